"""Substring deduplication over fixed-block anchors.

Every document is cut into non-overlapping blocks of BLOCK words, the anchors.  WINDOW >= 2 * BLOCK - 1, so any
window of WINDOW words holds a whole anchor of the document it stands in, and any other document that repeats that
window shows the anchor's words at some offset.  So:

1. index: the hashes of all anchors, as a bit table (and those of anchors that several places hold);
2. probe: every rolling window of BLOCK words of every document, against the index; what is hit is marked;
3. extend: around marked words, the windows of WINDOW words are compared (by 96 bits of hash) over all documents,
   each against the smallest doc_id that holds it; adjoining ones make up the maximal repeats.  Of a window that is
   frequent a task sends on the smallest document's alone, so what meets on it is a few rows a task.

The bit tables only let through what may repeat; step 3 decides.  They grow with the text up to a fixed size, past
which more windows are compared and the result stays the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bit_blocks, bit_table, maybe, mix64, scratch, small_batches

WINDOW, BLOCK = 13, 7
#: A bit table has 2**MOST_BITS bits at most (128 MB), in slices of 2**SLICE.
MOST_BITS, SLICE = 30, 16
#: Bits of the table that tells which documents lose words: 64 MB at most.
DOC_BITS = 1 << 29
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Windows that a task compares with one another before they leave it.
HELD = 800_000
#: Words of more bytes than this are hashed one by one.
LONG = 1024

_rng = np.random.default_rng(20)
#: A value for each byte, zero for white space, and the powers that tell places in a word apart.
_VALUES = _rng.integers(1, 2**64, 256, np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUES[_SPACE] = 0
_POWERS = np.multiply.accumulate(np.full(LONG, 0xD1342543DE82EF95, np.uint64))


def _flat(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all texts in a row, and where each text begins (one more for the end)."""
    sizes = np.array([0, *(len(t or b"") + 1 for t in texts)])
    data = np.frombuffer(b" " + b" ".join(t or b"" for t in texts) + b" ", np.uint8)
    space = _SPACE[data]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    begins = np.searchsorted(starts, np.cumsum(sizes) + 1)
    if not len(starts):
        return np.zeros(0, np.uint64), begins
    data = data[starts[0] :]
    place = np.arange(len(data)) - np.repeat(starts - starts[0], np.diff(np.r_[starts, len(data) + starts[0]]))
    h = np.add.reduceat(_VALUES[data] * _POWERS[np.minimum(place, LONG - 1)], starts - starts[0])
    for k in np.flatnonzero(ends - starts > LONG):
        h[k] = xxhash.xxh3_64_intdigest(data[starts[k] - starts[0] : ends[k] - starts[0]].tobytes())
    return mix64(h + (ends - starts).astype(np.uint64)), begins


def _rolling(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each place on (places too near the end are left out)."""
    m = max(0, len(words) - n + 1)
    h = words[:m].copy()
    for k in range(1, n):
        h *= BASE
        h += words[k : k + m]
    return mix64(h)


def _fits(begins: np.ndarray, n: int, m: int) -> np.ndarray:
    """Which of the first m places have n words left in their own text."""
    ends = np.repeat(begins[1:], np.diff(begins))[:m]
    return np.arange(m) + n <= ends


def _bits(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a hash, both in one slice of the table."""
    low = np.uint64((1 << SLICE) - 1)
    top = (h >> np.uint64(64 - (bits - SLICE))) << np.uint64(SLICE) if bits > SLICE else np.zeros(len(h), np.uint64)
    return (top | (h & low)).astype(np.int64), (top | ((h >> np.uint64(20)) & low)).astype(np.int64)


def _has(table: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    a, b = _bits(h, bits)
    return ((table[a >> 3] >> (a & 7).astype(np.uint8)) & (table[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)


def _put(table: np.ndarray, h: np.ndarray, bits: int) -> None:
    for at in _bits(h, bits):
        np.bitwise_or.at(table, at >> 3, (1 << (at & 7)).astype(np.uint8))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _parts(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut where their texts come to about `most` bytes: hashing takes some 40 bytes of memory for each."""
    for b in batches:
        upto, start = np.cumsum([0, *(len(t or b"") for t in _texts(b))]), 0
        while start < b.num_rows:
            end = max(start + 1, int(np.searchsorted(upto, upto[start] + most, side="right")) - 1)
            yield b.slice(start, end - start)
            start = end


def _texts(b: pa.RecordBatch) -> list:
    return b.column("text").cast(pa.binary()).to_pylist()


def _gather(hashes: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit tables of all hashes (column h), and of those that may be there twice.  Every task owns whole slices."""

    size = 1 << SLICE

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict = {}  # slice -> where its cells are
        cells = np.zeros(0, np.uint8)

        def add(h: np.ndarray) -> np.ndarray:
            x, y = _bits(h, bits)
            tops, own = np.unique(x >> SLICE, return_inverse=True)
            at = np.array([place.setdefault(t, len(place)) for t in tops.tolist()], np.int64)[own] << SLICE if len(h) else x
            grown = np.zeros(len(place) << SLICE, np.uint8)
            grown[: len(cells)] = cells
            u, v = at | (x & (size - 1)), at | (y & (size - 1))
            hit, n = np.unique(np.concatenate([u, v[u != v]]), return_counts=True)
            grown[hit] = np.minimum(grown[hit] + np.minimum(n, 2), 2)
            return grown

        held, n = [], 0
        for b in batches:
            held.append(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            n += len(held[-1])
            if n > 1_000_000:
                cells, held, n = add(np.concatenate(held)), [], 0
        if n:
            cells = add(np.concatenate(held))
        for top, k in place.items():
            own = cells[k << SLICE : (k + 1) << SLICE]
            once, twice = (np.packbits(own > t, bitorder="little").tobytes() for t in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array([top], pa.int64()), pa.array([once]), pa.array([twice])], ["slice", "once", "twice"])

    top = F.shiftrightunsigned("h", 64 - (bits - SLICE)) if bits > SLICE else F.lit(0)
    owned = hashes.repartition(top).mapInArrow(build, "slice long, once binary, twice binary")
    tables = np.zeros((2, 1 << (bits - 3)), np.uint8)
    for row in owned.collect():  # 2**bits / 8 bytes in all
        at = row["slice"] << (SLICE - 3)
        for k in (0, 1):
            tables[k, at : at + (1 << (SLICE - 3))] |= np.frombuffer(row[k + 1], np.uint8)
    return tables[0], tables[1]


def _merge(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """keys sorted with docs: (first of its key, belongs to its key's smallest doc)."""
    first = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, bool)
    least = docs[np.flatnonzero(first)][np.cumsum(first) - 1] if len(keys) else docs
    return first, docs == least


def repeated_windows(docs: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """docs(doc, text, version) -> (doc, version, place): the starts of windows that a smaller doc has too."""
    spark = docs.sparkSession
    octets = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = SLICE + 2
    while bits < most_bits and (1 << bits) < octets / 6 / BLOCK * 10:
        bits += 1

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros((2, 1 << (bits - 3)), np.uint8)
        for b in _parts(batches):
            words, begins = _flat(_texts(b))
            h = _rolling(words, BLOCK)
            place = np.arange(len(h)) - np.repeat(begins[:-1], np.diff(begins))[: len(h)]
            h = np.sort(h[_fits(begins, BLOCK, len(h)) & (place % BLOCK == 0)])
            second = np.r_[False, h[1:] == h[:-1]]
            third = np.r_[False, False, h[2:] == h[:-2]] if len(h) > 1 else second
            # a hash goes out twice from a task at most
            go = ~third & ~_has(twice, h, bits)
            again = second | _has(once, h, bits)
            _put(once, h, bits)
            _put(twice, h[again], bits)
            yield pa.RecordBatch.from_arrays([_signed(h[go])], ["h"])

    index, often = _gather(docs.select("text").mapInArrow(anchors, "h long"), bits)
    index, often = spark.sparkContext.broadcast(index), often

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = np.zeros(1 << (bits - 3), np.uint8)
        for b in _parts(batches):
            words, begins = _flat(_texts(b))
            h = _rolling(words, BLOCK)
            place = np.arange(len(h)) - np.repeat(begins[:-1], np.diff(begins))[: len(h)]
            h = h[_fits(begins, BLOCK, len(h)) & (place % BLOCK != 0)]
            h = np.unique(h[_has(index.value, h, bits)])
            h = h[~_has(sent, h, bits)]
            _put(sent, h, bits)
            yield pa.RecordBatch.from_arrays([_signed(h)], ["h"])

    hit, _ = _gather(docs.select("text").mapInArrow(probes, "h long"), bits)
    marked = spark.sparkContext.broadcast(hit | often)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each window that a task sees, only the smallest doc's goes on; the others are known to repeat."""
        kept: list = []
        for b in _parts(batches):
            words, begins = _flat(_texts(b))
            near = _has(marked.value, h := _rolling(words, BLOCK), bits) & _fits(begins, BLOCK, len(h))
            full = _fits(begins, WINDOW, m := max(0, len(words) - WINDOW + 1))
            upto = np.r_[0, np.cumsum(near)]
            at = np.flatnonzero(full & (upto[WINDOW - BLOCK + 1 :][:m] - upto[:m] > 0))
            row = np.searchsorted(begins, at, side="right") - 1
            one = _rolling(words, WINDOW)[at]
            two = (_rolling(mix64(words ^ np.uint64(0xA5A5A5A5A5A5A5A5)), WINDOW)[at] >> np.uint64(32)).astype(np.int64)
            doc, version = (b.column(c).to_numpy(zero_copy_only=False)[row] for c in ("doc", "version"))
            kept.append((one, two, doc, version, (at - begins[row]).astype(np.int64)))
            if sum(len(x[0]) for x in kept) > HELD:
                yield from settle(kept)
                kept = []
        if kept:
            yield from settle(kept)

    def settle(kept: list) -> Iterator[pa.RecordBatch]:
        one, two, doc, version, place = (np.concatenate(x) for x in zip(*kept, strict=True))
        order = np.argsort(one, kind="stable")
        keys = np.empty(len(one), [("a", np.uint64), ("b", np.int64)])
        keys["a"], keys["b"] = one[order], two[order]
        first = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, bool)
        starts = np.flatnonzero(first)
        mine = np.empty(len(one), bool)
        if len(starts):
            mine[order] = doc[order] == np.minimum.reduceat(doc[order], starts)[np.cumsum(first) - 1]
        yield from packed(doc[~mine], version[~mine], place[~mine])
        on = np.flatnonzero(mine)  # in the order of the texts: neighbours are alike, so they compress
        for s in range(0, len(on), 50_000):
            pick = on[s : s + 50_000]
            yield pa.RecordBatch.from_arrays(
                [_signed(one[pick]), pa.array(place[pick] << 32 | two[pick]), pa.array(doc[pick]), pa.array(version[pick]), pa.nulls(len(pick), pa.list_(pa.int32()))], ["k1", "k2", "doc", "version", "places"],
            )

    def packed(doc: np.ndarray, version: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
        """One row for each document, its places as steps from one to the next; k1 spreads these rows over the partitions."""
        order = np.lexsort((place, version, doc))
        doc, version, place = doc[order], version[order], place[order].astype(np.int32)
        if not len(doc):
            return
        new = np.r_[True, (doc[1:] != doc[:-1]) | (version[1:] != version[:-1])]
        at = np.flatnonzero(new)
        steps = np.where(new, place, np.diff(place, prepend=0)).astype(np.int32)
        for s in range(0, len(at), 2048):
            begin = at[s : s + 2048]
            end = at[s + 2048] if s + 2048 < len(at) else len(doc)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[begin, end] - begin[0], pa.int32()), pa.array(steps[begin[0] : end]))
            n = len(begin)
            yield pa.RecordBatch.from_arrays(
                [pa.array(mix64(doc[begin].astype(np.uint64)).view(np.int64)), pa.nulls(n, pa.int64()), pa.array(doc[begin]), pa.array(version[begin]), lists], ["k1", "k2", "doc", "version", "places"]
            )

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by window and doc: what is not of a window's first doc repeats.  (doc, version, place) go out."""
        last, least = (None, None), None
        held: list = []

        def out() -> pa.RecordBatch:
            doc, version, place = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((place, doc))  # neighbours are alike, so they compress
            return pa.RecordBatch.from_arrays([pa.array(c[order]) for c in (doc, version, place.astype(np.int32))], ["doc", "version", "place"])

        for b in batches:
            done = b.column("places").is_valid().to_numpy(zero_copy_only=False)
            if done.any():
                known = b.filter(pa.array(done))
                lists, doc, version = known.column("places"), known.column("doc").to_numpy(), known.column("version").to_numpy()
                sizes, steps = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy().astype(np.int64)
                upto, starts = np.cumsum(steps), np.cumsum(sizes) - sizes
                held.append((np.repeat(doc, sizes), np.repeat(version, sizes), upto - np.repeat(upto[starts] - steps[starts], sizes)))
            b = b.filter(pa.array(~done))
            if b.num_rows:
                one, rest, doc, version = (b.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2", "doc", "version"))
                keys = np.empty(len(one), [("a", np.int64), ("b", np.int64)])
                keys["a"], keys["b"] = one, rest & 0xFFFFFFFF
                first, mine = _merge(keys, doc)
                if (keys["a"][0], keys["b"][0]) == last:  # the window went on from the batch before
                    n = int(np.flatnonzero(np.r_[first[1:], True])[0]) + 1
                    mine[:n] = doc[:n] == least
                else:
                    least = None
                z = int(np.flatnonzero(first)[-1])
                if z or least is None:
                    least = doc[z]
                last = (keys["a"][-1], keys["b"][-1])
                held.append((doc[~mine], version[~mine], rest[~mine] >> 32))
            if sum(len(x[0]) for x in held) > HELD:
                yield out()
                held.clear()
        if held:
            yield out()

    windows = docs.mapInArrow(extend, "k1 long, k2 long, doc long, version int, places array<int>")
    sorted_ = windows.repartition("k1").sortWithinPartitions("k1", F.col("k2").bitwiseAND(F.lit(0xFFFFFFFF)), "doc")
    return sorted_.mapInArrow(decide, "doc long, version int, place int")


def substring_dedup(docs: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, n_removed, kept_text.

    Words are [^\\x20\\x09-\\x0D]+.  A word goes if a window of 13 words over it also starts in a document of a smaller
    doc_id.  A null or empty text has no words.  Rows that repeat a doc_id are one document: neither removes from
    the other.  A null doc_id counts as the largest.  Texts of under 13 words keep all.  Other columns are ignored;
    an empty table gives none.
    """
    spark = docs.sparkSession
    small_batches(spark, 2048)
    keyed = docs.select("doc_id", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc"), "text", F.hash("text").alias("version"))
    found = scratch(repeated_windows(keyed.select("doc", "text", "version"), most_bits), "repeated-windows")
    # documents without any pass straight through, the others meet their places
    who = F.xxhash64("doc", "version")
    hashes = found.select(who.alias("h")).distinct()
    blocks = bit_blocks(hashes.count(), DOC_BITS)
    asked = maybe(keyed, who, bit_table(hashes, blocks), blocks)
    none = lambda kind: F.lit(None).cast(kind)
    rows = asked.where("__maybe").select("doc", "version", F.lit(1).alias("kind"), "doc_id", "text", none("int").alias("place")).unionByName(
        found.select("doc", "version", F.lit(0).alias("kind"), none("long").alias("doc_id"), none("string").alias("text"), "place")
    )

    def result(done: list) -> pa.RecordBatch:
        ids, sizes, removed, texts = zip(*done, strict=True) if done else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [(t or b"").split() for t in _texts(b)]
            yield result([(i, len(w), 0, b" ".join(w)) for i, w in zip(b.column("doc_id").to_pylist(), words, strict=True)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A document's places come before its text."""
        now, places = None, []
        for b in batches:
            doc, version, kind = (b.column(c).to_numpy() for c in ("doc", "version", "kind"))
            place = b.column("place").fill_null(0).to_numpy()
            starts = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (version[1:] != version[:-1])]) if len(doc) else []
            done = []
            for s, e in zip(starts, [*starts[1:], len(doc)], strict=True):
                if (doc[s], version[s]) != now:
                    now, places = (doc[s], version[s]), []
                own = int((kind[s:e] == 0).sum())
                if own:
                    places.append(place[s : s + own])
                for k in range(s + own, e):
                    words, gone = (b.column("text")[k].as_py() or "").encode().split(), 0
                    if places:
                        at = np.unique(np.concatenate(places))
                        edges = np.zeros(len(words) + 1, np.int64)
                        edges[at] += 1
                        np.subtract.at(edges, at + WINDOW, 1)
                        stay = np.cumsum(edges)[:-1] == 0
                        gone = int(len(words) - stay.sum())
                        words = [w for w, x in zip(words, stay.tolist(), strict=True) if x]
                    done.append((b.column("doc_id")[k].as_py(), len(words) + gone, gone, b" ".join(words)))
            yield result(done)

    kinds = "doc_id long, n_words long, n_removed long, kept_text string"
    straight = asked.where("not __maybe").select("doc_id", "text").mapInArrow(whole, kinds)
    return straight.unionByName(rows.repartition("doc").sortWithinPartitions("doc", "version", "kind").mapInArrow(cut, kinds))
