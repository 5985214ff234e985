"""Ranked lexical search: a tree of maxima over ranges of documents for each term, searched best first.

Documents are dealt into segments.  In a segment they are put in order by length, so that a range holds documents of
like weights, and each term has a tree over the places: the impact of its occurrences in a document, the largest
impact in 32 neighbouring places that has any, in 32 of those, and in the whole segment.  index() writes the trees down, a
row for each segment and term.

A search takes a segment's trees of its terms.  The bound of a range is the sum of the terms' maxima there, each times the
term's weight.  The range of the highest bound is opened first, down to single documents; what lies below the k-th
best score so far is never opened, what equals it is, since ties go to the smaller doc_id.  Each segment gives k documents
for each item, and the best k of those are the answer: segments share nothing but the terms' document counts.

Items are searched for in blocks of BLOCK_PAIRS terms, so what each task is told is bounded however many items there are.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import ascii_lower, run_starts, scratch

#: A maximal run of these is a term: all but the ASCII characters that are no letters or digits.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM = re.compile(TERM.encode())
#: Children of a node, as a power of two, and levels of ranges above the documents.
FAN, LEVELS = 5, 2
#: A segment has at most 32 * 32 * 32 documents, and ends when its texts come to so many bytes.
SEGMENT, SEGMENT_BYTES = 1 << (FAN * (LEVELS + 1)), 1 << 25
#: Pairs of an item and a term searched for together.
BLOCK_PAIRS = 200_000
#: If the items have no more terms than this, the index leaves all other terms out.
MOST_TERMS = 200_000
#: Rows of the index that a task passes on together.
ROWS = 20_000

INDEX = "segment long, term string, n_docs int, ids array<long>, top int, " + ", ".join(f"node{k} array<short>, max{k} array<int>" for k in range(LEVELS + 1))


def _lists(values: np.ndarray, kind: pa.DataType, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _weights(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    return 10 + 90 * n * documents // max(total, 1)


def _trees(segment: int, ids: list, n: np.ndarray, owner: np.ndarray, term: np.ndarray, names: list, documents: int, total: int) -> Iterator[pa.RecordBatch]:
    """The index rows of a segment: owner and term tell in which document each occurrence stands, n how many terms each has."""
    schema = pa.schema([("segment", pa.int64()), ("term", pa.string()), ("n_docs", pa.int32()), ("ids", pa.list_(pa.int64())), ("top", pa.int32())]
                       + [f for k in range(LEVELS + 1) for f in ((f"node{k}", pa.list_(pa.int16())), (f"max{k}", pa.list_(pa.int32())))])
    order = np.argsort(n, kind="stable")
    place = np.empty(len(n), np.int64)
    place[order] = np.arange(len(n))
    row = {"segment": [segment], "term": [None], "n_docs": [len(n)], "ids": [[ids[k] for k in order]], "top": [None]}
    yield pa.RecordBatch.from_pylist([{k: v[0] for k, v in row.items()}], schema)
    if not len(term):
        return
    key, tf = np.unique(term.astype(np.int64) * SEGMENT + place[owner], return_counts=True)
    tf, m = tf.astype(np.int64), _weights(n, documents, total)[order]
    level = [(key, 1_000_000_000 * tf // (1000 * tf + 8 * m[key % SEGMENT]))]
    for _ in range(LEVELS):
        up = level[-1][0] >> FAN
        starts, _ = run_starts(up)
        level.append((up[starts], np.maximum.reduceat(level[-1][1], starts)))
    terms = np.unique(key // SEGMENT)
    cuts = [np.searchsorted(k, np.r_[terms, terms[-1] + 1] * (SEGMENT >> (FAN * i))) for i, (k, _) in enumerate(level)]
    top = np.maximum.reduceat(level[-1][1], cuts[-1][:-1])
    for a in range(0, len(terms), ROWS):
        b = min(a + ROWS, len(terms))
        cols = [pa.array(np.full(b - a, segment)), pa.array([names[t].decode() for t in terms[a:b]], pa.string()), pa.array(np.diff(cuts[0][a : b + 1]), pa.int32()), pa.nulls(b - a, pa.list_(pa.int64())), pa.array(top[a:b], pa.int32())]
        for k, (nodes, most) in enumerate(level):
            s, e = cuts[k][a], cuts[k][b]
            cols += [_lists(nodes[s:e] % (SEGMENT >> (FAN * k)), pa.int16(), cuts[k][a : b + 1] - s), _lists(most[s:e], pa.int32(), cuts[k][a : b + 1] - s)]
        yield pa.RecordBatch.from_arrays(cols, schema=schema)


def index(docs: DataFrame, documents: int, total: int, terms: set[bytes] | None = None) -> DataFrame:
    """docs(doc_id, text) -> the trees of all terms, or of those asked for, as a written table of the columns INDEX.

    The row of a segment whose term is null lists its documents by place.  documents and total are those of measure().
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId() << 32
        fresh = (lambda: dict(zip(terms, range(len(terms)), strict=True))) if terms is not None else (lambda: defaultdict(lambda: len(vocabulary)))
        vocabulary, ids, n, found, size = fresh(), [], [], [], 0
        names = list(terms) if terms is not None else None

        def done() -> Iterator[pa.RecordBatch]:
            owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
            yield from _trees(segment, ids, np.array(n, np.int64), owner, np.concatenate(found), names if names is not None else list(vocabulary), documents, total)

        for b in batches:
            for d, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                words = _TERM.findall((text.as_py() or b"").lower())
                if terms is None:
                    place = [vocabulary[w] for w in words]
                else:
                    place = [k for w in words if (k := vocabulary.get(w)) is not None]
                ids.append(d)
                n.append(len(words))
                found.append(np.array(place, np.int32))
                size += len(text.as_py() or b"")
                if len(ids) == SEGMENT or size > SEGMENT_BYTES:
                    yield from done()
                    segment, ids, n, found, size = segment + 1, [], [], [], 0
                    vocabulary = fresh() if terms is None else vocabulary
        if ids:
            yield from done()

    return scratch(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, INDEX), "search-index")


def measure(docs: DataFrame) -> tuple[int, int]:
    """How many documents have a term, and how many terms all have."""
    counts = docs.select(F.regexp_count("text", F.lit(TERM)).alias("n"))
    got = counts.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    return got["documents"], got["total"]


class _Segment:
    """The trees of one segment, for the terms of a block."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        head = table.filter(pa.compute.is_null(table["term"]))
        self.ids = head["ids"].combine_chunks().flatten()
        self.order = self.ids.fill_null(2**63 - 1).to_numpy(zero_copy_only=False)
        table = table.filter(pa.compute.is_valid(table["term"]))
        self.row = {t: k for k, t in enumerate(table["term"].to_pylist())}
        self.top = table["top"].to_numpy().astype(np.int64)
        self.keys, self.most = [], []
        for k in range(LEVELS + 1):
            nodes, most = (table[f"{c}{k}"].combine_chunks() for c in ("node", "max"))
            sizes = np.diff(nodes.offsets.to_numpy())
            self.keys.append(np.repeat(np.arange(len(sizes)) * (SEGMENT >> (FAN * k)), sizes) + nodes.flatten().to_numpy().astype(np.int64))
            self.most.append(most.flatten().to_numpy())

    def _open(self, rows: np.ndarray, w: np.ndarray, level: int, node: int) -> np.ndarray:
        """The bounds of a node's children on `level`; on level 0 these are the documents' scores."""
        first = rows * (SEGMENT >> (FAN * level)) + (node << FAN)
        lo, hi = np.searchsorted(self.keys[level], first), np.searchsorted(self.keys[level], first + (1 << FAN))
        size = hi - lo
        at = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
        bounds = np.zeros(1 << FAN, np.int64)
        np.add.at(bounds, self.keys[level][at] - np.repeat(first, size), np.repeat(w, size) * self.most[level][at])
        return bounds

    def best(self, terms: list[tuple[str, int]], k: int) -> list[tuple[int, int]]:
        """(score, place) of the k best documents of the segment for these weighted terms."""
        held = [(self.row[t], w) for t, w in terms if t in self.row]
        if not held:
            return []
        rows, w = (np.array(x, np.int64) for x in zip(*held, strict=True))
        opened, best = [(-int((w * self.top[rows]).sum()), LEVELS, 0)], []
        while opened:
            bound, level, node = heapq.heappop(opened)
            if len(best) == k and -bound < best[0][0]:
                break
            sums = self._open(rows, w, level, node)
            least = best[0][0] if len(best) == k else 1
            for child in np.flatnonzero(sums >= max(least, 1)).tolist():
                place, s = (node << FAN) + child, int(sums[child])
                if level:
                    heapq.heappush(opened, (-s, level - 1, place))
                    continue
                row = (s, -int(self.order[place]), place)
                if len(best) < k:
                    heapq.heappush(best, row)
                else:
                    heapq.heappushpop(best, row)
        return [(s, place) for s, _, place in best]


def _items(items: DataFrame) -> DataFrame:
    """item, item_id, terms: a row for each item_id."""
    each = items.select("item_id", F.array_distinct(F.regexp_extract_all(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(TERM), F.lit(0))).alias("terms"))
    united = each.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))
    return scratch(united.where(F.size("terms") > 0).select(F.monotonically_increasing_id().alias("item"), "item_id", "terms"), "items")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """docs(doc_id, text), items(item_id, text) -> item_id, rank, doc_id, score of each item's k best documents.

    The score is the sum of w * ((10**9 * tf) div (1000 * tf + 8 * m)) over the item's distinct terms.  Documents of
    equal scores come by doc_id, a null one last.  Documents whose score is 0 don't appear, so null and empty texts on
    either side give no rows; rows that repeat a doc_id are ranked each for itself; rows that repeat an item_id (null
    is one of its own) are one item with the terms of all.  Other columns are ignored; an empty table gives none.
    """
    spark, asked = docs.sparkSession, _items(items)
    pairs = asked.select("item", F.explode("terms").alias("term"))
    wanted = pairs.select("term").distinct().limit(MOST_TERMS + 1).collect()
    documents, total = measure(docs)
    trees = index(docs, documents, total, {r["term"].encode() for r in wanted} if len(wanted) <= MOST_TERMS else None)
    df = scratch(trees.where("term is not null").groupBy("term").agg(F.sum("n_docs").alias("df")), "document-counts")
    w = F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * documents + 2)) / (2 * F.col("df") + 1))).alias("w")
    weighed = scratch(pairs.join(df, "term").select("item", "term", w), "item-terms")
    blocks, parts = max(1, -(-weighed.count() // BLOCK_PAIRS)), []
    for block in range(blocks):
        own = weighed.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        asked_for = defaultdict(list)
        for r in own.collect():
            asked_for[r["item"]].append((r["term"], r["w"]))
        named = spark.createDataFrame([(t,) for t in sorted({t for ts in asked_for.values() for t, _ in ts})], "term string")
        met = trees.where("term is null").unionByName(trees.where("term is not null").join(F.broadcast(named), "term", "left_semi"))
        parts.append(scratch(met.groupBy("segment").applyInArrow(_searcher(dict(asked_for), k), "item long, doc_id long, score long"), "found"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    top = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return top.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _searcher(asked_for: dict, k: int):
    def run(table: pa.Table) -> pa.Table:
        segment, out = _Segment(table), []
        for item, terms in asked_for.items():
            out += [(item, place, s) for s, place in segment.best(terms, k)]
        item, place, score = (np.array(x, np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        return pa.table({"item": item, "doc_id": segment.ids.take(pa.array(place)), "score": score})

    return run
