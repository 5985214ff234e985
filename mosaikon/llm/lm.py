"""Scores of texts by an n-gram model of the corpus, kept in Elias-Fano tries.

    p3(w | u v) = share + rest * p2(w | v)       share = c(u v w) / (c(u v) + MU3),  rest = MU3 / (c(u v) + MU3)
    p2(w | v)   = the same with c(v w), c(v), MU2 and p1
    p1(w)       = (c(w) + 0.1) / (N + 0.1 * (V + 1))

Shares and rests are what the tries hold, in codes of twelve bits.  A model of the whole corpus fits into no task, so it is
dealt out, and texts and model meet like this:

1. Texts are cut into segments of some million tokens and written as word numbers, each segment with its own words.
2. A segment sends its distinct n-grams of three words with their counts to the shard that owns their middle word, as one
   packed row a shard: an n-gram that is frequent in a segment is sent once.
3. A shard adds up the counts, of two words too, builds its tries, looks all that was sent up in them, and sends codes back
   for what p3 is made of beside p1.
4. The segment puts the codes in the places of its n-grams and adds the logarithms up, document by document.

A middle word with a good part of a shard's n-grams is dealt out by the word before it, and a context of two words that is as
frequent by the word after it.  Their counts don't come together in one shard then, so they are added up beforehand, and
n-grams of two words are sent for such words, dealt out by both.  Which contexts those are is estimated from a sample; that
decides where n-grams go and not what comes out.  There are at most MOST_HOT of each kind, by the threshold they must pass.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mix64, scratch
from .trie import Trie, distinct, meaning, places, quantised

#: How much weight the next shorter context has, in counts.
MU2, MU3 = 32.0, 2.0
#: Tokens and documents of a segment, and tokens a shard should have.
SEGMENT, SEGMENT_DOCS, SHARD = 2_500_000, 1 << 16, 3_000_000
#: N-grams of a shard, as the segments sent them, that are put into tries at a time; those of one middle word stay together.
STEP = 400_000
#: A context is hot from this part of a shard, but never under one in MOST_HOT of all tokens.
HOT, MOST_HOT = 4, 1_000_000
#: One in how many documents tells which contexts are hot.
SAMPLED = 64
#: The end of a text and what stands before its beginning; no word is empty or has white space.
END, BEGIN = b"", b"\n"
#: Bits by which words are told apart within a shard, which has a million or so however large the corpus: one in two
#: million meets another there.  Counts of words use the words.
WORD_BITS = 40

_PART = "level int, shard int, segment long, blob binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Whole numbers from 0 on, in as few bytes each as the largest needs, plane by plane, compressed."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a, np.uint64)
        width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
        planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :width].T)
        data = zstandard.ZstdCompressor(level=3).compress(planes.tobytes())
        out += [struct.pack("<BQQ", width, len(a), len(data)), data]
    return b"".join(out)


def unpack(blob: bytes) -> list[np.ndarray]:
    at, out = 0, []
    while at < len(blob):
        width, n, size = struct.unpack_from("<BQQ", blob, at)
        at += 17
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[at : at + size], max_output_size=n * width + 1), np.uint8).reshape(width, n)
        kind = np.dtype(np.uint8 if width == 1 else np.uint16 if width == 2 else np.uint32 if width <= 4 else np.int64)
        whole = np.zeros((n, kind.itemsize), np.uint8)
        whole[:, :width] = planes.T
        out.append(whole.view(kind).reshape(n))
        at += size
    return out


def _pack_words(words: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b" ".join(words))


def _unpack_words(blob: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompressobj().decompress(blob).split(b" ")


def segments(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> a written row for each segment: its documents in order, their sizes and word numbers, its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId() << 32
        number, ids, learn, sizes, tokens, size = {END: 0, BEGIN: 1}, [], [], [], [], 0

        def done() -> pa.RecordBatch:
            blob = pack(np.array(sizes), np.array(learn), np.concatenate(tokens))
            return pa.RecordBatch.from_arrays(
                [pa.array([segment]), pa.array([ids], pa.list_(pa.int64())), pa.array([size]), pa.array([blob], pa.binary()), pa.array([_pack_words(list(number))], pa.binary())],
                ["segment", "ids", "n", "blob", "words"],
            )

        for b in batches:
            for d, text, own in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), b.column(2).to_pylist(), strict=True):
                words = (text.as_py() or b"").lower().split()  # both know ASCII only
                tokens.append(np.array([number.setdefault(w, len(number)) for w in words] + [0], np.uint32))
                ids.append(d)
                learn.append(own)
                sizes.append(len(words) + 1)
                size += len(words) + 1
                if size >= SEGMENT or len(ids) >= SEGMENT_DOCS:
                    yield done()
                    segment, number, ids, learn, sizes, tokens, size = segment + 1, {END: 0, BEGIN: 1}, [], [], [], [], 0
        if ids:
            yield done()

    learn = F.coalesce((F.crc32(F.col("doc_id").cast("string")) % 10 != 0).cast("int"), F.lit(1))
    each = docs.select(F.col("doc_id").cast("long"), "text", learn.alias("learn"))
    return scratch(each.mapInArrow(run, "segment long, ids array<long>, n long, blob binary, words binary"), "segments")


class _Segment:
    def __init__(self, blob: bytes, words: bytes):
        self.sizes, learn, self.tokens = unpack(blob)
        self.sizes, self.tokens = self.sizes.astype(np.int64), self.tokens.astype(np.int64)
        self.words = _unpack_words(words)
        self.learn = np.repeat(learn.astype(bool), self.sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.hashes = mix64(np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.words), np.uint64, len(self.words))) >> np.uint64(64 - WORD_BITS)

    def histories(self) -> tuple[np.ndarray, np.ndarray]:
        """The word before each token, and the one before that."""
        before = np.r_[1, self.tokens[:-1]]
        before[self.starts] = 1
        second = np.r_[1, before[:-1]]
        second[self.starts] = 1
        return before, second

    def context_hashes(self, level: int) -> np.ndarray:
        before, second = self.histories()
        h = mix64(self.hashes + np.uint64(2))[before]
        return h if level == 2 else _pair(h, self.hashes[second])

    def ngrams(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct contexts (word numbers), owner and next word of each distinct n-gram, its count, and the n-gram of each token."""
        before, second = self.histories()
        v = len(self.words)
        code = before if level == 2 else before * v + second
        del before, second
        code, which = np.unique(code, return_inverse=True)
        contexts = code[:, None] if level == 2 else np.stack([code % v, code // v], 1)
        key, gram = np.unique(which * v + self.tokens, return_inverse=True)
        return contexts, key // v, key % v, np.bincount(gram, self.learn, len(key)).astype(np.int64), gram

    def dealt(self, level: int, contexts: np.ndarray, owner: np.ndarray, follows: np.ndarray, shards: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams to be sent in the order of their shards, and where each shard begins."""
        last = mix64(self.hashes + np.uint64(2))[contexts[:, -1]]
        spread = np.isin(last, hot)
        if level == 2:
            sent = np.flatnonzero(spread[owner])
            own = mix64(last[owner[sent]] ^ self.hashes[follows[sent]])
        else:
            both = _pair(last, self.hashes[contexts[:, 0]])
            own = np.where(spread, both, last)[owner]
            apart, sent = np.flatnonzero(np.isin(both, hot)[owner]), np.arange(len(owner))
            own[apart] = mix64(both[owner[apart]] ^ self.hashes[follows[apart]])
        shard = (own % np.uint64(shards)).astype(np.int32)
        order = np.argsort(shard, kind="stable")
        return sent[order], np.searchsorted(shard[order], np.arange(shards + 1))


def _pair(last: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The hash of a context of two words, from that of the last as a context and that of the first."""
    return mix64(last ^ mix64(first + np.uint64(3)))


def _rows(b: pa.RecordBatch) -> Iterator[tuple[int, list, _Segment]]:
    for k in range(b.num_rows):
        yield b.column("segment")[k].as_py(), b.column("ids")[k], _Segment(b.column("blob")[k].as_py(), b.column("words")[k].as_py())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    level, shard, segment, blob = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(level, pa.int32()), pa.array(shard, pa.int32()), pa.array(segment, pa.int64()), pa.array(blob, pa.binary())], ["level", "shard", "segment", "blob"])


def _word_shards(s: _Segment, shards: int) -> list[np.ndarray]:
    shard = (s.hashes % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    return np.split(order, np.searchsorted(shard[order], np.arange(1, shards)))


def _ask_words(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for segment, _, s in _rows(b):
                n = np.bincount(s.tokens[s.learn], minlength=len(s.words))
                for shard, own in enumerate(_word_shards(s, shards)):
                    if len(own):
                        words = _pack_words([s.words[k] for k in own])
                        yield _batch([(1, shard, segment, struct.pack("<Q", len(words)) + words + pack(n[own]))])

    return run


def _answer_words(table: pa.Table) -> pa.Table:
    """The counts of the words of a shard over all segments, for each segment; and how many words and tokens the shard has."""
    words, counts, sizes = [], [], []
    for blob in table["blob"].to_pylist():
        (size,) = struct.unpack_from("<Q", blob)
        words.append(pa.array(_unpack_words(blob[8 : 8 + size]), pa.binary()))
        counts.append(unpack(blob[8 + size :])[0])
        sizes.append(len(counts[-1]))
    code = pa.chunked_array(words).combine_chunks().dictionary_encode().indices.to_numpy()
    total = np.bincount(code, np.concatenate(counts)).astype(np.int64)
    blobs = [pack(total[c]) for c in np.split(code, np.cumsum(sizes)[:-1])]
    n = len(blobs)
    return pa.table({"level": table["level"], "shard": table["shard"], "segment": table["segment"], "blob": pa.array(blobs, pa.binary()), "words": pa.array([int((total > 0).sum())] * n), "tokens": pa.array([int(total.sum())] * n)})


def _context_counts(hot: np.ndarray | None):
    """(level, h, n): tokens after each context in a sample of documents, or after each hot context in all that are learnt from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, s in _rows(b):
                for level in (2, 3):
                    h = s.context_hashes(level)
                    if hot is None:
                        h = h[np.repeat(np.arange(len(s.sizes)) % SAMPLED == 0, s.sizes)]
                    else:
                        h = h[s.learn & np.isin(h, hot)]
                    h, n = np.unique(h, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), level, np.int32)), pa.array(h.view(np.int64)), pa.array(n)], ["level", "h", "n"])

    return run


def _hot_contexts(cut: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of hot contexts in rising order, and how many tokens to learn from follow each."""
    least = max(SHARD // HOT, total // MOST_HOT)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if total < least:
        return none
    counts = lambda hot: cut.mapInArrow(_context_counts(hot), "level int, h long, n long").groupBy("level", "h").agg(F.sum("n").alias("n"))
    found = counts(None).where(F.col("n") * SAMPLED > least).select("h").toPandas()["h"].to_numpy(np.int64)
    if not len(found):
        return none
    hot = np.unique(found.view(np.uint64))
    exact = counts(hot).toPandas()
    h, n = exact["h"].to_numpy(np.int64).view(np.uint64), exact["n"].to_numpy(np.int64)
    totals = np.zeros(len(hot), np.int64)
    totals[np.searchsorted(hot, h)] = n
    return hot, totals


def _ask(shards: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for segment, _, s in _rows(b):
                for level in (2, 3) if len(hot) else (3,):
                    contexts, owner, follows, n, _ = s.ngrams(level)
                    order, cuts = s.dealt(level, contexts, owner, follows, shards, hot)
                    for shard in range(shards):
                        own = order[cuts[shard] : cuts[shard + 1]]
                        if not len(own):
                            continue
                        heads, at = np.unique(owner[own], return_index=True)
                        # numbers rise with those of the segment, where frequent words come early
                        words, named = np.unique(np.r_[contexts[heads].T.ravel(), follows[own]], return_inverse=True)
                        k = len(heads)
                        code = named[:k] if level == 2 else named[k : 2 * k] * len(words) + named[:k]
                        yield _batch([(level, shard, segment, pack(s.hashes[words], np.diff(code, prepend=0), np.diff(np.r_[at, len(own)]), named[k * (level - 1) :], n[own]))])

    return run


def _lookup(contexts: np.ndarray, owner: np.ndarray, follows: np.ndarray, n: np.ndarray, total: np.ndarray, mu: float, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The share of each n-gram and the rest of each context, by way of a trie of those that were learnt."""
    learnt, seen = np.flatnonzero(n > 0), np.flatnonzero(np.bincount(owner, n, len(contexts)) > 0)
    if not len(learnt):
        return np.zeros(len(n)), mu / (total + mu)
    place = np.zeros(len(contexts), np.int64)
    place[seen] = np.arange(len(seen))
    trie = Trie(contexts[seen], follows[learnt], place[owner[learnt]], n[learnt] / (total[owner[learnt]] + mu), mu / (total[seen] + mu), words)
    share, rest = trie.find(contexts, follows, owner)
    # not learnt at all, or in other shards only
    return meaning(share), np.where(rest > 0, meaning(rest), mu / (total + mu))


def _codes(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, quantised(np.maximum(p, 1e-300)), 0)


def _answer(hot: np.ndarray, totals: np.ndarray):
    """A shard: all n-grams of some contexts, from all segments."""

    def known(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which contexts are dealt out, and what they come to together."""
        if not len(hot):
            return np.zeros(len(h), bool), np.zeros(len(h))
        at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
        return hot[at] == h, totals[at]

    def part(level: int, contexts: np.ndarray, last: np.ndarray, code: np.ndarray, counts: np.ndarray, first: np.ndarray, v: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all n-grams of some middle words, code = context * v + next word, and of their contexts."""
        key, gram = np.unique(code, return_inverse=True)
        gram = gram.astype(np.uint32)
        n = np.bincount(gram, counts, len(key))
        owner, follows = key // v, key % v
        del key, code, counts
        spread, all_of = known(last)
        if level == 2:
            share, rest = _lookup(contexts, owner, follows, n, all_of, MU2, v)
        else:
            apart, all_of = known(_pair(last, first))
            share, rest = _lookup(contexts, owner, follows, n, np.where(apart, all_of, np.bincount(owner, n, len(contexts))), MU3, v)
            # n-grams of two words whose last context isn't dealt out are whole here
            near = ~spread[owner]
            pair, which2 = np.unique(contexts[owner[near], 1] * v + follows[near], return_inverse=True)
            middle, owner2 = np.unique(pair // v, return_inverse=True)
            n2 = np.bincount(which2, n[near], len(pair))
            share2, rest2 = _lookup(middle[:, None], owner2, pair % v, n2, np.bincount(owner2, n2, len(middle)), MU2, v)
            share[near] += rest[owner[near]] * share2[which2]
            near = np.flatnonzero(~spread)
            rest[near] *= rest2[places(middle, contexts[near, 1])]
        return _codes(share).astype(np.uint16)[gram], _codes(rest).astype(np.uint16)

    def run(table: pa.Table) -> pa.Table:
        level = table["level"][0].as_py()
        parts = [unpack(blob.as_py()) for blob in table["blob"]]
        words = distinct(np.concatenate([p[0] for p in parts]))
        v, code, grams = len(words), [], []
        for p in parts:
            hashes, gaps, _, follows, _ = p
            ids, c = places(words, hashes), np.cumsum(gaps, dtype=np.int64)
            code.append(ids[c] if level == 2 else ids[c % len(hashes)] * v + ids[c // len(hashes)])
            grams.append(ids.astype(np.uint32)[follows])
            p[0] = p[1] = p[3] = None
        sizes, many = [len(p[2]) for p in parts], [len(p[4]) for p in parts]
        code, which = np.unique(np.concatenate(code), return_inverse=True)
        which = which.astype(np.uint32)
        owner = np.repeat(which, np.concatenate([p[2] for p in parts]))
        grams, counts = np.concatenate(grams), np.concatenate([p[4] for p in parts])
        del parts
        # what a middle word needs is its own, so the shard is answered some middle words at a time
        middle = (code if level == 2 else code % v).astype(np.uint32)
        before = np.cumsum(np.bincount(middle, np.bincount(owner, minlength=len(code)), v))
        turn = ((before - before[0]) // STEP).astype(np.uint32)[middle]
        share, rest = np.zeros(len(owner), np.uint16), np.zeros(len(code), np.uint16)
        last = mix64(words.view(np.uint64) + np.uint64(2))
        number = np.zeros(len(code), np.uint32)
        for t in distinct(turn):
            own = np.flatnonzero(turn == t)
            number[own] = np.arange(len(own))
            on = np.flatnonzero((turn == t)[owner])
            own_code = code[own]
            contexts = own_code[:, None] if level == 2 else np.stack([own_code // v, own_code % v], 1)
            key = number[owner[on]].astype(np.int64) * v + grams[on]
            share[on], rest[own] = part(level, contexts, last[contexts[:, -1]], key, counts[on], words.view(np.uint64)[contexts[:, 0]], v)
        cut = lambda a, lengths: np.split(a, np.cumsum(lengths)[:-1])
        blobs = [pack(a, b) for a, b in zip(cut(share, many), cut(rest[which], sizes), strict=True)]
        return pa.table({"level": table["level"], "shard": table["shard"], "segment": table["segment"], "blob": pa.array(blobs, pa.binary())})

    return run


def _score(shards: int, hot: np.ndarray, words: int, tokens: int):
    """A segment and the answers to it."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        ((_, ids, s),) = _rows(texts.combine_chunks().to_batches()[0])
        got = {(x, y): blob for x, y, blob in zip(*(answers[c].to_pylist() for c in ("level", "shard", "blob")), strict=True)}
        count = np.zeros(len(s.words), np.int64)
        for shard, own in enumerate(_word_shards(s, shards)):
            if len(own):
                count[own] = unpack(got[1, shard])[0]
        p = (count + 0.1) / (tokens + 0.1 * (words + 1))
        base = np.log10(p)[s.tokens]
        p = p[s.tokens]
        for level in (2, 3) if len(hot) else (3,):
            contexts, owner, follows, _, gram = s.ngrams(level)
            order, cuts = s.dealt(level, contexts, owner, follows, shards, hot)
            share, rest = np.zeros(len(follows)), np.ones(len(follows))
            for shard in range(shards):
                own = order[cuts[shard] : cuts[shard + 1]]
                if not len(own):
                    continue
                a, b = unpack(got[level, shard])
                share[own] = meaning(a)
                rest[own] = meaning(b)[np.cumsum(np.diff(owner[own], prepend=owner[own[0]]) != 0)]
            p = np.minimum(share[gram] + rest[gram] * p, 1.0)  # codes may be a little off
        add = lambda x: np.add.reduceat(x, s.starts)
        return pa.table({
            "doc_id": ids.values, "n_tokens": s.sizes, "n_known": add((count[s.tokens] > 0).astype(np.int64)), "train_tokens": np.full(len(ids), tokens),
            "base_score": add(base), "score": add(np.log10(p)),
        })

    return run


def scores(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, one row per row of docs.

    The model learns from rows whose crc32(doc_id as text) mod 10 is not 0, those with a null doc_id too; held_out tells
    the others.  Tokens are words, lower-cased from A to Z, and an end, so null and empty texts have one.  score is the sum
    of log10 p3 and base_score that of log10 p1 over a text's tokens.  Rows that repeat a doc_id are texts of their own;
    other columns are ignored; an empty table gives none.
    """
    cut = segments(docs)
    total = cut.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(1, -(-total // SHARD))
    ones = scratch(cut.mapInArrow(_ask_words(shards), _PART).groupBy("shard").applyInArrow(_answer_words, _PART + ", words long, tokens long"), "word-counts")
    size = ones.groupBy("shard").agg(F.first("words").alias("words"), F.first("tokens").alias("tokens")).agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("words", "tokens")]).first()
    hot, totals = _hot_contexts(cut, total)
    more = cut.mapInArrow(_ask(shards, hot), _PART).groupBy("level", "shard").applyInArrow(_answer(hot, totals), _PART)
    answers = ones.drop("words", "tokens").unionByName(more).groupBy("segment")
    out = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    done = cut.groupBy("segment").cogroup(answers).applyInArrow(_score(shards, hot, size[0], size[1]), out)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    return done.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
