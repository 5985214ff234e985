"""Language identification by unigram pieces, marginalised over all segmentations.

A word is a sequence of pieces of a fixed public vocabulary; its probability in a language is the sum, over every way
to cut it into pieces, of the product of the pieces' probabilities there.  A forward pass over the characters gives the
sum without listing the ways; expectation-maximisation with the matching backward pass learns the probabilities from
the words of a bounded sample of labelled documents.  All pieces of letters alone take part, however long they are, and
no word is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import draw, held_out, letters, mix64, small_batches

#: Sample documents for each language, EM rounds, smoothing.
SAMPLE, ROUNDS, SMOOTH = 400, 4, 0.1
#: Probability of a single character outside the vocabulary.
UNKNOWN = 1e-7
#: Words of more characters are summed one at a time, and scaled as they go, for the sum would underflow.
LONG = 40
#: Words whose scores a task remembers; past that it forgets and starts again.
MEMO = 400_000
BASE = np.uint64(0x100000001B3)


def pieces(path: str | None = None) -> list[str]:
    """The pieces of a public vocabulary that consist of letters, in lower case."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {sp.id_to_piece(k).replace("▁", "").lower() for k in range(sp.get_piece_size())}
    return sorted(p for p in found if letters(p) == [p])


class Lattice:
    """Which pieces stand at which place of a batch of words of equal length."""

    def __init__(self, vocabulary: list[str]):
        self.vocabulary = vocabulary
        self.longest = max(map(len, vocabulary), default=1)
        #: For each length the hashes of all beginnings of pieces, sorted, and the piece that such a beginning is, or -1.
        self.tables = []
        for n in range(1, self.longest + 1):
            found: dict = {}
            for k, piece in enumerate(vocabulary):
                if len(piece) >= n:
                    begin = piece[:n]
                    if begin not in found or len(piece) == n:
                        found[begin] = k if len(piece) == n else -1
            h = np.zeros(len(found), np.uint64)
            codes = self.codes(list(found), n)
            for k in range(n):
                h = self.step(h, codes[:, k])
            order = np.argsort(h)
            self.tables.append((h[order], np.array(list(found.values()), np.int64)[order]))

    @staticmethod
    def step(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The hash of a beginning with one more character."""
        return mix64(h * BASE + codes)

    @staticmethod
    def codes(words: list[str], n: int) -> np.ndarray:
        return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), n).astype(np.uint64)

    def found(self, words: list[str], n: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each piece length (word, piece, bounds): the pieces from place t on are those from bounds[t] to bounds[t + 1].

        A place is looked at again with one more character only while what stands there is the beginning of a piece.
        """
        codes, w = np.ascontiguousarray(self.codes(words, n).T).ravel(), len(words)
        at, h, out = np.arange(n * w), np.zeros(n * w, np.uint64), []
        for k, (hashes, pieces) in enumerate(self.tables[:n], 1):
            inside = at < (n - k + 1) * w
            at, h = at[inside], self.step(h[inside], codes[at[inside] + (k - 1) * w])
            near = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            here = hashes[near] == h
            at, h, piece = at[here], h[here], pieces[near[here]]
            whole = piece >= 0
            out.append((at[whole] % w, piece[whole], np.searchsorted(at[whole], np.arange(n + 1) * w)))
        return out


def _unknown(first: tuple, t: int, words: int, p: np.ndarray) -> np.ndarray:
    """(words, languages): the probability of the single character at place t."""
    one = np.full((words, p.shape[1]), UNKNOWN)
    word, piece, bounds = first
    own = slice(bounds[t], bounds[t + 1])
    one[word[own]] = np.maximum(p[piece[own]], UNKNOWN)
    return one


def forward(found: list, words: int, n: int, p: np.ndarray) -> np.ndarray:
    """p: (pieces, languages) -> (n + 1, words, languages), the probability of each beginning."""
    a = np.zeros((n + 1, words, p.shape[1]))
    a[0] = 1
    for t in range(1, n + 1):
        a[t] = a[t - 1] * _unknown(found[0], t - 1, words, p)
        for k in range(2, min(len(found), t) + 1):
            word, piece, bounds = found[k - 1]
            own = slice(bounds[t - k], bounds[t - k + 1])
            if own.start < own.stop:
                a[t, word[own]] += a[t - k, word[own]] * p[piece[own]]
    return a


def _steps(word: str, lattice: Lattice, p: np.ndarray) -> Iterator[np.ndarray]:
    """For each end of a beginning of word, (piece lengths, languages): the probability of the piece of each length that ends there."""
    most = min(lattice.longest, len(word))
    for begin in range(0, len(word), 4096):  # some memory for a stretch, however long the word
        back = max(0, begin - most + 1)
        part = word[back : begin + 4096]
        own = np.zeros((len(part) + 1, most, p.shape[1]))
        own[:, 0] = UNKNOWN
        for k, (_, piece, bounds) in enumerate(lattice.found([part], len(part)), 1):
            start = np.repeat(np.arange(len(part)), np.diff(bounds))
            own[start + k, k - 1] = np.maximum(p[piece], UNKNOWN) if k == 1 else p[piece]
        yield from own[begin - back + 1 :]


def long_score(word: str, lattice: Lattice, p: np.ndarray) -> np.ndarray:
    """The log of the sum over all segmentations of a word of any length: the beginnings before are kept relative to the last."""
    total, last = np.zeros(p.shape[1]), np.zeros((min(lattice.longest, len(word)), p.shape[1]))
    last[0] = 1
    for own in _steps(word, lattice, p):
        now = (last * own).sum(0)
        total += np.log(now)
        last[1:] = last[:-1] / now
        last[0] = 1
    return total


def _by_length(words: list[str]) -> dict[int, list[int]]:
    found: dict = {}
    for k, w in enumerate(words):
        found.setdefault(len(w), []).append(k)
    return found


def log_scores(words: list[str], lattice: Lattice, p: np.ndarray) -> np.ndarray:
    """(words, languages): the log of the sum over all segmentations."""
    out = np.zeros((len(words), p.shape[1]))
    for n, at in _by_length(words).items():
        if n > LONG:
            out[at] = [long_score(words[k], lattice, p) for k in at]
            continue
        for s in range(0, len(at), 20_000):
            pick = at[s : s + 20_000]
            out[pick] = np.log(forward(lattice.found([words[k] for k in pick], n), len(pick), n, p)[n])
    return out


def _long_counts(word: str, lattice: Lattice, p: np.ndarray) -> np.ndarray:
    """How often each piece is expected in a word of any length, in one language: forward and backward in logs."""
    n, pieces = len(word), lattice.found([word], len(word))
    with np.errstate(divide="ignore"):
        lp = [np.full(n - k + 1, np.log(UNKNOWN) if k == 1 else -np.inf) for k in range(1, len(pieces) + 1)]
        ids = [np.full(n - k + 1, len(p)) for k in range(1, len(pieces) + 1)]
        for k, (_, piece, bounds) in enumerate(pieces):
            start = np.repeat(np.arange(n), np.diff(bounds))
            lp[k][start] = np.log(np.maximum(p[piece, 0], UNKNOWN) if k == 0 else p[piece, 0])
            ids[k][start] = piece
    a, b = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    a[0] = b[n] = 0
    for t in range(1, n + 1):
        a[t] = np.logaddexp.reduce([a[t - k] + lp[k - 1][t - k] for k in range(1, min(len(lp), t) + 1)])
    for t in range(n - 1, -1, -1):
        b[t] = np.logaddexp.reduce([b[t + k] + lp[k - 1][t] for k in range(1, min(len(lp), n - t) + 1)])
    found = np.zeros(len(p) + 1)
    for k, own in enumerate(ids, 1):
        found += np.bincount(own, np.exp(a[: n - k + 1] + lp[k - 1] + b[k:] - a[n]), len(p) + 1)
    return found[:-1]


def learn(words: list[str], counts: np.ndarray, lattice: Lattice) -> np.ndarray:
    """EM: piece probabilities of one language from its words and how often they occur."""
    v = len(lattice.vocabulary)
    p = np.full((v, 1), 1.0 / v)
    groups = [(n, np.array(at), lattice.found([words[k] for k in at], n)) for n, at in _by_length(words).items() if n <= LONG]
    large = [k for k, w in enumerate(words) if len(w) > LONG]
    for _ in range(ROUNDS):
        expected = sum((counts[k] * _long_counts(words[k], lattice, p) for k in large), np.zeros(v))
        for n, at, found in groups:
            a = forward(found, len(at), n, p)[:, :, 0]
            b = np.zeros_like(a)
            b[n] = 1
            for t in range(n - 1, -1, -1):
                b[t] = b[t + 1] * _unknown(found[0], t, len(at), p)[:, 0]
                for k in range(2, min(len(found), n - t) + 1):
                    word, piece, bounds = found[k - 1]
                    own = slice(bounds[t], bounds[t + 1])
                    b[t, word[own]] += b[t + k, word[own]] * p[piece[own], 0]
            weight = counts[at] / a[n]
            for k, (word, piece, bounds) in enumerate(found, 1):
                start = np.repeat(np.arange(n), np.diff(bounds))
                flow = a[start, word] * p[piece, 0] * b[start + k, word] * weight[word]
                expected += np.bincount(piece, flow, v)
        p = ((expected + SMOOTH) / (expected.sum() + SMOOTH * v))[:, None]
    return p[:, 0]


def fit(docs: DataFrame, sample: int = SAMPLE, vocabulary: str | None = None) -> tuple[list[str], list[str], np.ndarray]:
    """(languages, pieces, probabilities): from `sample` documents of each language at most, none held out.

    The sample is drawn by a hash of doc_id; its words are counted in Spark, and each language is learned in a task
    of its own from those counts, which the sample bounds.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    drawn = draw(known, "lang", sample)
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        for b in batches:
            langs, words = [], []
            for lang, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                own = letters((t or "").lower())
                langs += [lang] * len(own)
                words += own
            found = Counter(zip(langs, words, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "word", "n"])

    texts = docs.select("lang", "doc_id", "text").join(F.broadcast(drawn), ["lang", "doc_id"]).select("lang", "text")
    counts = texts.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    names = pieces(vocabulary)

    def train(table: pa.Table) -> pa.Table:
        p = learn(table.column("word").to_pylist(), table.column("n").to_numpy().astype(float), Lattice(names))
        return pa.table([pa.array([table.column("lang")[0].as_py()]), pa.array([p.tolist()])], ["lang", "p"])

    models = counts.groupBy("lang").applyInArrow(train, "lang string, p array<double>").orderBy("lang").collect()
    return [r["lang"] for r in models], names, np.array([r["p"] for r in models]).T.reshape(len(names), -1)


def predict(docs: DataFrame, model: tuple[list[str], list[str], np.ndarray]) -> DataFrame:
    """docs -> docs with lang_pred and score (the posterior of lang_pred under even priors).

    lang_pred is `und` with score 0 if the text is null, has no letter, or nothing was learned.  Ties go to the first
    language by name.  Only text is looked at.  Columns of the input stay, but for those named lang_pred and score.
    """
    small_batches(docs.sparkSession, 128)
    own = [c for c in docs.columns if c not in ("lang_pred", "score")]
    docs = docs.select(*own)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, names, p = shared.value
        lattice, memo, rows = Lattice(names), {}, np.zeros((0, len(langs)))
        for b in batches:
            texts = b.column("text").to_pylist()
            split = [letters(t.lower()) if t else [] for t in texts]
            if len(memo) > MEMO:
                memo, rows = {}, rows[:0]
            fresh = list({w for words in split for w in words if w not in memo})
            if fresh and langs:
                memo.update(zip(fresh, range(len(rows), len(rows) + len(fresh)), strict=True))
                rows = np.concatenate([rows, log_scores(fresh, lattice, p)])  # MEMO bounds it
            pred, score = [], []
            for words in split:
                if not words or not langs:
                    pred.append("und")
                    score.append(0.0)
                    continue
                total = rows[[memo[w] for w in words]].sum(0)
                post = np.exp(total - total.max())
                k = int(total.argmax())
                pred.append(langs[k])
                score.append(float(post[k] / post.sum()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred), pa.array(score)], [*own, "lang_pred", "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, lang_pred string, score double")
