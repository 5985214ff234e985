"""Toxicity by a counterfactual-regularised classifier.

Features are words, and word beginnings of 4 to 6 characters, that a text has or hasn't.  The classifier is a
logistic regression on a bounded sample of labelled documents.  For each identity term in one of them a twin is made
in which that term is swapped for another of its group, and the square of the change in score, on average over the
twins of a document, is added to the loss as a penalty, so that the mention of a group by itself doesn't move the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import held_out, letters, scratch, small_batches

#: The bound of the training sample.
SAMPLE = 12_000
#: A feature has a weight if at least so many sample documents have it and its chi-squared to the label (one degree of
#: freedom) is at least this, the 5 % point: a test of each feature, whatever their number.
LEAST, CHI = 4, 3.84
THRESHOLD = 0.3
#: Lasso (over the root of the sample size), weight of the counterfactual penalty, steps.
LASSO, PENALTY, STEPS = 0.06, 4.0, 400
#: Groups of interchangeable terms.
IDENTITY = (
    ("man", "woman"), ("men", "women"), ("boy", "girl"), ("he", "she"), ("his", "her"), ("male", "female"),
    ("black", "white", "asian", "latino"), ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"), ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("american", "mexican", "chinese", "african", "european", "arab", "indian"), ("immigrant", "native"), ("immigrants", "natives"),
    ("old", "young"), ("blind", "deaf", "disabled"), ("homme", "femme"), ("hommes", "femmes"), ("hombre", "mujer"), ("hombres", "mujeres"), ("mann", "frau"), ("männer", "frauen"),
)


def words_of(text: str) -> set[str]:
    return set(letters(text.lower()))


def features_of(words: set[str]) -> set[str]:
    """Words as they are, and their beginnings with a mark."""
    found = set(words)
    for w in words:
        for n in (4, 5, 6):
            if len(w) >= n:
                found.add(w[:n] + "-")
    return found


_NEXT = {w: g[(k + 1) % len(g)] for g in IDENTITY for k, w in enumerate(g)}


def twins(words: set[str]) -> list[set[str]]:
    """For each identity term among the words, in the order of the terms, the words with the next of its group in its place."""
    return [(words - {w}) | {_NEXT[w]} for w in sorted(words & _NEXT.keys())]


def _sample(docs: DataFrame, labels: DataFrame, bound: int) -> DataFrame:
    """(doc_id, text, y) of the labelled documents, the first `bound` in the order of a hash."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    picked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")


class Model:
    """Weights of the features; score(words) is a probability."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    def score(self, text: str | None) -> float:
        w, x = self.weights, self.bias
        for f in features_of(words_of(text or "")):
            x += w.get(f, 0.0)
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def loss(w: np.ndarray, b: float, rows: list, lasso: float) -> float:
    """What _fit makes small, over rows of (features, label, features of each twin)."""
    p = lambda f: 1 / (1 + np.exp(-(b + w[f].sum())))
    total = sum(-np.log(p(f) if y else 1 - p(f)) + PENALTY * np.mean([(p(f) - p(t)) ** 2 for t in own] or [0]) for f, y, own in rows)
    return total / len(rows) + lasso * np.abs(w).sum()


def _fit(rows: list[tuple[np.ndarray, int, list[np.ndarray]]], n: int) -> tuple[np.ndarray, float]:
    """rows: (features, label, features of each twin).  Proximal descent with momentum: few features get a weight."""

    def sparse(lists):
        sizes = np.array([len(x) for x in lists], int)
        return np.repeat(np.arange(len(lists)), sizes), np.concatenate(lists) if len(lists) else np.zeros(0, int)

    (ri, ci), (rt, ct) = sparse([r[0] for r in rows]), sparse([t for r in rows for t in r[2]])
    y, many = np.array([r[1] for r in rows], float), np.array([len(r[2]) for r in rows], int)
    m, k = max(1, len(rows)), int(many.sum())
    own = np.repeat(np.arange(len(rows)), many)  # whose twin it is
    part = PENALTY / np.maximum(many, 1)[own]
    w, b = np.zeros(n), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    pw, pb = w.copy(), b
    # steps that the curvature allows: a quarter of the column sums of |X|'|X|, with the bias as one more column
    sizes = np.bincount(ri, minlength=m)[: len(rows)] + 1
    step = 1 / (0.25 * (1 + 4 * PENALTY * (k > 0)) * np.maximum(np.bincount(ci, sizes[ri], n), 1) / m)
    step_b, lasso = 1 / (0.25 * (1 + 4 * PENALTY * (k > 0)) * sizes.mean()), LASSO / np.sqrt(m)
    alive = np.ones(n, bool)
    for t in range(2 * STEPS):
        if t == STEPS:  # the features that are left, with less shrinkage
            alive, lasso = w != 0, lasso / 8
        mom = t % STEPS / (t % STEPS + 3)
        lw, lb = w + mom * (w - pw), b + mom * (b - pb)
        p = 1 / (1 + np.exp(-np.clip(lb + np.bincount(ri, lw[ci], len(rows)), -30, 30)))
        ga = p - y
        w_twin = np.zeros(n)
        gb = 0.0
        if k:
            q = 1 / (1 + np.exp(-np.clip(lb + np.bincount(rt, lw[ct], k), -30, 30)))
            d = part * (p[own] - q)
            ga = ga + 2 * np.bincount(own, d, len(rows)) * p * (1 - p)
            g = -2 * d * q * (1 - q) / m
            w_twin, gb = np.bincount(ct, g[rt], n), g.sum()
        ga = ga / m
        w, pw = lw - step * (np.bincount(ci, ga[ri], n) + w_twin), w
        w = np.sign(w) * np.maximum(np.abs(w) - step * lasso, 0) * alive
        b, pb = lb - step_b * (ga.sum() + gb), b
    return w, b


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from the labelled documents that aren't held out.

    Which features count is settled in Spark, by LEAST and CHI.  The driver gets their numbers only: at most `sample`
    lists of the documents' features, and as many of each twin.
    """
    spark = docs.sparkSession

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = pa.list_(pa.string())
        for b in batches:
            own = [words_of(t or "") for t in b.column("text").to_pylist()]
            plain = pa.array([sorted(features_of(w)) for w in own], lists)
            other = pa.array([[sorted(features_of(t)) for t in twins(w)] for w in own], pa.list_(lists))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), plain, other], ["doc_id", "y", "plain", "twins"])

    kinds = "doc_id long, y int, plain array<string>, twins array<array<string>>"
    rows = scratch(_sample(docs, labels, sample).select("doc_id", F.col("y").cast("int").alias("y"), "text").mapInArrow(each, kinds), "toxicity-sample")
    n, pos = rows.agg(F.count("*"), F.sum("y")).first()
    if not n or not pos or pos == n:
        return Model({}, -2.0 if not pos else 2.0)
    seen = rows.select("y", F.explode("plain").alias("f")).groupBy("f").agg(F.count("*").alias("n"), F.sum("y").alias("p")).where(F.col("n") >= LEAST)
    rate = F.lit(pos / n)
    off = F.col("p") - F.col("n") * rate
    chi = off * off * n / (F.col("n") * (n - F.col("n")) * rate * (1 - rate))
    names = [r["f"] for r in seen.where((F.col("n") < n) & (chi >= CHI)).select("f").orderBy("f").collect()]  # the sample bounds them
    at = spark.sparkContext.broadcast({f: k for k, f in enumerate(names)})

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = pa.list_(pa.int32())
        pick = lambda fs: [at.value[f] for f in fs if f in at.value]
        for b in batches:
            plain = pa.array([pick(fs) for fs in b.column("plain").to_pylist()], lists)
            other = pa.array([[pick(fs) for fs in own] for own in b.column("twins").to_pylist()], pa.list_(lists))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), plain, other], ["doc_id", "y", "plain", "twins"])

    got = rows.mapInArrow(number, "doc_id long, y int, plain array<int>, twins array<array<int>>").orderBy("doc_id", "plain").collect()
    w, b = _fit([(np.array(r["plain"], int), r["y"], [np.array(t, int) for t in r["twins"]]) for r in got], len(names))
    return Model({f: float(x) for f, x in zip(names, w, strict=True) if x}, float(b))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs -> docs with score (0 to 1, higher: toxic likelier) and predicted (1 from THRESHOLD on).

    A null or empty text has the score of a text without any feature.  Columns of the input stay, but for those
    named score and predicted, which are replaced.  An empty table gives none.  Where nothing is labelled, or only
    one label occurs, all scores are alike.
    """
    small_batches(docs.sparkSession)
    own = [c for c in docs.columns if c not in ("score", "predicted")]
    docs = docs.select(*own)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for b in batches:
            s = np.array([m.score(t) for t in b.column("text").to_pylist()], float)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], [*own, "score", "predicted"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, score double, predicted int")
