"""Components, clusters and classifiers over pixels: pyspark.ml where it has them, Gram matrices where it hasn't.

dense(pixel_id, feature, v) has a row for every pixel and feature; features are few (thousands at most), so tables of
features times features fit the driver, and everything with pixels in it stays distributed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..storage import discard, scratch
from .spatial import smooth


def rows(dense: DataFrame, *extra: str, log: bool = True) -> DataFrame:
    """pixel_id, x: a pixel's values in the order of its features."""
    v = F.log1p("v") if log else F.col("v")
    got = dense.groupBy("pixel_id", *extra).agg(F.array_sort(F.collect_list(F.struct("feature", v.alias("v")))).alias("fs"))
    return got.select("pixel_id", *extra, F.transform("fs", lambda f: f["v"]).alias("x"))


def scaled(dense: DataFrame, *extra: str) -> DataFrame:
    """pixel_id, z: log values with mean zero and deviation one by feature, as an ml vector."""
    return _scaled(dense, *extra)[0]


def _scaled(dense: DataFrame, *extra: str) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """scaled(), and the means and deviations it took out."""
    r = rows(dense, *extra).withColumn("x", array_to_vector("x"))
    model = StandardScaler(inputCol="x", outputCol="z", withMean=True).fit(r)
    return model.transform(r).drop("x"), model.mean.toArray(), model.std.toArray()


def by_size(labels: DataFrame) -> DataFrame:
    """labels(pixel_id, c) renumbered from 0 by falling size; equal ones by their old number."""
    sizes = labels.groupBy("c").agg(F.count("*").alias("n"))  # a row for each cluster
    named = sizes.select("c", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "c")) - 1).alias("label"))
    return labels.join(F.broadcast(named), "c").select("pixel_id", "label")


def pca(dense: DataFrame, k: int = 5) -> tuple[DataFrame, np.ndarray, list[float]]:
    """(pixel_id, scores), loadings (features x k) and the explained shares of variance."""
    z = scaled(dense)
    model = PCA(k=k, inputCol="z", outputCol="s").fit(z)
    return model.transform(z).select("pixel_id", vector_to_array("s").alias("scores")), model.pc.toArray(), model.explainedVariance.toArray().tolist()


def segment(dense: DataFrame, k: int = 6, n_components: int = 5, seed: int = 0, how: str = "kmeans") -> DataFrame:
    """pixel_id, label: clusters of PCA scores, the largest first."""
    z = scaled(dense)
    s = PCA(k=n_components, inputCol="z", outputCol="s").fit(z).transform(z).select("pixel_id", "s")
    kind = {"kmeans": KMeans, "bisecting": BisectingKMeans, "mixture": GaussianMixture}[how]
    made = kind(k=k, featuresCol="s", predictionCol="c", seed=seed).fit(s).transform(s)
    return by_size(made.select("pixel_id", "c"))


def choose_k(dense: DataFrame, ks: range = range(2, 9), n_components: int = 5, seed: int = 0) -> int:
    """The number of clusters with the best silhouette."""
    z = scaled(dense)
    model = PCA(k=n_components, inputCol="z", outputCol="s").fit(z)
    # read by a fit and an evaluation for each k: scaling and projection are worked out once
    s = scratch(model.transform(z).select("pixel_id", vector_to_array("s").alias("s")), "scores").select("pixel_id", array_to_vector("s").alias("s"))
    best = [(ClusteringEvaluator(featuresCol="s", predictionCol="c").evaluate(KMeans(k=k, featuresCol="s", predictionCol="c", seed=seed).fit(s).transform(s)), -k) for k in ks]
    return -max(best)[1]


def gram(r: DataFrame, p: int) -> np.ndarray:
    """The sum of x x' over pixels: each partition adds up its own, p x p numbers leave it."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((p, p))
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(p), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "g"])

    parts = r.select("x").mapInArrow(add, "i int, g array<double>").select("i", F.posexplode("g").alias("j", "g")).groupBy("i", "j").agg(F.sum("g").alias("g"))
    out = np.zeros((p, p))
    for i, j, g in parts.collect():  # p x p
        out[i, j] = g
    return out


def nmf(dense: DataFrame, k: int = 5, steps: int = 60, seed: int = 0) -> tuple[DataFrame, np.ndarray]:
    """(pixel_id, w) and H (k x features), both nonnegative.

    With the Gram matrix X'X the updates of H need no pass over pixels, as W is taken to be X A with A >= 0 in them.
    Then each pixel's w is its own nonnegative least squares fit to H, one coordinate after the other.
    """
    r = rows(dense, log=False)
    p = len(r.first()["x"])
    g = gram(r, p)
    rng = np.random.default_rng(seed)
    vals, vecs = np.linalg.eigh(g)
    a = np.abs(vecs[:, ::-1][:, :k]) + rng.uniform(1e-4, 1e-3, (p, k))  # W = X A with A >= 0
    h = np.abs(vecs[:, ::-1][:, :k]).T * np.sqrt(np.maximum(vals[::-1][:k], 0))[:, None] + 1e-6
    for _ in range(steps):
        wtx, wtw = a.T @ g, a.T @ g @ a
        h *= wtx / np.maximum(wtw @ h, 1e-12)
        num, den = g @ h.T, g @ a @ (h @ h.T)
        a *= np.maximum(num, 0) / np.maximum(den, 1e-12)
    lit = r.sparkSession.sparkContext.broadcast((a, h))

    @F.pandas_udf(ArrayType(DoubleType()))
    def fit(x: pd.Series) -> pd.Series:
        start, h = lit.value
        x = np.stack(x.to_list())
        w, xh, hh = np.maximum(x @ start, 0), x @ h.T, h @ h.T
        for _ in range(500):
            moved = 0.0
            for j in np.flatnonzero(hh.diagonal() > 0):
                new = np.maximum(0, w[:, j] + (xh[:, j] - w @ hh[:, j]) / hh[j, j])
                moved = max(moved, float(np.abs(new - w[:, j]).max()))
                w[:, j] = new
            if moved <= 1e-10 * (1 + float(np.abs(w).max())):
                break
        return pd.Series(list(w))

    return r.select("pixel_id", fit("x").alias("w")), h


def _sums(dense: DataFrame) -> tuple:
    """Labels of dense, centres and deviations by feature, means of the labels, X'X and X'Y of scaled values: one pass."""
    z, centre, dev = _scaled(dense, "label")
    z = z.select("label", vector_to_array("z").alias("x"))
    labels = sorted(r["label"] for r in z.select("label").distinct().collect())
    p = len(centre)
    with_y = z.select(F.concat("x", F.array(*[F.when(F.col("label") == c, 1.0).otherwise(0.0) for c in labels], F.lit(1.0))).alias("x"))
    g = gram(with_y, p + len(labels) + 1)
    n = g[-1, -1]
    mean = g[-1, :-1] / n
    c = (g[:-1, :-1] - n * np.outer(mean, mean))
    return labels, centre, dev, mean[p:], c[:p, :p], c[:p, p:]


def _components(xx: np.ndarray, xy: np.ndarray, n_components: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x components, scores of length one) and loadings of Y."""
    ws, ps, qs, ss = [], [], [], []
    s = xy.copy()
    for _ in range(n_components):
        u, _, _ = np.linalg.svd(s, full_matrices=False)
        w = u[:, 0]
        for prev, pr in zip(ws, ps, strict=True):
            w = w - prev * (pr @ w)
        t2 = float(w @ xx @ w)
        if t2 <= 0:
            break
        w = w / math.sqrt(t2)
        pl, q = xx @ w, xy.T @ w
        v = pl.copy()
        for b in ss:
            v -= b * (b @ v)
        v /= np.linalg.norm(v)
        s = s - np.outer(v, v @ s)
        ws, ps, qs, ss = [*ws, w], [*ps, pl], [*qs, q], [*ss, v]
    return np.stack(ws, 1), np.stack(qs, 1)


def _per_value(a: np.ndarray, centre: np.ndarray, dev: np.ndarray, constant: np.ndarray | float = 0.0) -> np.ndarray:
    """Columns for scaled values as columns for log values as they are, the last row for a constant."""
    own = np.divide(a, dev[:, None], out=np.zeros(a.shape), where=dev[:, None] > 0)
    return np.vstack([own, constant - centre @ own])


def _importance(w: np.ndarray, q: np.ndarray) -> np.ndarray:
    power = (q * q).sum(0)
    return np.sqrt(len(w) * ((w / np.linalg.norm(w, axis=0)) ** 2 * power).sum(1) / power.sum())


def pls(dense: DataFrame, n_components: int = 2) -> tuple[list, np.ndarray, np.ndarray]:
    """PLS-DA of dense(pixel_id, label, feature, v): labels, coefficients (features + 1 x labels) and VIP.

    The coefficients are for log values as they are, the last row for a constant: the scaling of the pixels it learns
    from goes along with them.  All it needs of the pixels is X'X and X'Y, so one pass gathers them.
    """
    labels, centre, dev, mean, xx, xy = _sums(dense)
    w, q = _components(xx, xy, n_components)
    return labels, _per_value(w @ q.T, centre, dev, mean), _importance(w, q)


def _without(xx: np.ndarray, xy: np.ndarray, n_ortho: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(K, axes): X K has no variation along the scores X a of the axes a, which tell nothing about y.

    y is +1 and -1.  A score's loading, less what points along X'y, is the next axis to leave; X itself is never read,
    as what is needed of X K is K' X'X K.
    """
    keep, axes = np.eye(len(xx)), []
    y = xy[:, 1] - xy[:, 0]
    for _ in range(n_ortho):
        own, w = keep.T @ xx @ keep, keep.T @ y
        size = np.linalg.norm(w)
        w = w / size if size > 0 else w
        spread = float(w @ own @ w)
        if spread <= 0:
            break
        load = own @ w / spread
        o = load - (w @ load) * w
        if np.linalg.norm(o) < 1e-12:
            break
        o /= np.linalg.norm(o)
        axes.append(keep @ o)
        keep = keep - np.outer(keep @ o, own @ o / float(o @ own @ o))
    return keep, axes


def opls(dense: DataFrame, n_ortho: int = 1, n_components: int = 1) -> tuple[tuple, np.ndarray]:
    """(model as pls() gives it, axes) after n_ortho components that tell nothing about two labels are taken out.

    axes (features + 1 x 1 + components) read the predictive score, larger for the second label, and the orthogonal ones
    off log values as they are.  With other than two labels nothing is taken out.  The filter works on X'X and X'Y, so there is one
    pass over the pixels whatever the number of components.
    """
    labels, centre, dev, mean, xx, xy = _sums(dense)
    keep, away = _without(xx, xy, n_ortho) if len(labels) == 2 else (np.eye(len(xx)), [])
    w, q = _components(keep.T @ xx @ keep, keep.T @ xy, n_components)
    first = w[:, 0] / np.linalg.norm(w[:, 0]) * (-1 if q[-1, 0] < 0 else 1)
    return (labels, _per_value(keep @ w @ q.T, centre, dev, mean), _importance(w, q)), _per_value(np.stack([keep @ first, *away], 1), centre, dev)


def opls_scores(dense: DataFrame, axes: np.ndarray) -> DataFrame:
    """pixel_id, label, scores: the predictive score of each pixel, then its orthogonal ones."""
    lit = dense.sparkSession.sparkContext.broadcast(axes)

    @F.pandas_udf(ArrayType(DoubleType()))
    def project(x: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(x.to_list()) @ lit.value[:-1] + lit.value[-1]))

    return rows(dense, "label").select("pixel_id", "label", project("x").alias("scores"))


def classify(dense: DataFrame, model: tuple) -> DataFrame:
    """pixel_id, label, predicted by a PLS model of the same features, scaled as the pixels that it learned from."""
    labels, coef, _ = model
    lit = dense.sparkSession.sparkContext.broadcast((labels, coef))

    @F.pandas_udf(DoubleType())
    def predict(x: pd.Series) -> pd.Series:
        names, b = lit.value
        return pd.Series(np.array(names, float)[(np.stack(x.to_list()) @ b[:-1] + b[-1]).argmax(1)])

    return rows(dense, "label").select("pixel_id", "label", predict("x").cast("int").alias("predicted"))


def confusion(dense: DataFrame, folds: int = 5, n_components: int = 2, unit: str | None = None, n_ortho: int = 0) -> DataFrame:
    """label, predicted, n: each fold is predicted by a model of the others.

    Folds are by a hash of `unit`, which is the column `sample` where dense has one and pixel_id else: pixels of one sample
    are alike, so whole samples are left out.  With n_ortho the models are those of opls().
    """
    fold = F.pmod(F.xxhash64(unit or ("sample" if "sample" in dense.columns else "pixel_id")), F.lit(folds))
    parts = None
    for k in range(folds):
        others = dense.where(fold != k)
        got = classify(dense.where(fold == k), opls(others, n_ortho, n_components)[0] if n_ortho else pls(others, n_components))
        parts = got if parts is None else parts.unionByName(got)
    return parts.groupBy("label", "predicted").agg(F.count("*").alias("n"))


def average_linkage(distance: np.ndarray, k: int) -> list[int]:
    """Clusters of a small distance matrix by average linkage, cut at k, the largest first."""
    n = len(distance)
    d, size, member = distance.astype(float).copy(), np.ones(n), [[i] for i in range(n)]
    np.fill_diagonal(d, np.inf)
    alive = list(range(n))
    while len(alive) > max(1, k):
        sub = d[np.ix_(alive, alive)]
        i, j = np.unravel_index(int(sub.argmin()), sub.shape)
        i, j = alive[min(i, j)], alive[max(i, j)]
        new = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = new, new
        d[i, i] = np.inf
        size[i] += size[j]
        member[i] += member[j]
        alive.remove(j)
    out = [0] * n
    for label, c in enumerate(sorted((member[a] for a in alive), key=lambda m: (-len(m), min(m)))):
        for i in c:
            out[i] = label
    return out


def modules(matrix: DataFrame, features: list[int], k: int = 4, score: str = "cosine") -> list[tuple[int, int]]:
    """(feature, module) from a likeness table of feature pairs f1 < f2."""
    at = {f: i for i, f in enumerate(features)}
    d = np.ones((len(features), len(features)))
    for r in matrix.collect():  # features x features
        i, j = at[r["f1"]], at[r["f2"]]
        d[i, j] = d[j, i] = min(2.0, max(0.0, 1 - (r[score] if r[score] is not None else 0.0)))
    return list(zip(features, average_linkage(d, k), strict=True))


def top_loadings(loadings: np.ndarray, n: int = 5) -> list[tuple[int, int, float]]:
    """(component, feature, loading) of the largest by size."""
    return [(c, int(f), float(loadings[f, c])) for c in range(loadings.shape[1]) for f in np.argsort(-np.abs(loadings[:, c]), kind="stable")[:n]]


def two_level_mixture(values: DataFrame, pixels: DataFrame, k: int = 3, rounds: int = 30, sigma: float = 1.5, tolerance: float = 1e-4) -> DataFrame:
    """pixel_id, label of one ion: a mixture of k normal densities whose priors are smoothed over the grid.

    Each round is an aggregate of k moments and one pass of neighbourhood sums.  It ends when no mean or deviation
    moves by more than tolerance times the deviation of all values, after `rounds` at the latest.
    """
    q = values.agg(F.percentile("v", [(i + 0.5) / k for i in range(k)]).alias("q"), F.stddev_pop("v").alias("s")).first()
    mean, sd = list(q["q"]), [max(1e-9, (q["s"] or 0.0) / k)] * k
    # places go along with the values: what a round joins is large on both sides, and nothing of it goes by the driver
    own = scratch(values.select("pixel_id", "v").join(pixels.select("pixel_id", "x", "y").hint("merge"), "pixel_id", "left"), "placed")
    reach = math.ceil(2 * sigma)
    cells = [(i, j, math.exp(-(i * i + j * j) / (2 * sigma * sigma))) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)]
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(w).alias("w")) for i, j, w in cells]))
    resp = None
    for _ in range(rounds):
        if resp is None:
            base, weights = own, [F.lit(1.0 / k)] * k
        else:
            spread = resp.where("x is not null and y is not null").select("x", "y", "r", step.alias("s")).select((F.col("x") + F.col("s.i")).alias("x"), (F.col("y") + F.col("s.j")).alias("y"), F.col("s.w").alias("w"), *[(F.get("r", F.lit(i)) * F.col("s.w")).alias(f"w{i}") for i in range(k)])
            soft = spread.groupBy("x", "y").agg(*[(F.sum(f"w{i}") / F.sum("w")).alias(f"p{i}") for i in range(k)])
            base, weights = own.join(soft.hint("merge"), ["x", "y"]), [F.greatest(F.col(f"p{i}"), F.lit(1e-6)) for i in range(k)]
        dens = [weights[i] * F.exp(-F.pow((F.col("v") - mean[i]) / sd[i], 2) / 2) / sd[i] for i in range(k)]
        total = sum(dens[1:], dens[0]) + 1e-300
        before, resp = resp, scratch(base.select("pixel_id", "x", "y", "v", F.array(*[d / total for d in dens]).alias("r")), "responsibilities")
        if before is not None:
            discard(before)
        r = [F.get("r", F.lit(i)) for i in range(k)]
        m = resp.agg(*[F.sum(x).alias(f"n{i}") for i, x in enumerate(r)], *[F.sum(x * F.col("v")).alias(f"s{i}") for i, x in enumerate(r)], *[F.sum(x * F.col("v") * F.col("v")).alias(f"q{i}") for i, x in enumerate(r)]).first()
        old = [*mean, *sd]
        for i in range(k):
            n = max(m[f"n{i}"], 1e-9)
            mean[i] = m[f"s{i}"] / n
            sd[i] = math.sqrt(max(m[f"q{i}"] / n - mean[i] ** 2, 1e-12)) + 1e-9
        if max(abs(a - b) for a, b in zip(old, [*mean, *sd], strict=True)) <= tolerance * (q["s"] or 0.0):
            break
    order = sorted(range(k), key=lambda i: mean[i])
    rank = F.array(*[F.lit(order.index(i)) for i in range(k)])
    best = F.array_position("r", F.array_max("r")).cast("int") - 1
    return resp.select("pixel_id", F.get(rank, best).alias("label"))


def ward(centres: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (a, b, height) of a few hundred centres by the least growth of the sum of squares; new ones count on."""
    n = len(centres)
    c, w, alive, out = [x.astype(float) for x in centres], list(map(float, sizes)), list(range(n)), []
    while len(alive) > 1:
        x, m = np.stack([c[i] for i in alive]), np.array([w[i] for i in alive])
        d = ((x[:, None] - x[None]) ** 2).sum(2) * (m[:, None] * m[None]) / (m[:, None] + m[None])
        np.fill_diagonal(d, np.inf)
        i, j = sorted(np.unravel_index(int(d.argmin()), d.shape))
        a, b = alive[i], alive[j]
        out.append((a, b, float(math.sqrt(2 * d[i, j]))))
        c.append((w[a] * c[a] + w[b] * c[b]) / (w[a] + w[b]))
        w.append(w[a] + w[b])
        alive = [k for k in alive if k not in (a, b)] + [len(c) - 1]
    return out


def cut_tree(merges: list[tuple[int, int, float]], k: int) -> list[int]:
    """The cluster of each leaf when k are left."""
    n = len(merges) + 1
    parent = list(range(2 * n - 1))
    for step, (a, b, _) in enumerate(merges[: n - max(1, min(k, n))]):
        parent[a] = parent[b] = n + step

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    names: dict = {}
    return [names.setdefault(root(i), len(names)) for i in range(n)]


def hierarchy(dense: DataFrame, micro: int = 200, n_components: int = 5, seed: int = 0) -> tuple[DataFrame, list]:
    """(pixel_id, micro cluster) and the tree over the micro clusters: only their centres go to the driver."""
    z = scaled(dense)
    s = PCA(k=n_components, inputCol="z", outputCol="s").fit(z).transform(z).select("pixel_id", "s")
    model = KMeans(k=micro, featuresCol="s", predictionCol="c", seed=seed).fit(s)
    labels = model.transform(s).select("pixel_id", "c")
    sizes = dict(labels.groupBy("c").count().collect())
    return labels, ward(np.stack(model.clusterCenters()), np.array([sizes.get(i, 0) or 1e-9 for i in range(len(model.clusterCenters()))]))


def labels_for(labels: DataFrame, merges: list, k: int) -> DataFrame:
    """pixel_id, label of the tree cut at k, the largest first."""
    own = cut_tree(merges, k)
    at = F.array(*[F.lit(c) for c in own])
    return by_size(labels.select("pixel_id", F.get(at, F.col("c")).alias("c")))


def standardised(dense: DataFrame, sample: str = "sample") -> DataFrame:
    """v with mean zero and deviation one by sample and feature: samples then share an axis."""
    m = dense.groupBy(sample, "feature").agg(F.avg("v").alias("__m"), F.stddev_pop("v").alias("__s"))
    z = F.when(F.col("__s") > 0, (F.col("v") - F.col("__m")) / F.col("__s")).otherwise(0.0)
    return dense.join(F.broadcast(m), [sample, "feature"]).withColumn("v", z).drop("__m", "__s")


def pooled(dense: DataFrame, cap: int, sample: str = "sample") -> DataFrame:
    """At most cap pixels of each sample, drawn by a hash: what an embedding of many samples is made of."""
    px = dense.select(sample, "pixel_id").distinct()
    n = px.groupBy(sample).agg(F.count("*").alias("__n"))
    h = F.pmod(F.xxhash64("pixel_id"), F.lit(1 << 30))
    near = px.join(F.broadcast(n), sample).withColumn("__h", h).where(F.col("__h") < float(1 << 30) * (2 * cap + 64) / F.col("__n"))
    kept = near.withColumn("__r", F.row_number().over(Window.partitionBy(sample).orderBy("__h", "pixel_id"))).where(F.col("__r") <= cap).select(sample, "pixel_id")
    return dense.join(kept, [sample, "pixel_id"], "left_semi")


def pooled_pca(dense: DataFrame, k: int = 2, cap: int = 3000, sample: str = "sample") -> DataFrame:
    """pixel_id, scores of every pixel: components are fitted to at most cap pixels of each sample."""
    parts = [rows(d).withColumn("x", array_to_vector("x")) for d in (pooled(dense, cap, sample), dense)]
    scale = StandardScaler(inputCol="x", outputCol="z", withMean=True).fit(parts[0])
    model = PCA(k=k, inputCol="z", outputCol="s").fit(scale.transform(parts[0]))
    return model.transform(scale.transform(parts[1])).select("pixel_id", vector_to_array("s").alias("scores"))


def joint_segments(dense: DataFrame, k: int = 6, n_components: int = 5, seed: int = 0) -> DataFrame:
    """sample, pixel_id, label: clusters of all samples together, each standardised first.

    dense(sample, pixel_id, feature, v); pixel_id tells pixels apart across samples.
    """
    own = standardised(dense)
    r = rows(own, "sample", log=False).withColumn("z", array_to_vector("x"))
    s = PCA(k=n_components, inputCol="z", outputCol="s").fit(r).transform(r).select("sample", "pixel_id", "s")
    made = KMeans(k=k, featuresCol="s", predictionCol="c", seed=seed).fit(s).transform(s)
    return made.select("sample", "pixel_id").join(by_size(made.select("pixel_id", "c")), "pixel_id")


def smoothed_segments(dense: DataFrame, pixels: DataFrame, k: int = 6, n_components: int = 3, sigma: float = 1.0, seed: int = 0) -> DataFrame:
    """pixel_id, label: PCA scores smoothed over the grid, then clustered."""
    scores, _, _ = pca(dense, n_components)
    long = scores.select("pixel_id", F.posexplode("scores").alias("c", "v"))
    parts = None
    for i in range(n_components):
        one = smooth(long.where(F.col("c") == i).select("pixel_id", "v"), pixels, sigma, 3).withColumnRenamed("v", f"s{i}")
        parts = one if parts is None else parts.join(one, "pixel_id")
    s = parts.select("pixel_id", array_to_vector(F.array(*[F.col(f"s{i}") for i in range(n_components)])).alias("s"))
    made = KMeans(k=k, featuresCol="s", predictionCol="c", seed=seed).fit(s).transform(s)
    return by_size(made.select("pixel_id", "c"))
