"""What tells regions apart: markers, shrunken centroids, localisation, membership, classes, co-localisation.

dense(pixel_id, feature, label, v) has a row for every pixel and feature.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import scratch
from . import statistics as st


def one_vs_rest(dense: DataFrame, min_prevalence: float = 0.5) -> DataFrame:
    """label, feature, auc, log2_fc, mean_in, mean_out, present for each label against all others.

    Counts of equal values serve all labels at once: the rest of a label is what the whole has beyond it.
    """
    kept = dense.where("label >= 0")
    tau = st.fold_floor(kept)
    by = scratch(kept.groupBy("feature", "v", "label").agg(F.count("*").alias("c")), "counts")
    ranks = st.with_ranks(by.groupBy("feature", "v").agg(F.sum("c").alias("t")), ["feature"]).drop("t")
    sums = by.join(ranks, ["feature", "v"]).join(F.broadcast(tau)).groupBy("feature", "label").agg(
        F.sum("c").alias("n_in"), F.sum(F.col("c") * F.col("rank")).alias("r"), F.sum(F.col("c") * F.col("v")).alias("s"), F.sum(F.when(F.col("v") > F.col("tau"), F.col("c")).otherwise(0)).alias("up")
    )
    w = Window.partitionBy("feature")
    n, m = F.sum("n_in").over(w), F.col("n_in")
    out = sums.select("label", "feature", m.alias("n_in"), (n - m).alias("n_out"), "r", (F.col("s") / m).alias("mean_in"), ((F.sum("s").over(w) - F.col("s")) / (n - m)).alias("mean_out"), (F.col("up") / m).alias("prevalence")).where("n_out > 0").join(F.broadcast(tau))
    a, b = F.col("n_out"), F.col("n_in")
    return out.select("label", "feature", "mean_in", "mean_out", ((F.col("r") - b * (b + 1) / 2) / (a * b)).alias("auc"), st.log2_fold(F.col("mean_out"), F.col("mean_in"), F.col("tau")).alias("log2_fc"), (F.col("prevalence") >= min_prevalence).alias("present"))


def markers(dense: DataFrame, top_n: int = 15) -> DataFrame:
    """The top_n features of each label: present ones first, then by how far the AUC is from one half."""
    found = one_vs_rest(dense)
    w = Window.partitionBy("label").orderBy(F.desc("present"), F.desc(F.round(F.abs(F.col("auc") - 0.5), 9)), "feature")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)


def shrunken_centroids(dense: DataFrame, shrink: float = 2.0) -> DataFrame:
    """label, feature, d: soft-thresholded distance of a label's mean from the whole; only those that are left."""
    g = dense.groupBy("feature", "label").agg(F.count("*").alias("nk"), F.avg("v").alias("mk"), F.var_pop("v").alias("vk"))
    w = Window.partitionBy("feature")
    n, k = F.sum("nk").over(w), F.count("*").over(w)
    per = g.select("feature", "label", "nk", "mk", n.alias("n"), (F.sum(F.col("nk") * F.col("mk")).over(w) / n).alias("grand"), F.sqrt(F.sum(F.col("nk") * F.col("vk")).over(w) / F.greatest(F.lit(1), n - k)).alias("sj"))
    s0 = per.select("feature", "sj").distinct().agg(F.percentile("sj", 0.5).alias("s0"))
    m = F.sqrt(1 / F.col("nk") - 1 / F.col("n"))
    d = (F.col("mk") - F.col("grand")) / (m * (F.col("sj") + F.col("s0")))
    soft = F.signum(d) * F.greatest(F.abs(d) - shrink, F.lit(0.0))
    return per.join(F.broadcast(s0)).select("label", "feature", soft.alias("d")).where("d <> 0")


def localisation(dense: DataFrame, region: int) -> DataFrame:
    """feature, auc, log2_fc of a region against the rest of the tissue (signal over 5% of its median)."""
    tic = dense.groupBy("pixel_id").agg(F.sum("v").alias("tic"))
    edge = tic.agg((F.percentile(F.when(F.col("tic") > 0, F.col("tic")), 0.5) * 0.05).alias("edge"))
    tissue = tic.join(F.broadcast(edge)).where("tic > edge").select("pixel_id")
    values = dense.join(tissue, "pixel_id", "left_semi").select("feature", F.when(F.col("label") == region, "B").otherwise("A").alias("grp"), "v")
    return st.two_group(values).select("feature", "auc", "log2_fc", "mean_a", "mean_b")


def membership(dense: DataFrame, min_prevalence: float = 0.5, quantile: float = 0.75) -> DataFrame:
    """feature, compartment: the labels in which a feature is over its own quantile often enough, in order."""
    floor = dense.groupBy("feature").agg(F.percentile("v", quantile).alias("floor"))
    prev = dense.join(F.broadcast(floor), "feature").groupBy("feature", "label").agg(F.avg((F.col("v") > F.col("floor")).cast("double")).alias("p"))
    return prev.groupBy("feature").agg(F.concat_ws("+", F.transform(F.array_sort(F.collect_list(F.when(F.col("p") >= min_prevalence, F.col("label")))), lambda x: x.cast("string"))).alias("compartment"))


def class_values(dense: DataFrame, classes: DataFrame) -> DataFrame:
    """Features summed by class(feature, class) for each pixel; the class takes the feature's place."""
    return dense.join(F.broadcast(classes), "feature").groupBy("pixel_id", "label", F.col("class").alias("feature")).agg(F.sum("v").alias("v"))


def class_composition(dense: DataFrame, classes: DataFrame) -> DataFrame:
    """label, class, percent: the share of each class in a label's mean signal."""
    mean = class_values(dense, classes).groupBy("label", F.col("feature").alias("class")).agg(F.avg("v").alias("m"))
    return mean.select("label", "class", (100 * F.col("m") / F.sum("m").over(Window.partitionBy("label"))).alias("percent"))


def colocalisation(dense: DataFrame, target: int) -> DataFrame:
    """feature and its likeness to a target: pearson, cosine, m1, m2, dice over the pixels of both.

    A footprint is what is at or above the median of the positive values; an empty one gives null shares.
    """
    med = dense.where("v > 0").groupBy("feature").agg(F.percentile("v", 0.5).alias("med"))
    values = dense.join(F.broadcast(med), "feature", "left").select("pixel_id", "feature", "v", F.coalesce(F.col("v") >= F.col("med"), F.lit(False)).alias("on"))
    t = values.where(F.col("feature") == target).select("pixel_id", F.col("v").alias("tv"), F.col("on").alias("ton"))
    v, tv, on, ton = F.col("v"), F.col("tv"), F.col("on"), F.col("ton")
    both, div = on & ton, lambda a, b: F.when(b != 0, a / b)
    return values.join(t, "pixel_id").groupBy("feature").agg(
        F.corr(tv, v).alias("pearson"), div(F.sum(v * tv), F.sqrt(F.sum(v * v) * F.sum(tv * tv))).alias("cosine"),
        div(F.sum(F.when(on, tv).otherwise(0.0)), F.sum(tv)).alias("m1"), div(F.sum(F.when(ton, v).otherwise(0.0)), F.sum(v)).alias("m2"),
        div(2.0 * F.count_if(both), F.count_if(on) + F.count_if(ton)).alias("dice"),
    )


def coloc_matrix(dense: DataFrame) -> DataFrame:
    """f1 < f2 and their cosine: one pass over pixels, each with its few features as an array."""
    rows = dense.groupBy("pixel_id").agg(F.collect_list(F.struct("feature", "v")).alias("fs"))
    a = rows.select(F.explode("fs").alias("a"), "fs").select("a", F.explode("fs").alias("b")).where("a.feature <= b.feature")
    dots = a.groupBy(F.col("a.feature").alias("f1"), F.col("b.feature").alias("f2")).agg(F.sum(F.col("a.v") * F.col("b.v")).alias("dot"))
    norms = dots.where("f1 = f2").select(F.col("f1").alias("f"), F.sqrt("dot").alias("norm"))
    n1, n2 = norms.select(F.col("f").alias("f1"), F.col("norm").alias("n1")), norms.select(F.col("f").alias("f2"), F.col("norm").alias("n2"))
    return dots.where("f1 < f2").join(F.broadcast(n1), "f1").join(F.broadcast(n2), "f2").select("f1", "f2", F.when(F.col("n1") * F.col("n2") > 0, F.col("dot") / (F.col("n1") * F.col("n2"))).alias("cosine"))


def region_correlation(dense: DataFrame) -> DataFrame:
    """a < b and the Pearson correlation of their mean profiles."""
    mean = dense.groupBy("label", "feature").agg(F.avg("v").alias("m"))
    x, y = mean.select(F.col("label").alias("a"), "feature", F.col("m").alias("ma")), mean.select(F.col("label").alias("b"), "feature", F.col("m").alias("mb"))
    return x.join(y, "feature").where("a < b").groupBy("a", "b").agg(F.corr("ma", "mb").alias("score"))


def best_match(pairs: DataFrame) -> DataFrame:
    """label, match: the most alike other label; of equals, the smaller."""
    both = pairs.select(F.col("a").alias("label"), F.col("b").alias("match"), "score").union(pairs.select(F.col("b").alias("label"), F.col("a").alias("match"), "score"))
    return both.groupBy("label").agg(F.min(F.struct((-F.col("score")).alias("s"), "match")).alias("m")).select("label", "m.match")


def filter_auc(table: DataFrame, side: str = "either", cut: float = 0.7) -> DataFrame:
    """Rows whose auc speaks for A (at most cut), B (at least) or either."""
    far = {"A": F.col("auc") <= cut, "B": F.col("auc") >= cut, "either": F.abs(F.col("auc") - 0.5) >= abs(cut - 0.5)}[side]
    return table.where(F.col("auc").isNotNull() & far)


def marker_panel(tables: list[DataFrame], side: str = "either", cut: float = 0.6, max_q: float = 0.05) -> DataFrame:
    """The features that pass in any of several comparisons, each from the first in which it does."""
    kept = [filter_auc(t, side, cut).where(F.col("q_value") <= max_q).withColumn("pair", F.lit(k)) for k, t in enumerate(tables)]
    every = kept[0]
    for t in kept[1:]:
        every = every.unionByName(t)
    w = Window.partitionBy("feature").orderBy("pair")
    return every.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def region_table(dense: DataFrame) -> DataFrame:
    """label, feature, n, mean, median, sd (n - 1; zero for one pixel) of every region and feature."""
    return dense.groupBy("label", "feature").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.percentile("v", 0.5).alias("median"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("sd"))


def background(labels: DataFrame, dense: DataFrame, share: float = 0.1) -> DataFrame:
    """cluster, n_pixels, median of the clusters of labels(pixel_id, cluster >= 0) that look like no tissue.

    Those are clusters whose median of a pixel's summed values, not normalised, is under a share of the brightest's.
    """
    total = dense.groupBy("pixel_id").agg(F.sum("v").alias("total"))
    per = labels.where("cluster >= 0").join(total, "pixel_id").groupBy("cluster").agg(F.count("*").alias("n_pixels"), F.percentile("total", 0.5).alias("median"))
    top = per.agg(F.max("median").alias("top"))  # one row
    return per.join(F.broadcast(top)).where((F.col("top") > 0) & (F.col("median") < share * F.col("top"))).drop("top")


def cross_correlation(a: DataFrame, b: DataFrame) -> DataFrame:
    """a < b and the Pearson correlation of two regions over both assays a and b, each (feature, label, v).

    Each region's mean of a feature is standardised over regions, so that neither assay's scale decides; a feature that
    is the same everywhere counts as zero.  Null values, pixels that an assay doesn't cover, don't enter a mean, and a
    region that it doesn't cover at all takes the mean of its other means.
    """
    def block(df: DataFrame, name: str) -> DataFrame:
        mean = df.groupBy("label", "feature").agg(F.avg("v").alias("m"))
        filled = mean.withColumn("m", F.coalesce("m", F.avg("m").over(Window.partitionBy(F.lit(name)))))  # a row a region and feature
        w = Window.partitionBy("feature")
        sd = F.stddev_pop("m").over(w)
        return filled.select("label", F.concat(F.lit(name), F.col("feature").cast("string")).alias("feature"), F.when(sd > 1e-12, (F.col("m") - F.avg("m").over(w)) / sd).otherwise(0.0).alias("v"))

    return region_correlation(block(a, "a").unionByName(block(b, "b")))


def ion_rank(vectors: DataFrame, target_mz: float) -> DataFrame:
    """feature, mz, score: cosine of every ion of vectors(feature, mz, vector) to the one nearest to target_mz, itself included.

    Ties for the nearest go to the smaller m/z.  A zero or null vector has no score.
    """
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    target = vectors.agg(F.min_by("vector", F.struct(F.abs(F.col("mz") - target_mz), "mz", "feature")).alias("__t"))  # one row
    norm = F.sqrt(dot(F.col("vector"), F.col("vector"))) * F.sqrt(dot(F.col("__t"), F.col("__t")))
    score = F.when(norm > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("vector"), F.col("__t")) / norm)))
    return vectors.join(F.broadcast(target)).select("feature", "mz", score.alias("score"))
