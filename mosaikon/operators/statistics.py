"""Tests between groups, per feature: ranks, two and more groups, false discovery, receiver curves.

Values come as (feature, grp, v).  Rank statistics work on counts of equal values: those combine before the shuffle
on (feature, v), are written down once, and only distinct values are put in order, those of a large feature in parts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import special
from ..storage import scratch
from .ordered import beside, cumulate, cumulate_by, quantiles


def fold_floor(values: DataFrame, v: str = "v") -> DataFrame:
    """tau: the 5th percentile of the positive values, one if there are none."""
    return quantiles(values.where(F.col(v) > 0), [], v, {"tau": 0.05}).select(F.coalesce("tau", F.lit(1.0)).alias("tau"))


def log2_fold(a: Column, b: Column, tau: Column) -> Column:
    return F.log2((b + tau) / (a + tau))


def tie_blocks(values: DataFrame, groups: Column, keys: list[str]) -> DataFrame:
    """keys, v, n_<group> counts and the average rank of each block of equal values."""
    counts = scratch(values.groupBy(*keys, "v").agg(F.count("*").alias("t"), F.sum(groups.cast("long")).alias("in_b")), "blocks")
    return with_ranks(counts, keys)


def with_ranks(counts: DataFrame, keys: list[str]) -> DataFrame:
    """counts(keys, v, t), a written table, with the average rank of each block of t equal values."""
    upto = cumulate_by(counts.withColumn("rank", F.col("t")), keys, "v", ["rank"])
    return upto.withColumn("rank", F.col("rank") - (F.col("t") - 1) / 2)


def rank_auc(values: DataFrame, keys: list[str] | None = None, b: str = "B") -> DataFrame:
    """keys, n_a, n_b, auc (over one half: higher in B), u, z with tie correction and continuity."""
    keys = keys or ["feature"]
    blocks = tie_blocks(values, F.col("grp") == b, keys)
    t = F.col("t")
    got = blocks.groupBy(*keys).agg(
        F.sum("t").alias("n"), F.sum("in_b").alias("n_b"), F.sum(F.col("in_b") * F.col("rank")).alias("r"), F.sum((t * t * t - t).cast("double")).alias("ties")
    )
    nb, na, n = F.col("n_b").cast("double"), (F.col("n") - F.col("n_b")).cast("double"), F.col("n").cast("double")
    u = F.col("r") - nb * (nb + 1) / 2
    sd = F.sqrt(na * nb / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    top = F.greatest(u, na * nb - u)
    return got.where((na > 0) & (nb > 0)).select(
        *keys, na.cast("long").alias("n_a"), nb.cast("long").alias("n_b"), (u / (na * nb)).alias("auc"), u.alias("u"),
        F.when(sd > 0, (top - na * nb / 2 - 0.5) / sd).otherwise(0.0).alias("z"), (F.col("ties") > 0).alias("tied"),
    )


def moments(values: DataFrame, keys: list[str] | None = None, a: str = "A", b: str = "B") -> DataFrame:
    """keys, then n, mean and standard deviation (n - 1; zero for one value) of both groups."""
    keys = keys or ["feature"]
    of = lambda g: F.when(F.col("grp") == g, F.col("v"))
    return values.groupBy(*keys).agg(*[
        x for g, s in ((a, "a"), (b, "b")) for x in (F.count(of(g)).alias(f"n_{s}"), F.avg(of(g)).alias(f"mean_{s}"), F.coalesce(F.stddev_samp(of(g)), F.lit(0.0)).alias(f"sd_{s}"))
    ])


def t_statistic(m: DataFrame, equal_var: bool = False) -> DataFrame:
    """moments -> t (B minus A) and its degrees of freedom: Welch's, or Student's with one variance."""
    na, nb, va, vb = F.col("n_a"), F.col("n_b"), F.col("sd_a") * F.col("sd_a"), F.col("sd_b") * F.col("sd_b")
    diff = F.col("mean_b") - F.col("mean_a")
    if equal_var:
        df = (na + nb - 2).cast("double")
        se2 = ((na - 1) * va + (nb - 1) * vb) / df * (1 / na + 1 / nb)
    else:
        se2 = va / na + vb / nb
        df = se2 * se2 / ((va / na) * (va / na) / (na - 1) + (vb / nb) * (vb / nb) / (nb - 1))
    fine = (na > 1) & (nb > 1) & (se2 > 0)
    return m.withColumns({"t": F.when(fine, diff / F.sqrt(se2)), "df": F.when(fine, df)})


@F.pandas_udf(DoubleType())
def p_of_t(t: pd.Series, df: pd.Series) -> pd.Series:
    out = np.ones(len(t))
    fine = (t.notna() & df.notna()).to_numpy()
    if fine.any():
        out[fine] = special.t_two_sided(t[fine], df[fine])
    return pd.Series(out)


@F.pandas_udf(DoubleType())
def p_of_rank(u: pd.Series, z: pd.Series, na: pd.Series, nb: pd.Series, tied: pd.Series) -> pd.Series:
    """Exact where a group has 8 values at most and none are equal, else normal."""
    out = np.minimum(1.0, 2 * special.normal_sf(z.to_numpy()))
    for k in np.flatnonzero(((np.minimum(na, nb) <= 8) & ~tied).to_numpy()):
        out[k] = special.exact_rank_sum(float(u.iloc[k]), int(na.iloc[k]), int(nb.iloc[k]))
    return pd.Series(out)


@F.pandas_udf(DoubleType())
def p_of_chi2(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(special.chi2_sf(x.fillna(0), df))


@F.pandas_udf(DoubleType())
def p_of_f(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series(special.f_sf(f.fillna(0), d1.to_numpy(float), d2.to_numpy(float)))


def two_group(values: DataFrame, keys: list[str] | None = None, a: str = "A", b: str = "B") -> DataFrame:
    """keys, means, deviations, auc, log2_fc (B over A) and present (either mean above the floor tau)."""
    keys = keys or ["feature"]
    both = values.where(F.col("grp").isin(a, b))
    tau = fold_floor(both)
    m = moments(both, keys, a, b).join(rank_auc(both, keys, b).drop("n_a", "n_b"), keys).join(F.broadcast(tau))
    ma, mb, floor = F.col("mean_a"), F.col("mean_b"), F.col("tau")
    return m.withColumns({"log2_fc": log2_fold(ma, mb, floor), "present": (ma > floor) | (mb > floor)})


def two_group_test(values: DataFrame, method: str = "mwu", keys: list[str] | None = None, a: str = "A", b: str = "B") -> DataFrame:
    """two_group with p_value (mwu, welch or student) and q_value."""
    keys = keys or ["feature"]
    m = two_group(values, keys, a, b)
    if method == "mwu":
        m = m.withColumn("p_value", p_of_rank("u", "z", "n_a", "n_b", "tied"))
    else:
        m = t_statistic(m, method == "student").withColumn("p_value", p_of_t("t", "df"))
    return bh(m, "p_value", "q_value", [])


def by_sample(values: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Replicates instead of pixels: the mean of each sample >= 0 and group."""
    keys = keys or ["feature"]
    return values.where(F.col("sample") >= 0).groupBy(*keys, "grp", "sample").agg(F.avg("v").alias("v"))


def bh(df: DataFrame, p: str = "p", q: str = "q", family: list[str] | None = None) -> DataFrame:
    """Benjamini-Hochberg q-values within a family; null p stays null and doesn't count.

    Without a family the tests may be as many as there are: the table is written once, counts of equal p are summed in
    pieces, and the q of each p is joined on.  A family is put in order in one task; an empty list makes one of all
    rows, for tables with a row for each feature of an axis.
    """
    if family is None:
        return _bh_wide(scratch(df, "bh"), p, q)
    w = Window.partitionBy(*(family or [F.lit(0)]))
    tested = F.col(p).isNotNull()
    rank = F.row_number().over(w.orderBy(F.col(p).asc_nulls_last()))
    n = F.count(p).over(w)
    raw = df.withColumn("__raw", F.when(tested, F.col(p) * n / rank))
    least = F.min("__raw").over(w.orderBy(F.col(p).asc_nulls_last()).rowsBetween(0, Window.unboundedFollowing))
    return raw.withColumn(q, F.when(tested, F.greatest(F.lit(0.0), F.least(F.lit(1.0), least)))).drop("__raw")


def _bh_wide(df: DataFrame, p: str, q: str) -> DataFrame:
    blocks = df.where(F.col(p).isNotNull()).groupBy(p).agg(F.count("*").alias("__t"))
    n = blocks.agg(F.sum("__t").alias("__n"))  # one row
    raw = cumulate(blocks, p, ["__t"]).join(F.broadcast(n)).select(p, (F.col(p) * F.col("__n") / F.col("__t")).alias("__q"))
    least = cumulate(raw, p, ["__q"], descending=True, how=F.min)
    return df.join(least, p, "left").select(*df.columns, F.when(F.col(p).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), "__q"))).alias(q))


def kruskal(values: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, h (corrected for ties), df, top_group (largest mean; first by name of equal ones)."""
    keys = keys or ["feature"]
    counts = scratch(values.groupBy(*keys, "v", "grp").agg(F.count("*").alias("c")), "counts")
    blocks = with_ranks(counts.groupBy(*keys, "v").agg(F.sum("c").alias("t")), keys)
    t = F.col("t").cast("double")
    whole = blocks.groupBy(*keys).agg(F.sum("t").alias("n"), F.sum(t * t * t - t).alias("ties"))
    ranked = counts.join(blocks, [*keys, "v"]).groupBy(*keys, "grp").agg(F.sum(F.col("rank") * F.col("c")).alias("r"), F.sum("c").alias("m"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"))
    got = ranked.groupBy(*keys).agg(F.sum(F.col("r") * F.col("r") / F.col("m")).alias("s"), F.count("*").alias("k"), F.min(F.struct(-F.col("mean"), "grp")).alias("top"))
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))
    return got.join(whole, keys).select(*keys, F.when(F.col("ties") < n * n * n - n, h).otherwise(0.0).alias("h"), (F.col("k") - 1).alias("df"), F.col("top.grp").alias("top_group"))


def anova(values: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, f, df_between, df_within."""
    keys = keys or ["feature"]
    g = values.groupBy(*keys, "grp").agg(F.count("v").alias("m"), F.avg("v").alias("mean"), F.coalesce(F.var_pop("v"), F.lit(0.0)).alias("var"))
    m, mu = F.col("m"), F.col("mean")
    got = g.groupBy(*keys).agg(F.sum(m).alias("n"), F.count("*").alias("k"), F.sum(m * mu).alias("s"), F.sum(m * mu * mu).alias("ss"), F.sum(m * F.col("var")).alias("within"))
    n, k = F.col("n"), F.col("k")
    between = F.col("ss") - F.col("s") * F.col("s") / n
    f = (between / (k - 1)) / (F.col("within") / (n - k))
    return got.select(*keys, F.when((F.col("within") > 0) & (k > 1) & (n > k), f).otherwise(0.0).alias("f"), (k - 1).alias("df_between"), (n - k).alias("df_within"))


def roc_points(values: DataFrame, keys: list[str] | None = None, b: str = "B") -> DataFrame:
    """keys, score, fpr, tpr: one point for each distinct score from the highest down (the origin is left out).

    The rate of a group without values is null.
    """
    keys = keys or ["feature"]
    hit = (F.col("grp") == b).cast("long")
    counts = scratch(values.groupBy(*keys, "v").agg(F.sum(hit).alias("p"), F.sum(1 - hit).alias("m")), "scores")
    whole = counts.groupBy(*keys).agg(F.sum("p").alias("all_p"), F.sum("m").alias("all_m"))
    down = beside(cumulate_by(counts, keys, "v", ["p", "m"], descending=True), whole, keys)
    return down.select(*keys, F.col("v").alias("score"), F.try_divide("m", "all_m").alias("fpr"), F.try_divide("p", "all_p").alias("tpr"))


def segmentation_test(values: DataFrame, labels: DataFrame, samples: DataFrame, summary: str = "mean_top") -> DataFrame:
    """feature, n_a, n_b, auc, p_value, q_value between samples of groups A and B, by their hottest component.

    values(pixel_id, feature, v), labels(pixel_id, feature, label) with the hottest label largest, samples(pixel_id,
    sample, grp).  Each sample counts once: with the mean of its pixels in the component (zero without any), or with
    their share (frac_top).  Pixels of no sample (null or < 0) are left out; a sample is in the group of most of its
    pixels, of as many in the first by name.
    """
    pixels = samples.where(F.col("grp").isin("A", "B") & (F.col("sample") >= 0))
    sizes = pixels.groupBy("sample", "grp").agg(F.count("*").alias("n"))
    group = sizes.groupBy("sample").agg(F.min_by("grp", F.struct(-F.col("n"), "grp")).alias("grp"), F.sum("n").alias("n"))
    top = labels.groupBy("feature").agg(F.max("label").alias("top"))
    hot = labels.join(top, "feature").where(F.col("label") == F.col("top")).join(pixels.select("pixel_id", "sample"), "pixel_id")
    per = hot.join(values, ["pixel_id", "feature"]).groupBy("feature", "sample").agg(F.avg("v").alias("mean"), F.count("*").alias("m"))
    every = top.select("feature").join(group).join(per, ["feature", "sample"], "left")  # a row a feature and sample
    size = F.coalesce(F.col("mean") if summary == "mean_top" else F.col("m") / F.col("n"), F.lit(0.0))
    tested = rank_auc(every.select("feature", "grp", size.alias("v"))).withColumn("p_value", p_of_rank("u", "z", "n_a", "n_b", "tied"))
    return bh(tested.select("feature", "n_a", "n_b", "auc", "p_value"), "p_value", "q_value", [])
