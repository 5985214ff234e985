"""Many samples: consensus targets, feature tables, comparisons between groups, pseudobulk, batches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import statistics as st
from ..functions import special
from ..storage import scratch
from .ranges import nearest, window_join


def consensus(peaks: DataFrame, ppm: float = 20.0, min_prevalence: float = 0.0) -> DataFrame:
    """target_mz (of the most intense peak), lo, hi, n_samples: m/z clusters over peaks(sample_id, mz, intensity).

    A cluster ends where the gap to the next peak is over the tolerance or its width would be.  Gaps cut the axis into
    islands that know nothing of each other; the width rule runs along one island at a time, over its distinct m/z with
    the largest intensity of each: peaks are combined before they meet, and counted by sample afterwards, so what an
    island holds is bounded by the resolution of the axis and not by samples or peaks.  Equal intensities go to the
    smallest m/z.
    """
    cell = F.floor(F.log("mz") / F.log1p(F.lit(ppm * 1e-6))).cast("long")
    cells = peaks.groupBy(cell.alias("cell")).agg(F.min("mz").alias("lo"), F.max("mz").alias("hi"))
    # cells are one tolerance wide: a gap of at most a tolerance reaches no further than two cells on
    before = [cells.select((F.col("cell") + k).alias("cell"), F.col("hi").alias(f"p{k}")) for k in (1, 2)]
    linked = cells.join(before[0], "cell", "left").join(before[1], "cell", "left")
    tied = F.greatest(*[F.when(F.col("lo") - F.col(f"p{k}") <= F.col("lo") * ppm / 1e6, F.lit(1)).otherwise(0) for k in (1, 2)])
    starts = linked.select("cell", "lo", (1 - tied).alias("new"))
    island = F.sum("new").over(Window.partitionBy(F.lit(0)).orderBy("cell"))  # one row a cell: tolerance-wide steps of the axis
    named = starts.select("cell", island.alias("island"))
    n_samples = peaks.select("sample_id").distinct().count()

    def walk(table: pa.Table) -> pa.Table:
        mz, inten = (table.column(c).to_numpy(zero_copy_only=False) for c in ("mz", "intensity"))
        order = np.argsort(mz)
        mz, inten = mz[order], inten[order]
        edges, first = [0], mz[0]
        for k in range(1, len(mz)):
            tol = mz[k] * ppm / 1e6
            if mz[k] - mz[k - 1] > tol or mz[k] - first > tol:
                edges.append(k)
                first = mz[k]
        edges = np.array(edges)
        ends = np.r_[edges[1:], len(mz)]
        best = np.array([a + int(np.argmax(inten[a:z])) for a, z in zip(edges, ends, strict=True)])
        own = np.repeat(np.arange(len(edges)), ends - edges)
        return pa.table([pa.array(mz), pa.array(mz[best][own]), pa.array(mz[edges][own]), pa.array(mz[ends - 1][own])], ["mz", "target_mz", "lo", "hi"])

    tops = peaks.groupBy("mz", cell.alias("cell")).agg(F.max(F.col("intensity").cast("double")).alias("intensity")).join(named, "cell")
    placed = tops.select(F.col("mz").cast("double"), "intensity", "island").groupBy("island").applyInArrow(walk, "mz double, target_mz double, lo double, hi double")
    met = peaks.select("sample_id", F.col("mz").cast("double")).distinct().join(placed, "mz").select("sample_id", "target_mz", "lo", "hi").distinct()
    return met.groupBy("target_mz", "lo", "hi").agg(F.count("*").alias("n_samples")).where(F.col("n_samples") >= min_prevalence * n_samples)


def feature_table(peaks: DataFrame, targets: DataFrame, ppm: float = 10.0, fill: str = "nan", normalise: str | None = None) -> DataFrame:
    """sample_id, target_id, value: the nearest peak of each sample for each target; null or zero without one.

    normalise divides by a sample's median of positive values or sum, and multiplies by the mean of those.
    """
    samples = peaks.select("sample_id").distinct()
    asked = samples.join(F.broadcast(targets.select("target_id", "target_mz")))

    met = window_join(targets.select("target_id", "target_mz"), peaks.select("sample_id", "mz", "intensity"), ppm, "target_mz", "mz")
    best = met.groupBy("sample_id", "target_id").agg(F.min(F.struct(F.abs(F.col("mz") - F.col("target_mz")).alias("d"), "mz", "intensity"))["intensity"].alias("value"))
    table = asked.join(best, ["sample_id", "target_id"], "left").select("sample_id", "target_id", F.col("value") if fill == "nan" else F.coalesce("value", F.lit(0.0)).alias("value"))
    if normalise is None:
        return table
    positive = F.when(F.col("value") > 0, F.col("value"))
    factor = table.groupBy("sample_id").agg((F.percentile(positive, 0.5) if normalise == "median" else F.sum(positive)).alias("f")).where("f > 0")
    mean = factor.agg(F.avg("f").alias("mf"))
    return table.join(factor, "sample_id", "left").join(F.broadcast(mean)).select("sample_id", "target_id", (F.col("value") / F.col("f") * F.col("mf")).alias("value"))


def group_comparison(table: DataFrame, a: str, b: str, least: int = 2) -> DataFrame:
    """feature, n_a, n_b, auc, log2_fc, n_detected, prevalence of table(feature, sample_id, grp, v); null is absent.

    Only features with at least `least` samples in both groups are compared.
    """
    both = table.where(F.col("grp").isin(a, b))
    n = both.agg(F.count_distinct("sample_id").alias("n_compared"))
    known = both.where(F.col("v").isNotNull())
    compared = st.two_group(known, ["feature"], a, b).where((F.col("n_a") >= least) & (F.col("n_b") >= least))
    seen = known.groupBy("feature").agg(F.count_if(F.col("v") > 0).alias("n_detected"))
    return compared.join(seen, "feature").join(F.broadcast(n)).withColumn("prevalence", F.col("n_detected") / F.col("n_compared"))


def paired_fold(table: DataFrame, a: str, b: str) -> DataFrame:
    """feature, n_pairs, log2_fc: the mean over pairs of table(feature, pair, grp, v) of the log ratio B over A."""
    both = table.where(F.col("grp").isin(a, b) & F.col("v").isNotNull())
    tau = st.fold_floor(both)
    of = lambda g: F.avg(F.when(F.col("grp") == g, F.col("v")))
    pairs = both.groupBy("feature", "pair").agg(of(a).alias("va"), of(b).alias("vb")).where("va IS NOT NULL AND vb IS NOT NULL")
    return pairs.join(F.broadcast(tau)).groupBy("feature").agg(F.count("*").alias("n_pairs"), F.avg(st.log2_fold(F.col("va"), F.col("vb"), F.col("tau"))).alias("log2_fc"))


def pseudobulk(values: DataFrame, how: str = "median") -> DataFrame:
    """sample_id, region, feature, v: one value for all pixels of a region."""
    return values.groupBy("sample_id", "region", "feature").agg((F.percentile("v", 0.5) if how == "median" else F.avg("v")).alias("v"))


def tidy(wide: DataFrame, ids: list[str]) -> DataFrame:
    """A row for each feature column of a wide table."""
    return wide.unpivot(ids, [c for c in wide.columns if c not in ids], "feature", "v")


def features_present(peaks: DataFrame, targets: DataFrame, ppm: float = 20.0) -> DataFrame:
    """target_id, n_samples that have a peak for it."""

    met = window_join(targets.select("target_id", "target_mz"), peaks.select("sample_id", "mz"), ppm, "target_mz", "mz")
    return targets.select("target_id").join(met.groupBy("target_id").agg(F.count_distinct("sample_id").alias("n")), "target_id", "left").select("target_id", F.coalesce("n", F.lit(0)).alias("n_samples"))


def batch_variance(table: DataFrame) -> DataFrame:
    """feature, share: the part of a feature's variance that lies between batches, of table(feature, batch, v)."""
    g = table.groupBy("feature", "batch").agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s"))
    w = g.groupBy("feature").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("sm"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("smm"), F.sum(F.col("n") * F.col("s")).alias("w"))
    between = F.col("smm") - F.col("sm") * F.col("sm") / F.col("n")
    return w.select("feature", F.when(between + F.col("w") > 0, between / (between + F.col("w"))).otherwise(0.0).alias("share"))


def combat_mean(table: DataFrame) -> DataFrame:
    """table with the mean of each batch moved to the feature's: location only, without shrinkage."""
    b = table.groupBy("feature", "batch").agg(F.avg("v").alias("mb"))
    f = table.groupBy("feature").agg(F.avg("v").alias("mf"))
    return table.join(b, ["feature", "batch"]).join(F.broadcast(f), "feature").withColumn("v", F.col("v") - F.col("mb") + F.col("mf")).drop("mb", "mf")


def combat(table: DataFrame, steps: int = 500, tolerance: float = 1e-4) -> DataFrame:
    """Location and scale of table(row_id, feature, batch, v), shrunk towards each batch's prior over all features.

    Moments of each feature and batch are aggregates; the prior of a batch is one row; the fixed point of a batch and
    feature needs those moments and the prior alone, so it runs as a column function over one row each.
    """
    g = table.groupBy("feature", "batch").agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.coalesce(F.var_samp("v"), F.lit(0.0)).alias("s"), F.var_pop("v").alias("p"))
    f = g.groupBy("feature").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"), (F.sum(F.col("n") * F.col("p")) / F.sum("n")).alias("pooled"))
    z = g.join(f, "feature").where("pooled > 0").select("feature", "batch", "n", "grand", "pooled", ((F.col("m") - F.col("grand")) / F.sqrt("pooled")).alias("gamma"), (F.col("s") / F.col("pooled")).alias("delta"))
    prior = z.groupBy("batch").agg(F.avg("gamma").alias("gbar"), F.coalesce(F.var_samp("gamma"), F.lit(0.0)).alias("t2"), F.avg("delta").alias("dm"), F.coalesce(F.var_samp("delta"), F.lit(0.0)).alias("dv"))
    pair = StructType([StructField("g", DoubleType()), StructField("d", DoubleType())])

    @F.pandas_udf(pair)
    def shrink(n: pd.Series, gamma: pd.Series, delta: pd.Series, gbar: pd.Series, t2: pd.Series, dm: pd.Series, dv: pd.Series) -> pd.DataFrame:
        n, gamma, delta, gbar, t2, dm, dv = (x.to_numpy(float) for x in (n, gamma, delta, gbar, t2, dm, dv))
        with np.errstate(divide="ignore", invalid="ignore"):
            a, b = (2 * dv + dm * dm) / dv, (dm * dv + dm**3) / dv
        go, do = gamma.copy(), delta.copy()
        for _ in range(steps):
            gn = np.where(t2 > 0, (n * t2 * gamma + do * gbar) / (n * t2 + do), gbar)
            ss = (n - 1) * delta + n * (gamma - gn) ** 2
            dn = np.where(dv > 0, (b + 0.5 * ss) / (n / 2 + a - 1), dm)
            moved = max(np.max(np.abs(gn - go) / np.maximum(np.abs(go), 1e-12)), np.max(np.abs(dn - do) / np.maximum(np.abs(do), 1e-12))) if len(n) else 0
            go, do = gn, dn
            if moved < tolerance:
                break
        return pd.DataFrame({"g": go, "d": do})

    fit = z.join(F.broadcast(prior), "batch").select("feature", "batch", "grand", "pooled", shrink("n", "gamma", "delta", "gbar", "t2", "dm", "dv").alias("x"))
    sd = F.sqrt("pooled")
    fixed = ((F.col("v") - F.col("grand")) / sd - F.col("x.g")) / F.sqrt(F.col("x.d")) * sd + F.col("grand")
    return table.join(fit, ["feature", "batch"], "left").withColumn("v", F.coalesce(fixed, F.col("v"))).select(*table.columns)


def rank_floor(n_a: int, n_b: int) -> float:
    """The least two-sided p that an exact rank test of these sizes can give."""
    return min(1.0, 2 / math.comb(n_a + n_b, n_a))


def feasibility(sizes: DataFrame, alpha: float = 0.05) -> DataFrame:
    """sizes(n_a, n_b, n_features) with p_floor, max_features and feasible."""
    # 2 / C(n, k) as a product of k quotients: no factorial overflows
    ways = F.aggregate(F.sequence(F.lit(1), F.col("n_a")), F.lit(1.0), lambda acc, k: acc * (F.col("n_b") + k) / k)
    return sizes.withColumn("p_floor", F.least(F.lit(1.0), 2.0 / ways)).withColumn("max_features", F.floor(alpha / F.col("p_floor") + 1e-9)).withColumn("feasible", F.col("n_features") <= F.col("max_features"))


def dedupe(samples: DataFrame) -> DataFrame:
    """One row for each path and region: the newest; a missing group is taken from any other."""
    path = F.lower(F.replace("source", F.lit("\\"), F.lit("/")))
    w = Window.partitionBy("__k", "region")
    ranked = samples.withColumn("__k", path).select("*", F.row_number().over(w.orderBy(F.desc("mtime"), "source")).alias("__r"), F.first("grp", True).over(w.orderBy(F.desc("mtime"), "source").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__g"))
    return ranked.where("__r = 1").withColumn("grp", F.coalesce("grp", "__g")).drop("__k", "__r", "__g")


def group_by_pattern(samples: DataFrame, pattern: str, column: str = "source") -> DataFrame:
    """samples with grp from the first capture of a pattern, or the whole match if it has none."""
    group = 1 if "(" in pattern.replace("\\(", "") else 0
    got = F.regexp_extract(column, pattern, group)
    return samples.withColumn("grp", F.when(got != "", got))


def group_by_folder(samples: DataFrame, column: str = "source") -> DataFrame:
    """samples with grp, the name of the folder that holds the source; null where the path has none."""
    parts = F.split(F.replace(column, F.lit("\\"), F.lit("/")), "/")
    return samples.withColumn("grp", F.nullif(F.get(parts, F.size(parts) - 2), F.lit("")))


def group_by_meta(samples: DataFrame, key: str) -> DataFrame:
    """samples(meta) with grp, what meta says under key; a sample without that keeps its group."""
    return samples.withColumn("grp", F.coalesce(F.try_element_at("meta", F.lit(key)), F.col("grp")))


def assign(samples: DataFrame, chosen: DataFrame, column: str = "grp", key: str = "sample_id") -> DataFrame:
    """samples with a column (grp, batch) as chosen(key, value) says, others as they were; of repeated keys the largest value."""
    new = chosen.groupBy(key).agg(F.max(F.trim("value")).alias("__v"))
    return samples.join(new, key, "left").withColumn(column, F.coalesce("__v", column)).drop("__v")


def by_label(samples: DataFrame, column: str = "grp", key: str = "sample_id") -> DataFrame:
    """label, n, first_key: how many samples each group or batch has, missing ones under ""."""
    return samples.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("label")).agg(F.count("*").alias("n"), F.min(key).alias("first_key"))


def meta_keys(samples: DataFrame) -> DataFrame:
    """key, n: what samples(meta) are described by, and how many by each."""
    return samples.select(F.explode(F.map_keys("meta")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def rebase(samples: DataFrame, old: str, new: str, column: str = "source") -> DataFrame:
    """samples with moved: the path with prefix old, compared without case, put under new; null for other paths."""
    plain = F.replace(F.col(column), F.lit("\\"), F.lit("/"))
    start = old.replace("\\", "/").rstrip("/")
    tail = F.ltrim(F.substr(plain, F.lit(len(start) + 1)), F.lit("/"))
    return samples.withColumn("moved", F.when(F.startswith(F.lower(plain), F.lit(start.lower())), F.concat(F.lit(new.replace("\\", "/").rstrip("/") + "/"), tail)))


def diagnose(samples: DataFrame, files: DataFrame, regions: DataFrame) -> DataFrame:
    """sample_id, n_pixels, problem of samples(sample_id, source, region): why one can't be pooled, null if it can.

    files(path) are those that exist, regions(sample_id, region, pixel_id) the regions saved for a sample; a sample
    without a region is a whole slide, whose pixels aren't counted.
    """
    there = files.select(F.col("path").alias("source"), F.lit(True).alias("__f")).distinct()
    size = regions.groupBy("sample_id", "region").agg(F.count("pixel_id").alias("n_pixels"), F.lit(True).alias("__r"))
    named = samples.select("sample_id", "source", F.nullif("region", F.lit("")).alias("region"))
    got = named.join(there, "source", "left").join(size, ["sample_id", "region"], "left")
    problem = (
        F.when(~F.coalesce(F.endswith(F.lower("source"), F.lit(".imzml")), F.lit(False)), "not an imzML source").when(F.col("__f").isNull(), "source missing")
        .when(F.col("region").isNull(), None).when(F.col("__r").isNull(), "region not saved").when(F.col("n_pixels") == 0, "region without pixels")
    )
    return got.select("sample_id", F.coalesce("n_pixels", F.lit(0)).alias("n_pixels"), problem.alias("problem"))


def missing_sources(samples: DataFrame, files: DataFrame) -> DataFrame:
    """The samples whose imzML isn't among files(path); other sources can't be found again and aren't named."""
    return samples.where(F.endswith(F.lower("source"), F.lit(".imzml"))).join(files.select(F.col("path").alias("source")), "source", "left_anti").select(*samples.columns)


def sample_matrix(table: DataFrame, targets: list) -> DataFrame:
    """table(sample_id, target_id, value) as one row a sample and one column t<target> each: the targets name the columns."""
    return table.groupBy("sample_id").pivot("target_id", targets).agg(F.first("value")).select("sample_id", *[F.col(f"`{t}`").alias(f"t{t}") for t in targets])


def compare_mixing(before: DataFrame, after: DataFrame, points: int = 2000) -> DataFrame:
    """batch_mixing of a table and of its corrected one in one row: columns <name>_before and <name>_after."""
    a, b = batch_mixing(before, points), batch_mixing(after, points)
    return a.select(*[F.col(c).alias(f"{c}_before") for c in a.columns]).join(F.broadcast(b.select(*[F.col(c).alias(f"{c}_after") for c in b.columns])))


def batch_design(samples: DataFrame) -> DataFrame:
    """samples(sample_id, grp, batch) -> sample_id, batch, level, x: the protected design, a column for each group but the first.

    Long rather than wide: what a model needs is the few columns of a sample.  A missing group or batch is "".
    """
    named = samples.select("sample_id", F.coalesce(F.col("grp").cast("string"), F.lit("")).alias("grp"), F.coalesce(F.col("batch").cast("string"), F.lit("")).alias("batch"))
    levels = named.agg(F.array_sort(F.collect_set("grp")).alias("levels"))  # one row with a name for each group
    each = named.join(F.broadcast(levels)).withColumn("level", F.explode(F.slice("levels", F.lit(2), F.greatest(F.size("levels") - 1, F.lit(0)))))
    return each.select("sample_id", "batch", "level", (F.col("grp") == F.col("level")).cast("double").alias("x"))


def relocate(missing: DataFrame, files: DataFrame) -> DataFrame:
    """missing(source) with moved: the one file(path) of the same name, null if none or several."""
    name = lambda c: F.lower(F.element_at(F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/"), -1))
    one = files.groupBy(name("path").alias("__n")).agg(F.count("*").alias("n"), F.min("path").alias("moved")).where("n = 1").drop("n")
    return missing.withColumn("__n", name("source")).join(one, "__n", "left").drop("__n")




def apply_metadata(samples: DataFrame, rows: DataFrame) -> DataFrame:
    """samples(name, meta) with the columns of rows(name, meta) merged in, names compared without case."""
    extra = rows.select(F.lower("name").alias("__k"), F.col("meta").alias("__m")).dropDuplicates(["__k"])
    got = samples.withColumn("__k", F.lower("name")).join(extra, "__k", "left")
    fresh = F.coalesce("__m", F.expr("cast(map() as map<string, string>)"))
    kept = F.map_filter("meta", lambda k, _: ~F.map_contains_key(fresh, k))
    return got.withColumn("meta", F.map_concat(kept, fresh)).drop("__k", "__m")


def subject_and_compartment(samples: DataFrame, subject: str = "slide", compartment: str = "last") -> DataFrame:
    """samples(name, region, meta) with subject (slide, first, last or meta:key) and compartment (exact, first, last or meta:key)."""
    def token(rule: str):
        if rule.startswith("meta:"):
            return F.try_element_at("meta", F.lit(rule[5:]))
        if rule == "slide":
            return F.lower("name")
        if rule == "exact":
            return F.col("region")
        parts = F.split(F.trim("region"), r"\s+")
        return F.element_at(parts, 1 if rule == "first" else -1)

    return samples.withColumns({"subject": token(subject), "compartment": token(compartment)})


#: Pairs of a tested row and a digit that a task of batch_mixing holds before it counts them.
FOLD = 1 << 20
#: Bits of a squared distance that one pass of batch_mixing settles: sign and exponent first.
DIGITS = (12, 6, 6, 8, 16, 16)


def batch_mixing(table: DataFrame, points: int = 2000) -> DataFrame:
    """rejected: the share of tested rows whose neighbours' batches differ from all batches (chi-squared at 0.05).

    table(row_id, feature, batch, v).  A row's neighbours are the nearest quarter of all other rows.  Up to `points`
    rows, drawn by a hash, are tested (the reference tests 100) and broadcast; all rows are held against them.  The
    distance of the k-th neighbour is found digit by digit: a pass counts, for each tested row, the rows that agree
    with the digits found so far, by their next digit.  Rows at just that distance count in part, as many as are
    still wanted, in the proportion of their batches.
    """
    spark = table.sparkSession
    wide = table.groupBy("row_id", "batch").agg(F.array_sort(F.collect_list(F.struct("feature", "v"))).alias("f")).select("row_id", "batch", F.transform("f", lambda x: x["v"].cast("double")).alias("x"))
    wide = scratch(wide, "samples")
    sizes = sorted((r["batch"], r["n"]) for r in wide.groupBy("batch").agg(F.count("*").alias("n")).collect())  # a row for each batch
    drawn = wide.orderBy(F.xxhash64("row_id"), "row_id").limit(points).collect()
    if not drawn:
        return wide.select(F.lit(None).cast("double").alias("rejected")).limit(0)
    n = sum(c for _, c in sizes)
    whole, k = np.array([c for _, c in sizes], float) / n, min(max(3, round(0.25 * n)), n - 1)
    names = {name: i for i, (name, _) in enumerate(sizes)}
    test = spark.sparkContext.broadcast((np.array([r["x"] for r in drawn], float), np.array([r["row_id"] for r in drawn])))

    def distances(b: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """The bits of squared distances of some rows to all tested ones, and whether they are the same row."""
        y, ids = test.value
        own = np.array(b.column(0).to_pylist())
        for at in range(0, len(own), 64):
            part = np.array(b.column(2).slice(at, 64).to_pylist(), float)
            d = np.zeros((len(part), len(y)))
            for f in range(y.shape[1]):  # one order of sums, whatever the batch
                step = part[:, f, None] - y[None, :, f]
                d += step * step
            yield slice(at, at + 64), d.view(np.int64), own[at : at + 64, None] == ids[None, :]

    prefix, want, left = np.zeros(len(drawn), np.int64), np.full(len(drawn), k, np.int64), 64
    for bits in DIGITS:
        left -= bits
        known = spark.sparkContext.broadcast(prefix)

        def count(batches: Iterator[pa.RecordBatch], known=known, left=left, bits=bits) -> Iterator[pa.RecordBatch]:
            keys, counts, found = np.zeros(0, np.int64), np.zeros(0, np.int64), []

            def fold(keys: np.ndarray, counts: np.ndarray, found: list) -> tuple[np.ndarray, np.ndarray]:
                new, m = np.unique(np.concatenate(found), return_counts=True)
                keys, where = np.unique(np.r_[keys, new], return_inverse=True)
                return keys, np.bincount(where, np.r_[counts, m], len(keys)).astype(np.int64)

            for b in batches:
                for _, d, same in distances(b):
                    at = (((d >> left) >> bits) == known.value) & ~same
                    found.append((np.nonzero(at)[1].astype(np.int64) << bits) | ((d[at] >> left) & ((1 << bits) - 1)))
                    if sum(map(len, found)) > max(FOLD, len(keys)):
                        (keys, counts), found = fold(keys, counts, found), []
            if found:
                keys, counts = fold(keys, counts, found)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "n"])

        summed = wide.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        # of each tested row, the digit where the wanted rank is reached
        point, w = F.shiftright("key", bits), Window.partitionBy("point").orderBy("key")
        ranked = summed.withColumn("point", point).withColumn("upto", F.sum("n").over(w)).withColumn("before", F.col("upto") - F.col("n"))
        asked = spark.createDataFrame(list(enumerate(want.tolist())), "point long, want long")
        met = ranked.join(F.broadcast(asked), "point").where("before < want AND want <= upto").select("point", "key", "before")
        for r in met.collect():  # a row for each tested row
            prefix[r["point"]] = (prefix[r["point"]] << bits) | (r["key"] & ((1 << bits) - 1))
            want[r["point"]] -= r["before"]
    kth = spark.sparkContext.broadcast(prefix)

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, tied = np.zeros((len(names), len(kth.value)), np.int64), np.zeros((len(names), len(kth.value)), np.int64)
        for b in batches:
            batch = np.array([names[c] for c in b.column(1).to_pylist()], np.int64)
            for rows, d, same in distances(b):
                for c in np.unique(batch[rows]):
                    own = batch[rows] == c
                    near[c] += ((d[own] < kth.value) & ~same[own]).sum(0)
                    tied[c] += ((d[own] == kth.value) & ~same[own]).sum(0)
        c, point = np.nonzero(near + tied)
        yield pa.RecordBatch.from_arrays([pa.array(point), pa.array(c), pa.array(near[c, point]), pa.array(tied[c, point])], ["point", "c", "near", "tied"])

    found = wide.mapInArrow(compose, "point long, c long, near long, tied long").groupBy("point", "c").agg(F.sum("near").alias("near"), F.sum("tied").alias("tied"))
    near, tied = np.zeros((len(drawn), len(names))), np.zeros((len(drawn), len(names)))
    for r in found.collect():  # tested rows times batches
        near[r["point"], r["c"]], tied[r["point"], r["c"]] = r["near"], r["tied"]
    near += tied * (want / np.maximum(tied.sum(1), 1))[:, None]
    stat = ((near - k * whole) ** 2 / np.maximum(k * whole, 1e-9)).sum(1)
    rejected = float(np.mean([special.chi2_sf(float(s), max(1, len(names) - 1)) < 0.05 for s in stat]))
    return spark.createDataFrame([(rejected,)], "rejected double")


def snap(targets: DataFrame, apexes: DataFrame, ppm: float) -> DataFrame:
    """targets(target_id, mz) moved to the nearest apex(ref_mz) within ppm, where there is one."""
    return nearest(targets, apexes, ppm, ["target_id"]).withColumn("mz", F.coalesce("ref_mz", "mz")).drop("ref_mz")


def union_targets(primary: DataFrame, extra: DataFrame, ppm: float, most: int = 0) -> DataFrame:
    """mz, intensity of all primary targets, and of the extra ones with none of those near; the strongest if capped."""
    near = nearest(extra.select("mz").distinct(), primary.select(F.col("mz").alias("ref_mz")), ppm, ["mz"])
    met = near.where(F.col("ref_mz").isNotNull()).select("mz")
    out = primary.select("mz", "intensity").union(extra.join(met, "mz", "left_anti").select("mz", "intensity"))
    return out.orderBy(F.desc("intensity"), "mz").limit(most) if most else out
