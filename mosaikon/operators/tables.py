"""Tables of features: attach analyses, peak tables with two groups, calibration, reports, the run log."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import special
from .ranges import nearest

#: Distinct values up to which a key may become columns.
MAX_PIVOT = 40


def slug(text: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one underscore, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))


def run_prefixes(runs: DataFrame) -> DataFrame:
    """run_id, prefix: the kind of run, with its ordinal among those of its kind if it isn't the only one."""
    from pyspark.sql import Window

    w = Window.partitionBy("kind")
    n, k = F.count("*").over(w), F.row_number().over(w.orderBy("created", "run_id"))
    return runs.select("run_id", F.when(n > 1, F.concat(slug(F.col("kind")), F.lit("_"), k.cast("string"))).otherwise(slug(F.col("kind"))).alias("prefix"))


def attach(base: DataFrame, analysis: DataFrame, prefix: str, key: str | None = None, ppm: float = 5.0) -> DataFrame:
    """base(mz, ...) with the columns of analysis(mz, [key], ...) of the nearest m/z; each value of key makes columns.

    Of several rows of one m/z (and key) the least by all its columns counts.  A key with over MAX_PIVOT values is
    refused.
    """
    own = [c for c in analysis.columns if c not in ("mz", key)]
    if key:
        values = sorted(r[0] for r in analysis.select(key).distinct().limit(MAX_PIVOT + 1).collect())
        if not 2 <= len(values) <= MAX_PIVOT:
            raise ValueError(f"{key} has {len(values)} values or more; 2 to {MAX_PIVOT} can be columns")
        wide = analysis.groupBy("mz").pivot(key, values).agg(*[F.min(F.struct(*own))[c].alias(c) for c in own])
        names = [c for c in wide.columns if c != "mz"]
        if len(own) == 1:
            renamed = {c: f"{prefix}.{c}.{own[0]}" for c in names}
        else:
            renamed = {c: f"{prefix}.{c.rsplit('_', 1)[0]}.{c.rsplit('_', 1)[1]}" for c in names}
    else:
        wide = analysis.groupBy("mz").agg(*[F.min(F.struct(*own))[c].alias(c) for c in own])
        renamed = {c: f"{prefix}.{c}" for c in own}
    ref = wide.select(F.col("mz").alias("ref_mz"), *[F.col(f"`{c}`").alias(n.replace(".", "__")) for c, n in renamed.items()])
    met = nearest(base, ref, ppm, ["mz"])
    return met.select(*base.columns, *[F.col(n.replace(".", "__")).alias(n) for n in renamed.values()])


def join_by_mz(base: DataFrame, other: DataFrame, ppm: float = 5.0) -> DataFrame:
    """Every row of base(mz, ...) with the nearest row of other(ref_mz, ...), nulls without any."""
    return nearest(base, other, ppm, ["mz"])


@F.pandas_udf(DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    return pd.Series(1 - special.normal_sf(z))


def binormal(table: DataFrame) -> DataFrame:
    """table(mz, a_mean, a_sd, b_mean, b_sd) with z (the argument of Phi; null without spread) and log2_fc.

    tau is the 5th percentile of all positive means.
    """
    means = table.select(F.explode(F.array("a_mean", "b_mean")).alias("m")).where("m > 0").agg(F.coalesce(F.percentile("m", 0.05), F.lit(1.0)).alias("tau"))
    sd = F.sqrt(F.col("a_sd") * F.col("a_sd") + F.col("b_sd") * F.col("b_sd"))
    out = table.join(F.broadcast(means))
    return out.withColumns({"z": F.when(sd > 0, (F.col("b_mean") - F.col("a_mean")) / sd), "log2_fc": F.log2((F.col("b_mean") + F.col("tau")) / (F.col("a_mean") + F.col("tau")))}).drop("tau")


def binormal_auc(table: DataFrame) -> DataFrame:
    """binormal with auc; without spread 1, 0 or one half by which mean is larger."""
    flat = F.when(F.col("b_mean") > F.col("a_mean"), 1.0).when(F.col("b_mean") < F.col("a_mean"), 0.0).otherwise(0.5)
    return binormal(table).withColumn("auc", F.when(F.col("z").isNull(), flat).otherwise(normal_cdf(F.coalesce("z", F.lit(0.0)))))


def fit_calibration(points: DataFrame, weight: str = "none", through_origin: bool = False, keys: list[str] | None = None) -> DataFrame:
    """slope, intercept, r2, lod, loq of points(concentration, response), weighted by 1, 1/x or 1/x2.

    Points without a positive concentration have no weight where one is asked for.
    """
    keys = keys or []
    x, y = F.col("concentration"), F.col("response")
    w = {"none": F.lit(1.0), "1/x": F.when(x > 0, 1 / x).otherwise(0.0), "1/x2": F.when(x > 0, 1 / (x * x)).otherwise(0.0)}[weight]
    s = points.groupBy(*keys).agg(F.count_if(w > 0).alias("n"), F.sum(w).alias("w"), F.sum(w * x).alias("x"), F.sum(w * y).alias("y"), F.sum(w * x * x).alias("xx"), F.sum(w * x * y).alias("xy"), F.sum(w * y * y).alias("yy"))
    c = F.col
    slope = c("xy") / c("xx") if through_origin else (c("w") * c("xy") - c("x") * c("y")) / (c("w") * c("xx") - c("x") * c("x"))
    s = s.withColumn("slope", slope).withColumn("intercept", F.lit(0.0) if through_origin else (c("y") - c("slope") * c("x")) / c("w"))
    sse = c("yy") - 2 * c("slope") * c("xy") - 2 * c("intercept") * c("y") + c("slope") * c("slope") * c("xx") + 2 * c("slope") * c("intercept") * c("x") + c("intercept") * c("intercept") * c("w")
    sst = c("yy") if through_origin else c("yy") - c("y") * c("y") / c("w")
    s = s.withColumn("sse", F.greatest(F.lit(0.0), sse)).withColumn("r2", F.when(sst > 0, 1 - F.greatest(F.lit(0.0), sse) / sst))
    sd = F.sqrt(c("sse") / (c("n") - (1 if through_origin else 2)))
    fine = (c("slope") > 0) & (c("n") > (1 if through_origin else 2)) & (c("sse") > 0)
    return s.select(*keys, "slope", "intercept", "r2", F.when(fine, 3.3 * sd / c("slope")).alias("lod"), F.when(fine, 10 * sd / c("slope")).alias("loq"))


def apply_calibration(responses: DataFrame, model: DataFrame, lo: float, hi: float) -> DataFrame:
    """responses(response, ...) with concentration and whether it lies in the calibrated range."""
    c = (F.col("response") - F.col("intercept")) / F.col("slope")
    slack = abs(hi - lo) * 1e-9
    out = responses.join(F.broadcast(model.select("slope", "intercept"))).withColumn("concentration", F.when(F.col("slope") != 0, c))
    return out.withColumn("in_range", F.coalesce(F.col("concentration").between(lo - slack, hi + slack), F.lit(False))).drop("slope", "intercept")


def stale_runs(runs: DataFrame, current: DataFrame) -> DataFrame:
    """run_id, digest, stale: runs(run_id, dataset, inputs) whose dataset's fingerprint has changed or whose inputs have.

    current(dataset, fingerprint, inputs) says how things are now; the digest is SHA-1 of the inputs as JSON.
    """
    digest = lambda c: F.sha1(F.to_json(c))
    now = current.select("dataset", F.col("fingerprint").alias("now_fp"), digest("inputs").alias("now_digest"))
    own = runs.withColumn("digest", digest("inputs")).join(now, "dataset", "left")
    return own.select("run_id", "digest", (~(F.col("fingerprint").eqNullSafe(F.col("now_fp")) & F.col("digest").eqNullSafe(F.col("now_digest")))).alias("stale"))


def region_response(values: DataFrame, regions: DataFrame, analyte: int, standard: int | None = None) -> DataFrame:
    """region, response: the mean of the analyte's values(pixel_id, feature, v) over regions(region, pixel_id).

    With an internal standard it is the ratio to the mean of that; null where the standard isn't positive.  Pixels
    without a value count as zero.
    """
    asked = values.where(F.col("feature").isin(analyte, *([] if standard is None else [standard])))
    mean = lambda f: F.sum(F.when(F.col("feature") == f, F.col("v")).otherwise(0.0)) / F.count_distinct("pixel_id")
    got = regions.join(asked, "pixel_id", "left").groupBy("region").agg(mean(analyte).alias("a"), *([] if standard is None else [mean(standard).alias("s")]))
    return got.select("region", (F.col("a") if standard is None else F.when(F.col("s") > 0, F.col("a") / F.col("s"))).alias("response"))


def calibration_report(points: DataFrame, weight: str = "none", through_origin: bool = False, units: str = "", keys: list[str] | None = None) -> DataFrame:
    """fit_calibration with n_levels, conc_min, conc_max, weighting, through_origin and units: what a report states."""
    keys = keys or []
    x = F.when(F.col("response").isNotNull(), F.col("concentration"))
    span = points.groupBy(*keys).agg(F.count_distinct(x).alias("n_levels"), F.min(x).alias("conc_min"), F.max(x).alias("conc_max"))
    fit = fit_calibration(points, weight, through_origin, keys)
    both = fit.join(span, keys) if keys else fit.join(F.broadcast(span))  # one row each
    return both.withColumns({"weighting": F.lit(weight), "through_origin": F.lit(through_origin), "units": F.lit(units)})


def reporting(fields: DataFrame, meta: DataFrame) -> DataFrame:
    """section, field, value, status of a checklist fields(section, field, required, observed) and meta(section, field, value).

    What was observed comes before what a user wrote; blanks count as nothing.  A status is ok, missing where a required
    field has no value, and warn for others.  Of several values the first by order counts.
    """
    blank = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    given = meta.select("section", "field", blank("value").alias("__v")).groupBy("section", "field").agg(F.min("__v").alias("__v"))
    value = F.coalesce(blank("observed"), F.col("__v"))
    got = fields.join(given, ["section", "field"], "left").withColumn("value", value)
    status = F.when(F.col("value").isNotNull(), "ok").when(F.col("required"), "missing").otherwise("warn")
    return got.select("section", "field", "value", status.alias("status"))


def reporting_summary(report: DataFrame) -> DataFrame:
    """n_ok, n_warn, n_missing and ready: whether no required field is missing."""
    n = lambda s: F.count_if(F.col("status") == s)
    return report.agg(n("ok").alias("n_ok"), n("warn").alias("n_warn"), n("missing").alias("n_missing"), (n("missing") == 0).alias("ready"))
