"""Spectra: statistics of pixels, windows around targets, mean and maximum spectra, binned cubes, ion images.

peaks(pixel_id, mz, intensity) holds one row for each measured value; dense(pixel_id, bin, v) one for each pixel and
bin of a shared axis.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordered import quantiles
from .ranges import window_join


def pixel_stats(peaks: DataFrame) -> DataFrame:
    """pixel_id, tic (sum), rms (root of the mean square), median of the positive intensities."""
    i = F.col("intensity")
    return peaks.groupBy("pixel_id").agg(
        F.sum(i).alias("tic"), F.sqrt(F.avg(i * i)).alias("rms"), F.percentile(F.when(i > 0, i), 0.5).alias("median")
    )


def norm_factors(stats: DataFrame, method: str = "tic", max_amp: float = 3.0, scope: Column | None = None) -> DataFrame:
    """pixel_id, f: divisors with a mean near one and at least 1 / max_amp (no floor if max_amp <= 0).

    scope restricts which pixels set the scale.  Pixels without signal get one.
    """
    raw = F.col(method)
    counted = F.when((raw > 0) & (scope if scope is not None else F.lit(True)), raw)
    scale = stats.agg(F.avg(counted).alias("scale"))
    f = F.when(raw > 0, raw).otherwise(F.col("scale")) / F.col("scale")
    if max_amp > 0:
        f = F.greatest(f, F.lit(1.0 / max_amp))
    return stats.join(F.broadcast(scale)).select("pixel_id", F.coalesce(f, F.lit(1.0)).alias("f"))


def extract_sparse(peaks: DataFrame, targets: DataFrame, ppm: float, reduce: str = "sum") -> DataFrame:
    """(pixel_id, feature_id, value) where a pixel has any value within ppm of a target(feature_id, target_mz)."""
    how = {"sum": F.sum, "max": F.max, "mean": F.avg}[reduce]
    met = window_join(targets, peaks, ppm, "target_mz", "mz")
    return met.groupBy("pixel_id", "feature_id").agg(how("intensity").alias("value"))


def dense_grid(values: DataFrame, pixels: DataFrame, targets: list) -> DataFrame:
    """values with a zero where a pixel has none: a row for every pixel and feature_id in targets.

    values has a row at most for each of them.  A pixel's values travel together and the grid is laid out behind the join, so
    that no row of it is shuffled; a feature list is short.
    """
    held = values.where(F.col("feature_id").isNotNull()).groupBy("pixel_id").agg(F.map_from_entries(F.collect_list(F.struct("feature_id", "value"))).alias("__held"))
    grid = pixels.select("pixel_id").join(held, "pixel_id", "left").select("pixel_id", "__held", F.explode(F.array(*[F.lit(t) for t in targets])).alias("feature_id"))
    return grid.select("pixel_id", "feature_id", F.coalesce(F.try_element_at("__held", "feature_id"), F.lit(0.0)).alias("value"))


def normalised(values: DataFrame, factors: DataFrame) -> DataFrame:
    return values.join(factors, "pixel_id").withColumn("value", F.col("value") / F.col("f")).drop("f")


def mean_spectrum(dense: DataFrame, n_pixels: int | DataFrame) -> DataFrame:
    """bin, mean: the sum over all pixels by their number, so that an absent bin counts as zero."""
    total = dense.groupBy("bin").agg(F.sum("v").alias("s"))
    if isinstance(n_pixels, int):
        return total.select("bin", (F.col("s") / n_pixels).alias("mean"))
    return total.join(F.broadcast(n_pixels.agg(F.count("*").alias("n")))).select("bin", (F.col("s") / F.col("n")).alias("mean"))


def max_spectrum(dense: DataFrame) -> DataFrame:
    return dense.groupBy("bin").agg(F.max("v").alias("peak"))


def cube(peaks: DataFrame, low: float, bin_ppm: float, min_intensity: float = 0.0) -> DataFrame:
    """(bin, pixel_id, value): values summed into bins of constant width in ppm from low on."""
    bin_ = F.floor(F.log(F.col("mz") / low) / F.log1p(F.lit(bin_ppm * 1e-6))).cast("int")
    return peaks.where((F.col("mz") >= low) & (F.col("intensity") > min_intensity)).groupBy(bin_.alias("bin"), "pixel_id").agg(F.sum("intensity").alias("value"))


def write_cube(cube_: DataFrame, path: str, files: int = 32) -> None:
    """A cube sorted by bin over files, so that a range of bins reads few row groups."""
    cube_.repartitionByRange(files, "bin").sortWithinPartitions("bin", "pixel_id").write.mode("overwrite").parquet(path)


def cube_ion(cube_: DataFrame, first: int, last: int, reduce: str = "sum") -> DataFrame:
    """One image from bins first..last; the mean is over the number of bins, empty ones included."""
    part = cube_.where(F.col("bin").between(first, last)).groupBy("pixel_id")
    if reduce == "max":
        return part.agg(F.max("value").alias("value"))
    total = F.sum("value")
    return part.agg((total / (last - first + 1) if reduce == "mean" else total).alias("value"))


def composite(features: DataFrame, weight: str = "raw") -> DataFrame:
    """pixel_id, value: the sum of several ions; balanced scales each by the 99th percentile of its positive values."""
    if weight == "raw":
        return features.groupBy("pixel_id").agg(F.sum("value").alias("value"))
    scale = features.where("value > 0").groupBy("feature_id").agg(F.percentile("value", 0.99).alias("p99"))
    return features.join(F.broadcast(scale), "feature_id").groupBy("pixel_id").agg(F.sum(F.col("value") / F.col("p99")).alias("value"))


def ratio(features: DataFrame, num: int, den: int, eps: float = 1.0) -> DataFrame:
    """pixel_id, value: one ion over another plus eps."""
    of = lambda k: F.sum(F.when(F.col("feature_id") == k, F.col("value")).otherwise(0.0))
    return features.where(F.col("feature_id").isin(num, den)).groupBy("pixel_id").agg((of(num) / (of(den) + eps)).alias("value"))


def image(pixels: DataFrame, values: DataFrame) -> DataFrame:
    """(y, x, value) on the whole rectangle of the pixels, null where nothing was measured."""
    box = pixels.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    cells = box.select(F.explode(F.sequence("y0", "y1")).alias("y"), "x0", "x1").select("y", F.explode(F.sequence("x0", "x1")).alias("x"))
    return cells.join(pixels.join(values, "pixel_id", "left"), ["x", "y"], "left").select("y", "x", "value")


def rotated(pixels: DataFrame, quarter_turns: int) -> DataFrame:
    """x, y turned clockwise by quarters, from zero on."""
    box = pixels.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    x, y, x0, x1, y0, y1 = (F.col(c) for c in ("x", "y", "x0", "x1", "y0", "y1"))
    new = {0: (x - x0, y - y0), 1: (y1 - y, x - x0), 2: (x1 - x, y1 - y), 3: (y - y0, x1 - x)}[quarter_turns % 4]
    return pixels.join(F.broadcast(box)).select("pixel_id", new[0].alias("x"), new[1].alias("y"))


def grid_step(pixels: DataFrame, axis: str = "x") -> DataFrame:
    """step: the greatest common divisor of the gaps between the coordinates of an axis."""
    sorted_ = pixels.agg(F.array_sort(F.collect_set(axis)).alias("c"))  # as many as the image is wide
    gaps = F.transform(F.sequence(F.lit(2), F.size("c")), lambda i: F.element_at("c", i) - F.element_at("c", i - 1))
    gcd = F.expr("aggregate(gaps, cast(0 as bigint), (a, b) -> aggregate(sequence(1, 64), struct(a as p, cast(b as bigint) as q), (s, i) -> if(s.q = 0, s, struct(s.q as p, s.p % s.q as q)), s -> s.p))")
    return sorted_.where(F.size("c") > 1).select(gaps.alias("gaps")).select(gcd.alias("step"))


def raster_counts(points: DataFrame, bins: int) -> DataFrame:
    """(row, col, n): how many points(x, y) fall into each cell of a square raster over their extent."""
    box = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    cell = lambda v, lo, hi: F.least(F.floor((F.col(v) - F.col(lo)) / (F.col(hi) - F.col(lo)) * bins), F.lit(bins - 1)).cast("int")
    return points.join(F.broadcast(box)).groupBy(cell("y", "y0", "y1").alias("row"), cell("x", "x0", "x1").alias("col")).agg(F.count("*").alias("n"))


def quantile_clip(values: DataFrame, low: float = 0.0, high: float = 0.99) -> DataFrame:
    """value clipped to two quantiles of its feature."""
    edges = quantiles(values, ["feature_id"], "value", {"lo": low, "hi": high})
    return values.join(F.broadcast(edges), "feature_id").select("pixel_id", "feature_id", F.greatest("lo", F.least("hi", "value")).alias("value"))


def rgb(values: DataFrame, channels: list[int], high: float = 0.99) -> DataFrame:
    """pixel_id, r, g, b: three ions, each from zero to a quantile of its values, as 0..255."""
    edges = quantiles(values.where(F.col("feature_id").isin(*channels)), ["feature_id"], "value", {"hi": high})
    scaled = values.join(F.broadcast(edges), "feature_id").withColumn("s", F.when(F.col("hi") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / F.col("hi")))).otherwise(0.0))
    of = lambda k: F.floor(F.max(F.when(F.col("feature_id") == k, F.col("s"))) * 255).cast("int")
    return scaled.groupBy("pixel_id").agg(*[of(k).alias(n) for k, n in zip(channels, "rgb", strict=True)])


def mz_bounds(peaks: DataFrame, *by: str) -> DataFrame:
    """n_peaks, mz_lo, mz_hi over the finite m/z of peaks(mz), for each value of `by`."""
    fine = F.col("mz").isNotNull() & ~F.isnan(F.col("mz").cast("double")) & (F.abs("mz") < float("inf"))
    return peaks.where(fine).groupBy(*by).agg(F.count("*").alias("n_peaks"), F.min("mz").alias("mz_lo"), F.max("mz").alias("mz_hi"))


def relative_max(values: DataFrame, high: float = 0.99) -> DataFrame:
    """feature_id, relative_max: the largest value in percent of the hotspot limit, a quantile; zero if that isn't positive."""
    per = values.where(F.col("value").isNotNull()).groupBy("feature_id").agg(F.percentile("value", high).alias("anchor"), F.max("value").alias("top"))
    return per.select("feature_id", F.when(F.col("anchor") > 0, 100 * F.col("top") / F.col("anchor")).otherwise(0.0).alias("relative_max"))


def relative_window(values: DataFrame, low: float, high: float, clip: float = 0.99, anchor: float | None = None) -> DataFrame:
    """values as 0..1 between low and high percent of an anchor, a quantile of the feature unless one is given.

    Without a positive anchor or with high <= low values are only clipped to 0..1.  Nulls stay.
    """
    unit = lambda c: F.when(F.col("value").isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)))
    own = values.groupBy("feature_id").agg((F.percentile("value", clip) if anchor is None or anchor <= 0 else F.lit(float(anchor))).alias("__a"))
    lo, hi = low / 100 * F.col("__a"), high / 100 * F.col("__a")
    scaled = F.when((F.col("__a") > 0) & (hi > lo), unit((F.col("value") - lo) / (hi - lo))).otherwise(unit(F.col("value")))
    return values.join(own, "feature_id").withColumn("value", scaled).drop("__a")


def signal_range(spectrum: DataFrame, share: float = 0.001, pad: float = 0.02) -> DataFrame:
    """lo, hi: the m/z of spectrum(mz, v) with signal of at least a share of the tallest, and a margin; no row without any."""
    size = F.abs("v")
    top = spectrum.agg(F.max(size).alias("top"))  # one row
    got = spectrum.join(F.broadcast(top)).where((F.col("top") > 0) & (size >= share * F.col("top"))).agg(F.min("mz").alias("lo"), F.max("mz").alias("hi")).where("hi > lo")
    margin = (F.col("hi") - F.col("lo")) * pad
    return got.select((F.col("lo") - margin).alias("lo"), (F.col("hi") + margin).alias("hi"))


def fingerprint(pixels: DataFrame, peaks: DataFrame) -> DataFrame:
    """n_pixels, width, height, mz_lo, mz_hi, digest: one row that says which dataset this is.

    The digest is the sum over pixels(pixel_id, x, y) of 32 bits of each one's MD5, so their order doesn't matter.
    """
    part = F.conv(F.substring(F.md5(F.concat_ws(",", *[F.col(c).cast("bigint").cast("string") for c in ("pixel_id", "x", "y")]).cast("binary")), 1, 8), 16, 10).cast("bigint")
    grid = pixels.agg(F.count("*").alias("n_pixels"), (F.max("x") - F.min("x") + 1).cast("long").alias("width"), (F.max("y") - F.min("y") + 1).cast("long").alias("height"), F.sum(part).cast("long").alias("digest"))
    return grid.join(F.broadcast(mz_bounds(peaks).drop("n_peaks")))


def save_cube(cube_: DataFrame, mark: DataFrame, path: str, files: int = 32) -> None:
    """write_cube with the fingerprint of the dataset beside it."""
    write_cube(cube_, f"{path}/cube", files)
    mark.write.mode("overwrite").parquet(f"{path}/fingerprint")


def load_cube(spark: SparkSession, path: str, mark: DataFrame | None = None) -> DataFrame:
    """The cube of save_cube; a ValueError if a fingerprint is given and pixels differ.

    What decides is the number of pixels and their digest: m/z limits may come out otherwise when a file is read again.
    """
    if mark is not None:
        saved = spark.read.parquet(f"{path}/fingerprint").select("n_pixels", "digest").first()
        if saved != mark.select("n_pixels", "digest").first():
            raise ValueError(f"the cube in {path} is of another dataset")
    return spark.read.parquet(f"{path}/cube")
