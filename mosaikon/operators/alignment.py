"""Self-alignment of masses: lock masses out of the mean spectrum, one robust correction for each spectrum, warped axes.

peaks(pixel_id, mz, intensity).  A correction is a part: a peak seen at mz belongs to mz / (1 + shift).  Null and
non-positive m/z and rows without a pixel are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chemistry
from ..storage import scratch
from .ranges import bucket, dealt, window_join


def lock_masses(peaks: DataFrame, n_refs: int = 3, min_rel: float = 0.05, min_share: float = 0.5, bin_ppm: float = 20.0) -> DataFrame:
    """ref_id (from 1, the strongest first), ref_mz, rel_intensity, share of the apexes that serve as lock masses.

    An apex is a bin of the mean spectrum above the one before and not below the one after; it has min_rel of the largest,
    and the part `share` of the pixels has a peak in it or beside it.  ref_mz is the mean m/z, weighted by intensity, of these
    three bins.  Of equal apexes the lower m/z comes first.  Bins are as wide as two bin_ppm; the mean spectrum is a short
    table, which its axis bounds.
    """
    used = peaks.where("pixel_id is not null and mz > 0 and intensity > 0")
    i = F.col("intensity").cast("double")
    cells = scratch(used.groupBy(bucket(F.col("mz"), bin_ppm).alias("bin"), "pixel_id").agg(F.sum(i).alias("s"), F.sum(i * F.col("mz")).alias("sm")), "bins")
    n = cells.agg(F.count_distinct("pixel_id").alias("n"))
    w = Window.partitionBy(F.lit(0)).orderBy("bin").rangeBetween(-1, 1)
    before, after = (Window.partitionBy(F.lit(0)).orderBy("bin").rangeBetween(k, k) for k in (-1, 1))
    mean = cells.groupBy("bin").agg(F.sum("s").alias("s"), F.sum("sm").alias("sm"))
    side = lambda at: F.coalesce(F.sum("s").over(at), F.lit(0.0))
    seen = mean.select("bin", "s", (F.sum("sm").over(w) / F.sum("s").over(w)).alias("ref_mz"), side(before).alias("b"), side(after).alias("a"), F.max("s").over(Window.partitionBy(F.lit(0))).alias("top"))
    apexes = seen.where((F.col("s") > F.col("b")) & (F.col("s") >= F.col("a")) & (F.col("s") >= min_rel * F.col("top"))).select("bin", "ref_mz", (F.col("s") / F.col("top")).alias("rel_intensity"))
    around = apexes.select(F.col("bin").alias("apex"), F.explode(F.array(*[F.col("bin") + k for k in (-1, 0, 1)])).alias("bin"))
    held = around.join(cells.select("bin", "pixel_id"), "bin").select("apex", "pixel_id").distinct().groupBy(F.col("apex").alias("bin")).agg(F.count("*").alias("held"))
    kept = apexes.join(held, "bin").join(F.broadcast(n)).withColumn("share", F.col("held") / F.col("n")).where(F.col("share") >= min_share)
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("rel_intensity"), "bin")
    return kept.withColumn("ref_id", F.row_number().over(order)).where(F.col("ref_id") <= n_refs).select("ref_id", "ref_mz", "rel_intensity", "share")


def _errors(peaks: DataFrame, refs: DataFrame, ppm: float, regions: DataFrame | None) -> DataFrame:
    """pixel_id, region, ref_mz, e: where the strongest peak in a reference's window lies off, as a part.

    refs(ref_mz) may have tol_ppm, and region with regions.  Of peaks as strong the lower m/z counts.
    """
    has = set(refs.columns)
    tol = F.coalesce(F.col("tol_ppm"), F.lit(ppm)) if "tol_ppm" in has else F.lit(ppm)
    named = F.col("region") if regions is not None else F.lit(None).cast("string")
    own = refs.where("ref_mz > 0").select(F.col("ref_mz").cast("double").alias("ref_mz"), tol.cast("double").alias("tol"), named.alias("of")).distinct()
    reach = own.agg(F.max("tol").alias("t")).first()["t"]
    used = peaks.where("pixel_id is not null and mz > 0 and intensity > 0").select("pixel_id", "mz", "intensity")
    if regions is None:
        used = used.withColumn("region", named)
    else:
        served = own.where("of is not null").select(F.col("of").alias("region")).distinct()
        rank = F.col("priority") if "priority" in regions.columns else F.lit(0)
        place = regions.join(served, "region").groupBy("pixel_id").agg(F.min_by("region", F.struct(rank, "region")).alias("region"))
        used = used.join(place, "pixel_id", "left")
    met = window_join(own, used, reach or ppm, "ref_mz", "mz")
    met = met.where(F.abs(F.col("mz") - F.col("ref_mz")) <= F.col("ref_mz") * F.col("tol") / 1e6).where(F.col("of").eqNullSafe(F.col("region")))
    best = met.groupBy("pixel_id", "region", "ref_mz").agg(F.max(F.struct("intensity", (-F.col("mz")).alias("m")))["m"].alias("m"))
    return best.select("pixel_id", "region", "ref_mz", ((-F.col("m") - F.col("ref_mz")) / F.col("ref_mz")).alias("e"))


def spectrum_shifts(peaks: DataFrame, refs: DataFrame, ppm: float = 200.0, regions: DataFrame | None = None) -> DataFrame:
    """pixel_id, n_refs, shift: the median over references of how far a spectrum's strongest peak near each lies off.

    A spectrum without a peak near any reference has no row.  With regions(pixel_id, region[, priority]) each reference
    serves the region it names, and one that names none the pixels of no region that has any; of several regions the one of
    the smallest priority counts, of equal ones the first by name.  refs may hold tol_ppm, a tolerance of their own.
    """
    e = _errors(peaks, refs, ppm, regions)
    return e.groupBy("pixel_id").agg(F.count("*").alias("n_refs"), F.percentile("e", 0.5).alias("shift"))  # as many values as references


def shifted(peaks: DataFrame, shifts: DataFrame) -> DataFrame:
    """peaks with m/z corrected, for centroids; spectra without a shift stay as they are."""
    mz = F.col("mz") / (1 + F.coalesce("shift", F.lit(0.0)))
    return peaks.join(shifts.select("pixel_id", "shift"), "pixel_id", "left").withColumn("mz", mz).select(*[f"`{c}`" for c in peaks.columns])


def resampled(peaks: DataFrame, shifts: DataFrame) -> DataFrame:
    """pixel_id, mz, intensity: each spectrum corrected, then read again at its own m/z by straight lines.

    The axis so stays the one that spectra share.  Outside of what a corrected spectrum covers the intensity is zero; repeated
    m/z of a spectrum are added up, null intensities count as zero.  Points and the places to read lie in one order of a
    spectrum's m/z: two rows a point, no pairs.
    """
    used = peaks.where("pixel_id is not null and mz > 0").select("pixel_id", F.col("mz").cast("double").alias("mz"), F.coalesce(F.col("intensity").cast("double"), F.lit(0.0)).alias("intensity"))
    # what lies in a spectrum lies together: one shuffle for the sums and the windows, whose parts aren't merged again
    one = dealt(used, "pixel_id", rows=used.count()).groupBy("pixel_id", "mz").agg(F.sum("intensity").alias("intensity"))
    own = one.join(shifts.select("pixel_id", "shift"), "pixel_id", "left").withColumn("shift", F.coalesce("shift", F.lit(0.0)))
    none = F.lit(None).cast("double")
    knot = F.struct(F.col("mz").alias("at"), F.lit(0).alias("kind"), F.col("mz").alias("x"), F.col("intensity").alias("v"), none.alias("mz"))
    place = F.struct((F.col("mz") * (1 + F.col("shift"))).alias("at"), F.lit(1).alias("kind"), none.alias("x"), none.alias("v"), F.col("mz").alias("mz"))
    line = own.select("pixel_id", F.explode(F.array(knot, place)).alias("p")).select("pixel_id", "p.*")
    w = Window.partitionBy("pixel_id").orderBy("at", "kind")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    ends = lambda c: (F.last(c, True).over(back).alias(f"{c}0"), F.first(c, True).over(ahead).alias(f"{c}1"))
    read = line.select("pixel_id", "mz", "at", "kind", *ends("x"), *ends("v")).where("kind = 1")
    between = F.col("v0") + (F.col("at") - F.col("x0")) * (F.col("v1") - F.col("v0")) / (F.col("x1") - F.col("x0"))
    value = F.when(F.col("at") == F.col("x0"), F.col("v0")).when(F.col("x0").isNull() | F.col("x1").isNull(), 0.0).otherwise(between)
    return read.select("pixel_id", "mz", value.alias("intensity"))


def self_aligned(peaks: DataFrame, n_refs: int = 3, min_rel: float = 0.05, ppm: float = 100.0, keep_axis: bool = True) -> DataFrame:
    """peaks brought to the lock masses of their own mean spectrum: spectra agree then, absolute errors stay.

    keep_axis reads profiles again on their axis; without it the m/z of centroids move.
    """
    shifts = spectrum_shifts(peaks, lock_masses(peaks, n_refs, min_rel), ppm)
    return resampled(peaks, shifts) if keep_axis else shifted(peaks, shifts)


def calibration_anchors(lipids: DataFrame, mode: str = "negative") -> DataFrame:
    """label, ref_mz of the anchor ions of a mode that lipids(name, neutral_mass) holds."""
    adduct, names = chemistry.CALIBRATION_ANCHORS[mode]
    return lipids.where(F.col("name").isin(names)).select(F.concat("name", F.lit(f" {adduct}")).alias("label"), chemistry.ion_mz(F.col("neutral_mass"), adduct).alias("ref_mz")).distinct()


def region_offsets(peaks: DataFrame, regions: DataFrame, anchors: DataFrame, ppm: float = 30.0) -> DataFrame:
    """region, n, median_ppm, iqr_ppm, max_abs_ppm, slope, factor of each region(pixel_id, region) against anchors(ref_mz).

    An anchor counts with the median error of a region's spectra; a pixel in several regions counts in each.
    """
    e = _errors(peaks, anchors.select("ref_mz"), ppm, None).drop("region").join(regions.select("pixel_id", "region").distinct(), "pixel_id")
    per = e.groupBy("region", "ref_mz").agg((F.percentile("e", 0.5) * 1e6).alias("e"))
    q = lambda p: F.percentile("e", p)
    got = per.groupBy("region").agg(F.count("*").alias("n"), q(0.5).alias("median_ppm"), (q(0.75) - q(0.25)).alias("iqr_ppm"), F.max(F.abs("e")).alias("max_abs_ppm"), F.regr_slope("e", "ref_mz").alias("slope"))
    return got.withColumn("factor", 1 / (1 + F.col("median_ppm") * 1e-6))


def calibrated_regions(peaks: DataFrame, regions: DataFrame, anchors: DataFrame, ppm: float = 30.0) -> tuple[DataFrame, DataFrame]:
    """(region_offsets, peaks corrected on their axis): each region is measured and corrected with its own tolerance.

    A region's windows are three times its largest error and 10 ppm wide; pixels of no region stay as they are.
    """
    found = scratch(region_offsets(peaks, regions, anchors, ppm), "offsets")
    refs = found.select("region", (F.col("max_abs_ppm") * 3 + 10).alias("tol_ppm")).join(F.broadcast(anchors.select("ref_mz")))
    return found, resampled(peaks, spectrum_shifts(peaks, refs, ppm, regions))
