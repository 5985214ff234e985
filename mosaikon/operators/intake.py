"""What a dataset is: peaks of a mean spectrum, normalisation, drift and calibration."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import window_join
from .spectra import mz_bounds, pixel_stats


def pick_peaks(spectrum: DataFrame, snr: float = 3.0, min_rel: float = 0.0, max_peaks: int = 0, noise_windows: int = 32) -> DataFrame:
    """bin, intensity, rel_intensity, snr of the local maxima of spectrum(bin, v), the strongest first in rank.

    Noise is 1.4826 times the median distance from the median of the positive values of each of equal windows;
    windows without any take the median of the others.  A spectrum is one short table: its axis bounds it.
    """
    w = Window.partitionBy(F.lit(0)).orderBy("bin")
    noisy = _noise(spectrum, noise_windows)
    peak = (F.col("v") > F.coalesce(F.lag("v").over(w), F.lit(0.0))) & (F.col("v") >= F.coalesce(F.lead("v").over(w), F.lit(0.0)))
    found = noisy.withColumn("__p", peak).where("__p").select("bin", F.col("v").alias("intensity"), (F.col("v") / F.col("top")).alias("rel_intensity"), F.when(F.col("noise") > 0, F.col("v") / F.col("noise")).alias("snr"))
    kept = found.where((F.col("snr").isNull() | (F.col("snr") >= snr)) & (F.col("rel_intensity") >= min_rel))
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("intensity"), "bin")))
    return ranked.where(F.col("rank") <= max_peaks) if max_peaks else ranked


def _noise(spectrum: DataFrame, noise_windows: int) -> DataFrame:
    """spectrum with top, the largest value, and the noise of its window."""
    size = spectrum.agg(F.max("bin").alias("hi"), F.min("bin").alias("lo"), F.max("v").alias("top"))
    own = spectrum.join(F.broadcast(size)).withColumn("part", F.least(F.lit(noise_windows - 1), F.floor((F.col("bin") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1) * noise_windows)))
    med = own.where("v > 0").groupBy("part").agg(F.percentile("v", 0.5).alias("med"))
    mad = own.where("v > 0").join(F.broadcast(med), "part").groupBy("part").agg((F.percentile(F.abs(F.col("v") - F.col("med")), 0.5) * 1.4826).alias("noise"))
    usual = mad.agg(F.percentile("noise", 0.5).alias("usual"))
    return own.join(F.broadcast(mad), "part", "left").join(F.broadcast(usual)).withColumn("noise", F.coalesce("noise", "usual"))


def summits(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where v has a maximum with lower values on both sides (of a flat top, the middle), and how far each stands out.

    The prominence is the height over the higher of the two lowest points between it and the next larger value on each
    side, or the end.  A stack of falling values gives those lowest points in one walk each way.
    """
    edges = np.flatnonzero(np.diff(v)) + 1
    first, last = np.r_[0, edges], np.r_[edges, len(v)] - 1
    h = v[first]
    top = np.flatnonzero((h[1:-1] > h[:-2]) & (h[1:-1] > h[2:])) + 1

    def lowest(h: np.ndarray) -> np.ndarray:
        out, stack = h.copy(), []
        for k, x in enumerate(h):
            low = x
            while stack and stack[-1][0] <= x:
                low = min(low, stack.pop()[1])
            out[k] = low
            stack.append((x, low))
        return out

    floor = np.maximum(lowest(h), lowest(h[::-1])[::-1])
    return (first[top] + last[top]) // 2, (h - floor)[top]


def apart(at: np.ndarray, height: np.ndarray, distance: int) -> np.ndarray:
    """Which peaks stay when each, from the highest down, drops those nearer than distance; of equals the later stays."""
    keep = np.ones(len(at), bool)
    for k in np.argsort(height, kind="stable")[::-1]:
        if keep[k]:
            keep[(np.abs(at - at[k]) < distance) & (np.arange(len(at)) != k)] = False
    return keep


def pick_profile(spectrum: DataFrame, snr: float = 3.0, min_rel: float = 0.0, max_peaks: int = 0, prominence: float = 1.0, distance: int = 3, noise_windows: int = 32) -> DataFrame:
    """bin, intensity, rel_intensity, snr, prominence, rank of the peaks of a profile spectrum(bin, v).

    Peaks are as high as snr times the local noise and min_rel of the tallest, at least `distance` points from any
    higher one, and stand out by prominence times the noise (0 asks for nothing).  One spectrum is one task: it has as
    many points as the axis, whatever the number of pixels.
    """
    def find(t: pa.Table) -> pa.Table:
        t = t.sort_by("bin")
        v, noise = (np.nan_to_num(t[c].to_numpy().astype(float)) for c in ("v", "noise"))
        at, size = summits(v) if len(v) else (np.zeros(0, int), np.zeros(0))
        tall = v[at] >= np.maximum(np.maximum(snr * noise[at], min_rel * v.max(initial=0)), 1e-12)
        at, size = at[tall], size[tall]
        near = apart(at, v[at], distance)
        at, size = at[near], size[near]
        fine = size >= np.maximum(prominence * noise[at], 1e-12) if prominence > 0 else np.ones(len(at), bool)
        at, size = at[fine], size[fine]
        rank = np.empty(len(at), np.int32)
        rank[np.lexsort((at, -v[at]))] = np.arange(1, len(at) + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = v[at] / noise[at]
        ratio = pa.array(ratio, mask=~(noise[at] > 0))
        return pa.table({"bin": t["bin"].take(pa.array(at)).cast(pa.int64()), "intensity": v[at], "rel_intensity": v[at] / v.max(initial=1e-300), "snr": ratio, "prominence": size, "rank": rank})

    got = _noise(spectrum, noise_windows).select("bin", F.col("v").cast("double").alias("v"), "noise", F.lit(0).alias("one")).groupBy("one").applyInArrow(find, "bin long, intensity double, rel_intensity double, snr double, prominence double, rank int")
    return got.where(F.col("rank") <= max_peaks) if max_peaks else got


def normalisation(stats: DataFrame, limit: float = 0.05) -> DataFrame:
    """tic_cv, rms_cv and which of them, if any, was evened out before."""
    cv = lambda c: F.stddev_pop(c) / F.avg(c)
    got = stats.agg(cv("tic").alias("tic_cv"), cv("rms").alias("rms_cv"))
    return got.withColumn("method", F.when(F.col("tic_cv") <= limit, "tic").when(F.col("rms_cv") <= limit, "rms").otherwise("none"))


def apex(peaks: DataFrame, refs: DataFrame, ppm: float) -> DataFrame:
    """pixel_id, ref_id, ppm: error of the strongest positive peak near each of refs(ref_id, ref_mz)."""
    met = window_join(refs, peaks.where("intensity > 0"), ppm, "ref_mz", "mz")
    best = met.groupBy("pixel_id", "ref_id", "ref_mz").agg(F.max(F.struct("intensity", (-F.col("mz")).alias("m")))["m"].alias("m"))
    return best.select("pixel_id", "ref_id", "ref_mz", ((-F.col("m") - F.col("ref_mz")) / F.col("ref_mz") * 1e6).alias("ppm"))


def drift(peaks: DataFrame, ref_mz: float, ppm: float = 50.0) -> DataFrame:
    """n, median, iqr, max_abs, rms of the error over pixels at one m/z."""
    refs = peaks.sparkSession.range(1).select(F.lit(0).alias("ref_id"), F.lit(ref_mz).alias("ref_mz"))
    p = F.col("ppm")
    return apex(peaks, refs, ppm).agg(F.count("*").alias("n"), F.percentile(p, 0.5).alias("median"), (F.percentile(p, 0.75) - F.percentile(p, 0.25)).alias("iqr"), F.max(F.abs(p)).alias("max_abs"), F.sqrt(F.avg(p * p)).alias("rms"))


def calibration(peaks: DataFrame, refs: DataFrame, ppm: float = 30.0) -> DataFrame:
    """n, median, slope (ppm for each m/z) and factor over anchors(ref_id, ref_mz)."""
    per = apex(peaks, refs, ppm).groupBy("ref_id", "ref_mz").agg(F.percentile("ppm", 0.5).alias("e"))
    got = per.agg(F.count("*").alias("n"), F.percentile("e", 0.5).alias("median"), F.regr_slope("e", "ref_mz").alias("slope"))
    return got.withColumn("factor", 1 / (1 + F.col("median") * 1e-6))


def fwhm_ppm(spectrum: DataFrame, targets: DataFrame, reach: int = 50) -> DataFrame:
    """target bin, fwhm_ppm of spectrum(bin, mz, v) around targets(target): where it falls under half, by line."""
    t = targets.join(spectrum.select(F.col("bin").alias("target"), F.col("mz").alias("m0"), F.col("v").alias("v0")), "target")
    near = t.select("target", "m0", "v0", F.explode(F.sequence(F.col("target") - reach, F.col("target") + reach)).alias("bin")).join(spectrum, "bin")
    w = Window.partitionBy("target").orderBy("bin")
    side = near.withColumns({"pm": F.lag("mz").over(w), "pv": F.lag("v").over(w)})
    half = F.col("v0") / 2
    cross = F.col("pm") + (half - F.col("pv")) * (F.col("mz") - F.col("pm")) / (F.col("v") - F.col("pv"))
    up = F.when((F.col("bin") <= F.col("target")) & (F.col("pv") < half) & (F.col("v") >= half), cross)
    down = F.when((F.col("bin") > F.col("target")) & (F.col("pv") >= half) & (F.col("v") < half), cross)
    return side.groupBy("target", "m0").agg(F.max(up).alias("l"), F.min(down).alias("r")).select("target", ((F.col("r") - F.col("l")) / F.col("m0") * 1e6).alias("fwhm_ppm"))


#: A profile peak spans two samples or more, and a profile axis has steps of at most 30 ppm.
PROFILE_RUN, PROFILE_GAP_PPM = 2.0, 30.0


def representation(spectra: DataFrame, flag: str | None = None) -> DataFrame:
    """label (profile, centroid or unknown), source, n_votes, profile_fraction of spectra(pixel_id, mz, intensity arrays).

    A spectrum of 8 points, 4 of them positive, votes.  Where a fifth of its points are zero or less, the mean length of
    runs of positive ones decides; else the median step between their m/z does, if there are 8.  Data win over a file's
    flag; where half or more say profile it is profile.  All spectra vote, and null arrays don't.
    """
    i, m = F.col("intensity"), F.col("mz")
    n = F.size(i)
    some = F.size(F.filter(i, lambda v: v > 0))
    runs = F.size(F.filter(i, lambda v, k: (v > 0) & ((k == 0) | ~F.coalesce(F.get(i, k - 1) > 0, F.lit(False)))))
    points = F.array_sort(F.transform(F.filter(F.arrays_zip(m.alias("m"), i.alias("i")), lambda p: (p["i"] > 0) & (p["m"] > 0)), lambda p: p["m"]))
    per = spectra.where(i.isNotNull() & m.isNotNull()).select(n.alias("n"), some.alias("some"), runs.alias("runs"), points.alias("p"))
    steps = F.array_sort(F.transform(F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, F.lit(0))), lambda v, k: (v - F.get("p", k)) / F.get("p", k) * 1e6))
    per = per.withColumn("g", F.when(F.size("p") >= 8, steps)).withColumn("h", F.size("g"))
    middle = (F.get("g", F.floor((F.col("h") - 1) / 2).cast("int")) + F.get("g", F.floor(F.col("h") / 2).cast("int"))) / 2
    zeros = 1 - F.col("some") / F.col("n") >= 0.2
    vote = F.when((F.col("n") < 8) | (F.col("some") < 4), None).when(zeros, (F.col("some") / F.col("runs") >= PROFILE_RUN).cast("int")).when(F.size("p") >= 8, (middle <= PROFILE_GAP_PPM).cast("int"))
    got = per.select(vote.alias("vote")).agg(F.count("vote").alias("n_votes"), F.avg("vote").alias("profile_fraction"))
    data = F.when(F.col("n_votes") == 0, None).when(F.col("profile_fraction") >= 0.5, "profile").otherwise("centroid")
    said = F.lit(flag.strip().lower() if flag and flag.strip().lower() in ("profile", "centroid") else None).cast("string")
    source = (
        F.when(data.isNull() & said.isNull(), "undetermined").when(data.isNull(), "file flag").when(said.isNull(), "data heuristic")
        .when(said == data, "file flag (confirmed by data)").otherwise(F.concat(F.lit("data heuristic (file flag said "), said, F.lit(")")))
    )
    return got.select(F.coalesce(data, said, F.lit("unknown")).alias("label"), source.alias("source"), "n_votes", "profile_fraction")


def inspect(peaks: DataFrame, flag: str | None = None) -> DataFrame:
    """One row on a dataset peaks(pixel_id, mz, intensity): n_pixels, limits, what it holds and what to do with it.

    representation and its source, normalisation found, suggested_norm (none for data that are evened out already) and
    suggested_pick (centroids or mean-spectrum).
    """
    spectra = peaks.groupBy("pixel_id").agg(F.array_sort(F.collect_list(F.struct("mz", "intensity"))).alias("p")).select("pixel_id", F.col("p.mz").alias("mz"), F.col("p.intensity").alias("intensity"))
    kind = representation(spectra, flag).select(F.col("label").alias("representation"), "source")
    stats = pixel_stats(peaks)
    state = normalisation(stats).select(F.col("method").alias("normalisation"))
    each = [stats.agg(F.count("*").alias("n_pixels")), mz_bounds(peaks).select("mz_lo", "mz_hi"), kind, state]  # one row each
    one = each[0]
    for t in each[1:]:
        one = one.join(F.broadcast(t))
    done = F.col("normalisation") != "none"
    return one.withColumns({"suggested_norm": F.when(done, "none").otherwise("tic"), "suggested_pick": F.when(F.col("representation") == "centroid", "centroids").otherwise("mean-spectrum")})
