"""Queries on spectra and images."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import spectra as sp
from . import bindings as b
from .registry import query

_STATS = "stats AS (SELECT pixel_id, sum(intensity) AS tic, sqrt(avg(intensity * intensity)) AS rms, quantile_cont(CASE WHEN intensity > 0 THEN intensity END, 0.5) AS median FROM peaks GROUP BY 1)"
_NORM = "norm AS (SELECT pixel_id, greatest(CASE WHEN tic > 0 THEN tic ELSE s END / s, 1 / 3e0) AS f FROM stats, (SELECT avg(CASE WHEN tic > 0 THEN tic END) AS s FROM stats))"
_HITS = "hits AS (SELECT p.pixel_id, t.feature_id, p.intensity FROM peaks p JOIN targets t ON p.mz BETWEEN t.target_mz - t.target_mz * 2000e0 / 1e6 AND t.target_mz + t.target_mz * 2000e0 / 1e6)"


def _window(how: str) -> str:
    return f"""WITH {b.PEAKS}, {b.TARGETS_SQL}, {_HITS}, got AS (SELECT pixel_id, feature_id, {how}(intensity) AS value FROM hits GROUP BY 1, 2)
SELECT p.pixel_id, t.feature_id, round(coalesce(g.value, 0e0), 6) AS value FROM (SELECT DISTINCT pixel_id FROM peaks) p CROSS JOIN targets t LEFT JOIN got g ON g.pixel_id = p.pixel_id AND g.feature_id = t.feature_id"""


def _extracted(spark, sf, how):
    p = b.peaks(spark, sf)
    got = sp.extract_sparse(p, b.targets(spark), 2000.0, how)
    return sp.dense_grid(got, p.select("pixel_id").distinct(), list(range(20)))


@query(f"WITH {b.PEAKS}, {_STATS} SELECT pixel_id, round(tic, 6) AS tic, round(rms, 6) AS rms, round(median, 6) AS median FROM stats")
def tic_stats(spark, sf):
    return b.rounded(sp.pixel_stats(b.peaks(spark, sf)))


@query(f"WITH {b.PEAKS}, {_STATS}, {_NORM} SELECT pixel_id, round(f, 6) AS f FROM norm")
def norm_factors_tic(spark, sf):
    return b.rounded(sp.norm_factors(sp.pixel_stats(b.peaks(spark, sf))))


@query(_window("sum"))
def extract_window_sum(spark, sf):
    return b.rounded(_extracted(spark, sf, "sum"))


@query(_window("max"))
def extract_window_max(spark, sf):
    return b.rounded(_extracted(spark, sf, "max"))


@query(_window("avg"))
def extract_window_mean(spark, sf):
    return b.rounded(_extracted(spark, sf, "mean"))


@query(f"""WITH {b.PEAKS}, {b.TARGETS_SQL}, {_HITS}, {_STATS}, {_NORM}, got AS (SELECT pixel_id, feature_id, sum(intensity) AS value FROM hits GROUP BY 1, 2)
SELECT n.pixel_id, t.feature_id, round(coalesce(g.value, 0e0) / n.f, 6) AS value FROM norm n CROSS JOIN targets t LEFT JOIN got g ON g.pixel_id = n.pixel_id AND g.feature_id = t.feature_id""")
def feature_matrix_tic(spark, sf):
    factors = sp.norm_factors(sp.pixel_stats(b.peaks(spark, sf)))
    return b.rounded(sp.normalised(_extracted(spark, sf, "sum"), factors))


@query(f"""WITH {b.PEAKS}, {b.TARGETS_SQL}, {_STATS}, {_NORM},
hits AS (SELECT p.pixel_id, p.region, t.feature_id, sum(p.intensity) AS v FROM peaks p JOIN targets t ON p.mz BETWEEN t.target_mz - t.target_mz * 2000e0 / 1e6 AND t.target_mz + t.target_mz * 2000e0 / 1e6 GROUP BY ALL),
sizes AS (SELECT region, count(DISTINCT pixel_id) AS n FROM peaks GROUP BY 1)
SELECT h.region, h.feature_id, round(sum(h.v / n.f) / max(s.n), 6) AS mean FROM hits h JOIN norm n USING (pixel_id) JOIN sizes s USING (region) GROUP BY 1, 2""")
def region_contrast(spark, sf):
    """The mean of each target by region, normalised, over all pixels of the region."""
    p = b.peaks(spark, sf)
    factors = sp.norm_factors(sp.pixel_stats(p))
    met = sp.window_join(b.targets(spark), p, 2000.0, "target_mz", "mz").groupBy("pixel_id", "region", "feature_id").agg(F.sum("intensity").alias("v"))
    sizes = p.groupBy("region").agg(F.count_distinct("pixel_id").alias("n"))
    total = met.join(factors, "pixel_id").groupBy("region", "feature_id").agg(F.sum(F.col("v") / F.col("f")).alias("s"))
    return b.rounded(total.join(F.broadcast(sizes), "region").select("region", "feature_id", (F.col("s") / F.col("n")).alias("mean")))


@query(f"WITH {b.DENSE} SELECT feature AS bin, round(sum(v) / (SELECT count(*) FROM embeddings), 6) AS mean FROM dense GROUP BY 1")
def mean_spectrum(spark, sf):
    return b.rounded(sp.mean_spectrum(b.dense(spark, sf).withColumnRenamed("feature", "bin"), b.table(spark, sf, "embeddings")))


@query(f"WITH {b.DENSE} SELECT feature AS bin, round(max(v), 6) AS peak FROM dense GROUP BY 1")
def max_spectrum(spark, sf):
    return b.rounded(sp.max_spectrum(b.dense(spark, sf).withColumnRenamed("feature", "bin")))


@query(f"WITH {b.DENSE}, m AS (SELECT feature AS bin, label, avg(v) AS m FROM dense GROUP BY 1, 2) SELECT a.bin, round(b.m - a.m, 6) AS diff FROM m a JOIN m b ON a.bin = b.bin AND a.label = 0 AND b.label = 1")
def region_mean_diff(spark, sf):
    d = b.dense(spark, sf).where(F.col("label").isin(0, 1))
    of = lambda k: F.avg(F.when(F.col("label") == k, F.col("v")))
    return b.rounded(d.groupBy(F.col("feature").alias("bin")).agg((of(1) - of(0)).alias("diff")))


@query(f"WITH {b.PEAKS} SELECT floor(ln(mz / 200e0) / ln(1 + 500e-6))::INT AS bin, pixel_id, round(sum(intensity), 6) AS value FROM peaks WHERE mz >= 200 AND intensity > 0 GROUP BY 1, 2")
def cube_bins(spark, sf):
    return b.rounded(sp.cube(b.peaks(spark, sf), 200.0, 500.0))


@query(f"WITH {b.PEAKS}, c AS (SELECT floor(ln(mz / 200e0) / ln(1 + 500e-6))::INT AS bin, pixel_id, sum(intensity) AS value FROM peaks WHERE mz >= 200 AND intensity > 0 GROUP BY 1, 2) SELECT pixel_id, round(sum(value) / 101e0, 6) AS value FROM c WHERE bin BETWEEN 100 AND 200 GROUP BY 1")
def cube_ion(spark, sf):
    return b.rounded(sp.cube_ion(sp.cube(b.peaks(spark, sf), 200.0, 500.0), 100, 200, "mean"))


def _features(spark, sf):
    return b.dense(spark, sf).select("pixel_id", F.col("feature").alias("feature_id"), F.col("v").alias("value"))


@query(f"WITH {b.DENSE} SELECT pixel_id, round(sum(v), 6) AS value FROM dense GROUP BY 1")
def composite_raw(spark, sf):
    return b.rounded(sp.composite(_features(spark, sf)))


@query(f"WITH {b.DENSE}, s AS (SELECT feature, quantile_cont(v, 0.99) AS p FROM dense WHERE v > 0 GROUP BY 1) SELECT pixel_id, round(sum(v / p), 6) AS value FROM dense JOIN s USING (feature) GROUP BY 1")
def composite_balanced(spark, sf):
    return b.rounded(sp.composite(_features(spark, sf), "balanced"))


@query(f"WITH {b.DENSE} SELECT pixel_id, round(sum(v) FILTER (feature = 3) / (sum(v) FILTER (feature = 5) + 1e0), 6) AS value FROM dense GROUP BY 1")
def ratio_image(spark, sf):
    return b.rounded(sp.ratio(_features(spark, sf), 3, 5))


@query("""WITH px AS (SELECT DISTINCT l_orderkey AS pixel_id, l_orderkey % 100 AS x, l_orderkey // 100 AS y FROM lineitem), v AS (SELECT l_orderkey AS pixel_id, sum(l_quantity) AS value FROM lineitem GROUP BY 1),
box AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM px), cells AS (SELECT a.y, c.x FROM (SELECT unnest(range(y0, y1 + 1)) AS y FROM box) a, (SELECT unnest(range(x0, x1 + 1)) AS x FROM box) c)
SELECT cells.y, cells.x, round(v.value, 6) AS value FROM cells LEFT JOIN px ON px.x = cells.x AND px.y = cells.y LEFT JOIN v ON v.pixel_id = px.pixel_id""")
def to_image(spark, sf):
    p = b.peaks(spark, sf)
    px = p.select("pixel_id").distinct().select("pixel_id", (F.col("pixel_id") % 100).alias("x"), F.floor(F.col("pixel_id") / 100).alias("y"))
    return b.rounded(sp.image(px, p.groupBy("pixel_id").agg(F.sum("intensity").alias("value"))))


@query("WITH box AS (SELECT max(vec_id // 25) AS y1, min(vec_id // 25) AS y0, min(vec_id % 25) AS x0 FROM embeddings) SELECT vec_id AS pixel_id, y1 - vec_id // 25 AS x, vec_id % 25 - x0 AS y FROM embeddings, box")
def rotate_image(spark, sf):
    return sp.rotated(b.grid(spark, sf), 1)


@query("SELECT 1::BIGINT AS step")
def coordinate_grid_step(spark, sf):
    return sp.grid_step(b.grid(spark, sf))


@query("""WITH p AS (SELECT l_extendedprice AS x, l_quantity AS y FROM lineitem), b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p)
SELECT least(floor((y - y0) / (y1 - y0) * 40), 39)::INT AS row, least(floor((x - x0) / (x1 - x0) * 40), 39)::INT AS col, count(*) AS n FROM p, b GROUP BY 1, 2""")
def raster_counts(spark, sf):
    return sp.raster_counts(b.table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y")), 40)


@query(f"WITH {b.DENSE}, q AS (SELECT feature, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM dense GROUP BY 1) SELECT pixel_id, feature AS feature_id, round(greatest(lo, least(hi, v)), 6) AS value FROM dense JOIN q USING (feature)")
def quantile_clip(spark, sf):
    return b.rounded(sp.quantile_clip(_features(spark, sf), 0.01))


@query(f"""WITH {b.DENSE}, q AS (SELECT feature, quantile_cont(v, 0.99) AS hi FROM dense GROUP BY 1), s AS (SELECT pixel_id, feature, CASE WHEN hi > 0 THEN least(1e0, greatest(0e0, v / hi)) ELSE 0e0 END AS s FROM dense JOIN q USING (feature))
SELECT pixel_id, floor(max(s) FILTER (feature = 1) * 255)::INT AS r, floor(max(s) FILTER (feature = 2) * 255)::INT AS g, floor(max(s) FILTER (feature = 3) * 255)::INT AS b FROM s GROUP BY 1""")
def rgb_overlay(spark, sf):
    return sp.rgb(_features(spark, sf), [1, 2, 3])


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def stream_window_means(spark, sf):
    """The events as a stream, drained."""
    import uuid

    from ..streaming import live

    return b.rounded(live.drain(live.window_means(live.read_events(spark, f"{sf}/events.parquet")), f"windows_{uuid.uuid4().hex}"))


_PEAK = f"WITH {b.DENSE}, m AS (SELECT feature AS bin, avg(v) AS v FROM dense GROUP BY 1), w AS (SELECT bin, v, least(3, floor((bin - min(bin) OVER ()) / (max(bin) OVER () - min(bin) OVER () + 1) * 4)) AS part, max(v) OVER () AS top, v > coalesce(lag(v) OVER (ORDER BY bin), 0) AND v >= coalesce(lead(v) OVER (ORDER BY bin), 0) AS p FROM m), md AS (SELECT part, quantile_cont(v, 0.5) AS md FROM w GROUP BY 1), n AS (SELECT part, quantile_cont(abs(v - md), 0.5) * 1.4826 AS noise FROM w JOIN md USING (part) GROUP BY 1)"


@query(f"{_PEAK} SELECT bin, round(v, 6) AS intensity, round(v / top, 6) AS rel_intensity, round(v / noise, 5) AS snr, (row_number() OVER (ORDER BY v DESC, bin))::INT AS rank FROM w JOIN n USING (part) WHERE p AND v / noise >= 3")
def pick_peaks(spark, sf):
    from ..operators import intake

    m = sp.mean_spectrum(b.dense(spark, sf).withColumnRenamed("feature", "bin"), b.table(spark, sf, "embeddings")).withColumnRenamed("mean", "v")
    return b.rounded(intake.pick_peaks(m, 3.0, noise_windows=4).withColumn("snr", F.round("snr", 5)))


@query(f"""{_PEAK}, h AS (SELECT bin, v, top, noise FROM w JOIN n USING (part)), k AS (SELECT a.bin, a.v, any_value(a.top) AS top, any_value(a.noise) AS noise, coalesce(max(c.bin) FILTER (c.bin < a.bin AND c.v > a.v), -1) AS l, coalesce(min(c.bin) FILTER (c.bin > a.bin AND c.v > a.v), 1000000) AS r, bool_and(a.v > c.v) FILTER (abs(c.bin - a.bin) = 1) AND count(*) FILTER (abs(c.bin - a.bin) = 1) = 2 AS p FROM h a, h c GROUP BY 1, 2),
q AS (SELECT k.bin, k.v, any_value(k.top) AS top, any_value(k.noise) AS noise, k.v - greatest(min(c.v) FILTER (c.bin BETWEEN k.l + 1 AND k.bin), min(c.v) FILTER (c.bin BETWEEN k.bin AND k.r - 1)) AS size FROM k, h c WHERE k.p GROUP BY 1, 2)
SELECT bin::BIGINT AS bin, round(v, 6) AS intensity, round(v / top, 6) AS rel_intensity, round(v / noise, 5) AS snr, round(size, 6) AS prominence, (row_number() OVER (ORDER BY v DESC, bin))::INT AS rank FROM q WHERE v >= noise AND size >= 0.5 * noise""")
def pick_profile_peaks(spark, sf):
    from ..operators import intake

    m = sp.mean_spectrum(b.dense(spark, sf).withColumnRenamed("feature", "bin"), b.table(spark, sf, "embeddings")).withColumnRenamed("mean", "v")
    got = intake.pick_profile(m, 1.0, prominence=0.5, distance=1, noise_windows=4)
    return b.rounded(got.withColumn("snr", F.round("snr", 5)))


@query(f"WITH {b.PEAKS}, a AS (SELECT pixel_id, arg_max(mz, intensity * 1e9 - mz) AS m FROM peaks WHERE mz BETWEEN 300 - 300 * 5000e0 / 1e6 AND 300 + 300 * 5000e0 / 1e6 AND intensity > 0 GROUP BY 1), e AS (SELECT (m - 300) / 300 * 1e6 AS p FROM a) SELECT count(*) AS n, round(quantile_cont(p, 0.5), 6) AS median, round(quantile_cont(p, 0.75) - quantile_cont(p, 0.25), 6) AS iqr, round(max(abs(p)), 6) AS max_abs, round(sqrt(avg(p * p)), 5) AS rms FROM e")
def drift_qc(spark, sf):
    from ..operators import intake

    return b.rounded(intake.drift(b.peaks(spark, sf), 300.0, 5000.0).withColumn("rms", F.round("rms", 5)))


@query(f"WITH {b.PEAKS}, {b.TARGETS_SQL}, a AS (SELECT pixel_id, feature_id, target_mz, arg_max(mz, intensity * 1e9 - mz) AS m FROM peaks JOIN targets ON mz BETWEEN target_mz - target_mz * 2000e0 / 1e6 AND target_mz + target_mz * 2000e0 / 1e6 WHERE intensity > 0 GROUP BY ALL), e AS (SELECT feature_id, target_mz, quantile_cont((m - target_mz) / target_mz * 1e6, 0.5) AS e FROM a GROUP BY 1, 2) SELECT count(*) AS n, round(quantile_cont(e, 0.5), 6) AS median, round(regr_slope(e, target_mz), 6) AS slope, round(1 / (1 + quantile_cont(e, 0.5) * 1e-6), 9) AS factor FROM e")
def calibration_offset(spark, sf):
    from ..operators import intake

    refs = b.targets(spark).select(F.col("feature_id").alias("ref_id"), F.col("target_mz").alias("ref_mz"))
    return intake.calibration(b.peaks(spark, sf), refs, 2000.0).select("n", F.round("median", 6).alias("median"), F.round("slope", 6).alias("slope"), F.round("factor", 9).alias("factor"))


@query(f"WITH {b.PEAKS}, {_STATS} SELECT round(stddev_pop(tic) / avg(tic), 6) AS tic_cv, round(stddev_pop(rms) / avg(rms), 6) AS rms_cv, CASE WHEN stddev_pop(tic) / avg(tic) <= 0.05 THEN 'tic' WHEN stddev_pop(rms) / avg(rms) <= 0.05 THEN 'rms' ELSE 'none' END AS method FROM stats")
def detect_normalisation(spark, sf):
    from ..operators import intake

    return b.rounded(intake.normalisation(sp.pixel_stats(b.peaks(spark, sf))))


@query(f"WITH {b.DENSE}, n AS (SELECT pixel_id, sqrt(sum(v * v)) AS n FROM dense GROUP BY 1) SELECT pixel_id, feature, round(v / n, 6) AS v FROM dense JOIN n USING (pixel_id)")
def normalise_vectors(spark, sf):
    from ..functions import arrays

    e = b.table(spark, sf, "embeddings").select(F.col("vec_id").alias("pixel_id"), F.transform("embedding", lambda x: F.abs(x).cast("double")).alias("i"))
    return b.rounded(e.select("pixel_id", F.posexplode(arrays.l2(F.col("i"))).alias("feature", "v")))


@query(f"WITH {b.DENSE}, m AS (SELECT label, feature, avg(v) AS v FROM dense GROUP BY 1, 2), n AS (SELECT pixel_id, sqrt(sum(v * v)) AS n FROM dense GROUP BY 1), k AS (SELECT label, sqrt(sum(v * v)) AS n FROM m GROUP BY 1) SELECT d.pixel_id AS a_id, m.label AS b_id, round(sum(d.v * m.v) / (max(n.n) * max(k.n)), 6) AS cosine FROM dense d JOIN m USING (feature) JOIN n ON n.pixel_id = d.pixel_id JOIN k ON k.label = m.label GROUP BY 1, 2")
def spectral_cosine(spark, sf):
    from ..operators import library

    d = b.dense(spark, sf)
    a = d.select(F.col("pixel_id").alias("id"), F.col("feature").alias("bin"), "v")
    m = d.groupBy(F.col("label").alias("id"), F.col("feature").alias("bin")).agg(F.avg("v").alias("v"))
    return b.rounded(library.aligned_cosine(a, m))


def _spectra(spark, sf):
    e = b.table(spark, sf, "embeddings")
    mz = F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda k: 100.0 + k * 2.5)
    return e.select("vec_id", "label", (300 + F.col("label") * 10.0).alias("precursor"), mz.alias("mz"), F.transform("embedding", lambda x: F.abs(x).cast("double")).alias("intensity"))


@query()
def library_search(spark, sf):
    """Every spectrum against the mean spectrum of each label near its precursor."""
    from ..operators import library

    s = _spectra(spark, sf)
    lib = s.select("label", "precursor", F.posexplode("intensity").alias("k", "i")).groupBy("label", "precursor", "k").agg(F.avg("i").alias("i")).groupBy("label", "precursor").agg(F.array_sort(F.collect_list(F.struct("k", "i"))).alias("p"))
    lib = lib.select(F.concat(F.lit("label "), F.col("label").cast("string")).alias("name"), "precursor", F.transform("p", lambda p: 100.0 + p["k"] * 2.5).alias("mz"), F.transform("p", lambda p: p["i"]).alias("intensity"))
    return b.rounded(library.search(s.select(F.col("vec_id").alias("query_id"), "precursor", "mz", "intensity"), lib))


def _preprocessed(spark, sf, *steps):
    from ..functions import arrays

    s = _spectra(spark, sf)
    return b.rounded(s.select(F.col("vec_id").alias("pixel_id"), F.posexplode(arrays.pipeline(F.col("intensity"), list(steps))).alias("bin", "v")))


@query()
def preprocess_snip(spark, sf):
    return _preprocessed(spark, sf, {"name": "snip", "iterations": 10}, {"name": "l2"})


@query()
def preprocess_savgol(spark, sf):
    return _preprocessed(spark, sf, {"name": "hull"}, {"name": "savgol", "window": 7})


@query()
def preprocess_baseline(spark, sf):
    return _preprocessed(spark, sf, {"name": "locmin", "window": 10}, {"name": "gaussian", "sigma": 1.0})


@query(f"WITH {b.PEAKS} SELECT sample, count(*) AS n_peaks, min(mz) AS mz_lo, max(mz) AS mz_hi FROM peaks GROUP BY 1")
def mz_bounds(spark, sf):
    return sp.mz_bounds(b.peaks(spark, sf), "sample")
