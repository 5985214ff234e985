"""Queries on the self-alignment of masses; the status of an order is the region of a pixel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alignment as al
from . import bindings as b
from .registry import query


def _refs(spark):
    return b.targets(spark).select(F.col("feature_id").alias("ref_id"), F.col("target_mz").alias("ref_mz"))


def _regions(spark, sf):
    return b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("pixel_id"), F.col("o_orderstatus").alias("region"))


_NEAR = "mz BETWEEN target_mz - target_mz * {0}e0 / 1e6 AND target_mz + target_mz * {0}e0 / 1e6"
_ERRORS = f"e AS MATERIALIZED (SELECT pixel_id, target_mz, (arg_max(mz, intensity * 1e9 - mz) - target_mz) / target_mz AS e FROM peaks JOIN targets ON {_NEAR.format(2000)} WHERE intensity > 0 GROUP BY 1, 2)"
_SHIFTS = f"{_ERRORS}, s AS MATERIALIZED (SELECT pixel_id, count(*) AS n_refs, quantile_cont(e, 0.5) AS shift FROM e GROUP BY 1)"


@query(f"""WITH {b.PEAKS}, c AS MATERIALIZED (SELECT floor(ln(mz) / ln(1.002e0))::BIGINT AS bin, pixel_id, sum(intensity::DOUBLE) AS s, sum(intensity::DOUBLE * mz) AS sm FROM peaks WHERE intensity > 0 GROUP BY 1, 2),
m AS MATERIALIZED (SELECT bin, sum(s) AS s, sum(sm) AS sm FROM c GROUP BY 1),
a AS MATERIALIZED (
  SELECT m.bin, m.s, (m.sm + coalesce(l.sm, 0) + coalesce(r.sm, 0)) / (m.s + coalesce(l.s, 0) + coalesce(r.s, 0)) AS ref_mz FROM m LEFT JOIN m l ON l.bin = m.bin - 1 LEFT JOIN m r ON r.bin = m.bin + 1
  WHERE m.s > coalesce(l.s, 0) AND m.s >= coalesce(r.s, 0) AND m.s >= 0.05 * (SELECT max(s) FROM m)),
h AS (SELECT a.bin, a.s, a.ref_mz, count(DISTINCT pixel_id) / (SELECT count(DISTINCT pixel_id) FROM c) AS share FROM a JOIN c ON c.bin IN (a.bin - 1, a.bin, a.bin + 1) GROUP BY ALL)
SELECT row_number() OVER (ORDER BY s DESC, bin)::INT AS ref_id, round(ref_mz, 6) AS ref_mz, round(s / (SELECT max(s) FROM m), 6) AS rel_intensity, round(share, 6) AS share FROM h QUALIFY ref_id <= 50""")
def lock_masses(spark, sf):
    """The fifty strongest apexes, however many pixels hold them."""
    return b.rounded(al.lock_masses(b.peaks(spark, sf), 50, 0.05, 0.0, 1000.0))


@query(f"WITH {b.PEAKS}, {b.TARGETS_SQL}, {_SHIFTS} SELECT pixel_id, n_refs, round(shift * 1e6, 4) AS shift_ppm FROM s")
def spectrum_shifts(spark, sf):
    return al.spectrum_shifts(b.peaks(spark, sf), _refs(spark), 2000.0).select("pixel_id", "n_refs", F.round(F.col("shift") * 1e6, 4).alias("shift_ppm"))


@query(f"""WITH {b.PEAKS}, {b.TARGETS_SQL}, w AS (SELECT feature_id, target_mz, unnest(['F', 'O', 'P']) AS region FROM targets),
e AS (SELECT pixel_id, target_mz, (arg_max(mz, intensity * 1e9 - mz) - target_mz) / target_mz AS e FROM peaks JOIN orders ON o_orderkey = pixel_id JOIN w ON w.region = o_orderstatus
  AND CASE w.region WHEN 'F' THEN feature_id % 2 = 0 AND {_NEAR.format(2000)} WHEN 'O' THEN feature_id % 2 = 1 AND {_NEAR.format(1000)} ELSE {_NEAR.format(2000)} END WHERE intensity > 0 GROUP BY 1, 2)
SELECT pixel_id, count(*) AS n_refs, round(quantile_cont(e, 0.5) * 1e6, 4) AS shift_ppm FROM e GROUP BY 1""")
def region_shifts(spark, sf):
    """Region F has the even references, O the odd ones with half the tolerance, pixels of neither have all."""
    r = _refs(spark)
    part = lambda region, of, tol: of.select("ref_mz", F.lit(region).cast("string").alias("region"), F.lit(tol).alias("tol_ppm"))
    refs = part("F", r.where("ref_id % 2 = 0"), 2000.0).unionByName(part("O", r.where("ref_id % 2 = 1"), 1000.0)).unionByName(part(None, r, 2000.0))
    return al.spectrum_shifts(b.peaks(spark, sf), refs, 2000.0, _regions(spark, sf)).select("pixel_id", "n_refs", F.round(F.col("shift") * 1e6, 4).alias("shift_ppm"))


@query(f"""WITH {b.PEAKS}, {b.TARGETS_SQL}, {_SHIFTS},
p AS MATERIALIZED (SELECT pixel_id, mz, sum(intensity::DOUBLE) AS v, mz * (1 + coalesce(any_value(shift), 0)) AS place FROM peaks LEFT JOIN s USING (pixel_id) GROUP BY 1, 2),
lo AS (SELECT a.pixel_id, a.mz, max(k.mz) AS x0, arg_max(k.v, k.mz) AS v0 FROM p a JOIN p k ON k.pixel_id = a.pixel_id AND k.mz <= a.place GROUP BY 1, 2),
hi AS (SELECT a.pixel_id, a.mz, min(k.mz) AS x1, arg_min(k.v, k.mz) AS v1 FROM p a JOIN p k ON k.pixel_id = a.pixel_id AND k.mz >= a.place GROUP BY 1, 2)
SELECT pixel_id, mz, round(CASE WHEN place = x0 THEN v0 WHEN x0 IS NULL OR x1 IS NULL THEN 0 ELSE v0 + (place - x0) * (v1 - v0) / (x1 - x0) END, 5) AS intensity
FROM p LEFT JOIN lo USING (pixel_id, mz) LEFT JOIN hi USING (pixel_id, mz)""")
def resampled_spectra(spark, sf):
    p = b.peaks(spark, sf)
    return b.rounded(al.resampled(p, al.spectrum_shifts(p, _refs(spark), 2000.0)), 5)


@query(f"""WITH {b.PEAKS}, {b.TARGETS_SQL}, {_ERRORS}, per AS (SELECT o_orderstatus AS region, target_mz, quantile_cont(e, 0.5) * 1e6 AS e FROM e JOIN orders ON o_orderkey = pixel_id GROUP BY 1, 2)
SELECT region, count(*) AS n, round(quantile_cont(e, 0.5), 4) AS median_ppm, round(quantile_cont(e, 0.75) - quantile_cont(e, 0.25), 4) AS iqr_ppm, round(max(abs(e)), 4) AS max_abs_ppm, round(regr_slope(e, target_mz), 4) AS slope,
round(1 / (1 + quantile_cont(e, 0.5) * 1e-6), 4) AS factor FROM per GROUP BY 1""")
def region_offsets(spark, sf):
    return b.rounded(al.region_offsets(b.peaks(spark, sf), _regions(spark, sf), _refs(spark), 2000.0), 4)
