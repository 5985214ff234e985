"""Queries on stacks of sections: each of the 64 features is a section, the grid of pixels its image."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import registration as rg
from . import bindings as b
from .registry import query


def _sections(spark, sf):
    return b.grid(spark, sf).join(b.dense(spark, sf), "pixel_id").select(F.col("feature").alias("z"), "y", "x", "v")


#: The two transforms as plain sums, a join for each axis and direction.
_SHIFTS = f"""
{b.DENSE}, {b.GRID}, pix AS MATERIALIZED (SELECT feature::BIGINT AS z, y, x, v FROM grid JOIN dense USING (pixel_id)),
size AS MATERIALIZED (SELECT min(y) AS y0, min(x) AS x0, max(y) - min(y) + 1 AS h, max(x) - min(x) + 1 AS w FROM pix),
ys AS (SELECT unnest(range(h)) AS y FROM size), xs AS (SELECT unnest(range(w)) AS x FROM size), zs AS (SELECT z, sum(v) / (SELECT h * w FROM size) AS m FROM pix GROUP BY z),
img AS MATERIALIZED (
  SELECT zs.z, ys.y, xs.x, (coalesce(v, 0) - m) * (0.5 - 0.5 * cos(2 * pi() * ys.y / (h - 1))) * (0.5 - 0.5 * cos(2 * pi() * xs.x / (w - 1))) AS v
  FROM zs CROSS JOIN ys CROSS JOIN xs CROSS JOIN size LEFT JOIN pix ON pix.z = zs.z AND pix.y = ys.y + y0 AND pix.x = xs.x + x0),
f1 AS MATERIALIZED (SELECT z, img.y, k.x AS k, sum(v * cos(2 * pi() * k.x * img.x / w)) AS re, -sum(v * sin(2 * pi() * k.x * img.x / w)) AS im FROM img, xs k, size GROUP BY 1, 2, 3),
f2 AS MATERIALIZED (
  SELECT z, l.y AS l, k, sum(re * cos(2 * pi() * l.y * f1.y / h) + im * sin(2 * pi() * l.y * f1.y / h)) AS re, sum(im * cos(2 * pi() * l.y * f1.y / h) - re * sin(2 * pi() * l.y * f1.y / h)) AS im
  FROM f1, ys l, size GROUP BY 1, 2, 3),
c AS (SELECT a.z, l, k, a.re * o.re + a.im * o.im AS re, a.im * o.re - a.re * o.im AS im FROM f2 a JOIN f2 o USING (l, k) WHERE o.z = a.z - 1),
p AS MATERIALIZED (SELECT z, l, k, re / sqrt(re * re + im * im) AS re, im / sqrt(re * re + im * im) AS im FROM c),
g AS MATERIALIZED (
  SELECT z, ys.y, k, sum(re * cos(2 * pi() * l * ys.y / h) - im * sin(2 * pi() * l * ys.y / h)) / any_value(h) AS re, sum(im * cos(2 * pi() * l * ys.y / h) + re * sin(2 * pi() * l * ys.y / h)) / any_value(h) AS im
  FROM p, ys, size GROUP BY 1, 2, 3),
r AS MATERIALIZED (SELECT z, g.y, xs.x, sum(re * cos(2 * pi() * k * xs.x / w) - im * sin(2 * pi() * k * xs.x / w)) / any_value(w) AS r FROM g, xs, size GROUP BY 1, 2, 3),
top AS MATERIALIZED (SELECT z, y, x, r FROM (SELECT *, row_number() OVER (PARTITION BY z ORDER BY r DESC, y, x) AS n FROM r) WHERE n = 1),
fine AS (
  SELECT top.z, top.r AS peak, h, w, top.y + 0.5 * (u.r - d.r) / (u.r - 2 * top.r + d.r) AS py, top.x + 0.5 * (a.r - e.r) / (a.r - 2 * top.r + e.r) AS px
  FROM top, size, r u, r d, r a, r e
  WHERE u.z = top.z AND d.z = top.z AND a.z = top.z AND e.z = top.z AND u.x = top.x AND d.x = top.x AND a.y = top.y AND e.y = top.y
  AND u.y = (top.y + h - 1) % h AND d.y = (top.y + 1) % h AND a.x = (top.x + w - 1) % w AND e.x = (top.x + 1) % w),
one AS (SELECT z, z - 1 AS fixed, CASE WHEN py > h / 2 THEN h - py ELSE -py END AS dy, CASE WHEN px > w / 2 THEN w - px ELSE -px END AS dx, peak FROM fine
        UNION ALL SELECT min(z), NULL, 0, 0, NULL FROM zs),
shifts AS MATERIALIZED (SELECT *, sum(dy) OVER (ORDER BY z) AS ty, sum(dx) OVER (ORDER BY z) AS tx FROM one)"""


@query(f"WITH {_SHIFTS} SELECT z, fixed, round(dy, 5) AS dy, round(dx, 5) AS dx, round(peak, 5) AS peak, round(ty, 5) AS ty, round(tx, 5) AS tx FROM shifts")
def registered_stack(spark, sf):
    """Each section to the one before it, and to the first."""
    return b.rounded(rg.register_stack(_sections(spark, sf)).drop("matrix"), 5)


@query(f"""WITH {_SHIFTS}, s AS (SELECT z, round(dy, 9) AS ty, round(dx, 9) AS tx FROM shifts),
spread AS (SELECT z, y + floor(ty)::BIGINT + i AS y, x + floor(tx)::BIGINT + k AS x, v, abs(1 - i - (ty - floor(ty))) * abs(1 - k - (tx - floor(tx))) AS weight
           FROM pix JOIN s USING (z), range(2) a(i), range(2) c(k))
SELECT z, y, x, round(sum(weight * v), 5) AS v FROM spread, size WHERE weight > 0 AND y BETWEEN y0 AND y0 + h - 1 AND x BETWEEN x0 AND x0 + w - 1 GROUP BY ALL HAVING sum(weight) > 1 - 1e-9""")
def aligned_volume(spark, sf):
    """The sections moved to meet the one before each."""
    p = _sections(spark, sf).withColumn("z", F.col("z").cast("long"))
    return b.rounded(rg.align(p, rg.register_stack(p).select("z", F.col("dy").alias("ty"), F.col("dx").alias("tx"))), 5)
