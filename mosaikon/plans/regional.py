"""Queries on groups of pixels: tests, markers, likeness, and the pixel grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import regions as rg
from ..operators import spatial as sl
from ..operators import statistics as st
from . import bindings as b
from .registry import query

_TWO = "two AS (SELECT pixel_id, feature, CASE label WHEN 0 THEN 'A' ELSE 'B' END AS grp, v FROM dense WHERE label IN (0, 1))"
_RANKS = "ranks AS (SELECT feature, grp, v, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2e0 AS r, count(*) OVER (PARTITION BY feature, v) AS t FROM two)"
_AUC = """auc AS (SELECT feature, count(*) FILTER (grp = 'A') AS n_a, count(*) FILTER (grp = 'B') AS n_b, sum(r) FILTER (grp = 'B') - count(*) FILTER (grp = 'B') * (count(*) FILTER (grp = 'B') + 1) / 2e0 AS u,
  sum(t * t - 1)::DOUBLE AS ties, count(*)::DOUBLE AS n FROM ranks GROUP BY 1)"""


def _two(spark, sf):
    return b.dense(spark, sf).where(F.col("label").isin(0, 1)).select("pixel_id", "feature", F.when(F.col("label") == 0, "A").otherwise("B").alias("grp"), "v")


@query(f"""WITH {b.DENSE}, {_TWO}, {_RANKS}, {_AUC} SELECT feature, n_a, n_b, round(u / (n_a * n_b), 6) AS auc, round(u, 6) AS u,
round((greatest(u, n_a * n_b - u) - n_a * n_b / 2e0 - 0.5) / sqrt(n_a * n_b / 12e0 * (n + 1 - ties / (n * (n - 1)))), 6) AS z, ties > 0 AS tied FROM auc""")
def two_group_auc(spark, sf):
    return b.rounded(st.rank_auc(_two(spark, sf)))


@query(f"""WITH {b.DENSE}, {_TWO}, {_RANKS}, {_AUC}, tau AS (SELECT quantile_cont(v, 0.05) AS tau FROM two WHERE v > 0),
m AS (SELECT feature, avg(v) FILTER (grp = 'A') AS mean_a, stddev_samp(v) FILTER (grp = 'A') AS sd_a, avg(v) FILTER (grp = 'B') AS mean_b, stddev_samp(v) FILTER (grp = 'B') AS sd_b FROM two GROUP BY 1)
SELECT feature, round(mean_a, 6) AS mean_a, round(sd_a, 6) AS sd_a, round(mean_b, 6) AS mean_b, round(sd_b, 6) AS sd_b, round(u / (n_a * n_b), 6) AS auc, round(log2((mean_b + tau) / (mean_a + tau)), 6) AS log2_fc,
mean_a > tau OR mean_b > tau AS present FROM m JOIN auc USING (feature), tau""")
def two_group_stats(spark, sf):
    return b.rounded(st.two_group(_two(spark, sf)).select("feature", "mean_a", "sd_a", "mean_b", "sd_b", "auc", "log2_fc", "present"))


_M = "m AS (SELECT feature, count(*) FILTER (grp = 'A') AS na, count(*) FILTER (grp = 'B') AS nb, avg(v) FILTER (grp = 'A') AS ma, avg(v) FILTER (grp = 'B') AS mb, var_samp(v) FILTER (grp = 'A') AS va, var_samp(v) FILTER (grp = 'B') AS vb FROM two GROUP BY 1)"


@query(f"WITH {b.DENSE}, {_TWO}, {_M} SELECT feature, round((mb - ma) / sqrt(va / na + vb / nb), 6) AS t, round((va / na + vb / nb) ** 2 / ((va / na) ** 2 / (na - 1) + (vb / nb) ** 2 / (nb - 1)), 6) AS df FROM m")
def welch_t(spark, sf):
    return b.rounded(st.t_statistic(st.moments(_two(spark, sf))).select("feature", "t", "df"))


@query(f"WITH {b.DENSE}, {_TWO}, {_M} SELECT feature, round((mb - ma) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1e0 / na + 1e0 / nb)), 6) AS t, (na + nb - 2)::DOUBLE AS df FROM m")
def student_t(spark, sf):
    return b.rounded(st.t_statistic(st.moments(_two(spark, sf)), True).select("feature", "t", "df"))


@query()
def two_group_p_values(spark, sf):
    return b.rounded(st.two_group_test(_two(spark, sf)).select("feature", "auc", "p_value", "q_value"))


@query(f"""WITH {b.PEAKS}, two AS (SELECT floor(mz / 10)::BIGINT AS feature, CASE region WHEN 'A' THEN 'A' ELSE 'B' END AS grp, sample, avg(intensity) AS v FROM peaks WHERE region IN ('A', 'R') GROUP BY ALL),
r AS (SELECT feature, grp, rank() OVER (PARTITION BY feature ORDER BY round(v, 9)) + (count(*) OVER (PARTITION BY feature, round(v, 9)) - 1) / 2e0 AS r FROM two)
SELECT feature, count(*) FILTER (grp = 'A') AS n_a, count(*) FILTER (grp = 'B') AS n_b, round((sum(r) FILTER (grp = 'B') - count(*) FILTER (grp = 'B') * (count(*) FILTER (grp = 'B') + 1) / 2e0) / (count(*) FILTER (grp = 'A') * count(*) FILTER (grp = 'B')), 6) AS auc
FROM r GROUP BY 1 HAVING count(*) FILTER (grp = 'A') > 0 AND count(*) FILTER (grp = 'B') > 0""")
def sample_summarised_auc(spark, sf):
    p = b.peaks(spark, sf).where(F.col("region").isin("A", "R"))
    values = st.by_sample(p.select(F.floor(F.col("mz") / 10).alias("feature"), F.when(F.col("region") == "A", "A").otherwise("B").alias("grp"), "sample", F.col("intensity").alias("v")))
    return b.rounded(st.rank_auc(values.withColumn("v", F.round("v", 9))).select("feature", "n_a", "n_b", "auc"))


_OVR = """tau AS (SELECT quantile_cont(v, 0.05) AS tau FROM dense WHERE v > 0),
r AS (SELECT feature, label, v, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2e0 AS r FROM dense),
g AS (SELECT feature, label, count(*) AS b, sum(r) AS s, sum(v) AS sv, avg(CASE WHEN v > tau THEN 1e0 ELSE 0e0 END) AS p FROM r, tau GROUP BY 1, 2),
o AS (SELECT *, sum(b) OVER (PARTITION BY feature) - b AS a, sum(sv) OVER (PARTITION BY feature) - sv AS rest FROM g),
ovr AS (SELECT label, feature, sv / b AS mean_in, rest / a AS mean_out, (s - b * (b + 1) / 2e0) / (a * b) AS auc, log2((sv / b + tau) / (rest / a + tau)) AS log2_fc, p >= 0.5 AS present FROM o, tau)"""


@query(f"WITH {b.DENSE}, {_OVR} SELECT label, feature, round(mean_in, 6) AS mean_in, round(mean_out, 6) AS mean_out, round(auc, 6) AS auc, round(log2_fc, 6) AS log2_fc, present FROM ovr")
def one_vs_rest(spark, sf):
    return b.rounded(rg.one_vs_rest(b.dense(spark, sf)))


@query(f"WITH {b.DENSE}, {_OVR} SELECT label, feature, round(auc, 6) AS auc, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY present DESC, round(abs(auc - 0.5), 9) DESC, feature)::INT AS rank FROM ovr) WHERE rank <= 15")
def one_vs_rest_markers(spark, sf):
    return b.rounded(rg.markers(b.dense(spark, sf)).select("label", "feature", "auc", "rank"))


@query(f"""WITH {b.DENSE}, r AS (SELECT feature, label, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2e0 AS r, count(*) OVER (PARTITION BY feature, v) AS t FROM dense),
g AS (SELECT feature, label, sum(r) AS s, count(*) AS m, sum(t * t - 1)::DOUBLE AS ties FROM r GROUP BY 1, 2)
SELECT feature, round((12 / (sum(m) * (sum(m) + 1)::DOUBLE) * sum(s * s / m) - 3 * (sum(m) + 1)) / (1 - sum(ties) / (sum(m)::DOUBLE ** 3 - sum(m))), 6) AS h, count(*) - 1 AS df FROM g GROUP BY 1""")
def kruskal_h(spark, sf):
    d = b.dense(spark, sf).withColumnRenamed("label", "grp")
    return b.rounded(st.kruskal(d).select("feature", "h", "df"))


@query(f"""WITH {b.DENSE}, g AS (SELECT feature, label, count(*) AS m, avg(v) AS mu, var_pop(v) AS s FROM dense GROUP BY 1, 2)
SELECT feature, round(((sum(m * mu * mu) - sum(m * mu) ** 2 / sum(m)) / (count(*) - 1)) / (sum(m * s) / (sum(m) - count(*))), 6) AS f, count(*) - 1 AS df_between, (sum(m) - count(*))::BIGINT AS df_within FROM g GROUP BY 1""")
def anova_f(spark, sf):
    return b.rounded(st.anova(b.dense(spark, sf).withColumnRenamed("label", "grp")))


@query()
def multigroup_p_values(spark, sf):
    d = b.dense(spark, sf).withColumnRenamed("label", "grp")
    k = st.kruskal(d).withColumn("kw_p", st.p_of_chi2("h", "df"))
    return b.rounded(st.bh(k.join(st.anova(d).withColumn("f_p", st.p_of_f("f", "df_between", "df_within")), "feature"), "kw_p", "kw_q", []))


@query(f"""WITH {b.DENSE}, g AS (SELECT feature, label, count(*) AS nk, avg(v) AS mk, var_pop(v) AS vk FROM dense GROUP BY 1, 2),
p AS (SELECT *, sum(nk) OVER w AS n, sum(nk * mk) OVER w / sum(nk) OVER w AS grand, sqrt(sum(nk * vk) OVER w / greatest(1, sum(nk) OVER w - count(*) OVER w)) AS sj FROM g WINDOW w AS (PARTITION BY feature)),
s AS (SELECT quantile_cont(sj, 0.5) AS s0 FROM (SELECT DISTINCT feature, sj FROM p)), d AS (SELECT label, feature, (mk - grand) / (sqrt(1e0 / nk - 1e0 / n) * (sj + s0)) AS d FROM p, s)
SELECT label, feature, round(sign(d) * (abs(d) - 0.5), 6) AS d FROM d WHERE abs(d) > 0.5""")
def shrunken_centroids(spark, sf):
    return b.rounded(rg.shrunken_centroids(b.dense(spark, sf), 0.5))


@query(f"""WITH {b.DENSE}, tic AS (SELECT pixel_id, sum(v) AS tic FROM dense GROUP BY 1), e AS (SELECT quantile_cont(tic, 0.5) * 0.05 AS e FROM tic WHERE tic > 0),
two AS (SELECT feature, CASE label WHEN 2 THEN 'B' ELSE 'A' END AS grp, v FROM dense WHERE pixel_id IN (SELECT pixel_id FROM tic, e WHERE tic > e)), {_RANKS}, {_AUC}, tau AS (SELECT quantile_cont(v, 0.05) AS tau FROM two WHERE v > 0),
m AS (SELECT feature, avg(v) FILTER (grp = 'A') AS mean_a, avg(v) FILTER (grp = 'B') AS mean_b FROM two GROUP BY 1)
SELECT feature, round(u / (n_a * n_b), 6) AS auc, round(log2((mean_b + tau) / (mean_a + tau)), 6) AS log2_fc, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b FROM auc JOIN m USING (feature), tau""")
def roi_localization(spark, sf):
    return b.rounded(rg.localisation(b.dense(spark, sf), 2))


@query(f"""WITH {b.DENSE}, f AS (SELECT feature, quantile_cont(v, 0.75) AS f FROM dense GROUP BY 1), p AS (SELECT feature, label, avg(CASE WHEN v > f THEN 1e0 ELSE 0e0 END) AS p FROM dense JOIN f USING (feature) GROUP BY 1, 2)
SELECT feature, coalesce(string_agg(label::VARCHAR, '+' ORDER BY label) FILTER (p >= 0.3), '') AS compartment FROM p GROUP BY 1""")
def region_membership(spark, sf):
    return rg.membership(b.dense(spark, sf), 0.3)


def _classes(spark):
    return spark.range(64).select(F.col("id").cast("int").alias("feature"), (F.col("id") % 8).alias("class"))


@query(f"WITH {b.DENSE}, c AS (SELECT label, feature % 8 AS class, sum(v) / count(DISTINCT pixel_id) AS m FROM dense GROUP BY 1, 2) SELECT label, class::BIGINT AS class, round(100 * m / sum(m) OVER (PARTITION BY label), 6) AS percent FROM c")
def class_composition(spark, sf):
    return b.rounded(rg.class_composition(b.dense(spark, sf), _classes(spark)))


@query(f"""WITH {b.DENSE}, two AS (SELECT pixel_id, feature % 8 AS feature, CASE label WHEN 0 THEN 'A' ELSE 'B' END AS grp, round(sum(v), 9) AS v FROM dense WHERE label IN (0, 1) GROUP BY ALL), {_RANKS}, {_AUC}
SELECT feature::BIGINT AS feature, round(u / (n_a * n_b), 6) AS auc FROM auc""")
def class_comparison(spark, sf):
    values = rg.class_values(b.dense(spark, sf).where(F.col("label").isin(0, 1)), _classes(spark))
    return b.rounded(st.rank_auc(values.select("feature", F.when(F.col("label") == 0, "A").otherwise("B").alias("grp"), F.round("v", 9).alias("v"))).select("feature", "auc"))


@query(f"""WITH {b.DENSE}, {_TWO}, c AS (SELECT feature, v, sum(CASE grp WHEN 'B' THEN 1 ELSE 0 END) AS p, sum(CASE grp WHEN 'A' THEN 1 ELSE 0 END) AS m FROM two GROUP BY 1, 2)
SELECT feature, round(v, 6) AS score, round(sum(m) OVER d / sum(m) OVER (PARTITION BY feature), 6) AS fpr, round(sum(p) OVER d / sum(p) OVER (PARTITION BY feature), 6) AS tpr FROM c WINDOW d AS (PARTITION BY feature ORDER BY v DESC ROWS UNBOUNDED PRECEDING)""")
def roc_curve_points(spark, sf):
    return b.rounded(st.roc_points(_two(spark, sf)))


@query("""WITH p AS (SELECT p_partkey AS id, p_retailprice / (SELECT max(p_retailprice) + 1 FROM part) AS p FROM part), r AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, id) AS raw FROM p)
SELECT id, round(least(1e0, min(raw) OVER (ORDER BY p, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM r""")
def bh_qvalues(spark, sf):
    part = b.table(spark, sf, "part")
    top = part.agg((F.max("p_retailprice") + 1).alias("top"))
    return b.rounded(st.bh(part.join(F.broadcast(top)).select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") / F.col("top")).alias("p"))).select("id", "q"))


@query(f"""WITH {b.DENSE}, md AS (SELECT feature, quantile_cont(v, 0.5) AS md FROM dense WHERE v > 0 GROUP BY 1), d AS (SELECT pixel_id, feature, v, coalesce(v >= md, false) AS o FROM dense LEFT JOIN md USING (feature)), t AS (SELECT pixel_id, v AS tv, o AS t_on FROM d WHERE feature = 7)
SELECT feature, round(corr(tv, v), 6) AS pearson, round(sum(v * tv) / sqrt(sum(v * v) * sum(tv * tv)), 6) AS cosine, round(sum(CASE WHEN o THEN tv ELSE 0 END) / sum(tv), 6) AS m1, round(sum(CASE WHEN t_on THEN v ELSE 0 END) / sum(v), 6) AS m2,
round(2e0 * count(*) FILTER (o AND t_on) / (count(*) FILTER (o) + count(*) FILTER (t_on)), 6) AS dice FROM d JOIN t USING (pixel_id) GROUP BY 1""")
def colocalize(spark, sf):
    return b.rounded(rg.colocalisation(b.dense(spark, sf), 7))


@query(f"""WITH {b.DENSE} SELECT a.feature AS f1, b.feature AS f2, round(sum(a.v * b.v) / sqrt(sum(a.v * a.v) * sum(b.v * b.v)), 6) AS cosine FROM dense a JOIN dense b ON a.pixel_id = b.pixel_id AND a.feature < b.feature GROUP BY 1, 2""")
def coloc_matrix(spark, sf):
    return b.rounded(rg.coloc_matrix(b.dense(spark, sf)))


_RC = "m AS (SELECT label, feature, avg(v) AS m FROM dense GROUP BY 1, 2), rc AS (SELECT x.label AS a, y.label AS b, corr(x.m, y.m) AS score FROM m x JOIN m y ON x.feature = y.feature AND x.label < y.label GROUP BY 1, 2)"


@query(f"WITH {b.DENSE}, {_RC} SELECT a, b, round(score, 6) AS score FROM rc")
def region_correlation(spark, sf):
    return b.rounded(rg.region_correlation(b.dense(spark, sf)))


@query(f"WITH {b.DENSE}, {_RC}, s AS (SELECT a AS label, b AS match, score FROM rc UNION ALL SELECT b, a, score FROM rc) SELECT label, match FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, match) AS r FROM s) WHERE r = 1")
def region_best_match(spark, sf):
    return rg.best_match(rg.region_correlation(b.dense(spark, sf)))


@query(f"""WITH {b.DENSE}, {b.GRID}, e AS (SELECT p.pixel_id AS a, q.pixel_id AS b FROM grid p JOIN grid q ON (q.x = p.x + 1 AND q.y = p.y) OR (q.x = p.x AND q.y = p.y + 1)),
z AS (SELECT pixel_id, feature, v - avg(v) OVER (PARTITION BY feature) AS z FROM dense), c AS (SELECT x.feature, sum(x.z * y.z) AS c, count(*) AS e FROM e JOIN z x ON x.pixel_id = e.a JOIN z y ON y.pixel_id = e.b AND y.feature = x.feature GROUP BY 1),
s AS (SELECT feature, sum(z * z) AS s, count(*) AS n FROM z GROUP BY 1) SELECT feature, round(n * c / (e * s), 6) AS morans_i FROM s JOIN c USING (feature)""")
def moran_i(spark, sf):
    return b.rounded(sl.moran(b.dense(spark, sf), b.grid(spark, sf)))


@query(f"WITH {b.DENSE}, t AS (SELECT feature, max(v) AS t FROM dense GROUP BY 1) SELECT feature, round(avg(CASE WHEN v > 0.05 * t AND t > 0 THEN 1e0 ELSE 0e0 END), 6) AS frequency FROM dense JOIN t USING (feature) GROUP BY 1")
def feature_frequency(spark, sf):
    return b.rounded(sl.frequency(b.dense(spark, sf)))


@query(f"WITH {b.DENSE}, r AS (SELECT feature, v, row_number() OVER (PARTITION BY feature ORDER BY v DESC) AS r, count(*) OVER (PARTITION BY feature) AS n FROM dense) SELECT feature, round(sum(CASE WHEN r <= greatest(1, ceil(0.01 * n)) THEN v ELSE 0e0 END) / sum(v), 6) AS hotspot FROM r GROUP BY 1")
def hotspot_fraction(spark, sf):
    return b.rounded(sl.hotspot(b.dense(spark, sf)))


@query(f"WITH {b.DENSE}, f AS (SELECT pixel_id, v FROM dense WHERE feature = 4) SELECT pixel_id FROM f WHERE v > 0 AND v >= (SELECT quantile_cont(v, 0.7) FROM f WHERE v > 0)")
def threshold_mask_percentile(spark, sf):
    return sl.threshold_mask(b.dense(spark, sf).where("feature = 4"), 70)


@query(f"WITH {b.DENSE} SELECT pixel_id FROM dense WHERE feature = 4 AND v > 0.1")
def threshold_mask_absolute(spark, sf):
    return sl.threshold_mask(b.dense(spark, sf).where("feature = 4"), 0.1, False)


def _mask(spark, sf):
    return b.table(spark, sf, "embeddings").where("label < 5").select(F.col("vec_id").alias("pixel_id"))


@query("SELECT vec_id AS pixel_id FROM embeddings WHERE label >= 5")
def invert_mask(spark, sf):
    return sl.invert(b.grid(spark, sf), _mask(spark, sf))


_OFF = "off AS (SELECT i, j FROM range(-2, 3) a(i), range(-2, 3) c(j) WHERE i * i + j * j BETWEEN 1 AND 4), mk AS (SELECT g.*, label < 5 AS m FROM grid g JOIN embeddings ON vec_id = pixel_id)"


@query(f"WITH {b.GRID}, {_OFF} SELECT p.pixel_id FROM mk p, off LEFT JOIN mk q ON q.x = p.x + i AND q.y = p.y + j AND q.m WHERE p.m AND q.pixel_id IS NULL GROUP BY 1")
def ring_inner(spark, sf):
    return sl.ring(b.grid(spark, sf), _mask(spark, sf), 2.0)


@query(f"WITH {b.GRID}, {_OFF} SELECT DISTINCT p.pixel_id FROM mk p, off JOIN mk q ON q.x = p.x + i AND q.y = p.y + j AND q.m WHERE NOT p.m")
def ring_outer(spark, sf):
    return sl.ring(b.grid(spark, sf), _mask(spark, sf), 2.0, "outer")


_ISL = """mk AS (SELECT g.* FROM grid g JOIN embeddings ON vec_id = pixel_id WHERE label < 5), reach(a, b) AS (SELECT pixel_id, pixel_id FROM mk UNION SELECT r.a, q.pixel_id FROM reach r JOIN mk p ON p.pixel_id = r.b JOIN mk q ON abs(p.x - q.x) + abs(p.y - q.y) = 1),
isl AS (SELECT a AS pixel_id, min(b) AS island FROM reach GROUP BY 1)"""


@query(f"WITH RECURSIVE {b.GRID}, {_ISL} SELECT pixel_id, island FROM isl")
def islands(spark, sf):
    return sl.islands(b.grid(spark, sf), _mask(spark, sf))


@query(f"WITH RECURSIVE {b.GRID}, {_ISL} SELECT pixel_id FROM isl WHERE island IN (SELECT island FROM isl GROUP BY 1 HAVING count(*) >= 3)")
def drop_small(spark, sf):
    return sl.drop_small(b.grid(spark, sf), _mask(spark, sf), 3)


@query(f"""WITH RECURSIVE {b.GRID}, bx AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM grid), mk AS (SELECT g.* FROM grid g JOIN embeddings ON vec_id = pixel_id WHERE label >= 5),
out(pixel_id) AS (SELECT pixel_id FROM mk, bx WHERE x IN (x0, x1) OR y IN (y0, y1) UNION SELECT q.pixel_id FROM out o JOIN mk p ON p.pixel_id = o.pixel_id JOIN mk q ON abs(p.x - q.x) + abs(p.y - q.y) = 1)
SELECT vec_id AS pixel_id FROM embeddings WHERE vec_id NOT IN (SELECT pixel_id FROM out)""")
def fill_holes(spark, sf):
    return sl.fill_holes(b.grid(spark, sf), _mask(spark, sf))


@query()
def spatial_chaos(spark, sf):
    return b.rounded(sl.chaos(b.dense(spark, sf), b.grid(spark, sf)))


@query()
def detect_samples(spark, sf):
    tic = b.dense(spark, sf).groupBy("pixel_id").agg(F.sum("v").alias("v"))
    return sl.detect_samples(b.grid(spark, sf), tic)
