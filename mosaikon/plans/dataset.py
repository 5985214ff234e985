"""Queries on what a dataset and a roster are, on isotopes, and on images."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chemistry as ch
from ..operators import annotation as an
from ..operators import cohort as co
from ..operators import explain as ex
from ..operators import hierarchical as hi
from ..operators import intake as it
from ..operators import library as lb
from ..operators import multimodal as mm
from ..operators import regions as rg
from ..operators import spatial as sl
from ..operators import spectra as sp
from ..operators import statistics as st
from ..operators import tables as tb
from . import bindings as b
from .chemical import _CAL, _DECOYS, _FEAT, _KINDS, _SHIFT, _feat
from .extras import _IMP, _importance
from .models import _nested
from .registry import query

_ALL = ch.ISOTOPES
_R = {e: [a / _ALL[e][0][1] for _, a in _ALL[e][1:]] for e in "CHNO"}
_D = {e: [m - _ALL[e][0][0] for m, _ in _ALL[e][1:]] for e in "CHNO"}


def _sum(weight) -> str:
    return " + ".join(f"{e} * {weight(e)!r}::DOUBLE" for e in "CHNO")


_MONO = _sum(lambda e: _ALL[e][0][0])
_P0 = " * ".join(f"power({_ALL[e][0][1]!r}::DOUBLE, {e})" for e in "CHNO")
_S, _SD = _sum(lambda e: _R[e][0]), _sum(lambda e: _R[e][0] * _D[e][0])
_Q, _QD = _sum(lambda e: _R[e][0] ** 2), _sum(lambda e: _R[e][0] ** 2 * _D[e][0])
#: One and two extra nucleons in closed form: an atom with one each, pairs of atoms, or an oxygen with two.
_ENVELOPE = f"s AS (SELECT *, {_MONO} AS mono, {_P0} AS p0, {_S} AS r1, {_SD} AS w1, {_Q} AS q, {_QD} AS qd FROM f), e AS (SELECT *, O * {_R['O'][1]!r}::DOUBLE + (r1 * r1 - q) / 2 AS r2, O * {_R['O'][1] * _D['O'][1]!r}::DOUBLE + r1 * w1 - qd AS w2 FROM s)"


def _formulas(spark, sf):
    p = b.table(spark, sf, "part")
    formula = F.concat(F.lit("C"), F.col("p_size") + 10, F.lit("H"), 2 * F.col("p_size") + 20, F.lit("N"), F.col("p_partkey") % 3, F.lit("O"), F.col("p_partkey") % 7 + 1)
    return p.select(F.col("p_partkey").alias("formula_id"), ch.parse_formula(formula).alias("atoms"))


@query(f"""WITH f AS (SELECT p_partkey AS formula_id, p_size + 10 AS C, 2 * p_size + 20 AS H, p_partkey % 3 AS N, p_partkey % 7 + 1 AS O FROM part), {_ENVELOPE}
SELECT formula_id, 0 AS "offset", round(mono, 6) AS mass, round(p0, 9) AS abundance FROM e UNION ALL SELECT formula_id, 1, round(mono + w1 / r1, 6), round(p0 * r1, 9) FROM e UNION ALL SELECT formula_id, 2, round(mono + w2 / r2, 6), round(p0 * r2, 9) FROM e""")
def isotope_distribution(spark, sf):
    return an.isotope_distribution(_formulas(spark, sf), 2).select("formula_id", "offset", F.round("mass", 6).alias("mass"), F.round("abundance", 9).alias("abundance"))


@query(f"""WITH f AS (SELECT p_partkey AS formula_id, p_size + 10 AS C, 2 * p_size + 19 AS H, p_partkey % 3 AS N, p_partkey % 7 + 1 AS O FROM part), {_ENVELOPE},
z AS (SELECT formula_id, mono + {ch.ELEMENTS['H']!r}::DOUBLE + {_SHIFT!r}::DOUBLE AS mz0, r1, r2, w1, w2, greatest(1, r1, r2) AS t FROM e)
SELECT formula_id, 0 AS "offset", round(mz0, 6) AS mz, round(1 / t, 6) AS rel_intensity FROM z UNION ALL SELECT formula_id, 1, round(mz0 + w1 / r1, 6), round(r1 / t, 6) FROM z UNION ALL SELECT formula_id, 2, round(mz0 + w2 / r2, 6), round(r2 / t, 6) FROM z""")
def ion_isotope_pattern(spark, sf):
    return b.rounded(an.ion_pattern(_formulas(spark, sf), "[M-H]-"))


@query(f"""WITH {b.PEAKS}, {b.TARGETS_SQL}, a AS (SELECT feature_id, k::INT AS k, target_mz + k * {ch.C13_STEP}e0 AS goal FROM targets, range(3) t(k)),
s AS (SELECT feature_id, sum(intensity) FILTER (k = 0) AS s0, sum(intensity) FILTER (k = 1) AS s1, sum(intensity) FILTER (k = 2) AS s2 FROM a JOIN peaks ON abs(mz - goal) <= goal * 100e0 / 1e6 GROUP BY 1),
r AS (SELECT feature_id, coalesce(s0, 0) > 0 AS ok, coalesce(s1, 0) / s0 AS m1, coalesce(s2, 0) / s0 AS m2, greatest(1, round_even(target_mz / 14e0, 0)) AS c FROM targets LEFT JOIN s USING (feature_id))
SELECT feature_id, round(CASE WHEN ok THEN m1 ELSE 0 END, 6) AS m1_ratio, round(CASE WHEN ok THEN m2 ELSE 0 END, 6) AS m2_ratio, (CASE WHEN ok THEN c ELSE 0 END)::INT AS n_carbon, round(CASE WHEN ok THEN 0.011e0 * c ELSE 0e0 END, 6) AS expected_m1,
coalesce(ok AND m1 > 0 AND m1 BETWEEN 0.0055e0 * c AND 0.0275e0 * c, false) AS consistent FROM r""")
def isotope_consistency(spark, sf):
    t = b.targets(spark).withColumnRenamed("target_mz", "mz")
    return b.rounded(an.averagine_check(t, b.peaks(spark, sf)))


@query(f"""WITH {b.LIPIDS}, {_FEAT}, o1 AS (SELECT feature_id, (mz - (neutral_mass + {_SHIFT!r}::DOUBLE)) / (neutral_mass + {_SHIFT!r}::DOUBLE) * 1e6 AS ppm, row_number() OVER (PARTITION BY feature_id ORDER BY abs(neutral_mass + {_SHIFT!r}::DOUBLE - mz), neutral_mass) AS r FROM feat JOIN lipids ON abs(neutral_mass + {_SHIFT!r}::DOUBLE - mz) <= mz * 300e0 / 1e6),
o AS (SELECT CASE WHEN count(*) >= 30 AND abs(quantile_cont(ppm, 0.5)) >= 2 THEN quantile_cont(ppm, 0.5) ELSE 0e0 END AS off FROM o1 WHERE r = 1), g AS (SELECT feature_id, mz / (1 + off * 1e-6) AS mz FROM feat, o),
kinds(kind, s) AS (VALUES {_KINDS}), m AS (SELECT feature_id, kind, round(-abs(mz - (neutral_mass + {_SHIFT!r} + s)) / (neutral_mass + {_SHIFT!r} + s) * 1e6, 6) AS score,
  row_number() OVER (PARTITION BY feature_id, kind ORDER BY abs(neutral_mass + {_SHIFT!r} + s - mz), neutral_mass) AS r FROM g JOIN kinds ON true JOIN lipids ON abs(neutral_mass + {_SHIFT!r} + s - mz) <= mz * 400e0 / 1e6),
hits AS (SELECT * FROM m WHERE r = 1), scores AS (SELECT DISTINCT score FROM hits),
c AS (SELECT s.score, k.kind, count(h.score) AS n FROM scores s CROSS JOIN kinds k LEFT JOIN hits h ON h.kind = k.kind AND h.score >= s.score GROUP BY 1, 2),
md AS (SELECT d.score, least(1e0, quantile_cont((d.n + 1e0) / (t.n + 1e0), 0.5)) AS md FROM c d JOIN c t ON t.score = d.score AND t.kind = 't' WHERE d.kind <> 't' GROUP BY 1),
q AS (SELECT score, min(md) OVER (ORDER BY score ROWS UNBOUNDED PRECEDING) AS q FROM md), a AS (SELECT feature_id, q FROM hits JOIN q USING (score) WHERE kind = 't')
SELECT f.feature_id, round(a.q, 6) AS q_value, coalesce(a.q <= 0.9, false) AS fdr_pass FROM feat f LEFT JOIN a USING (feature_id) WHERE a.q IS NULL OR a.q <= 0.9""")
def attach_fdr(spark, sf):
    return b.rounded(an.attach_fdr(_feat(spark, sf), b.lipids(spark, sf), _DECOYS, _SHIFT, 400.0, q_max=0.9, wide_ppm=300.0).select("feature_id", "q_value", "fdr_pass"))


_ACIDS = ", ".join(f"('{n}', {m!r}::DOUBLE)" for n, m in lb.carboxylates())


@query(f"""WITH acids(chain, ion) AS (VALUES {_ACIDS}), fr AS (SELECT l_orderkey AS query_id, 171 + l_partkey * 0.0137e0 AS mz, l_quantity AS intensity FROM lineitem),
m AS (SELECT query_id, chain, max(intensity) AS strength FROM fr JOIN acids ON abs(mz - ion) <= 0.01 GROUP BY 1, 2)
SELECT query_id, chain, round(strength, 6) AS strength, row_number() OVER (PARTITION BY query_id ORDER BY strength DESC, chain)::INT AS rank FROM m""")
def acyl_chains(spark, sf):
    fr = b.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), (171 + F.col("l_partkey") * 0.0137).alias("mz"), F.col("l_quantity").alias("intensity"))
    return b.rounded(lb.acyl_chains(fr))


_RES = "g AS (SELECT month(o_orderdate) AS feature, c_custkey AS subject, c_mktsegment AS grp, o_orderstatus AS compartment, log2(avg(o_totalprice) + 1) AS v FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY ALL), u AS (SELECT feature, subject || compartment AS unit, v - avg(v) OVER (PARTITION BY feature, grp) AS e FROM g), r AS (SELECT feature, unit, e / sqrt(sum(e * e) OVER (PARTITION BY feature)) AS r FROM u)"


def _residuals(spark, sf):
    return hi.unit_residuals(_nested(spark, sf).withColumn("unit", F.concat(F.col("subject").cast("string"), "compartment")))


@query(f"WITH {_RES} SELECT feature, unit, round(r, 6) AS r FROM r")
def standardised_residuals(spark, sf):
    return b.rounded(_residuals(spark, sf))


@query(f"WITH {_RES}, p AS (SELECT x.feature % 3 AS class, x.feature AS f1, y.feature AS f2, sum(x.r * y.r) AS dot FROM r x JOIN r y ON x.unit = y.unit AND x.feature % 3 = y.feature % 3 AND x.feature < y.feature GROUP BY 1, 2, 3), n AS (SELECT feature % 3 AS class, count(DISTINCT feature) AS m FROM r GROUP BY 1) SELECT class, any_value(m) AS m, round(sum(dot) / any_value(m * (m - 1) / 2e0), 6) AS r_bar FROM p JOIN n USING (class) GROUP BY 1")
def inter_feature_correlation(spark, sf):
    r = _residuals(spark, sf)
    return b.rounded(hi.class_correlation(r, r.select("feature", (F.col("feature") % 3).alias("class")).distinct()))


@query(f"WITH {b.DENSE} SELECT feature AS feature_id, round(100 * max(v) / quantile_cont(v, 0.99), 5) AS relative_max FROM dense GROUP BY 1")
def relative_max(spark, sf):
    return b.rounded(sp.relative_max(b.dense(spark, sf).select("pixel_id", F.col("feature").alias("feature_id"), F.col("v").alias("value"))), 5)


@query(f"WITH {b.DENSE}, a AS (SELECT feature, quantile_cont(v, 0.99) AS a FROM dense GROUP BY 1) SELECT pixel_id, feature AS feature_id, round(least(1, greatest(0, (v - 0.1 * a) / (0.8 * a))), 6) AS value FROM dense JOIN a USING (feature)")
def relative_window(spark, sf):
    return b.rounded(sp.relative_window(b.dense(spark, sf).select("pixel_id", F.col("feature").alias("feature_id"), F.col("v").alias("value")), 10.0, 90.0))


@query("WITH s AS (SELECT 200 + l_partkey * 0.25e0 AS mz, sum(l_quantity) AS v FROM lineitem GROUP BY 1), r AS (SELECT min(mz) AS lo, max(mz) AS hi FROM s WHERE v >= 0.5 * (SELECT max(v) FROM s)) SELECT round(lo - (hi - lo) * 0.02, 6) AS lo, round(hi + (hi - lo) * 0.02, 6) AS hi FROM r")
def signal_mz_range(spark, sf):
    return b.rounded(sp.signal_range(b.peaks(spark, sf).groupBy("mz").agg(F.sum("intensity").alias("v")), 0.5))


@query(f"WITH {b.DENSE}, {b.GRID}, {b.PEAKS}, m AS (SELECT min(mz) AS mz_lo, max(mz) AS mz_hi FROM peaks) SELECT count(*) AS n_pixels, max(x) - min(x) + 1 AS width, (max(y) - min(y) + 1)::BIGINT AS height, sum(('0x' || substr(md5(pixel_id || ',' || x || ',' || y), 1, 8))::BIGINT)::BIGINT AS digest, any_value(mz_lo) AS mz_lo, any_value(mz_hi) AS mz_hi FROM grid, m")
def dataset_fingerprint(spark, sf):
    return sp.fingerprint(b.grid(spark, sf), b.peaks(spark, sf))


@query("""WITH s AS (SELECT vec_id, embedding AS e, len(embedding) AS n FROM embeddings), c AS (SELECT vec_id, n, len(list_filter(range(1, n + 1), lambda k: e[k] > 0)) AS pos, len(list_filter(range(1, n + 1), lambda k: e[k] > 0 AND (k = 1 OR e[k - 1] <= 0))) AS runs FROM s),
v AS (SELECT CASE WHEN n < 8 OR pos < 4 THEN NULL WHEN 1 - pos / n >= 0.2 THEN (pos / runs >= 2)::INT ELSE 1 END AS vote FROM c)
SELECT CASE WHEN avg(vote) >= 0.5 THEN 'profile' ELSE 'centroid' END AS label, CASE WHEN avg(vote) >= 0.5 THEN 'file flag (confirmed by data)' ELSE 'data heuristic (file flag said profile)' END AS source, count(vote) AS n_votes, round(avg(vote), 6) AS profile_fraction FROM v""")
def detect_representation(spark, sf):
    e = b.table(spark, sf, "embeddings").select(F.col("vec_id").alias("pixel_id"), F.transform("embedding", lambda _, k: 200 + k * 0.001).alias("mz"), F.col("embedding").alias("intensity"))
    return b.rounded(it.representation(e, "profile"))


@query(f"WITH {b.DENSE} SELECT label, feature, count(v) AS n, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, round(stddev_samp(v), 6) AS sd FROM dense GROUP BY 1, 2")
def region_tables(spark, sf):
    return b.rounded(rg.region_table(b.dense(spark, sf)))


_DIM = "CASE WHEN label % 4 = 0 THEN 0.02e0 WHEN label % 4 = 1 THEN 0.5e0 ELSE 1e0 END"


@query(f"WITH {b.DENSE}, t AS (SELECT pixel_id, label AS cluster, sum(v * {_DIM}) AS total FROM dense GROUP BY 1, 2), c AS (SELECT cluster, count(*) AS n_pixels, quantile_cont(total, 0.5) AS median FROM t GROUP BY 1) SELECT cluster, n_pixels, round(median, 6) AS median FROM c WHERE median < 0.1 * (SELECT max(median) FROM c)")
def background_clusters(spark, sf):
    d = b.dense(spark, sf).withColumn("v", F.col("v") * F.expr(_DIM.replace("e0", "D")))
    labels = b.table(spark, sf, "embeddings").select(F.col("vec_id").alias("pixel_id"), F.col("label").alias("cluster"))
    return b.rounded(rg.background(labels, d))


@query(f"""WITH {b.DENSE}, m AS (SELECT label, feature, avg(v) AS m FROM dense GROUP BY 1, 2), z AS (SELECT label, feature, (m - avg(m) OVER w) / stddev_pop(m) OVER w AS z FROM m WINDOW w AS (PARTITION BY feature))
SELECT x.label AS a, y.label AS b, round(corr(x.z, y.z), 6) AS score FROM z x JOIN z y ON x.feature = y.feature AND x.label < y.label GROUP BY 1, 2""")
def cross_region_comparison(spark, sf):
    d = b.dense(spark, sf)
    return b.rounded(rg.cross_correlation(d.where("feature < 32"), d.where("feature >= 32").withColumn("v", F.col("v") * 1000)))


@query("WITH v AS (SELECT vec_id AS feature, 200 + vec_id * 0.5e0 AS mz, embedding::DOUBLE[] AS e FROM embeddings), t AS (SELECT e AS te FROM v ORDER BY abs(mz - 230.3), mz LIMIT 1) SELECT feature, mz, round(list_dot_product(e, te) / sqrt(list_dot_product(e, e)) / sqrt(list_dot_product(te, te)), 6) AS score FROM v, t")
def ion_embedding_rank(spark, sf):
    v = b.table(spark, sf, "embeddings").select(F.col("vec_id").alias("feature"), (200 + F.col("vec_id") * 0.5).alias("mz"), F.col("embedding").alias("vector"))
    return b.rounded(rg.ion_rank(v, 230.3))


@query(f"WITH {b.DENSE}, {b.GRID}, i AS (SELECT x, y::BIGINT AS y, v FROM grid JOIN dense USING (pixel_id) WHERE feature = 3), n AS (SELECT count(*) AS c FROM i) SELECT f.x, f.y, round(0.375e0 * a.v + 0.125e0 * r.v + 0.375e0 * d.v + 0.125e0 * e.v, 6) AS v FROM i f LEFT JOIN i a ON a.x = f.x - 3 AND a.y = f.y + 1 LEFT JOIN i r ON r.x = f.x - 2 AND r.y = f.y + 1 LEFT JOIN i d ON d.x = f.x - 3 AND d.y = f.y + 2 LEFT JOIN i e ON e.x = f.x - 2 AND e.y = f.y + 2")
def warp_image(spark, sf):
    i = b.grid(spark, sf).join(b.dense(spark, sf).where("feature = 3"), "pixel_id").select("x", "y", "v")
    return b.rounded(mm.warp_image(i, i.select("x", "y"), [[1.0, 0.0, 2.75], [0.0, 1.0, -1.5], [0.0, 0.0, 1.0]]))


@query(f"WITH {_IMP}, n AS (SELECT donor, feature, direction, importance / sum(abs(importance)) OVER (PARTITION BY donor) AS i FROM imp WHERE region = 'N'), m AS (SELECT feature, avg(i) AS mean, stddev_pop(i) AS sd, avg(direction) AS d FROM n GROUP BY 1) SELECT feature, round(mean, 6) AS mean, round(sd, 6) AS sd, round(d, 6) AS direction, row_number() OVER (ORDER BY round(mean, 9) DESC, feature)::INT AS rank FROM m")
def importance_histogram(spark, sf):
    table = ex.normalised(_importance(spark, sf).where("region = 'N'"))
    return b.rounded(ex.bars(table, 100).select("feature", "mean", "sd", "direction", "rank"))


def _roster(spark, sf):
    c = b.table(spark, sf, "customer")
    meta = F.when(F.col("c_nationkey") % 3 == 0, F.create_map(F.lit("arm"), F.col("c_mktsegment"), F.lit("lot"), F.lit("7"))).otherwise(F.create_map(F.lit("lot"), F.lit("8")))
    return c.select(F.col("c_custkey").alias("sample_id"), F.when(F.col("c_nationkey") < 20, F.col("c_mktsegment")).alias("grp"), (F.col("c_nationkey") % 5).cast("string").alias("batch"), F.concat(F.lit("D:\\Scans\\"), F.lower("c_mktsegment"), F.lit("\\"), "c_name").alias("source"), meta.alias("meta"))


@query("SELECT c_custkey AS sample_id, CASE WHEN c_custkey % 7 = 0 THEN 'lab ' || c_nationkey WHEN c_nationkey < 20 THEN c_mktsegment END AS grp FROM customer")
def cohort_set_group(spark, sf):
    c = b.table(spark, sf, "customer").where("c_custkey % 7 = 0").select(F.col("c_custkey").alias("sample_id"), F.concat(F.lit(" lab "), F.col("c_nationkey")).alias("value"))
    return co.assign(_roster(spark, sf), c).select("sample_id", "grp")


@query("SELECT coalesce(CASE WHEN c_nationkey < 20 THEN c_mktsegment END, '') AS label, count(*) AS n, min(c_custkey) AS first_key FROM customer GROUP BY 1")
def cohort_by_group(spark, sf):
    return co.by_label(_roster(spark, sf))


@query("SELECT (c_nationkey % 5)::VARCHAR AS label, count(*) AS n, min(c_custkey) AS first_key FROM customer GROUP BY 1")
def cohort_by_batch(spark, sf):
    return co.by_label(_roster(spark, sf), "batch")


@query("SELECT 'arm' AS key, count(*) AS n FROM customer WHERE c_nationkey % 3 = 0 UNION ALL SELECT 'lot', count(*) FROM customer")
def cohort_meta_keys(spark, sf):
    return co.meta_keys(_roster(spark, sf))


@query("SELECT c_custkey AS sample_id, CASE WHEN c_mktsegment = 'BUILDING' THEN '/data/b/' || c_name END AS moved FROM customer")
def rebase_cohort(spark, sf):
    return co.rebase(_roster(spark, sf), "d:\\scans\\Building", "/data/b").select("sample_id", "moved")


@query("WITH p AS (SELECT l_suppkey % 6 AS sample_id, l_linenumber AS t, max(l_quantity) AS v FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2) SELECT sample_id, max(v) FILTER (t = 1) AS t1, max(v) FILTER (t = 2) AS t2, max(v) FILTER (t = 7) AS t7 FROM p GROUP BY 1")
def export_sample_matrix(spark, sf):
    t = b.table(spark, sf, "lineitem").where("l_linestatus = 'O'").groupBy((F.col("l_suppkey") % 6).alias("sample_id"), F.col("l_linenumber").alias("target_id")).agg(F.max("l_quantity").alias("value"))
    return co.sample_matrix(t, [1, 2, 7])


@query(f"""WITH {b.DENSE}, {b.GRID}, e AS (SELECT p.pixel_id AS a, q.pixel_id AS b FROM grid p JOIN grid q ON (q.x = p.x + 1 AND q.y = p.y) OR (q.x = p.x AND q.y = p.y + 1)),
z AS (SELECT pixel_id, feature, v - avg(v) OVER (PARTITION BY feature) AS z FROM dense), c AS (SELECT x.feature, sum(x.z * y.z) AS c, count(*) AS e FROM e JOIN z x ON x.pixel_id = e.a JOIN z y ON y.pixel_id = e.b AND y.feature = x.feature GROUP BY 1),
s AS (SELECT feature, sum(z * z) AS s, count(*) AS n FROM z GROUP BY 1), i AS (SELECT feature, n * c / (e * s) AS i FROM s JOIN c USING (feature))
SELECT feature, round(i, 6) AS morans_i FROM i WHERE i >= 0.01""")
def spatial_features(spark, sf):
    return b.rounded(sl.find_spatial(b.dense(spark, sf), b.grid(spark, sf), 0.01, 0.01).select("feature", "morans_i"))


@query(f"""WITH {b.DENSE}, p AS (SELECT *, label % 2 AS g, (pixel_id % 6) * 2 + label % 2 AS sample, (v > 0.1)::INT AS hot FROM dense WHERE label >= 0),
s AS (SELECT feature, g, sample, coalesce(avg(v) FILTER (hot = (SELECT max(hot) FROM p)), 0e0) AS x FROM p GROUP BY 1, 2, 3)
SELECT a.feature, count(DISTINCT a.sample) AS n_a, count(DISTINCT c.sample) AS n_b, round(avg(CASE WHEN c.x > a.x THEN 1e0 WHEN c.x = a.x THEN 0.5e0 ELSE 0e0 END), 6) AS auc FROM s a JOIN s c ON a.feature = c.feature AND a.g = 0 AND c.g = 1 GROUP BY 1""")
def segmentation_test(spark, sf):
    d = b.dense(spark, sf)
    labels = d.select("pixel_id", "feature", (F.col("v") > 0.1).cast("int").alias("label"))
    g = F.col("label") % 2
    samples = b.table(spark, sf, "embeddings").where("label >= 0").select(F.col("vec_id").alias("pixel_id"), ((F.col("vec_id") % 6) * 2 + g).alias("sample"), F.when(g == 0, "A").otherwise("B").alias("grp"))
    return b.rounded(st.segmentation_test(d.select("pixel_id", "feature", "v"), labels, samples).select("feature", "n_a", "n_b", "auc"))


@query(f"WITH {_CAL}, l AS (SELECT analyte, count(DISTINCT x) AS n_levels, min(x) AS conc_min, max(x) AS conc_max FROM c GROUP BY 1) SELECT analyte, round(b, 5) AS slope, round(a, 5) AS intercept, round(1 - sse / (yy - y * y / w), 5) AS r2, n_levels, conc_min, conc_max, '1/x' AS weighting, false AS through_origin, 'pmol' AS units FROM h JOIN l USING (analyte)")
def calibration_report(spark, sf):
    p = b.table(spark, sf, "part").where("p_size > 0").select(F.col("p_brand").alias("analyte"), F.col("p_size").cast("double").alias("concentration"), (F.col("p_retailprice") / 100).alias("response"))
    return b.rounded(tb.calibration_report(p, "1/x", units="pmol", keys=["analyte"]).drop("lod", "loq"), 5)


_FIELDS = "f AS (SELECT p_brand AS section, p_name || p_partkey AS field, p_size > 25 AS required, CASE WHEN p_partkey % 3 = 0 THEN ' auto ' END AS observed, p_partkey FROM part), r AS (SELECT section, field, coalesce(nullif(trim(observed), ''), CASE WHEN p_partkey % 5 = 0 THEN 'user' END) AS value, required FROM f), s AS (SELECT section, field, value, CASE WHEN value IS NOT NULL THEN 'ok' WHEN required THEN 'missing' ELSE 'warn' END AS status FROM r)"


def _report(spark, sf):
    p = b.table(spark, sf, "part")
    own = [F.col("p_brand").alias("section"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("field")]
    fields = p.select(*own, (F.col("p_size") > 25).alias("required"), F.when(F.col("p_partkey") % 3 == 0, " auto ").alias("observed"))
    return tb.reporting(fields, p.where("p_partkey % 5 IN (0, 1)").select(*own, F.when(F.col("p_partkey") % 5 == 0, "user").otherwise("  ").alias("value")))


@query(f"WITH {_FIELDS} SELECT * FROM s")
def validate_reporting(spark, sf):
    return _report(spark, sf)


@query(f"WITH {_FIELDS} SELECT count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status = 'warn') AS n_warn, count(*) FILTER (status = 'missing') AS n_missing, count(*) FILTER (status = 'missing') = 0 AS ready FROM s")
def reporting_summary(spark, sf):
    return tb.reporting_summary(_report(spark, sf))


_SOURCES = "c AS (SELECT c_custkey AS sample_id, c_name || CASE WHEN c_custkey % 11 = 0 THEN '.raw' ELSE '.imzML' END AS source, c_nationkey AS k, CASE WHEN c_nationkey < 12 THEN c_mktsegment END AS region FROM customer)"


def _sources(spark, sf):
    c = b.table(spark, sf, "customer")
    name = F.concat("c_name", F.when(F.col("c_custkey") % 11 == 0, ".raw").otherwise(".imzML"))
    return c.select(F.col("c_custkey").alias("sample_id"), name.alias("source"), F.when(F.col("c_nationkey") < 12, F.col("c_mktsegment")).otherwise("").alias("region"), "c_nationkey")


@query(f"""WITH {_SOURCES}, n AS (SELECT o_custkey AS sample_id, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT sample_id, CASE WHEN region IS NULL THEN 0 ELSE coalesce(n, 0) END AS n_pixels, CASE WHEN source NOT LIKE '%.imzML' THEN 'not an imzML source' WHEN k % 4 = 0 THEN 'source missing' WHEN region IS NULL THEN NULL WHEN n IS NULL THEN 'region not saved' END AS problem FROM c LEFT JOIN n USING (sample_id)""")
def diagnose_cohort(spark, sf):
    s = _sources(spark, sf)
    saved = b.table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("sample_id"), F.col("o_orderkey").alias("pixel_id")).join(s.select("sample_id", "region"), "sample_id")
    return co.diagnose(s, s.where("c_nationkey % 4 <> 0").select(F.col("source").alias("path")), saved)


@query(f"WITH {_SOURCES} SELECT sample_id, source FROM c WHERE source LIKE '%.imzML' AND k % 4 = 0")
def missing_source_samples(spark, sf):
    s = _sources(spark, sf)
    return co.missing_sources(s, s.where("c_nationkey % 4 <> 0").select(F.col("source").alias("path"))).select("sample_id", "source")


@query("""WITH p AS (SELECT l_suppkey AS pixel_id, 200 + l_partkey * 0.25e0 AS mz, l_quantity AS intensity FROM lineitem), g AS (SELECT pixel_id, (lead(mz) OVER w - mz) / mz * 1e6 AS gap FROM p WINDOW w AS (PARTITION BY pixel_id ORDER BY mz)),
v AS (SELECT CASE WHEN count(*) >= 8 THEN (quantile_cont(gap, 0.5) <= 30)::INT END AS vote FROM g GROUP BY pixel_id), t AS (SELECT pixel_id, sum(intensity) AS tic, sqrt(avg(intensity * intensity)) AS rms FROM p GROUP BY 1),
m AS (SELECT count(*) AS n_pixels, CASE WHEN stddev_pop(tic) / avg(tic) <= 0.05 THEN 'tic' WHEN stddev_pop(rms) / avg(rms) <= 0.05 THEN 'rms' ELSE 'none' END AS normalisation FROM t), k AS (SELECT CASE WHEN avg(vote) >= 0.5 THEN 'profile' ELSE 'centroid' END AS representation FROM v)
SELECT n_pixels, (SELECT min(mz) FROM p) AS mz_lo, (SELECT max(mz) FROM p) AS mz_hi, representation, CASE WHEN representation = 'centroid' THEN 'file flag (confirmed by data)' ELSE 'data heuristic (file flag said centroid)' END AS source, normalisation, CASE WHEN normalisation = 'none' THEN 'tic' ELSE 'none' END AS suggested_norm, CASE WHEN representation = 'centroid' THEN 'centroids' ELSE 'mean-spectrum' END AS suggested_pick FROM m, k""")
def inspect_dataset(spark, sf):
    return it.inspect(b.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("pixel_id"), (200 + F.col("l_partkey") * 0.25).alias("mz"), F.col("l_quantity").alias("intensity")), "centroid")
