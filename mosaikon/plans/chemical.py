"""Queries on compounds, cohorts, tables and other assays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chemistry as ch
from ..operators import annotation as an
from ..operators import cohort as co
from ..operators import multimodal as mm
from ..operators import ranges as ra
from ..operators import tables as tb
from . import bindings as b
from .registry import query

_SHIFT = ch.ADDUCTS["negative"]["[M-H]-"][0]
_ADDUCTS = ", ".join(f"('{a}', {s!r}::DOUBLE, {z})" for a, (s, z) in ch.ADDUCTS["negative"].items())
_IDX = f"idx AS (SELECT l.*, a.adduct, (l.neutral_mass + a.shift) / a.z AS ion_mz FROM lipids l CROSS JOIN (VALUES {_ADDUCTS}) a(adduct, shift, z))"
#: What is asked for: a m/z for each supplier, the same in both.
_FEAT = "feat AS (SELECT s_suppkey AS feature_id, 210 + s_suppkey * 3.7e0 + s_acctbal / 1e5 AS mz, s_acctbal AS intensity FROM supplier)"


def _feat(spark, sf):
    s = b.table(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").alias("feature_id"), (210 + F.col("s_suppkey") * 3.7 + F.col("s_acctbal") / 1e5).alias("mz"), F.col("s_acctbal").alias("intensity"))


@query(f"""WITH {b.LIPIDS}, {_FEAT}, m AS (SELECT f.feature_id, f.mz, l.neutral_mass AS ref_mz, row_number() OVER (PARTITION BY f.feature_id ORDER BY abs(l.neutral_mass - f.mz), l.neutral_mass) AS r FROM feat f JOIN lipids l ON abs(l.neutral_mass - f.mz) <= f.mz * 400e0 / 1e6)
SELECT f.feature_id, round(f.mz, 6) AS mz, round(m.ref_mz, 6) AS ref_mz FROM feat f LEFT JOIN m ON m.feature_id = f.feature_id AND r = 1""")
def nearest_within_ppm(spark, sf):
    ref = b.lipids(spark, sf).select(F.col("neutral_mass").alias("ref_mz"))
    return b.rounded(ra.nearest(_feat(spark, sf), ref, 400.0, ["feature_id"]).select("feature_id", "mz", "ref_mz"))


_ANN = f"""{b.LIPIDS}, {_FEAT}, {_IDX}, ann AS (SELECT feature_id, mz, name, class, adduct, (mz - ion_mz) / ion_mz * 1e6 AS ppm, round(-abs((mz - ion_mz) / ion_mz * 1e6) + 0.1 * 500 * prior, 9) AS score FROM feat JOIN idx ON ion_mz BETWEEN mz - mz * 500e0 / 1e6 AND mz + mz * 500e0 / 1e6),
ranked AS (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY score DESC, class, name, adduct)::INT AS rank FROM ann)"""


def _annotated(spark, sf):
    return an.annotate(_feat(spark, sf), an.ion_index(b.lipids(spark, sf)), 500.0)


@query(f"WITH {_ANN} SELECT feature_id, name, class, adduct, round(ppm, 6) AS ppm, round(score, 6) AS score, rank FROM ranked")
def annotate_all(spark, sf):
    return b.rounded(_annotated(spark, sf).select("feature_id", "name", "class", "adduct", "ppm", "score", "rank"))


@query(f"WITH {_ANN} SELECT f.feature_id, r.class, r.name FROM feat f LEFT JOIN ranked r ON r.feature_id = f.feature_id AND r.rank = 1")
def annotate_class_of(spark, sf):
    return an.top_class(_feat(spark, sf), an.ion_index(b.lipids(spark, sf)), 500.0).select("feature_id", "class", "name")


@query(f"WITH {b.LIPIDS}, {_FEAT}, {_IDX} SELECT lipid_id, count(DISTINCT adduct) AS n_adducts, string_agg(DISTINCT adduct, ',' ORDER BY adduct) AS adducts FROM feat JOIN idx ON ion_mz BETWEEN mz - mz * 500e0 / 1e6 AND mz + mz * 500e0 / 1e6 GROUP BY 1")
def corroborating_adducts(spark, sf):
    return an.corroborating(_feat(spark, sf), an.ion_index(b.lipids(spark, sf)), 500.0)


@query(f"""WITH {b.LIPIDS}, {_FEAT}, {_IDX}, m AS (SELECT feature_id, (mz - ion_mz) / ion_mz * 1e6 AS ppm, row_number() OVER (PARTITION BY feature_id ORDER BY abs(ion_mz - mz), ion_mz) AS r FROM feat JOIN idx ON abs(ion_mz - mz) <= mz * 300e0 / 1e6)
SELECT count(*) AS n, round(CASE WHEN count(*) >= 30 AND abs(quantile_cont(ppm, 0.5)) >= 2 THEN quantile_cont(ppm, 0.5) ELSE 0e0 END, 6) AS "offset" FROM m WHERE r = 1""")
def mass_offset(spark, sf):
    return b.rounded(an.mass_offset(_feat(spark, sf), an.ion_index(b.lipids(spark, sf)).select("ion_mz"), 300.0))


_DECOYS = [1.5, 2.25, 3.1, 4.4, 5.7]
_KINDS = ", ".join(f"('{n}', {s}e0)" for n, s in [("t", 0.0), *[(f"d{k}", s) for k, s in enumerate(_DECOYS)]])


@query(f"""WITH {b.LIPIDS}, {_FEAT}, kinds(kind, s) AS (VALUES {_KINDS}), m AS (SELECT feature_id, kind, round(-abs(mz - (neutral_mass + {_SHIFT!r} + s)) / (neutral_mass + {_SHIFT!r} + s) * 1e6, 6) AS score,
  row_number() OVER (PARTITION BY feature_id, kind ORDER BY abs(neutral_mass + {_SHIFT!r} + s - mz), neutral_mass) AS r FROM feat JOIN kinds ON true JOIN lipids ON abs(neutral_mass + {_SHIFT!r} + s - mz) <= mz * 400e0 / 1e6),
hits AS (SELECT * FROM m WHERE r = 1), scores AS (SELECT DISTINCT score FROM hits),
c AS (SELECT s.score, k.kind, count(h.score) AS n FROM scores s CROSS JOIN kinds k LEFT JOIN hits h ON h.kind = k.kind AND h.score >= s.score GROUP BY 1, 2),
md AS (SELECT d.score, least(1e0, quantile_cont((d.n + 1e0) / (t.n + 1e0), 0.5)) AS md FROM c d JOIN c t ON t.score = d.score AND t.kind = 't' WHERE d.kind <> 't' GROUP BY 1),
q AS (SELECT score, min(md) OVER (ORDER BY score ROWS UNBOUNDED PRECEDING) AS q FROM md)
SELECT feature_id, round(score, 6) AS score, round(q, 6) AS q FROM hits JOIN q USING (score) WHERE kind = 't'""")
def fdr_target_decoy(spark, sf):
    return b.rounded(an.target_decoy(_feat(spark, sf), b.lipids(spark, sf), _DECOYS, _SHIFT, 400.0))


_ISO = "iso AS (SELECT p_partkey AS feature_id, 300 + p_partkey * 0.2508387e0 AS mz, p_retailprice AS intensity FROM part)"


@query(f"""WITH {_ISO} SELECT a.feature_id, EXISTS (SELECT 1 FROM iso c, (VALUES (1), (2)) n(n) WHERE abs(c.mz - (a.mz - n * {ch.C13_STEP})) <= a.mz * 15e0 / 1e6 AND c.intensity > a.intensity) AS satellite FROM iso a""")
def deisotope_flags(spark, sf):
    part = b.table(spark, sf, "part").select(F.col("p_partkey").alias("feature_id"), (300 + F.col("p_partkey") * 0.2508387).alias("mz"), F.col("p_retailprice").alias("intensity"))
    return an.deisotope(part).select("feature_id", "satellite")


_MASS = " + ".join(f"{m!r} * {n}" for m, n in ((ch.ELEMENTS["C"], 40), (ch.ELEMENTS["H"], 78), (ch.ELEMENTS["N"], 1), (ch.ELEMENTS["O"], 8), (ch.ELEMENTS["P"], 1)))


@query(f"SELECT s_suppkey AS id, round({_MASS} + s_suppkey * {ch.ELEMENTS['C']!r}, 6) AS mass, round(({_MASS} + s_suppkey * {ch.ELEMENTS['C']!r} + {_SHIFT!r}), 6) AS mz FROM supplier")
def formula_mass(spark, sf):
    s = b.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("C"), (F.col("s_suppkey") + 40).cast("string"), F.lit("H78NO8P")).alias("formula"))
    mass = ch.formula_mass(ch.parse_formula(F.col("formula")))
    return b.rounded(s.select("id", mass.alias("mass"), ch.ion_mz(mass, "[M-H]-").alias("mz")))


@query(f"WITH {b.DENSE}, s AS (SELECT feature, sum(v) AS s FROM dense WHERE feature < 3 GROUP BY 1), t(feature, t) AS (VALUES (0, 1e0), (1, 0.4e0), (2, 0.1e0)), n AS (SELECT sqrt(sum(s * s)) AS ns, sqrt(sum(t * t)) AS nt FROM s JOIN t USING (feature)), r AS (SELECT d.feature, corr(z.v, d.v) AS r FROM dense d JOIN dense z ON z.pixel_id = d.pixel_id AND z.feature = 0 WHERE d.feature < 3 GROUP BY 1) SELECT round(greatest(0, 1 - avg(abs(t / nt - s / ns))), 6) AS spectral, round(greatest(0, least(1, sum(t * r) FILTER (feature > 0) / sum(t) FILTER (feature > 0))), 6) AS spatial FROM s JOIN t USING (feature) JOIN r USING (feature), n")
def isotope_scores(spark, sf):
    return b.rounded(an.isotope_scores(b.dense(spark, sf), [(0, 1.0), (1, 0.4), (2, 0.1)]))


@query("SELECT c_custkey AS id, (CASE WHEN NOT (c_acctbal > 0) THEN 5 WHEN c_nationkey % 7 = 0 THEN 1 WHEN c_nationkey % 5 = 0 THEN 4 WHEN c_nationkey % 3 = 0 THEN 3 WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN 2 ELSE 3 END)::INT AS level FROM customer")
def msi_level(spark, sf):
    c = b.table(spark, sf, "customer")
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    t = c.select(k.alias("id"), (F.col("c_acctbal") > 0).alias("annotated"), (n % 7 == 0).alias("ms2"), (n % 5 == 0).alias("formula_only"), (n % 3 == 0).alias("ambiguous"), (k % 2 == 0).alias("isotope_ok"), (k % 3 == 0).alias("spatial_ok"))
    return an.msi_level(t).select("id", "level")


@query("""WITH o AS (SELECT p_partkey AS id, p_size / 100e0 AS q FROM part WHERE p_size < 30), t AS (SELECT p_partkey AS id, p_retailprice / 1e4 AS fdr FROM part WHERE p_size > 20)
SELECT coalesce(o.id, t.id) AS id, round(q, 6) AS q, round(fdr, 6) AS fdr, CASE WHEN o.id IS NULL THEN 'theirs_only' WHEN t.id IS NULL THEN 'ours_only' ELSE 'both' END AS agreement, round(q - fdr, 6) AS delta FROM o FULL JOIN t ON o.id = t.id""")
def compare_fdr(spark, sf):
    p = b.table(spark, sf, "part")
    ours = p.where("p_size < 30").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 100.0).alias("q"))
    theirs = p.where("p_size > 20").select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 1e4).alias("fdr"))
    return b.rounded(an.compare_lists(ours, theirs, ["id"]))


_CONSENSUS_PEAKS = "sp AS (SELECT sample AS sample_id, mz, intensity FROM peaks)"


def _sample_peaks(spark, sf):
    return b.peaks(spark, sf).select(F.col("sample").alias("sample_id"), "mz", "intensity")


@query(f"""WITH RECURSIVE {b.PEAKS}, {_CONSENSUS_PEAKS}, p AS (SELECT mz, max(intensity) AS i, row_number() OVER (ORDER BY mz) AS r FROM sp GROUP BY mz),
w(r, lo) AS (SELECT r, mz FROM p WHERE r = 1 UNION ALL
  SELECT p.r, CASE WHEN p.mz - q.mz > p.mz * 1500e0 / 1e6 OR p.mz - w.lo > p.mz * 1500e0 / 1e6 THEN p.mz ELSE w.lo END FROM w JOIN p ON p.r = w.r + 1 JOIN p q ON q.r = w.r),
placed AS (SELECT mz, i, lo FROM w JOIN p USING (r)),
n AS (SELECT lo, count(DISTINCT sample_id) AS n_samples FROM sp JOIN placed USING (mz) GROUP BY 1),
c AS (SELECT lo, max(mz) AS hi, (array_agg(mz ORDER BY i DESC, mz))[1] AS target_mz FROM placed GROUP BY 1)
SELECT round(target_mz, 6) AS target_mz, round(lo, 6) AS lo, round(hi, 6) AS hi, n_samples FROM c JOIN n USING (lo)""")
def consensus_targets(spark, sf):
    return b.rounded(co.consensus(_sample_peaks(spark, sf), 1500.0))


_NEAR = f"{b.PEAKS}, {b.TARGETS_SQL}, hit AS (SELECT sample AS sample_id, feature_id AS target_id, intensity, row_number() OVER (PARTITION BY sample, feature_id ORDER BY abs(mz - target_mz), mz, intensity) AS r FROM peaks JOIN targets ON mz BETWEEN target_mz - target_mz * 2000e0 / 1e6 AND target_mz + target_mz * 2000e0 / 1e6), tab AS (SELECT s.sample AS sample_id, t.feature_id AS target_id, h.intensity AS value FROM (SELECT DISTINCT sample FROM peaks) s CROSS JOIN targets t LEFT JOIN hit h ON h.sample_id = s.sample AND h.target_id = t.feature_id AND h.r = 1)"


def _targets(spark):
    return b.targets(spark).withColumnRenamed("feature_id", "target_id")


@query(f"WITH {_NEAR} SELECT sample_id, target_id, round(value, 6) AS value FROM tab")
def batch_feature_table(spark, sf):
    return b.rounded(co.feature_table(_sample_peaks(spark, sf), _targets(spark), 2000.0))


@query(f"WITH {_NEAR}, z AS (SELECT sample_id, target_id, coalesce(value, 0e0) AS value FROM tab), f AS (SELECT sample_id, quantile_cont(value, 0.5) AS f FROM z WHERE value > 0 GROUP BY 1) SELECT sample_id, target_id, round(value / f * (SELECT avg(f) FROM f), 6) AS value FROM z JOIN f USING (sample_id)")
def batch_feature_table_median(spark, sf):
    return b.rounded(co.feature_table(_sample_peaks(spark, sf), _targets(spark), 2000.0, "zero", "median"))


@query(f"WITH {b.PEAKS}, {b.TARGETS_SQL} SELECT t.feature_id AS target_id, count(DISTINCT sample) AS n_samples FROM targets t LEFT JOIN peaks p ON p.mz BETWEEN target_mz - target_mz * 300e0 / 1e6 AND target_mz + target_mz * 300e0 / 1e6 GROUP BY 1")
def features_present(spark, sf):
    return co.features_present(_sample_peaks(spark, sf), _targets(spark), 300.0)


def _cohort(spark, sf):
    return b.cohort(spark, sf).withColumn("v", F.round("value", 6))


@query(f"""WITH {b.COHORT}, two AS (SELECT feature, sample_id, grp, round(value, 6) AS v FROM cohort WHERE grp IN ('BUILDING', 'MACHINERY')), tau AS (SELECT quantile_cont(v, 0.05) AS tau FROM two WHERE v > 0),
r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2e0 AS r FROM two),
g AS (SELECT feature, count(*) FILTER (grp = 'BUILDING') AS n_a, count(*) FILTER (grp = 'MACHINERY') AS n_b, avg(v) FILTER (grp = 'BUILDING') AS ma, avg(v) FILTER (grp = 'MACHINERY') AS mb, sum(r) FILTER (grp = 'MACHINERY') AS s, count(*) FILTER (v > 0) AS n_detected FROM r GROUP BY 1)
SELECT feature, n_a, n_b, round((s - n_b * (n_b + 1) / 2e0) / (n_a * n_b), 6) AS auc, round(log2((mb + tau) / (ma + tau)), 6) AS log2_fc, n_detected, round(n_detected / (SELECT count(DISTINCT sample_id) FROM two)::DOUBLE, 6) AS prevalence FROM g, tau WHERE n_a >= 2 AND n_b >= 2""")
def group_comparison(spark, sf):
    got = co.group_comparison(_cohort(spark, sf), "BUILDING", "MACHINERY")
    return b.rounded(got.select("feature", "n_a", "n_b", "auc", "log2_fc", "n_detected", "prevalence"))


@query("""WITH p AS (SELECT month(o_orderdate)::INT AS feature, o_custkey AS pair, o_orderpriority AS grp, o_totalprice AS v FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')), tau AS (SELECT quantile_cont(v, 0.05) AS tau FROM p WHERE v > 0),
w AS (SELECT feature, pair, avg(v) FILTER (grp = '1-URGENT') AS va, avg(v) FILTER (grp = '5-LOW') AS vb FROM p GROUP BY 1, 2) SELECT feature, count(*) AS n_pairs, round(avg(log2((vb + tau) / (va + tau))), 6) AS log2_fc FROM w, tau WHERE va IS NOT NULL AND vb IS NOT NULL GROUP BY 1""")
def paired_log2fc(spark, sf):
    o = b.table(spark, sf, "orders").select(F.month("o_orderdate").alias("feature"), F.col("o_custkey").alias("pair"), F.col("o_orderpriority").alias("grp"), F.col("o_totalprice").alias("v"))
    return b.rounded(co.paired_fold(o, "1-URGENT", "5-LOW"))


@query(f"WITH {b.PEAKS} SELECT sample AS sample_id, region, floor(mz / 25)::BIGINT AS feature, round(quantile_cont(intensity, 0.5), 6) AS v FROM peaks GROUP BY 1, 2, 3")
def pseudobulk_median(spark, sf):
    p = b.peaks(spark, sf).select(F.col("sample").alias("sample_id"), "region", F.floor(F.col("mz") / 25).alias("feature"), F.col("intensity").alias("v"))
    return b.rounded(co.pseudobulk(p))


@query("SELECT s_suppkey, s_nationkey, feature, round(v, 6) AS v FROM (SELECT s_suppkey, s_nationkey, s_acctbal AS bal, s_acctbal * 2 AS twice FROM supplier) UNPIVOT (v FOR feature IN (bal, twice))")
def pseudobulk_tidy(spark, sf):
    s = b.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", F.col("s_acctbal").alias("bal"), (F.col("s_acctbal") * 2).alias("twice"))
    return b.rounded(co.tidy(s, ["s_suppkey", "s_nationkey"]))


@query(f"WITH {b.COHORT}, g AS (SELECT feature, batch, count(*) AS n, avg(value) AS m, var_pop(value) AS s FROM cohort GROUP BY 1, 2), t AS (SELECT feature, sum(n * m * m) - sum(n * m) ** 2 / sum(n) AS bt, sum(n * s) AS w FROM g GROUP BY 1) SELECT feature, round(bt / (bt + w), 6) AS share FROM t")
def batch_variance_fraction(spark, sf):
    return b.rounded(co.batch_variance(b.cohort(spark, sf).withColumnRenamed("value", "v")))


@query(f"WITH {b.COHORT} SELECT sample_id, feature, round(value - avg(value) OVER (PARTITION BY feature, batch) + avg(value) OVER (PARTITION BY feature), 4) AS v FROM cohort")
def combat_mean_only(spark, sf):
    return b.rounded(co.combat_mean(b.cohort(spark, sf).withColumnRenamed("value", "v")).select("sample_id", "feature", "v"), 4)


@query()
def combat_full(spark, sf):
    return b.rounded(co.combat(b.cohort(spark, sf).withColumnRenamed("value", "v")).select("sample_id", "feature", "v"), 4)


@query("""WITH s AS (SELECT n_a, n_b, n_features FROM (SELECT n_nationkey AS id, 2 + n_nationkey % 5 AS n_a, 3 + n_nationkey % 4 AS n_b, (n_nationkey + 1) * 3 AS n_features FROM nation)), p AS (SELECT *, least(1e0, 2e0 * factorial(n_a) * factorial(n_b) / factorial(n_a + n_b)) AS p FROM s)
SELECT n_a, n_b, n_features, round(p, 6) AS p_floor, floor(0.05 / p + 1e-9)::BIGINT AS max_features, n_features <= floor(0.05 / p + 1e-9) AS feasible FROM p""")
def bh_feasibility(spark, sf):
    n = F.col("n_nationkey")
    return b.rounded(co.feasibility(b.table(spark, sf, "nation").select((2 + n % 5).alias("n_a"), (3 + n % 4).alias("n_b"), ((n + 1) * 3).alias("n_features"))))


@query("SELECT p_partkey AS id, trim(regexp_replace(lower(p_type || ' / ' || p_brand), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part")
def slug(spark, sf):
    return b.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), tb.slug(F.concat("p_type", F.lit(" / "), "p_brand")).alias("slug"))


@query("SELECT o_orderkey AS run_id, trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '_', 'g'), '_') || '_' || row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS prefix FROM orders")
def run_prefixes(spark, sf):
    return tb.run_prefixes(b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("kind"), F.col("o_orderdate").alias("created")))


@query("""WITH a AS (SELECT 200 + (l_partkey % 50) * 1e0 AS mz, l_returnflag AS region, round(avg(l_quantity), 6) AS auc FROM lineitem GROUP BY 1, 2), base AS (SELECT 200 + n_nationkey * 2 + 0.0005e0 AS mz, n_name AS name FROM nation)
SELECT round(base.mz, 6) AS mz, name, max(auc) FILTER (region = 'A') AS "cmp.A.auc", max(auc) FILTER (region = 'N') AS "cmp.N.auc", max(auc) FILTER (region = 'R') AS "cmp.R.auc" FROM base LEFT JOIN a ON abs(a.mz - base.mz) <= base.mz * 5e0 / 1e6 GROUP BY base.mz, name""")
def attach_pivot(spark, sf):
    a = b.table(spark, sf, "lineitem").groupBy((200 + (F.col("l_partkey") % 50) * F.lit(1.0)).alias("mz"), F.col("l_returnflag").alias("region")).agg(F.round(F.avg("l_quantity"), 6).alias("auc"))
    base = b.table(spark, sf, "nation").select((200 + F.col("n_nationkey") * 2 + 0.0005).alias("mz"), F.col("n_name").alias("name"))
    return tb.attach(base, a, "cmp", "region").withColumn("mz", F.round("mz", 6))


_PEAKTAB = "pt AS (SELECT l_partkey AS mz, avg(l_quantity) FILTER (l_linestatus = 'F') AS a_mean, stddev_samp(l_quantity) FILTER (l_linestatus = 'F') AS a_sd, avg(l_quantity) FILTER (l_linestatus = 'O') AS b_mean, stddev_samp(l_quantity) FILTER (l_linestatus = 'O') AS b_sd FROM lineitem GROUP BY 1)"


def _peaktab(spark, sf):
    of = lambda f, s: f(F.when(F.col("l_linestatus") == s, F.col("l_quantity")))
    return b.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("mz")).agg(of(F.avg, "F").alias("a_mean"), of(F.stddev_samp, "F").alias("a_sd"), of(F.avg, "O").alias("b_mean"), of(F.stddev_samp, "O").alias("b_sd"))


@query(f"WITH {_PEAKTAB}, tau AS (SELECT quantile_cont(m, 0.05) AS tau FROM (SELECT a_mean AS m FROM pt UNION ALL SELECT b_mean FROM pt) WHERE m > 0) SELECT mz, round(CASE WHEN sqrt(a_sd * a_sd + b_sd * b_sd) > 0 THEN (b_mean - a_mean) / sqrt(a_sd * a_sd + b_sd * b_sd) END, 6) AS z, round(log2((b_mean + tau) / (a_mean + tau)), 6) AS log2_fc FROM pt, tau")
def binormal_auc_z(spark, sf):
    return b.rounded(tb.binormal(_peaktab(spark, sf)).select("mz", "z", "log2_fc"))


@query()
def binormal_auc(spark, sf):
    return b.rounded(tb.binormal_auc(_peaktab(spark, sf)).select("mz", "auc"))


_CAL = "c AS (SELECT p_brand AS analyte, p_size::DOUBLE AS x, p_retailprice / 100 AS y, 1e0 / p_size AS w FROM part WHERE p_size > 0), s AS (SELECT analyte, count(*) AS n, sum(w) AS w, sum(w * x) AS x, sum(w * y) AS y, sum(w * x * x) AS xx, sum(w * x * y) AS xy, sum(w * y * y) AS yy FROM c GROUP BY 1), f AS (SELECT *, (w * xy - x * y) / (w * xx - x * x) AS b FROM s), g AS (SELECT *, (y - b * x) / w AS a FROM f), h AS (SELECT *, yy - 2 * b * xy - 2 * a * y + b * b * xx + 2 * a * b * x + a * a * w AS sse FROM g)"


@query(f"WITH {_CAL} SELECT analyte, round(b, 5) AS slope, round(a, 5) AS intercept, round(1 - sse / (yy - y * y / w), 5) AS r2, round(CASE WHEN b > 0 AND n > 2 AND sse > 0 THEN 3.3e0 * sqrt(sse / (n - 2)) / b END, 4) AS lod, round(CASE WHEN b > 0 AND n > 2 AND sse > 0 THEN 10 * sqrt(sse / (n - 2)) / b END, 4) AS loq FROM h")
def calibration_fit(spark, sf):
    p = b.table(spark, sf, "part").where("p_size > 0").select(F.col("p_brand").alias("analyte"), F.col("p_size").cast("double").alias("concentration"), (F.col("p_retailprice") / 100).alias("response"))
    fit = tb.fit_calibration(p, "1/x", keys=["analyte"])
    return fit.select("analyte", *[F.round(c, d).alias(c) for c, d in (("slope", 5), ("intercept", 5), ("r2", 5), ("lod", 4), ("loq", 4))])


@query("WITH m AS (SELECT regr_slope(p_retailprice, p_size) AS s, regr_intercept(p_retailprice, p_size) AS i FROM part) SELECT s_suppkey AS id, round((s_acctbal - i) / s, 4) AS concentration, (s_acctbal - i) / s BETWEEN 1 - 49e-9 AND 50 + 49e-9 AS in_range FROM supplier, m")
def apply_calibration(spark, sf):
    model = tb.fit_calibration(b.table(spark, sf, "part").select(F.col("p_size").cast("double").alias("concentration"), F.col("p_retailprice").alias("response")))
    r = b.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("response"))
    return tb.apply_calibration(r, model, 1.0, 50.0).select("id", F.round("concentration", 4).alias("concentration"), "in_range")


@query(f"WITH {b.GRID}, m AS (SELECT l_orderkey % 25 + 0.2e0 AS x, l_orderkey // 25 % 20 + 0.1e0 AS y, l_linenumber AS feature, l_quantity AS value FROM lineitem) SELECT g.pixel_id, feature, round(avg(value), 6) AS value FROM m JOIN grid g ON g.x = floor(m.x + 0.5) AND g.y = floor(m.y + 0.5) WHERE sqrt((m.x - g.x) ** 2 + (m.y - g.y) ** 2) <= 0.5 GROUP BY 1, 2")
def resample_grid(spark, sf):
    m = b.table(spark, sf, "lineitem").select((F.col("l_orderkey") % 25 + 0.2).alias("x"), (F.floor(F.col("l_orderkey") / 25) % 20 + 0.1).alias("y"), F.col("l_linenumber").alias("feature"), F.col("l_quantity").alias("value"))
    return b.rounded(mm.resample(m, b.grid(spark, sf)))


def _halves(spark, sf):
    d = b.dense(spark, sf)
    return d.where("feature < 32").select("pixel_id", "feature", "v"), d.where("feature >= 32").select("pixel_id", "feature", "v")


@query(f"WITH {b.DENSE} SELECT a.feature AS fa, c.feature AS fb, round(corr(a.v, c.v), 6) AS score FROM dense a JOIN dense c ON a.pixel_id = c.pixel_id AND a.feature < 32 AND c.feature >= 32 GROUP BY 1, 2")
def cross_corr_pearson(spark, sf):
    return b.rounded(mm.cross_correlation(*_halves(spark, sf)))


@query(f"WITH {b.DENSE}, r AS (SELECT pixel_id, feature, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2e0 AS v FROM dense) SELECT a.feature AS fa, c.feature AS fb, round(corr(a.v, c.v), 6) AS score FROM r a JOIN r c ON a.pixel_id = c.pixel_id AND a.feature < 32 AND c.feature >= 32 GROUP BY 1, 2")
def cross_corr_spearman(spark, sf):
    return b.rounded(mm.cross_correlation(*_halves(spark, sf), "spearman"))


@query(f"WITH {b.GRID}, {b.DENSE} SELECT x // 2 + y // 2 * 100 + 1 AS cell_id, feature, round(avg(v), 6) AS value FROM grid JOIN dense USING (pixel_id) GROUP BY 1, 2")
def cell_matrix(spark, sf):
    g = b.grid(spark, sf)
    raster = g.select(F.col("y").alias("row"), F.col("x").alias("col"), (F.floor(F.col("x") / 2) + F.floor(F.col("y") / 2) * 100 + 1).alias("label"))
    w = mm.pixel_cells(g, raster, [[1.0, 0.0, 0.5], [0.0, 1.0, 0.5], [0.0, 0.0, 1.0]])
    return b.rounded(mm.cell_matrix(w, b.dense(spark, sf)))


@query(f"WITH {b.GRID} SELECT pixel_id, round(x * 0.8e0 - y * 0.6e0 + 3, 6) AS x, round(x * 0.6e0 + y * 0.8e0 - 2, 6) AS y FROM grid")
def warp_points(spark, sf):
    return b.rounded(mm.warp(b.grid(spark, sf), [[0.8, -0.6, 3.0], [0.6, 0.8, -2.0], [0.0, 0.0, 1.0]]))


_VOX = f"{b.GRID}, {b.DENSE}, vox AS (SELECT feature AS z, y, x, v FROM grid JOIN dense USING (pixel_id) WHERE feature < 8)"


def _voxels(spark, sf):
    return b.grid(spark, sf).join(b.dense(spark, sf).where("feature < 8"), "pixel_id").select(F.col("feature").alias("z"), "y", "x", "v")


@query(f"WITH {_VOX} SELECT y, x, round(max(v), 6) AS v FROM vox GROUP BY 1, 2")
def max_projection(spark, sf):
    return b.rounded(mm.projection(_voxels(spark, sf)))


@query(f"WITH {_VOX} SELECT y, x, round(v, 6) AS v FROM vox WHERE z = 3")
def orthoslice(spark, sf):
    return b.rounded(mm.orthoslice(_voxels(spark, sf), "z", 3))


@query(f"WITH {_VOX}, o AS (SELECT *, 0.5 * v / (SELECT max(v) FROM vox) AS op FROM vox), t AS (SELECT *, coalesce(exp(sum(ln(1 - op)) OVER (PARTITION BY y, x ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1e0) AS t FROM o) SELECT y, x, round(sum(v * op * t), 6) AS v FROM t GROUP BY 1, 2")
def alpha_composite(spark, sf):
    return b.rounded(mm.composite(_voxels(spark, sf)))


@query("WITH s AS (SELECT lower(replace(c_mktsegment, '\\', '/')) AS k, c_nationkey % 3 AS region, * FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY k, region ORDER BY c_custkey DESC) AS r FROM s) SELECT c_mktsegment AS source, region, c_custkey AS mtime FROM r WHERE r = 1")
def cohort_dedupe(spark, sf):
    c = b.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("source"), (F.col("c_nationkey") % 3).alias("region"), F.col("c_custkey").alias("mtime"), F.lit(None).cast("string").alias("grp"))
    return co.dedupe(c).select("source", "region", "mtime")


@query("SELECT p_partkey AS id, nullif(regexp_extract(p_name, '(\\d+)', 1), '') AS grp FROM part")
def cohort_group_by_pattern(spark, sf):
    return co.group_by_pattern(b.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("source")), r"(\d+)").select("id", "grp")


@query("WITH f AS (SELECT lower(s_name) AS n, min('/data/' || s_name) AS moved FROM supplier GROUP BY 1 HAVING count(*) = 1) SELECT 'C:\\old\\' || upper(s_name) AS source, moved FROM supplier LEFT JOIN f ON f.n = lower(s_name)")
def cohort_relocate(spark, sf):
    s = b.table(spark, sf, "supplier")
    return co.relocate(s.select(F.concat(F.lit("C:\\old\\"), F.upper("s_name")).alias("source")), s.select(F.concat(F.lit("/data/"), "s_name").alias("path")))


@query("SELECT 'C:\\data\\' || c_mktsegment || '/' || c_name AS source, c_mktsegment AS grp FROM customer")
def cohort_group_by_folder(spark, sf):
    c = b.table(spark, sf, "customer").select(F.concat(F.lit("C:\\data\\"), "c_mktsegment", F.lit("/"), "c_name").alias("source"))
    return co.group_by_folder(c)


@query("SELECT c_custkey AS sample_id, CASE WHEN c_nationkey % 3 = 0 THEN c_mktsegment ELSE 'old' END AS grp FROM customer")
def cohort_group_by_meta(spark, sf):
    meta = F.when(F.col("c_nationkey") % 3 == 0, F.create_map(F.lit("arm"), "c_mktsegment")).otherwise(F.expr("cast(map() as map<string, string>)"))
    return co.group_by_meta(b.table(spark, sf, "customer").select(F.col("c_custkey").alias("sample_id"), F.lit("old").alias("grp"), meta.alias("meta")), "arm").select("sample_id", "grp")


@query("""WITH n AS (SELECT c_custkey AS sample_id, c_mktsegment AS grp, (c_nationkey % 5)::VARCHAR AS batch FROM customer), l AS (SELECT DISTINCT grp AS level FROM n)
SELECT sample_id, batch, level, (grp = level)::INT::DOUBLE AS x FROM n JOIN l ON level > (SELECT min(level) FROM l)""")
def batch_design(spark, sf):
    return co.batch_design(b.table(spark, sf, "customer").select(F.col("c_custkey").alias("sample_id"), F.col("c_mktsegment").alias("grp"), (F.col("c_nationkey") % 5).alias("batch")))


@query(f"""WITH {b.DENSE}, r AS (SELECT vec_id AS pixel_id, label AS region FROM embeddings),
m AS (SELECT region, avg(v) FILTER (feature = 4) AS a, avg(v) FILTER (feature = 9) AS s FROM r JOIN dense USING (pixel_id) GROUP BY 1)
SELECT region, round(a / s, 6) AS response FROM m""")
def region_response(spark, sf):
    regions = b.table(spark, sf, "embeddings").select(F.col("vec_id").alias("pixel_id"), F.col("label").alias("region"))
    return b.rounded(tb.region_response(b.dense(spark, sf), regions, 4, 9))


@query()
def run_log_staleness(spark, sf):
    o = b.table(spark, sf, "orders")
    runs = o.select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("dataset"), F.col("o_orderstatus").alias("fingerprint"), F.struct("o_orderpriority").alias("inputs"))
    now = o.groupBy(F.col("o_custkey").alias("dataset")).agg(F.max("o_orderstatus").alias("fingerprint"), F.struct(F.max("o_orderpriority").alias("o_orderpriority")).alias("inputs"))
    return tb.stale_runs(runs, now)
