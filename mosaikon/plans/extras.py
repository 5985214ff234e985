"""More queries: trees of clusters, pooled samples, importance, rosters, target lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotation as an
from ..operators import cohort as co
from ..operators import explain as ex
from ..operators import multivariate as mv
from . import bindings as b
from .registry import query


@query()
def hierarchy_cut(spark, sf):
    labels, merges = mv.hierarchy(b.dense(spark, sf))
    return mv.labels_for(labels, merges, 5)


@query()
def joint_segmentation(spark, sf):
    return mv.joint_segments(b.dense(spark, sf).withColumn("sample", F.col("label") % 3).drop("label"), 4)


@query()
def smoothed_segmentation(spark, sf):
    return mv.smoothed_segments(b.dense(spark, sf), b.grid(spark, sf), 4)


@query(f"WITH {b.DENSE}, s AS (SELECT *, label % 3 AS sample FROM dense) SELECT sample, pixel_id, feature, round((v - avg(v) OVER w) / stddev_pop(v) OVER w, 6) AS v FROM s WINDOW w AS (PARTITION BY sample, feature)")
def standardised_samples(spark, sf):
    d = b.dense(spark, sf).withColumn("sample", F.col("label") % 3)
    return b.rounded(mv.standardised(d).select("sample", "pixel_id", "feature", "v"))


@query()
def pooled_embedding(spark, sf):
    d = mv.standardised(b.dense(spark, sf).withColumn("sample", F.col("label") % 3))
    return b.rounded(mv.pooled_pca(d.withColumn("v", F.col("v") + 10)).select("pixel_id", F.get("scores", F.lit(0)).alias("c1"), F.get("scores", F.lit(1)).alias("c2")))


@query()
def linear_importance(spark, sf):
    return b.rounded(ex.linear_shapley(b.dense(spark, sf)))


_IMP = "imp AS (SELECT l_suppkey % 6 AS donor, l_returnflag AS region, l_linenumber AS feature, avg(l_quantity) AS importance, sign(avg(l_discount) - 0.05) AS direction FROM lineitem GROUP BY ALL)"


def _importance(spark, sf):
    return b.table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 6).alias("donor"), F.col("l_returnflag").alias("region"), F.col("l_linenumber").alias("feature")).agg(F.avg("l_quantity").alias("importance"), F.signum(F.avg("l_discount") - 0.05).alias("direction"))


@query(f"WITH {_IMP} SELECT donor, region, feature, round(importance / sum(abs(importance)) OVER (PARTITION BY donor, region), 6) AS importance FROM imp")
def importance_l1(spark, sf):
    return b.rounded(ex.normalised(_importance(spark, sf)).select("donor", "region", "feature", "importance"))


@query(f"WITH {_IMP}, m AS (SELECT region, feature, avg(importance) AS mean, stddev_pop(importance) AS sd, row_number() OVER (PARTITION BY region ORDER BY round(avg(importance), 9) DESC, feature) AS r FROM imp GROUP BY 1, 2) SELECT region, feature, round(mean, 6) AS mean, round(sd, 6) AS sd, r::INT AS rank FROM m WHERE r <= 3")
def importance_bars(spark, sf):
    return b.rounded(ex.bars(_importance(spark, sf), 3).select("region", "feature", "mean", "sd", "rank"))


@query()
def batch_mixing(spark, sf):
    return b.rounded(co.batch_mixing(b.dense(spark, sf).select(F.col("pixel_id").alias("row_id"), "feature", F.col("label").alias("batch"), "v")))


@query("SELECT c_custkey AS id, lower(c_name) AS subject, list_extract(string_split_regex(c_mktsegment || ' zone ' || c_nationkey, '\\s+'), -1) AS compartment FROM customer")
def cohort_subjects(spark, sf):
    c = b.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.concat("c_mktsegment", F.lit(" zone "), F.col("c_nationkey").cast("string")).alias("region"), F.expr("cast(map() as map<string, string>)").alias("meta"))
    return co.subject_and_compartment(c).select("id", "subject", "compartment")


@query("SELECT c_custkey AS id, n_name AS nation FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey < 20")
def cohort_apply_metadata(spark, sf):
    c = b.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("name"), F.create_map(F.lit("a"), F.lit("1")).alias("meta"))
    n = b.table(spark, sf, "nation").where("n_nationkey < 20").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("name"), F.create_map(F.lit("nation"), F.col("n_name")).alias("meta"))
    return co.apply_metadata(c, n).select("id", F.try_element_at("meta", F.lit("nation")).alias("nation"))


@query(f"WITH {b.LIPIDS}, t AS (SELECT s_suppkey AS target_id, 210 + s_suppkey * 3.7e0 AS mz FROM supplier), m AS (SELECT target_id, neutral_mass, row_number() OVER (PARTITION BY target_id ORDER BY abs(neutral_mass - mz), neutral_mass) AS r FROM t JOIN lipids ON abs(neutral_mass - mz) <= mz * 300e0 / 1e6) SELECT t.target_id, round(coalesce(m.neutral_mass, t.mz), 6) AS mz FROM t LEFT JOIN m ON m.target_id = t.target_id AND r = 1")
def snap_targets(spark, sf):
    t = b.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("target_id"), (210 + F.col("s_suppkey") * 3.7).alias("mz"))
    return b.rounded(co.snap(t, b.lipids(spark, sf).select(F.col("neutral_mass").alias("ref_mz")), 300.0).select("target_id", "mz"))


@query("WITH a AS (SELECT 200 + s_suppkey * 3.1e0 AS mz, s_acctbal AS intensity FROM supplier), e AS (SELECT 200 + p_partkey * 0.7e0 AS mz, p_retailprice AS intensity FROM part) SELECT round(mz, 6) AS mz, round(intensity, 6) AS intensity FROM a UNION ALL SELECT round(mz, 6), round(intensity, 6) FROM e WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.mz BETWEEN e.mz - e.mz * 500e0 / 1e6 AND e.mz + e.mz * 500e0 / 1e6)")
def union_targets(spark, sf):
    a = b.table(spark, sf, "supplier").select((200 + F.col("s_suppkey") * 3.1).alias("mz"), F.col("s_acctbal").alias("intensity"))
    e = b.table(spark, sf, "part").select((200 + F.col("p_partkey") * 0.7).alias("mz"), F.col("p_retailprice").alias("intensity"))
    return b.rounded(co.union_targets(a, e, 500.0))


@query("""WITH t AS (SELECT p_partkey AS id, p_retailprice / 200 - 5 AS ppm, p_size / 50e0 AS isotope, p_partkey % 4 AS n, p_size / 10e0 AS lead, p_size > 20 AS ok FROM part),
s AS (SELECT *, 100 * (0.5 * greatest(0, least(1, 1 - abs(ppm) / 10)) + 0.22 * greatest(0, least(1, isotope)) + 0.16 * greatest(0, least(1, (n - 1) / 2e0)) + 0.12 * greatest(0, least(1, lead / 10))) AS c FROM t)
SELECT id, round(c, 6) AS confidence, CASE WHEN c >= 70 AND ok THEN 'High' WHEN c >= 45 THEN 'Medium' ELSE 'Low' END AS grade FROM s""")
def annotation_confidence(spark, sf):
    p = b.table(spark, sf, "part")
    t = p.select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 200 - 5).alias("ppm"), (F.col("p_size") / 50.0).alias("isotope"), (F.col("p_partkey") % 4).alias("n_adducts"), (F.col("p_size") / 10.0).alias("lead"), (F.col("p_size") > 20).alias("isotope_ok"))
    return b.rounded(an.confidence(t).select("id", "confidence", "grade"))
