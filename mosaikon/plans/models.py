"""Queries that fit models; SQL can express few of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hierarchical as hi
from ..operators import multivariate as mv
from ..operators import regions as rg
from . import bindings as b
from .registry import query

_POOL = f"WITH {b.DENSE}, m AS (SELECT feature, count(*) FILTER (label = 0) AS na, count(*) FILTER (label = 1) AS nb, var_samp(v) FILTER (label = 0) AS va, var_samp(v) FILTER (label = 1) AS vb FROM dense WHERE label IN (0, 1) GROUP BY 1), p AS (SELECT feature, (na + nb - 2)::DOUBLE AS d, ((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) AS s2 FROM m)"


def _two(spark, sf):
    return b.dense(spark, sf).where(F.col("label").isin(0, 1)).select("feature", F.when(F.col("label") == 0, "A").otherwise("B").alias("grp"), "v")


@query(f"{_POOL} SELECT feature, round(s2, 9) AS s2, d FROM p")
def pooled_variance(spark, sf):
    return hi.pooled_variance(_two(spark, sf)).select("feature", F.round("s2", 9).alias("s2"), "d")


@query(f"{_POOL} SELECT feature, round((4 * 0.01e0 + d * s2) / (4 + d), 9) AS s2_post, d + 4 AS df FROM p")
def squeezed_variance(spark, sf):
    return hi.squeeze(hi.pooled_variance(_two(spark, sf)), 4.0, 0.01).select("feature", F.round("s2_post", 9).alias("s2_post"), "df")


@query()
def moderated_t(spark, sf):
    return b.rounded(hi.moderated_t(_two(spark, sf)).select("feature", "t", "df", "p_value", "q_value"))


def _nested(spark, sf):
    o, c = b.table(spark, sf, "orders"), b.table(spark, sf, "customer")
    both = o.join(c, o["o_custkey"] == c["c_custkey"]).where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    return both.groupBy(F.month("o_orderdate").cast("long").alias("feature"), F.col("c_custkey").alias("subject"), F.when(F.col("c_mktsegment") == "BUILDING", "A").otherwise("B").alias("grp"), F.col("o_orderstatus").alias("compartment")).agg(F.log2(F.avg("o_totalprice") + 1).alias("v"))


@query()
def stratified_comparison(spark, sf):
    return b.rounded(hi.stratified(_nested(spark, sf)).select("compartment", "feature", "auc", "p_value", "q_value"))


@query()
def nested_mixed_model(spark, sf):
    return b.rounded(hi.mixed_model(_nested(spark, sf)).select("feature", "term", "estimate", "se", "df", "p_value"))


@query()
def camera_classes(spark, sf):
    t = hi.moderated_t(_two(spark, sf)).select("feature", (F.col("feature") % 8).alias("class"), "t")
    return b.rounded(hi.camera(t))


@query()
def pca_scores(spark, sf):
    return b.rounded(mv.pca(b.dense(spark, sf))[0].select("pixel_id", F.posexplode("scores").alias("component", "score")))


@query()
def kmeans_segments(spark, sf):
    return mv.segment(b.dense(spark, sf))


@query()
def bisecting_segments(spark, sf):
    return mv.segment(b.dense(spark, sf), how="bisecting")


@query()
def auto_segments(spark, sf):
    d = b.dense(spark, sf)
    return mv.segment(d, mv.choose_k(d))


@query()
def nmf_scores(spark, sf):
    return b.rounded(mv.nmf(b.dense(spark, sf))[0].select("pixel_id", F.posexplode("w").alias("component", "w")))


@query()
def plsda_vip(spark, sf):
    _, _, vip = mv.pls(b.dense(spark, sf))
    return spark.createDataFrame([(k, round(float(v), 6)) for k, v in enumerate(vip)], "feature int, vip double")


@query(f"""WITH {b.DENSE}, l AS (SELECT pixel_id, label % 2 AS label, feature, ln(1 + v) AS v FROM dense), c AS (SELECT feature, avg(v) AS m, stddev_samp(v) AS s FROM l GROUP BY 1),
z AS MATERIALIZED (SELECT pixel_id, label, feature, (v - m) / s AS z FROM l JOIN c USING (feature)),
w0 AS (SELECT feature, sum(CASE label WHEN 1 THEN z ELSE -z END) AS w FROM z GROUP BY 1), w AS MATERIALIZED (SELECT feature, w / sqrt(sum(w * w) OVER ()) AS w FROM w0),
t AS MATERIALIZED (SELECT pixel_id, sum(z * w) AS t FROM z JOIN w USING (feature) GROUP BY 1), tt AS (SELECT sum(t * t) AS tt FROM t),
l0 AS MATERIALIZED (SELECT feature, sum(z * t) / any_value(tt) AS p FROM z JOIN t USING (pixel_id), tt GROUP BY 1),
o0 AS (SELECT feature, p - sum(p * w) OVER () * w AS o FROM l0 JOIN w USING (feature)), o AS MATERIALIZED (SELECT feature, o / sqrt(sum(o * o) OVER ()) AS o FROM o0),
u AS MATERIALIZED (SELECT pixel_id, sum(z * o) AS u FROM z JOIN o USING (feature) GROUP BY 1), uu AS (SELECT sum(u * u) AS uu FROM u),
away AS (SELECT feature, sum(z * u) / any_value(uu) AS p FROM z JOIN u USING (pixel_id), uu GROUP BY 1), part AS (SELECT sum(p * w) AS k FROM away JOIN w USING (feature))
SELECT pixel_id, round(t - k * u, 5) AS predictive, round(u, 5) AS orthogonal FROM t JOIN u USING (pixel_id), part""")
def opls_scores(spark, sf):
    """Odd labels against even ones, without what varies across both."""
    d = b.dense(spark, sf).withColumn("label", F.col("label") % 2)
    return b.rounded(mv.opls_scores(d, mv.opls(d)[1]).select("pixel_id", F.get("scores", F.lit(0)).alias("predictive"), F.get("scores", F.lit(1)).alias("orthogonal")), 5)


@query()
def cv_confusion(spark, sf):
    return mv.confusion(b.dense(spark, sf))


@query()
def coloc_modules(spark, sf):
    return spark.createDataFrame(mv.modules(rg.coloc_matrix(b.dense(spark, sf)), list(range(64))), "feature int, module int")


@query()
def spatial_mixture(spark, sf):
    return mv.two_level_mixture(b.dense(spark, sf).where("feature = 4"), b.grid(spark, sf))
