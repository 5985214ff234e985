"""The engine's tables as views of the test tables, the same in Spark and in SQL.

peaks      lineitem:   an order is a pixel, a part an m/z, the quantity an intensity
dense      embeddings: a vector is a pixel of a grid 25 wide, its 64 positions are bins, the label a region
lipids     part:       a part is a compound, its brand the class
samples    customers' orders by priority, for cohorts
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def peaks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("pixel_id"), (200 + F.col("l_partkey") * 0.25).alias("mz"), F.col("l_quantity").alias("intensity"),
        F.col("l_returnflag").alias("region"), (F.col("l_suppkey") % 6).alias("sample"),
    )


def dense(spark: SparkSession, sf: str) -> DataFrame:
    cells = table(spark, sf, "embeddings").select(F.col("vec_id").alias("pixel_id"), "label", F.posexplode("embedding").alias("feature", "e"))
    return cells.select("pixel_id", "label", "feature", F.abs("e").cast("double").alias("v"))


def grid(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("pixel_id"), (F.col("vec_id") % 25).alias("x"), F.floor(F.col("vec_id") / 25).alias("y"))


def lipids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("class"), (200 + F.col("p_partkey") * 0.25).alias("neutral_mass"), (F.col("p_size") / 100.0).alias("prior"), F.col("p_partkey").alias("lipid_id"))


def cohort(spark: SparkSession, sf: str) -> DataFrame:
    """(sample_id, grp, compartment, feature, value): customers are samples, price by priority and month."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy(
        F.col("c_custkey").alias("sample_id"), F.col("c_mktsegment").alias("grp"), (F.col("c_nationkey") % 5).alias("batch"), F.month("o_orderdate").alias("feature")
    ).agg(F.avg("o_totalprice").alias("value"))


#: The same views for DuckDB, to put after WITH.
PEAKS = "peaks AS (SELECT l_orderkey AS pixel_id, 200 + l_partkey * 0.25e0 AS mz, l_quantity AS intensity, l_returnflag AS region, l_suppkey % 6 AS sample FROM lineitem)"
DENSE = "dense AS (SELECT vec_id AS pixel_id, label, unnest(range(len(embedding)))::INT AS feature, abs(unnest(embedding))::DOUBLE AS v FROM embeddings)"
GRID = "grid AS (SELECT vec_id AS pixel_id, vec_id % 25 AS x, vec_id // 25 AS y FROM embeddings)"
LIPIDS = "lipids AS (SELECT p_name AS name, p_brand AS class, 200 + p_partkey * 0.25e0 AS neutral_mass, p_size / 100e0 AS prior, p_partkey AS lipid_id FROM part)"
COHORT = "cohort AS (SELECT c_custkey AS sample_id, c_mktsegment AS grp, c_nationkey % 5 AS batch, month(o_orderdate)::INT AS feature, avg(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"
#: Targets that are asked for by name in the queries on peaks: 20 m/z across the range.
TARGETS = [200.0 + 25 * k for k in range(20)]
TARGETS_SQL = "targets AS (SELECT k::INT AS feature_id, 200e0 + 25 * k AS target_mz FROM range(20) t(k))"


def targets(spark: SparkSession) -> DataFrame:
    return spark.range(20).select(F.col("id").cast("int").alias("feature_id"), (200 + 25.0 * F.col("id")).alias("target_mz"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Sums come in another order from run to run: what is compared is rounded."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])
