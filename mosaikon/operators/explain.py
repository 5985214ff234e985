"""Which ions speak for a region: exact Shapley values of a linear model, one region against the rest.

For a linear model the Shapley value of a feature is its weight times its distance from the mean, so importance and
direction are aggregates.  The method is named in the result: these aren't the values of a tree ensemble.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .multivariate import scaled


def linear_shapley(dense: DataFrame, reg: float = 0.01) -> DataFrame:
    """region, feature (its place), importance (mean of |phi|), direction, method."""
    z = scaled(dense, "label")
    labels = sorted(r["label"] for r in z.select("label").distinct().collect())
    spread = z.select(F.posexplode(vector_to_array("z")).alias("feature", "x")).groupBy("feature").agg(F.avg(F.abs("x")).alias("a"))
    out = None
    for c in labels:
        y = z.withColumn("y", (F.col("label") == c).cast("double"))
        w = LogisticRegression(featuresCol="z", labelCol="y", regParam=reg, standardization=False).fit(y).coefficients.toArray()
        weights = F.array(*[F.lit(float(x)) for x in w])
        phi = spread.select(F.lit(c).alias("region"), "feature", (F.abs(F.get(weights, F.col("feature"))) * F.col("a")).alias("importance"), F.signum(F.get(weights, F.col("feature"))).alias("direction"), F.lit("linear").alias("method"))
        out = phi if out is None else out.unionByName(phi)
    return out


def normalised(table: DataFrame, how: str = "l1") -> DataFrame:
    """importance over the sum (l1) or largest (max) of its donor and region; zero where that is zero."""
    w = Window.partitionBy("donor", "region")
    base = F.sum(F.abs("importance")).over(w) if how == "l1" else F.max(F.abs("importance")).over(w)
    return table.withColumn("importance", F.when(base > 0, F.col("importance") / base).otherwise(0.0)) if how != "none" else table


def bars(table: DataFrame, top: int) -> DataFrame:
    """region, feature, mean, sd (over n), direction over donors, rank: the top features of each region."""
    m = table.groupBy("region", "feature").agg(F.avg("importance").alias("mean"), F.stddev_pop("importance").alias("sd"), F.avg("direction").alias("direction"))
    w = Window.partitionBy("region").orderBy(F.desc(F.round("mean", 9)), "feature")
    return m.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
