"""A log of analyses: one row a run, appended; payloads beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "run_id string, kind string, dataset string, fingerprint string, inputs string, created timestamp, status string"


class RunStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, runs: DataFrame) -> None:
        runs.select(*[c.split()[0] for c in SCHEMA.split(", ")]).write.mode("append").parquet(f"{self.path}/runs")

    def runs(self) -> DataFrame:
        """All runs, the newest first; a run that was written again counts as its last state."""
        got = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/runs")
        last = got.groupBy("run_id").agg(F.max_by(F.struct(*[c for c in got.columns if c != "run_id"]), "created").alias("s"))
        return last.select("run_id", "s.*").where("status <> 'deleted'").orderBy(F.desc("created"), "run_id")

    def delete(self, run_ids: list[str]) -> None:
        """Runs are marked, not rewritten: the log only grows."""
        self.append(self.runs().where(F.col("run_id").isin(run_ids)).withColumns({"status": F.lit("deleted"), "created": F.current_timestamp()}))

    def save(self, run_id: str, payload: DataFrame) -> None:
        payload.write.mode("overwrite").parquet(f"{self.path}/payloads/{run_id}")

    def load(self, run_id: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/payloads/{run_id}")
