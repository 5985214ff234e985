"""From raw documents to token ids: each stage reads what the one before has kept.

toxicity -> line dedup -> SimHash near-dedup -> mixing -> BPE.  All stages but the last return the columns of
documents.  Stages take null and empty texts, repeated rows and empty tables as the operators they call do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaikon.llm import bpe, lines, mixing, shared, simhash, toxicity
from mosaikon.llm.queries import WEIGHTS


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score under the threshold, as they are."""
    model = toxicity.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where("predicted = 0").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a smaller doc_id has too; a null text becomes an empty one."""
    done = lines.line_dedup(docs).withColumns({"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")})
    return done.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each near-duplicate class."""
    return simhash.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the fitted rates say, zero times included."""
    return mixing.mix(docs, WEIGHTS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and the text they decode to."""
    return bpe.encode(docs.select("doc_id", "text")).select("doc_id", "n_tokens", "ids", "decoded")


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("simhash_near_dedup", drop_near_copies), ("mixing", mix_sources), ("bpe", encode)]
#: The first stage learns and the fourth iterates, which SQL can't express; tests compare with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = shared.scratch(docs, name)
    return docs
