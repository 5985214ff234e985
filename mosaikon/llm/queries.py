"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _sha(col):
    return F.sha2(F.coalesce(col, F.lit("")).cast("binary"), 256)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A domain is a language (documents.lang).  What part each should have of the tokens that other languages leave.
WEIGHTS = {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixing_rates

    done = mixing_rates(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), WEIGHTS)
    return done.select("doc_id", "domain", "posterior", "n_tokens", "rate", "residual", "converged")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import substring_dedup

    done = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", _sha(F.col("kept_text")).alias("kept_sha256"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import line_dedup

    done = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", _sha(F.col("kept_text")).alias("kept_sha256"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectors import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode

    done = encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), _sha(F.col("decoded")).alias("decoded_sha256"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit, predict
    from .shared import held_out

    docs = table(spark, sf_dir, "documents")
    done = predict(docs.select("doc_id", "text"), fit(docs.select("doc_id", "lang", "text")))
    return done.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shared import held_out
    from .toxicity import fit, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return done.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract

    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .search import search

    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import scores

    return scores(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .variants import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_source_mixing, op2_substring_dedup, op3_simhash_near_dedup, op4_line_dedup, op5_embedding_near_dedup, op6_bpe, op7_language_id, op8_toxicity, op9_html_extraction, op10_exact_dedup, op11_ranked_search, op12_lm_scoring, op13_spelling_variants)}
