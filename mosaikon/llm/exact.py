"""Exact deduplication behind a two-pass Bloom filter.

Pass one hashes every normalised text into a counting Bloom filter and keeps the cells that at least two rows
touch.  Pass two looks every row up: rows with an untouched cell have no twin and pass straight through; only the
others shuffle and are compared by their SHA-256.

The filter has 16 bits for each row, however many there are.  What is broadcast at a time is a filter of MOST_BITS: for
more rows than that holds, the hashes are dealt into ranges, and each range has both passes of its own over the keys.
A key is some 50 bytes of a row, so the ranges cost little beside the texts, which are read once.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WHITE, bit_blocks, bit_table, maybe, scratch

#: Bits of the filter of one range: 64 MB, for 33 million rows.
MOST_BITS = 1 << 29


def exact_dedup(docs: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """docs(doc_id, text) -> one row per row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after all characters of [\\x20\\x09-\\x0D] are deleted.  Of equal texts the row
    with the most code points in the original stays, then that of the smallest doc_id, a null one counting as the
    largest.  A null text is an empty one; empty texts equal each other.  Rows that repeat a doc_id, null too, each
    count in group_size, and are kept together if their doc_id stays; keep_id is null if that is null.  Columns other than doc_id and text are ignored; an empty table gives none.
    """
    text = F.coalesce("text", F.lit(""))
    keys = scratch(
        docs.select("doc_id", F.char_length(text).alias("n"), F.unhex(F.sha2(F.regexp_replace(text, f"{WHITE}+", "").cast("binary"), 256)).alias("sha")),
        "exact-keys",
    )
    n, h = keys.count(), F.xxhash64("sha")
    ranges = max(1, -(-16 * n // most_bits))
    blocks, parts = bit_blocks(-(-n // ranges), most_bits), []
    for k in range(ranges):
        own = keys if ranges == 1 else keys.where(F.pmod(F.xxhash64(F.lit(3), "sha"), F.lit(ranges)) == k)
        told = maybe(own, h, bit_table(own.select(h.alias("h")), blocks, 2), blocks)
        parts.append(told if ranges == 1 else scratch(told, "exact-range"))  # one broadcast at a time
    seen = functools.reduce(DataFrame.unionByName, parts)
    again = seen.where("__maybe").select("doc_id", "n", "sha")
    groups = scratch(
        again.groupBy("sha").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("none"), "doc_id")).alias("best"), F.count("*").alias("group_size"))
        .where("group_size > 1").select("sha", F.col("best.doc_id").alias("best_id"), "group_size"),
        "exact-groups",
    )
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("best_id"))
    met = again.join(groups, "sha", "left").select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), "sha")
    alone = seen.where("not __maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha")
    return alone.unionByName(met).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
