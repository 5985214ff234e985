"""Line deduplication: lines are hashed, documents counted per hash, repeated lines dropped, texts put together again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WHITE_CHARS, ascii_lower, named, scratch, unused


def line_dedup(docs: DataFrame, min_docs: int = 2, min_chars: int = 10) -> DataFrame:
    """docs -> docs with n_lines, n_dropped and kept_text beside their own columns.

    Lines are split at \\n.  A line's key is the line without white space at both ends, A-Z in lower case.  Keys of
    min_chars code points found in min_docs documents lose their lines except in the smallest doc_id holding them.
    A null or empty text is one empty line.  Rows that repeat a doc_id are one document to the count (for min_docs
    above 2, each row counts) and keep the same lines.  A null doc_id counts as the largest.  Columns of the input
    stay as they are, whatever their names, but for n_lines, n_dropped and kept_text (in any case), which are replaced.
    """
    own = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped", "kept_text")]
    docs = docs.select(*named(*own))
    d, v, flagged, lost = unused(docs, "__doc", "__version", "__flags", "__gone")
    text = F.coalesce("text", F.lit(""))
    doc, key = F.coalesce("doc_id", F.lit((1 << 63) - 1)), F.col("key")
    # btrim, not trim(): it takes the characters to strip
    split = docs.select(doc.alias("doc"), F.xxhash64(text).alias("version"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    keyed = split.select("doc", "version", "pos", F.btrim("line", F.lit(WHITE_CHARS)).alias("line")).where(F.char_length("line") >= min_chars)
    # two hashes of different seeds: 128 bits
    lines = scratch(
        keyed.select("doc", "version", "pos", ascii_lower(F.col("line")).alias("key")).select("doc", "version", "pos", F.xxhash64(key).alias("k1"), F.xxhash64(F.lit(7), key).alias("k2")),
        "lines",
    )
    counted = [F.min("doc").alias("owner"), F.max("doc").alias("last")]
    if min_docs > 2:
        counted.append(F.count("*").alias("n"))
        grouped = lines.select("doc", "version", "k1", "k2").distinct().groupBy("k1", "k2").agg(*counted).where(F.col("n") >= min_docs)
    else:
        grouped = lines.groupBy("k1", "k2").agg(*counted)
    repeated = scratch(grouped.where("owner < last").select("k1", "k2", "owner"), "repeated-lines")
    dropped = lines.join(repeated, ["k1", "k2"]).where("doc > owner").groupBy("doc", "version").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    # one flag a line up to the last dropped one, in as many steps
    before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get("gone", i - 1))
    flags = F.flatten(
        F.transform("gone", lambda at, i: F.concat(F.array_repeat(F.lit(False), at - before(i) - 1), F.array(F.lit(True))))
    )
    dropped = dropped.select("doc", "version", flags.alias("flags"), F.size("gone").alias("gone"))
    joined = docs.withColumns({d: doc, v: F.xxhash64(text)}).join(
        dropped.select(F.col("doc").alias(d), F.col("version").alias(v), F.col("flags").alias(flagged), F.col("gone").alias(lost)),
        [d, v], "left",
    )
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda line, i: ~F.coalesce(F.get(flagged, i), F.lit(False))), "\n")
    return joined.select(
        *named(*own),
        (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(lost, F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col(lost).isNull(), text).otherwise(kept).alias("kept_text"),
    )
