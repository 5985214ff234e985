"""Small helpers that the training-data operators share."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import scratch

#: The white space of every word and line rule here, as a Java regular expression.
WHITE = r"[\x20\x09-\x0D]"
#: The same characters, for trim().
WHITE_CHARS = " \t\n\x0b\x0c\r"
_WORD = re.compile(r"[^\W\d_]+")
#: What \w takes beside letters, digits and the underscore: numbers like \u00bd and \u2167.
_NUMBERS = frozenset(c for c in map(chr, range(0xA0, sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())


def letters(text: str) -> list[str]:
    """Runs of letters (general category L)."""
    if not text.isascii() and not _NUMBERS.isdisjoint(text):
        text = "".join([" " if c in _NUMBERS else c for c in text])
    return _WORD.findall(text)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def one_in(who: str, n: int):
    """Whether a row is of the sample of one in n values of `who`."""
    return F.pmod(F.xxhash64(F.lit(17), who), F.lit(n)) == 0


def dealt(rows: DataFrame, few: DataFrame, n: int, key: str, who: str, part: int) -> DataFrame:
    """rows with part_a, part_b, side: the rows of a key are to be compared in groups of about 2 * part at most.

    A key with more than `part` rows is dealt out by a hash of `who` into parts, and every pair of parts becomes a
    group; side says whether a row is of its group's first part (1), its second (0), or both are the same (2).  How
    many rows a key has is estimated from `few`, the rows of one in n values of `who`; that decides how large groups
    are, and never which rows meet.
    """
    counts = few.groupBy(key).agg((F.count("*") * n).alias("__n"))
    hot = scratch(counts.where(F.col("__n") > part).select(key, F.ceil(F.col("__n") / part).cast("int").alias("__parts")), "hot-keys")
    met, n = rows.join(hot, key, "left"), F.coalesce("__parts", F.lit(1))
    met = met.withColumn("__own", F.pmod(F.xxhash64(F.lit(18), who), n).cast("int")).withColumn("__other", F.explode(F.sequence(F.lit(0), n - 1)))
    own, other = F.col("__own"), F.col("__other")
    return met.select(
        *rows.columns, F.least(own, other).alias("part_a"), F.greatest(own, other).alias("part_b"),
        F.when(own == other, 2).otherwise((own < other).cast("int")).alias("side"),
    )


def whole_runs(batches: Iterator[pa.RecordBatch], keys: tuple) -> Iterator[pa.Table]:
    """Rows sorted by keys, cut between runs of equal ones only."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t])
        if not t.num_rows:
            continue
        same = np.ones(t.num_rows, bool)
        for c in keys:
            col = t.column(c).to_numpy()
            same &= col == col[-1]
        cut = t.num_rows - int(same[::-1].argmin() if not same.all() else t.num_rows)
        if cut:
            yield t.slice(0, cut)
        held = t.slice(cut)
    if held is not None and held.num_rows:
        yield held


def run_starts(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal rows begin, and how long they are."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    starts = np.flatnonzero(new)
    return starts, np.diff(np.r_[starts, len(new)])


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Texts may be long: hand them to Python in small Arrow batches, which Spark also ends at 64 MB."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def ascii_lower(col):
    """Lower-case A-Z only.  Texts of ASCII alone take the quick built-in."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def named(*columns: str) -> list:
    """Columns by their whole names, dots and all."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores put before those that df has in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def held_out(doc_id):
    """The documents no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def draw(known: DataFrame, key: str, n: int) -> DataFrame:
    """(key, doc_id) of up to n rows of each key, the first in the order of a hash of doc_id.

    Counts come first; with them a cut on the hash leaves about twice as many as are wanted, and only those are put in
    order, however many rows a key has.
    """
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    counts = known.groupBy(key).agg(F.count("*").alias("__n"))  # a row for each key
    near = known.select(key, "doc_id", h.alias("__h")).join(F.broadcast(counts), key).where(F.col("__h") < F.lit(float(1 << 30)) * (2 * n + 64) / F.col("__n"))
    w = Window.partitionBy(key).orderBy("__h", "doc_id")
    return near.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).select(key, "doc_id").distinct()


#: Bits of one block of a bit table, the size of Spark's bitmap aggregates.
BLOCK = 32768


def bit_blocks(n: int, most_bits: int) -> int:
    """Blocks of a bit table for n hashes: 16 bits for each, most_bits in all at most (one block at least)."""
    blocks = 1
    while blocks * BLOCK < min(16 * n, most_bits):
        blocks *= 2
    return blocks


def _place(h, blocks: int):
    low = F.lit(BLOCK - 1)
    return F.pmod(h, F.lit(blocks)).cast("int"), F.shiftrightunsigned(h, 31).bitwiseAND(low).cast("int"), F.shiftrightunsigned(h, 47).bitwiseAND(low).cast("int")


def bit_table(hashes: DataFrame, blocks: int, least: int = 1) -> DataFrame:
    """(block, bits) of hashes(h): a Bloom filter of two bits each, of the cells that `least` hashes touch."""
    block, b1, b2 = _place(F.col("h"), blocks)
    touched = hashes.select(block.alias("block"), F.explode(F.array_distinct(F.array(b1, b2))).alias("bit")).groupBy("block", "bit").agg(F.count("*").alias("n"))
    return scratch(touched.where(F.col("n") >= least).groupBy("block").agg(F.bitmap_construct_agg(F.col("bit").cast("long")).alias("bits")), "bits")


def maybe(df: DataFrame, h, table: DataFrame, blocks: int) -> DataFrame:
    """df with __maybe: false where the table can't hold h.  The table is broadcast: bit_blocks() bounds it."""
    def bit(at):
        byte = F.conv(F.hex(F.substring(F.col("bits"), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (at % 8).cast("int"))) != 0

    block, b1, b2 = _place(h, blocks)
    met = df.withColumns({"__b": block, "__1": b1, "__2": b2}).join(F.broadcast(table.withColumnRenamed("block", "__b")), "__b", "left")
    return met.withColumn("__maybe", F.coalesce(bit(F.col("__1")) & bit(F.col("__2")), F.lit(False))).select(*df.columns, "__maybe")


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser for 64-bit hashes (SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Of the links i-j among n nodes, the places of some that connect as much: n-1 at most."""
    label, left, chosen = np.arange(n), np.arange(len(i)), []
    while len(left):
        a, b = label[i[left]], label[j[left]]
        apart = a != b
        left, a, b = left[apart], a[apart], b[apart]
        if not len(left):
            break
        high, low = np.maximum(a, b), np.minimum(a, b)
        roots, first = np.unique(high, return_index=True)
        chosen.append(left[first])
        label[roots] = low[first]
        while True:
            nxt = label[label]
            if (nxt == label).all():
                break
            label = nxt
    return np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
