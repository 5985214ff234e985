"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has 64 bits and two link at RADIUS = 3 or fewer differing bits.  The bits fall into three blocks.
Three differing bits leave at least one block that holds one of them or more, so with that block set aside the
others differ in two bits at most, and a radius of two is halved exactly: every fingerprint emits, for each block
set aside, all variants of the other bits within distance one, and two fingerprints that link meet on a variant.
Rows are shuffled on variants, and those that meet are compared on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .shared import dealt, forest, mix64, one_in, run_starts, scratch, small_batches, whole_runs

RADIUS = 3
BLOCKS = ((0, 22), (22, 43), (43, 64))
#: Fingerprints compared at once: bounds memory, not partners.
STRIP = 2048
#: Fingerprints on one variant that one task compares: more are dealt out as pairs of such parts.  How many a variant
#: has is estimated from one fingerprint in SAMPLED.
PART, SAMPLED = 16_384, 64


def fingerprint(text: bytes) -> int:
    """SimHash over 3-word shingles, repeats included; 0 for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < 3:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined, sizes = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[:-2].tolist(), ends[2:].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << int(k) for k in np.flatnonzero(2 * ones > len(h)))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _version():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, version, fp (the 64 bits as a signed long); a null text is an empty one.

    version tells texts of one doc_id apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            fp = np.fromiter((fingerprint(t or b"") for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), _signed(fp)], ["doc_id", "version", "fp"])

    return docs.select("doc_id", "text", _version().alias("version")).mapInArrow(run, "doc_id long, version long, fp long")


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    one = np.uint64(1)
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for k, (low, high) in enumerate(BLOCKS):
            aside = np.uint64(((1 << (high - low)) - 1) << low)
            rest = fp & ~aside
            flips = [np.uint64(0)] + [one << np.uint64(i) for i in range(64) if not low <= i < high]
            for flip in flips:
                yield pa.RecordBatch.from_arrays([_signed(mix64((rest ^ flip) ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64))), _signed(fp)], ["variant", "fp"])


def _links_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among the distinct fingerprints that met on one variant: enough of them to connect all that link."""
    us, vs = [], []
    for a in range(0, len(fp), STRIP):
        for c in range(a, len(fp), STRIP):
            x, y = fp[a : a + STRIP], fp[c : c + STRIP]
            i, j = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= RADIUS)
            if a == c:
                i, j = i[i < j], j[i < j]
            keep = forest(i + a, j + c, len(fp))
            us.append(fp[i[keep] + a])
            vs.append(fp[j[keep] + c])
    return np.concatenate(us), np.concatenate(vs)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by variant and parts.  Small meetings are compared for all at once, large ones one by one."""
    for t in whole_runs(batches, ("variant", "part_a", "part_b")):
        fp = t.column("fp").to_numpy().view(np.uint64)
        starts, sizes = run_starts(*(t.column(c).to_numpy() for c in ("variant", "part_a", "part_b")))
        run, inside, pairs = np.repeat(np.arange(len(starts)), sizes), np.repeat(sizes <= 16, sizes), []
        for step in range(1, 16):
            i = np.flatnonzero((run[step:] == run[:-step]) & inside[step:])
            i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= RADIUS]
            pairs.append((fp[i], fp[i + step]))
        for s, n in zip(starts[sizes > 16], sizes[sizes > 16], strict=True):
            pairs.append(_links_of(np.unique(fp[s : s + n])))
        u, v = (np.concatenate(x) for x in zip(*pairs, strict=True))
        u, v = np.minimum(u, v), np.maximum(u, v)
        found = np.unique(np.stack([u[u != v], v[u != v]]), axis=1)
        if found.shape[1]:
            yield pa.RecordBatch.from_arrays([_signed(found[0].copy()), _signed(found[1].copy())], ["u", "v"])


def links_between(distinct: DataFrame) -> DataFrame:
    """distinct(fp) -> (u, v): links enough to connect all fingerprints that link."""
    variants = lambda df: df.mapInArrow(_variants, "variant long, fp long")
    met = dealt(variants(distinct), variants(distinct.where(one_in("fp", SAMPLED))), SAMPLED, "variant", "fp", PART).select("variant", "fp", "part_a", "part_b")
    keys = ["variant", "part_a", "part_b"]
    return met.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_meet, "u long, v long")


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all rows, and a row for each distinct one: fp, first (its least doc_id), component."""
    spark = docs.sparkSession
    small_batches(spark)
    prints = scratch(fingerprints(docs), "prints")
    distinct = scratch(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-prints")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
    links = links_between(distinct.select("fp"))
    found = components(links).select(F.col("node").alias("fp"), "component")
    return prints, distinct.join(found, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fingerprint (16 hex digits), component_id, one row per row of docs.

    component_id is the least doc_id reachable over links, null where no row of the class has one.  Texts without
    words (null, empty, white space) have fingerprint zero and link like any other; equal fingerprints always link,
    so only distinct ones are hashed and compared.  Rows that repeat a doc_id are rows of their own.  Other columns
    are ignored; an empty table gives none.
    """
    prints, classes = _classes(docs)
    least = classes.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = scratch(classes.join(least, "component").select("fp", "component_id"), "print-classes")
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents that are the first of their class, with all their columns.

    First is the text of the smallest doc_id; a null doc_id counts as the largest.  Of several texts of that doc_id in
    one class the one with the least hash is first.  Each text is kept or not by its own class, whatever happens to
    other texts of its doc_id.  Rows that repeat a doc_id and its text are one document and stay together, those
    with a null doc_id too.
    """
    prints, classes = _classes(docs)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "version")
    # first by fingerprint, then by class: a row for each distinct fingerprint goes on
    by_print = prints.groupBy("fp").agg(F.min(order).alias("head"))
    heads = by_print.join(classes.select("fp", "component"), "fp").groupBy("component").agg(F.min("head").alias("head"))
    heads = scratch(heads.select(F.col("head.doc_id").alias("__first"), F.col("head.version").alias("__version")), "heads")
    return docs.join(heads, docs["doc_id"].eqNullSafe(heads["__first"]) & (_version() == heads["__version"]), "left_semi")
