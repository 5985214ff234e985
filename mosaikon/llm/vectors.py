"""Embedding near-duplicates by Euclidean p-stable hashing.

Vectors are brought to length one; there cosine c is the distance sqrt(2 - 2c).  A table's hash of a vector is a number
of quantised projections floor((a.x + b) / WIDTH), a being normal and b uniform.  tables() takes so many projections
that a bucket holds few vectors at random, and so many tables that two vectors of cosine 0.9 exactly share a bucket
with probability RECALL; 0.95 and more share one almost surely.

Vectors themselves don't travel to their buckets.  What does is an id and a sketch of 128 signs of other projections:

1. in each bucket, sketches tell which members may be near one (a pair of cosine 0.9 passes all but surely);
2. components of such pairs tell how vectors travel: to one task for a component of at most PART, else bucket by bucket.

Either way the pairs are the same: those that share a bucket and whose sketches are near, each counted once.  Cosines in
double precision decide.  Large buckets are dealt out as pairs of parts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .shared import dealt, forest, mix64, one_in, run_starts, scratch, whole_runs

COSINE, WIDTH, SEED = 0.9, 2.0, 11
#: The part of pairs at COSINE exactly that share a bucket, and how many vectors share one at random.
RECALL, CROWD = 0.975, 64
#: Signs of 128 that may differ: 36 is 4.5 deviations above the mean of a pair at cosine 0.9, and 4.9 below that of a random one.
SIGNS = 36
#: Members of a bucket that are compared in one task: more are dealt out as pairs of such parts.
#: A component of at most as many is fetched whole, which changes what travels and not which pairs are found.
PART = 2048
#: Bucket sizes are estimated from one vector in so many.
SAMPLED = 64


def _agree(distance: float) -> float:
    """P(two vectors so far apart have the same quantised projection)."""
    r = WIDTH / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def tables(n: int) -> tuple[int, int]:
    """(projections of a hash, tables) for n vectors."""
    hashes = max(6, math.ceil(math.log(max(1, n) / CROWD) / -math.log(_agree(math.sqrt(2)))))
    return hashes, math.ceil(math.log(1 - RECALL) / math.log(1 - _agree(math.sqrt(2 - 2 * COSINE)) ** hashes))


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _buckets(x: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """One 64-bit bucket for each vector and table; it holds the table's number."""
    hashes, n = size
    rng = np.random.default_rng(SEED + x.shape[1])
    a, b = rng.standard_normal((x.shape[1], n * hashes)), rng.uniform(0, WIDTH, n * hashes)
    h = np.full((len(x), n), x.shape[1], np.uint64) + (np.arange(n, dtype=np.uint64) << np.uint64(32))
    for k in range(hashes):  # one projection of every table at a time
        cells = np.floor((x @ a[:, k::hashes] + b[k::hashes]) / WIDTH).astype(np.int64).view(np.uint64)
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + cells)
    return h


def _signs(x: np.ndarray) -> np.ndarray:
    """Two 64-bit sketches of each vector."""
    a = np.random.default_rng(SEED + 1 + x.shape[1]).standard_normal((x.shape[1], 128))
    return np.packbits(x @ a > 0, axis=1).view(np.uint64)


def _by_size(t: pa.Table) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    raw = t.column("raw").to_pylist()
    sizes = np.array([len(r) for r in raw])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, [raw[k] for k in at]


def _hash(kind: str, size: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            for at, own in _by_size(t):
                x = _unit(own, kind)
                h, signs, rep = _buckets(x, size), _signs(x), t.column("rep").to_numpy()[at]
                for k in range(h.shape[1]):
                    cols = [h[:, k].copy().view(np.int64), rep, signs[:, 0].copy().view(np.int64), signs[:, 1].copy().view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["bucket", "rep", "s1", "s2"])

    return run


def _pairs(starts: np.ndarray, sizes: np.ndarray, side: np.ndarray, near) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places i < j of near rows of one run, some at a time; where a run has two parts, across them only."""
    small = np.repeat(sizes <= 8, sizes)
    run = np.repeat(np.arange(len(starts)), sizes)
    for step in range(1, 8):
        i = np.flatnonzero((run[step:] == run[:-step]) & small[step:])
        i = i[(side[i] == 2) | (side[i] != side[i + step])]
        if len(i):
            i = i[near(i, i + step)]
            yield i, i + step
    for s, n in zip(starts[sizes > 8], sizes[sizes > 8], strict=True):
        for a in range(s, s + n, 64):
            i, j = np.nonzero(near(slice(a, min(a + 64, s + n)), slice(s, s + n)))
            i, j = i + a, j + s
            fine = (i < j) & ((side[i] == 2) | (side[i] != side[j]))
            yield i[fine], j[fine]


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by bucket and parts: members that may be near another go out, and links u - v that connect them."""
    for t in whole_runs(batches, ("bucket", "part_a", "part_b")):
        bucket, pa_, pb, side, rep = (t.column(c).to_numpy() for c in ("bucket", "part_a", "part_b", "side", "rep"))
        s = np.stack([t.column(c).to_numpy().view(np.uint64) for c in ("s1", "s2")], 1)

        def near(i, j):
            x, y = s[i], s[j]  # noqa: B023
            if isinstance(i, slice):
                x, y = x[:, None, :], y[None, :, :]
            return np.bitwise_count(x ^ y).sum(-1, dtype=np.int16) <= SIGNS

        on, us, vs = np.zeros(len(rep), bool), [], []
        for i, j in _pairs(*run_starts(bucket, pa_, pb), side, near):
            on[i] = on[j] = True
            keep = forest(i, j, len(rep))
            us.append(i[keep])
            vs.append(j[keep])
        at = np.flatnonzero(on)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(c[at]) for c in (bucket, pa_, pb, side, rep)] + [pa.nulls(len(at), pa.int64())], ["bucket", "part_a", "part_b", "side", "u", "v"])
            u, v = rep[np.concatenate(us)], rep[np.concatenate(vs)]
            n = len(u)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), *[pa.nulls(n, pa.int32())] * 3, pa.array(u), pa.array(v)], ["bucket", "part_a", "part_b", "side", "u", "v"])


def _compare(kind: str, size: tuple[int, int]):
    """Sorted by group and parts: (u, links) counts links by cosine, (u, v) are links that connect as much.

    A group is a component, or one bucket of a large component.  A pair counts if it shares a bucket and its sketches are
    near, wherever it is met; in a bucket of a large component only if that is the first of its buckets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs(batches, ("whole", "g", "part_a", "part_b")):
            for at, own in _by_size(t):
                whole, g, pa_, pb, side, rep, mult = (t.column(c).to_numpy()[at] for c in ("whole", "g", "part_a", "part_b", "side", "rep", "mult"))
                x = _unit(own, kind)
                h, signs = _buckets(x, size).view(np.int64), _signs(x)
                links, us, vs = np.zeros(len(rep), np.int64), [], []

                def near(i, j):
                    return (np.einsum("ij,ij->i", x[i], x[j]) if not isinstance(i, slice) else x[i] @ x[j].T) >= COSINE  # noqa: B023

                for i, j in _pairs(*run_starts(whole, g, pa_, pb), side, near):
                    fine = np.bitwise_count(signs[i] ^ signs[j]).sum(1, dtype=int) <= SIGNS
                    i, j = i[fine], j[fine]
                    same = h[i] == h[j]
                    fine = same.any(1) & (whole[i] | (h[i, same.argmax(1)] == g[i]))
                    i, j = i[fine], j[fine]
                    np.add.at(links, i, mult[j])
                    np.add.at(links, j, mult[i])
                    keep = forest(i, j, len(rep))
                    us.append(i[keep])
                    vs.append(j[keep])
                got = np.flatnonzero(links)
                if len(got):
                    u, v = rep[np.concatenate(us)], rep[np.concatenate(vs)]
                    yield pa.RecordBatch.from_arrays([pa.array(rep[got]), pa.array(links[got]), pa.nulls(len(got), pa.int64())], ["u", "links", "v"])
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.nulls(len(u), pa.int64()), pa.array(v)], ["u", "links", "v"])

    return run


def near_vectors(vectors: DataFrame) -> DataFrame:
    """vectors(vec_id, embedding) -> vec_id, n_links, component_id, kept: one row per row.

    n_links counts the other rows with cosine >= 0.9; component_id is the least vec_id reachable over links.  Null
    and zero vectors, and those with null or non-finite components, link with nothing and are components of their
    own, as are vectors of different lengths to one another.  Rows that repeat a vec_id count each.  Equal vectors
    are compared once and counted as often as they occur.  Other columns are ignored; an empty table gives none.
    """
    spark = vectors.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    single = vectors.schema["embedding"].dataType.elementType.typeName() == "float"
    kind = "<f4" if single else "<f8"
    v = vectors.select("vec_id", "embedding", F.col("embedding").cast("array<double>").alias("x"))
    finite = F.size("x") > 0
    finite &= F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("x", lambda c: c != 0)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [np.asarray(r, kind) for r in b.column(1).to_pylist()]
            # large components of double precision mustn't overflow; + 0.0 makes -0.0 equal 0.0
            raw = [((r if single else r / np.abs(r).max()) + r.dtype.type(0)).tobytes() if len(r) else b"" for r in x]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], ["vec_id", "raw"])

    good = scratch(v.where(F.coalesce(finite, F.lit(False))).select("vec_id", "embedding").mapInArrow(pack, "vec_id long, raw binary").withColumn("k1", F.xxhash64("raw")).withColumn("k2", F.xxhash64(F.lit(7), "raw")), "vectors")
    distinct = scratch(
        good.groupBy("k1", "k2").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("mult"), F.min("raw").alias("raw")).withColumn("rep", F.monotonically_increasing_id()), "distinct-vectors"
    )
    size = tables(distinct.count())
    hashed = lambda df: df.select("rep", "raw").mapInArrow(_hash(kind, size), "bucket long, rep long, s1 long, s2 long")
    keys = ["bucket", "part_a", "part_b"]
    met = dealt(hashed(distinct), hashed(distinct.where(one_in("rep", SAMPLED))), SAMPLED, "bucket", "rep", PART)
    near = scratch(met.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_sketched, "bucket long, part_a int, part_b int, side int, u long, v long"), "near-vectors")
    groups = components(near.where("v is not null").select("u", "v"))
    sizes = groups.groupBy("component").agg(F.count("*").alias("n"))
    groups = scratch(groups.join(sizes, "component"), "vector-groups")
    whole = groups.where(F.col("n") <= PART).select(F.lit(True).alias("whole"), F.col("component").alias("g"), F.lit(0).alias("part_a"), F.lit(0).alias("part_b"), F.lit(2).alias("side"), F.col("node").alias("rep"))
    large = groups.where(F.col("n") > PART).select(F.col("node").alias("u"))
    split = near.where("v is null").join(large, "u").select(F.lit(False).alias("whole"), F.col("bucket").alias("g"), "part_a", "part_b", "side", F.col("u").alias("rep"))
    keys = ["whole", "g", "part_a", "part_b"]
    fetched = whole.unionByName(split).join(distinct.select("rep", "mult", "raw"), "rep").repartition(*keys).sortWithinPartitions(*keys)
    links = scratch(fetched.mapInArrow(_compare(kind, size), "u long, links long, v long"), "vector-links")
    found = components(links.where("v is not null").select("u", "v"))
    counts = links.where("v is null").groupBy("u").agg(F.sum("links").alias("links"))
    # components are of numbers of distinct vectors: each takes the least vec_id in it
    classes = scratch(
        distinct.select("k1", "k2", "rep", "vec_id", "mult").join(counts, distinct["rep"] == counts["u"], "left").join(found, distinct["rep"] == found["node"], "left")
        .select("k1", "k2", "vec_id", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("class")),
        "vector-classes",
    )
    least = classes.groupBy("class").agg(F.min("vec_id").alias("component_id"))
    linked = good.select("vec_id", "k1", "k2").join(classes.join(least, "class").select("k1", "k2", "n_links", "component_id"), ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    odd = v.where(~F.coalesce(finite, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(odd).select("*", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
