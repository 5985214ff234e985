"""Nearest neighbours of many points by neighbour descent, and a layout of their graph on a plane.

points(pixel_id, x) has an array of numbers for each point.  knn_graph() starts from groups of points that random planes
leave together, then lets neighbours of one point meet, round after round: who is near a common neighbour is likely
near.  A round is one join of the links with the points, one list a point (at most twice k), and a cut to the k nearest, which
starts before the shuffle.  layout() draws each point towards its neighbours and away from points taken by hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import discard, scratch
from .graph import numbered
from .multivariate import scaled

#: Points of a group compared with each other at the start, and how often points are grouped.
GROUP, TABLES = 64, 4
#: Lists that meet at a time: what they find is as many links as their pairs.
LISTS = 256
#: Rounds of descent at most; they end when fewer than this share of all links is new.
ROUNDS, STILL = 12, 0.002
#: Points that exact_neighbours() takes at a time: what each task is told.
BLOCK = 512
#: The layout's shape for points that may come as near as 0.1, and points each is kept away from in a round.
A, B, AWAY = 1.577, 0.8951, 10
#: Rounds of the layout, in which neighbours are looked up anew, and steps of a point in each.
LAYOUT_ROUNDS, STEPS = 20, 5


def _matrix(column: pa.Array, kind=np.float32) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances.  Sums of differences: equal points have distance zero exactly."""
    return ((x[:, None, :] - y[None, :, :]).astype(np.float64) ** 2).sum(-1)


def _links(ids: np.ndarray, d: np.ndarray, keep: np.ndarray) -> pa.RecordBatch:
    i, j = np.nonzero(keep)
    return pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j]), pa.array(d[i, j])], ["u", "v", "d"])


def _start(points: DataFrame, n: int, k: int, table: int) -> DataFrame:
    """(u, v, d) of the k nearest in groups of about GROUP points on the same side of random planes."""
    bits, dims = max(1, int(n // GROUP).bit_length()), F.size("x")

    def along(j: int):
        weight = lambda i: (F.pmod(F.xxhash64(F.lit(table), F.lit(j), i), F.lit(2001)) - 1000) / 1000.0
        return F.aggregate(F.zip_with("x", F.sequence(F.lit(1), dims), lambda a, i: a * weight(i)), F.lit(0.0), lambda s, a: s + a)

    side = F.concat(*[F.when(along(j) > 0, "1").otherwise("0") for j in range(bits)])
    put = points.withColumns({"side": side, "at": along(bits)}).repartitionByRange("side", "at", "pixel_id").sortWithinPartitions("side", "at", "pixel_id").select("pixel_id", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        def out(t: pa.Table) -> pa.RecordBatch:
            ids, x = t["pixel_id"].to_numpy(), _matrix(t["x"].combine_chunks())
            d = _squares(x, x)
            np.fill_diagonal(d, np.inf)
            place = np.argsort(np.argsort(d, axis=1, kind="stable"), axis=1)
            return _links(ids, d, (place < k) & np.isfinite(d))

        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            while held.num_rows >= 2 * GROUP:
                yield out(held.slice(0, GROUP))
                held = held.slice(GROUP)
        if held is not None and held.num_rows:
            yield out(held)

    return put.mapInArrow(run, "u long, v long, d double")


def _cut(links: DataFrame, k: int) -> DataFrame:
    """The k nearest of each u; of equal ones the smaller v."""
    once = links.groupBy("u", "v").agg(F.min("d").alias("d"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("u").orderBy("d", "v"))).where(F.col("rank") <= k)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of points that share a neighbour: the links among them that are nearer than a member's farthest."""
    for b in batches:
        for at in range(0, b.num_rows, LISTS):
            lists = b.column("near").slice(at, LISTS)
            members, cuts = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            ids, most, x = members.field("v").to_numpy(), members.field("most").to_numpy(), _matrix(members.field("x"))
            found = []
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if e - s > 1:
                    d = _squares(x[s:e], x[s:e])
                    keep = (d < most[s:e, None]) & (ids[s:e, None] != ids[None, s:e])
                    if keep.any():
                        found.append(_links(ids[s:e], d, keep))
            if found:
                yield pa.Table.from_batches(found).combine_chunks().to_batches()[0]


def usable(points: DataFrame) -> DataFrame:
    """points with an id and finite numbers only, as floats, each id once."""
    fine = F.col("pixel_id").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return points.where(fine).groupBy(F.col("pixel_id").cast("long").alias("pixel_id")).agg(F.min(F.col("x").cast("array<float>")).alias("x"))


def knn_graph(points: DataFrame, k: int = 15, rounds: int = ROUNDS) -> DataFrame:
    """points(pixel_id, x) -> pixel_id, neighbour, rank (from 1), distance: about the k nearest other points of each.

    Points without an id or with a number that is null or not finite are left out, all others are there; of rows that
    repeat an id one counts.  Fewer than k + 1 points have all others as neighbours; an empty table gives none.
    """
    points = scratch(usable(points), "points")
    n = points.count()
    links = _start(points, n, k, 0)
    for t in range(1, TABLES):
        links = links.unionByName(_start(points, n, k, t))
    graph = scratch(_cut(links, k), "graph")
    for r in range(rounds):
        most = graph.groupBy(F.col("u").alias("v")).agg(F.when(F.count("*") >= k, F.max("d")).otherwise(F.lit(float("inf"))).alias("most"))
        nodes = points.withColumnRenamed("pixel_id", "v").join(most, "v", "left").withColumn("most", F.coalesce("most", F.lit(float("inf"))))
        back = graph.select(F.col("v").alias("u"), F.col("u").alias("v"))
        by_chance = Window.partitionBy("u").orderBy(F.xxhash64(F.lit(r), "v"), "v")
        back = back.withColumn("r", F.row_number().over(by_chance)).where(F.col("r") <= k).select("u", "v")
        both = graph.select("u", "v").unionByName(back).distinct()
        lists = both.join(nodes, "v").groupBy("u").agg(F.collect_list(F.struct("v", "most", "x")).alias("near")).select("near")
        found = lists.mapInArrow(_meet, "u long, v long, d double")
        before, graph = graph, scratch(_cut(graph.select("u", "v", "d").unionByName(found), k), "graph")
        new = graph.join(before, ["u", "v"], "left_anti").count()
        discard(before)
        if new <= STILL * n * k:
            break
    discard(points)
    return graph.select(F.col("u").alias("pixel_id"), F.col("v").alias("neighbour"), "rank", F.sqrt("d").alias("distance"))


def exact_neighbours(points: DataFrame, queries: DataFrame, k: int = 15) -> DataFrame:
    """pixel_id, neighbour, rank, distance: the k nearest of all points to each of queries(pixel_id, x), itself left out.

    Queries are taken in blocks of about BLOCK; a task holds one block and cuts to k for each before anything is shuffled.
    Rows are taken as in knn_graph().
    """
    points, asked = usable(points), scratch(usable(queries), "queries")
    blocks, parts = max(1, -(-asked.count() // BLOCK)), []
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("pixel_id"), F.lit(blocks)) == block).orderBy("pixel_id").toArrow()
        ids, x = own["pixel_id"].to_numpy(), _matrix(own["x"].combine_chunks())

        def run(batches: Iterator[pa.RecordBatch], ids=ids, x=x) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for s in range(0, b.num_rows, 1024):
                    c = b.slice(s, 1024)
                    if not len(ids):
                        continue
                    theirs = c.column("pixel_id").to_numpy()
                    d = _squares(x, _matrix(c.column("x")))
                    d[ids[:, None] == theirs[None, :]] = np.inf
                    order = np.lexsort((np.broadcast_to(theirs, d.shape), d), axis=1)[:, :k]
                    i, j = np.repeat(np.arange(len(ids)), order.shape[1]), order.ravel()
                    fine = np.isfinite(d[i, j])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i[fine]]), pa.array(theirs[j[fine]]), pa.array(d[i, j][fine])], ["u", "v", "d"])

        parts.append(points.mapInArrow(run, "u long, v long, d double"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return _cut(found, k).select(F.col("u").alias("pixel_id"), F.col("v").alias("neighbour"), "rank", F.sqrt("d").alias("distance"))


def memberships(graph: DataFrame) -> DataFrame:
    """pixel_id, neighbour, w: how much each link of knn_graph() counts, from 0 to 1, alike in both directions.

    A point's nearest counts 1, the others fall off so that all come to log2 of their number; w joins what both ends say as
    chances that don't depend on each other.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.diff(b.column("d").offsets.to_numpy())
            owner, flat = np.repeat(np.arange(len(sizes)), sizes), b.column("d").flatten().to_numpy()
            nearest = np.full(len(sizes), np.inf)
            np.minimum.at(nearest, owner[flat > 0], flat[flat > 0])
            over = np.maximum(flat - np.where(np.isfinite(nearest), nearest, 0)[owner], 0)
            low, high = np.full(len(sizes), 1e-12), np.full(len(sizes), 1e12)
            for _ in range(80):  # halving on a logarithmic scale
                sigma = np.sqrt(low * high)
                total = np.bincount(owner, np.exp(-over / sigma[owner]), len(sizes))
                less = total < np.log2(np.maximum(sizes, 2))
                low, high = np.where(less, sigma, low), np.where(less, high, sigma)
            w = np.exp(-over / np.sqrt(low * high)[owner])
            yield pa.RecordBatch.from_arrays([b.column("pixel_id"), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(w)), b.column("v")], ["pixel_id", "w", "v"])

    lists = graph.groupBy("pixel_id").agg(F.array_sort(F.collect_list(F.struct("distance", "neighbour"))).alias("l")).select("pixel_id", F.col("l.distance").alias("d"), F.col("l.neighbour").alias("v"))
    one = lists.mapInArrow(run, "pixel_id long, w array<double>, v array<long>").select("pixel_id", F.explode(F.arrays_zip("v", "w")).alias("e")).select("pixel_id", F.col("e.v").alias("neighbour"), F.col("e.w").alias("w"))
    pair = one.groupBy(F.least("pixel_id", "neighbour").alias("a"), F.greatest("pixel_id", "neighbour").alias("b")).agg((1 - F.product(1 - F.col("w"))).alias("w"))
    return one.select("pixel_id", "neighbour").join(pair, (F.col("a") == F.least("pixel_id", "neighbour")) & (F.col("b") == F.greatest("pixel_id", "neighbour"))).select("pixel_id", "neighbour", "w")


def _steps(alpha: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = np.stack([b.column(c).to_numpy() for c in ("c0", "c1")], 1)
            lists = b.column("near")
            near, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
            owner = np.repeat(np.arange(len(sizes)), sizes)
            w, other = near.field("w").to_numpy(), np.stack([near.field(c).to_numpy() for c in ("c0", "c1")], 1)
            pull = w > 0
            push = np.bincount(owner, w, len(sizes)) * 5 / np.maximum(np.bincount(owner[~pull], minlength=len(sizes)), 1)
            for _ in range(STEPS):
                apart = own[owner] - other
                d = np.maximum((apart**2).sum(1), 1e-12)
                draw = np.where(pull, -2 * A * B * d ** (B - 1) / (1 + A * d**B) * w, 2 * B / ((0.001 + d) * (1 + A * d**B)) * push[owner])
                moves = np.clip(draw[:, None] * apart, -4, 4)
                own = own + np.clip(alpha * np.stack([np.bincount(owner, moves[:, c], len(sizes)) for c in (0, 1)], 1), -1, 1)
            yield pa.RecordBatch.from_arrays([b.column("idx"), pa.array(own[:, 0]), pa.array(own[:, 1])], ["idx", "c0", "c1"])

    return run


def layout(graph: DataFrame, begin: DataFrame, rounds: int = LAYOUT_ROUNDS, rate: float = 0.3) -> DataFrame:
    """graph of knn_graph(), begin(pixel_id, c0, c1) -> pixel_id, c0, c1: every point of begin, neighbours near each other.

    Points without neighbours move away from others only.  All that chance decides is drawn by hash: the same input gives
    the same layout but for the order of sums.
    """
    names = scratch(numbered(begin.select("pixel_id", "c0", "c1")), "layout")
    n = names.count()
    if not n:
        return begin.select("pixel_id", "c0", "c1")
    ids = names.select("idx", "pixel_id")
    edges = memberships(graph).join(ids.select(F.col("pixel_id"), F.col("idx").alias("u")), "pixel_id")
    edges = scratch(edges.join(ids.select(F.col("pixel_id").alias("neighbour"), F.col("idx").alias("v")), "neighbour").select("u", "v", "w"), "edges")
    at = scratch(names.select("idx", "c0", "c1"), "at")
    for r in range(rounds):
        away = at.select(F.col("idx").alias("u"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(AWAY)), lambda j, r=r: F.pmod(F.col("idx") + 1 + F.pmod(F.xxhash64(F.lit(r), "idx", j), F.lit(max(n - 1, 1))), F.lit(n)))).alias("v"))
        asked = edges.unionByName(away.select("u", "v", F.lit(0.0).alias("w")))  # another point, if there is one
        lists = asked.join(at.withColumnRenamed("idx", "v"), "v").groupBy(F.col("u").alias("idx")).agg(F.collect_list(F.struct("w", "c0", "c1")).alias("near"))
        moved = at.join(lists, "idx").mapInArrow(_steps(rate * (1 - r / rounds)), "idx long, c0 double, c1 double")
        before, at = at, scratch(moved, "at")
        discard(before)
    return ids.join(at, "idx").select("pixel_id", "c0", "c1")


def embedding(dense: DataFrame, k: int = 15, rounds: int = LAYOUT_ROUNDS) -> DataFrame:
    """pixel_id, c0, c1: a layout of the neighbour graph of z-scored log values, begun at the first two principal components."""
    z = scratch(scaled(dense).select("pixel_id", vector_to_array("z").alias("x")), "scaled")
    s = PCA(k=2, inputCol="z", outputCol="s").fit(z.select(array_to_vector("x").alias("z"))).transform(z.select("pixel_id", array_to_vector("x").alias("z")))
    s = s.select("pixel_id", vector_to_array("s").alias("s")).select("pixel_id", F.col("s")[0].alias("c0"), F.col("s")[1].alias("c1"))
    size = s.agg(F.max(F.greatest(F.abs("c0"), F.abs("c1")))).first()[0] or 1.0
    return layout(knn_graph(z, k), s.select("pixel_id", (F.col("c0") / size * 10).alias("c0"), (F.col("c1") / size * 10).alias("c1")), rounds)


def trustworthiness(points: DataFrame, placed: DataFrame, k: int = 15, tested: int = 200) -> float:
    """How far the k nearest on the plane are near among the points, from 0 to 1, for up to `tested` points drawn by hash.

    Each tested point is ranked against all points: 1 less the mean excess of ranks over k, scaled as is usual.
    """
    points, plane = usable(points), placed.select("pixel_id", F.array("c0", "c1").alias("x"))
    asked = scratch(points.orderBy(F.xxhash64(F.lit(5), "pixel_id"), "pixel_id").limit(tested), "tested")
    n = points.count()
    near = exact_neighbours(plane, plane.join(asked.select("pixel_id"), "pixel_id", "left_semi"), k).select("pixel_id", "neighbour")
    far = scratch(near.join(points.select(F.col("pixel_id").alias("neighbour"), F.col("x").alias("y")), "neighbour").join(asked, "pixel_id")
                  .select("pixel_id", "neighbour", F.aggregate(F.zip_with("x", "y", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v).alias("d")), "near")
    # tested points times k distances, in arrays, meet every point once
    lists = asked.join(far.groupBy("pixel_id").agg(F.array_sort(F.collect_list("d")).alias("ds")), "pixel_id").select("pixel_id", "x", "ds").collect()
    ids, ds = np.array([r["pixel_id"] for r in lists]), [np.array(r["ds"]) for r in lists]
    x = np.array([r["x"] for r in lists], np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(len(d), np.int64) for d in ds]
        for b in batches:
            for s in range(0, b.num_rows, 1024):
                c = b.slice(s, 1024)
                d = _squares(x, _matrix(c.column("x")))
                d[ids[:, None] == c.column("pixel_id").to_numpy()[None, :]] = np.inf
                for i, own in enumerate(ds):
                    total[i] += np.searchsorted(np.sort(d[i]), own * (1 - 1e-6))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, [len(d) for d in ds])), pa.array(np.concatenate([np.arange(len(d)) for d in ds])), pa.array(np.concatenate(total))], ["u", "j", "nearer"])

    rank = points.mapInArrow(run, "u long, j long, nearer long").groupBy("u", "j").agg((F.sum("nearer") + 1).alias("rank"))
    excess = rank.agg(F.sum(F.greatest(F.col("rank") - k, F.lit(0)))).first()[0]
    return 1 - 2 * excess / (len(lists) * k * (2 * n - 3 * k - 1))
