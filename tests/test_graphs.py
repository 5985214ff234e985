"""Neighbour graphs and layouts, tree explanations and cells, against plain versions."""

import itertools
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mosaikon.operators import cells, forest, graph, neighbours


def points_of(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "pixel_id long, x array<double>")


def nearest(x, k):
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, 1, kind="stable")[:, :k]


def trust(x, y, k):
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    rank, n = np.argsort(np.argsort(d, 1), 1) + 1, len(x)
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * np.maximum(np.take_along_axis(rank, nearest(y, k), 1) - k, 0).sum()


@pytest.fixture(scope="module")
def spiral():
    """A curve that winds through ten dimensions, with noise, and one point many times."""
    rng = np.random.default_rng(1)
    t = np.sort(rng.uniform(0, 8 * np.pi, 700))
    turn = rng.normal(0, 1, (3, 10))
    x = np.stack([t * np.cos(t), t * np.sin(t), 5 * t], 1) @ turn + rng.normal(0, 0.3, (700, 10))
    return np.r_[x, np.repeat(x[:1], 60, 0)]


def test_graph_finds_nearly_all_neighbours(spark, spiral):
    got = {}
    for r in neighbours.knn_graph(points_of(spark, spiral), 10).collect():
        got.setdefault(r["pixel_id"], []).append((r["rank"], r["distance"], r["neighbour"]))
    assert len(got) == len(spiral)
    hits = 0
    for i, found in got.items():
        d = np.sqrt(((spiral.astype(np.float32) - spiral[i].astype(np.float32)) ** 2).sum(1))
        assert [r for r, _, _ in sorted(found)] == list(range(1, 11))
        assert all(abs(d[j] - dist) < 1e-3 and j != i for _, dist, j in found)
        hits += sum(dist <= np.sort(np.delete(d, i))[9] + 1e-4 for _, dist, _ in found)  # equal points are as good as each other
    assert hits / (10 * len(spiral)) >= 0.95


def test_exact_neighbours(spark, spiral, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    p = points_of(spark, spiral[:700])
    got = {(r["pixel_id"], r["rank"]): r["neighbour"] for r in neighbours.exact_neighbours(p, p.where("pixel_id % 9 = 0"), 5).collect()}
    want = nearest(spiral[:700], 5)
    assert got == {(i, k + 1): want[i, k] for i in range(0, 700, 9) for k in range(5)}


def test_layout_keeps_neighbours(spark, spiral):
    p = points_of(spark, spiral[:700])
    centred = spiral[:700] - spiral[:700].mean(0)
    start = centred @ np.linalg.svd(centred, full_matrices=False)[2][:2].T
    start *= 10 / np.abs(start).max()
    begin = spark.createDataFrame([(i, float(a), float(c)) for i, (a, c) in enumerate(start)], "pixel_id long, c0 double, c1 double")
    placed = neighbours.layout(neighbours.knn_graph(p, 10), begin)
    at = np.array([(r["c0"], r["c1"]) for r in placed.orderBy("pixel_id").collect()])
    assert at.shape == (700, 2) and np.isfinite(at).all()
    exact = trust(spiral[:700], at, 10)
    assert exact > max(0.95, trust(spiral[:700], start, 10) - 0.005)
    assert abs(neighbours.trustworthiness(p, placed, 10, 700) - exact) < 2e-3


def test_memberships_come_to_log2_of_k(spark, spiral):
    graph = neighbours.knn_graph(points_of(spark, spiral[:700]), 8)
    w = neighbours.memberships(graph)
    rows = {(r["pixel_id"], r["neighbour"]): r["w"] for r in w.collect()}
    assert len(rows) == 700 * 8 and all(0 < v <= 1 + 1e-12 for v in rows.values())
    assert all(abs(v - rows[j, i]) < 1e-12 for (i, j), v in rows.items() if (j, i) in rows)
    # taken apart again for a point whose neighbours don't name it back, the weights are its own and come to three
    sums = [sum(v for (i, _), v in rows.items() if i == p) for p in range(700)]
    assert min(sums) >= math.log2(8) - 1e-6


def test_odd_points(spark):
    assert neighbours.knn_graph(spark.createDataFrame([], "pixel_id long, x array<double>")).count() == 0
    rows = [(1, [0.0, 0.0], 1), (2, [1.0, 0.0], 2), (3, None, 3), (4, [float("nan"), 0.0], 4), (None, [0.0, 0.0], 5), (5, [5.0, None], 6), (2, [1.0, 0.0], 7), (6, [0.0, 3.0], 8)]
    odd = spark.createDataFrame(rows, "pixel_id long, x array<double>, rank int")
    got = {tuple(r) for r in neighbours.knn_graph(odd, 15).collect()}
    assert {(i, j, r) for i, j, r, _ in got} == {(1, 2, 1), (1, 6, 2), (2, 1, 1), (2, 6, 2), (6, 1, 1), (6, 2, 2)}
    begin = odd.where("x is not null and pixel_id is not null").select("pixel_id", F.lit(0.0).alias("c0"), F.col("rank").cast("double").alias("c1")).dropDuplicates(["pixel_id"])
    placed = neighbours.layout(neighbours.knn_graph(odd, 15), begin).collect()
    assert sorted(r["pixel_id"] for r in placed) == [1, 2, 4, 5, 6]
    one = begin.where("pixel_id = 1")
    assert neighbours.layout(neighbours.knn_graph(odd, 15).limit(0), one).count() == 1


def plain_value(nodes, tree, x, known):
    """Class shares of one tree where only `known` features of x are known."""
    def at(k):
        r = tree[k]
        if r["left"] < 0:
            return np.array(r["stats"]) / sum(r["stats"])
        if r["feature"] in known:
            return at(r["left"] if x[r["feature"]] <= r["threshold"] else r["right"])
        a, b = (sum(tree[c]["stats"]) for c in (r["left"], r["right"]))
        return (a * at(r["left"]) + b * at(r["right"])) / (a + b)

    return at(0)


def random_forest_nodes(rng, features, trees, depth):
    nodes = []
    for t in range(trees):
        ids = itertools.count()

        def grow(d, stats, t=t, ids=ids):
            k = next(ids)
            row = {"tree": t, "id": k, "left": -1, "right": -1, "feature": -1, "threshold": None, "stats": [float(s) for s in stats]}
            nodes.append(row)
            if d and stats.sum() > 3:
                left = np.minimum(rng.integers(0, 9, 3), stats)
                if 0 < left.sum() < stats.sum():
                    row |= {"feature": int(rng.integers(features)), "threshold": float(rng.normal())}
                    row["left"] = grow(d - 1, left)
                    row["right"] = grow(d - 1, stats - left)
            return k

        grow(depth, rng.integers(5, 30, 3))
    return nodes


def test_tree_values_are_those_of_all_subsets():
    """Features that a way tests twice, too."""
    rng = np.random.default_rng(4)
    nodes = random_forest_nodes(rng, 5, 4, 5)
    trees = [{r["id"]: r for r in nodes if r["tree"] == t} for t in range(4)]
    found, x = forest.leaves(nodes, 4), rng.normal(size=(12, 5))
    phi = forest.explain_rows(x, found, 3)
    for i, row in enumerate(x):
        game = {s: sum(plain_value(nodes, t, row, s) for t in trees) / 4 for n in range(6) for s in map(frozenset, itertools.combinations(range(5), n))}
        for j in range(5):
            want = sum(math.factorial(len(s)) * math.factorial(4 - len(s)) / math.factorial(5) * (game[s | {j}] - v) for s, v in game.items() if j not in s)
            assert np.allclose(phi[i, :, j], want, atol=1e-12)
        assert np.allclose(phi[i].sum(1) + forest.expected(found), game[frozenset(range(5))])


def test_importance_finds_what_tells_regions_apart(spark):
    rng = np.random.default_rng(2)
    label = rng.integers(0, 3, 300)
    x = rng.normal(size=(300, 6))
    x[:, 2] += 4 * (label == 1)
    x[:, 5] -= 4 * (label == 2)
    rows = [(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, label, strict=True))] + [(900, [0.0] * 6, -1), (901, [0.0] * 6, None), (902, [None] * 6, 1)]
    pixels = spark.createDataFrame(rows, "pixel_id long, x array<double>, label int")
    own = pixels.where("label >= 0 and pixel_id < 900")
    found, classes = forest.fit(own, trees=20, depth=4)
    values = forest.shapley(own, found, classes)
    assert classes == [0, 1, 2]
    for r in values.groupBy("pixel_id", "class").agg(F.sum("phi").alias("s")).where("pixel_id < 9").collect():
        row = x[r["pixel_id"]]
        share = sum(leaf.value[r["class"]] for leaf in found if ((row[leaf.features] > leaf.low) & (row[leaf.features] <= leaf.high)).all())
        assert abs(r["s"] + forest.expected(found)[r["class"]] - share) < 1e-9
    got = {(r["region"], r["feature"]): (r["importance"], r["direction"]) for r in forest.region_importance(pixels, 20, 4).collect()}
    assert len(got) == 18
    for region, feature, sign in ((1, 2, 1), (2, 5, -1)):
        assert max(got[region, f] for f in range(6)) == got[region, feature]
        assert sign * got[region, feature][1] > 0.5
    donors = pixels.withColumn("donor", F.when(F.col("pixel_id") % 2 == 0, "a").otherwise("b")).unionByName(own.where("label = 0").withColumn("donor", F.lit("c")))
    assert {r["donor"] for r in forest.panel(donors, 5, 3).select("donor").distinct().collect()} == {"a", "b"}


def test_importance_needs_two_regions(spark):
    with pytest.raises(ValueError):
        forest.region_importance(spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [2.0, 1.0], 0)], "pixel_id long, x array<double>, label int"), 3, 2)


def raster_of(spark, image):
    return spark.createDataFrame([(r, c, float(v)) for (r, c), v in np.ndenumerate(image)], "row long, col long, v double")


def back(df, shape, column="v"):
    out = np.zeros(shape)
    for r in df.collect():
        out[r["row"], r["col"]] = r[column]
    return out


def disc(image, row, col, r):
    y, x = np.ogrid[: image.shape[0], : image.shape[1]]
    image[(y - row) ** 2 + (x - col) ** 2 <= r * r] = 255


def test_distances_are_exact(spark):
    rng = np.random.default_rng(5)
    mask = (rng.random((23, 31)) < 0.93).astype(float)
    zeros = np.argwhere(mask == 0)
    want = np.array([[((zeros - (r, c)) ** 2).sum(1).min() for c in range(31)] for r in range(23)])
    assert (back(cells.distances(raster_of(spark, mask)), mask.shape) == want).all()
    assert np.isinf(back(cells.distances(raster_of(spark, np.ones((3, 4)))), (3, 4))).all()


def plain_flood(height, markers):
    """Edges from the highest pass down; two parts join unless both have a marker."""
    rows, cols = height.shape
    name = lambda r, c: r * cols + c
    parent, mark, edges = list(range(rows * cols)), {name(r, c): m for (r, c), m in markers.items()}, []
    for r in range(rows):
        for c in range(cols):
            for r2, c2 in ((r + 1, c), (r, c + 1)):
                if r2 < rows and c2 < cols:
                    edges.append((min(height[r, c], height[r2, c2]), max(height[r, c], height[r2, c2]), name(r, c), name(r2, c2)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    by_marker = {}
    for k, m in mark.items():  # pixels of one marker are one from the start
        parent[root(k)] = by_marker.setdefault(m, k)
    has = {root(k): m for k, m in mark.items()}
    for _, _, a, c in sorted(edges, reverse=True):
        a, c = root(a), root(c)
        if a != c and not (a in has and c in has):
            parent[a] = c
            if a in has:
                has[c] = has.pop(a)
    return {(r, c): has[root(name(r, c))] for r in range(rows) for c in range(cols) if root(name(r, c)) in has}


@pytest.mark.parametrize("levels", [4, 1000])
def test_watershed_is_a_plain_flood(spark, levels):
    """On rasters with many equal heights, and with hardly any."""
    rng = np.random.default_rng(levels)
    height = rng.integers(0, levels, (14, 17)).astype(float)
    markers = {(2, 3): 7, (2, 4): 7, (11, 12): 0, (5, 15): 3, (13, 0): 30}
    pixels = spark.createDataFrame([(r * 17 + c, c, r, float(v)) for (r, c), v in np.ndenumerate(height)], "pixel_id long, x long, y long, v double")
    own = spark.createDataFrame([(r * 17 + c, m) for (r, c), m in markers.items()], "pixel_id long, marker long")
    got = {(r["pixel_id"] // 17, r["pixel_id"] % 17): r["marker"] for r in cells.watershed(pixels, own).collect()}
    assert got == plain_flood(height, markers)


def test_watershed_without_ways_or_markers(spark):
    apart = spark.createDataFrame([(0, 0, 0, 1.0), (1, 5, 5, 2.0)], "pixel_id long, x long, y long, v double")
    own = spark.createDataFrame([(1, 4)], "pixel_id long, marker long")
    assert [tuple(r) for r in cells.watershed(apart, own).collect()] == [(1, 4)]
    assert cells.watershed(apart, own.limit(0)).count() == 0


def test_forest_is_the_largest(spark):
    rng = np.random.default_rng(8)
    edges = [(int(a), int(c), float(w)) for a, c, w in zip(rng.integers(0, 60, 150), rng.integers(0, 60, 150), rng.integers(0, 12, 150), strict=True)]
    found, chosen = graph.spanning_forest(spark.createDataFrame(edges, "u long, v long, w double"))
    parent = list(range(60))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    want = []
    for w, a, c in sorted(((w, min(a, c), max(a, c)) for a, c, w in edges if a != c), reverse=True):
        if root(a) != root(c):
            parent[max(root(a), root(c))] = min(root(a), root(c))
            want.append((w, a, c))
    assert sorted(tuple(r) for t in chosen for r in t.collect()) == sorted(want)
    got = {r["node"]: r["component"] for r in found.collect()}
    least = {}
    for k, c in sorted(got.items(), reverse=True):
        assert root(k) == root(c)
        least[c] = k
    assert {k: least[c] for k, c in got.items()} == {k: root(k) for k in {x for a, c, _ in edges if a != c for x in (a, c)}}


def test_cells_of_discs(spark):
    image = np.zeros((60, 90))
    for col in (15, 45, 75):
        disc(image, 30, col, 8)
    disc(image, 5, 5, 1)
    found = cells.segment(raster_of(spark, image), 6.0)
    table = sorted(tuple(r) for r in cells.cell_table(found).collect())
    assert [t[0] for t in table] == [1, 2, 3]
    assert all(abs(r - 30) < 0.5 and abs(c - want) < 0.5 and 0.7 < area / (np.pi * 64) < 1.3 for (_, r, c, area), want in zip(table, (15, 45, 75), strict=True))
    touching = np.zeros((60, 100))
    disc(touching, 30, 38, 12)
    disc(touching, 30, 62, 12)
    both = cells.segment(raster_of(spark, 255 - touching), 6.0, invert=True)
    sides = back(both, touching.shape, "label")
    assert sides.max() == 2 and len({*sides[30, 27:49]}) == 1 and len({*sides[30, 52:73]}) == 1 and sides[30, 38] != sides[30, 62]


def test_cells_of_odd_images(spark):
    assert cells.segment(spark.createDataFrame([], "row long, col long, v double")).count() == 0
    assert cells.segment(raster_of(spark, np.full((5, 6), 3.0))).count() == 0
    assert cells.segment(spark.createDataFrame([(0, 0, None), (0, 1, None)], "row long, col long, v double")).count() == 0


def test_lists_meet_a_few_at_a_time(monkeypatch):
    """What is found leaves after each slice of lists, and is the same whatever the slice."""
    rng = np.random.default_rng(11)
    kind = pa.list_(pa.struct([("v", pa.int64()), ("most", pa.float64()), ("x", pa.list_(pa.float32()))]))
    lists = [[{"v": int(v), "most": 9.0, "x": rng.normal(0, 1, 3).tolist()} for v in rng.integers(0, 50, n)] for n in rng.integers(0, 9, 40)]
    batch = pa.RecordBatch.from_arrays([pa.array(lists, kind)], ["near"])
    found = {}
    for n in (7, 1000):
        monkeypatch.setattr(neighbours, "LISTS", n)
        found[n] = [b.to_pydict() for b in neighbours._meet(iter([batch]))]
    assert (len(found[7]), len(found[1000])) == (6, 1)
    for c in ("u", "v", "d"):
        assert [x for b in found[7] for x in b[c]] == found[1000][0][c]
