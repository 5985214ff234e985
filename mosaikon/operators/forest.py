"""Which ions tell regions apart: a forest fitted by Spark and the exact Shapley values of its trees.

A leaf gives its share of each class to a pixel that passes all tests on the way to it.  Where a feature isn't known, a pixel
goes both ways in the proportion of the fitted pixels there.  So a leaf with m features on its way is a game of m
players of the form  value * product of (what the pixel passes, or the proportion), whose Shapley values are integrals of
polynomials of degree m - 1; sums over a few points give them exactly.  Whether a pixel passes is yes or no for each feature, so a leaf has at most 2**m answers;
those that a batch of pixels asks for are worked out once and handed to the pixels.

The forest that tasks are given has trees * 2**depth leaves at most, whatever the number of pixels.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import _file, scratch, shared_folder
from .statistics import tie_blocks

#: Trees, their depth, and the pixels that a forest is fitted to and explained on: drawn alike from all regions beyond that.
TREES, DEPTH, MOST = 300, 8, 20_000


class Leaf(NamedTuple):
    features: np.ndarray  # those tested on the way, once each
    low: np.ndarray  # a pixel passes a feature's tests if low < x <= high
    high: np.ndarray
    part: np.ndarray  # the proportion that goes on where the feature isn't known
    value: np.ndarray  # for each class, over the number of trees


def leaves(nodes: list[dict], trees: int) -> list[Leaf]:
    """nodes(tree, id, left, right, feature, threshold, stats: fitted pixels by class) of a forest -> its leaves."""
    out, by_tree = [], {}
    for r in nodes:
        by_tree.setdefault(r["tree"], {})[r["id"]] = r
    for tree in by_tree.values():
        todo = [(0, {})]
        while todo:
            at, way = todo.pop()
            r = tree[at]
            n = sum(r["stats"])
            if r["left"] < 0:
                low, high, part = (np.array([w[k] for w in way.values()], float) for k in range(3))
                out.append(Leaf(np.array(list(way), np.int64), low, high, part, np.array(r["stats"]) / n / trees))
                continue
            low, high, part = way.get(r["feature"], (-math.inf, math.inf, 1.0))
            for child, bounds in ((r["left"], (low, min(high, r["threshold"]))), (r["right"], (max(low, r["threshold"]), high))):
                todo.append((child, way | {r["feature"]: (*bounds, part * sum(tree[child]["stats"]) / n)}))
    return out


def _games(passed: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Shapley values of product(passed or part) for each row of passed (answers x m)."""
    t, w = np.polynomial.legendre.leggauss((len(part) + 1) // 2)
    t = (t + 1) / 2
    factors = part * (1 - t)[:, None, None] + passed * t[:, None, None]  # points x answers x m
    return (passed - part) * np.einsum("q,qa,qam->am", w / 2, factors.prod(2), 1 / factors)


def explain_rows(x: np.ndarray, forest: list[Leaf], classes: int) -> np.ndarray:
    """Shapley values (rows x classes x features) of a forest's class shares."""
    phi = np.zeros((x.shape[1], classes, len(x)))
    for leaf in forest:
        m = len(leaf.features)
        if not m:
            continue
        own = x[:, leaf.features]
        passed = (own > leaf.low) & (own <= leaf.high)
        answers, which = np.unique(passed @ (1 << np.arange(m)), return_inverse=True)
        game = _games((answers[:, None] >> np.arange(m) & 1).astype(float), leaf.part)
        seen = np.flatnonzero(leaf.value)
        for j, f in enumerate(leaf.features):
            phi[f, seen] += leaf.value[seen, None] * game[which, j][None, :]
    return phi.transpose(2, 1, 0)


def expected(forest: list[Leaf]) -> np.ndarray:
    """The class shares of a pixel of which nothing is known."""
    return sum(leaf.value * leaf.part.prod() for leaf in forest)


def draw(pixels: DataFrame, most: int = MOST) -> DataFrame:
    """All pixels, or beyond `most` about that many: a cut on a hash takes each region in its proportion."""
    n = pixels.count()
    if n <= most:
        return pixels
    return pixels.where(F.pmod(F.xxhash64(F.lit(31), "pixel_id"), F.lit(1 << 30)) < int((1 << 30) * most / n))


def fit(pixels: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 0) -> tuple[list[Leaf], list]:
    """pixels(pixel_id, x, label) -> the leaves of a forest and its classes in order."""
    spark: SparkSession = pixels.sparkSession
    classes = [r[0] for r in pixels.select("label").distinct().orderBy("label").collect()]  # a row a region
    code = spark.createDataFrame([(c, float(k)) for k, c in enumerate(classes)], f"label {pixels.schema['label'].dataType.simpleString()}, y double")
    ready = pixels.join(F.broadcast(code), "label").select(array_to_vector("x").alias("v"), "y")
    model = RandomForestClassifier(featuresCol="v", labelCol="y", numTrees=trees, maxDepth=depth, seed=seed).fit(ready)
    path = f"{shared_folder(spark)}/forest-{uuid.uuid4().hex}"
    model.write().save(path)
    n = F.col("nodeData")
    nodes = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), n["id"].alias("id"), n["leftChild"].alias("left"), n["rightChild"].alias("right"), n["split"]["featureIndex"].alias("feature"),
        F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"), n["impurityStats"].alias("stats"),
    )
    found = leaves([r.asDict() for r in nodes.collect()], trees)  # bounded by trees and depth
    fs, at = _file(spark, path)
    fs.delete(at, True)
    return found, classes


def shapley(pixels: DataFrame, forest: list[Leaf], classes: list) -> DataFrame:
    """pixels(pixel_id, x) -> pixel_id, class (its place in classes), feature (its place in x), v, phi: a row for each.

    The values of a pixel and class add up to the forest's share of the class less expected().
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 2048):
                c = b.slice(s, 2048)
                x = c.column("x").flatten().to_numpy(zero_copy_only=False).reshape(c.num_rows, -1)
                phi = explain_rows(x, forest, len(classes))
                ids, p = c.column("pixel_id").to_numpy(), x.shape[1]
                for k in range(len(classes)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(ids, p)), pa.array(np.full(len(ids) * p, k, np.int32)), pa.array(np.tile(np.arange(p, dtype=np.int32), len(ids))), pa.array(x.ravel()), pa.array(phi[:, k].ravel())],
                        ["pixel_id", "class", "feature", "v", "phi"],
                    )

    return pixels.select("pixel_id", F.col("x").cast("array<double>").alias("x")).mapInArrow(run, "pixel_id long, class int, feature int, v double, phi double")


def importance(values: DataFrame) -> DataFrame:
    """shapley() -> class, feature, importance (mean of |phi|), direction (Spearman's correlation of v and phi; 0 for flat columns)."""
    values = scratch(values.withColumn("phi", F.round("phi", 12)), "shapley")
    ranks = lambda t, keys, name: tie_blocks(t, F.lit(True), keys).select(*keys, F.col("v").alias(name), F.col("rank").alias(f"r_{name}"))
    of_v = ranks(values.where("class = 0").select("feature", "v"), ["feature"], "v")
    of_phi = ranks(values.select("class", "feature", F.col("phi").alias("v")), ["class", "feature"], "phi")
    both = values.join(of_v, ["feature", "v"]).join(of_phi, ["class", "feature", "phi"])
    flat = (F.stddev_pop("r_v") == 0) | (F.stddev_pop("r_phi") == 0)
    return both.groupBy("class", "feature").agg(F.avg(F.abs("phi")).alias("importance"), F.when(flat, 0.0).otherwise(F.corr("r_v", "r_phi")).alias("direction"))


def region_importance(pixels: DataFrame, trees: int = TREES, depth: int = DEPTH, most: int = MOST, seed: int = 0) -> DataFrame:
    """pixels(pixel_id, x, label) -> region, feature, importance, direction: what tells each region from the others.

    Pixels whose label is null or negative, or whose x has a null, are left out.  Fewer than two regions are an error.
    """
    fine = F.col("label").isNotNull() & F.coalesce(F.col("label").cast("double") >= 0, F.lit(True)) & F.forall("x", lambda v: v.isNotNull())
    own = scratch(draw(pixels.where(fine), most), "pixels")
    forest, classes = fit(own, trees, depth, seed)
    if len(classes) < 2:
        raise ValueError("importance needs at least two regions")
    named = own.sparkSession.createDataFrame([(k, c) for k, c in enumerate(classes)], f"class int, region {own.schema['label'].dataType.simpleString()}")
    return importance(shapley(own, forest, classes)).join(F.broadcast(named), "class").select("region", "feature", "importance", "direction")


def panel(pixels: DataFrame, trees: int = TREES, depth: int = DEPTH, most: int = MOST, seed: int = 0) -> DataFrame:
    """region_importance() of each donor's pixels(donor, pixel_id, x, label) by itself: donor, region, feature, importance, direction.

    Donors with fewer than two regions are left out.
    """
    regions = pixels.where("label is not null").groupBy("donor").agg(F.count_distinct("label").alias("n")).where("n > 1")
    out = None
    for r in regions.orderBy("donor").collect():  # a fit for each donor
        one = region_importance(pixels.where(F.col("donor") == r["donor"]).drop("donor"), trees, depth, most, seed).withColumn("donor", F.lit(r["donor"]))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no donor has two regions")
    return out.select("donor", "region", "feature", "importance", "direction")
