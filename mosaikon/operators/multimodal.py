"""Other assays on the same tissue: resampling, correlation, cells, landmarks, volumes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .statistics import tie_blocks


def warp(points: DataFrame, matrix: list[list[float]], x: str = "x", y: str = "y") -> DataFrame:
    """points with x and y through a 3 x 3 affine matrix."""
    (a, b, c), (d, e, f) = matrix[0], matrix[1]
    return points.withColumns({x: F.col(x) * a + F.col(y) * b + c, y: F.col(x) * d + F.col(y) * e + f})


def warp_image(image: DataFrame, frame: DataFrame, matrix: list[list[float]]) -> DataFrame:
    """frame(x, y) with v: image(x, y, v) moved by a 3 x 3 affine matrix, read by bilinear interpolation.

    Each cell of the frame is traced back to the image and takes its four neighbours by equi-joins on integer cells.
    Cells that any neighbour of positive weight is missing for have null.
    """
    back = warp(frame.select("x", "y", F.col("x").cast("double").alias("u"), F.col("y").cast("double").alias("w")), inverse(matrix), "u", "w")
    # a point that rounding put beside its cell would ask for a neighbour of no weight
    back = back.withColumns({"u": F.round("u", 9), "w": F.round("w", 9)})
    part = back.withColumns({"fu": F.floor("u"), "fw": F.floor("w")})
    du, dw = F.col("u") - F.col("fu"), F.col("w") - F.col("fw")
    corner = lambda i, k: F.struct((F.col("fu") + i).alias("sx"), (F.col("fw") + k).alias("sy"), ((du if i else 1 - du) * (dw if k else 1 - dw)).alias("weight"))
    asked = part.select("x", "y", F.explode(F.array(*[corner(i, k) for i in (0, 1) for k in (0, 1)])).alias("c")).select("x", "y", "c.*").where("weight > 0")
    met = asked.join(image.select(F.col("x").cast("long").alias("sx"), F.col("y").cast("long").alias("sy"), "v"), ["sx", "sy"], "left")
    return met.groupBy("x", "y").agg(F.when(F.count("v") == F.count("*"), F.sum(F.col("weight") * F.col("v"))).alias("v"))


def compose(second: list, first: list) -> list:
    return (np.array(second) @ np.array(first)).tolist()


def inverse(matrix: list) -> list:
    return np.linalg.inv(np.array(matrix)).tolist()


def landmark_affine(pairs: DataFrame) -> list:
    """The least-squares affine matrix of pairs(x, y, u, v): six sums go to the driver, however many pairs."""
    c, t = ["x", "y", "o"], ["u", "v"]
    own = pairs.withColumn("o", F.lit(1.0))
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"{a}{b}") for k, a in enumerate(c) for b in c[k:]] + [F.sum(F.col(a) * F.col(b)).alias(f"{a}{b}") for a in c for b in t]
    r = own.agg(*sums).first()
    gram = np.array([[r["".join(sorted((a, b), key=c.index))] for b in c] for a in c])
    sol = np.linalg.solve(gram, np.array([[r[f"{a}{b}"] for b in t] for a in c]))
    return [[sol[0, 0], sol[1, 0], sol[2, 0]], [sol[0, 1], sol[1, 1], sol[2, 1]], [0.0, 0.0, 1.0]]


def resample(modality: DataFrame, pixels: DataFrame, how: str = "mean", pitch: float = 1.0) -> DataFrame:
    """pixel_id, feature, value of modality(x, y, feature, value) on the pixel grid.

    A location goes to the nearest pixel if that is within half a pitch; the grid is regular, so that is a rounding
    and an equi-join.
    """
    agg = {"mean": F.avg, "sum": F.sum, "max": F.max}[how]
    cell = lambda c: F.floor(F.col(c) / pitch + 0.5).cast("long")
    near = modality.select(cell("x").alias("x"), cell("y").alias("y"), "feature", "value", F.sqrt(F.pow(F.col("x") - cell("x") * pitch, 2) + F.pow(F.col("y") - cell("y") * pitch, 2)).alias("d"))
    return near.where(F.col("d") <= pitch / 2).join(pixels, ["x", "y"]).groupBy("pixel_id", "feature").agg(agg("value").alias("value"))


def cross_correlation(a: DataFrame, b: DataFrame, method: str = "pearson") -> DataFrame:
    """fa, fb, score of two tables (pixel_id, feature, v) over the pixels of both; null for a flat column.

    Pixels carry their few features as arrays, so the join is on pixels alone.
    """
    if method == "spearman":
        def ranked(t):  # counts of equal values combine before they are put in order
            rank = tie_blocks(t, F.lit(True), ["feature"]).select("feature", "v", "rank")
            return t.join(rank, ["feature", "v"]).select("pixel_id", "feature", F.col("rank").alias("v"))

        a, b = ranked(a), ranked(b)
    left = a.groupBy("pixel_id").agg(F.collect_list(F.struct("feature", "v")).alias("fa"))
    right = b.groupBy("pixel_id").agg(F.collect_list(F.struct("feature", "v")).alias("fb"))
    both = left.join(right, "pixel_id").select(F.explode("fa").alias("a"), "fb").select("a", F.explode("fb").alias("b"))
    return both.groupBy(F.col("a.feature").alias("fa"), F.col("b.feature").alias("fb")).agg(F.corr("a.v", "b.v").alias("score"))


def pixel_cells(pixels: DataFrame, raster: DataFrame, matrix: list[list[float]], side: int = 4) -> DataFrame:
    """pixel_id, cell_id, weight (of a cell's pixels, summing to one) and area from a label raster(row, col, label).

    Each pixel is sampled at side x side points that an affine matrix takes to the raster.
    """
    offs = [(k + 0.5) / side - 0.5 for k in range(side)]
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in offs for j in offs]))
    spread = pixels.select("pixel_id", "x", "y", steps.alias("s")).select("pixel_id", (F.col("x") + F.col("s.i")).alias("x"), (F.col("y") + F.col("s.j")).alias("y"))
    at = warp(spread, matrix).select("pixel_id", F.floor("y").cast("long").alias("row"), F.floor("x").cast("long").alias("col"))
    met = at.join(raster.where("label > 0"), ["row", "col"]).groupBy("pixel_id", F.col("label").alias("cell_id")).agg((F.count("*") / (side * side)).alias("area"))
    total = met.groupBy("cell_id").agg(F.sum("area").alias("t"))
    return met.join(total, "cell_id").select("pixel_id", "cell_id", (F.col("area") / F.col("t")).alias("weight"), "area")


def cell_matrix(weights: DataFrame, values: DataFrame, support: float = 0.25, norm: str = "none") -> DataFrame:
    """cell_id, feature, value: weighted means over a cell's pixels; cells of too little area are left out."""
    fine = weights.groupBy("cell_id").agg(F.sum("area").alias("a")).where(F.col("a") >= support).select("cell_id")
    out = weights.join(fine, "cell_id", "left_semi").join(values, "pixel_id").groupBy("cell_id", "feature").agg(F.sum(F.col("weight") * F.col("v")).alias("value"))
    if norm == "none":
        return out
    own = F.sum("value") if norm == "tic" else F.percentile(F.when(F.col("value") > 0, F.col("value")), 0.5)
    factor = out.groupBy("cell_id").agg(own.alias("f"))
    return out.join(factor, "cell_id").select("cell_id", "feature", F.when(F.col("f") > 0, F.col("value") / F.col("f")).otherwise(0.0).alias("value"))


def projection(voxels: DataFrame, axis: str = "z") -> DataFrame:
    """The largest value along an axis of voxels(z, y, x, v); null counts as nothing."""
    keep = [c for c in ("z", "y", "x") if c != axis]
    return voxels.groupBy(*keep).agg(F.max("v").alias("v"))


def orthoslice(voxels: DataFrame, axis: str, at: int) -> DataFrame:
    return voxels.where(F.col(axis) == at).drop(axis)


def composite(voxels: DataFrame, alpha: float = 0.5) -> DataFrame:
    """y, x, v: front to back over z, each layer's opacity alpha times its share of the largest value."""
    top = voxels.agg(F.max("v").alias("top"))
    c = F.coalesce("v", F.lit(0.0))
    own = voxels.join(F.broadcast(top)).select("z", "y", "x", c.alias("c"), F.least(F.lit(1 - 1e-12), alpha * c / F.col("top")).alias("op"))
    before = Window.partitionBy("y", "x").orderBy("z").rowsBetween(Window.unboundedPreceding, -1)
    through = F.coalesce(F.exp(F.sum(F.log(1 - F.col("op"))).over(before)), F.lit(1.0))
    return own.withColumn("__t", F.col("c") * F.col("op") * through).groupBy("y", "x").agg(F.sum("__t").alias("v"))


def depths(sections: DataFrame, spacing: float) -> DataFrame:
    """sections with z_um filled from their place where it is missing or zero."""
    z: Column = F.when(F.coalesce(F.col("z_um"), F.lit(0.0)) != 0, F.col("z_um")).otherwise(F.col("z_index") * spacing)
    return sections.withColumn("z_um", z)


def joint_blocks(a: DataFrame, b: DataFrame, weight: float = 0.5) -> DataFrame:
    """Both tables z-scored by feature, scaled to one norm each and weighted, as one: ready for an embedding."""
    def block(t, name, w):
        m = t.groupBy("feature").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
        z = t.join(F.broadcast(m), "feature").select("pixel_id", F.concat(F.lit(name), F.col("feature").cast("string")).alias("feature"), F.when(F.col("s") > 0, (F.col("v") - F.col("m")) / F.col("s")).otherwise(0.0).alias("z"))
        n = z.agg(F.sqrt(F.sum(F.col("z") * F.col("z"))).alias("n"))
        return z.join(F.broadcast(n)).select("pixel_id", "feature", F.when(F.col("n") > 0, F.col("z") / F.col("n") * w).otherwise(0.0).alias("v"))

    return block(a, "a:", weight).unionByName(block(b, "b:", 1 - weight))


def volume(sections: DataFrame, depth: int) -> DataFrame:
    """voxels(z, y, x, v) with missing planes filled linearly between the planes on both sides.

    sections(z, y, x, v) holds the planes that were measured; a column of pixels is one window.
    """
    w = Window.partitionBy("y", "x").orderBy("z")
    gap = sections.withColumn("z1", F.lead("z").over(w)).withColumn("v1", F.lead("v").over(w))
    steps = F.explode(F.sequence("z", F.coalesce(F.col("z1") - 1, F.col("z"))))
    full = gap.select("y", "x", "z", "v", "z1", "v1", steps.alias("zi"))
    share = (F.col("zi") - F.col("z")) / (F.col("z1") - F.col("z"))
    return full.where(F.col("zi") < depth).select(F.col("zi").alias("z"), "y", "x", F.when(F.col("zi") == F.col("z"), F.col("v")).otherwise(F.col("v") + (F.col("v1") - F.col("v")) * share).alias("v"))


