"""Cells in an image: threshold, distance to the background, markers, and a watershed between them.

raster(row, col, v) has a row for each pixel.  What works along a line of the image (smoothing, distances, the largest value
nearby) takes one line a group; the watershed is a spanning forest of the pixels rooted in the markers.  No task and no
driver holds an image.  Pixels that a line lacks count as zero and as background.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import scratch
from .graph import components, spanning_forest
from .spatial import neighbours

#: Bins of the histogram that a threshold is taken from.
BINS = 256


def along(raster: DataFrame, line: str, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """raster(row, col, v) with f of each whole line (`line` is row or col) in place of v."""
    at = "col" if line == "row" else "row"

    def run(table: pa.Table) -> pa.Table:
        place = table[at].to_numpy()
        low = place.min()
        v = np.zeros(place.max() - low + 1)
        v[place - low] = table["v"].to_numpy()
        return table.set_column(table.schema.get_field_index("v"), "v", pa.array(f(v)[place - low]))

    return raster.select(F.col("row").cast("long"), F.col("col").cast("long"), F.col("v").cast("double")).groupBy(line).applyInArrow(run, "row long, col long, v double")


def gaussian(raster: DataFrame, sigma: float) -> DataFrame:
    """Smoothed along rows and columns, up to four deviations, with the image mirrored at its edges."""
    reach = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    w /= w.sum()

    def f(v: np.ndarray) -> np.ndarray:
        return np.convolve(np.pad(v, reach, mode="symmetric"), w, "valid")

    return along(along(raster, "col", f), "row", f)


def otsu(raster: DataFrame) -> float:
    """The threshold between the two classes of values that differ most; the value itself where there is but one."""
    ends = raster.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    lo, hi = ends["lo"], ends["hi"]
    if lo is None or hi <= lo:
        return lo or 0.0
    at = F.least(F.floor((F.col("v") - lo) / (hi - lo) * BINS), F.lit(BINS - 1)).cast("int")
    n = np.zeros(BINS)
    for r in raster.groupBy(at.alias("k")).count().collect():  # a row a bin
        n[r["k"]] = r["count"]
    centres = lo + (np.arange(BINS) + 0.5) * (hi - lo) / BINS
    low, total = np.cumsum(n), np.cumsum(n * centres)
    high = low[-1] - low
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.where((low > 0) & (high > 0), low * high * (total / low - (total[-1] - total) / high) ** 2, -1)
    return float(centres[int(np.argmax(between))])


def _to_background(v: np.ndarray) -> np.ndarray:
    """Squared distance along a line to the nearest zero."""
    at = np.arange(len(v), dtype=float)
    before = np.maximum.accumulate(np.where(v == 0, at, -np.inf))
    after = np.minimum.accumulate(np.where(v == 0, at, np.inf)[::-1])[::-1]
    return np.minimum(at - before, after - at) ** 2


def _nearest(g: np.ndarray) -> np.ndarray:
    """min over k of g[c + k] + k * k: steps outwards, until none can be nearer."""
    best, k = g.copy(), 1
    while k < len(g) and k * k < best.max():
        best[k:] = np.minimum(best[k:], g[:-k] + k * k)
        best[:-k] = np.minimum(best[:-k], g[k:] + k * k)
        k += 1
    return best


def distances(mask: DataFrame) -> DataFrame:
    """mask(row, col, v) with v 1 or 0 -> row, col, v: the squared distance of each pixel to the nearest 0, exactly.

    It is infinite where the image has no 0.
    """
    return along(along(mask, "col", _to_background), "row", _nearest)


def largest_near(raster: DataFrame, size: int) -> DataFrame:
    """The largest value in a square of `size` (odd) pixels around each."""
    half = size // 2
    f = lambda v: np.lib.stride_tricks.sliding_window_view(np.pad(v, half, constant_values=-np.inf), 2 * half + 1).max(1)
    return along(along(raster, "col", f), "row", f)


def watershed(heights: DataFrame, markers: DataFrame) -> DataFrame:
    """heights(pixel_id, x, y, v), markers(pixel_id, marker >= 0) -> pixel_id, marker.

    The image is flooded from its markers downwards: a pixel goes to the marker that it reaches over the highest pass,
    passes being the lower of two pixels side by side, then the higher, then the pixels' ids.  That is the spanning
    forest rooted in the markers.  Pixels from which no marker can be reached don't appear; ids and markers are whole
    numbers from 0 on.
    """
    rooted = markers.select("pixel_id", (-F.col("marker") - 1).alias("root"))
    pixels = scratch(heights.select("pixel_id", "x", "y", "v").join(rooted, "pixel_id", "left").select("pixel_id", "x", "y", "v", F.coalesce("root", "pixel_id").alias("node")), "heights")
    end = lambda c: pixels.select(F.col("pixel_id").alias(c), F.col("v").alias(f"v_{c}"), F.col("node").alias(f"n_{c}"))
    sides = neighbours(pixels).join(end("a"), "a").join(end("b"), "b")
    order = F.struct(F.least("v_a", "v_b").alias("low"), F.greatest("v_a", "v_b").alias("high"), F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q"))
    found, _ = spanning_forest(sides.select(F.col("n_a").alias("u"), F.col("n_b").alias("v"), order.alias("w")))
    own = pixels.select("pixel_id", "node")
    if found is not None:
        own = own.join(found, "node", "left").select("pixel_id", F.coalesce("component", "node").alias("node"))
    return own.where("node < 0").select("pixel_id", (-F.col("node") - 1).alias("marker"))


def segment(raster: DataFrame, min_diameter: float = 6.0, invert: bool = False) -> DataFrame:
    """raster(row, col, v), no pixel twice -> row, col, label: the pixels of cells, labels from 1 in the order of their first pixel.

    Smoothed by a sixth of the diameter, cut at Otsu's threshold; markers are pixels as far from the background as any within a
    diameter; cells smaller than a disc of that diameter are left out.  Null values count as zero; a flat image has no cells.
    """
    v = F.coalesce("v", F.lit(0.0)).cast("double")
    image = scratch(raster.select("row", "col", v.alias("v")), "image")
    if invert:
        image = image.withColumn("v", F.lit(image.agg(F.max("v")).first()[0]) - F.col("v"))
    soft = scratch(gaussian(image, max(0.5, min_diameter / 6)), "smoothed")
    cut = otsu(soft)
    far = scratch(distances(soft.withColumn("v", (F.col("v") > cut).cast("double"))), "distances")
    size = max(1, round(min_diameter)) | 1
    wide = (far.agg(F.max("col") - F.min("col")).first()[0] or 0) + 2
    start = far.agg(F.min("row").alias("r"), F.min("col").alias("c")).first()
    name = (F.col("row") - (start["r"] or 0)) * wide + F.col("col") - (start["c"] or 0)
    near = largest_near(far, size).withColumnRenamed("v", "top")
    inside = scratch(far.where("v > 0").join(near, ["row", "col"]).select(name.alias("pixel_id"), F.col("col").alias("x"), F.col("row").alias("y"), "v", (F.col("v") == F.col("top")).alias("peak")), "inside")
    peaks = inside.where("peak").select("pixel_id", "x", "y")
    joined = components(neighbours(peaks).select(F.col("a").alias("u"), F.col("b").alias("v")))
    markers = peaks.join(joined, peaks["pixel_id"] == joined["node"], "left").select("pixel_id", F.coalesce("component", "pixel_id").alias("marker"))
    found = scratch(watershed(inside, markers), "cells")
    fine = found.groupBy("marker").agg(F.count("*").alias("n"), F.min("pixel_id").alias("first")).where(F.col("n") >= math.pi * (min_diameter / 2) ** 2)
    named = fine.select("marker", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("first")).alias("label"))  # a row a cell
    out = found.join(named, "marker").join(inside.select("pixel_id", F.col("y").alias("row"), F.col("x").alias("col")), "pixel_id")
    return out.select("row", "col", "label")


def cell_table(cells: DataFrame) -> DataFrame:
    """label, row, col (of the centre) and area of segment()'s cells."""
    return cells.groupBy("label").agg(F.avg("row").alias("row"), F.avg("col").alias("col"), F.count("*").alias("area"))
