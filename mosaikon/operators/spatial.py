"""Statistics on the pixel grid: autocorrelation, frequency, hotspots, masks, rings, islands and holes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import scratch
from .graph import components, numbered, spanning_forest
from .ordered import beside, cumulate_by, quantiles


def neighbours(pixels: DataFrame) -> DataFrame:
    """(a, b): each pair of pixels side by side once, by equi-joins on the grid."""
    here = pixels.select(F.col("pixel_id").alias("a"), F.explode(F.array(F.struct((F.col("x") + 1).alias("x"), "y"), F.struct("x", (F.col("y") + 1).alias("y")))).alias("to"))
    there = pixels.select(F.col("pixel_id").alias("b"), "x", "y")
    return here.select("a", "to.x", "to.y").join(there, ["x", "y"]).select("a", "b")


def moran(values: DataFrame, pixels: DataFrame) -> DataFrame:
    """feature, morans_i over the 4-neighbour grid; zero for a flat image or one without neighbours.

    values(pixel_id, feature, v) has a row for every pixel.
    """
    mean = values.groupBy("feature").agg(F.avg("v").alias("m"))
    z = values.join(F.broadcast(mean), "feature").select("pixel_id", "feature", (F.col("v") - F.col("m")).alias("z"))
    e = neighbours(pixels)
    left = z.join(e, z["pixel_id"] == e["a"]).select("feature", F.col("b").alias("pixel_id"), F.col("z").alias("za"))
    pairs = left.join(z, ["feature", "pixel_id"]).groupBy("feature").agg(F.sum(F.col("za") * F.col("z")).alias("c"), F.count("*").alias("e"))
    own = z.groupBy("feature").agg(F.sum(F.col("z") * F.col("z")).alias("s"), F.count("*").alias("n"))
    i = F.col("n") * F.col("c") / (F.col("e") * F.col("s"))
    return own.join(pairs, "feature", "left").select("feature", F.when((F.col("s") > 0) & (F.col("e") > 0), i).otherwise(0.0).alias("morans_i"))


def frequency(values: DataFrame, share: float = 0.05) -> DataFrame:
    """feature, frequency: the part of pixels above a share of the feature's maximum."""
    top = values.groupBy("feature").agg(F.max("v").alias("top"))
    hit = (F.col("v") > F.col("top") * min(max(share, 0.0), 1.0)) & (F.col("top") > 0)
    return values.join(F.broadcast(top), "feature").groupBy("feature").agg(F.avg(hit.cast("double")).alias("frequency"))


def hotspot(values: DataFrame, top: float = 0.01) -> DataFrame:
    """feature, hotspot: the part of the signal in the brightest share of pixels."""
    counts = scratch(values.groupBy("feature", "v").agg(F.count("*").alias("t")), "blocks")
    n = counts.groupBy("feature").agg(F.sum("t").alias("n"))
    upto = beside(cumulate_by(counts.withColumn("r", F.col("t")), ["feature"], "v", ["r"], descending=True), n, ["feature"])
    k = F.greatest(F.lit(1), F.ceil(F.col("n") * top))
    used = F.greatest(F.lit(0), F.least(F.col("t"), k - F.col("r") + F.col("t")))  # of equal values as many as the share holds
    total = F.sum(F.col("v") * F.col("t"))
    return upto.groupBy("feature").agg(F.when(total > 0, F.sum(F.when(used > 0, F.col("v") * used).otherwise(0.0)) / total).otherwise(0.0).alias("hotspot"))


def threshold_mask(values: DataFrame, cut: float, percentile: bool = True) -> DataFrame:
    """pixel_id of the pixels at or above a percentile of the positive values, or strictly above a value."""
    v = F.coalesce(F.nanvl(F.col("v"), F.lit(0.0)), F.lit(0.0))
    if not percentile:
        return values.where(v > cut).select("pixel_id")
    edge = quantiles(values.select(v.alias("v")).where("v > 0"), [], "v", {"edge": cut / 100})
    return values.join(F.broadcast(edge)).where((v >= F.col("edge")) & (v > 0)).select("pixel_id")


def invert(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    return pixels.join(mask, "pixel_id", "left_anti").select("pixel_id")


def ring(pixels: DataFrame, mask: DataFrame, width: float, mode: str = "inner") -> DataFrame:
    """pixel_id within a distance of the mask's edge: inside it, outside it, or both (band).

    Each pixel asks the offsets within the width for a pixel of the other kind: equi-joins on the grid.  Outside
    the acquired pixels everything counts as outside the mask.
    """
    if width <= 0:
        return mask.select("pixel_id")
    reach = int(math.floor(width))
    offsets = [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if 0 < i * i + j * j <= width * width]
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets]))
    inside = pixels.join(mask.select("pixel_id"), "pixel_id", "left_semi")
    outside = pixels.join(mask.select("pixel_id"), "pixel_id", "left_anti")
    spot = inside.select(F.col("x").alias("tx"), F.col("y").alias("ty"))

    def asked(df):
        return df.select("pixel_id", "x", "y", steps.alias("s")).select("pixel_id", (F.col("x") + F.col("s.i")).alias("tx"), (F.col("y") + F.col("s.j")).alias("ty"))

    inner = asked(inside).join(spot, ["tx", "ty"], "left_anti").select("pixel_id").distinct()
    outer = asked(outside).join(spot, ["tx", "ty"], "left_semi").select("pixel_id").distinct()
    return {"inner": inner, "outer": outer}.get(mode) if mode != "band" else inner.union(outer)


def islands(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """(pixel_id, island): 4-connected parts of a mask, each named by its least pixel_id."""
    own = pixels.join(mask.select("pixel_id"), "pixel_id", "left_semi")
    found = components(neighbours(own).select(F.col("a").alias("u"), F.col("b").alias("v")))
    return own.join(found, own["pixel_id"] == found["node"], "left").select("pixel_id", F.coalesce("component", "pixel_id").alias("island"))


def drop_small(pixels: DataFrame, mask: DataFrame, least: int) -> DataFrame:
    """The mask without islands of fewer pixels."""
    parts = islands(pixels, mask)
    large = parts.groupBy("island").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("island")
    return parts.join(large, "island", "left_semi").select("pixel_id")


def fill_holes(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """The mask with the pixels that it surrounds: parts of the rest that don't touch the edge of the image."""
    box = pixels.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    rest = islands(pixels, invert(pixels, mask)).join(pixels, "pixel_id").join(F.broadcast(box))
    edge = F.max(((F.col("x") == F.col("x0")) | (F.col("x") == F.col("x1")) | (F.col("y") == F.col("y0")) | (F.col("y") == F.col("y1"))).cast("int"))
    holes = rest.groupBy("island").agg(edge.alias("edge")).where("edge = 0").select("island")
    return mask.select("pixel_id").union(rest.join(holes, "island", "left_semi").select("pixel_id"))


def smooth(values: DataFrame, pixels: DataFrame, sigma: float = 1.0, reach: int = 4) -> DataFrame:
    """(pixel_id, v): a Gaussian over the neighbourhood, weights brought to one over the pixels that are there."""
    r = max(1, int(math.ceil(reach * sigma)))
    cells = [(i, j, math.exp(-(i * i + j * j) / (2 * sigma * sigma))) for i in range(-r, r + 1) for j in range(-r, r + 1)]
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(w).alias("w")) for i, j, w in cells]))
    spread = pixels.join(values, "pixel_id").select("x", "y", "v", step.alias("s")).select((F.col("x") + F.col("s.i")).alias("x"), (F.col("y") + F.col("s.j")).alias("y"), (F.col("v") * F.col("s.w")).alias("wv"), F.col("s.w").alias("w"))
    summed = spread.groupBy("x", "y").agg((F.sum("wv") / F.sum("w")).alias("v"))
    return pixels.join(summed, ["x", "y"]).select("pixel_id", "v")


def detect_samples(pixels: DataFrame, tic: DataFrame, rel: float = 0.1, min_frac: float = 0.004, sigma: float = 1.0) -> DataFrame:
    """(pixel_id, sample): tissue pieces, the largest first from 0: smooth, threshold, fill, part, drop specks."""
    soft = smooth(tic, pixels, sigma)
    edge = tic.agg((F.percentile(F.when(F.col("v") > 0, F.col("v")), 0.5) * rel).alias("edge"))
    over = scratch(soft.join(F.broadcast(edge)).where("v > edge").select("pixel_id"), "over")
    mask = scratch(fill_holes(pixels, over), "mask")
    least = max(20, int(min_frac * pixels.count()))
    parts = islands(pixels, mask)
    sizes = parts.groupBy("island").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    named = sizes.withColumn("sample", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "island")) - 1)
    return parts.join(F.broadcast(named.select("island", "sample")), "island").select("pixel_id", "sample")


def chaos(values: DataFrame, pixels: DataFrame, levels: int = 30) -> DataFrame:
    """feature, chaos: one minus the mean number of islands over pixels, at rising levels; null under 4 pixels.

    Islands above a level are the pixels above it less the edges above it of the largest spanning forest, an edge counting as
    much as the lower of its pixels.  So one forest of all features gives the islands of all levels.
    """
    top = values.where("v > 0").groupBy("feature").agg(F.percentile("v", 0.99).alias("p99"), F.count("*").alias("nnz"))
    shares = values.join(top, "feature").where("nnz >= 4").select("pixel_id", "feature", F.least(F.lit(1.0), F.col("v") / F.col("p99")).alias("s"))
    cuts = F.array(*[F.lit(k / (levels + 1)) for k in range(1, levels + 1)])
    passed = lambda s: F.size(F.filter(cuts, lambda c: s > c))
    nodes = numbered(shares.where(F.col("s") > 1 / (levels + 1)))
    a = neighbours(pixels).join(nodes.select(F.col("pixel_id").alias("a"), "feature", F.col("idx").alias("u"), F.col("s").alias("s_a")), "a")
    both = a.join(nodes.select(F.col("pixel_id").alias("b"), "feature", F.col("idx").alias("v"), F.col("s").alias("s_b")), ["feature", "b"])
    _, chosen = spanning_forest(both.select("u", "v", F.struct(F.least("s_a", "s_b").alias("s"), "feature").alias("w")))
    count = nodes.select("feature", passed(F.col("s")).alias("n"))
    for edges in chosen:
        count = count.unionByName(edges.select("w.feature", (-passed(F.col("w.s"))).alias("n")))
    parts = count.groupBy("feature").agg(F.sum("n").alias("parts"))
    return top.join(parts, "feature", "left").select("feature", F.when(F.col("nnz") >= 4, 1 - F.coalesce("parts", F.lit(0)) / (F.col("nnz") * levels)).alias("chaos"))


def quality(scores: DataFrame) -> DataFrame:
    """scores(feature, morans_i, chaos, hotspot) with quality: structure, less what few pixels hold."""
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    i, c = unit(F.col("morans_i")), unit(F.col("chaos"))
    both = F.when(F.col("chaos").isNull(), i).otherwise((i + c) / 2)
    return scores.withColumn("quality", both * (1 - unit(F.col("hotspot"))))


def find_spatial(values: DataFrame, pixels: DataFrame, min_frequency: float = 0.01, min_morans: float = 0.05, rescue: float | None = None) -> DataFrame:
    """feature, frequency, morans_i of the features that are neither rare nor without structure."""
    f = frequency(values).where(F.col("frequency") >= min_frequency)
    both = f.join(moran(values, pixels), "feature")
    fine = F.col("morans_i") >= min_morans
    return both.where(fine if rescue is None else fine | (F.col("frequency") >= rescue))
