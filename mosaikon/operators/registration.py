"""Registration of serial sections by phase correlation.

The Fourier transform of an image is one of its lines and then one of its columns, so no image lies in one task: a task
holds a line, a strip of BLOCK columns, or BLOCK lines.  Between the steps strips travel as packed binary cells, BLOCK
columns of a line in each, and not as a row for each pixel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import scratch

#: Columns of a strip, and lines of a band.
BLOCK = 64
#: Lines that are transformed at a time.
LINES = 256


def _strips(height: int, width: int, block: int):
    """Lines (z, y, mean, flat, x, v) -> (z, block, y, raw): the transform of each line in its window, cut into strips."""
    both = height > 1 and width > 1
    down, across = (np.hanning(height), np.hanning(width)) if both else (np.ones(height), np.ones(width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, LINES):
                b = whole.slice(at, LINES)
                z, y, mean, flat = (b.column(c).to_numpy(zero_copy_only=False) for c in ("z", "y", "mean", "flat"))
                a = np.zeros((b.num_rows, width))
                for k, (x, v) in enumerate(zip(b.column("x"), b.column("v"), strict=True)):
                    if x.is_valid:
                        a[k, x.values.to_numpy()] = v.values.to_numpy()
                a = np.where(flat[:, None], 0.0, (a - mean[:, None]) * down[y][:, None] * across)
                f = np.fft.rfft(a, axis=1)
                for s in range(0, f.shape[1], block):
                    raw = [line.tobytes() for line in f[:, s : s + block]]
                    yield pa.RecordBatch.from_arrays([pa.array(z), pa.array(np.full(len(z), s // block, np.int32)), pa.array(y), pa.array(raw, pa.binary())], ["z", "block", "y", "raw"])

    return run


def _down(height: int, width: int):
    """All lines of a strip -> the transform of its columns."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("y")
        f = np.fft.fft(np.frombuffer(b"".join(t.column("raw").to_pylist()), complex).reshape(t.num_rows, -1), axis=0)
        if min(height, width) == 1 and t.column("block")[0].as_py() == 0:
            f[0, 0] = 0  # the mean, which is gone where there is no window: what is left of it is rounding
        return pa.table({"z": t.column("z")[:1], "block": t.column("block")[:1], "raw": pa.array([f.tobytes()], pa.binary())})

    return run


def _crossed(height: int, block: int):
    """Strips of two sections -> bands of the cross-power spectrum, its columns turned back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for z, strip, raw, other in zip(*(b.column(c).to_pylist() for c in ("z", "block", "raw", "other")), strict=True):
                cross = np.frombuffer(raw, complex) * np.frombuffer(other, complex).conj()
                size = np.abs(cross)
                size[size == 0] = 1.0
                back = np.fft.ifft((cross / size).reshape(height, -1), axis=0)
                bands = [back[s : s + block].tobytes() for s in range(0, height, block)]
                n = len(bands)
                yield pa.RecordBatch.from_arrays([pa.array([z] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([strip] * n, pa.int32()), pa.array(bands, pa.binary())], ["z", "band", "block", "raw"])

    return run


def _lines(height: int, width: int, block: int):
    """All strips of a band -> the lines of the correlation, each with its largest value and the first place of it."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("block")
        z, first = t.column("z")[0].as_py(), t.column("band")[0].as_py() * block
        rows = min(block, height - first)
        f = np.concatenate([np.frombuffer(r, complex).reshape(rows, -1) for r in t.column("raw").to_pylist()], axis=1)
        r = np.fft.irfft(f, width, axis=1)
        return pa.table({
            "z": pa.array([z] * rows, pa.int64()), "y": pa.array(range(first, first + rows), pa.int32()), "peak": pa.array(r.max(1)),
            "x": pa.array(r.argmax(1).astype(np.int32)), "line": pa.array(list(r), pa.list_(pa.float64())),
        })

    return run


def phase_shifts(pixels: DataFrame, pairs: DataFrame) -> DataFrame:
    """pixels(z, y, x, v), pairs(z, fixed) -> z, fixed, dy, dx, peak: what to add to the places of z to meet fixed.

    z, y and x are integers; the frame is what the pixels of all sections span.  Missing pixels and those that aren't finite count as
    zero, repeated ones are added up, rows without a place are ignored.  Each section loses its mean and is faded out
    at the borders (unless it is one line or column); the peak of the phase correlation is refined by the parabola through its neighbours
    on either axis.  Of equal peaks the first by line and column counts.  A section with one value everywhere
    gives shifts and a peak of zero.  A z occurs once in pairs; pairs of sections that have no pixels are left out, and an
    empty table gives none.
    """
    spark = pixels.sparkSession
    schema = "z long, fixed long, dy double, dx double, peak double"
    v = F.col("v").cast("double")
    own = pixels.select(F.col("z").cast("long").alias("z"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v).otherwise(0.0).alias("v"))
    own = own.where("z is not null and y is not null and x is not null")
    edge = own.agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1")).first()
    if edge["y0"] is None:
        return spark.createDataFrame([], schema)
    height, width = edge["y1"] - edge["y0"] + 1, edge["x1"] - edge["x0"] + 1
    used = pairs.select(F.explode(F.array("z", "fixed")).alias("z")).distinct()
    placed = own.join(used, "z", "left_semi").select("z", (F.col("y") - edge["y0"]).cast("int").alias("y"), (F.col("x") - edge["x0"]).cast("int").alias("x"), "v")
    # one shuffle: what lies on a line lies together
    pixel = placed.repartition("z", "y").groupBy("z", "y", "x").agg(F.sum("v").alias("v"))
    cells = F.collect_list(F.struct("x", "v"))
    lines = scratch(pixel.groupBy("z", "y").agg(cells.alias("c"), F.sum("v").alias("s"), F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "lines")
    sections = lines.groupBy("z").agg(
        (F.sum("s") / (height * width)).alias("mean"), ((F.sum("n") == height * width) & (F.min("lo") == F.max("hi"))).alias("flat")
    )
    every = sections.select("z", "mean", "flat", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y"))
    full = every.join(lines.select("z", "y", "c"), ["z", "y"], "left").select("z", "y", "mean", "flat", F.col("c.x").alias("x"), F.col("c.v").alias("v"))
    strips = full.mapInArrow(_strips(height, width, BLOCK), "z long, block int, y int, raw binary")
    spectra = scratch(strips.groupBy("z", "block").applyInArrow(_down(height, width), "z long, block int, raw binary"), "spectra")
    other = spectra.select(F.col("z").alias("fixed"), "block", F.col("raw").alias("other"))
    met = spectra.join(pairs.select(F.col("z").cast("long").alias("z"), F.col("fixed").cast("long").alias("fixed")), "z").join(other, ["fixed", "block"])
    bands = met.select("z", "block", "raw", "other").mapInArrow(_crossed(height, BLOCK), "z long, band int, block int, raw binary")
    r = scratch(bands.groupBy("z", "band").applyInArrow(_lines(height, width, BLOCK), "z long, y int, peak double, x int, line array<double>"), "correlation")
    top = r.groupBy("z").agg(F.max(F.struct("peak", -F.col("y"), -F.col("x"))).alias("m")).select("z", F.col("m.peak").alias("peak"), (-F.col("m.col2")).alias("py"), (-F.col("m.col3")).alias("px"))
    at = lambda k: F.get("line", F.pmod(F.col("px") + k, F.lit(width)).cast("int"))
    line = lambda k, of: F.max(F.when(F.col("y") == F.pmod(F.col("py") + k, F.lit(height)), of))
    around = top.join(r.select("z", "y", "line"), "z").where(F.pmod(F.col("y") - F.col("py") + 1, F.lit(height)) <= 2)
    found = around.groupBy("z", "peak", "py", "px").agg(line(-1, at(0)).alias("up"), line(1, at(0)).alias("down"), line(0, at(-1)).alias("left"), line(0, at(1)).alias("right"))

    def signed(place: str, before: str, after: str, size: int) -> Column:
        bend = F.col(before) - 2 * F.col("peak") + F.col(after)
        fine = F.when(bend != 0, 0.5 * (F.col(before) - F.col(after)) / bend).otherwise(0.0) if min(height, width) > 2 else F.lit(0.0)
        p = F.col(place) + fine
        return F.when(p > size / 2, size - p).otherwise(-p) + 0.0

    shifts = found.select("z", signed("py", "up", "down", height).alias("dy"), signed("px", "left", "right", width).alias("dx"), "peak")
    return pairs.select(F.col("z").cast("long").alias("z"), F.col("fixed").cast("long").alias("fixed")).join(shifts, "z").select("z", "fixed", "dy", "dx", "peak")


def register_pair(moving: DataFrame, fixed: DataFrame) -> DataFrame:
    """dy, dx, peak that take moving(y, x, v) to fixed(y, x, v)."""
    both = moving.select(F.lit(1).alias("z"), "y", "x", "v").unionByName(fixed.select(F.lit(0).alias("z"), "y", "x", "v"))
    return phase_shifts(both, moving.sparkSession.createDataFrame([(1, 0)], "z long, fixed long")).select("dy", "dx", "peak")


def register_stack(pixels: DataFrame, reference: str | int = "previous") -> DataFrame:
    """z, fixed, dy, dx, peak, ty, tx, matrix of each section of pixels(z, y, x, v).

    Each section meets the one before it (reference "previous"), or all meet the first, the middle one ("centroid") or
    the z that is named; that one has no fixed section and stays.  (dy, dx) takes a section to its fixed one and
    (ty, tx) to the frame of the stack, which along a chain is a running sum; matrix is the latter as the nine entries of
    a transform of (x, y, 1).  Besides the frame, a row for each section is all that is put in order.  A named z that
    has no pixels is refused.
    """
    z = pixels.where("z is not null and y is not null and x is not null").select(F.col("z").cast("long").alias("z")).distinct()
    order = Window.orderBy("z")
    if reference == "previous":
        pairs = z.select("z", F.lag("z").over(order).alias("fixed"))
    else:
        place = z.select("z", F.row_number().over(order).alias("r"), F.count("*").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"))
        if reference == "first":
            place = place.where("r = 1")
        elif reference == "centroid":
            place = place.where("r = n div 2 + 1")
        else:
            place = place.where(F.col("z") == int(reference))
        anchor = place.select("z").first()
        if anchor is None and reference not in ("first", "centroid"):
            raise ValueError(f"no pixel lies in section {reference}")
        fixed = F.lit(anchor["z"] if anchor else None).cast("long")
        pairs = z.select("z", F.when(F.col("z") != fixed, fixed).alias("fixed"))
    pairs = scratch(pairs, "pairs")
    shifts = scratch(phase_shifts(pixels, pairs.where("fixed is not null")), "shifts")
    own = pairs.join(shifts.drop("fixed"), "z", "left").select("z", "fixed", F.coalesce("dy", F.lit(0.0)).alias("dy"), F.coalesce("dx", F.lit(0.0)).alias("dx"), "peak")
    total = (lambda c: F.sum(c).over(order)) if reference == "previous" else F.col
    own = own.select("*", total("dy").alias("ty"), total("dx").alias("tx"))
    entries = [F.lit(1.0), F.lit(0.0), F.col("tx"), F.lit(0.0), F.lit(1.0), F.col("ty"), F.lit(0.0), F.lit(0.0), F.lit(1.0)]
    return own.withColumn("matrix", F.array(*entries))


def align(pixels: DataFrame, shifts: DataFrame) -> DataFrame:
    """z, y, x, v: pixels(z, y, x, v) moved by shifts(z, ty, tx), read by bilinear interpolation in the frame all pixels span.

    A pixel gives its value to the up to four cells it comes to lie between, which is the same and takes one grouping
    and no join on cells.  A cell of which a part has no pixel, or a null one, is left out, as are sections without a shift.
    """
    edge = pixels.agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1")).first()
    # a place that rounding put beside a cell would ask for a neighbour of no weight
    to = shifts.select("z", F.round("ty", 9).alias("ty"), F.round("tx", 9).alias("tx")).select(
        "z", F.floor("ty").alias("sy"), F.floor("tx").alias("sx"), (F.col("ty") - F.floor("ty")).alias("fy"), (F.col("tx") - F.floor("tx")).alias("fx")
    )
    corner = lambda i, k: F.struct((F.col("y") + F.col("sy") + i).alias("y"), (F.col("x") + F.col("sx") + k).alias("x"), ((F.col("fy") if i else 1 - F.col("fy")) * (F.col("fx") if k else 1 - F.col("fx"))).alias("w"))
    spread = pixels.where("v is not null").join(to, "z").select("z", "v", F.explode(F.array(*[corner(i, k) for i in (0, 1) for k in (0, 1)])).alias("c")).select("z", "v", "c.*").where("w > 0")
    inside = spread.where(F.col("y").between(edge["y0"], edge["y1"]) & F.col("x").between(edge["x0"], edge["x1"]))
    cells = inside.groupBy("z", "y", "x").agg(F.sum(F.col("w") * F.col("v")).alias("v"), F.sum("w").alias("w"))
    return cells.where(F.col("w") > 1 - 1e-9).select("z", "y", "x", "v")
