"""Transforms of one spectrum's arrays, and likeness of two: vectorised where a column function can't say it."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

_ARRAY = ArrayType(DoubleType())


def l2(intensity: Column) -> Column:
    """The array by its length; all zeros stay."""
    norm = F.sqrt(F.aggregate(intensity, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(intensity, lambda x: x / norm)).otherwise(intensity)


def by_reference(mz: Column, intensity: Column, ref: float, ppm: float = 100.0) -> Column:
    """The array by the largest value near a reference m/z; unchanged without one."""
    near = F.filter(F.arrays_zip(mz.alias("m"), intensity.alias("i")), lambda p: F.abs(p["m"] - ref) <= ref * ppm / 1e6)
    top = F.array_max(F.transform(near, lambda p: p["i"]))
    return F.when(top > 0, F.transform(intensity, lambda x: x / top)).otherwise(intensity)


def _each(f):
    @F.pandas_udf(_ARRAY)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else f(np.asarray(x, float)))

    return run


def snip(iterations: int = 40):
    """Takes away a baseline clipped at widening distances, on a doubly logarithmic scale."""
    def f(y: np.ndarray) -> np.ndarray:
        z = np.log(np.log(np.sqrt(np.maximum(y, 0) + 1) + 1) + 1)
        for k in range(1, min(iterations, (len(z) - 1) // 2) + 1):
            z[k:-k] = np.minimum(z[k:-k], (z[2 * k :] + z[: -2 * k]) / 2)
        return np.maximum(y - ((np.exp(np.exp(z) - 1) - 1) ** 2 - 1), 0)

    return _each(f)


def rolling_baseline(window: int = 50, how: str = "min"):
    """Takes away the smallest or median value around each place, smoothed over half the window."""
    def f(y: np.ndarray) -> np.ndarray:
        if not len(y):
            return y
        r = max(1, window // 2)
        around = np.lib.stride_tricks.sliding_window_view(np.pad(y, r, mode="edge"), 2 * r + 1)
        base = around.min(1) if how == "min" else np.median(around, axis=1)
        k = np.exp(-0.5 * (np.arange(-r, r + 1) / (r / 2)) ** 2)
        return np.maximum(y - np.convolve(np.pad(base, r, mode="edge"), k / k.sum(), "valid"), 0)

    return _each(f)


def hull():
    """Takes away the lower convex hull."""
    def f(y: np.ndarray) -> np.ndarray:
        kept: list = []
        for i in range(len(y)):
            while len(kept) > 1 and (y[kept[-1]] - y[kept[-2]]) * (i - kept[-2]) >= (y[i] - y[kept[-2]]) * (kept[-1] - kept[-2]):
                kept.pop()
            kept.append(i)
        return np.maximum(y - np.interp(np.arange(len(y)), kept, y[kept]), 0) if len(y) else y

    return _each(f)


def savgol(window: int = 9, poly: int = 3):
    """A polynomial through each place's neighbours; the window is odd and wide enough."""
    w = max(window | 1, (poly + 2) | 1)
    x = np.arange(-(w // 2), w // 2 + 1)
    kernel = np.linalg.pinv(np.vander(x, poly + 1, increasing=True))[0]
    return _each(lambda y: np.convolve(np.pad(y, w // 2, mode="edge"), kernel[::-1], "valid") if len(y) else y)


def gaussian(sigma: float = 1.0):
    r = max(1, math.ceil(4 * sigma))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return _each(lambda y: np.convolve(np.pad(y, r, mode="edge"), k / k.sum(), "valid") if len(y) else y)


def recalibrated(refs: list[float], ppm: float = 200.0):
    """m/z moved by the median error of the strongest peak near each reference (columns mz, intensity)."""
    @F.pandas_udf(_ARRAY)
    def run(mz: pd.Series, inten: pd.Series) -> pd.Series:
        out = []
        for m, i in zip(mz, inten, strict=True):
            if m is None:
                out.append(None)
                continue
            m, i = np.asarray(m, float), np.asarray(i, float)
            errs = []
            for r in refs:
                at = np.flatnonzero(np.abs(m - r) <= r * ppm / 1e6)
                if len(at) and i[at].max() > 0:
                    errs.append((m[at[i[at].argmax()]] - r) / r)
            out.append(m / (1 + np.median(errs)) if errs else m)
        return pd.Series(out)

    return run


def _pairs(a: np.ndarray, b: np.ndarray, wa: np.ndarray, wb: np.ndarray, tol: float, shift: float = 0.0) -> list[tuple[int, int]]:
    """Greedy one-to-one pairs within tol (or tol of a shift), the largest products first."""
    near = np.abs(a[:, None] - b[None, :]) <= tol
    if shift:
        near |= np.abs(a[:, None] - b[None, :] - shift) <= tol
    i, j = np.nonzero(near)
    used_a, used_b, found = set(), set(), []
    for k in np.lexsort((j, i, -(wa[i] * wb[j]))):
        if i[k] not in used_a and j[k] not in used_b:
            used_a.add(i[k])
            used_b.add(j[k])
            found.append((int(i[k]), int(j[k])))
    return found


def _likeness(kind: str, tol: float):
    def one(ma, ia, pa_, mb, ib, pb) -> float:
        ma, ia, mb, ib = (np.asarray(x, float) for x in (ma, ia, mb, ib))
        if not len(ma) or not len(mb) or ia.sum() <= 0 or ib.sum() <= 0:
            return 0.0
        if kind == "entropy":
            p, q = ia / ia.sum(), ib / ib.sum()
            ent = lambda x: float(-(x[x > 0] * np.log(x[x > 0])).sum())
            mix_a, mix_b, rest = p / 2, q / 2, []
            for i, j in _pairs(ma, mb, p, q, tol):
                rest.append(mix_a[i] + mix_b[j])
                mix_a[i] = mix_b[j] = 0
            mixed = np.concatenate([mix_a, mix_b, rest])
            return float(np.clip(1 - (2 * ent(mixed) - ent(p) - ent(q)) / math.log(4), 0, 1))
        wa, wb = np.sqrt(np.maximum(ia, 0)), np.sqrt(np.maximum(ib, 0))
        shift = (pa_ - pb) if kind == "modified" and pa_ is not None and pb is not None else 0.0
        dot = sum(wa[i] * wb[j] for i, j in _pairs(ma, mb, wa, wb, tol, shift))
        return float(dot / (np.linalg.norm(wa) * np.linalg.norm(wb)))

    @F.pandas_udf(DoubleType())
    def run(ma: pd.Series, ia: pd.Series, pa_: pd.Series, mb: pd.Series, ib: pd.Series, pb: pd.Series) -> pd.Series:
        return pd.Series([one(*r) for r in zip(ma, ia, pa_, mb, ib, pb, strict=True)])

    return run


def cosine(tol: float = 0.01):
    return _likeness("cosine", tol)


def modified_cosine(tol: float = 0.01):
    return _likeness("modified", tol)


def entropy_likeness(tol: float = 0.01):
    return _likeness("entropy", tol)


def unit():
    """l2() for a pipeline: Spark's own array functions can't take what a Python function returns."""
    return _each(lambda y: y / n if (n := np.linalg.norm(y)) > 0 else y)


#: Transforms by name, for a pipeline from a configuration.
TRANSFORMS = {"l2": unit, "snip": snip, "locmin": rolling_baseline, "median": lambda window=50: rolling_baseline(window, "median"), "hull": hull, "savgol": savgol, "gaussian": gaussian}


def register_transform(name: str, make) -> None:
    """Add a transform: make(**params) gives a column function of an intensity array."""
    TRANSFORMS[name] = make


def pipeline(intensity: Column, steps: list[dict]) -> Column:
    """An intensity column through named steps, each {"name": ..., **params}."""
    for step in steps:
        params = {k: v for k, v in step.items() if k != "name"}
        intensity = TRANSFORMS[step["name"]](**params)(intensity)
    return intensity
