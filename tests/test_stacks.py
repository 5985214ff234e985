"""Registration of sections, against plain transforms of whole images and planted shifts."""

import numpy as np
import pytest

from mosaikon.operators import registration as rg

SCHEMA = "z long, y long, x long, v double"


def pixels_of(spark, images):
    rows = [(z, y, x, float(v)) for z, img in images.items() for (y, x), v in np.ndenumerate(img) if not np.isnan(v)]
    return spark.createDataFrame(rows, SCHEMA)


def plain(moving, fixed):
    """(dy, dx, peak) by a transform of the whole image."""
    def ready(a):
        a = np.nan_to_num(a)
        a = np.zeros_like(a) if a.min() == a.max() else a - a.mean()
        return a * np.outer(np.hanning(a.shape[0]), np.hanning(a.shape[1])) if min(a.shape) > 1 else a

    c = np.fft.fft2(ready(moving)) * np.conj(np.fft.fft2(ready(fixed)))
    if min(c.shape) == 1:
        c[0, 0] = 0  # images without their mean
    r = np.fft.ifft2(c / np.where(np.abs(c) == 0, 1, np.abs(c))).real
    at = np.unravel_index(r.argmax(), r.shape)
    out = []
    for axis, n in enumerate(r.shape):
        line = np.roll(np.moveaxis(r, axis, 0)[:, at[1 - axis]], 1 - at[axis])[:3]
        p = float(at[axis])
        if min(r.shape) > 2 and line[0] - 2 * line[1] + line[2] != 0:
            p += 0.5 * (line[0] - line[2]) / (line[0] - 2 * line[1] + line[2])
        out.append(n - p if p > n / 2 else -p)
    return (*out, r[at])


def field(seed, h, w, dy=0.0, dx=0.0):
    """A smooth random image, moved by (dy, dx)."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:h, 0:w].astype(float)
    spots = zip(rng.uniform(0.2 * h, 0.8 * h, 30), rng.uniform(0.2 * w, 0.8 * w, 30), rng.uniform(1, 3, 30), strict=True)
    return sum(a * np.exp(-((y - dy - u) ** 2 + (x - dx - v) ** 2) / 4) for u, v, a in spots)


@pytest.mark.parametrize("shape", [(40, 33), (21, 48), (6, 5), (1, 20), (17, 1), (2, 9)])
def test_equals_the_transform_of_whole_images(spark, monkeypatch, shape):
    monkeypatch.setattr(rg, "BLOCK", 7)
    monkeypatch.setattr(rg, "LINES", 5)
    rng = np.random.default_rng(shape[0])
    images = {z: rng.normal(size=shape) for z in range(3)}
    images[2][0, -1] = np.nan  # a pixel that isn't there
    pairs = spark.createDataFrame([(1, 0), (2, 0), (0, 2)], "z long, fixed long")
    got = {r["z"]: (r["dy"], r["dx"], r["peak"]) for r in rg.phase_shifts(pixels_of(spark, images), pairs).collect()}
    for z, f in ((1, 0), (2, 0), (0, 2)):
        assert got[z] == pytest.approx(plain(images[z], images[f]), abs=1e-7)


def test_planted_shifts(spark):
    still = pixels_of(spark, {0: field(5, 64, 72)}).drop("z")
    for dy, dx, within in ((0, 0, 1e-6), (3, -5, 0.1), (-7, 2, 0.1), (2.5, -1.5, 0.35)):
        r = rg.register_pair(pixels_of(spark, {0: field(5, 64, 72, dy, dx)}).drop("z"), still).first()
        assert abs(r["dy"] + dy) <= within and abs(r["dx"] + dx) <= within


def test_stack_is_brought_to_its_reference(spark):
    """Sections that drift; numbers leave gaps and the frame doesn't start at zero."""
    drift = {10: (0, 0), 12: (2, -1), 13: (4, -3), 17: (3, -4), 20: (5, -6)}
    p = pixels_of(spark, {z: field(9, 60, 60, *d) for z, d in drift.items()}).selectExpr("z", "y + 100 AS y", "x - 50 AS x", "v")
    for reference, anchor in (("previous", 10), ("first", 10), ("centroid", 13), (17, 17)):
        got = {r["z"]: r for r in rg.register_stack(p, reference).collect()}
        assert set(got) == set(drift)
        for z, r in got.items():
            want = [drift[anchor][k] - drift[z][k] for k in (0, 1)]
            assert abs(r["ty"] - want[0]) <= 0.4 and abs(r["tx"] - want[1]) <= 0.4
            assert r["matrix"] == [1, 0, r["tx"], 0, 1, r["ty"], 0, 0, 1]
        assert got[anchor]["fixed"] is None and (got[anchor]["ty"], got[anchor]["tx"]) == (0, 0)
    assert got[12]["fixed"] == 17
    with pytest.raises(ValueError):
        rg.register_stack(p, 11)


def test_aligned_sections_lie_on_each_other(spark):
    still, moved = field(3, 50, 50), field(3, 50, 50, 4, -2)
    p = pixels_of(spark, {0: still, 1: moved})
    got = np.full((50, 50), np.nan)
    for r in rg.align(p, spark.createDataFrame([(1, -4.0, 2.0)], "z long, ty double, tx double")).collect():
        assert r["z"] == 1
        got[r["y"], r["x"]] = r["v"]
    assert np.isnan(got[-4:]).all() and np.isnan(got[:, :2]).all()
    assert np.allclose(got[:-4, 2:], moved[4:, :-2])
    # half a pixel: the mean of the four around, and no cell that lacks one of them
    half = {(r["y"], r["x"]): r["v"] for r in rg.align(p, spark.createDataFrame([(0, 0.5, -1.5)], "z long, ty double, tx double")).collect()}
    assert len(half) == 49 * 48
    assert half[1, 0] == pytest.approx(still[0:2, 1:3].mean())


def test_odd_sections(spark):
    """Flat sections stay, repeated pixels add up, values that aren't finite count as nothing, extra columns don't matter."""
    img = field(2, 20, 24)
    rows = [(0, y, x, float(v), "a") for (y, x), v in np.ndenumerate(img)]
    rows += [(1, y, x, float(v) / 2, "b") for (y, x), v in np.ndenumerate(img) for _ in range(2)]
    rows += [(2, y, x, 0.1, None) for y in range(20) for x in range(24)]
    rows += [(3, 5, 5, None, None), (3, 6, 6, float("nan"), None), (3, 7, 7, float("inf"), None), (None, 1, 1, 1.0, None), (4, None, 1, 1.0, None)]
    p = spark.createDataFrame(rows, "z long, y long, x long, v double, peak string")
    got = {r["z"]: r for r in rg.register_stack(p, "first").collect()}
    assert set(got) == {0, 1, 2, 3}
    assert (got[1]["dy"], got[1]["dx"]) == pytest.approx((0, 0), abs=1e-6) and got[1]["peak"] == pytest.approx(1)
    for z in (2, 3):
        assert (got[z]["dy"], got[z]["dx"], got[z]["peak"]) == (0, 0, 0)
    none = spark.createDataFrame([], SCHEMA)
    for reference in ("previous", "first", "centroid"):
        assert rg.register_stack(none, reference).count() == 0
    assert rg.align(none, spark.createDataFrame([], "z long, ty double, tx double")).count() == 0
