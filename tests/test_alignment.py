"""Lock masses, corrections of spectra and their axes; orthogonal components; nonnegative fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaikon.operators import alignment as al
from mosaikon.operators import multivariate as mv

AXIS = 400 * (1 + 4e-6) ** np.arange(60_000)[::30][:1500]
TRUE = [400.9, 410.2, 430.7]


def _profiles(shifts):
    """One spectrum for each shift (ppm): three Gaussian peaks on an axis that all share."""
    rows = []
    for p, s in enumerate(shifts):
        y = sum(h * np.exp(-0.5 * ((AXIS - m * (1 + s * 1e-6)) / (m * 150e-6)) ** 2) for m, h in zip(TRUE, (100, 60, 30), strict=True))
        rows += [(p, float(m), float(v)) for m, v in zip(AXIS, y, strict=True) if v > 1e-9]
    return rows


PEAKS = "pixel_id int, mz double, intensity double"


def test_planted_drift_leaves_and_the_axis_stays(spark):
    drift = [-360, -240, -120, 0, 0, 120, 240, 360]
    peaks = spark.createDataFrame(_profiles(drift), PEAKS).cache()
    refs = al.lock_masses(peaks, bin_ppm=200.0, min_share=0.9).orderBy("ref_id").collect()
    assert [round(r["ref_mz"], 1) for r in refs] == TRUE
    assert all(r["share"] == 1.0 for r in refs)
    table = spark.createDataFrame(refs)
    shifts = {r["pixel_id"]: r["shift"] * 1e6 for r in al.spectrum_shifts(peaks, table, 800.0).collect()}
    off = np.array([shifts[p] - d for p, d in enumerate(drift)])
    assert np.ptp(off) <= 125  # an axis step is 120 ppm
    done = al.resampled(peaks, al.spectrum_shifts(peaks, table, 800.0)).cache()
    assert {r["mz"] for r in done.collect()} <= set(AXIS)
    at = lambda t: np.array([r["m"] for r in t.where("mz < 405").groupBy("pixel_id").agg((F.sum(F.col("mz") * F.col("intensity")) / F.sum("intensity")).alias("m")).orderBy("pixel_id").collect()])
    assert np.ptp(at(peaks)) / 400 * 1e6 > 700
    assert np.ptp(at(done)) / 400 * 1e6 < 130


def test_resampling_is_interpolation(spark):
    rng = np.random.default_rng(4)
    rows, shifts = [], []
    for p in range(12):
        m = np.sort(rng.uniform(300, 310, 40))
        rows += [(p, float(a), float(b)) for a, b in zip(m, rng.random(40), strict=True)]
        if p:
            shifts.append((p, float(rng.normal(0, 2e-3))))
    got = al.resampled(spark.createDataFrame(rows, PEAKS), spark.createDataFrame(shifts, "pixel_id int, shift double")).toPandas()
    assert len(got) == 480
    by = dict(shifts)
    for p, g in got.groupby("pixel_id"):
        m, v = (np.array(x) for x in zip(*[(a, b) for q, a, b in rows if q == p], strict=True))
        g = g.sort_values("mz")
        assert np.allclose(g.intensity, np.interp(m * (1 + by.get(p, 0.0)), m, v, left=0, right=0))


def test_odd_rows(spark):
    """Nulls, repeated m/z, empty tables, spectra without references; of equal peaks the lower m/z."""
    peaks = spark.createDataFrame([(1, 500.01, 3.0), (1, 500.02, 3.0), (1, 500.02, None), (1, None, 9.0), (None, 500.0, 1.0), (1, -1.0, 2.0), (2, 700.0, 1.0), (3, 500.0, 0.0)], PEAKS)
    refs = spark.createDataFrame([(500.0,), (500.0,), (None,)], "ref_mz double")
    got = al.spectrum_shifts(peaks, refs, 100.0).collect()
    assert [(r["pixel_id"], r["n_refs"]) for r in got] == [(1, 1)]
    assert got[0]["shift"] == pytest.approx(2e-5)
    none = al.spectrum_shifts(peaks, refs.where("false"))
    assert none.count() == 0
    same = {(r["pixel_id"], r["mz"]): r["intensity"] for r in al.resampled(peaks, none).collect()}
    assert same == {(1, 500.01): 3.0, (1, 500.02): 3.0, (2, 700.0): 1.0, (3, 500.0): 0.0}
    assert al.lock_masses(peaks.where("false")).count() == 0
    assert al.resampled(peaks.where("false"), none).count() == 0
    extra = al.shifted(peaks.withColumn("a.b", F.lit(1)).where("pixel_id = 1 and mz > 0"), spark.createDataFrame(got)).collect()
    assert sorted(r["mz"] for r in extra)[0] == pytest.approx(500.01 / (1 + 2e-5))
    assert extra[0]["a.b"] == 1


def test_regions_have_their_own_references(spark):
    """Pixel 1 lies in both regions: the smaller priority counts; pixel 4 in a region without references takes the rest's."""
    peaks = spark.createDataFrame([(p, m, 1.0) for p in (1, 2, 3, 4) for m in (500.005, 600.012)], PEAKS)
    regions = spark.createDataFrame([(1, "b", 0), (1, "a", 1), (2, "a", 1), (4, "c", 0)], "pixel_id int, region string, priority int")
    refs = spark.createDataFrame([(500.0, "a", None), (600.0, "b", 30.0), (600.0, None, 10.0), (500.0, None, 50.0)], "ref_mz double, region string, tol_ppm double")
    got = {r["pixel_id"]: (r["n_refs"], round(r["shift"] * 1e6, 3)) for r in al.spectrum_shifts(peaks, refs, 40.0, regions).collect()}
    assert got == {1: (1, 20.0), 2: (1, 10.0), 3: (1, 10.0), 4: (1, 10.0)}


def test_regions_are_measured_and_corrected(spark):
    drift = {"a": 12e-6, "b": -8e-6}
    anchors = [400.0, 500.0, 600.0]
    rows = [(p, m * (1 + drift.get(r, 0.0)), 5.0) for p, r in enumerate("aabbx") for m in anchors]
    regions = spark.createDataFrame([(p, r) for p, r in enumerate("aabb")], "pixel_id int, region string")
    table = spark.createDataFrame([(m,) for m in anchors], "ref_mz double")
    peaks = spark.createDataFrame(rows, PEAKS)
    found, done = al.calibrated_regions(peaks, regions, table)
    got = {r["region"]: r for r in found.collect()}
    assert got["a"]["median_ppm"] == pytest.approx(12, abs=1e-6)
    assert got["b"]["factor"] == pytest.approx(1 / (1 - 8e-6))
    assert got["a"]["n"] == 3
    assert done.count() == len(rows)
    untouched = {(r["mz"], r["intensity"]) for r in done.where("pixel_id = 4").collect()}
    assert untouched == {(m, 5.0) for m in anchors}


def test_anchors_come_from_the_compounds(spark):
    lipids = spark.createDataFrame([("FA 18:1", 282.2559), ("PC 32:0", 733.5622), ("X", 1.0)], "name string, neutral_mass double")
    got = al.calibration_anchors(lipids).collect()
    assert [r["label"] for r in got] == ["FA 18:1 [M-H]-"]
    assert got[0]["ref_mz"] == pytest.approx(281.2486, abs=1e-3)
    assert [r["label"] for r in al.calibration_anchors(lipids, "positive").collect()] == ["PC 32:0 [M+H]+"]


def _two_labels(n=80, p=6, seed=0):
    """Feature 0 tells the labels apart; a strong trend that doesn't runs through all features."""
    rng = np.random.default_rng(seed)
    y = np.arange(n) % 2
    trend = rng.normal(0, 1, n)
    trend -= np.where(y, trend[y == 1].mean(), trend[y == 0].mean())
    x = rng.normal(0, 0.2, (n, p)) + trend[:, None] * rng.uniform(0.5, 2, p) + 6
    x[:, 0] += y * 1.5
    return y, np.expm1(x)


def _long(spark, y, v):
    return spark.createDataFrame([(i, int(y[i]), f, float(v[i, f])) for i in range(len(y)) for f in range(v.shape[1])], "pixel_id int, label int, feature int, v double")


@pytest.mark.parametrize("n_ortho", [1, 2, 3])
def test_orthogonal_components_equal_the_deflation_of_all_pixels(spark, n_ortho):
    y, v = _two_labels()
    _, axes = mv.opls(d := _long(spark, y, v), n_ortho)
    got = np.array([r["scores"] for r in mv.opls_scores(d, axes).orderBy("pixel_id").collect()])
    x = np.log1p(v)
    x = (x - x.mean(0)) / x.std(0, ddof=1)
    sign = 2.0 * y - 1
    want = []
    for _ in range(n_ortho):
        w = x.T @ (sign - sign.mean())
        w /= np.linalg.norm(w)
        t = x @ w
        load = x.T @ t / (t @ t)
        o = load - w * (w @ load)
        o /= np.linalg.norm(o)
        u = x @ o
        want.append(u)
        x = x - np.outer(u, x.T @ u / (u @ u))
    w = x.T @ (sign - sign.mean())
    want.insert(0, x @ w / np.linalg.norm(w))
    assert np.allclose(got, np.stack(want, 1), atol=1e-6)


def test_a_planted_trend_leaves_and_labels_stay_apart(spark):
    y, v = _two_labels()
    d = _long(spark, y, v)
    (labels, coef, vip), axes = mv.opls(d)
    s = np.array([r["scores"][0] for r in mv.opls_scores(d, axes).orderBy("pixel_id").collect()])
    assert labels == [0, 1]
    assert s[y == 1].min() > s[y == 0].max()
    assert int(np.argmax(vip)) == 0
    assert coef.shape == (7, 2)
    hit = mv.classify(d, (labels, coef, vip)).where("label = predicted").count()
    assert hit == 80
    c = mv.confusion(d, 3, 1, n_ortho=1).toPandas()
    assert c[c.label == c.predicted].n.sum() >= 78


def test_three_labels_lose_nothing(spark):
    y, v = _two_labels()
    d = _long(spark, np.arange(80) % 3, v)
    (a, b, c), axes = mv.opls(d, 2, 2)
    x, z, w = mv.pls(d, 2)
    assert a == x
    assert np.allclose(b, z)
    assert np.allclose(c, w)
    assert axes.shape == (7, 1)


def test_samples_are_left_out_whole(spark):
    """Each sample has one label and an offset of its own, which pixels of the same sample would give away."""
    rng = np.random.default_rng(7)
    rows = [(s * 20 + k, s, s % 2, f, float(np.expm1(3 + off[f] + rng.normal(0, 0.01)))) for s in range(10) for off in [rng.normal(0, 1, 5)] for k in range(20) for f in range(5)]
    d = spark.createDataFrame(rows, "pixel_id int, sample int, label int, feature int, v double")
    share = lambda c: c[c.label == c.predicted].n.sum() / c.n.sum()
    whole = mv.confusion(d, 5).toPandas()
    named = mv.confusion(d, 5, unit="sample").toPandas()
    assert whole.sort_values(["label", "predicted"]).values.tolist() == named.sort_values(["label", "predicted"]).values.tolist()
    assert share(mv.confusion(d, 5, unit="pixel_id").toPandas()) > share(whole)


def test_each_pixel_has_its_least_squares_fit(spark):
    """No other nonnegative w is nearer: gradients are zero where w is positive and not negative elsewhere."""
    rng = np.random.default_rng(1)
    v = rng.random((50, 3)) @ rng.random((3, 8)) + rng.random((50, 8)) * 0.05
    d = spark.createDataFrame([(i, f, float(v[i, f])) for i in range(50) for f in range(8)], "pixel_id int, feature int, v double")
    w, h = mv.nmf(d, 3)
    got = np.array([r["w"] for r in w.orderBy("pixel_id").collect()])
    grad = (got @ h - v) @ h.T
    assert (got >= 0).all()
    assert np.abs(grad[got > 1e-9]).max() < 1e-5
    assert grad[got <= 1e-9].min(initial=0) > -1e-5
    assert np.linalg.norm(got @ h - v) / np.linalg.norm(v) < 0.1


def test_parts_of_spectra_stay_small(spark, monkeypatch):
    """Parts of many points aren't merged again, and there are more of them where there are more points."""
    from mosaikon.operators import ranges

    monkeypatch.setattr(ranges, "PART_ROWS", 50)
    peaks = spark.createDataFrame([(p, 100.0 + k, float(k % 7)) for p in range(100) for k in range(20)], "pixel_id int, mz double, intensity double")
    shifts = spark.createDataFrame([(p, 1, 0.0) for p in range(100)], "pixel_id int, n_refs int, shift double")
    got = al.resampled(peaks, shifts)
    assert got.rdd.getNumPartitions() == 40
    assert sorted(map(tuple, got.collect())) == sorted((p, 100.0 + k, float(k % 7)) for p in range(100) for k in range(20))
