"""Running totals by key: the same whether a key is put in order whole or in parts."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaikon.operators import ordered, regions, spatial, statistics


def _table(spark, n=4000):
    """A feature that holds nearly all rows, most of them within a millionth of each other, and small ones; a null key."""
    rng = np.random.default_rng(3)
    v = np.where(rng.random(n) < 0.8, 1 + rng.random(n) * 1e-6, rng.normal(0, 5, n).round(2))
    rows = [(i, 0, int(rng.integers(3)), "AB"[int(rng.integers(2))], float(x)) for i, x in enumerate(v)]
    rows += [(i, 1 + i % 2, i % 3, "AB"[i % 2], float(i % 7)) for i in range(60)]
    rows += [(i, None, i % 3, "AB"[i // 3 % 2], float(i % 5)) for i in range(30)]
    return spark.createDataFrame(rows, "pixel_id int, feature int, label int, grp string, v double")


@pytest.mark.parametrize("descending", [False, True])
def test_parts_of_a_hot_key_add_up_to_plain_sums(spark, monkeypatch, descending):
    blocks = _table(spark).groupBy("feature", "v").agg(F.count("*").alias("t"), F.sum(F.lit(2)).alias("u"))
    blocks = ordered.scratch(blocks.unionByName(spark.createDataFrame([(0, None, 3, 1), (0, float("nan"), 2, 1), (0, math.inf, 1, 1), (0, -math.inf, 4, 1)], "feature int, v double, t long, u long")), "blocks")
    monkeypatch.setattr(ordered, "PIECE_ROWS", 100)
    cut = ordered.cuts(blocks, ["feature"], "v").collect()
    assert [r["feature"] for r in cut] == [0]
    assert len(cut[0]["__cuts"]) > 20
    got = ordered.cumulate_by(blocks, ["feature"], "v", ["t"], descending)
    assert got.columns == blocks.columns
    place = lambda v: (0, 0.0) if v is None else (2, 0.0) if math.isnan(v) else (1, v)
    rows, want = blocks.collect(), {}
    for f in {r["feature"] for r in rows}:
        total = 0
        for r in sorted((r for r in rows if r["feature"] == f), key=lambda r: place(r["v"]), reverse=descending):
            total += r["t"]
            want[(f, place(r["v"]))] = (total, r["u"])
    found = [((r["feature"], place(r["v"])), (r["t"], r["u"])) for r in got.collect()]
    assert len(found) == len(want)
    assert dict(found) == want


def test_parts_hold_about_as_many_rows_however_near_they_lie(spark, monkeypatch):
    t = spark.range(20_000).select(F.lit(1).alias("k"), (1 + F.col("id") * 1e-12).alias("v"), F.lit(1).alias("t"))
    monkeypatch.setattr(ordered, "PIECE_ROWS", 1000)
    c = ordered.cuts(t, ["k"], "v").first()["__cuts"]
    sizes = np.histogram([r["v"] for r in t.collect()], [-np.inf, *c, np.inf])[0]
    assert len(sizes) == 20
    assert sizes.max() < 1300


def test_rank_statistics_do_not_depend_on_parts(spark, monkeypatch):
    t = _table(spark, 1500)
    tests = {
        "auc": lambda: statistics.rank_auc(t), "kruskal": lambda: statistics.kruskal(t.where("feature is not null")), "roc": lambda: statistics.roc_points(t),
        "rest": lambda: regions.one_vs_rest(t.where("feature is not null")), "hot": lambda: spatial.hotspot(t, 0.05),
    }
    whole = {k: f().toPandas() for k, f in tests.items()}
    monkeypatch.setattr(ordered, "PIECE_ROWS", 90)
    for k, f in tests.items():
        a, b = (x.sort_values(sorted(x.columns)).reset_index(drop=True) for x in (whole[k], f().toPandas()))
        assert len(a) == len(b) > 0
        for c in a.columns:
            assert np.allclose(a[c], b[c], equal_nan=True) if a[c].dtype.kind in "fi" else (a[c] == b[c]).all(), (k, c)


def test_hotspot_of_equal_values_and_nulls(spark):
    """Of ten pixels with 5, 5, 5 and seven ones a fifth holds two fives; a null counts as a pixel without signal."""
    t = spark.createDataFrame([(i, 0, v) for i, v in enumerate([5.0] * 3 + [1.0] * 7)] + [(i, 1, v) for i, v in enumerate([4.0, None])], "pixel_id int, feature int, v double")
    got = {r["feature"]: r["hotspot"] for r in spatial.hotspot(t, 0.2).collect()}
    assert got[0] == pytest.approx(10 / 22)
    assert got[1] == pytest.approx(1.0)
    assert spatial.hotspot(t.where("false")).count() == 0


@pytest.mark.parametrize("rows", [50, 1 << 20])
def test_quantiles_are_those_of_percentile(spark, monkeypatch, rows):
    """Near values, ties, nulls, infinities, a key of nulls, one of a single value and a null key."""
    t = _table(spark, 2500).select("feature", "v")
    more = [(5, None), (5, None), (6, 2.5), (7, math.inf), (7, -math.inf), (7, 1.0), (7, None), (8, -3.0), (8, -3.0), (8, 0.0), (8, -0.0), (8, 4.0)]
    t = t.unionByName(spark.createDataFrame(more, "feature int, v double"))
    monkeypatch.setattr(ordered, "PIECE_ROWS", rows)
    shares = {"low": 0.0, "a": 0.05, "mid": 0.5, "b": 0.987, "high": 1.0}
    got = {r["feature"]: r.asDict() for r in ordered.quantiles(t, ["feature"], "v", shares).collect()}
    want = {r["feature"]: r.asDict() for r in t.groupBy("feature").agg(*[F.percentile("v", p).alias(n) for n, p in shares.items()]).collect()}
    assert got.keys() == want.keys()
    for f in want:
        for n in shares:
            assert got[f][n] == pytest.approx(want[f][n], rel=1e-12) if want[f][n] is not None else got[f][n] is None, (f, n)
    fine = t.where("feature < 3")
    one, two = ordered.quantiles(fine, [], "v", {"m": 0.5}).collect(), fine.agg(F.percentile("v", 0.5).alias("m")).collect()
    assert len(one) == 1
    assert one[0]["m"] == pytest.approx(two[0]["m"])


def test_quantiles_of_nothing(spark):
    t = spark.createDataFrame([], "feature int, v double")
    assert ordered.quantiles(t, ["feature"], "v", {"m": 0.5}).count() == 0
    assert [r["m"] for r in ordered.quantiles(t, [], "v", {"m": 0.5}).collect()] == [None]
