"""Facts that hold in closed form, and cases with a planted answer."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaikon.functions import arrays, chemistry, special
from mosaikon.operators import annotation, cohort, hierarchical, intake, library, multimodal, multivariate, ranges, regions, spatial, spectra, statistics, tables
from mosaikon.sources import imzml, readers


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*by).collect()]


def test_tails():
    assert special.t_two_sided(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert special.f_sf(3.0, 2, 20) == pytest.approx(0.0725381, abs=1e-6)
    assert special.chi2_sf(5.0, 3) == pytest.approx(0.1717971, abs=1e-6)
    assert special.exact_rank_sum(9, 3, 3) == pytest.approx(0.1)
    assert special.exact_rank_sum(16, 4, 4) == pytest.approx(2 / 70)
    assert special.digamma(1.0) == pytest.approx(-0.5772156649, abs=1e-9)
    assert special.trigamma(1.0) == pytest.approx(math.pi**2 / 6, abs=1e-9)


def test_rank_floor():
    assert cohort.rank_floor(3, 6) == pytest.approx(2 / 84)
    assert cohort.rank_floor(3, 3) == pytest.approx(2 / 20)


def test_masses(spark):
    df = spark.createDataFrame([("C39H76NO8P",), ("C42H82NO8P",), ("C2Xx",)], "f string")
    mass = chemistry.formula_mass(chemistry.parse_formula(F.col("f")))
    got = [r[0] for r in df.select(chemistry.ion_mz(mass, "[M-H]-")).collect()]
    assert got[0] == pytest.approx(716.5236, abs=2e-3)
    assert got[2] is None
    pc = df.select(chemistry.ion_mz(mass, "[M-CH3]-"), chemistry.ion_mz(mass, "[M+HCOO]-"), chemistry.ion_mz(mass, "[M+Cl]-") - mass).collect()[1]
    assert pc[0] == pytest.approx(744.5549, abs=2e-3)
    assert pc[1] == pytest.approx(804.5760, abs=2e-3)
    assert pc[2] == pytest.approx(34.9694, abs=2e-4)


def test_nearest_prefers_the_lower_and_keeps_all(spark):
    q = spark.createDataFrame([(1, 100.0), (2, 500.0), (3, None)], "id int, mz double")
    r = spark.createDataFrame([(99.999,), (100.001,), (499.0,)], "ref_mz double")
    assert rows(ranges.nearest(q, r, 50.0, ["id"]).select("id", "ref_mz"), "id") == [(1, 99.999), (2, None), (3, None)]


@pytest.mark.parametrize("twice", [False, True])
def test_candidates_are_ranked_where_they_are_met(spark, twice):
    """No pair is shuffled, and ranks are those of all pairs; rows that share an id are ranked together."""
    mzs = [(i, 100.0 * 1.01**i) for i in range(60)] + ([(7, 5000.0)] if twice else [(None, 300.0), (90, None), (91, -1.0)])
    lipids = [(f"L{k}", "ab"[k % 2], 95.0 * 1.0013**k, (k % 5) / 10.0) for k in range(1500)]
    ions = annotation.ion_index(spark.createDataFrame(lipids, "name string, class string, neutral_mass double, prior double")).where("adduct = '[M-H]-'")
    got = annotation.annotate(spark.createDataFrame(mzs, "feature_id int, mz double"), ions, 5000.0)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert twice or "Exchange" not in plan[: plan.index("Join")]
    found = sorted(ions.select("ion_mz", "prior", "class", "name", "adduct").collect())
    want = {}
    for i, mz in mzs:
        for ion, prior, *names in found if mz and mz > 0 else ():
            if mz - mz * 5000.0 / 1e6 <= ion <= mz + mz * 5000.0 / 1e6:
                want.setdefault(i, []).append((-round(-abs((mz - ion) / ion * 1e6) + 500 * prior, 9), *names))
    want = {(i, r + 1, n) for i, all_of in want.items() for r, (_, _, n, _) in enumerate(sorted(all_of))}
    assert {(r["feature_id"], r["rank"], r["name"]) for r in got.collect()} == want
    assert len(want) > 400


def test_dense_grid_is_laid_out_behind_the_join(spark):
    """No row of the grid is shuffled: nothing is exchanged or joined above the explode."""
    values = spark.createDataFrame([(1, 0, 2.0), (1, 2, None), (3, 1, 4.0)], "pixel_id long, feature_id int, value double")
    got = spectra.dense_grid(values, spark.createDataFrame([(1,), (2,), (None,)], "pixel_id long"), [0, 1, 2])
    assert sorted(map(tuple, got.where("value <> 0").collect())) == [(1, 0, 2.0)]
    assert got.count() == 9
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")


def test_nearest_matches_come_without_pairs(spark, monkeypatch):
    """Dense references: none of the searches for the nearest or the best may form all pairs of a window."""
    rng = np.random.default_rng(3)
    q = spark.createDataFrame([(k, float(m)) for k, m in enumerate(rng.uniform(300, 330, 60))] + [(60, None), (61, -1.0), (62, 320.5)], "feature_id long, mz double")
    masses = [float(m) for m in np.round(rng.uniform(600, 660, 400), 2)] + [320.5 + 1.00727646, 641 + 2 * 1.00727646]
    lipids = spark.createDataFrame([(f"n{k % 17}", f"c{k % 5}", m / (1 + k % 2), [0.1, 0.3, None, 0.1, 1e9][k % 50 if k % 50 < 5 else 0], k) for k, m in enumerate(masses)], "name string, class string, neutral_mass double, prior double, lipid_id long")
    index = annotation.ion_index(lipids, "negative", ["[M-H]-", "[M-2H]2-"]).cache()
    ranked = annotation.annotate(q, index, 2000.0).where("rank = 1").select("feature_id", "class", "name")
    want = {r["feature_id"]: (r["class"], r["name"]) for r in ranked.collect()}
    met = {(r["lipid_id"], r["adduct"]) for r in ranges.window_join(q, index, 50.0, "mz", "ion_mz").collect()}
    pairs = ranges.window_join(q, index, 50.0, "mz", "ion_mz").selectExpr("feature_id", "struct(abs(mz - ion_mz), ion_mz) as d")
    near = {r["feature_id"]: r["d"]["ion_mz"] for r in pairs.groupBy("feature_id").agg(F.min("d").alias("d")).collect()}

    def none(features, index, *rest):
        assert index.where("prior is not null and prior < 1e8").isEmpty(), "all pairs"
        return ranges.window_join(features, index, *rest)

    monkeypatch.setattr(annotation, "window_join", none)
    got = {r["feature_id"]: (r["class"], r["name"]) for r in annotation.top_class(q, index, 2000.0).collect()}
    assert got == {k: want.get(k, (None, None)) for k in range(63)}
    found = {(r["lipid_id"], a) for r in annotation.corroborating(q, index, 50.0).collect() for a in r["adducts"].split(",")}
    assert found == met
    monkeypatch.undo()
    monkeypatch.setattr(ranges, "window_join", none)
    assert {r["feature_id"]: r["ion_mz"] for r in ranges.nearest(q, index.select("ion_mz"), 50.0, ["feature_id"], "mz", "ion_mz").where("ion_mz is not null").collect()} == near


def test_best_class_sends_no_ions_to_the_driver(spark):
    """Ions are many where their lipids' file is small: none of the joins may broadcast them, by which the driver would hold them all."""
    lipids = spark.range(20000).selectExpr("concat('n', id % 17) AS name", "concat('c', id % 5) AS class", "300 + id * 0.0007D AS neutral_mass", "(1 + id % 2) / 10D AS prior", "id AS lipid_id")
    index = annotation.ion_index(lipids, "negative", ["[M-H]-", "[M+Cl]-"])
    q = spark.range(30).selectExpr("id AS feature_id", "301.5D + id * 0.401 AS mz")
    want = {r["feature_id"]: (r["class"], r["name"]) for r in annotation.annotate(q, index, 50.0).where("rank = 1").collect()}
    best = annotation.top_class(q, index, 50.0)
    assert {r["feature_id"]: (r["class"], r["name"]) for r in best.collect()} == {k: want.get(k, (None, None)) for k in range(30)}
    assert len(want) > 20

    def nodes(plan):
        yield plan
        kind = plan.getClass().getSimpleName()
        below = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(k) for k in range(plan.children().size())]
        for each in below:
            yield from nodes(each)

    sent = [n.metrics().apply("numOutputRows").value() for n in nodes(best._jdf.queryExecution().executedPlan()) if n.nodeName() == "BroadcastExchange"]
    assert sent and max(sent) < 1000, sent


def test_window_join_equals_cross_join(spark):
    rng = np.random.default_rng(0)
    q = spark.createDataFrame([(i, float(m)) for i, m in enumerate(rng.uniform(100, 1000, 200))], "i int, mz double")
    r = spark.createDataFrame([(float(m),) for m in rng.uniform(100, 1000, 2000)], "ref_mz double")
    for ppm in (5.0, 800.0, 20000.0):
        want = q.join(r).where(ranges.within(F.col("mz"), F.col("ref_mz"), ppm)).count()
        assert ranges.window_join(q, r, ppm).count() == want
        assert ranges.window_join(q, r, ppm, spread="refs").count() == want


def test_norm_floor(spark):
    s = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 100.0), (4, 199.0)], "pixel_id int, tic double")
    f = dict(rows(spectra.norm_factors(s), "pixel_id"))
    assert f[1] == 1.0
    assert f[2] == pytest.approx(1 / 3)
    assert f[3] == pytest.approx(1.0)


def test_moran_of_checkerboard_and_halves(spark):
    px = spark.createDataFrame([(y * 6 + x, x, y) for x in range(6) for y in range(6)], "pixel_id int, x int, y int")
    v = px.select("pixel_id", F.explode(F.array(F.struct(F.lit(0).alias("f"), ((F.col("x") + F.col("y")) % 2).cast("double").alias("v")), F.struct(F.lit(1).alias("f"), (F.col("x") < 3).cast("double").alias("v")), F.struct(F.lit(2).alias("f"), F.lit(1.0).alias("v")))).alias("s"))
    got = dict(rows(spatial.moran(v.select("pixel_id", F.col("s.f").alias("feature"), "s.v"), px), "feature"))
    assert got[0] == pytest.approx(-1.0)
    assert got[1] > 0.7
    assert got[2] == 0.0


def test_masks(spark):
    px = spark.createDataFrame([(y * 7 + x, x, y) for x in range(7) for y in range(7)], "pixel_id int, x int, y int")
    square = px.where("x between 1 and 5 and y between 1 and 5 and not (x = 3 and y = 3)")
    assert spatial.fill_holes(px, square).count() == 25
    assert spatial.ring(px, spatial.fill_holes(px, square), 1.0).count() == 16
    assert spatial.ring(px, spatial.fill_holes(px, square), 1.0, "outer").count() == 20
    speck = square.select("pixel_id").union(spark.createDataFrame([(0,)], "pixel_id int"))
    assert spatial.drop_small(px, speck, 2).count() == 24
    assert spatial.islands(px, speck).select("island").distinct().count() == 2


def test_three_against_three_stays_above_a_tenth(spark):
    v = spark.createDataFrame([(0, "A", float(k)) for k in range(3)] + [(0, "B", float(k + 10)) for k in range(3)], "feature int, grp string, v double")
    r = statistics.two_group_test(v).first()
    assert r["auc"] == 1.0
    assert r["p_value"] == pytest.approx(0.1)
    t = statistics.two_group_test(v, "welch").first()
    assert t["p_value"] == pytest.approx(special.t_two_sided(10 / math.sqrt(2 / 3), 4), rel=1e-6)


def test_bh(spark):
    p = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, None]
    df = spark.createDataFrame(list(enumerate(p)), "i int, p double")
    got = [q for _, q in rows(statistics.bh(df).select("i", "q"), "i")]
    assert got[:3] == pytest.approx([0.007, 0.028, 0.0588])
    assert got[-1] is None


def test_deisotope_needs_a_stronger_parent(spark):
    f = spark.createDataFrame([(0, 500.0, 10.0), (1, 501.0033548, 5.0), (2, 502.0067096, 50.0)], "feature_id int, mz double, intensity double")
    got = dict(rows(annotation.deisotope(f).select("feature_id", "satellite"), "feature_id"))
    assert got == {0: False, 1: True, 2: False}


def test_consensus_width_and_gap(spark):
    p = spark.createDataFrame([(s, m, i) for s, m, i in [(1, 500.0, 1.0), (2, 500.004, 3.0), (3, 500.02, 1.0), (1, 700.0, 2.0)]], "sample_id int, mz double, intensity double")
    got = rows(cohort.consensus(p, 20.0), "target_mz")
    assert [(round(r[0], 3), r[3]) for r in got] == [(500.004, 2), (500.02, 1), (700.0, 1)]


def test_combat_takes_batches_out(spark):
    rng = np.random.default_rng(1)
    data = [(b * 40 + i, f, b, float(rng.normal(b * 3, 1 + b))) for b in range(3) for i in range(40) for f in range(12)]
    t = spark.createDataFrame(data, "row_id int, feature int, batch int, v double")
    share = lambda x: x.agg(F.avg("share")).first()[0]
    assert share(cohort.batch_variance(t)) > 0.5
    assert share(cohort.batch_variance(cohort.combat(t))) < 0.02


@pytest.mark.parametrize("points", [40, 2000])
def test_batch_mixing_looks_for_neighbours_among_all_rows(spark, points):
    rng = np.random.default_rng(5)
    batch = rng.integers(0, 3, 300)
    x = rng.normal(0, 1, (300, 3)) + 0.35 * batch[:, None]
    t = spark.createDataFrame([(i, f, int(batch[i]), float(x[i, f])) for i in range(300) for f in range(3)], "row_id int, feature int, batch int, v double")
    drawn = [r[0] for r in t.select("row_id").distinct().orderBy(F.xxhash64("row_id"), "row_id").limit(points).collect()]
    whole, k, out = np.bincount(batch) / 300, 75, []
    for i in drawn:
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        near = np.bincount(batch[np.argsort(d)[:k]], minlength=3)
        out.append(special.chi2_sf(float(((near - k * whole) ** 2 / (k * whole)).sum()), 2) < 0.05)
    assert 0.1 < np.mean(out) < 0.9
    assert cohort.batch_mixing(t, points).first()[0] == pytest.approx(np.mean(out))


def test_batch_mixing_of_equal_rows(spark):
    """Ties at the last neighbour are shared out: copies of one row in three batches are well mixed."""
    t = spark.createDataFrame([(i, 0, i % 3, 1.0) for i in range(90)], "row_id int, feature int, batch int, v double")
    assert cohort.batch_mixing(t).first()[0] == 0


def test_mixed_model_finds_planted_effects(spark):
    rng = np.random.default_rng(2)
    data = []
    for s in range(9):
        grp, u = ("normal" if s < 3 else "treated"), rng.normal(0, 0.5)
        for c in range(3):
            for f in range(3):
                effect = (2.5 if f == 0 and s >= 3 and c == 1 else 0) + (1.8 if f == 1 and s >= 3 else 0)
                data.append((f, f"s{s}", grp, f"c{c}", float(10 + u + effect + rng.normal(0, 0.2))))
    got = {(r["feature"], r["term"]): r for r in hierarchical.mixed_model(spark.createDataFrame(data, "feature long, subject string, grp string, compartment string, v double")).collect()}
    assert got[0, "group:c1"]["estimate"] == pytest.approx(2.5, abs=0.6)
    assert got[0, "group:c1"]["p_value"] < 0.01
    assert got[1, "group"]["p_value"] < 0.05
    assert got[2, "group"]["p_value"] > 0.05


def test_moderated_t_ranks_the_planted_feature_first(spark):
    rng = np.random.default_rng(3)
    data = [(f, g, float(rng.normal(2.0 if f == 0 and g == "B" else 0, 0.5))) for f in range(30) for g in "AAAABBBB"]
    got = hierarchical.moderated_t(spark.createDataFrame(data, "feature int, grp string, v double")).orderBy("p_value").first()
    assert got["feature"] == 0


def test_segments_find_planted_regions(spark):
    rng = np.random.default_rng(4)
    data = [(p, f, float(max(0, rng.normal(5 if f // 4 == p // 30 else 0.5, 0.2)))) for p in range(90) for f in range(12)]
    seg = multivariate.segment(spark.createDataFrame(data, "pixel_id int, feature int, v double"), 3, 3).toPandas()
    assert seg.groupby(seg.pixel_id // 30).label.nunique().tolist() == [1, 1, 1]


def test_model_queries_do_the_whole_job(spark, monkeypatch):
    """Every pixel gets coordinates, and queries run with the operators' own defaults."""
    from mosaikon import catalog

    sf, seen = "/root/testdata/sf0.01", {}
    assert catalog.QUERIES["pooled_embedding"](spark, sf).count() == spark.read.parquet(f"{sf}/embeddings.parquet").count()
    for name in ("choose_k", "confusion", "two_level_mixture", "hierarchy"):
        def record(*args, __name=name, **more):
            seen[__name] = (len(args), more)
            return (None, None) if __name == "hierarchy" else 2

        monkeypatch.setattr(multivariate, name, record)
    monkeypatch.setattr(multivariate, "segment", lambda *a: None)
    monkeypatch.setattr(multivariate, "labels_for", lambda *a: None)
    for q in ("auto_segments", "cv_confusion", "spatial_mixture", "hierarchy_cut"):
        catalog.QUERIES[q](spark, sf)
    assert seen == {"choose_k": (1, {}), "confusion": (1, {}), "two_level_mixture": (2, {}), "hierarchy": (1, {})}


def test_pooled_pca_gives_every_pixel_coordinates(spark):
    rng = np.random.default_rng(6)
    t = spark.createDataFrame([(i, i % 2, f, float(abs(rng.normal()))) for i in range(300) for f in range(4)], "pixel_id int, sample int, feature int, v double")
    assert multivariate.pooled_pca(t, 2, 40).count() == 300


def test_plsda_separates(spark):
    rng = np.random.default_rng(5)
    data = [(p, p % 2, f, float(rng.normal(3 if f == 0 and p % 2 else 0, 0.3) + 5)) for p in range(60) for f in range(6)]
    d = spark.createDataFrame(data, "pixel_id int, label int, feature int, v double")
    _, _, vip = multivariate.pls(d)
    assert int(np.argmax(vip)) == 0
    c = multivariate.confusion(d, 3).toPandas()
    assert c[c.label == c.predicted].n.sum() >= 58


def test_classify_scales_as_the_model_did(spark):
    """Pixels of one label alone are labelled as they are among the others."""
    rng = np.random.default_rng(8)
    data = [(p, p % 2, f, float(rng.normal(4 if f == 0 and p % 2 else 0, 0.3) + 5)) for p in range(80) for f in range(4)]
    d = spark.createDataFrame(data, "pixel_id int, label int, feature int, v double")
    got = multivariate.classify(d.where("label = 1"), multivariate.pls(d))
    assert got.count() == 40
    assert got.where("predicted = 1").count() == 40


def test_chaos_of_features_with_large_numbers(spark):
    """A feature's name and a pixel's number may be as large as they like."""
    rng = np.random.default_rng(2)
    v = rng.random(36)
    pixels = spark.createDataFrame([((1 << 50) + k, k % 6, k // 6) for k in range(36)], "pixel_id long, x int, y int")
    values = spark.createDataFrame([((1 << 50) + k, f, float(v[k])) for k in range(36) for f in (0, 34_953, 1 << 30)], "pixel_id long, feature int, v double")
    assert len({r["chaos"] for r in spatial.chaos(values, pixels).collect()}) == 1


def test_mixed_model_against_dense_matrices(spark):
    """Subjects with differing rows; the likelihood is evaluated with whole covariance matrices on a fine grid."""
    rng, data = np.random.default_rng(12), []
    for subject in range(24):
        shift = rng.normal(0, 1.2)
        for comp in "pqr"[: 3 - subject % 4 // 3]:
            for _ in range(1 + (subject % 5 == 0)):
                data.append((7, f"s{subject}", "case" if subject % 2 else "base", comp, 3 + shift + (subject % 2) * (0.7 + (comp == "q")) + rng.normal(0, 0.5)))
    got = {r["term"]: r for r in hierarchical.mixed_model(spark.createDataFrame([*data, (7, "s0", "base", "p", None)], "feature long, subject string, grp string, compartment string, v double")).collect()}
    y = np.array([d[4] for d in data])
    g, c = np.array([d[2] == "case" for d in data], float), [np.array([d[3] == k for d in data], float) for k in "qr"]
    x = np.stack([np.ones(len(y)), g, *c, g * c[0], g * c[1]], 1)
    same = np.array([[a[1] == b[1] for b in data] for a in data], float)

    def at(lam):
        v = np.linalg.inv(np.eye(len(y)) + lam * same)
        xx = x.T @ v @ x
        beta = np.linalg.solve(xx, x.T @ v @ y)
        r = y - x @ beta
        rss, n = r @ v @ r, len(y) - x.shape[1]
        return n * np.log(rss / n) - np.linalg.slogdet(v)[1] + np.linalg.slogdet(xx)[1], beta, np.sqrt(np.diag(np.linalg.inv(xx)) * rss / n)

    _, beta, se = min((at(lam) for lam in np.exp(np.linspace(-3, 5, 1500))), key=lambda a: a[0])
    terms = ["intercept", "group", "q", "r", "group:q", "group:r"]
    assert [got[t]["estimate"] for t in terms] == pytest.approx(beta.tolist(), abs=2e-3)
    assert [got[t]["se"] for t in terms] == pytest.approx(se.tolist(), rel=5e-3)


def test_design_of_batches(spark):
    s = spark.createDataFrame([(1, "b", "x"), (2, "a", None), (3, "c", "y"), (4, None, "x")], "sample_id int, grp string, batch string")
    got = {(r["sample_id"], r["level"]): (r["batch"], r["x"]) for r in cohort.batch_design(s).collect()}
    assert got == {(k, g): (b, float(g == own)) for k, own, b in ((1, "b", "x"), (2, "a", ""), (3, "c", "y"), (4, "", "x")) for g in "abc"}
    folders = spark.createDataFrame([("/a/b/c.imzml",), ("c.imzml",), ("D:\\x\\y.csv",)], "source string")
    assert [r["grp"] for r in cohort.group_by_folder(folders).collect()] == ["b", None, "x"]


def test_likeness_of_spectra(spark):
    s = spark.createDataFrame([([100.0, 200.0], [1.0, 4.0], 300.0)], "m array<double>, i array<double>, p double")
    args = ("m", "i", "p", "m", "i", "p")
    r = s.select(arrays.cosine()(*args), arrays.modified_cosine()(*args), arrays.entropy_likeness()(*args)).first()
    assert list(r) == pytest.approx([1.0, 1.0, 1.0])
    moved = s.select(F.transform("m", lambda x: x + 14).alias("m"), "i", (F.col("p") + 14).alias("p"))
    r = s.join(moved.toDF("m2", "i2", "p2")).select(arrays.cosine()("m", "i", "p", "m2", "i2", "p2"), arrays.modified_cosine()("m", "i", "p", "m2", "i2", "p2")).first()
    assert list(r) == pytest.approx([0.0, 1.0])


def test_calibration_is_exact_on_a_line(spark):
    pts = spark.createDataFrame([(float(x), 2.0 * x + 1) for x in (1, 2, 4, 8)], "concentration double, response double")
    m = tables.fit_calibration(pts, "1/x")
    r = m.first()
    assert (r["slope"], r["intercept"], r["r2"]) == pytest.approx((2.0, 1.0, 1.0))
    back = tables.apply_calibration(pts.select("response"), m, 1.0, 8.0).collect()
    assert all(x["in_range"] for x in back)


def test_attach_makes_columns(spark):
    base = spark.createDataFrame([(500.0, "x"), (600.0, "y")], "mz double, lipid string")
    a = spark.createDataFrame([(500.001, "r1", 0.9), (500.001, "r2", 0.1)], "mz double, region string, auc double")
    got = tables.attach(base, a, "cmp", "region").orderBy("mz").collect()
    assert got[0]["cmp.r1.auc"] == 0.9
    assert got[1]["cmp.r2.auc"] is None
    with pytest.raises(ValueError, match="columns"):
        tables.attach(base, a.where("region = 'r1'"), "cmp", "region")


def test_landmarks(spark):
    m = [[0.9, -0.2, 5.0], [0.1, 1.1, -3.0], [0.0, 0.0, 1.0]]
    pts = spark.createDataFrame([(float(x), float(y)) for x in range(4) for y in range(3)], "x double, y double")
    pairs = pts.select("x", "y", (0.9 * F.col("x") - 0.2 * F.col("y") + 5).alias("u"), (0.1 * F.col("x") + 1.1 * F.col("y") - 3).alias("v"))
    assert np.allclose(multimodal.landmark_affine(pairs), m)
    assert np.allclose(multimodal.compose(multimodal.inverse(m), m), np.eye(3))


def test_readers(spark, tmp_path):
    (tmp_path / "long.csv").write_text("X,Y,MZ,Intensity\n1,1,500.1,3\n2,1,500.1,4\n")
    (tmp_path / "wide.csv").write_text("x,y,500.1,600.2\n1,1,3,5\n2,1,4,6\n")
    assert readers.imaging_csv(spark, str(tmp_path / "long.csv")).count() == 2
    wide = readers.imaging_csv(spark, str(tmp_path / "wide.csv"))
    assert wide.count() == 4
    assert {r[0] for r in wide.select("mz").collect()} == {500.1, 600.2}
    (tmp_path / "a.mgf").write_text("BEGIN IONS\nTITLE=one\nPEPMASS=500.5 10\n100.1 5\n200.2 6\nEND IONS\nBEGIN IONS\nTITLE=two\nPEPMASS=600\n50 1\nEND IONS\n")
    got = readers.mgf(spark, str(tmp_path / "a.mgf")).orderBy("title").collect()
    assert [(r["title"], r["precursor"], list(r["mz"])) for r in got] == [("one", 500.5, [100.1, 200.2]), ("two", 600.0, [50.0])]
    (tmp_path / "a.msp").write_text("Name: A\nPrecursorMZ: 300.1\nPrecursor_type: [M-H]-\nSMILES: CC\nNum Peaks: 2\n100 1\n150.5 2\n\nName: B\nPrecursorMZ: 400\nNum Peaks: 1\n99 3\n")
    lib = readers.msp(spark, str(tmp_path / "a.msp")).orderBy("name").collect()
    assert [(r["name"], r["precursor"], list(r["mz"]), r["adduct"]) for r in lib] == [("A", 300.1, [100.0, 150.5], "[M-H]-"), ("B", 400.0, [99.0], None)]
    (tmp_path / "a.sdf").write_text("x\n> <LM_ID>\nLM1\n\n> <COMMON_NAME>\nthing\n\n> <FORMULA>\nC2H6O\n\n> <MAIN_CLASS>\nOH\n\n$$$$\ny\n> <LM_ID>\nLM2\n\n> <FORMULA>\nC2Xx\n\n$$$$\n")
    lip = readers.lipids_from_sdf(spark, str(tmp_path / "a.sdf")).collect()
    assert [(r["name"], r["class"], round(r["neutral_mass"], 4)) for r in lip] == [("thing", "OH", 46.0419)]
    (tmp_path / "t.csv").write_text("made by someone\n\nmz,a_mean,b_mean\n500.1,1,2\n600.2,3,4\n")
    assert rows(readers.peak_table(spark, str(tmp_path / "t.csv")), "mz") == [(500.1, 1.0, 2.0), (600.2, 3.0, 4.0)]


def test_imzml_round_trip(spark, tmp_path):
    path = str(tmp_path / "a.imzML")
    s = spark.createDataFrame([(1, 1, [100.0, 200.5], [1.0, 2.0]), (2, 1, [300.25], [7.0])], "x int, y int, mz array<double>, intensity array<float>")
    imzml.write(s, path)
    imzml.register(spark)
    got = spark.read.format("imzml").load(path).orderBy("pixel_id").collect()
    assert [(r["x"], r["y"], list(r["mz"]), list(r["intensity"])) for r in got] == [(1, 1, [100.0, 200.5], [1.0, 2.0]), (2, 1, [300.25], [7.0])]


def test_session(spark):
    from mosaikon.session import STEPS, Session, unmet

    rng = np.random.default_rng(6)
    px = spark.createDataFrame([(y * 8 + x, x, y) for x in range(8) for y in range(8)], "pixel_id long, x long, y long")
    data = [(y * 8 + x, m, float(rng.uniform(5, 6) if (m == 500.0) == (x < 4) else rng.uniform(1, 2))) for x in range(8) for y in range(8) for m in (500.0, 600.0, 700.0)]
    s = Session(spark.createDataFrame(data, "pixel_id long, mz double, intensity double"), px)
    s.set_features([500.0, 600.0, 700.0])
    s.add_region("left", px.where("x < 4"), "A")
    s.add_region("right", px.where("x >= 4"), "B")
    t = {r["feature"]: r["auc"] for r in s.compare(s.group("A"), s.group("B")).collect()}
    assert t[0] == 0.0
    assert t[1] == 1.0
    assert s.threshold(500.0, 60).join(px, "pixel_id").where("x < 4").count() > 10
    assert s.run("pca", k=2)[0].count() == 64
    assert unmet("roi_comparison", {"a": 1}, s) == ["b"]
    assert len(STEPS) >= 26


def test_stream_store(spark, tmp_path):
    from mosaikon.streaming import live

    src = str(tmp_path / "in")
    spark.createDataFrame([(1, 0, 2.0), (2, 0, 3.0), (2, 1, 5.0)], "pixel_id int, bin int, v double").write.parquet(src)
    q = live.accumulate(spark.readStream.schema("pixel_id int, bin int, v double").parquet(src), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert rows(live.accumulated(spark, str(tmp_path / "out")), "bin") == [(0, 5.0, 2), (1, 5.0, 1)]


def test_class_evidence(spark):
    s = spark.createDataFrame([(1, 700.0, [184.073, 516.0])], "query_id int, precursor double, mz array<double>")
    r = spark.createDataFrame([("PC", "fragment", 184.0733), ("PC", "loss", 184.0), ("PE", "loss", 141.019)], "class string, kind string, value double")
    assert rows(library.class_evidence(s, r), "class") == [(1, "PC", 2)]


def brute_envelope(formula, offsets):
    """Abundance and mean mass by convolving one atom after another."""
    p, w = np.zeros(offsets + 1), np.zeros(offsets + 1)
    p[0] = 1.0
    for e, n in formula.items():
        for _ in range(n):
            q, v = np.zeros(offsets + 1), np.zeros(offsets + 1)
            for m, a in chemistry.ISOTOPES[e]:
                k = round(m - chemistry.ISOTOPES[e][0][0])
                for j in range(offsets + 1 - k):
                    q[j + k] += p[j] * a
                    v[j + k] += (w[j] + p[j] * m) * a
            p, w = q, v
    return p, w / np.where(p > 0, p, 1)


def test_isotope_distribution_is_the_convolution(spark):
    formulas = {1: {"C": 42, "H": 82, "N": 1, "O": 8, "P": 1}, 2: {"C": 2, "S": 3, "Cl": 2}, 3: {"K": 2, "Na": 1, "Cl": 5}, 4: {"P": 2}}
    df = spark.createDataFrame([(k, f) for k, f in formulas.items()] + [(5, None)], "formula_id int, atoms map<string, int>")
    got = {(r.formula_id, r.offset): r for r in annotation.isotope_distribution(df, 4).collect()}
    assert len(got) == 25
    for k, f in formulas.items():
        p, m = brute_envelope(f, 4)
        for o in range(5):
            assert got[k, o].abundance == pytest.approx(p[o], abs=1e-12)
            if p[o] > 0:
                assert got[k, o].mass == pytest.approx(m[o], abs=1e-7)
            else:
                assert got[k, o].mass is None


def test_ion_pattern_counts_the_adduct(spark):
    df = spark.createDataFrame([(1, {"C": 10, "H": 20, "O": 2})], "formula_id int, atoms map<string, int>")
    got = {r.offset: r for r in annotation.ion_pattern(df, "[M+Cl]-").collect()}
    p, m = brute_envelope({"C": 10, "H": 20, "O": 2, "Cl": 1}, 2)
    assert [got[k].rel_intensity for k in range(3)] == pytest.approx(list(p / p.max()))
    assert got[2].mz - got[0].mz == pytest.approx(m[2] - m[0], abs=1e-7)
    two = {r.offset: r.mz for r in annotation.ion_pattern(df, "[M-2H]2-").collect()}
    assert two[1] - two[0] == pytest.approx(0.5017, abs=1e-3)


def test_class_correlation_widens_camera(spark):
    rng = np.random.default_rng(0)
    shared = rng.normal(size=40)
    data = [(f, u, "A" if u < 20 else "B", float((shared[u] if f < 5 else 0) * 3 + rng.normal())) for f in range(20) for u in range(40)]
    values = spark.createDataFrame(data, "feature int, unit int, grp string, v double")
    r = hierarchical.unit_residuals(values)
    classes = spark.createDataFrame([(f, "tied" if f < 5 else "free") for f in range(20)], "feature int, class string")
    bar = hierarchical.class_correlation(r, classes)
    y = np.array([d[3] for d in data]).reshape(20, 2, 20)
    e = (y - y.mean(axis=2, keepdims=True)).reshape(20, 40)
    c = np.corrcoef(e[:5])
    got = {x["class"]: x.r_bar for x in bar.collect()}
    assert got["tied"] == pytest.approx((c.sum() - 5) / 20, abs=1e-9)
    scores = classes.withColumn("t", F.col("feature") * -0.1)
    p = {x["class"]: x.p_value for x in hierarchical.camera(scores, bar).collect()}
    q = {x["class"]: x.p_value for x in hierarchical.camera(scores, 0.0).collect()}
    assert p["tied"] > q["tied"]


def test_representation(spark):
    profile = (1, [200 + 0.001 * k for k in range(12)], [float(v) for v in (0, 0, 1, 2, 1, 0, 0, 3, 4, 3, 0, 0)])
    spikes = (2, [200.0 + k for k in range(12)], [float(v) for v in (0, 5, 0, 0, 5, 0, 5, 0, 0, 5, 0, 0)])
    sparse = (3, [200.0 + k for k in range(10)], [1.0] * 10)
    kinds = "pixel_id int, mz array<double>, intensity array<double>"
    of = lambda *r, flag=None: intake.representation(spark.createDataFrame(list(r), kinds), flag).first()
    assert of(profile).label == "profile" and of(spikes).label == "centroid" and of(sparse).label == "centroid"
    assert of(profile, spikes).label == "profile" and of(profile, spikes, sparse, (4, None, None)).n_votes == 3
    assert of(spikes, flag="profile").source == "data heuristic (file flag said profile)"
    assert of((5, [1.0], [1.0]), flag="centroid").source == "file flag" and of((5, [], [])).label == "unknown"


def test_cube_knows_its_dataset(spark, tmp_path):
    pixels = spark.createDataFrame([(k, k % 3, k // 3) for k in range(9)], "pixel_id int, x int, y int")
    peaks = spark.createDataFrame([(k, 200.0 + k, 1.0) for k in range(9)], "pixel_id int, mz double, intensity double")
    mark = spectra.fingerprint(pixels, peaks)
    spectra.save_cube(spectra.cube(peaks, 200.0, 15.0), mark, str(tmp_path), 2)
    assert spectra.load_cube(spark, str(tmp_path), spectra.fingerprint(pixels.orderBy(F.desc("pixel_id")), peaks.where("mz > 201"))).count() == 9
    with pytest.raises(ValueError, match="another dataset"):
        spectra.load_cube(spark, str(tmp_path), spectra.fingerprint(pixels.withColumn("x", F.col("x") + 1), peaks))


def test_warp_image(spark):
    image = spark.createDataFrame([(x, y, float(x + 10 * y)) for x in range(4) for y in range(4)], "x int, y int, v double")
    turn = [[0.0, -1.0, 3.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]]
    got = {(r.x, r.y): r.v for r in multimodal.warp_image(image, image.select("x", "y"), turn).collect()}
    assert all(got[3 - y, x] == pytest.approx(x + 10 * y) for x in range(4) for y in range(4))
    half = {(r.x, r.y): r.v for r in multimodal.warp_image(image, image.select("x", "y"), [[1.0, 0.0, 0.5], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]).collect()}
    assert half[1, 1] == pytest.approx(10.5) and half[0, 1] is None


def test_empty_images_and_rosters(spark):
    none = spark.createDataFrame([], "pixel_id int, feature_id int, value double")
    assert spectra.relative_max(none).count() == 0 and spectra.relative_window(none, 0, 90).count() == 0
    assert spectra.signal_range(spark.createDataFrame([(1.0, 0.0)], "mz double, v double")).count() == 0
    flat = spark.createDataFrame([(1, 1, 0.0), (2, 1, None)], "pixel_id int, feature_id int, value double")
    assert rows(spectra.relative_window(flat, 10, 90).select("pixel_id", "value"), "pixel_id") == [(1, 0.0), (2, None)]
    roster = spark.createDataFrame([(1, None, "C:/a/x"), (2, "g", None)], "sample_id int, grp string, source string")
    assert rows(cohort.rebase(roster, "c:\\A", "/d").select("sample_id", "moved"), "sample_id") == [(1, "/d/x"), (2, None)]
    new = spark.createDataFrame([(1, " h "), (1, "g"), (9, "z")], "sample_id int, value string")
    assert rows(cohort.assign(roster, new).select("sample_id", "grp"), "sample_id") == [(1, "h"), (2, "g")]
    a = spark.createDataFrame([(f, r, float(f * r)) for f in range(4) for r in range(3)], "feature int, label int, v double")
    b = a.withColumn("v", F.when(F.col("label") > 0, F.col("v")))
    assert regions.cross_correlation(a, b).count() == 3


def test_pieces_and_running_totals(spark):
    from mosaikon.operators.ordered import cumulate, piece

    rng = np.random.default_rng(1)
    some = np.r_[rng.normal(size=300) * 10.0 ** rng.integers(-300, 300, 300), 2.0 ** np.arange(-1074, 1024, 61), np.nextafter(2.0 ** np.arange(-60, 60), 0), 0.0, -0.5, 5e-324, np.inf, -np.inf]
    df = spark.createDataFrame([(float(x), 1) for x in np.unique(some)], "x double, n int")
    got = df.withColumn("k", piece(F.col("x"))).orderBy("x").collect()
    assert all(a.k <= b.k for a, b in zip(got, got[1:], strict=False)) and len({r.k for r in got}) > 300
    assert [r.n for r in cumulate(df, "x", ["n"]).orderBy("x").collect()] == list(range(1, len(got) + 1))
    down = [r.n for r in cumulate(df.withColumn("n", F.col("x")), "x", ["n"], descending=True, how=F.min).orderBy("x").collect()]
    assert down == [r.x for r in got]
    near = spark.createDataFrame([(1 + k * 1e-6, 1) for k in range(50)], "x double, n int")
    assert [r.n for r in cumulate(near, "x", ["n"], descending=True).orderBy("x").collect()] == list(range(50, 0, -1))
    odd = spark.createDataFrame([(None,), (float("nan"),)], "x double").select(piece(F.col("x")).alias("k"))
    assert sorted(r.k or 0 for r in odd.collect()) == [0, 1 << 40]


def test_bh_ways_agree(spark):
    rng = np.random.default_rng(2)
    ps = np.r_[rng.random(200) ** 3, [1.0] * 20, [0.0] * 3, [0.01] * 7]
    df = spark.createDataFrame([(i, float(p)) for i, p in enumerate(ps)] + [(999, None)], "i int, p double")
    a, b = rows(statistics.bh(df).select("i", "q"), "i"), rows(statistics.bh(df, family=[]).select("i", "q"), "i")
    assert a[-1] == (999, None) and [q for _, q in a[:-1]] == pytest.approx([q for _, q in b[:-1]])
    assert statistics.bh(df.limit(0)).count() == 0


def test_segmentation_test_counts_samples_once(spark):
    samples = spark.createDataFrame([(p, p // 10, "A" if p < 30 else "B") for p in range(60)] + [(60, -1, "A"), (61, 0, "B")], "pixel_id int, sample int, grp string")
    values = spark.createDataFrame([(p, 1, p % 10 + p // 10 * 0.01 + (5 if p >= 30 else 0)) for p in range(62)], "pixel_id int, feature int, v double")
    labels = values.select("pixel_id", "feature", (F.col("v") > 6).cast("int").alias("label"))
    got = statistics.segmentation_test(values, labels, samples).first()
    assert (got.n_a, got.n_b) == (3, 3) and got.auc == 1.0 and got.p_value == pytest.approx(0.1)
    share = statistics.segmentation_test(values, labels, samples, "frac_top").first()
    assert share.auc == 1.0


def test_session_is_taken_up_again(spark, tmp_path):
    from mosaikon.session import Session

    pixels = spark.createDataFrame([(k, k % 3, k // 3) for k in range(9)], "pixel_id long, x long, y long")
    peaks = spark.createDataFrame([(k, 300.0, float(k)) for k in range(9)], "pixel_id long, mz double, intensity double")
    s = Session(peaks, pixels)
    s.set_features([300.0, 400.0])
    s.add_region("a 1", pixels.where("x = 0"), "g")
    s.add_region("b/2", pixels.where("x = 1"), "g")
    s.add_region("c", pixels.where("x > 5"))
    s.save(str(tmp_path))
    t = Session(peaks, pixels)
    t.load(str(tmp_path))
    assert t.features == [300.0, 400.0] and sorted(t.region_names()) == ["a 1", "b/2", "c"] and t.group_names() == ["g"]
    assert t.region("b/2").count() == 3 and t.region("c").count() == 0 and t.group("g").count() == 6
    with pytest.raises(ValueError, match="another dataset"):
        Session(peaks, pixels.where("x < 2")).load(str(tmp_path))


def test_diagnose_names_each_cause(spark):
    s = spark.createDataFrame([(1, "a.imzML", ""), (2, "b.raw", "r"), (3, "c.imzml", None), (4, "a.imzML", "r"), (5, "a.imzML", "q"), (6, None, "r"), (7, "a.imzML", "e")], "sample_id int, source string, region string")
    files = spark.createDataFrame([("a.imzML",), ("a.imzML",)], "path string")
    regions_ = spark.createDataFrame([(4, "r", 1), (4, "r", 2), (7, "e", None)], "sample_id int, region string, pixel_id int")
    assert rows(cohort.diagnose(s, files, regions_), "sample_id") == [
        (1, 0, None), (2, 0, "not an imzML source"), (3, 0, "source missing"), (4, 2, None), (5, 0, "region not saved"), (6, 0, "not an imzML source"), (7, 0, "region without pixels"),
    ]
    assert [r.sample_id for r in cohort.missing_sources(s, files).collect()] == [3]


def brute_prominence(v, i):
    left, right = [v[i]], [v[i]]
    for k in range(i - 1, -1, -1):
        if v[k] > v[i]:
            break
        left.append(v[k])
    for k in range(i + 1, len(v)):
        if v[k] > v[i]:
            break
        right.append(v[k])
    return v[i] - max(min(left), min(right))


def test_prominence_and_distance(spark):
    rng = np.random.default_rng(3)
    for v in (rng.random(200), rng.integers(0, 6, 200).astype(float), np.ones(9), np.array([0.0, 2, 2, 2, 0, 3, 1])):
        at, size = intake.summits(v)
        inner = [k for k in range(1, len(v) - 1) if v[k - 1] < v[k]]
        ends = [(k, next(j for j in range(k, len(v)) if j + 1 == len(v) or v[j + 1] != v[k])) for k in inner]
        assert list(at) == [(k + j) // 2 for k, j in ends if j + 1 < len(v) and v[j + 1] < v[k]]
        assert size == pytest.approx([brute_prominence(v, i) for i in at])
    assert list(intake.apart(np.array([1, 3, 5, 9]), np.array([1.0, 3.0, 2.0, 1.0]), 3)) == [False, True, False, True]
    spectrum = spark.createDataFrame([(k, float(x)) for k, x in enumerate([0, 1, 9, 8.5, 9.2, 1, 0, 4, 0, 0, 0, 0, 0.5, 0])], "bin int, v double")
    got = intake.pick_profile(spectrum, snr=0.0, prominence=0.0)
    assert [r.bin for r in got.orderBy("rank").collect()] == [4, 7, 12]


def test_batch_mixing_folds_its_counts(spark, monkeypatch):
    """However often a task counts what it holds, the answer is the same; before it counts it holds some pairs only."""
    rng = np.random.default_rng(9)
    data = [(i, f, i % 3, float(rng.normal(0.5 * (i % 3), 1))) for i in range(120) for f in range(2)]
    t = spark.createDataFrame(data, "row_id int, feature int, batch int, v double")
    want = cohort.batch_mixing(t).first()[0]
    monkeypatch.setattr(cohort, "FOLD", 100)
    assert cohort.batch_mixing(t).first()[0] == want


def test_mixture_joins_nothing_by_way_of_the_driver(spark, monkeypatch):
    """Tables of all pixels aren't broadcast; two halves of a noisy grid are told apart, pixels without a place are left out."""
    plans = []
    def seen(df, label, real=multivariate.scratch):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, label)

    monkeypatch.setattr(multivariate, "scratch", seen)
    rng = np.random.default_rng(10)
    pixels = spark.createDataFrame([(i, i % 20, i // 20) for i in range(400)], "pixel_id int, x int, y int")
    values = spark.createDataFrame([(i, float(rng.normal(3.0 * (i >= 200), 1.0))) for i in range(400)] + [(1000, 1.5)], "pixel_id int, v double")
    got = {r["pixel_id"]: r["label"] for r in multivariate.two_level_mixture(values, pixels, 2).collect()}
    assert len(plans) > 2 and not any("Broadcast" in p for p in plans)
    assert sorted(got) == list(range(400))
    assert np.mean([got[i] == (i >= 200) for i in range(400)]) > 0.97


def test_choose_k_projects_once(spark, monkeypatch):
    """Every fit reads scores that are written once."""
    written = []
    monkeypatch.setattr(multivariate, "scratch", lambda df, label, real=multivariate.scratch: written.append(label) or real(df, label))
    rng = np.random.default_rng(4)
    data = [(p, f, float(max(0, rng.normal(5 if f // 4 == p // 30 else 0.5, 0.2)))) for p in range(90) for f in range(12)]
    assert multivariate.choose_k(spark.createDataFrame(data, "pixel_id int, feature int, v double"), n_components=3) == 3
    assert written == ["scores"]
