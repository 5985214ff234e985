"""Designs with subjects and compartments: moderated tests, mixed models, gene-set style competition.

Features are independent of one another, so each is one group; what they share, a prior of variances, is a handful of
moments that goes to the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import special
from . import statistics as st


def pooled_variance(values: DataFrame, keys: list[str] | None = None, a: str = "A", b: str = "B") -> DataFrame:
    """keys, n_a, n_b, means, s2 (pooled) and d (its degrees of freedom)."""
    m = st.moments(values, keys, a, b)
    d = F.col("n_a") + F.col("n_b") - 2
    s2 = ((F.col("n_a") - 1) * F.col("sd_a") * F.col("sd_a") + (F.col("n_b") - 1) * F.col("sd_b") * F.col("sd_b")) / d
    return m.where((F.col("n_a") > 0) & (F.col("n_b") > 0) & (d > 0)).withColumns({"s2": s2, "d": d.cast("double")})


def fit_prior(variances: DataFrame) -> tuple[float, float]:
    """(d0, s0) of the scaled inverse chi-squared prior, from moments of log s2; d0 is infinite if they don't spread."""
    @F.pandas_udf(DoubleType())
    def shift(d: pd.Series) -> pd.Series:
        known = {x: special.digamma(x / 2) - math.log(x / 2) for x in d.unique()}
        return d.map(known)

    @F.pandas_udf(DoubleType())
    def spread(d: pd.Series) -> pd.Series:
        known = {x: special.trigamma(x / 2) for x in d.unique()}
        return d.map(known)

    e = F.log("s2") - shift("d")
    row = variances.where("s2 > 0").select(e.alias("e"), spread("d").alias("t"), "s2").agg(F.avg("e").alias("m"), F.var_samp("e").alias("v"), F.avg("t").alias("t"), F.avg("s2").alias("s")).first()
    if row["m"] is None:
        return math.inf, 1.0
    extra = (row["v"] or 0.0) - row["t"]
    if extra <= 0:
        return math.inf, float(row["s"])
    y = 0.5 + 1 / extra  # Newton steps on the inverse of trigamma
    for _ in range(50):
        t = special.trigamma(y)
        h = 1e-5 * y
        step = t * (1 - t / extra) / ((special.trigamma(y + h) - special.trigamma(y - h)) / (2 * h))
        y += step
        if -step / y < 1e-8:
            break
    return 2 * y, math.exp(row["m"] + special.digamma(y) - math.log(y))


def squeeze(variances: DataFrame, d0: float, s0: float) -> DataFrame:
    """s2 drawn towards a prior: s2_post and its degrees of freedom."""
    if math.isinf(d0):
        return variances.withColumns({"s2_post": F.lit(s0), "df": F.lit(1e9)})
    d = F.col("d")
    return variances.withColumns({"s2_post": (d0 * s0 + d * F.col("s2")) / (d0 + d), "df": d + d0})


def moderated_t(values: DataFrame, keys: list[str] | None = None, a: str = "A", b: str = "B") -> DataFrame:
    """keys, t, df, p_value, q_value with variances that borrow from all features."""
    v = pooled_variance(values, keys, a, b)
    s = squeeze(v, *fit_prior(v))
    t = (F.col("mean_b") - F.col("mean_a")) / (F.sqrt("s2_post") * F.sqrt(1 / F.col("n_a") + 1 / F.col("n_b")))
    return st.bh(s.withColumn("t", t).withColumn("p_value", st.p_of_t("t", "df")), "p_value", "q_value", [])


def stratified(values: DataFrame, stratum: str = "compartment") -> DataFrame:
    """two_group_test inside each stratum; the family of the q-values is the stratum."""
    m = st.two_group(values, [stratum, "feature"]).withColumn("p_value", st.p_of_rank("u", "z", "n_a", "n_b", "tied"))
    return st.bh(m, "p_value", "q_value", [stratum])


def _reml(xx0: np.ndarray, xy0: np.ndarray, yy0: float, sizes: np.ndarray, many: np.ndarray, xs: np.ndarray, ys: np.ndarray, yys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimates and their covariance in a model with a random intercept for each subject.

    xx0, xy0, yy0: X'X, X'y, y'y.  Subjects of one design are a row of the others: rows a subject has, subjects, the
    subject's sum of X, and over subjects the sum of their sums of y and of the squares of these.
    """

    def at(lam: float):
        w = lam / (1 + lam * sizes)
        xx = xx0 - (xs * (w * many)[:, None]).T @ xs
        xy = xy0 - (xs * w[:, None]).T @ ys
        beta = np.linalg.solve(xx, xy)
        rss = float(yy0 - 2 * beta @ xy0 + beta @ xx0 @ beta - (w * (yys - 2 * ys * (xs @ beta) + many * (xs @ beta) ** 2)).sum())
        n = (sizes * many).sum() - len(xy0)
        rss = max(rss, 1e-14 * yy0)
        return (n * math.log(max(rss, 1e-300) / n) + (many * np.log1p(lam * sizes)).sum() + np.linalg.slogdet(xx)[1]), beta, np.linalg.inv(xx) * rss / n

    grid = [0.0, *np.exp(np.linspace(-6, 6, 25))]
    k = int(np.argmin([at(g)[0] for g in grid]))
    lo, hi = grid[max(0, k - 1)], grid[min(len(grid) - 1, k + 1)]
    g = (math.sqrt(5) - 1) / 2
    for _ in range(40):  # golden section
        p, q = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, q) if at(p)[0] < at(q)[0] else (p, hi)
    _, beta, cov = at((lo + hi) / 2)
    return beta, cov


def mixed_model(values: DataFrame) -> DataFrame:
    """feature, term, estimate, se, df, p_value of v ~ group * compartment + (1 | subject).

    values(feature, subject, grp, compartment, v); the first group and compartment by name are the reference.  Terms of
    the group alone have between-subject degrees of freedom, the others within-subject ones.  The likelihood needs sums
    only: those of each cell (group and compartment), and for each design (how many rows of which cells a subject has)
    those over its subjects.  They are aggregated first, so that a task holds a feature's cells and designs and not its
    subjects.
    """
    kinds = "feature long, term string, estimate double, se double, df double"
    fine = values.where(F.col("v").isNotNull() & ~F.isnan(F.col("v").cast("double"))).withColumn("v", F.col("v").cast("double"))
    cells = fine.groupBy("feature", "subject", "grp", "compartment").agg(F.count("*").alias("n"), F.sum("v").alias("y"), F.sum(F.col("v") * F.col("v")).alias("yy"))
    subjects = cells.groupBy("feature", "subject").agg(F.array_sort(F.collect_list(F.struct("grp", "compartment", "n"))).alias("design"), F.sum("y").alias("y"))  # a subject's few cells
    designs = subjects.groupBy("feature", "design").agg(F.count("*").alias("n"), F.sum("y").alias("y"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    totals = cells.groupBy("feature", "grp", "compartment").agg(F.sum("n").alias("n"), F.sum("y").alias("y"), F.sum("yy").alias("yy"))
    sums = totals.withColumn("design", F.array(F.struct("grp", "compartment", "n"))).select("feature", F.lit(True).alias("cell"), "design", "n", "y", "yy").unionByName(designs.withColumn("cell", F.lit(False)))

    def fit(key: tuple, t: pa.Table) -> pa.Table:
        f, rows = t.to_pylist(), []
        own = [(r["design"][0]["grp"], r["design"][0]["compartment"], r["n"], r["y"], r["yy"]) for r in f if r["cell"]]
        groups, comps = sorted({c[0] for c in own}), sorted({c[1] for c in own})
        n = sum(c[2] for c in own)
        if len(groups) == 2 and n > 2 * len(comps) + 1:
            def line(grp, comp):
                g, c = float(grp == groups[1]), [float(comp == k) for k in comps[1:]]
                return np.array([1.0, g, *c, *[g * k for k in c]])

            x, many = np.stack([line(*c[:2]) for c in own]), np.array([c[2] for c in own], float)
            names = ["intercept", "group", *comps[1:], *[f"group:{k}" for k in comps[1:]]]
            if np.linalg.matrix_rank(x) == x.shape[1]:
                met = [r for r in f if not r["cell"]]
                xs = np.stack([sum(line(d["grp"], d["compartment"]) * d["n"] for d in r["design"]) for r in met])
                num = lambda k: np.array([r[k] for r in met], float)
                sizes = np.array([sum(d["n"] for d in r["design"]) for r in met], float)
                beta, cov = _reml((x * many[:, None]).T @ x, x.T @ np.array([c[3] for c in own]), sum(c[4] for c in own), sizes, num("n"), xs, num("y"), num("yy"))
                n_sub = int(num("n").sum())
                between, within = max(1, n_sub - 2), max(1, n - n_sub - (x.shape[1] - 2))
                rows = [(names[k], float(beta[k]), float(math.sqrt(max(cov[k, k], 0))), float(between if k < 2 else within)) for k in range(len(names))]
        cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        return pa.table([pa.array([key[0].as_py()] * len(rows), pa.int64()), pa.array(cols[0], pa.string()), *[pa.array(c, pa.float64()) for c in cols[1:]]], ["feature", "term", "estimate", "se", "df"])

    out = sums.groupBy("feature").applyInArrow(fit, kinds)
    t = F.when(F.col("se") > 0, F.col("estimate") / F.col("se"))
    return st.bh(out.withColumn("t", t).withColumn("p_value", st.p_of_t("t", "df")), "p_value", "q_value", ["term"])


def unit_residuals(values: DataFrame) -> DataFrame:
    """feature, unit, r of values(feature, unit, grp, v): what the groups' means leave, scaled to length one.

    Units are subjects or samples, and only fixed effects are taken out, so that what couples the features of a class
    stays in.  A feature that the means fit exactly has zeros.
    """
    left = F.col("v") - F.avg("v").over(Window.partitionBy("feature", "grp"))
    e = values.where(F.col("v").isNotNull()).select("feature", "unit", left.alias("e"))
    norms = e.groupBy("feature").agg(F.sqrt(F.sum(F.col("e") * F.col("e"))).alias("n"))
    return e.join(norms, "feature").select("feature", "unit", F.when(F.col("n") > 1e-12, F.col("e") / F.col("n")).otherwise(0.0).alias("r"))


def class_correlation(residuals: DataFrame, classes: DataFrame) -> DataFrame:
    """class, m, r_bar: the mean correlation between the features of classes(feature, class); zero for a single one.

    Residuals have length one, so the sum over units of the squared sum over features holds all pairs at once.
    """
    met = residuals.join(classes.select("feature", "class"), "feature")
    m = F.col("m")
    size = met.select("class", "feature").distinct().groupBy("class").agg(F.count("*").alias("m"))
    square = met.groupBy("class", "unit").agg(F.sum("r").alias("s")).groupBy("class").agg(F.sum(F.col("s") * F.col("s")).alias("ss"))
    return size.join(square, "class").select("class", "m", F.when(m > 1, (F.col("ss") - m) / (m * (m - 1))).otherwise(0.0).alias("r_bar"))


def camera(scores: DataFrame, r_bar: float | DataFrame = 0.01, min_vif: float = 1.0) -> DataFrame:
    """class, m, p_value, direction of scores(feature, class, t): do a class's features rank apart from the others?

    The rank sum's variance is inflated for a correlation r_bar between features of a class: one for all, or a table
    (class, r_bar) such as class_correlation gives.
    """
    ranked = st.tie_blocks(scores.select(F.lit(0).alias("k"), F.col("t").alias("v")), F.lit(True), ["k"]).select(F.col("v").alias("t"), "rank")
    n = scores.agg(F.count("*").alias("n"), F.sum("t").alias("all"))
    own = scores.join(ranked, "t").groupBy("class").agg(F.count("*").alias("m"), F.sum("rank").alias("r"), F.sum("t").alias("s")).join(F.broadcast(n)).where("m < n AND m > 1")
    if isinstance(r_bar, DataFrame):
        own = own.join(r_bar.select("class", "r_bar"), "class", "left").withColumn("r_bar", F.coalesce("r_bar", F.lit(0.0)))
    else:
        own = own.withColumn("r_bar", F.lit(float(r_bar)))

    @F.pandas_udf(DoubleType())
    def p(m: pd.Series, r: pd.Series, n: pd.Series, bar: pd.Series) -> pd.Series:
        m, r, n = m.to_numpy(float), r.to_numpy(float), n.to_numpy(float)
        k = n - m
        rho = np.maximum(np.clip(bar.to_numpy(float), -1, 1), (min_vif - 1) / np.maximum(1, m - 1))
        u = m * k + m * (m + 1) / 2 - r
        var = m * k / (2 * math.pi) * (math.asin(1) + (k - 1) * math.asin(0.5) + (m - 1) * (k - 1) * np.arcsin(rho / 2) + (m - 1) * np.arcsin((rho + 1) / 2))
        lower, upper = (u + 0.5 - m * k / 2) / np.sqrt(var), (u - 0.5 - m * k / 2) / np.sqrt(var)
        return pd.Series(np.minimum(1, 2 * np.minimum(special.normal_sf(-lower), special.normal_sf(upper))))

    got = own.withColumn("p_value", p("m", "r", "n", "r_bar")).withColumn("direction", F.when(F.col("s") / F.col("m") < (F.col("all") - F.col("s")) / (F.col("n") - F.col("m")), "down").otherwise("up"))
    return st.bh(got.select("class", "m", "p_value", "direction"), "p_value", "q_value", [])
