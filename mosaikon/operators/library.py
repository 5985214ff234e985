"""Spectra against spectra: library search and class evidence from fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.chemistry import ELECTRON, ELEMENTS


def search(queries: DataFrame, library: DataFrame, precursor_da: float = 0.5, fragment_da: float = 0.01, top: int = 5) -> DataFrame:
    """query_id, name, cosine, modified, entropy, rank: the best library spectra of a near precursor.

    Both sides hold precursor, mz and intensity; a bucket of the precursor's tolerance makes it an equi-join.
    """
    b = lambda c: F.floor(F.col(c) / (2 * precursor_da))
    q = queries.select("query_id", F.col("precursor").alias("qp"), F.col("mz").alias("qm"), F.col("intensity").alias("qi"), F.explode(F.array(b("precursor") - 1, b("precursor"), b("precursor") + 1)).alias("__b"))
    lib = library.select("name", F.col("precursor").alias("lp"), F.col("mz").alias("lm"), F.col("intensity").alias("li"), b("precursor").alias("__b"))
    met = q.join(lib, "__b").where(F.abs(F.col("qp") - F.col("lp")) <= precursor_da)
    args = ("qm", "qi", "qp", "lm", "li", "lp")
    scored = met.select("query_id", "name", *[make(fragment_da)(*args).alias(n) for n, make in (("cosine", arrays.cosine), ("modified", arrays.modified_cosine), ("entropy", arrays.entropy_likeness))])
    w = Window.partitionBy("query_id").orderBy(F.desc("modified"), F.desc("entropy"), "name")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def verdict(score: Column, strong: float = 0.8, weak: float = 0.5) -> Column:
    return F.when(score.isNull(), "no evidence").when(score >= strong, "confirmed").when(score >= weak, "tentative").otherwise("unsupported")


def class_evidence(spectra: DataFrame, rules: DataFrame, da: float = 0.01) -> DataFrame:
    """query_id, class, hits of spectra(query_id, precursor, mz) by rules(class, kind, value): fragments and losses."""
    peaks = spectra.select("query_id", "precursor", F.explode("mz").alias("m"))
    both = peaks.select("query_id", F.explode(F.array(F.struct(F.lit("fragment").alias("kind"), F.col("m").alias("v")), F.struct(F.lit("loss").alias("kind"), (F.col("precursor") - F.col("m")).alias("v")))).alias("p")).select("query_id", "p.kind", "p.v")
    b = lambda c: F.floor(F.col(c) / (2 * da))
    spread = rules.select("class", "kind", "value", F.explode(F.array(b("value") - 1, b("value"), b("value") + 1)).alias("__b"))
    met = both.withColumn("__b", b("v")).join(F.broadcast(spread), ["kind", "__b"]).where(F.abs(F.col("v") - F.col("value")) <= da)
    return met.select("query_id", "class", "kind", "value").distinct().groupBy("query_id", "class").agg(F.count("*").alias("hits"))


def aligned_cosine(a: DataFrame, b: DataFrame) -> DataFrame:
    """a_id, b_id, cosine of spectra on one axis (id, bin, v): bins that both have, lengths over all."""
    na, nb = (t.groupBy(F.col("id").alias(n)).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias(f"n{n}")) for t, n in ((a, "a_id"), (b, "b_id")))
    dots = a.select(F.col("id").alias("a_id"), "bin", F.col("v").alias("x")).join(b.select(F.col("id").alias("b_id"), "bin", F.col("v").alias("y")), "bin").groupBy("a_id", "b_id").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    return dots.join(na, "a_id").join(nb, "b_id").select("a_id", "b_id", F.when(F.col("na_id") * F.col("nb_id") > 0, F.col("dot") / (F.col("na_id") * F.col("nb_id"))).otherwise(0.0).alias("cosine"))


def carboxylates(carbons: range = range(12, 25), bonds: range = range(7)) -> list[tuple[str, float]]:
    """(C:D, m/z) of deprotonated fatty acids, CnH(2n - 2d)O2."""
    c, h, o = (ELEMENTS[e] for e in "CHO")
    return [(f"{n}:{d}", n * c + (2 * n - 2 * d - 1) * h + 2 * o + ELECTRON) for n in carbons for d in bonds]


def acyl_chains(fragments: DataFrame, carbons: range = range(12, 25), bonds: range = range(7), da: float = 0.01) -> DataFrame:
    """query_id, chain, strength, rank of fragments(query_id, mz, intensity): the fatty acids whose ions are there.

    The strength is the most intense fragment within da; a null intensity counts as one.  Chains of equal strength are
    ranked by name.  The table of acids is a row for each pair of the two ranges, whatever the spectra.
    """
    b = lambda c: F.floor(F.col(c) / (2 * da))
    acids = fragments.sparkSession.createDataFrame(carboxylates(carbons, bonds), "chain string, ion double")
    spread = acids.select("*", F.explode(F.array(b("ion") - 1, b("ion"), b("ion") + 1)).alias("__b"))
    met = fragments.withColumn("__b", b("mz")).join(F.broadcast(spread), "__b").where(F.abs(F.col("mz") - F.col("ion")) <= da)
    best = met.groupBy("query_id", "chain").agg(F.max(F.coalesce("intensity", F.lit(1.0))).alias("strength"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("strength"), "chain")))
