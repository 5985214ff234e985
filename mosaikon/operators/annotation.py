"""Compounds for m/z: matches with adducts, false discovery by decoys, isotopes, confidence."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chemistry import ADDUCT_ATOMS, ADDUCTS, C13_STEP, ISOTOPES, formula_mass, ion_mz, isotope_logs
from ..storage import scratch
from .ordered import cumulate
from .ranges import beside_in_order, bucket, dealt, met_in_place, nearest, window_join, within


def species(carbons: range, bonds: range, chains: int = 1, head: tuple[str, float] = ("FA", 31.98982924)) -> list[tuple[str, str, float]]:
    """(name, class, neutral mass) of an in-silico series: CnH2n less two hydrogens for each double bond."""
    ch2, h2 = 14.0156500638, 2.0156500638
    return [(f"{head[0]} {c}:{d}", head[0], head[1] + c * ch2 - d * h2) for c in carbons for d in bonds if d <= max(0, (c - 2) // 2) * chains]


def ion_index(lipids: DataFrame, mode: str = "negative", adducts: list[str] | None = None) -> DataFrame:
    """lipids with a row for each adduct and its ion_mz: a handful of adducts, so rows are exploded.

    Lipids are dealt out before, as a small file is one task and its ions are many.
    """
    chosen = [(a, s, z) for a, (s, z) in ADDUCTS[mode].items() if adducts is None or a in adducts]
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("adduct"), F.lit(s).alias("shift"), F.lit(z).alias("z")) for a, s, z in chosen]))
    return dealt(lipids, "neutral_mass").select("*", each.alias("__a")).select(*lipids.columns, F.col("__a.adduct").alias("adduct"), ((F.col("neutral_mass") + F.col("__a.shift")) / F.col("__a.z")).alias("ion_mz"))


def annotate(features: DataFrame, index: DataFrame, ppm: float = 10.0) -> DataFrame:
    """All candidates of features(feature_id, mz): ppm error, score, and rank within the feature.

    The score is -|ppm| and a tenth of the tolerance for each unit of prior; ties go by class, name and adduct.  Candidates
    are ranked where they are met and not shuffled, unless rows share a feature_id.
    """
    if features.groupBy("feature_id").count().where("count > 1").isEmpty():
        return _ranked(_scored(met_in_place(features, index, ppm, "mz", "ion_mz"), ppm), "__b").drop("__b")
    return _ranked(_scored(window_join(features, index, ppm, "mz", "ion_mz"), ppm))


def _scored(met: DataFrame, ppm: float) -> DataFrame:
    return met.withColumn("ppm", (F.col("mz") - F.col("ion_mz")) / F.col("ion_mz") * 1e6).withColumn("score", F.round(-F.abs("ppm") + 0.1 * ppm * F.col("prior"), 9))


def _ranked(scored: DataFrame, *also: str) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("feature_id", *also).orderBy(F.desc("score"), "class", "name", "adduct")))


#: So many values of prior at most are searched one by one for the best candidate.
PRIORS = 1000


def top_class(features: DataFrame, index: DataFrame, ppm: float = 10.0) -> DataFrame:
    """features with the class of the best candidate, null without any.

    Of ions with one prior only the nearest on either side can be the best, so a feature meets two for each value of prior,
    however many lie in its window; ions that differ by rounding only (M-H of a mass, M-2H of its double) tie, and are
    fetched for the best.  Null priors, those that swallow the ppm error, and more than PRIORS values are taken by all pairs.
    """
    weight = F.abs(0.1 * ppm * F.col("prior"))
    usual, odd = index.where(weight < 1e6), index.where(~F.coalesce(weight < 1e6, F.lit(False)))
    priors = usual.select("prior").distinct().limit(PRIORS + 1)
    asked = dealt(features.select("feature_id", "mz"), "mz")
    if priors.count() > PRIORS:
        best = annotate(asked, index, ppm).where("rank = 1")
    else:
        each = beside_in_order(asked.join(F.broadcast(priors)), usual.select("ion_mz", "prior"), "mz", "ion_mz", ("prior",))
        sides = each.select("feature_id", "mz", "prior", F.explode(F.array("__below.ion_mz", "__above.ion_mz")).alias("ion_mz")).where(within(F.col("mz"), F.col("ion_mz"), ppm))
        top = _scored(dealt(sides, "feature_id"), ppm).withColumn("top", F.max("score").over(Window.partitionBy("feature_id"))).where(F.col("score") >= F.col("top") - 2e-9)
        cell = F.floor(F.log("ion_mz") * F.lit(2.0**40))  # ions of one score lie in one cell or in two side by side
        few = top.select("feature_id", "mz", "prior", F.explode(F.array(*[cell + k for k in (-1, 0, 1)])).alias("__c")).distinct()
        # merged, as Spark would judge the ions by the file their lipids lie in and send all of them through the driver
        met = few.join(usual.withColumn("__c", cell).hint("merge"), ["prior", "__c"]).where(within(F.col("mz"), F.col("ion_mz"), ppm))
        first = _scored(met, ppm).groupBy("feature_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "class", "name", "adduct")).alias("m")).select("feature_id", (-F.col("m.s")).alias("score"), "m.class", "m.name", "m.adduct")
        rest = annotate(asked, odd, ppm).where("rank = 1").select(*first.columns)
        best = _ranked(first.unionByName(rest)).where("rank = 1")
    return features.join(best.select("feature_id", "class", "name"), "feature_id", "left")


def mass_offset(features: DataFrame, index: DataFrame, wide_ppm: float = 15.0, least: int = 30, least_ppm: float = 2.0) -> DataFrame:
    """n, offset: the median signed error of each feature's nearest candidate; zero if few or small."""
    best = nearest(features, index.select("ion_mz"), wide_ppm, ["feature_id"], "mz", "ion_mz").where(F.col("ion_mz").isNotNull())
    err = (F.col("mz") - F.col("ion_mz")) / F.col("ion_mz") * 1e6
    got = best.agg(F.count("*").alias("n"), F.percentile(err, 0.5).alias("m"))
    return got.select("n", F.when((F.col("n") >= least) & (F.abs("m") >= least_ppm), F.col("m")).otherwise(0.0).alias("offset"))


def target_decoy(features: DataFrame, lipids: DataFrame, decoy_shifts: list[float], adduct_shift: float, ppm: float = 10.0) -> DataFrame:
    """feature_id, score, q: for each decoy shift (d + 1) / (t + 1) at the score, the median over shifts, monotone.

    The nearest matches are written once; counts of equal scores are summed in pieces to give how many score as high.
    """
    names = [f"d{k}" for k in range(len(decoy_shifts))]
    kinds = F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), F.lit(float(s)).alias("shift")) for n, s in zip(["t", *names], [0.0, *decoy_shifts], strict=True)]))
    index = dealt(lipids.select("neutral_mass"), "neutral_mass").select("neutral_mass", kinds.alias("k")).select("k.kind", (F.col("neutral_mass") + adduct_shift + F.col("k.shift")).alias("ion_mz"))
    asked = dealt(features.select("feature_id", "mz"), "mz").select("feature_id", "mz", kinds.alias("k")).select("feature_id", "mz", "k.kind")
    near = nearest(asked, index, ppm, ["feature_id", "kind"], "mz", "ion_mz", by=("kind",)).where(F.col("ion_mz").isNotNull())
    hits = scratch(near.select("feature_id", F.round(-F.abs(F.col("mz") - F.col("ion_mz")) / F.col("ion_mz") * 1e6, 6).alias("score"), "kind"), "decoys")
    counts = hits.groupBy("score").agg(F.count_if(F.col("kind") == "t").alias("t"), *[F.count_if(F.col("kind") == n).alias(n) for n in names])
    summed = cumulate(counts, "score", ["t", *names], descending=True)
    ratios = F.array_sort(F.array(*[(F.col(n) + 1) / (F.col("t") + 1) for n in names]))
    k = len(names)
    median = (F.element_at(ratios, (k - 1) // 2 + 1) + F.element_at(ratios, k // 2 + 1)) / 2
    q = cumulate(summed.select("score", F.least(F.lit(1.0), median).alias("q")), "score", ["q"], how=F.min)
    return hits.where("kind = 't'").join(q, "score").select("feature_id", "score", "q")


def deisotope(features: DataFrame, ppm: float = 15.0, charges: tuple = (1,), satellites: tuple = (1, 2)) -> DataFrame:
    """features(feature_id, mz, intensity) with satellite: a strictly more intense peak is n * 1.00336 / z below."""
    steps = F.explode(F.array(*[F.lit(n * C13_STEP / z) for n in satellites for z in charges]))
    down = features.select("feature_id", "mz", "intensity", steps.alias("step")).where("mz > step")
    # the tolerance is relative to the satellite's own m/z, and so is the bucket
    asked = down.withColumn("__b", F.explode(F.array(*[bucket(F.col("mz") - F.col("step"), 2 * ppm) + F.lit(k) for k in (-1, 0, 1)])))
    refs = features.select(F.col("mz").alias("m0"), F.col("intensity").alias("i0"), bucket(F.col("mz"), 2 * ppm).alias("__b"))
    near = F.abs(F.col("m0") - (F.col("mz") - F.col("step"))) <= F.col("mz") * ppm / 1e6
    hit = asked.join(refs, "__b").where(near & (F.col("i0") > F.col("intensity"))).select("feature_id").distinct().withColumn("__s", F.lit(True))
    return features.join(hit, "feature_id", "left").withColumn("satellite", F.coalesce("__s", F.lit(False))).drop("__s")


def isotope_scores(values: DataFrame, envelope: list[tuple[int, float]]) -> DataFrame:
    """spectral and spatial score of an envelope [(feature, theory)], the first being the base peak.

    values(pixel_id, feature, v) has a row for every pixel and feature of the envelope.
    """
    theory = F.create_map(*[x for f, t in envelope for x in (F.lit(f), F.lit(float(t)))])
    base = envelope[0][0]
    own = values.where(F.col("feature").isin([f for f, _ in envelope])).select("pixel_id", F.col("feature").alias("f"), "v")
    m0 = own.where(F.col("f") == base).select("pixel_id", F.col("v").alias("v0"))
    per = own.join(m0, "pixel_id").groupBy("f").agg(F.sum("v").alias("s"), F.corr("v0", "v").alias("r")).withColumn("t", F.element_at(theory, F.col("f")))
    norms = per.agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("ns"), F.sqrt(F.sum(F.col("t") * F.col("t"))).alias("nt"))
    got = per.join(F.broadcast(norms))
    other = F.col("f") != base
    return got.agg(
        F.greatest(F.lit(0.0), 1 - F.avg(F.abs(F.col("t") / F.col("nt") - F.col("s") / F.col("ns")))).alias("spectral"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.sum(F.when(other, F.col("t") * F.coalesce("r", F.lit(0.0)))) / F.sum(F.when(other, F.col("t"))))).alias("spatial"),
    )


def msi_level(table: DataFrame) -> DataFrame:
    """level 1 to 5 from annotated, ms2, formula_only, ambiguous, isotope_ok and spatial_ok."""
    level = (
        F.when(~F.col("annotated"), 5).when(F.col("ms2"), 1).when(F.col("formula_only"), 4).when(F.col("ambiguous"), 3)
        .when(F.col("isotope_ok") & F.col("spatial_ok"), 2).otherwise(3)
    )
    return table.withColumn("level", level)


def corroborating(features: DataFrame, index: DataFrame, ppm: float = 10.0) -> DataFrame:
    """lipid_id, n_adducts, adducts: which ions of a compound are among the features.

    If an ion is in any feature's window, it is in that of the feature below it or above it.
    """
    sides = beside_in_order(index.select("lipid_id", "adduct", "ion_mz"), features.select("mz"), "ion_mz", "mz")
    has = [F.coalesce(within(F.col(f"{c}.mz"), F.col("ion_mz"), ppm), F.lit(False)) for c in ("__below", "__above")]
    met = sides.where(has[0] | has[1]).select("lipid_id", "adduct").distinct()
    return met.groupBy("lipid_id").agg(F.count("*").alias("n_adducts"), F.concat_ws(",", F.array_sort(F.collect_list("adduct"))).alias("adducts"))


def compare_lists(ours: DataFrame, theirs: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join of two annotation lists (q, fdr): agreement and the difference of both."""
    a, b = ours.withColumn("__a", F.lit(True)), theirs.withColumn("__b", F.lit(True))
    side = F.when(F.col("__a") & F.col("__b"), "both").when(F.col("__a"), "ours_only").otherwise("theirs_only")
    return a.join(b, keys, "full_outer").select(*keys, "q", "fdr", side.alias("agreement"), (F.col("q") - F.col("fdr")).alias("delta"))


def attach_fdr(features: DataFrame, lipids: DataFrame, decoy_shifts: list[float], adduct_shift: float, ppm: float = 5.0, q_max: float | None = None, keep_unannotated: bool = True, recalibrate: bool = True, wide_ppm: float = 15.0) -> DataFrame:
    """features(feature_id, mz) with q_value (null without a compound) and fdr_pass.

    With recalibrate, masses are first divided by 1 + the list's own mass_offset.  With q_max, features above it go,
    and those without a compound stay only if keep_unannotated.
    """
    asked = features.select("feature_id", "mz")
    if recalibrate:
        off = mass_offset(asked, lipids.select((F.col("neutral_mass") + adduct_shift).alias("ion_mz")), wide_ppm).select("offset")  # one row
        asked = asked.join(F.broadcast(off)).select("feature_id", (F.col("mz") / (1 + F.col("offset") * 1e-6)).alias("mz"))
    q = target_decoy(asked, lipids, decoy_shifts, adduct_shift, ppm).select("feature_id", F.col("q").alias("q_value"))
    known = F.col("q_value").isNotNull()
    passed = known if q_max is None else known & (F.col("q_value") <= q_max)
    got = features.join(q, "feature_id", "left").withColumn("fdr_pass", F.coalesce(passed, F.lit(False)))
    return got if q_max is None else got.where(F.col("fdr_pass") | (~known & F.lit(keep_unannotated)))


def isotope_distribution(formulas: DataFrame, offsets: int = 4) -> DataFrame:
    """formulas(formula_id, atoms: map of element to count) with a row for each of 0..offsets extra nucleons: mass, abundance.

    The mass is the mean over the isotopologues of that offset, null where there are none.  With L(k) the sum over atoms
    of isotope_logs, the ratios to the lightest isotopologue are c(k) = sum of j L(j) c(k - j) / k; masses follow from
    the same sum's derivative.  A few columns of arithmetic do a whole formula, however many atoms it has.
    Elements without isotopes on record count as none; a null map gives nulls.
    """
    logs = {e: isotope_logs(e, offsets) for e in ISOTOPES}
    n = lambda e: F.greatest(F.lit(0), F.coalesce(F.try_element_at("atoms", F.lit(e)), F.lit(0)))
    total = lambda weight: sum((n(e) * F.lit(float(weight(e))) for e in ISOTOPES if weight(e)), F.lit(0.0))
    df = formulas.withColumns({f"__l{k}": total(lambda e, k=k: logs[e][k - 1][0]) for k in range(1, offsets + 1)} | {f"__d{k}": total(lambda e, k=k: logs[e][k - 1][1]) for k in range(1, offsets + 1)})
    df = df.withColumns({"__p": F.exp(total(lambda e: math.log(ISOTOPES[e][0][1]))), "__m": total(lambda e: ISOTOPES[e][0][0]), "__c0": F.lit(1.0), "__w0": F.lit(0.0)})
    for k in range(1, offsets + 1):
        col = lambda a, j: F.col(f"__{a}{j}")
        c = sum((j * col("l", j) * col("c", k - j) for j in range(1, k + 1)), F.lit(0.0)) / k
        w = sum((j * (col("l", j) * col("w", k - j) + col("d", j) * col("c", k - j)) for j in range(1, k + 1)), F.lit(0.0)) / k
        df = df.withColumns({f"__c{k}": c, f"__w{k}": w})
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("offset"), F.col(f"__c{k}").alias("c"), F.col(f"__w{k}").alias("w")) for k in range(offsets + 1)]))
    there = F.col("__e.c") > 0
    return df.select(*formulas.columns, each.alias("__e"), "__p", "__m").select(
        *formulas.columns, "__e.offset", F.when(there, F.col("__m") + F.col("__e.w") / F.col("__e.c")).alias("mass"), F.greatest(F.lit(0.0), F.col("__p") * F.col("__e.c")).alias("abundance")
    )


def ion_pattern(formulas: DataFrame, adduct: str, peaks: int = 3) -> DataFrame:
    """formulas(formula_id, atoms) with offset, mz, rel_intensity of an ion's isotopes, the largest being one.

    The lightest stands at ion_mz of the neutral formula, the others as far above as the ion's own atoms say.
    """
    delta = ADDUCT_ATOMS[adduct]
    z = next(a[adduct][1] for a in ADDUCTS.values() if adduct in a)
    extra = F.create_map(*[x for e, k in delta.items() for x in (F.lit(e), F.lit(k))])
    both = F.map_zip_with("atoms", extra, lambda _, a, d: F.coalesce(a, F.lit(0)) + F.coalesce(d, F.lit(0)))
    named = formulas.select("formula_id", F.col("atoms").alias("__atoms"), both.alias("atoms"))
    dist = isotope_distribution(named, peaks - 1).where("abundance > 0")
    w = Window.partitionBy("formula_id")
    base = F.min_by("mass", "offset").over(w)
    return dist.select(
        "formula_id", "offset", (ion_mz(formula_mass(F.col("__atoms")), adduct) + (F.col("mass") - base) / z).alias("mz"), (F.col("abundance") / F.max("abundance").over(w)).alias("rel_intensity")
    )


def averagine_check(features: DataFrame, peaks: DataFrame, ppm: float = 100.0, charge: int = 1) -> DataFrame:
    """features(feature_id, mz) with m1_ratio, m2_ratio, n_carbon, expected_m1 and consistent, where no formula is known.

    An ion of m/z * z has one carbon for each 14 Da, and each carbon 1.1 % of M+1; from half to 2.5 times of that fits.
    Features without signal have ratios of zero and aren't consistent.
    """
    steps = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col("mz") + k * C13_STEP / charge).alias("at")) for k in range(3)]))
    asked = features.select("feature_id", steps.alias("s")).select("feature_id", "s.k", "s.at")
    met = window_join(asked, peaks.select(F.col("mz").alias("peak_mz"), "intensity"), ppm, "at", "peak_mz")
    s = lambda k: F.coalesce(F.sum(F.when(F.col("k") == k, F.col("intensity"))), F.lit(0.0))
    sums = met.groupBy("feature_id").agg(*[s(k).alias(f"s{k}") for k in range(3)])
    got = features.join(sums, "feature_id", "left")
    some = F.coalesce(F.col("s0") > 0, F.lit(False))
    carbons = F.greatest(F.lit(1.0), F.bround(F.col("mz") * charge / 14.0, 0))
    m1, expected = F.when(some, F.col("s1") / F.col("s0")).otherwise(0.0), F.when(some, carbons * 0.011).otherwise(0.0)
    return got.select(
        "feature_id", m1.alias("m1_ratio"), F.when(some, F.col("s2") / F.col("s0")).otherwise(0.0).alias("m2_ratio"), F.when(some, carbons).otherwise(0.0).cast("int").alias("n_carbon"),
        expected.alias("expected_m1"), (some & (m1 > 0) & m1.between(0.5 * expected, 2.5 * expected)).alias("consistent"),
    )




def confidence(table: DataFrame, ppm: float = 10.0) -> DataFrame:
    """table(ppm, isotope, n_adducts, lead, prior, isotope_ok) with confidence (0 to 100) and its grade.

    Half is closeness, .22 the isotope score, .16 other adducts (two are enough), .12 the lead over the next candidate.
    """
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    score = 100 * (0.5 * unit(1 - F.abs("ppm") / ppm) + 0.22 * unit(F.coalesce("isotope", F.lit(0.0))) + 0.16 * unit((F.col("n_adducts") - 1) / 2.0) + 0.12 * unit(F.coalesce("lead", F.lit(0.0)) / ppm))
    grade = F.when((F.col("confidence") >= 70) & F.col("isotope_ok"), "High").when(F.col("confidence") >= 45, "Medium").otherwise("Low")
    return table.withColumn("confidence", score).withColumn("grade", grade)


def search_urls(table: DataFrame) -> DataFrame:
    """table(name) with a literature search address."""
    return table.withColumn("url", F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/?term="), F.url_encode("name")))
