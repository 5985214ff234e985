"""Mixing sources to target weights by soft membership.

1. A naive Bayes classifier learns from a labelled table which words speak for which domain.  Words fall into CELLS hash
   cells, so that all of them count and the model has a fixed size.
2. It gives every document the posterior of each domain, so a document's tokens count in part for several.
3. Projected gradient descent fits a rate >= 0 for each document, so that the rates times tokens times posteriors add
   up, domain by domain, to the targets, staying as near to one rate for all as the targets allow.

Rates live with their documents and are never gathered: an iteration is one aggregate of as many sums as there are
domains.  All of it is DataFrame functions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WHITE, draw, named, scratch, unused

#: Labelled documents of each domain that the classifier learns from, the hash cells of its words, smoothing.
SAMPLE, CELLS, SMOOTH = 1000, 1 << 16, 0.5
#: Most steps of the fit, its tolerance relative to the targets, and how often rates are written down.
STEPS, TOLERANCE, EVERY = 100, 1e-4, 10


def _words(docs: DataFrame, *columns) -> DataFrame:
    """A row for each word, and one with an empty word for each document."""
    return docs.select(*columns, F.explode(F.array_append(F.split(F.lower(F.coalesce("text", F.lit(""))), f"{WHITE}+"), "")).alias("word"))


def _cell():
    return F.pmod(F.xxhash64("word"), F.lit(CELLS)).cast("int")


def learn(labelled: DataFrame, label: str, sample: int = SAMPLE) -> tuple[DataFrame, list]:
    """labelled(doc_id, text, label) -> (cell, logp) and the domains: for each domain in the order of its name, log P(cell | domain).

    It learns from `sample` documents of each domain, drawn by a hash of doc_id, and from all of their words.  logp
    has a row for each cell that the sample touches, CELLS at most.  Domains are the labels that occur: a few.
    """
    known = labelled.where(F.col(label).isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col(label).alias("domain"), "text")
    drawn = draw(known, "domain", sample)
    words = _words(known.join(F.broadcast(drawn), ["doc_id", "domain"]), "domain").where("word <> ''")
    counts = scratch(words.groupBy("domain", _cell().alias("cell")).agg(F.count("*").alias("n")), "domain-words")
    totals = {r["domain"]: r["t"] for r in counts.groupBy("domain").agg(F.sum("n").alias("t")).collect()}
    domains = sorted(totals)
    table = counts.groupBy("cell").pivot("domain", domains).agg(F.sum("n"))
    logp = [F.log((F.coalesce(F.col(f"`{d}`"), F.lit(0)) + SMOOTH) / (totals[d] + SMOOTH * CELLS)) for d in domains]
    return table.select("cell", F.array(*logp).alias("logp")), domains


def posteriors(docs: DataFrame, model: DataFrame, domains: list) -> DataFrame:
    """docs(doc_id, text) -> doc_id, version, tokens, post (array, in the order of domains).

    Words of a text go together, so its evidence counts as that of the square root of their number: a smoothing that
    every document has alike.  A document without a known word has even posteriors; one without words has no tokens.
    version tells texts of one doc_id apart; rows that repeat a doc_id and its text are one member with all their tokens.
    """
    text = F.coalesce("text", F.lit(""))
    words = _words(docs.select("doc_id", "text", F.xxhash64(text).alias("version")), "doc_id", "version")
    met = words.withColumn("cell", F.when(F.col("word") != "", _cell())).join(F.broadcast(model), "cell", "left")
    sums = [F.sum(F.coalesce(F.get("logp", F.lit(k)), F.lit(0.0))).alias(f"s{k}") for k in range(len(domains))]
    summed = met.groupBy("doc_id", "version").agg(F.count_if(F.col("word") != "").alias("tokens"), F.count("logp").alias("known"), *sums)
    temper = 1 / F.sqrt(F.greatest(F.col("known"), F.lit(1)))
    top = F.greatest(*[F.col(f"s{k}") for k in range(len(domains))]) if len(domains) > 1 else F.col("s0")
    odds = [F.exp((F.col(f"s{k}") - top) * temper) for k in range(len(domains))]
    total = sum(odds[1:], odds[0])
    return summed.select("doc_id", "version", "tokens", F.array(*[o / total for o in odds]).alias("post"))


def fit_rates(members: DataFrame, targets: list[float], steps: int = STEPS) -> DataFrame:
    """members(tokens, post, ...) -> members with rate >= 0, residual and converged.

    With A the tokens times posteriors, it minimises (A r - t)' G (A r - t) over r >= 0 by projected gradient, from the
    one rate that meets the sum of the targets.  G is the inverse of the sum of tokens * post * post', a table of
    domains times domains; with it, and gradients taken for each token, the step 1 is the longest that is safe, and
    the first step is already exact unless it takes rates below zero.

    residual is how far the worst domain is from its target, as a part of all tokens; converged says whether that is
    within TOLERANCE.  It isn't where rates below zero would be needed, or `steps` ended the descent.  Members without
    tokens (null and empty texts) have a rate too and move nothing; where no tokens or no targets are, all rates are 0,
    and 1 where there is no domain.  An empty table gives none.
    """
    n, total, t = len(targets), float(sum(targets)), F.col("tokens")
    share = [F.get("post", F.lit(k)) for k in range(n)]
    first = members.agg(F.sum(t).alias("all"), *[F.sum(t * share[i] * share[j]).alias(f"g{i}_{j}") for i in range(n) for j in range(i, n)]).first()
    if not n or not first["all"] or not total:
        return members.withColumns({"rate": F.lit(0.0 if n else 1.0), "residual": F.lit(0.0), "converged": F.lit(True)})
    gram = np.array([[first[f"g{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)], float)
    weigh = np.linalg.pinv(gram, rcond=1e-9)
    rated = members.withColumn("rate", F.lit(total / first["all"]))
    for step in range(steps + 1):
        got = rated.agg(*[F.sum(F.col("rate") * t * s) for s in share]).first()
        off = np.array(got, float) - np.array(targets, float)
        residual = float(np.abs(off).max() / total)
        if residual <= TOLERANCE or step == steps:
            break
        slope = sum((s * F.lit(float(d)) for s, d in zip(share, weigh @ off, strict=True)), F.lit(0.0))
        rated = rated.withColumn("rate", F.greatest(F.lit(0.0), F.col("rate") - slope))
        if step % EVERY == EVERY - 1:
            rated = scratch(rated, "rates")
    return rated.withColumns({"residual": F.lit(residual), "converged": F.lit(residual <= TOLERANCE)})


def targets(domains: list, present: list[float], tokens: float, weights: dict[str, float] | None) -> list[float]:
    """Tokens that each domain should have, of those present: `tokens` in all."""
    listed = {d: max(0.0, float(w)) for d, w in (weights or dict.fromkeys(domains, 1.0)).items() if d in domains}
    others = sum(p for d, p in zip(domains, present, strict=True) if d not in listed)
    asked = sum(listed.values())
    if not asked and not others:  # every domain has the weight zero
        listed, asked = dict.fromkeys(domains, 1.0), float(len(domains))
    rest, grow = (max(0.0, tokens - others), 1.0) if asked else (0.0, tokens / others)
    return [rest * listed[d] / (asked or 1.0) if d in listed else p * grow for d, p in zip(domains, present, strict=True)]


def mixing_rates(docs: DataFrame, weights: dict[str, float] | None = None, label: str = "lang") -> DataFrame:
    """docs(doc_id, text, label) -> doc_id, version, n_tokens, domain, posterior, rate, residual, converged: a row for each document.

    residual and converged are those of the fit, the same in every row.

    weights: what part of all tokens each domain should have, evenly by default.  A domain that weights doesn't list
    keeps the part it has; the listed ones that occur divide the rest by their weights.  Only a weight of zero sets a
    domain to zero.  Labels teach the classifier and aren't looked at otherwise.  Null and empty texts
    have no tokens and the rate their posteriors give.  Where nothing is labelled all rates are 1.  An empty table
    gives none.  Ties between domains go to the first by name.
    """
    spark = docs.sparkSession
    model, domains = learn(docs, label)
    if not domains:
        model, domains = spark.createDataFrame([], "cell int, logp array<double>"), [None]
    members = scratch(posteriors(docs, model, domains), "posteriors")
    sums = members.agg(F.sum("tokens"), *[F.sum(F.col("tokens") * F.get("post", F.lit(k))) for k in range(len(domains))]).first()
    rated = fit_rates(members, targets(domains, [float(x or 0) for x in sums[1:]], float(sums[0] or 0), weights))
    best = F.array_position("post", F.array_max("post")).cast("int")
    names = F.array(*[F.lit(d).cast("string") for d in domains])
    return rated.select("doc_id", "version", F.col("tokens").alias("n_tokens"), F.get(names, best - 1).alias("domain"), F.array_max("post").alias("posterior"), "rate", "residual", "converged")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, label: str = "lang") -> DataFrame:
    """docs in the fitted mixture: each document as often as its rate says.

    A rate of 2.3 is two rows, and a third for the three in ten documents whose hash of doc_id says so; no draw depends
    on where a row is.  A null doc_id is one like any other; null and empty texts come as often as their rate says.
    Columns stay as they are, whatever their names.  An empty table gives none.
    """
    doc, version, rate, own, copy = unused(docs, "__doc", "__version", "__rate", "__own", "__copy")
    rates = mixing_rates(docs, weights, label).select(F.col("doc_id").alias(doc), F.col("version").alias(version), F.col("rate").alias(rate))
    chance = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    here = docs.withColumn(own, F.xxhash64(F.coalesce("text", F.lit(""))))
    met = here.join(rates, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(own) == F.col(version)))
    times = F.floor(F.col(rate) + chance).cast("int")
    return met.where(times > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), times))).select(*named(*docs.columns))
