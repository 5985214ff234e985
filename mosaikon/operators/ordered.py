"""Running totals in the order of a number, over a whole table or by key, without one task that sorts it all."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import scratch

#: Pieces to each doubling of a value.
FINE = 1024


def piece(x: Column) -> Column:
    """A whole number that never falls as x rises: values of one piece lie within a thousandth of each other.

    It depends on the value only, so that every task cuts alike; there are some 2 million pieces at each sign, however many
    rows.  Infinities lie outside of all others and NaN above them, as in Spark's own order; null gives null.
    """
    x = x.cast("double")
    size = F.abs(x)
    e = F.floor(F.log2(size))
    # where log2 rounds up to the next power the second term falls short by as much as the first is too large
    key = (e + 1100) * FINE + F.floor(size / F.pow(F.lit(2.0), e.cast("double")) * FINE)
    sign = F.when(x < 0, -1).otherwise(1)
    return F.when(F.isnan(x), F.lit(1 << 40)).when(size == float("inf"), sign * F.lit(1 << 39)).when(size == 0, F.lit(0)).when(x.isNotNull(), sign * key).cast("long")


def cumulate(blocks: DataFrame, by: str, columns: list[str], descending: bool = False, how: Callable = F.sum) -> DataFrame:
    """blocks, one row for each value of by, with each column's sum (or F.min) over all rows up to its own.

    Each piece is put in order by itself, and what the pieces before it come to is joined on.
    """
    order = F.desc if descending else F.asc
    own = blocks.withColumn("__piece", piece(F.col(by)))
    before = Window.partitionBy(F.lit(0)).orderBy(order("__piece")).rowsBetween(Window.unboundedPreceding, -1)  # a row a piece
    whole = own.groupBy("__piece").agg(*[how(c).alias(c) for c in columns])
    heads = whole.select("__piece", *[how(c).over(before).alias(f"__before_{c}") for c in columns])
    inside = Window.partitionBy("__piece").orderBy(order(by)).rowsBetween(Window.unboundedPreceding, 0)
    each = own.withColumns({c: how(c).over(inside) for c in columns}).join(heads, "__piece")
    both = (lambda c: F.coalesce(F.col(f"__before_{c}"), F.lit(0)) + F.col(c)) if how is F.sum else (lambda c: F.least(f"__before_{c}", c))
    return each.select(*[both(c).alias(c) if c in columns else F.col(c) for c in blocks.columns])


#: Rows of one key that one task puts in order.
PIECE_ROWS = 1 << 20
#: Parts that the rows of one key are cut into at most.
PARTS = 1024


def beside(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """left joined to right on keys, where null equals null."""
    named = right.withColumnsRenamed({k: f"__of_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys])
    return left.join(named, same, how).drop(*[f"__of_{k}" for k in keys])


def cuts(blocks: DataFrame, keys: list[str], by: str) -> DataFrame | None:
    """keys, __cuts of the keys with more than PIECE_ROWS rows: rising values that part a key's rows about evenly.

    None where no key has that many.  The quantiles are a sketch that combines before the shuffle; they are written down,
    as a second reading might give others.
    """
    sizes = blocks.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > PIECE_ROWS)
    most = sizes.agg(F.max("__n").alias("n")).first()["n"]
    if most is None:
        return None
    k = min(PARTS, -(-most // PIECE_ROWS))
    own = beside(blocks.select(*keys, by), sizes.select(*keys), keys, "left_semi")
    at = F.percentile_approx(F.col(by).cast("double"), [i / k for i in range(1, k)], 16 * k)
    return scratch(own.groupBy(*keys).agg(at.alias("__cuts")), "cuts")


def cumulate_by(blocks: DataFrame, keys: list[str], by: str, columns: list[str], descending: bool = False) -> DataFrame:
    """blocks, one row for each key and value of by, with each column's sum over the rows of its key up to its own.

    A key with many rows is cut at quantiles of its own values, so that near values part too; each part is put in order by
    itself and what the parts before it come to is joined on.  blocks is read several times: give a written table.
    Null is below and NaN above all other values, as in Spark's own order; a null key is a key.
    """
    order = F.desc if descending else F.asc
    cut = cuts(blocks, keys, by)
    if cut is None:
        upto = Window.partitionBy(*keys).orderBy(order(by)).rowsBetween(Window.unboundedPreceding, 0)
        return blocks.withColumns({c: F.sum(c).over(upto) for c in columns})
    below = F.size(F.filter("__cuts", lambda c: c < F.col(by)))
    own = beside(blocks, cut, keys).withColumn("__part", F.when(F.col("__cuts").isNotNull(), below).otherwise(0)).drop("__cuts")
    before = Window.partitionBy(*keys).orderBy(order("__part")).rowsBetween(Window.unboundedPreceding, -1)  # PARTS rows a key at most
    whole = own.groupBy(*keys, "__part").agg(*[F.sum(c).alias(c) for c in columns])
    heads = whole.select(*keys, "__part", *[F.sum(c).over(before).alias(f"__before_{c}") for c in columns])
    inside = Window.partitionBy(*keys, "__part").orderBy(order(by)).rowsBetween(Window.unboundedPreceding, 0)
    each = beside(own.withColumns({c: F.sum(c).over(inside) for c in columns}), heads, [*keys, "__part"])
    return each.select(*[(F.coalesce(F.col(f"__before_{c}"), F.lit(0)) + F.col(c)).alias(c) if c in columns else F.col(c) for c in blocks.columns])


def quantiles(values: DataFrame, keys: list[str], by: str, shares: dict[str, float]) -> DataFrame:
    """keys, then a column for each name of shares: exact quantiles of by as doubles, on a straight line between two values.

    Counts by piece, which combine before the shuffle, say in which pieces the two ranks of a quantile lie; only the values
    of those are put in order, in parts where they are many.  No buffer holds the values of a key.  values is read twice.  Nulls don't
    count; a key without other values has nulls, and so has the one row of a table without rows and keys.
    """
    on = keys or ["__all"]
    own = values.select(*keys, *([] if keys else [F.lit(0).alias("__all")]), F.col(by).cast("double").alias("__v")).withColumn("__piece", piece(F.col("__v")))
    found = scratch(own.groupBy(*on, "__piece").agg(F.count("*").alias("__t")), "pieces")
    real = found.where("__piece is not null")
    upto = F.sum("__t").over(Window.partitionBy(*on).orderBy("__piece").rowsBetween(Window.unboundedPreceding, 0))  # counts of pieces, not values
    each = beside(real.withColumn("__u", upto), real.groupBy(*on).agg(F.sum("__t").alias("__n")), on, "inner")
    at = lambda p: (F.col("__n") - 1) * F.lit(float(p))
    ranks = [F.struct(F.lit(name).alias("name"), F.lit(k).alias("side"), whole(at(p)).alias("rank")) for name, p in shares.items() for k, whole in enumerate((F.floor, F.ceil))]
    asked = each.select(*on, "__piece", "__n", "__t", (F.col("__u") - F.col("__t")).alias("__before"), F.explode(F.array(*ranks)).alias("q"))
    wanted = asked.where((F.col("q.rank") >= F.col("__before")) & (F.col("q.rank") < F.col("__before") + F.col("__t"))).select(*on, "__piece", "__n", "__t", "__before", "q.*")
    near = [*on, "__piece"]
    side = lambda name, k: F.max(F.when((F.col("name") == name) & (F.col("side") == k), F.col("v")))

    def value(name: str, p: float) -> Column:
        low, high, x = F.col(f"__{name}_0"), F.col(f"__{name}_1"), at(p)
        return F.when(F.floor(x) == F.ceil(x), low).otherwise((F.ceil(x) - x) * low + (x - F.floor(x)) * high).alias(name)

    if not keys:
        few = wanted.collect()  # two rows a share
        run = _in_order(own.where(F.col("__piece").isin(sorted({r["__piece"] for r in few}))), near, max((r["__t"] for r in few), default=0))
        least = [F.min(F.when((F.col("__piece") == r["__piece"]) & (F.col("__t") + r["__before"] > r["rank"]), F.col("__v"))).alias(f"__{r['name']}_{r['side']}") for r in few]
        if not few:
            return run.agg(*[F.max("__v").alias(name) for name in shares])
        return run.agg(*least).withColumn("__n", F.lit(few[0]["__n"])).select(*[value(name, p) for name, p in shares.items()])
    wanted = scratch(wanted, "wanted")
    run = _in_order(beside(own, wanted.select(*near).distinct(), near, "left_semi"), near, wanted.agg(F.max("__t")).first()[0] or 0)
    hit = beside(wanted.drop("__t"), run, near).where(F.col("__before") + F.col("__t") > F.col("rank")).groupBy(*on, "__n", "name", "side").agg(F.min("__v").alias("v"))
    both = hit.groupBy(*on).agg(F.max("__n").alias("__n"), *[side(name, k).alias(f"__{name}_{k}") for name in shares for k in (0, 1)])
    return beside(found.select(*on).distinct(), both.select(*on, *[value(name, p) for name, p in shares.items()]), on)


def _in_order(own: DataFrame, near: list[str], most: int) -> DataFrame:
    """near, __v, __t: running counts of the values of each piece, of which the largest has `most` rows."""
    blocks = own.groupBy(*near, "__v").agg(F.count("*").alias("__t"))
    if most > PIECE_ROWS:
        return cumulate_by(scratch(blocks, "blocks"), near, "__v", ["__t"])
    return blocks.withColumn("__t", F.sum("__t").over(Window.partitionBy(*near).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)))
