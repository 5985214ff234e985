"""Joins by m/z tolerance: all matches in a window, and the nearest.

A tolerance is relative to the query: |ref - query| <= query * ppm / 1e6, both ends included.  Both sides get a
bucket on a logarithmic scale, two tolerances wide, and the query is put into its own bucket and both neighbours;
what is left is an equi-join on the bucket, which Spark may broadcast or shuffle, and a filter.  All matches are as many as
they are; the nearest come without pairs, out of one order of queries and references in pieces of near values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import piece

#: A wider window, in ppm, isn't searched in order: only up to here are differences of m/z exact, so that no two tie by rounding.
EXACT_PPM = 5e5


def bucket(mz: Column, ppm: float) -> Column:
    return F.floor(F.log(mz) / F.lit(math.log1p(2 * ppm * 1e-6)))


def within(query: Column, ref: Column, ppm: float) -> Column:
    width = query * F.lit(ppm) / F.lit(1e6)
    return (ref >= query - width) & (ref <= query + width)


def window_join(queries: DataFrame, refs: DataFrame, ppm: float, query: str = "mz", ref: str = "ref_mz", spread: str = "queries", by: tuple = ()) -> DataFrame:
    """All pairs of a query and a reference in its window, and alike in the columns of by.

    spread names the side that is copied into three buckets: the smaller one.  Column names must differ but for
    those of the join.  Null and non-positive m/z match nothing.
    """
    three = lambda c: F.explode(F.array(*[bucket(F.col(c), ppm) + F.lit(k) for k in (-1, 0, 1)]))
    left = queries.where(F.col(query) > 0).withColumn("__b", three(query) if spread == "queries" else bucket(F.col(query), ppm))
    right = refs.where(F.col(ref) > 0).withColumn("__b", bucket(F.col(ref), ppm) if spread == "queries" else three(ref))
    return left.join(right, ["__b", *by]).where(within(F.col(query), F.col(ref), ppm)).drop("__b")


def met_in_place(queries: DataFrame, refs: DataFrame, ppm: float, query: str = "mz", ref: str = "ref_mz") -> DataFrame:
    """window_join() with the bucket, __b, kept: a query lies in one, and all it meets lies in the task of that bucket.

    References are copied, and both sides are dealt out by bucket, so what goes by __b and more needs no shuffle of the pairs:
    rows that travel are as many as the tables', however many pairs there are.  Buckets are one tolerance wide where that is under
    half of a value.
    """
    part = ppm * 1e-6
    cell = lambda mz: F.floor(F.log(mz) / F.lit(-math.log1p(-part) * (1 + 1e-9))) if 0 < part < 0.5 else bucket(mz, ppm)
    left = dealt(queries.where(F.col(query) > 0).withColumn("__b", cell(F.col(query))), "__b")
    right = dealt(refs.where(F.col(ref) > 0).withColumn("__b", F.explode(F.array(*[cell(F.col(ref)) + F.lit(k) for k in (-1, 0, 1)]))), "__b")
    return left.hint("shuffle_hash").join(right, "__b").where(within(F.col(query), F.col(ref), ppm))


#: Rows of a part that dealt() is told to bound.
PART_ROWS = 1 << 19


def dealt(df: DataFrame, *columns: str, rows: int = 0) -> DataFrame:
    """df in as many partitions as a shuffle has, which aren't merged again: rows that compress well are many to a partition.

    With rows, how many df has, there are more where a partition would have more than PART_ROWS.
    """
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART_ROWS)), *columns)


def beside_in_order(queries: DataFrame, refs: DataFrame, query: str = "mz", ref: str = "ref_mz", by: tuple = ()) -> DataFrame:
    """queries with __below and __above: structs of the reference next at or below, and next above, alike in the columns of by.

    Of references of one m/z the least by its other columns stands for all.  Queries and references are put in order
    together in pieces of near values, and a piece takes the last reference before it and the first behind it from a
    table of a row a piece: as many rows as both tables have, however many lie in a window.  Null, non-finite and
    non-positive m/z are left out.
    """
    real = lambda c: (F.col(c) > 0) & (F.col(c) < float("inf"))
    rest = [c for c in refs.columns if c != ref and c not in by]
    one = refs.where(real(ref)).groupBy(*by, ref).agg(F.min(F.struct(*rest)).alias("__o")) if rest else refs.where(real(ref)).select(*by, ref)
    found = F.struct(F.col(ref), *[F.col(f"__o.`{c}`").alias(c) for c in rest])
    own = queries.where(real(query)).select(*by, F.col(query).cast("double").alias("__at"), F.struct(*[c for c in queries.columns if c not in by]).alias("__q"))
    both = own.unionByName(one.select(*by, F.col(ref).cast("double").alias("__at"), found.alias("__r")), allowMissingColumns=True).withColumn("__piece", piece(F.col("__at")))
    order = lambda how, reach: Window.partitionBy(*(by or [F.lit(0)])).orderBy(how("__piece")).rowsBetween(Window.unboundedPreceding, reach)
    ends = both.groupBy(*by, "__piece").agg(F.min("__r").alias("lo"), F.max("__r").alias("hi"))  # a row a piece
    heads = ends.select(*[F.col(c).alias(f"__of_{c}") for c in [*by, "__piece"]], F.last("hi", True).over(order(F.asc, -1)).alias("__before"), F.last("lo", True).over(order(F.desc, -1)).alias("__behind"))
    inside = lambda how: Window.partitionBy(*by, "__piece").orderBy(how("__at"), how("__kind")).rowsBetween(Window.unboundedPreceding, 0)
    line = dealt(both, *by, "__piece").withColumn("__kind", F.col("__q").isNotNull())  # a reference at a query's own m/z counts as below
    line = line.withColumns({"__below": F.last("__r", True).over(inside(F.asc)), "__above": F.last("__r", True).over(inside(F.desc))}).where("__kind")
    met = line.join(heads, [F.col(c) == F.col(f"__of_{c}") for c in [*by, "__piece"]])
    return met.select(*by, "__q.*", F.coalesce("__below", "__before").alias("__below"), F.coalesce("__above", "__behind").alias("__above"))


def nearest(queries: DataFrame, refs: DataFrame, ppm: float, key: list[str], query: str = "mz", ref: str = "ref_mz", spread: str = "queries", by: tuple = ()) -> DataFrame:
    """Each query with its nearest reference in the window; of two as near, the lower m/z.  No match: nulls.

    key names the columns that tell queries apart, and by those in which a reference must be like its query (without nulls,
    part of key).  A query meets the reference below it and the one above it, not all in its window.
    """
    rest = [c for c in refs.columns if c != ref and c not in by]
    if ppm <= EXACT_PPM:
        def near(side: str) -> Column:
            at = F.col(f"{side}.`{ref}`")
            return F.when(within(F.col(query), at, ppm), F.struct(F.abs(at - F.col(query)).alias("d"), *[F.col(f"{side}.`{c}`").alias(c) for c in [ref, *rest]]))

        met = beside_in_order(queries.select(*dict.fromkeys([*key, query, *by])), refs, query, ref, by).select(*key, F.least(near("__below"), near("__above")).alias("__n"))
    else:
        met = window_join(queries, refs, ppm, query, ref, spread, by).select(*key, F.struct(F.abs(F.col(ref) - F.col(query)).alias("d"), F.col(ref), *rest).alias("__n"))
    best = met.groupBy(*key).agg(F.min("__n").alias("__m"))
    picked = best.select(*key, *[F.col(f"__m.`{c}`").alias(c) for c in [ref, *rest]])
    return queries.join(picked, key, "left")
