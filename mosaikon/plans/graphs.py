"""Queries on graphs of pixels, on forests and on cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cells as ce
from ..operators import forest as fo
from ..operators import multivariate as mv
from ..operators import neighbours as nb
from . import bindings as b
from .registry import query


def _points(spark, sf):
    return b.table(spark, sf, "embeddings").select(F.col("vec_id").alias("pixel_id"), F.col("embedding").alias("x"))


@query("""
WITH d AS (
  SELECT q.vec_id AS pixel_id, p.vec_id AS neighbour,
         list_sum(list_transform(range(1, 65), lambda i: ((q.embedding[i] - p.embedding[i])::DOUBLE) ** 2)) AS d2
  FROM embeddings q JOIN embeddings p ON q.vec_id <> p.vec_id WHERE q.vec_id % 20 = 0)
SELECT pixel_id, neighbour, rank::INT AS rank, round(sqrt(d2), 5) AS distance
FROM (SELECT *, row_number() OVER (PARTITION BY pixel_id ORDER BY d2, neighbour) AS rank FROM d) WHERE rank <= 15""")
def nearest_pixels(spark, sf):
    """The exact neighbours of every twentieth pixel among all."""
    p = _points(spark, sf)
    return b.rounded(nb.exact_neighbours(p, p.where("pixel_id % 20 = 0")), 5)


@query()
def neighbour_graph(spark, sf):
    return b.rounded(nb.knn_graph(_points(spark, sf)), 5)


@query()
def neighbour_embedding(spark, sf):
    return nb.embedding(b.dense(spark, sf))


@query()
def forest_importance(spark, sf):
    return b.rounded(fo.region_importance(mv.rows(b.dense(spark, sf), "label", log=False)))


def _image(spark, sf):
    """The embeddings as an image: a vector is a row of pixels."""
    return b.dense(spark, sf).select(F.col("pixel_id").alias("row"), F.col("feature").cast("long").alias("col"), "v")


@query(f"""
WITH {b.DENSE}, p AS (SELECT pixel_id AS row, feature::BIGINT AS col, v > 0.05 AS inside FROM dense),
around AS (SELECT row, col, unnest(range(-12, 13)) AS i FROM p WHERE inside), square AS (SELECT row, col, i, unnest(range(-12, 13)) AS j FROM around)
SELECT s.row, s.col, min(i * i + j * j)::DOUBLE AS v FROM square s JOIN p ON p.row = s.row + i AND p.col = s.col + j AND NOT p.inside GROUP BY ALL
UNION ALL SELECT row, col, 0 FROM p WHERE NOT inside""")
def distance_map(spark, sf):
    """Squared distances to the pixels under a twentieth, none of which is more than 12 away."""
    return ce.distances(_image(spark, sf).withColumn("v", (F.col("v") > 0.05).cast("double")))


@query()
def segmented_cells(spark, sf):
    return ce.segment(_image(spark, sf), 3.0)


@query()
def cell_areas(spark, sf):
    return b.rounded(ce.cell_table(ce.segment(_image(spark, sf), 3.0)))
