"""Connected components of a link table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import discard, scratch


def components(links: DataFrame) -> DataFrame:
    """links(u, v) of long ids -> (node, component), component being the smallest id that node reaches.

    Every round each node takes the first of its neighbours and itself as parent, parents are followed twice more,
    and the links are redrawn between parents.  First is by a hash that each round draws anew: half of the nodes that
    still have links go in a round, on average, however long the chains are and whatever ids they bear.  What is
    left when no link remains is one node a component, which then takes the smallest id in it.  All of it is grouping
    with map-side combine and joins of written tables: no component meets in one task.  Nodes without links don't
    appear; loops and repeated links are harmless; an empty table gives an empty table.
    """
    edges = scratch(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct(), "links")
    found, turn = None, 0
    while not edges.isEmpty():
        turn += 1
        place = lambda c, turn=turn: F.xxhash64(F.lit(turn), c)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        best = both.groupBy(F.col("u").alias("node")).agg(F.min_by("v", place("v")).alias("p"), F.min(place("v")).alias("h"))
        up = scratch(best.select("node", F.when(F.col("h") < place("node"), F.col("p")).otherwise(F.col("node")).alias("parent")), "parents")  # nodes of one hash wait
        for _ in range(2):
            above = up.select(F.col("node").alias("parent"), F.col("parent").alias("top"))
            before, up = up, scratch(up.join(above, "parent").select("node", F.col("top").alias("parent")), "parents")
            discard(before)
        before = edges
        edges = scratch(
            edges.join(up.select(F.col("node").alias("u"), F.col("parent").alias("pu")), "u")
            .join(up.select(F.col("node").alias("v"), F.col("parent").alias("pv")), "v")
            .select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).where("u < v").distinct(),
            "links",
        )
        discard(before)
        if found is None:
            found, table = up.select("node", F.col("parent").alias("component")), up
        else:
            moved = up.select(F.col("node").alias("component"), F.col("parent").alias("to"))
            found = scratch(found.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "members")
            discard(table, up)
            table = found
    discard(edges)
    if found is None:
        return links.select(F.col("u").alias("node"), F.col("v").alias("component")).limit(0)
    least = found.groupBy("component").agg(F.min("node").alias("least"))
    return found.join(least, "component").select("node", F.col("least").alias("component"))


def spanning_forest(edges: DataFrame) -> tuple[DataFrame | None, list[DataFrame]]:
    """edges(u, v, w) -> (node, component), and written tables (w, a, b) of the edges that make up the maximum spanning forest.

    w is anything that can be put in order; of equal ones the edge with the larger ends counts as more, so that the forest
    is the only one.  A node with a negative id is a root: trees that have one never grow together, and a
    component with a root bears its id; the others bear that of one of their nodes.  Every round each component without a root
    takes its best edge; what those join becomes one, and of edges between the same two only the best stays.  All of it is
    grouping with map-side combine and joins of written tables.  Nodes without edges don't appear, loops are harmless.
    """
    fresh = edges.where("u <> v").select("u", "v", "w", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
    best = lambda df: df.groupBy(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")).agg(F.max(F.struct("w", "a", "b")).alias("e")).select(F.col("lo").alias("u"), F.col("hi").alias("v"), "e.*")
    left, found, chosen = scratch(best(fresh.where("u >= 0 or v >= 0")), "edges"), None, []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v"), "w", "a", "b"))
        pick = both.where("u >= 0").groupBy("u").agg(F.max(F.struct("w", "a", "b", "v")).alias("e"))
        pick = scratch(pick.select("u", F.col("e.v").alias("p"), "e.w", "e.a", "e.b"), "picks")
        chosen.append(pick.select("w", "a", "b").distinct())
        # two components may pick each other: the lesser stays
        back = pick.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        up = scratch(pick.join(back, "p", "left").select(F.col("u").alias("node"), F.when((F.col("pp") == F.col("u")) & (F.col("u") < F.col("p")), F.col("u")).otherwise(F.col("p")).alias("parent")), "parents")
        while True:
            above = up.select(F.col("node").alias("parent"), F.col("parent").alias("top"))
            further = scratch(up.join(above, "parent", "left").select("node", F.coalesce("top", "parent").alias("parent"), (F.col("top") != F.col("parent")).alias("moved")), "parents")
            discard(up)
            moved, up = not further.where("moved").isEmpty(), further
            if not moved:
                break
        to = up.select("node", "parent")
        at = lambda c, to=to: to.select(F.col("node").alias(c), F.col("parent").alias(f"{c}_to"))
        before = left
        moved = left.join(at("u"), "u", "left").join(at("v"), "v", "left").select(F.coalesce("u_to", "u").alias("u"), F.coalesce("v_to", "v").alias("v"), "w", "a", "b")
        left = scratch(best(moved.where("u <> v and (u >= 0 or v >= 0)")), "edges")
        discard(before)
        if found is None:
            found = scratch(to.select("node", F.col("parent").alias("component")), "members")
        else:
            older = found
            found = scratch(older.join(to.select(F.col("node").alias("component"), "parent"), "component", "left").select("node", F.coalesce("parent", "component").alias("component")), "members")
            discard(older)
        discard(up)
    discard(left)
    return found, chosen


def numbered(table: DataFrame) -> DataFrame:
    """A written table with idx, whole numbers from 0 without gaps: counts of its partitions are added up, no row is moved."""
    own = table.withColumns({"__p": F.spark_partition_id(), "__m": F.monotonically_increasing_id()})
    own = scratch(own, "numbered")
    low = F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.partitionBy(F.lit(0)).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    heads = own.groupBy("__p").agg(F.count("*").alias("n")).select("__p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    return own.join(heads, "__p").withColumn("idx", F.col("__before") + low).drop("__p", "__m", "__before")
