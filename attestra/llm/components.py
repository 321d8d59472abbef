"""Consolidating pairwise matches into groups (problem 4): seed-tree pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from attestra.plans.runtime import discard, materialize

#: A vertex with more neighbours than this is joined by broadcast. There are at most 2 * edges / HOT_DEGREE such
#: vertices, and the HOT_MOST of most neighbours are broadcast; any others take the shuffle join, which AQE splits where skewed.
HOT_DEGREE = 100_000
HOT_MOST = 100_000


def _with_minimum(big: DataFrame, minima: DataFrame, key: str) -> DataFrame:
    """big joined with minima (one row per key, column n = its rows in big); hot keys don't go through one task."""
    hot = minima.where(F.col("n") > HOT_DEGREE)
    if hot.isEmpty():
        return big.join(minima, key)
    hot = F.broadcast(hot.orderBy(F.desc("n"), key).limit(HOT_MOST))
    cold = big.join(hot.select(key), key, "left_anti").join(minima.join(hot.select(key), key, "left_anti"), key)
    return cold.unionByName(big.join(hot, key))


def connected_groups(links: DataFrame, left: str, right: str, vertex: str = "vertex", group: str = "group_id") -> DataFrame:
    """One row (vertex, group) per value found in either column; group is the smallest value reachable.

    Each round, every vertex tells its neighbours and itself the least value it sees; the least of what a vertex was
    told becomes the neighbour of all else it was told. A vertex that wasn't told its own value is no minimum of any
    neighbourhood: it leaves the graph and hangs under its least value in a forest. What is left over at the end are
    the seeds, whose values flow down the forest by pointer doubling. Rounds are about log2 of the longest chain.

    Nulls: a row with one null links nothing, but its other end is a vertex; a row with two is ignored. Links to
    oneself, repeated and reversed rows change nothing. An empty input gives no rows. Other columns are ignored.
    """
    pairs = links.select(F.col(left).alias("u"), F.col(right).alias("v"))
    vertices = pairs.select(F.explode(F.array("u", "v")).alias("u")).where("u is not null").distinct()
    proper = pairs.where("u <> v")
    graph = materialize(proper.union(proper.select("v", "u")).distinct())
    forest: DataFrame | None = None
    while not graph.isEmpty():
        minima = materialize(graph.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")))
        told = _with_minimum(graph, minima, "u").select(F.col("v").alias("u"), F.col("m").alias("t"))
        told = materialize(told.union(minima.select("u", F.col("m").alias("t"))).distinct())
        least = materialize(told.groupBy("u").agg(F.min("t").alias("m"), F.count("*").alias("n"), F.max(F.col("t") == F.col("u")).alias("stays")))
        dropped = materialize(least.where("not stays").select(F.col("u").alias("child"), F.col("m").alias("parent")))
        edges = _with_minimum(told, least, "u").where("t <> m").select(F.col("t").alias("u"), F.col("m").alias("v"))
        after = materialize(edges.union(edges.select("v", "u")).distinct())
        for done in (graph, minima, told, least):
            discard(done)
        graph, forest = after, dropped if forest is None else forest.union(dropped)
    if forest is None:
        return vertices.select(F.col("u").alias(vertex), F.col("u").alias(group))
    forest = materialize(forest)
    while True:
        above = forest.groupBy("parent").agg(F.count("*").alias("n")).join(
            forest.select(F.col("child").alias("parent"), F.col("parent").alias("grand")), "parent")
        above = materialize(above)
        if above.isEmpty():
            break
        moved = _with_minimum(forest, above, "parent").select("child", F.col("grand").alias("parent"))
        rest = forest.join(above.select("parent"), "parent", "left_anti").select("child", "parent")
        after = materialize(moved.unionByName(rest))
        discard(forest)
        forest = after
    return (
        vertices.join(forest.select(F.col("child").alias("u"), "parent"), "u", "left")
        .select(F.col("u").alias(vertex), F.coalesce("parent", "u").alias(group))
    )
