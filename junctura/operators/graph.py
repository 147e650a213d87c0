"""Graphs: components, closures, clusters by distance.

Connected components of an edge table: large-star and small-star steps, until nothing changes.

Each step joins the edges with a minimum per node, so a node with very many edges is no group in one task. Each round is
written to the shared folder, which cuts the lineage; the round before is removed then. Joins are by sorted parts that can
spill: Spark guesses a table's size by its files, and numbers in Parquet are many times smaller than a table to broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .. import storage

#: Edges of a task's part; tables of more edges are dealt over more parts, so a task's memory does not grow with them.
PART_ROWS = 200_000


def _least(edges: DataFrame, a: str, b: str) -> DataFrame:
    return edges.groupBy(a).agg(F.min(b).alias("least"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges: a, b (long). Returns node, component (the smallest node it is linked with, itself included).

    Edges from a node to itself, doubled and null edges change nothing; an empty table gives an empty one.
    """
    rounds = storage.Tables(edges.sparkSession)
    e = rounds.stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b"), "edges")
    with storage.parts(edges.sparkSession, e.count() // PART_ROWS):
        return _settled(e, rounds, most_rounds)


def _settled(e: DataFrame, rounds: storage.Tables, most_rounds: int) -> DataFrame:
    e = rounds.stored(e.distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        # large star: each node's larger neighbours go to its least neighbour (or itself)
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _least(both, "a", "b").select("a", F.least("a", "least").alias("least"))
        large = both.filter("b > a").hint("merge").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        # small star: a node and its smaller neighbours go to the least of them
        least = _least(large, "a", "b")
        small = large.hint("merge").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b").unionByName(least.select("a", F.col("least").alias("b")))
        e = rounds.stored(small.distinct(), "edges")
        rounds.drop(all_but=1)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    found = e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    found = rounds.stored(found, "components")
    rounds.drop(all_but=1)
    return found


def closure(start: DataFrame, parents: DataFrame, most_rounds: int = 60) -> DataFrame:
    """start: id. parents: child, parent. All ids that the start reaches up or down the tree (GRF02)."""
    rounds = storage.Tables(start.sparkSession)
    found = rounds.stored(start.select("id").distinct(), "closure")
    n = found.count()
    for _ in range(most_rounds):
        up = parents.join(found, parents["child"] == found["id"]).select(F.col("parent").alias("id")).filter("id is not null")
        down = parents.join(found, parents["parent"] == found["id"]).select(F.col("child").alias("id"))
        found = rounds.stored(found.unionByName(up).unionByName(down).distinct(), "closure")
        rounds.drop(all_but=1)
        now = found.count()
        if now == n:
            return found
        n = now
    raise RuntimeError(f"the closure did not settle in {most_rounds} rounds")


def eps_clusters(points: DataFrame, eps: float = 500.0) -> DataFrame:
    """points: id (long), name, x, y. id, cluster: the smallest id of the points of one name that steps of at most eps reach (WIN06, GRF03).

    Points of one place and name are one spot. Spots of a cell with sides of eps / 2 ** 0.5 are all near one another, so a cell is one node, named by its smallest id; spots
    meet those of 12 of the 24 cells around, and which cells have near ones is all that is kept of it. So a frequent name is not one group, and edges grow with cells and not with pairs.
    """
    side = eps * 0.7071  # a little less, so that rounding does no harm
    cell = lambda c: F.floor(F.col(c) / side).cast("long")
    spots = points.filter("id is not null and name is not null and x is not null and y is not null").groupBy("name", "x", "y").agg(F.min("id").alias("id")).withColumns({"cx": cell("x"), "cy": cell("y")})
    here = storage.stored(spots.withColumn("cell", F.min("id").over(Window.partitionBy("name", "cx", "cy"))).drop("id"), "spots")
    ahead = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(3) for j in range(-2, 3) if (i, j) > (0, 0)))
    around = here.select("name", F.col("x").alias("bx"), F.col("y").alias("by"), "cx", "cy", F.col("cell").alias("other"), F.inline(ahead)).withColumns({"cx": F.col("cx") + F.col("i"), "cy": F.col("cy") + F.col("j")})
    near = F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by")) <= eps
    edges = around.hint("merge").join(here, ["name", "cx", "cy"]).filter(near).select(F.col("cell").alias("a"), F.col("other").alias("b")).distinct()
    of = here.hint("merge").join(components(edges), F.col("cell") == F.col("node"), "left").select("name", "x", "y", F.coalesce("component", "cell").alias("component"))
    return points.hint("merge").join(of, ["name", "x", "y"], "left").select("id", F.coalesce("component", "id").alias("cluster"))
