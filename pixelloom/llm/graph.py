"""Connected components of a graph of links: one contraction, then alternating large and small stars over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stage, unstage

#: Up to so many rows (16 bytes each) a list of nodes is broadcast; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 250_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """A hint for a list of a counted size; beyond the bound Spark joins it by a shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _round(e: DataFrame) -> DataFrame:
    """One large star and one small star over edges (a, b), a < b, each once; moved tells edges that changed.

    Large: a node's larger neighbours go to the least of it and its neighbours. Small: a node's smaller neighbours go to the least of them. Neither makes
    more edges than there were. The least neighbour is an aggregate that tasks combine before they exchange, and edges meet it by a join, so that the centre of a
    large star is no task's alone: Spark splits such a join, or broadcasts the nodes where they are few."""
    both = e.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(e.select(F.col("b").alias("x"), F.col("a").alias("y")))
    least = both.groupBy("x").agg(F.min("y").alias("m"))
    large = both.filter("y > x").join(least, "x").select(F.least("x", "m").alias("a"), F.col("y").alias("b"), (F.col("m") < F.col("x")).alias("moved"))
    large = large.groupBy("a", "b").agg(F.max("moved").alias("moved"))  # many nodes may send a node to the same least one
    least = large.groupBy("b").agg(F.min("a").alias("m"), F.max("moved").alias("any"))
    others = large.select("a", "b").join(least.select("b", "m"), "b").filter("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"), F.lit(True).alias("moved"))
    return least.select(F.col("m").alias("a"), "b", F.col("any").alias("moved")).unionByName(others).groupBy("a", "b").agg(F.max("moved").alias("moved"))


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """edges (u, v): node, component (the least node reachable), for all nodes with a link to another node.

    First every node is put under its least smaller neighbour, and only nodes that have larger neighbours of their own stay in the graph, linked
    with what their members saw. Stars about least nodes, which is what links mostly are, end there; the leaves of a large star are never exchanged by its
    centre. What is left is settled by rounds of stars, and members take the component of their least neighbour. Every round is written to the shared folder."""
    e = edges.filter("u <> v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    e = stage(e, "edges")
    at_b = W.partitionBy("b").orderBy("a")
    x = e.withColumns({"m": F.first("a").over(at_b), "k": F.row_number().over(at_b)})
    centres = e.select(F.col("a").alias("b"), F.lit(True).alias("centre")).distinct()
    x = x.join(centres, "b", "full")  # a node without smaller neighbours comes from the right alone: its k is null
    seen = Observation()
    x = x.select("a", "b", F.coalesce("m", "b").alias("m"), "k", F.col("centre").isNotNull().alias("centre"))
    x = stage(x.observe(seen, F.count_if((F.col("k") > 1) | (F.col("centre") & F.col("k").isNotNull())).alias("rest"), F.count("*").alias("n")), "stars")
    own = x.filter("k = 1 or k is null").select(F.col("b").alias("node"), "m")
    if not seen.get["rest"]:
        return own.withColumnRenamed("m", "component")
    now = x.filter("k > 1").select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(x.filter("k = 1 and centre").select(F.col("m").alias("a"), "b"))
    now = now.distinct()  # thousands of nodes may have seen the same two
    for _ in range(most):
        moves = Observation()
        new = stage(_round(now).observe(moves, F.count("*").alias("n"), F.coalesce(F.sum(F.col("moved").cast("int")), F.lit(0)).alias("moved")), "round")
        if "moved" in now.columns:
            unstage(now)
        now = new
        if not moves.get["moved"]:
            break
    else:
        raise RuntimeError("components did not settle")
    top = now.select(F.col("b").alias("m"), F.col("a").alias("top"))
    return own.join(small(top, moves.get["n"]), "m", "left").select("node", F.coalesce("top", "m").alias("component"))
