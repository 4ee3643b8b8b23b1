"""Connected components of an edge table, by alternating large-star and small-star steps.

A large star hangs every larger neighbour of a node on the node's smallest neighbour; a small star
does the same with the smaller ones.  The edges end as stars around each component's smallest node,
after a number of rounds that grows with the logarithm of the longest chain.  Each round is two
aggregations and two joins that can be split, ending in a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, skew_join


def _star(edges: DataFrame, few=lambda df: df) -> DataFrame:
    """Edges (u, v): every v with the least of u's neighbourhood."""
    least = few(edges.groupBy("u").agg(F.min("v").alias("m"))).select("u", F.least("u", "m").alias("m"))
    return few(skew_join(edges, least, ["u"]))


def components(edges: DataFrame, task_edges: int | None = None) -> DataFrame:
    """(node, label) for every node of the edges (a, b); the label is the component's least node.

    ``task_edges`` edges or more go to a task of a round, so that rounds over few edges don't run as many tasks
    as the session has shuffle partitions; none leaves it to the session.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = cut_lineage(e)
    seen = None
    while True:
        state = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
        tasks = task_edges and -(-state["n"] // task_edges)
        few = lambda df, tasks=tasks: df.coalesce(max(6, tasks)) if tasks else df
        e = few(e)
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = few(_star(both, few).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        s = _star(large, few)
        small = s.select(F.col("v").alias("a"), F.col("m").alias("b")).union(s.select(F.col("u").alias("a"), F.col("m").alias("b")))
        e = cut_lineage(few(small.where("a <> b").distinct()))
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
