"""Connected components by repeated contraction to the neighbour of least random rank."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.scratch import Scratch


def _ranked(node: str, salt: int) -> Column:
    """A node with a rank before it that changes from round to round, so that no order of the ids makes long chains."""
    return F.struct(F.xxhash64(F.col(node), F.lit(salt)).alias("rank"), F.col(node).alias("node"))


def connected_components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) of every node that has an edge; comp is the smallest node of its component.

    Each round ranks the nodes anew at random, points every node at the one of
    least rank among itself and its neighbours (a min aggregate, so a hub is
    combined before the shuffle), jumps pointers twice, and keeps only edges
    between different targets. A node with a neighbour stays with a chance of at
    most a half, so the nodes left halve at least, on average, whatever their ids:
    rounds grow with the logarithm of the largest component. No neighbour list is
    ever collected. Nulls and loops are dropped; no edges give no rows.
    """
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b").distinct()
    edges = scratch.table(edges, "edges")
    labels: DataFrame | None = None
    for turn in count():
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(_ranked("b", turn)).alias("m"))
        step = least.select(F.col("a").alias("node"), F.least(_ranked("a", turn), "m")["node"].alias("to"))
        step = scratch.table(step, "pointers")
        for _ in range(2):
            jump = step.select(F.col("node").alias("to"), F.col("to").alias("far"))
            step = step.join(jump, "to", "left").select("node", F.coalesce("far", "to").alias("to"))
        step = scratch.table(step, "jumped")
        ends = step.select(F.col("node").alias("a"), F.col("to").alias("x"))
        other = step.select(F.col("node").alias("b"), F.col("to").alias("y"))
        fewer = edges.join(ends, "a").join(other, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        fewer = scratch.table(fewer, "edges")
        if labels is None:
            labels = step.select("node", F.col("to").alias("comp"))
        else:
            moved = step.select(F.col("node").alias("comp"), F.col("to").alias("far"))
            labels = scratch.table(labels.join(moved, "comp", "left").select("node", F.coalesce("far", "comp").alias("comp")), "labels")
        scratch.drop(edges)
        edges = fewer
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    named = labels.groupBy("comp").agg(F.min("node").alias("least"))
    return scratch.table(labels.join(named, "comp").select("node", F.col("least").alias("comp")), "components")
