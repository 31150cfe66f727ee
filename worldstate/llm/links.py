"""Connected components of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """Each node's neighbours (of a large star: the larger ones; of a small star: the smaller ones and itself) move to its least neighbour."""
    if larger:
        edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        moved = edges.join(least, "a").where("b > a").select("m", "b")
    else:
        least = edges.groupBy("b").agg(F.min("a").alias("m"))
        joined = edges.join(least, "b")
        moved = joined.select("m", F.col("a").alias("b")).where("b > m").unionByName(least.select("m", "b"))
    return moved.select(F.col("m").alias("a"), "b").where("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b): the least node that links reach.

    Large and small stars alternate until nothing changes, which takes rounds in the logarithm of the longest
    chain. Edges never outnumber those given; each round is written to the shared folder. No edges: no rows.
    """
    pairs = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    pairs, seen = common.stored(pairs, "links", clean=True), None
    while True:
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        pairs = common.stored(_stars(_stars(pairs, True), False), "links", clean=True)
    return pairs.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(pairs.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
