"""Connected components of an edge table by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Stored, sized, stored_alone


def connected_components(edges: DataFrame, name: str, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node of its component.

    edges: columns u and v of one orderable type; direction, repeats and self edges don't matter. Nodes of self edges only come
    back with themselves as root; an empty table gives an empty result. Each round replaces edges by edges to a smaller
    neighbour and is written to the shared folder; it ends when a round changes nothing. A hub's edges meet only in
    minimums, which combine before the shuffle, and in inner joins, which Spark can split. Edges and components never leave the executors.
    """
    given = Stored(edges.select("u", "v"), name)
    with sized(edges.sparkSession, 2 * given.read().count()):
        out = stored_alone(edges.sparkSession, name, lambda: _settle(given.read(), name, max_rounds))
    given.drop()
    return out


def _settle(edges: DataFrame, name: str, max_rounds: int) -> DataFrame:
    both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    now = Stored(both.where("u != v"), name)
    mark = _mark(now.read())
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        # large-star: every larger neighbour of a node hangs on the node's smallest neighbour (or itself)
        e = now.read()
        sides = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sides.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = sides.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        after = Stored(large, name)
        # small-star: all smaller neighbours of a node, and itself, hang on the smallest of them
        e = after.read()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        small = e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(low.select("u", F.col("m").alias("v"))).distinct()
        old, now = now, Stored(small, name)
        old.drop()
        after.drop()
        was, mark = mark, _mark(now.read())
        if mark == was:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.read().select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _mark(e: DataFrame) -> tuple:
    """Number of edges and a checksum of them: equal marks mean that a round changed nothing."""
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first())
