"""Call and dependency graphs, and breadth-first search over them as frontier joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numbering import numbered_within
from tessera.operators.queries import all_dependencies
from tessera.plans.schema import Index
from tessera.sources.shared import stored

CALL_FAN_OUT = 10
#: Levels that one plan holds; deeper searches cut their lineage.
UNROLLED = 4


def call_graph(index: Index) -> DataFrame:
    """(caller, callee, ord): distinct pairs of names, merged over files; ord is the first edge's id. Calls without a known caller don't count."""
    names = index.symbols.select(F.col("id").alias("_symbol"), F.col("name").alias("caller"))
    edges = index.call_edges.join(names, index.call_edges["caller_symbol_id"] == names["_symbol"])
    return edges.groupBy("caller", F.col("callee_name").alias("callee")).agg(F.min("id").alias("ord"))


def call_edges(index: Index) -> DataFrame:
    """The call graph as edges (s, t, ord)."""
    return call_graph(index).select(F.col("caller").alias("s"), F.col("callee").alias("t"), "ord")


def dependency_edges(index: Index, reverse: bool = False) -> DataFrame:
    """Resolved file dependencies as edges (s, t, ord), one an import; reverse: from the imported to the importing file."""
    both = all_dependencies(index).where("source_rel != '' and target_rel is not null and target_rel != ''")
    s, t = ("target_rel", "source_rel") if reverse else ("source_rel", "target_rel")
    return both.select(F.col(s).alias("s"), F.col(t).alias("t"), F.col("id").alias("ord"))


def neighbour_rows(edges: DataFrame) -> DataFrame:
    """(node, pos, neighbour): each node's neighbours in order, from 1."""
    return numbered_within(edges, "s", ["ord"], "pos").select(F.col("s").alias("node"), "pos", F.col("t").alias("neighbour"))


def levels(edges: DataFrame, start: str, max_depth: int, fan_out: int | None = None) -> DataFrame:
    """(node, depth, place) of every node that a search from start emits: depth below max_depth, each node once.

    place orders the nodes of a level as a queue would: by the parent's place, then the edge's. The start is emitted even if it has no edges.
    fan_out: only so many first edges of a node are followed.
    """
    spark = edges.sparkSession
    empty = spark.createDataFrame([], "node string, depth int, place array<long>")
    if max_depth <= 0:
        return empty
    follow = edges
    if fan_out is not None:
        rank = F.row_number().over(Window.partitionBy("s").orderBy("ord"))  # with the limit, Spark keeps only the first rows of a key before it shuffles
        follow = edges.withColumn("_rank", rank).where(F.col("_rank") <= fan_out).drop("_rank")
    frontier = spark.createDataFrame([(start, 0, [])], "node string, depth int, place array<long>")
    seen = frontier
    for depth in range(1, max_depth):
        reached = frontier.join(follow, frontier["node"] == follow["s"]).select(F.col("t").alias("node"), F.concat("place", F.array(F.col("ord").cast("long"))).alias("place"))
        first = reached.groupBy("node").agg(F.min("place").alias("place"))
        frontier = first.join(seen.select("node"), "node", "left_anti").select("node", F.lit(depth).alias("depth"), "place")
        if depth % UNROLLED == 0:
            frontier = stored(frontier, "graph")
            if frontier.isEmpty():
                break
        seen = seen.unionByName(frontier)
        if depth % UNROLLED == 0:
            seen = stored(seen, "graph")
    return seen


def search(edges: DataFrame, start: str, max_depth: int, fan_out: int | None = None) -> DataFrame:
    """(depth, rank, node, neighbours): the nodes of levels() in the order they are met; rank from 1 in each level. neighbours: all of them, in order."""
    found = levels(edges, start, max_depth, fan_out)
    near = edges.join(found.select(F.col("node").alias("s")), "s", "left_semi")
    near = near.groupBy("s").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "t"))), lambda x: x["t"]).alias("neighbours"))
    ranked = numbered_within(found, "depth", ["place"], "rank")
    out = ranked.join(near, ranked["node"] == near["s"], "left")
    return out.select("depth", "rank", "node", F.coalesce("neighbours", F.array().cast("array<string>")).alias("neighbours")).orderBy("depth", "rank")


def call_chain(index: Index, start: str, max_depth: int = 5) -> DataFrame:
    return search(call_edges(index), start, max_depth, CALL_FAN_OUT)


def upstream(index: Index, rel_path: str, max_depth: int = 3) -> DataFrame:
    return search(dependency_edges(index, reverse=True), rel_path, max_depth)


def downstream(index: Index, rel_path: str, max_depth: int = 3) -> DataFrame:
    return search(dependency_edges(index), rel_path, max_depth)
