"""Mermaid diagrams of searches, as relations: numbered lines of nodes, leaves and arrows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.numbering import numbered
from tessera.functions.text import base_name
from tessera.operators.graph import call_chain, downstream, upstream
from tessera.plans.schema import Index

CALL_LIMIT = 8


def _lines(steps: DataFrame, label: Column, shown: Column, identifier: Column, limit: int | None = None, reverse: bool = False) -> DataFrame:
    """(line_no, line) of a search's steps. label: a node's short name, shown: what its box holds, identifier: its name in the diagram; all of columns node and i, its number.

    Nodes that the search has not emitted are leaves: each is declared before the first arrow that meets it, and numbered after the steps.
    """
    emitted = numbered(steps, ["depth", "rank"], "i").withColumn("i", F.col("i") - 1)
    near = F.col("neighbours") if limit is None else F.slice("neighbours", F.lit(1), F.lit(limit))
    drawn = emitted.select("i", F.col("node").alias("s"), F.posexplode(near).alias("pos", "t"))
    far = drawn.join(emitted.select(F.col("node").alias("t")), "t", "left_anti").groupBy("t").agg(F.min(F.struct("i", "pos")).alias("first"))
    leaves = numbered(far.select(F.col("t").alias("node"), "first.i", "first.pos").withColumnRenamed("i", "at"), ["at", "pos"], "k")
    leaves = leaves.crossJoin(F.broadcast(emitted.agg(F.count(F.lit(1)).alias("n")))).withColumn("i", F.col("n") + F.col("k") - 1)  # one row is broadcast
    nodes = emitted.select("node", "i").union(leaves.select("node", "i")).withColumn("label", label)
    named = nodes.select("node", "i", identifier.alias("name"), shown.alias("shown"))
    box = F.concat(F.lit("    "), "name", F.lit('["'), "shown", F.lit('"]'))
    declared = named.join(leaves.select(F.col("node").alias("leaf"), "at", "pos"), F.col("node") == F.col("leaf"), "left")
    place = [F.when(F.col("at").isNull(), 1).otherwise(2).alias("a"), F.coalesce("at", "i").alias("b"), F.coalesce("pos", F.lit(0)).alias("c"), F.lit(0).alias("d")]
    ends = [named.select(F.col("node").alias(x), F.col("name").alias(f"{x}_name")) for x in "st"]
    arrow = F.concat(F.lit("    "), *(("t_name", F.lit(" --> "), "s_name") if reverse else ("s_name", F.lit(" --> "), "t_name")))
    arrows = drawn.join(ends[0], "s").join(ends[1], "t").select(F.lit(2).alias("a"), F.col("i").alias("b"), F.col("pos").alias("c"), F.lit(1).alias("d"), arrow.alias("line"))
    fixed = steps.sparkSession.createDataFrame([(0, 0, 0, 0, "```mermaid"), (0, 1, 0, 0, "graph TD"), (3, 0, 0, 0, "```")], "a int, b long, c int, d int, line string")
    return numbered(fixed.union(declared.select(*place, box.alias("line"))).union(arrows), ["a", "b", "c", "d"], "line_no").select("line_no", "line")


def _plain(label: Column) -> Column:
    return F.translate(label, ".-", "__")


def dependency_diagram(index: Index, rel_path: str, direction: str = "downstream", max_depth: int = 3) -> DataFrame:
    """Files as nodes named by their base name and number, dependencies as arrows from importer to imported."""
    down = direction == "downstream"
    steps = (downstream if down else upstream)(index, rel_path, max_depth)
    return _lines(steps, base_name(F.col("node")), F.col("label"), F.concat(_plain(F.col("label")), F.lit("_"), F.col("i").cast("string")), reverse=not down)


def call_diagram(index: Index, name: str, max_depth: int = 3) -> DataFrame:
    """Symbols as nodes, calls as arrows, at most CALL_LIMIT from a node."""
    return _lines(call_chain(index, name, max_depth), F.col("node"), F.concat("label", F.lit("()")), _plain(F.col("label")), CALL_LIMIT)


def text(lines: DataFrame) -> str:
    """A diagram as one text; it is fetched part by part."""
    return "\n".join(r.line for r in lines.orderBy("line_no").toLocalIterator())
