"""The driver's tables as the five relations of an index, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.numbering import numbered
from tessera.plans.schema import Index

#: What orders the rows that become edges.
EDGE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _numbered_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that become edges, with ids. They are numbered and stored once a session for each folder of tables."""
    sc = spark.sparkContext
    if getattr(sc, "_tessera_edges", None) is None:
        sc._tessera_edges = {}
    if sf_dir not in sc._tessera_edges:
        kept = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(*EDGE_ORDER, "l_returnflag", "l_discount")
        sc._tessera_edges[sf_dir] = numbered(kept, EDGE_ORDER)
    return sc._tessera_edges[sf_dir]


def bridge(spark: SparkSession, sf_dir: str) -> Index:
    """The five relations. How many files and parts there are comes from aggregates of one row, which are broadcast; nothing is counted while a plan is made."""
    supplier, part, events = (table(spark, sf_dir, n) for n in ("supplier", "part", "events"))
    files_n = F.broadcast(supplier.agg(F.count(F.lit(1)).alias("n_files")))
    parts_n = F.broadcast(part.agg(F.count(F.lit(1)).alias("n_parts")))
    n_files, n_parts = F.col("n_files"), F.col("n_parts")
    path = F.concat(F.lit("src/n"), F.col("s_nationkey").cast("string"), F.lit("/"), F.col("s_name"), F.lit(".ts"))
    language = F.when(F.col("s_nationkey") % 2 == 0, "typescript").otherwise("typescriptreact")
    files = supplier.select((F.col("s_suppkey") + 1).alias("id"), path.alias("path"), path.alias("rel_path"), language.alias("language"))
    symbols = part.crossJoin(files_n).select(
        (F.col("p_partkey") + 1).alias("id"), (F.col("p_partkey") % n_files + 1).alias("file_id"), F.col("p_name").alias("name"), F.lower("p_type").alias("kind"),
        F.col("p_size").alias("line_start"), (F.col("p_retailprice") > 950).alias("is_export"), F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).alias("parent_symbol"),
    )
    source = F.concat(F.lit("@/"), F.col("event_type"), F.lit("/m"), (F.col("event_id") % 7).cast("string"))
    imports = events.crossJoin(files_n).select(
        (F.col("event_id") + 1).alias("id"), (F.col("user_id") % n_files + 1).alias("file_id"), F.col("event_type").alias("symbol_name"), source.alias("source_path"),
        F.when(F.col("event_id") % 5 == 0, "default").otherwise("named").alias("import_type"), (F.col("event_id") % 40).cast("int").alias("line"),
    )
    edges = _numbered_edges(spark, sf_dir)
    known = F.col("l_returnflag") != "N"
    callee = part.select(F.col("p_partkey").alias("_part"), F.col("p_name").alias("callee_name"))
    calls = edges.crossJoin(parts_n).withColumn("_key", F.col("l_orderkey") % n_parts).join(callee, F.col("_key") == F.col("_part"))
    calls = calls.select("id", (F.col("l_suppkey") + 1).alias("caller_file_id"), F.when(known, F.col("l_partkey") + 1).alias("caller_symbol_id"), "callee_name")
    deps = edges.where("l_discount < 0.02").crossJoin(files_n).select("id", (F.col("l_suppkey") + 1).alias("source_file_id"), F.when(known, F.col("l_orderkey") % n_files + 1).alias("target_file_id"), known.alias("resolved"))
    return Index(files, symbols, imports, calls, deps)


#: CTEs that every oracle begins with.
SQL = f"""
WITH RECURSIVE ns AS (SELECT count(*) AS n FROM supplier), np AS (SELECT count(*) AS n FROM part),
files AS (SELECT s_suppkey + 1 AS id, 'src/n' || s_nationkey || '/' || s_name || '.ts' AS rel_path FROM supplier),
symbols AS (SELECT p_partkey + 1 AS id, p_partkey % (SELECT n FROM ns) + 1 AS file_id, p_name AS name, lower(p_type) AS kind, p_size AS line_start,
  p_retailprice > 950 AS is_export, CASE WHEN p_size % 3 = 0 THEN p_brand END AS parent_symbol FROM part),
imports AS (SELECT event_id + 1 AS id, user_id % (SELECT n FROM ns) + 1 AS file_id, event_type AS symbol_name, '@/' || event_type || '/m' || (event_id % 7) AS source_path,
  CASE WHEN event_id % 5 = 0 THEN 'default' ELSE 'named' END AS import_type, CAST(event_id % 40 AS INTEGER) AS line FROM events),
edge_rows AS (SELECT *, row_number() OVER (ORDER BY {", ".join(EDGE_ORDER)}) AS id FROM lineitem WHERE l_quantity >= 49),
call_edges AS (SELECT e.id, l_suppkey + 1 AS caller_file_id, CASE WHEN l_returnflag <> 'N' THEN l_partkey + 1 END AS caller_symbol_id, p_name AS callee_name
  FROM edge_rows e JOIN part ON p_partkey = l_orderkey % (SELECT n FROM np)),
dependency_edges AS (SELECT id, l_suppkey + 1 AS source_file_id, CASE WHEN l_returnflag <> 'N' THEN l_orderkey % (SELECT n FROM ns) + 1 END AS target_file_id,
  l_returnflag <> 'N' AS resolved FROM edge_rows WHERE l_discount < 0.02),
dep_paths AS (SELECT d.id, s.rel_path AS source_rel, t.rel_path AS target_rel FROM dependency_edges d JOIN files s ON s.id = d.source_file_id
  LEFT JOIN files t ON t.id = d.target_file_id WHERE d.resolved),
call_pairs AS (SELECT s.name AS caller, ce.callee_name AS callee, min(ce.id) AS ord FROM call_edges ce JOIN symbols s ON s.id = ce.caller_symbol_id GROUP BY ALL)
"""
