"""The relational queries over an index. All return lazy DataFrames; ties are ordered by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import ascii_like
from tessera.plans.schema import Index

SYMBOL_LIMIT, IMPORT_LIMIT = 20, 10


def _with_path(table: DataFrame, key: str, files: DataFrame, name: str = "rel_path") -> DataFrame:
    paths = files.select(F.col("id").alias("_file"), F.col("rel_path").alias(name))
    return table.join(paths, table[key] == paths["_file"]).drop("_file")


def stats(index: Index) -> DataFrame:
    """One row: numbers of files, symbols, imports, calls and dependency edges (unresolved ones too)."""
    out = None
    for name, table in (("files", index.files), ("symbols", index.symbols), ("imports", index.imports), ("calls", index.call_edges), ("deps", index.dependency_edges)):
        one = table.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.union(one)
    return out.groupBy().pivot("name", ["files", "symbols", "imports", "calls", "deps"]).agg(F.first("n"))


def kind_counts(index: Index) -> DataFrame:
    return index.symbols.groupBy("kind").agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"), "kind")


def top_imports(index: Index, limit: int = IMPORT_LIMIT) -> DataFrame:
    """The most frequent import sources; the empty source doesn't count."""
    counts = index.imports.where("source_path != ''").groupBy("source_path").agg(F.count(F.lit(1)).alias("cnt"))
    return counts.orderBy(F.desc("cnt"), "source_path").limit(limit)


def find_symbols(index: Index, name: str) -> DataFrame:
    """Symbols whose name matches the pattern, by file and line."""
    return _with_path(index.symbols.where(ascii_like(F.col("name"), name)), "file_id", index.files).orderBy("rel_path", "line_start", "id")


def symbols_in_file(index: Index, part: str) -> DataFrame:
    """Symbols of all files whose path holds the part, by line."""
    return _with_path(index.symbols, "file_id", index.files.where(ascii_like(F.col("rel_path"), f"%{part}%"))).orderBy("line_start", "id")


def list_symbols(index: Index, kind: str | None = None, exported_only: bool = False) -> DataFrame:
    keep = F.lit(True)
    if kind:
        keep = keep & (F.col("kind") == kind)
    if exported_only:
        keep = keep & F.col("is_export")
    return _with_path(index.symbols.where(keep), "file_id", index.files).orderBy("kind", "name", "id")


def children_of(index: Index, parent: str) -> DataFrame:
    """Symbols of any file whose parent has that name."""
    return _with_path(index.symbols.where(F.col("parent_symbol") == parent), "file_id", index.files).orderBy("line_start", "id")


def imports_of_symbol(index: Index, name: str) -> DataFrame:
    return _with_path(index.imports.where(ascii_like(F.col("symbol_name"), name)), "file_id", index.files, "importer").orderBy("importer", "id")


def imports_from_module(index: Index, module: str) -> DataFrame:
    """Imports of the module or below it; only if there are none, of every source that holds the text. One plan, no action."""
    source: Column = F.col("source_path")
    exact = _with_path(index.imports.where((source == module) | ascii_like(source, f"{module}/%")), "file_id", index.files, "importer")
    loose = _with_path(index.imports.where(ascii_like(source, f"%{module}%")), "file_id", index.files, "importer")
    any_exact = exact.limit(1).select(F.lit(1).alias("_one"))
    fallback = loose.withColumn("_key", F.lit(1)).join(F.broadcast(any_exact), F.col("_key") == F.col("_one"), "left_anti").drop("_key")  # at most one row
    return exact.unionByName(fallback).orderBy("importer", "id")


def used_by(index: Index, module: str) -> DataFrame:
    """For each importer of a module, the names it imports, in order, without empty ones."""
    rows = imports_from_module(index, module)
    names = F.transform(F.array_sort(F.collect_list(F.struct("id", "symbol_name"))), lambda x: x["symbol_name"])
    return rows.groupBy("importer").agg(F.array_join(F.filter(names, lambda x: x != ""), ", ").alias("symbols")).orderBy("importer")


def callers(index: Index, name: str) -> DataFrame:
    """Call sites of a name (its case counts); calls outside a known symbol have no caller."""
    edges = _with_path(index.call_edges.where(F.col("callee_name") == name), "caller_file_id", index.files)
    who = index.symbols.select(F.col("id").alias("_symbol"), F.col("name").alias("caller_name"), F.col("kind").alias("caller_kind"))
    return edges.join(who, edges["caller_symbol_id"] == who["_symbol"], "left").drop("_symbol").orderBy("id")


def callees(index: Index, symbol_id: int) -> DataFrame:
    return index.call_edges.where(F.col("caller_symbol_id") == symbol_id).select("callee_name").distinct().orderBy("callee_name")


def symbol_by_name(index: Index, name: str, limit: int = SYMBOL_LIMIT) -> DataFrame:
    return _with_path(index.symbols.where(ascii_like(F.col("name"), name)), "file_id", index.files).orderBy("id").limit(limit)


def dependencies(index: Index, file_id: int) -> DataFrame:
    """Resolved files that a file imports, one row an import."""
    edges = index.dependency_edges.where(F.col("source_file_id") == file_id)
    return _with_path(edges, "target_file_id", index.files).orderBy("id")


def dependents(index: Index, file_id: int) -> DataFrame:
    edges = index.dependency_edges.where(F.col("target_file_id") == file_id)
    return _with_path(edges, "source_file_id", index.files).orderBy("id")


def all_dependencies(index: Index) -> DataFrame:
    """All resolved dependency edges with both paths."""
    edges = _with_path(index.dependency_edges.where("resolved"), "source_file_id", index.files, "source_rel")
    targets = index.files.select(F.col("id").alias("_file"), F.col("rel_path").alias("target_rel"))
    return edges.join(targets, edges["target_file_id"] == targets["_file"], "left").drop("_file").orderBy("id")
