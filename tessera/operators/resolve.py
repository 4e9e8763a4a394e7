"""Import resolution as joins: aliases, candidate paths against a listing, file ids, dependency edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import normal_path

#: What is appended to a path, in this order, after the path itself.
CANDIDATE_ENDINGS = (".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js")


def is_internal(source: Column) -> Column:
    return source.startswith(".") | source.startswith("@") | source.startswith("/")


def join_path(folder: Column, rest: Column) -> Column:
    """rest if it is absolute, else below the folder."""
    return F.when(rest.startswith("/"), rest).when((folder == "") | folder.endswith("/"), F.concat(folder, rest)).otherwise(F.concat(folder, F.lit("/"), rest))


def apply_aliases(source: Column, aliases: list[tuple[str, str]]) -> Column:
    """The first alias, in the list's order, that the source starts with is replaced by its folder; no border is looked for."""
    out = source
    for prefix, target in reversed(aliases):
        rest = F.ltrim(F.substring(source, F.lit(len(prefix) + 1), F.length(source)), F.lit("/"))
        out = F.when(source.startswith(prefix), normal_path(join_path(F.lit(target), rest))).otherwise(out)
    return out


def resolve(imports: DataFrame, listing: DataFrame, root: str, aliases: list[tuple[str, str]]) -> DataFrame:
    """imports with resolved_path and resolved_abs.

    listing: a column path with every file below the root, normalised. External sources have neither; sources that no file answers keep
    their path and have no resolved_abs. resolved_abs is joined as written (it may hold `.` parts), only the look-up is normalised.
    Each distinct source is looked up once, by an equality join of its candidates.
    """
    sources = imports.select("source_path").distinct().where(is_internal(F.col("source_path")))
    sources = sources.withColumn("rel", apply_aliases(F.col("source_path"), aliases))
    endings = F.array(F.lit(""), *[F.lit(x) for x in CANDIDATE_ENDINGS])
    tried = sources.select("source_path", "rel", F.posexplode(endings).alias("pos", "ending"))
    tried = tried.withColumn("candidate", F.concat("rel", "ending")).withColumn("raw", join_path(F.lit(root), F.col("candidate")))
    # a path that ends in a slash names no file, though its normal form may
    looked = tried.withColumn("look", F.when(~F.col("raw").endswith("/"), normal_path(F.col("raw"))))
    found = looked.join(listing.select(F.col("path").alias("look")).distinct(), "look")
    first = found.groupBy("source_path").agg(F.min(F.struct("pos", "candidate", "raw")).alias("hit"))
    answers = sources.join(first, "source_path", "left").select("source_path", F.coalesce("hit.candidate", "rel").alias("resolved_path"), F.col("hit.raw").alias("resolved_abs"))
    return imports.join(answers, "source_path", "left")


def with_file_ids(resolved: DataFrame, files: DataFrame) -> DataFrame:
    """Adds resolved_file_id: the file whose absolute path is resolved_abs, as written."""
    ids = files.select(F.col("path").alias("resolved_abs"), F.col("id").alias("resolved_file_id"))
    return resolved.join(ids, "resolved_abs", "left").drop("resolved_abs")


def edges_of_imports(imports: DataFrame) -> DataFrame:
    """One edge an import row: resolved with a file id, else unresolved for internal sources, else none. Repeats stay."""
    kept = imports.where(F.col("resolved_file_id").isNotNull() | is_internal(F.col("source_path")))
    return kept.select("id", F.col("file_id").alias("source_file_id"), F.col("resolved_file_id").alias("target_file_id"), F.col("resolved_file_id").isNotNull().alias("resolved"))
