"""Source trees as a Python data source: files to index with their content, or a listing of all files.

Not the built-in binary reader: that one leaves out names that begin with a dot or an underscore.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: What is indexed, and which folders are not entered (nor is any that begins with a dot).
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx")
EXCLUDED = frozenset("node_modules .next .git dist build .turbo coverage __pycache__ .venv venv".split())
CHUNK = 64


def source_files(root: str) -> Iterator[str]:
    """Absolute paths of the files to index, in sorted order; linked folders are not followed."""
    for folder, folders, names in os.walk(root):
        folders[:] = sorted(f for f in folders if f not in EXCLUDED and not f.startswith("."))
        for name in sorted(names):
            if name.endswith(EXTENSIONS):
                yield os.path.join(folder, name)


def all_files(root: str) -> Iterator[str]:
    for folder, folders, names in os.walk(root):
        folders.sort()
        for name in sorted(names):
            yield os.path.join(folder, name)


@dataclass
class Chunk(InputPartition):
    paths: list[str]


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.listing = os.path.abspath(options["path"]), options.get("listing", "false") == "true"

    def partitions(self) -> list[Chunk]:
        size = CHUNK * 64 if self.listing else CHUNK
        paths = list(all_files(self.root) if self.listing else source_files(self.root))
        return [Chunk(paths[i : i + size]) for i in range(0, len(paths), size)] or [Chunk([])]

    def read(self, partition: Chunk) -> Iterator[tuple]:
        for path in partition.paths:
            content = None
            if not self.listing:
                try:
                    with open(path, "rb") as f:
                        content = f.read()
                except OSError:
                    pass  # no content: counted as an error by the index
            yield (path, os.path.relpath(path, self.root), content)


class TreeSource(DataSource):
    """format("source_tree"): path, rel_path, content (null if a file can't be read). Option listing: all files, without content.

    The root must be readable by the driver and by all executors under the same path.
    """

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, rel_path string, content binary"

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    spark.dataSource.register(TreeSource)
    return spark.read.format("source_tree").load(root)


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """A column path: every file below root, in no folder left out."""
    spark.dataSource.register(TreeSource)
    return spark.read.format("source_tree").option("listing", "true").load(root).select(F.col("path"))
