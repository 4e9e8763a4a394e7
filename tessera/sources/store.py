"""Stored indexes: a folder of five Parquet tables for each project, on any file system that Spark reaches."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.schema import TABLES, Index


class NoIndex(Exception):
    """There is no index of that name."""


def project_name(path: str) -> str:
    return os.path.basename(os.path.abspath(path))


class Store:
    def __init__(self, spark: SparkSession, home: str | None = None):
        self.spark = spark
        self.home = (home or os.path.join(os.path.expanduser("~"), ".tessera")).rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.home}/projects/{name}"

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def exists(self, name: str) -> bool:
        fs, at = self._fs(f"{self.path(name)}/files")
        return fs.exists(at)

    def projects(self) -> list[str]:
        """Names of all stored projects, sorted."""
        fs, at = self._fs(f"{self.home}/projects")
        if not fs.exists(at):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory())
        return sorted(n for n in names if not n.startswith("."))

    def read(self, name: str) -> Index:
        """The tables of a project; nothing is made by reading."""
        if not self.exists(name) and not self._restore(name):
            raise NoIndex(name)
        return Index(*(self.spark.read.schema(schema).parquet(f"{self.path(name)}/{table}") for table, schema in TABLES.items()))

    def _restore(self, name: str) -> bool:
        """Gives an index its name back that a run set aside before it died."""
        fs, folder = self._fs(f"{self.home}/projects")
        aside = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith(f".{name}-") and s.getPath().getName().endswith("-old")] if fs.exists(folder) else []
        return bool(aside) and fs.rename(aside[0], self._fs(self.path(name))[1])

    def write(self, name: str, tables: dict[str, DataFrame]) -> None:
        """Replaces a project: all tables are written beside it, the old folder is set aside, and deleted when the new one has its name. read() finds a set-aside index."""
        staging = f"{self.home}/projects/.{name}-{uuid.uuid4().hex}"
        for table, schema in TABLES.items():
            tables[table].select(*[tables[table][f.name].cast(f.dataType).alias(f.name) for f in schema]).write.parquet(f"{staging}/{table}")
        fs, at = self._fs(self.path(name))
        _, new = self._fs(staging)
        _, old = self._fs(f"{staging}-old")
        had = fs.exists(at)
        if had and not fs.rename(at, old):
            raise OSError(f"{self.path(name)} can't be renamed")
        if not fs.rename(new, at):
            if had:
                fs.rename(old, at)
            raise OSError(f"{staging} can't be renamed")
        if had:
            fs.delete(old, True)
