"""Tables in the folder that driver and executors share: they cut lineage and outlive executors."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


class NoSharedFolder(Exception):
    """A cluster needs spark.checkpoint.dir: its machines share no other folder."""


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder of its own for each local session, and an error on a cluster."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise NoSharedFolder("set spark.checkpoint.dir to a folder that driver and executors share")
        if getattr(sc, "_tessera_folder", None) is None:
            sc._tessera_folder = Path(tempfile.mkdtemp(prefix="tessera-shared-")).as_uri()
        folder = sc._tessera_folder
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written in the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
