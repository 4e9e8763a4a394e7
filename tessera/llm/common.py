"""What the training-data operators share: shipping the package, tables in the shared folder, global order."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from tessera.sources.shared import shared_folder

PACKAGE = Path(__file__).resolve().parent.parent

#: ASCII white space, the only white space that ends a word: [\x20\x09-\x0D].
SPACE = r"[\x20\x09-\x0D]"


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hash of the ordered pair of two 64-bit hashes."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def ship(spark: SparkSession) -> None:
    """Makes this package importable in every Python worker and bounds the rows and bytes of an Arrow batch.

    Executors share no folder with the driver, so the package travels as a zip through Spark's own file server.
    Batches are small because a row may be a very long text.
    """
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", None) is None:
        folder = tempfile.mkdtemp(prefix="tessera-")
        path = os.path.join(folder, "tessera_package.zip")
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(PACKAGE.rglob("*.py")):
                z.write(f, f.relative_to(PACKAGE.parent).as_posix())
        sc.addPyFile(path)
        sc._tessera_shipped = path
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


class Stored:
    """A DataFrame written once as Parquet in the shared folder: it cuts lineage and survives lost executors."""

    def __init__(self, df: DataFrame, name: str, codec: str = "zstd"):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/tessera-{name}-{uuid.uuid4().hex}"
        df.write.option("compression", codec).parquet(self.path)
        self.schema = df.schema
        _tables(self.spark).append(self)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        fs, at = _files(self.spark, self.path)
        fs.delete(at, True)
        _tables(self.spark).remove(self)


def _tables(spark: SparkSession) -> list[Stored]:
    sc = spark.sparkContext
    if getattr(sc, "_tessera_tables", None) is None:
        sc._tessera_tables = []
    return sc._tessera_tables


def drop_stored(spark: SparkSession) -> None:
    """Deletes the tables that operators have stored in this session. Results that aren't written or collected by then are lost."""
    for table in list(_tables(spark)):
        table.drop()


def stored(df: DataFrame, name: str) -> DataFrame:
    return Stored(df, name).read()


def stored_alone(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What make() gives, stored; the tables that it has stored on the way are dropped."""
    before = list(_tables(spark))
    out = Stored(make(), name)
    for table in list(_tables(spark)):
        if table is not out and not any(table is x for x in before):
            table.drop()
    return out.read()


#: Rows of few columns that a shuffle partition is worth.
ROWS_A_PARTITION = 50_000


@contextmanager
def sized(spark: SparkSession, rows: int, most: int | None = None) -> Iterator[None]:
    """What runs inside shuffles into as many partitions as so many rows are worth, and no more than `most` or than are set; the setting comes back after."""
    name = "spark.sql.shuffle.partitions"
    was = spark.conf.get(name)
    spark.conf.set(name, str(max(1, min(most or int(was), -(-rows // ROWS_A_PARTITION)))))
    try:
        yield
    finally:
        spark.conf.set(name, was)


#: Bits of a bitmap's row, and rows of a bitmap (4 KB each) that are broadcast at most.
CHUNK_BITS, MOST_CHUNKS = 1 << 15, 8192


def has_bit(bitmap: Column, bit: Column) -> Column:
    """Whether a bitmap has a bit; no bitmap has none."""
    byte = F.conv(F.hex(F.substr(bitmap, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.call_function("shiftright", byte, F.pmod(bit, F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))


def only(rows: DataFrame, need: DataFrame, column: str, name: str) -> DataFrame:
    """The rows whose `column` (long, not null) is one of need's, which are stored: as a left semi join, but rows stay where they are.

    A bitmap of need is broadcast: of row numbers, which are dense, one bit each. Numbers so far apart or so many that it has more than
    MOST_CHUNKS rows are joined as Spark sees fit.
    """
    chunk, bit = F.shiftright(column, CHUNK_BITS.bit_length() - 1).alias("_chunk"), F.col(column).bitwiseAND(F.lit(CHUNK_BITS - 1))
    if need.select(chunk).distinct().count() > MOST_CHUNKS:
        return rows.join(need, column, "left_semi")
    # dealt by chunk before the bitmaps are made, so that no task sends more than its rows
    maps = need.select(chunk, bit.alias("_bit")).repartition("_chunk").groupBy("_chunk").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    maps = Stored(maps, name).read()
    return rows.withColumn("_chunk", chunk).join(F.broadcast(maps), "_chunk").where(has_bit(F.col("_bits"), bit)).select(*rows.columns)


def bucket_of(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n. A null id counts as an empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def running_order(df: DataFrame, keys: list[str], weight: str | None, partitions: int, name: str) -> tuple[DataFrame, int]:
    """Adds `pos` (long): the sum of weight (or the number) of all rows before a row in the order of keys.

    keys order all rows (make them unique for a stable result). Range partitions keep their rows sorted, each partition sums
    its own rows, and only one total per partition reaches the driver. No window without partition, no single task.
    Returns the table and the grand total.
    """
    columns = list(df.columns)
    out = StructType(list(df.schema.fields)).add("part", IntegerType()).add("local", LongType())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        for b in batches:
            w = np.ones(b.num_rows, np.int64) if weight is None else b.column(columns.index(weight)).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(w) + before
            local = ends - w
            before = int(ends[-1]) if len(ends) else before
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(local)], names=[*columns, "part", "local"])

    ranged = df.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys)
    table = stored(ranged.mapInArrow(number, out), name)
    last = F.max(F.col("local") + (F.lit(1) if weight is None else F.col(weight)))
    totals = {r[0]: r[1] for r in table.groupBy("part").agg(last.alias("n")).collect()}  # one row per range partition
    before, rows = 0, []
    for p in sorted(totals):
        rows.append((p, before))
        before += totals[p]
    if not rows:
        return table.select(*columns, F.lit(0).cast("long").alias("pos")), 0
    offsets = df.sparkSession.createDataFrame(rows, "part int, start long")
    joined = table.join(F.broadcast(offsets), "part")  # as many rows as range partitions
    return joined.select(*columns, (F.col("local") + F.col("start")).alias("pos")), before


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
