"""Gapless numbers in a given order without sorting all rows, or all rows of a key, in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.shared import stored

#: monotonically_increasing_id() holds the partition above so many bits, and the row's place in it below.
_PLACE_BITS = 33


def in_order(df: DataFrame, name: str = "id", totals: dict[str, str] | None = None) -> DataFrame:
    """Adds each row's number, from 1, in the order that df has; totals: further columns, each with the sum of a count over all rows before.

    The rows are stored with their partition and place once; the driver sees one row a partition. Totals are summed within each partition.
    """
    totals = totals or {}
    table = stored(df.withColumn("_at", F.monotonically_increasing_id()), "in-order").withColumn("_part", F.shiftright("_at", _PLACE_BITS))
    sizes = table.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(t) for t, c in totals.items()]).collect()  # one row a partition
    before, rows = [0] * (1 + len(totals)), []
    for r in sorted(sizes, key=lambda r: r["_part"]):
        rows.append((r["_part"], before[0] - (r["_part"] << _PLACE_BITS) + 1, *before[1:]))
        before = [x + y for x, y in zip(before, r[1:], strict=True)]
    starts = df.sparkSession.createDataFrame(rows, ", ".join(["_part long", "_start long", *[f"_start_{t} long" for t in totals]]))
    earlier = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    sums = {t: F.coalesce(F.sum(c).over(earlier), F.lit(0)) for t, c in totals.items()}
    placed = (table.withColumns(sums) if sums else table).join(F.broadcast(starts), "_part")  # as many rows as partitions
    placed = placed.withColumns({name: F.col("_at") + F.col("_start")} | {t: F.col(t) + F.col(f"_start_{t}") for t in totals})
    return placed.drop("_at", "_part", "_start", *[f"_start_{t}" for t in totals])


def numbered(df: DataFrame, order: list[str], name: str = "id", totals: dict[str, str] | None = None) -> DataFrame:
    """Adds numbers from 1 in the order of the columns, which tell all rows apart, and totals. Ranges of rows are sorted, however many share their first columns."""
    return in_order(df.repartitionByRange(*order).sortWithinPartitions(*order), name, totals)


def numbered_within(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """Adds numbers from 1 for each key, in the order of the columns; a key's rows may lie in many ranges."""
    rows = numbered(df, [key, *order], "_n")
    first = rows.groupBy(F.col(key).alias("_key")).agg(F.min("_n").alias("_first"))
    return rows.join(first, rows[key].eqNullSafe(first["_key"])).withColumn(name, F.col("_n") - F.col("_first") + 1).drop("_n", "_key", "_first")
