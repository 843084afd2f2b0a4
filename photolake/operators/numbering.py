"""Gapless numbering of a large table without one window over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

#: Rows of a range, about; each range is numbered apart, and then placed after the ranges before it.
RANGE_ROWS = 1_000_000


def dense_index(df: DataFrame, key: str, name: str, *ties: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with ``name``: 0..n-1 by ``key`` (nulls first), then by ``ties``.

    The rows are written once and dealt into as many ranges of (key, ties) as their number asks for, so a key that
    many rows share is split by its ties. Only the ranges' sizes are gathered. An empty table stays empty.
    """
    rows = written(df, "rows-to-number")
    ranges = max(1, -(-rows.count() // range_rows))
    by = [F.col(c).asc_nulls_first() for c in (key, *ties)]
    if ranges == 1:
        return rows.withColumn(name, F.row_number().over(Window.orderBy(*by)).cast("long") - 1)
    placed = written(rows.repartitionByRange(ranges, *by).withColumn("_part", F.spark_partition_id()), "numbered-ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))  # one row a range
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*by))
    return placed.join(F.broadcast(starts), "_part").withColumn(name, (F.col("_start") + inside - 1).cast("long")).drop("_part", "_start")
