"""Steps of demosaicking on a mosaic table. Lines are the units of the windows; borders are mirrored."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BAYER = ((1, 0), (2, 1))


def mosaic(cells: DataFrame) -> DataFrame:
    """One value a cell, by parity: green red over blue green."""
    even_y, even_x = F.col("y") % 2 == 0, F.col("x") % 2 == 0
    v = F.when(even_y, F.when(even_x, F.col("g")).otherwise(F.col("r"))).otherwise(F.when(even_x, F.col("b")).otherwise(F.col("g")))
    return cells.select("photo_id", "y", "x", v.alias("v"))


def _line(axis: str) -> Window:
    return Window.partitionBy("photo_id", "y" if axis == "x" else "x").orderBy(axis)


def neighbour(value: Column | str, step: int, axis: str) -> Column:
    """The value so many cells before or after; beyond an end the mirrored one."""
    w = _line(axis)
    return F.coalesce(F.lag(value, step).over(w), F.lead(value, step).over(w)) if step > 0 else F.coalesce(F.lead(value, -step).over(w), F.lag(value, -step).over(w))


def interp_missing(mosaic: DataFrame) -> DataFrame:
    """``h, v_``: the channel that a cell lacks, as the mean of the two next cells along a row and along a column."""
    means = {name: (neighbour("v", 1, axis) + neighbour("v", -1, axis)) / 2 for name, axis in (("across", "x"), ("down", "y"))}
    return mosaic.withColumns(means)


def lowpass9(table: DataFrame, value: str, weights: Sequence[float], axis: str) -> DataFrame:
    """Nine taps, the same either way: ``weights`` from the middle outwards, five of them."""
    total = F.col(value) * weights[0]
    for k in range(1, 5):
        total = total + (neighbour(value, k, axis) + neighbour(value, -k, axis)) * weights[k]
    return table.withColumn(value, total)


def local_stats9(table: DataFrame, value: str, other: str, axis: str) -> DataFrame:
    """Mean and sample variance of nine cells along an axis, and the mean square of what differs from another column."""
    w = _line(axis).rowsBetween(-4, 4)
    rest = (F.col(value) - F.col(other)) * (F.col(value) - F.col(other))
    return table.withColumns({"mean9": F.avg(value).over(w), "var9": F.var_samp(value).over(w), "rest9": F.avg(rest).over(w)})
