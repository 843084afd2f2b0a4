"""Tone and colour steps that need more than one projection, so that shared values are computed once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pixels import clamp, film_curve, from_hsv, to_hsv, trunc


def _rgb() -> tuple:
    return F.col("r"), F.col("g"), F.col("b")


def vibrance_saturation(cells: DataFrame, vibrance: float, saturation: float) -> DataFrame:
    """``s' = clamp(2^saturation * s^(2^-vibrance))`` of whole values; two values near zero change nothing."""
    if abs(vibrance) < 1e-5 and abs(saturation) < 1e-5:
        return cells
    h, s, v = to_hsv(_rgb())
    hsv = cells.withColumns({"_h": F.greatest(h, F.lit(0.0)), "_s": s, "_v": v})
    hsv = hsv.withColumn("_s", clamp(F.lit(2.0**saturation) * F.pow("_s", F.lit(2.0**-vibrance)), 0.0, 1.0))
    new = from_hsv((F.col("_h"), F.col("_s"), F.col("_v")))
    return hsv.withColumns({c: trunc(clamp(x)) for c, x in zip("rgb", new, strict=True)}).drop("_h", "_s", "_v")


def curve_cells(cells: DataFrame, curve) -> DataFrame:
    """A hue-preserving curve on all cells."""
    return cells.withColumns({c: x for c, x in zip("rgb", film_curve(_rgb(), curve), strict=True)})
