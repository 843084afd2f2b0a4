"""Steps of film development, quarter turns and crops on cell tables, cell by cell; ``tiles`` has what needs neighbours."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASSES = 7


def box_radius(sigma_const: float, pixels_per_mm: float, dt: float) -> int:
    """Radius of one of seven box passes; the divisor 12/7 is whole, that is 1, and the width is made odd."""
    sigma2 = dt * (sigma_const * pixels_per_mm) ** 2
    width = math.floor(math.sqrt(sigma2 * (12 // PASSES) + 1))
    return (width - 1 if width % 2 else width) // 2


def extents(cells: DataFrame) -> DataFrame:
    """``photo_id, width, height``: one row a photo."""
    return cells.groupBy("photo_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def develop_step(cells: DataFrame, growth: float, consumption: float, salt_consumption: float, thickness: float, dt: float) -> DataFrame:
    """One step of the reaction, cell by cell, on radius ``c_rad``, crystals ``c_cry`` and salt ``c_salt`` of each
    channel c and the shared developer ``dev``. Volumes are taken with the radius before it grows."""
    grown = {c: F.col("dev") * F.col(f"{c}_salt") * (growth * dt) for c in "rgb"}
    volume = {c: grown[c] * F.col(f"{c}_rad") * F.col(f"{c}_rad") * F.col(f"{c}_cry") for c in "rgb"}
    used = (volume["r"] + volume["g"] + volume["b"]) * (2.0 * consumption / (thickness * 3.0))
    new = {f"{c}_rad": F.col(f"{c}_rad") + grown[c] for c in "rgb"} | {f"{c}_salt": F.col(f"{c}_salt") - 2.0 * salt_consumption * volume[c] for c in "rgb"}
    return cells.withColumns(new | {"dev": F.greatest(F.col("dev") - used, F.lit(0.0))})


def pool_exchange(cells: DataFrame, pools: DataFrame, mix: float, dt: float, divisor: float, thickness: float) -> tuple[DataFrame, DataFrame]:
    """Developer moves between the layer and each photo's pool (photo_id, pool, volume, ppm); what the layer gains the pool loses."""
    m = mix ** (dt / divisor)
    held = cells.join(pools.select("photo_id", "pool"), "photo_id")
    after = F.col("dev") * m + (1 - m) * F.col("pool")
    gained = held.groupBy("photo_id").agg(F.sum(after - F.col("dev")).alias("_gained"))
    left = F.col("pool") - F.col("_gained") * thickness / (F.col("ppm") * F.col("ppm") * F.col("volume"))
    return held.withColumn("dev", after).drop("pool"), pools.join(gained, "photo_id").withColumn("pool", left).drop("_gained")


def pool_equalise(cells: DataFrame, pools: DataFrame, thickness: float) -> tuple[DataFrame, DataFrame]:
    """Agitation: all developer of a photo spreads evenly over its pool and its layer."""
    sums = cells.groupBy("photo_id").agg(F.sum("dev").alias("_dev"), F.count("*").alias("_n"))
    area = thickness / (F.col("ppm") * F.col("ppm"))
    even = (F.col("_dev") * area + F.col("pool") * F.col("volume")) / (F.col("volume") + F.col("_n") * area)
    new = pools.join(sums, "photo_id").withColumn("pool", even).drop("_dev", "_n")
    return cells.drop("dev").join(new.select("photo_id", F.col("pool").alias("dev")), "photo_id"), new


def rotate(cells: DataFrame, turns: int) -> DataFrame:
    """Quarter turns counter-clockwise as a change of coordinates."""
    turns %= 4
    if not turns:
        return cells
    both = cells.join(extents(cells), "photo_id")
    right, low = F.col("width") - 1 - F.col("x"), F.col("height") - 1 - F.col("y")
    y, x = {1: (right, F.col("y")), 2: (low, right), 3: (F.col("x"), low)}[turns]
    return both.withColumn("_y", y.cast("int")).withColumn("x", x.cast("int")).withColumn("y", F.col("_y")).drop("_y", "width", "height")


def crop_rect(sizes: DataFrame) -> DataFrame:
    """``photo_id, x0, y0, x1, y1`` (last ones included) from width, height, crop_height, crop_aspect, crop_x, crop_y.

    Height is a part of the photo's, kept in 0..1, the aspect in 1e-4..1e4. Offsets are limited so that the rectangle
    stays inside; where photo and rectangle differ by an odd number, it moves by half a cell. Height 0 or less: all.
    """
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    tall = h * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("crop_height")))
    aspect = F.greatest(F.lit(1e-4), F.least(F.lit(1e4), F.col("crop_aspect")))
    made = sizes.withColumns({"_w": F.round(F.least(tall * aspect, w)), "_h": F.round(F.least(tall, w / aspect))})

    def start(full: Column, part: Column, offset: Column) -> Column:
        most = (1 - part / full) / 2
        odd = F.when(F.round((full - part) / 2) * 2 == full - part, 0.0).otherwise(0.5)
        moved = F.round(F.greatest(-most, F.least(most, offset)) * full + odd) - odd
        return F.round(0.5 * (full - part) + moved).cast("int")

    x0, y0 = start(w, F.col("_w"), F.col("crop_x")), start(h, F.col("_h"), F.col("crop_y"))
    off = F.col("crop_height") <= 0
    at = made.withColumns({"x0": F.when(off, 0).otherwise(x0), "y0": F.when(off, 0).otherwise(y0)})
    x1 = F.when(off, F.col("width") - 1).otherwise(F.col("x0") + F.col("_w") - 1).cast("int")
    y1 = F.when(off, F.col("height") - 1).otherwise(F.col("y0") + F.col("_h") - 1).cast("int")
    return at.select("photo_id", "x0", "y0", x1.alias("x1"), y1.alias("y1"))


def crop(cells: DataFrame, rects: DataFrame) -> DataFrame:
    """The cells inside each photo's rectangle, counted from its corner."""
    inside = cells.join(rects, "photo_id").where("x between x0 and x1 and y between y0 and y1")
    return inside.withColumns({"x": F.col("x") - F.col("x0"), "y": F.col("y") - F.col("y0")}).drop("x0", "y0", "x1", "y1")
