"""Reductions and histograms of cell tables. All aggregate partly before they shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pixels import clamp, pattern_at, trunc

BINS = 128
CHANNELS = ("l", "r", "g", "b")
LUMA = (0.2126, 0.7151, 0.0722)


def luma() -> Column:
    return LUMA[0] * F.col("r") + LUMA[1] * F.col("g") + LUMA[2] * F.col("b")


def cell_stats(cells: DataFrame) -> DataFrame:
    """Sum, least, largest, mean and population variance of each photo and channel."""
    flat = cells.select("photo_id", F.stack(F.lit(3), F.lit("r"), "r", F.lit("g"), "g", F.lit("b"), "b").alias("channel", "v"))
    return flat.groupBy("photo_id", "channel").agg(F.sum("v").alias("total"), F.min("v").alias("low"), F.max("v").alias("high"), F.avg("v").alias("mean"), F.var_pop("v").alias("variance"))


def raw_range(mosaic: DataFrame) -> DataFrame:
    return mosaic.groupBy("photo_id").agg(F.min("v").alias("low"), F.max("v").alias("high"))


def channel_limits(cells: DataFrame, camera: DataFrame) -> DataFrame:
    """Largest value of each channel, and its clip point: 65535 times the camera's multiplier (r_mul, g_mul, b_mul)."""
    top = cells.groupBy("photo_id").agg(*[F.max(c).alias(f"{c}_max") for c in "rgb"])
    return top.join(camera, "photo_id").select("photo_id", *[f"{c}_max" for c in "rgb"], *[(65535.0 * F.col(f"{c}_mul")).alias(f"{c}_clip") for c in "rgb"])


def binned(cells: DataFrame, place) -> DataFrame:
    """``photo_id, channel, bin, n`` with luma ``l``; ``place`` gives the bin of a value."""
    named = [x for c, v in zip(CHANNELS, (luma(), F.col("r"), F.col("g"), F.col("b")), strict=True) for x in (F.lit(c), place(v))]
    return cells.select("photo_id", F.stack(F.lit(4), *named).alias("channel", "bin")).groupBy("photo_id", "channel", "bin").agg(F.count("*").alias("n"))


def hist_final(cells: DataFrame) -> DataFrame:
    """Histogram of whole values 0..65535, 512 to a bin."""
    return binned(cells, lambda v: F.floor(trunc(clamp(v)) / 512).cast("int"))


def hist_float(cells: DataFrame, rects: DataFrame, top: float) -> DataFrame:
    """Histogram of linear values inside each photo's rectangle (x0, y0, x1, y1), whose last row and column are left out."""
    r = rects.select(F.col("photo_id").alias("_p"), "x0", "y0", "x1", "y1")
    inside = cells.join(r, F.col("photo_id") == F.col("_p")).where("x >= x0 and x < x1 and y >= y0 and y < y1")
    return binned(inside, lambda v: F.least(F.lit(BINS - 1), F.greatest(F.lit(0), trunc(clamp((BINS - 1) * v / top, 0.0, 1e9)))))


def turn_back(rects: DataFrame) -> DataFrame:
    """Rectangles ``x0, y0, x1, y1`` (last ones included) of photos that are shown after ``turns`` quarter turns, in
    places before the turn; ``width`` and ``height`` are those of the turned photo."""
    low = lambda v: F.col("height") - 1 - F.col(v)
    right = lambda v: F.col("width") - 1 - F.col(v)
    by_turn = {
        1: (low("y1"), F.col("x0"), low("y0"), F.col("x1")),
        2: (right("x1"), low("y1"), right("x0"), low("y0")),
        3: (F.col("y0"), right("x1"), F.col("y1"), right("x0")),
    }
    turn = F.pmod("turns", F.lit(4))
    pick = lambda i, name: F.coalesce(*[F.when(turn == k, v[i]) for k, v in by_turn.items()], F.col(name)).cast("int").alias(name)
    return rects.select("photo_id", *[pick(i, name) for i, name in enumerate(("x0", "y0", "x1", "y1"))])


def raw_bin(v: Column | str, top: float) -> Column:
    return F.least(F.lit(BINS - 1), trunc(clamp((BINS - 1) * (F.col(v) if isinstance(v, str) else v) / top, 0.0, 1e9)))


def hist_raw(mosaic: DataFrame, cfa: Sequence[Sequence[int]], top: float) -> DataFrame:
    """Histogram of a mosaic by the colour that the pattern has at each cell."""
    channel = F.element_at(F.array(F.lit("r"), F.lit("g"), F.lit("b")), pattern_at(cfa) + 1)
    return mosaic.select("photo_id", channel.alias("channel"), raw_bin("v", top).alias("bin")).groupBy("photo_id", "channel", "bin").agg(F.count("*").alias("n"))


def hist_raw_colour(cells: DataFrame, top: float) -> DataFrame:
    """Histogram of a raw table that has all three colours in each cell."""
    named = [x for c in "rgb" for x in (F.lit(c), raw_bin(c, top))]
    return cells.select("photo_id", F.stack(F.lit(3), *named).alias("channel", "bin")).groupBy("photo_id", "channel", "bin").agg(F.count("*").alias("n"))


def hist_raw_mono(mosaic: DataFrame, top: float) -> DataFrame:
    """Histogram of a raw table without colours: each cell counts on all three channels. Counted before it is tripled."""
    once = mosaic.select("photo_id", raw_bin("v", top).alias("bin")).groupBy("photo_id", "bin").agg(F.count("*").alias("n"))
    return once.select("photo_id", F.explode(F.array(*map(F.lit, "rgb"))).alias("channel"), "bin", "n")


def hist_peaks(hist: DataFrame) -> DataFrame:
    """Highest of the inner bins, at least 1, times 1.1."""
    inner = F.max(F.when(F.col("bin").between(1, BINS - 2), F.col("n")))
    return hist.groupBy("photo_id", "channel").agg((F.greatest(F.coalesce(inner, F.lit(0)), F.lit(1)) * 1.1).alias("peak"))


def hist_heights(hist: DataFrame, log: bool) -> DataFrame:
    """Heights 0..1 of the bins: linear up to the peak, or by logarithm."""
    joined = hist.join(hist_peaks(hist), ["photo_id", "channel"])
    n, peak = F.col("n"), F.col("peak")
    return joined.withColumn("height", F.least(F.lit(1.0), F.ln(n + 1) / F.ln(peak + 1)) if log else F.least(n, peak) / peak)
