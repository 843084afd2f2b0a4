"""Sampling and merging of exposures, lookup tables, and white-balance estimates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pixels import BASE_TEMPERATURE, BASE_TINT, XYZ_TO_SRGB, base_rgb, dot, illuminant_rgb, locus_x, locus_y, multipliers_of
from .grid import extents
from .storage import checkpointed

UNCLIPPED = 60000


def sample_wb(cells: DataFrame, points: DataFrame, cam_mul: Sequence[float] = (1.0, 1.0, 1.0), reach: int = 10) -> DataFrame:
    """Mean channels in a square about each point (photo_id, px, py in 0..1), over the camera's multipliers.

    A point outside gives -1. Points are joined to the cells of their photo and box.
    """
    p = points.join(extents(cells), "photo_id")
    ok = F.col("px").between(0, 1) & F.col("py").between(0, 1)
    boxes = p.where(ok).select("photo_id", "px", "py", F.round(F.col("px") * (F.col("width") - 1)).alias("_x"), F.round(F.col("py") * (F.col("height") - 1)).alias("_y"))
    near = cells.join(boxes, "photo_id").where(f"abs(x - _x) <= {reach} and abs(y - _y) <= {reach}")
    means = near.groupBy("photo_id", "px", "py").agg(*[(F.avg(c) / m).alias(c) for c, m in zip("rgb", cam_mul, strict=True)])
    return points.join(means, ["photo_id", "px", "py"], "left").select("photo_id", "px", "py", *[F.coalesce(c, F.lit(-1.0)).alias(c) for c in "rgb"])


def wb_from_sample(sample: DataFrame) -> DataFrame:
    """Gains that make a sample grey, the smallest of them one."""
    gains = [F.try_divide(F.lit(1.0), F.col(c)) for c in "rgb"]
    return sample.withColumns({f"{c}_gain": g / F.least(*gains) for c, g in zip("rgb", gains, strict=True)})


def exposure_ratio(base: DataFrame, other: DataFrame, base_comp: float = 0.0) -> DataFrame:
    """``photo_id, ratio``: sums of both frames over the cells that are unclipped in both. ``base_comp``: the exposure
    compensation of the base, by which its values were divided out of the sensor's. All cells count, where the original
    rule samples them at random and starts its sum with one factor that all but vanishes in it."""
    o = other.select("photo_id", "y", "x", *[F.col(c).alias(f"o{c}") for c in "rgb"])
    both = base.join(o, ["photo_id", "y", "x"]).where((F.greatest("r", "g", "b") / 2.0**-base_comp < UNCLIPPED) & (F.greatest("or", "og", "ob") < UNCLIPPED))
    return both.groupBy("photo_id").agg((F.sum(F.col("r") + F.col("g") + F.col("b")) / F.sum(F.col("or") + F.col("og") + F.col("ob"))).alias("ratio"))


def brighter(last_ratio: Column) -> Column:
    """Whether a frame is taken: not more than five parts in a hundred darker than the last one."""
    return F.col("ratio").isNotNull() & (F.col("ratio") <= last_ratio * 1.05)


def merge_exposures(base: DataFrame, frame: DataFrame, ratio: DataFrame, last_ratio: Column | float = 1.0, weight: Column | float = 1.0, base_comp: float = 0.0) -> DataFrame:
    """Weighted mean of the base and the scaled frame; a clipped cell of the frame has no weight.
    Cells are clipped by the whole part of their brightest channel.

    A frame that is darker than the last one is rejected: the photo stays as it is, as does a cell or photo that the
    frame doesn't have. ``last_ratio`` and ``weight`` may be columns of ``ratio``.
    """
    last_ratio, weight = (F.lit(v) if isinstance(v, (int, float)) else v for v in (last_ratio, weight))
    f = frame.select("photo_id", "y", "x", *[F.col(c).alias(f"o{c}") for c in "rgb"])
    r = F.col("ratio")
    w = F.when(F.floor(F.greatest("or", "og", "ob")) <= UNCLIPPED, F.try_divide(F.lit(2.0**-base_comp), r)).otherwise(0.0)
    joined = base.join(f, ["photo_id", "y", "x"], "left").join(ratio, "photo_id", "left")
    mixed = lambda c: (F.col(c) * weight + F.col(f"o{c}") * r * w) / (weight + w)
    use = brighter(last_ratio) & F.col("or").isNotNull()
    return joined.select("photo_id", "y", "x", *[F.when(use, mixed(c)).otherwise(F.col(c)).alias(c) for c in "rgb"])


def merge_chain(base: DataFrame, frames: Sequence[tuple[DataFrame, float]], base_comp: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Frames (cells, exposure compensation) merged one after another into the base, and ``photo_id, weight, last``.

    Each frame that is taken adds its weight to the photo's and sets the factor that the next one may not exceed.
    Cells and state are stored after each frame, since the next one depends on them.
    """
    now = base
    state = base.select("photo_id").distinct().select("photo_id", F.lit(1.0).alias("weight"), F.lit(1.0).alias("last"))
    for frame, comp in frames:
        rated = checkpointed(state.join(exposure_ratio(now, frame, base_comp), "photo_id", "left"))
        now = checkpointed(merge_exposures(now, frame, rated, F.col("last"), F.col("weight"), base_comp))
        use = brighter(F.col("last"))
        weight = F.when(use, F.col("weight") + F.try_divide(F.lit(2.0**-base_comp), F.col("ratio"))).otherwise(F.col("weight"))
        state = rated.select("photo_id", weight.alias("weight"), F.when(use, 2.0**-comp).otherwise(F.col("last")).alias("last"))
    return now, state


def lut_from(spark: SparkSession, curve: Callable[[Column], Column]) -> DataFrame:
    """``i, v``: a column function sampled at 0..65535."""
    return spark.range(65536).select(F.col("id").cast("int").alias("i"), curve(F.col("id")).alias("v"))


def apply_lut(cells: DataFrame, lut: DataFrame, columns: Sequence[str] = ("r", "g", "b")) -> DataFrame:
    """Columns of whole values looked up in a table of 65536 rows, which is broadcast."""
    for c in columns:
        one = F.broadcast(lut.select(F.col("i").alias(f"_{c}"), F.col("v").alias(f"_v{c}")))
        cells = cells.join(one, F.col(c).cast("int") == F.col(f"_{c}")).withColumn(c, F.col(f"_v{c}")).drop(f"_{c}", f"_v{c}")
    return cells


def estimate_wb(photos: DataFrame, cam_to_rgb, cam_mul: Sequence[float], pre_mul: Sequence[float]) -> DataFrame:
    """``photo_id, temperature, tint`` whose multipliers are nearest to ones, from two grids: coarse, then about its best.

    Each grid is an array of fixed size inside the row, so photos aren't joined or shuffled.
    """

    def best(temperatures: Column, tints: Column) -> Column:
        def far(light: Column, m: Column) -> Column:
            r, g, b = multipliers_of((light["r"], light["g"], light["b"]), m, cam_to_rgb, cam_mul, pre_mul)
            return F.struct(((r - 1) * (r - 1) + (g - 1) * (g - 1) + (b - 1) * (b - 1)).alias("far"), light["t"].alias("t"), m.alias("m"))

        lights = F.transform(temperatures, lambda t: F.struct(t.alias("t"), *[v.alias(c) for v, c in zip(illuminant_rgb(t), "rgb", strict=True)]))
        return F.array_min(F.flatten(F.transform(lights, lambda light: F.transform(tints, lambda m: far(light, m)))))

    steps = lambda n: F.sequence(F.lit(-n), F.lit(n))
    coarse = best(F.transform(F.sequence(F.lit(0), F.lit(60)), lambda i: F.lit(2000.0) * F.pow(F.lit(10.0), i / 60.0)), F.transform(F.sequence(F.lit(0), F.lit(40)), lambda i: 0.5 + i * 0.03))
    one = photos.select("photo_id", coarse.alias("c"))
    fine = best(F.transform(steps(10), lambda i: F.col("c.t") * F.pow(F.lit(10.0), i / 600.0)), F.transform(steps(10), lambda i: F.col("c.m") + i * 0.003))
    limited = one.select("photo_id", fine.alias("f"))
    return limited.select("photo_id", F.greatest(F.lit(2000.0), F.least(F.lit(20000.0), F.col("f.t"))).alias("temperature"), F.col("f.m").alias("tint"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, inside expressions of array functions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def estimate_wb_by_camera(photos: DataFrame, rounds: int = 80) -> DataFrame:
    """``photo_id, temperature, tint`` whose multipliers are nearest to ones for each photo's own camera.

    ``photos``: photo_id, matrix (array of three arrays: camera to RGB), cam_mul and pre_mul (arrays of three). A simplex
    of three points (logarithms of temperature and tint, so that no tint is zero or below) is reflected, stretched, drawn
    in or shrunk for so many rounds, as a fold inside the row. That takes milliseconds a photo, so photos, which may lie in
    few small files, are dealt evenly over the shuffle partitions first. Temperatures are limited to 2000..20000. A photo
    without usable numbers of its camera (missing, not finite, the least of a set zero) gets 5200 K and tint 1, as where
    the original search finds nothing.
    """
    endless = F.lit(float("inf"))
    least = lambda a: F.array_min(a)
    over_least = lambda c: F.transform(c, lambda x: F.try_divide(x, least(F.col(c))))
    cam, pre = over_least("cam_mul"), over_least("pre_mul")
    unknown = ((F.get(F.get("matrix", 0), 0) == 1) & (F.get(F.get("matrix", 1), 1) == 1) & (F.get(F.get("matrix", 2), 2) == 1)) | F.forall(pre, lambda x: x == 1)
    known = ~F.coalesce(unknown, F.lit(False))
    ratio = F.zip_with(pre, cam, lambda p, c: F.try_divide(p, c))
    offset = F.transform("matrix", lambda row: F.aggregate(F.zip_with(row, F.col("_ratio"), lambda m, x: F.try_divide(m * x, least(F.col("_ratio")))), F.lit(0.0), lambda a, v: a + v))
    ones = F.array(*[F.lit(1.0)] * 3)
    base = lambda t, tint: F.array(*[F.lit(v / d) for v, d in zip(base_rgb(t), (1.0, tint, 1.0), strict=True)])
    tasks = int(photos.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = photos.repartition(tasks, "photo_id").select("photo_id", "matrix", known.alias("_known"), ratio.alias("_ratio"))
    rows = rows.select("photo_id", F.when(F.col("_known"), offset).otherwise(ones).alias("_offset"), F.when(F.col("_known"), base(BASE_TEMPERATURE, BASE_TINT)).otherwise(base(5200.0, 1.0)).alias("_base"))
    part = lambda c, i: F.get(F.col(c), i)

    def point(u: Column, m: Column) -> Column:
        """(distance, u, m); endless where a divisor is zero or a number is missing."""

        def far(x: Column, y: Column) -> Column:
            over = (part("_base", 0), part("_base", 1) * F.exp(m), part("_base", 2))
            found = F.array(*[F.greatest(F.coalesce(F.try_divide(b, v), endless), F.lit(0.0)) * part("_offset", i) for i, (b, v) in enumerate(zip(over, dot(XYZ_TO_SRGB, (x, y, 1 - x - y)), strict=True))])
            off = lambda v, low: F.try_divide(v, low) - 1
            return let(found, lambda f: let(least(f) + 1e-5, lambda low: F.coalesce(F.aggregate(f, F.lit(0.0), lambda a, v: a + off(v, low) * off(v, low)), endless)))

        distance = let(F.when(u > -700, F.exp(u)), lambda t: let(locus_x(t), lambda x: let(locus_y(t, x), lambda y: far(x, y))))
        return F.struct(distance.alias("f"), u.alias("u"), m.alias("m"))

    def step(s: Column, _: Column) -> Column:
        a, b, worst = (F.get(s, i) for i in range(3))
        along = lambda c, by: point(c["u"] + (c["u"] - worst["u"]) * by, c["m"] + (c["m"] - worst["m"]) * by)
        middle = F.struct(((a["u"] + b["u"]) / 2).alias("u"), ((a["m"] + b["m"]) / 2).alias("m"))
        shrunk = F.transform(s, lambda p: point((a["u"] + p["u"]) / 2, (a["m"] + p["m"]) / 2))

        def moved(c: Column, r: Column) -> Column:
            """Stretched if the reflected point ``r`` is the best, kept if it beats the second, else drawn in."""
            by = F.when(r["f"] < a["f"], 2.0).when(r["f"] < worst["f"], 0.5).otherwise(-0.5)
            chosen = lambda k: F.when(r["f"] < a["f"], F.array(a, b, F.when(k["f"] < r["f"], k).otherwise(r))).when(k["f"] < F.least(r["f"], worst["f"]), F.array(a, b, k)).otherwise(shrunk)
            return F.when((r["f"] >= a["f"]) & (r["f"] < b["f"]), F.array(a, b, r)).otherwise(let(let(by, lambda x: along(c, x)), chosen))

        return F.array_sort(let(middle, lambda c: let(along(c, F.lit(1.0)), lambda r: moved(c, r))))

    corners = F.array(*[F.struct(F.log(F.lit(t)).alias("u"), F.log(F.lit(m)).alias("m")) for t, m in ((5200.0, 1.0), (7000.0, 1.0), (5200.0, 1.25))])
    first = F.array_sort(F.transform(corners, lambda c: point(c["u"], c["m"])))
    best = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, step, lambda s: F.get(s, 0))
    found = rows.select("photo_id", best.alias("s"))
    usable = F.col("s.f") < endless
    return found.select("photo_id", F.when(usable, F.greatest(F.lit(2000.0), F.least(F.lit(20000.0), F.exp("s.u")))).otherwise(5200.0).alias("temperature"), F.when(usable, F.exp("s.m")).otherwise(1.0).alias("tint"))
