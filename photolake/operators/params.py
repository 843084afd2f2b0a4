"""Processing parameters, lens preferences and camera rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema

SWITCHES = ("lens_ca", "lens_vign", "lens_dist", "auto_ca")


def effective_params(photos: DataFrame, params: DataFrame, profile: DataFrame, estimates: DataFrame | None = None) -> DataFrame:
    """Stored parameters of each photo, else those of the profile named ``Default``; a repeated one counts once.

    Without such a profile the values of ``schema.PROFILE`` hold. ``estimates`` (photo_id and any parameter columns, such as the rotation from metadata and the estimated
    temperature and tint) goes before the profile where nothing is stored.
    """
    names = [c for c in params.columns if c != "photo_id"]
    defaults = profile.where("profile_id = 'Default'").dropDuplicates(["profile_id"]).select(*[F.col(c).alias(f"_{c}") for c in names if c in profile.columns])
    both = photos.select("photo_id").join(params.withColumn("_stored", F.lit(True)), "photo_id", "left").join(F.broadcast(defaults), how="left")  # one row, or none
    guessed: list[str] = []
    if estimates is not None:
        guessed = [c for c in estimates.columns if c in names]
        both = both.join(estimates.select("photo_id", *[F.col(c).alias(f"e_{c}") for c in guessed]), "photo_id", "left")

    def value(c: str) -> Column:
        fallback = F.coalesce(F.col(f"_{c}"), F.lit(schema.PROFILE.get(c))) if c in profile.columns else F.lit(schema.CROP.get(c))
        if c in guessed:
            fallback = F.coalesce(F.col(f"e_{c}"), fallback)
        return F.when(F.col("_stored"), F.col(c)).otherwise(fallback).alias(c)

    return both.select("photo_id", *map(value, names), F.coalesce("_stored", F.lit(False)).alias("stored"))


def resolve_lens(params: DataFrame, photos: DataFrame, files: DataFrame, prefs: DataFrame) -> DataFrame:
    """``photo_id, lens`` and the four switches: a stored value above -1, else the preference of camera and lens, else off.

    A stored lens ``NoLens`` puts the three lens switches to 0 if any is stored (above -1), and keeps auto-CA.
    """
    f = files.select("file_id", F.col("camera_model").alias("exif_camera"), "exif_lens")
    p = prefs.select("exif_camera", "exif_lens", F.col("lens").alias("_lens"), *[F.col(s).alias(f"_{s}") for s in SWITCHES])
    joined = params.join(photos.select("photo_id", "file_id"), "photo_id").join(f, "file_id", "left").join(p, ["exif_camera", "exif_lens"], "left")
    pick = lambda s: F.when(F.col(s) > -1, F.col(s)).otherwise(F.coalesce(F.col(f"_{s}"), F.lit(0)))
    stored = reduce(lambda a, b: a | b, [F.col(s) > -1 for s in SWITCHES[:3]])
    none = stored & (F.col("lens") == "NoLens")
    lens = F.when(stored, F.col("lens")).otherwise(F.coalesce("_lens", F.lit("NoLens")))
    return joined.select("photo_id", lens.alias("resolved_lens"), *[F.when(none, 0).otherwise(pick(s)).cast("int").alias(s) for s in SWITCHES[:3]], pick("auto_ca").cast("int").alias("auto_ca"))


def upsert_params(params: DataFrame, changes: DataFrame, key: tuple[str, ...] = ("photo_id",)) -> DataFrame:
    """Rows of ``changes`` take the place of those with the same key, all columns."""
    return params.join(changes.select(*key), list(key), "left_anti").unionByName(changes)


def erase(prefs: DataFrame, keys: DataFrame, key: tuple[str, ...] = ("exif_camera", "exif_lens")) -> DataFrame:
    return prefs.join(keys.select(*key), list(key), "left_anti")


def mark_edited(photos: DataFrame, queue: DataFrame, ids: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """Photos of ``ids`` are processed now and their thumbnails stale; in the queue processed and not exported."""
    hit = ids.select("photo_id").distinct().withColumn("_hit", F.lit(True))
    p = photos.join(hit, "photo_id", "left")
    on = F.coalesce("_hit", F.lit(False))
    edited = p.withColumns({"last_processed_time": F.when(on, F.lit(now)).otherwise(F.col("last_processed_time")).cast("long"), **{c: F.when(on, 0).otherwise(F.col(c)) for c in ("thumb_written", "big_thumb_written")}})
    q = queue.join(hit, "photo_id", "left").withColumns({"processed": F.col("processed") | on, "exported": F.col("exported") & ~on})
    return edited.drop("_hit").select(*photos.columns), q.drop("_hit").select(*queue.columns)


def paste_params(params: DataFrame, source_id: str, targets: DataFrame) -> DataFrame:
    """Parameters with one photo's copied onto all targets."""
    source = params.where(F.col("photo_id") == source_id).drop("photo_id")
    pasted = targets.select("photo_id").distinct().join(F.broadcast(source))  # one row
    return upsert_params(params, pasted.select(*params.columns))


def apply_camera_wb(params: DataFrame, photos: DataFrame, files: DataFrame, camera_wb: DataFrame) -> DataFrame:
    """Temperature and tint remembered for the photo's camera, else the stored ones."""
    wb = camera_wb.select("camera_make", "camera_model", F.col("temperature").alias("_t"), F.col("tint").alias("_m"))
    f = files.select("file_id", "camera_make", "camera_model")
    joined = params.join(photos.select("photo_id", "file_id"), "photo_id").join(f, "file_id", "left").join(wb, ["camera_make", "camera_model"], "left")
    return joined.withColumns({"temperature": F.coalesce("_t", "temperature"), "tint": F.coalesce("_m", "tint")}).select(*params.columns)


#: Fixed order of the stages, and the columns whose change makes each the first stale one.
STAGES = ("load", "demosaic", "prefilmulation", "filmulation", "blackwhite", "none")
FIRST_STALE = {
    "load": ["auto_ca", "highlight_recovery", "lens", "lens_ca", "lens_vign", "lens_dist", "rotation_angle"],
    "demosaic": ["exposure_comp", "temperature", "tint"],
    "prefilmulation": [*list(schema.PROFILE)[:17], "toe_boundary"],
    "filmulation": ["blackpoint", "whitepoint", "crop_height", "crop_aspect", "crop_x", "crop_y", "rotation"],
    "blackwhite": ["shadows_x", "shadows_y", "highlights_x", "highlights_y", "vibrance", "saturation", "monochrome", "bw_r", "bw_g", "bw_b"],
}


def stale_stage(old: DataFrame, new: DataFrame) -> DataFrame:
    """``photo_id, stage``: the earliest stage that a change of parameters makes stale, ``none`` without one."""
    before = old.select("photo_id", *[F.col(c).alias(f"_{c}") for c in old.columns if c != "photo_id"])
    first: Column = F.lit(len(STAGES) - 1)
    for k, stage in enumerate(STAGES[:-1]):
        for c in FIRST_STALE[stage]:
            if c in new.columns and c in old.columns:
                first = F.least(first, F.when(F.col(c).eqNullSafe(F.col(f"_{c}")), len(STAGES) - 1).otherwise(k))
    return new.join(before, "photo_id").select("photo_id", F.element_at(F.array(*map(F.lit, STAGES)), first + 1).alias("stage"))


def upgrade(table: DataFrame, name: str, from_version: int) -> DataFrame:
    """Backfills of columns that older catalogs lack. Columns that are there and not null stay."""
    have = set(table.columns)
    fill = lambda c, v: F.coalesce(F.col(c), v) if c in have else v
    if name == "photos":
        new = {"import_start_time": fill("import_start_time", F.col("import_time")), "rating": F.least(F.lit(5), F.greatest(F.lit(0), F.col("rating"))) if from_version < 9 else F.col("rating")}
        new |= {"thumb_written": fill("thumb_written", F.lit(1)), "big_thumb_written": fill("big_thumb_written", F.lit(0))}
    elif name == "queue":
        new = {"sorted_index": fill("sorted_index", F.col("qt_index"))}
    else:
        keep = ("monochrome", "bw_r", "bw_g", "bw_b", "toe_boundary", "lens", "lens_ca", "lens_vign", "lens_dist", "rotation_angle", "rotation_point_x", "rotation_point_y")
        new = {c: fill(c, F.lit(v)) for c, v in (schema.PROFILE | schema.CROP).items() if c in keep or c.startswith("crop")}
    return table.withColumns(new)


def white_level(files: DataFrame, constants: DataFrame) -> DataFrame:
    """``file_id, white``: sensor white level by model and ISO.

    ``constants`` has one row for each (make_model, iso, entry, white); iso null holds for every ISO. ISO matches
    within 3. Of one entry the lowest level, of several the last entry; without a match null.
    """
    model = files.select("file_id", F.concat_ws(" ", "camera_make", "camera_model").alias("make_model"), "sensitivity")
    hit = model.join(constants, "make_model").where(F.col("iso").isNull() | (F.abs(F.col("sensitivity") - F.col("iso")) < 3))
    lowest = hit.groupBy("file_id", "entry").agg(F.min("white").alias("white"))
    last = lowest.groupBy("file_id").agg(F.max_by("white", "entry").alias("white"))
    return files.select("file_id").join(last, "file_id", "left")


def max_value(df: DataFrame) -> DataFrame:
    """``max_value`` after J10, from ``camera_make, path, white, own_max, black``: a DNG file uses its own level; 12-bit
    files of one maker scale a 14-bit constant; the black level is taken off."""
    scaled = F.when((F.col("camera_make") == "Nikon") & (F.col("own_max") < 4096) & (F.col("white") >= 4096), F.col("white") * 4095.0 / 16383.0).otherwise(F.col("white").cast("double"))
    level = F.when(F.lower("path").endswith(".dng") | F.col("white").isNull(), F.col("own_max").cast("double")).otherwise(scaled)
    return df.withColumn("max_value", level - F.col("black"))


def first_above(steps: Column, x: Column, strict: bool) -> Column:
    """The value of the first step whose limit is at or above ``x`` (``strict``: above it), null without one.

    ``steps``: an array of (limit, value) with rising limits, looked up by halving its range inside the row.
    """
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(steps) + 1.0)).cast("int"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        limit = F.get(steps, mid)["limit"]
        below = limit <= x if strict else limit < x
        return F.when(s["lo"] >= s["hi"], s).when(below, F.struct((mid + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi")))

    ends = F.struct(F.lit(0).alias("lo"), F.size(steps).alias("hi"))
    return F.when(x.isNotNull(), F.get(steps, F.aggregate(rounds, ends, halve, lambda s: s["lo"]))["value"])


def step_array(order: Column, limit: Column, value: Column) -> Column:
    """An aggregate: steps in an order as an array of (limit, value). A step that isn't above all before it is never the
    first above anything, so it is left out, and limits rise."""
    sorted_steps = F.array_sort(F.collect_list(F.struct(order.alias("o"), limit.alias("limit"), value.alias("value"))))
    start = F.slice(F.transform(sorted_steps, lambda s: F.struct(s["limit"].alias("limit"), s["value"].alias("value"))), 1, 0)
    keep = lambda a, s: F.when((F.size(a) == 0) | (s["limit"] > F.element_at(F.concat(a, F.array(F.struct(s["limit"].alias("limit"), s["value"].alias("value")))), F.greatest(F.size(a), F.lit(1)))["limit"]), F.array_append(a, F.struct(s["limit"].alias("limit"), s["value"].alias("value")))).otherwise(a)
    return F.aggregate(F.filter(sorted_steps, lambda s: s["limit"].isNotNull()), start, keep)


def aperture_scale(files: DataFrame, scaling: DataFrame) -> DataFrame:
    """``file_id, scale``: the first entry of a step table (``make_model, pos, aperture, scale``) above the f-number.

    Each model's steps become one sorted array, joined by model and looked up inside the row.
    """
    steps = scaling.groupBy("make_model").agg(step_array(F.col("pos"), F.col("aperture"), F.col("scale")).alias("steps"))
    model = files.select("file_id", F.concat_ws(" ", "camera_make", "camera_model").alias("make_model"), F.when(F.col("aperture") > 0.7, F.col("aperture")).alias("_f"))
    return model.join(steps, "make_model", "left").select("file_id", first_above(F.col("steps"), F.col("_f"), True).alias("scale"))


#: Steps of one table at most.
MOST_STEPS = 65536


def decode_lens_code(df: DataFrame, steps: DataFrame, code: str, missing) -> DataFrame:
    """``value``: that of the first threshold at or above the code in a step table (``threshold, value``), else ``missing``.

    The table becomes one row with one sorted array, which every row is given; a table of more than ``MOST_STEPS``
    rows is refused. Of equal thresholds the one with the lowest value holds.
    """
    one = steps.agg(step_array(F.struct("threshold", "value"), F.col("threshold"), F.col("value")).alias("_steps"), F.count("*").alias("_n"))
    one = one.select(F.when(F.col("_n") > MOST_STEPS, F.raise_error(F.lit("too many steps"))).otherwise(F.col("_steps")).alias("_steps"))
    found = df.join(F.broadcast(one), how="left")  # one row
    return found.withColumn("value", F.coalesce(first_above(F.col("_steps"), F.col(code), False), F.lit(missing))).drop("_steps")


def lens_candidates(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` best candidates of each photo by score, ties by lens name.

    Spark limits each photo's rows to ``k`` in every task before the shuffle, so what meets is bounded by ``k`` a task.
    """
    rank = F.row_number().over(Window.partitionBy("photo_id").orderBy(F.desc("score"), "lens"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def best_lens(queries: DataFrame, scored: DataFrame) -> DataFrame:
    """The best lens above a score of 25 on the camera's mount.

    ``queries``: photo_id, mount, query; a query that begins with a backslash takes all mounts and gets the backslash
    back on its result. ``scored``: photo_id, mount, lens, score.
    """
    s = scored.where("score > 25").withColumnRenamed("mount", "_mount")
    hit = queries.join(s, "photo_id").where(F.col("query").startswith("\\") | (F.col("mount") == F.col("_mount")))
    mark = F.when(F.col("query").startswith("\\"), F.lit("\\")).otherwise(F.lit(""))
    best = hit.groupBy("photo_id", mark.alias("_mark")).agg(F.min(F.struct((-F.col("score")).alias("s"), "lens")).alias("b"))
    return best.select("photo_id", F.concat("_mark", "b.lens").alias("lens"), (-F.col("b.s")).alias("score"))


def lens_availability(files: DataFrame, calibrations: DataFrame) -> DataFrame:
    """``file_id, ca, vign, dist``: what the last fitting calibration set allows; chromatic correction needs colour.

    ``files``: file_id, lens, crop, color. ``calibrations``: lens, pos, crop_factor, has_ca, has_vign, has_dist. A set
    fits if the photo's crop is at least 0.96 of its own, or the photo's crop is unknown (below 1e-6).
    """
    hit = files.join(calibrations, "lens").where((F.col("crop") < 1e-6) | (F.col("crop") / F.col("crop_factor") >= 0.96))
    last = hit.groupBy("file_id").agg(F.max_by(F.struct((F.col("has_ca") & F.col("color")).alias("ca"), F.col("has_vign").alias("vign"), F.col("has_dist").alias("dist")), "pos").alias("s"))
    joined = files.select("file_id").join(last, "file_id", "left")
    return joined.select("file_id", *[F.coalesce(F.col(f"s.{c}"), F.lit(False)).alias(c) for c in ("ca", "vign", "dist")])
