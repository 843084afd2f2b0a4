"""Photos stored by capture day, each day sorted by capture time, and a list of the days that are live.

A write puts the days it touches into a folder of its own version, then writes the list: for each day the version
that holds it and its number of photos. Other days keep their files. A reader opens only the days that it asks for;
what a cut-off write leaves behind is in no list.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from .days import date_histogram
from .organize import organize
from .storage import numbers_in, written

DAYS = "capture_day long, version long, n long"
SECONDS = 86400


def capture_day(at: str = "capture_time") -> Column:
    """Days since 1970 in UTC; photos without a time have day null."""
    return F.floor((F.col(at) - F.pmod(F.col(at), F.lit(SECONDS))) / SECONDS)


def live_days(spark: SparkSession, path: str) -> DataFrame:
    """The last list of days; only its own file is opened."""
    known = numbers_in(spark, f"{path}/lists", "list")
    return spark.read.schema(DAYS).parquet(f"{path}/lists/list={known[-1]}") if known else spark.createDataFrame([], DAYS)


def write_days(photos: DataFrame, path: str, days: DataFrame | None) -> None:
    """Writes ``photos`` as all photos of the days that they have, beside the live days (``capture_day, version, n``) to keep."""
    spark = photos.sparkSession
    known = numbers_in(spark, f"{path}/lists", "list")
    version = known[-1] + 1 if known else 0
    at, order = f"{path}/days/version={version}", ["capture_day", "capture_time", "photo_id"]
    # ranges, not hashes: a day with very many photos is dealt into several files
    rows = photos.withColumn("capture_day", capture_day()).repartitionByRange(*order).sortWithinPartitions(*order)
    rows.write.mode("overwrite").partitionBy("capture_day").parquet(at)
    stored = spark.read.schema(schema.PHOTOS + ", capture_day long").parquet(at)
    made = stored.groupBy("capture_day").agg(F.count("*").alias("n")).select("capture_day", F.lit(version).cast("long").alias("version"), "n")
    listed = made if days is None else days.unionByName(made)
    listed.coalesce(1).write.mode("overwrite").parquet(f"{path}/lists/list={version}")


def write_photos(photos: DataFrame, path: str) -> None:
    """Writes a whole table of photos."""
    write_days(photos.select(*_columns()), path, None)


def _columns() -> list[str]:
    return [c.split()[0] for c in schema.PHOTOS.split(", ")]


def read_photos(spark: SparkSession, path: str, min_time: int | None = None, max_time: int | None = None) -> DataFrame:
    """The live photos; with times, those of the days from one to the other, and only their files are opened."""
    days = live_days(spark, path)
    if min_time is not None:
        days = days.where(F.col("capture_day") >= min_time // SECONDS)
    if max_time is not None:
        days = days.where(F.col("capture_day") <= max_time // SECONDS)
    return _read(spark, path, days)


def _read(spark: SparkSession, path: str, days: DataFrame) -> DataFrame:
    name = lambda d: "__HIVE_DEFAULT_PARTITION__" if d is None else d
    folders = [f"{path}/days/version={r.version}/capture_day={name(r.capture_day)}" for r in days.collect()]  # one row a day
    if not folders:
        return spark.createDataFrame([], schema.PHOTOS)
    return spark.read.schema(schema.PHOTOS).option("basePath", f"{path}/days").parquet(*folders).select(*_columns())


def organize_stored(spark: SparkSession, path: str, min_time: int, max_time: int, *ratings: int, **more) -> DataFrame:
    """``organize`` on stored photos: opens the days between the two times."""
    return organize(read_photos(spark, path, min_time, max_time), min_time, max_time, *ratings, **more)


def histogram_stored(spark: SparkSession, path: str, tz: int = 0, min_rating: int = 0, max_rating: int = 5, min_time: int | None = None, max_time: int | None = None) -> DataFrame:
    """``date_histogram`` of stored photos, whole or of a stretch of days; only capture times and ratings are read.

    Days are local ones; a stretch is of UTC days and so has parts of local days at its ends.
    """
    return date_histogram(read_photos(spark, path, min_time, max_time), tz, min_rating, max_rating)


def change_photos(spark: SparkSession, path: str, changed: DataFrame, gone: DataFrame | None = None) -> None:
    """Puts ``changed`` (whole new rows and ``old_capture_time``; null: a new photo) in the place of the stored rows, and
    takes those of ``gone`` (photo_id, capture_time as stored) out.

    Only the days that a row leaves or enters are read and written anew.
    """
    changed = written(changed.select(*_columns(), "old_capture_time", F.col("old_capture_time").isNotNull().alias("_old")), "changed-photos")
    left = [changed.where("_old").select(capture_day("old_capture_time").alias("d")), changed.select(capture_day().alias("d"))]
    ids = [changed.select("photo_id")]
    if gone is not None:
        left.append(gone.select(capture_day().alias("d")))
        ids.append(gone.select("photo_id"))
    touched = {r.d for r in reduce(DataFrame.union, left).distinct().collect()}  # one row a day
    days = live_days(spark, path)
    known = sorted(d for d in touched if d is not None)
    hit = F.col("capture_day").isin(known) if known else F.lit(False)
    hit = F.coalesce(hit, F.lit(None in touched))
    stay = _read(spark, path, days.where(hit)).join(reduce(DataFrame.union, ids).distinct(), "photo_id", "left_anti")
    write_days(written(stay.select(*_columns()).unionByName(changed.select(*_columns())), "days-anew"), path, days.where(~hit))
