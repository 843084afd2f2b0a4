"""Filtering, sorting and counting photos."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def organize(
    photos: DataFrame,
    min_time: int,
    max_time: int,
    min_rating: int = 0,
    max_rating: int = 5,
    import_range: tuple[int, int] | None = None,
    processed_range: tuple[int, int] | None = None,
) -> DataFrame:
    """Photos by capture time and rating, all bounds inclusive; a negative least rating lets all marked ones in."""
    floor = -5 if min_rating < 0 else min_rating
    kept = photos.where(F.col("capture_time").between(min_time, max_time) & F.col("rating").between(floor, max_rating))
    if import_range:
        kept = kept.where(F.col("import_time").between(*import_range))
    if processed_range:
        kept = kept.where(F.col("last_processed_time").between(*processed_range))
    return kept


def organize_ids(photos: DataFrame, *bounds, **more) -> DataFrame:
    return organize(photos, *bounds, **more).select("photo_id")


def sort_keys(rating: int = 0, processed: int = 0, imported: int = 0, capture: int = 1) -> list:
    """Sort columns: optional ones by 1, -1 or 0, then always capture time and file name in one direction."""
    named = [("rating", rating), ("last_processed_time", processed), ("import_time", imported), ("capture_time", capture), ("filename", capture)]
    return [F.asc(c) if way > 0 else F.desc(c) for c, way in named if way]


def page(photos: DataFrame, size: int, **ways: int) -> DataFrame:
    """The first rows by ``sort_keys``: the rows of a page are kept in heaps, not sorted in whole."""
    return photos.orderBy(*sort_keys(**ways)).limit(size)


def counts(queue: DataFrame, photos: DataFrame) -> DataFrame:
    """One row: ``queued`` and ``matching``."""
    one = queue.agg(F.count("*").alias("queued")).withColumn("_k", F.lit(0))
    two = photos.agg(F.count("*").alias("matching")).withColumn("_k", F.lit(0))
    return one.join(two, "_k").drop("_k")


def import_batches(photos: DataFrame) -> DataFrame:
    """Photos that share one start of import."""
    return photos.groupBy("import_start_time").agg(F.count("*").alias("n"), F.min("capture_time").alias("first_capture"), F.max("capture_time").alias("last_capture"))
