"""Discovering raw files, requests for them, and checks of their copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Extensions of raw files; each is taken all in upper or all in lower case.
RAW_EXTENSIONS = ("CR2", "NEF", "DNG", "RW2", "IIQ", "ARW", "RAF", "ORF", "PEF", "SRW", "CR3")
_RAW = r"\.(" + "|".join(f"{x}|{x.lower()}" for x in RAW_EXTENSIONS) + ")$"


def is_raw(path: Column | str) -> Column:
    return (F.col(path) if isinstance(path, str) else path).rlike(_RAW)


def discover_raws(spark: SparkSession, folder: str) -> DataFrame:
    """``path, modificationTime, length, content`` of all raw files below a folder. Contents are read only if used."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return found.where(is_raw("path"))


def filter_raws(manifest: DataFrame) -> DataFrame:
    """Rows of a manifest whose path is a raw file's, without a leading ``file://``."""
    return manifest.withColumn("path", F.regexp_replace("path", "^file://", "")).where(is_raw("path"))


def expand_requests(requests: DataFrame) -> DataFrame:
    """``request_id, path`` of comma-separated ``names``; one name that isn't raw rejects its whole request."""
    one = requests.select("request_id", F.explode(F.split("names", ",")).alias("path"))
    one = one.withColumn("path", F.regexp_replace("path", "^file://", ""))
    bad = one.where(~is_raw("path")).select("request_id").distinct()
    return one.join(bad, "request_id", "left_anti")


def card_dirs(manifest: DataFrame) -> DataFrame:
    """``dir, on_card``: folders that lie on a memory card, by ``DCIM`` in their own or a lower path.

    Paths of less than four characters are never looked into. A folder's rows are or-ed before they are shuffled.
    """
    parts = F.split(F.regexp_replace("path", "/[^/]*$", ""), "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    folder = manifest.select(F.regexp_replace("path", "/[^/]*$", "").alias("deepest"), F.explode(ups).alias("dir")).where("dir <> ''")
    return folder.groupBy("dir").agg(F.max(F.col("deepest").contains("DCIM")).alias("_any")).select("dir", (F.col("_any") & (F.length("dir") >= 4)).alias("on_card"))


def with_file_id(df: DataFrame, content: str = "content") -> DataFrame:
    """``file_id``: md5 of the bytes; the content itself is dropped, so it is never shuffled."""
    return df.withColumn("file_id", F.md5(F.col(content).cast("binary"))).drop(content)


def verify_copies(originals: DataFrame, copies: DataFrame) -> DataFrame:
    """``path, verified``: whether each original's copy has the same content; a missing copy has not."""
    mine = with_file_id(originals.select("path", "content"))
    theirs = with_file_id(copies.select("path", "content")).withColumnRenamed("file_id", "_copy")
    return mine.join(theirs, "path", "left").select("path", F.coalesce(F.col("file_id") == F.col("_copy"), F.lit(False)).alias("verified"))


def dedupe_batch(batch: DataFrame) -> DataFrame:
    """``first``: whether a row is the first of its file in the batch, by ``seq``."""
    return batch.withColumn("first", F.row_number().over(Window.partitionBy("file_id").orderBy("seq")) == 1)


def classify_import(batch: DataFrame, files: DataFrame) -> DataFrame:
    """``action`` for each row: ``new``, ``known`` (in the catalog or earlier in the batch) or ``relocate`` (known at another path)."""
    firsts = dedupe_batch(batch)
    joined = firsts.join(files.select("file_id", F.col("file_path").alias("_at")), "file_id", "left")
    action = F.when(~F.col("first"), "known").when(F.col("_at").isNull(), "new").when(F.col("_at") == F.col("path"), "known").otherwise("relocate")
    return joined.withColumn("action", action).drop("_at", "first")


def upsert_files(files: DataFrame, batch: DataFrame) -> DataFrame:
    """Known files take the batch's path, new ones come with usage 0. The batch has one row a file, at least its id and path."""
    new = batch.select("file_id", F.col("file_path").alias("_path"))
    return files.join(new, "file_id", "full_outer").withColumns({"file_path": F.coalesce("_path", "file_path"), "usage_count": F.coalesce("usage_count", F.lit(0).cast("long"))}).drop("_path")


def count_uses(files: DataFrame, new: DataFrame) -> DataFrame:
    """Files whose ``usage_count`` has grown by the photos of ``new`` (column file_id) that are added for them."""
    added = new.groupBy("file_id").agg(F.count("*").alias("_added"))
    return files.join(added, "file_id", "left").withColumn("usage_count", F.coalesce("usage_count", F.lit(0)) + F.coalesce("_added", F.lit(0))).select(*files.columns)


def add_photos(photos: DataFrame, new: DataFrame, now: int, started: int) -> DataFrame:
    """Photos with those of ``new`` (photo_id, file_id, filename, capture_time, rating) added, imported now."""
    rows = new.select(
        "photo_id", "capture_time", F.lit("").alias("name"), "filename", "file_id", F.col("rating").cast("int").alias("rating"), F.lit(0.0).alias("latitude"), F.lit(0.0).alias("longitude"),
        F.lit(now).cast("long").alias("import_time"), F.lit(now).cast("long").alias("last_processed_time"), F.lit(started).cast("long").alias("import_start_time"), F.lit(0).alias("thumb_written"), F.lit(0).alias("big_thumb_written"),
    )
    return photos.unionByName(rows)
