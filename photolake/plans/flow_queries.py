"""Queries that go through files or streams. Their folders lie in the shared checkpoint folder."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from .. import schema
from ..operators import stored
from ..operators.storage import shared_folder, written
from ..sources.files import discover_raws, with_file_id
from ..streaming import live
from .registry import query


def folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/flow-{uuid.uuid4().hex}"


@query("catalog_round_trip", "SELECT photo_id, capture_time, filename, rating, last_processed_time FROM photos", "photos")
def catalog_round_trip(spark: SparkSession, d: str) -> DataFrame:
    at = folder(spark)
    schema.write_catalog({"photos": fx.catalog_photos(spark, d)}, at)
    return schema.read_catalog(spark, at, ("photos",))["photos"].select("photo_id", "capture_time", "filename", "rating", "last_processed_time")


@query(
    "catalog_tables",
    """SELECT 'photos' AS name, count(*) AS n, count(DISTINCT photo_id) AS keys, sum(capture_time + rating)::DOUBLE AS total FROM photos
  UNION ALL SELECT 'files', count(*), count(DISTINCT file_id), round(sum(aperture + usage_count), 3) FROM files UNION ALL SELECT 'queue', count(*), count(DISTINCT photo_id), sum(qt_index + 2 * sorted_index)::DOUBLE FROM queue
  UNION ALL SELECT 'params', count(*), count(DISTINCT photo_id), round(sum(temperature + exposure_comp + lens_ca), 3) FROM params UNION ALL SELECT 'lens_prefs', count(*), count(DISTINCT exif_camera || exif_lens), sum(switch)::DOUBLE FROM lens_prefs""",
    "photos", "files", "queue", "params", "lens_prefs",
)
def catalog_tables(spark: SparkSession, d: str) -> DataFrame:
    """All five tables written and read back: rows, keys and a sum of each."""
    at = folder(spark)
    made = {"photos": fx.catalog_photos(spark, d), "files": fx.files(spark, d), "queue": fx.queue(spark, d), "params": fx.params(spark, d), "lens_prefs": fx.lens_prefs(spark, d)}
    schema.write_catalog(made, at)
    key = {"photos": "photo_id", "files": "file_id", "queue": "photo_id", "params": "photo_id", "lens_prefs": "concat(exif_camera, exif_lens)"}
    total = {"photos": "capture_time + rating", "files": "aperture + usage_count", "queue": "qt_index + 2 * sorted_index", "params": "temperature + exposure_comp + lens_ca", "lens_prefs": "lens_ca"}
    sums = [t.selectExpr(f"'{n}' AS name", f"{key[n]} AS k", f"cast({total[n]} AS double) AS v").groupBy("name").agg(F.count("*").alias("n"), F.countDistinct("k").alias("keys"), F.round(F.sum("v"), 3).alias("total")) for n, t in schema.read_catalog(spark, at).items()]
    return reduce(DataFrame.unionByName, sums)


@query(
    "organize_stored",
    """SELECT photo_id, capture_time, rating FROM (SELECT photo_id, capture_time + CASE WHEN event_id % 5 = 0 THEN 86400 ELSE 0 END AS capture_time,
    CASE WHEN event_id % 5 = 0 THEN 3 ELSE rating END AS rating FROM photos WHERE event_id % 7 <> 0), (SELECT min(capture_time) AS a, max(capture_time) AS b FROM photos)
  WHERE capture_time BETWEEN a + (b - a) // 4 AND b - (b - a) // 4 AND rating BETWEEN 0 AND 4""",
    "photos",
)
def organize_stored(spark: SparkSession, d: str) -> DataFrame:
    """Photos stored by day; one in five moves to the next day, one in seven goes, each in a version that rewrites only
    its days; then the middle half of the time is read."""
    at, p = folder(spark), fx.photos(spark, d)
    stored.write_photos(p, at)
    edited = p.where("event_id % 5 = 0").withColumn("old_capture_time", F.col("capture_time")).withColumns({"capture_time": F.col("capture_time") + 86400, "rating": F.lit(3)})
    stored.change_photos(spark, at, edited)
    later = F.when(F.col("event_id") % 5 == 0, 86400).otherwise(0)
    none = edited.limit(0)
    stored.change_photos(spark, at, none, p.where("event_id % 7 = 0").withColumn("capture_time", F.col("capture_time") + later))
    a, b = p.agg(F.min("capture_time"), F.max("capture_time")).first()
    quarter = (b - a) // 4
    return stored.organize_stored(spark, at, a + quarter, b - quarter, 0, 4).select("photo_id", "capture_time", "rating")


@query("discover_raws", "SELECT source, count(*) * 33 AS bytes FROM documents WHERE doc_id % 2 = 0 GROUP BY 1")
def found_raws(spark: SparkSession, d: str) -> DataFrame:
    """Content ids of the documents written as files in a folder for each source, raw and other ones; the raw ones found below."""
    at = folder(spark)
    docs = fx.manifest(spark, d).select("seq", F.md5(F.col("content").cast("binary")).alias("id")).join(fx.table(spark, d, "documents").select(F.col("doc_id").alias("seq"), "source"), "seq")
    for kind, rows in (("nef", docs.where("seq % 2 = 0")), ("jpg", docs.where("seq % 2 = 1"))):
        rows.select("source", F.coalesce("id", F.md5(F.lit(b""))).alias("id")).write.partitionBy("source").mode("append").option("extension", kind).csv(f"{at}/card")
    found = discover_raws(spark, f"{at}/card")
    return found.groupBy(F.regexp_extract("path", "source=([^/]*)/", 1).alias("source")).agg(F.sum("length").alias("bytes"))


@query(
    "stream_import",
    """SELECT *, count(*) OVER () AS files, count(*) OVER () - 1 AS last_index FROM (SELECT md5(content) AS file_id, md5(content) || '0001' AS photo_id, 1 AS usage_count, true AS queued,
  '/card/' AS card FROM manifest GROUP BY content)""",
    "manifest",
)
def stream_import(spark: SparkSession, d: str) -> DataFrame:
    """Manifest rows in four deliveries, two of them made twice: files, photos and queue after all of them."""
    at = folder(spark)
    m = fx.manifest(spark, d).select("seq", "path", "content", F.col("seq").alias("capture_time"), (F.col("seq") % 6).cast("int").alias("rating"))
    for k in (0, 1, 2, 3, 1, 3):
        m.where(F.col("seq") % 4 == k).write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(m.schema).parquet(f"{at}/in")
        live.stream_import(stream, f"{at}/catalog", f"{at}/state").awaitTermination()
    files, photos, queue = live.latest_files(spark, f"{at}/catalog"), live.imported(spark, f"{at}/catalog", "photos"), live.imported(spark, f"{at}/catalog", "queue")
    sizes = files.agg(F.count("*").alias("files")).join(queue.agg(F.max("qt_index").alias("last_index")))  # one row
    rows = files.join(photos.select("file_id", "photo_id"), "file_id", "left").join(queue.select("photo_id", F.lit(True).alias("queued")), "photo_id", "left")
    return rows.select("file_id", "photo_id", "usage_count", "queued", F.substring("file_path", 1, 6).alias("card")).join(F.broadcast(sizes))


@query("stream_date_histogram", "SELECT (DATE '1970-01-01' + ((capture_time + 7200) // 86400)::INTEGER) AS day, count(*) AS thecount FROM photos GROUP BY 1", "photos")
def stream_date_histogram(spark: SparkSession, d: str) -> DataFrame:
    at, name = folder(spark), f"hist_{uuid.uuid4().hex}"
    p = fx.catalog_photos(spark, d)
    p.repartition(4).write.parquet(f"{at}/in")
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    days = live.stream_date_histogram(stream, 2)
    days.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


@query(
    "stream_histogram_changes",
    """SELECT (DATE '1970-01-01' + ((t + 7200) // 86400)::INTEGER) AS day, count(*) AS thecount FROM (
  SELECT capture_time + CASE WHEN event_id % 5 = 0 THEN 86400 ELSE 0 END AS t, CASE WHEN event_id % 5 = 0 THEN 3 ELSE rating END AS rating FROM photos WHERE event_id % 7 <> 0) WHERE rating >= 0 GROUP BY 1""",
    "photos",
)
def stream_histogram_changes(spark: SparkSession, d: str) -> DataFrame:
    """All photos are added, one in five then gets another day and rating, and one in seven is removed."""
    at, name = folder(spark), f"hist_{uuid.uuid4().hex}"
    p = fx.photos(spark, d)
    edited = F.col("event_id") % 5 == 0
    later, rated = F.col("capture_time") + F.when(edited, 86400).otherwise(0), F.when(edited, 3).otherwise(F.col("rating"))
    none = F.lit(None)
    rows = lambda *values: [v.cast(t).alias(n) for v, t, n in zip(values, ("long", "int") * 2, ("old_capture_time", "old_rating", "capture_time", "rating"), strict=True)]
    added = p.select(*rows(none, none, F.col("capture_time"), F.col("rating")))
    moved = p.where(edited).select(*rows(F.col("capture_time"), F.col("rating"), later, rated))
    removed = p.where("event_id % 7 = 0").select(*rows(later, rated, none, none))
    for changes in (added, moved, removed):
        changes.write.mode("append").parquet(f"{at}/in")
    stream = spark.readStream.schema(added.schema).option("maxFilesPerTrigger", 8).parquet(f"{at}/in")
    days = live.stream_histogram_changes(stream, 2, 0, 5)
    days.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).where("thecount <> 0")


@query(
    "stream_live_histogram",
    """SELECT (DATE '1970-01-01' + ((t + 7200) // 86400)::INTEGER) AS day, count(*) AS thecount FROM (
  SELECT capture_time + CASE WHEN event_id % 5 = 0 THEN 86400 ELSE 0 END AS t, CASE WHEN event_id % 5 = 0 THEN 3 ELSE rating END AS rating FROM photos WHERE event_id % 7 <> 0) WHERE rating >= 0 GROUP BY 1""",
    "photos",
)
def stream_live_histogram(spark: SparkSession, d: str) -> DataFrame:
    """The same edits and removals as bare new rows of the photos, in two runs of the stream with a restart between:
    first all photos and some edits, then the other edits, the removals, and late copies of the first rows."""
    at = folder(spark)
    p = written(fx.photos(spark, d).select("photo_id", "capture_time", "rating", "event_id"), "live-photos")
    edited, removed = F.col("event_id") % 5 == 0, F.col("event_id") % 7 == 0
    image = lambda rows, version, gone: rows.select("photo_id", F.lit(version).cast("long").alias("version"), "capture_time", "rating", F.lit(gone).alias("removed"))
    moved = p.withColumns({"capture_time": F.col("capture_time") + 86400, "rating": F.lit(3)})
    first = [image(p, 1, False), image(moved.where(edited & (F.col("event_id") % 2 == 0)), 2, False)]
    second = [image(moved.where(edited), 2, False), image(p.where(removed), 3, True), image(p.where(edited | removed), 1, False)]
    for images in (first, second):
        for rows in images:
            rows.write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 64).parquet(f"{at}/in")
        live.stream_live_histogram(stream, f"{at}/days", f"{at}/state", 2, 0, 5).awaitTermination()
    return live.live_histogram(spark, f"{at}/days")


@query("file_ids_of_batch", "SELECT md5(content) AS file_id, count(*) AS n FROM manifest GROUP BY 1", "manifest")
def file_ids_of_batch(spark: SparkSession, d: str) -> DataFrame:
    return with_file_id(fx.manifest(spark, d)).groupBy("file_id").agg(F.count("*").alias("n"))
