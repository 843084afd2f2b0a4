"""Streams: import of manifest rows as they arrive, and the live date histogram."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from .. import schema
from ..functions.catalog import local_day
from ..operators.storage import written
from ..operators.workqueue import assign_instances, queue_additions
from ..sources.files import add_photos, classify_import, with_file_id
from . import runs

#: What a batch adds to a file: a path that replaces the one before, and the photos that were added for it.
FILE_CHANGES = "file_id string, file_path string, added long"


def last_changes(rows: DataFrame) -> DataFrame:
    """One row a file: its last path, all photos that were added, and the last batch."""
    return rows.groupBy("file_id").agg(F.max_by("file_path", "batch").alias("file_path"), F.sum("added").alias("added"), F.max("batch").alias("batch"))


TABLES = {
    "files": runs.Table("files", "file_id", FILE_CHANGES + ", batch long", last_changes),
    "photos": runs.Table("photos", "photo_id", schema.PHOTOS),
    "queue": runs.Table("queue", "photo_id", schema.QUEUE),
}


def imported(spark: SparkSession, catalog_path: str, table: str) -> DataFrame:
    """``photos`` or ``queue`` of all committed batches, or the changes of ``files`` with their ``batch``."""
    return runs.read_files(spark, TABLES[table], runs.last_commit(spark, catalog_path).files)


def files_of(changes: DataFrame) -> DataFrame:
    """``file_id, file_path, usage_count``: the last path of each file and all photos that were added for it."""
    return changes.groupBy("file_id").agg(F.max_by("file_path", "batch").alias("file_path"), F.sum("added").alias("usage_count"))


def latest_files(spark: SparkSession, catalog_path: str) -> DataFrame:
    """The files table after the last committed batch."""
    return files_of(imported(spark, catalog_path, "files"))


def import_batch(batch: DataFrame, files: DataFrame, queue: DataFrame, now: int, started: int, enqueue: bool = True, queued: int | None = None) -> dict[str, DataFrame]:
    """What a batch of manifest rows (seq, path, content or file_id, capture_time, rating) adds to each table.

    ``files`` and ``queue`` may be the part of each that the batch's files ask for; ``queued`` is then the whole
    queue's size. A new file adds its row, its first photo and, if asked, the photo's place in the queue; a file that is known at
    another path only takes the new one; all else changes nothing, so rows that come again are harmless.
    """
    spark = batch.sparkSession
    known = with_file_id(batch) if "content" in batch.columns else batch
    seen = written(classify_import(known, files), "import-batch")
    new = assign_instances(seen.where("action = 'new'"), files, "seq").withColumn("filename", F.regexp_extract("path", "[^/]*$", 0))
    photos = written(add_photos(spark.createDataFrame([], schema.PHOTOS), new, now, started), "import-photos")
    changed = seen.where("action <> 'known'").groupBy("file_id").agg(F.min_by("path", "seq").alias("file_path"), F.sum((F.col("action") == "new").cast("long")).alias("added"))
    asked = new.select("photo_id", "seq") if enqueue else new.select("photo_id", "seq").limit(0)
    return {"files": changed, "photos": photos, "queue": queue_additions(queue, photos, asked, "seq", queued)}


def stream_import(stream: DataFrame, catalog_path: str, checkpoint: str, started: int = 0, enqueue: bool = True, fanout: int = runs.FANOUT) -> StreamingQuery:
    """Runs imports over a stream of manifest rows into the sorted runs of a catalog (``runs``).

    A batch opens only the runs' files that can hold one of its own ids, and knows the queue's size from the commit;
    so its cost grows with the logarithm of the number of batches before it. A batch that is run again after its
    commit is passed over, and one that was cut off before it left nothing that is read. Read the tables with
    ``latest_files`` and ``imported``.
    """
    return stream.writeStream.foreachBatch(import_step(stream.sparkSession, catalog_path, checkpoint, started, enqueue, fanout)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def import_step(spark: SparkSession, catalog_path: str, writer: str, started: int = 0, enqueue: bool = True, fanout: int = runs.FANOUT):
    """The step that ``stream_import`` takes for each batch."""

    def make(batch: DataFrame, number: int, last: runs.Commit) -> dict[str, DataFrame]:
        spark = batch.sparkSession
        rows = written(with_file_id(batch), "import-ids")
        ids = rows.select("file_id").distinct()
        files = files_of(runs.lookup(spark, last.files, TABLES["files"], ids))
        near = runs.read_files(spark, TABLES["queue"], runs.files_for(last.files, TABLES["queue"], ids.withColumnRenamed("file_id", "photo_id")))
        queue = near.join(ids, F.substring("photo_id", 1, 32) == F.col("file_id"), "left_semi")
        made = import_batch(rows, files, queue, int(time.time()), started, enqueue, runs.count_of(last.files, TABLES["queue"]))
        return made | {"files": made["files"].withColumn("batch", F.lit(last.version + 1).cast("long"))}

    return runs.keep_appending(spark, catalog_path, TABLES, writer, make, fanout)


def stream_date_histogram(stream: DataFrame, tz: int = 0) -> DataFrame:
    """Photos by local day over a stream of photos; use output mode ``complete`` or ``update``. State: one row a day."""
    return stream.groupBy(local_day("capture_time", tz).alias("day")).agg(F.count("*").alias("thecount"))


def stream_histogram_changes(stream: DataFrame, tz: int = 0, low: int = -6, high: int = 5) -> DataFrame:
    """Photos by local day over a stream of changes: each has a photo's values before it (old_capture_time, old_rating;
    null if it was added) and after it (capture_time, rating; null if it was removed).

    Photos count while their rating lies in low..high. A day that has lost all its photos stays with 0, so mode
    ``update`` tells it. State: one row a day.
    """
    side = lambda at, rating, n: F.when(F.col(at).isNotNull() & F.col(rating).between(low, high), F.struct(local_day(at, tz).alias("day"), F.lit(n).cast("long").alias("n")))
    both = F.array_compact(F.array(side("capture_time", "rating", 1), side("old_capture_time", "old_rating", -1)))
    return stream.select(F.inline(both)).groupBy("day").agg(F.sum("n").alias("thecount"))


#: A histogram is kept as changes of days; the changes of one day add up.
DAYS = {"days": runs.Table("days", "day", "day string, n long", lambda rows: rows.groupBy("day").agg(F.sum("n").alias("n")))}


def day_changes(images: DataFrame, tz: int = 0, low: int = -6, high: int = 5) -> DataFrame:
    """``day, n`` (photos gained, or below 0 lost) for a stream of photos as they are now: photo_id, version, capture_time, rating, removed.

    Keyed state remembers each photo's version and the day on which it counts, so nothing but its new row is asked for.
    Rows may come late, twice or in any order: an image whose version isn't beyond the remembered one changes nothing,
    and of one version's images the one with the last day holds. A removed photo's version stays in the state, so that
    an older image doesn't bring it back. A photo counts while its rating lies in low..high; rows without photo_id or
    version are left out; without capture time a photo counts on no day.

    State is kept by groups of photos (``GROUPS``, by hash): a batch writes the groups that it touches anew, and a group's
    changes of one day come as one row.
    """
    counts = F.col("capture_time").isNotNull() & F.col("rating").between(low, high) & ~F.coalesce("removed", F.lit(False))
    day = F.when(counts, F.unix_date(local_day("capture_time", tz))).cast("long")
    group = F.pmod(F.xxhash64("photo_id"), F.lit(GROUPS)).cast("int")
    rows = images.where("photo_id IS NOT NULL AND version IS NOT NULL").select(group.alias("photos"), "photo_id", "version", F.coalesce(day, F.lit(NO_DAY)).alias("day"))

    def remember(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, versions, days = state.get if state.exists else ([], [], [])
        known = dict(zip(ids, zip(versions, days, strict=True), strict=True))
        latest: dict[str, tuple[int, int]] = {}
        for p in parts:
            for photo, version, day in zip(p["photo_id"], p["version"].tolist(), p["day"].tolist(), strict=True):
                if photo not in latest or (version, day) > latest[photo]:
                    latest[photo] = version, day
        moved: Counter = Counter()
        newer = {k: v for k, v in latest.items() if k not in known or v[0] > known[k][0]}
        for photo, (_, day) in newer.items():
            moved[day] += 1
            moved[known[photo][1] if photo in known else NO_DAY] -= 1
        if newer:
            known |= newer
            state.update((list(known), *map(list, zip(*known.values(), strict=True))))
        found = [(d, n) for d, n in moved.items() if n and d != NO_DAY]
        if found:
            yield pd.DataFrame(found, columns=["day", "n"])

    changes = rows.groupBy("photos").applyInPandasWithState(remember, "day long, n long", "photo_ids array<string>, versions array<long>, days array<long>", "append", "NoTimeout")
    return changes.select(F.date_from_unix_date(F.col("day").cast("int")).alias("day"), "n")


#: Groups of photos that share a row of state and a call of Python. Another number can't go on from an old checkpoint.
GROUPS = 1 << 12
#: Stands for "on no day" where a number is asked for.
NO_DAY = -(2**40)


def stream_live_histogram(images: DataFrame, path: str, checkpoint: str, tz: int = 0, low: int = -6, high: int = 5, fanout: int = runs.FANOUT) -> StreamingQuery:
    """Keeps the date histogram of a stream of photos' new rows and removals (``day_changes``) below ``path``.

    A batch adds only its days' changes as a sorted run; ``live_histogram`` reads the sums.
    """

    def make(batch: DataFrame, number: int, last: runs.Commit) -> dict[str, DataFrame]:
        return {"days": DAYS["days"].merged(batch.select(F.col("day").cast("string").alias("day"), "n"))}

    step = runs.keep_appending(images.sparkSession, path, DAYS, checkpoint, make, fanout)
    return day_changes(images, tz, low, high).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_histogram(spark: SparkSession, path: str) -> DataFrame:
    """``day, thecount`` after the last committed batch; days without photos have no row."""
    rows = runs.read_files(spark, DAYS["days"], runs.last_commit(spark, path).files)
    return DAYS["days"].merged(rows).where("n <> 0").select(F.col("day").cast("date").alias("day"), F.col("n").alias("thecount"))
