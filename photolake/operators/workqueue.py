"""The ordered work queue. Every operator returns the new queue; indices stay 0..n-1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.catalog import is_edited
from .numbering import dense_index

COLUMNS = ["qt_index", "sorted_index", "processed", "exported", "output", "photo_id"]


def queue_view(queue: DataFrame, photos: DataFrame) -> DataFrame:
    """The queue with ratings; order by ``qt_index`` where it is shown."""
    return queue.join(photos.select("photo_id", "rating"), "photo_id").select(*COLUMNS, "rating")


def queue_additions(queue: DataFrame, photos: DataFrame, ids: DataFrame, order: str, size: int | None = None) -> DataFrame:
    """Rows to append for the photos of ``ids`` (``photo_id`` and the numeric column ``order``) that aren't queued yet.

    A repeated request counts once, at its first place. Only the new rows are numbered; they follow on the queue's
    size, which is counted unless it is given (``queue`` may then hold the rows of these photos alone).
    """
    wanted = ids.groupBy("photo_id").agg(F.min(order).alias("_order")).join(queue, "photo_id", "left_anti")
    known = wanted.join(photos.select("photo_id", is_edited("import_time", "last_processed_time").alias("processed")), "photo_id")
    numbered = dense_index(known, "_order", "_at", "photo_id")
    if size is None:
        numbered = numbered.join(F.broadcast(queue.agg(F.count("*").alias("_size"))))  # one row
    else:
        numbered = numbered.withColumn("_size", F.lit(size))
    at = (F.col("_size") + F.col("_at")).cast("long")
    return numbered.select(at.alias("qt_index"), at.alias("sorted_index"), "processed", F.lit(False).alias("exported"), F.lit(False).alias("output"), "photo_id")


def enqueue(queue: DataFrame, photos: DataFrame, ids: DataFrame, order: str) -> DataFrame:
    """The queue with the photos of ``ids`` that aren't queued yet at its end, as ``queue_additions`` numbers them."""
    return queue.select(*COLUMNS).unionByName(queue_additions(queue, photos, ids, order))


def renumbered(queue: DataFrame) -> DataFrame:
    """Closes the gaps of each index by itself."""
    first = dense_index(queue.select(*COLUMNS), "qt_index", "_q", "photo_id")
    both = dense_index(first, "sorted_index", "_s", "photo_id")
    return both.select(F.col("_q").alias("qt_index"), F.col("_s").alias("sorted_index"), *COLUMNS[2:])


def dequeue(queue: DataFrame, ids: DataFrame) -> DataFrame:
    """Without the photos of ``ids``; ids that aren't queued change nothing."""
    return renumbered(queue.join(ids.select("photo_id").distinct(), "photo_id", "left_anti"))


def move(queue: DataFrame, photo_id: str, dest: int) -> DataFrame:
    """Moves an item to a place by ``sorted_index``; those between move up by one towards the gap."""
    source = queue.where(F.col("photo_id") == photo_id).select(F.col("sorted_index").alias("_from"))
    i, a, d = F.col("sorted_index"), F.col("_from"), F.lit(dest).cast("long")
    moved = F.when(a.isNull(), i).when(i == a, d).when((a < i) & (i <= d), i - 1).when((d <= i) & (i < a), i + 1).otherwise(i)
    return queue.join(F.broadcast(source), how="left").withColumn("sorted_index", moved).select(*COLUMNS)


def reset_order(queue: DataFrame) -> DataFrame:
    return queue.withColumn("qt_index", F.col("sorted_index")).select(*COLUMNS)


def queue_neighbours(queue: DataFrame) -> DataFrame:
    """``photo_id, prev, next`` by ``sorted_index``, empty at the ends. Indices are dense, so neighbours are joined."""
    q = queue.select("sorted_index", "photo_id")
    side = lambda step, name: q.select((F.col("sorted_index") + step).alias("sorted_index"), F.col("photo_id").alias(name))
    joined = q.join(side(1, "prev"), "sorted_index", "left").join(side(-1, "next"), "sorted_index", "left")
    return joined.select("photo_id", F.coalesce("prev", F.lit("")).alias("prev"), F.coalesce("next", F.lit("")).alias("next"))


def queue_position(queue: DataFrame) -> DataFrame:
    """``photo_id, position``: place from 0 to 1, 0 for a single item. An empty queue has no rows (the place is then -1)."""
    size = queue.agg(F.count("*").alias("_n"))
    place = F.when(F.col("_n") == 1, 0.0).otherwise(F.try_divide(F.col("sorted_index"), F.col("_n") - 1))
    return queue.join(F.broadcast(size)).select("photo_id", place.alias("position"))


def clear(queue: DataFrame) -> DataFrame:
    return queue.select(*COLUMNS).limit(0)


def mark_exported(queue: DataFrame, ids: DataFrame) -> DataFrame:
    hit = ids.select("photo_id").distinct().withColumn("_hit", F.lit(True))
    return queue.join(hit, "photo_id", "left").withColumn("exported", F.col("exported") | F.coalesce("_hit", F.lit(False))).select(*COLUMNS)


def split_queue(queue: DataFrame, photos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queued photos that stay (rating 0 or more), and those to forget."""
    rated = queue_view(queue, photos)
    return rated.where("rating >= 0"), rated.where("rating < 0")


def usage_counts(files: DataFrame, photos: DataFrame) -> DataFrame:
    """``file_id, uses``: photos of each file that were imported, 0 for none."""
    return files.select("file_id").join(photos.select("file_id", "import_time"), "file_id", "left").groupBy("file_id").agg(F.count("import_time").alias("uses"))


def reconcile_usage(files: DataFrame, photos: DataFrame) -> DataFrame:
    """Files with their true counts; rows that were right are as before."""
    return files.join(usage_counts(files, photos), "file_id", "left").withColumn("usage_count", F.coalesce("uses", "usage_count").cast("long")).drop("uses")


def forget(photos: DataFrame, params: DataFrame, queue: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Photos, parameters, queue and files without the queued photos that are marked (rating below 0).

    Marked photos that aren't queued stay. Files are recounted, unused ones go, and the queue is numbered anew in the
    order of ``sorted_index``, both indices alike.
    """
    stay, gone = split_queue(queue, photos)
    ids = gone.select("photo_id").distinct()
    left = photos.join(ids, "photo_id", "left_anti")
    numbered = dense_index(stay.select(*COLUMNS), "sorted_index", "_at", "photo_id")
    new_queue = numbered.select(F.col("_at").alias("qt_index"), F.col("_at").alias("sorted_index"), *COLUMNS[2:])
    return left, params.join(ids, "photo_id", "left_anti"), new_queue, reconcile_usage(files, left).where("usage_count > 0")


def assign_instances(new: DataFrame, files: DataFrame, *order: str) -> DataFrame:
    """``number``: the file's uses so far and a running number over its new photos; ``photo_id`` by it."""
    from ..functions.catalog import photo_id_of

    running: Column = F.row_number().over(Window.partitionBy("file_id").orderBy(*order))
    based = new.join(files.select("file_id", F.col("usage_count").alias("_base")), "file_id", "left")
    return based.withColumn("number", (F.coalesce("_base", F.lit(0)) + running).cast("long")).withColumn("photo_id", photo_id_of("file_id", "number")).drop("_base")
