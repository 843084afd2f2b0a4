"""The work queue kept in order by keys with gaps, in zones of some rows each.

A row's place is told by its key, not by a dense index: a move gives one row a key between its new neighbours, and only
the zones that it leaves and enters are written. Where two neighbours leave no gap, the keys of that zone are spread
anew; a zone that has grown to twice its size is cut in two. Dense indices are a zone's start, from the counts of the
zones before it, and a number inside the zone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import numbers_in, written

#: Rows of a new zone, and the distance of keys.
ZONE_ROWS = 100_000
GAP = 1 << 20

ROWS = "order_key long, photo_id string, processed boolean, exported boolean, output boolean"
ZONES = "low long, version long, n long"
NAMES = [c.split()[0] for c in ROWS.split(", ")]


@dataclass(frozen=True)
class Zone:
    """Rows with keys from ``low`` up to the next zone's, in the folder of the version that wrote it last."""

    low: int
    version: int
    n: int


def zones(spark: SparkSession, path: str) -> list[Zone]:
    """The live zones by their keys; a zone stands for many rows, so the list is short."""
    known = numbers_in(spark, f"{path}/lists", "list")
    rows = spark.read.schema(ZONES).parquet(f"{path}/lists/list={known[-1]}").collect() if known else []
    return sorted((Zone(*r) for r in rows), key=lambda z: z.low)


def _read(spark: SparkSession, path: str, chosen: list[Zone]) -> DataFrame:
    """Rows of these zones, with their ``low``."""
    if not chosen:
        return spark.createDataFrame([], ROWS + ", low long")
    folders = [f"{path}/zones/version={z.version}/low={z.low}" for z in chosen]
    return spark.read.schema(ROWS + ", low long").option("basePath", f"{path}/zones").parquet(*folders).select(*NAMES, "low")


def _write(spark: SparkSession, path: str, rows: DataFrame, keep: list[Zone]) -> None:
    """Writes whole zones (rows with their ``low``) as a new version beside those that stay as they are."""
    known = numbers_in(spark, f"{path}/lists", "list")
    version = known[-1] + 1 if known else 0
    at = f"{path}/zones/version={version}"
    rows.repartition("low").sortWithinPartitions("low", "order_key").write.mode("overwrite").partitionBy("low").parquet(at)
    made = spark.read.schema(ROWS + ", low long").parquet(at).groupBy("low").agg(F.count("*").alias("n"))
    kept = spark.createDataFrame([(z.low, z.version, z.n) for z in keep], ZONES)
    listed = kept.unionByName(made.select("low", F.lit(version).cast("long").alias("version"), "n"))
    listed.coalesce(1).write.mode("overwrite").parquet(f"{path}/lists/list={version}")


def create(queue: DataFrame, path: str, zone_rows: int = ZONE_ROWS, gap: int = GAP) -> None:
    """Stores a queue with dense ``sorted_index`` in zones of ``zone_rows``."""
    i = F.col("sorted_index")
    low = (i - F.pmod(i, F.lit(zone_rows))) * gap
    rows = queue.select((i * gap).cast("long").alias("order_key"), *NAMES[1:], low.cast("long").alias("low"))
    _write(queue.sparkSession, path, rows, [])


def ranked(spark: SparkSession, path: str) -> DataFrame:
    """The queue with its dense ``sorted_index``: each zone is numbered by itself after the rows of those before it."""
    live = zones(spark, path)
    starts, before = [], 0
    for z in live:
        starts.append((z.low, before))
        before += z.n
    inside = F.row_number().over(Window.partitionBy("low").orderBy("order_key")) - 1
    placed = _read(spark, path, live).withColumn("_at", inside).join(F.broadcast(spark.createDataFrame(starts, "low long, _start long")), "low")  # one row a zone
    return placed.select((F.col("_start") + F.col("_at")).cast("long").alias("sorted_index"), *NAMES[1:])




def remove(spark: SparkSession, path: str, ids: DataFrame) -> None:
    """Takes the photos of ``ids`` out: only the zones that hold one are written."""
    live = zones(spark, path)
    gone = written(ids.select("photo_id").distinct(), "queue-gone")
    hit = {r.low for r in _read(spark, path, live).select("photo_id", "low").join(gone, "photo_id", "left_semi").select("low").distinct().collect()}
    if hit:
        rows = _read(spark, path, [z for z in live if z.low in hit]).join(gone, "photo_id", "left_anti")
        _write(spark, path, written(rows, "queue-zones"), [z for z in live if z.low not in hit])


def move(spark: SparkSession, path: str, photo_id: str, dest: int, zone_rows: int = ZONE_ROWS, gap: int = GAP) -> None:
    """Moves a photo to a place (beyond the end: to the end). A photo that isn't queued changes nothing."""
    live = zones(spark, path)
    source = _read(spark, path, live).where(F.col("photo_id") == photo_id).first()
    if source is None:
        return
    left, at = [(z, z.n - (z.low == source.low)) for z in live], max(0, dest)
    for z, n in left:
        target = z
        if at <= n:
            break
        at -= n
    else:
        at = left[-1][1]
    rest = _read(spark, path, [target]).where(F.col("photo_id") != photo_id)
    ends = rest.orderBy("order_key").select("order_key").offset(max(0, at - 1)).limit(2).collect()
    keys = [r[0] for r in ends]
    following = next((z.low for z in live if z.low > target.low), None)
    first = target.low == live[0].low
    before = keys[0] if at > 0 else None
    after = (keys[1] if len(keys) > 1 else None) if at > 0 else (keys[0] if keys else None)
    low_end = before if before is not None else (after - 2 * gap if first and after is not None else target.low - 1)
    high_end = after if after is not None else (following if following is not None else low_end + 2 * gap)
    key = (low_end + high_end) // 2
    moved = spark.createDataFrame([(key, photo_id, source.processed, source.exported, source.output, target.low)], ROWS + ", low long")
    if not low_end < key < high_end:
        # no room: the zone's keys are spread evenly over its span, which the new row's place divides
        span = (following if following is not None else target.low + (target.n + 2) * gap) - target.low
        numbered = rest.withColumn("_i", F.row_number().over(Window.partitionBy("low").orderBy("order_key")) - 1)
        numbered = numbered.withColumn("_i", F.col("_i") + (F.col("_i") >= at).cast("int")).unionByName(moved.withColumn("_i", F.lit(at)))
        whole = numbered.withColumn("order_key", (target.low + F.expr(f"_i * {span}L div {target.n + 1}")).cast("long")).drop("_i")
    else:
        whole = rest.unionByName(moved)
    whole = written(whole, "queue-zone")
    count = target.n + (target.low != source.low)
    if count >= 2 * zone_rows:
        middle = whole.orderBy("order_key").select("order_key").offset(count // 2).limit(1).first()[0]
        whole = whole.withColumn("low", F.when(F.col("order_key") >= middle, middle).otherwise(F.col("low")))
    if source.low != target.low:
        theirs = _read(spark, path, [z for z in live if z.low == source.low]).where(F.col("photo_id") != photo_id)
        whole = whole.unionByName(theirs)
    keep = [z for z in live if z.low not in (source.low, target.low)]
    _write(spark, path, written(whole, "queue-zones"), keep)
