"""Queries of the photo catalog over the fixture tables."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from .. import schema
from ..functions import catalog as fn
from ..operators import days, orderkeys, organize, params, workqueue
from ..operators.storage import shared_folder
from ..sources import camera_constants, files as sources
from .registry import query

TODAY = datetime.date(2024, 2, 3)
NOW = 1_710_000_000
TIMES = (1_704_200_000, 1_706_000_000)
DAY = "(DATE '1970-01-01' + ((capture_time + {s}) // 86400)::INTEGER)"
DAY2 = DAY.format(s=7200)
DAY_5 = DAY.format(s=-18000)
QUEUE = "qt_index, sorted_index, processed, exported, output, photo_id"


def _hist_sql(tz: int, where: str = "") -> str:
    d = DAY.format(s=tz * 3600)
    return f"""SELECT day, n AS thecount, (date_diff('day', DATE '1970-01-01', day) + 2440588)::BIGINT AS julday, strftime(day, '%Y/%m/%d') AS thedate, strftime(day, '%Y/%m') AS yearmonth,
  strftime(day, '%m') AS themonth, strftime(day, '%d') AS theday FROM (SELECT a.day, coalesce(b.n, 0) AS n FROM
  (SELECT unnest(generate_series(least(min({d}), DATE '{TODAY}')::TIMESTAMP, greatest(max({d}), DATE '{TODAY}')::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM photos) a
  LEFT JOIN (SELECT {d} AS day, count(*) AS n FROM photos {where} GROUP BY 1) b ON a.day = b.day)"""


@query("date_histogram_dense", _hist_sql(2), "photos")
def date_histogram_dense(spark: SparkSession, d: str) -> DataFrame:
    p = fx.catalog_photos(spark, d)
    return days.densify_days(days.date_histogram(p, 2), p, 2, TODAY)


@query("date_histogram_rated", _hist_sql(-5, "WHERE rating BETWEEN 2 AND 4"), "photos")
def date_histogram_rated(spark: SparkSession, d: str) -> DataFrame:
    p = fx.catalog_photos(spark, d)
    return days.densify_days(days.date_histogram(p, -5, 2, 4), p, -5, TODAY)


@query("bar_height", f"SELECT {DAY2} AS day, round(least(1.0, (ln(count(*)) + 1) / 16), 6) AS height FROM photos GROUP BY 1", "photos")
def bar_height(spark: SparkSession, d: str) -> DataFrame:
    return days.date_histogram(fx.catalog_photos(spark, d), 2).select("day", F.round(fn.bar_height("thecount"), 6).alias("height"))


@query(
    "mark_selected",
    f"SELECT day, n AS thecount, day BETWEEN DATE '2024-01-05' AND DATE '2024-01-09' AS selected, least(day, DATE '2024-01-10') AS lo, greatest(day, DATE '2024-01-10') AS hi, least(day + 9, DATE '{TODAY}')::DATE AS later FROM (SELECT {DAY2} AS day, count(*) AS n FROM photos GROUP BY 1)",
    "photos",
)
def mark_selected(spark: SparkSession, d: str) -> DataFrame:
    hist = days.date_histogram(fx.catalog_photos(spark, d), 2)
    lo, hi = days.range_from_anchor("day", F.lit(datetime.date(2024, 1, 10)))
    return days.mark_selected(hist, datetime.date(2024, 1, 5), datetime.date(2024, 1, 9)).withColumns({"lo": lo, "hi": hi, "later": days.step_days("day", 9, TODAY)})


@query("day_bounds", f"SELECT DISTINCT {DAY_5} AS day, epoch({DAY_5})::BIGINT + 18000 AS lo, epoch({DAY_5})::BIGINT + 18000 + 86399 AS hi FROM photos", "photos")
def day_bounds(spark: SparkSession, d: str) -> DataFrame:
    one = fx.catalog_photos(spark, d).select(fn.local_day("capture_time", -5).alias("day")).distinct()
    lo, hi = fn.day_bounds("day", "day", -5)
    return one.withColumns({"lo": lo, "hi": hi})


@query("organize", f"SELECT photo_id, capture_time, rating FROM photos WHERE capture_time BETWEEN {TIMES[0]} AND {TIMES[1]} AND rating BETWEEN 1 AND 4", "photos")
def organize_filter(spark: SparkSession, d: str) -> DataFrame:
    return organize.organize(fx.catalog_photos(spark, d), *TIMES, 1, 4).select("photo_id", "capture_time", "rating")


@query("organize_ids", f"SELECT photo_id FROM photos WHERE capture_time BETWEEN {TIMES[0]} AND {TIMES[1]} AND rating BETWEEN -5 AND 5", "photos")
def organize_ids(spark: SparkSession, d: str) -> DataFrame:
    return organize.organize_ids(fx.catalog_photos(spark, d), *TIMES, -3, 5)


@query(
    "organize_ranges",
    "SELECT photo_id, import_time FROM photos WHERE capture_time BETWEEN 0 AND 9999999999 AND rating BETWEEN 0 AND 5 AND import_time BETWEEN 1704500000 AND 1705500000 AND last_processed_time BETWEEN 1704600000 AND 1705400000",
    "photos",
)
def organize_ranges(spark: SparkSession, d: str) -> DataFrame:
    kept = organize.organize(fx.catalog_photos(spark, d), 0, 9999999999, import_range=(1704500000, 1705500000), processed_range=(1704600000, 1705400000))
    return kept.select("photo_id", "import_time")


@query("organize_page", "SELECT photo_id, rating, capture_time, filename FROM photos WHERE rating BETWEEN 0 AND 5 ORDER BY rating DESC, last_processed_time, capture_time DESC, filename DESC LIMIT 100", "photos")
def organize_page(spark: SparkSession, d: str) -> DataFrame:
    kept = organize.organize(fx.catalog_photos(spark, d), 0, 9999999999)
    return organize.page(kept, 100, rating=-1, processed=1, capture=-1).select("photo_id", "rating", "capture_time", "filename")


@query("import_batches", "SELECT import_start_time, count(*) AS n, min(capture_time) AS first_capture, max(capture_time) AS last_capture FROM photos GROUP BY 1", "photos")
def import_batches(spark: SparkSession, d: str) -> DataFrame:
    return organize.import_batches(fx.catalog_photos(spark, d))


@query("counts", "SELECT (SELECT count(*) FROM queue) AS queued, count(*) AS matching FROM photos WHERE rating BETWEEN 1 AND 5", "queue")
def counts(spark: SparkSession, d: str) -> DataFrame:
    return organize.counts(fx.queue(spark, d), organize.organize(fx.catalog_photos(spark, d), 0, 9999999999, 1))


@query(
    "ratings",
    """SELECT photo_id, least(5, greatest(-6, rating + 3)) AS clamped,
  least(5, greatest(-6, CASE WHEN rating < 0 THEN -1 + 2 WHEN rating + 2 < 0 THEN -1 ELSE rating + 2 END)) AS up,
  least(5, greatest(-6, CASE WHEN rating < 0 THEN rating WHEN rating - 2 < 0 THEN -1 ELSE rating - 2 END)) AS down, -1 - rating AS toggled FROM photos""",
    "photos",
)
def ratings(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("rating")
    return fx.catalog_photos(spark, d).select("photo_id", fn.clamp_rating(r + 3).alias("clamped"), fn.bump_rating(r, 2).alias("up"), fn.bump_rating(r, -2).alias("down"), fn.toggle_mark(r).alias("toggled"))


@query(
    "labels",
    """SELECT photo_id, import_time < last_processed_time - 1 AS edited, left(photo_id, 4) AS shard, left(photo_id, 32) AS of_file,
  strftime(make_timestamp((capture_time + 7200) * 1000000), '%a %Y-%m-%d %H:%M:%S') AS label, strftime(make_timestamp(capture_time * 1000000), '%Y:%m:%d %H:%M:%S') AS exif,
  strftime(make_timestamp((capture_time - 10800) * 1000000), '/%Y/%m/%Y-%m-%d/') AS dest, capture_time - 3600 AS read_back FROM photos""",
    "photos",
)
def labels(spark: SparkSession, d: str) -> DataFrame:
    p = fx.catalog_photos(spark, d)
    return p.select(
        "photo_id",
        fn.is_edited("import_time", "last_processed_time").alias("edited"),
        fn.with_shard("photo_id").alias("shard"),
        fn.file_id_of("photo_id").alias("of_file"),
        fn.time_label("capture_time", 2).alias("label"),
        fn.exif_text("capture_time").alias("exif"),
        fn.dest_path("capture_time", -3).alias("dest"),
        fn.capture_time(F.lit(""), fn.exif_text("capture_time"), 3600).alias("read_back"),
    )


@query(
    "metadata_rules",
    """SELECT cust_key, (CASE cust_key % 9 WHEN 3 THEN 2 WHEN 6 THEN 3 WHEN 8 THEN 1 ELSE 0 END)::INTEGER AS turns, (CASE cust_key % 9 WHEN 3 THEN 2 WHEN 5 THEN 1 WHEN 6 THEN 3 ELSE 0 END)::INTEGER AS turns_cr3,
  (CASE WHEN camera_make = 'Canon' THEN least(5, greatest(0, cust_key % 12 - 4)) ELSE 0 END)::BIGINT AS meta_rating, CASE WHEN cust_key % 3 = 0 THEN exif_lens WHEN cust_key % 3 = 1 THEN 'second' ELSE 'third' END AS lens,
  CASE WHEN aperture >= 8 THEN printf('%.0f', aperture) ELSE printf('%.1f', aperture) END AS f_label, ((cust_key % 4 + 3) % 4)::BIGINT AS right_turn, ((cust_key % 4 + 1) % 4)::BIGINT AS left_turn FROM files""",
    "files",
)
def metadata_rules(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("cust_key")
    first, second = F.when(k % 3 == 0, F.col("exif_lens")).otherwise(""), F.when(k % 3 == 1, "second")
    return fx.files(spark, d).select(
        "cust_key",
        fn.quarter_turns(k % 9).alias("turns"),
        fn.quarter_turns(k % 9, True).alias("turns_cr3"),
        fn.metadata_rating("camera_make", k % 12 - 4).cast("long").alias("meta_rating"),
        fn.lens_name([first, second, F.lit("third"), F.lit("x"), F.lit("y"), F.lit("z")]).alias("lens"),
        fn.aperture_label("aperture").alias("f_label"),
        fn.turn(k % 4, True).cast("long").alias("right_turn"),
        fn.turn(k % 4, False).cast("long").alias("left_turn"),
    )


@query(
    "rationals",
    """SELECT cust_key, n1, d1 // g1 AS a_den, gcd(cust_key, 84) AS g, CASE WHEN focal_length < 0.01 THEN '0/1' ELSE (h // gcd(h, 100)) || '/' || (100 // gcd(h, 100)) END AS focal,
  CASE WHEN e1 < e2 THEN (n1 // g1) || '/' || (6000 // g1) ELSE (6000 // g2) || '/' || (d2 // g2) END AS shutter,
  '1/' || (cust_key % 500 + 1) AS raw_label, CASE WHEN 1.0 / (cust_key % 500 + 1) > 0.5 THEN printf('%.1f', 1.0 / (cust_key % 500 + 1)) WHEN 1.0 / (cust_key % 500 + 1) < 0.1 THEN '1/' || round((cust_key % 500 + 1)::DOUBLE)::BIGINT ELSE '1/' || (cust_key % 500 + 1) END AS label
  FROM (SELECT *, abs((6000 // g1) / (t * nullif(n1 // g1, 0)) - 1) AS e1a, coalesce(abs((6000 // g1)::DOUBLE / nullif(t * (n1 // g1), 0) - 1), 1e300) AS e1, abs((d2 // g2)::DOUBLE / (t * (6000 // g2)) - 1) AS e2 FROM (
   SELECT *, CASE WHEN n1 = 0 THEN 6000 ELSE gcd(n1, 6000) END AS g1, gcd(d2, 6000) AS g2, 6000 AS d1 FROM (
    SELECT *, round(t * 6000)::BIGINT AS n1, round(6000 / t)::BIGINT AS d2, round(focal_length * 100)::BIGINT AS h FROM (SELECT *, 1.0::DOUBLE / (cust_key % 500 + 1) * (1 + cust_key % 13) AS t FROM files))))""",
    "files",
)
def rationals(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("cust_key")
    t = F.lit(1.0) / (k % 500 + 1) * (1 + k % 13)
    n1 = F.round(t * 6000).cast("long")
    return fx.files(spark, d).select(
        "cust_key",
        n1.alias("n1"),
        (F.lit(6000) / fn.gcd_with(n1, 6000)).cast("long").alias("a_den"),
        fn.gcd("cust_key", F.lit(84)).alias("g"),
        fn.rational100("focal_length").alias("focal"),
        fn.shutter_fraction(t).alias("shutter"),
        F.col("exposure_time").alias("raw_label"),
        fn.shutter_label("exposure_time").alias("label"),
    )


SUFFIX_SQL = f"""SELECT seq, string_agg(substr('{fn.SUFFIX_DIGITS}', (v % 62 + 1)::INTEGER, 1), '' ORDER BY i) AS suffix FROM chain GROUP BY seq"""
#: The name of a copied file: stem, underscore, suffix, and the last four characters.
NAME_SQL = "SELECT seq, suffix, left(path, length(path) - 4) || '_' || suffix || right(path, 4) AS name FROM suffixes JOIN manifest USING (seq)"


@query(
    "hash_suffix",
    f"""{fx.sql("", "manifest").replace("WITH", "WITH RECURSIVE", 1)}, ids AS (SELECT DISTINCT seq, md5(content) AS h FROM manifest), chain AS (
  SELECT seq, h, 0 AS i, ('0x' || substr(h, 1, 2))::INTEGER AS v FROM ids
  UNION ALL SELECT seq, h, i + 1, ('0x' || substr(h, 2 * i + 3, 2))::INTEGER + v // 62 FROM chain WHERE i < 6), suffixes AS ({SUFFIX_SQL}) {NAME_SQL}""",
)
def hash_suffix(spark: SparkSession, d: str) -> DataFrame:
    return sources.with_file_id(fx.manifest(spark, d)).select("seq", fn.hash_suffix("file_id").alias("suffix"), fn.suffixed_name("path", "file_id").alias("name"))


@query("output_names", "SELECT seq, regexp_replace(path, '\\.[^.]*$', '') || CASE WHEN seq % 3 = 0 THEN '-HDR' ELSE '' END || '-output' AS name FROM manifest", "manifest")
def output_names(spark: SparkSession, d: str) -> DataFrame:
    names = F.when(F.col("seq") % 3 == 0, F.array("path", "path")).otherwise(F.array("path"))
    return fx.manifest(spark, d).select("seq", fn.output_name(names).alias("name"))


RAW = "regexp_matches(path, '\\.(CR2|cr2|NEF|nef|DNG|dng|RW2|rw2|IIQ|iiq|ARW|arw|RAF|raf|ORF|orf|PEF|pef|SRW|srw|CR3|cr3)$')"


@query("filter_raws", f"SELECT seq, path FROM manifest WHERE {RAW}", "manifest")
def filter_raws(spark: SparkSession, d: str) -> DataFrame:
    m = fx.manifest(spark, d)
    return sources.filter_raws(m.withColumn("path", F.concat(F.lit("file://"), "path"))).select("seq", "path")


@query(
    "expand_requests",
    f"SELECT r AS request_id, path FROM (SELECT *, bool_and({RAW}) OVER (PARTITION BY r) AS good FROM (SELECT *, seq // 60 * 60 + CASE WHEN seq % 60 < 48 THEN seq % 6 ELSE 0 END AS r FROM manifest)) WHERE good",
    "manifest",
)
def expand_requests(spark: SparkSession, d: str) -> DataFrame:
    """All rows: of the six requests to sixty rows one is mixed, three hold raw files only, and two none."""
    m = fx.manifest(spark, d).withColumn("request_id", F.expr("seq - seq % 60 + if(seq % 60 < 48, seq % 6, 0)"))
    requests = m.groupBy("request_id").agg(F.array_join(F.collect_list("path"), ",").alias("names"))
    return sources.expand_requests(requests)


@query(
    "card_dirs",
    """SELECT dir, bool_or(contains(deepest, 'DCIM')) AND length(dir) >= 4 AS on_card FROM (SELECT regexp_replace(path, '/[^/]*$', '') AS deepest, unnest(range(1, len(string_split(regexp_replace(path, '/[^/]*$', ''), '/')) + 1)) AS k,
  array_to_string(list_slice(string_split(regexp_replace(path, '/[^/]*$', ''), '/'), 1, k), '/') AS dir FROM manifest) WHERE dir <> '' GROUP BY dir""",
    "manifest",
)
def card_dirs(spark: SparkSession, d: str) -> DataFrame:
    return sources.card_dirs(fx.manifest(spark, d))


@query("file_ids", "SELECT seq, md5(content) AS file_id FROM manifest", "manifest")
def file_ids(spark: SparkSession, d: str) -> DataFrame:
    return sources.with_file_id(fx.manifest(spark, d)).select("seq", "file_id")


@query("verify_copies", "SELECT path, CASE WHEN seq % 7 = 0 OR seq % 11 = 0 THEN false ELSE true END AS verified FROM manifest", "manifest")
def verify_copies(spark: SparkSession, d: str) -> DataFrame:
    m = fx.manifest(spark, d)
    copies = m.where("seq % 7 <> 0").withColumn("content", F.when(F.col("seq") % 11 == 0, F.concat("content", F.lit("~"))).otherwise(F.col("content")))
    return sources.verify_copies(m, copies)


CLASSIFIED = """known AS (SELECT md5(content) AS file_id, min_by(path, seq) AS held FROM manifest WHERE seq % 10 < 3 GROUP BY 1),
ranked AS (SELECT seq, path, md5(content) AS file_id, row_number() OVER (PARTITION BY md5(content) ORDER BY seq) AS k FROM manifest)"""


@query(
    "classify_import",
    f"""{fx.sql("", "manifest")}, {CLASSIFIED} SELECT seq, r.file_id, CASE WHEN k > 1 THEN 'known' WHEN held IS NULL THEN 'new' WHEN held = path THEN 'known' ELSE 'relocate' END AS action FROM ranked r LEFT JOIN known USING (file_id)""",
)
def classify_import(spark: SparkSession, d: str) -> DataFrame:
    m = sources.with_file_id(fx.manifest(spark, d))
    known = m.where("seq % 10 < 3").groupBy("file_id").agg(F.min_by("path", "seq").alias("file_path"))
    return sources.classify_import(m, known).select("seq", "file_id", "action")


@query("dedupe_batch", "SELECT seq, row_number() OVER (PARTITION BY md5(content) ORDER BY seq) = 1 AS first FROM manifest", "manifest")
def dedupe_batch(spark: SparkSession, d: str) -> DataFrame:
    return sources.dedupe_batch(sources.with_file_id(fx.manifest(spark, d))).select("seq", "first")


@query(
    "upsert_files",
    "SELECT coalesce(f.file_id, n.file_id) AS file_id, coalesce(n.path, f.file_path) AS file_path, coalesce(usage_count, 0) AS usage_count FROM files f FULL JOIN (SELECT file_id, '/new/' || file_id AS path FROM files WHERE cust_key % 5 = 0 UNION ALL SELECT md5(content), max('/new/' || md5(content)) FROM manifest GROUP BY 1) n ON f.file_id = n.file_id",
    "files",
    "manifest",
)
def upsert_files(spark: SparkSession, d: str) -> DataFrame:
    f = fx.files(spark, d)
    ids = f.where("cust_key % 5 = 0").select("file_id").union(sources.with_file_id(fx.manifest(spark, d)).select("file_id").distinct())
    return sources.upsert_files(f, ids.select("file_id", F.concat(F.lit("/new/"), "file_id").alias("file_path"))).select("file_id", "file_path", "usage_count")


@query(
    "assign_instances",
    "SELECT event_id, p.file_id, coalesce(usage_count, 0) + row_number() OVER (PARTITION BY p.file_id ORDER BY event_id) AS number, p.file_id || printf('%04d', coalesce(usage_count, 0) + row_number() OVER (PARTITION BY p.file_id ORDER BY event_id)) AS photo_id FROM photos p LEFT JOIN files USING (file_id)",
    "photos",
    "files",
)
def assign_instances(spark: SparkSession, d: str) -> DataFrame:
    new = fx.photos(spark, d).select("event_id", "file_id")
    return workqueue.assign_instances(new, fx.files(spark, d), "event_id").select("event_id", "file_id", "number", "photo_id")


@query("add_photos", f"SELECT photo_id, import_time, rating, thumb_written FROM photos UNION ALL SELECT file_id || '9999', {NOW}, 0, 0 FROM files WHERE usage_count > 0", "photos", "files")
def add_photos(spark: SparkSession, d: str) -> DataFrame:
    new = fx.files(spark, d).where("usage_count > 0").select(fn.photo_id_of("file_id", F.lit(9999)).alias("photo_id"), "file_id", F.col("file_path").alias("filename"), F.lit(1).cast("long").alias("capture_time"), F.lit(0).alias("rating"))
    return sources.add_photos(fx.catalog_photos(spark, d), new, NOW, NOW).select("photo_id", "import_time", "rating", "thumb_written")


@query("count_uses", "SELECT file_id, usage_count + coalesce(n, 0) AS usage_count FROM files LEFT JOIN (SELECT file_id, count(*) AS n FROM photos WHERE rating > 0 GROUP BY 1) USING (file_id)", "photos", "files")
def count_uses(spark: SparkSession, d: str) -> DataFrame:
    new = fx.catalog_photos(spark, d).where("rating > 0").select("photo_id", "file_id")
    return sources.count_uses(fx.files(spark, d), new).select("file_id", "usage_count")


# the queue


@query("queue_view", f"SELECT {QUEUE}, rating FROM queue JOIN photos USING (photo_id)", "queue")
def queue_view(spark: SparkSession, d: str) -> DataFrame:
    return workqueue.queue_view(fx.queue(spark, d), fx.catalog_photos(spark, d))


@query("queue_survivors", "SELECT photo_id, rating >= 0 AS stays FROM queue JOIN photos USING (photo_id)", "queue")
def queue_survivors(spark: SparkSession, d: str) -> DataFrame:
    stay, gone = workqueue.split_queue(fx.queue(spark, d), fx.catalog_photos(spark, d))
    return stay.select("photo_id", F.lit(True).alias("stays")).union(gone.select("photo_id", F.lit(False)))


@query(
    "enqueue",
    f"SELECT {QUEUE} FROM queue UNION ALL SELECT (SELECT count(*) FROM queue) + k - 1, (SELECT count(*) FROM queue) + k - 1, edited, false, false, photo_id FROM (SELECT photo_id, import_time < last_processed_time - 1 AS edited, row_number() OVER (ORDER BY event_id) AS k FROM photos WHERE event_id % 3 = 0 AND event_type <> 'purchase')",
    "queue",
)
def enqueue(spark: SparkSession, d: str) -> DataFrame:
    p = fx.photos(spark, d)
    ids = p.where("event_id % 3 = 0").select("photo_id", "event_id")
    return workqueue.enqueue(fx.queue(spark, d), p, ids.union(ids), "event_id")


@query(
    "dequeue",
    "SELECT row_number() OVER (ORDER BY qt_index) - 1 AS qt_index, row_number() OVER (ORDER BY sorted_index) - 1 AS sorted_index, processed, exported, output, photo_id FROM queue WHERE qt_index % 4 <> 1",
    "queue",
)
def dequeue(spark: SparkSession, d: str) -> DataFrame:
    q = fx.queue(spark, d)
    gone = q.where("qt_index % 4 = 1").select("photo_id")
    return workqueue.dequeue(q, gone.union(gone.select(F.lit("not queued"))))


@query(
    "queue_move",
    f"SELECT qt_index, CASE WHEN sorted_index = a THEN 3 WHEN a < sorted_index AND sorted_index <= 3 THEN sorted_index - 1 WHEN 3 <= sorted_index AND sorted_index < a THEN sorted_index + 1 ELSE sorted_index END AS sorted_index, processed, exported, output, photo_id FROM queue, (SELECT sorted_index AS a FROM queue WHERE photo_id = (SELECT min(photo_id) FROM queue))",
    "queue",
)
def queue_move(spark: SparkSession, d: str) -> DataFrame:
    q = fx.queue(spark, d)
    return workqueue.move(q, q.agg(F.min("photo_id")).first()[0], 3)


@query("queue_reset_order", "SELECT sorted_index AS qt_index, sorted_index, photo_id FROM queue", "queue")
def queue_reset_order(spark: SparkSession, d: str) -> DataFrame:
    return workqueue.reset_order(fx.queue(spark, d)).select("qt_index", "sorted_index", "photo_id")


@query("queue_neighbours", "SELECT photo_id, coalesce(lag(photo_id) OVER (ORDER BY sorted_index), '') AS prev, coalesce(lead(photo_id) OVER (ORDER BY sorted_index), '') AS next FROM queue", "queue")
def queue_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return workqueue.queue_neighbours(fx.queue(spark, d))


@query("queue_position", "SELECT photo_id, round(sorted_index::DOUBLE / ((SELECT count(*) FROM queue) - 1), 9) AS position FROM queue", "queue")
def queue_position(spark: SparkSession, d: str) -> DataFrame:
    return workqueue.queue_position(fx.queue(spark, d)).select("photo_id", F.round("position", 9).alias("position"))


@query("queue_exported", "SELECT photo_id, qt_index % 5 = 0 AS exported FROM queue", "queue")
def queue_exported(spark: SparkSession, d: str) -> DataFrame:
    q = fx.queue(spark, d)
    return workqueue.mark_exported(q, q.where("qt_index % 5 = 0").select("photo_id")).select("photo_id", "exported")


@query("queue_cleared", f"SELECT {QUEUE} FROM queue WHERE false", "queue")
def queue_cleared(spark: SparkSession, d: str) -> DataFrame:
    return workqueue.clear(fx.queue(spark, d))


@query("usage_counts", "SELECT f.file_id, count(import_time) AS uses FROM files f LEFT JOIN photos p ON f.file_id = p.file_id GROUP BY 1", "photos", "files")
def usage_counts(spark: SparkSession, d: str) -> DataFrame:
    return workqueue.usage_counts(fx.files(spark, d), fx.catalog_photos(spark, d))


@query("reconcile_usage", "SELECT f.file_id, count(import_time) AS usage_count FROM files f LEFT JOIN photos p ON f.file_id = p.file_id GROUP BY 1", "photos", "files")
def reconcile_usage(spark: SparkSession, d: str) -> DataFrame:
    return workqueue.reconcile_usage(fx.files(spark, d), fx.catalog_photos(spark, d)).select("file_id", "usage_count")


GONE = "gone AS (SELECT photo_id FROM queue JOIN photos USING (photo_id) WHERE rating < 0)"


def _forgotten(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    return workqueue.forget(fx.catalog_photos(spark, d), fx.params(spark, d), fx.queue(spark, d), fx.files(spark, d))


@query("forget_photos", f"{fx.sql('', 'queue')}, {GONE} SELECT photo_id, rating FROM photos WHERE photo_id NOT IN (SELECT photo_id FROM gone)")
def forget_photos(spark: SparkSession, d: str) -> DataFrame:
    return _forgotten(spark, d)[0].select("photo_id", "rating")


@query("forget_params", f"{fx.sql('', 'queue', 'params')}, {GONE} SELECT photo_id, exposure_comp FROM params WHERE photo_id NOT IN (SELECT photo_id FROM gone)")
def forget_params(spark: SparkSession, d: str) -> DataFrame:
    return _forgotten(spark, d)[1].select("photo_id", "exposure_comp")


@query("forget_queue", f"{fx.sql('', 'queue')}, {GONE} SELECT row_number() OVER (ORDER BY sorted_index) - 1 AS qt_index, row_number() OVER (ORDER BY sorted_index) - 1 AS sorted_index, photo_id FROM queue WHERE photo_id NOT IN (SELECT photo_id FROM gone)")
def forget_queue(spark: SparkSession, d: str) -> DataFrame:
    return _forgotten(spark, d)[2].select("qt_index", "sorted_index", "photo_id")


@query("forget_files", f"{fx.sql('', 'queue', 'files')}, {GONE} SELECT f.file_id, count(import_time) AS usage_count FROM files f JOIN photos p ON f.file_id = p.file_id WHERE photo_id NOT IN (SELECT photo_id FROM gone) GROUP BY 1")
def forget_files(spark: SparkSession, d: str) -> DataFrame:
    return _forgotten(spark, d)[3].select("file_id", "usage_count")


# parameters and cameras


@query(
    "effective_params",
    "SELECT p.photo_id, coalesce(exposure_comp, 0.0) AS exposure_comp, coalesce(temperature, 5200.0) AS temperature, coalesce(lens_ca, -1) AS lens_ca, 0.002::DOUBLE AS whitepoint, q.photo_id IS NOT NULL AS stored FROM photos p LEFT JOIN params q ON p.photo_id = q.photo_id",
    "photos",
    "params",
)
def effective_params(spark: SparkSession, d: str) -> DataFrame:
    e = params.effective_params(fx.catalog_photos(spark, d), fx.params(spark, d), schema.profile(spark))
    return e.select("photo_id", "exposure_comp", "temperature", "lens_ca", "whitepoint", "stored")


@query(
    "resolve_lens",
    """SELECT p.photo_id, CASE WHEN stored THEN p.lens ELSE coalesce(l.lens, 'NoLens') END AS resolved_lens, (CASE WHEN stored THEN 0 ELSE coalesce(switch, 0) END)::INTEGER AS lens_ca,
  (CASE WHEN stored THEN 0 ELSE coalesce(switch, 0) END)::INTEGER AS lens_vign, (CASE WHEN stored THEN 0 ELSE coalesce(switch, 0) END)::INTEGER AS lens_dist, (CASE WHEN auto_ca > -1 THEN auto_ca ELSE coalesce(switch, 0) END)::INTEGER AS auto_ca
  FROM (SELECT *, lens_ca > -1 AS stored, left(photo_id, 32) AS file_id FROM params) p LEFT JOIN files f ON p.file_id = f.file_id LEFT JOIN lens_prefs l ON f.camera_model = l.exif_camera AND f.exif_lens = l.exif_lens""",
    "params",
    "files",
    "lens_prefs",
)
def resolve_lens(spark: SparkSession, d: str) -> DataFrame:
    return params.resolve_lens(fx.params(spark, d), fx.catalog_photos(spark, d), fx.files(spark, d), fx.lens_prefs(spark, d))


@query("upsert_params", "SELECT photo_id, CASE WHEN right(photo_id, 1) = '3' THEN 1.25 ELSE exposure_comp END AS exposure_comp FROM params", "params")
def upsert_params(spark: SparkSession, d: str) -> DataFrame:
    p = fx.params(spark, d)
    return params.upsert_params(p, p.where("right(photo_id, 1) = '3'").withColumn("exposure_comp", F.lit(1.25))).select("photo_id", "exposure_comp")


@query("mark_edited_photos", f"SELECT photo_id, CASE WHEN rating = 5 THEN {NOW} ELSE last_processed_time END AS last_processed_time, (CASE WHEN rating = 5 THEN 0 ELSE 1 END)::INTEGER AS thumb_written FROM photos", "photos")
def mark_edited_photos(spark: SparkSession, d: str) -> DataFrame:
    p = fx.catalog_photos(spark, d)
    return params.mark_edited(p, fx.queue(spark, d), p.where("rating = 5"), NOW)[0].select("photo_id", "last_processed_time", "thumb_written")


@query("mark_edited_queue", "SELECT photo_id, processed OR rating = 5 AS processed, false AS exported FROM queue JOIN photos USING (photo_id)".replace("processed OR", "queue.processed OR"), "queue")
def mark_edited_queue(spark: SparkSession, d: str) -> DataFrame:
    p = fx.catalog_photos(spark, d)
    return params.mark_edited(p, fx.queue(spark, d), p.where("rating = 5"), NOW)[1].select("photo_id", "processed", "exported")


@query("paste_params", "SELECT photo_id, CASE WHEN right(photo_id, 1) IN ('1', '2') THEN (SELECT exposure_comp FROM params ORDER BY photo_id LIMIT 1) ELSE exposure_comp END AS exposure_comp FROM params", "params")
def paste_params(spark: SparkSession, d: str) -> DataFrame:
    p = fx.params(spark, d)
    return params.paste_params(p, p.agg(F.min("photo_id")).first()[0], p.where("right(photo_id, 1) in ('1', '2')")).select("photo_id", "exposure_comp")


@query(
    "apply_camera_wb",
    "SELECT photo_id, coalesce(CASE WHEN f.camera_make = 'Canon' AND camera_model = 'MACHINERY' THEN 4100.0 WHEN f.camera_make = 'Nikon' AND camera_model = 'HOUSEHOLD' THEN 6100.0 END, temperature) AS temperature FROM params p LEFT JOIN files f ON left(p.photo_id, 32) = f.file_id",
    "params",
    "files",
)
def apply_camera_wb(spark: SparkSession, d: str) -> DataFrame:
    wb = spark.createDataFrame([("Canon", "MACHINERY", 4100.0, 1.1), ("Nikon", "HOUSEHOLD", 6100.0, 0.9)], "camera_make string, camera_model string, temperature double, tint double")
    return params.apply_camera_wb(fx.params(spark, d), fx.catalog_photos(spark, d), fx.files(spark, d), wb).select("photo_id", "temperature")


@query("lens_prefs_set", "SELECT exif_camera, exif_lens, CASE WHEN exif_lens = 'LENS_4' THEN 'other' ELSE lens END AS lens FROM lens_prefs", "lens_prefs")
def lens_prefs_set(spark: SparkSession, d: str) -> DataFrame:
    p = fx.lens_prefs(spark, d)
    change = p.where("exif_lens = 'LENS_4'").withColumn("lens", F.lit("other"))
    return params.upsert_params(p, change, ("exif_camera", "exif_lens")).select("exif_camera", "exif_lens", "lens")


@query("lens_prefs_erased", "SELECT exif_camera, exif_lens FROM lens_prefs WHERE exif_camera <> 'MACHINERY'", "lens_prefs")
def lens_prefs_erased(spark: SparkSession, d: str) -> DataFrame:
    p = fx.lens_prefs(spark, d)
    return params.erase(p, p.where("exif_camera = 'MACHINERY'")).select("exif_camera", "exif_lens")


@query(
    "stale_stage",
    "SELECT photo_id, CASE right(photo_id, 1) WHEN '1' THEN 'load' WHEN '2' THEN 'demosaic' WHEN '3' THEN 'filmulation' WHEN '4' THEN 'blackwhite' WHEN '5' THEN 'demosaic' ELSE 'none' END AS stage FROM params",
    "params",
)
def stale_stage(spark: SparkSession, d: str) -> DataFrame:
    old = fx.params(spark, d)
    last = F.right("photo_id", F.lit(1))
    change = lambda c, digits, v: F.when(last.isin(*digits), F.lit(v)).otherwise(F.col(c))
    new = old.withColumns({"rotation_angle": change("rotation_angle", "1", 2.0), "tint": change("tint", "125", 9.0), "crop_height": change("crop_height", "3", 0.5), "saturation": change("saturation", "45", 0.7)})
    return params.stale_stage(old, new)


@query("upgrade_photos", "SELECT photo_id, import_time AS import_start_time, least(5, greatest(0, rating)) AS rating, 1 AS thumb_written FROM photos", "photos")
def upgrade_photos(spark: SparkSession, d: str) -> DataFrame:
    old = fx.catalog_photos(spark, d).drop("import_start_time", "thumb_written")
    return params.upgrade(old, "photos", 3).select("photo_id", "import_start_time", "rating", "thumb_written")


@query(
    "queue_moved_keyed",
    """SELECT photo_id, row_number() OVER (ORDER BY i) - 1 AS sorted_index FROM (SELECT photo_id, qt_index, CASE WHEN sorted_index = 5 THEN n // 2 WHEN sorted_index > 5 AND sorted_index <= n // 2 THEN sorted_index - 1 ELSE sorted_index END AS i
  FROM queue, (SELECT count(*) AS n FROM queue)) WHERE qt_index % 11 <> 0""",
    "queue",
)
def queue_moved_keyed(spark: SparkSession, d: str) -> DataFrame:
    """The queue in zones of ordered keys: one photo moves to the middle, one in eleven goes; the dense places after that."""
    at = f"{shared_folder(spark)}/queue-{uuid.uuid4().hex}"
    q = fx.queue(spark, d)
    orderkeys.create(q, at, zone_rows=500)
    photo, n = q.where("sorted_index = 5").first().photo_id, q.count()
    orderkeys.move(spark, at, photo, n // 2, zone_rows=500)
    orderkeys.remove(spark, at, q.where("qt_index % 11 = 0"))
    return orderkeys.ranked(spark, at).select("photo_id", "sorted_index")


@query("upgrade_queue", "SELECT photo_id, qt_index AS sorted_index FROM queue", "queue")
def upgrade_queue(spark: SparkSession, d: str) -> DataFrame:
    return params.upgrade(fx.queue(spark, d).drop("sorted_index"), "queue", 5).select("photo_id", "sorted_index")


#: A small file of camera constants, as it may lie beside a catalog.
CONSTANTS = """// levels
{"camera_constants": [
 /* a scalar level */ {"make_model": "Canon MACHINERY", "ranges": {"white": 15000}},
 {"make_model": ["Canon HOUSEHOLD", "Nikon HOUSEHOLD"], "ranges": {"white": [{"iso": 100, "levels": [16000, 15800]}, {"iso": [200, 300], "levels": 15500}]}},
 {"make_model": "Nikon HOUSEHOLD", "ranges": {"white": [{"iso": 202, "levels": 3900}]}}
]}"""


def _constants(spark: SparkSession) -> DataFrame:
    return camera_constants.parse_constants(spark.createDataFrame([(CONSTANTS,)], "value string"))


WHITE = """white AS (SELECT file_id, camera_make, file_path, CASE WHEN camera_make = 'Canon' AND camera_model = 'MACHINERY' THEN 15000.0::DOUBLE WHEN camera_make = 'Nikon' AND camera_model = 'HOUSEHOLD' AND sensitivity = 200 THEN 3900.0
  WHEN camera_model = 'HOUSEHOLD' AND sensitivity = 100 THEN 15800.0 WHEN camera_model = 'HOUSEHOLD' AND sensitivity IN (200, 300) THEN 15500.0 END AS white, cust_key FROM files)"""


@query("white_level", f"{fx.sql('', 'files')}, {WHITE} SELECT file_id, white FROM white")
def white_level(spark: SparkSession, d: str) -> DataFrame:
    return params.white_level(fx.files(spark, d), _constants(spark))


@query(
    "max_value",
    f"""{fx.sql('', 'files')}, {WHITE} SELECT file_id, round(CASE WHEN white IS NULL THEN own_max WHEN camera_make = 'Nikon' AND own_max < 4096 AND white >= 4096 THEN white * 4095.0 / 16383.0 ELSE white END - 128, 6) AS max_value
  FROM (SELECT *, CASE WHEN cust_key % 2 = 0 THEN 4000.0::DOUBLE ELSE 15900.0::DOUBLE END AS own_max FROM white)""",
)
def max_value(spark: SparkSession, d: str) -> DataFrame:
    f = fx.files(spark, d)
    own = f.select("file_id", "camera_make", F.col("file_path").alias("path"), F.when(F.col("cust_key") % 2 == 0, 4000.0).otherwise(15900.0).alias("own_max"), F.lit(128.0).alias("black"))
    return params.max_value(own.join(params.white_level(f, _constants(spark)), "file_id")).select("file_id", F.round("max_value", 6).alias("max_value"))


@query(
    "aperture_scale",
    "SELECT file_id, CASE WHEN NOT (camera_make = 'Canon' AND camera_model = 'MACHINERY') THEN NULL WHEN aperture < 1.8 THEN 1.1::DOUBLE WHEN aperture < 2.8 THEN 1.05::DOUBLE WHEN aperture < 5.6 THEN 1.01::DOUBLE END AS scale FROM files",
    "files",
)
def aperture_scale(spark: SparkSession, d: str) -> DataFrame:
    steps = spark.createDataFrame([("Canon MACHINERY", 0, 1.8, 1.1), ("Canon MACHINERY", 1, 2.8, 1.05), ("Canon MACHINERY", 2, 5.6, 1.01)], "make_model string, pos int, aperture double, scale double")
    return params.aperture_scale(fx.files(spark, d), steps)


@query("decode_lens_code", "SELECT cust_key, CASE WHEN c <= 10 THEN 8.0::DOUBLE WHEN c <= 40 THEN 20.0 WHEN c <= 80 THEN 55.0 ELSE 0.0 END AS focal FROM (SELECT cust_key, cust_key % 100 AS c FROM files)", "files")
def decode_lens_code(spark: SparkSession, d: str) -> DataFrame:
    steps = spark.createDataFrame([(10, 8.0), (40, 20.0), (80, 55.0)], "threshold long, value double")
    f = fx.files(spark, d).select("cust_key", (F.col("cust_key") % 100).alias("code"))
    return params.decode_lens_code(f, steps, "code", 0.0).select("cust_key", F.col("value").alias("focal"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    f = fx.files(spark, d).select(F.col("cust_key").alias("photo_id"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    return f.select("photo_id", F.concat(F.lit("M"), (F.col("k") % 2).cast("string")).alias("mount"), F.concat(F.lit("L"), F.col("k").cast("string")).alias("lens"), ((F.col("photo_id") * 7 + F.col("k") * 13) % 60).alias("score"))


SCORED = "scored AS (SELECT cust_key AS photo_id, 'M' || (k % 2) AS mount, 'L' || k AS lens, (cust_key * 7 + k * 13) % 60 AS score FROM files, range(0, 5) t(k))"


@query("lens_candidates", f"{fx.sql('', 'files')}, {SCORED} SELECT * FROM (SELECT photo_id, lens, score, row_number() OVER (PARTITION BY photo_id ORDER BY score DESC, lens)::INTEGER AS rank FROM scored) WHERE rank <= 2")
def lens_candidates(spark: SparkSession, d: str) -> DataFrame:
    return params.lens_candidates(_scored(spark, d), 2).select("photo_id", "lens", "score", "rank")


@query(
    "best_lens",
    f"""{fx.sql('', 'files')}, {SCORED} SELECT photo_id, CASE WHEN photo_id % 2 = 0 THEN '\\' ELSE '' END || lens AS lens, score FROM (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY score DESC, lens) AS k FROM scored WHERE score > 25 AND (photo_id % 2 = 0 OR mount = 'M1')) WHERE k = 1""",
)
def best_lens(spark: SparkSession, d: str) -> DataFrame:
    q = fx.files(spark, d).select(F.col("cust_key").alias("photo_id"), F.lit("M1").alias("mount"), F.when(F.col("cust_key") % 2 == 0, "\\some lens").otherwise("some lens").alias("query"))
    return params.best_lens(q, _scored(spark, d))


@query(
    "lens_availability",
    "SELECT file_id, CASE WHEN exif_lens <> 'LENS_3' THEN false WHEN cust_key % 3 = 0 THEN cust_key % 2 = 0 WHEN cust_key % 3 = 1 THEN cust_key % 2 = 0 ELSE false END AS ca, exif_lens = 'LENS_3' AND cust_key % 3 <> 1 AS vign, exif_lens = 'LENS_3' AND cust_key % 3 <> 1 AS dist FROM files",
    "files",
)
def lens_availability(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("cust_key")
    f = fx.files(spark, d).select("file_id", F.col("exif_lens").alias("lens"), F.when(k % 3 == 0, 1.6).when(k % 3 == 1, 1.0).otherwise(0.0).alias("crop"), (k % 2 == 0).alias("color"))
    c = spark.createDataFrame([("LENS_3", 0, 1.0, True, False, False), ("LENS_3", 1, 1.6, True, True, True), ("LENS_3", 2, 2.0, False, True, True)], "lens string, pos int, crop_factor double, has_ca boolean, has_vign boolean, has_dist boolean")
    return params.lens_availability(f, c.where("pos < 2").unionByName(c.where("pos = 2").withColumn("crop_factor", F.lit(9.0)))).select("file_id", "ca", "vign", "dist")


@query(
    "camera_wb_upsert",
    """WITH cams AS (SELECT DISTINCT CASE WHEN c_nationkey % 2 = 0 THEN 'Canon' ELSE 'Nikon' END AS camera_make, c_mktsegment AS camera_model FROM customer)
  SELECT camera_make, camera_model, CASE WHEN camera_make = 'Nikon' THEN 4000.0::DOUBLE ELSE 5000.0::DOUBLE END AS temperature, CASE WHEN camera_make = 'Nikon' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS tint FROM cams""",
)
def camera_wb_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The white balance remembered for each make and model: one maker's are set anew, some of them for the first time."""
    cams = fx.files(spark, d).select("camera_make", "camera_model").distinct()
    wb = lambda rows, t, m: rows.select("camera_make", "camera_model", F.lit(t).alias("temperature"), F.lit(m).alias("tint"))
    known = wb(cams.where("camera_make = 'Canon' OR camera_model < 'F'"), 5000.0, 1.0)
    return params.upsert_params(known, wb(cams.where("camera_make = 'Nikon'"), 4000.0, 1.5), ("camera_make", "camera_model"))


@query(
    "upgrade_params",
    "SELECT photo_id, temperature, 0 AS monochrome, 0.21::DOUBLE AS bw_r, 'NoLens' AS lens, lens_ca, -1 AS lens_vign, 0.0::DOUBLE AS crop_height, 0.0::DOUBLE AS rotation_angle FROM params",
    "params",
)
def upgrade_params(spark: SparkSession, d: str) -> DataFrame:
    """Parameters of an older catalog: columns that it lacks come with the profile's values, null ones are filled, others stay."""
    old = fx.params(spark, d).drop("monochrome", "bw_r", "crop_height", "rotation_angle", "lens").withColumn("lens_vign", F.lit(None).cast("int"))
    return params.upgrade(old, "params", 5).select("photo_id", "temperature", "monochrome", "bw_r", "lens", "lens_ca", "lens_vign", "crop_height", "rotation_angle")


@query(
    "effective_estimates",
    "SELECT a.photo_id, coalesce(p.temperature, 3000.0 + event_id % 7) AS temperature, coalesce(p.tint, 1.0) AS tint, p.photo_id IS NOT NULL AS stored FROM photos a LEFT JOIN params p ON a.photo_id = p.photo_id",
    "photos",
    "params",
)
def effective_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Estimated temperatures go before the profile where nothing is stored, and no profile is there at all."""
    p = fx.photos(spark, d)
    guess = p.select("photo_id", (3000.0 + F.col("event_id") % 7).alias("temperature"))
    e = params.effective_params(p, fx.params(spark, d), schema.profile(spark).where("profile_id <> 'Default'"), guess)
    return e.select("photo_id", "temperature", "tint", "stored")
