"""Hand-computed cases of the catalog's rules."""

import datetime

from pyspark.sql import functions as F

from photolake import schema
from photolake.functions import catalog as fn
from photolake.operators import days, numbering, organize, params, workqueue
from photolake.sources import camera_constants, files
from photolake.streaming import live


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_ratings(spark):
    rows = [(r, d) for r in range(-6, 6) for d in (-3, -1, 1, 3)]
    got = spark.createDataFrame(rows, "r int, d int").select("r", "d", fn.bump_rating("r", F.col("d")).alias("b"), fn.toggle_mark(fn.toggle_mark("r")).alias("t")).collect()
    for x in got:
        want = (x.d - 1 if x.d > 0 else x.r) if x.r < 0 else (-1 if x.r + x.d < 0 else x.r + x.d)
        assert x.b == max(-6, min(5, want)) and x.t == x.r


def test_labels_and_fractions(spark):
    assert [value(spark, fn.shutter_label(F.lit(x))) for x in ("1/500", "2/1", "10/300", "3/20", "bulb", "1/0")] == ["1/500", "2.0", "1/30", "3/20", "bulb", "1/0"]
    assert [value(spark, fn.aperture_label(F.lit(x))) for x in (8.0, 2.8, 11.4)] == ["8", "2.8", "11"]
    assert value(spark, fn.rational100(F.lit(2.8))) == "14/5" and value(spark, fn.rational100(F.lit(0.001))) == "0/1"
    assert value(spark, fn.shutter_fraction(F.lit(0.0))) == "0/1" and value(spark, fn.shutter_fraction(F.lit(1 / 125))) == "1/125"
    assert value(spark, fn.gcd(F.lit(832040), F.lit(514229))) == 1 and value(spark, fn.gcd(F.lit(84), F.lit(0))) == 84
    assert value(spark, fn.photo_id_of(F.lit("a" * 32), F.lit(12345))) == "a" * 32 + "12345"
    assert value(spark, fn.suffixed_name(F.lit("IMG_1.CR2"), F.lit("00" * 16))) == "IMG_1_aaaaaaa.CR2"
    assert value(spark, fn.output_name(F.array(F.lit("a.b.CR2"), F.lit("c")))) == "a.b-HDR-output"


def photos_at(spark, *rows):
    return spark.createDataFrame(rows, "capture_time long, rating int")


def test_histogram_counts_marked_photos_only_by_default(spark):
    day = 1_700_000_000 // 86400 * 86400
    p = photos_at(spark, (day, -3), (day + 10, 5), (day + 86400 * 2, 2))
    assert sum(r.thecount for r in days.date_histogram(p).collect()) == 3
    assert sum(r.thecount for r in days.date_histogram(p, 0, 1, 5).collect()) == 2
    dense = days.densify_days(days.date_histogram(p, 0, 1, 5), p, 0, datetime.date(2023, 11, 18)).orderBy("day").collect()
    assert [r.thecount for r in dense] == [1, 0, 1, 0, 0] and dense[0].thedate == "2023/11/14" and dense[0].julday == 2460263


def test_organize_floor(spark):
    p = photos_at(spark, (5, -6), (5, -5), (5, 0), (6, 3))
    assert organize.organize(p, 0, 5, -1, 5).count() == 2


def test_dense_index(spark):
    df = spark.createDataFrame([(i * 7919 % 10007, i) for i in range(3000)] + [(5, -1), (5, -2), (None, 0)], "k long, t long")
    for range_rows in (1_000_000, 100):
        got = numbering.dense_index(df, "k", "n", "t", range_rows=range_rows).orderBy("n").collect()
        assert [r.n for r in got] == list(range(3003))
        assert [(r.k, r.t) for r in got] == sorted([(r.k, r.t) for r in df.collect()], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert numbering.dense_index(df.limit(0), "k", "n").count() == 0


def queue_of(spark, n):
    return spark.createDataFrame([(i, n - 1 - i, False, False, False, f"p{i}") for i in range(n)], schema.QUEUE)


def test_queue(spark):
    q = queue_of(spark, 6)
    moved = {r.photo_id: r.sorted_index for r in workqueue.move(q, "p0", 2).collect()}
    assert moved == {"p0": 2, "p1": 5, "p2": 4, "p3": 3, "p4": 1, "p5": 0}
    assert {r.photo_id: r.sorted_index for r in workqueue.move(q, "nobody", 2).collect()} == {f"p{i}": 5 - i for i in range(6)}
    left = workqueue.dequeue(q, spark.createDataFrame([("p2",), ("nobody",)], "photo_id string")).orderBy("qt_index").collect()
    assert [(r.photo_id, r.qt_index, r.sorted_index) for r in left] == [("p0", 0, 4), ("p1", 1, 3), ("p3", 2, 2), ("p4", 3, 1), ("p5", 4, 0)]
    near = {r.photo_id: (r.prev, r.next) for r in workqueue.queue_neighbours(q).collect()}
    assert near["p0"] == ("p1", "") and near["p5"] == ("", "p4")
    assert workqueue.queue_position(queue_of(spark, 1)).first().position == 0.0


def test_enqueue_twice_changes_nothing(spark):
    p = spark.createDataFrame([(f"p{i}", 10, 12, i) for i in range(9)], "photo_id string, import_time long, last_processed_time long, seq long")
    once = workqueue.enqueue(queue_of(spark, 3), p, p, "seq")
    twice = workqueue.enqueue(once, p, p, "seq")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) and once.count() == 9
    assert [r.qt_index for r in once.orderBy("qt_index").collect()] == list(range(9))


def test_requests_cards_and_extensions(spark, tmp_path):
    asked = spark.createDataFrame([(1, "a.CR2,b.nef"), (2, "a.CR2,b.jpg"), (3, "file:///x.DNG"), (4, "a.Cr2")], "request_id int, names string")
    assert sorted((r.request_id, r.path) for r in files.expand_requests(asked).collect()) == [(1, "a.CR2"), (1, "b.nef"), (3, "/x.DNG")]
    m = spark.createDataFrame([("/c/DCIM/1/a.CR2",), ("/d/dcim/b.CR2",)], "path string")
    assert {r.dir: r.on_card for r in files.card_dirs(m).collect()} == {"/c": False, "/c/DCIM": True, "/c/DCIM/1": True, "/d": False, "/d/dcim": False}
    (tmp_path / "sub").mkdir()
    for name in ("a.CR2", "sub/b.dng", "c.Cr2", "d.jpg"):
        (tmp_path / name).write_bytes(name.encode())
    found = files.with_file_id(files.discover_raws(spark, str(tmp_path))).collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in found) == ["a.CR2", "b.dng"] and all(len(r.file_id) == 32 for r in found)


def test_constants_with_comments(spark, tmp_path):
    (tmp_path / "c.json").write_text('// x\n{"camera_constants": [ /* y */ {"make_model": "A", "ranges": {"white": 9}},\n {"make_model": ["B", "C"], "ranges": {"white": [{"iso": [1, 2], "levels": [5, 4]}]}}]}')
    got = sorted((r.make_model, r.iso, r.entry, r.white) for r in camera_constants.read_camera_constants(spark, str(tmp_path / "c.json")).where("iso is not null").collect())
    assert got == sorted((m, i, 1, w) for m in "BC" for i in (1, 2) for w in (4.0, 5.0))


def test_stored_no_lens_keeps_auto_ca(spark):
    p = spark.createDataFrame([("a" * 32 + "0001", "NoLens", 1, 1, -1, 1), ("a" * 32 + "0002", "NoLens", -1, -1, -1, -1)], "photo_id string, lens string, lens_ca int, lens_vign int, lens_dist int, auto_ca int")
    photos = p.select("photo_id", F.lit("a" * 32).alias("file_id"))
    f = spark.createDataFrame([("a" * 32, "M", "L")], "file_id string, camera_model string, exif_lens string")
    prefs = spark.createDataFrame([("M", "L", "good", 1, 0, 1, 0)], schema.LENS_PREFS)
    got = [tuple(r)[1:] for r in params.resolve_lens(p, photos, f, prefs).orderBy("photo_id").collect()]
    assert got == [("NoLens", 0, 0, 0, 1), ("good", 1, 0, 1, 0)]


def test_stream_import_is_idempotent(spark, tmp_path):
    m = spark.createDataFrame([(i, f"/p{i}", f"text {i % 5}", 100 + i, 2) for i in range(20)], "seq long, path string, content string, capture_time long, rating int")
    for _ in range(2):
        m.repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    at = str(tmp_path / "catalog")
    live.stream_import(stream, at, str(tmp_path / "state"), 7).awaitTermination()
    assert [r.usage_count for r in live.latest_files(spark, at).collect()] == [1] * 5
    photos = live.imported(spark, at, "photos").collect()
    assert len(photos) == 5 and all(p.photo_id == p.file_id + "0001" and p.import_start_time == 7 and p.rating == 2 for p in photos)
    assert sorted(r.qt_index for r in live.imported(spark, at, "queue").collect()) == list(range(5))


def test_import_without_queue_and_at_another_path(spark):
    columns = "seq long, path string, content string, capture_time long, rating int"
    files = live.files_of(spark.createDataFrame([("900150983cd24fb0d6963f7d28e17f72", "/old.CR2", 1, 0)], live.FILE_CHANGES + ", batch long"))
    batch = spark.createDataFrame([(0, "/d/new.CR2", "abc", 5, 0), (1, "/d/x.CR2", "x", 6, 1), (2, "/d/y.CR2", "x", 6, 1)], columns)
    made = live.import_batch(batch, files, spark.createDataFrame([], schema.QUEUE), 9, 8, enqueue=False)
    assert sorted((r.file_path, r.added) for r in made["files"].collect()) == [("/d/new.CR2", 0), ("/d/x.CR2", 1)]
    assert [(r.filename, r.import_time, r.capture_time) for r in made["photos"].collect()] == [("x.CR2", 9, 6)] and made["queue"].count() == 0


def test_forget_leaves_true_counts(spark):
    photos = spark.createDataFrame([("f1_1", "f1", 3, 9), ("f1_2", "f1", -1, 9), ("f2_1", "f2", -2, 9), ("f3_1", "f3", -5, 9)], "photo_id string, file_id string, rating int, import_time long")
    q = spark.createDataFrame([(0, 0, False, False, False, "f1_1"), (1, 1, False, False, False, "f1_2"), (2, 2, False, False, False, "f2_1")], schema.QUEUE)
    f = spark.createDataFrame([("f1", 7), ("f2", 1), ("f3", 0)], "file_id string, usage_count long")
    left, _, queue, kept = workqueue.forget(photos, photos.select("photo_id"), q, f)
    assert {r.photo_id for r in left.collect()} == {"f1_1", "f3_1"}
    assert [(r.photo_id, r.qt_index) for r in queue.collect()] == [("f1_1", 0)]
    assert {r.file_id: r.usage_count for r in kept.collect()} == {"f1": 1, "f3": 1}


def test_estimates_go_before_the_profile(spark):
    photos = spark.createDataFrame([("a",), ("b",), ("c",)], "photo_id string")
    stored = spark.createDataFrame([("a", 1.0, 2)], "photo_id string, temperature double, rotation int")
    guess = spark.createDataFrame([("a", 9.0, 3), ("b", 4000.0, 1)], "photo_id string, temperature double, rotation int")
    got = {r.photo_id: (r.temperature, r.rotation, r.stored) for r in params.effective_params(photos, stored, schema.profile(spark), guess).collect()}
    others = schema.profile(spark).withColumn("profile_id", F.lit("Other")).withColumn("temperature", F.lit(1.0))
    more = params.effective_params(photos, stored, schema.profile(spark).unionByName(others).unionByName(schema.profile(spark)), guess)
    assert {r.photo_id: (r.temperature, r.rotation, r.stored) for r in more.collect()} == got
    assert got == {"a": (1.0, 2, True), "b": (4000.0, 1, False), "c": (5200.0, 0, False)}
