"""Sorted runs, import at length, and the live histogram, with restarts, crashes and late rows."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from photolake.streaming import live, runs

DAY = 86400
IMAGE = "photo_id string, version long, capture_time long, rating int, removed boolean"
MANIFEST = "seq long, path string, content string, capture_time long, rating int"


def test_lookups_open_few_files_however_many_versions(spark, tmp_path):
    table = runs.Table("t", "k", "k string, v long", lambda rows: rows.groupBy("k").agg(F.sum("v").alias("v")))
    at, last, draw, want, opened = str(tmp_path), runs.Commit(), random.Random(2), {}, {}
    for version in range(10):
        keys = [f"{draw.randrange(50):032x}" for _ in range(3)]
        batch = spark.createDataFrame([(k, 1) for k in keys], table.columns).groupBy("k").agg(F.sum("v").alias("v")).coalesce(1)
        ids = batch.select("k")
        found = runs.lookup(spark, last.files, table, ids)
        opened[version] = len(runs.files_for(last.files, table, ids))
        if version in (5, 9):
            assert {r.k: r.v for r in found.collect()} == {k: want[k] for k in set(keys) if k in want}
        last = runs.append(spark, at, last, {"t": batch}, {"t": table}, "w", version, fanout=3)
        for k in keys:
            want[k] = want.get(k, 0) + 1
    assert {r.k: r.v for r in table.merged(runs.read_files(spark, table, last.files)).collect()} == want
    assert max(opened.values()) <= 2 * 3 and opened[9] == 1  # two runs a level at most
    assert runs.last_commit(spark, at) == last and runs.versions(spark, at) == list(range(10))


def test_wide_runs_are_cut_by_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runs, "FILE_ROWS", 50)
    table = runs.Table("t", "k", "k string, v long")
    rows = spark.range(400).select(F.md5(F.col("id").cast("string").cast("binary")).alias("k"), F.col("id").alias("v"))
    last = runs.append(spark, str(tmp_path), runs.Commit(), {"t": rows.where("v < 200")}, {"t": table}, "w", 0, fanout=2)
    last = runs.append(spark, str(tmp_path), last, {"t": rows.where("v >= 200")}, {"t": table}, "w", 1, fanout=2)
    assert len(last.files) >= 6 and all(f.level == 1 for f in last.files)
    ranges = sorted((f.least, f.greatest) for f in last.files)
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    one = rows.where("v = 7").select("k")
    assert len(runs.files_for(last.files, table, one)) <= 2 and runs.lookup(spark, last.files, table, one).first().v == 7


def manifest(spark, *rows):
    return spark.createDataFrame([(s, f"/card/{s}.CR2", c, 100 + s, 0) for s, c in rows], MANIFEST)


def test_import_over_batches_redelivery_and_a_crash(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "c")
    step = live.import_step(spark, at, "w", 7, fanout=2)
    for n in range(3):
        step(manifest(spark, (3 * n, f"a{n}"), (3 * n + 1, f"b{n % 2}"), (3 * n + 2, f"a{n}")), n)
    files = {r.file_id: r for r in live.latest_files(spark, at).collect()}
    assert len(files) == 5 and {r.usage_count for r in files.values()} == {1}
    assert sorted(r.qt_index for r in live.imported(spark, at, "queue").collect()) == list(range(5))
    # the same batch again, by the same writer or by one that starts anew, adds nothing
    step(manifest(spark, (12, "a2"), (13, "b0"), (14, "a2")), 2)
    assert runs.last_commit(spark, at).version == 2
    live.import_step(spark, at, "other", 7, fanout=2)(manifest(spark, (12, "a2"), (13, "b0"), (14, "new")), 0)
    assert live.imported(spark, at, "photos").count() == live.latest_files(spark, at).count() == 6
    # a crash after some tables leaves what it was
    whole = runs.write_run

    def cut(spark, rows, table, *more):
        if table.name == "queue":
            raise RuntimeError("lost")
        return whole(spark, rows, table, *more)

    monkeypatch.setattr(runs, "write_run", cut)
    late = live.import_step(spark, at, "w", 7, fanout=2)
    with pytest.raises(RuntimeError):
        late(manifest(spark, (20, "c")), 3)
    assert live.imported(spark, at, "photos").count() == live.latest_files(spark, at).count() == 6
    monkeypatch.setattr(runs, "write_run", whole)
    late(manifest(spark, (20, "c")), 3)
    assert live.imported(spark, at, "photos").count() == 7
    assert sorted(r.qt_index for r in live.imported(spark, at, "queue").collect()) == list(range(7))


def test_live_histogram_remembers_photos(spark, tmp_path):
    def run(*rows):
        spark.createDataFrame(rows, IMAGE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(IMAGE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        live.stream_live_histogram(stream, str(tmp_path / "days"), str(tmp_path / "state"), 0, 0, 5, fanout=2).awaitTermination()
        first = datetime.date(1970, 1, 1)
        return {(r.day - first).days: r.thecount for r in live.live_histogram(spark, str(tmp_path / "days")).collect()}

    assert run(("a", 1, 5 * DAY, 3, False), ("b", 1, 5 * DAY + 9, 0, False), ("c", 1, 6 * DAY, -2, False), ("d", 1, 9 * DAY, 1, False), (None, 1, 0, 0, False)) == {5: 2, 9: 1}
    # out of order within a batch; late; rated up; removed; without a time; an old image after the removal
    assert run(("a", 3, 7 * DAY, 3, False), ("a", 2, 8 * DAY, 3, False), ("c", 2, 6 * DAY, 1, None), ("b", 2, None, None, True), ("d", 3, None, 1, False)) == {6: 1, 7: 1}
    assert run(("a", 2, 8 * DAY, 3, False), ("b", 1, 5 * DAY, 0, False), ("a", 3, 7 * DAY, 3, False), ("c", 3, 6 * DAY, -1, False)) == {7: 1}


def test_live_histogram_of_many_photos_needs_few_rows_of_state(spark, tmp_path):
    """A row of state and a call of Python cost milliseconds, so photos share them."""
    p = spark.range(20000).selectExpr("concat('p', id) AS photo_id", "1L AS version", f"(id % 9) * {DAY} AS capture_time", "cast(id % 12 - 6 AS int) AS rating", "false AS removed")
    p.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(IMAGE).parquet(str(tmp_path / "in"))
    query = live.stream_live_histogram(stream, str(tmp_path / "days"), str(tmp_path / "state"), 0, 0, 5)
    query.awaitTermination()
    assert 0 < query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 20000 // 4
    want = p.where("rating >= 0").groupBy(F.expr("date_from_unix_date(cast(capture_time / 86400 AS int))").alias("day")).count()
    assert sorted(map(tuple, live.live_histogram(spark, str(tmp_path / "days")).collect())) == sorted(map(tuple, want.collect()))


def test_photos_of_one_group_stay_apart(spark, tmp_path, monkeypatch):
    """Random images, late, twice, of equal versions, without values, in groups of many photos that come in parts."""
    monkeypatch.setattr(live, "GROUPS", 3)
    records = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(records)
    draw, known, first = random.Random(4), {}, datetime.date(1970, 1, 1)
    spark.conf.set(records, 7)
    try:
        for _ in range(4):
            rows = [(f"p{draw.randrange(40)}", draw.randrange(4), draw.choice([None, *range(5)]), draw.choice([None, -1, 0, 5]), draw.choice([None, False, False, True])) for _ in range(60)]
            latest = {}
            for photo, version, day, rating, removed in rows:
                counts = day is not None and rating is not None and rating >= 0 and not removed
                latest[photo] = max(latest.get(photo, (-1, -1)), (version, day if counts else -1))
            known |= {k: v for k, v in latest.items() if k not in known or v[0] > known[k][0]}
            spark.createDataFrame([(k, v, d and d * DAY, r, x) for k, v, d, r, x in rows], IMAGE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(IMAGE).parquet(str(tmp_path / "in"))
            live.stream_live_histogram(stream, str(tmp_path / "days"), str(tmp_path / "state"), 0, 0, 5, fanout=2).awaitTermination()
            days = [d for _, d in known.values() if d >= 0]
            got = {(r.day - first).days: r.thecount for r in live.live_histogram(spark, str(tmp_path / "days")).collect()}
            assert got == {d: days.count(d) for d in days}
    finally:
        spark.conf.set(records, before)
