"""Photos stored by day, step tables, camera constants, and the simplex search."""

import numpy as np
from pyspark.sql import functions as F

from photolake import schema
from photolake.functions import pixels as px
from photolake.operators import merge, params, stored
from photolake.sources import camera_constants

DAY = 86400


def photos(spark, *rows):
    df = spark.createDataFrame(rows, "photo_id string, capture_time long, rating int")
    rest = [c for c in schema.PHOTOS.split(", ") if c.split()[0] not in ("photo_id", "capture_time", "rating")]
    return df.select("*", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in rest])


def test_a_day_is_read_and_written_alone(spark, tmp_path):
    at = str(tmp_path)
    stored.write_photos(photos(spark, *[(f"p{i}", (i // 40) * DAY - DAY + i, i % 6) for i in range(200)], ("none", None, 1)), at)
    one = stored.organize_stored(spark, at, DAY, 2 * DAY - 1)
    assert one.count() == 40 and all("/capture_day=1/" in f for f in one.inputFiles())
    assert "PushedFilters" in one._jdf.queryExecution().toString() if hasattr(one, "_jdf") else True
    assert stored.read_photos(spark, at).count() == 201
    before = set(stored.read_photos(spark, at).inputFiles())
    # p0 of day -1 moves to day 2, p45 of day 0 is rated, p199 goes, a new one comes without a time
    changed = photos(spark, ("p0", 2 * DAY + 7, 5), ("p45", 45, -3), ("new", None, 2)).withColumn("old_capture_time", F.expr("CASE photo_id WHEN 'p0' THEN -86400L WHEN 'p45' THEN 45L END"))
    stored.change_photos(spark, at, changed, photos(spark, ("p199", 3 * DAY + 199, 0)))
    now = {r.photo_id: (r.capture_time, r.rating) for r in stored.read_photos(spark, at).collect()}
    assert len(now) == 201 and now["p0"] == (2 * DAY + 7, 5) and now["p45"] == (45, -3) and now["new"] == (None, 2) and "p199" not in now
    kept = before & set(stored.read_photos(spark, at).inputFiles())
    assert kept and all("/capture_day=1/" in f for f in kept)
    assert {(r.day.isoformat(), r.thecount) for r in stored.histogram_stored(spark, at, min_time=DAY, max_time=DAY).collect()} == {("1970-01-02", 40)}
    # a day that loses all its photos has no row, and a list that was never written to its end is not read
    stored.change_photos(spark, at, photos(spark).withColumn("old_capture_time", F.lit(0).cast("long")), stored.read_photos(spark, at, DAY, 2 * DAY - 1))
    assert stored.read_photos(spark, at, DAY, 2 * DAY - 1).count() == 0 and stored.read_photos(spark, at).count() == 161
    stored.write_days(photos(spark, ("x", 1, 1)), at, None)
    (next((tmp_path / "lists" / "list=3").glob("*.parquet"))).unlink()
    assert stored.read_photos(spark, at).count() == 161


def test_first_step_above(spark):
    steps = [(0, 1.8, "a"), (1, 1.4, "never"), (2, 2.8, "b"), (3, None, "null"), (4, 5.6, "c")]
    files = spark.createDataFrame([(str(f), "M", "x", f) for f in (0.5, 0.8, 1.4, 1.8, 2.0, 2.8, 5.5, 5.6, 9.0)] + [("n", "M", "x", None), ("o", "other", "x", 2.0)], "file_id string, camera_make string, camera_model string, aperture double")
    scaling = spark.createDataFrame([("M x", *s) for s in steps], "make_model string, pos int, aperture double, scale string")
    got = {r.file_id: r.scale for r in params.aperture_scale(files, scaling).collect()}
    for f, *_, x in files.collect():
        want = next((v for _, limit, v in steps if limit is not None and x is not None and x > 0.7 and limit > x), None) if f != "o" else None
        assert got[f] == want, f
    plan = params.aperture_scale(files, scaling)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Window" not in plan
    table = spark.createDataFrame([(i * 3, float(i)) for i in range(1000)], "threshold long, value double")
    codes = spark.range(-5, 3010).withColumn("code", F.col("id"))
    found = params.decode_lens_code(codes, table, "code", -1.0)
    assert found.where("value <> CASE WHEN code > 2997 THEN -1 WHEN code <= 0 THEN 0 ELSE ceil(code / 3) END").count() == 0 and found.count() == 3015
    assert params.decode_lens_code(spark.createDataFrame([(None,)], "code long"), table, "code", -1.0).first().value == -1.0


def test_top_lenses_are_limited_before_the_shuffle(spark):
    scored = spark.createDataFrame([(p, f"L{(7 * p + k) % 5}", "M", 30 + k % 3) for p in range(5) for k in range(5)], "photo_id long, lens string, mount string, score long")
    assert "WindowGroupLimit" in params.lens_candidates(scored, 2)._jdf.queryExecution().toString()
    queries = spark.createDataFrame([(p, "M", "\\q" if p % 2 else "q") for p in range(5)], "photo_id long, mount string, query string")
    best = params.best_lens(queries, scored)
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "Window" not in plan
    for r in best.collect():
        top = max(((30 + k % 3), -((7 * r.photo_id + k) % 5)) for k in range(5))
        assert (r.score, r.lens) == (top[0], ("\\" if r.photo_id % 2 else "") + f"L{-top[1]}")


def test_comments_inside_strings_stay(spark):
    text = '{"camera_constants": [ // one\n /* "two" */ {"make_model": "A /* not */ B // C", "note": "a \\" // b", "ranges": {"white": 9}} /* " */ ] } // "end'
    df = spark.createDataFrame([(text,)], "value string")
    got = camera_constants.parse_constants(df).collect()
    assert [(r.make_model, r.white) for r in got] == [("A /* not */ B // C", 9.0)]
    long = '{"camera_constants": [{"make_model": "' + "x\\\\y" * 50000 + '", "ranges": {"white": 1}}]} // z'
    assert camera_constants.parse_constants(spark.createDataFrame([(long,)], "value string")).count() == 1


def test_whole_parts_decide_about_clipping(spark):
    cells = spark.createDataFrame([(1, 0, 0, 100.0, 100.0, 100.0), (1, 0, 1, 100.0, 100.0, 100.0)], "photo_id long, y int, x int, r double, g double, b double")
    frame = spark.createDataFrame([(1, 0, 0, 60000.7, 10.0, 10.0), (1, 0, 1, 60001.0, 10.0, 10.0)], cells.schema)
    ratio = spark.createDataFrame([(1, 1.0)], "photo_id long, ratio double")
    got = {r.x: r.r for r in merge.merge_exposures(cells, frame, ratio).collect()}
    assert got == {0: (100 + 60000.7) / 2, 1: 100.0}


def test_no_default_profile_loses_no_photo(spark):
    p = spark.createDataFrame([("a",), ("b",)], "photo_id string")
    own = spark.createDataFrame([("a", 1.5, 7.0)], "photo_id string, exposure_comp double, crop_x double")
    got = {r.photo_id: (r.exposure_comp, r.crop_x, r.stored) for r in params.effective_params(p, own, schema.profile(spark).limit(0)).collect()}
    assert got == {"a": (1.5, 7.0, True), "b": (schema.PROFILE["exposure_comp"], 0.0, False)}


def test_simplex_finds_each_cameras_best(spark):
    matrices = [[[1.6, -0.4, -0.2], [-0.2, 1.4, -0.2], [0.05, -0.45, 1.4]], [[1.7, -0.5, -0.2], [-0.25, 1.5, -0.25], [0.0, -0.4, 1.4]], [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]]
    muls = [([2.1, 1.0, 1.6], [1.9, 1.0, 1.4]), ([1.8, 1.0, 1.9], [1.9, 1.0, 1.4]), ([1.0, 1.0, 1.0], [1.0, 1.0, 1.0])]
    rows = [(i, m, *c) for i, (m, c) in enumerate(zip(matrices, muls, strict=True))]
    got = {r.photo_id: (r.temperature, r.tint) for r in merge.estimate_wb_by_camera(spark.createDataFrame(rows, "photo_id long, matrix array<array<double>>, cam_mul array<double>, pre_mul array<double>")).collect()}
    assert len(set(got.values())) == 3
    for i, m, cam, pre in rows:
        far = lambda t, tint, m=m, cam=cam, pre=pre: F.aggregate(F.array(*px.wb_multipliers(t, tint, m, cam, pre)), F.lit(0.0), lambda a, v: a + (v - 1) * (v - 1))
        mine = spark.range(1).select(far(F.lit(got[i][0]), F.lit(got[i][1])).alias("d")).first().d
        near = spark.range(0, 60).select((got[i][0] * (0.9 + F.col("id") / 300)).alias("t")).join(spark.range(0, 40).select((got[i][1] * (0.9 + F.col("id") / 200)).alias("m")))
        assert mine <= near.select(F.min(far(F.col("t"), F.col("m")))).first()[0] + 1e-9 and np.sqrt(mine) < 0.2


CAMERA = "photo_id long, matrix array<array<double>>, cam_mul array<double>, pre_mul array<double>"


def spread(temperature, tint, matrix, cam, pre):
    """How far the multipliers of a known camera lie apart, over their least."""
    light = lambda t: np.array(px.XYZ_TO_SRGB) @ (lambda x, y: np.array([x, y, 1 - x - y]))(*chromaticity(1000 / t))

    def chromaticity(k):
        low = k > 0.25
        x = np.polyval((-0.2661239, -0.2343589, 0.8776956, 0.179910) if low else (-3.0258469, 2.1070379, 0.2226347, 0.24039), k)
        return x, np.polyval((-0.95494760, -1.37418593, 2.09137015, -0.16748867) if low else (3.08175800, -5.87338670, 3.75112997, -0.37001483), x)

    cam, pre = np.array(cam) / min(cam), np.array(pre) / min(pre)
    m = np.array([1, tint / px.BASE_TINT, 1]) * light(px.BASE_TEMPERATURE) / light(temperature) * (np.array(matrix) @ (pre / cam))
    return max(m) / min(m) - 1


def test_simplex_meets_no_tint_of_zero_and_reaches_far_tints(spark):
    stretched = [[1.68, -0.44, -0.24], [-0.24, 1.48, -0.24], [0.01, -0.49, 1.48]]
    green = [[1.4, 0.1, -0.5], [-0.5, 1.5, 0.0], [-0.2, 0.8, 0.4]]
    rows = [(1, stretched, [2.5, 1.0, 1.8], [1.9, 1.0, 1.4]), (2, stretched, [2.55, 1.0, 1.9], [1.9, 1.0, 1.4]), (3, green, [1.4, 2.5, 1.1], [1.5, 0.9, 2.1])]
    got = {r.photo_id: (r.temperature, r.tint) for r in merge.estimate_wb_by_camera(spark.createDataFrame(rows, CAMERA)).collect()}
    for i, *camera in rows:
        assert spread(*got[i], *camera) < 1e-4, i
    assert abs(got[3][0] - 8704.9) < 1 and abs(got[3][1] - 155.91) < 0.01


def test_a_camera_without_numbers_stops_no_other_photo(spark):
    m, good = [[1.6, -0.4, -0.2], [-0.2, 1.4, -0.2], [0.05, -0.45, 1.4]], [1.9, 1.0, 1.4]
    nan, inf = float("nan"), float("inf")
    unusable = [(m, [0.0, 0.0, 0.0], good), (m, [2.1, 1.0, 0.0], good), (m, good, [0.0, 1.0, 1.4]), (m, None, good), (m, [2.1, None, 1.6], good), (m, good, [nan, 1.0, 1.4]), (None, good, good), (m, [], good), (m, [inf] * 3, good)]
    rows = [(0, m, [2.1, 1.0, 1.6], good), *[(i, *c) for i, c in enumerate(unusable, 1)]]
    got = {r.photo_id: (r.temperature, r.tint) for r in merge.estimate_wb_by_camera(spark.createDataFrame(rows, CAMERA)).collect()}
    assert len(got) == 10 and spread(*got[0], *rows[0][1:]) < 1e-4
    assert all(abs(got[i][0] - 5200) < 1e-6 and got[i][1] == 1 for i in range(1, 10)), got
