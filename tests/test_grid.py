"""Pixel operators against twins in NumPy and plain Python, written from the definitions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from photolake import schema
from photolake.functions import pixels as px
from photolake.operators import grid, hist, merge, mosaic, tiles, tone


def make(spark, *photos):
    rows = [(k, y, x, *map(float, p[y, x])) for k, p in enumerate(photos) for y in range(p.shape[0]) for x in range(p.shape[1])]
    return spark.createDataFrame(rows, "photo_id long, y int, x int, r double, g double, b double")


def array_of(df, photo=0, columns="rgb"):
    rows = df.where(f"photo_id = {photo}").collect()
    out = np.full((max(r.y for r in rows) + 1, max(r.x for r in rows) + 1, len(columns)), np.nan)
    for r in rows:
        out[r.y, r.x] = [r[c] for c in columns]
    return out


def image(h, w, seed=0):
    return np.random.default_rng(seed).uniform(0, 65535, (h, w, 3))


def smooth_np(a, r):
    for axis in (1, 0):
        a = np.pad(a, [(7 * r, 7 * r) if k == axis else (0, 0) for k in (0, 1)], mode="reflect")
        for _ in range(7):
            k = np.ones(2 * r + 1) / (2 * r + 1)
            a = np.apply_along_axis(lambda v: np.convolve(v, k, "valid"), axis, a)
    return a


def test_box_radius_uses_whole_division():
    assert grid.box_radius(0.2, 10, 100 / 12) == (lambda w: (w - 1 if w % 2 else w) // 2)(math.floor(math.sqrt(100 / 12 * 4 * 1 + 1)))
    assert grid.box_radius(0.2, 0.5, 1) == 0


def test_smoothing(spark):
    a = image(20, 17)
    got = array_of(tiles.smooth(make(spark, a), "r", 2), columns="r")[:, :, 0]
    assert np.allclose(got, smooth_np(a[:, :, 0], 2))
    flat = make(spark, np.full((9, 9, 3), 7.0), image(1, 3))
    assert {round(r.r, 9) for r in tiles.smooth(flat, "r", 3).where("photo_id = 0").collect()} == {7.0}


def develop_np(a, p, steps):
    h, w, _ = a.shape
    rolloff, toe = p["rolloff_boundary"], p["toe_boundary"]
    bend, room = rolloff - toe, 65535 - rolloff
    x = np.maximum(0, a - toe + toe * toe / (a + toe + 1 / 65535))
    cry = np.where(x > bend, 65535 - room * room / (x + room - bend), x) * p["crystals_per_pixel"] * 0.00015387105
    rad, salt, dev = np.full(a.shape, p["crystal_radius"]), np.full(a.shape, p["salt_density"]), np.full((h, w), p["developer_concentration"])
    pool, volume, ppm, dt = p["developer_concentration"], p["reservoir_thickness"] * p["film_area"] / 864, math.sqrt(h * w / p["film_area"]), p["development_time"] / steps
    period = steps // p["agitate_count"]
    thick = p["layer_thickness"]
    radius = grid.box_radius(p["sigma_const"], ppm, dt)
    for i in range(steps + 1):
        grown = dev[:, :, None] * salt * p["crystal_growth"] * dt
        vol = grown * rad * rad * cry
        rad = rad + grown
        dev = np.maximum(0, dev - 2 * p["developer_consumption"] / (3 * thick) * vol.sum(2))
        salt = salt - 2 * p["salt_consumption"] * vol
        dev = smooth_np(dev, radius) if radius else dev
        m = p["layer_mix_const"] ** (dt / p["layer_time_divisor"])
        new = dev * m + (1 - m) * pool
        pool -= (new - dev).sum() * thick / (ppm**2 * volume)
        dev = new
        if (i + period // 2) % period == 0:
            pool = (dev.sum() * thick / ppm**2 + pool * volume) / (volume + h * w * thick / ppm**2)
            dev = np.full((h, w), pool)
    return rad * rad * cry


def test_development(spark):
    a = image(16, 18, 3)
    p = schema.PROFILE | {"film_area": 3.0, "toe_boundary": 500.0, "sigma_const": 0.05}
    got = array_of(tiles.develop_photos(make(spark, a), p, steps=2))
    assert np.allclose(got, develop_np(a, p, 2), rtol=1e-9)


def test_exchange_and_agitation_keep_all_developer(spark):
    cells = make(spark, image(6, 5)).withColumn("dev", F.col("r") / 65535)
    pools = spark.createDataFrame([(0, 0.7, 50.0, 0.3)], "photo_id long, pool double, volume double, ppm double")
    total = lambda c, p: c.agg(F.sum("dev")).first()[0] * 0.1 / 0.09 + p.first()["pool"] * 50.0
    before = total(cells, pools)
    for made in (grid.pool_exchange(cells, pools, 0.2, 8.0, 20.0, 0.1), grid.pool_equalise(cells, pools, 0.1)):
        assert abs(total(*made) - before) < 1e-9


def test_rotations(spark):
    a = image(4, 7)
    cells = make(spark, a)
    for k in range(4):
        assert np.allclose(array_of(grid.rotate(cells, k)), np.rot90(a, k))
    assert grid.rotate(cells, 4) is cells


def level_np(a, degrees):
    h, w, _ = a.shape
    t, sw, sh = math.radians(degrees), (w - 1) / 2, (h - 1) / 2
    over = 1.0
    for u in (-sw, sw):
        for v in (-sh, sh):
            over = max(over, abs(u * math.cos(t) - v * math.sin(t)) / sw, abs(u * math.sin(t) + v * math.cos(t)) / sh)
    out = np.zeros_like(a)
    for y in range(h):
        for x in range(w):
            rx = ((x - sw) * math.cos(t) - (y - sh) * math.sin(t)) / over + sw
            ry = ((x - sw) * math.sin(t) + (y - sh) * math.cos(t)) / over + sh
            ex, ey = math.modf(rx)[0], math.modf(ry)[0]
            for yy, wy in ((math.floor(ry), 1 - ey), (math.ceil(ry), ey)):
                for xx, wx in ((math.floor(rx), 1 - ex), (math.ceil(rx), ex)):
                    out[y, x] += a[min(max(yy, 0), h - 1), min(max(xx, 0), w - 1)] * wy * wx
    return out


def test_levelling(spark):
    a = image(9, 13, 5)
    for side in (4, 128):
        assert np.allclose(array_of(tiles.level(make(spark, a), 11.0, side)), level_np(a, 11.0))
    assert np.allclose(array_of(tiles.level(make(spark, a), -38.0, 3)), level_np(a, -38.0))
    assert tiles.level(make(spark, a), -50.0).count() == 9 * 13


def shrink_np(a, factor, axis):
    a = np.moveaxis(a, axis, 0)
    n = len(a)
    end = max(1.0, math.floor(n / factor + 0.5))
    whole = max(1, math.floor(n / end))
    s = n / end / whole
    rows = []
    for j in range(int(end * whole)):
        p = (j + 0.5) * s - 0.5
        e = p - math.trunc(p)
        rows.append((1 - e) * a[math.floor(p)] + (e * a[math.ceil(p)] if e else 0))
    rows = np.array(rows).reshape(int(end), whole, *a.shape[1:]).mean(1)
    return np.moveaxis(rows, 0, axis)


@pytest.mark.parametrize("box", [(9, 20), (5, 5), (4, 30)])
def test_downscaling(spark, box):
    a, small = image(23, 19, 6), image(4, 3, 7)
    got = tiles.downscale(make(spark, a, small), *box, side=6)
    factor = max(19 / min(19, box[0]), 23 / min(23, box[1]))
    assert np.allclose(array_of(got), shrink_np(shrink_np(a, factor, 1), factor, 0))
    assert np.allclose(array_of(got, 1), small)


def test_thumbnails(spark):
    a = np.round(image(10, 14, 8))
    linear = np.where(a / 65535 <= 0.04045, a / 65535 / 12.92, ((a / 65535 + 0.055) / 1.055) ** 2.4)
    small = shrink_np(shrink_np(linear, 14 / 6, 1), 14 / 6, 0)
    want = 65535 * np.where(small <= 0.0031308, small * 12.92, 1.055 * small ** (1 / 2.4) - 0.055)
    got = array_of(tiles.thumbnails(make(spark, a), 6))
    assert got.shape == (4, 6, 3) and np.abs(got - np.floor(want)).max() <= 1


def test_dither_is_fixed_and_within_one_step(spark):
    cells = make(spark, np.round(image(30, 30, 1)))
    dither = lambda: cells.select("y", "x", "r", px.to_8bit("r", px.uniform_of("photo_id", "y", "x", F.lit("r"))).alias("v"))
    rows = dither().collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, dither().collect()))
    off = np.array([(r.r + 1) / 256 - 1 - r.v for r in rows if 512 < r.r < 65000])
    assert -1 < off.min() and off.max() < 1 and abs(off.mean()) < 0.1 and off.std() > 0.2
    u = [r[0] for r in cells.select(px.uniform_of("photo_id", "y", "x", F.lit("r"))).collect()]
    assert min(u) >= 0 and max(u) < 1 and abs(np.mean(u) - 0.5) < 0.05


def test_crop_rectangles(spark):
    rows = [(0, 10, 8, 0.5, 1.5, 0.0, 0.0), (1, 10, 8, 0.0, 1.0, 0.3, 0.3), (2, 11, 9, 1.0, 99999.0, 0.4, -0.4), (3, 9, 9, 0.45, 1.0, 1.0, -1.0)]
    sizes = spark.createDataFrame(rows, "photo_id int, width int, height int, crop_height double, crop_aspect double, crop_x double, crop_y double")
    got = {r.photo_id: (r.x0, r.y0, r.x1, r.y1) for r in grid.crop_rect(sizes).collect()}
    assert got[0] == (2, 2, 7, 5) and got[1] == (0, 0, 9, 7)
    assert all(0 <= g[0] and g[2] < r[1] and 0 <= g[1] and g[3] < r[2] for r, g in zip(rows, got.values(), strict=True) if g[3] >= g[1])
    assert got[3][2] == 8 and got[3][1] == 0


def test_histograms_leave_out_last_line_and_count_all_cells(spark):
    cells = make(spark, image(6, 5))
    rects = spark.createDataFrame([(0, 0, 0, 4, 5)], "photo_id long, x0 int, y0 int, x1 int, y1 int")
    assert hist.hist_float(cells, rects, 65535.0).where("channel = 'r'").agg(F.sum("n")).first()[0] == 4 * 5
    assert hist.hist_final(cells).where("channel = 'g'").agg(F.sum("n")).first()[0] == 30
    peaks = hist.hist_peaks(spark.createDataFrame([(0, "r", 0, 50), (0, "r", 127, 90), (0, "r", 5, 7), (0, "g", 0, 3)], "photo_id long, channel string, bin int, n long"))
    assert {r.channel: round(r.peak, 6) for r in peaks.collect()} == {"r": 7.7, "g": 1.1}


def test_merge_weights_are_whole(spark):
    base = make(spark, np.full((1, 3, 3), 1000.0))
    frame = make(spark, np.array([[[2000.0] * 3, [60000.0] * 3, [60001.0] * 3]]))
    ratio = spark.createDataFrame([(0, 0.5)], "photo_id long, ratio double")
    got = array_of(merge.merge_exposures(base, frame, ratio))[0, :, 0]
    assert np.allclose(got, [1000, (1000 + 30000 * 2) / 3, 1000])
    dark = spark.createDataFrame([(0, 1.06)], "photo_id long, ratio double")
    assert np.allclose(array_of(merge.merge_exposures(base, frame, dark)), 1000)


def test_chain_rejects_a_darker_frame_and_keeps_photos_without_one(spark):
    base = make(spark, np.full((1, 2, 3), 1000.0), np.full((1, 2, 3), 500.0))
    bright, dark = make(spark, np.full((1, 2, 3), 4000.0)), make(spark, np.full((1, 2, 3), 3000.0))
    got, state = merge.merge_chain(base, [(bright, 2.0), (dark, 1.5)])
    assert np.allclose(array_of(got), 1000) and np.allclose(array_of(got, 1), 500)
    assert {r.photo_id: (r.weight, r.last) for r in state.collect()} == {0: (5.0, 0.25), 1: (1.0, 1.0)}


@pytest.mark.parametrize("turns", range(4))
def test_rectangles_turn_back(spark, turns):
    a = image(6, 9, 4)
    shown = np.rot90(a, turns)  # counter-clockwise, as grid.rotate turns
    h, w = shown.shape[:2]
    rects = spark.createDataFrame([(0, 1, 2, 4, 3, w, h, turns)], "photo_id long, x0 int, y0 int, x1 int, y1 int, width int, height int, turns int")
    r = hist.turn_back(rects).first()
    assert np.allclose(np.sort(a[r.y0 : r.y1 + 1, r.x0 : r.x1 + 1, 0].ravel()), np.sort(shown[2:4, 1:5, 0].ravel()))


def test_colour_round_trips(spark):
    cells = make(spark, np.round(image(5, 5, 9)))
    whole = cells.withColumns({c: F.col(c).cast("int") for c in "rgb"})
    back = whole.withColumns({f"n{c}": F.round(v) for c, v in zip("rgb", px.from_hsv(px.to_hsv((F.col("r"), F.col("g"), F.col("b")))), strict=True)})
    assert back.where("abs(nr - r) > 1 or abs(ng - g) > 1 or abs(nb - b) > 1").isEmpty()
    black = make(spark, np.zeros((1, 1, 3)))
    assert black.select(*px.to_hsv((F.col("r"), F.col("g"), F.col("b")))).first()[0] == -1
    assert tone.vibrance_saturation(whole, 0.0, 0.0) is whole
    assert cells.select((px.to_srgb(px.to_linear(F.col("r") / 65535)) * 65535 - F.col("r")).alias("d")).where("abs(d) > 1e-6").isEmpty()


def test_white_balance_estimate_is_near_the_best_of_a_finer_grid(spark):
    camera = (((1.6, -0.4, -0.2), (-0.2, 1.4, -0.2), (0.05, -0.45, 1.4)), (2.1, 1.0, 1.6), (1.9, 1.0, 1.4))
    got = merge.estimate_wb(spark.createDataFrame([(1,)], "photo_id long"), *camera).first()
    far = lambda t, m: F.aggregate(F.array(*px.wb_multipliers(t, m, *camera)), F.lit(0.0), lambda a, v: a + (v - 1) * (v - 1))
    mine = spark.range(1).select(far(F.lit(got.temperature), F.lit(got.tint)).alias("d")).first().d
    grid_best = spark.range(2000, 20000, 25).select(F.col("id").cast("double").alias("t")).join(spark.range(300, 1800, 10).select((F.col("id") / 1000).alias("m"))).select(F.min(far(F.col("t"), F.col("m")))).first()[0]
    assert mine <= grid_best * 1.02 + 1e-4


def test_lut_and_mosaic(spark):
    cells = make(spark, np.round(image(4, 4, 2))).withColumns({c: F.col(c).cast("int") for c in "rgb"})
    doubled = merge.apply_lut(cells, merge.lut_from(spark, lambda i: F.least(F.lit(65535), i * 2)), ("r",))
    assert doubled.join(cells.select("y", "x", F.col("r").alias("old")), ["y", "x"]).where("r <> least(65535, old * 2)").isEmpty()
    m = array_of(mosaic.mosaic(cells).withColumn("v", F.col("v").cast("double")), columns="v")[:, :, 0]
    a = array_of(cells)
    assert m[0, 0] == a[0, 0, 1] and m[0, 1] == a[0, 1, 0] and m[1, 0] == a[1, 0, 2] and m[1, 1] == a[1, 1, 1]
