"""Tiles against twins in NumPy, and the keyed queue against a list."""

import random

import numpy as np
import pytest
from test_grid import array_of, develop_np, image, make, smooth_np

from photolake import schema
from photolake.operators import orderkeys, tiles


@pytest.mark.parametrize("side, radius", [(4, 1), (5, 2), (64, 2)])
def test_smoothing_across_tiles(spark, side, radius):
    a, b, c = image(19, 16), image(1, 9), image(3, 2)
    got = tiles.smooth(make(spark, a, b, c), "r", radius, side)
    for k, x in enumerate((a, b, c)):
        mine = array_of(got, k, ["r"])[:, :, 0]
        assert mine.shape == x.shape[:2] and np.allclose(mine, smooth_reflect(x[:, :, 0], radius))


def smooth_reflect(a, r):
    """Pads of any width, mirrored as often as needed."""
    for axis in (1, 0):
        n = a.shape[axis]
        a = np.take(a, tiles.mirrored(-7 * r, n + 7 * r, n), axis=axis)
        for _ in range(7):
            a = np.apply_along_axis(lambda v: np.convolve(v, np.ones(2 * r + 1) / (2 * r + 1), "valid"), axis, a)
    return a


def test_mirrors_agree():
    a = image(20, 17)[:, :, 0]
    assert np.allclose(smooth_reflect(a, 2), smooth_np(a, 2))


def test_development_on_tiles(spark):
    p = schema.PROFILE | {"film_area": 3.0, "toe_boundary": 500.0, "sigma_const": 0.05}
    a, b = image(16, 18, 3), image(9, 11, 4)
    got = tiles.develop_photos(make(spark, a, b), p, 2, side=7)
    for k, x in enumerate((a, b)):
        assert np.allclose(array_of(got, k), develop_np(x, p, 2), rtol=1e-9)
    still = p | {"sigma_const": 0.0}
    assert np.allclose(array_of(tiles.develop_photos(make(spark, b), still, 3, side=7)), develop_np(b, still, 3), rtol=1e-9)


def test_moves_equal_a_lists(spark, tmp_path):
    order = [f"p{i:02d}" for i in range(12)]
    at, draw = str(tmp_path), random.Random(1)
    queue = spark.createDataFrame([(i, p, False, i % 2 == 0, False) for i, p in enumerate(order)], "sorted_index long, photo_id string, processed boolean, exported boolean, output boolean")
    orderkeys.create(queue, at, zone_rows=4, gap=4)
    assert [z.n for z in orderkeys.zones(spark, at)] == [4, 4, 4]
    moves = [("p00", 5), ("p05", 5), ("p11", 5), ("p02", 5), ("p07", 0), ("p03", 99), ("p09", 5), ("p04", 5), ("nobody", 3)]
    for n, (photo, dest) in enumerate(moves):
        if photo in order:
            order.remove(photo)
            order.insert(dest, photo)
        before = orderkeys.zones(spark, at)
        orderkeys.move(spark, at, photo, dest, zone_rows=4, gap=4)
        after = orderkeys.zones(spark, at)
        assert len(set(before) - set(after)) <= 2  # the zones that it left and entered
        if n in (1, 4, 8):
            got = {r.sorted_index: r.photo_id for r in orderkeys.ranked(spark, at).collect()}
            assert [got[i] for i in range(len(order))] == order and len(got) == len(order)
    orderkeys.remove(spark, at, spark.createDataFrame([("p07",), ("nobody",)], "photo_id string"))
    order.remove("p07")
    got = {r.sorted_index: r.photo_id for r in orderkeys.ranked(spark, at).collect()}
    assert [got[i] for i in range(len(order))] == order
