"""Photos as square tiles of cells: smoothing, film development, levelling and scaling down.

A tile is one row with its cells as arrays, so that a step of development is arithmetic on arrays. For smoothing, each tile
sends to others the strips of its cells that their surroundings need (``halo``), mirrored borders included; this is the
only exchange of a step. Box means are differences of running sums. A levelled tile is sent the cells of its turned box.
Scaling down is linear, so each tile adds up its own part of every new cell, and only these parts meet. A photo of any
size is spread over its tiles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pixels import density, expose, to_linear, to_srgb
from .grid import PASSES, box_radius, extents
from .storage import written

#: Cells of a tile's side.
SIDE = 128
#: What the state of a tile holds, one layer after another.
LAYERS = ["r_cry", "g_cry", "b_cry", "r_rad", "g_rad", "b_rad", "r_salt", "g_salt", "b_salt", "dev"]
PLACE = "photo_id long, ty int, tx int, height int, width int"


def tiled(cells: DataFrame, layers: list[str], side: int = SIDE) -> DataFrame:
    """``photo_id, ty, tx, height, width, state``: cells gathered into tiles; ``state`` has the layers' doubles by lines."""
    placed = cells.select("photo_id", F.expr(f"y div {side}").cast("int").alias("ty"), F.expr(f"x div {side}").cast("int").alias("tx"), "y", "x", *[F.col(c).cast("double").alias(c) for c in layers])

    def gather(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        y, x = rows["y"].to_numpy() - key[1] * side, rows["x"].to_numpy() - key[2] * side
        data = np.zeros((len(layers), y.max() + 1, x.max() + 1))
        data[:, y, x] = rows[layers].to_numpy().T
        return pd.DataFrame({"photo_id": [key[0]], "ty": [key[1]], "tx": [key[2]], "state": [data.tobytes()]})

    made = placed.groupBy("photo_id", "ty", "tx").applyInPandas(gather, "photo_id long, ty int, tx int, state binary")
    sizes = extents(cells).select("photo_id", F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"))
    return made.join(sizes, "photo_id").select("photo_id", "ty", "tx", "height", "width", "state")


def untiled(tiles: DataFrame, layers: list[str], wanted: list[str], side: int = SIDE) -> DataFrame:
    """``photo_id, y, x`` and the wanted layers, one row a cell."""

    def spread(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples():
                data, y0, x0 = layers_of(r.state, r.ty, r.tx, r.height, r.width, side)
                y, x = np.mgrid[: data.shape[1], : data.shape[2]].reshape(2, -1)
                yield pd.DataFrame({"photo_id": r.photo_id, "y": y + y0, "x": x + x0} | {c: data[layers.index(c)].ravel() for c in wanted})

    return tiles.mapInPandas(spread, "photo_id long, y int, x int, " + ", ".join(f"{c} double" for c in wanted))


def layers_of(state: bytes, ty: int, tx: int, height: int, width: int, side: int) -> tuple[np.ndarray, int, int]:
    """A tile's layers, and the place of its first cell."""
    y0, x0 = ty * side, tx * side
    return np.frombuffer(state).reshape(-1, min(side, height - y0), min(side, width - x0)), y0, x0


def mirrored(lo: int, hi: int, n: int) -> np.ndarray:
    """The places lo..hi-1 of an axis of n cells, mirrored about its first and last cell."""
    if n == 1:
        return np.zeros(hi - lo, int)
    at = np.arange(lo, hi) % (2 * (n - 1))
    return np.where(at < n, at, 2 * (n - 1) - at)


def needed(tile: int, side: int, n: int, pad: int) -> tuple[int, int]:
    """First and last place on an axis that a tile with ``pad`` cells around it asks for."""
    at = mirrored(tile * side - pad, min(n, (tile + 1) * side) + pad, n)
    return int(at.min()), int(at.max())


def halo(values: np.ndarray, ty: int, tx: int, height: int, width: int, pad: int, side: int) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """``ty, tx`` of every other tile that needs some of this tile's cells, the place of the first one, and the cells."""
    y0, x0, h, w = ty * side, tx * side, *values.shape
    reach = pad // side + 2
    for j in range(max(0, ty - reach), min(-(-height // side), ty + reach + 1)):
        top, low = needed(j, side, height, pad)
        a, b = max(top, y0), min(low, y0 + h - 1)
        for i in range(max(0, tx - reach), min(-(-width // side), tx + reach + 1)) if a <= b else ():
            left, right = needed(i, side, width, pad)
            c, d = max(left, x0), min(right, x0 + w - 1)
            if c <= d and (j, i) != (ty, tx):
                yield j, i, a, c, values[a - y0 : b - y0 + 1, c - x0 : d - x0 + 1]


def box_means(padded: np.ndarray, radius: int) -> np.ndarray:
    """Seven box means along each axis; each takes ``radius`` cells off both ends."""
    for _ in range(2):
        for _ in range(PASSES):
            sums = np.concatenate([np.zeros((1, padded.shape[1])), np.cumsum(padded, axis=0)])
            padded = (sums[2 * radius + 1 :] - sums[: -2 * radius - 1]) / (2 * radius + 1)
        padded = padded.T
    return padded


MESSAGE = PLACE + ", y int, x int, h int, w int, own boolean, radius int, pool double, data binary"


def smoothed_tile(rows: pd.DataFrame, side: int, values: np.ndarray) -> np.ndarray:
    """A tile's values smoothed, from its own and the strips that came for it."""
    r = rows.iloc[0]
    pad = PASSES * int(r["radius"])
    if not pad:
        return values
    y0, x0 = int(r["ty"]) * side, int(r["tx"]) * side
    ys, xs = mirrored(y0 - pad, y0 + values.shape[0] + pad, int(r["height"])), mirrored(x0 - pad, x0 + values.shape[1] + pad, int(r["width"]))
    top, left = ys.min(), xs.min()
    whole = np.full((ys.max() - top + 1, xs.max() - left + 1), np.nan)
    whole[y0 - top : y0 - top + values.shape[0], x0 - left : x0 - left + values.shape[1]] = values
    for s in rows[~rows["own"]].itertuples():
        whole[s.y - top : s.y - top + s.h, s.x - left : s.x - left + s.w] = np.frombuffer(s.data).reshape(s.h, s.w)
    return box_means(whole[np.ix_(ys - top, xs - left)], int(r["radius"]))


def messages(r, values: np.ndarray, state: bytes, radius: int, pool: float, side: int) -> list[tuple]:
    """A tile's own row and the strips for others."""
    place = (r.height, r.width)
    out = [(r.photo_id, r.ty, r.tx, *place, 0, 0, 0, 0, True, radius, pool, state)]
    for j, i, y, x, strip in halo(values, r.ty, r.tx, r.height, r.width, PASSES * radius, side) if radius else ():
        out.append((r.photo_id, j, i, *place, y, x, *strip.shape, False, radius, pool, np.ascontiguousarray(strip).tobytes()))
    return out


def smooth(cells: DataFrame, value: str, radius: int, side: int = SIDE) -> DataFrame:
    """``photo_id, y, x`` and one column smoothed along both axes, borders mirrored."""
    names = [c.split()[0] for c in MESSAGE.split(", ")]

    def send(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples():
                data, _, _ = layers_of(r.state, r.ty, r.tx, r.height, r.width, side)
                yield pd.DataFrame(messages(r, data[0], r.state, radius, 0.0, side), columns=names)

    def take(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        r = rows[rows["own"]].iloc[0]
        data, _, _ = layers_of(r["data"], *key[1:], r["height"], r["width"], side)
        return pd.DataFrame({"photo_id": [key[0]], "ty": [key[1]], "tx": [key[2]], "height": [r["height"]], "width": [r["width"]], "state": [np.ascontiguousarray(smoothed_tile(rows, side, data[0])).tobytes()]})

    sent = tiled(cells, [value], side).mapInPandas(send, MESSAGE)
    return untiled(sent.groupBy("photo_id", "ty", "tx").applyInPandas(take, PLACE + ", state binary"), [value], [value], side)


def develop_photos(cells: DataFrame, p: dict, steps: int | None = None, side: int = SIDE) -> DataFrame:
    """Film development of all photos: ``r, g, b`` become densities.

    ``p`` holds the parameters by the names of the default profile. Steps run from 0 to ``steps`` inclusive. Tiles are
    stored after each step, since each depends on the one before. A photo's pool is one row; its sums come from the
    tiles' own. The radius of smoothing follows each photo's size inside its tiles, so nothing is gathered on the driver.
    """
    steps = p["development_steps"] if steps is None else steps
    dt = p["development_time"] / steps
    period = steps // p["agitate_count"] if p["agitate_count"] > 0 else 3 * steps
    exposed = {f"{c}_cry": expose(c, p["crystals_per_pixel"], p["rolloff_boundary"], p["toe_boundary"]) for c in "rgb"}
    start = {f"{c}_rad": F.lit(p["crystal_radius"]) for c in "rgb"} | {f"{c}_salt": F.lit(p["salt_density"]) for c in "rgb"} | {"dev": F.lit(p["developer_concentration"])}
    now = written(tiled(cells.withColumns(exposed | start), LAYERS, side), "tiles")
    size = (F.col("height").cast("long") * F.col("width")).alias("n")
    pools = now.select("photo_id", size).distinct().select(
        "photo_id", "n", F.lit(p["developer_concentration"]).alias("pool"), F.lit(None).cast("double").alias("even"), F.lit(p["reservoir_thickness"] * p["film_area"] / 864).alias("volume"), F.sqrt(F.col("n") / p["film_area"]).alias("ppm")
    )
    pools = written(pools, "pools")
    m = p["layer_mix_const"] ** (dt / p["layer_time_divisor"])
    thick, names = p["layer_thickness"], [c.split()[0] for c in MESSAGE.split(", ")]
    used = 2.0 * p["developer_consumption"] / (thick * 3.0)

    def react(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples():
                data = layers_of(r.state, r.ty, r.tx, r.height, r.width, side)[0].copy()
                cry, rad, salt, dev = data[:3], data[3:6], data[6:9], data[9]
                if r.even == r.even:
                    dev[:] = r.even
                grown = dev * salt * (p["crystal_growth"] * dt)
                volume = grown * rad * rad * cry
                rad += grown
                salt -= 2.0 * p["salt_consumption"] * volume
                dev[:] = np.maximum(dev - volume.sum(axis=0) * used, 0.0)
                yield pd.DataFrame(messages(r, dev, data.tobytes(), box_radius(p["sigma_const"], r.ppm, dt), r.pool, side), columns=names)

    def mix(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        r = rows[rows["own"]].iloc[0]
        data = layers_of(r["data"], *key[1:], r["height"], r["width"], side)[0].copy()
        dev = smoothed_tile(rows, side, data[9])
        after = dev * m + (1 - m) * r["pool"]
        sums = {"gained": [float((after - dev).sum())], "held": [float(after.sum())]}
        data[9] = after
        return pd.DataFrame({"photo_id": [key[0]], "ty": [key[1]], "tx": [key[2]], "height": [r["height"]], "width": [r["width"]], "state": [data.tobytes()]} | sums)

    for i in range(steps + 1):
        sent = now.join(pools.select("photo_id", "pool", "even", "ppm"), "photo_id").mapInPandas(react, MESSAGE)
        now = written(sent.groupBy("photo_id", "ty", "tx").applyInPandas(mix, PLACE + ", state binary, gained double, held double"), "tiles")
        sums = now.groupBy("photo_id").agg(F.sum("gained").alias("gained"), F.sum("held").alias("held"))
        area = thick / (F.col("ppm") * F.col("ppm"))
        left = F.col("pool") - F.col("gained") * area / F.col("volume")
        even = (F.col("held") * area + left * F.col("volume")) / (F.col("volume") + F.col("n") * area)
        stirred = (i + period // 2) % period == 0
        new = pools.drop("even").join(sums, "photo_id").withColumns({"even": even if stirred else F.lit(None).cast("double"), "left": left})
        pools = written(new.select("photo_id", "n", F.coalesce("even", "left").alias("pool"), "even", "volume", "ppm"), "pools")
        now = now.drop("gained", "held")
    done = untiled(now, LAYERS, LAYERS[:6], side)
    return done.select("photo_id", "y", "x", *[density(f"{c}_rad", f"{c}_cry").alias(c) for c in "rgb"])


def turned(y: np.ndarray, x: np.ndarray, height: int, width: int, angle: float) -> tuple[np.ndarray, np.ndarray]:
    """Where the cells of a levelled photo come from: turned about the centre, shrunk by the largest overshoot of a corner."""
    cos, sin, sw, sh = math.cos(angle), math.sin(angle), (width - 1) / 2, (height - 1) / 2
    over = [1.0]
    for v in (sh, -sh):
        over += [abs(sw * cos - v * sin) / sw] if sw else []
        over += [abs(sw * sin + v * cos) / sh] if sh else []
    u, v = x - sw, y - sh
    return (u * sin + v * cos) / max(over) + sh, (u * cos - v * sin) / max(over) + sw


def source_box(ty: int, tx: int, height: int, width: int, angle: float, side: int) -> tuple[int, int, int, int]:
    """First and last line and column that a levelled tile asks for; the map is affine, so its corners tell."""
    y, x = np.meshgrid([ty * side, min(height, (ty + 1) * side) - 1], [tx * side, min(width, (tx + 1) * side) - 1])
    py, px = turned(y.astype(float), x.astype(float), height, width, angle)
    box = lambda p, n: (int(np.clip(math.floor(p.min()) - 1, 0, n - 1)), int(np.clip(math.ceil(p.max()) + 1, 0, n - 1)))
    return *box(py, height), *box(px, width)


def level(cells: DataFrame, degrees: float, side: int = SIDE) -> DataFrame:
    """Fine rotation about the centre, shrunk by the largest overshoot of a corner; bilinear, kept at the edges."""
    if degrees <= -49:
        return cells
    angle, names = math.radians(degrees), [c.split()[0] for c in MESSAGE.split(", ")]

    def send(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples():
                data, y0, x0 = layers_of(r.state, r.ty, r.tx, r.height, r.width, side)
                last_y, last_x = y0 + data.shape[1] - 1, x0 + data.shape[2] - 1
                # no new tile lies further from this one than the turn carries its cells
                y, x = np.meshgrid([float(y0 - 2), last_y + 2.0], [float(x0 - 2), last_x + 2.0])
                grow = 1 / max(1e-9, turned_scale(r.height, r.width, angle))
                sw, sh = (r.width - 1) / 2, (r.height - 1) / 2
                ny = (-(x - sw) * math.sin(angle) + (y - sh) * math.cos(angle)) * grow + sh
                nx = ((x - sw) * math.cos(angle) + (y - sh) * math.sin(angle)) * grow + sw
                out = []
                edges = lambda p, n: (max(0, int(p.min() // side) - 1), min(-(-n // side), int(p.max() // side) + 2))
                for j in range(*edges(ny, r.height)):
                    for i in range(*edges(nx, r.width)):
                        a, b, c, d = source_box(j, i, r.height, r.width, angle, side)
                        a, b, c, d = max(a, y0), min(b, last_y), max(c, x0), min(d, last_x)
                        if a <= b and c <= d:
                            block = np.ascontiguousarray(data[:, a - y0 : b - y0 + 1, c - x0 : d - x0 + 1])
                            out.append((r.photo_id, j, i, r.height, r.width, a, c, *block.shape[1:], False, 0, 0.0, block.tobytes()))
                yield pd.DataFrame(out, columns=names)

    def take(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        height, width = int(rows["height"].iloc[0]), int(rows["width"].iloc[0])
        a, b, c, d = source_box(key[1], key[2], height, width, angle, side)
        block = np.full((3, b - a + 1, d - c + 1), np.nan)
        for s in rows.itertuples():
            block[:, s.y - a : s.y - a + s.h, s.x - c : s.x - c + s.w] = np.frombuffer(s.data).reshape(3, s.h, s.w)
        y, x = np.mgrid[key[1] * side : min(height, (key[1] + 1) * side), key[2] * side : min(width, (key[2] + 1) * side)].reshape(2, -1)
        py, px = turned(y.astype(float), x.astype(float), height, width, angle)
        out = np.zeros((3, len(y)))
        for yy, wy in taps(py, height):
            for xx, wx in taps(px, width):
                out += block[:, yy - a, xx - c] * (wy * wx)
        return pd.DataFrame({"photo_id": key[0], "y": y, "x": x} | dict(zip("rgb", out, strict=True)))

    sent = tiled(cells, ["r", "g", "b"], side).mapInPandas(send, MESSAGE)
    return sent.groupBy("photo_id", "ty", "tx").applyInPandas(take, "photo_id long, y int, x int, r double, g double, b double")


def turned_scale(height: int, width: int, angle: float) -> float:
    """Distance in the source of two cells that lie side by side in the levelled photo."""
    y, x = turned(np.zeros(2), np.array([0.0, 1.0]), height, width, angle)
    return math.hypot(y[1] - y[0], x[1] - x[0])


def taps(points: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The two neighbours of each point on an axis, kept inside, with their weights."""
    share = points - np.trunc(points)
    return [(np.clip(np.floor(points).astype(int), 0, n - 1), 1 - share), (np.clip(np.ceil(points).astype(int), 0, n - 1), share)]


def shrinking(n: int, factor: float, first: int, count: int) -> tuple[int, np.ndarray]:
    """What the cells first..first+count-1 of an axis of n give to the axis scaled down: its first touched place, and
    the weights, one line a touched place.

    The axis is sampled bilinearly at a whole multiple of its end size; then whole blocks are averaged.
    """
    end = max(1, math.floor(n / factor + 0.5))
    whole = max(1, math.floor(n / end))
    scale = n / end / whole
    j = np.arange(max(0, math.floor((first - 0.5) / scale) - 1), min(end * whole, math.ceil((first + count + 0.5) / scale) + 2))
    to = j // whole
    weights = np.zeros((int(to[-1] - to[0]) + 1, count)) if len(j) else np.zeros((0, count))
    for at, w in taps((j + 0.5) * scale - 0.5, n) if len(j) else ():
        ours = (at >= first) & (at < first + count)
        np.add.at(weights, (to[ours] - to[0], at[ours] - first), w[ours] / whole)
    return int(to[0]) if len(j) else 0, weights


def downscale(cells: DataFrame, most_x: int, most_y: int, side: int = SIDE) -> DataFrame:
    """Photos scaled down to fit a box; those that fit stay as they are."""

    def parts_of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples():
                data, y0, x0 = layers_of(r.state, r.ty, r.tx, r.height, r.width, side)
                factor = max(r.width / min(r.width, most_x), r.height / min(r.height, most_y))
                top, down = shrinking(r.height, factor, y0, data.shape[1])
                left, across = shrinking(r.width, factor, x0, data.shape[2])
                made = np.einsum("ya,lab,xb->lyx", down, data, across, optimize=True)
                there = np.argwhere(np.outer(down.any(axis=1), across.any(axis=1)))
                y, x = there.T
                yield pd.DataFrame({"photo_id": r.photo_id, "y": y + top, "x": x + left} | {c: made[k, y, x] for k, c in enumerate("rgb")})

    each = tiled(cells, ["r", "g", "b"], side).mapInPandas(parts_of, "photo_id long, y int, x int, r double, g double, b double")
    return each.groupBy("photo_id", "y", "x").agg(*[F.sum(c).alias(c) for c in "rgb"])


def thumbnails(cells: DataFrame, most: int = 600) -> DataFrame:
    """Linear light, scaled down to a square box, and gamma again: whole values 0..65535."""
    linear = cells.withColumns({c: to_linear(F.col(c) / 65535.0) for c in "rgb"})
    return downscale(linear, most, most).withColumns({c: (65535 * to_srgb(c)).cast("int") for c in "rgb"})
