"""Queries on cell and mosaic tables over the fixture tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from .. import schema
from ..functions import pixels as px
from ..operators import grid, hist, merge, mosaic, tiles, tone
from .registry import query

BLOCK = ((3.0, 5.0), (7.0, 11.0))
MULTIPLIERS = (2.0, 1.0, 1.5)
MATRIX = ((1.6, -0.4, -0.2), (-0.2, 1.4, -0.2), (0.05, -0.45, 1.4))
CAM, PRE = (2.1, 1.0, 1.6), (1.9, 1.0, 1.4)
XTRANS = ((1, 2, 1, 1, 0, 1), (0, 1, 0, 2, 1, 2), (1, 2, 1, 1, 0, 1), (1, 0, 1, 1, 2, 1), (2, 1, 2, 0, 1, 0), (1, 0, 1, 1, 2, 1))


def _rgb() -> tuple:
    return F.col("r"), F.col("g"), F.col("b")


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return fx.cells(spark, d)


def _whole(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d).withColumns({c: F.col(c).cast("int") for c in "rgb"})


def _rounded(names: str, values, digits: int = 5) -> list:
    return [F.round(v, digits).alias(n) for n, v in zip(names.split(), values, strict=True)]


AT = ("photo_id", "y", "x")
WHOLE = "whole AS (SELECT photo_id, y, x, trunc(r)::INTEGER AS r, trunc(g)::INTEGER AS g, trunc(b)::INTEGER AS b FROM cells)"
W = f"{fx.sql('', 'cells')}, {WHOLE} "


def arr(rows) -> str:
    return "[" + ", ".join(("[" + ", ".join(map(str, r)) + "]") for r in rows) + "]"


@query(
    "mosaic_normalised",
    f"""SELECT photo_id, y, x, round(s, 5) AS black_off, round(least(s * {arr([[MULTIPLIERS[c] for c in r] for r in mosaic.BAYER])}[y % 2 + 1][x % 2 + 1]::DOUBLE * (65535.0::DOUBLE / 60000), 65535.0), 5) AS v
  FROM (SELECT *, v - (100.0::DOUBLE + {arr(BLOCK)}[y % 2 + 1][x % 2 + 1]::DOUBLE) AS s FROM mosaic)""",
    "mosaic",
)
def mosaic_normalised(spark: SparkSession, d: str) -> DataFrame:
    m = fx.mosaic(spark, d).withColumn("s", px.subtract_black("v", 100.0, BLOCK))
    return m.select(*AT, F.round("s", 5).alias("black_off"), F.round(px.clip(px.normalise("s", MULTIPLIERS, mosaic.BAYER, 60000)), 5).alias("v"))


@query(
    "raw_normalised",
    "SELECT photo_id, y, x, " + ", ".join(f"round({c} * {m}::DOUBLE * (65535.0::DOUBLE / 60000), 4) AS {c}" for c, m in zip("rgb", MULTIPLIERS, strict=True)) + ", round(r * (65535.0::DOUBLE / 60000), 4) AS plain, round(g * (65535.0::DOUBLE / 60000), 4) AS grey FROM cells",
    "cells",
)
def raw_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Cells with three colours, with and without the camera's multipliers, and a channel taken for one without colour."""
    whole, plain = px.normalise_colour(_rgb(), 60000, MULTIPLIERS), px.normalise_colour(_rgb(), 60000)
    return _cells(spark, d).select(*AT, *_rounded("r g b plain grey", (*whole, plain[0], px.normalise_mono("g", 60000)[2]), 4))


def _xyz_sql(t: str) -> str:
    k = f"(1000.0::DOUBLE / {t})"
    return f"""CASE WHEN {t} < 4000 THEN -0.2661239 * {k} ** 3 - 0.2343589 * {k} ** 2 + 0.8776956 * {k} + 0.17991 ELSE -3.0258469 * {k} ** 3 + 2.1070379 * {k} ** 2 + 0.2226347 * {k} + 0.24039 END"""


def _y_sql(t: str, x: str) -> str:
    return f"""CASE WHEN {t} < 2222 THEN -1.1063814 * {x} ** 3 - 1.3481102 * {x} ** 2 + 2.18555832 * {x} - 0.20219683 WHEN {t} < 4000 THEN -0.9549476 * {x} ** 3 - 1.37418593 * {x} ** 2 + 2.09137015 * {x} - 0.16748867
  ELSE 3.081758 * {x} ** 3 - 5.8733867 * {x} ** 2 + 3.75112997 * {x} - 0.37001483 END"""


def _mult_sql(table: str, t: str, tint: str) -> str:
    """Multipliers with the camera's base, of a table with columns t and tint; columns mr, mg, mb are added."""
    m = px.XYZ_TO_SRGB
    ratio = [p / c for p, c in zip(PRE, CAM, strict=True)]
    offset = [sum(a * x / min(ratio) for a, x in zip(row, ratio, strict=True)) for row in MATRIX]
    rgb = lambda x, y, row: f"({row[0]} * {x} + {row[1]} * {y} + {row[2]} * (1 - {x} - {y}))"
    base_t = f"{px.BASE_TEMPERATURE}::DOUBLE"
    return f"""SELECT *, pr / (least(pr, pg, pb) + 1e-5) AS mr, pg / (least(pr, pg, pb) + 1e-5) AS mg, pb / (least(pr, pg, pb) + 1e-5) AS mb FROM (
  SELECT *, greatest({rgb('xb', 'yb', m[0])} / {rgb('xc', 'yc', m[0])}, 0) * {offset[0]} AS pr, greatest(({rgb('xb', 'yb', m[1])} / {px.BASE_TINT}) / ({rgb('xc', 'yc', m[1])} / {tint}), 0) * {offset[1]} AS pg,
    greatest({rgb('xb', 'yb', m[2])} / {rgb('xc', 'yc', m[2])}, 0) * {offset[2]} AS pb FROM (
   SELECT *, {_y_sql(t, 'xc')} AS yc, {_y_sql(base_t, 'xb')} AS yb FROM (SELECT *, {_xyz_sql(t)} AS xc, {_xyz_sql(base_t)} AS xb FROM {table})))"""


@query("illuminants", f"SELECT photo_id, round(xc, 8) AS xx, round(yc, 8) AS yy, round(1 - xc - yc, 8) AS zz FROM (SELECT *, {_y_sql('temperature', 'xc')} AS yc FROM (SELECT *, {_xyz_sql('temperature')} AS xc FROM params))", "params")
def illuminants(spark: SparkSession, d: str) -> DataFrame:
    return fx.params(spark, d).select("photo_id", *_rounded("xx yy zz", px.temp_to_xyz("temperature"), 8))


@query("wb_multipliers", f"SELECT photo_id, round(mr, 6) AS mr, round(mg, 6) AS mg, round(mb, 6) AS mb FROM ({_mult_sql('params', 'temperature', 'tint')})", "params")
def wb_multipliers(spark: SparkSession, d: str) -> DataFrame:
    return fx.params(spark, d).select("photo_id", *_rounded("mr mg mb", px.wb_multipliers("temperature", "tint", MATRIX, CAM, PRE), 6))


@query(
    "white_balanced",
    f"""SELECT photo_id, y, x, {', '.join(f"round(greatest(({row[0]} * r + {row[1]} * g + {row[2]} * b) * (2.0 ** 0.5) * {m}, 0), 4) AS {c}" for c, row, m in zip('rgb', MATRIX, (1.1, 1.0, 1.3), strict=True))} FROM cells""",
    "cells",
)
def white_balanced(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d).select(*AT, *_rounded("r g b", px.apply_wb(_rgb(), MATRIX, (F.lit(1.1), F.lit(1.0), F.lit(1.3)), 0.5), 4))


@query(
    "exposed",
    """SELECT photo_id, y, x, round(CASE WHEN l > 51275.0 - 2000 THEN 65535.0 - 14260.0 * 14260.0 / (l + 14260.0 - 49275.0) ELSE l END * (500 * 0.00015387105::DOUBLE), 6) AS crystals
  FROM (SELECT *, greatest(0.0, r - 2000 + 4000000.0::DOUBLE / (r + 2000 + 1 / 65535.0::DOUBLE)) AS l FROM cells)""",
    "cells",
)
def exposed(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d).select(*AT, F.round(px.expose("r", 500.0, 51275.0, 2000.0), 6).alias("crystals"))


@query("tones", "SELECT photo_id, y, x, trunc(least(65535.0, greatest(0.0, (r - 1000) * (65535.0 / 60000::DOUBLE))))::INTEGER AS white, round(g / 65535 * (g / 65535) * b, 5) AS dense, round(2 * t - t * t, 8) AS curve FROM (SELECT *, (sqrt(0.04 + 0.6 * (b / 65535)) - 0.2) / 0.6 AS t FROM cells)", "cells")
def tones(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d).select(*AT, px.white_black("r", 1000.0, 60000.0).alias("white"), F.round(px.density(F.col("g") / 65535, "b"), 5).alias("dense"), F.round(px.tonecurve(F.col("b") / 65535), 8).alias("curve"))


def _newton_sql() -> str:
    a, b, c = 1 + 3 * 0.2 - 3 * 0.7, 3 * 0.7 - 6 * 0.2, 3 * 0.2
    body = "SELECT photo_id, y, x AS place, r / 65535 AS v, r / 65535 AS t FROM cells"
    for _ in range(5):
        body = f"SELECT photo_id, y, place, v, least(1.0, greatest(0.0, t - ((({a} * t + {b}) * t + {c}) * t - v) / ((3 * {a} * t + 2 * {b}) * t + {c}))) AS t FROM ({body})"
    a, b, c = 1 + 3 * 0.3 - 3 * 0.8, 3 * 0.8 - 6 * 0.3, 3 * 0.3
    return f"SELECT photo_id, y, place AS x, round((({a} * t + {b}) * t + {c}) * t, 7) AS v FROM ({body})"


@query("shadows_highlights", _newton_sql(), "cells")
def shadows_highlights(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d).select(*AT, F.round(px.shadows_highlights(F.col("r") / 65535, 0.2, 0.3, 0.7, 0.8), 7).alias("v"))


ROOT = "trunc(sqrt({} * 65535.0))"


@query(
    "film_curve",
    W
    + "SELECT photo_id, y, x, "
    + ", ".join(f"(CASE WHEN hi = lo OR {c} = hi THEN nh WHEN {c} = lo THEN nl ELSE trunc(nl + (nh - nl) * ({c} - lo)::DOUBLE / (hi - lo)) END)::INTEGER AS {c}" for c in "rgb")
    + f" FROM (SELECT *, {ROOT.format('hi')} AS nh, {ROOT.format('lo')} AS nl FROM (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM whole))",
)
def film_curve(spark: SparkSession, d: str) -> DataFrame:
    curve = lambda v: F.floor(F.sqrt(v * F.lit(65535.0)))
    return _whole(spark, d).select(*AT, *[v.alias(c) for v, c in zip(px.film_curve(_rgb(), curve), "rgb", strict=True)])


HSV = """hsv AS (SELECT photo_id, y, x, CASE WHEN hi = 0 THEN -1.0 WHEN h < 0 THEN h + 6 ELSE h END AS h, CASE WHEN hi = 0 THEN 0.0 ELSE (hi - lo)::DOUBLE / hi END AS s, hi / 65535.0::DOUBLE AS v FROM (
  SELECT *, CASE WHEN hi = lo THEN 0.0::DOUBLE WHEN r = hi THEN (g - b)::DOUBLE / (hi - lo) WHEN g = hi THEN 2 + (b - r)::DOUBLE / (hi - lo) ELSE 4 + (r - g)::DOUBLE / (hi - lo) END AS h FROM (
   SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM whole)))"""


@query("to_hsv", f"{W}, {HSV} SELECT photo_id, y, x, round(h, 8) AS h, round(s, 8) AS s, round(v, 8) AS v FROM hsv")
def to_hsv(spark: SparkSession, d: str) -> DataFrame:
    return _whole(spark, d).select(*AT, *_rounded("h s v", px.to_hsv(_rgb()), 8))


def _back_sql(s: str) -> str:
    p, q, t = "v * (1 - s)", "v * (1 - s * f)", "v * (1 - s * (1 - f))"
    order = {"r": ("v", q, p, p, t, "v"), "g": (t, "v", "v", q, p, p), "b": (p, p, t, "v", "v", q)}
    pick = lambda c: "CASE WHEN s = 0 THEN v " + " ".join(f"WHEN i = {k} THEN {e}" for k, e in enumerate(order[c])) + " END"
    return ", ".join(f"trunc(least(65535.0, greatest(0.0, ({pick(c)}) * 65535)))::INTEGER AS {c}" for c in "rgb") + f" FROM (SELECT *, trunc(h)::INTEGER AS i, h - trunc(h) AS f FROM (SELECT photo_id, y, x, greatest(h, 0.0) AS h, {s} AS s, v FROM hsv))"


@query("vibrance", f"{W}, {HSV} SELECT photo_id, y, x, {_back_sql('least(1.0, greatest(0.0, 2.0 ** 0.4 * s ** (2.0 ** (-0.3))))')}")
def vibrance(spark: SparkSession, d: str) -> DataFrame:
    return tone.vibrance_saturation(_whole(spark, d), 0.3, 0.4).select(*AT, "r", "g", "b")


@query("monochrome", W + "SELECT photo_id, y, x, trunc(least(65535.0, greatest(0.0, 0.21::DOUBLE * r + 0.78::DOUBLE * g + 0.07::DOUBLE * b)))::INTEGER AS grey FROM whole")
def monochrome(spark: SparkSession, d: str) -> DataFrame:
    return _whole(spark, d).select(*AT, px.monochrome(_rgb()).alias("grey"))


GAMMA = "CASE WHEN {0} <= 0.0031308 THEN {0} * 12.92 ELSE 1.055 * {0} ** (1 / 2.4::DOUBLE) - 0.055 END"
LINEAR = "CASE WHEN {0} <= 0.04045 THEN {0} / 12.92 ELSE (({0} + 0.055) / 1.055) ** 2.4 END"


@query("gamma", f"SELECT photo_id, y, x, round({LINEAR.format('(r / 65535)')}, 8) AS linear, round({GAMMA.format('(g / 65535)')}, 8) AS curved FROM cells", "cells")
def gamma(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d).select(*AT, F.round(px.to_linear(F.col("r") / 65535), 8).alias("linear"), F.round(px.to_srgb(F.col("g") / 65535), 8).alias("curved"))


def _dot_sql(row) -> str:
    return f"({row[0]} * (r / 65535) + {row[1]} * (g / 65535) + {row[2]} * (b / 65535))"


@query("colour_spaces", "SELECT photo_id, y, x, " + ", ".join(f"round({_dot_sql(row)}, 8) AS {n}" for n, row in zip(("xx", "yy", "zz"), px.SRGB_TO_XYZ, strict=True)) + ", " + ", ".join(f"round({_dot_sql(row)}, 8) AS {n}" for n, row in zip(("rr", "gg", "bb"), px.XYZ_TO_SRGB, strict=True)) + " FROM cells", "cells")
def colour_spaces(spark: SparkSession, d: str) -> DataFrame:
    v = tuple(c / 65535 for c in _rgb())
    return _cells(spark, d).select(*AT, *_rounded("xx yy zz", px.to_xyz(v), 8), *_rounded("rr gg bb", px.from_xyz(v), 8))


def _lab_sql() -> str:
    f = lambda row, w: f"(CASE WHEN least(1.0, greatest(0.0, {_dot_sql(row)} / {w})) <= 216 / 24389::DOUBLE THEN (24389 / 27::DOUBLE * least(1.0, greatest(0.0, {_dot_sql(row)} / {w})) + 16) / 116 ELSE cbrt(least(1.0, greatest(0.0, {_dot_sql(row)} / {w}))) END)"
    return (
        "SELECT photo_id, y, x, trunc(65535 * least(1.0, greatest(0.0, 116 * fy - 16)))::INTEGER AS l, trunc(32767 * least(1.0, greatest(-1.0, 500 * (fx - fy))) + 32768)::INTEGER AS a, trunc(32767 * least(1.0, greatest(-1.0, 200 * (fy - fz))) + 32768)::INTEGER AS b FROM (SELECT photo_id, y, x, "
        + ", ".join(f"{f(row, w)} AS {n}" for n, row, w in zip(("fx", "fy", "fz"), px.SRGB_TO_XYZ, px.WHITE_D50, strict=True))
        + " FROM cells)"
    )


@query("lab", _lab_sql(), "cells")
def lab(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d).select(*AT, *[v.alias(n) for v, n in zip(px.to_lab(tuple(c / 65535 for c in _rgb())), "lab", strict=True)])


@query(
    "eight_bits",
    W + f"SELECT photo_id, y, x, trunc(least(255.0, greatest(0.0, (r + 1) / 256::DOUBLE - 1 + 0.9999 * ((y * 31 + x * 17) % 100 / 100::DOUBLE))))::INTEGER AS dithered, g // 256 AS shown, (b // 256) * 257 AS tiff, trunc(({LINEAR.format('((b // 256) / 255.0::DOUBLE)')}) * 65535.0)::INTEGER AS jpeg FROM whole",
)
def eight_bits(spark: SparkSession, d: str) -> DataFrame:
    small = px.to_display("b")
    return _whole(spark, d).select(*AT, px.to_8bit("r", (F.col("y") * 31 + F.col("x") * 17) % 100 / 100).alias("dithered"), px.to_display("g").alias("shown"), px.from_8bit(small, "tiff").alias("tiff"), px.from_8bit(small, "jpeg").alias("jpeg"))


@query("dithered")
def dithered(spark: SparkSession, d: str) -> DataFrame:
    """Dither by a hash of place and channel: fixed for a photo, so it has no twin in SQL."""
    return _whole(spark, d).select(*AT, *[px.to_8bit(c, px.uniform_of("photo_id", "y", "x", F.lit(c))).alias(c) for c in "rgb"])


@query("lut_applied", W + "SELECT photo_id, y, x, trunc(sqrt(r * 65535.0))::BIGINT AS r, trunc(sqrt(g * 65535.0))::BIGINT AS g, b FROM whole")
def lut_applied(spark: SparkSession, d: str) -> DataFrame:
    lut = merge.lut_from(spark, lambda i: F.floor(F.sqrt(i * F.lit(65535.0))))
    return merge.apply_lut(_whole(spark, d), lut, ("r", "g")).select(*AT, "r", "g", "b")


@query("linear_lut", W + "SELECT photo_id, y, x, trunc(least(60000.0, greatest(500.0, 1.2 * r - 3000)))::INTEGER AS r FROM whole")
def linear_lut(spark: SparkSession, d: str) -> DataFrame:
    return _whole(spark, d).select(*AT, px.linear_lut("r", 1.2, -3000.0, 500.0, 60000.0).alias("r"))


# histograms

FLAT = "flat AS (" + " UNION ALL ".join(f"SELECT photo_id, y, x, '{c}' AS channel, {e} AS v FROM cells" for c, e in (("l", "0.2126 * r + 0.7151 * g + 0.0722 * b"), ("r", "r"), ("g", "g"), ("b", "b"))) + ")"
F_SQL = f"{fx.sql('', 'cells')}, {FLAT} "
FINAL = f"final AS (SELECT photo_id, channel, (trunc(least(65535.0, greatest(0.0, v)))::INTEGER // 512)::INTEGER AS bin, count(*) AS n FROM flat GROUP BY ALL)"
PEAK = "SELECT photo_id, channel, greatest(coalesce(max(n) FILTER (bin BETWEEN 1 AND 126), 0), 1) * 1.1::DOUBLE AS peak FROM final GROUP BY ALL"


@query("cell_stats", F_SQL + "SELECT photo_id, channel, round(sum(v), 3) AS total, min(v) AS low, max(v) AS high, round(avg(v), 5) AS mean, round(var_pop(v), 2) AS variance FROM flat WHERE channel <> 'l' GROUP BY ALL")
def cell_stats(spark: SparkSession, d: str) -> DataFrame:
    return hist.cell_stats(_cells(spark, d)).select("photo_id", "channel", F.round("total", 3).alias("total"), "low", "high", F.round("mean", 5).alias("mean"), F.round("variance", 2).alias("variance"))


@query("raw_range", "SELECT photo_id, min(v) AS low, max(v) AS high FROM mosaic GROUP BY 1", "mosaic")
def raw_range(spark: SparkSession, d: str) -> DataFrame:
    return hist.raw_range(fx.mosaic(spark, d))


@query("channel_limits", "SELECT photo_id, max(r) AS r_max, max(g) AS g_max, max(b) AS b_max, 65535.0 * (1.0::DOUBLE + photo_id % 3) AS r_clip, 65535.0::DOUBLE AS g_clip, 65535.0 * 1.5::DOUBLE AS b_clip FROM cells GROUP BY 1", "cells")
def channel_limits(spark: SparkSession, d: str) -> DataFrame:
    c = _cells(spark, d)
    camera = c.select("photo_id").distinct().select("photo_id", (F.lit(1.0) + F.col("photo_id") % 3).alias("r_mul"), F.lit(1.0).alias("g_mul"), F.lit(1.5).alias("b_mul"))
    return hist.channel_limits(c, camera)


@query("hist_final", f"{F_SQL}, {FINAL} SELECT * FROM final")
def hist_final(spark: SparkSession, d: str) -> DataFrame:
    return hist.hist_final(_cells(spark, d))


@query("hist_float", F_SQL + "SELECT photo_id, channel, least(127, trunc(127 * v / 65535.0))::INTEGER AS bin, count(*) AS n FROM flat WHERE x >= 2 AND x < 15 AND y >= 1 AND y < 20 GROUP BY ALL")
def hist_float(spark: SparkSession, d: str) -> DataFrame:
    c = _cells(spark, d)
    rects = c.select("photo_id").distinct().select("photo_id", F.lit(2).alias("x0"), F.lit(1).alias("y0"), F.lit(15).alias("x1"), F.lit(20).alias("y1"))
    return hist.hist_float(c, rects, 65535.0)


def _raw_sql(cfa) -> str:
    n = len(cfa)
    return f"SELECT photo_id, ['r', 'g', 'b'][{arr(cfa)}[y % {n} + 1][x % {n} + 1] + 1] AS channel, least(127, trunc(127 * v / 65535.0))::INTEGER AS bin, count(*) AS n FROM mosaic GROUP BY ALL"


@query("hist_raw", _raw_sql(mosaic.BAYER), "mosaic")
def hist_raw(spark: SparkSession, d: str) -> DataFrame:
    return hist.hist_raw(fx.mosaic(spark, d), mosaic.BAYER, 65535.0)


@query("hist_raw_six", _raw_sql(XTRANS), "mosaic")
def hist_raw_six(spark: SparkSession, d: str) -> DataFrame:
    return hist.hist_raw(fx.mosaic(spark, d), XTRANS, 65535.0)


@query("hist_raw_colour", F_SQL + "SELECT photo_id, channel, least(127, trunc(127 * v / 60000.0::DOUBLE))::INTEGER AS bin, count(*) AS n FROM flat WHERE channel <> 'l' GROUP BY ALL")
def hist_raw_colour(spark: SparkSession, d: str) -> DataFrame:
    return hist.hist_raw_colour(_cells(spark, d), 60000.0)


@query("hist_raw_mono", "SELECT photo_id, channel, least(127, trunc(127 * v / 60000.0::DOUBLE))::INTEGER AS bin, count(*) AS n FROM mosaic, (VALUES ('r'), ('g'), ('b')) t(channel) GROUP BY ALL", "mosaic")
def hist_raw_mono(spark: SparkSession, d: str) -> DataFrame:
    return hist.hist_raw_mono(fx.mosaic(spark, d), 60000.0)


@query("hist_peaks", f"{F_SQL}, {FINAL} SELECT photo_id, channel, round(peak, 6) AS peak FROM ({PEAK})")
def hist_peaks(spark: SparkSession, d: str) -> DataFrame:
    return hist.hist_peaks(hist.hist_final(_cells(spark, d))).withColumn("peak", F.round("peak", 6))


@query("hist_heights", f"{F_SQL}, {FINAL} SELECT photo_id, channel, bin, round(least(n, peak) / peak, 8) AS linear, round(least(1.0, ln(n + 1) / ln(peak + 1)), 8) AS log FROM final JOIN ({PEAK}) USING (photo_id, channel)")
def hist_heights(spark: SparkSession, d: str) -> DataFrame:
    h = hist.hist_final(_cells(spark, d))
    key = ["photo_id", "channel", "bin"]
    linear = hist.hist_heights(h, False).select(*key, F.round("height", 8).alias("linear"))
    return linear.join(hist.hist_heights(h, True).select(*key, F.round("height", 8).alias("log")), key)


# sampling and merging


@query(
    "sample_wb",
    """SELECT photo_id, px, py, CASE WHEN px > 1 THEN -1.0 ELSE round(r / 2.0, 4) END AS r, CASE WHEN px > 1 THEN -1.0 ELSE round(g, 4) END AS g, CASE WHEN px > 1 THEN -1.0 ELSE round(b / 1.5, 4) END AS b FROM (
  SELECT p.photo_id, px, py, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM (SELECT photo_id, px, py, max(x) AS mx, max(y) AS my FROM cells, (VALUES (0.1::DOUBLE, 0.9::DOUBLE), (0.5, 0.5), (1.5, 0.5)) t(px, py) GROUP BY ALL) p JOIN cells c ON p.photo_id = c.photo_id
  WHERE px > 1 OR (abs(x - round(px * mx)) <= 10 AND abs(y - round(py * my)) <= 10) GROUP BY ALL)""",
    "cells",
)
def sample_wb(spark: SparkSession, d: str) -> DataFrame:
    c = _cells(spark, d)
    spots = F.array(*[F.struct(F.lit(a).alias("px"), F.lit(b).alias("py")) for a, b in ((0.1, 0.9), (0.5, 0.5), (1.5, 0.5))])
    points = c.select("photo_id").distinct().select("photo_id", F.inline(spots))
    return merge.sample_wb(c, points, (2.0, 1.0, 1.5)).select("photo_id", "px", "py", *_rounded("r g b", _rgb(), 4))


@query("grey_gains", "SELECT photo_id, round((1 / r) / least(1 / r, 1 / g, 1 / b), 8) AS r_gain, round((1 / g) / least(1 / r, 1 / g, 1 / b), 8) AS g_gain, round((1 / b) / least(1 / r, 1 / g, 1 / b), 8) AS b_gain FROM (SELECT photo_id, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM cells GROUP BY 1)", "cells")
def grey_gains(spark: SparkSession, d: str) -> DataFrame:
    means = _cells(spark, d).groupBy("photo_id").agg(*[F.avg(c).alias(c) for c in "rgb"])
    return merge.wb_from_sample(means).select("photo_id", *_rounded("r_gain g_gain b_gain", [F.col(f"{c}_gain") for c in "rgb"], 8))


BRIGHT = "bright AS (SELECT photo_id, y, x, least(65535.0, 2 * r) AS r2, least(65535.0, 2 * g) AS g2, least(65535.0, 2 * b) AS b2 FROM cells)"
RATIO = "ratio AS (SELECT photo_id, sum(r + g + b) / sum(r2 + g2 + b2) AS ratio FROM cells JOIN bright USING (photo_id, y, x) WHERE greatest(r, g, b, r2, g2, b2) < 60000 GROUP BY 1)"


def _bright(c: DataFrame) -> DataFrame:
    return c.withColumns({k: F.least(F.lit(65535.0), 2 * F.col(k)) for k in "rgb"})


@query("exposure_ratio", f"{fx.sql('', 'cells')}, {BRIGHT}, {RATIO} SELECT photo_id, round(ratio, 9) AS ratio FROM ratio")
def exposure_ratio(spark: SparkSession, d: str) -> DataFrame:
    c = _cells(spark, d)
    return merge.exposure_ratio(c, _bright(c)).select("photo_id", F.round("ratio", 9).alias("ratio"))


@query(
    "merge_exposures",
    f"{fx.sql('', 'cells')}, {BRIGHT}, {RATIO} SELECT photo_id, y, x, " + ", ".join(f"round(CASE WHEN ratio IS NULL THEN {c} ELSE ({c} + {c}2 * ratio * w) / (1 + w) END, 5) AS {c}" for c in "rgb") + " FROM (SELECT *, CASE WHEN floor(greatest(r2, g2, b2)) <= 60000 THEN 1 / ratio ELSE 0.0 END AS w FROM cells JOIN bright USING (photo_id, y, x) LEFT JOIN ratio USING (photo_id))",
)
def merge_exposures(spark: SparkSession, d: str) -> DataFrame:
    c = _cells(spark, d)
    b = _bright(c)
    return merge.merge_exposures(c, b, merge.exposure_ratio(c, b)).select(*AT, *_rounded("r g b", _rgb()))


def _chain_sql() -> str:
    """Three frames: the base, twice as bright, and four times; each brighter one at its own compensation."""
    step = lambda at, frame, ratio, w: f"(CASE WHEN floor(top) > 60000 THEN {at} ELSE ({at} * {w} + {frame} * {ratio} / {ratio}) / ({w} + 1 / {ratio}) END)"
    frame = lambda k: f"SELECT photo_id, y, x, " + ", ".join(f"least(65535.0, {k} * {c}) AS {c}2" for c in "rgb") + " FROM cells"  # noqa: E731, F541
    rate = lambda base, bright: f"SELECT photo_id, sum(r + g + b) / sum(r2 + g2 + b2) AS ratio FROM {base} JOIN {bright} USING (photo_id, y, x) WHERE greatest(r, g, b, r2, g2, b2) < 60000 GROUP BY 1"
    merged = lambda base, bright, state: f"SELECT photo_id, y, x, " + ", ".join(f"CASE WHEN ratio IS NULL OR ratio > last * 1.05 THEN {c} ELSE {step(c, c + '2', 'ratio', 'weight')} END AS {c}" for c in "rgb") + f" FROM (SELECT *, greatest(r2, g2, b2) AS top FROM {base} JOIN {bright} USING (photo_id, y, x) JOIN {state} USING (photo_id))"  # noqa: E731, F541
    return f"""{fx.sql('', 'cells')}, f2 AS ({frame(2)}), f4 AS ({frame(4)}), q2 AS ({rate('cells', 'f2')}),
  s2 AS (SELECT photo_id, ratio, 1.0::DOUBLE AS weight, 1.0::DOUBLE AS last FROM (SELECT DISTINCT photo_id FROM cells) LEFT JOIN q2 USING (photo_id)), m2 AS ({merged('cells', 'f2', 's2')}), q4 AS ({rate('m2', 'f4')}),
  s4 AS (SELECT a.photo_id, q4.ratio, CASE WHEN a.ratio <= 1.05 THEN 1 + 1 / a.ratio ELSE 1.0 END AS weight, CASE WHEN a.ratio <= 1.05 THEN 0.5::DOUBLE ELSE 1.0 END AS last FROM s2 a LEFT JOIN q4 USING (photo_id)), m4 AS ({merged('m2', 'f4', 's4')})
  SELECT photo_id, y, x, round(r, 4) AS r, round(g, 4) AS g, round(b, 4) AS b, round(CASE WHEN ratio <= last * 1.05 THEN weight + 1 / ratio ELSE weight END, 6) AS weight FROM m4 JOIN s4 USING (photo_id)"""


@query("merge_chain", _chain_sql())
def merge_chain(spark: SparkSession, d: str) -> DataFrame:
    c = _cells(spark, d)
    times = lambda k: c.withColumns({n: F.least(F.lit(65535.0), k * F.col(n)) for n in "rgb"})
    merged, state = merge.merge_chain(c, [(times(2), 1.0), (times(4), 2.0)])
    return merged.join(state, "photo_id").select(*AT, *_rounded("r g b", _rgb(), 4), F.round("weight", 6).alias("weight"))


# grids


SIZED = "sized AS (SELECT *, max(x) OVER (PARTITION BY photo_id) AS mx, max(y) OVER (PARTITION BY photo_id) AS my FROM cells)"


@query(
    "rotated",
    f"{fx.sql('', 'cells')}, {SIZED} SELECT photo_id, k, y, x, r FROM (" + " UNION ALL ".join(f"SELECT photo_id, {k} AS k, {y}::INTEGER AS y, {x}::INTEGER AS x, r FROM sized" for k, y, x in ((1, "mx - x", "y"), (2, "my - y", "mx - x"), (3, "x", "my - y"))) + ")",
)
def rotated(spark: SparkSession, d: str) -> DataFrame:
    c = _cells(spark, d)
    parts = [grid.rotate(c, k).select("photo_id", F.lit(k).alias("k"), "y", "x", "r") for k in (1, 2, 3)]
    return parts[0].union(parts[1]).union(parts[2])


RECT = """rects AS (SELECT photo_id, round(0.5 * (w - cw) + (round(greatest(-(1 - cw / w) / 2, least((1 - cw / w) / 2, 0.1)) * w + ow) - ow))::INTEGER AS x0, round(0.5 * (h - ch) + (round(greatest(-(1 - ch / h) / 2, least((1 - ch / h) / 2, -0.05)) * h + oh) - oh))::INTEGER AS y0, cw::INTEGER AS cw, ch::INTEGER AS ch FROM (
  SELECT *, CASE WHEN round((w - cw) / 2) * 2 = w - cw THEN 0.0 ELSE 0.5 END AS ow, CASE WHEN round((h - ch) / 2) * 2 = h - ch THEN 0.0 ELSE 0.5 END AS oh FROM (
   SELECT photo_id, w, h, round(least(h * 0.5 * 0.4, w)) AS cw, round(least(h * 0.5, w / 0.4)) AS ch FROM (SELECT photo_id, max(x)::DOUBLE + 1 AS w, max(y)::DOUBLE + 1 AS h FROM cells GROUP BY 1))))"""


@query("cropped", f"{fx.sql('', 'cells')}, {RECT} SELECT photo_id, (y - y0)::INTEGER AS y, (x - x0)::INTEGER AS x, g FROM cells JOIN rects USING (photo_id) WHERE x BETWEEN x0 AND x0 + cw - 1 AND y BETWEEN y0 AND y0 + ch - 1")
def cropped(spark: SparkSession, d: str) -> DataFrame:
    c = _cells(spark, d)
    asked = grid.extents(c).withColumns({"crop_height": F.lit(0.5), "crop_aspect": F.lit(0.4), "crop_x": F.lit(0.1), "crop_y": F.lit(-0.05)})
    return grid.crop(c, grid.crop_rect(asked)).select("photo_id", "y", "x", "g")


TURNED = RECT.replace("SELECT photo_id, max(x)::DOUBLE + 1 AS w, max(y)::DOUBLE + 1 AS h FROM cells GROUP BY 1", "SELECT photo_id, w::DOUBLE AS w, h::DOUBLE AS h FROM turned")


@query(
    "hist_float_turned",
    f"""{F_SQL}, turned AS (SELECT photo_id, photo_id % 4 AS k, CASE WHEN photo_id % 2 = 1 THEN max(y) ELSE max(x) END + 1 AS w, CASE WHEN photo_id % 2 = 1 THEN max(x) ELSE max(y) END + 1 AS h FROM cells GROUP BY 1), {TURNED},
  back AS (SELECT photo_id, CASE k WHEN 1 THEN h - y0 - ch WHEN 2 THEN w - x0 - cw WHEN 3 THEN y0 ELSE x0 END AS ax, CASE k WHEN 1 THEN x0 WHEN 2 THEN h - y0 - ch WHEN 3 THEN w - x0 - cw ELSE y0 END AS ay,
    CASE WHEN k % 2 = 1 THEN ch ELSE cw END AS across, CASE WHEN k % 2 = 1 THEN cw ELSE ch END AS down FROM rects JOIN turned USING (photo_id))
  SELECT photo_id, channel, least(127, trunc(127 * v / 65535.0))::INTEGER AS bin, count(*) AS n FROM flat JOIN back USING (photo_id) WHERE x >= ax AND x < ax + across - 1 AND y >= ay AND y < ay + down - 1 GROUP BY ALL""",
)
def hist_float_turned(spark: SparkSession, d: str) -> DataFrame:
    """The crop is asked for on the turned photo, and counted on the cells before the turn."""
    c = _cells(spark, d)
    odd = F.col("photo_id") % 2 == 1
    sizes = grid.extents(c).select("photo_id", F.when(odd, F.col("height")).otherwise(F.col("width")).alias("width"), F.when(odd, F.col("width")).otherwise(F.col("height")).alias("height"))
    asked = sizes.withColumns({"crop_height": F.lit(0.5), "crop_aspect": F.lit(0.4), "crop_x": F.lit(0.1), "crop_y": F.lit(-0.05)})
    rects = grid.crop_rect(asked).join(sizes, "photo_id").withColumn("turns", F.col("photo_id") % 4)
    return hist.hist_float(c, hist.turn_back(rects), 65535.0)


def _smooth_sql() -> str:
    """Seven box means of radius 1 over a mirrored halo, along rows and then along columns."""
    body = "SELECT photo_id, y, x, r AS v FROM cells"
    for axis, line in (("x", "y"), ("y", "x")):
        body = f"""SELECT s.photo_id, s.{line}, p::INTEGER AS {axis}, s.v, s.n FROM (SELECT *, max({axis}) OVER (PARTITION BY photo_id) + 1 AS n FROM ({body})) s,
  unnest(list_distinct([{axis}, -{axis}, 2 * (n - 1) - {axis}])) u(p) WHERE p >= -7 AND p < n + 7"""
        for _ in range(7):
            body = f"SELECT photo_id, {line}, {axis}, n, avg(v) OVER (PARTITION BY photo_id, {line} ORDER BY {axis} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM ({body})"
        body = f"SELECT photo_id, y, x, v FROM ({body}) WHERE {axis} >= 0 AND {axis} < n"
    return f"SELECT photo_id, y, x, round(v, 4) AS r FROM ({body})"


@query("smoothed", _smooth_sql(), "cells")
def smoothed(spark: SparkSession, d: str) -> DataFrame:
    return tiles.smooth(_cells(spark, d), "r", 1).select(*AT, F.round("r", 4).alias("r"))


@query(
    "develop_step",
    "SELECT photo_id, y, x, round(rg, 9) AS r_rad, round(1.0 - 2 * 3.0 * rv, 9) AS r_salt, round(greatest(1.0 - 2 * 5.0 / (0.1 * 3.0) * (rv + gv + bv), 0.0), 9) AS dev FROM (SELECT *, (0.5 + 0.002 * 2)::DOUBLE AS rg, 0.004::DOUBLE * 0.25 * (r / 65535) AS rv, 0.004 * 0.25 * (g / 65535) AS gv, 0.004 * 0.25 * (b / 65535) AS bv FROM cells)",
    "cells",
)
def develop_step(spark: SparkSession, d: str) -> DataFrame:
    state = {f"{c}_cry": F.col(c) / 65535 for c in "rgb"} | {f"{c}_rad": F.lit(0.5) for c in "rgb"} | {f"{c}_salt": F.lit(1.0) for c in "rgb"} | {"dev": F.lit(1.0)}
    new = grid.develop_step(_cells(spark, d).withColumns(state), 0.002, 5.0, 3.0, 0.1, 2.0)
    return new.select(*AT, *[F.round(c, 9).alias(c) for c in ("r_rad", "r_salt", "dev")])


POOLS = "pools AS (SELECT photo_id, 0.8::DOUBLE AS pool, 1000.0::DOUBLE AS volume, sqrt(count(*) / 864.0::DOUBLE) AS ppm, sum(g / 65535) AS dev, count(*) AS n FROM cells GROUP BY 1)"


def _pools(c: DataFrame) -> DataFrame:
    return c.groupBy("photo_id").agg(F.count("*").alias("n")).select("photo_id", F.lit(0.8).alias("pool"), F.lit(1000.0).alias("volume"), F.sqrt(F.col("n") / 864.0).alias("ppm"))


@query("pool_exchange", f"{fx.sql('', 'cells')}, {POOLS} SELECT photo_id, round(pool - ((dev * m + n * (1 - m) * pool) - dev) * 0.1 / (ppm * ppm * volume), 9) AS pool, round(dev * m + n * (1 - m) * pool, 5) AS layer FROM (SELECT *, 0.2 ** 0.5 AS m FROM pools)")
def pool_exchange(spark: SparkSession, d: str) -> DataFrame:
    c = _cells(spark, d).withColumn("dev", F.col("g") / 65535)
    cells, pools = grid.pool_exchange(c, _pools(c), 0.2, 10.0, 20.0, 0.1)
    return pools.select("photo_id", F.round("pool", 9).alias("pool")).join(cells.groupBy("photo_id").agg(F.round(F.sum("dev"), 5).alias("layer")), "photo_id")


@query("pool_equalised", f"{fx.sql('', 'cells')}, {POOLS} SELECT photo_id, round((dev * 0.1 / (ppm * ppm) + pool * volume) / (volume + n * 0.1 / (ppm * ppm)), 9) AS dev FROM pools")
def pool_equalised(spark: SparkSession, d: str) -> DataFrame:
    c = _cells(spark, d).withColumn("dev", F.col("g") / 65535)
    return grid.pool_equalise(c, _pools(c), 0.1)[0].groupBy("photo_id").agg(F.round(F.max("dev"), 9).alias("dev"))


@query("developed")
def developed(spark: SparkSession, d: str) -> DataFrame:
    """Steps depend on each other, so there is no twin in SQL; a NumPy twin is in the tests."""
    return tiles.develop_photos(_cells(spark, d), schema.PROFILE)


_TAPS = "(SELECT *, unnest([{'at': greatest(0, least(n - 1, floor(p))), 'w': 1 - (p - trunc(p))}, {'at': greatest(0, least(n - 1, ceil(p))), 'w': p - trunc(p)}]) AS t FROM {src})"


def _level_sql(degrees: float) -> str:
    a, b = f"cos(radians({degrees}))", f"sin(radians({degrees}))"
    return f"""{fx.sql('', 'cells')}, ext AS (SELECT photo_id, max(x) + 1 AS w, max(y) + 1 AS h, max(x) / 2.0::DOUBLE AS sw, max(y) / 2.0::DOUBLE AS sh FROM cells GROUP BY 1),
  z AS (SELECT *, greatest(1.0, abs(sw * {a} - sh * {b}) / sw, abs(sw * {a} + sh * {b}) / sw, abs(sw * {b} + sh * {a}) / sh, abs(sw * {b} - sh * {a}) / sh) AS k FROM ext),
  pts AS (SELECT photo_id, y, x, w, h, ((x - sw) * {a} - (y - sh) * {b}) / k + sw AS px, ((x - sw) * {b} + (y - sh) * {a}) / k + sh AS py FROM cells JOIN z USING (photo_id)),
  tx AS {_TAPS.replace("{src}", "(SELECT *, w AS n, px AS p FROM pts)")}, ty AS {_TAPS.replace("{src}", "(SELECT photo_id, y, x, t.at AS ax, t.w AS wx, h AS n, py AS p FROM tx)")}
  SELECT q.photo_id, q.y, q.x, """ + ", ".join(f"round(sum(c.{v} * wx * t.w), 4) AS {v}" for v in "rgb") + " FROM ty q JOIN cells c ON c.photo_id = q.photo_id AND c.x = ax AND c.y = t.at GROUP BY 1, 2, 3"


def _downscale_sql(most_x: int, most_y: int) -> str:
    axis = lambda n: f"""SELECT photo_id, j // whole AS too, whole, n, (j + 0.5) * n / last / whole - 0.5 AS p FROM (
    SELECT *, unnest(range(0, (last * whole)::BIGINT)) AS j FROM (SELECT *, greatest(1, floor(n / last))::BIGINT AS whole FROM (SELECT photo_id, {n} AS n, greatest(1, round({n} / k))::BIGINT AS last FROM f)))"""  # noqa: E731
    part = lambda name, n: f"{name}0 AS ({axis(n)}), {name}1 AS {_TAPS.replace('{src}', name + '0')}, {name} AS (SELECT photo_id, too, t.at AS at, sum(t.w / whole) AS w FROM {name}1 GROUP BY 1, 2, 3)"
    return f"""{fx.sql('', 'cells')}, ext AS (SELECT photo_id, max(x) + 1 AS w, max(y) + 1 AS h FROM cells GROUP BY 1), f AS (SELECT *, greatest(w / least(w, {most_x}), h / least(h, {most_y}))::DOUBLE AS k FROM ext),
  {part("ax", "w")}, {part("ay", "h")}
  SELECT c.photo_id, ay.too::INTEGER AS y, ax.too::INTEGER AS x, """ + ", ".join(f"round(sum(c.{v} * ax.w * ay.w), 4) AS {v}" for v in "rgb") + " FROM cells c JOIN ax ON ax.photo_id = c.photo_id AND ax.at = c.x JOIN ay ON ay.photo_id = c.photo_id AND ay.at = c.y GROUP BY 1, 2, 3"


@query("levelled", _level_sql(7.0))
def levelled(spark: SparkSession, d: str) -> DataFrame:
    return tiles.level(_cells(spark, d), 7.0).select(*AT, *_rounded("r g b", _rgb(), 4))


@query("downscaled", _downscale_sql(9, 20))
def downscaled(spark: SparkSession, d: str) -> DataFrame:
    return tiles.downscale(_cells(spark, d), 9, 20).select(*AT, *_rounded("r g b", _rgb(), 4))


@query("thumbnails")
def thumbnails(spark: SparkSession, d: str) -> DataFrame:
    return tiles.thumbnails(_cells(spark, d), 12)


@query("thumb_status", "SELECT photo_id, CASE WHEN count(*) = 0 THEN -1 ELSE 1 END AS status FROM cells GROUP BY 1", "cells")
def thumb_status(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.catalog import thumb_status as status

    return grid.extents(_cells(spark, d)).select("photo_id", status("height", "width").alias("status"))


@query("mosaic_of_cells", "SELECT photo_id, y, x, CASE WHEN y % 2 = 0 THEN CASE WHEN x % 2 = 0 THEN g ELSE r END ELSE CASE WHEN x % 2 = 0 THEN b ELSE g END END AS v FROM cells", "cells")
def mosaic_of_cells(spark: SparkSession, d: str) -> DataFrame:
    return mosaic.mosaic(_cells(spark, d))


def _near(v: str, k: int, axis: str) -> str:
    w = f"OVER (PARTITION BY photo_id, {'y' if axis == 'x' else 'x'} ORDER BY {axis})"
    a, b = ("lag", "lead") if k > 0 else ("lead", "lag")
    return f"coalesce({a}({v}, {abs(k)}) {w}, {b}({v}, {abs(k)}) {w})"


@query("interp_missing", f"SELECT photo_id, y, x, ({_near('v', 1, 'x')} + {_near('v', -1, 'x')}) / 2 AS across, ({_near('v', 1, 'y')} + {_near('v', -1, 'y')}) / 2 AS down FROM mosaic", "mosaic")
def interp_missing(spark: SparkSession, d: str) -> DataFrame:
    return mosaic.interp_missing(fx.mosaic(spark, d)).select(*AT, "across", "down")


TAPS = (0.3, 0.2, 0.1, 0.04, 0.01)


@query("lowpass9", "SELECT photo_id, y, x, round(v * 0.3 + " + " + ".join(f"({_near('v', k, 'y')} + {_near('v', -k, 'y')}) * {TAPS[k]}" for k in range(1, 5)) + ", 5) AS v FROM mosaic", "mosaic")
def lowpass9(spark: SparkSession, d: str) -> DataFrame:
    return mosaic.lowpass9(fx.mosaic(spark, d), "v", TAPS, "y").select(*AT, F.round("v", 5).alias("v"))


@query(
    "local_stats9",
    "SELECT photo_id, y, x, round(avg(v) OVER w, 4) AS mean9, round(var_samp(v) OVER w, 1) AS var9, round(avg((v - o) * (v - o)) OVER w, 1) AS rest9 FROM (SELECT *, v * 0.9 AS o FROM mosaic) WINDOW w AS (PARTITION BY photo_id, y ORDER BY x ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)",
    "mosaic",
)
def local_stats9(spark: SparkSession, d: str) -> DataFrame:
    s = mosaic.local_stats9(fx.mosaic(spark, d).withColumn("o", F.col("v") * 0.9), "v", "o", "x")
    return s.select(*AT, F.round("mean9", 4).alias("mean9"), F.round("var9", 1).alias("var9"), F.round("rest9", 1).alias("rest9"))


@query("estimate_wb")
def estimate_wb(spark: SparkSession, d: str) -> DataFrame:
    """A grid search; the tests hold it against a finer one."""
    photos = _cells(spark, d).select("photo_id").distinct()
    return merge.estimate_wb(photos, MATRIX, CAM, PRE)


@query("estimate_wb_by_camera")
def estimate_wb_by_camera(spark: SparkSession, d: str) -> DataFrame:
    """Each file's estimate, by the matrix of its camera and its own multipliers; the tests hold it against a fine grid."""
    f = fx.files(spark, d)
    k, model = F.col("cust_key"), F.length("camera_model") / 100.0
    matrix = F.array(*[F.array(*[F.lit(v) + (model if i == j else -model / 2) for j, v in enumerate(row)]) for i, row in enumerate(MATRIX)])
    mults = F.array(CAM[0] + (k % 10) / 20.0, F.lit(float(CAM[1])), CAM[2] + (k % 7) / 20.0)
    photos = f.select(k.alias("photo_id"), matrix.alias("matrix"), mults.alias("cam_mul"), F.array(*[F.lit(float(v)) for v in PRE]).alias("pre_mul"))
    return merge.estimate_wb_by_camera(photos)


@query(
    "thumb_states",
    "SELECT n_nationkey AS photo_id, CASE WHEN h IS NULL THEN -1 WHEN n_regionkey = 1 THEN 0 ELSE 1 END AS status FROM nation LEFT JOIN (SELECT photo_id, max(y) + 1 AS h FROM cells GROUP BY 1) ON photo_id = n_nationkey",
    "cells",
)
def thumb_states(spark: SparkSession, d: str) -> DataFrame:
    """All three states: photos without cells have no thumbnail, edited ones a stale one, others theirs."""
    from ..functions.catalog import thumb_status as status
    from ..operators.params import mark_edited

    n = fx.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("photo_id"), "n_regionkey")
    sized = n.join(grid.extents(_cells(spark, d)).select("photo_id", "height", "width"), "photo_id", "left")
    fresh = sized.select("photo_id", "n_regionkey", status(F.coalesce("height", F.lit(0)), F.coalesce("width", F.lit(0))).alias("thumb_written"))
    photos = fresh.withColumns({"big_thumb_written": F.col("thumb_written"), "last_processed_time": F.lit(0).cast("long")})
    queue = photos.select("photo_id", F.lit(False).alias("processed"), F.lit(False).alias("exported"))
    edited, _ = mark_edited(photos, queue, photos.where("n_regionkey = 1 AND thumb_written = 1"), 9)
    return edited.select("photo_id", F.col("thumb_written").alias("status"))
