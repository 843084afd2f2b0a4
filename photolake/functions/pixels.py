"""Column functions on linear values of cells: 0..65535 before the film step, a density after it.

All are expressions over ``r, g, b``, so they add nothing but a projection. Values are clamped before they are cast.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .catalog import col

TOP = 65535.0
#: Scale from linear values to exposed crystals.
CRYSTAL_SCALE = 0.00015387105
Triple = tuple[Column, Column, Column]


def clamp(x: Column, low: float = 0.0, high: float = TOP) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def trunc(x: Column) -> Column:
    """Towards zero, of a value that fits."""
    return x.cast("int")


def pattern_at(pattern: Sequence[Sequence[float]], y: Column | str = "y", x: Column | str = "x") -> Column:
    """The value of a small block that repeats over the image."""
    rows = F.array(*[F.array(*map(F.lit, r)) for r in pattern])
    return F.get(F.get(rows, (col(y) % len(pattern)).cast("int")), (col(x) % len(pattern[0])).cast("int"))


def subtract_black(v: Column | str, black: float, block: Sequence[Sequence[float]] = ((0.0,),)) -> Column:
    return col(v) - (F.lit(black) + pattern_at(block))


def normalise(v: Column | str, multipliers: Sequence[float], cfa: Sequence[Sequence[int]], top: Column | float) -> Column:
    """A mosaic value times the multiplier of its colour, scaled so that the sensor's top is 65535."""
    factor = pattern_at([[multipliers[c] for c in row] for row in cfa])
    return col(v) * factor * (F.lit(TOP) / (F.lit(top) if isinstance(top, (int, float)) else top))


def normalise_colour(rgb: Triple, top: Column | float, multipliers: Sequence[float] = (1.0, 1.0, 1.0)) -> Triple:
    """Cells that have all three colours: each times its multiplier, scaled as a mosaic. Leave the multipliers out for
    a table that has them applied already."""
    scale = F.lit(TOP) / (F.lit(top) if isinstance(top, (int, float)) else top)
    return tuple(v * scale * m for v, m in zip(rgb, multipliers, strict=True))


def normalise_mono(v: Column | str, top: Column | float) -> Triple:
    """A cell without colour as three equal channels, scaled as a mosaic but never multiplied."""
    return normalise_colour((col(v),) * 3, top)


def clip(v: Column | str) -> Column:
    return F.least(col(v), F.lit(TOP))


def locus_x(t: Column) -> Column:
    """Chromaticity x of a colour temperature: piecewise cubics in 1000/t; a break belongs to the upper piece."""
    k = F.lit(1000.0) / t
    return F.when(t < 4000, ((-0.2661239 * k - 0.2343589) * k + 0.8776956) * k + 0.179910).otherwise(((-3.0258469 * k + 2.1070379) * k + 0.2226347) * k + 0.24039)


def locus_y(t: Column, x: Column) -> Column:
    """Chromaticity y of a colour temperature and its x, likewise in x."""
    return (
        F.when(t < 2222, ((-1.10638140 * x - 1.34811020) * x + 2.18555832) * x - 0.20219683)
        .when(t < 4000, ((-0.95494760 * x - 1.37418593) * x + 2.09137015) * x - 0.16748867)
        .otherwise(((3.08175800 * x - 5.87338670) * x + 3.75112997) * x - 0.37001483)
    )


def temp_to_xyz(t: Column | str) -> Triple:
    """Illuminant of a colour temperature, scaled so that its parts are the chromaticities."""
    t = col(t).cast("double")
    x = locus_x(t)
    y = locus_y(t, x)
    return x, y, 1 - x - y


def dot(matrix: Sequence[Sequence[float]], v: Triple) -> Triple:
    return tuple(F.lit(r[0]) * v[0] + F.lit(r[1]) * v[1] + F.lit(r[2]) * v[2] for r in matrix)


#: sRGB to XYZ and back, both for the D50 illuminant.
SRGB_TO_XYZ = ((0.4360747, 0.3850649, 0.1430804), (0.2225045, 0.7168786, 0.0606169), (0.0139322, 0.0971045, 0.7141733))
XYZ_TO_SRGB = ((3.1338561, -1.6168667, -0.4906146), (-0.9787684, 1.9161415, 0.0334540), (0.0719453, -0.2289914, 1.4052427))
WHITE_D50 = (0.964221, 1.0, 0.825211)
#: The illuminant that a known camera's multipliers stand for.
BASE_TEMPERATURE, BASE_TINT = 6594.9982, 0.9864318
IDENTITY = ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0))


def illuminant_rgb(t: Column | str) -> Triple:
    """The illuminant of a temperature in sRGB."""
    return dot(XYZ_TO_SRGB, temp_to_xyz(t))


def base_rgb(t: float) -> list[float]:
    """The illuminant in sRGB of one number of 4000 or more."""
    k = 1000.0 / t
    x = ((-3.0258469 * k + 2.1070379) * k + 0.2226347) * k + 0.24039
    y = ((3.08175800 * x - 5.87338670) * x + 3.75112997) * x - 0.37001483
    return [row[0] * x + row[1] * y + row[2] * (1 - x - y) for row in XYZ_TO_SRGB]


def multipliers_of(light: Triple, tint: Column | str, cam_to_rgb: Sequence[Sequence[float]] = IDENTITY, cam_mul: Sequence[float] = (1, 1, 1), pre_mul: Sequence[float] = (1, 1, 1)) -> Triple:
    """White-balance multipliers for an illuminant and a tint, scaled by their smallest plus 1e-5.

    The camera's and the daylight multipliers are each divided by their smallest. A camera matrix of ones on the
    diagonal, or unit daylight multipliers, say that the camera isn't known: then the base is 5200 K at tint 1.
    """
    cam, pre = ([x / min(m) for x in m] for m in (cam_mul, pre_mul))
    if all(cam_to_rgb[i][i] == 1 for i in range(3)) or all(x == 1 for x in pre):
        base, base_tint, offset = base_rgb(5200.0), 1.0, (1.0, 1.0, 1.0)
    else:
        ratio = [p / c for p, c in zip(pre, cam, strict=True)]
        offset = [sum(m * x / min(ratio) for m, x in zip(row, ratio, strict=True)) for row in cam_to_rgb]
        base, base_tint = base_rgb(BASE_TEMPERATURE), BASE_TINT
    tinted = (light[0], light[1] / col(tint), light[2])
    over = (base[0], base[1] / base_tint, base[2])
    found = [F.greatest(F.lit(b) / x, F.lit(0.0)) * o for b, x, o in zip(over, tinted, offset, strict=True)]
    least = F.least(*found) + 1e-5
    return tuple(x / least for x in found)


def wb_multipliers(t: Column | str, tint: Column | str, *camera: Sequence) -> Triple:
    """``multipliers_of`` the illuminant of a temperature; ``camera``: its matrix, and its two sets of multipliers."""
    return multipliers_of(illuminant_rgb(t), tint, *camera)


def apply_wb(rgb: Triple, matrix: Sequence[Sequence[float]], mults: Triple, exposure: Column | float) -> Triple:
    """The colour matrix, each row scaled by 2^exposure and its multiplier, not below 0."""
    gain = F.pow(F.lit(2.0), F.lit(exposure) if isinstance(exposure, (int, float)) else exposure)
    return tuple(F.greatest(F.lit(0.0), v * gain * m) for v, m in zip(dot(matrix, rgb), mults, strict=True))


def expose(x: Column | str, crystals: float, rolloff: float, toe: float) -> Column:
    """Exposed crystals: a toe, a rolloff above its boundary, and the crystal scale. Boundaries are clamped first."""
    rolloff = max(1.0, min(65534.0, rolloff))
    toe = max(0.0, min(toe, rolloff / 2))
    bend, room = rolloff - toe, TOP - toe - (rolloff - toe)
    x = F.greatest(F.lit(0.0), col(x))
    lifted = F.greatest(F.lit(0.0), x - toe + toe * toe / (x + toe + 1 / TOP))
    return F.when(lifted > bend, TOP - room * room / (lifted + (room - bend))).otherwise(lifted) * (crystals * CRYSTAL_SCALE)


def density(radius: Column | str, crystals: Column | str) -> Column:
    return col(radius) * col(radius) * col(crystals)


def white_black(x: Column | str, black: float, white: float) -> Column:
    return trunc(clamp((col(x) - black) * (TOP / white)))


def tonecurve(x: Column | str) -> Column:
    """The default curve on 0..1: a quadratic Bézier (0,0), (0.2,1), (1,1), solved for its parameter."""
    x = col(x)
    t = (F.sqrt(F.greatest(F.lit(0.0), F.lit(0.04) + 0.6 * x)) - 0.2) / 0.6
    return 2 * t - t * t


def shadows_highlights(x: Column | str, sx: float, sy: float, hx: float, hy: float) -> Column:
    """A cubic Bézier (0,0), (sx,sy), (hx,hy), (1,1) on 0..1; five Newton steps from t = x, each kept in 0..1."""
    x = col(x)
    cubic = lambda t, p, q: (((1 + 3 * p - 3 * q) * t + (3 * q - 6 * p)) * t + 3 * p) * t
    slope = lambda t, p, q: (3 * (1 + 3 * p - 3 * q) * t + 2 * (3 * q - 6 * p)) * t + 3 * p
    step = lambda t, _: clamp(t - F.coalesce(F.try_divide(cubic(t, sx, hx) - x, slope(t, sx, hx)), F.lit(0.0)), 0.0, 1.0)
    return cubic(F.aggregate(F.sequence(F.lit(1), F.lit(5)), x.cast("double"), step), sy, hy)


def film_curve(rgb: Triple, curve: Callable[[Column], Column]) -> Triple:
    """A curve on the largest and smallest channel; the middle one keeps its relative place, so the hue stays."""
    top, low = F.greatest(*rgb), F.least(*rgb)
    new_top, new_low = curve(top), curve(low)
    place = lambda v: F.when(top == low, new_top).when(v == top, new_top).when(v == low, new_low).otherwise(new_low + (new_top - new_low) * (v - low) / F.nullif(top - low, F.lit(0)))
    return tuple(trunc(place(v)) for v in rgb)


def to_hsv(rgb: Triple) -> Triple:
    """Hue 0..6 (-1 at black), saturation and value 0..1 of 0..65535."""
    r, g, b = rgb
    top, low = F.greatest(*rgb), F.least(*rgb)
    d = F.nullif((top - low).cast("double"), F.lit(0.0))
    h = F.when(top == 0, -1.0).when(top == low, 0.0).when(r == top, (g - b) / d).when(g == top, 2 + (b - r) / d).otherwise(4 + (r - g) / d)
    s = F.when(top == 0, 0.0).otherwise((top - low) / F.nullif(top.cast("double"), F.lit(0.0)))
    return F.when((h < 0) & (top > 0), h + 6).otherwise(h), s, top / TOP


def from_hsv(hsv: Triple) -> Triple:
    h, s, v = hsv
    i = F.floor(h).cast("int")
    f = h - i
    f = F.when(i % 2 == 0, 1 - f).otherwise(f)
    top, low, mid = v, v * (1 - s), v * (1 - s * f)
    order = {0: (top, mid, low), 1: (mid, top, low), 2: (low, top, mid), 3: (low, mid, top), 4: (mid, low, top), 5: (top, low, mid)}
    out = []
    for c in range(3):
        x = order[0][c]
        for k in range(1, 6):
            x = F.when(i == k, order[k][c]).otherwise(x)
        out.append(F.when(s == 0, v).otherwise(x) * TOP)
    return tuple(out)


def monochrome(rgb: Triple, weights: Sequence[float] = (0.21, 0.78, 0.07)) -> Column:
    return trunc(clamp(sum((F.lit(w) * c for w, c in zip(weights, rgb, strict=True)), F.lit(0.0))))


def to_linear(v: Column | str) -> Column:
    """sRGB to linear, both kept in 0..1."""
    v = clamp(col(v), 0.0, 1.0)
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def to_srgb(v: Column | str) -> Column:
    v = clamp(col(v), 0.0, 1.0)
    return F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)


def to_xyz(rgb: Triple) -> Triple:
    return dot(SRGB_TO_XYZ, rgb)


def from_xyz(xyz: Triple) -> Triple:
    return dot(XYZ_TO_SRGB, xyz)


def to_lab(rgb: Triple) -> Triple:
    """L*a*b* (D50) of linear sRGB 0..1 as whole numbers: L clamped to 0..1 as 0..65535, a and b to -1..1 about 32768."""

    def curve(t: Column) -> Column:
        t = clamp(t, 0.0, 1.0)
        return F.when(t <= 216 / 24389, (F.lit(24389 / 27) * t + 16) / 116).otherwise(F.cbrt(t))

    fx, fy, fz = (curve(v / w) for v, w in zip(to_xyz(rgb), WHITE_D50, strict=True))
    side = lambda v: trunc(32767 * clamp(v, -1.0, 1.0) + 32768)
    return trunc(TOP * clamp(116 * fy - 16, 0.0, 1.0)), side(500 * (fx - fy)), side(200 * (fy - fz))


def uniform_of(*keys: Column | str) -> Column:
    """A number in 0..1 that is fixed by its keys."""
    return F.pmod(F.xxhash64(*map(col, keys)), F.lit(1 << 32)) / float(1 << 32)


def to_8bit(v: Column | str, u: Column | str) -> Column:
    """Eight bits with dither by a uniform number."""
    return trunc(clamp((col(v) + 1) / 256 - 1 + 0.9999 * col(u), 0.0, 255.0))


def from_8bit(v: Column | str, kind: str) -> Column:
    """``jpeg``: by the inverse gamma; ``tiff``: times 257; ``tiff16``: as it is."""
    v = col(v)
    if kind == "jpeg":
        return trunc(to_linear(v / 255.0) * TOP)
    return v * 257 if kind == "tiff" else v


def to_display(v: Column | str) -> Column:
    return F.floor(col(v) / 256).cast("int")


def linear_lut(i: Column | str, slope: float, offset: float, dark: float, bright: float) -> Column:
    return trunc(clamp(slope * col(i) + offset, dark, bright))


