"""Column functions of the photo catalog.

Times are whole unix seconds; zones are whole hours. Dates are counted in days, so no session time zone matters.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def seconds_of(ts: Column | str) -> Column:
    """Unix seconds, rounded down, of a timestamp without zone."""
    return F.floor(F.timestamp_diff("MICROSECOND", F.expr(EPOCH), col(ts)) / F.lit(1_000_000)).cast("long")


def local_day(seconds: Column | str, tz: int = 0) -> Column:
    """Civil date at an offset of whole hours."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor((col(seconds) + tz * 3600) / 86400).cast("int"))


def local_time(seconds: Column | str, tz: int = 0) -> Column:
    return F.expr(EPOCH) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (col(seconds) + tz * 3600).cast("decimal(18,6)"))


def day_bounds(first: Column | str, last: Column | str, tz: int) -> tuple[Column, Column]:
    """First and last unix second of a range of local days."""
    return (F.unix_date(col(first)) * 86400 - tz * 3600).cast("long"), (F.unix_date(col(last)) * 86400 - tz * 3600 + 86399).cast("long")


def bar_height(n: Column | str) -> Column:
    n = col(n)
    return F.when(n > 0, F.least(F.lit(1.0), (F.ln(n) + 1) / 16)).otherwise(F.lit(0.0))


def is_edited(imported: Column | str, processed: Column | str) -> Column:
    return col(imported) < col(processed) - 1


def file_id_of(photo_id: Column | str) -> Column:
    return F.substring(col(photo_id), 1, 32)


def photo_id_of(file_id: Column | str, number: Column | str) -> Column:
    """The file's id and at least four digits."""
    return F.format_string("%s%04d", col(file_id), col(number))


def with_shard(photo_id: Column | str) -> Column:
    return F.substring(col(photo_id), 1, 4)


def output_name(names: Column | str) -> Column:
    """The first input's name without extension, ``-HDR`` for several inputs, and ``-output``."""
    names = col(names)
    stem = F.regexp_replace(F.element_at(names, 1), r"\.[^.]*$", "")
    return F.concat(stem, F.when(F.size(names) != 1, "-HDR").otherwise(""), F.lit("-output"))


def thumb_status(rows: Column | str, cols: Column | str) -> Column:
    return F.when((col(rows) == 0) | (col(cols) == 0), -1).otherwise(1)


def clamp_rating(r: Column | str) -> Column:
    return F.least(F.lit(5), F.greatest(F.lit(-6), col(r)))


def bump_rating(r: Column | str, change: Column | int) -> Column:
    """A marked photo stays so unless the change is positive; falling below 0 marks it."""
    r, d = col(r), F.lit(change) if isinstance(change, int) else change
    marked = F.when(d > 0, -1 + d).otherwise(r)
    return clamp_rating(F.when(r < 0, marked).when(r + d < 0, -1).otherwise(r + d))


def toggle_mark(r: Column | str) -> Column:
    return -1 - col(r)


def time_label(seconds: Column | str, tz: int = 0) -> Column:
    return F.date_format(local_time(seconds, tz), "EEE yyyy-MM-dd HH:mm:ss")


def exif_text(seconds: Column | str, tz: int = 0) -> Column:
    return F.date_format(local_time(seconds, tz), "yyyy:MM:dd HH:mm:ss")


def capture_time(primary: Column | str, fallback: Column | str, tz_seconds: int) -> Column:
    """Unix seconds of the first time text that isn't empty, read as local time at an offset in seconds."""
    text = F.coalesce(F.nullif(col(primary), F.lit("")), col(fallback))
    return seconds_of(F.to_timestamp_ntz(text, F.lit("yyyy:MM:dd HH:mm:ss"))) - tz_seconds


def dest_path(seconds: Column | str, import_tz: int, pattern: str = "/yyyy/MM/yyyy-MM-dd/") -> Column:
    """Folder for a photo by its capture time in the zone of the import, in hours; a slash is put at the end if missing.

    The capture time is in unix seconds: the camera's zone belongs to ``capture_time``, which reads it.
    """
    if not pattern.endswith("/"):
        pattern += "/"
    return F.date_format(local_time(seconds, import_tz), pattern)


def _divisors(n: int) -> list[int]:
    return [d for d in range(1, n + 1) if n % d == 0]


def gcd_with(n: Column, fixed: int) -> Column:
    """Greatest common divisor of a whole number and a constant, from the constant's divisors."""
    return F.coalesce(F.array_max(F.filter(F.array(*map(F.lit, _divisors(fixed))), lambda d: n % d == 0)), F.lit(1))


def gcd(a: Column | str, b: Column | str) -> Column:
    """Greatest common divisor of any two whole numbers: Euclid's steps, folded over a list that is long enough.

    Each two steps halve the larger number, so 93 steps do for 64 bits.
    """
    start = F.struct(F.abs(col(a)).cast("long").alias("a"), F.abs(col(b)).cast("long").alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.nullif(s["b"], F.lit(0))).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(93)), start, step, lambda s: s["a"])


def shutter_fraction(t: Column | str) -> Column:
    """``n/d`` for a shutter time: the better of round(t*6000)/6000 and 6000/round(6000/t) after reduction.

    The error is abs(d/(t*n) - 1), which is inverted but decides the result; ties go to the second.
    """
    t = col(t).cast("double")
    a_n, b_d = F.round(t * 6000).cast("long"), F.round(F.try_divide(F.lit(6000.0), t)).cast("long")
    ga, gb = gcd_with(a_n, 6000), gcd_with(b_d, 6000)
    n1, d1 = (a_n / ga).cast("long"), (F.lit(6000) / ga).cast("long")
    n2, d2 = (F.lit(6000) / gb).cast("long"), (b_d / gb).cast("long")
    error = lambda n, d: F.coalesce(F.abs(F.try_divide(d.cast("double"), t * n) - 1), F.lit(math.inf))
    first = error(n1, d1) < error(n2, d2)
    text = lambda n, d: F.concat_ws("/", n.cast("string"), d.cast("string"))
    return F.when(t == 0, "0/1").otherwise(F.when(first, text(n1, d1)).otherwise(text(n2, d2)))


def rational100(v: Column | str) -> Column:
    """``n/d`` over a hundred, reduced; below 0.01 ``0/1``."""
    v = col(v).cast("double")
    n = F.round(v * 100).cast("long")
    g = gcd_with(n, 100)
    return F.when(v < 0.01, "0/1").otherwise(F.concat_ws("/", (n / g).cast("long").cast("string"), (F.lit(100) / g).cast("long").cast("string")))


def _plain(x: Column, decimals: int) -> Column:
    return F.format_string(f"%.{decimals}f", x)


def shutter_label(text: Column | str) -> Column:
    """Above half a second one decimal, below a tenth ``1/n``, else the fraction itself."""
    text = col(text)
    parts = F.split(text, "/")
    n, d = F.get(parts, 0).try_cast("double"), F.get(parts, 1).try_cast("double")
    t = F.try_divide(n, d)
    return F.when(t.isNull() | (F.size(parts) != 2), text).when(t > 0.5, _plain(t, 1)).when((t > 0) & (t < 0.1), F.concat(F.lit("1/"), F.round(F.try_divide(F.lit(1.0), t)).cast("long").cast("string"))).otherwise(text)


def aperture_label(f: Column | str) -> Column:
    f = col(f)
    return F.when(f >= 8, _plain(f, 0)).otherwise(_plain(f, 1))


def quarter_turns(code: Column | str, cr3: Column | bool = False) -> Column:
    code = col(code)
    flip = F.lit(cr3) if isinstance(cr3, bool) else cr3
    old = F.when(code == 3, 2).when(code == 6, 3).when(code == 8, 1).otherwise(0)
    new = F.when(code == 3, 2).when(code == 5, 1).when(code == 6, 3).otherwise(0)
    return F.when(flip, new).otherwise(old)


def metadata_rating(make: Column | str, rating: Column | str, cr3: Column | bool = False) -> Column:
    cr3 = F.lit(cr3) if isinstance(cr3, bool) else cr3
    return F.when((col(make) == "Canon") & ~cr3, F.least(F.lit(5), F.greatest(F.lit(0), col(rating)))).otherwise(0)


def lens_name(fields: list[Column | str], cr3: Column | bool = False) -> Column:
    """The first field that isn't empty; the last four of six aren't used for CR3."""
    cr3 = F.lit(cr3) if isinstance(cr3, bool) else cr3
    kept = [F.nullif(col(c), F.lit("")) for c in fields]
    return F.coalesce(*kept[:2], *[F.when(~cr3, c) for c in kept[2:]], F.lit(""))


#: Fixed order of the digits of a name suffix.
SUFFIX_DIGITS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def hash_suffix(file_id: Column | str) -> Column:
    """Seven digits to base 62 from the first seven bytes of a hash; each passes its quotient on."""
    byte = lambda i: F.conv(F.substring(col(file_id), 2 * i + 1, F.lit(2)), 16, 10).cast("int")

    def step(s: Column, i: Column) -> Column:
        v = byte(i) + s["carry"]
        digit = F.substring(F.lit(SUFFIX_DIGITS), v % 62 + 1, F.lit(1))
        return F.struct(F.floor(v / 62).cast("int").alias("carry"), F.concat(s["text"], digit).alias("text"))

    start = F.struct(F.lit(0).alias("carry"), F.lit("").alias("text"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(6)), start, step, lambda s: s["text"])


def suffixed_name(name: Column | str, file_id: Column | str) -> Column:
    """An underscore and the suffix between the stem and the extension of four characters."""
    name = col(name)
    return F.concat(F.substring(name, F.lit(1), F.length(name) - 4), F.lit("_"), hash_suffix(file_id), F.substring(name, F.length(name) - 3, F.lit(4)))


def turn(r: Column | str, right: bool) -> Column:
    return F.pmod(col(r) + (-1 if right else 1), F.lit(4))
