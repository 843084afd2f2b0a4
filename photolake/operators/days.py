"""Photos by local day."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.catalog import col, local_day


def date_histogram(photos: DataFrame, tz: int = 0, min_rating: int = 0, max_rating: int = 5) -> DataFrame:
    """``day, thecount``. Ratings are looked at only if they are narrowed, so the default counts marked photos too."""
    if min_rating > 0 or max_rating < 5:
        photos = photos.where(F.col("rating").between(min_rating, max_rating))
    return photos.groupBy(local_day("capture_time", tz).alias("day")).agg(F.count("*").alias("thecount"))


def densify_days(hist: DataFrame, photos: DataFrame, tz: int, today: datetime.date) -> DataFrame:
    """Every day between the first and the last photo and today, with labels; 0 for days without photos.

    First and last day ignore the rating filter. They are one row; the days between them are counted by the span.
    """
    now = F.lit(today)
    day = local_day("capture_time", tz)
    span = photos.agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    days = span.select(F.explode(F.sequence(F.least(F.coalesce("lo", now), now), F.greatest(F.coalesce("hi", now), now))).alias("day"))
    return with_labels(days.join(hist, "day", "left").withColumn("thecount", F.coalesce("thecount", F.lit(0))))


def with_labels(days: DataFrame) -> DataFrame:
    d = F.col("day")
    labels = {"thedate": "yyyy/MM/dd", "yearmonth": "yyyy/MM", "themonth": "MM", "theday": "dd"}
    return days.withColumns({"julday": (F.unix_date(d) + 2440588).cast("long")} | {k: F.date_format(d, p) for k, p in labels.items()})


def range_from_anchor(anchor: Column | str, other: Column | str) -> tuple[Column, Column]:
    """Start and end of a range that is spanned from an anchor day, in either direction."""
    return F.least(col(anchor), col(other)), F.greatest(col(anchor), col(other))


def step_days(day: Column | str, n: int, today: datetime.date) -> Column:
    """A day moved by so many days, but not beyond today."""
    return F.least(F.date_add(col(day), n), F.lit(today))


def mark_selected(hist: DataFrame, lo: datetime.date, hi: datetime.date) -> DataFrame:
    return hist.withColumn("selected", F.col("day").between(F.lit(lo), F.lit(hi)))
