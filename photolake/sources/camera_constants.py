"""Camera constants from JSON with comments: fields that are a scalar or an array become arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def many(field: Column) -> Column:
    """The text of a JSON value as an array of texts: an array's members, or the scalar alone."""
    return F.when(field.startswith("["), F.from_json(field, "array<string>")).when(field.isNotNull(), F.array(field))


#: A string of JSON, which is kept, or a comment, which isn't: whichever begins first, so neither is looked for inside the other.
STRING_OR_COMMENT = r'(?s)("[^"\\]*+(?:\\.[^"\\]*+)*+")|/\*.*?\*/|//[^\r\n]*+'


def without_comments(text: Column | str) -> Column:
    """JSON without its comments of both kinds; what looks like one inside a string stays."""
    return F.regexp_replace(text, STRING_OR_COMMENT, "$1")


def parse_constants(texts: DataFrame, column: str = "value") -> DataFrame:
    """One row for each (make_model, iso, entry, white) of constants held as whole texts.

    ``entry`` is the place in the file. A scalar white level holds for every ISO (null).
    """
    plain = without_comments(column)
    entries = texts.select(F.posexplode(F.from_json(F.get_json_object(plain, "$.camera_constants"), "array<string>")).alias("entry", "e"))
    get = lambda p: F.get_json_object("e", p)
    models = entries.select("entry", "e", F.explode(many(get("$.make_model"))).alias("make_model"))
    levels = models.select("entry", "make_model", get("$.ranges.white").alias("w"))
    flat = levels.where(~F.col("w").startswith("[")).select("make_model", F.lit(None).cast("int").alias("iso"), "entry", F.col("w").cast("double").alias("white"))
    ranges = levels.where(F.col("w").startswith("[")).select("entry", "make_model", F.explode(F.from_json("w", "array<string>")).alias("r"))
    field = lambda p: F.get_json_object("r", p)
    iso = ranges.select("entry", "make_model", "r", F.explode(many(field("$.iso"))).alias("iso"))
    by_iso = iso.select("make_model", F.col("iso").cast("int").alias("iso"), "entry", F.explode(many(field("$.levels"))).alias("white"))
    return flat.unionByName(by_iso.withColumn("white", F.col("white").cast("double")))


def read_camera_constants(spark: SparkSession, path: str) -> DataFrame:
    return parse_constants(spark.read.text(path, wholetext=True))
