"""What several corpus operators share: the shared folder and Arrow helpers.

All operators read only the columns that they name, so extra columns, also with clashing names,
never reach them. A null text counts as an empty one.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that end a word: space and \t \n \v \f \r.
SPACES = "\\x20\\x09-\\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none and all is one machine."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new place in the shared folder for a table that cuts the lineage."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written once in the shared folder and read back: lost executors cost no second computation."""
    path = scratch_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with an empty text for null."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def whole_row(docs: DataFrame) -> Column:
    """All columns of a row as one struct ``_doc``, so that no name in it can clash with a new one."""
    return F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns]).alias("_doc")


def row_columns(docs: DataFrame, **new: Column) -> list[Column]:
    """The columns of ``docs`` out of ``_doc``, but those that are given anew."""
    return [new[c].alias(c) if c in new else F.col("_doc").getField(c).alias(c) for c in docs.columns]


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``work`` on each Arrow batch of ``df``; it returns one batch or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (made := work(batch)) is not None:
                yield made

    return df.mapInArrow(run, schema)
