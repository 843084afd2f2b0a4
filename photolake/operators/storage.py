"""Cutting the lineage of jobs in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names; a temporary one only on a local master, where all is one machine."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` stored in the checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written once in the shared folder and read back."""
    path = f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbers_in(spark: SparkSession, folder: str, name: str) -> list[int]:
    """The numbers n of all tables ``<folder>/<name>=<n>`` that were written, told by the names of their files; none is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    try:
        found = files.load(folder).select(F.regexp_extract("path", rf"/{name}=(\d+)/", 1).cast("long").alias("n")).distinct().collect()
    except AnalysisException:
        return []
    return sorted(r.n for r in found)
