"""From raw documents to packed training sequences, in five stages.

Each stage works on all that the one before kept, and is written as Parquet and read again: a lost executor costs
at most the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photolake.llm import common, line_dedup, packing, quality, queries, secrets, similar


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the threshold table reject go.

    Null and empty texts go; very long ones are judged whole. A value that equals a threshold passes. Null ids and
    repeated rows are rows of their own; all columns stay, whatever their names. Empty table: no rows.
    """
    return quality.kept_documents(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that are aligned with an earlier document's go from the later one's text.

    Null and empty texts stay as they are; very long ones are aligned whole. Ties in id go by text hash, null ids first;
    repeated rows are one document. All columns stay, ``n_chars`` follows the text. Empty table: no rows.
    """
    return line_dedup.without_shared_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays whose five-word shingles are alike by 0.8 or more.

    Null, empty and blank texts are one group; of very long ones all shingles count. The smallest (id, text hash) stays,
    null ids last; of repeated rows one. All columns stay, whatever their names. Empty table: no rows.
    """
    return similar.one_of_each_group(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; all documents stay.

    Null and empty texts stay as they are; very long ones are scanned whole. Overlapping spans become one mark. Null ids
    and repeated rows are rows of their own. All columns stay, ``n_chars`` follows the text. Empty table: no rows.
    """
    return secrets.without_secrets(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with a check sum of their ids.

    A null or empty text is its end id alone; very long ones are cut into pieces. Documents of one length go by their
    hash; null ids stay null, repeated rows are each packed. Other columns aren't read. Empty table: no rows.
    """
    return queries.packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

#: SQL can't express the alignment, the link components or the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = common.scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
