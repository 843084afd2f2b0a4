"""Token ids in ORC files: integer run-length encoding, row indexes, and Bloom filters on document ids.

A row is a document; its ids are a list of integers, which ORC stores run-length encoded. Stripes are small enough
that many readers share a file, and each stripe's index and Bloom filter let a reader skip it by document id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import texts, written
from .tokens import encoder

#: Characters of text in a file, about.
FILE_CHARS = 128_000_000
#: Bytes of a stripe, and rows between two entries of its row index.
STRIPE_BYTES = 4 << 20
INDEX_ROWS = 1000
#: Parts up to whose number their places are broadcast (16 bytes each): enough for 100 TB.
BROADCAST_PARTS = 2_000_000
ROW = "doc_id long, part int, start_in_part long, n_tokens int, tokens array<int>"


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int, space_counts: bool = True, file_chars: int = FILE_CHARS) -> None:
    """Encodes all documents whole and writes them at ``path`` in ascending order of ``doc_id``.

    Parts are ranges of (doc_id, text hash), numbered in their order; each row holds its part's number and its place
    there, so no file name or number of files matters. Rows in a part are sorted. Null ids come first. Null or empty
    text: the end id alone. Very long texts: a row of their own like any other. Repeated rows are all written; those
    with one id are ordered by their text's hash. Columns with other names aren't read. Empty table: an empty folder of files.
    """
    rows = texts(docs)
    chars = rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    key = (F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    sorted_rows = rows.repartitionByRange(int(max(1, -(-chars // file_chars))), *key).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, before, part = encoder(vocabulary, space_counts), 0, TaskContext.get().partitionId()
        for batch in batches:
            for at, own, flat in tok.encode_batches(batch.column("text")):
                values = np.insert(flat, np.cumsum(own), end_id).view("<i4")  # the end id after each text
                counts = own + 1
                starts = before + np.cumsum(counts) - counts
                before += int(counts.sum())
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype("int32")
                parts = pa.array(np.full(len(own), part, "int32"))
                tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(own)), parts, pa.array(starts), pa.array(counts.astype("int32")), tokens],
                    ["doc_id", "part", "start_in_part", "n_tokens", "tokens"],
                )

    (
        sorted_rows.mapInArrow(run, ROW)
        .write.option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.row.index.stride", INDEX_ROWS)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.compress", "ZSTD")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, tokens`` of all documents; ``start`` is the number of ids of all before it.

    Files are split by stripes among the readers. A filter on ``doc_id`` is pushed to the files' indexes and Bloom
    filters. Only the totals of the parts, one row for each, are gathered to place the parts one after another; they
    come from two columns, so no token is read for them.
    """
    stored = spark.read.schema(ROW).orc(path)
    ends = stored.groupBy("part").agg(F.sum("n_tokens").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(ends.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("_base")), "part-places")
    if bases.count() <= BROADCAST_PARTS:
        bases = F.broadcast(bases)  # with more parts, Spark joins as it sees fit
    return stored.join(bases, "part").select("doc_id", (F.col("_base") + F.col("start_in_part")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "tokens")


def find_tokens(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """Tokens of a few documents; stripes whose index or Bloom filter rules the ids out aren't read."""
    return spark.read.schema(ROW).orc(path).where(F.col("doc_id").isin(ids)).select("doc_id", "n_tokens", "tokens")
