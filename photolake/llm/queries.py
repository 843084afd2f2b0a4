"""The queries of this package: each applies one operator, with production parameters, to its whole table.

The operators return texts, spans, ids or files; the queries derive short digests from these.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, common, hmm, line_dedup, orc_store, packing, prefix_trie, quality, secrets, sentence_pieces, simhash, syncmers, whitening, wrappers


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.apply_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, the places of those deleted, and a digest of the text that stays."""
    docs = table(spark, sf_dir, "documents").withColumn("n_lines", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long"))
    cut = line_dedup.dedup_lines(docs, runs=True)
    return cut.select(
        "doc_id",
        "n_lines",
        F.size("removed").cast("long").alias("n_removed"),
        F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    pieces = packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "used")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return linked.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda m: m["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secrets.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        secrets.listed(F.concat("base", "added")).alias("spans"),
    )


def op7_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch_path(spark, "orc-tokens")
    orc_store.write_tokens(table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"), end_id=0)

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens = batch.column("tokens")
        ends, values = tokens.offsets.to_numpy(), tokens.values.to_numpy()
        sums = [zlib.crc32(values[i:j].astype("<u4").tobytes()) for i, j in zip(ends, ends[1:], strict=False)]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
        )

    return common.map_batches(orc_store.read_tokens(spark, path), digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentence_pieces.encode_decode(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
    return coded.select("doc_id", "n_tokens", "by_library", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op9_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = syncmers.against_edits(table(spark, sf_dir, "documents"))
    return held.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).drop("edited")


def op10_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"))


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold the template's own marks."""
    said = "\\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    path = vocabulary("byte_bpe_50k.json")
    return chat.read_back(chat.format_conversations(rows, path), path)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_line_dedup": op2_line_dedup,
        "op3_packing": op3_packing,
        "op4_simhash": op4_simhash,
        "op5_html": op5_html,
        "op6_secrets": op6_secrets,
        "op7_orc_tokens": op7_orc_tokens,
        "op8_sentencepiece": op8_sentencepiece,
        "op9_syncmers": op9_syncmers,
        "op10_hmm": op10_hmm,
        "op11_chat": op11_chat,
        "op12_whitening": op12_whitening,
        "op13_prefix_trie": op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality": quality.oracle(), "op11_chat": chat.oracle(), "op13_prefix_trie": prefix_trie.oracle()}
