"""Line dedup by pairwise alignment: documents that share a line are aligned by patience diff, and the blocks that
they have in common go from the later one.

Later means after in the order of (doc_id, text hash). A document is aligned with the first document that holds one
of its lines, and, for rare lines, with the last one before it that does; with ``runs`` also with the first one that
holds one of its shortest runs of lines of enough words: every line of a common block lies in such a run, so every
block that any earlier document holds has a partner. What goes is what the alignments say: a block of enough words
goes whole, of a shorter one only the lines that very many documents hold. What an alignment leaves of the later document
is aligned with the same partner again, until it gives no block: so blocks in another order are found too. The pairs
are at most a few for each line of a document, however many documents hold it, and a frequent line costs one pair a document.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, row_columns, whole_row, written
from .quality import WHITE, let

#: Documents that hold a line up to which it counts as rare; longer groups have no window over them.
RARE_DOCUMENTS = 16
#: Words of an aligned block from which it is deleted.
BLOCK_WORDS = 12
#: Documents that hold a line from which it is boilerplate: aligned with an earlier document it goes, however short its block.
FREQUENT_DOCUMENTS = 50


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places of equal lines, rising in both.

    Lines that are once in either part, in the longest run of such lines that rises in both, are fixed; equal
    lines grow from them and from the parts' ends, and the gaps between are aligned the same way.
    """
    out: list[tuple[int, int]] = []
    parts = [(0, len(a), 0, len(b))]
    while parts:
        i, i2, j, j2 = parts.pop()
        while i < i2 and j < j2 and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i2 and j < j2 and a[i2 - 1] == b[j2 - 1]:
            i2, j2 = i2 - 1, j2 - 1
            out.append((i2, j2))
        if i == i2 or j == j2:
            continue
        here, there = Counter(a[i:i2]), Counter(b[j:j2])
        place = {b[k]: k for k in range(j, j2) if there[b[k]] == 1}
        once = [(k, place[a[k]]) for k in range(i, i2) if here[a[k]] == 1 and a[k] in place]
        tails: list[int] = []
        ends: list[int] = []
        before: list[int] = []
        for n, (_, y) in enumerate(once):
            at = bisect_left(tails, y)
            before.append(ends[at - 1] if at else -1)
            tails[at : at + 1], ends[at : at + 1] = [y], [n]
        fixed, n = [], ends[-1] if ends else -1
        while n >= 0:
            fixed.append(once[n])
            n = before[n]
        top_i, top_j = i2, j2
        for x, y in fixed:  # from the last one back
            parts.append((x + 1, top_i, y + 1, top_j))
            out.append((x, y))
            top_i, top_j = x, y
        if fixed:
            parts.append((i, top_i, j, top_j))
    return sorted(out)


def common_lines(a: list[int], a_words: list[int], b: list[int], block_words: int, often: frozenset[int] | set[int] = frozenset()) -> list[int]:
    """Places in ``a`` of aligned blocks, contiguous in both, of at least so many words; of shorter ones the lines of ``often``."""
    out, block, last = [], [], None
    for i, j in [*patience(a, b), (-1, -1)]:
        if last is None or (i, j) != (last[0] + 1, last[1] + 1):
            out += block if sum(a_words[k] for k in block) >= block_words else [k for k in block if a[k] in often]
            block = []
        block.append(i)
        last = (i, j)
    return out


def aligned_lines(a: list[int], a_words: list[int], b: list[int], block_words: int, often: frozenset[int] | set[int] = frozenset()) -> list[int]:
    """``common_lines`` of ``a``, and of the stretches that these leave, each aligned with all of ``b`` again."""
    there, gone, todo = set(b), [], [(0, len(a))]
    while todo:
        lo, hi = todo.pop()
        shared = [k for k in range(lo, hi) if a[k] in there]
        if sum(a_words[k] for k in shared) < block_words and not any(a[k] in often for k in shared):
            continue
        taken = [lo + k for k in common_lines(a[lo:hi], a_words[lo:hi], b, block_words, often)]
        gone += taken
        if taken:
            ends = [lo - 1, *taken, hi]
            todo += [(x + 1, y) for x, y in zip(ends, ends[1:], strict=False) if y - x > 1]
    return sorted(gone)


_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))


def shortest_runs(lines: np.ndarray, words: np.ndarray, offsets: np.ndarray, block_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``start, end, key, document`` of the shortest runs of adjacent lines that reach ``block_words``.

    There is one from every line on and one up to every line, where the document has the words. Lines of a block
    that holds the words lie in such a run inside it. ``offsets`` are the documents' places in ``lines``.
    """
    document = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    place = np.arange(len(lines))
    total = np.concatenate([[0], np.cumsum(words, dtype="int64")])
    end = np.searchsorted(total, total[:-1] + block_words)
    start = np.searchsorted(total, total[1:] - block_words, side="right") - 1
    on, to = end <= offsets[1:][document], start >= offsets[:-1][document]
    start, end = np.concatenate([place[on], start[to]]), np.concatenate([end[on], place[to] + 1])
    power, back = (np.concatenate([[np.uint64(1)], np.full(len(lines), x, "uint64")]).cumprod(dtype="uint64") for x in (_ODD, _INVERSE))
    sums = np.concatenate([np.zeros(1, "uint64"), np.cumsum(lines.view("uint64") * power[:-1], dtype="uint64")])
    key = (sums[end] - sums[start]) * back[start] + (end - start).astype("uint64")
    return start, end, key.view("int64"), np.concatenate([document[on], document[to]])


def sequences(docs: DataFrame) -> DataFrame:
    """``_row`` (the document's place in the order), its ``lines`` as hashes and their ``words``.

    Lines without a word are left out; ``at`` has the others' places in the text. White space around a line doesn't
    count.
    """
    cut = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.struct(F.btrim(x, F.lit(WHITE)).alias("line"), i.alias("at")))
    full = F.filter(cut, lambda x: x["line"] != "")
    words = lambda x: F.size(F.split(x["line"], r"[\x20\x09-\x0D]+"))
    return docs.select(row_key().alias("_row"), full.alias("_full")).select(
        "_row",
        F.transform("_full", lambda x: F.xxhash64(x["line"])).alias("lines"),
        F.transform("_full", words).alias("words"),
        F.transform("_full", lambda x: x["at"]).alias("at"),
    )


def row_key() -> Column:
    """Orders documents; equal for repeated rows, which are one document here."""
    return F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))


def run_holders(seqs: DataFrame, block_words: int) -> DataFrame:
    """``_row, _with``: each document and the first holders of its runs of two lines or more, if they are earlier."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        lines, words = batch.column("lines"), batch.column("words")
        offsets = lines.offsets.to_numpy().astype("int64")
        values = lines.values.to_numpy()[offsets[0] : offsets[-1]]
        counts = words.flatten().to_numpy()
        start, end, key, document = shortest_runs(values, counts, offsets - offsets[0], block_words)
        long = end - start > 1
        kept = np.unique(np.stack([document[long], key[long]], axis=1), axis=0)
        at = pa.array(kept[:, 0])
        return pa.RecordBatch.from_arrays([batch.column("_id").take(at), batch.column("_h").take(at), pa.array(kept[:, 1])], ["_id", "_h", "run"])

    flat = seqs.where(F.size("lines") > 1).select(F.col("_row.id").alias("_id"), F.col("_row.h").alias("_h"), "lines", "words")
    held = map_batches(flat, work, "_id long, _h long, run long").select(F.struct(F.col("_id").alias("id"), F.col("_h").alias("h")).alias("_row"), "run")
    found = written(held.groupBy("run").agg(F.min("_row").alias("first"), F.max("_row").alias("last")).where("first <> last").select("run", "first"), "run-holders")
    return held.join(found, "run").where("_row <> first").select("_row", F.col("first").alias("_with"))


def shared_lines(seqs: DataFrame) -> DataFrame:
    """``_row, line`` of lines that several documents hold, with their number ``n`` and the ``first`` of them."""
    held = seqs.select("_row", F.explode(F.array_distinct("lines")).alias("line"))
    # written, so that the join is no part of the grouping: Spark can then split a line that very many hold
    found = written(held.groupBy("line").agg(F.count("*").alias("n"), F.min("_row").alias("first")).where("n > 1"), "line-holders")
    return written(held.join(found, "line"), "shared-lines")


def pairs(seqs: DataFrame, shared: DataFrame, rare_documents: int = RARE_DOCUMENTS, block_words: int | None = None) -> DataFrame:
    """``_row, _with``: each document and the earlier ones to align it with; the first holders of its runs too where ``block_words`` is given."""
    by_line = Window.partitionBy("line").orderBy("_row")
    rare = shared.where(F.col("n") <= rare_documents).select("_row", F.lag("_row").over(by_line).alias("_with")).where("_with is not null")
    found = shared.where("_row <> first").select("_row", F.col("first").alias("_with")).union(rare)
    return (found if block_words is None else found.union(run_holders(seqs, block_words))).distinct()


def removed_lines(seqs: DataFrame, rare_documents: int = RARE_DOCUMENTS, block_words: int = BLOCK_WORDS, runs: bool = False) -> DataFrame:
    """``_row, removed``: places of the lines to delete, for documents that lose any."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        cut = []
        for a, w, p, b, often in zip(*(batch.column(c).to_pylist() for c in ("lines", "words", "at", "other", "often")), strict=True):
            cut.append([p[k] for k in aligned_lines(a, w, b, block_words, set(often or ()))])
        return pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_h"), pa.array(cut, pa.list_(pa.int32()))], ["_id", "_h", "removed"])

    shared = shared_lines(seqs)
    frequent = shared.where((F.col("n") >= FREQUENT_DOCUMENTS) & (F.col("_row") != F.col("first"))).groupBy("_row").agg(F.collect_set("line").alias("often"))
    both = (
        pairs(seqs, shared, rare_documents, block_words if runs else None)
        .join(seqs.join(frequent, "_row", "left"), "_row")
        .join(seqs.select(F.col("_row").alias("_with"), F.col("lines").alias("other")), "_with")
        .select(F.col("_row.id").alias("_id"), F.col("_row.h").alias("_h"), "lines", "words", "at", "other", "often")
    )
    found = map_batches(both, work, "_id long, _h long, removed array<int>").where(F.size("removed") > 0)
    merged = found.groupBy("_id", "_h").agg(F.array_distinct(F.flatten(F.collect_set("removed"))).alias("removed"))
    return merged.select(F.struct(F.col("_id").alias("id"), F.col("_h").alias("h")).alias("_row"), "removed")


def cut_texts(docs: DataFrame, rare_documents: int = RARE_DOCUMENTS, block_words: int = BLOCK_WORDS, runs: bool = False) -> DataFrame:
    """``_doc`` (the whole row), ``_kept`` (the text that stays) and ``_removed`` (places of deleted lines, ascending)."""
    named = docs.select(whole_row(docs), row_key().alias("_row"))
    seqs = written(sequences(docs).dropDuplicates(["_row"]), "line-sequences")
    cut = removed_lines(seqs, rare_documents, block_words, runs)
    joined = named.join(cut, "_row", "left").select("_doc", F.col("_doc.text").alias("_text"), F.sort_array(F.coalesce("removed", F.array().cast("array<int>"))).alias("_removed"))
    lines = F.split("_text", "\n")
    # a few places are looked up in their array, many in a map
    few = F.filter(lines, lambda x, i: ~F.array_contains("_removed", i))
    gone = F.map_from_arrays("_removed", F.transform("_removed", lambda x: F.lit(True)))
    many = let(gone, lambda g: F.filter(lines, lambda x, i: F.element_at(g, i).isNull()))
    left = F.array_join(F.when(F.size("_removed") <= 32, few).otherwise(many), "\n")
    return joined.select("_doc", F.when(F.size("_removed") == 0, F.col("_text")).otherwise(left).alias("_kept"), "_removed")


def dedup_lines(docs: DataFrame, rare_documents: int = RARE_DOCUMENTS, block_words: int = BLOCK_WORDS, runs: bool = False) -> DataFrame:
    """The columns of ``docs`` with the kept lines as ``text``, and ``removed``: places of deleted lines, ascending.

    An aligned block goes if it holds at least ``block_words`` words; of a shorter one go the lines that
    ``FREQUENT_DOCUMENTS`` or more hold. With ``runs``, a partner is found for every block that any earlier document
    holds. Very long texts are aligned whole. Documents that tie in id go by their text's hash.
    Null or empty text: unchanged, nothing removed. A text whose lines all go becomes empty. Repeated rows (equal id
    and text) are one document: all of them keep what one would keep. A null id comes before all others. Empty
    table: no rows. A column ``removed`` of ``docs`` gives way to the new one.
    """
    made = cut_texts(docs, rare_documents, block_words, runs)
    columns = row_columns(docs, text=F.col("_kept"))
    return made.select(*[c for n, c in zip(docs.columns, columns, strict=True) if n != "removed"], F.col("_removed").alias("removed"))


def without_shared_lines(docs: DataFrame) -> DataFrame:
    """The same rows and columns; ``text`` has the kept lines, and ``n_chars``, if there, their number of characters.

    Null or empty text: unchanged. Very long texts are aligned whole. Repeated rows are one document; documents that tie
    in id go by their text's hash; a null id comes before all others. Columns whose
    names clash with inner ones are kept as they are. Empty table: no rows.
    """
    new = {"text": F.col("_kept"), "n_chars": F.length("_kept").cast("long")}
    return cut_texts(docs, runs=True).select(*row_columns(docs, **new))
