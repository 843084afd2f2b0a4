"""Document fingerprints from closed syncmers.

A k-mer of characters is a closed syncmer if the smallest of its inner substrings lies at its start or its end. This
depends on the k-mer alone, so an edit elsewhere leaves the others in place: they are anchors. A fingerprint keeps
the anchors whose hashes lie below a limit, with their places: all of them, unless a share of a long text's anchors is
asked for. An anchor that stands at several places is kept at each. Two fingerprints are compared below the lower of
their limits.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts

K = 16
INNER = 5
#: Share of a text's anchors that its fingerprint keeps (1: all), and anchors that it keeps at least, where it has them.
FRACTION = 1.0
LEAST = 256
#: Characters of results that are handed back at once, about.
CHARS_OUT = 16_000_000
#: Characters of a text that are hashed at once.
CHARS_AT_ONCE = 1 << 16


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal inputs, equal outputs; bits spread."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def windows(codes: np.ndarray, width: int) -> np.ndarray:
    """A polynomial hash of each substring of so many characters."""
    n, h = len(codes) - width + 1, np.zeros(len(codes) - width + 1, "uint64")
    for i in range(width):
        h = h * np.uint64(0x100000001B3) + codes[i : i + n]
    return h


@dataclass(eq=False, slots=True)
class Anchors:
    """Anchors of a text with hashes below ``limit``, by place."""

    hashes: np.ndarray  # 32 bits
    places: np.ndarray
    limit: int

    def shown(self) -> str:
        """Base 64 of the limit, and of hash and place of each anchor, as 32-bit integers."""
        if not len(self.hashes):
            return ""
        table = np.stack([self.hashes.astype("<u4"), self.places.astype("<u4")], axis=1)
        return base64.b64encode(np.uint32(self.limit - 1).astype("<u4").tobytes() + table.tobytes()).decode()


def lowest(hashes: np.ndarray, places: np.ndarray, fraction: float) -> Anchors:
    """Of all anchors in the order of the text those that its fingerprint keeps, by hash: the share below ``fraction``,
    or ``LEAST`` different ones if these are more."""
    if fraction >= 1:
        return Anchors(hashes, places, 1 << 32)
    found = np.unique(hashes)
    limit = 1 << 32 if len(found) <= LEAST else max(int(fraction * (1 << 32)), int(found[LEAST - 1]) + 1)
    kept = hashes < limit
    return Anchors(hashes[kept], places[kept], limit)


def anchors(text: str, fraction: float = FRACTION) -> Anchors:
    """The anchors of a whole text that its fingerprint keeps.

    A text without a syncmer, such as one shorter than a k-mer, is one anchor by itself; an empty one has none.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype("uint64")
    if not len(codes):
        return Anchors(np.zeros(0, "uint32"), np.zeros(0, "int64"), 1 << 32)
    span = K - INNER + 1
    hashes, places = [np.zeros(0, "uint32")], [np.zeros(0, "int64")]
    for at in range(0, len(codes) - K + 1, CHARS_AT_ONCE):
        part = codes[at : at + CHARS_AT_ONCE + K - 1]
        inner = mixed(windows(part, INNER))
        least, width = inner, 1
        while width < span:  # the minimum over ever wider windows
            step = min(width, span - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        n = len(least)
        chosen = np.flatnonzero((inner[:n] == least) | (inner[span - 1 : span - 1 + n] == least))
        h = np.zeros(len(chosen), "uint64")
        for offset in (0, INNER, 2 * INNER, span - 1):  # these inner substrings cover the k-mer
            h = h * np.uint64(0x9E3779B97F4A7C15) + inner[chosen + offset]
        hashes.append((mixed(h) >> np.uint64(32)).astype("uint32"))
        places.append(chosen + at)
    every = np.concatenate(hashes)
    if not len(every):
        return Anchors((mixed(windows(codes, len(codes))) >> np.uint64(32)).astype("uint32"), np.zeros(1, "int64"), 1 << 32)
    return lowest(every, np.concatenate(places), fraction)


def numbered(hashes: np.ndarray) -> np.ndarray:
    """Each hash with the number of equal ones before it, as one key: the r-th of one text can only meet the r-th of another."""
    order = np.argsort(hashes, kind="stable")
    first = np.searchsorted(hashes[order], hashes[order])
    keys = np.empty(len(hashes), "uint64")
    keys[order] = hashes[order].astype("uint64") << np.uint64(32) | (np.arange(len(hashes)) - first).astype("uint64")
    return keys


def matched(a: Anchors, b: Anchors) -> tuple[np.ndarray, np.ndarray, int]:
    """Places in a and b of the longest run of common anchors that stand in one order in both, and the number of all
    anchors of the two below the lower limit. Of a repeated anchor the r-th in a is held against the r-th in b."""
    limit = min(a.limit, b.limit)
    x, y = (np.flatnonzero(z.hashes < limit) if z.limit > limit else np.arange(len(z.hashes)) for z in (a, b))
    _, i, j = np.intersect1d(numbered(a.hashes[x]), numbered(b.hashes[y]), assume_unique=True, return_indices=True)
    order = np.argsort(i)
    i, j = x[i[order]], y[j[order]]
    total = len(x) + len(y) - len(i)
    if len(j) > 1 and (np.diff(j) < 0).any():
        run = rising(j.tolist())
        i, j = i[run], j[run]
    return a.places[i], b.places[j], total


def rising(values: list[int]) -> list[int]:
    """Places of a longest rising run of distinct values."""
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for n, value in enumerate(values):
        at = bisect_left(tails, value)
        before.append(ends[at - 1] if at else -1)
        tails[at : at + 1], ends[at : at + 1] = [value], [n]
    out, n = [], ends[-1]
    while n >= 0:
        out.append(n)
        n = before[n]
    return out[::-1]


def likeness(a: Anchors, b: Anchors) -> float:
    """About the share of two texts that is alike and in the same order, from 0 to 1.

    Anchors of both, matched by their places in one order, give the share J of all; 2J/(1+J) is the share of a text.
    Two empty texts are alike.
    """
    if not len(a.hashes) or not len(b.hashes):
        return float(len(a.hashes) == len(b.hashes))
    own, _, total = matched(a, b)
    j = len(own) / total
    return 2 * j / (1 + j)


def fingerprints(docs: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """``doc_id, fingerprint`` of every whole text; equal texts have equal ones.

    ``fraction`` 1 keeps all anchors, repeated ones with each of their places. Null or empty text: an empty fingerprint. Very long texts: the number of anchors
    grows with them. Null ids and repeated rows: rows of their own. Empty table: no rows. No shuffle.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([anchors(x.as_py(), fraction).shown() for x in batch.column("text")], pa.string())], ["doc_id", "fingerprint"])

    return map_batches(texts(docs), work, "doc_id long, fingerprint string")


def edited_text(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


#: Rows of a range of documents, about, and ranges at most.
RANGE_ROWS = 2000
MOST_RANGES = 100_000


def in_ranges(docs: DataFrame) -> tuple[DataFrame, int]:
    """``doc_id, text, _range, _ahead``, dealt by ``_range`` and sorted by (doc_id, text hash) in each.

    After its own rows each range has a copy of the next range's first row (``_ahead``), the last range one of the
    first's. So every row finds the one that follows it in its own task, and texts are shuffled once. The bounds of
    the ranges, one id and hash each, are all that the driver sees.
    """
    rows = texts(docs).withColumns({"_id": F.coalesce("doc_id", F.lit(-(1 << 63))), "_h": F.xxhash64("text")})
    count = docs.count()
    ranges = int(min(MOST_RANGES, max(1, count // RANGE_ROWS)))
    dealt = rows.select("_id", "_h").repartitionByRange(ranges, "_id", "_h")
    bounds = dealt.groupBy(F.spark_partition_id().alias("_part")).agg(F.min(F.struct("_id", "_h")).alias("start"))
    starts = sorted((r["start"]["_id"], r["start"]["_h"]) for r in bounds.select("start").collect())

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        def of(key: tuple[int, int]) -> list[int]:
            at = bisect_right(starts, key) - 1
            return [at, (at - 1) % len(starts)] if starts[at] == key else [at]

        return pd.Series([of(x) for x in zip(ids.tolist(), hashes.tolist(), strict=True)])

    placed = rows.withColumn("_places", places("_id", "_h")).select("doc_id", "text", "_id", "_h", F.posexplode("_places").alias("_ahead", "_range"))
    return placed.repartitionById(max(1, len(starts)), F.col("_range")).sortWithinPartitions("_range", "_ahead", "_id", "_h"), len(starts)


def against_edits(docs: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document.

    ``doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next``; the next document by
    (doc_id, text hash), null ids first; after the last one comes the first. Null or empty text: empty, like other
    empty ones. Very long texts: all their anchors count. Columns with other names aren't read. Repeated rows follow each other. One row: it follows itself. Empty table: no rows.
    """
    rows, _ = in_ranges(docs)
    schema = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, out, held = None, [[] for _ in names], 0
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())

        def handed() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)
            for column in out:
                column.clear()
            return made

        for batch in batches:
            for doc, text, place, ahead in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "_range", "_ahead")), strict=True):
                own = anchors(text, fraction)
                if last is not None and last[0] == place:
                    _, d, t, fp = last
                    edited = edited_text(t, text)
                    changed = anchors(edited, fraction)
                    row = (d, len(t), edited, fp.shown(), changed.shown(), likeness(fp, changed), likeness(fp, own))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    held += len(edited) + len(row[3]) + len(row[4])
                    if held >= CHARS_OUT:
                        yield handed()
                        held = 0
                last = None if ahead else (place, doc, text, own)
        if out[0]:
            yield handed()

    return rows.select("doc_id", "text", "_range", "_ahead").mapInArrow(run, schema)
