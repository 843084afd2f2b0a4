"""Near copies by the exact likeness of their word shingles, with candidates from SimHash BK-trees.

Two texts are near copies if the Jaccard likeness of their sets of shingles reaches a bound. At a likeness of 0.8,
fingerprints differ by ten of 64 bits on average, which no blocks of bits can shard: so a shard is the texts that
agree in a band of minimum hashes, and within it a BK-tree finds the pairs within a wide radius. Pairs go that can't
reach the bound by the sizes of their sets in each of 64 parts of the hash space; each that is left is verified on
the whole sets, so no pair is linked wrongly, and none is lost but by the bands and the radius.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, row_columns, texts, whole_row, written
from .components import connected_components
from .simhash import SEED, BKForest, majority, shingle_hashes

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Bands of minimum hashes: a pair of likeness s shares one with probability 1 - (1 - s**BAND_HASHES)**BANDS.
BANDS = 12
BAND_HASHES = 3
#: Bits by which fingerprints of a pair may differ: nearly four deviations above the mean at a likeness of 0.8.
RADIUS = 20
ROWS_AT_ONCE = 200_000
SHINGLES_AT_ONCE = 20_000
PAIRS_AT_ONCE = 200_000
#: Rows of shards whose sets a task holds at once, but for one larger shard.
SETS_AT_ONCE = 20_000

_factors = np.random.default_rng(SEED).integers(0, 1 << 63, (BANDS * BAND_HASHES, 1), "uint64") * np.uint64(2) + np.uint64(1)


def bands(hashes: np.ndarray) -> list[int]:
    """A hash of each band of the set's minimum hashes, signed."""
    least = np.full(len(_factors), (1 << 64) - 1, "uint64")
    for at in range(0, len(hashes), SHINGLES_AT_ONCE):
        np.minimum(least, (hashes[at : at + SHINGLES_AT_ONCE] * _factors).min(axis=1), out=least)
    made = [xxhash.xxh64_intdigest(least[k * BAND_HASHES : (k + 1) * BAND_HASHES].tobytes(), k) for k in range(BANDS)]
    return np.array(made, "uint64").view("int64").tolist()


#: Parts of the hash space whose shingles are counted by text, 16 bits each, packed in long columns.
PARTS = 64
COUNTS = [f"c{i}" for i in range(PARTS // 4)]


def part_counts(hashes: np.ndarray) -> list[int]:
    """Distinct shingles in each part of the hash space, at most 65535 each, packed."""
    counts = np.bincount((hashes >> np.uint64(58)).astype("int64"), minlength=PARTS)
    return np.minimum(counts, 65535).astype("<u2").view("<i8").tolist()


def may_reach(c: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Pairs whose sets may reach the likeness: what both have in common is in each part at most what the smaller has."""
    n, packed = c["n"], np.stack([c[x] for x in COUNTS], axis=1)
    ok = np.minimum(n[a], n[b]) >= similarity * np.maximum(n[a], n[b])
    for at in range(0, len(a), PAIRS_AT_ONCE):
        own = at + np.flatnonzero(ok[at : at + PAIRS_AT_ONCE])
        x, y = (packed[z[own]].view("<u2") for z in (a, b))
        both = np.minimum(x, y).sum(axis=1, dtype="int64")
        ok[own] = (both >= similarity * (n[a[own]] + n[b[own]] - both)) | ((x == 65535) & (y == 65535)).any(axis=1)
    return ok


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets reach the likeness; two empty ones do."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both)


def sketches(docs: DataFrame, shingle_words: int) -> DataFrame:
    """``doc_id, h`` (a hash of the text), ``fp``, ``n`` (distinct shingles), ``bands`` and ``counts`` of every whole text."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps, sizes, keys, counts = [], [], [], []
        for text in batch.column("text"):
            hashes = shingle_hashes(text.as_py(), shingle_words)
            fps.append(majority(hashes))
            distinct = np.unique(hashes)
            sizes.append(len(distinct))
            keys.append(bands(distinct))
            counts.append(part_counts(distinct))
        made = [pa.array(np.array(fps, "uint64").view("int64")), pa.array(sizes, pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in (keys, counts))]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), *made], ["doc_id", "h", "fp", "n", "bands", "counts"])

    return map_batches(texts(docs).withColumn("h", F.xxhash64("text")), work, "doc_id long, h long, fp long, n long, bands array<long>, counts array<long>")


def by_shard(rows: DataFrame, work) -> DataFrame:
    """``a, b`` that ``work`` finds in whole shards: arrays of the columns, sorted by key, fingerprint and text."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for a, b in work(dict(zip(names, held, strict=True))):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        held = [np.zeros(0, "int64") for _ in names]
        key = names.index("key")
        for batch in batches:
            held = [np.concatenate([x, batch.column(c).to_numpy()]) for x, c in zip(held, names, strict=True)]
            if len(held[key]) >= ROWS_AT_ONCE and (cut := int(np.searchsorted(held[key], held[key][-1]))):
                yield from found([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if len(held[key]):
            yield from found(held)

    return rows.repartition("key").sortWithinPartitions("key", "fp", "h").mapInArrow(run, "a long, b long").distinct()


def to_heads(shards: DataFrame, similarity: float) -> DataFrame:
    """Each text beside its neighbour in its shard's order and beside the shard's first one: few pairs, that join most groups."""

    def work(c: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        key, h = c["key"], c["h"]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        head = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))
        own = np.flatnonzero(~fresh)
        for other in (head[own], own - 1):
            ok = may_reach(c, own, other, similarity)
            yield h[own[ok]], h[other[ok]]

    return by_shard(shards, work)


def product(starts: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of members of the groups a and b."""
    n = sizes[a] * sizes[b]
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    wide = np.repeat(sizes[b], n)
    return np.repeat(starts[a], n) + at // wide, np.repeat(starts[b], n) + at % wide


def top(above: np.ndarray, at: int) -> int:
    """The end of a group's way; the way is halved as it is gone."""
    while above[at] != at:
        above[at] = above[above[at]]
        at = above[at]
    return at


def joining(rows: DataFrame, similarity: float, radius: int) -> DataFrame:
    """Links ``a, b`` between groups (column ``root``) of a shard that are near somewhere within the radius.

    Candidates are verified on the whole sets (column ``shingles``) in the shard's task, and only while their groups
    are still two: so a shard gives fewer links than it has groups, however many of its pairs are near.
    """
    longs = ["key", "fp", "h", "n", "root", *COUNTS]

    def found(c: dict[str, np.ndarray], sets: list[np.ndarray]) -> pa.RecordBatch:
        key, fp, h = c["key"], c["fp"], c["h"]
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])]))
        sizes = np.diff(np.concatenate([starts, [len(key)]]))
        own = np.arange(len(starts))
        group = np.unique(c["root"], return_inverse=True)[1]
        above = np.arange(group.max() + 1)  # each group's way to its smallest one
        forest = BKForest(key[starts], fp[starts].view("uint64"))
        links: list[tuple[int, int]] = []

        def hits() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            yield own, own
            yield from forest.links(radius)

        for x, y in hits():
            for at in range(0, len(x), 10_000):
                a, b = product(starts, sizes, x[at : at + 10_000], y[at : at + 10_000])
                while (higher := above[above]).tobytes() != above.tobytes():
                    above[:] = higher
                two = above[group[a]] != above[group[b]]
                a, b = a[two], b[two]
                ok = may_reach(c, a, b, similarity)
                for i, j in zip(a[ok].tolist(), b[ok].tolist(), strict=True):
                    one, other = top(above, group[i]), top(above, group[j])
                    if one != other and similar(sets[i], sets[j], similarity):
                        above[max(one, other)] = min(one, other)
                        links.append((min(h[i], h[j]), max(h[i], h[j])))
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sets = [np.zeros(0, "int64") for _ in longs], []
        for batch in batches:
            held = [np.concatenate([x, batch.column(c).to_numpy()]) for x, c in zip(held, longs, strict=True)]
            sets += [x.values.to_numpy() for x in batch.column("shingles")]
            if len(sets) >= SETS_AT_ONCE and (cut := int(np.searchsorted(held[0], held[0][-1]))):
                yield found(dict(zip(longs, [x[:cut] for x in held], strict=True)), sets[:cut])
                held, sets = [x[cut:] for x in held], sets[cut:]
        if sets:
            yield found(dict(zip(longs, held, strict=True)), sets)

    dealt = rows.select(*longs, "shingles").repartition("key").sortWithinPartitions("key", "fp", "h")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def shingle_sets(texts_of: DataFrame, docs: DataFrame, shingle_words: int) -> DataFrame:
    """``h, shingles``: the whole sorted sets of the texts whose hashes are given."""

    def shingled(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.unique(shingle_hashes(x.as_py(), shingle_words)).view("int64") for x in batch.column("text")]
        return pa.RecordBatch.from_arrays([batch.column("h"), pa.array(sets, pa.list_(pa.int64()))], ["h", "shingles"])

    own = texts(docs).select(F.xxhash64("text").alias("h"), "text").join(texts_of.distinct(), "h", "left_semi").dropDuplicates(["h"])
    return written(map_batches(own, shingled, "h long, shingles array<long>"), "shingles")


def verified(pairs: DataFrame, docs: DataFrame, shingle_words: int, similarity: float) -> DataFrame:
    """The pairs ``a, b`` of text hashes whose whole sets of shingles reach the likeness."""

    def check(batch: pa.RecordBatch) -> pa.RecordBatch:
        ok = [similar(x.values.to_numpy(), y.values.to_numpy(), similarity) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
        return batch.select(["a", "b"]).filter(pa.array(ok))

    sets = shingle_sets(pairs.select(F.col("a").alias("h")).union(pairs.select(F.col("b").alias("h"))), docs, shingle_words)
    one = pairs.join(sets.select(F.col("h").alias("a"), F.col("shingles").alias("x")), "a")
    both = one.join(sets.select(F.col("h").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
    return written(map_batches(both, check, "a long, b long"), "near-pairs")


def groups(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """``doc_id, h, root, first`` for every row: equal roots are one group of near copies, linked through others too.

    ``first``: the row is its group's smallest by (doc_id, text hash), nulls last. Equal texts are one from the first
    step on. Texts without words are one group. First each text is held against two of every shard, then all pairs of
    a shard are that these haven't joined: so a large group of copies costs no square of pairs.
    """
    found = written(sketches(docs, shingle_words), "sketches")
    place = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), "h")
    distinct = found.groupBy("h").agg(F.min(place).alias("place"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("counts").alias("counts"))
    distinct = written(distinct, "distinct-texts")
    keyed = distinct.select("h", "fp", "n", F.explode("bands").alias("key"), *[F.col("counts")[i].alias(x) for i, x in enumerate(COUNTS)])
    shared = keyed.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select("key")
    shards = written(keyed.join(shared, "key", "left_semi").select("key", "h", "fp", "n", *COUNTS), "shards")
    tried = written(to_heads(shards, similarity), "first-pairs")
    near = verified(tried, docs, shingle_words, similarity)
    roots = written(connected_components(near), "roots").select(F.col("node").alias("h"), "root")
    rooted = shards.join(roots, "h", "left").select("key", "h", "fp", "n", *COUNTS, F.coalesce("root", "h").alias("root"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("_least"), F.max("root").alias("_most")).where("_least <> _most").select("key")
    mixed = written(rooted.join(mixed, "key", "left_semi"), "mixed-shards")
    sets = shingle_sets(mixed.select("h"), docs, shingle_words)
    near = near.union(written(joining(mixed.join(sets, "h"), similarity, radius), "joining-links"))
    roots = connected_components(near).select(F.col("node").alias("h"), "root")
    named = distinct.select("h", "place").join(roots, "h", "left").select("h", "place", F.coalesce("root", "h").alias("root"))
    heads = named.groupBy("root").agg(F.min("place").alias("head"))
    return found.select("doc_id", "h").join(named.join(heads, "root").select("h", "root", "head"), "h").select("doc_id", "h", "root", (F.col("head") == place).alias("first"))


def one_of_each_group(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, all their columns, that come first in their group; of repeated rows one.

    Null, empty and blank texts are one group. Very long texts: whole. Ties: the smaller text hash. A null id comes
    after all others. Columns whose names clash with inner ones are kept as they are. Empty table: no rows.
    """
    number = F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("_id")
    firsts = groups(docs, shingle_words, similarity, radius).where("first").select(number, F.col("h").alias("_h")).distinct()
    keyed = docs.select(whole_row(docs), number, F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h"))
    return keyed.join(firsts, ["_id", "_h"], "left_semi").dropDuplicates(["_id", "_h"]).select(*row_columns(docs))
