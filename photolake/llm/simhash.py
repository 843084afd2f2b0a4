"""SimHash near-duplicates, linked through BK-trees.

A fingerprint is a 64-bit majority of word-shingle hashes. Fingerprints within two bits of each other agree in one
of three blocks of bits, so all fingerprints with one block in common form a shard, and each shard is searched
with a BK-tree of its own: children hang on their parent by their integer Hamming distance to it, and a search
follows only edges within the radius of the distance at hand. A tree lives in the task that owns its shard; nothing
is broadcast, because the trees of a corpus have no size bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, row_columns, texts, whole_row, written
from .components import connected_components

RADIUS = 2
SHINGLE_WORDS = 3
SEED = 42
#: Bits of the three blocks: lowest, middle, highest.
BLOCKS = (22, 21, 21)
#: A shard with more fingerprints is searched in finer shards: all fingerprints that agree but for two of sixteen
#: groups of four bits. Those hold at most 256 fingerprints.
SHARD_FINGERPRINTS = 8192
#: Fingerprints whose trees a task grows at once, and pairs of query and node that it follows at once.
ROWS_AT_ONCE = 200_000
PAIRS_AT_ONCE = 1_000_000


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the 64-bit hashes."""
    counts = np.zeros(64, "int64")
    for at in range(0, len(hashes), 100_000):
        part = hashes[at : at + 100_000]
        counts += np.unpackbits(part.view("uint8").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="uint32")
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def shingle_hashes(text: str, shingle_words: int) -> np.ndarray:
    """64-bit hashes of the word shingles in order; a text of fewer words is one shingle, one without words none."""
    words = text.encode().lower().split()
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle_words:
        return np.array([digest(joined, SEED)] if words else [], "<u8")
    ends = np.cumsum([len(w) + 1 for w in words])
    first = [0, *ends[: len(words) - shingle_words].tolist()]
    last = (ends[shingle_words - 1 :] - 1).tolist()
    return np.array([digest(joined[i:j], SEED) for i, j in zip(first, last, strict=True)], "<u8")


def fingerprint(text: str, shingle_words: int = SHINGLE_WORDS) -> int:
    hashes = shingle_hashes(text, shingle_words)
    return int(hashes[0]) if len(hashes) == 1 else majority(hashes)


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, h`` (a hash of the text) and ``fp`` (the 64 bits as a signed long) of every whole text."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(x.as_py(), shingle_words) for x in batch.column("text")], "uint64")
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(found.view("int64"))], ["doc_id", "h", "fp"])

    return map_batches(texts(docs).withColumn("h", F.xxhash64("text")), work, "doc_id long, h long, fp long")


class BKForest:
    """One BK-tree for each key over distinct fingerprints, grown and searched level by level.

    ``keys`` are sorted; the first fingerprint of a key is its tree's root. All fingerprints that arrive at a node
    at the same distance go down the same edge, and the first of them becomes the child there.
    """

    def __init__(self, keys: np.ndarray, fps: np.ndarray):
        self.fps = fps
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(keys)]]))
        self.root = np.repeat(starts, sizes)
        codes, children = [], []
        waiting = np.flatnonzero(self.root != np.arange(len(fps)))
        node = self.root[waiting]
        while len(waiting):
            edge = node * 65 + np.bitwise_count(fps[waiting] ^ fps[node])
            code, first, group = np.unique(edge, return_index=True, return_inverse=True)
            codes.append(code)
            children.append(waiting[first])
            stays = np.ones(len(waiting), bool)
            stays[first] = False
            node = waiting[first][group][stays]
            waiting = waiting[stays]
        self.codes = np.concatenate(codes) if codes else np.zeros(0, "int64")
        self.children = np.concatenate(children) if children else np.zeros(0, "int64")
        order = np.argsort(self.codes)
        self.codes, self.children = self.codes[order], self.children[order]

    def links(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places (query, found) within the radius, each pair once."""
        queries = np.flatnonzero(np.bincount(self.root, minlength=len(self.fps))[self.root] > 1)
        stack = [(queries[i : i + PAIRS_AT_ONCE], self.root[queries[i : i + PAIRS_AT_ONCE]]) for i in range(0, len(queries), PAIRS_AT_ONCE)]
        while stack:
            query, node = stack.pop()
            if len(query) > PAIRS_AT_ONCE:
                half = len(query) // 2
                stack += [(query[:half], node[:half]), (query[half:], node[half:])]
                continue
            near = np.bitwise_count(self.fps[query] ^ self.fps[node]).astype("int64")
            hit = (near <= radius) & (query < node)
            if hit.any():
                yield query[hit], node[hit]
            # the edges of a node stand together by distance, so those within the radius are one range
            lo = np.searchsorted(self.codes, node * 65 + np.maximum(near - radius, 1))
            n = np.searchsorted(self.codes, node * 65 + np.minimum(near + radius, 64), side="right") - lo
            if total := int(n.sum()):
                at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(total)
                stack.append((np.repeat(query, n), self.children[at]))


def hang(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the groups of the places a and b; ``label`` holds each place's smallest one of its group."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(la, lb)[apart], np.minimum(la, lb)[apart])
        while (label[label] != label).any():
            label[:] = label[label]


def shard_links(rows: DataFrame, radius: int) -> DataFrame:
    """Links ``a, b`` that join all fingerprints of a shard (column ``key``) that the radius connects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            forest = BKForest(keys, fps.view("uint64"))
            label = np.arange(len(fps))
            for a, b in forest.links(radius):
                hang(label, a, b)
            far = np.flatnonzero(label != np.arange(len(fps)))
            return pa.RecordBatch.from_arrays([pa.array(fps[far]), pa.array(fps[label[far]])], ["a", "b"])

        keys, fps = np.zeros(0, "int64"), np.zeros(0, "int64")
        for batch in batches:
            keys = np.concatenate([keys, batch.column("key").to_numpy()])
            fps = np.concatenate([fps, batch.column("fp").to_numpy()])
            if len(keys) >= ROWS_AT_ONCE and (cut := int(np.searchsorted(keys, keys[-1]))):
                yield linked(keys[:cut], fps[:cut])
                keys, fps = keys[cut:], fps[cut:]
        if len(keys):
            yield linked(keys, fps)

    dealt = rows.select("key", "fp").repartition("key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(run, "a long, b long")


def link(distinct: DataFrame, radius: int = RADIUS, shard_fingerprints: int = SHARD_FINGERPRINTS) -> DataFrame:
    """Links ``a, b`` whose components are those of all pairs of fingerprints (column ``fp``) within the radius.

    Shards above ``shard_fingerprints`` go to the finer shards; no pair is lost, since a pair within two bits
    differs in at most two of the sixteen groups. So no shard is larger than that number.
    """
    if radius != RADIUS:
        raise ValueError("the blocks are laid out for a radius of two bits")
    low, mid, _ = BLOCKS
    value = [F.col("fp").bitwiseAND((1 << low) - 1), F.shiftrightunsigned("fp", low).bitwiseAND((1 << mid) - 1), F.shiftrightunsigned("fp", low + mid)]
    shards = distinct.select("fp", F.explode(F.array(*[F.lit(k << low) + v for k, v in enumerate(value)])).alias("key"))
    hot = written(shards.groupBy("key").count().where(F.col("count") > shard_fingerprints).select("key"), "hot-shards")
    links = shard_links(shards.join(hot, "key", "left_anti"), radius)
    if hot.isEmpty():
        return links
    full = (1 << 64) - 1
    masks = [full ^ (15 << 4 * i) ^ (15 << 4 * j) for i, j in combinations(range(16), 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    crowded = shards.join(hot, "key", "left_semi").select("fp").distinct()
    finer = crowded.select("fp", F.explode(F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m))) for k, m in enumerate(signed)])).alias("key"))
    return links.union(shard_links(finer, radius))


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, h, fp, component_id, first`` for every row; the component is the smallest id that links reach.

    ``first``: the row is the component's smallest by (doc_id, text hash), nulls last. Null or empty text, or one of
    white space: fingerprint zero, linked like any other. Null ids: rows of their own, with the smallest id of their
    component that isn't null. Very long texts: all their shingles count. A bit that half of them have is 0. Repeated rows
    stay. Columns with other names aren't read. Empty table: no rows. Equal texts are one fingerprint from the
    first step on, so groups of copies of any size cost one row.
    """
    found = written(fingerprints(docs, shingle_words), "fingerprints")
    place = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), "h")
    distinct = written(found.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min(place).alias("place")), "distinct-fingerprints")
    roots = connected_components(link(distinct.select("fp")))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", "place", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.min("place").alias("head"))
    named = rooted.join(smallest, "root").select("fp", "component_id", "head")
    return found.join(named, "fp").select("doc_id", "h", "fp", "component_id", (F.col("head") == place).alias("first"))


def one_of_each_group(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of ``docs``, all their columns, that come first in their group; of repeated rows one.

    Null, empty and blank texts are one group. Very long texts: whole. Ties: the smaller text hash. A null id comes after
    all others. Columns whose names clash with inner ones are kept as they are. Empty table: no rows.
    """
    firsts = near_duplicates(docs, shingle_words).where("first").select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("_id"), F.col("h").alias("_h")).distinct()
    keyed = docs.select(whole_row(docs), F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h"))
    return keyed.join(firsts, ["_id", "_h"], "left_semi").dropDuplicates(["_id", "_h"]).select(*row_columns(docs))
