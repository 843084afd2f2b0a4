"""Packing of token sequences: first-fit decreasing over a tournament tree of bin capacities.

Documents are dealt at random (by a hash) into groups of bounded size; each group is packed alone, in one task's
memory, so the work is spread however large the corpus is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts
from .tokens import encoder

SEQUENCE_TOKENS = 4096
#: Characters of text in a group at most, but for one document that is longer.
GROUP_CHARS = 8_000_000
#: Tasks at most; of more parts, a task packs several, one after another.
MOST_TASKS = 100_000
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, used long"


class BinTree:
    """Bins in the order in which they were opened, as leaves of a tournament tree of their free capacities.

    Each inner node holds the larger capacity of its two children; the first bin with room for an item is found by
    going left whenever the left child has room.
    """

    def __init__(self, most_bins: int, capacity: int):
        self.size = 1 << max(0, most_bins - 1).bit_length()
        self.tree = [capacity] * (2 * self.size)

    def place(self, need: int) -> int:
        """The first bin with ``need`` free; it is taken from the bin."""
        tree, at = self.tree, 1
        while at < self.size:
            at *= 2
            if tree[at] < need:
                at += 1
        chosen = at - self.size
        tree[at] -= need
        while at > 1:
            at //= 2
            larger = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == larger:
                break
            tree[at] = larger
        return chosen


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[int]:
    """Bin of each item; items go by falling length (ties: as given), each to the first bin that has room."""
    bins = BinTree(len(lengths), capacity)
    chosen = [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        chosen[i] = bins.place(lengths[i])
    return chosen


def pack_group(tokens: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, bin, offset) of documents of so many tokens.

    A document of more than ``capacity`` tokens gives full pieces first; what is left of it competes with the other
    documents. The documents with the fewest tokens are then cut to fill the room that first fit left in the bins,
    last bin first, so that only the last bins are padded.
    """
    pieces, items, full = [], [], 0
    for d, n in enumerate(tokens):
        whole = n // capacity
        for k in range(whole):
            pieces.append((d, k * capacity, capacity, full, 0))
            full += 1
        if n % capacity:
            items.append((d, whole * capacity, n % capacity))
    chosen = first_fit_decreasing([x[2] for x in items], capacity)
    bins: dict[int, list[tuple[int, int, int]]] = {}
    for item, b in zip(items, chosen, strict=True):
        bins.setdefault(b, []).append(item)
    used = {b: sum(x[2] for x in own) for b, own in bins.items()}
    # what the last bins hold moves, cut freely, into the room of the earlier ones
    order = sorted(bins)
    first = 0
    while order and first < len(order) - 1:
        room = capacity - used[order[first]]
        if not room:
            first += 1
            continue
        last = order[-1]
        d, start, n = bins[last].pop()
        moved = min(room, n)
        bins[order[first]].append((d, start + n - moved, moved))
        used[order[first]] += moved
        used[last] -= moved
        if n > moved:
            bins[last].append((d, start, n - moved))
        if not bins[last]:
            order.pop()
    for k, b in enumerate(order):
        offset = 0
        for d, start, n in bins[b]:
            pieces.append((d, start, n, full + k, offset))
            offset += n
    return pieces


def pack_documents(
    docs: DataFrame,
    vocabulary: str,
    end_id: int,
    sequence_tokens: int = SEQUENCE_TOKENS,
    space_counts: bool = False,
    group_chars: int = GROUP_CHARS,
) -> DataFrame:
    """Token ids of all documents in sequences of at most ``sequence_tokens``.

    Each document is encoded whole with the tokenizer file ``vocabulary`` and ends with ``end_id``. One row per
    piece: ``doc_id``, ``start`` (its document's ids before it), ``length``, ``ids`` (little-endian unsigned 32-bit),
    ``doc_tokens``, ``sequence_id``, ``offset`` in the sequence (gapless from 0) and ``used`` (tokens of the whole
    sequence; the rest is padding).

    Null or empty text: one piece, the end id alone. Null ``doc_id``: kept as null. Repeated rows: each is packed.
    Documents of one length go by their hash. Columns with other names aren't read.
    Empty table: no rows. The hash that deals documents out takes id and text, so no source or key is a hot spot;
    rows that are equal in both are packed in bounded groups too.
    """
    rows = texts(docs)
    total = rows.agg(F.sum(F.length("text") + 1).alias("chars")).first()["chars"] or 0
    parts = max(1, -(-total // (2 * group_chars)))
    tasks = int(min(parts, MOST_TASKS))
    dealt = (
        rows.withColumn("_h", F.xxhash64("doc_id", "text"))
        .withColumn("_part", F.pmod("_h", F.lit(parts)))
        .repartitionById(tasks, F.pmod("_part", F.lit(tasks)).cast("int"))  # part by part, so that no task gets two and another none
        .sortWithinPartitions("_part", "_h", "doc_id")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = encoder(vocabulary, space_counts)
        end = np.array([end_id], "<u4").tobytes()

        def packed(part: int, group: int, ids: list, texts: list[str]) -> pa.RecordBatch:
            encoded = [x + end for x in tok.encode(texts)]
            tokens = [len(x) // 4 for x in encoded]
            pieces = pack_group(tokens, sequence_tokens)
            used: dict[int, int] = {}
            for _, _, n, b, _ in pieces:
                used[b] = used.get(b, 0) + n
            base = (part << 40) + (group << 24)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[d] for d, *_ in pieces], pa.int64()),
                    pa.array([s for _, s, *_ in pieces], pa.int64()),
                    pa.array([n for _, _, n, *_ in pieces], pa.int64()),
                    pa.array([encoded[d][4 * s : 4 * (s + n)] for d, s, n, *_ in pieces], pa.binary()),
                    pa.array([tokens[d] for d, *_ in pieces], pa.int64()),
                    pa.array([base + b for *_, b, _ in pieces], pa.int64()),
                    pa.array([o for *_, o in pieces], pa.int64()),
                    pa.array([used[b] for *_, b, _ in pieces], pa.int64()),
                ],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "used"],
            )

        now, group, ids, kept, chars = None, 0, [], [], 0
        for batch in batches:
            for doc, text, part in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "_part")), strict=True):
                if ids and (part != now or chars + len(text) > group_chars):
                    yield packed(now, group, ids, kept)
                    group, ids, kept, chars = group + 1 if part == now else 0, [], [], 0
                if part != now:
                    now, group = part, 0
                ids.append(doc)
                kept.append(text)
                chars += len(text) + 1
        if ids:
            yield packed(now, group, ids, kept)

    return dealt.select("doc_id", "text", "_part").mapInArrow(run, PIECES)
