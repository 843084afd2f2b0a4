"""A hidden Markov language model, trained by Baum-Welch over the whole corpus and scored by the scaled forward recursion.

Words are many and grow with the corpus, so the model's alphabet is made of classes: each word that is at least one
of ``FREQUENT_SHARE`` training tokens is a class, the others are classed by a hash of their last characters, and the
end of a text is a class. A text's probability is that of its classes under the hidden states times that of each word
in its class; a class keeps a part for words never seen in training (the share of its tokens that were seen once).

Counts of words are gathered by one shuffle over the distinct words of blocks of documents. Nothing that grows with
the corpus reaches the driver or is broadcast.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts, written

#: A word with one of so many training tokens, or more, is a class of its own: so many classes at most.
FREQUENT_SHARE = 2000
#: Classes of the other words.
SUFFIXES = 512
SUFFIX_CHARS = 3
STATES = 8
#: Rounds of Baum-Welch at most, and gain of the likelihood (share of its logarithm) below which there is no other.
ROUNDS = 6
TOLERANCE = 1e-3
SEED = 7
#: Steps whose alphas are held at once, and how many of them in all texts that are trained on side by side, about. A text
#: of more steps trains as one sequence too: the alphas of a segment are computed again from those at its start.
SEGMENT = 1024
ALPHAS_AT_ONCE = 300_000
#: Characters of a block of documents at most, but for one longer text.
BLOCK_CHARS = 16_000_000
#: Stands for the end of a text among the words; no word holds white space.
END = "\n"
BLOCKS = "block long, doc_id long, held_out boolean, ids binary, token string, place int, seen long"
SEQUENCES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, words_score double, classes binary"


def held_out(doc_id: int | None) -> bool:
    """Whether a document is kept from training. A null id counts as an empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def in_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of documents: a row for each document (words by their place among the block's distinct words), and
    one for each distinct word (``seen``: how often in the block's training documents)."""

    names = [x.split()[0] for x in BLOCKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        none = lambda kind, k: pa.nulls(k, kind)
        places: dict[bytes, int] = {END.encode(): 0}
        ids: list[int | None] = []
        coded: list[bytes] = []

        def made() -> Iterator[pa.RecordBatch]:
            out = [held_out(x) for x in ids]
            n, v = len(ids), len(places)
            learning = b"".join(x for x, away in zip(coded, out, strict=True) if not away)
            seen = np.bincount(np.frombuffer(learning, "<u4"), minlength=v).astype("int64")
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, block)), pa.array(ids, pa.int64()), pa.array(out), pa.array(coded, pa.binary()), none(pa.string(), n), none(pa.int32(), n), none(pa.int64(), n)], names
            )
            words = pa.array(list(places), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(v, block)), none(pa.int64(), v), none(pa.bool_(), v), none(pa.binary(), v), words, pa.array(np.arange(v, dtype="int32")), pa.array(seen)], names
            )

        chars = 0
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if ids and chars + len(text) > BLOCK_CHARS:
                        yield from made()
                        places, ids, coded, chars, block = {END.encode(): 0}, [], [], 0, block + 1
                    ids.append(doc)
                    own = [places.setdefault(w, len(places)) for w in text.encode().lower().split()]
                    own.append(0)
                    coded.append(np.array(own, "<u4").tobytes())
                    chars += len(text)
        if ids:
            yield from made()

    return texts(docs).mapInArrow(run, BLOCKS)


@dataclass
class Words:
    """Totals of the training tokens; ``size`` and ``once`` by class: its tokens, and its words seen once."""

    tokens: int
    distinct: int
    size: np.ndarray
    once: np.ndarray

    @property
    def classes(self) -> int:
        return len(self.size)

    def base(self, seen: np.ndarray) -> np.ndarray:
        return np.log10((seen + 1) / (self.tokens + self.distinct + 1))

    def within(self, seen: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """log10 of a word's share of its class."""
        size, once = self.size[cls], self.once[cls]
        unseen = np.where(size > 0, (once + 0.5) / (size + 1), 1.0)
        return np.log10(np.where(seen > 0, seen / np.maximum(size, 1) * (1 - unseen), unseen))


def classed(blocks: DataFrame) -> tuple[DataFrame, Words]:
    """``block, place, total, cls`` of each block's words, and the totals.

    Words are dealt by token once; both the sums and the join back read that one exchange. The rows of a word are as
    many as blocks hold it, and none of them is held in memory. Frequent words, at most ``FREQUENT_SHARE``, are found
    by their share and so are bounded.
    """
    words = blocks.where("token is not null").select("block", "token", "place", "seen")
    n = int(words.agg(F.sum("seen")).first()[0] or 0)
    dealt = words.repartition("token")
    sums = dealt.groupBy("token").agg(F.sum("seen").alias("total"), F.min("block").alias("least"))
    common = (F.col("total") > 0) & (F.col("total") * FREQUENT_SHARE >= n) | (F.col("token") == END)
    suffix = F.pmod(F.xxhash64(F.substring("token", -SUFFIX_CHARS, SUFFIX_CHARS)), F.lit(SUFFIXES)).cast("int")
    joined = dealt.drop("seen").join(sums.hint("merge"), "token").select("block", "place", "total", (F.col("least") == F.col("block")).alias("first"), suffix.alias("suffix"), F.when(common, F.col("token")).alias("common"))
    total = written(joined, "word-totals")
    once = total.where("first")
    frequent = sorted(r["common"] for r in once.where(F.col("common").isNotNull() & (F.col("common") != END)).select("common").collect())
    names = blocks.sparkSession.createDataFrame([(END, 0), *[(w, 1 + i) for i, w in enumerate(frequent)]], "common string, own int")
    found = total.join(F.broadcast(names), "common", "left").select("block", "place", "total", "first", F.coalesce("own", F.col("suffix") + 1 + len(frequent)).alias("cls"))
    size, single, v = np.zeros(1 + len(frequent) + SUFFIXES), np.zeros(1 + len(frequent) + SUFFIXES), 0
    known = lambda c: F.sum(F.when(c, 1).otherwise(0))
    for r in found.where("first").groupBy("cls").agg(F.sum("total").alias("n"), known(F.col("total") == 1).alias("once"), known(F.col("total") > 0).alias("v")).collect():
        size[r["cls"]], single[r["cls"]] = r["n"], r["once"]
        v += r["v"]
    return found.drop("first"), Words(n, v, size, single)


def sequences(blocks: DataFrame, words: DataFrame, totals: Words) -> DataFrame:
    """Each document's classes, beside what its words say apart from the hidden states.

    A block's words come first in its task, then its documents; blocks are dealt out one by one, so tasks are alike.
    Only one block's words are held at a time.
    """
    names = [x.split()[0] for x in SEQUENCES.split(", ")]
    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    makers = int(blocks.agg(F.max(F.shiftright("block", 24))).first()[0] or 0) + 1
    dealt = F.pmod(F.shiftright("block", 24) + F.col("block").bitwiseAND(0xFFFFFF) * makers, F.lit(tasks)).cast("int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, ready = None, [], None
        for batch in batches:
            edges = np.flatnonzero(np.diff(batch.column("block").to_numpy())) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                part = batch.slice(lo, hi - lo)
                if (now := part.column("block")[0].as_py()) != block:
                    block, parts, ready = now, [], None
                own = part.filter(pc.is_null(part.column("ids")))
                if own.num_rows:
                    parts.append([own.column(c).to_numpy() for c in ("place", "total", "cls")])
                docs = part.slice(own.num_rows)
                if not docs.num_rows:
                    continue
                if ready is None:
                    place, total, kind = (np.concatenate(x) for x in zip(*parts, strict=True))
                    seen, cls = np.zeros(len(place), "int64"), np.zeros(len(place), "int64")
                    seen[place], cls[place] = total, kind
                    ready = totals.base(seen), totals.within(seen, cls), seen > 0, cls.astype("<u2")
                base, within, known, cls = ready
                coded = [np.frombuffer(x.as_py(), "<u4") for x in docs.column("ids")]
                made = [
                    pa.array([len(x) for x in coded], pa.int64()),
                    pa.array([int(known[x].sum()) for x in coded], pa.int64()),
                    pa.array([float(base[x].sum()) for x in coded], pa.float64()),
                    pa.array([float(within[x].sum()) for x in coded], pa.float64()),
                    pa.array([cls[x].tobytes() for x in coded], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays([docs.column("doc_id"), docs.column("held_out"), *made], names)

    docs = blocks.where("token is null").select("block", F.lit(1).alias("kind"), "doc_id", "held_out", "ids")
    both = docs.unionByName(words.select("block", F.lit(0).alias("kind"), "place", "total", "cls"), allowMissingColumns=True)
    return both.repartitionById(tasks, dealt).sortWithinPartitions("block", "kind").drop("kind").mapInArrow(run, SEQUENCES)


@dataclass
class Model:
    """Chances of the first state, from state to state, and of each class in each state."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # class by state

    @classmethod
    def first(cls, size: np.ndarray) -> Model:
        """Near the classes' shares, with seeded noise that tells the states apart."""
        noise = np.random.default_rng(SEED)
        emit = (size[:, None] + 1) * noise.uniform(0.5, 1.5, (len(size), STATES))
        move = noise.uniform(0.5, 1.5, (STATES, STATES))
        return cls(np.full(STATES, 1 / STATES), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    @classmethod
    def of_counts(cls, counts: np.ndarray, classes: int) -> Model:
        start = counts[:STATES] + 0.1
        move = counts[STATES : STATES + STATES**2].reshape(STATES, STATES) + 0.1
        emit = counts[STATES + STATES**2 :].reshape(classes, STATES) + 0.01
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    def forward(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each class sequence, whole. Texts go side by side, one token a step."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        sizes = np.array([len(texts[i]) for i in order])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        flat = np.concatenate([texts[i] for i in order])
        out = np.zeros(len(texts))
        alpha = np.repeat(self.start[None], len(order), 0)
        steps = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")  # texts longer than t
        for t, n in enumerate(steps.tolist()):
            alpha = (alpha[:n] if t == 0 else alpha[:n] @ self.move) * self.emit[flat[starts[:n] + t]]
            scale = alpha.sum(1)
            alpha /= scale[:, None]
            out[:n] += np.log10(scale)
        back = np.zeros(len(texts))
        back[order] = out
        return back

    def expected(self, texts: list[np.ndarray]) -> tuple[np.ndarray, float]:
        """Baum-Welch counts of all whole sequences (starts, moves and emissions, flat), and their log10 probability.

        Texts go side by side, one token a step. Of texts longer than a segment, a first pass keeps only the alphas
        at the segments' starts.
        """
        texts = sorted(texts, key=len, reverse=True)
        sizes = np.array([len(x) for x in texts])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        flat = np.concatenate(texts)
        steps = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left").tolist()  # texts longer than t

        def forward(first: int, alpha: np.ndarray | None, kept: list | None) -> np.ndarray:
            for t in range(first, min(first + SEGMENT, len(steps))):
                n = steps[t]
                like = self.emit[flat[starts[:n] + t]]
                alpha = (np.repeat(self.start[None], n, 0) if alpha is None else alpha[:n] @ self.move) * like
                scale = alpha.sum(1, keepdims=True)
                alpha /= scale
                if kept is not None:
                    kept.append((alpha, like / scale, scale))
            return alpha

        entry: list[np.ndarray | None] = [None]
        for first in range(0, len(steps) - SEGMENT, SEGMENT):
            entry.append(forward(first, entry[-1], None))
        moves, emits, begin, log = np.zeros((STATES, STATES)), np.zeros((len(self.emit), STATES)), np.zeros(STATES), 0.0
        ahead = np.zeros((0, STATES))  # what the step after says of the states there
        for first in range((len(steps) - 1) // SEGMENT * SEGMENT, -1, -SEGMENT):
            kept: list[tuple] = []
            forward(first, entry[first // SEGMENT], kept)
            shares, tokens = [], []
            for t in range(first + len(kept) - 1, first - 1, -1):
                n, (alpha, like, scale) = steps[t], kept[t - first]
                m = len(ahead)
                if m:
                    moves += alpha[:m].T @ ahead
                beta = np.concatenate([ahead @ self.move.T, np.ones((n - m, STATES))])
                shares.append(alpha * beta)
                tokens.append(flat[starts[:n] + t])
                log += float(np.log10(scale).sum())
                ahead = like * beta
            share, token = np.concatenate(shares), np.concatenate(tokens)
            emits += np.stack([np.bincount(token, share[:, k], len(self.emit)) for k in range(STATES)], 1)
            begin = shares[-1].sum(0)
        return np.concatenate([begin, (moves * self.move).ravel(), emits.ravel()]), log


def side_by_side(batches: Iterator[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Texts in groups of about ``ALPHAS_AT_ONCE``, long ones apart from short ones, so that few steps have few texts."""
    waiting: dict[int, list[np.ndarray]] = {}
    held: dict[int, int] = {}
    for text in batches:
        kind = len(text).bit_length() // 2
        waiting.setdefault(kind, []).append(text)
        held[kind] = held.get(kind, 0) + min(len(text), SEGMENT)
        if held[kind] >= ALPHAS_AT_ONCE:
            yield waiting.pop(kind)
            del held[kind]
    yield from waiting.values()


def train(seqs: DataFrame, totals: Words, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[Model, list[float]]:
    """Baum-Welch over all whole training documents; the model, and the log10 probability before each round.

    Each task sends one list of expected counts, as long as the model is (states, classes), and its log-likelihood;
    Spark adds the lists by place. So what reaches the driver is one model a round. It ends when the likelihood has
    settled.
    """
    model, logs = Model.first(totals.size), []
    learning = seqs.where("not held_out").select("classes")
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
            total, log = np.zeros(0), 0.0
            for texts in side_by_side(np.frombuffer(row.as_py(), "<u2") for batch in batches for row in batch.column("classes")):
                counts, own = model.expected(texts)
                total, log = counts + total if len(total) else counts, log + own
            if len(total):
                yield pa.RecordBatch.from_arrays([pa.array([np.append(total, log)], pa.list_(pa.float64()))], ["counts"])

        lists = learning.mapInArrow(run, "counts array<double>")
        summed = lists.select(F.posexplode("counts")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
        if not summed:
            break
        counts = np.zeros(len(summed))
        for r in summed:
            counts[r["pos"]] = r["n"]
        model = Model.of_counts(counts[:-1], totals.classes)
        logs.append(float(counts[-1]))
        if len(logs) > 1 and logs[-1] - logs[-2] < tolerance * abs(logs[-2]):
            break
    return model, logs


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every whole text.

    The model learns from the documents that aren't held out. Null or empty text: the end token alone. Null id: as an
    empty id, so it trains. Repeated rows count as often as they are there. Very long texts train and score as one
    sequence. Ties: words seen equally often are classed by their spelling alone. Without training documents no word
    is known and the states know nothing. Columns beside doc_id and text aren't read. Empty table: no rows.
    """
    blocks = written(in_blocks(docs), "word-blocks")
    words, totals = classed(blocks)
    seqs = written(sequences(blocks, words, totals), "class-sequences")
    model, _ = train(seqs, totals, rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logs = model.forward([np.frombuffer(x.as_py(), "<u2") for x in batch.column("classes")]) if batch.num_rows else np.zeros(0)
            columns = [batch.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known")]
            total = pa.array(np.full(batch.num_rows, totals.tokens, "int64"))
            yield pa.RecordBatch.from_arrays(
                [*columns, total, batch.column("base_score"), pa.array(batch.column("words_score").to_numpy() + logs)],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return seqs.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
