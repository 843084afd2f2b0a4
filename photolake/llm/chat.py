"""Chat formatting: conversations become sequences of token ids with a loss mask, assembled segment by segment.

Each text is encoded apart from its neighbours, and the marks of the template are reserved ids beyond the vocabulary
that are spliced in between, so no text can give a mark's id and no merge crosses a mark. A turn is

    head, text, end            for the roles system, user and assistant
    head, role, end of role, text, end     for any other role

In the written form a mark is a control string. One that occurs inside a text gets a backslash before it, and so does
one that follows backslashes; a line feed parts the text from the mark after it, so a backslash at a text's end escapes
nothing. Taking one backslash from before each control string undoes this.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, written
from .folds import joined_digests
from .tokens import UnitEncoder

#: The marks of the template in the order of their ids.
HEADS = {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "}
OTHER, END_ROLE, END = "### Other: ", "\n</role> ", "\n</turn>\n"
MARKS = [*HEADS.values(), OTHER, END_ROLE, END]
#: Control strings inside a text, and the backslashes before them.
CONTROL = r"\\*(?:### (?:System|User|Assistant|Other):|</(?:role|turn)>)"
LEARNED = "assistant"

#: Turns whose values of ``turn`` lie so close are formatted in one place; a longer conversation is dealt out.
TURNS_APART = 4096
#: A part ends behind the turn that fills it with so many ids; bytes of texts that are encoded at once.
PART_IDS, BYTES_AT_ONCE = 65_536, 8_000_000

PARTS = "conv_id long, chunk long, seq long, n_turns long, ids array<int>, mask array<boolean>, text string"
_control, _escaped = re.compile(CONTROL), re.compile(r"\\(" + CONTROL + ")")


def escape(text: str) -> str:
    return _control.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _escaped.sub(r"\1", text)


@lru_cache(maxsize=2)
def template_of(path: str) -> Template:
    """A worker's template, read once."""
    return Template(path)


class Template:
    """One tokenizer file with the marks' reserved ids; strings of its own special tokens are ordinary text."""

    def __init__(self, path: str):
        self.units = UnitEncoder(path, True)
        self.tokenizer = self.units.tokenizer
        self.tokenizer.encode_special_tokens = True
        self.first = self.tokenizer.get_vocab_size()
        self.of = {m: self.first + i for i, m in enumerate(MARKS)}

    def assemble(self, roles: list[str], texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Of these turns: number of ids of each, all ids, the mask of all, and the written form of each.

        Segments are laid out by prefix sums of their sizes; the mask is the prefix sum of +1 where a learned segment
        begins and -1 where it ends.
        """
        shape, bodies, forms, count = [], [], [], []
        for role, text in zip(roles, texts, strict=True):
            body = escape(text)
            if role in HEADS:
                bodies.append(body)
                shape += [self.of[HEADS[role]], -2 if role == LEARNED else -1, self.of[END]]
                forms.append(HEADS[role] + body + END)
                count.append(3)
            else:
                name = escape(role)
                bodies += [name, body]
                shape += [self.of[OTHER], -1, self.of[END_ROLE], -1, self.of[END]]
                forms.append(OTHER + name + END_ROLE + body + END)
                count.append(5)
        counts, flat = self.units.encode_array(pa.array(bodies, pa.string()))
        kinds = np.array(shape, "int64")
        sizes = np.ones(len(kinds), "int64")
        sizes[kinds < 0] = counts
        ends = np.cumsum(sizes)
        starts = ends - sizes
        total = int(ends[-1]) if len(ends) else 0
        ids, steps = np.empty(total, "int32"), np.zeros(total + 1, "int32")
        ids[starts[kinds >= 0]] = kinds[kinds >= 0]
        texts_at = np.repeat(kinds < 0, sizes)
        ids[texts_at] = flat
        np.add.at(steps, starts[kinds == -2], 1)
        np.add.at(steps, ends[kinds == -2], -1)
        of_turn = np.add.reduceat(sizes, np.cumsum([0, *count[:-1]])) if count else np.zeros(0, "int64")
        return of_turn, ids, np.cumsum(steps[:-1]).astype(bool), forms

    def turns(self, ids: np.ndarray, mask: np.ndarray) -> tuple[list[tuple[str, str]], list[str]]:
        """The turns (role, text) that assembled ids hold, and the texts of the mask's runs."""
        ids, mask = np.asarray(ids), np.asarray(mask, bool)
        marks = np.flatnonzero(ids >= self.first)
        runs = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype("int8"))).reshape(-1, 2)
        pieces = [ids[i + 1 : j].tolist() for i, j in zip(marks, marks[1:], strict=False)] + [ids[i:j].tolist() for i, j in runs]
        plain = [unescape(x) for x in self.tokenizer.decode_batch(pieces, skip_special_tokens=False)]
        between, learned = plain[: max(0, len(marks) - 1)], plain[max(0, len(marks) - 1) :]
        named = {self.of[h]: r for r, h in HEADS.items()}
        found, role = [], ""
        for mark, text in zip(ids[marks].tolist(), between, strict=False):
            if mark in named:
                found.append((named[mark], text))
            elif mark == self.of[OTHER]:
                role = text
            elif mark == self.of[END_ROLE]:
                found.append((role, text))
        return found, learned


def read_text(text: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a written form: a mark has no backslash before its control string."""
    mark = re.compile("(" + "|".join((r"(?<!\\)" if m[0] == "#" else "") + re.escape(m) for m in MARKS) + ")")
    parts = mark.split(text)
    found, role = [], ""
    for kind, body in zip(parts[1::2], parts[2::2], strict=True):
        if kind == OTHER:
            role = unescape(body)
        elif kind != END:
            found.append((next((r for r, h in HEADS.items() if h == kind), role), unescape(body)))
    return found


def format_conversations(conversations: DataFrame, vocabulary: str) -> DataFrame:
    """The sequences of ``conversations`` (conv_id, turn, role, text): rows of ``PARTS``, and ``start``, ``parts``.

    A conversation is one row or, if it is long, several: in the order of ``chunk`` (nulls first), ``seq`` they hold its
    turns one after another; ``start`` is the number of ids before a part, ``parts`` their number. ``text`` is the
    written form of the ids, ``mask`` is true on the ids of assistant texts.

    Turns go by ``turn``, null first; ties by role, then by text; repeated rows stay, one after another. A null role or
    text is an empty one, and a null ``conv_id`` is a conversation of its own. Whole texts of any length; one turn is
    never cut. Extra columns aren't read. No rows, no sequences. A hot conversation is dealt out by its turns.
    """
    rows = conversations.select("conv_id", F.floor(F.col("turn") / TURNS_APART).alias("chunk"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartition("conv_id", "chunk").sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in ("conv_id", "chunk", "turn", "role", "text")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template, seq = template_of(vocabulary), 0
        for batch in batches:
            texts = batch.column("text")
            bytes_before = np.cumsum([0, *(len(x.as_buffer()) if x.is_valid else 0 for x in texts)])
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(bytes_before, bytes_before[at] + BYTES_AT_ONCE, "right")) - 1)
                piece = batch.slice(at, to - at)
                yield parts_of(template, piece, seq)
                seq += piece.num_rows
                at = to

    made = written(dealt.mapInArrow(run, PARTS), "chat-parts")
    narrow = made.select("conv_id", "chunk", "seq", F.size("ids").cast("long").alias("n_ids"))
    many = narrow.groupBy("conv_id").agg(F.count("*").alias("parts")).where("parts > 1")
    before = "sum(n_ids) OVER (PARTITION BY a.conv_id ORDER BY chunk NULLS FIRST, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    starts = narrow.alias("a").join(many.alias("b"), F.expr("a.conv_id <=> b.conv_id")).selectExpr("a.conv_id AS _c", "chunk AS _k", "seq AS _s", f"coalesce({before}, 0L) AS start", "parts")
    placed = made.join(written(starts, "chat-starts"), F.expr("conv_id <=> _c AND chunk <=> _k AND seq = _s"), "left")
    return placed.select(*made.columns, F.coalesce("start", F.lit(0)).alias("start"), F.coalesce("parts", F.lit(1)).cast("long").alias("parts"))


def parts_of(template: Template, rows: pa.RecordBatch, seq: int) -> pa.RecordBatch:
    """The parts of sorted turns; a part ends with its conversation or chunk, or behind the turn that fills it."""
    sizes, ids, mask, forms = template.assemble(rows.column("role").to_pylist(), rows.column("text").to_pylist())
    names = list(zip(rows.column("conv_id").to_pylist(), rows.column("chunk").to_pylist(), strict=True))
    ends = np.cumsum(sizes)
    cuts, held = [], 0
    for i, size in enumerate(sizes.tolist()):
        if i and (names[i] != names[i - 1] or held >= PART_IDS):
            cuts.append(i)
            held = 0
        held += size
    first = np.array([0, *cuts], "int64")
    last = np.array([*cuts, len(names)], "int64")
    offsets = pa.array(np.concatenate([[0], ends[last - 1]]), pa.int32())
    columns = [
        pa.array([names[i][0] for i in first], pa.int64()),
        pa.array([names[i][1] for i in first], pa.int64()),
        pa.array(seq + first, pa.int64()),
        pa.array(last - first, pa.int64()),
        pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())),
        pa.ListArray.from_arrays(offsets, pa.array(mask)),
        pa.array(["".join(forms[i:j]) for i, j in zip(first, last, strict=True)], pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["conv_id", "chunk", "seq", "n_turns", "ids", "mask", "text"])


def read_back(sequences: DataFrame, vocabulary: str) -> DataFrame:
    """Per conversation, from the ids and masks of its sequences alone but for the last column: ``conv_id, n_turns,
    turns_sha256`` (role, line feed, text, line feed of each turn), ``loss_chars, loss_sha256`` (all text under the
    mask), ``formatted_chars`` (code points of the written form).

    Parts are decoded apart; only the digests of a conversation of several parts go through them in order.
    """

    def decode(batch: pa.RecordBatch) -> pa.RecordBatch:
        template = template_of(vocabulary)
        turns, loss, chars, counts = [], [], [], []
        for ids, mask in zip(batch.column("ids"), batch.column("mask"), strict=True):
            found, learned = template.turns(ids.values.to_numpy(), ids_mask(mask))
            counts.append(len(found))
            turns.append("".join(f"{r}\n{t}\n" for r, t in found).encode())
            loss.append("".join(learned).encode())
            chars.append(sum(map(len, learned)))
        plain = [batch.column(c) for c in ("conv_id", "chunk", "seq", "parts", "formatted_chars")]
        columns = [*plain, pa.array(counts, pa.int64()), pa.array(chars, pa.int64()), pa.array(turns, pa.binary()), pa.array(loss, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["conv_id", "chunk", "seq", "parts", "formatted_chars", "n_turns", "loss_chars", "turns", "loss"])

    ids_mask = lambda m: m.values.to_numpy(zero_copy_only=False)
    rows = sequences.select("conv_id", "chunk", "seq", "parts", F.length("text").cast("long").alias("formatted_chars"), "ids", "mask")
    schema = "conv_id long, chunk long, seq long, parts long, formatted_chars long, n_turns long, loss_chars long, turns binary, loss binary"
    wanted = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    decoded = map_batches(rows.where("parts = 1"), decode, schema)
    short = decoded.withColumns({"turns_sha256": F.sha2("turns", 256), "loss_sha256": F.sha2("loss", 256)}).select(*wanted)
    long = written(map_batches(rows.where("parts > 1"), decode, schema), "chat-decoded")
    sums = long.groupBy(F.col("conv_id").alias("_c")).agg(*[F.sum(c).alias(c) for c in ("n_turns", "loss_chars", "formatted_chars")])
    digests = joined_digests(long, ["conv_id"], ["chunk", "seq"], ["turns", "loss"])
    return short.unionByName(digests.join(sums, F.expr("conv_id <=> _c")).select(*wanted))


def oracle() -> str:
    """The digests of all conversations in SQL, from their rows, with the template's lengths counted by its rules."""
    control = CONTROL.replace("(?:", "(").replace("'", "''")
    other = len(OTHER) + len(END_ROLE)
    heads = " ".join(f"WHEN '{r}' THEN {len(h)}" for r, h in HEADS.items())
    escaped = lambda c: f"length(regexp_replace({c}, '({control})', '\\\\\\1', 'g'))"
    return f"""WITH rows_ AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = '{LEARNED}' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = '{LEARNED}' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  sum(CASE role {heads} ELSE {other} + {escaped("role")} END + {escaped("text")} + {len(END)})::BIGINT AS formatted_chars
FROM rows_ GROUP BY conv_id"""
