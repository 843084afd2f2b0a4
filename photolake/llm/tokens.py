"""Token ids of whole texts, put together from the ids of their words with a bounded memory of words.

A tokenizer that splits at white space before it merges gives a text the ids of its words, one after another. Most
words of a corpus repeat, so each worker keeps the ids of those that it has met and asks the library only for new
ones. All else is done on arrays: Arrow splits the texts and numbers the distinct words, a lookup table holds the
known ones, and one gather puts the ids of a slice of texts together.
"""

from __future__ import annotations

import os
import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Units that a worker keeps (some 60 bytes each); beyond, the half met longest ago goes.
KEPT_UNITS = 800_000
#: Bytes of texts that are worked on at once, but for one longer text.
BYTES_AT_ONCE = 8_000_000
#: Words that the library is given in one string.
JOINED_WORDS = 256

#: White space beside the space and the line feed, as a class of a pattern.
_WHITE = r"[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Texts with one of these are given to the library whole: special tokens, and, where white space counts, such of it as
#: isn't one space or line feed between two other characters (two line feeds are as good).
_SPECIAL = r"<\|"
_ODD = rf"{_SPECIAL}|{_WHITE}|  | \n|\n |\n\n\n|\n\n\z|\A | \z"
#: Stops that are a unit of their own at the end of a word after a Latin letter. An apostrophe may begin a suffix.
_STOPS = string.punctuation.replace("'", "")

_letter = np.zeros(256, bool)
_letter[[ord(c) for c in string.ascii_letters]] = True


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs of so many items from each start on, one run after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def bytes_of(strings: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings, and the offsets of each."""
    data = np.frombuffer(strings.buffers()[2] or b"", "uint8")
    return data, np.frombuffer(strings.buffers()[1], "<i4")[strings.offset : strings.offset + len(strings) + 1].astype("int64")


def without_stops(words: pa.StringArray) -> tuple[pa.StringArray, pa.StringArray]:
    """Each word without the stops at its end, and these; a word that no Latin letter ends then stays whole.

    The dotted capital I, which a normaliser may end with a mark, isn't among these letters.
    """
    cut = pc.ascii_rtrim(words, characters=_STOPS)
    data, offsets = bytes_of(cut)
    ends, size = offsets[1:], np.diff(offsets)
    if not len(data):
        return words, pa.array([""] * len(words), pa.string())
    last, prior = data[ends - 1], data[np.maximum(ends - 2, 0)]
    wide = (size > 1) & (prior >= 0xC3) & (prior <= 0xC9) & (last >= 0x80) & (last < 0xC0)
    code = (prior.astype("int64") & 0x1F) << 6 | (last & 0x3F)
    fits = (size > 0) & (_letter[last] | (wide & (code <= 0x24F) & ~np.isin(code, [0xD7, 0xF7, 0x130])))
    core = pc.if_else(pa.array(fits), cut, words)
    data, offsets = bytes_of(words)
    rest = offsets[1:] - offsets[:-1] - np.diff(bytes_of(core)[1])
    tails = np.concatenate([[0], np.cumsum(rest)]).astype("<i4")
    return core, pa.StringArray.from_buffers(len(words), pa.py_buffer(tails), pa.py_buffer(data[ragged(offsets[1:] - rest, rest)]))


class Memory:
    """Ids of the units that a worker has met, all in arrays: the unit, its first id's place and its number of ids."""

    def __init__(self) -> None:
        self.units = pa.array([""], pa.string())
        self.size, self.start, self.met = np.zeros(1, "int64"), np.zeros(1, "int64"), np.zeros(1, "int64")
        self.ids, self.now = np.zeros(0, "<u4"), 0

    def places(self, units: pa.StringArray, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The place of each of these distinct units until the next call; ``learn`` gives (sizes, ids) of new ones."""
        self.now += 1
        if len(self.units) > KEPT_UNITS:
            self.forget()
        at = pc.index_in(units, value_set=self.units)
        new = units.filter(pc.is_null(at))
        place = pc.fill_null(at, -1).to_numpy().astype("int64")
        if len(new):
            sizes, ids = learn(new.to_pylist())
            place[place < 0] = len(self.units) + np.arange(len(new))
            self.units = pa.concat_arrays([self.units, new])
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(sizes) - sizes])
            self.size = np.concatenate([self.size, sizes])
            self.met = np.concatenate([self.met, np.zeros(len(new), "int64")])
            self.ids = np.concatenate([self.ids, ids])
        self.met[place] = self.now
        return place

    def forget(self) -> None:
        self.met[0] = self.now + 1  # the empty unit stays in the first place
        kept = np.sort(np.argsort(-self.met, kind="stable")[: len(self.units) // 2])
        self.units = self.units.take(pa.array(kept))
        self.ids = self.ids[ragged(self.start[kept], self.size[kept])]
        self.size, self.met = self.size[kept], self.met[kept]
        self.start = np.cumsum(self.size) - self.size


class UnitEncoder:
    """Encodes texts with one tokenizer file of the ``tokenizers`` library.

    A text is cut at line feeds and single spaces, and before stops that follow a Latin letter at a word's end: there
    every word split of these tokenizers begins a new unit, so the ids of the units joined are the ids of the text.

    ``space_counts``: the space before a word belongs to its unit, and a line feed is one (byte-level vocabularies).
    Else white space is dropped by the tokenizer.
    """

    def __init__(self, path: str, space_counts: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.space_counts = space_counts
        self.lead, self.feed = (" ", "\n") if space_counts else ("", "")
        pieces = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        # the first id of a word behind a space, or the last one of a run of letters
        self.edge = np.array([x.startswith("Ġ") if space_counts else x.endswith("</w>") for x in pieces])
        self.memory = Memory()

    def each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and the ids of all, by the library."""
        got = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(map(len, got), "int64", len(got)), np.array([i for x in got for i in x], "<u4")

    def joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Like ``each`` for words that have one edge each, of which the library gets many in one string.

        Every word has an edge at least, so a string with as many edges as words is cut rightly; the words of any
        other string are given one by one.
        """
        sizes, ids = [], []
        parts = [words[i : i + JOINED_WORDS] for i in range(0, len(words), JOINED_WORDS)]
        between = "" if self.space_counts else " "
        for part, got in zip(parts, self.tokenizer.encode_batch_fast([between.join(x) for x in parts], add_special_tokens=False), strict=True):
            own = np.array(got.ids, "<u4")
            edges = np.flatnonzero(self.edge[own])
            if len(edges) != len(part):
                size, own = self.each(part)
            elif self.space_counts:
                size = np.diff(np.append(edges, len(own)))
            else:
                size = np.diff(np.concatenate([[0], edges + 1]))
            sizes.append(size)
            ids.append(own)
        return np.concatenate([np.zeros(0, "int64"), *sizes]), np.concatenate([np.zeros(0, "<u4"), *ids])

    def learn(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each new unit, and the ids of all."""
        plain = np.array([x[:1] == " " for x in units] if self.space_counts else [x.isalpha() for x in units])
        sizes = np.zeros(len(units), "int64")
        sizes[plain], ids = self.joined([x for x, ok in zip(units, plain, strict=True) if ok])
        sizes[~plain], others = self.each([x for x, ok in zip(units, plain, strict=True) if not ok])
        starts = np.zeros(len(units), "int64")
        starts[plain] = np.cumsum(sizes[plain]) - sizes[plain]
        starts[~plain] = len(ids) + np.cumsum(sizes[~plain]) - sizes[~plain]
        return sizes, np.concatenate([ids, others])[ragged(starts, sizes)]

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and the ids of all, one text after another."""
        odd = pc.match_substring_regex(texts, _ODD if self.space_counts else _SPECIAL)
        whole = texts.filter(odd)
        lines = pc.split_pattern(pc.if_else(odd, "", texts) if len(whole) else texts, "\n")
        line_at = lines.offsets.to_numpy() - lines.offsets[0].as_py()
        words = pc.split_pattern(lines.flatten(), " ")
        word_at = (words.offsets.to_numpy() - words.offsets[0].as_py()).astype("int64")
        flat = words.flatten()
        later, first = flat.dictionary_encode(), flat.take(pa.array(word_at[:-1])).dictionary_encode()
        rows = later.indices.to_numpy().astype("int64")
        # a line's first word has no space before it; it comes after a line feed, but in the first line of a text
        n, m = len(later.dictionary), len(first.dictionary)
        rows[word_at[:-1]] = n + first.indices.to_numpy()
        fed = np.ones(len(word_at) - 1, bool)
        fed[line_at[:-1]] = False
        rows[word_at[:-1][fed]] += m
        size, start, ids = self.rows(later.dictionary, first.dictionary)
        own = size[rows]
        found = ids[ragged(start[rows], own)]
        total = np.concatenate([[0], np.cumsum(own)])
        ends = total[word_at[line_at]]
        counts = np.diff(ends)
        if len(whole):
            sizes, others = self.each(whole.to_pylist())
            places, own = np.flatnonzero(odd.to_numpy(zero_copy_only=False)), ends[:-1].copy()
            own[places] = len(found) + np.cumsum(sizes) - sizes
            counts[places] = sizes
            found = np.concatenate([found, others])[ragged(own, counts)]
        return counts, found

    def rows(self, later: pa.StringArray, first: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Size and start in the ids returned, for each distinct word: behind a space, at a text's start, behind a line feed."""
        cores, stops = without_stops(pa.concat_arrays([later, first]))
        n, m = len(later), len(first)
        led = pc.if_else(pc.equal(cores.slice(0, n), ""), "", pc.binary_join_element_wise(self.lead, cores.slice(0, n), "")) if self.lead else cores.slice(0, n)
        units = pa.concat_arrays([led, cores.slice(n), stops, pa.array([self.feed], pa.string())]).dictionary_encode()
        memory = self.memory
        at = memory.places(units.dictionary, self.learn)[units.indices.to_numpy()]
        core, stop, feed = at[: n + m], at[n + m : 2 * (n + m)], at[-1]
        before = np.concatenate([np.zeros(n + m, "int64"), np.full(m, feed)])
        core, stop = np.concatenate([core, core[n:]]), np.concatenate([stop, stop[n:]])
        parts = np.stack([before, core, stop], axis=1)
        sizes = memory.size[parts]
        ids = memory.ids[ragged(memory.start[parts].ravel(), sizes.ravel())]
        size = sizes.sum(axis=1)
        return size, np.cumsum(size) - size, ids

    def encode_batches(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``encode_array`` over slices of bounded size: (first text, counts, ids)."""
        at = 0
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype="int64")
        while at < len(texts):
            before = sizes[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(sizes, before + BYTES_AT_ONCE)))
            yield at, *self.encode_array(texts.slice(at, upto - at))
            at = upto

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out = []
        for _, counts, flat in self.encode_batches(pa.array(texts, pa.string())):
            ends, data = np.cumsum(counts).tolist(), flat.tobytes()
            out += [data[4 * i : 4 * j] for i, j in zip([0, *ends], ends, strict=False)]
        return out


_encoders: dict[tuple[str, bool], UnitEncoder] = {}


def encoder(path: str, space_counts: bool) -> UnitEncoder:
    """The encoder of this worker process."""
    if (path, space_counts) not in _encoders:
        _encoders[path, space_counts] = UnitEncoder(path, space_counts)
    return _encoders[path, space_counts]
