"""Encoding and decoding with merge-type SentencePiece vocabularies.

A score-ordered agenda of adjacent symbol pairs: the pair whose joined piece has the highest score merges first, of
equal ones the leftmost. No piece of such a vocabulary has a word mark after another character, so words merge
apart from each other and a worker keeps the ids of words that it has met.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts

MARK = "▁"
#: A worker keeps up to twice so many words.
KEPT_WORDS = 300_000
ROW = "doc_id long, n_tokens long, ids binary, decoded string, by_library boolean"

_words = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class AgendaEncoder:
    """Encodes like the library does with begin and end ids and without sampling."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = lib = SentencePieceProcessor(model_file=path)
        size = lib.vocab_size()
        plain = [i for i in range(size) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.ids = {lib.id_to_piece(i): i for i in plain}
        self.scores = {p: lib.get_score(i) for p, i in self.ids.items()}
        self.bytes = {int(lib.id_to_piece(i)[1:-1], 16): i for i in range(size) if lib.is_byte(i)}
        self.whole = any(MARK in p.lstrip(MARK) for p in self.ids)  # then words can't be cut apart
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.odd: set[str] = set()  # words on which agenda and library differ

    def merge(self, word: str) -> list[int]:
        """Ids of one word, its spaces already marks."""
        pieces, scores = list(word), self.scores
        left, right = list(range(-1, len(pieces) - 1)), list(range(1, len(pieces) + 1))
        agenda = [(-scores[p], i, p) for i in range(len(pieces) - 1) if (p := pieces[i] + pieces[i + 1]) in scores]
        heapq.heapify(agenda)
        last = len(pieces)
        while agenda:
            _, i, p = heapq.heappop(agenda)
            j = right[i]
            if not pieces[i] or j >= last or pieces[i] + pieces[j] != p:
                continue  # one of the two has merged with another meanwhile
            pieces[i], pieces[j] = p, ""
            right[i] = k = right[j]
            if k < last:
                left[k] = i
                if (q := p + pieces[k]) in scores:
                    heapq.heappush(agenda, (-scores[q], i, q))
            if (h := left[i]) >= 0 and (q := pieces[h] + p) in scores:
                heapq.heappush(agenda, (-scores[q], h, q))
        out = []
        for p in filter(None, pieces):
            if p in self.ids:
                out.append(self.ids[p])
            else:
                out.extend(self.bytes[b] for b in p.encode())
        return out

    def cut(self, text: str) -> list[str]:
        if not text:
            return []
        if self.whole or MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
            marked = MARK + text.replace(" ", MARK)
            return [marked] if self.whole else _words.findall(marked)
        return [MARK + x for x in text.split(" ")]

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """Ids of each text, begin and end included, as little-endian unsigned 32-bit integers, and whether some of
        them are the library's because the agenda gave others.

        Each new word is held against the library, and so is the first text as a whole; where that differs, all texts
        are the library's.
        """
        begin, end = (array("I", [x]).tobytes() for x in (self.library.bos_id(), self.library.eos_id()))
        out, odd = [], []
        for at in range(0, len(texts), 200):
            words = [self.cut(x) for x in texts[at : at + 200]]
            self.learn(set().union(*words))
            known = self.known
            out += [b"".join([begin, *[known[x] for x in own], end]) for own in words]
            odd += [bool(self.odd) and not self.odd.isdisjoint(own) for own in words]
        if texts and self.library.encode(texts[0], add_bos=True, add_eos=True) != np.frombuffer(out[0], "<u4").tolist():
            said = self.library.encode(texts, add_bos=True, add_eos=True, num_threads=1)
            return [array("I", x).tobytes() for x in said], [True] * len(texts)
        return out, odd

    def learn(self, words: set[str]) -> None:
        if len(self.known) > KEPT_WORDS:
            self.known, self.older = {}, self.known
        new = words.difference(self.known)
        again = {x for x in new if x in self.older}
        self.known.update((x, self.older[x]) for x in again)
        new = list(new - again)
        said = self.library.encode([x[1:].replace(MARK, " ") for x in new], num_threads=1)
        for word, ids in zip(new, said, strict=True):
            own = self.merge(word)
            if own != ids and word[0] == MARK != word:  # the library puts a mark before what it is given
                own = ids
                self.odd.add(word)
            self.known[word] = array("I", own).tobytes()


_encoders: dict[str, AgendaEncoder] = {}


def encode_decode(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded, by_library`` for every document, encoded whole and decoded again by the library.

    The agenda's ids are held against the library's; where they differ the library's hold, and ``by_library`` tells so.

    Null or empty text: begin and end ids, decoded to an empty text. Very long texts: whole. Pairs that tie in score go
    from left to right. Null ids and repeated rows are kept as they are; other columns aren't read. Empty table: no
    rows. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _encoders:
            _encoders[model] = AgendaEncoder(model)
        coder = _encoders[model]
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                ids, odd = coder.encode(part.column("text").to_pylist())
                decoded = coder.library.decode([np.frombuffer(x, "<u4").tolist() for x in ids], num_threads=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.string()), pa.array(odd)],
                    ["doc_id", "n_tokens", "ids", "decoded", "by_library"],
                )

    return texts(docs).mapInArrow(run, ROW)
