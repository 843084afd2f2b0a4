"""Token ids, packing, ORC files and SentencePiece against the libraries on whole texts."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from photolake.llm import orc_store, packing, sentence_pieces, tokens
from photolake.llm.queries import vocabulary

ALPHABET = " \n\tab'sé1!.,​\x85İΣ▁　"


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(1)
    fixed = ["", " ", "x", "a  b", " a", "a ", "\n\n a\n b\t c", "ﬁ é ́x Å", "a\x1c b", "<|endoftext|> x<|endoftext|>y", "don't. I'll, we've", "end.\nNext\n\nlast.", "x." * 50, "\n", "\n\n", "a\n", "a\n\n", "a\n\nb", "a\n\n\nb", "é.) İ. ﬁ! ×. x’. a'. 's", "word***\nword&&& ***", "İ" * 300 + " a" * 600]
    return fixed + ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(40))) for _ in range(400)]


@pytest.mark.parametrize(("name", "space_counts"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_ids_are_those_of_whole_texts(name, space_counts, odd_texts, sample, monkeypatch):
    coder = tokens.UnitEncoder(vocabulary(name), space_counts)
    texts = odd_texts + [t for _, t in sample if t]
    want = [np.array(x.ids, "<u4").tobytes() for x in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert coder.encode(texts) == want
    monkeypatch.setattr(tokens, "KEPT_UNITS", 50)  # the memory turns over again and again
    monkeypatch.setattr(tokens, "BYTES_AT_ONCE", 1000)
    small = tokens.UnitEncoder(vocabulary(name), space_counts)
    assert small.encode(texts) == want and small.encode([]) == []
    at, counts, flat = next(iter(coder.encode_batches(pa.array(texts[5:9]))))
    assert at == 0 and flat[: counts[0]].tobytes() == want[5]


def test_first_fit_decreasing_by_definition():
    rng = random.Random(2)
    for _ in range(100):
        sizes = [rng.randint(1, 40) for _ in range(rng.randrange(1, 60))]
        free, want = [], [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            b = next((k for k, room in enumerate(free) if room >= sizes[i]), len(free))
            if b == len(free):
                free.append(40)
            free[b] -= sizes[i]
            want[i] = b
        assert packing.first_fit_decreasing(sizes, 40) == want


def test_packed_pieces_hold_each_id_once(make_docs, edges, sample):
    rows = edges + [(d + 100, t) for d, t in sample]
    name = vocabulary("word_bpe_49k.json")
    got = packing.pack_documents(make_docs(rows), name, 2, sequence_tokens=256, group_chars=60_000).collect()
    coder = tokens.UnitEncoder(name, False)
    whole = {d: np.append(np.array(coder.tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4"), np.uint32(2)) for d, t in rows}
    sequences, docs = {}, {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length, r.used))
        docs.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
        assert r.length * 4 == len(r.ids) and r.doc_tokens == len(whole[r.doc_id])
    for pieces in sequences.values():
        at = 0
        for offset, length, used in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256 and {p[2] for p in pieces} == {at}
    for d, ids in whole.items():
        copies = sum(x[0] == d for x in rows)
        assert b"".join(b for _, b in sorted(docs[d])[::copies]) == ids.tobytes()
    total = sum(len(whole[d]) for d, _ in rows)
    assert len(sequences) * 256 - total < 256 * (1 + total * 6 // 60_000)
    assert packing.pack_documents(make_docs([]), name, 2).count() == 0


def test_orc_files_hold_all_ids_in_order(spark, make_docs, edges, sample, tmp_path):
    rows = edges + [(d + 100, t) for d, t in sample]
    name, path = vocabulary("byte_bpe_50k.json"), str(tmp_path / "t")
    orc_store.write_tokens(make_docs(rows), path, name, 0, file_chars=100_000)
    coder = tokens.UnitEncoder(name, True).tokenizer
    ids = lambda t: [*coder.encode(t or "", add_special_tokens=False).ids, 0]
    got = orc_store.read_tokens(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    at = 0
    texts = {}
    for d, t in rows:
        texts.setdefault(d, []).append(t)
    for r in got:
        assert r.start == at and r.n_tokens == len(r.tokens) and r.tokens in [ids(t) for t in texts[r.doc_id]]
        at += r.n_tokens
    assert len(list((tmp_path / "t").glob("*.orc"))) > 1
    found = orc_store.find_tokens(spark, path, [104, 107])
    assert {r.doc_id for r in found.collect()} == {104, 107}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(doc_id" in plan
    assert {r.part for r in spark.read.orc(path).select("part").distinct().collect()} == set(range(len(list((tmp_path / "t").glob("*.orc")))))
    orc_store.write_tokens(make_docs([]), str(tmp_path / "e"), name, 0)
    assert orc_store.read_tokens(spark, str(tmp_path / "e")).count() == 0


def test_places_hold_for_any_number_of_parts_and_files(spark, tmp_path):
    rows = [(i, p, 0, 3, [p, i, 0]) for i, p in enumerate((9, 99_998, 99_999, 100_000, 100_001, 1_000_000))]
    path = str(tmp_path / "many")
    for row in rows:  # each part in a file of its own, whose name says nothing
        spark.createDataFrame([row], orc_store.ROW).write.mode("append").orc(path)
    got = orc_store.read_tokens(spark, path).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.tokens) for r in got] == [(d, 3 * k, t) for k, (d, _, _, _, t) in enumerate(rows)]


def scanned(df):
    """Rows that the scan of ``df`` gave to what comes after it."""
    df.collect()
    node = df._jdf.queryExecution().executedPlan()
    while node.children().size():
        node = node.children().head()
    return node.metrics().get("numOutputRows").get().value()


def test_stripes_are_read_side_by_side_and_skipped(spark, make_docs, tmp_path, monkeypatch):
    import pyarrow.orc

    monkeypatch.setattr(orc_store, "STRIPE_BYTES", 1 << 14)
    monkeypatch.setattr(orc_store, "INDEX_ROWS", 1000)
    rng = random.Random(5)
    rows = [(2 * i, " ".join(rng.choice("alpha beta gamma delta omega".split()) + str(rng.randrange(10**6)) for _ in range(12))) for i in range(20_000)]
    name, path = vocabulary("byte_bpe_50k.json"), str(tmp_path / "t")
    orc_store.write_tokens(make_docs(rows), path, name, 0)
    (file,) = (tmp_path / "t").glob("*.orc")
    assert pyarrow.orc.ORCFile(str(file)).nstripes > 3
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(file.stat().st_size // 4))
    try:
        by_task = orc_store.read_tokens(spark, path).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sum(r["count"] for r in by_task) == len(rows) and len(by_task) > 1  # several tasks had stripes of one file
    assert 0 < scanned(spark.read.schema(orc_store.ROW).orc(path).where("doc_id = 2000")) <= 4000  # by the row index
    assert scanned(spark.read.schema(orc_store.ROW).orc(path).where("doc_id = 2001")) == 0  # inside an index entry's range: by the Bloom filter


def test_sentence_pieces_equal_the_library(make_docs, edges, sample, odd_texts):
    name = vocabulary("piece_bpe_32k.model")
    coder = sentence_pieces.AgendaEncoder(name)
    for t in odd_texts:
        assert np.frombuffer(coder.encode([t])[0][0], "<u4").tolist() == coder.library.encode(t, add_bos=True, add_eos=True)
    rows = edges + sample
    got = sentence_pieces.encode_decode(make_docs(rows), name).withColumn("crc", F.crc32("ids")).collect()
    lib = coder.library
    want = []
    for d, t in rows:
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        want.append((str(d), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), lib.decode(ids)))
    assert sorted((str(r.doc_id), r.n_tokens, r.crc, r.decoded) for r in got) == sorted(want)
    assert sentence_pieces.encode_decode(make_docs([]), name).count() == 0


def test_the_library_holds_where_the_agenda_differs():
    import public_tokenizers
    from photolake.llm.sentence_pieces import AgendaEncoder

    coder = AgendaEncoder(public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["a plain text of words", "another text here"]
    want = [coder.library.encode(t, add_bos=True, add_eos=True) for t in texts]
    for worse in ("another", "plain"):  # a word of a later text, and one of the first
        bad = AgendaEncoder(public_tokenizers.path("piece_bpe_32k.model"))
        good = bad.merge
        bad.merge = lambda word, good=good, worse=worse: [0, 0] if worse in word else good(word)
        got, odd = bad.encode(texts)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == want and odd == [worse in t for t in texts]
