import random

from photolake.llm import line_dedup

WHITE = " \t\n\x0b\x0c\r"


def brute(rows, block_words):
    """Places of all lines in a run of enough words that any earlier document has too."""
    docs = sorted({(-(1 << 63) if d is None else d, t or "") for d, t in rows})
    lines = [[(x.strip(WHITE), i) for i, x in enumerate(t.split("\n")) if x.strip(WHITE)] for _, t in docs]
    out, seen = {}, set()
    for doc, own in zip(docs, lines, strict=True):
        texts = [x for x, _ in own]
        runs = [(i, j) for i in range(len(own)) for j in range(i + 1, len(own) + 1) if sum(len(x.split()) for x in texts[i:j]) >= block_words]
        out[doc] = sorted({own[k][1] for i, j in runs if tuple(texts[i:j]) in seen for k in range(i, j)})
        seen |= {tuple(texts[i:j]) for i, j in runs}
    return out


def test_all_earlier_documents_count(make_docs):
    rng = random.Random(7)
    pool = [" ".join(rng.choice("ab cd ef gh ij".split()) for _ in range(rng.randrange(1, 9))) for _ in range(40)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 12)))) for i in range(100)]
    want = brute(rows, 9)
    every = sum(map(len, want.values()))
    assert every > 50
    got = {(r.doc_id, dict(rows)[r.doc_id]): r.removed for r in line_dedup.dedup_lines(make_docs(rows), 4, 9, runs=True).collect()}
    assert all(set(got[k]) <= set(want[k]) for k in want)
    assert sum(map(len, got.values())) >= 0.9 * every  # lines here repeat as no real ones do


def test_all_blocks_of_real_texts_count(make_docs, sample):
    rows = [(d, t) for d, t in sample if t]
    want = brute([(d, t[:6000]) for d, t in rows], line_dedup.BLOCK_WORDS)
    short = [(d, t[:6000]) for d, t in rows]
    got = {(r.doc_id, dict(short)[r.doc_id]): set(r.removed) for r in line_dedup.dedup_lines(make_docs(short), runs=True).collect()}
    every = sum(map(len, want.values()))
    assert sum(len(got[k] & set(v)) for k, v in want.items()) >= 0.99 * every > 0


def test_alignment_decides(make_docs, monkeypatch):
    """Documents that share runs of words are partners, but only what is aligned goes."""
    lines = [f"line number {i} of a passage with some words" for i in range(9)]
    a, moved = "\n".join(lines), "\n".join([*lines[5:], "between the parts", *lines[:5]])
    assert line_dedup.aligned_lines([*range(5, 9), 99, *range(5)], [8] * 10, list(range(9)), 12) == [0, 1, 2, 3, 5, 6, 7, 8, 9]
    assert line_dedup.common_lines([*range(5, 9), 99, *range(5)], [8] * 10, list(range(9)), 12) == [5, 6, 7, 8, 9]
    rows = [(0, a), (1, moved)]
    cut = lambda: {r.doc_id: r.removed for r in line_dedup.dedup_lines(make_docs(rows), runs=True).collect()}
    assert cut() == {0: [], 1: [0, 1, 2, 3, 5, 6, 7, 8, 9]}
    pairs = line_dedup.pairs(line_dedup.sequences(make_docs(rows)), line_dedup.shared_lines(line_dedup.sequences(make_docs(rows))), block_words=12)
    assert pairs.count() == 1
    assert line_dedup.aligned_lines([1, 2, 3], [5, 5, 5], [3, 2, 1], 12) == []  # all lines are shared, no block is


def test_query_finds_blocks_of_frequent_lines(make_docs, spark, tmp_path):
    from photolake.llm import queries

    one, two = "a line of seven words it is", "and here is one more of eight words"
    own = lambda i: f"only document {i} has this"
    rows = [(i, f"{one}\n{own(i)}") for i in range(20)] + [(i, f"{two}\n{own(i)}") for i in range(20, 40)]
    rows += [(i, f"{own(i)}\n{one}\n{two}") for i in (40, 41)]
    make_docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.removed for r in queries.op2_line_dedup(spark, str(tmp_path)).collect()}
    assert got[41] == "1,2" and got[40] == ""


def test_short_lines_of_many_documents_go(make_docs):
    notice, few = "Released under some license.", "a short line of few"
    rows = [(i, f"text of {i}\n{notice}\nmore of {i}\n {notice}") for i in range(60)] + [(100 + i, f"own {i}\n{few}") for i in range(30)]
    got = {r.doc_id: (r.text, r.removed) for r in line_dedup.dedup_lines(make_docs(rows)).collect()}
    assert got[0] == (rows[0][1], [])
    assert all(got[i] == (f"text of {i}\nmore of {i}", [1, 3]) for i in range(1, 60))
    assert all(got[100 + i] == (rows[60 + i][1], []) for i in range(30))
