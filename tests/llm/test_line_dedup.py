import random

from photolake.llm import line_dedup


def brute_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + (a[i] == b[j]))
    return best[-1][-1]


def test_patience_aligns_equal_lines_in_order():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(12) for _ in range(rng.randrange(15))] for _ in range(2))
        found = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:]))
        if len(set(a)) == len(a) and len(set(b)) == len(b):
            assert len(found) == brute_lcs(a, b)


PASSAGE = ["the first line of a passage that many hold", "and a second line which goes on and on", "third: the end of it all"]


def cut(make_docs, rows, **more):
    got = line_dedup.dedup_lines(make_docs(rows), **more)
    assert got.columns[:-1] == make_docs(rows).columns
    return sorted(((r.doc_id, r.text, r.removed) for r in got.collect()), key=str)


def test_blocks_go_from_later_documents(make_docs):
    own = lambda i: f"words that only document {i} has, and more of them here"
    rows = [(i, "\n".join([own(i), *PASSAGE, own(i + 100)])) for i in range(40)]
    rows += [(50, "\n".join([own(50), PASSAGE[2]])), (51, "\n\n  " + "\n ".join(PASSAGE) + "\n\n")]
    got = {d: (t, r) for d, t, r in cut(make_docs, rows)}
    assert got[0] == (rows[0][1], [])
    for i in range(1, 40):
        assert got[i] == (f"{own(i)}\n{own(i + 100)}", [1, 2, 3])
    assert got[50] == (rows[40][1], [])  # one short line is no block
    assert got[51][1] == [2, 3, 4]


def test_nulls_copies_and_repeats(make_docs, edges):
    long = "one line that has far more than twelve words in it so that it makes a block by itself"
    rows = edges + [(90, long), (90, long), (91, long), (92, long + "\n" + "x y z")]
    got = cut(make_docs, rows)
    assert len(got) == len(rows)
    assert [x for x in got if x[0] == 90] == [(90, long, [])] * 2
    assert (91, "", [0]) in got and (92, "x y z", [0]) in got
    assert (1, None, []) in got and (2, "", []) in got


def brute(rows, rare, block_words):
    """All pairs that share a line as the method pairs them, aligned, by plain loops over all documents."""
    from photolake.llm.line_dedup import aligned_lines

    docs = sorted({(d, t) for d, t in rows})
    lines = [[(x.strip(" \t\n\x0b\x0c\r"), i) for i, x in enumerate(t.split("\n")) if x.strip(" \t\n\x0b\x0c\r")] for _, t in docs]
    out = {}
    for n, own in enumerate(lines):
        partners = set()
        for line in {x for x, _ in own}:
            holders = [m for m in range(len(docs)) if any(x == line for x, _ in lines[m])]
            if holders[0] != n:
                partners.add(holders[0])
            if len(holders) <= rare and holders.index(n):
                partners.add(holders[holders.index(n) - 1])
        gone = set()
        for m in partners:
            gone |= {own[k][1] for k in aligned_lines([x for x, _ in own], [len(x.split()) for x, _ in own], [x for x, _ in lines[m]], block_words)}
        out[docs[n]] = sorted(gone)
    return out


def test_matches_brute_force(make_docs, sample):
    rng = random.Random(5)
    pool = [" ".join(rng.choice("ab cd ef gh ij".split()) for _ in range(rng.randrange(1, 9))) for _ in range(40)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 9)))) for i in range(80)]
    for rows, rare, block in ((rows, 4, 6), (sample, 16, 12)):
        want = brute([(d, t or "") for d, t in rows], rare, block)
        got = {(d, t): r for d, t, r in ((r.doc_id, dict(rows)[r.doc_id] or "", r.removed) for r in line_dedup.dedup_lines(make_docs(rows), rare, block).collect())}
        assert got == want


def test_empty_table(make_docs):
    assert line_dedup.dedup_lines(make_docs([])).count() == 0
