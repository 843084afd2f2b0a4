import random

from photolake.llm import syncmers


def brute_chosen(text):
    """Places of closed syncmers by the definition."""
    import numpy as np

    codes = np.array([ord(c) for c in text], "uint64")
    inner = syncmers.mixed(syncmers.windows(codes, syncmers.INNER)).tolist()
    span = syncmers.K - syncmers.INNER + 1
    return [i for i in range(len(text) - syncmers.K + 1) if min(inner[i : i + span]) in (inner[i], inner[i + span - 1])]


def brute_anchors(text):
    """(hash, place) of all anchors in the order of the text, by loops."""
    return [(int(syncmers.anchors(text[i : i + syncmers.K]).hashes[0]), i) for i in (brute_chosen(text) if len(text) >= syncmers.K else [])]


def brute_likeness(a, b):
    """By the longest common run in order, by a table; the r-th of equal anchors meets the r-th."""
    def named(text):
        seen = {}
        return [(h, seen.setdefault(h, []).append(0) or len(seen[h])) for h, _ in brute_anchors(text)]

    x, y = named(a), named(b)
    if not x or not y:
        return syncmers.likeness(syncmers.anchors(a), syncmers.anchors(b)) if (a and b) else float(not a and not b)
    place = {h: k for k, h in enumerate(y)}
    common = [place[h] for h in x if h in place]
    best = []
    for n, h in enumerate(common):
        best.append(1 + max([best[m] for m in range(n) if common[m] < h], default=0))
    j = max(best, default=0) / (len(x) + len(y) - len(common))
    return 2 * j / (1 + j)


def test_all_rows_and_next_documents(make_docs, edges, sample):
    rows = edges[1:] + [(d + 100, t) for d, t in sample]
    got = syncmers.against_edits(make_docs(rows)).collect()
    assert len(got) == len(rows)
    unique = sorted({(d, t or "") for d, t in rows if d != 5})
    order = [t for _, t in unique]
    by_id = {r.doc_id: r for r in got}
    for i, (d, t) in enumerate(unique):
        following = order[(i + 1) % len(order)] if d != 4 else dict(rows)[5]
        r = by_id[d]
        assert r.edited == t[: len(t) - len(t) // 2] + following[: len(t) // 2] and r.n_chars == len(t)
        assert r.fingerprint == syncmers.anchors(t).shown() and r.edited_fingerprint == syncmers.anchors(r.edited).shown()
        assert abs(r.near_edited - brute_likeness(t, r.edited)) < 1e-9 and abs(r.near_next - brute_likeness(t, following)) < 1e-9
    assert by_id[5].fingerprint == by_id[6].fingerprint
    long = [r for r in got if r.n_chars > 400 and r.doc_id != 7]
    assert sum(0.2 < r.near_edited < 0.8 for r in long) > 0.95 * len(long)


def test_anchors_by_definition():
    rng = random.Random(3)
    for n in (0, 1, 15, 16, 17, 60, 400, 3000, 9000):
        text = "".join(rng.choice("abcdé 😀") for _ in range(n))
        kept = brute_anchors(text)
        got = syncmers.anchors(text)
        if kept:
            assert list(zip(got.hashes.tolist(), got.places.tolist(), strict=True)) == kept and got.limit == 1 << 32
            some = syncmers.anchors(text, 0.25)
            assert [x for x in kept if x[0] < some.limit] == list(zip(some.hashes.tolist(), some.places.tolist(), strict=True))
            assert len(set(some.hashes.tolist())) >= min(syncmers.LEAST, len({h for h, _ in kept}))
        else:
            assert len(got.hashes) == min(1, n)


def test_a_text_against_its_fivefold():
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefgh ") for _ in range(2000))
    assert abs(syncmers.likeness(syncmers.anchors(text), syncmers.anchors(text * 5)) - 1 / 3) < 0.01
    assert syncmers.likeness(syncmers.anchors(text * 5), syncmers.anchors(text * 5)) == 1



def test_long_texts_are_cut_without_a_seam(monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh ") for _ in range(20_000))
    whole = syncmers.anchors(text)
    assert len(whole.hashes) > 2 * syncmers.LEAST  # they grow with the text
    monkeypatch.setattr(syncmers, "CHARS_AT_ONCE", 100)
    assert syncmers.anchors(text).shown() == whole.shown()


def test_a_moved_passage_is_found_by_its_places():
    rng = random.Random(5)
    draw = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, text, other = draw(700), draw(60_000), draw(50_000)
    a, b = syncmers.anchors(text[:20_000] + passage + text[20_000:]), syncmers.anchors(other[:40_000] + passage + other[40_000:])
    here, there, _ = syncmers.matched(a, b)
    assert len(here) > 15 and set(there - here) == {20_000} and here.min() >= 20_000 and here.max() < 20_700
    assert 0 < syncmers.likeness(a, b) < 0.05


def test_error_against_all_anchors(sample):
    """The share of anchors that is kept moves the likeness little; with fraction 1 it is exact."""
    texts = [t for _, t in sample if t]
    texts += [t + " " + u for t, u in zip(texts, texts[1:], strict=False)] + [" ".join(texts[k::7]) for k in range(7)]
    errors = []
    for t, u in zip(texts, texts[1:], strict=False):
        edited = syncmers.edited_text(t, u)
        exact = syncmers.likeness(syncmers.anchors(t, 1), syncmers.anchors(edited, 1))
        errors.append(abs(exact - syncmers.likeness(syncmers.anchors(t), syncmers.anchors(edited))))
    print("error of likeness: mean", sum(errors) / len(errors), "most", max(errors))
    assert sum(errors) / len(errors) < 0.02 and max(errors) < 0.1


def test_single_row_and_empty_table(make_docs):
    assert syncmers.against_edits(make_docs([])).count() == 0
    (row,) = syncmers.against_edits(make_docs([(None, "abc" * 20)])).collect()
    assert row.doc_id is None and row.near_next == 1.0
