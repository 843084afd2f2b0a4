import math
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import xxhash

from photolake.llm import hmm


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), hmm.END]


def test_base_columns_match_brute_force(make_docs, edges, sample):
    rows = edges[1:] + [(d + 100, t) for d, t in sample]
    got = hmm.score(make_docs(rows), rounds=1).collect()
    out = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows}
    counts = Counter(w for d, t in rows if not out[d] for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((d, out[d], len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for d, t in rows)
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_held_out_texts_are_likelier_than_by_their_words(make_docs, sample):
    got = [r for r in hmm.score(make_docs(sample)).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def small_model(classes=5):
    rng = np.random.default_rng(1)
    draw = lambda *s: rng.uniform(0.1, 1, s)
    start, move, emit = draw(hmm.STATES), draw(hmm.STATES, hmm.STATES), draw(classes, hmm.STATES)
    return hmm.Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def test_forward_is_exact_and_sums_to_one():
    m = small_model(3)
    seqs = [np.array(x, "<u2") for x in product(range(3), repeat=4)]
    assert abs(sum(10 ** m.forward(seqs)) - 1) < 1e-9
    by_hand = []
    for s in seqs[:20]:
        total = 0.0
        a = m.start * m.emit[s[0]]
        for c in s[1:]:
            a = a @ m.move * m.emit[c]
        total = a.sum()
        by_hand.append(math.log10(total))
    assert np.allclose(m.forward(seqs[:20]), by_hand)


def test_expected_counts_and_rising_likelihood():
    rng = np.random.default_rng(2)
    seqs = [rng.integers(0, 5, rng.integers(1, 40)).astype("<u2") for _ in range(50)]
    m = small_model()
    counts, log = m.expected(seqs)
    assert abs(log - m.forward(seqs).sum()) < 1e-6
    k = hmm.STATES
    assert abs(counts[:k].sum() - 50) < 1e-6 and abs(counts[k : k + k * k].sum() - sum(len(s) - 1 for s in seqs)) < 1e-6
    assert np.allclose(counts[k + k * k :].reshape(5, k).sum(1), np.bincount(np.concatenate(seqs), minlength=5))
    before = m.forward(seqs).sum()
    for _ in range(5):
        m = hmm.Model.of_counts(m.expected(seqs)[0], 5)
        after = m.forward(seqs).sum()
        assert after > before - 0.5
        before = after


def test_segments_change_nothing(monkeypatch):
    rng = np.random.default_rng(3)
    seqs = [rng.integers(0, 5, n).astype("<u2") for n in (1, 2, 7, 8, 9, 16, 40, 41, 3, 24)]
    m = small_model()
    counts, log = m.expected(seqs)
    for segment in (1, 4, 8, 41):
        monkeypatch.setattr(hmm, "SEGMENT", segment)
        other, same = m.expected(seqs)
        assert np.allclose(counts, other) and abs(log - same) < 1e-9


def brute_scores(rows, rounds):
    """Scores of all texts by plain loops: words, classes, Baum-Welch over whole texts, forward recursion."""
    out = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows}
    counts = Counter(w for d, t in rows if not out[d] for w in tokens(t))
    n = sum(counts.values())
    frequent = sorted(w for w, c in counts.items() if c * hmm.FREQUENT_SHARE >= n and w != hmm.END)

    def cls(w):
        if w == hmm.END:
            return 0
        if w in frequent:
            return 1 + frequent.index(w)
        h = xxhash.xxh64_intdigest(w[-hmm.SUFFIX_CHARS :].encode(), 42)
        return 1 + len(frequent) + (h - (1 << 64) if h >> 63 else h) % hmm.SUFFIXES

    size, once = np.zeros(1 + len(frequent) + hmm.SUFFIXES), Counter()
    for w, c in counts.items():
        size[cls(w)] += c
        once[cls(w)] += c == 1
    m = hmm.Model.first(size)
    texts = {d: [cls(w) for w in tokens(t)] for d, t in rows}

    def alphas(x):
        a, found = m.start * m.emit[x[0]], []
        for k, c in enumerate(x):
            a = a if k == 0 else a @ m.move * m.emit[c]
            found.append((a / a.sum(), a.sum()))
            a = a / a.sum()
        return found

    for _ in range(rounds):
        begin, moves, emits = np.zeros(hmm.STATES), np.zeros((hmm.STATES, hmm.STATES)), np.zeros((len(size), hmm.STATES))
        for d, x in texts.items():
            if out[d]:
                continue
            forward, beta = alphas(x), np.ones(hmm.STATES)
            for k in range(len(x) - 1, -1, -1):
                share = forward[k][0] * beta
                emits[x[k]] += share
                if k == 0:
                    begin += share
                else:
                    moves += np.outer(forward[k - 1][0], m.emit[x[k]] * beta) * m.move / forward[k][1]
                    beta = m.move @ (m.emit[x[k]] * beta) / forward[k][1]
        m = hmm.Model.of_counts(np.concatenate([begin, moves.ravel(), emits.ravel()]), len(size))

    def within(w):
        c, k = counts[w], cls(w)
        unseen = (once[k] + 0.5) / (size[k] + 1) if size[k] else 1.0
        return math.log10(c / size[k] * (1 - unseen) if c else unseen)

    return {d: sum(math.log10(s) for _, s in alphas(texts[d])) + sum(within(w) for w in tokens(t)) for d, t in rows}


def test_scores_match_brute_force(make_docs, sample, monkeypatch):
    monkeypatch.setattr(hmm, "BLOCK_CHARS", 2000)
    monkeypatch.setattr(hmm, "SEGMENT", 100)
    rows = [(d, (t or "")[:3000]) for d, t in sample if d is not None][:60] + [(10_000, "ZZ top never seen"), (10_001, "")]
    want = brute_scores(rows, 2)
    got = {r.doc_id: r.score for r in hmm.score(make_docs(rows), rounds=2).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[d] - want[d]) < 1e-6 * max(1, abs(want[d])) for d in want)


def test_training_ends_when_the_likelihood_has_settled(make_docs, sample):
    blocks = hmm.in_blocks(make_docs(sample))
    words, totals = hmm.classed(blocks)
    seqs = hmm.sequences(blocks, words, totals)
    _, logs = hmm.train(seqs, totals, rounds=30, tolerance=1e-3)
    gains = [(b - a) / -a for a, b in zip(logs, logs[1:], strict=False)]
    assert 2 <= len(logs) < 30 and all(g >= 1e-3 for g in gains[:-1]) and gains[-1] < 1e-3


def test_words_of_a_class_sum_to_one():
    totals = hmm.Words(13, 4, np.array([13.0, 0]), np.array([2.0, 0]))
    shares = 10 ** totals.within(np.array([1, 1, 5, 6, 0]), np.zeros(5, int))
    assert abs(shares.sum() - 1) < 1e-9 and totals.within(np.array([0]), np.array([1]))[0] == 0


def test_empty_table_and_nulls(make_docs):
    assert hmm.score(make_docs([])).count() == 0
    (row,) = hmm.score(make_docs([(None, None)])).collect()
    assert (row.n_tokens, row.train_tokens, row.held_out) == (1, 1, False)
