import random

import pytest

import corpus_pipeline
from photolake.llm import similar


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def firsts(rows):
    """The first of each group, all pairs compared."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    near = 0
    for i in range(len(rows)):
        for j in range(i):
            if likeness(sets[i], sets[j]) >= 0.8:
                near += rows[i][1] != rows[j][1]
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return sorted({min(rows[j][0] for j in range(len(rows)) if root[j] == r) for r in root}), near


def edited(rows, seed):
    """Copies with single words changed, some so that they stay near and some not, and chains of such copies."""
    rng = random.Random(seed)
    out = []
    for k in range(12):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 500))]
        for c in range(8):
            out.append((10_000 + 100 * k + c, " ".join(words)))
            words = list(words)
            for _ in range(max(1, int(len(words) * rng.choice([0.004, 0.01, 0.015, 0.03])))):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_stage_matches_brute_force(spark, make_docs, sample, seed):
    rows = edited(None, seed) + [(d, t) for d, t in sample if d is not None][:60] + [(5001, " \n "), (5002, ""), (5003, None)]
    want, near = firsts(rows)
    assert near > 20
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, make_docs(rows), None).collect())
    assert got == want


def test_recall_of_candidates_near_the_bound():
    """Share of pairs of likeness 0.8 to 0.85 that agree in a band and lie within the radius."""
    rng = random.Random(3)
    found = total = 0
    while total < 300:
        words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        other = list(words)
        for _ in range(8):
            other[rng.randrange(400)] = f"x{rng.randrange(10**6)}"
        if 0.8 <= likeness(shingles(" ".join(words)), shingles(" ".join(other))) < 0.85:
            a, b = (similar.shingle_hashes(" ".join(x), 5) for x in (words, other))
            total += 1
            far = (similar.majority(a) ^ similar.majority(b)).bit_count()
            found += far <= similar.RADIUS and not set(similar.bands(a)).isdisjoint(similar.bands(b))
    print("recall", found, "of", total)
    assert found >= 0.99 * total
