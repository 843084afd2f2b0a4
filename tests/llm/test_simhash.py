import random
import re

import numpy as np
import xxhash

from photolake.llm import simhash
from photolake.llm.components import connected_components


def brute_fp(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(items, linked):
    root = list(range(len(items)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(items))]


def near(a, b):
    return (a ^ b).bit_count() <= 2


def test_documents_match_brute_force(make_docs, edges, sample):
    rows = edges + sample
    got = sorted((str(r.doc_id), r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(make_docs(rows)).collect())
    fps = [brute_fp(t) for _, t in rows]
    root = groups(fps, near)
    smallest = {}
    for (d, _), g in zip(rows, root, strict=True):
        if d is not None:
            smallest[g] = min(d, smallest.get(g, d))
    assert got == sorted((str(d), f, smallest.get(g)) for (d, _), f, g in zip(rows, fps, root, strict=True))


def ball(count, seed):
    """Fingerprints in chains of single-bit changes, so shards are crowded."""
    rng = random.Random(seed)
    out = {rng.getrandbits(64)}
    while len(out) < count:
        out.add(rng.choice(sorted(out)) ^ 1 << rng.randrange(64) ^ (1 << rng.randrange(64) if rng.random() < 0.4 else 0))
    return [x - (1 << 64) if x >> 63 else x for x in sorted(out)]


def test_links_of_crowded_shards(spark):
    fps = ball(300, 1) + ball(60, 2) + ball(1, 3)
    table = spark.createDataFrame([(x,) for x in fps], "fp long")
    want = groups([x & (1 << 64) - 1 for x in fps], near)
    for most in (8192, 20):
        roots = {r.node: r.root for r in connected_components(simhash.link(table, shard_fingerprints=most)).collect()}
        got = {}
        for x, g in zip(fps, want, strict=True):
            got.setdefault(g, set()).add(roots.get(x, x))
        assert all(len(x) == 1 for x in got.values()) and len(set().union(*got.values())) == len(set(want))


def test_tree_search_finds_all_pairs():
    fps = np.array(ball(500, 4), "int64")
    keys = np.sort(np.arange(500) % 3)
    forest = simhash.BKForest(keys, fps.view("uint64"))
    found = {(int(a), int(b)) for x, y in forest.links(2) for a, b in zip(x, y, strict=True)}
    want = {(i, j) for i in range(500) for j in range(i + 1, 500) if keys[i] == keys[j] and near(int(fps[i]) & (1 << 64) - 1, int(fps[j]) & (1 << 64) - 1)}
    assert found == want


def test_empty_table(make_docs):
    assert simhash.near_duplicates(make_docs([])).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (7, 6), (200, 201)], "a long, b long")
    roots = {r.node: r.root for r in connected_components(edges).collect()}
    assert roots == {**{i: 0 for i in range(41)}, 200: 200, 201: 200}
