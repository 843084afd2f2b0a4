"""The prefix trie against a plain version over small tables, deep conversations included."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from photolake.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, key string, pos int, piece string"


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [(x[2], x[3]) for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c in sorted(built):
        seen = hashlib.sha256()
        members[(0, seen.digest())].append((c, None, 0))
        for d, (role, text) in enumerate(built[c], 1):
            before = (d - 1, seen.digest())
            seen.update(len(role).to_bytes(8, "big") + role + len(text).to_bytes(8, "big") + text)
            members[(d, seen.digest())].append((c, before, len(text)))
    children, totals = defaultdict(int), {}
    for k, m in members.items():
        if m[0][1] is not None:
            children[m[0][1]] += 1
    for k in sorted(members, key=lambda k: -k[0]):
        leaves, saved = totals.setdefault(k, [0, 0])
        leaves += children[k] == 0
        saved += (len(members[k]) - 1) * members[k][0][2]
        totals[k] = [leaves, saved]
        if (up := members[k][0][1]) is not None:
            above = totals.setdefault(up, [0, 0])
            above[0] += leaves
            above[1] += saved
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c, *_ in m if len(built[c]) == k[0])
        up = m[0][1]
        out.append((m[0][0], k[0], None if up is None else members[up][0][0], len(m), children[k], *totals[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def check(spark, rows):
    df = spark.createDataFrame([(*r, "k", 1, "p") for r in rows], SCHEMA)
    got = prefix_trie.prefix_trie(df).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)


def test_shared_beginnings_ties_and_nulls(spark):
    draw = random.Random(1)
    texts = ["", None, "hello", "grüße 漢字", "a" * 3000]
    rows = [(c, draw.choice([t, t, None, t // 2]), draw.choice(["user", "assistant", None, ""]), draw.choice(texts[: 1 + c % 5])) for c in range(-6, 60) if c % 7 for t in range(draw.randrange(1, 14))]
    rows += [(None, 0, "user", "lost"), (60, 0, "user", "x"), (60, 0, "user", "x"), (9007199254740993, 0, "user", "x")]
    check(spark, rows)


def test_deep_and_hot_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "APART", 64)
    monkeypatch.setattr(prefix_trie, "IDS_APART", 16)
    rows = [(5, t, "user", f"turn {t}") for t in range(700)]
    rows += [(c, t, "user", f"turn {t}" if t < 64 * (c % 9) else f"own {c} {t}") for c in (10, 15, 20, 25, 30, 35) for t in range(150 + c * 4)]
    rows += [(c, t, "user", "copy") for c in range(100, 190, 5) for t in range(65)]
    rows += [(c, 0, "user", "same") for c in range(200, 300)]
    check(spark, rows)


@pytest.mark.parametrize("rows", [[], [(1, 0, "user", "a")], [(5, None, None, None)]])
def test_tiny_tables(spark, rows):
    check(spark, rows)
