"""Chat formatting against a plain version, on its escapes, long conversations and odd rows."""

import hashlib
import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from photolake.llm import chat, queries  # noqa: E402

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "conv_id long, turn long, role string, text string, ids string, mask int, seq string, _c long"
SAID = "\\### Assistant: </turn> ok"


def plain(rows):
    """By conversation: turns, their digest, and the assistant texts joined."""
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, found in by.items():
        found.sort(key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))
        learned = "".join(t for *_, r, t in found if r == "assistant")
        every = "".join(f"{r}\n{t}\n" for *_, r, t in found)
        out[c] = (len(found), hashlib.sha256(every.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x", 3, "y", 5) for r in rows], SCHEMA)
    made = chat.format_conversations(df, VOCABULARY)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(made, VOCABULARY).collect()}
    assert got == plain(rows)
    return made.collect()


ODD = ["", " ", "\n", "\\", "\\\\", "a\\", SAID, "### User: x", "#### User: ### User:", "\\\\### Other:\\", "</turn>", "\n</turn>\n", "</role> </turn", "</tur", "### ", "<|endoftext|>", "\x00\x07 é́ 漢字 \U0001f600", "### Assistant:" * 3, "x\r\n\ty  "]


def test_escapes_are_undone():
    for text in ODD:
        assert chat.unescape(chat.escape(text)) == text
    draw = random.Random(4)
    bits = ["\\", "### User:", "### Assistant:", "</turn>", "</role>", "#", " ", "\n", "<", "/turn>", "ok"]
    for _ in range(3000):
        turns = [(draw.choice(["user", "assistant", "tool", "", "a </role> b", "\\"]), "".join(draw.choices(bits, k=draw.randrange(9)))) for _ in range(3)]
        template = chat.template_of(VOCABULARY)
        _, ids, mask, forms = template.assemble([r for r, _ in turns], [t for _, t in turns])
        assert template.turns(ids, mask)[0] == turns
        assert template.turns(ids, mask)[1] == [t for r, t in turns if r == "assistant" and t]
        assert chat.read_text("".join(forms)) == turns
        said = [i for r, t in turns for x in ([t] if r in chat.HEADS else [r, t]) for i in template.tokenizer.encode(chat.escape(x), add_special_tokens=False).ids]
        assert ids[ids < template.first].tolist() == said
        assert (ids >= template.first).sum() == sum(2 if r in chat.HEADS else 3 for r, _ in turns)


def test_odd_rows(spark):
    roles = ["user", "assistant", None, "", "tool", "### User: ", "assistant"]
    rows = [(c, t, roles[(c + t) % 7], ODD[(3 * c + t) % len(ODD)]) for c in range(6) for t in range(5)]
    rows += [(None, None, None, None), (None, 1, "assistant", "null conversation"), (7, None, "assistant", None), (7, 0, "user", "a"), (7, 0, "user", "a"), (7, 0, "assistant", "tie"), (-8, -5000, "assistant", "early")]
    made = check(spark, rows)
    for r in made:  # turns without a place are a part of their own
        before = sum(len(x.ids) for x in made if x.conv_id == r.conv_id and (x.chunk is not None, x.chunk or 0, x.seq) < (r.chunk is not None, r.chunk or 0, r.seq))
        assert len(r.ids) == len(r.mask) and r.start == before and r.parts == sum(x.conv_id == r.conv_id for x in made)


def test_long_conversations_in_parts(spark, monkeypatch):
    rows = [(1, t, "assistant" if t % 2 else "user", f"turn {t} of many") for t in range(9000)]
    rows += [(2, 0, "user", "word " * 60000), (2, 1, "assistant", "other " * 60000), (2, 2, "user", "end"), (3, 0, "assistant", "short")]
    made = check(spark, rows)
    one = sorted((r for r in made if r.conv_id == 1), key=lambda r: (r.chunk, r.seq))
    assert len(one) == one[0].parts >= 3 and {r.chunk for r in one} == {0, 1, 2}
    assert [r.start for r in one] == [sum(len(x.ids) for x in one[:i]) for i in range(len(one))]
    assert all(len(r.ids) < 2 * chat.PART_IDS for r in one)
    assert sum(r.conv_id == 2 for r in made) >= 2


def test_empty_table(spark):
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], SCHEMA), VOCABULARY), VOCABULARY).collect() == []


def test_query_holds_the_planted_conversation(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", "hi")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in queries.op11_chat(spark, str(tmp_path)).collect()}
    assert set(got) == {1, -7}
    assert (got[-7].n_turns, got[-7].loss_chars, got[-7].loss_sha256) == (2, len(SAID), hashlib.sha256(SAID.encode()).hexdigest())
