import re
from collections import Counter

from photolake.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_counts_match_brute_force(make_docs, edges, sample):
    rows = edges + sample
    got = quality.apply_rules(make_docs(rows)).collect()
    assert len(got) == len(rows)
    found = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)
    assert found == sorted((str(d), *brute(t)) for d, t in rows)


def test_rules(make_docs):
    clean = "the house of the old man is by the river and it was built with stone from that hill"
    rows = [(1, clean), (2, clean.replace(" ", "%%% ")), (3, "HEY!! " + " ".join(f"W{i}!!" for i in range(30))), (4, "\n".join(["a line of text in here"] * 9)), (5, "few words")]
    got = {r.doc_id: r for r in quality.apply_rules(make_docs(rows)).collect()}
    assert got[1].kept and got[1].failed == ""
    assert "symbols" in got[2].failed and not got[2].kept
    assert "exclamations" in got[3].failed
    assert got[4].base_failed and "repeated_lines" in got[4].failed
    assert got[5].base_failed and not got[5].kept


def test_empty_table(make_docs):
    assert quality.apply_rules(make_docs([])).count() == 0


def test_plan_has_no_python_and_no_shuffle(make_docs, edges):
    plan = quality.apply_rules(make_docs(edges))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
