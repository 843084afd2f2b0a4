import corpus_pipeline
from photolake.llm import line_dedup, simhash


def stages(spark, docs):
    out = []
    for name, stage in corpus_pipeline.STAGES:
        path_docs = stage(spark, docs, None).cache()
        out.append((name, path_docs))
        docs = path_docs
    return out


def test_stages_on_real_texts_and_edges(spark, make_docs, edges, sample):
    rows = edges + [(d + 100, t) for d, t in sample] + [(9000 + d, t) for d, t in sample[:20]]
    docs = make_docs(rows)
    done = dict(stages(spark, docs))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_duplicates", "secret_scan", "packing"]
    for name in names[:-1]:
        assert done[name].columns == docs.columns
    kept = {r.doc_id: r.text for r in done["quality_rules"].collect()}
    assert kept.items() <= {**dict(rows)}.items()
    cut = {r.doc_id: r for r in done["line_dedup"].collect()}
    assert cut.keys() == kept.keys() and all(r.n_chars == len(r.text) for r in cut.values())
    groups = {}
    for r in simhash.near_duplicates(done["line_dedup"]).collect():
        groups.setdefault(r.component_id, []).append(r.doc_id)
    assert sorted(r.doc_id for r in done["near_duplicates"].collect()) == sorted(min(x) for x in groups.values())
    assert "token = \"" not in " ".join(r.text.lower() for r in done["secret_scan"].collect())
    pieces = done["packing"].collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in done["secret_scan"].collect()}
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())


def test_empty_table(spark, make_docs):
    assert all(df.count() == 0 for _, df in stages(spark, make_docs([])))


def test_line_dedup_keeps_first_copies(make_docs, sample):
    rows = [(d, t) for d, t in sample[:30]] + [(d + 500, t) for d, t in sample[:30]]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(make_docs(rows)).collect()}
    assert all(len(got[d + 500]) <= len(got[d]) for d, _ in sample[:30])
