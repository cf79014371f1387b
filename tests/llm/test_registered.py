"""The registered queries: against SQL where there is some, else against plain Python or the library."""

import os
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from panelweave.llm import mixing, near_dedup, quality_rules, secret_scan, sentencepiece_codec
from panelweave.llm.oracles import LLM_ORACLES
from panelweave.llm.queries import LLM_QUERIES
from tests.compare import differences
from tests.llm import brute


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{os.path.join(sf, t)}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(con):
    return con.execute("select doc_id, text from documents order by doc_id").fetchall()


def test_names():
    assert {n.split("_")[0] for n in LLM_QUERIES} == {*(f"op{i}" for i in range(1, 14)), "pipeline"}
    assert set(LLM_QUERIES) - set(LLM_ORACLES) == {"op2_lm_scoring", "op4_fingerprints", "op5_sentencepiece", "op12_language_id", "pipeline"}


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_query_matches_sql(spark, sf, con, name):
    assert differences(LLM_QUERIES[name](spark, sf), con, LLM_ORACLES[name]) == []


def test_lm_query(spark, sf, texts):
    out = {r.doc_id: r for r in LLM_QUERIES["op2_lm_scoring"](spark, sf).collect()}
    assert len(out) == len(texts)
    for (id, _), want in zip(texts, brute.lm_base(texts)):
        r = out[id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[:4]
        assert r.base_score == pytest.approx(want[4])
    held = [r for r in out.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_fingerprint_query(spark, sf, texts):
    out = {r.doc_id: r for r in LLM_QUERIES["op4_fingerprints"](spark, sf).collect()}
    order = texts[::-1]
    groups = dict(zip((i for i, _ in texts), (c for _, c in brute.components(texts, 80))))
    error = []
    for (id, text), (_, after) in zip(order, order[1:] + order[:1]):
        changed = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        r = out[id]
        assert (r.n_chars, r.edited_sha256, r.component_id) == (len(text), brute.sha(changed), groups[id])
        a, b, c = map(brute.shingle_set, (text, changed, after))
        error += [r.near_edited - len(a & b) / len(a | b), r.near_next - len(a & c) / len(a | c)]
    assert max(map(abs, error)) < 0.2 and sum(e * e for e in error) / len(error) < 0.05**2


def test_sentencepiece_query(spark, sf, texts):
    sp = pytest.importorskip("sentencepiece")
    library = sp.SentencePieceProcessor(model_file=sentencepiece_codec.public_model())
    found = Counter(tuple(r)[:4] for r in LLM_QUERIES["op5_sentencepiece"](spark, sf).collect())
    want = Counter()
    for id, text in texts:
        ids = library.encode(text or "")
        want[(id, len(ids), brute.sha(",".join(map(str, ids))), brute.sha(library.decode(ids)))] += 1
    assert found == want


def brute_pipeline(rows):
    """The pipeline's decisions in plain Python: (doc_id, text) with repeats."""
    judged = [(i, quality_rules.judge(t, quality_rules.LineRules()), s) for i, t, s in rows]
    rows = [(i, j[-1], s) for i, j, s in judged if j[6]]
    keep = {i for (i, _, _), c in zip(rows, brute.components([r[:2] for r in rows], 80)) if c[1] == i}
    patterns = secret_scan.compile_rules(secret_scan.RULES)
    masked = []
    for i, t, s in rows:
        if i in keep:
            out, end = [], 0
            for _, a, b in secret_scan.find_spans(t, patterns):
                out += [t[end:a], "[SECRET]"] if a >= end else []
                end = max(end, b)
            masked.append((i, "".join(out) + t[end:], s))
    return masked


def test_pipeline(spark, sf, con):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near copies", "secrets", "mix", "encode"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    table = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        table = stage(spark, table, sf)
        assert table.schema == docs.schema
    rows = con.execute("select doc_id, text, source from documents order by doc_id").fetchall()
    masked = brute_pipeline(rows)
    assert Counter((r.doc_id, r.text) for r in table.collect()) == Counter((i, t) for i, t, _ in masked)
    mixed = mixing.mixed_documents(table)
    copies = Counter()
    for r in mixing.mix_documents(table).collect():
        copies[r.doc_id] = r.copies if r["size"] else 0
    assert Counter(r.doc_id for r in mixed.collect()) == +copies
    out = Counter((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, sf).collect())
    own = sentencepiece_codec.codec(sentencepiece_codec.public_model())
    assert out == Counter({(i, brute.sha(own.listed(own.encode(t)[0]))): copies[i] for i, t, _ in masked if copies[i]})


def test_stages_keep_clean_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert corpus_pipeline.quality(spark, docs, sf).count() > 0.7 * docs.count()
    kept = near_dedup.deduplicate(docs)
    assert kept.filter("kept").count() == kept.select("component_id").distinct().count()
