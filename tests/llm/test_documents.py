"""Operators on documents against plain Python, on rows with nulls, blanks, repeats, long texts and clashing columns."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelweave.llm import fingerprints, lm_scoring, mixing, near_dedup, quality_rules, secret_scan, suffix_dedup
from panelweave.llm import textarrays as T
from panelweave.llm.components import components
from panelweave.llm.near_links import NearSpec, block_links, estimate, packed
from tests.llm import brute


def got(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_words_and_hashes_follow_the_bytes():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab é\t\n\x0b\x1f\x85 ") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    data, offsets = T.utf8(pa.array([*texts, None, ""]))
    w = T.words(data, offsets)
    found = [(int(r), bytes(data[s:e])) for r, s, e in zip(w.row, w.starts, w.ends)]
    assert found == [(i, x.encode()) for i, t in enumerate(texts) for x in brute.words(t)]
    by = {}
    for (_, x), h in zip(found, T.hashes(w)):
        assert by.setdefault(x, h) == h
    assert len(set(map(int, by.values()))) == len(by)


def test_quality_counts(docs, rows):
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert got(quality_rules.judge_documents(docs), *names) == Counter((r[0], *brute.counts(r[1])) for r in rows)


def test_line_rules_and_cleaning(spark):
    body = "\n".join(" ".join(f"word{7 * i + j}" for j in range(7)) + "." for i in range(10))
    dirty = body + "\nHome | News | About | Contact\nAll rights reserved.\n" + " ".join(["word"] * 31)
    rows = [(1, body), (2, dirty), (3, "Home | News | About | Contact\n" * 3 + body.split("\n")[0])]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    by = {r.doc_id: r for r in quality_rules.judge_documents(docs, with_text=True).collect()}
    assert (by[2].n_navigation, by[2].n_boilerplate, by[2].n_punctuation) == (1, 1, 1)
    assert by[1].kept and by[2].kept and by[2].clean_text == body
    clean = quality_rules.clean_documents(docs)
    assert clean.schema == docs.schema
    assert {r.doc_id: (r.text, r.n_chars) for r in clean.collect()} == {1: (body, len(body)), 2: (body, len(body))}


@pytest.mark.parametrize("spec", [lm_scoring.LmSpec(), lm_scoring.LmSpec(shard_bytes=20_000, flush=3_000), lm_scoring.LmSpec(shard_bytes=20_000, broadcast_bytes=0)])
def test_lm_base(docs, rows, spec):
    out = lm_scoring.score_documents(docs, spec).collect()
    want = brute.lm_base([(r[0], r[1]) for r in rows])
    keys = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out)
    assert keys == Counter((row[0], *w[:4], round(w[4], 6)) for row, w in zip(rows, want))
    assert all(r.score < 0 for r in out)


def test_lm_scores_equal_the_model_without_a_filter(docs, rows):
    """With so many bits that no probe is wrong the scores are those of the counts; the stated size costs little."""
    want = brute.lm_scores([(r[0], r[1]) for r in rows])
    for spec in (lm_scoring.LmSpec(bits=80, probes=24), lm_scoring.LmSpec(bits=80, probes=24, shard_bytes=20_000, broadcast_bytes=0)):
        out = Counter((r.doc_id, r.n_tokens, round(r.score, 6)) for r in lm_scoring.score_documents(docs, spec).collect())
        assert out == Counter((row[0], n, round(s, 6)) for row, (n, s) in zip(rows, want))
    by = {(row[0], n, row[1]): s for row, (n, s) in zip(rows, want)}
    stated = lm_scoring.score_documents(docs, lm_scoring.LmSpec()).select("doc_id", "n_tokens", "score").collect()
    exact = Counter()
    for (id, n, _), s in by.items():
        exact[id, n] = s
    assert sum(abs(r.score - exact[r.doc_id, r.n_tokens]) for r in stated if r.doc_id is not None) < 0.05 * sum(r.n_tokens for r in stated)


def test_lm_both_ways_agree(docs):
    one, other = (
        sorted((str(r.doc_id), r.n_tokens, round(r.score, 6)) for r in lm_scoring.score_documents(docs, spec).collect())
        for spec in (lm_scoring.LmSpec(shard_bytes=20_000), lm_scoring.LmSpec(shard_bytes=20_000, broadcast_bytes=0))
    )
    assert one == other


def test_filter_holds_every_level():
    rng = np.random.default_rng(0)
    keys, counts = np.unique(T.mix64(rng.integers(0, 1 << 62, 20_000).astype(np.uint64))), None
    counts = rng.integers(1, 300, len(keys))
    spec = lm_scoring.LmSpec()
    levels = lm_scoring.one_shard(0, lm_scoring.build_filter(keys, counts, spec).tobytes(), 0, spec).levels(keys)
    assert (levels >= np.frexp(counts)[1]).all() and (levels > np.frexp(counts)[1]).mean() < 0.05
    other = lm_scoring.one_shard(0, lm_scoring.build_filter(keys, counts, spec).tobytes(), 0, spec).levels(T.mix64(keys + np.uint64(9)))
    assert (other > 0).mean() < 0.05


def test_fingerprints(docs, rows):
    for spec in (fingerprints.FingerprintSpec(), fingerprints.FingerprintSpec(range_bytes=20_000)):
        out = fingerprints.fingerprint_documents(docs, spec).collect()
        assert len(out) == len(rows)
        prints = {r.fingerprint for r in out}
        assert len(prints) <= len({brute.sha(r[1] or "") for r in rows})
    ids = {r[0]: r for r in rows if sum(x[0] == r[0] for x in rows) == 1}
    order = sorted({r[0] for r in rows if r[0] is not None}, reverse=True)
    by = {r.doc_id: r for r in out}
    for a, b in zip(order, order[1:]):
        if a in ids and b in ids:
            text, after = ids[a][1] or "", ids[b][1] or ""
            changed = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
            assert (by[a].n_chars, by[a].edited_sha256) == (len(text), brute.sha(changed))
            x, y = brute.shingle_set(text), brute.shingle_set(changed)
            assert abs(by[a].near_edited - (len(x & y) / len(x | y) if x | y else 1.0)) < 0.25
            assert by[a].near_next == np.mean([p == q for p, q in zip(*(unprinted(by[i].fingerprint) for i in (a, b)))])


def unprinted(text):
    import base64

    return np.frombuffer(base64.b64decode(text), "<u4")


def test_one_document_is_its_own_successor(spark):
    docs = spark.createDataFrame([(7, "a b c d e f")], "doc_id long, text string")
    (row,) = fingerprints.fingerprint_documents(docs).collect()
    assert row.edited_sha256 == brute.sha("a b c d a b") and row.near_next == 1.0 and row.component_id == 7


@pytest.mark.parametrize("percent", [80, 85])
def test_near_components(docs, rows, percent):
    want = brute.components([(r[0], r[1]) for r in rows], percent)
    found = got(near_dedup.deduplicate(docs, NearSpec(percent=percent)), "doc_id", "n_shingles", "component_id")
    assert found == Counter((r[0], *w) for r, w in zip(rows, want))


def test_near_group_over_many_blocks(spark, monkeypatch):
    """A group of near copies whose links skip the least id, cut into blocks of a few documents."""
    from panelweave.llm import near_links

    monkeypatch.setattr(near_links, "BLOCK_DOCS", 7)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(60):
        text = list(base)
        for at in rng.sample(range(100), rng.randint(0, 4)):
            text[at] = f"v{rng.randint(0, 1000)}"
        rows.append((i, " ".join(text)))
    want = brute.components(rows, 80)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(near_dedup.deduplicate(docs, NearSpec()), "doc_id", "n_shingles", "component_id") == Counter((r[0], *w) for r, w in zip(rows, want))


def test_estimates_are_corrected_for_chance():
    rng = np.random.default_rng(1)
    spec = NearSpec()
    one = rng.integers(0, 1 << 32, (1, spec.minima), dtype=np.uint32)
    for share in (0.0, 0.5, 0.9):
        many = np.where(rng.random((400, spec.minima)) < share, one, rng.integers(0, 1 << 32, (400, spec.minima), dtype=np.uint32))
        assert abs(estimate(packed(one, 4)[0], packed(many, 4), spec).mean() - share) < 0.02
    sets = [np.arange(100, dtype=np.uint64), np.arange(5, 105, dtype=np.uint64), np.arange(60, 160, dtype=np.uint64)]
    low = np.zeros((3, 8), np.uint64)
    assert block_links(np.ones(3, bool), sets, low, spec) == [(0, 1)]


def test_one_of_each(docs, rows):
    out = near_dedup.one_of_each(docs)
    assert out.schema == docs.schema
    want = brute.components([(r[0], r[1]) for r in rows], 80)
    kept = {(r[0], r[1]) for r, w in zip(rows, want) if r[0] is None or r[0] == w[1]}
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter(kept)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(5, 5), (100, 90), (None, 3)], "a long, b long")
    found = {r.node: r.component for r in components(edges).collect()}
    assert found == {**{i: 0 for i in range(61)}, 90: 90, 100: 90}


def test_secret_spans(docs, rows):
    import re

    def plain(text):
        found = []
        for at, rule in enumerate(secret_scan.RULES):
            for m in re.compile(rule.pattern, re.ASCII | (re.I if rule.any_case else 0)).finditer(text or ""):
                if len(m[rule.group]) >= rule.least:
                    found.append((m.start(), at, f"{rule.kind}:{m.start()}:{m.end()}"))
        return ",".join(x[2] for x in sorted(found))

    out = secret_scan.scan_documents(docs, secret_scan.BlobLedger(docs.sparkSession))
    assert set(docs.columns) <= set(out.columns)
    found = got(out.select("doc_id", secret_scan.listed(F.col("spans")).alias("s")), "doc_id", "s")
    assert found == Counter((r[0], plain(r[1])) for r in rows)


def test_assign_rule_drops_short_values_as_matched():
    patterns = secret_scan.compile_rules(secret_scan.BASE)
    assert secret_scan.find_spans("password=token:abcdefg", patterns) == []
    assert secret_scan.find_spans("ſecret=abcdefgh", patterns) == []
    assert secret_scan.find_spans("é PassWD : 'abc/+=.-_", patterns) == [("assign", 2, 21)]


def test_ledger_scans_only_what_is_new(spark):
    ledger = secret_scan.BlobLedger(spark)
    first = spark.createDataFrame([(1, "token=abcdefg"), (2, "clean"), (3, "clean")], "doc_id long, text string")
    secret_scan.scan_documents(first, ledger).collect()
    assert ledger.entries().count() == 2
    second = spark.createDataFrame([(4, "token=abcdefg"), (5, "new AKIA" + "A" * 16)], "doc_id long, text string")
    out = {r.doc_id: len(r.spans) for r in secret_scan.scan_documents(second, ledger).collect()}
    assert out == {4: 1, 5: 1} and ledger.entries().count() == 3
    again = secret_scan.BlobLedger(spark, ledger.path, version="rules-2")
    secret_scan.scan_documents(first, again).collect()
    assert ledger.entries().count() == 5


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "é token=abcdefg end", 3), (2, "clean", 5), (3, None, None)], "doc_id long, text string, n_chars long")
    out = secret_scan.redacted(docs, secret_scan.BlobLedger(spark))
    assert out.schema == docs.schema
    assert sorted(map(tuple, out.collect())) [:2] == [(1, "é [SECRET] end", 14), (2, "clean", 5)]


def test_whole_secrets_are_found_and_redacted(spark):
    import duckdb

    from panelweave.llm.oracles import LLM_ORACLES

    rng = random.Random(9)
    made = lambda n, more="+/": "".join(rng.choice("ABCXYZabcxyz0189" + more) for _ in range(n))
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    lines = [made(64) for _ in range(12)] + [made(9) + "=="]
    headers = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0F\n\n"
    token, long = "github_pat_" + made(22, "") + "_" + made(59, ""), made(93, "-._~")
    texts = [f"a {begin}\n{head}" + sep.join(lines) + sep + tail + " b" for head in ("", headers) for sep in ("\n", "\r\n", "\\n", "\n> ", "\n-") for tail in (end, "")]
    texts += [f"a {begin}\n" + "\n".join(lines[:-1]) + "\n\nplain words stay b", f"a {begin} b", f"a {begin}\n{lines[0][:30]}... b"]
    texts += [f"a https://oauth2:{long}@host b", f"a ftp://{long}:{long}@host b", f"a {token} b"]
    rows = list(enumerate(texts))
    ledger = secret_scan.BlobLedger(spark)
    out = dict(map(tuple, secret_scan.redacted(spark.createDataFrame(rows, "doc_id long, text string"), ledger).collect()))
    for i, text in rows:
        assert out[i].startswith("a [SECRET]") and out[i].endswith(" b"), text
        assert not any(part in out[i] for part in [*(x[:12] for x in lines), lines[-1][:8], "BEGIN", "END", long[:9], token[-20:]]), text
    assert out[len(rows) - 6].endswith("]\n\nplain words stay b")
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    patterns = secret_scan.compile_rules(secret_scan.RULES)
    want = {i: ",".join(f"{k}:{a}:{b}" for k, a, b in secret_scan.find_spans(t, patterns)) for i, t in rows}
    assert dict(con.execute(f"select doc_id, spans from ({LLM_ORACLES['op6_secret_scans']})").fetchall()) == want


@pytest.mark.parametrize("spec", [suffix_dedup.RepeatSpec(), suffix_dedup.RepeatSpec(flush=2_000, range_bytes=10_000, block=3_000, hot_bytes=200, longest=40, broadcast_ids=0)])
def test_repeats(docs, rows, spec):
    rng = random.Random(8)
    passage = " ".join(str(rng.random()) for _ in range(9))
    short = [(r[0], r[1]) for r in rows]
    short += [(1000 + i, f"{i} intro {i * i} " + passage[i % 3 : 120 + 5 * i] + f" outro {i}") for i in range(9)]
    some = docs.sparkSession.createDataFrame(short, "doc_id long, text string").withColumn("m", F.lit("x"))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert got(suffix_dedup.deduplicate(some, spec), *names) == Counter((r[0], *w) for r, w in zip(short, brute.repeats(short)))


@pytest.mark.parametrize("spec", [suffix_dedup.RepeatSpec(), suffix_dedup.RepeatSpec(block=2_000, hot_bytes=1_000, longest=60)])
def test_repeats_of_crowded_and_null_ids(spark, spec):
    """Ids with many texts, copies with unlike tails, and periodic texts much longer than a block."""
    rng = random.Random(9)
    passages = [" ".join(str(rng.random()) for _ in range(5)) for _ in range(40)]
    rows = [(i, f"head {i} {p} tail {i * 7}") for i, p in enumerate(passages)]
    rows += [(None, f"{rng.random()} {p} {rng.random()}") for p in passages]
    rows += [(500, f"{rng.random()} {rng.choice(passages)} {rng.random()}") for _ in range(30)]
    rows += [(600 + i, passages[0] * 3 + f" {rng.random()} end") for i in range(60)]
    rows += [(700, "ab" * 9_000), (701, "ba" * 4_000 + "c"), (702, "abc" * 3_000), (None, "ab" * 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert got(suffix_dedup.deduplicate(df, spec), *names) == Counter((r[0], *w) for r, w in zip(rows, brute.repeats(rows)))


def test_lists_of_null_ids_stay_short(spark):
    """Every text is asked for its own anchors: the lists together grow with the rows, not with their square."""
    rng = random.Random(3)
    spec = suffix_dedup.RepeatSpec()
    sizes = []
    for n in (10, 40):
        passages = [" ".join(str(rng.random()) for _ in range(6)) for _ in range(n)]
        texts = [(suffix_dedup.LAST_ID, i, f"a {p} b") for i, p in enumerate(passages)]
        rows = [(i, i, f"c {p} d") for i, p in enumerate(passages)] + texts
        df = spark.createDataFrame(rows, "m long, u long, text string")
        pairs = suffix_dedup.shared_anchors(df, 10_000, spec).filter(F.col("m") == suffix_dedup.LAST_ID)
        lists = suffix_dedup.anchors_by_text(df.filter(F.col("m") == suffix_dedup.LAST_ID), pairs, spec).collect()
        assert len(lists) == n
        sizes.append(max(len(r.anchors) for r in lists))
    assert sizes[1] <= 2 * sizes[0]


def test_segments_are_cut(spark):
    spec = suffix_dedup.RepeatSpec(longest=100)
    text = "ab" * 5_000
    anchors = suffix_dedup.runs(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]), spec)[0]
    df = spark.createDataFrame([(1, 1, text, [int(a) for a in np.unique(anchors).view(np.int64)])], "m long, u long, text string, anchors array<long>")
    out = suffix_dedup.segments(df, spec).collect()
    assert sum(r.n for r in out) == len(text) - 49 and max(r.n for r in out) == 100 and max(len(r.bytes) for r in out) <= 149
    assert sum(bool(r.bytes) for r in out) <= 4


def test_repeat_classes_are_equal_strings():
    rng = random.Random(2)
    for _ in range(60):
        n, length, letters = rng.randint(1, 100), rng.randint(1, 12), rng.randint(1, 4)
        text = [rng.randint(0, letters) for _ in range(n)]
        number = suffix_dedup.repeat_classes(np.array(text, np.int16), length)
        for i in range(n - length + 1):
            for j in range(i):
                assert (number[i] == number[j]) == (text[i : i + length] == text[j : j + length])


def test_kept_text_of_repeats(spark):
    rng = random.Random(4)
    passage = " ".join(str(rng.random()) for _ in range(6))
    docs = spark.createDataFrame([(1, "head " + passage), (2, passage + " tail"), (3, "tail " + passage)], "doc_id long, text string")
    out = {r.doc_id: r.kept for r in suffix_dedup.deduplicate(docs, with_text=True).collect()}
    assert out == {1: "head " + passage, 2: " tail", 3: "tail"}


def test_mix_meets_targets(docs, rows):
    out = mixing.mix_documents(docs).collect()
    assert len(out) == len(rows)
    total = sum(len(brute.words(r[1])) for r in rows)
    assert sum(r["size"] for r in out) == total
    targets = {(r.source_size, round(r.target, 6)) for r in out}
    assert abs(sum(t for _, t in targets) - total) < 1e-3 * total
    assert all(t <= 3 * s + 1e-6 for s, t in targets)
    for s, t in targets:
        group = [r for r in out if (r.source_size, round(r.target, 6)) == (s, t)]
        assert all(r.taken <= 3 * r["size"] for r in group)
        assert abs(sum(r.taken for r in group) - t) <= max(r["size"] for r in group)


def test_mix_reshares_what_small_sources_cannot_take(spark):
    rows = [(i, "w " * 10, s) for i, s in enumerate(["a"] * 2 + ["b"] * 40 + ["c"] * 58 + [None] * 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.source_size: r.target for r in mixing.mix_documents(docs).collect()}
    # weights 5, 2, 1, 5 of 2000 words; a stops at 60, b at 1200
    left = 2000 - 60
    assert out[20] == 60.0 and out[400] == pytest.approx(left * 2 / 8) and out[580] == pytest.approx(left / 8) and out[1000] == pytest.approx(left * 5 / 8)


def test_mix_keeps_the_columns_and_reruns_agree(docs):
    one, other = (mixing.mixed_documents(df) for df in (docs, docs.repartition(5)))
    assert one.schema == docs.schema
    assert Counter(map(tuple, one.collect())) == Counter(map(tuple, other.collect()))
    planned = mixing.mix_documents(docs).filter("size > 0").groupBy("doc_id").sum("copies").collect()
    assert {r[0]: r[1] for r in one.groupBy("doc_id").count().collect()} == {r[0]: r[1] for r in planned if r[1]}


@pytest.mark.parametrize("limit", [0])
def test_salted_lookup_equals_broadcast(docs, limit):
    from panelweave.llm.attach import attach

    side = docs.groupBy("source").count().withColumnRenamed("count", "n")
    narrow = docs.select("doc_id", "source")
    one, other = (attach(narrow, side, "source", F.col("doc_id"), limit=k) for k in (limit, 1000))
    assert Counter(map(tuple, one.collect())) == Counter(map(tuple, other.collect()))


def test_empty_tables_give_no_rows(spark, empty):
    results = [
        quality_rules.judge_documents(empty), quality_rules.clean_documents(empty), lm_scoring.score_documents(empty),
        fingerprints.fingerprint_documents(empty), near_dedup.deduplicate(empty), near_dedup.one_of_each(empty),
        secret_scan.scan_documents(empty, secret_scan.BlobLedger(spark)), secret_scan.redacted(empty, secret_scan.BlobLedger(spark)),
        suffix_dedup.deduplicate(empty), mixing.mix_documents(empty), mixing.mixed_documents(empty),
    ]
    assert [r.count() for r in results] == [0] * len(results)
