"""Clusters, languages and manifests against plain Python: ties, nulls, repeats, empty tables, clashing columns."""

import hashlib
import itertools
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.llm import centroids, language_id, manifest
from panelweave.llm.queries import LLM_QUERIES


# ---- clusters ----------------------------------------------------------------------------------


def lloyd(rows, spec):
    """Every vector against every centroid in every round."""
    kept = [
        (i, [math.floor(spec.scale * float(x)) for x in v])
        for i, v in rows
        if v is not None and len(v) == spec.dim and all(x is not None and math.isfinite(x) for x in v)
    ]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{spec.seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cents = [v for _, v in order[: spec.clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))

    for _ in range(spec.rounds):
        held = defaultdict(list)
        for _, v in kept:
            held[nearest(v)[1]].append(v)
        for j, vs in held.items():
            cents[j] = [sum(col) // len(vs) for col in zip(*vs)]
    last = [(i, *nearest(v)) for i, v in kept]
    own = Counter()
    for _, d, j in last:
        own[j] += d
    total = sum(own.values())
    return Counter((i, j, d, own[j], total, hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for i, d, j in last)


def vectors(rng, n, dim, spread=0.05):
    middles = rng.normal(size=(5, dim))
    return [[float(np.float32(x)) for x in middles[rng.integers(5)] + spread * rng.normal(size=dim)] for _ in range(n)]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int") if len(rows[0]) == 3 else None
    return df.selectExpr("*", "'x' as cluster", "1 as distance", "2 as block", "3 as v")


@pytest.mark.parametrize("block", [7, 4096])
def test_clusters(spark, monkeypatch, block):
    monkeypatch.setattr(centroids, "BLOCK", block)
    spec = centroids.Clustering(clusters=4, rounds=6, dim=3, scale=16)
    rng = np.random.default_rng(3)
    good = vectors(rng, 120, 3, 0.6)
    rows = [(i, v) for i, v in enumerate(good)]
    rows += [(200, None), (201, []), (202, [1.0, 2.0]), (203, [1.0, None, 2.0]), (204, [1.0, float("nan"), 2.0]), (205, [float("inf"), 0.0, 0.0])]
    rows += [(None, good[0]), (None, None), (3, good[3]), (3, good[4]), *[(300 + i, [0.5, 0.5, 0.5]) for i in range(40)]]
    df = frame(spark, [(i, v, 1) for i, v in rows]).repartition(3)
    out = centroids.cluster_embeddings(df, spec)
    assert Counter(tuple(r) for r in out.collect()) == lloyd(rows, spec)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_clusters_of_few_and_of_no_vectors(spark):
    spec = centroids.Clustering(clusters=8, dim=2)
    rows = [(1, [0.1, 0.2]), (2, [0.3, 0.4]), (2, [0.3, 0.4])]
    df = frame(spark, [(i, v, 0) for i, v in rows])
    assert Counter(tuple(r) for r in centroids.cluster_embeddings(df, spec).collect()) == lloyd(rows, spec)
    assert centroids.cluster_embeddings(df.limit(0), spec).count() == 0
    assert centroids.cluster_embeddings(df.limit(1), spec).first().distance == 0


def test_components_too_large_raise(spark):
    df = frame(spark, [(1, [1e9, 0.0], 0), (2, [0.0, 0.0], 0)])
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster_embeddings(df, centroids.Clustering(dim=2))


def test_large_components_are_exact():
    rng = np.random.default_rng(0)
    x, c = rng.integers(-(1 << 27), 1 << 27, (50, 64)), rng.integers(-(1 << 27), 1 << 27, (5, 64))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, k)) for k in c] for r in x]
    assert centroids.squared(x, c).tolist() == want
    small = x >> 20
    assert centroids.squared(small, c >> 20).tolist() == ((small[:, None].astype(object) - (c >> 20)[None]) ** 2).sum(axis=2).tolist()


def test_expired_walks_only_the_top():
    rng = np.random.default_rng(1)
    keys = np.sort(rng.random(1000))
    for limit in (-1, 0, 0.01, 0.5, 2):
        assert sorted(centroids.expired(keys, limit)) == list(np.flatnonzero(keys <= limit))
    assert len(centroids.expired(np.zeros(0), 1)) == 0


def test_bounds_spare_rescans():
    """Far groups are settled after a round: only vectors near a border are measured again."""
    rng = np.random.default_rng(2)
    x = np.array(vectors(rng, 2000, 8, 0.02))
    x = np.floor(1024 * x).astype(np.int32)
    cents, spent, heaps, seen = x[:4].astype(np.int64), np.zeros(4), None, []
    whole = centroids.squared
    for _ in range(6):
        heaps, _ = centroids._advance(x, heaps, cents, spent)
        cluster = np.empty(len(x), int)
        for c, (_, places) in enumerate(heaps):
            cluster[places] = c
        assert (cluster == whole(x.astype(np.int64), cents).argmin(axis=1)).all()
        moved = np.array([np.floor(x[cluster == c].mean(axis=0)) if (cluster == c).any() else cents[c] for c in range(4)], np.int64)
        drift = np.sqrt(((moved - cents) ** 2).sum(axis=1)) * (1 + centroids.SLACK)
        spent = spent + drift + [np.delete(drift, c).max() for c in range(4)]
        seen.append(sum(len(centroids.expired(keys, s)) for (keys, _), s in zip(heaps, spent)))
        cents = moved
    assert seen[-1] < len(x) / 4


def test_rounds_join_without_a_shuffle(spark):
    rows = spark.range(50).selectExpr("id as block", "cast(id as string) as matrix")
    (a, one), (b, two) = centroids.bucketed(rows, "test"), centroids.bucketed(rows.select("block"), "test")
    plan = a.hint("merge").join(b, "block")._jdf.queryExecution().toString()
    for name in (one, two):
        spark.sql(f"DROP TABLE {name}")
    assert "Exchange" not in plan


# ---- languages ---------------------------------------------------------------------------------


def test_marginals_by_enumeration():
    rng = np.random.default_rng(1)
    counts, k = np.array([5, 0, 1, 7]), 3
    scores, change = rng.normal(size=(13, k)), rng.normal(size=(k, k))
    got, moves = language_id.marginals(scores, counts, change, pairs=True)
    want, want_moves = np.zeros_like(scores), np.zeros((k, k))
    at = 0
    for n in counts:
        paths = list(itertools.product(range(k), repeat=int(n))) if n else []
        weight = np.array([math.exp(sum(scores[at + i, p[i]] for i in range(n)) + sum(change[p[i], p[i + 1]] for i in range(n - 1))) for p in paths])
        for p, q in zip(paths, weight / weight.sum() if n else []):
            for i in range(n):
                want[at + i, p[i]] += q
            for i in range(n - 1):
                want_moves[p[i], p[i + 1]] += q
        at += n
    assert np.allclose(got, want) and np.allclose(moves, want_moves)


def test_segments_do_not_show():
    """Long chains, cut into segments, equal the plain recursion, whatever stands beside them."""
    rng = np.random.default_rng(4)
    scores, change = 3 * rng.normal(size=(1000, 4)), rng.normal(size=(4, 4))
    alpha, beta = np.ones((1000, 4)), np.ones((1000, 4))
    for i in range(1000):
        alpha[i] = (alpha[i - 1] @ np.exp(change) if i else 1) * np.exp(scores[i])
        alpha[i] /= alpha[i].sum()
    for i in reversed(range(999)):
        beta[i] = np.exp(change) @ (np.exp(scores[i + 1]) * beta[i + 1])
        beta[i] /= beta[i].sum()
    want = alpha * beta / (alpha * beta).sum(axis=1, keepdims=True)
    alone, _ = language_id.marginals(scores, np.array([1000]), change)
    beside, _ = language_id.marginals(np.vstack([scores[:90], scores]), np.array([90, 1000]), change)
    assert np.allclose(alone, want) and np.array_equal(beside[90:], alone)


EN = "the house and the garden with a small river that goes down to the town where they live".split()
DE = "das haus und der garten mit einem kleinen fluss der zur stadt hinunter geht wo sie wohnen".split()


def two_languages(n=60):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(n):
        words, lang = (EN, "en") if i % 2 else (DE, "de")
        rows.append((i, " ".join(rng.choice(words, 40)), lang))
    return rows


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'q' as lang_pred", "1 as score", "2 as h", "3 as n")


def test_languages_and_edges(spark):
    rows = two_languages()
    rows += [(100, None, "en"), (101, "", "en"), (102, "12 34 -- 5", "de"), (None, "das haus", "de"), (103, "THE GARDEN and the town", None)]
    rows += [(104, "the house " * 20_000, None), (105, "der garten", "en"), (105, "der garten", "en"), (106, " \t\n", None)]
    out = language_id.identify_documents(labelled(spark, rows).repartition(4))
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    got = defaultdict(list)
    for r in out.collect():
        got[r.doc_id].append((r.held_out, r.lang_pred, r.score))
    assert sum(map(len, got.values())) == len(rows)
    for i, text, lang in rows[:60]:
        assert got[i][0][0] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i][0][1] == lang and 0.5 < got[i][0][2] <= 1
    for i in (100, 101, 102, 106):
        assert got[i][0][1:] == ("und", 0.0)
    assert got[103][0][1] == got[104][0][1] == "en"
    assert got[None][0][:2] == (False, "de")
    assert got[105][0] == got[105][1]


def test_switched_text_is_labelled_word_by_word(spark):
    model = language_id.train(labelled(spark, two_languages()))
    text = "The garden and the river. Der Garten mit einem Fluss und the town"
    (row,) = language_id.label_words(labelled(spark, [(1, text, None)]), model, ["doc_id"]).collect()
    raw = text.encode()
    found = [(raw[s.start : s.end].decode(), s.lang) for s in row.spans]
    assert found == [("The garden and the river", "en"), ("Der Garten mit einem Fluss und", "de"), ("the town", "en")]
    (both,) = language_id.predict(labelled(spark, [(1, text, None)]), model, ["doc_id"]).collect()
    assert 0.5 < both.score < 0.8


def test_no_labels_and_no_rows(spark):
    rows = labelled(spark, [(1, "the house", None), (2, None, "en")])
    assert [(r.lang_pred, r.score) for r in language_id.identify_documents(rows).collect()] == [("und", 0.0)] * 2
    assert language_id.identify_documents(rows.limit(0)).count() == 0
    assert language_id.label_words(rows, None, ["doc_id"]).first().spans == []


def test_lexicon_counts_all_words(spark):
    rows = labelled(spark, two_languages())
    sums = {r["lang"]: sum(r["counts"]) for r in language_id.lexicon(rows).collect()}
    assert sums == {"en": 30 * 40, "de": 30 * 40}


def test_sample_is_bounded_and_does_not_follow_the_partitions(spark):
    spec = language_id.CrfSpec(docs=5, words=8)
    rows = labelled(spark, two_languages())
    pick = lambda df: sorted((r["lang"], r["h"], bytes(r["run"])) for r in language_id.sample(df, spec).collect())
    one = pick(rows.repartition(1))
    assert one == pick(rows.repartition(7)) == pick(rows.unionByName(rows))
    assert len(one) == 10 and all(len(run.split()) == 8 for _, _, run in one)


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").distinct()
    out = LLM_QUERIES["op12_language_id"](spark, sf).join(docs, "doc_id").where("held_out and lang is not null and lang_pred <> 'und'")
    right, all_rows = out.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert all_rows > 20 and right / all_rows > 0.95


# ---- manifests ---------------------------------------------------------------------------------


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, low=False):
    row = list(row)
    if low and row[4] is not None:
        row[4] = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row[4])
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def grow(digests):
    """The root, and per leaf the (left, right) siblings of every level."""
    steps, level, below = [[] for _ in digests], list(digests), [[i] for i in range(len(digests))]
    while len(level) > 1:
        up, under = [], []
        for a in range(0, len(level), 16):
            run = level[a : a + 16]
            for j in range(len(run)):
                for i in below[a + j]:
                    steps[i].append((run[:j], run[j + 1 :]))
            up.append(H(*run))
            under.append(sum(below[a : a + 16], []))
        level, below = up, under
    return level[0], steps


def whole_manifest(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = grow([leaf(r) for r in by[s]])
    root, top = grow([trees[s][0] for s in names])
    out = Counter()
    for s, above in zip(names, top):
        for r, steps in zip(by[s], trees[s][1]):
            cur = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0)
            for a, b in steps + above:
                cur = H(*a, cur, *b)
            out[(r[0], leaf(r), trees[s][0], root, H(*[x for a, b in steps + above for x in a + b]), cur, cur == root)] += 1
    return out


def test_manifest_of_edge_rows(docs, rows):
    ordered = [(r[0], r[3], r[2], r[4], r[1]) for r in rows]
    out = manifest.manifest(docs)
    assert Counter(tuple(r) for r in out.collect()) == whole_manifest(ordered)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("sources", [1, 2, 300])
def test_manifest_of_many_leaves_and_sources(spark, sources):
    rows = [(i, f"s{i % sources}" if i % 7 else None, "en", i, f"Text {i % 50}") for i in range(1000)] + [(5, "s0", "en", 5, "Same")] * 300
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert Counter(tuple(r) for r in manifest.manifest(df).collect()) == whole_manifest(rows)


def test_manifest_of_one_row_and_of_none(spark, empty):
    rows = [(7, "a", None, 3, "Abc")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    (row,) = manifest.manifest(df).collect()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == H()
    assert manifest.manifest(empty).count() == 0


def test_claims_are_checked(spark):
    rows = [(i, "a", "en", 1, f"t{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    out = manifest.manifest(df, F.when(F.col("doc_id") < 3, F.sha2(F.lit("other"), 256)))
    assert {r.doc_id for r in out.collect() if not r.verified} == {0, 1, 2}
