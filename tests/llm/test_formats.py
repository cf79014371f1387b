"""Chat formatting, SentencePiece and URL filters."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.llm import chat_format, sentencepiece_codec, url_filter
from tests.llm import brute


def noise(rng, letters, n):
    return "".join(rng.choice(letters) for _ in range(rng.randint(0, n)))


# ---- chat ----------------------------------------------------------------------------------------

PARTS = ["<|", "im_end", "im_start", "|>", "\\", "\n", "n", "a", "<|im_end|>", "<|im_start|>", "<|n|>", "<|\\im_end|>"]


def test_every_turn_is_read_back():
    rng = random.Random(1)
    for _ in range(3000):
        role, text = (noise(rng, PARTS, 6) for _ in range(2))
        shown, start, end = chat_format.format_turn(role, text)
        assert chat_format.parse(shown * 2) == [(role, text)] * 2
        assert chat_format.unescape(shown[start:end]) == text


def test_plain_turns_stay_plain():
    assert chat_format.format_turn("user", "a <b> \\ c") == ("<|im_start|>user\na <b> \\ c<|im_end|>\n", 17, 26)
    assert chat_format.parse("<|im_start|>user\nopen") is None
    assert chat_format.parse("stray<|im_start|>user\na<|im_end|>\n") is None


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), noise(rng, PARTS, 8)) for c in range(12) for t in range(rng.randint(1, 6))]
    rows += [(1, 3, "assistant", "tie"), (1, 3, "assistant", "tie"), (20, 0, None, None), (20, None, "assistant", None), (None, 0, "assistant", "x" * 50_000)]
    return rows + [(30, t, "user", f"turn {t}") for t in range(3000)]


def test_conversations(spark, turns):
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("x")).repartition(4)
    out = {r.conv_id: r for r in chat_format.read_back(chat_format.format_turns(df)).collect()}
    whole = {r.conv_id: r for r in chat_format.format_conversations(df.filter("conv_id <> 30")).collect()}
    groups = {}
    for c, t, role, text in turns:
        groups.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(out) == set(groups)
    for c, rows in groups.items():
        rows.sort(key=lambda r: (r[0], chat_format.format_turn(r[1], r[2])[0]))
        r = out[c]
        masked = "".join(x for _, role, x in rows if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(rows), brute.sha("".join(f"{role}\n{x}\n" for _, role, x in rows)))
        assert (r.loss_chars, r.loss_sha256) == (len(masked), brute.sha(masked))
        shown = "".join(chat_format.format_turn(role, x)[0] for _, role, x in rows)
        assert r.formatted_chars == len(shown)
        if c in whole and c is not None:
            assert whole[c].formatted == shown and chat_format.parse(shown) == [(role, x) for _, role, x in rows]
            spans = whole[c].loss_spans
            assert "".join(chat_format.unescape(shown[s.start : s.end]) for s in spans) == masked
    assert chat_format.read_back(chat_format.format_turns(df.limit(0))).count() == 0


# ---- sentencepiece -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    sp = pytest.importorskip("sentencepiece")
    return sp.SentencePieceProcessor(model_file=sentencepiece_codec.public_model())


SAMPLES = ["", " ", "  a", "a ", "▁x y", "\n\n a\tb", "🙂 é 漢字 \x00 z", "aaaaaa aaaa", "x" * 500, " " * 100, "<s> </s> <unk> <0x0A>", "word\r\nline", "ab\n▁ ▁", "naïve,co-op.(x)"]


def test_encoding_and_decoding_equal_the_library(library):
    rng = random.Random(3)
    own = sentencepiece_codec.Codec(sentencepiece_codec.public_model())
    for text in SAMPLES + [noise(rng, "abcdeéß漢🙂 \n\t▁.,-_<>0123ABC", 80) for _ in range(500)]:
        ids, borders = own.encode(text)
        want = library.encode(text)
        assert ids.tolist() == want and own.listed(ids) == ",".join(map(str, want))
        assert own.decode(ids) == library.decode(want)
        assert borders[0] == 0 and borders[-1] == len(text.encode()) and (np.diff(borders) >= 0).all()


def test_spans_equal_the_library(library):
    own = sentencepiece_codec.Codec(sentencepiece_codec.public_model())
    for text in ["a simple text, with words.", "naïve  señor\nline", "Wörter und Zahlen 123", "🙂 x\t漢字\x00 \u0378é"]:
        _, borders = own.encode(text)
        pieces = library.encode(text, return_type="proto").pieces
        assert list(zip(borders[:-1].tolist(), borders[1:].tolist())) == [(p.begin, p.end) for p in pieces]


def test_decoding_any_ids_equals_the_library(library):
    rng = random.Random(4)
    own = sentencepiece_codec.Codec(sentencepiece_codec.public_model())
    for _ in range(200):
        ids = [rng.randint(3, 400) if rng.random() < 0.5 else rng.randint(259, 31_999) for _ in range(rng.randint(0, 12))]
        ids = [i for i in ids if own.types[i] == sentencepiece_codec.NORMAL or 0x20 <= int(own.names[i][3:5], 16) < 0x7F]
        assert own.decode(np.array(ids, np.int32)) == library.decode(ids)


def test_long_words_merge_alike():
    rng = random.Random(5)
    own = sentencepiece_codec.Codec(sentencepiece_codec.public_model())
    for _ in range(300):
        word = noise(rng, "abcenrt", 60)
        assert own.merged(word) == own.long_merged(word)


def test_character_map_normalises_like_the_library():
    sp = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2

    rng = random.Random(6)
    for rule in ("nmt_nfkc", "nfkc_cf"):
        library = sp.SentencePieceNormalizer(rule_name=rule)
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(library.serialized_model_proto())
        spec = model.normalizer_spec
        own = sentencepiece_codec.Normalizer(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
        for text in ["ＡＢＣ　ｱﾞ ﬁ  x ", "  é́ ½ ㌔", "a\tb\nc", " ", "", "㍿ ok  "] + [noise(rng, "aB é́ﬁ½　ｱﾞ㍿\t \u200b", 30) for _ in range(200)]:
            shown, borders = own(text)
            assert shown == library.normalize(text)
            assert len(borders) == len(shown.encode()) + 1 and (np.diff(borders) >= 0).all()


def test_encoded_documents(docs, rows, library):
    out = sentencepiece_codec.encode_documents(docs, sentencepiece_codec.public_model(), ids=True, borders=True)
    found = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.n_covered, tuple(r.ids)) for r in out.collect())
    want = Counter()
    for r in rows:
        ids = library.encode(r[1] or "")
        want[(r[0], len(ids), brute.sha(",".join(map(str, ids))), brute.sha(library.decode(ids)), len((r[1] or "").encode()), tuple(ids))] += 1
    assert found == want
    assert sentencepiece_codec.encode_documents(docs.limit(0), sentencepiece_codec.public_model()).count() == 0


# ---- urls ----------------------------------------------------------------------------------------

RULES = [
    url_filter.UrlRule("allow", "good.org", "/"), url_filter.UrlRule("block", "good.org", "/bad/"), url_filter.UrlRule("block", "evil.com", "/"),
]


def test_hosts_and_paths(spark):
    urls = {
        "http://A.b/C?x": ("a.b", "/C"), "https://x": ("x", ""), "no scheme": ("", ""), None: ("", ""), "a://b#/c": ("b", ""),
        "http://h/p#q": ("h", "/p"), "http://ÄB.c/é/": ("Äb.c", "/é/"), "x://u/a://b/c": ("u", "/a://b/c"), "://h/": ("h", "/"), "": ("", ""),
    }
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    out = df.select("url", url_filter.host_of(F.col("url")).alias("h"), url_filter.path_of(F.col("url")).alias("p")).collect()
    assert {r.url: (r.h, r.p) for r in out} == urls


def test_rules_and_propagation(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">' for h in hosts)
    rows = [
        (1, "http://www.good.org/a", link("friend.net")), (2, "http://good.org/bad/x", ""), (3, "http://evil.com/", link("friend.net")),
        (4, "http://farm.net/1", link("evil.com", "evil.com")), (5, "http://friend.net/", None), (6, "http://alone.info/", "<p>"),
        (7, None, None), (8, "http://notgood.org/", ""), (6, "http://alone.info/", "<p>"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("mass", F.lit(1))
    out = url_filter.judge_pages(pages, RULES).collect()
    found = {r.page_id: (r.rule, r.verdict) for r in out}
    assert len(out) == len(rows)
    assert found == {
        1: ("good.org/", "allow"), 2: ("good.org/bad/", "block"), 3: ("evil.com/", "block"), 4: (None, "block"),
        5: (None, "allow"), 6: (None, "allow"), 7: (None, "allow"), 8: (None, "allow"),
    }
    assert {r.page_id: r.trust > 0 for r in out}[5] and {r.page_id: r.distrust > 0 for r in out}[4]
    assert url_filter.judge_pages(pages.limit(0), RULES).count() == 0
    assert {r.verdict for r in url_filter.judge_pages(pages, []).collect()} == {"allow"}


def test_copies_of_a_host_graph_are_judged_alike(spark):
    rules = [url_filter.UrlRule("block", "com", "/bad/"), url_filter.UrlRule("allow", "com", "/good/")]
    spread = url_filter.Spread(units=10**4, least=10**2)
    pages = [("a.evil", "/bad/"), ("b.evil", "/"), ("c.x.evil", "/"), ("a.fine", "/good/"), ("b.fine", "/"), ("a.both", "/bad/"), ("b.both", "/good/"), ("b.both", "/good/"), ("c.both", "/")]

    def verdicts(copies):
        rows = [(k, f"http://{host}{k}.com{path}", None) for k in range(copies) for host, path in pages]
        out = {}
        for r in url_filter.judge_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), rules, spread).collect():
            out.setdefault(r.page_id, set()).add((r.host.replace(f"{r.page_id}.com", ""), r.path, r.verdict))
        return out

    one = verdicts(1)[0]
    assert one >= {("b.evil", "/", "block"), ("c.x.evil", "/", "block"), ("b.fine", "/", "allow"), ("c.both", "/", "allow")}
    many = verdicts(500)
    assert len(many) == 500 and all(found == one for found in many.values())


def test_a_large_domain_is_judged_like_a_small_one(spark):
    rules = [url_filter.UrlRule("block", "com", "/bad/")]
    for n in (60, 3000):
        rows = [(i, f"http://h{i}.farm.com/{'bad/' if i % 10 < 3 else ''}", None) for i in range(n)]
        out = url_filter.judge_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), rules, url_filter.Spread(units=10**4, least=10**2))
        assert {r.verdict for r in out.collect()} == {"block"}


def test_url_filter_stays_in_the_jvm(spark, sf):
    from panelweave.llm.queries import LLM_QUERIES

    text = LLM_QUERIES["op7_url_filters"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in text for word in ("Python", "Pandas", "Arrow", "CartesianProduct"))
