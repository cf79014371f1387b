import random

import pytest

WORDS = "alpha beta gamma delta über ñandú la the of and token= señal x1 y2 zeta eta".split()
# Names that operators use inside or return, as extra columns of the input.
CLASHING = ["size", "blob", "spans", "component_id", "m", "u", "row", "key", "_key", "kept", "copies", "_row", "values", "bits", "least"]


def prose(rng: random.Random, n: int) -> str:
    words = [rng.choice(WORDS) + rng.choice(["", "", ",", ".", "a", "b", str(rng.randint(0, 99))]) for _ in range(n)]
    return "".join(w + rng.choice([" ", " ", " ", "\n"]) for w in words).strip()


def edge_rows() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): nulls, empty, blank, very long, repeated and nearly equal texts."""
    rng = random.Random(5)
    base = prose(rng, 120)
    texts = [
        None, "", " \t\n", "one", "four words are here", base, base, base.upper(), base + " more", base.replace("beta", "b", 1),
        prose(rng, 30_000), "x" * 60_000, "é漢🙂 " * 40, "ab " * 500, prose(rng, 60), "password = hunter2hunter2 and AKIA" + "B" * 20,
        "secret: short\napi-key='abcdefghij' " + "0123456789abcdef" * 3, "a | b | c | d\n" * 12, "\x00\x1f \x85  <|im_end|> \\ ▁▁ x",
    ]
    texts += [prose(rng, rng.randint(1, 90)) for _ in range(30)]
    rows = [(i * 3, t, "en", f"src{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[5], rows[14], rows[14]]  # repeated rows
    rows += [(900, texts[20], None, None, None), (901, None, None, None, None), (None, texts[21], "en", "src1", 5), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return edge_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The edge rows with extra columns whose names the operators use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, schema)
    for name in CLASHING:
        df = df.selectExpr("*", f"'{name}' as `{name}`")
    return df.repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
