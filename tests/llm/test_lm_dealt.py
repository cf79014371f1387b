"""Operator 2 when the model is too large to broadcast: disk in proportion, any number of chunks."""

import os
import random
import zlib
from collections import Counter

import pytest

from panelweave.llm import lm_scoring
from panelweave.llm.suffix_dedup import release
from panelweave.sources.staging import shared_dir


def bytes_on_disk(spark) -> int:
    """Shuffle files and staged tables."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    held = sum(files.apply(i).length() for i in range(files.size()))
    top = f"{shared_dir(spark)}/panelweave".split(":", 1)[-1]
    return held + sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(top) for f in names if os.path.exists(f"{d}/{f}"))


def test_dealt_scores_keep_within_four_times_the_input(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    parts = ["th", "an", "er", "in", "re", "on", "ti", "ea", "ing", "ou", "wh", "ble", "sh", "nd", "es", "at"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.choice((1, 1, 1, 2, 2, 3, 4))))
    rows = [(i, " ".join(word() for _ in range(rng.randint(1, 900)))) for i in range(2_000)]
    path = str(tmp_path / "documents")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.option("compression", "snappy").parquet(path)
    size = sum(os.path.getsize(f"{path}/{f}") for f in os.listdir(path) if f.endswith(".parquet"))
    release(spark)
    floor, most = bytes_on_disk(spark), []

    def watched(df, label, *more, stage=lm_scoring.stage):
        out = stage(df, label, *more)
        most.append((bytes_on_disk(spark) - floor, label))
        return out

    monkeypatch.setattr(lm_scoring, "stage", watched)
    spec = lm_scoring.LmSpec(shard_bytes=500_000, broadcast_bytes=0, flush=400_000, chunk_bytes=2_000_000)
    assert lm_scoring.score_documents(spark.read.parquet(path), spec).count() == len(rows)
    assert max(most)[0] <= 4 * size, (size, most)


def test_chunks_of_any_size_score_alike(docs):
    want = None
    for sizes in ({}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "chunk_bytes": 1, "asked": 1}, {"broadcast_bytes": 0, "chunk_bytes": 3_000, "asked": 700}):
        out = lm_scoring.score_documents(docs, lm_scoring.LmSpec(shard_bytes=20_000, **sizes))
        got = Counter((*r[:5], round(r.base_score, 9), round(r.score, 9)) for r in out.collect())
        want = want or got
        assert got == want


@pytest.mark.parametrize("held", [True, False])
def test_dealt_with_texts_of_one_side_only(spark, held):
    """All texts in training, or all but one held out: most shards then have no model and answer zeros."""
    kept = [i for i in range(400) if (zlib.crc32(str(i).encode()) % 7 == 2) == held][:30]
    rows = [(i, f"word{i} of the word{i + 1}") for i in kept] + ([(None, "the")] if held else [])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    one, other = (
        Counter((*r[:5], round(r.base_score, 9), round(r.score, 9)) for r in lm_scoring.score_documents(docs, spec).collect())
        for spec in (lm_scoring.LmSpec(shard_bytes=2), lm_scoring.LmSpec(shard_bytes=2, broadcast_bytes=0, chunk_bytes=100))
    )
    assert one == other and sum(one.values()) == len(rows)


def test_nothing_of_the_dealt_way_is_left(spark, docs):
    names = {t.name for t in spark.catalog.listTables()}
    before = set(os.listdir(f"{shared_dir(spark)}/panelweave")) if os.path.isdir(f"{shared_dir(spark)}/panelweave") else set()
    assert lm_scoring.score_documents(docs, lm_scoring.LmSpec(broadcast_bytes=0)).count() == docs.count()
    assert {t.name for t in spark.catalog.listTables()} == names
    left = {f.rsplit("-", 1)[0] for f in set(os.listdir(f"{shared_dir(spark)}/panelweave")) - before}
    assert left == {"lm-scores"}
