"""Null keys, gaps, unseen values, broken files and half-written tables."""

import datetime as dt
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelweave.operators import forecast, groups, scaling, series, vocab, windows
from panelweave.sources import files, staging
from panelweave.spec import PanelSpec

HOUR = PanelSpec(step="1 hour", chunk_steps=3)
START = dt.datetime(2024, 1, 1)


def panel(spark, rows):
    data = [(i, START + dt.timedelta(hours=h) if h is not None else None, y) for i, h, y in rows]
    return spark.createDataFrame(data, "id string, ts timestamp_ntz, y double")


def test_a_null_id_is_an_entity(spark):
    df = panel(spark, [(i, h, None if h % 4 == 3 else float(h)) for i in ("a", None) for h in range(10)])
    by = {}
    for r in series.forward_fill(df, HOUR, ["y"]).collect():
        by.setdefault(r.id, []).append((r.ts, r.y))
    assert sorted(by["a"]) == sorted(by[None]) and all(y is not None for _, y in by[None])
    assert series.drop_negative_groups(df, HOUR).count() == 20
    assert {r.low for r in series.partition_min(df, HOUR, "y", "low").collect()} == {0.0}
    assert series.fill_gaps(df.where("hour(ts) <> 5"), HOUR, forward=["y"]).count() == 20
    for dense in (True, False):
        w = windows.sliding_windows(df, HOUR, 4, ["y"], dense=dense, block_steps=4)
        assert w.count() == 14 and w.where("is_first").count() == 2


def test_a_row_without_a_time_raises(spark):
    with pytest.raises(Exception, match="without a time"):
        series.forward_fill(panel(spark, [("a", 1, 1.0), ("a", None, 2.0)]), HOUR, ["y"]).collect()


@pytest.mark.parametrize(
    "hours",
    [[*range(3), *range(6, 10)], [*range(3, 8), *range(12, 15)], [*range(3, 6), *range(10, 14)], [1, 1, 3], [*range(8), 9], [*range(8), *range(16, 24)], [4, 4]],
)
def test_dense_windows_refuse_gaps_and_repeats(spark, hours):
    df = panel(spark, [("a", h, 1.0) for h in hours])
    with pytest.raises(Exception, match="gap or a repeated time"):
        windows.sliding_windows(df, HOUR.with_(chunk_steps=8), 3, ["y"], dense=True, block_steps=8).collect()


def test_group_apply_does_not_depend_on_the_pieces(spark):
    df = panel(spark, [(i, h, float(h * h % 17)) for i in ("a", "b", None) for h in range(241)])

    def partial(piece):
        return pd.DataFrame({"id": piece["id"].iloc[:1], "n": [len(piece)], "s": [piece["y"].sum()]})

    def centred(piece):
        return piece.assign(z=piece["y"] - piece["total"] / piece["rows"])[["id", "ts", "z"]]

    merge = [F.sum("n").alias("rows"), F.sum("s").alias("total")]
    out = []
    for steps in (7, 100, 4096):
        done = groups.group_apply(
            df, HOUR.with_(chunk_steps=steps), partial, "id string, n bigint, s double", merge, centred, "id string, ts timestamp_ntz, z double"
        )
        out.append(sorted(map(tuple, done.collect()), key=str))
    assert out[0] == out[1] == out[2] and len(out[0]) == 723


def test_pieces_are_the_callers(spark):
    df = panel(spark, [("a", h, 1.0) for h in range(10)])
    size = groups.piece_apply(df, HOUR, 5, lambda p: pd.DataFrame({"n": [len(p)]}), "n bigint")
    assert sum(r.n for r in size.collect()) == 10 and size.count() in (2, 3)


def test_entities_without_a_scaler(spark):
    train = panel(spark, [("a", h, float(h)) for h in range(4)])
    state = staging.stage(scaling.fit_scaler(train, ["y"], "id"), "scalers")
    late = train.unionByName(panel(spark, [("late", 0, 1.0), (None, 0, 1.0)]))
    for run in (lambda **k: scaling.scale(late, state, ["y"], "id", **k), lambda **k: scaling.inverse_scale(late, state, {"y": "y"}, "id", **k)):
        with pytest.raises(Exception, match="no scaler state"):
            run().collect()
        assert run(unseen="skip").count() == 4
        assert run(unseen="null").where("y is null").count() == 2


def test_unknown_codes(spark):
    df = spark.createDataFrame([("x",), ("y",)], "c string")
    state = staging.stage(vocab.fit_vocabulary(df, ["c"]), "vocabulary")
    codes = spark.createDataFrame([(0,), (7,), (None,)], "c int")
    with pytest.raises(Exception, match="unknown code"):
        vocab.decode_labels(codes, state, ["c"]).collect()
    assert [r.c for r in vocab.decode_labels(codes, state, ["c"], unseen="null").collect()] == ["x", None, None]


def test_five_quantiles_need_five_names(spark):
    quantiles = [0.05, 0.1, 0.5, 0.9, 0.95]
    model = spark.createDataFrame([(1, q, 0, "bias", 10 * q) for q in quantiles], forecast.MODEL_SCHEMA)
    design = spark.createDataFrame(
        [("a", [START], [(0, 1.0)], [[]], [1.0])], f"id string, ts array<timestamp_ntz>, shared {forecast.PAIRS}, own array<{forecast.PAIRS}>, y array<double>"
    )
    with pytest.raises(ValueError, match="quantiles"):
        forecast.predict_quantiles(design, model)
    (row,) = forecast.predict_quantiles(design, model, {f"q{int(100 * q)}": q for q in reversed(quantiles)}).collect()
    assert [row[f"q{int(100 * q)}"] for q in quantiles] == [10 * q for q in quantiles]


def test_bad_values_in_files_raise(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n,d\n1,2024-01-01\nabc,2024-01-02\n")
    with pytest.raises(Exception, match="MALFORMED|abc|FAILFAST"):
        files.read_csv_dates(spark, str(tmp_path / "a.csv"), "n int, d date").collect()
    good = '"";"m1";"m2"\n2024-01-01 00:15:00;1,5;2\n'
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "one.txt").write_text(good)
    assert files.read_decimal_comma(spark, str(tmp_path / "t"), ["m1", "m2"]).first()["m1"] == 1.5
    with pytest.raises(ValueError, match="header names"):
        files.read_decimal_comma(spark, str(tmp_path / "t"), ["m2", "m1"])
    (tmp_path / "t" / "two.txt").write_text(good.replace("m1", "m3"))
    with pytest.raises(ValueError, match="different headers"):
        files.header_names(spark, str(tmp_path / "t"))
    (tmp_path / "bad.txt").write_text(good + "not a time;1;2\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|not a time"):
        files.read_decimal_comma(spark, str(tmp_path / "bad.txt"), ["m1", "m2"]).collect()


def test_a_half_written_table_is_built_again(spark, tmp_path):
    path, calls = str(tmp_path / "stored"), []

    def build():
        calls.append(1)
        return spark.range(100).repartition(4)

    assert staging.materialize(spark, path, build).count() == 100
    assert staging.materialize(spark, path, build).count() == 100 and len(calls) == 1
    os.rename(os.path.join(path, "_SUCCESS"), str(tmp_path / "marker"))
    parts = [f for f in os.listdir(path) if f.startswith("part-")]
    os.rename(os.path.join(path, parts[0]), str(tmp_path / "lost"))
    assert staging.materialize(spark, path, build).count() == 100 and len(calls) == 2


def test_many_pieces_in_a_call(spark):
    """Batched functions see whole pieces only, fewer calls than pieces, and exact ids beside null ones."""
    big = (1 << 60) + 1
    rows = [(i, h, float(h)) for i in (big, big + 1, None, 3) for h in range(121)]
    df = panel(spark, [(str(i) if i is not None else None, h, y) for i, h, y in rows]).withColumn("id", F.col("id").cast("bigint"))
    spec = HOUR.with_(chunk_steps=24)

    def sums(pieces):
        by = pieces.groupby(groups.PIECE).agg(n=("y", "size"), s=("y", "sum"))
        first = ~pieces[groups.PIECE].duplicated()
        return by.assign(id=pieces.loc[first, "id"].to_numpy(), calls=[1.0] + [0.0] * (len(by) - 1))

    def one(piece):
        return pd.DataFrame({"id": piece["id"].iloc[:1], "n": [len(piece)], "s": [piece["y"].sum()], "calls": [1.0]})

    schema = "id bigint, n bigint, s double, calls double"
    plain = groups.piece_apply(df, spec, 24, one, schema).drop("calls").collect()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("10000", "50", "7", "1"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            done = groups.piece_apply(df, spec, 24, sums, schema, batched=True).collect()
            assert sorted([tuple(r)[:3] for r in done], key=str) == sorted(map(tuple, plain), key=str)
            assert size != "10000" or sum(r["calls"] for r in done) < len(done)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    spread = groups.group_apply(
        df, spec, sums, schema, [F.sum("n").alias("rows"), F.sum("s").alias("total")],
        lambda p: p.assign(z=p["y"] - p["total"] / p["rows"])[["id", "ts", "z"]], "id bigint, ts timestamp_ntz, z double", batched=True,
    )
    assert {(r["id"], r["n"], r["s"]) for r in spread.groupBy("id").agg(F.count("z").alias("n"), F.sum("z").alias("s")).collect()} == {
        (i, 121, 0.0) for i in (big, big + 1, None, 3)
    }
