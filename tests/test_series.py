"""Ordered operators on small hand-made panels, with pieces of a few steps."""

from datetime import date, datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelweave.operators import profile, series, windows
from panelweave.plans import monthly
from panelweave.spec import PanelSpec

DAY = PanelSpec(step="1 day", chunk_steps=3)
START = date(2024, 1, 1)
few = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))


def panel(spark, data):
    """{id: {day number: value}} to a frame."""
    rows = [(i, START + timedelta(days=d), v) for i, days in data.items() for d, v in days.items()]
    return spark.createDataFrame(rows, "id string, ts date, y double")


def as_dict(df, value="y"):
    out = {}
    for r in df.collect():
        out.setdefault(r["id"], {})[(r["ts"] - START).days] = r[value]
    return out


def brute_fill(days):
    out, last = {}, None
    for d in sorted(days):
        last = days[d] if days[d] is not None else last
        out[d] = last
    return out


def brute_dense(days):
    if not days:
        return {}
    whole = {d: days.get(d) for d in range(min(days), max(days) + 1)}
    return brute_fill(whole)


series_data = st.dictionaries(
    st.sampled_from(["a", "b", "c"]),
    st.dictionaries(st.integers(0, 40), st.one_of(st.none(), st.integers(-5, 5).map(float)), min_size=1, max_size=15),
    min_size=1,
)


@few
@given(series_data)
def test_forward_fill_and_gaps_match_brute_force(spark, data):
    df = panel(spark, data)
    filled = series.forward_fill(df, DAY, ["y"])
    assert as_dict(filled) == {i: brute_fill(d) for i, d in data.items()}
    again = series.forward_fill(filled, DAY, ["y"])
    assert as_dict(again) == as_dict(filled)
    dense = series.fill_gaps(df, DAY, forward=["y"])
    assert as_dict(dense) == {i: brute_dense(d) for i, d in data.items()}
    assert profile.gaps(dense, DAY).isEmpty()
    assert as_dict(series.fill_gaps(dense, DAY)) == as_dict(dense)


@few
@given(series_data, st.integers(1, 5))
def test_windows_match_brute_force_and_flatten_undoes_them(spark, data, length):
    df = panel(spark, data)
    w = windows.sliding_windows(df, DAY, length, ["y"], block_steps=4)
    got = {
        (r["id"], (r["window_ts"] - START).days): ([s["y"] for s in r["steps"]], r["is_first"])
        for r in w.collect()
    }
    want = {}
    for i, days in data.items():
        order = sorted(days)
        for k in range(len(order) - length + 1):
            want[i, order[k]] = ([days[d] for d in order[k : k + length]], k == 0)
    assert got == want
    long_enough = {i: d for i, d in data.items() if len(d) >= length}
    assert as_dict(windows.flatten_windows(w)) == long_enough


@few
@given(series_data, st.integers(1, 6))
def test_dense_windows_equal_counted_windows(spark, data, length):
    dense = series.fill_gaps(panel(spark, data), DAY, forward=["y"])
    one = windows.sliding_windows(dense, DAY, length, ["y"], dense=True, block_steps=3)
    two = windows.sliding_windows(dense, DAY, length, ["y"])
    pick = ["id", "window_ts", "is_first", F.col("steps.ts").alias("t"), F.col("steps.y").alias("y")]
    assert sorted(map(str, one.select(*pick).collect())) == sorted(map(str, two.select(*pick).collect()))


def test_short_series_and_gaps_raise(spark):
    df = panel(spark, {"a": {0: 1.0, 1: 2.0, 4: 3.0}, "b": {0: 1.0}})
    with pytest.raises(Exception, match="shorter than the window"):
        windows.sliding_windows(df, DAY, 2, ["y"], short="error").collect()
    with pytest.raises(Exception, match="with a gap"):
        windows.sliding_windows(df, DAY, 3, ["y"], dense=True).collect()
    assert [r["id"] for r in profile.gaps(df, DAY).collect()] == ["a"]
    assert [(r["id"], r["rows"]) for r in profile.short_series(df, DAY, 2).collect()] == [("b", 1)]


def test_window_shapes(spark):
    """128 rows and 12 steps give 117 windows of 12 steps; encoder 9 leaves 3 targets."""
    df = spark.range(128).select(
        F.lit(0).alias("id"),
        F.date_add(F.lit(START), F.col("id").cast("int")).alias("ts"),
        *[(F.col("id") * (k + 1)).cast("double").alias(f"f{k}") for k in range(5)],
        F.col("id").cast("double").alias("y"),
    )
    names = [f"f{k}" for k in range(5)]
    w = windows.sliding_windows(df, PanelSpec(step="1 day"), 12, [*names, "y"])
    xy = windows.encoder_decoder_split(w, 9, names, ["y"])
    shapes = xy.select(
        F.size("x"), F.size(F.col("x")[0]), F.size("y"), F.size(F.col("y")[0])
    ).distinct().collect()
    assert xy.count() == 117
    assert [tuple(r) for r in shapes] == [(12, 5, 3, 1)]


def test_groups_with_returns_are_dropped_whole(spark):
    df = panel(spark, {"a": {0: 5.0, 9: -1.0}, "b": {0: 0.0, 9: 2.0}, "c": {1: None}})
    assert as_dict(series.drop_negative_groups(df, DAY)) == {"b": {0: 0.0, 9: 2.0}}
    assert as_dict(series.partition_min(df, DAY, "y", "low"), "low")["a"] == {0: -1.0, 9: -1.0}


def test_positions(spark):
    df = panel(spark, {"a": {d: 1.0 for d in (0, 1, 5, 7, 20)}, "b": {3: 1.0}})
    got = as_dict(series.with_position(df, DAY), "pos")
    assert got == {"a": {0: 0, 1: 1, 5: 2, 7: 3, 20: 4}, "b": {3: 0}}


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
def test_hourly_gaps_keep_minutes_and_fractions(spark, kind):
    times = [datetime(2024, 1, 1, 0, 30, 0, 250000), datetime(2024, 1, 1, 3, 30, 0, 250000), datetime(2024, 1, 1, 5, 10)]
    df = spark.createDataFrame([("a", str(t), 1.0) for t in times], "id string, ts string, y double")
    df = df.withColumn("ts", F.col("ts").cast(kind))
    out = series.fill_gaps(df, PanelSpec(step="1 hour", chunk_steps=2), made="made").orderBy("ts")
    got = [(str(r["ts"].time()), r["made"]) for r in out.collect()]
    assert got == [
        ("00:30:00.250000", False), ("01:30:00.250000", True), ("02:30:00.250000", True),
        ("03:30:00.250000", False), ("04:30:00.250000", True), ("05:10:00", False),
    ]


def test_month_ends(spark):
    df = spark.createDataFrame([("2023-11", 1.0), ("2024-02", 2.0)], "m string, v double")
    rows = monthly.month_end_panel(df, "m", "v").orderBy("ts").collect()
    assert [str(r["ts"]) for r in rows] == ["2023-11-30", "2023-12-31", "2024-01-31", "2024-02-29"]
    assert [r["y"] for r in rows] == [1.0, None, None, 2.0]


def test_bounded_spec_cuts_crowded_pieces(spark):
    df = spark.range(2000).select(
        F.lit("hot").alias("id"),
        (F.timestamp_seconds(F.col("id") * 60)).cast("timestamp_ntz").alias("ts"),
        F.col("id").cast("double").alias("y"),
    )
    coarse = PanelSpec(step="1 month", chunk_steps=12)
    spec = profile.bounded_spec(df, coarse, max_rows=100)
    counts = series.with_piece(df, spec).groupBy("id", series.PIECE).count()
    assert counts.agg(F.max("count")).first()[0] <= 100
    assert profile.bounded_spec(df, PanelSpec(chunk_steps=1), max_rows=100).step == "1 hour"
    got = series.with_position(df, spec).where("pos <> y").count()
    assert got == 0
