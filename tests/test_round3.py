"""Null ids in joins, headers of every file, calendar grids, restarted streams, bounded quantile brackets, state coverage."""

from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.operators import joins, profile, quantiles, resample, scaling, splits
from panelweave.operators.preprocess import PanelPreprocessor
from panelweave.sources import files
from panelweave.sources.staging import discard, stage
from panelweave.spec import PanelSpec
from panelweave.streaming import resample as streaming

D = date(2024, 1, 1)


def rows(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


# ---- null ids ----------------------------------------------------------------------------------


@pytest.fixture
def nameless(spark):
    data = [("a", D, 1.0), (None, D, 3.0), (None, D + timedelta(5), 5.0), ("a", D + timedelta(5), 2.0), ("b", D + timedelta(5), 9.0)]
    return spark.createDataFrame(data, "id string, ts date, y double")


def test_a_null_id_in_the_training_ids_is_kept(nameless):
    train = stage(nameless.where(F.col("ts") == D).select("id").distinct(), "ids")
    kept = joins.cold_start_filter(nameless.where(F.col("ts") > D), train, "id")
    assert rows(kept, "id", "y") == [("a", 2.0), (None, 5.0)]
    shuffled = joins.attach(nameless, train, "id", "left_semi", limit=0, null_safe=True)
    assert rows(shuffled, "id", "y") == rows(nameless.where("id is null or id = 'a'"), "id", "y")


def test_three_way_split_keeps_a_known_null_id(nameless):
    parts = splits.split_three(nameless, D + timedelta(1), D + timedelta(9), PanelSpec())
    assert rows(parts[1], "id", "y") == [("a", 2.0), (None, 5.0)]


def test_a_null_id_has_a_scaler(nameless):
    state = stage(scaling.fit_scaler(nameless, ["y"], "id"), "state")
    out = scaling.scale(nameless, state, ["y"], "id")
    assert rows(out.where("id is null"), "y") == [(-1.0,), (1.0,)]
    assert rows(scaling.inverse_scale(out, state, {"y": "y"}, "id"), "id", "ts", "y") == rows(nameless, "id", "ts", "y")
    assert scaling.scale(nameless, state, ["y"], "id", unseen="skip").count() == 5
    with pytest.raises(Exception, match="no scaler state for null"):
        scaling.scale(nameless, stage(state.where("scope_key is not null"), "some"), ["y"], "id").collect()


def test_forecasts_of_a_null_id_meet_their_rows(nameless):
    told = nameless.select("id", "ts", (F.col("y") + 1).alias("yhat"))
    out = joins.actual_vs_forecast(nameless, told)
    assert out.columns == ["id", "ts", "y", "yhat"] and out.where("yhat = y + 1").count() == 5


def test_nulls_match_nothing_by_default(nameless):
    side = stage(nameless.select("id").distinct().withColumn("n", F.lit(1)), "side")
    assert joins.attach(nameless, side, "id", "left").where("n is null").count() == 2
    both = joins.attach(nameless, side, "id", "left", null_safe=True)
    assert both.columns == ["id", "ts", "y", "n"] and both.where("n is null").isEmpty()


# ---- files -------------------------------------------------------------------------------------


def test_a_file_without_a_header_raises(spark, tmp_path):
    good = '"";"m1"\n2024-01-01 00:15:00;1,5\n'
    (tmp_path / "one.txt").write_text(good)
    (tmp_path / "two.txt").write_text("2024-01-01 00:30:00;2,5\n2024-01-01 00:45:00;3,5\n")
    with pytest.raises(ValueError, match="without a header.*two.txt"):
        files.read_decimal_comma(spark, str(tmp_path), ["m1"])
    (tmp_path / "two.txt").write_text('"";"m1"\n2024-01-01 00:30:00;2,5\n2024-01-01 00:45:00;3,5\n')
    assert sorted(r["m1"] for r in files.read_decimal_comma(spark, str(tmp_path), ["m1"]).collect()) == [1.5, 2.5, 3.5]
    (tmp_path / "two.txt").write_text("2024-01-01 00:30:00;2,5\n" + good)
    with pytest.raises(Exception, match="(?i)malformed|failfast|header"):
        files.read_decimal_comma(spark, str(tmp_path), ["m1"]).collect()


# ---- grids -------------------------------------------------------------------------------------


def test_monthly_means(spark):
    days = [("a", date(2023, 11, 1) + timedelta(i), float(i)) for i in range(120)] + [("a", None, 5.0), (None, date(2024, 2, 29), 7.0), ("b", D, None)]
    df = spark.createDataFrame(days, "id string, ts date, y double")
    out = resample.resample_mean(df, PanelSpec(step="1 month"))
    want = {}
    for i, d, y in days:
        if d is not None:
            want.setdefault((i, d.replace(day=1)), []).append(y)
    assert {(r["id"], r["ts"]): r["y"] for r in out.collect()} == {k: (None if None in v else pytest.approx(np.mean(v))) for k, v in want.items()}
    assert dict(out.dtypes)["ts"] == "date"
    quarters = resample.resample_mean(df.where("id = 'a'"), PanelSpec(step="1 month"), "3 months")
    assert [r[0] for r in quarters.select("ts").orderBy("ts").collect()] == [date(2023, 10, 1), date(2024, 1, 1)]


@pytest.mark.parametrize("kind", ["date", "timestamp", "timestamp_ntz"])
def test_twelve_months_are_a_year_of_any_time_type(spark, kind):
    df = spark.createDataFrame([(1, datetime(2023, m, 15), float(m)) for m in range(1, 13)], "id int, ts timestamp_ntz, y double")
    df = df.withColumn("ts", F.col("ts").cast(kind))
    (row,) = resample.resample_mean(df, PanelSpec(step="12 months")).collect()
    assert row["y"] == 6.5 and str(row["ts"]).startswith("2023-01-01")
    assert resample.resample_mean(df.limit(0), PanelSpec(step="1 month")).count() == 0


def test_time_summary(spark):
    times = [datetime(2024, 1, 1, 0, 0, 0), datetime(2024, 1, 1, 0, 0, 3), None]
    for kind in ("timestamp_ntz", "timestamp"):
        df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz").withColumn("t", F.col("t").cast(kind))
        r = profile.describe_time(df, "t").first()
        assert (r["count"], r["null_count"], r["min"], r["max"], r["mean"]) == (2, 1, times[0], times[1], datetime(2024, 1, 1, 0, 0, 1))


# ---- streams -----------------------------------------------------------------------------------


def test_a_stopped_stream_goes_on(spark, tmp_path):
    """Batches, a stop, a late row: closed windows equal the batch result, the late row is dropped, nothing comes twice."""
    spec, base = PanelSpec(step="1 hour"), str(tmp_path / "job")
    source = str(tmp_path / "source")
    at = lambda h, m=0: datetime(2024, 1, 1) + timedelta(hours=h, minutes=m)
    schema = "id int, ts timestamp_ntz, y double"

    def add(*data):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        return streaming.run_available(streaming.resample_stream(stream, spec, late="1 hour"), folder=base)

    add((1, at(0), 1.0), (1, at(0, 30), 3.0), (2, at(1), 5.0))
    add((1, at(1, 10), 2.0), (1, at(3), 4.0))
    first = run().collect()
    assert {(r["id"], r["ts"].hour, r["y"]) for r in first} == {(1, 0, 2.0), (2, 1, 5.0), (1, 1, 2.0)}
    add((1, at(0, 45), 1000.0), (1, at(3, 30), 6.0))  # the first is behind the watermark of 2:00
    add((2, at(9), 0.0))
    out = run()
    got = [(r["id"], r["ts"].hour, r["y"]) for r in out.collect()]
    assert sorted(got) == [(1, 0, 2.0), (1, 1, 2.0), (1, 3, 5.0), (2, 1, 5.0)]
    assert run().count() == 4


# ---- quantiles ---------------------------------------------------------------------------------


@pytest.mark.parametrize("shape", ["spread", "ties", "skew"])
def test_narrowed_quantiles_are_exact(spark, shape):
    rng = np.random.default_rng(5)
    x = {"spread": rng.normal(size=4000), "ties": rng.integers(0, 9, 4000).astype(float), "skew": rng.pareto(0.3, 4000)}[shape]
    df = spark.createDataFrame([("a" if i % 4 else None, float(v)) for i, v in enumerate(x)], "g string, v double")
    probs = [0.0, 0.1, 0.5, 0.999, 1.0]
    out = quantiles.exact_quantiles(df, ["g"], "v", probs, accuracy=50, ranked_values=20)
    got = {(r["g"], r["quantile"]): r["value"] for r in out.collect()}
    for g in ("a", None):
        mine = [v for i, v in enumerate(x) if bool(i % 4) == (g == "a")]
        assert [got[g, p] for p in probs] == pytest.approx([float(np.quantile(mine, p)) for p in probs])


def test_ranked_values_stay_bounded(spark, monkeypatch):
    """A hundred times the rows needs more counting passes, not more ranked values."""
    seen = []
    real = quantiles._narrowed

    def spy(r, stored, by, limit):
        out = real(r, stored, by, limit)
        if out is None:
            held = quantiles._with_brackets(r, stored, by).where(F.col("__v").between(F.col("__lo"), F.col("__hi")))
            seen.append(held.groupBy("quantile").agg(F.countDistinct("__v").alias("n")).agg(F.max("n")).first()[0])
        return out

    monkeypatch.setattr(quantiles, "_narrowed", spy)
    for n in (2_000, 200_000):
        df = spark.range(n).select((F.xxhash64("id") / 1e10).alias("v"))
        out = quantiles.exact_quantiles(df, [], "v", [0.5], accuracy=50, ranked_values=100).first()
        assert out["value"] == pytest.approx(float(np.median([r["v"] for r in df.collect()])))
    assert len(seen) == 2 and max(seen) <= 130


# ---- fitted state ------------------------------------------------------------------------------


def test_uncovered_rows_are_listed(spark):
    df = spark.createDataFrame([("a", 1.0, "x"), ("a", 2.0, "y"), (None, 3.0, "x"), ("b", 4.0, "z"), ("b", 4.0, None)], "id string, y double, kind string")
    prep = PanelPreprocessor(PanelSpec(), scale=("y",), encode=("kind",))
    state = prep.fit(df.where("id = 'a' or id is null"))
    assert rows(prep.uncovered(df, state), "kind", "column", "key", "rows") == rows(
        spark.createDataFrame([("scaler", "y", "b", 2), ("vocabulary", "kind", "z", 1), ("vocabulary", "kind", None, 1)], "kind string, column string, key string, rows long"),
        "kind", "column", "key", "rows",
    )
    assert prep.uncovered(df.where("id = 'a'"), state).isEmpty()
    shared = PanelPreprocessor(PanelSpec(), scale=("y",), scope="global")
    assert shared.uncovered(df, shared.fit(df)).isEmpty()


def test_states_tell_whether_they_are_fitted(spark):
    df = spark.createDataFrame([("a", 1.0, "x")], "id string, y double, kind string")
    prep = PanelPreprocessor(PanelSpec(), scale=("y",), encode=("kind",))
    state = prep.fit(df)
    partial = type(state)(state.scalers.where("column <> 'y'"), state.vocabularies)
    assert [prep.is_fitted(s) for s in (state, partial, None)] == [True, False, False]


# ---- staged tables -----------------------------------------------------------------------------


def test_staged_tables_can_be_discarded(spark, tmp_path):
    one, other = stage(spark.range(5), "one"), stage(spark.range(7), "other", codec="zstd")
    mine = str(tmp_path / "mine")
    spark.range(3).write.parquet(mine)
    outside = spark.read.parquet(mine)
    discard(one, outside)
    assert other.count() == 7 and outside.count() == 3
    with pytest.raises(Exception, match="(?i)not.exist|not.found"):
        one.count()
    discard(stage(spark.range(0), "none"))
