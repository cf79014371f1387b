"""Joins, states, vocabularies, batches, splits and sources."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from panelweave.functions.columns import downcast, log_target
from panelweave.operators import batches, joins, scaling, splits, vocab
from panelweave.operators.preprocess import PanelPreprocessor, PreprocessorState
from panelweave.operators.quantiles import exact_quantiles
from panelweave.plans import retail
from panelweave.sources import files, staging
from panelweave.spec import PanelSpec


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_shuffled_join_equals_broadcast_join(spark, how):
    # key 0 holds a third of all rows, a sixth has no key
    key = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 6 != 1, F.col("id") % 50)
    fact = spark.range(600).select(key.alias("k"), F.col("id").alias("n"))
    side = spark.range(0, 40, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    side = side.unionByName(spark.createDataFrame([(4, 999)], "k bigint, v bigint"))
    small = joins.attach(fact, side, "k", how)
    large = joins.attach(fact, side, "k", how, limit=3)
    assert "ResolvedHint (strategy=broadcast)" in small._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in large._jdf.queryExecution().analyzed().toString()
    assert small.columns == large.columns
    assert rows(small, *small.columns) == rows(large, *small.columns)


def test_wide_sides_are_not_broadcast(spark):
    wide = spark.range(70).select("id", F.repeat(F.lit("x"), 1_000_000).alias("text"))
    assert joins.fits_broadcast(wide.select("id"))
    assert not joins.fits_broadcast(wide)


def test_shuffled_join_takes_map_columns(spark):
    fact = spark.range(6).select((F.col("id") % 2).alias("k"), F.create_map(F.lit("a"), F.col("id")).alias("m"))
    side = spark.range(2).select(F.col("id").alias("k"), F.lit("v").alias("v"))
    assert joins.attach(fact, side, "k", limit=1).count() == 6


def test_holidays_multiply_rows_unless_deduped(spark):
    day = date(2024, 1, 1)
    fact = spark.createDataFrame([(day, "s", "c"), (day + timedelta(1), "s", "c")], "date date, state string, city string")
    calendar = spark.createDataFrame(
        [(day, "National", "x", "b"), (day, "National", "x", "a"), (day, "Local", "c", "l"), (day, "Regional", "other", "r")],
        "date date, locale string, locale_name string, description string",
    )
    every = rows(joins.holiday_join(fact, calendar), "date", "national_hol", "regional_hol", "local_hol")
    assert every == [(day, "a", "", "l"), (day, "b", "", "l"), (day + timedelta(1), "", "", "")]
    once = joins.holiday_join(fact, calendar, dedupe=True)
    assert rows(once, "national_hol") == [("",), ("a",)]


def test_series_is_filled_inside_each_trajectory(spark):
    d = [date(2024, 1, k) for k in range(1, 8)]
    oil = spark.createDataFrame([(d[0], 1.0), (d[2], None), (d[4], 5.0)], "date date, p double")
    fact = spark.createDataFrame(
        [("a", x, d[0]) for x in d] + [("b", x, d[1]) for x in d[1:]], "t string, date date, first date"
    )
    out = joins.attach_filled_series(fact, oil, date="date", value="p", since="first", until=d[6])
    got = {(r["t"], r["date"].day): r["p"] for r in out.collect()}
    assert [got["a", k] for k in range(1, 8)] == [1.0, 1.0, 1.0, 1.0, 5.0, 5.0, 5.0]
    # b starts on the second day and must not see the first day's price
    assert [got["b", k] for k in range(2, 8)] == [None, None, None, 5.0, 5.0, 5.0]


def test_zero_sales_policies(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (None,)], "x float")
    null = [r[0] for r in df.select(log_target(F.col("x"))).collect()]
    minus = [r[0] for r in df.select(log_target(F.col("x"), "neg_inf")).collect()]
    assert null == [0.0, None, None]
    assert minus == [0.0, float("-inf"), None]


def test_trajectory_prep_small(spark):
    d = [date(2024, 1, k) for k in range(1, 6)]
    train = spark.createDataFrame(
        [
            (d[0], 1, 7, 1.0, "True"), (d[1], 1, 7, 0.0, None), (d[4], 1, 7, 8.0, "False"),
            (d[0], 2, 7, 3.0, "True"), (d[1], 2, 7, -1.0, "True"),
            (date(2023, 1, 1), 1, 7, -5.0, "True"),  # a return outside the range does not count
        ],
        "date date, store_nbr int, item_nbr int, unit_sales double, onpromotion string",
    )
    out = retail.trajectory_prep(train, d[0], d[4]).orderBy("date").collect()
    assert [r["traj_id"] for r in out] == ["1_7"] * 5
    assert [r["open"] for r in out] == [1, 1, 0, 0, 1]
    assert [r["onpromotion"] for r in out] == [1, 1, 1, 1, 0]
    assert [round(r["log_sales"], 4) for r in out] == [0.0, 0.0, 0.0, 0.0, 2.0794]


def test_scaler_scopes_and_constant_series(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("b", 5.0)], "id string, y double")
    group = {r["scope_key"]: (r["mean"], r["scale"]) for r in scaling.fit_scaler(df, ["y"], "id").collect()}
    assert group == {"a": (2.0, 1.0), "b": (5.0, 1.0)}
    (one,) = scaling.fit_scaler(df, ["y"]).collect()
    assert (one["scope_key"], one["mean"]) == ("*", 3.5)
    state = staging.stage(scaling.fit_scaler(df, ["y"], "id"))
    scaled = scaling.scale(df, state, ["y"], "id")
    assert rows(scaled, "id", "y") == [("a", -1.0), ("a", 1.0), ("b", 0.0), ("b", 0.0)]
    back = scaling.inverse_scale(scaled, state, {"y": "y"}, "id")
    assert rows(back, "id", "y") == rows(df, "id", "y")


def test_vocabulary_orders_numbers_as_numbers(spark):
    df = spark.createDataFrame([(10, "b"), (2, "a"), (1, "b"), (10, None), (-3, "c")], "n int, t string")
    state = staging.stage(vocab.fit_vocabulary(df, ["n", "t"], ranges=3))
    codes = {(r["column"], r["value"]): r["code"] for r in state.collect()}
    assert codes == {
        ("n", "-3"): 0, ("n", "1"): 1, ("n", "2"): 2, ("n", "10"): 3, ("t", "a"): 0, ("t", "b"): 1, ("t", "c"): 2,
    }
    new = spark.createDataFrame([(2, "a"), (5, "b")], "n int, t string")
    with pytest.raises(Exception, match="unseen value in n: 5"):
        vocab.encode_labels(new, state, ["n", "t"]).collect()
    assert rows(vocab.encode_labels(new, state, ["n", "t"], "skip"), "n", "t") == [(2, 0)]
    assert rows(vocab.encode_labels(new, state, ["n", "t"], "keep"), "n", "t") == [(2, 0), (4, 1)]
    salted = vocab.encode_labels(new, state, ["n", "t"], "keep", limit=1)
    assert rows(salted, "n", "t") == [(2, 0), (4, 1)]


def test_large_vocabulary_is_numbered_without_gaps(spark):
    df = spark.range(5000).select(F.concat(F.lit("v"), F.col("id") % 3000).alias("t"))
    state = vocab.fit_vocabulary(df, ["t"], ranges=7)
    values = [r["value"] for r in state.orderBy("code").collect()]
    assert values == sorted({f"v{k}" for k in range(3000)})
    assert state.agg(F.min("code"), F.max("code"), F.count_distinct("code")).first()[:] == (0, 2999, 3000)


def test_preprocessor_round_trip_and_state(spark, tmp_path):
    df = spark.createDataFrame(
        [("m1", 3, 1.0), ("m1", 4, 2.0), ("m2", 3, 10.0), ("m2", 12, 30.0)], "id string, month int, y double"
    )
    prep = PanelPreprocessor(PanelSpec(), scale=("y",), months=("month",), encode=("kind",))
    df = df.withColumn("kind", F.concat(F.lit("k"), "month"))
    state = prep.fit(df)
    state.save(str(tmp_path / "s"))
    loaded = PreprocessorState.load(spark, str(tmp_path / "s"))
    out = prep.transform(df, loaded)
    assert rows(out, "id", "month", "y", "kind")[0] == ("m1", 2, -1.0, 1)
    assert rows(prep.inverse(out, loaded), *df.columns) == rows(df, *df.columns)
    assert prep.is_fitted(loaded)
    assert not prep.is_fitted(None)
    assert not prep.is_fitted(PreprocessorState(state.scalers, state.vocabularies.limit(0)))


@pytest.mark.parametrize("drop", [False, True])
def test_batches_cover_every_row_once(spark, drop):
    df = spark.range(1003).withColumnRenamed("id", "k")
    out = batches.assign_batches(df, ["k"], 64, seed=3, drop_remainder=drop, group_rows=100)
    sizes = [r["count"] for r in out.groupBy("batch").count().orderBy("batch").collect()]
    assert sizes == [64] * 15 + ([] if drop else [43])
    assert out.select("k").distinct().count() == sum(sizes)
    other = batches.assign_batches(df.repartition(5), ["k"], 64, seed=3, drop_remainder=drop, group_rows=100)
    assert rows(out, "k", "batch") == rows(other, "k", "batch")


def test_batches_follow_the_shuffled_order(spark):
    df = spark.range(700).withColumnRenamed("id", "k")
    order = [r["k"] for r in batches.shuffle_rows(df, ["k"], 5).collect()]
    out = {r["k"]: r["batch"] for r in batches.assign_batches(df, ["k"], 32, seed=5, group_rows=40).collect()}
    assert [out[k] for k in order] == [i // 32 for i in range(700)]


def test_numbered_groups_stay_bounded(spark):
    """A hundred times the rows makes more ranges, not larger ones."""
    for n in (1_000, 100_000):
        bits = ((n - 1) // 200).bit_length()
        keys = spark.range(n).select(F.shiftright(batches.seeded_hash(["id"], 1), batches.BITS - bits).alias("r"))
        assert keys.groupBy("r").count().agg(F.max("count")).first()[0] <= 400
        out = batches.assign_batches(spark.range(n), ["id"], 64, seed=1, group_rows=200)
        assert out.groupBy("batch").count().where("count <> 64").count() <= 1


def test_batches_of_no_rows(spark):
    assert batches.assign_batches(spark.range(0), ["id"], 8).count() == 0


def test_shuffles_are_seeded_permutations(spark):
    df = spark.range(200).withColumnRenamed("id", "k")

    def order(frame, seed):
        return [r["k"] for r in batches.shuffle_rows(frame, ["k"], seed).collect()]

    assert order(df, 1) == order(df.repartition(7), 1)
    assert order(df, 1) != order(df, 2)
    assert sorted(order(df, 1)) == list(range(200))


def test_three_way_split_drops_cold_starts(spark):
    d = date(2024, 1, 1)
    df = spark.createDataFrame(
        [("a", d), ("a", d + timedelta(5)), ("a", d + timedelta(9)), ("b", d + timedelta(5)), ("b", d + timedelta(9))],
        "id string, ts date",
    )
    parts = splits.split_three(df, d + timedelta(5), d + timedelta(9), PanelSpec())
    assert [rows(p, "id") for p in parts] == [[("a",)], [("a",)], [("a",)]]
    early, late = splits.split_two(df, d + timedelta(5), overlap=timedelta(5))
    assert (early.count(), late.count()) == (1, 5)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 15, 101, 1000])
def test_exact_quantiles_equal_percentile(spark, n):
    df = spark.range(n).select((F.col("id") % 2).alias("g"), F.round(F.rand(n) * 20).alias("v"))
    probs = [0.0, 0.1, 0.25, 0.5, 0.7, 0.9, 1.0]
    for accuracy in (100_000, 100):  # the second one makes the brackets wide and the sketch lossy
        out = exact_quantiles(df, ["g"], "v", probs, accuracy)
        got = {(r["g"], r["quantile"]): r["value"] for r in out.collect()}
        want = df.groupBy("g").agg(F.percentile("v", F.array(*[F.lit(p) for p in probs])).alias("p"))
        for r in want.collect():
            assert [got[r["g"], p] for p in probs] == pytest.approx(r["p"])


def test_downcast_raises_on_overflow(spark):
    df = spark.createDataFrame([(70000,)], "store_nbr int")
    with pytest.raises(Exception, match="CAST_OVERFLOW|overflow"):
        downcast(df).collect()


def test_materialize_builds_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    path = str(tmp_path / "t")
    assert staging.materialize(spark, path, build).count() == 3
    assert staging.materialize(spark, path, build).count() == 3
    assert calls == [1]


def test_decimal_comma_text(spark, tmp_path):
    (tmp_path / "m.txt").write_text('"";"MT_001";"MT_002"\n"2011-01-01 00:15:00";0;1,5\n"2011-01-01 00:30:00";2,25;\n')
    out = files.convert_decimal_comma(spark, str(tmp_path / "m.txt"), str(tmp_path / "m.parquet"))
    assert out.columns == ["timestamp", "MT_001", "MT_002"]
    assert [(str(r[0]), r[1], r[2]) for r in out.orderBy("timestamp").collect()] == [
        ("2011-01-01 00:15:00", 0.0, 1.5), ("2011-01-01 00:30:00", 2.25, None),
    ]


def test_csv_months(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Month,#Passengers\n1949-01,112\n1949-02,118\n")
    df = files.read_csv_dates(spark, str(tmp_path / "a.csv"), "Month string, `#Passengers` int", ["Month"])
    assert [(str(r[0]), r[1]) for r in df.collect()] == [("1949-01-01", 112), ("1949-02-01", 118)]
