"""One query per operator; every query reads whole tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.functions import columns as C
from panelweave.functions import timegrid as TG
from panelweave.functions.arrays import softmax
from panelweave.functions.losses import QUANTILES, pinball, pinball_arrays
from panelweave.operators import batches, evaluate, forecast, groups, importance, joins, profile
from panelweave.operators import resample, scaling, series, splits, vocab, windows
from panelweave.operators.preprocess import (
    PanelPreprocessor,
    PreprocessorState,
    electricity_preprocessor,
    retail_preprocessor,
)
from panelweave.plans import hourly as hourly_plan
from panelweave.plans import forecasting, monthly, retail
from panelweave.sources import files, staging
from panelweave.spec import PanelSpec
from panelweave.streaming import resample as streaming
from panelweave.workloads import standins as S

# Added before rounding means of 2^k exact decimals, which otherwise fall on rounding ties.
TIE = 1e-9

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SPLIT = date(2024, 1, 24)
VALIDATION, TEST = date(2024, 1, 5), date(2024, 1, 20)
WINDOW, ENCODER = 7, 5
BANDS = dict(zip(("yhat_low", "yhat", "yhat_up"), QUANTILES, strict=True))


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(name: str):
    return F.round(F.col(name).cast("double"), 6).alias(name)


def r8(name: str):
    """For means of exact decimals, where a tie at the seventh place is likely."""
    return F.round(F.col(name).cast("double"), 8).alias(name)


# ---- sources and sinks -------------------------------------------------------------------------


@query
def read_csv_dates(spark, sf):
    path = staging.new_path(spark, "csv-months")
    S.months(spark, sf).write.csv(path, header=True)
    df = files.read_csv_dates(spark, path, "Month string, Passengers double", ["Month"])
    return df.withColumnRenamed("Month", "month_start")


@query
def read_decimal_comma(spark, sf):
    path, out = staging.new_path(spark, "meter-text"), staging.new_path(spark, "meter-parquet")
    stamp = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("")
    comma = [F.replace(F.col(m).cast("string"), F.lit("."), F.lit(",")).alias(m) for m in S.METERS]
    S.meters(spark, sf).select(stamp, *comma).write.csv(path, header=True, sep=";")
    df = files.convert_decimal_comma(spark, path, out)
    return df.select("timestamp", *[r6(m) for m in S.METERS])


@query
def scan_parquet(spark, sf):
    return files.read_table(spark, f"{sf}/events.parquet", ["event_id", "user_id", "value"])


@query
def write_parquet(spark, sf):
    path = staging.new_path(spark, "orders-copy")
    files.write_table(S.table(spark, sf, "orders"), path, ["o_orderstatus"])
    return spark.read.parquet(path).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query
def cached_result(spark, sf):
    path = staging.new_path(spark, "cached-daily")

    def again():
        raise AssertionError("the stored result must be reused")

    staging.materialize(spark, path, lambda: S.daily(spark, sf))
    return staging.materialize(spark, path, again).select("id", "ts", r6("y"))


@query
def preprocessor_state(spark, sf):
    panel = staging.stage(S.hourly_parts(spark, sf), "panel")
    prep, path = electricity_preprocessor(), staging.new_path(spark, "state")
    prep.fit(panel).save(path)
    out = prep.transform(panel, PreprocessorState.load(spark, path))
    return out.select("id", "ts", r6("year"), "month", "day", "day_of_week", "hour", r6("y"))


# ---- projections and columns -------------------------------------------------------------------


@query
def select_order(spark, sf):
    return S.hourly_parts(spark, sf).select("id", "ts", "year", "month", "day", "hour", r6("y"))


@query
def rename(spark, sf):
    return (
        S.table(spark, sf, "events")
        .withColumnsRenamed({"user_id": "id", "value": "y"})
        .select("event_id", "id", "ts", "y")
    )


@query
def drop(spark, sf):
    return S.table(spark, sf, "events").drop("event_type", "props")


@query
def literal_column(spark, sf):
    rows = S.table(spark, sf, "orders").select("o_orderkey")
    return rows.withColumns(
        {"id": F.lit(0), "open": F.lit(1).cast("tinyint"), "split": F.lit("training")}
    )


@query
def downcast(spark, sf):
    return C.downcast(S.train(spark, sf).drop("onpromotion"))


@query
def text_flag(spark, sf):
    return S.train(spark, sf).select(
        "date", "store_nbr", "item_nbr", C.text_flag(F.col("onpromotion")).alias("onpromotion")
    )


@query
def composite_key(spark, sf):
    return S.train(spark, sf).select(
        "date", C.composite_key(F.col("store_nbr"), F.col("item_nbr")).alias("traj_id")
    )


@query
def fill_null_const(spark, sf):
    df = S.train(spark, sf).select("date", "store_nbr", "item_nbr", "onpromotion")
    return C.fill_constant(df, {"onpromotion": ""})


@query
def feature_vector(spark, sf):
    names = ["l_quantity", "l_discount", "l_tax"]
    df = S.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", C.feature_vector(names).alias("v")
    )
    picks = [F.element_at("v", i + 1).alias(f"v{i}") for i in range(len(names))]
    return df.select("l_orderkey", "l_linenumber", *picks)


@query
def scalar_functions(spark, sf):
    """All scalar functions: date parts, month end, parsing, log, text, casts, greatest, softmax."""
    d, x = F.col("o_orderdate"), F.col("o_totalprice")
    low, mid = softmax([F.lit(0.0), x / 100000.0])
    return S.table(spark, sf, "orders").select(
        "o_orderkey",
        F.year(d).alias("year"),
        F.month(d).alias("month"),
        F.dayofmonth(d).alias("day"),
        F.hour(d).alias("hour"),
        TG.iso_weekday(d).alias("weekday"),
        F.last_day(d).alias("month_end"),
        TG.parse_year_month(F.date_format(d, "yyyy-MM")).alias("month_start"),
        F.round(C.log_target(x), 6).alias("log_price"),
        F.replace(F.col("o_orderpriority"), F.lit("-"), F.lit(".")).alias("replaced"),
        C.composite_key(F.col("o_custkey"), F.col("o_orderstatus")).alias("key"),
        x.cast("int").alias("whole"),
        (x >= 100000).alias("large"),
        C.month_to_index(F.month(d)).alias("month_index"),
        C.index_to_month(C.month_to_index(F.month(d))).alias("month_again"),
        F.greatest(x - 100000.0, F.lit(0.0)).alias("excess"),
        F.round(low, 6).alias("softmax_low"),
        F.round(mid, 6).alias("softmax_mid"),
    )


# ---- filters -----------------------------------------------------------------------------------


@query
def date_range_filter(spark, sf):
    df = S.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return splits.between(df, "l_shipdate", date(1996, 1, 1), date(1996, 6, 30))


@query
def locale_filter(spark, sf):
    calendar = S.holidays(spark, sf)
    views = [v for v, _, _ in joins.holiday_views(calendar)]
    parts = [
        v.select("date", F.lit(level).alias("level"), F.col(v.columns[-1]).alias("name"))
        for v, level in zip(views, ("national", "regional", "local"), strict=True)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def not_null_filter(spark, sf):
    return S.transactions(spark, sf).where(F.col("transactions").isNotNull())


@query
def year_filter(spark, sf):
    df = S.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return df.where(TG.from_year(F.col("o_orderdate"), 1998))


def _trajectories(spark, sf):
    train = staging.stage(S.train(spark, sf).drop("onpromotion"), "train")
    return train.withColumn("traj_id", C.composite_key(F.col("store_nbr"), F.col("item_nbr")))


TRAIN_SPEC = retail.TRAJECTORY.with_(target="unit_sales")


@query
def drop_negative_groups(spark, sf):
    df = _trajectories(spark, sf).select("traj_id", "date", "unit_sales")
    nameless = F.when(F.col("traj_id") != "3_2", F.col("traj_id")).alias("traj_id")
    return series.drop_negative_groups(df.select(nameless, "date", "unit_sales"), TRAIN_SPEC)


# ---- joins -------------------------------------------------------------------------------------


@query
def left_join_series(spark, sf):
    oil = staging.stage(S.oil(spark, sf), "oil")
    out = joins.left_join_series(S.train(spark, sf).drop("onpromotion"), oil, "date")
    return out.select("date", "store_nbr", "item_nbr", "unit_sales", r6("dcoilwtico"))


@query
def inner_join_dims(spark, sf):
    stores = staging.stage(S.stores(spark, sf), "stores")
    items = staging.stage(S.items(spark, sf), "items")
    out = joins.inner_join_dims(S.train(spark, sf), [(stores, "store_nbr"), (items, "item_nbr")])
    return out.select("date", "store_nbr", "item_nbr", "unit_sales", "city", "state", "family", "class")


@query
def inner_join_composite(spark, sf):
    traffic = staging.stage(S.transactions(spark, sf), "transactions")
    out = joins.inner_join_composite(
        S.train(spark, sf).drop("onpromotion"), traffic, ["store_nbr", "date"]
    )
    return out.select("date", "store_nbr", "item_nbr", "unit_sales", "transactions")


@query
def holiday_join(spark, sf):
    calendar = staging.stage(S.holidays(spark, sf), "holidays")
    stores = staging.stage(S.stores(spark, sf), "stores")
    facts = joins.attach(S.transactions(spark, sf), stores, "store_nbr", "inner")
    return joins.holiday_join(facts, calendar).select(
        "date", "store_nbr", "transactions", "national_hol", "regional_hol", "local_hol"
    )


@query
def trajectory_prep(spark, sf):
    train = staging.stage(S.train(spark, sf), "train")
    return retail.trajectory_prep(train).withColumn("log_sales", r6("log_sales"))


def _star(spark, sf):
    return retail.star_assembly(S.retail_tables(spark, sf))


@query
def star_assembly(spark, sf):
    return _star(spark, sf).withColumns(
        {"log_sales": r6("log_sales"), "oil_price": F.round(F.col("oil_price").cast("double"), 0)}
    )


@query
def cold_start_filter(spark, sf):
    panel = staging.stage(S.daily(spark, sf), "daily")
    early, late = splits.split_two(panel, date(2024, 1, 2))
    ids = staging.stage(early.select("id").distinct(), "ids")
    return joins.cold_start_filter(late, ids, "id").select("id", "ts", r6("y"))


@query
def actual_vs_forecast(spark, sf):
    panel = staging.stage(S.daily(spark, sf), "daily")
    pred = panel.select("id", F.date_add("ts", 1).alias("ts"), F.col("y").alias("yhat"))
    return joins.actual_vs_forecast(panel, pred).select("id", "ts", r6("y"), r6("yhat"))


# ---- aggregations ------------------------------------------------------------------------------


@query
def resample_mean(spark, sf):
    return S.hourly(spark, sf).select("id", "ts", r6("y"))


@query
def resample_monthly(spark, sf):
    """Means per calendar month and per quarter."""
    orders = S.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("id"), F.col("o_orderdate").cast("date").alias("ts"), F.col("o_totalprice").cast("double").alias("y")
    )
    spec = PanelSpec(step="1 month")
    months = resample.resample_mean(orders, spec).withColumn("step", F.lit("month"))
    quarters = resample.resample_mean(orders, spec, "3 months").withColumn("step", F.lit("quarter"))
    return months.unionByName(quarters).select("step", "id", "ts", F.round("y", 4).alias("y"))


@query
def group_apply(spark, sf):
    """A pandas function that scales with the entity's own moments; pieces of one day, many in a call."""
    panel = staging.stage(S.hourly(spark, sf), "hourly")

    def moments(pieces):
        sums = pieces.assign(q=pieces["y"] ** 2).groupby(groups.PIECE).agg(n=("y", "size"), s=("y", "sum"), q=("q", "sum"))
        first = ~pieces[groups.PIECE].duplicated()
        return sums.assign(id=pieces.loc[first, "id"].to_numpy())[["id", "n", "s", "q"]]

    def scaled(pieces):
        mean = pieces["s"] / pieces["n"]
        sd = (pieces["q"] / pieces["n"] - mean**2).clip(lower=0) ** 0.5
        z = ((pieces["y"] - mean) / sd.where(pieces["n"] > 1, 1.0)).round(6)
        return pieces.assign(z=z)[["id", "ts", "z"]]

    return groups.group_apply(
        panel, S.HOURLY.with_(chunk_steps=24), moments, "id bigint, n bigint, s double, q double",
        [F.sum(c).alias(c) for c in ("n", "s", "q")], scaled, "id bigint, ts timestamp_ntz, z double", batched=True,
    )


@query
def fit_scaler(spark, sf):
    panel = S.hourly_parts(spark, sf)
    both = scaling.fit_scaler(panel, ["y", "year"], "id").unionByName(
        scaling.fit_scaler(panel, ["y", "year"])
    )
    return both.select("scope_key", "column", *[F.round(F.col(c) + TIE, 6).alias(c) for c in ("mean", "scale")])


@query
def fit_vocabulary(spark, sf):
    panel = S.hourly_parts(spark, sf)
    numbers = vocab.fit_vocabulary(panel, ["id", "month", "day", "hour", "day_of_week"])
    texts = vocab.fit_vocabulary(S.table(spark, sf, "part"), ["p_type", "p_brand", "p_name"])
    return numbers.unionByName(texts)


@query
def distinct_ids(spark, sf):
    return profile.distinct_ids(S.table(spark, sf, "events"), "user_id")


@query
def null_count(spark, sf):
    return profile.null_count(S.meters(spark, sf))


@query
def describe(spark, sf):
    table = profile.describe(S.table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"])
    return table.select("column", "count", "null_count", r6("mean"), r6("std"), r6("min"), r6("max"))


@query
def describe_time(spark, sf):
    return profile.describe_time(S.table(spark, sf, "events"), "ts")


@query
def row_count(spark, sf):
    return profile.row_count(splits.split_label(S.readings(spark, sf), SPLIT), ["split"])


@query
def batch_mean(spark, sf):
    losses = S.table(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("epoch"), F.col("l_extendedprice").alias("loss")
    )
    return evaluate.batch_mean(losses, "loss").select("epoch", F.round("loss", 4).alias("loss"))


# ---- ordered operators -------------------------------------------------------------------------


@query
def forward_fill(spark, sf):
    wide = staging.stage(S.meters(spark, sf), "meters")
    long = resample.wide_to_long(wide.withColumnRenamed("timestamp", "ts"), "ts")
    # one meter without a name is a series of its own
    long = long.withColumn("id", F.when(F.col("id") != "click", F.col("id")))
    # pieces of one day, so that values are carried over many piece borders
    spec = S.HOURLY.with_(step="15 minutes", chunk_steps=96)
    return series.forward_fill(long, spec, ["y"]).select("id", "ts", r6("y"))


@query
def partition_min(spark, sf):
    df = _trajectories(spark, sf).select("traj_id", "date", "unit_sales")
    return series.partition_min(df, TRAIN_SPEC, "unit_sales", "lowest")


def _order_days(spark, sf):
    return (
        S.table(spark, sf, "orders")
        .groupBy(F.col("o_orderdate").cast("date").alias("ts"))
        .agg(F.round(F.sum("o_totalprice"), 2).alias("y"))
        .withColumn("id", F.lit(0))
    )


def _exploded(w):
    step = F.posexplode("steps").alias("step", "s")
    return w.select("id", "window_ts", "is_first", step).select(
        "id", "window_ts", "is_first", "step", F.col("s.ts").alias("ts"), F.round("s.y", 6).alias("y")
    )


@query
def sliding_windows(spark, sf):
    """A single long series, cut into blocks of 64 rows."""
    days = staging.stage(_order_days(spark, sf), "order-days")
    w = windows.sliding_windows(days, S.DAILY.with_(chunk_steps=365), 12, ["y"], block_steps=64)
    return _exploded(w)


@query
def panel_windows(spark, sf):
    daily = staging.stage(S.daily(spark, sf), "daily")
    nameless = daily.withColumn("id", F.when(F.col("id") != 7, F.col("id")))
    return _exploded(windows.sliding_windows(nameless, S.DAILY, WINDOW, ["y"]))


def _dense_daily(spark, sf):
    """Gap-free daily panel, stored."""
    daily = staging.stage(S.daily(spark, sf), "daily")
    panel = series.fill_gaps(daily, S.DAILY, forward=["y"])
    return staging.stage(panel, "dense-daily")


def _dense_windows(spark, sf, columns=("y",)):
    return windows.sliding_windows(
        _dense_daily(spark, sf), S.DAILY, WINDOW, list(columns), dense=True, block_steps=8
    )


@query
def encoder_decoder_split(spark, sf):
    panel = _dense_daily(spark, sf).withColumn("weekday", TG.iso_weekday(F.col("ts")))
    w = windows.sliding_windows(panel, S.DAILY, WINDOW, ["id", "weekday", "y"], dense=True)
    xy = windows.encoder_decoder_split(w, ENCODER, ["id", "weekday"], ["y"])
    return xy.select("id", "window_ts", F.posexplode("x").alias("step", "x"), "y").select(
        "id",
        "window_ts",
        "step",
        F.col("x")[0].alias("x_id"),
        F.col("x")[1].alias("x_weekday"),
        F.round(
            F.when(F.col("step") >= ENCODER, F.get(F.get("y", F.col("step") - ENCODER), F.lit(0))), 6
        ).alias("y"),
    )


@query
def flatten_windows(spark, sf):
    flat = windows.flatten_windows(_dense_windows(spark, sf))
    return flat.select("id", "ts", r6("y"))


# ---- gap filling -------------------------------------------------------------------------------


@query
def upsample_daily(spark, sf):
    df = _trajectories(spark, sf).select("traj_id", "date", "store_nbr", "unit_sales")
    # pieces of 30 days, so that gaps cross many piece borders
    return resample.upsample(df, TRAIN_SPEC.with_(chunk_steps=30), ["store_nbr"], made="made")


@query
def upsample_monthly(spark, sf):
    return monthly.month_end_panel(S.months(spark, sf), "Month", "Passengers")


# ---- ordering and batching ---------------------------------------------------------------------


@query
def sort_panel(spark, sf):
    return S.hourly(spark, sf).select("id", "ts", r6("y")).orderBy("id", "ts")


@query
def head(spark, sf):
    return S.hourly(spark, sf).select("id", "ts", r6("y")).orderBy("id", "ts").limit(10)


@query
def shuffle_rows(spark, sf):
    return batches.shuffle_rows(S.hourly(spark, sf).select("id", "ts", r6("y")), ["id", "ts"], 69)


@query
def assign_batches(spark, sf):
    """The batch of every row, in ranges of a few hundred rows."""
    panel = staging.stage(S.hourly(spark, sf), "hourly")
    rows = batches.assign_batches(panel, ["id", "ts"], 64, seed=69, group_rows=500)
    return rows.select("id", "ts", "batch")


# ---- reshaping and splits ----------------------------------------------------------------------


@query
def union_all(spark, sf):
    train, test = splits.split_two(S.readings(spark, sf), SPLIT)
    return train.withColumn("split", F.lit("training")).unionByName(
        test.withColumn("split", F.lit("validation"))
    )


@query
def wide_to_long(spark, sf):
    return resample.wide_to_long(S.meters(spark, sf), "timestamp").select("id", "timestamp", r6("y"))


@query
def hourly_panel(spark, sf):
    panel = resample.hourly_panel(S.meters(spark, sf), meters=S.METERS)
    return panel.withColumn("y", F.round(F.col("y").cast("double"), 3))


@query
def split_two(spark, sf):
    train, test = splits.split_two(S.table(spark, sf, "events").select("event_id", "ts"), SPLIT)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query
def split_three(spark, sf):
    panel = staging.stage(S.readings(spark, sf).withColumn("kind", F.floor("y")), "readings")
    spec = PanelSpec(id="kind")  # whole values: rare ones occur only late
    parts = splits.split_three(panel, VALIDATION, TEST, spec)
    named = [
        p.select(F.lit(n).alias("part"), "id", "ts", "kind")
        for p, n in zip(parts, ("train", "validation", "test"), strict=True)
    ]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query
def split_label(spark, sf):
    return splits.split_label(S.readings(spark, sf), SPLIT)


@query
def split_series(spark, sf):
    return splits.split_label(S.daily(spark, sf), SPLIT).select("id", "ts", r6("y"), "split")


# ---- preprocessing -----------------------------------------------------------------------------


def _panel(spark, sf):
    return staging.stage(S.hourly_parts(spark, sf), "hourly-parts")


@query
def scale_by_group(spark, sf):
    panel = _panel(spark, sf)
    state = staging.stage(scaling.fit_scaler(panel, ["y", "year"], "id"), "scalers")
    return scaling.scale(panel, state, ["y", "year"], "id").select("id", "ts", r6("year"), r6("y"))


@query
def scale_global(spark, sf):
    panel = _panel(spark, sf)
    state = staging.stage(scaling.fit_scaler(panel, ["y", "year"]), "scalers")
    return scaling.scale(panel, state, ["y", "year"]).select("id", "ts", r6("year"), r6("y"))


@query
def encode_labels(spark, sf):
    parts = S.table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    state = staging.stage(vocab.fit_vocabulary(parts, ["p_brand", "p_type", "p_size"]), "vocab")
    return vocab.encode_labels(parts, state, ["p_brand", "p_type", "p_size"])


@query
def inverse_scale(spark, sf):
    panel = _panel(spark, sf)
    state = staging.stage(scaling.fit_scaler(panel, ["y"], "id"), "scalers")
    scaled = scaling.scale(panel, state, ["y"], "id")
    moved = scaled.select("id", "ts", "y", (F.col("y") + 1).alias("yhat"))
    back = scaling.inverse_scale(moved, state, {"y": "y", "yhat": "y"}, "id")
    return back.select("id", "ts", r6("y"), r6("yhat"))


@query
def inverse_labels(spark, sf):
    parts = S.table(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    state = staging.stage(vocab.fit_vocabulary(parts, ["p_brand", "p_size"]), "vocab")
    codes = vocab.encode_labels(parts, state, ["p_brand", "p_size"])
    return vocab.decode_labels(codes, state, ["p_brand", "p_size"], {"p_size": "int"})


@query
def month_normalizer(spark, sf):
    m = F.month("o_orderdate")
    return S.table(spark, sf, "orders").select(
        "o_orderkey",
        C.month_to_index(m).alias("month_index"),
        C.index_to_month(C.month_to_index(m)).alias("month"),
    )


@query
def column_transformer(spark, sf):
    panel = staging.stage(monthly.month_end_panel(S.months(spark, sf), "Month", "Passengers"), "months")
    prep = PanelPreprocessor(
        monthly.MONTH_ENDS, scale=("year", "y"), months=("month",), scope="global",
        output=("id", "ts", "year", "month", "y"),
    )
    out = prep.transform(panel, prep.fit(panel))
    return out.select("id", "ts", r6("year"), "month", r6("y"))


@query
def electricity_transform(spark, sf):
    """Observed form: one mean and scale shared by all meters."""
    panel, prep = _panel(spark, sf), electricity_preprocessor("global")
    out = prep.transform(panel, prep.fit(panel))
    return out.select("id", "ts", r6("year"), "month", "day", "day_of_week", "hour", r6("y"))


@query
def retail_transform(spark, sf):
    """The retail panel scaled and encoded, and the encoded part decoded again."""
    known = C.fill_constant(_star(spark, sf), {"onpromotion": 0})  # unknown before the first day
    panel = staging.stage(C.downcast(known), "star")
    prep = retail_preprocessor()
    state = prep.fit(panel)
    out = prep.transform(panel, state)
    back = vocab.decode_labels(out, state.vocabularies, ["city", "family"])
    return back.select(
        "traj_id", "date", F.round("log_sales", 4).alias("log_sales"),
        F.round("transactions", 4).alias("transactions"), "item_nbr", "store_nbr", "national_hol",
        "regional_hol", "local_hol", "onpromotion", "open", "city", "family", "state", "type", "cluster", "class",
        "perishable", "month", "day_of_month", "day_of_week", F.round("year", 4).alias("year"),
        F.round("oil_price", 4).alias("oil_price"),
    )


@query
def is_fitted(spark, sf):
    """What a state fitted on early rows of three quarters of the meters lacks for the whole panel."""
    panel = staging.stage(_panel(spark, sf), "panel")
    prep = electricity_preprocessor()
    state = prep.fit(panel.where((F.col("ts") < F.lit("2024-01-10").cast(panel.schema["ts"].dataType)) & (F.col("id") % 4 != 0)))
    return prep.uncovered(panel, state)


# ---- forecasts and scores ----------------------------------------------------------------------


def _persistence(spark, sf):
    """Window forecasts that repeat the last encoder value, with a band of one around it."""
    w = _dense_windows(spark, sf)
    last = F.element_at("steps", ENCODER)["y"]
    tail = F.slice("steps", ENCODER + 1, WINDOW - ENCODER)
    steps = F.transform(
        tail,
        lambda s: F.struct(
            s["ts"].alias("ts"), s["y"].alias("y"), (last - 1.0).alias("yhat_low"),
            last.alias("yhat"), (last + 1.0).alias("yhat_up"),
        ),
    )
    return w.select("id", "window_ts", "is_first", steps.alias("steps"))


def _forecast_rows(spark, sf):
    rows = _persistence(spark, sf).select("id", "window_ts", F.posexplode("steps").alias("step", "s"))
    return rows.select("id", "window_ts", "step", "s.*")


@query
def pinball_loss(spark, sf):
    loss = evaluate.pinball_loss(_forecast_rows(spark, sf), ["id", "window_ts"], 0.9)
    return loss.select("id", "window_ts", r8("loss"))


@query
def pinball_loss_arrays(spark, sf):
    """The same loss from window rows, without a shuffle."""
    w = _persistence(spark, sf)
    y, yhat = F.col("steps")["y"], F.col("steps")["yhat"]
    return w.select("id", "window_ts", F.round(pinball_arrays(y, yhat, 0.9), 8).alias("loss"))


@query
def quantile_pinball_loss(spark, sf):
    loss = evaluate.quantile_pinball_loss(_forecast_rows(spark, sf), ["id", "window_ts"], BANDS)
    return loss.select("id", "window_ts", r8("loss"))


@query
def evaluate_forecast(spark, sf):
    """Mean loss per entity and step."""
    scores = evaluate.evaluate_forecast(
        _forecast_rows(spark, sf), ["id", "window_ts"], BANDS, ["id", "step"]
    )
    return scores.select("id", "step", r8("loss"), "windows")


def _design(spark, sf):
    """Design table of the scaled daily panel."""
    panel = _dense_daily(spark, sf)
    state = staging.stage(scaling.fit_scaler(panel, ["y"], "id"), "scalers")
    known = scaling.scale(panel, state, ["y"], "id").withColumn(
        "weekday", TG.iso_weekday(F.col("ts"))
    )
    # the id as a small real input
    known = known.withColumn("id_code", F.col("id") / F.lit(1000.0))
    roles = forecast.InputRoles(
        static_real=("id_code",), known_categorical={"weekday": 8}, use_target_history=True
    )
    w = windows.sliding_windows(known, S.DAILY, WINDOW, roles.columns, dense=True)
    return staging.stage(forecast.design_matrix(w, roles, ENCODER), "design"), roles


@query
def quantile_baseline(spark, sf):
    design, _ = _design(spark, sf)
    return forecast.quantile_baseline(design).select("step", "quantile", r6("value"))


def _calendar(rows):
    return rows.withColumn("weekday", TG.iso_weekday(F.col("ts")))


def _category_panel(spark, sf):
    """The scaled daily panel with entity and group codes, its scalers, and the roles of a model on them."""
    panel = _dense_daily(spark, sf)
    state = staging.stage(scaling.fit_scaler(panel, ["y"], "id"), "scalers")
    coded = panel.withColumns({"entity": F.col("id"), "cohort": F.pmod("id", F.lit(5))})
    words = staging.stage(vocab.fit_vocabulary(coded, ["entity", "cohort"]), "vocabulary")
    coded = vocab.encode_labels(coded, words, ["entity", "cohort"])
    sizes = {r["column"]: r["n"] for r in words.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    static = {c: sizes.get(c, 1) for c in ("entity", "cohort")}
    roles = forecast.InputRoles(static_categorical=static, known_categorical={"weekday": 8}, use_target_history=True)
    return staging.stage(_calendar(scaling.scale(coded, state, ["y"], "id")), "category-panel"), state, roles


def _category_fit(spark, sf, score: bool = False):
    """Two steps of a model with a category for every entity on the windows before ``TEST``; the later ones score it if asked."""
    panel, state, roles = _category_panel(spark, sf)
    w = windows.sliding_windows(panel, S.DAILY, WINDOW, roles.columns, dense=True)
    design = staging.stage(forecast.design_matrix(w, roles, ENCODER), "design")
    train, held = splits.split_two(design, TEST, "window_ts")
    fit = forecast.fit_quantile_model(
        train, roles, held_out=held if score else None, epochs=2, learning_rate=0.02, min_delta=0.0, patience=9
    )
    return panel, state, roles, design, fit


@query
def fit_quantile_model(spark, sf):
    """The weights with the least training loss of two full steps."""
    fit = _category_fit(spark, sf)[-1]
    return fit.model.select("step", "quantile", "position", "feature", r6("weight"))


@query
def fit_history(spark, sf):
    """Losses of both parts before, between and after the two steps."""
    return _category_fit(spark, sf, score=True)[-1].history.select("epoch", r6("train_loss"), r6("held_out_loss"))


@query
def forecast_flow(spark, sf):
    """Forecasts of a fitted model for the days after every entity's last one, in original units."""
    panel, state, roles, _, fit = _category_fit(spark, sf)
    out = forecasting.forecast_beyond(panel, S.DAILY, fit, roles, ENCODER, WINDOW - ENCODER, _calendar, state)
    return out.select("id", "step", "ts", r6("yhat_low"), r6("yhat"), r6("yhat_up"))


def _stated_model(spark, sf):
    """The baseline quantiles as bias and half of the last value as slope, as a stored model."""
    design, roles = _design(spark, sf)
    bias = forecast.quantile_baseline(design).select(
        "step", "quantile", F.lit(0).alias("position"), F.lit("bias").alias("feature"),
        F.col("value").alias("weight"),
    )
    slope = {"y_last": 0.5, "weekday=3": 0.25}
    rest = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("position"), F.lit(n).alias("feature"),
                    F.lit(slope.get(n, 0.0)).alias("weight"),
                )
                for i, n in enumerate(roles.features)
                if i
            ]
        )
    ).alias("e")
    model = bias.unionByName(bias.select("step", "quantile", rest).select("step", "quantile", "e.*"))
    return design, roles, staging.stage(model, "model")


@query
def predict_quantiles(spark, sf):
    design, _, model = _stated_model(spark, sf)
    out = forecast.predict_quantiles(design, model)
    return out.select("id", "window_ts", "step", "ts", r6("y"), r6("yhat_low"), r6("yhat"), r6("yhat_up"))


def _two_targets(spark, sf):
    """Forecasts of two targets of the daily panel from shared inputs, by a stated model."""
    panel, _, roles = _category_panel(spark, sf)
    panel = panel.withColumn("z", F.col("y") * F.col("y"))
    roles = forecast.InputRoles(
        more_targets=("z",), static_categorical=roles.static_categorical, known_categorical={"weekday": 8}, use_target_history=True
    )
    w = windows.sliding_windows(panel, S.DAILY, WINDOW, roles.columns, dense=True)
    design = staging.stage(forecast.design_matrix(w, roles, ENCODER), "design")
    bias = forecast.quantile_baseline(design).select("step", "quantile", F.lit("bias").alias("feature"), F.col("value").alias("weight"))
    slopes = F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(v).alias("weight")) for n, v in (("y_last", 0.5), ("z_mean", -0.25), ("weekday=3", 0.125))])
    model = bias.unionByName(bias.select("step", "quantile", F.explode(slopes).alias("e")).select("step", "quantile", "e.*"))
    places = spark.range(roles.width).select(F.col("id").cast("int").alias("position")).withColumn("feature", roles.feature_name(F.col("position")))
    model = staging.stage(model.join(places, "feature"), "model")
    return forecast.split_outputs(forecast.predict_quantiles(design, model), roles, WINDOW - ENCODER)


@query
def predict_two_targets(spark, sf):
    out = _two_targets(spark, sf)
    return out.select("id", "window_ts", "output", "step", "ts", r6("y"), r6("yhat_low"), r6("yhat"), r6("yhat_up"))


@query
def two_target_loss(spark, sf):
    """Losses summed over the targets, averaged over the steps."""
    loss = evaluate.quantile_pinball_loss(_two_targets(spark, sf), ["id", "window_ts"], BANDS, outputs=2)
    return loss.select("id", "window_ts", r6("loss"))


@query
def predict_external_model(spark, sf):
    """A user's numpy model: mean of the encoder values, less and plus one."""
    w = _dense_windows(spark, sf)
    x = F.transform(F.slice("steps", 1, ENCODER), lambda s: s["y"])

    def make():
        import numpy as np

        def predict(inputs):
            middle = inputs.mean(axis=1)
            return np.stack([middle - 1.0, middle, middle + 1.0], axis=1)

        return predict

    rows = forecast.predict_external_model(
        w.select("id", "window_ts", x.alias("x")), make, "x", ENCODER
    )
    picks = [F.round(F.element_at("yhat", i + 1), 6).alias(n) for i, n in enumerate(BANDS)]
    return rows.select("id", "window_ts", *picks)


@query
def forecast_to_series(spark, sf):
    """Forecasts made in scaled units, flattened, unscaled and set next to the actual values."""
    panel = _dense_daily(spark, sf)
    state = staging.stage(scaling.fit_scaler(panel, ["y"], "id"), "scalers")
    w = windows.sliding_windows(
        scaling.scale(panel, state, ["y"], "id"), S.DAILY, WINDOW, ["y"], dense=True, block_steps=8
    )
    last = F.element_at("steps", ENCODER)["y"]
    tail = F.slice("steps", ENCODER + 1, WINDOW - ENCODER)
    steps = F.transform(
        tail,
        lambda s: F.struct(
            s["ts"].alias("ts"), (last - 1.0).alias("yhat_low"), last.alias("yhat"),
            (last + 1.0).alias("yhat_up"),
        ),
    )
    made = w.select("id", "is_first", steps.alias("steps"))
    out = evaluate.forecast_to_series(made, panel, state)
    return out.select("id", "ts", r6("y"), r6("yhat_low"), r6("yhat"), r6("yhat_up"))


@query
def band_series(spark, sf):
    flat = windows.flatten_windows(_persistence(spark, sf)).drop("y")
    panel = _dense_daily(spark, sf)
    out = evaluate.band_series(joins.actual_vs_forecast(panel, flat))
    return out.select("id", "ts", *[r6(c) for c in ("y", "yhat", "yhat_low", "yhat_up")])


def _importance(spark, sf):
    """Weights of three inputs of every window step, historical and future part apart."""
    w = _dense_windows(spark, sf)
    rows = w.select("id", "window_ts", F.posexplode("steps").alias("step", "s"))
    inputs = rows.select(
        "id",
        "window_ts",
        "step",
        F.col("s.ts").alias("ts"),
        F.when(F.col("step") < ENCODER, "historical").otherwise("future").alias("part"),
        (F.dayofmonth("s.ts") * 0.1).alias("day"),
        (TG.iso_weekday(F.col("s.ts")) * -0.3).alias("weekday"),
        (F.col("s.y") * 0.02).alias("value"),
    )
    keys = ["id", "window_ts", "step", "ts", "part"]
    return importance.feature_importance(inputs, keys, ["day", "weekday", "value"])


@query
def feature_importance(spark, sf):
    return _importance(spark, sf).select("id", "window_ts", "step", "feature", r6("weight"))


@query
def importance_table(spark, sf):
    names = ["day", "weekday", "value"]
    out = importance.importance_table(_importance(spark, sf), names)
    return out.select("part", "ts", *[r6(f"{n}_importance") for n in names])


@query
def static_importance(spark, sf):
    """Importance weights of the inputs that a window has once, for the model with a category per entity."""
    _, _, roles, design, fit = _category_fit(spark, sf)
    names = [i.name for i in roles.inputs if i.kind != "known"]
    parts = forecast.input_contributions(design, fit.model, roles)
    weights = importance.static_importance(parts, ["id", "window_ts"], names)
    return weights.select("id", "window_ts", "feature", r6("weight"))


def _plain(feature: str) -> str:
    return feature.replace("=", "_") + "_importance"


@query
def model_importance(spark, sf):
    """Importance weights of a linear model's own inputs, by forecast time."""
    design, roles, model = _stated_model(spark, sf)
    parts = forecast.contributions(design, model, roles.features)
    keys = ["id", "window_ts", "step", "ts"]
    weights = importance.feature_importance(parts, keys, roles.features)
    out = importance.importance_table(weights, roles.features, ["ts"])
    return out.select("ts", *[F.round(F.col(f"`{n}_importance`"), 6).alias(_plain(n)) for n in roles.features])


@query
def window_flow(spark, sf):
    """Events to scaled windows of both splits: windows, steps and checksum per entity."""
    parts = hourly_plan.window_flow(S.readings(spark, sf), S.HOURLY, SPLIT, 24)
    frames = []
    for part, name in zip(parts, ("training", "validation"), strict=True):
        last = F.element_at("steps", -1)["y"]
        per_id = part.groupBy("id").agg(
            F.count(F.lit(1)).alias("windows"), F.round(F.sum(last), 4).alias("last_sum")
        )
        frames.append(per_id.withColumn("split", F.lit(name)))
    return frames[0].unionByName(frames[1])


@query
def resample_stream(spark, sf):
    events = S.table(spark, sf, "events")
    stream = (
        spark.readStream.schema(events.schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf)
        .select(F.col("user_id").alias("id"), "ts", F.col("value").alias("y"))
    )
    out = streaming.run_available(streaming.resample_stream(stream, S.HOURLY))
    return out.select("id", F.col("ts").cast("timestamp_ntz").alias("ts"), r6("y"))


@query
def resample_stream_restarted(spark, sf):
    """The same stream in two runs with a stop between them; the second goes on from the checkpoint."""
    events = S.table(spark, sf, "events").select(F.col("user_id").alias("id"), "ts", F.col("value").alias("y"))
    base = staging.new_path(spark, "restarted")
    source = f"{base}/source"

    def run():
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(source)
        return streaming.run_available(streaming.resample_stream(stream, S.HOURLY), folder=base)

    early, late = splits.split_two(events, SPLIT)
    early.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(source)
    run()
    late.write.mode("append").parquet(source)
    out = run()
    return out.select("id", F.col("ts").cast("timestamp_ntz").alias("ts"), r6("y"))
