"""Losses, training, prediction and importance."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from panelweave.operators import evaluate, forecast, importance, scaling, windows
from panelweave.plans import forecasting
from panelweave.sources.staging import stage
from panelweave.spec import PanelSpec

BANDS = {"yhat_low": 0.1, "yhat": 0.5, "yhat_up": 0.9}


def perfect(spark, n=8):
    return spark.range(n).select(
        F.col("id").alias("w"), F.explode(F.array(F.lit(0), F.lit(1))).alias("step"),
        F.lit(1.0).alias("y"), *[F.lit(1.0).alias(c) for c in BANDS],
    )


def test_perfect_forecasts_have_no_loss(spark):
    one = evaluate.pinball_loss(perfect(spark), ["w"], 0.5).collect()
    many = evaluate.quantile_pinball_loss(perfect(spark), ["w"], BANDS).collect()
    assert [r["loss"] for r in one] == [0.0] * 8
    assert [r["loss"] for r in many] == [0.0] * 8


def test_loss_by_hand(spark):
    df = spark.createDataFrame([(1, 0, 3.0, 1.0), (1, 1, 0.0, 1.0)], "w int, step int, y double, yhat double")
    (r,) = evaluate.pinball_loss(df, ["w"], 0.9).collect()
    assert r["loss"] == pytest.approx((0.9 * 2 + 0.1 * 1) / 2)
    two = df.unionByName(df)  # two outputs per step are summed, steps averaged
    (r2,) = evaluate.pinball_loss(two, ["w"], 0.9, outputs=2).collect()
    assert r2["loss"] == pytest.approx(2 * r["loss"])


def test_importance_sums_to_one(spark):
    df = spark.createDataFrame([(1, 800.0, -2.0, 0.0), (2, 1.0, 1.0, 1.0)], "k int, a double, b double, c double")
    w = importance.feature_importance(df, ["k"], ["a", "b", "c"])
    sums = {r["k"]: r["s"] for r in w.groupBy("k").agg(F.sum("weight").alias("s")).collect()}
    assert sums == {1: pytest.approx(1.0), 2: pytest.approx(1.0)}
    assert {r["feature"]: r["weight"] for r in w.where("k = 2").collect()} == {
        "a": pytest.approx(1 / 3), "b": pytest.approx(1 / 3), "c": pytest.approx(1 / 3),
    }


def signal(spark, entities=30, days=40):
    """y depends on a known input and on its own past, so a fitted model must beat quantiles."""
    n = F.col("n")
    return spark.range(entities).select(
        F.col("id"), F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("n")
    ).select(
        "id",
        F.date_add(F.lit(date(2024, 1, 1)), n).alias("ts"),
        (F.col("id") / 30.0).alias("size"),
        F.sin(n * 0.9 + F.col("id")).alias("known"),
        (n % 3).alias("phase"),
        (F.col("id") / 15.0 + 2.0 * F.sin(n * 0.9 + F.col("id")) + (n % 3) * 0.5
         + (F.pmod(F.xxhash64("id", n), F.lit(100)) - 50) / 500.0).alias("y"),
    )


ROLES = forecast.InputRoles(
    static_real=("size",), known_real=("known",), known_categorical={"phase": 3}, use_target_history=True
)


@pytest.fixture(scope="module")
def design(spark):
    w = windows.sliding_windows(signal(spark), PanelSpec(step="1 day"), 8, ROLES.columns, dense=True)
    return forecast.design_matrix(w, ROLES, 6)


def test_design_names_match_the_positions(design):
    row = design.first()
    assert len(row["own"]) == len(row["y"]) == len(row["ts"]) == 2
    used = [p["position"] for p in row["shared"]] + [p["position"] for p in row["own"][0]]
    assert len(set(used)) == len(used) == len(ROLES.inputs) and max(used) < ROLES.width == len(ROLES.features)
    names = [i.name for i in ROLES.inputs]
    assert names == ["bias", "size", "known", "phase", "known_encoder_mean", "y_last", "y_mean"]
    named = design.sparkSession.range(ROLES.width).select(ROLES.feature_name(F.col("id").cast("int"))).collect()
    assert [r[0] for r in named] == ROLES.features
    with pytest.raises(ValueError, match="static"):
        forecast.design_matrix(design, forecast.InputRoles(), 2)


def test_design_does_not_grow_with_the_vocabulary(spark):
    panel = signal(spark, 10, 20).withColumn("code", F.col("id").cast("int"))
    w = windows.sliding_windows(panel, PanelSpec(step="1 day"), 8, ["code", "y"], dense=True)
    rows = []
    for size in (10, 1_000_000):
        roles = forecast.InputRoles(static_categorical={"code": size}, use_target_history=True)
        rows.append(forecast.design_matrix(w, roles, 6).select(F.size("shared"), F.size(F.flatten("own"))).distinct().collect())
    assert rows[0] == rows[1] and len(rows[0]) == 1


def test_codes_without_a_category_raise(spark):
    panel = signal(spark, 3, 10).withColumn("code", F.col("id").cast("int"))
    w = windows.sliding_windows(panel, PanelSpec(step="1 day"), 8, ["code", "y"], dense=True)
    with pytest.raises(Exception, match="no category"):
        forecast.design_matrix(w, forecast.InputRoles(static_categorical={"code": 2}), 6).collect()


@pytest.fixture(scope="module")
def fitted(design):
    return forecast.fit_quantile_model(design, ROLES, epochs=25, learning_rate=0.3, min_delta=0.0, patience=25)


def test_training_beats_the_baseline(fitted):
    losses = [r["train_loss"] for r in fitted.history.orderBy("epoch").collect()]
    assert len(losses) == 26
    assert min(losses) < 0.6 * losses[0]


def weights(fit):
    return sorted((r["step"], r["quantile"], r["position"], r["feature"], r["weight"]) for r in fit.model.collect())


def test_weights_do_not_follow_the_partitions(design):
    """Whole sums: the same bits from 1, 8 and 64 partitions, and with a weight table that is joined, not broadcast."""
    fit = lambda df, **more: forecast.fit_quantile_model(df, ROLES, epochs=3, min_delta=0.0, patience=9, **more)
    one = fit(design.repartition(1))
    wide = fit(design, broadcast_bytes=0)
    for other in (fit(design.repartition(8)), fit(design.repartition(64)), wide):
        assert weights(other) == weights(one)
        assert other.history.collect() == one.history.collect()


def test_wide_models_predict_alike(design, fitted):
    narrow = forecast.predict_quantiles(design, fitted.model)
    wide = forecast.predict_quantiles(design, fitted.model, broadcast_bytes=0)
    assert sorted(map(tuple, narrow.collect())) == sorted(map(tuple, wide.select(*narrow.columns).collect()))


def test_weights_are_looked_up_without_an_array_in_every_row(spark, design, fitted, monkeypatch):
    """A broadcast table with a category for every entity: same bits, and no row carries the weights of all positions."""
    steps, weights_of = forecast.forecast_steps(design), forecast._by_position(fitted.model, forecast.QUANTILES)
    assert forecast._kind(2, ROLES.width, 3, forecast.BROADCAST_BYTES) == "array"
    assert forecast._kind(2, 90_000, 3, forecast.BROADCAST_BYTES) == "lookup"
    assert forecast._kind(2, 900_000, 3, forecast.BROADCAST_BYTES) == "join"
    array = forecast._weighted(steps, [], weights_of, 3, ROLES.width, "array")
    lookup = forecast._weighted(steps, [], weights_of, 3, ROLES.width, "lookup", len(ROLES.inputs))
    assert sorted(map(str, array.collect())) == sorted(map(str, lookup.select(*array.columns).collect()))
    listed = ["collect_list(struct(position" in df._jdf.queryExecution().optimizedPlan().toString() for df in (array, lookup)]
    assert listed == [True, False]

    fit = lambda: forecast.fit_quantile_model(design, ROLES, epochs=3, min_delta=0.0, patience=9)
    predict = lambda: sorted(map(str, forecast.predict_quantiles(design, fitted.model).collect()))
    one, rows = fit(), predict()
    monkeypatch.setattr(forecast, "ROW_BYTES", 0)
    other = fit()
    assert weights(other) == weights(one) and other.history.collect() == one.history.collect()
    assert predict() == rows


def test_predictions_score_what_training_saw(design, fitted):
    rows = forecast.predict_quantiles(design, fitted.model)
    score = evaluate.evaluate_forecast(rows, ["id", "window_ts"], BANDS).first()["loss"]
    best = fitted.history.agg(F.min("train_loss")).first()[0]
    assert score == pytest.approx(best, rel=1e-4)
    sorted_rows = forecast.predict_quantiles(design, fitted.model, sort_quantiles=True)
    assert sorted_rows.where("yhat_low > yhat or yhat > yhat_up").isEmpty()
    cover = rows.agg(
        F.avg((F.col("y") <= F.col("yhat_up")).cast("double")),
        F.avg((F.col("y") <= F.col("yhat_low")).cast("double")),
    ).first()
    assert cover[0] > 0.7 and cover[1] < 0.3


def test_early_stop(design):
    out = forecast.fit_quantile_model(design, ROLES, epochs=30, min_delta=10.0)
    # the first score always counts as progress, the second does not
    assert out.history.count() == 2


def test_held_out_rows_do_not_train(spark, design):
    train, held = design.where("id < 20"), design.where("id >= 20")
    out = forecast.fit_quantile_model(train, ROLES, held_out=held, epochs=3, min_delta=0.0, patience=9)
    first = out.history.where("epoch = 0").first()
    base = forecast.quantile_baseline(train).groupBy("step").agg(
        *[F.max(F.when(F.col("quantile") == q, F.col("value"))).alias(n) for n, q in BANDS.items()]
    )
    rows = forecast.forecast_steps(held).join(F.broadcast(base), "step")
    want = evaluate.evaluate_forecast(rows, ["id", "window_ts"], BANDS).first()["loss"]
    assert first["held_out_loss"] == pytest.approx(want, rel=1e-4)
    alone = forecast.fit_quantile_model(train, ROLES, epochs=3, min_delta=0.0, patience=9)
    assert [r["train_loss"] for r in alone.history.orderBy("epoch").collect()] == [r["train_loss"] for r in out.history.orderBy("epoch").collect()]


def test_missing_inputs_are_refused(spark, design):
    broken = design.withColumn("y", F.transform("y", lambda v: F.when(v > 0, v)))
    with pytest.raises(Exception, match="null or NaN"):
        forecast.fit_quantile_model(broken, ROLES, epochs=1)
    panel = signal(spark, 3, 10).withColumn("known", F.nullif(F.col("phase"), F.lit(2)).cast("double"))
    w = windows.sliding_windows(panel, PanelSpec(step="1 day"), 8, ROLES.columns, dense=True)
    with pytest.raises(Exception, match="null or NaN"):
        forecast.design_matrix(w, ROLES, 6).collect()
    with pytest.raises(ValueError, match="no training windows"):
        forecast.fit_quantile_model(design.limit(0), ROLES)


def test_inputs_share_the_importance(spark, design, fitted):
    parts = forecast.input_contributions(design, fitted.model, ROLES)
    flat = forecast.contributions(design, fitted.model, ROLES.features)
    phases = sum(F.col(f"`phase={i}`") for i in range(3))
    one = {(r["id"], r["window_ts"], r["step"]): r["phase"] for r in parts.collect()}
    two = {(r["id"], r["window_ts"], r["step"]): r["p"] for r in flat.select("id", "window_ts", "step", phases.alias("p")).collect()}
    assert one == pytest.approx(two)
    static = importance.static_importance(parts, ["id", "window_ts"], ["size", "y_last", "y_mean"])
    sums = static.groupBy("id", "window_ts").agg(F.sum("weight").alias("s"), F.count("*").alias("n")).collect()
    assert len(sums) == design.count() and all(r["s"] == pytest.approx(1.0) and r["n"] == 3 for r in sums)


# ---- several targets ---------------------------------------------------------------------------


def test_two_targets_are_two_models_on_shared_inputs(spark):
    panel = signal(spark, 12, 20).withColumn("z", 3 - F.col("y"))
    roles = forecast.InputRoles(more_targets=("z",), static_real=("size",), observed=("y",))
    w = windows.sliding_windows(panel, PanelSpec(step="1 day"), 8, roles.columns, dense=True)
    design = forecast.design_matrix(w, roles, 6)
    assert design.select(F.size("y"), F.size("ts"), F.size("own")).distinct().collect() == [(4, 4, 4)]
    fit = forecast.fit_quantile_model(design, roles, epochs=2, learning_rate=0.05, min_delta=0.0, patience=9)
    out = forecast.split_outputs(forecast.predict_quantiles(design, fit.model), roles, 2)
    both = {}
    for name in ("y", "z"):
        alone = forecast.InputRoles(target=name, static_real=("size",), observed=("y",))
        d = forecast.design_matrix(w, alone, 6)
        one = forecast.fit_quantile_model(d, alone, epochs=2, learning_rate=0.05, min_delta=0.0, patience=9)
        both[name] = {(r["id"], r["window_ts"], r["step"]): r["yhat"] for r in forecast.predict_quantiles(d, one.model).collect()}
    for r in out.collect():
        assert r["yhat"] == pytest.approx(both[r["output"]][r["id"], r["window_ts"], r["step"]])
    losses = evaluate.quantile_pinball_loss(out, ["id", "window_ts"], BANDS, outputs=2).agg(F.avg("loss")).first()[0]
    apart = [evaluate.quantile_pinball_loss(out.where(F.col("output") == n), ["id", "window_ts"], BANDS).agg(F.avg("loss")).first()[0] for n in ("y", "z")]
    assert losses == pytest.approx(sum(apart))


# ---- beyond the data ---------------------------------------------------------------------------


def test_future_windows(spark):
    d = date(2024, 3, 1)
    rows = [(i, d + timedelta(k), float(10 * (i or 0) + k), i) for i in (1, 2, None) for k in range(6)]
    rows += [(3, d, 1.0, 3), (4, d, 1.0, 4), (4, d + timedelta(2), 1.0, 4), (4, d + timedelta(3), 1.0, 4)]  # too short; with a gap
    panel = spark.createDataFrame(rows, "id int, ts date, y double, code int")
    known = lambda df: df.withColumn("day", F.dayofmonth("ts"))
    out = forecasting.future_windows(panel, PanelSpec(step="1 day"), 3, 2, known, ["code", "day", "y"], ["code"])
    got = {r["id"]: r for r in out.collect()}
    assert set(got) == {1, 2, None}
    for i in (1, 2, None):
        steps = got[i]["steps"]
        assert [s["ts"] for s in steps] == [d + timedelta(k) for k in range(3, 8)] and got[i]["window_ts"] == d + timedelta(3)
        assert [s["y"] for s in steps] == [10.0 * (i or 0) + 3, 10.0 * (i or 0) + 4, 10.0 * (i or 0) + 5, None, None]
        assert [s["code"] for s in steps] == [i] * 5 and [s["day"] for s in steps] == [4, 5, 6, 7, 8]


def test_future_windows_on_a_monthly_grid(spark):
    panel = spark.createDataFrame([("a", date(2024, m, 28), float(m)) for m in range(1, 13)], "id string, ts date, y double")
    panel = panel.withColumn("ts", F.last_day("ts"))
    out = forecasting.future_windows(panel, PanelSpec(step="1 month"), 9, 3, lambda df: df, ["y"]).first()
    assert [s["ts"] for s in out["steps"]][-3:] == [date(2025, 1, 31), date(2025, 2, 28), date(2025, 3, 31)]


def test_forecasts_beyond_the_data_use_the_model(spark):
    panel = signal(spark, 8, 30)
    spec = PanelSpec(step="1 day")
    roles = forecast.InputRoles(static_real=("size",), use_target_history=True)
    scalers = scaling.fit_scaler(panel, ["y"], "id")
    scaled = stage(scaling.scale(panel, stage(scalers, "s"), ["y"], "id"), "p")
    design = forecast.design_matrix(windows.sliding_windows(scaled, spec, 8, roles.columns, dense=True), roles, 6)
    fit = forecast.fit_quantile_model(design, roles, epochs=2, min_delta=0.0, patience=5)
    out = forecasting.forecast_beyond(scaled, spec, fit, roles, 6, 2, lambda df: df, scalers)
    assert out.count() == 16 and out.agg(F.min("ts"), F.max("ts")).first() == (date(2024, 1, 31), date(2024, 2, 1))
    # by hand, for one entity
    last = [r["y"] for r in scaled.where("id = 3").orderBy(F.desc("ts")).limit(6).collect()]
    state = scalers.where("scope_key = '3'").first()
    w = {(r["step"], r["feature"]): r["weight"] for r in fit.model.where("quantile = 0.5").collect()}
    for r in out.where("id = 3").collect():
        s = r["step"]
        z = w[s, "bias"] + w[s, "size"] * 0.1 + w[s, "y_last"] * last[0] + w[s, "y_mean"] * sum(last) / 6
        assert r["yhat"] == pytest.approx(z * state["scale"] + state["mean"])
