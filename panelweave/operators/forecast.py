"""Linear multi-horizon quantile forecasts on sparse inputs: design rows, training, prediction.

A design row holds one window.  Its inputs are lists of (position, value): a category is one entry, whatever the size of its
vocabulary.  Inputs that all forecast steps share are stored once per window.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.functions.losses import QUANTILES
from panelweave.operators.quantiles import exact_quantiles
from panelweave.sources.staging import stage

#: Forecast columns of the usual three quantiles.
NAMES = dict(zip(("yhat_low", "yhat", "yhat_up"), QUANTILES, strict=True))
MODEL_SCHEMA = "step int, quantile double, position int, feature string, weight double"
PAIRS = "array<struct<position: int, value: double>>"
#: Weight tables of up to this many bytes are broadcast; wider ones are joined by position.
BROADCAST_BYTES = 8 << 20
#: A broadcast table is one array per step up to this many bytes a step, since every row carries a copy of its step's array;
#: beyond that the pairs are looked up in it one by one.
ROW_BYTES = 4 << 10
#: Copies of a wide weight table, so that a position that all windows have is no task's share.
SALTS = 16
#: Training counts inputs and targets in whole units of 1 / UNITS.
UNITS = float(1 << 24)
#: Sum of squared gradients that a weight starts with.
FIRST_SQUARE = 1e-12


@dataclass(frozen=True)
class Input:
    """``size`` positions from ``first`` on; ``kind`` says at which step ``column`` is read."""

    name: str
    column: str
    kind: str
    coded: bool
    first: int
    size: int

    def pair(self, value: Column) -> Column:
        """(position, value); an unknown category and a value that is null or NaN raise."""
        if self.coded:
            code = value.cast("int")
            bad = F.concat(F.lit(f"{self.column} has no category "), F.coalesce(value.cast("string"), F.lit("null")))
            place = F.when(code.between(0, self.size - 1), code + F.lit(self.first)).otherwise(F.raise_error(bad).cast("int"))
            return F.struct(place.alias("position"), F.lit(1.0).alias("value"))
        x, bad = value.cast("double"), F.lit(f"null or NaN among the model inputs: {self.column}")
        fine = F.when(x.isNotNull() & ~F.isnan(x), x).otherwise(F.raise_error(bad).cast("double"))
        return F.struct(F.lit(self.first).alias("position"), fine.alias("value"))

    def holds(self, position: Column) -> Column:
        return position.between(self.first, self.first + self.size - 1)


@dataclass(frozen=True)
class InputRoles:
    """Window columns by role, by name.

    Static inputs are read at the first step, known ones at the forecast step and as encoder mean,
    observed ones in the encoder only (last value and mean).  ``*_categorical`` map a column of
    codes to its number of categories.  The targets' own history is an input only with
    ``use_target_history``.  ``more_targets`` are forecast beside ``target`` from the same inputs.
    """

    target: str = "y"
    more_targets: Sequence[str] = ()
    static_real: Sequence[str] = ()
    static_categorical: Mapping[str, int] = field(default_factory=dict)
    known_real: Sequence[str] = ()
    known_categorical: Mapping[str, int] = field(default_factory=dict)
    observed: Sequence[str] = ()
    use_target_history: bool = False

    @property
    def outputs(self) -> list[str]:
        """The targets in the order of the design's steps."""
        return [self.target, *self.more_targets]

    @property
    def columns(self) -> list[str]:
        """Columns the windows must hold."""
        names = [
            *self.static_real, *self.static_categorical, *self.known_real,
            *self.known_categorical, *self.observed, *self.outputs,
        ]
        return list(dict.fromkeys(names))

    @property
    def inputs(self) -> list[Input]:
        """The model's inputs in the order of their positions."""
        out: list[Input] = []

        def add(name: str, column: str, kind: str, size: int | None = None) -> None:
            first = out[-1].first + out[-1].size if out else 0
            out.append(Input(name, column, kind, size is not None, first, 1 if size is None else size))

        add("bias", "", "bias")
        for c in self.static_real:
            add(c, c, "static")
        for c, n in self.static_categorical.items():
            add(c, c, "static", n)
        for c in self.known_real:
            add(c, c, "known")
        for c, n in self.known_categorical.items():
            add(c, c, "known", n)
        for c in self.known_real:
            add(f"{c}_encoder_mean", c, "mean")
        for c in [*self.observed, *(self.outputs if self.use_target_history else [])]:
            add(f"{c}_last", c, "last")
            add(f"{c}_mean", c, "mean")
        return out

    @property
    def width(self) -> int:
        return self.inputs[-1].first + self.inputs[-1].size

    @property
    def features(self) -> list[str]:
        """Names of the positions."""
        return [n for i in self.inputs for n in ([f"{i.name}={k}" for k in range(i.size)] if i.coded else [i.name])]

    def feature_name(self, position: Column) -> Column:
        """The name of a position, without a list of all names."""
        out = F.lit(None).cast("string")
        for i in self.inputs:
            name = F.concat(F.lit(f"{i.name}="), (position - i.first).cast("string")) if i.coded else F.lit(i.name)
            out = F.when(i.holds(position), name).otherwise(out)
        return out

    def window_inputs(self, steps: Column, encoder_steps: int) -> Column:
        """The pairs that all forecast steps share."""
        encoder = F.slice(steps, 1, encoder_steps)

        def value(i: Input) -> Column:
            if i.kind == "bias":
                return F.lit(1.0)
            if i.kind == "static":
                return F.element_at(steps, 1)[i.column]
            if i.kind == "last":
                return F.element_at(encoder, -1)[i.column]
            return F.aggregate(encoder, F.lit(0.0), lambda s, e: s + e[i.column].cast("double")) / F.lit(float(encoder_steps))

        return F.array(*[i.pair(value(i)) for i in self.inputs if i.kind != "known"]).cast(PAIRS)

    def step_inputs(self, step: Column) -> Column:
        """The pairs of the known inputs at one forecast step."""
        return F.array(*[i.pair(step[i.column]) for i in self.inputs if i.kind == "known"]).cast(PAIRS)


def design_matrix(windows: DataFrame, roles: InputRoles, encoder_steps: int) -> DataFrame:
    """Window rows to (keys, ts, shared, own, y): inputs of the window and, per forecast step, time, own inputs and target.

    With several targets the steps of the first come first, then those of the second, and so on: a step of the design and
    of a model is a (target, forecast step).  ``split_outputs`` tells them apart.  The target may be null at times that are still to come.  Any other input that is null or NaN raises, and so does
    a code without a category.
    """
    if not roles.static_real and not roles.static_categorical:
        raise ValueError("at least one static input is needed, for example the entity code")
    rest = [c for c in windows.columns if c != "steps"]
    steps = F.col("steps")
    future = F.slice(steps, encoder_steps + 1, F.size(steps) - encoder_steps)

    def target(name: str) -> Column:
        return F.transform(future, lambda s: s[name].cast("double"))

    n = len(roles.outputs)
    return windows.select(
        *rest,
        F.concat(*[F.transform(future, lambda s: s["ts"])] * n).alias("ts"),
        roles.window_inputs(steps, encoder_steps).alias("shared"),
        F.concat(*[F.transform(future, roles.step_inputs)] * n).alias("own"),
        F.concat(*map(target, roles.outputs)).alias("y"),
    )


def split_outputs(rows: DataFrame, roles: InputRoles, horizon: int) -> DataFrame:
    """``rows`` with ``output``, the target's name, and ``step`` counted from 1 for each target."""
    names = F.array(*map(F.lit, roles.outputs))
    at = F.col("step") - 1
    return rows.withColumns({"output": F.get(names, F.floor(at / horizon).cast("int")), "step": (at % horizon + 1).cast("int")})


INPUTS = ("ts", "shared", "own", "y")


def forecast_steps(design: DataFrame) -> DataFrame:
    """Design rows to one row per forecast step: keys, step (from 1), ts, pairs, y."""
    keys = [c for c in design.columns if c not in INPUTS]
    zipped = F.posexplode(F.arrays_zip("ts", "own", "y")).alias("__p", "__s")
    return design.select(*keys, "shared", zipped).select(
        *keys, (F.col("__p") + 1).alias("step"), "__s.ts", F.concat("shared", "__s.own").alias("pairs"), "__s.y"
    )


def quantile_baseline(design: DataFrame, quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """Empirical quantiles of the target per forecast step: (step, quantile, value)."""
    long = design.select(F.posexplode("y").alias("__p", "y")).select(
        (F.col("__p") + 1).alias("step"), "y"
    )
    return exact_quantiles(long, ["step"], "y", quantiles)


def _by_position(model: DataFrame, quantiles: Sequence[float]) -> DataFrame:
    """(step, position, w): one array of weights in the order of ``quantiles``; a missing one is zero."""
    picks = [F.coalesce(F.max(F.when(F.col("quantile") == q, F.col("weight"))), F.lit(0.0)) for q in quantiles]
    return model.groupBy("step", "position").agg(F.array(*picks).alias("w"))


def _kind(horizon: int, width: int, quantiles: int, broadcast_bytes: int) -> str:
    """How ``_weighted`` finds the weights: in an ``array`` per step, by ``lookup`` in a broadcast table, or by a shuffled ``join``."""
    if 8 * horizon * width * quantiles > broadcast_bytes:
        return "join"
    return "array" if 8 * width * quantiles <= ROW_BYTES else "lookup"


def _longest() -> Column:
    """The greatest number of pairs of a forecast step, over all design rows."""
    own = F.coalesce(F.array_max(F.transform("own", F.size)), F.lit(0))
    return F.max(F.size("shared") + own).alias("pairs")


def _weighted(
    steps: DataFrame, keys: Sequence[str], weights: DataFrame, quantiles: int, width: int, kind: str, longest: int | None = None
) -> DataFrame:
    """``steps`` with ``parts``: every pair with its weights, (position, value, w), in the order of positions.

    ``array``: the table is broadcast as one array of all positions per step.  ``lookup``: it is broadcast with a row per
    (step, position) and joined for the first, second, ... of the ``longest`` pairs, so a row carries its own weights only.
    ``join``: it is joined by (step, position), in salted copies, and the pairs are put together again; ``keys`` must then
    identify a row of a stored table.
    """
    none = F.array(*[F.lit(0.0)] * quantiles)
    if kind == "lookup":
        table = F.broadcast(weights.select(F.col("step").alias("__step"), F.col("position").alias("__position"), F.col("w").alias("__found")))
        joined, found = steps, [f"__w{i}" for i in range(longest or 0)]
        for i, name in enumerate(found):
            same = (F.col("step") == F.col("__step")) & (F.get("pairs", F.lit(i))["position"] == F.col("__position"))
            joined = joined.join(table, same, "left").drop("__step", "__position").withColumnRenamed("__found", name)
        own = F.array(*[F.coalesce(name, none) for name in found])
        part = lambda p, i: F.struct(p["position"], p["value"], F.get(own, i).alias("w"))
        return joined.withColumn("parts", F.array_sort(F.transform("pairs", part))).drop(*found)
    if kind == "array":
        every = weights.select("step").distinct().select("step", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("position"))
        filled = every.join(weights.select("step", "position", "w"), ["step", "position"], "left").withColumn("w", F.coalesce("w", none))
        dense = filled.groupBy("step").agg(F.sort_array(F.collect_list(F.struct("position", "w"))).alias("__w"))
        dense = dense.select("step", F.col("__w.w").alias("__w"))
        joined = steps.join(F.broadcast(dense), "step", "left")  # width x quantiles numbers a row, within the limit
        part = lambda p: F.struct(p["position"], p["value"], F.coalesce(F.get("__w", p["position"]), none).alias("w"))
        return joined.withColumn("parts", F.transform(F.array_sort("pairs"), part)).drop("__w")
    salt = F.pmod(F.xxhash64(*keys), F.lit(SALTS))
    pairs = steps.select(*keys, "step", F.explode("pairs").alias("__p")).select(*keys, "step", "__p.*", salt.alias("__salt"))
    copies = weights.select("step", "position", "w", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("__salt"))
    joined = pairs.join(copies, ["step", "position", "__salt"], "left")
    part = F.struct("position", "value", F.coalesce("w", none).alias("w"))
    parts = joined.groupBy(*keys, "step").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    return steps.join(parts, [*keys, "step"])


def _units(x: Column) -> Column:
    return F.floor(x * F.lit(UNITS) + F.lit(0.5))


@dataclass(frozen=True)
class FittedQuantiles:
    """``model`` is a stored weight table, ``history`` the loss per epoch."""

    model: DataFrame
    history: DataFrame


# Positions of the sums that are no gradients: losses of training and of held-out rows.
_LOSS = {False: (-1, -2), True: (-3, -4)}


def _training_rows(train: DataFrame, held_out: DataFrame | None) -> tuple[DataFrame, int]:
    """(row, held_out, ts, shared, own, y) in whole units, stored, and the greatest number of pairs of a step."""
    both = train.select(*INPUTS, F.lit(False).alias("held_out"))
    if held_out is not None:
        both = both.unionByName(held_out.select(*INPUTS, F.lit(True).alias("held_out")))

    def whole(pairs: Column) -> Column:
        return F.transform(pairs, lambda p: F.struct(p["position"].alias("position"), _units(p["value"]).alias("value")))

    bad = F.raise_error(F.lit("null or NaN among the targets")).cast("bigint")
    y = F.transform("y", lambda v: F.when(v.isNotNull() & ~F.isnan(v), _units(v)).otherwise(bad))
    rows = both.select(
        F.monotonically_increasing_id().alias("row"), "held_out", "ts", whole(F.col("shared")).alias("shared"),
        F.transform("own", whole).alias("own"), y.alias("y"),
    )
    seen = Observation()
    stored = stage(rows.observe(seen, _longest()), "training-rows")
    return stored, seen.get.get("pairs") or 0


def _epoch_sums(steps: DataFrame, weights: DataFrame, quantiles: int, width: int, kind: str, longest: int) -> DataFrame:
    """(step, position, a, s) with whole sums over all rows, whatever their partitions.

    ``a`` adds up a position's values, ``s`` those of the rows whose forecast is above the target, per quantile; the
    subgradient of the pinball loss is s - tau a.  Positions below zero hold counts and errors of the losses.
    """
    rows = _weighted(steps, ["row"], weights, quantiles, width, kind, longest)
    zero = F.lit(0).cast("bigint")

    def forecast(q: int) -> Column:
        return F.aggregate("parts", zero, lambda t, p: t + F.floor(F.get(p["w"], F.lit(q)) * p["value"] + F.lit(0.5)))

    rows = rows.withColumn("e", F.array(*[F.col("y") - forecast(q) for q in range(quantiles)]))

    def entry(position: Column, a: Column, s: Column) -> Column:
        return F.struct(position.cast("int").alias("position"), a.cast("bigint").alias("a"), s.alias("s"))

    def losses(held: bool) -> Column:
        below, error = _LOSS[held]
        over = F.transform("e", lambda x: F.greatest(-x, zero))
        return F.array(entry(F.lit(below), F.lit(1), over), entry(F.lit(error), F.lit(0), F.col("e")))

    gradient = F.transform("parts", lambda p: entry(p["position"], p["value"], F.transform("e", lambda x: F.when(x < 0, p["value"]).otherwise(zero))))
    entries = F.when(F.col("held_out"), losses(True)).otherwise(F.concat(gradient, losses(False)))
    long = rows.select("step", F.explode(entries).alias("g")).select("step", "g.*")
    picks = [F.sum(F.get("s", F.lit(q))).alias(f"s{q}") for q in range(quantiles)]
    sums = long.groupBy("step", "position").agg(F.sum("a").alias("a"), *picks)
    return sums.select("step", "position", "a", F.array(*[f"s{q}" for q in range(quantiles)]).alias("s"))


def fit_quantile_model(
    train: DataFrame,
    roles: InputRoles,
    *,
    held_out: DataFrame | None = None,
    quantiles: Sequence[float] = QUANTILES,
    epochs: int = 20,
    learning_rate: float = 0.1,
    min_delta: float = 0.1,
    patience: int = 0,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> FittedQuantiles:
    """A linear model per (step, quantile) that minimises the quantile pinball loss.

    ``train`` and ``held_out`` are design tables.  Inputs and targets are taken in units of 2**-24, so forecasts, losses and
    subgradients are sums of whole numbers: the same rows give the same weights however they are partitioned.  An epoch is
    one aggregation over all rows by (step, position); the step of a weight shrinks with the sum of its squared gradients.
    Weights and gradients stay tables, only the losses per forecast step reach the driver.  The same pass scores the
    incoming weights on training and held-out rows; the best scored weights are returned, and the start is the quantile
    baseline of the training rows, so the held-out (or training) loss is never above that of the start.  Training stops once it has
    not fallen by ``min_delta`` for more than ``patience`` epochs.
    """
    spark = train.sparkSession
    taus, n_taus, width = [float(q) for q in quantiles], len(quantiles), roles.width
    data, longest = _training_rows(train, held_out)
    own = data.where(~F.col("held_out")).select(F.transform("y", lambda v: v / F.lit(UNITS)).alias("y"))
    start = quantile_baseline(own, taus).select("step", "quantile", (_units(F.col("value")) / F.lit(UNITS)).alias("weight"))
    bias = _by_position(start.withColumn("position", F.lit(0)), taus)
    weights = stage(bias.withColumn("seen", F.array(*[F.lit(FIRST_SQUARE)] * n_taus)), "weights")
    horizon = weights.agg(F.max("step")).first()[0]
    if not horizon:
        raise ValueError("no training windows")
    kind = _kind(horizon, width, n_taus, broadcast_bytes)
    steps = forecast_steps(data)

    best, best_loss, reference, waited, history = weights, float("inf"), float("inf"), 0, []
    for epoch in range(epochs + 1):
        sums = stage(_epoch_sums(steps, weights, n_taus, width, kind, longest), "gradients")
        scored = sums.where("position < 0").groupBy("position").agg(
            F.sum("a").alias("a"), F.array(*[F.sum(F.get("s", F.lit(q))) for q in range(n_taus)]).alias("s")
        )
        total = {r["position"]: (r["a"], r["s"]) for r in scored.collect()}  # four rows

        def loss(held: bool) -> float | None:
            below, error = _LOSS[held]
            if below not in total:
                return None
            n, over = total[below]
            return sum(tau * e + o for tau, o, e in zip(taus, over, total[error][1], strict=True)) / UNITS / (n * n_taus)

        train_loss, held_loss = loss(False), loss(True)
        score = train_loss if held_loss is None else held_loss
        history.append((epoch, train_loss, held_loss))
        if score < best_loss:
            best, best_loss = weights, score
        if reference - score > min_delta:
            reference, waited = score, 0
        else:
            waited += 1
        if epoch == epochs or waited > patience:
            break
        rows = total[_LOSS[False][0]][0] // horizon
        weights = stage(_stepped(weights, sums, taus, UNITS * rows, learning_rate), "weights")

    cell = F.inline(F.array(*[F.struct(F.lit(t).alias("quantile"), F.get("w", F.lit(q)).alias("weight")) for q, t in enumerate(taus)]))
    model = best.select("step", "position", cell)
    model = model.select("step", "quantile", "position", roles.feature_name(F.col("position")).alias("feature"), "weight")
    return FittedQuantiles(stage(model, "quantile-model"), spark.createDataFrame(history, "epoch int, train_loss double, held_out_loss double"))


def _stepped(weights: DataFrame, sums: DataFrame, taus: Sequence[float], scale: float, rate: float) -> DataFrame:
    """The weights after one step against the gradients; a position without a weight starts at zero."""
    grads = sums.where("position >= 0")
    joined = weights.join(grads, ["step", "position"], "full")
    w, seen = [], []
    for q, tau in enumerate(taus):
        at = F.lit(q)
        grad = F.coalesce((F.get("s", at).cast("double") - F.lit(tau) * F.col("a").cast("double")) / F.lit(scale), F.lit(0.0))
        square = F.coalesce(F.get("seen", at), F.lit(FIRST_SQUARE)) + grad * grad
        seen.append(square)
        w.append(F.coalesce(F.get("w", at), F.lit(0.0)) - F.lit(rate) * grad / F.sqrt(square))
    return joined.select("step", "position", F.array(*w).alias("w"), F.array(*seen).alias("seen"))


def _with_parts(design: DataFrame, model: DataFrame, quantiles: Sequence[float], broadcast_bytes: int) -> DataFrame:
    """Forecast steps with their weighted pairs."""
    weights = _by_position(model, quantiles)
    steps, last = model.agg(F.countDistinct("step"), F.max("position")).first()
    width = (last or 0) + 1
    kind, longest = _kind(steps, width, len(quantiles), broadcast_bytes), 0
    if kind != "array":
        seen = Observation()
        design = stage(design.withColumn("__row", F.monotonically_increasing_id()).observe(seen, _longest()), "design")
        longest = seen.get.get("pairs") or 0
    return _weighted(forecast_steps(design), ["__row"] if kind == "join" else [], weights, len(quantiles), width, kind, longest)


def predict_quantiles(
    design: DataFrame,
    model: DataFrame,
    names: Mapping[str, float] = NAMES,
    sort_quantiles: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Forecasts per (window, step), one column per quantile; dot products in the JVM.

    ``names`` maps a column to its quantile and must name exactly the quantiles of the model.

    The weight table is broadcast within ``broadcast_bytes`` and joined by position beyond; all ways add up in the order of the
    positions and give the same numbers.  Quantiles may cross unless ``sort_quantiles`` is set.
    """
    held = sorted(r[0] for r in model.select("quantile").distinct().collect())
    ordered = sorted(names, key=lambda n: names[n])
    if held != [float(names[n]) for n in ordered]:
        raise ValueError(f"the model has the quantiles {held}, the names stand for {dict(names)}")
    rows = _with_parts(design, model, held, broadcast_bytes)

    def dot(q: int) -> Column:
        return F.aggregate("parts", F.lit(0.0), lambda t, p: t + F.get(p["w"], F.lit(q)) * p["value"])

    yhat = F.array(*map(dot, range(len(held))))
    yhat = F.array_sort(yhat) if sort_quantiles else yhat
    keys = [c for c in design.columns if c not in INPUTS]
    out = rows.select(*keys, "ts", "step", "y", yhat.alias("__yhat"))
    picks = [F.element_at("__yhat", i + 1).alias(n) for i, n in enumerate(ordered)]
    return out.select(*keys, "ts", "step", "y", *picks)


def contributions(
    design: DataFrame, model: DataFrame, features: Sequence[str], quantile: float = 0.5
) -> DataFrame:
    """Absolute contribution of every position to one quantile's forecast, one column per position.

    For models with few positions; ``input_contributions`` has one column per input.
    """
    return _contributions(design, model, {f: F.lit(i).eqNullSafe for i, f in enumerate(features)}, quantile)


def input_contributions(design: DataFrame, model: DataFrame, roles: InputRoles, quantile: float = 0.5) -> DataFrame:
    """Absolute contribution of every input to one quantile's forecast, one column per input, categories as one."""
    return _contributions(design, model, {i.name: i.holds for i in roles.inputs}, quantile)


def _contributions(design: DataFrame, model: DataFrame, named: Mapping[str, Callable], quantile: float) -> DataFrame:
    one = model.where(F.col("quantile") == F.lit(float(quantile)))
    rows = _with_parts(design, one, [float(quantile)], BROADCAST_BYTES)
    keys = [c for c in design.columns if c not in INPUTS]

    def total(mine: Callable) -> Column:
        parts = F.filter("parts", lambda p: mine(p["position"]))
        return F.aggregate(parts, F.lit(0.0), lambda t, p: t + F.abs(p["value"] * F.get(p["w"], F.lit(0))))

    return rows.select(*keys, "step", "ts", *[total(mine).alias(n) for n, mine in named.items()])


def predict_external_model(
    rows: DataFrame,
    make_predict_fn: Callable,
    inputs: str = "x",
    width: int | None = None,
    batch_size: int = 1024,
    out: str = "yhat",
) -> DataFrame:
    """Score windows with a user's model: ``make_predict_fn`` loads it once per worker.

    ``inputs`` is an ``ARRAY<DOUBLE>`` column of fixed ``width``; the model returns one array per
    row (for example horizon x quantiles values).
    """
    from pyspark.ml.functions import predict_batch_udf

    predict = predict_batch_udf(
        make_predict_fn,
        return_type=T.ArrayType(T.DoubleType()),
        batch_size=batch_size,
        input_tensor_shapes=[[width]] if width else None,
    )
    return rows.withColumn(out, predict(inputs))
