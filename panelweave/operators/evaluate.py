"""Forecast scores and chart-ready tables, computed on long forecast tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.functions.losses import pinball
from panelweave.operators.joins import actual_vs_forecast
from panelweave.operators.scaling import inverse_scale
from panelweave.operators.windows import flatten_windows


def pinball_loss(
    df: DataFrame,
    keys: Sequence[str],
    tau: float,
    y: str = "y",
    yhat: str = "yhat",
    outputs: int = 1,
    out: str = "loss",
) -> DataFrame:
    """One loss per window: sum over a step's ``outputs`` rows, mean over its steps."""
    loss = pinball(F.col(y).cast("double"), F.col(yhat).cast("double"), float(tau))
    return df.groupBy(*keys).agg((F.avg(loss) * F.lit(outputs)).alias(out))


def quantile_pinball_loss(
    df: DataFrame,
    keys: Sequence[str],
    quantiles: Mapping[str, float],
    y: str = "y",
    outputs: int = 1,
    out: str = "loss",
) -> DataFrame:
    """Mean over the quantiles of the pinball loss; ``quantiles`` maps forecast column to tau.

    All quantiles are summed row by row, so one aggregation serves them all.
    """
    target = F.col(y).cast("double")
    losses = [pinball(target, F.col(c).cast("double"), float(t)) for c, t in quantiles.items()]
    total = losses[0]
    for part in losses[1:]:
        total = total + part
    mean = total / F.lit(float(len(losses)))
    return df.groupBy(*keys).agg((F.avg(mean) * F.lit(outputs)).alias(out))


def evaluate_forecast(
    df: DataFrame,
    keys: Sequence[str],
    quantiles: Mapping[str, float],
    by: Sequence[str] = (),
    y: str = "y",
    outputs: int = 1,
) -> DataFrame:
    """Mean loss over windows, overall or per ``by`` column (a subset of the keys, or the step)."""
    windows = quantile_pinball_loss(
        df, list(dict.fromkeys([*keys, *by])), quantiles, y=y, outputs=outputs
    )
    return windows.groupBy(*by).agg(
        F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("windows")
    )


def batch_mean(df: DataFrame, loss: str, by: Sequence[str] = ("epoch",)) -> DataFrame:
    """Mean of step losses per epoch."""
    return df.groupBy(*by).agg(F.avg(loss).alias(loss))


def forecast_to_series(
    forecasts: DataFrame,
    actual: DataFrame,
    state: DataFrame | None = None,
    *,
    id: str = "id",
    target: str = "y",
    scope: str | None = "id",
    quantiles: Sequence[str] = ("yhat_low", "yhat", "yhat_up"),
) -> DataFrame:
    """Overlapping window forecasts to one forecast per (id, ts), unscaled and next to the actuals.

    ``forecasts`` has id, is_first and steps ``ARRAY<STRUCT<ts, quantile columns>>``; ``state`` is
    the scaler table the target was scaled with.
    """
    flat = flatten_windows(forecasts, id).select(id, "ts", *quantiles)
    if state is not None:
        flat = inverse_scale(flat, state, {q: target for q in quantiles}, scope)
    return actual_vs_forecast(actual, flat, id, "ts")


def band_series(
    df: DataFrame,
    by: Sequence[str] = ("id",),
    columns: Sequence[str] = ("ts", "y", "yhat", "yhat_low", "yhat_up"),
) -> DataFrame:
    return df.select(*by, *columns)
