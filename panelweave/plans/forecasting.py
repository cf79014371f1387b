"""Train, forecast beyond the data, and bring the forecasts back to original units."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.functions.timegrid import shift, slot, time_type
from panelweave.operators.forecast import NAMES, FittedQuantiles, InputRoles, design_matrix, predict_quantiles
from panelweave.operators.joins import attach
from panelweave.operators.scaling import inverse_scale
from panelweave.sources.staging import stage
from panelweave.spec import PanelSpec

Known = Callable[[DataFrame], DataFrame]


def future_windows(
    panel: DataFrame,
    spec: PanelSpec,
    encoder_steps: int,
    horizon: int,
    known: Known,
    columns: Sequence[str],
    static: Sequence[str] = (),
) -> DataFrame:
    """One window per entity that ends ``horizon`` grid steps after its last row: id, window_ts, is_first, steps.

    ``panel`` is a stored panel without gaps.  The window holds the last ``encoder_steps`` rows and ``horizon`` made ones: their
    ``static`` columns are those of the last row, ``known`` (which adds columns that follow from the time, such as
    calendar parts) is applied to both, and all other columns are null.  An entity whose last ``encoder_steps`` grid
    steps are not all there, once each, gets no window.  Null ids are an entity.  Only the rows of the encoder are grouped.
    """
    dtype = time_type(panel, spec.ts)
    named = list(dict.fromkeys([c for c in columns if c in panel.columns and c not in (spec.id, spec.ts)]))
    fixed = [c for c in static if c not in (spec.id, spec.ts)]
    last = panel.groupBy(spec.id).agg(
        F.max(spec.ts).alias("__last"), *[F.max_by(c, spec.ts).alias(f"__static_{c}") for c in fixed]
    )
    last = stage(last, "last-rows")
    rows = attach(panel, last.select(spec.id, "__last"), spec.id, "inner", null_safe=True)
    back = slot(F.col("__last"), dtype, spec) - slot(F.col(spec.ts), dtype, spec)
    kept = list(dict.fromkeys([spec.id, spec.ts, *fixed, *named]))
    encoder = rows.where(back < encoder_steps).select(*kept, (-back).cast("int").alias("__place"))
    made = last.select(
        spec.id, "__last", *[F.col(f"__static_{c}").alias(c) for c in fixed], F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("__place")
    ).withColumn(spec.ts, shift(F.col("__last"), F.col("__place"), dtype, spec)).drop("__last")
    both = known(encoder.unionByName(made, allowMissingColumns=True))
    fields = [c for c in dict.fromkeys(columns) if c not in (spec.ts,)]
    step = F.struct("__place", F.col(spec.ts).alias("ts"), *fields)
    grouped = both.groupBy(spec.id).agg(
        F.sort_array(F.collect_list(step)).alias("steps"), F.countDistinct("__place").alias("__places"), F.count(F.lit(1)).alias("__rows")
    )
    whole = encoder_steps + horizon
    grouped = grouped.where((F.col("__places") == whole) & (F.col("__rows") == whole))
    return grouped.select(spec.id, F.element_at("steps", 1)["ts"].alias("window_ts"), F.lit(False).alias("is_first"), "steps")


def forecast_beyond(
    panel: DataFrame,
    spec: PanelSpec,
    fit: FittedQuantiles,
    roles: InputRoles,
    encoder_steps: int,
    horizon: int,
    known: Known,
    scalers: DataFrame | None = None,
    names: Mapping[str, float] = NAMES,
) -> DataFrame:
    """Quantile forecasts of the ``horizon`` steps after every entity's last row: id, step, ts and the quantiles.

    ``panel`` is in the units the model was trained in; with ``scalers``, the table it was scaled with, the forecasts are
    in original units.
    """
    static = [*roles.static_real, *roles.static_categorical]
    windows = future_windows(panel, spec, encoder_steps, horizon, known, roles.columns, static)
    rows = predict_quantiles(design_matrix(windows, roles, encoder_steps), fit.model, names)
    rows = rows.select(spec.id, "step", "ts", *names)
    if scalers is None:
        return rows
    return inverse_scale(rows, scalers, {n: roles.target for n in names}, spec.id)
