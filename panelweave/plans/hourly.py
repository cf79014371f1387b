"""Event or meter readings to scaled, windowed hourly panels."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.functions.timegrid import date_parts
from panelweave.operators.resample import resample_mean
from panelweave.operators.scaling import fit_scaler, scale
from panelweave.operators.series import fill_gaps
from panelweave.operators.splits import split_two
from panelweave.operators.windows import sliding_windows
from panelweave.sources.staging import stage
from panelweave.spec import PanelSpec


def dense_panel(events: DataFrame, spec: PanelSpec) -> DataFrame:
    """Means per grid step, gaps filled with the last known value, calendar columns added.

    The means are staged, so the raw events are scanned and shuffled once.
    """
    means = stage(resample_mean(events, spec), "means")
    panel = fill_gaps(means, spec, forward=[spec.target])
    return panel.withColumns(date_parts(F.col(spec.ts)))


def window_flow(
    events: DataFrame, spec: PanelSpec, boundary: date, length: int
) -> tuple[DataFrame, DataFrame]:
    """Panel, scaling fitted on the training part only, split by time, windows of both parts.

    The panel is staged for the fit, and staged scaled: both splits and the windows read that.  Entities without a training
    row have no scaler and are left out of the second part.
    """
    panel = stage(dense_panel(events, spec), "panel")
    train, _ = split_two(panel, boundary, spec.ts)
    state = stage(fit_scaler(train, [spec.target], spec.id), "scalers")
    scaled = stage(scale(panel, state, [spec.target], spec.id, unseen="skip"), "scaled-panel")
    columns = ["month", "day", "day_of_week", "hour", spec.target]
    return tuple(
        sliding_windows(part, spec, length, columns, dense=True) for part in split_two(scaled, boundary, spec.ts)
    )
