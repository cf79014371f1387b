"""Down-sampling, gap filling on a calendar, and wide-to-long reshaping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.functions.timegrid import date_parts, slot, time_type
from panelweave.operators.series import fill_gaps
from panelweave.spec import PanelSpec


def resample_mean(df: DataFrame, spec: PanelSpec, every: str | None = None) -> DataFrame:
    """Tumbling means per entity, labelled by the left edge; empty windows are not emitted.

    Months have no fixed length: there the windows are runs of calendar months, counted from January of year 0, so that three
    months are a quarter; their edge has the type of the time column.  Rows without a time are in no window.
    Means are combined map-side, so a hot entity costs one partial row per window and task.
    """
    grid = spec.with_(step=every) if every else spec
    if grid.is_monthly:
        if df.isStreaming:
            raise ValueError("a stream closes windows of a fixed length only: resample it by days, and the days by months")
        dtype = time_type(df, spec.ts)
        timed = df.where(F.col(spec.ts).isNotNull())
        means = timed.groupBy(spec.id, slot(F.col(spec.ts), dtype, grid).cast("bigint").alias("__slot")).agg(F.avg(spec.target).alias(spec.target))
        month = F.col("__slot") * F.lit(grid.step_count)
        edge = F.make_date((F.floor(month / 12)).cast("int"), (F.pmod(month, F.lit(12)) + 1).cast("int"), F.lit(1))
        return means.select(spec.id, edge.cast(dtype).alias(spec.ts), spec.target)
    return (
        df.groupBy(F.col(spec.id), F.window(spec.ts, every or spec.step).alias("__window"))
        .agg(F.avg(spec.target).alias(spec.target))
        .select(spec.id, F.col("__window.start").alias(spec.ts), spec.target)
    )


def upsample(
    df: DataFrame, spec: PanelSpec, keys: Sequence[str] = (), made: str | None = None
) -> DataFrame:
    """A row per grid step; ``keys`` are entity-level columns repeated on the made rows."""
    return fill_gaps(df, spec, forward=keys, made=made)


def wide_to_long(
    df: DataFrame, ts: str, meters: Sequence[str] | None = None, id: str = "id", value: str = "y"
) -> DataFrame:
    """One column per entity to (id, ts, value) in a single scan; nulls are kept."""
    names = list(meters) if meters is not None else [c for c in df.columns if c != ts]
    return df.unpivot([ts], names, id, value).select(id, ts, value)


def hourly_panel(
    df: DataFrame, ts: str = "timestamp", meters: Sequence[str] | None = None
) -> DataFrame:
    """Wide meter table to the hourly panel: id, ts, date parts and the hourly mean as FLOAT."""
    spec = PanelSpec(step="1 hour")
    long = wide_to_long(df.withColumnRenamed(ts, spec.ts), spec.ts, meters)
    hourly = resample_mean(long, spec)
    parts = date_parts(F.col(spec.ts))
    small = {"year": "int"}
    columns = [
        parts[p].cast(small.get(p, "smallint")).alias(p)
        for p in ("year", "month", "day", "day_of_week", "hour")
    ]
    return hourly.select(spec.id, spec.ts, *columns, F.col(spec.target).cast("float").alias("y"))
