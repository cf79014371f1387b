"""Counts and summaries of a panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.functions.timegrid import epoch_seconds, slot, time_type
from panelweave.operators.series import PIECE, with_piece
from panelweave.spec import PanelSpec


def distinct_ids(df: DataFrame, id: str) -> DataFrame:
    return df.select(id).distinct()


def null_count(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row with the number of nulls of each column."""
    names = list(columns or df.columns)
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names])


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row per numeric column: count, nulls, mean, deviation, minimum, maximum; one pass."""
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        aggs.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count(x).alias("count"),
                F.count_if(x.isNull()).alias("null_count"),
                F.avg(x).alias("mean"),
                F.stddev_samp(x).alias("std"),
                F.min(x).alias("min"),
                F.max(x).alias("max"),
            ).alias(f"__{c}")
        )
    packed = df.agg(*aggs)
    return packed.select(F.inline(F.array(*[F.col(f"__{c}") for c in columns])))


def describe_time(df: DataFrame, ts: str) -> DataFrame:
    """One row for a time column: count, nulls, minimum, maximum, and the mean as a time, in whole seconds."""
    x, dtype = F.col(ts), time_type(df, ts)
    seconds = epoch_seconds(x, dtype)
    mean = F.floor(F.avg(seconds)).cast("bigint")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    at = F.timestamp_seconds(mean) if isinstance(dtype, T.TimestampType) else epoch + F.make_dt_interval(secs=mean)
    return df.agg(
        F.count(x).alias("count"),
        F.count_if(x.isNull()).alias("null_count"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        at.alias("mean"),
    )


def row_count(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))


def duplicate_keys(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """(id, ts) pairs that occur more than once; empty for a valid panel."""
    return row_count(df, [spec.id, spec.ts]).where("rows > 1")


def gaps(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Entities that do not have exactly one row per grid step, with rows and steps."""
    number = slot(F.col(spec.ts), time_type(df, spec.ts), spec)
    spans = df.groupBy(spec.id).agg(
        F.count(F.lit(1)).alias("rows"), (F.max(number) - F.min(number) + 1).alias("steps")
    )
    return spans.where("rows <> steps")


def bounded_spec(df: DataFrame, spec: PanelSpec, max_rows: int = 100_000) -> PanelSpec:
    """The spec with time pieces short enough that none holds more than ``max_rows`` rows.

    For series with many rows per grid step.  Each try is one count per (entity, piece).  A piece
    of a single second is not cut further.
    """
    while True:
        pieces = with_piece(df, spec).groupBy(spec.id, PIECE).agg(F.count(F.lit(1)).alias("n"))
        top = pieces.agg(F.max("n")).first()[0] or 0
        if top <= max_rows:
            return spec
        steps = spec.chunk_steps * max_rows // top
        if steps >= 1:
            spec = spec.with_(chunk_steps=int(steps))
        elif not spec.is_monthly and spec.step_seconds == 1:
            return spec
        else:
            coarse = 30 * 86400 if spec.is_monthly else spec.step_seconds
            seconds = max(1, spec.chunk_steps * coarse * max_rows // top)
            spec = spec.with_(step=f"{seconds} seconds", chunk_steps=1)


def short_series(df: DataFrame, spec: PanelSpec, length: int) -> DataFrame:
    """Entities too short for one window of ``length`` steps, with their row counts."""
    return row_count(df, [spec.id]).where(F.col("rows") < length)
