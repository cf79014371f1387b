"""Time arithmetic on DATE, TIMESTAMP and TIMESTAMP_NTZ columns without leaving the JVM."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.spec import PanelSpec


def time_type(df: DataFrame, name: str) -> T.DataType:
    dtype = df.schema[name].dataType
    if not isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        raise TypeError(f"{name} must be a date or timestamp column, not {dtype.simpleString()}")
    return dtype


def time_literal(value: date, dtype: T.DataType) -> Column:
    """A constant of the column's own type, so that comparisons push down and ignore time zones."""
    return F.lit(value.isoformat()).cast(dtype)


def epoch_seconds(ts: Column, dtype: T.DataType) -> Column:
    """Whole seconds since 1970-01-01 as BIGINT, monotone in ``ts``."""
    if isinstance(dtype, T.DateType):
        return F.unix_date(ts).cast("bigint") * F.lit(86400)
    if isinstance(dtype, T.TimestampType):
        return F.unix_seconds(ts)
    # TIMESTAMP_NTZ has no zone, so its own fields are the exact clock
    return (
        F.unix_date(ts.cast("date")).cast("bigint") * F.lit(86400)
        + F.hour(ts) * 3600
        + F.minute(ts) * 60
        + F.second(ts)
    )


def slot(ts: Column, dtype: T.DataType, spec: PanelSpec) -> Column:
    """Number of the grid step that holds ``ts``; neighbours on the grid differ by one."""
    if spec.is_monthly:
        months = F.year(ts).cast("bigint") * 12 + F.month(ts) - 1
        return F.floor(months / F.lit(spec.step_count))
    return F.floor(epoch_seconds(ts, dtype) / F.lit(spec.step_seconds))


def steps_until(ts: Column, later: Column, dtype: T.DataType, spec: PanelSpec) -> Column:
    """Grid steps from ``ts`` to the next observation, rounded up."""
    if spec.is_monthly:
        return slot(later, dtype, spec) - slot(ts, dtype, spec)
    if isinstance(dtype, T.DateType):
        gap = F.datediff(later, ts).cast("double") * F.lit(86400.0)
    else:
        gap = (later - ts).cast("interval second").cast("decimal(20,6)").cast("double")
    return F.ceil(gap / F.lit(float(spec.step_seconds)))


def shift(ts: Column, by: Column, dtype: T.DataType, spec: PanelSpec) -> Column:
    """``ts`` moved ``by`` grid steps; monthly grids land on month ends."""
    n = by * F.lit(spec.step_count)
    if spec.is_monthly:
        moved = F.last_day(F.add_months(F.trunc(ts.cast("date"), "month"), n.cast("int")))
        return moved.cast(dtype)
    if isinstance(dtype, T.DateType):
        if spec.step_seconds % 86400:
            raise ValueError(f"a DATE column needs a step of whole days, not {spec.step!r}")
        return F.date_add(ts, (by * F.lit(spec.step_seconds // 86400)).cast("int"))
    seconds = (by * F.lit(spec.step_seconds)).cast("decimal(18,6)")
    return ts + F.make_dt_interval(secs=seconds)


def iso_weekday(ts: Column) -> Column:
    """Monday = 1 … Sunday = 7."""
    return (F.weekday(ts) + 1).cast("int")


def date_parts(ts: Column) -> dict[str, Column]:
    return {
        "year": F.year(ts),
        "month": F.month(ts),
        "day": F.dayofmonth(ts),
        "day_of_week": iso_weekday(ts),
        "hour": F.hour(ts),
    }


def from_year(ts: Column, year: int) -> Column:
    """``year(ts) >= year`` written as a range, so that the bound reaches the Parquet scan."""
    return ts >= F.make_date(F.lit(year), F.lit(1), F.lit(1))


def parse_year_month(text: Column) -> Column:
    return F.to_date(text, "yyyy-MM")
