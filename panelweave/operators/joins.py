"""Joins of a fact table with dimension, series, state and calendar tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.functions.timegrid import time_literal, time_type
from panelweave.operators.series import fill_gaps, forward_fill
from panelweave.sources.staging import stage
from panelweave.spec import PanelSpec

# A side within both limits is copied to every executor.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024


def row_bytes(df: DataFrame) -> Column:
    """Rough size of a row: eight bytes per value, plus the length of text and nested values."""
    fixed = F.lit(8 * len(df.columns)).cast("bigint")
    for field in df.schema.fields:
        if not isinstance(field.dataType, (T.NumericType, T.BooleanType, T.DatetimeType)):
            text = F.col(f"`{field.name}`").cast("string")
            fixed = fixed + F.coalesce(F.octet_length(text), F.lit(0))
    return fixed


def fits_broadcast(side: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether ``side`` is within the row and byte limits; stops reading soon after the limit."""
    seen = side.select(row_bytes(side).alias("b")).limit(limit + 1)
    n, size = seen.agg(F.count(F.lit(1)), F.sum("b")).first()
    return n <= limit and (size or 0) <= BROADCAST_BYTES


def attach(
    fact: DataFrame,
    side: DataFrame,
    on: str | Sequence[str],
    how: str = "left",
    limit: int = BROADCAST_ROWS,
    fits: bool | None = None,
    null_safe: bool = False,
) -> DataFrame:
    """Equi-join of a large table with a side of unknown size; null keys match nothing unless ``null_safe``.

    ``side`` should be a stored table: its rows and bytes are counted first, unless the caller has
    done so and passes the answer as ``fits``.  Within the limits it is broadcast.  Beyond them the
    join is a shuffled one, whose large partitions adaptive execution splits on either side; no job
    runs on ``fact`` while the plan is built.  Only joins that keep or drop fact rows are offered.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"attach does not offer a {how} join")
    if fits if fits is not None else fits_broadcast(side, limit):
        side = F.broadcast(side)
    if not null_safe:
        return fact.join(side, keys, how)
    same = F.lit(True)
    for k in keys:
        side = side.withColumnRenamed(k, f"__side_{k}")
        same = same & F.col(k).eqNullSafe(F.col(f"__side_{k}"))
    joined = fact.join(side, same, how)
    return joined.drop(*[f"__side_{k}" for k in keys])


def left_join_series(fact: DataFrame, series: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Attach a time-keyed series; fact rows without a value get null."""
    return attach(fact, series, on, "left")


def inner_join_dims(fact: DataFrame, dims: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Attach dimensions one after the other; facts without a match are dropped."""
    for dim, key in dims:
        fact = attach(fact, dim, key, "inner")
    return fact


def inner_join_composite(fact: DataFrame, side: DataFrame, keys: Sequence[str]) -> DataFrame:
    return attach(fact, side, keys, "inner")


def holiday_views(
    holidays: DataFrame, date: str = "date", dedupe: bool = False
) -> list[tuple[DataFrame, list[str], str]]:
    """The national, regional and local part of a holiday calendar with their join keys."""
    parts = [
        ("National", [], "national_hol"),
        ("Regional", ["state"], "regional_hol"),
        ("Local", ["city"], "local_hol"),
    ]
    views = []
    for level, place, name in parts:
        view = holidays.where(F.col("locale") == level).select(
            date, *[F.col("locale_name").alias(p) for p in place], F.col("description").alias(name)
        )
        keys = [date, *place]
        if dedupe:
            view = view.groupBy(*keys).agg(F.min(name).alias(name))
        views.append((view, keys, name))
    return views


def holiday_join(
    fact: DataFrame, holidays: DataFrame, date: str = "date", dedupe: bool = False
) -> DataFrame:
    """Three left joins (by date, by date and state, by date and city); ``""`` where there is none.

    Two holidays on one key give two rows unless ``dedupe`` picks the smaller name.
    """
    # a view is no larger than the calendar, so one bounded count serves all three
    fits = fits_broadcast(holidays) or None
    for view, keys, name in holiday_views(holidays, date, dedupe):
        fact = attach(fact, view, keys, "left", fits=fits)
        fact = fact.withColumn(name, F.coalesce(F.col(name), F.lit("")))
    return fact


def _last_day(dated: DataFrame, date: str, until: dt.date) -> DataFrame:
    """An empty row on ``until`` for every place whose series ends earlier."""
    end = time_literal(until, time_type(dated, date))
    ends = dated.groupBy("__place").agg(F.max(date).alias("__end"))
    return ends.where(F.col("__end") < end).select("__place", end.alias(date))


def attach_filled_series(
    fact: DataFrame,
    series: DataFrame,
    *,
    date: str,
    value: str,
    since: str,
    place: str | None = None,
    until: dt.date | None = None,
    how: str = "left",
) -> DataFrame:
    """Attach a series and carry its last value forward inside each trajectory.

    Same result as joining first and forward filling the joined facts per trajectory, for
    trajectories with a row on every date the series is read for.  The fill runs on the series,
    which has one row per date (and place); a carried value counts only if it was observed on or
    after ``since``, the first date of the row's trajectory.  In a left join the series also gets
    the dates it lacks, up to ``until``.
    """
    spec = PanelSpec(id="__place", ts=date, target=value, step="1 day")
    dated = series.withColumn("__place", F.col(place) if place else F.lit(0)).withColumn(
        "__seen", F.when(F.col(value).isNotNull(), F.col(date))
    )
    kept = [value, "__seen", *([place] if place else [])]
    if how == "left":
        if until is not None:
            dated = dated.unionByName(_last_day(dated, date, until), allowMissingColumns=True)
        filled = fill_gaps(dated, spec, forward=kept)
    else:
        filled = forward_fill(dated, spec, [value, "__seen"])
    filled = stage(filled.drop("__place"), "filled-series")
    joined = attach(fact, filled, [date, place] if place else [date], how)
    return joined.withColumn(
        value, F.when(F.col("__seen") >= F.col(since), F.col(value))
    ).drop("__seen")


def cold_start_filter(frame: DataFrame, train_ids: DataFrame, id: str) -> DataFrame:
    """Rows whose entity occurs in the stored table of training ids; a null id is an entity too."""
    return attach(frame, train_ids, id, "left_semi", null_safe=True)


def actual_vs_forecast(
    actual: DataFrame, forecast: DataFrame, id: str = "id", ts: str = "ts"
) -> DataFrame:
    """Left join of forecasts on actual rows; both keyed by (id, ts), so no key is hot.  A null id is an entity too."""
    renamed = forecast.withColumnsRenamed({id: "__id", ts: "__ts"})
    same = F.col(id).eqNullSafe(F.col("__id")) & (F.col(ts) == F.col("__ts"))
    return actual.join(renamed, same, "left").select(id, ts, *[c for c in [*actual.columns, *forecast.columns] if c not in (id, ts)])
