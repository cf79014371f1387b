"""Splits by time, without cold-start entities in the later parts."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.functions.timegrid import time_literal, time_type
from panelweave.operators.joins import cold_start_filter
from panelweave.sources.staging import stage
from panelweave.spec import PanelSpec

Boundary = date | datetime


def _at(df: DataFrame, ts: str, boundary: Boundary, overlap: timedelta = timedelta(0)) -> Column:
    return time_literal(boundary - overlap, time_type(df, ts))


def between(df: DataFrame, ts: str, first: Boundary | None, last: Boundary | None) -> DataFrame:
    """Rows of a closed time range, open where a bound is None; bounds are pushed into the scan."""
    if first is not None:
        df = df.where(F.col(ts) >= _at(df, ts, first))
    return df if last is None else df.where(F.col(ts) <= _at(df, ts, last))


def split_two(
    df: DataFrame, boundary: Boundary, ts: str = "ts", overlap: timedelta = timedelta(0)
) -> tuple[DataFrame, DataFrame]:
    """Rows before the boundary and rows from it on; the second part may start ``overlap`` earlier."""
    return (
        df.where(F.col(ts) < _at(df, ts, boundary)),
        df.where(F.col(ts) >= _at(df, ts, boundary, overlap)),
    )


def split_three(
    df: DataFrame,
    validation: Boundary,
    test: Boundary,
    spec: PanelSpec,
    overlap: timedelta = timedelta(0),
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Training, validation and test rows; the last two only for entities seen in training.

    The training ids are staged once and serve both semi joins.
    """
    ts = F.col(spec.ts)
    train = df.where(ts < _at(df, spec.ts, validation))
    middle = df.where(
        (ts >= _at(df, spec.ts, validation, overlap)) & (ts < _at(df, spec.ts, test))
    )
    last = df.where(ts >= _at(df, spec.ts, test, overlap))
    ids = stage(train.select(spec.id).distinct(), "training-ids")
    return (
        train,
        cold_start_filter(middle, ids, spec.id),
        cold_start_filter(last, ids, spec.id),
    )


def split_label(df: DataFrame, boundary: Boundary, ts: str = "ts", out: str = "split") -> DataFrame:
    """Both sides of a split in one frame, told apart by a label; one scan instead of two."""
    before = F.col(ts) < _at(df, ts, boundary)
    return df.withColumn(out, F.when(before, "training").when(F.col(ts).isNotNull(), "validation"))
