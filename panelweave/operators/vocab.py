"""Label vocabularies: sorted distinct values with 0-based codes, kept as a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.operators.joins import BROADCAST_BYTES, BROADCAST_ROWS, attach, row_bytes
from panelweave.sources.staging import stage, stage_counted

# Distinct values that one task numbers at most.
RANGE_ROWS = 500_000
STATE_SCHEMA = "column string, value string, code int"


def _entry(df: DataFrame, name: str) -> Column:
    """A value with its sort keys: integers and floats sort as numbers, all else as text."""
    dtype = df.schema[name].dataType
    value = F.col(name)
    whole = value.cast("bigint") if isinstance(dtype, T.IntegralType) else F.lit(None).cast("bigint")
    real = (
        value.cast("double")
        if isinstance(dtype, (T.FractionalType, T.DecimalType))
        else F.lit(None).cast("double")
    )
    return F.struct(
        F.lit(name).alias("column"),
        whole.alias("whole"),
        real.alias("real"),
        value.cast("string").alias("value"),
    )


def fit_vocabulary(df: DataFrame, columns: Sequence[str], ranges: int | None = None) -> DataFrame:
    """Codes for every column from one scan, without sorting a large vocabulary in a single task.

    The distinct values are staged and counted, then range partitioned into as many parts as
    their number asks for and staged with the range number.  A code is the value's number inside
    its range plus the size of the column's earlier ranges; that size table has at most one row
    per column and range.
    """
    entries = df.select(F.inline(F.array(*[_entry(df, c) for c in columns])))
    distinct = entries.where(F.col("value").isNotNull()).distinct()
    stored, rows = stage_counted(distinct, "distinct-values")
    order = ["whole", "real", "value"]
    if (ranges or rows // RANGE_ROWS + 1) == 1:
        number = F.row_number().over(Window.partitionBy("column").orderBy(*order)) - 1
        return stored.select("column", "value", number.cast("int").alias("code"))
    ranged = stored.repartitionByRange(ranges or rows // RANGE_ROWS + 1, "column", *order)
    placed = stage(ranged.withColumn("__range", F.spark_partition_id()), "vocabulary")
    sizes = placed.groupBy("column", "__range").agg(F.count(F.lit(1)).alias("__n"))
    earlier = (
        Window.partitionBy("column").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = sizes.select(
        "column", "__range", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start")
    )
    inside = Window.partitionBy("column", "__range").orderBy(*order)
    return placed.join(F.broadcast(starts), ["column", "__range"]).select(
        "column",
        "value",
        (F.col("__start") + F.row_number().over(inside) - 1).cast("int").alias("code"),
    )


def _sizes(state: DataFrame, columns: Sequence[str]) -> dict[str, tuple[int, int]]:
    """Rows and bytes of every column's vocabulary, one small job for all of them."""
    sized = state.where(F.col("column").isin(list(columns))).groupBy("column").agg(
        F.count(F.lit(1)).alias("n"), F.sum(row_bytes(state)).alias("b")
    )
    found = {r["column"]: (r["n"], r["b"]) for r in sized.collect()}  # one row per column
    return {c: found.get(c, (0, 0)) for c in columns}


def _fits(size: tuple[int, int], limit: int = BROADCAST_ROWS) -> bool:
    return size[0] <= limit and size[1] <= BROADCAST_BYTES


def encode_labels(
    df: DataFrame,
    state: DataFrame,
    columns: Sequence[str],
    unseen: str = "error",
    limit: int = BROADCAST_ROWS,
) -> DataFrame:
    """Replace values by codes.  ``unseen`` values raise, drop the row or get the next free code.

    ``state`` is a stored vocabulary table.  Its small columns are broadcast, a column with a large
    vocabulary is joined through a shuffle that spreads hot values.  The lookups of all columns follow each other on the rows as
    they are, with one projection at the end.  A null value counts as unseen.
    """
    if unseen not in ("error", "skip", "keep"):
        raise ValueError("unseen must be 'error', 'skip' or 'keep'")
    sizes, picks, known = _sizes(state, columns), {}, F.lit(True)
    out = df.withColumns({f"__value_{c}": F.col(c).cast("string") for c in columns})
    for c in columns:
        codes = state.where(F.col("column") == c).select(F.col("value").alias(f"__value_{c}"), F.col("code").alias(f"__code_{c}"))
        out = attach(out, codes, f"__value_{c}", "left", fits=_fits(sizes[c], limit))
        code = F.col(f"__code_{c}")
        if unseen == "error":
            text = F.concat(F.lit(f"unseen value in {c}: "), F.coalesce(F.col(f"__value_{c}"), F.lit("null")))
            code = F.when(code.isNull(), F.raise_error(text)).otherwise(code)
        elif unseen == "skip":
            known = known & code.isNotNull()
        else:
            code = F.coalesce(code, F.lit(sizes[c][0]))
        picks[c] = code.cast("int").alias(c)
    # one projection for all columns
    return (out.where(known) if unseen == "skip" else out).select(*[picks.get(c, F.col(c)) for c in df.columns])


def decode_labels(
    df: DataFrame, state: DataFrame, columns: Sequence[str], types: dict[str, str] | None = None, unseen: str = "error"
) -> DataFrame:
    """Replace codes by the values they stand for, cast to ``types`` where given.

    A code the vocabulary does not have raises, or becomes null with ``unseen="null"``.
    """
    if unseen not in ("error", "null"):
        raise ValueError("unseen must be 'error' or 'null'")
    sizes, picks = _sizes(state, columns), {}
    out = df.withColumns({f"__code_{c}": F.col(c).cast("int") for c in columns})
    for c in columns:
        values = state.where(F.col("column") == c).select(F.col("code").alias(f"__code_{c}"), F.col("value").alias(f"__value_{c}"))
        out = attach(out, values, f"__code_{c}", "left", fits=_fits(sizes[c]))
        code, value = F.col(f"__code_{c}"), F.col(f"__value_{c}")
        if unseen == "error":
            text = F.concat(F.lit(f"unknown code in {c}: "), code.cast("string"))
            value = F.when(value.isNull() & code.isNotNull(), F.raise_error(text)).otherwise(value)
        picks[c] = (value.cast(types[c]) if types and c in types else value).alias(c)
    return out.select(*[picks.get(c, F.col(c)) for c in df.columns])
