"""Seeded shuffles and consecutive batches of windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.operators.joins import attach
from panelweave.sources.staging import stage

# Rows that one task numbers, on average.
GROUP_ROWS = 100_000
# Bits of the order key.
BITS = 60


def seeded_hash(keys: Sequence[str], seed: int) -> Column:
    """The first 60 bits of the MD5 of the keys' text and the seed, as a whole number; nulls have a text of their own."""
    texts = [F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys]
    digest = F.md5(F.concat_ws("\x1f", *texts, F.lit(str(seed))).cast("binary"))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("bigint")


def shuffle_rows(df: DataFrame, keys: Sequence[str], seed: int) -> DataFrame:
    """A permutation that depends on keys and seed only, not on the partitioning."""
    return df.orderBy(seeded_hash(keys, seed), *keys)


def assign_batches(
    df: DataFrame,
    keys: Sequence[str],
    size: int,
    seed: int = 0,
    *,
    drop_remainder: bool = False,
    group_rows: int = GROUP_ROWS,
    out: str = "batch",
) -> DataFrame:
    """Number the rows in the order of ``shuffle_rows`` and cut them into batches; the last may be short.

    Rows are numbered inside ranges of the order key, which are its leading bits: as many as make about ``group_rows``
    rows a range, from the counted rows.  A range's start is the prefix sum over the ranges' counts.  ``keys`` must identify
    a row.  ``df`` is read three times: stage one that is expensive to compute.
    """
    bits = max(0, (df.count() - 1) // group_rows).bit_length()
    rows = df.withColumn("__order", seeded_hash(keys, seed)).withColumn(
        "__range", F.shiftright("__order", BITS - bits).cast("bigint")
    )
    counts = rows.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    everything = Window.partitionBy(F.lit(0))  # one row per range
    starts = counts.select(
        "__range",
        F.coalesce(
            F.sum("__n").over(everything.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("__start"),
        F.sum("__n").over(everything).alias("__all"),
    )
    inside = Window.partitionBy("__range").orderBy("__order", *keys)
    numbered = attach(rows, stage(starts, "batch-ranges"), "__range", "inner").withColumn(
        "__row", F.col("__start") + F.row_number().over(inside) - 1
    )
    batch = F.floor(F.col("__row") / F.lit(size)).cast("bigint")
    if drop_remainder:
        numbered = numbered.where((batch + 1) * size <= F.col("__all"))
    return numbered.select(*df.columns, batch.alias(out))
