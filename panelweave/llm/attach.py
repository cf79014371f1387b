"""Lookup of a keyed side whose keys may be hot on the row side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sides of up to this many rows are broadcast; larger ones are joined on salted keys.
BROADCAST_ROWS = 50_000
SALTS = 64


def attach(rows: DataFrame, side: DataFrame, key: str, spread_by: Column, how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` with the columns of ``side``, which has one row per ``key``; nulls are equal.

    A counted small side is broadcast.  A larger one is copied ``SALTS`` times and ``spread_by`` deals the rows of each
    key over the copies, so a key with a third of all rows is no task's share.
    """
    side = side.withColumnRenamed(key, "__key")
    if side.count() <= limit:
        return rows.join(F.broadcast(side), F.col(key).eqNullSafe(F.col("__key")), how).drop("__key")
    side = side.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int"))
    return salted.join(side, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__salt") == F.col("__copy")), how).drop("__key", "__copy", "__salt")
