"""Importance weights of the inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.functions.arrays import softmax


def feature_importance(
    contributions: DataFrame, keys: Sequence[str], names: Sequence[str]
) -> DataFrame:
    """Weights per row that sum to one: softmax over the absolute contribution columns.

    A (window, step) is one row with a column per input, so no shuffle is needed.  Result is long:
    keys, feature, weight.
    """
    weights = softmax([F.abs(F.col(n)).cast("double") for n in names])
    rows = [
        F.struct(F.lit(n).alias("feature"), w.alias("weight"))
        for n, w in zip(names, weights, strict=True)
    ]
    return contributions.select(*keys, F.inline(F.array(*rows)))


def static_importance(contributions: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Weights per window that sum to one, for inputs that all its steps share: keys, feature, weight.

    A window's absolute contributions are averaged over its steps before the softmax; ``keys`` identify a window.
    """
    mean = contributions.groupBy(*keys).agg(*[F.avg(F.abs(F.col(n)).cast("double")).alias(n) for n in names])
    return feature_importance(mean, keys, names)


def importance_table(
    weights: DataFrame, names: Sequence[str], by: Sequence[str] = ("part", "ts")
) -> DataFrame:
    """One ``{name}_importance`` column per input, averaged over the windows that cover a time."""
    picks = [
        F.avg(F.when(F.col("feature") == n, F.col("weight"))).alias(f"{n}_importance")
        for n in names
    ]
    return weights.groupBy(*by).agg(*picks)
