"""Exact quantiles of large groups without sorting a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.operators.joins import attach
from panelweave.sources.staging import stage

# Rank error of the sketch is at most rows / ACCURACY.
ACCURACY = 100_000
# Distinct values that one task ranks at most, except where a bracket cannot be narrowed.
RANKED_VALUES = 50_000
# Cells that a narrowing pass cuts a bracket into, and the rank error of its sketch in cells.
CELLS, CELL_ERROR = 256, 0.3
PASSES = 8


def _with_brackets(rows: DataFrame, stored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Every row once per quantile of its group, with that quantile's bracket."""
    if by:
        placed = attach(rows, stored, list(by), "inner", null_safe=True)
    else:
        placed = rows.join(F.broadcast(stored))  # one row
    return placed.select(*by, "__n", "__v", F.inline("__brackets"))


def _narrowed(rows: DataFrame, stored: DataFrame, by: Sequence[str], limit: int) -> DataFrame | None:
    """The brackets after one counting pass, or None when each holds at most ``limit`` distinct values.

    The values inside a bracket are sketched into cells of equal rank; the cells that can hold the wanted rank are the new
    bracket, about a hundredth of the old one.
    """
    v, lo, hi = F.col("__v"), F.col("__lo"), F.col("__hi")
    inside = v.between(lo, hi)
    grid = [i / CELLS for i in range(CELLS + 1)]
    seen = _with_brackets(rows, stored, by).where(v <= hi).groupBy(*by, "quantile", "__n", "__lo", "__hi").agg(
        F.count_if(v < lo).alias("__below"),
        F.count_if(inside).alias("__inside"),
        F.approx_count_distinct(F.when(inside, v)).alias("__values"),
        F.percentile_approx(F.when(inside, v), grid, 4 * CELLS).alias("__grid"),
    )
    seen = stage(seen, "narrowing")
    if (seen.agg(F.max("__values")).first()[0] or 0) <= limit:
        return None
    place = ((F.col("__n") - 1) * F.col("quantile") - F.col("__below")) / F.col("__inside") * CELLS
    first = F.greatest(F.floor(place - CELL_ERROR) - 1, F.lit(0)).cast("int")
    last = F.least(F.ceil(place + CELL_ERROR) + 1, F.lit(CELLS)).cast("int")
    wide = F.col("__values") > limit
    bracket = F.struct(
        "quantile",
        F.when(wide, F.get("__grid", first)).otherwise(lo).alias("__lo"),
        F.when(wide, F.get("__grid", last)).otherwise(hi).alias("__hi"),
    )
    return stage(seen.groupBy(*by, "__n").agg(F.collect_list(bracket).alias("__brackets")), "brackets")


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: Sequence[float],
    accuracy: int = ACCURACY,
    ranked_values: int = RANKED_VALUES,
) -> DataFrame:
    """Linearly interpolated quantiles: columns ``by``, quantile, value.

    A mergeable sketch brackets every quantile between two values; its rank error is bounded, so
    the bracket is certain to hold the rank.  While a bracket has more than ``ranked_values`` distinct values, a counting pass
    narrows it.  One more aggregation counts the rows below, inside (per distinct value) and above the
    bracket, and the distinct values inside are ranked: a bounded number however many rows there are.
    """
    margin = 2.0 / accuracy
    low = [max(0.0, p - margin) for p in probs]
    high = [min(1.0, p + margin) for p in probs]
    x = F.col(value).cast("double")
    rows = df.select(*by, x.alias("__v")).where(F.col("__v").isNotNull())
    sketch = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("__n"),
        F.percentile_approx("__v", [*low, *high], accuracy).alias("__b"),
    )
    brackets = [
        F.struct(
            F.lit(float(p)).alias("quantile"),
            F.element_at("__b", i + 1).alias("__lo"),
            F.element_at("__b", len(probs) + i + 1).alias("__hi"),
        )
        for i, p in enumerate(probs)
    ]
    stored = stage(sketch.select(*by, "__n", F.array(*brackets).alias("__brackets")), "brackets")
    # a bracket has about 4 / accuracy of a group's rows, so small groups need no counting pass
    most = stored.agg(F.max("__n")).first()[0] or 0
    for _ in range(PASSES if 8 * most / accuracy > ranked_values else 0):
        narrower = _narrowed(rows, stored, by, ranked_values)
        if narrower is None:
            break
        stored = narrower
    placed = _with_brackets(rows, stored, by)
    v = F.col("__v")
    side = F.when(v < F.col("__lo"), 0).when(v <= F.col("__hi"), 1).otherwise(2)
    counted = (
        placed.withColumn("__side", side)
        .groupBy(*by, "quantile", "__n", "__side", F.when(F.col("__side") == 1, v).alias("__in"))
        .agg(
            F.count(F.lit(1)).alias("__c"), F.min("__v").alias("__min"), F.max("__v").alias("__max")
        )
    )
    ordered = (
        Window.partitionBy(*by, "quantile")
        .orderBy("__side", "__in")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = counted.withColumn("__end", F.sum("__c").over(ordered))
    end, start = F.col("__end"), F.col("__end") - F.col("__c")
    place = (F.col("__n") - 1) * F.col("quantile")
    below = F.floor(place)

    def value_at(rank):
        """The value with this 0-based rank; of the outer parts only the nearest row is known."""
        is_low, is_in = F.col("__side") == 0, F.col("__side") == 1
        return F.max(
            F.when(is_low & (rank == end - 1), F.col("__max"))
            .when(is_in & (start <= rank) & (rank < end), F.col("__in"))
            .when((F.col("__side") == 2) & (rank == start), F.col("__min"))
        )

    picked = ranked.groupBy(*by, "quantile").agg(
        value_at(below).alias("__left"),
        value_at(F.least(below + 1, F.col("__n") - 1)).alias("__right"),
        F.max(place - below).alias("__part"),
    )
    left, right = F.col("__left"), F.col("__right")
    found = left.isNotNull() & right.isNotNull()
    value_out = F.when(found, left + (right - left) * F.col("__part")).otherwise(
        F.raise_error(F.lit("quantile outside its bracket")).cast("double")
    )
    return picked.select(*by, "quantile", value_out.alias("value"))
