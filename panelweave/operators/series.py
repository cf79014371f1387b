"""Ordered operators over an entity's history that never hold the whole history in one task.

Rows are grouped by (entity, time piece).  What a piece needs from its past or future (last known
value, next observation, number of earlier rows) comes from a summary with one row per piece, built
with a map-side partial aggregate and joined back on the same (entity, piece) key the window uses.
The facts are therefore shuffled once, on a key whose groups have a bounded size.

A null id is an entity like any other: the key is a struct around the id, which is never null itself.
A row without a time has no place in the order and raises an error.

The input is read twice, for the summary (only the columns it needs) and for the rows.  Stage an
input that is expensive to compute; a stored table is scanned twice, which is cheap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelweave.functions.timegrid import shift, slot, steps_until, time_type
from panelweave.spec import PanelSpec

ENTITY = "__entity"
PIECE = "__piece"
NEXT = "__next_start"
OFFSET = "__offset"
TOTAL = "__total"
LOWEST = "__lowest"
FIRST = "__first"


def carried(name: str) -> str:
    return f"__carried_{name}"


def in_piece(spec: PanelSpec) -> WindowSpec:
    return Window.partitionBy(ENTITY, PIECE).orderBy(spec.ts)


def with_piece(df: DataFrame, spec: PanelSpec) -> DataFrame:
    ts = F.col(spec.ts)
    number = slot(ts, time_type(df, spec.ts), spec)
    missing = F.raise_error(F.lit(f"a row without a time in {spec.ts}"))
    piece = F.when(ts.isNull(), missing).otherwise(F.floor(number / F.lit(spec.chunk_steps)))
    return df.withColumns({ENTITY: F.struct(F.col(spec.id).alias("id")), PIECE: piece})


def with_context(
    df: DataFrame,
    spec: PanelSpec,
    *,
    carry: Sequence[str] = (),
    next_start: bool = False,
    first: bool = False,
    offset: bool = False,
    lowest: str | None = None,
) -> DataFrame:
    """Add the piece number and the requested facts about the rest of the entity's history."""
    pieced = with_piece(df, spec)
    aggs: list[Column] = []
    if next_start or first:
        aggs.append(F.min(spec.ts).alias("__start"))
    if offset:
        aggs.append(F.count(F.lit(1)).alias("__rows"))
    if lowest is not None:
        aggs.append(F.min(lowest).alias("__low"))
    for c in carry:
        known = F.when(F.col(c).isNotNull(), F.col(spec.ts))
        aggs.append(F.max_by(F.col(c), known).alias(f"__last_{c}"))
    pieces = pieced.groupBy(ENTITY, PIECE).agg(*aggs)

    entity = Window.partitionBy(ENTITY)
    ordered = entity.orderBy(PIECE)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    facts: list[Column] = []
    if next_start:
        facts.append(F.lead("__start").over(ordered).alias(NEXT))
    if first:
        facts.append(F.min("__start").over(entity).alias(FIRST))
    if offset:
        facts.append(F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias(OFFSET))
        facts.append(F.sum("__rows").over(entity).alias(TOTAL))
    if lowest is not None:
        facts.append(F.min("__low").over(entity).alias(LOWEST))
    for c in carry:
        facts.append(F.last(f"__last_{c}", ignorenulls=True).over(before).alias(carried(c)))
    return pieced.join(pieces.select(ENTITY, PIECE, *facts), [ENTITY, PIECE], "left")


def filled_forward(name: str, spec: PanelSpec) -> Column:
    """Last known value up to this row; needs ``with_context(carry=[name])``."""
    so_far = in_piece(spec).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.coalesce(F.last(name, ignorenulls=True).over(so_far), F.col(carried(name)))


def forward_fill(df: DataFrame, spec: PanelSpec, columns: Sequence[str]) -> DataFrame:
    """Carry the last non-null value of each column forward inside its entity.

    Nulls before an entity's first value stay null.
    """
    ctx = with_context(df, spec, carry=columns)
    filled = {c: filled_forward(c, spec) for c in columns}
    return ctx.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])


def partition_min(df: DataFrame, spec: PanelSpec, column: str, out: str) -> DataFrame:
    """The entity's minimum on every row; nulls do not count."""
    ctx = with_context(df, spec, lowest=column)
    return ctx.select(*df.columns, F.col(LOWEST).alias(out))


def drop_negative_groups(df: DataFrame, spec: PanelSpec, column: str | None = None) -> DataFrame:
    """Keep only entities whose smallest value is not negative (drops all-null entities too)."""
    ctx = with_context(df, spec, lowest=column or spec.target)
    return ctx.where(F.col(LOWEST) >= 0).select(*df.columns)


def with_position(df: DataFrame, spec: PanelSpec, out: str = "pos") -> DataFrame:
    """0-based number of the row inside its entity, in time order."""
    ctx = with_context(df, spec, offset=True)
    number = F.col(OFFSET) + F.row_number().over(in_piece(spec)) - 1
    return ctx.select(*df.columns, number.cast("bigint").alias(out))


def fill_gaps(
    df: DataFrame,
    spec: PanelSpec,
    *,
    forward: Sequence[str] = (),
    made: str | None = None,
    lowest: str | None = None,
    first: str | None = None,
) -> DataFrame:
    """One row per grid step between an entity's first and last observation.

    Made rows repeat the entity, carry the ``forward`` columns on and are null elsewhere.
    ``made`` names an optional flag column, ``first`` one with the entity's first time.  With ``lowest`` the entities whose minimum of that
    column is negative are removed in the same pass.  Filling before the rows are made gives the
    same values as filling after, so the made rows need neither a shuffle nor a sort.
    """
    dtype = time_type(df, spec.ts)
    ctx = with_context(df, spec, carry=forward, next_start=True, first=first is not None, lowest=lowest)
    if lowest is not None:
        ctx = ctx.where(F.col(LOWEST) >= 0)
    following = F.coalesce(F.lead(spec.ts).over(in_piece(spec)), F.col(NEXT))
    kept = [filled_forward(c, spec).alias(c) if c in forward else F.col(c) for c in df.columns]
    if first:
        kept.append(F.col(FIRST).alias(first))
    rows = ctx.select(*kept, following.alias("__until"))

    # The steps of one gap are made in two levels, so that no array outgrows chunk_steps.
    ts = F.col(spec.ts)
    count = F.greatest(
        F.coalesce(steps_until(ts, F.col("__until"), dtype, spec), F.lit(1)), F.lit(1)
    ).cast("bigint")
    size = F.lit(spec.chunk_steps).cast("bigint")
    rows = rows.withColumn("__count", count)
    rows = rows.withColumn(
        "__block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__count") - 1) / size)))
    )
    low = F.col("__block") * size
    high = F.least(F.col("__count") - 1, low + size - 1)
    rows = rows.withColumn("__step", F.explode(F.sequence(low, high)))
    original = F.col("__step") == 0
    moved = F.when(original, ts).otherwise(shift(ts, F.col("__step"), dtype, spec))
    rows = rows.withColumn("__ts", moved)

    out: list[Column] = []
    for c in df.columns:
        if c == spec.id or c in forward:
            out.append(F.col(c))
        elif c == spec.ts:
            out.append(F.col("__ts").alias(c))
        else:
            out.append(F.when(original, F.col(c)).alias(c))
    if first:
        out.append(F.col(first))
    if made:
        out.append((~original).alias(made))
    return rows.select(*out)
