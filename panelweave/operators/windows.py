"""Overlapping windows of T steps, their encoder/decoder halves and the way back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.functions.timegrid import slot, time_type
from panelweave.operators.series import FIRST, NEXT, OFFSET, TOTAL, in_piece, with_context
from panelweave.spec import PanelSpec

BLOCK_STEPS = 512


def sliding_windows(
    df: DataFrame,
    spec: PanelSpec,
    length: int,
    features: Sequence[str],
    *,
    dense: bool = False,
    short: str = "skip",
    block_steps: int | None = None,
) -> DataFrame:
    """Every run of ``length`` consecutive rows of each entity; n rows give n - length + 1 windows.

    Result: id, window_ts (time of the first step), is_first (first window of its entity) and
    steps ``ARRAY<STRUCT<pos, ts, features…>>``.

    History is cut into blocks of ``block_steps`` rows; a block also receives the first
    ``length - 1`` rows of the next one, so every window lies whole inside one block and no group
    exceeds ``block_steps + length`` rows.  ``dense=True`` is for panels without gaps (as from
    ``fill_gaps``): the row number then follows from the time since the entity's first, and an entity
    in which any row is not exactly one step before the next raises; ``profile.gaps`` lists them.
    ``df`` is read twice, for the entity's facts and for its rows, and should be a stored table.
    Entities with fewer than ``length`` rows give no window, or an error with ``short="error"``.
    """
    if length < 1:
        raise ValueError("length must be positive")
    if short not in ("skip", "error"):
        raise ValueError("short must be 'skip' or 'error'")
    # the default block repeats at most a quarter of the rows for its neighbour
    size = max(block_steps or max(BLOCK_STEPS, 4 * length), length)
    if dense and short == "skip":
        ctx = with_context(df, spec, first=True, next_start=True)
        at = lambda c: slot(c, time_type(df, spec.ts), spec)
        here, following = at(F.col(spec.ts)), F.coalesce(F.lead(spec.ts).over(in_piece(spec)), F.col(NEXT))
        gap = F.concat(
            F.lit("dense=True on a series with a gap or a repeated time: "), F.coalesce(F.col(spec.id).cast("string"), F.lit("null"))
        )
        number = F.when(at(following) - here != 1, F.raise_error(gap)).otherwise(here - at(F.col(FIRST)))
        rows = ctx.withColumn("pos", number.cast("bigint"))
    else:
        ctx = with_context(df, spec, offset=True)
        number = (F.col(OFFSET) + F.row_number().over(in_piece(spec)) - 1).cast("bigint")
        if short == "error":
            too_short = F.concat(
                F.lit("series shorter than the window: "), F.coalesce(F.col(spec.id).cast("string"), F.lit("null"))
            )
            number = F.when(F.col(TOTAL) < length, F.raise_error(too_short)).otherwise(number)
        rows = ctx.withColumn("pos", number)

    named = [f for f in features if f != spec.ts]
    block = F.floor(F.col("pos") / F.lit(size))
    rows = rows.select(spec.id, spec.ts, *named, "pos", block.alias("__own"))
    inside = F.col("pos") - F.col("__own") * F.lit(size)
    # the previous block completes its last windows with these rows
    homes = F.array_compact(F.array(F.col("__own"), F.when(inside < length - 1, F.col("__own") - 1)))
    rows = rows.withColumn("__block", F.explode(homes))
    step = F.struct("pos", F.col(spec.ts).alias("ts"), *named)
    groups = rows.groupBy(spec.id, "__block").agg(
        F.sort_array(F.collect_list(step)).alias("__rows"),
        F.count(F.lit(1)).cast("int").alias("__size"),
        F.count_if(F.col("__own") == F.col("__block")).cast("int").alias("__mine"),
    )
    last = F.least(F.col("__mine"), F.col("__size") - F.lit(length - 1))
    starts = groups.where(last > 0).select(spec.id, "__rows", F.explode(F.sequence(F.lit(1), last)).alias("__i"))
    steps = F.slice("__rows", F.col("__i"), length)
    start = F.element_at("__rows", F.col("__i"))
    return starts.select(
        spec.id, start["ts"].alias("window_ts"), (start["pos"] == 0).alias("is_first"), steps.alias("steps")
    )


def encoder_decoder_split(
    windows: DataFrame,
    encoder_steps: int,
    inputs: Sequence[str],
    targets: Sequence[str],
    steps: str = "steps",
) -> DataFrame:
    """Replace ``steps`` by x (all steps, input columns) and y (steps after the encoder, targets)."""
    rest = [c for c in windows.columns if c != steps]
    all_steps = F.col(steps)
    x = F.transform(all_steps, lambda s: F.array(*[s[i].cast("double") for i in inputs]))
    tail = F.slice(all_steps, encoder_steps + 1, F.greatest(F.size(all_steps) - encoder_steps, F.lit(0)))
    y = F.transform(tail, lambda s: F.array(*[s[t].cast("double") for t in targets]))
    return windows.select(*rest, x.alias("x"), y.alias("y"))


def flatten_windows(windows: DataFrame, id: str = "id", steps: str = "steps") -> DataFrame:
    """Undo the overlap: the whole first window of an entity, then the last step of every other."""
    kept = F.when(F.col("is_first"), F.col(steps)).otherwise(
        F.slice(F.col(steps), F.size(steps), 1)
    )
    return windows.select(id, F.explode(kept).alias("__s")).select(id, "__s.*")
