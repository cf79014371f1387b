"""User functions applied to entities, piece by piece."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.operators.joins import attach
from panelweave.operators.series import ENTITY, PIECE, with_piece
from panelweave.sources.staging import stage
from panelweave.spec import PanelSpec

PandasFn = Callable[[pd.DataFrame], pd.DataFrame]
MARK = "__mark"
NO_ID = "__no_id"


def piece_apply(
    df: DataFrame, spec: PanelSpec, chunk_steps: int, fn: PandasFn, schema: T.StructType | str, batched: bool = False
) -> DataFrame:
    """Run a pandas function on every (entity, time piece), rows in time order.

    The caller cuts the pieces: each spans ``chunk_steps`` grid steps, on borders that are the same
    for all entities.  The function sees a piece at a time and nothing else of its entity.

    A call costs milliseconds, more than a short piece's work.  With ``batched`` the function gets many pieces at a time:
    whole ones, one after the other, numbered in the column ``PIECE``, and has to work on each by itself (row by row,
    or grouped by ``PIECE``).
    """
    ts = spec.ts
    pieced = with_piece(df, spec.with_(chunk_steps=chunk_steps))
    if batched:
        return _many_pieces(pieced, spec, fn, schema)

    def run(piece: pd.DataFrame) -> pd.DataFrame:
        return fn(piece.drop(columns=[ENTITY, PIECE]).sort_values(ts, ignore_index=True))

    return pieced.groupBy(ENTITY, PIECE).applyInPandas(run, schema)


def _many_pieces(pieced: DataFrame, spec: PanelSpec, fn: PandasFn, schema: T.StructType | str) -> DataFrame:
    """``fn`` on frames of whole pieces; a task holds an Arrow batch and the piece that goes on in the next one."""
    key = spec.id
    whole = isinstance(pieced.schema[key].dataType, T.IntegralType)
    sent = pieced.repartition(ENTITY, PIECE).sortWithinPartitions(ENTITY, PIECE, spec.ts).withColumn(MARK, F.xxhash64(ENTITY, PIECE))
    if whole:  # a null among whole numbers would make them floats, so it travels as a flag
        zero = F.lit(0).cast(pieced.schema[key].dataType)
        sent = sent.withColumns({NO_ID: F.col(key).isNull(), key: F.coalesce(F.col(key), zero)})
    sent = sent.drop(ENTITY, PIECE)

    def call(frames: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(frames, ignore_index=True)
        mark = rows[MARK].to_numpy()
        rows[PIECE] = np.cumsum(np.diff(mark, prepend=mark[:1]) != 0)
        parts = [rows]
        if whole:
            lost = rows[NO_ID].to_numpy(dtype=bool)
            parts = [rows[~lost], rows[lost].assign(**{key: np.nan})]
        for part in parts:
            if len(part):
                part = part.drop(columns=[c for c in (MARK, NO_ID) if c in part]).reset_index(drop=True)
                yield fn(part.assign(**{PIECE: part[PIECE] - part[PIECE].iloc[0]}))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            if frame.empty:
                continue
            mark = frame[MARK].to_numpy()
            if held and held[-1][MARK].iloc[-1] != mark[0]:
                yield from call(held)
                held = []
            cut = len(mark) - int(np.argmax(mark[::-1] != mark[-1])) if mark[0] != mark[-1] else 0
            if cut:
                yield from call([*held, frame.iloc[:cut]])
                held = []
            held.append(frame.iloc[cut:])
        if held:
            yield from call(held)

    return sent.mapInPandas(run, schema)


def group_apply(
    df: DataFrame,
    spec: PanelSpec,
    partial: PandasFn,
    partial_schema: T.StructType | str,
    merge: Sequence[Column],
    fn: PandasFn,
    schema: T.StructType | str,
    batched: bool = False,
) -> DataFrame:
    """A function of whole entities in two phases, without holding an entity in one task.

    ``partial`` makes rows of partial results from a piece (it must return the id column), ``merge``
    aggregates them per entity with Spark's own functions, and ``fn`` gets each piece with the merged
    columns beside its rows.  When ``merge`` does not depend on how rows are grouped (sums, counts,
    extremes), neither does the result, whatever ``spec.chunk_steps`` is.  With ``batched`` both
    functions get many pieces at a time, see ``piece_apply``.
    """
    parts = piece_apply(df, spec, spec.chunk_steps, partial, partial_schema, batched)
    merged = stage(parts.groupBy(F.struct(F.col(spec.id).alias("id")).alias(ENTITY)).agg(*merge), "merged")
    keyed = df.withColumn(ENTITY, F.struct(F.col(spec.id).alias("id")))
    whole = attach(keyed, merged, ENTITY, "left").drop(ENTITY)
    return piece_apply(whole, spec, spec.chunk_steps, fn, schema, batched)
