"""Document fingerprints: MinHash signatures, and groups of near copies by joined and verified signature bands.

A text's shingles are hashed by many universal permutations in numpy; the least values are its signature, printed in
base64.  The likeness of two signatures is their share of equal places.  Groups come from ``near_links``: signature
bands are joined in Spark and Jaccard similarity (80 percent) is verified on the full shingle sets.

``fingerprint_documents`` also measures an edited form of each text: its last third replaced by the beginning of the
next document in descending id order (after the last comes the first).  The order is made without one sorted whole:
ids are cut at quantiles into ranges, every range also gets the first document of the range after it, and rows stream
through a range in order, one document and its successor at a time.

Null text is the empty text; texts without words have equal signatures.  Rows that repeat an id are ordered by a hash
of their text; a null doc_id comes last and is linked with nothing.  A single row is its own successor.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.near_links import NearSpec, near_components, text_sets
from panelweave.llm import textarrays as T
from panelweave.sources.staging import stage

NO_ID = -(1 << 63)


@dataclass(frozen=True)
class FingerprintSpec:
    """Number of permutations, the link settings, and the text bytes of a range of ids (at most ``max_ranges``)."""

    permutations: int = 128
    near: NearSpec = NearSpec()
    range_bytes: int = 16_000_000
    max_ranges: int = 20_000


def text_signatures(texts: list[str], spec: FingerprintSpec) -> np.ndarray:
    """One row of minima per text."""
    a, b = T.permutations(spec.permutations, 41)
    parts = [T.minima(values, first, a, b) for _, _, values, first in text_sets(pa.array(texts, pa.string()), spec.near)]
    return np.concatenate(parts) if parts else np.zeros((0, spec.permutations), np.uint32)


def printed(signature: np.ndarray) -> str:
    return base64.b64encode(signature.astype("<u4").tobytes()).decode()


def likeness(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Share of equal places, row by row."""
    return (one == other).mean(axis=1)


def edited(text: str, after: str) -> str:
    """The last third of ``text`` replaced by as many characters of ``after``, or all it has."""
    cut = len(text) // 3
    return text[: len(text) - cut] + after[:cut]


OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, component_id long"
)


def id_ranges(docs: DataFrame, spec: FingerprintSpec) -> np.ndarray:
    """Ids at which ranges begin, in descending order; the first is the greatest id."""
    got = docs.agg(F.sum(F.octet_length("text")).alias("b"), F.max("doc_id").alias("top")).first()
    if got["top"] is None:
        return np.array([NO_ID], np.int64)
    n = int(min(spec.max_ranges, max(1, (got["b"] or 0) // spec.range_bytes)))
    shares = [i / n for i in range(1, n)]
    cuts = docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 20 * n)).alias("q")).first()["q"] if shares else []
    return np.array(sorted({got["top"], *(cuts or [])}, reverse=True), np.int64)


def fingerprint_documents(docs: DataFrame, spec: FingerprintSpec = FingerprintSpec()) -> DataFrame:
    """Per row: doc_id, n_chars, digest of the edited text, both fingerprints, their likeness, the likeness to the
    next document, and the least id among the document's verified near copies."""
    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    groups = stage(near_components(narrow, spec.near).filter("component_id <> doc_id").select("doc_id", "tie", "component_id").distinct(), "near-groups")
    heads = id_ranges(narrow, spec)
    last = len(heads) - 1

    def place(ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(-heads, -np.maximum(ids, -(1 << 63) + 1), side="right") - 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy()
            part = place(ids)
            row = np.arange(len(ids))
            first = row[heads[part] == ids]
            blobs = [press.compress((t.as_py() or "").encode()) for t in batch.column(1)]
            rows = np.concatenate([row, first])
            before = np.where(part[first] == 0, last, part[first] - 1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([part, before]), pa.int64()), pa.array(np.repeat([0, 1], [len(row), len(first)]), pa.int32()),
                    pa.array(ids[rows]), batch.column(2).take(pa.array(rows)), pa.array([blobs[i] for i in rows], pa.binary()),
                    pa.nulls(len(rows), pa.int64()),
                ],
                names=["part", "beyond", "doc_id", "tie", "blob", "component_id"],
            )

    def deal_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(place(batch.column(0).to_numpy()), pa.int64()), pa.array(np.zeros(n), pa.int32()), batch.column(0),
                    batch.column(1), pa.nulls(n, pa.binary()), batch.column(2),
                ],
                names=["part", "beyond", "doc_id", "tie", "blob", "component_id"],
            )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        waiting: list[tuple[int, str, int | None]] = []
        part, group = None, (None, None, None)

        def rows(more: bool) -> pa.RecordBatch:
            """All that wait but the last, which stays to precede what follows."""
            texts = [w[1] for w in waiting]
            own = text_signatures(texts, spec)
            changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
            new = text_signatures(changed, spec)
            columns = [
                [None if w[0] == NO_ID else w[0] for w in waiting[:-1]], list(map(len, texts[:-1])),
                [hashlib.sha256(t.encode()).hexdigest() for t in changed], list(map(printed, own[:-1])), list(map(printed, new)),
                likeness(own[:-1], new), likeness(own[:-1], own[1:]), [w[2] for w in waiting[:-1]],
            ]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
            del waiting[: -1 if more else None]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in OUT.split(", ")])

        size, closed = 0, False
        for batch in batches:
            for at, beyond, id, tie, blob, component in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != part:
                    if len(waiting) > 1:
                        yield rows(False)
                    waiting.clear()
                    part, size, closed = at, 0, False
                if blob is None:
                    group = (id, tie, component)
                elif not closed:
                    text = unpress.decompress(blob).decode()
                    own = group[2] if group[:2] == (id, tie) else None if id == NO_ID else id
                    waiting.append((id, text, own))
                    size += len(text)
                    closed = bool(beyond)
                    if size > T.CHUNK and len(waiting) > 1 and not closed:
                        yield rows(True)
                        size = len(waiting[-1][1])
        if len(waiting) > 1:
            yield rows(False)

    fields = "part long, beyond int, doc_id long, tie long, blob binary, component_id long"
    texts = narrow.select("doc_id", "text", F.xxhash64("text").alias("tie")).mapInArrow(deal, fields)
    dealt = texts.unionByName(groups.mapInArrow(deal_groups, fields)).repartition("part")
    order = dealt.sortWithinPartitions("part", "beyond", F.desc("doc_id"), "tie", F.col("blob").isNotNull())
    return order.mapInArrow(finish, OUT)
