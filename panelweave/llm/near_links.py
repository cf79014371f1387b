"""Verified near-copy links between documents: MinHash bands, b-bit estimates, exact Jaccard.

1. Each text becomes its set of distinct word shingles; documents with equal sets are one class, whose node is the
   least id and the set's digest, so that an id with several texts has a node for each.  Classes of any size cost one row
   each from here on.
2. Signatures of representatives are cut into bands.  Every band bucket links its members to its least member, and
   the components of these links are *clusters*: two documents that share any bucket are in one cluster.
3. Inside a cluster the packed low bits of the minima are compared by bit counts; pairs whose corrected estimate is
   within ``margin`` of the threshold or above are checked on their full sets.  A cluster is cut into blocks
   of bounded size, and pairs of blocks are dealt to tasks, so no task holds a whole cluster and pairs are never rows.
   Only links that join two parts of a block pair are returned: as many as there are documents at most.

With 25 bands of 5 a pair at similarity 0.8 shares no bucket with probability 5e-5, at 0.85 with 4e-7.  The margin is
over four standard deviations of the estimate.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm import textarrays as T
from panelweave.llm.components import components
from panelweave.sources.staging import stage

#: Ids and packed bits of up to this many cluster members (about 100 bytes each) are broadcast to the scan of the texts.
BROADCAST_MEMBERS = 300_000
#: Bounds of a block: documents, and shingles.
BLOCK_DOCS, BLOCK_SHINGLES = 1500, 2_000_000


@dataclass(frozen=True)
class NearSpec:
    """Shingle length in words, link threshold in percent, bands and rows of the signature, bits kept per minimum."""

    shingle: int = 5
    percent: int = 80
    bands: int = 25
    rows: int = 5
    bits: int = 4
    margin: float = 0.17
    lower: bool = True
    salt: int = 21

    @property
    def minima(self) -> int:
        return self.bands * self.rows


def text_sets(column: pa.Array, spec: NearSpec) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows [lo, hi) with their shingle sets (values, first)."""
    data, offsets = T.utf8(column)
    for lo, hi in T.chunks(offsets):
        at = offsets[lo : hi + 1]
        part = data[at[0] : at[-1]]
        w = T.words(T.LOWER[part] if spec.lower else part, at - at[0])
        yield lo, hi, *T.shingles(w, T.hashes(w), spec.shingle)


def packed(minima: np.ndarray, bits: int) -> np.ndarray:
    """The low bits of each row's minima as a row of 64-bit words, padded with zeros."""
    fit = 64 // bits
    low = (minima & np.uint32((1 << bits) - 1)).astype(np.uint64)
    low = np.pad(low, ((0, 0), (0, -low.shape[1] % fit))).reshape(len(low), -1, fit)
    return (low << (np.arange(fit, dtype=np.uint64) * np.uint64(bits))).sum(axis=2, dtype=np.uint64)


def estimate(one: np.ndarray, many: np.ndarray, spec: NearSpec) -> np.ndarray:
    """Similarity of one packed signature to many: equal places by bit counts, corrected for chance agreement."""
    diff = many ^ one
    folded = diff.copy()
    for shift in range(1, spec.bits):
        folded |= diff >> np.uint64(shift)
    ones = sum(1 << (spec.bits * i) for i in range(64 // spec.bits))
    unequal = np.bitwise_count(folded & np.uint64(ones)).sum(axis=1, dtype=np.int64)
    chance = 1 / (1 << spec.bits)
    return ((1 - unequal / spec.minima) - chance) / (1 - chance)


def signatures(docs: DataFrame, spec: NearSpec) -> DataFrame:
    """Per row: doc_id, tie (a hash of the text), n_shingles, digest of the set (null when empty), band keys, packed low bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = T.permutations(spec.minima, spec.salt)
        place = T.seeds(spec.bands * (spec.rows + 1), spec.salt + 2).reshape(spec.bands, -1)
        for batch in batches:
            for lo, hi, values, first in text_sets(batch.column(2), spec):
                counts = np.diff(first)
                least = T.minima(values, first, a, b)
                bands = T.mix64(least.reshape(hi - lo, spec.bands, spec.rows).astype(np.uint64) + place[:, 1:])
                keys = T.mix64((bands * (place[:, 1:] | np.uint64(1))).sum(axis=2, dtype=np.uint64) + place[:, 0]).view(np.int64)
                low = packed(least, spec.bits)
                raw = [values[s:e].tobytes() for s, e in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(counts, pa.int64()),
                        pa.array([set_digest(r) if r else None for r in raw], pa.binary()),
                        pa.ListArray.from_arrays(np.arange(0, keys.size + 1, spec.bands, dtype=np.int32), keys.ravel()),
                        pa.array([r.tobytes() for r in low], pa.binary()),
                    ],
                    names=["doc_id", "tie", "n_shingles", "digest", "bands", "bits"],
                )

    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("tie"), docs["text"].alias("text"))
    return narrow.mapInArrow(run, "doc_id long, tie long, n_shingles long, digest binary, bands array<long>, bits binary")


def set_digest(packed_set: bytes) -> bytes:
    return hashlib.blake2b(packed_set, digest_size=16).digest()


def node_of(rep: Column, digest: Column) -> Column:
    """Eight bytes that order like the id, then eight of the set's digest."""
    ordered = F.lpad(F.hex(rep.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.unhex(ordered), F.substring(digest, 1, 8))


def id_of(node: Column) -> Column:
    unsigned = F.conv(F.hex(F.substring(node, 1, 8)), 16, 10).cast("decimal(20,0)")
    return (unsigned - F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("long")


def sets_of(docs: DataFrame, spec: NearSpec) -> DataFrame:
    """Rows of ``docs`` whose text is the one of their ``node``: all columns but the text, and the sorted set as packed
    64-bit values."""
    others = [c for c in docs.columns if c != "text"]
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest, nodes = batch.select(others), batch.column("node")
            for lo, hi, values, first in text_sets(batch.column(at), spec):
                sets = [values[s:e].tobytes() for s, e in zip(first[:-1], first[1:], strict=True)]
                own = pa.array([set_digest(v)[:8] == n.as_py()[8:] for v, n in zip(sets, nodes.slice(lo, hi - lo), strict=True)], pa.bool_())
                part = rest.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sets, pa.binary())], names=[*others, "values"]).filter(own)

    fields = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in others)
    return docs.mapInArrow(run, f"{fields}, values binary")


def block_links(left: np.ndarray, sets: list[np.ndarray], low: np.ndarray, spec: NearSpec) -> list[tuple[int, int]]:
    """Links that join parts of one block (``left`` all True) or of two, as index pairs.

    ``left`` marks the documents of the first block.  In a pair of blocks only pairs across are compared.
    """
    n = len(sets)
    size = np.fromiter(map(len, sets), np.int64, n)
    part, links = np.arange(n), []
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.concatenate([[0], np.cumsum(size)])
    flag = np.zeros(len(values), bool)
    one_block = bool(left.all())
    floor = spec.percent / 100 - spec.margin
    for i in np.flatnonzero(left):
        other = np.arange(i + 1, n) if one_block else np.flatnonzero(~left)
        other = other[(part[other] != part[i])]
        other = other[100 * np.minimum(size[other], size[i]) >= spec.percent * np.maximum(size[other], size[i])]
        if len(other):
            other = other[estimate(low[i], low[other], spec) >= floor]
        if not len(other):
            continue
        own = place[first[i] : first[i + 1]]
        flag[own] = True
        for j in other:
            if part[j] != part[i]:
                common = int(np.count_nonzero(flag[place[first[j] : first[j + 1]]]))
                if 100 * common >= spec.percent * (size[i] + size[j] - common):
                    links.append((int(i), int(j)))
                    part[part == part[j]] = part[i]
        flag[own] = False
    return links


def classes(sigs: DataFrame) -> DataFrame:
    """One row per distinct set: digest, rep (least id), node, n_shingles, bands, bits."""
    first = F.min_by(F.struct("n_shingles", "bands", "bits"), "doc_id")
    full = sigs.filter("digest is not null and doc_id is not null")
    found = full.groupBy("digest").agg(F.min("doc_id").alias("rep"), first.alias("s"))
    return found.select("digest", "rep", node_of(F.col("rep"), F.col("digest")).alias("node"), "s.*")


def verified_links(docs: DataFrame, reps: DataFrame, spec: NearSpec) -> DataFrame:
    """Links (a, b) between nodes that connect exactly what the threshold connects."""
    keys = reps.select("node", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most")
    star = keys.join(shared, "key").filter("node != least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    clusters = components(star)
    members = clusters.join(reps, "node").select("rep", "node", "component", "n_shingles", "bits")
    members = stage(members, "members")
    sums = members.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    cut = F.ceil(F.greatest(F.col("n") / BLOCK_DOCS, F.col("s") / BLOCK_SHINGLES)).cast("int")
    placed = members.join(sums.select("component", cut.alias("cut")), "component")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("cut")).cast("int"))

    texts = docs.select(docs["doc_id"].cast("long").alias("rep"), docs["text"].alias("text"))
    wanted = placed.select("rep", "node", "component", "cut", "block", "bits")
    wanted = F.broadcast(wanted) if members.count() <= BROADCAST_MEMBERS else wanted
    sets = sets_of(texts.join(wanted, "rep"), spec)
    group = F.transform(
        F.sequence(F.lit(0), F.col("cut") - 1), lambda j: F.struct(F.least(j, "block").alias("x"), F.greatest(j, "block").alias("y"))
    )
    dealt = sets.withColumn("g", F.explode(group)).select("component", "g.x", "g.y", (F.col("g.x") == F.col("block")).alias("left"), "node", "bits", "values")
    dealt = dealt.repartition("component", "x", "y").sortWithinPartitions("component", "x", "y", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        key = None

        def links() -> pa.RecordBatch:
            ids = list(held)
            left = np.array([held[i][0] for i in ids])
            low = np.array([np.frombuffer(held[i][1], np.uint64) for i in ids])
            sets = [np.frombuffer(held[i][2], np.uint64) for i in ids]
            found = block_links(left, sets, low, spec) if len(ids) > 1 else []
            a, b = [ids[x] for x, _ in found], [ids[y] for _, y in found]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for component, x, y, left, node, bits, values in zip(*columns, strict=True):
                if key != (component, x, y):
                    if held:
                        yield links()
                    held, key = {}, (component, x, y)
                held[node] = (left, bits, values)
        if held:
            yield links()

    return dealt.mapInArrow(run, "a binary, b binary")


def near_components(docs: DataFrame, spec: NearSpec) -> DataFrame:
    """Per row of ``docs``: doc_id, tie (a hash of the text), digest, n_shingles, component_id, first.

    A null or wordless text has an empty set and is linked with nothing: its component is itself.  Rows that repeat a
    doc_id with one text are one document; with another text they are linked by that text, and may lie in another
    component.  A null doc_id is linked with nothing.  ``first`` marks the rows whose set is the component's first, which stands
    for it.
    """
    sigs = stage(signatures(docs, spec), "signatures")
    reps = stage(classes(sigs), "classes")
    found = components(stage(verified_links(docs, reps, spec), "links")).withColumnRenamed("node", "_node")
    least = reps.join(found, F.col("node") == F.col("_node"), "left").select(
        F.col("digest").alias("_d"), F.coalesce(id_of(F.col("component")), "rep").alias("component_id"),
        F.coalesce(F.col("component") == F.col("node"), F.lit(True)).alias("first"),
    )
    out = sigs.join(least, F.col("digest") == F.col("_d"), "left")
    return out.select(
        "doc_id", "tie", "digest", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.coalesce("first", F.lit(True)).alias("first"),
    )
