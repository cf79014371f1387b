"""Language-model scores from a log-frequency Bloom filter.

Training counts unigrams and bigrams exactly: each task sorts and sums some million n-gram hashes at a time and sends
them on by hash range; each range then sums what it got.  A range becomes a shard of the filter: an n-gram of count c
has level ``1 + floor(log2 c)`` and is entered once for every level up to its own.  A level is read back by probing
level 1, 2, ... until a probe fails.  Exact unigram counts stay beside the filter for the base score.

Scoring broadcasts shards and counts when their measured size is within ``broadcast_bytes``.  Beyond that the texts
are stored in chunks.  A chunk sends each shard one blob with the chunk's distinct n-grams of that range, in order; the
shard probes them and sends back a level and a count for each, in the same order, and the chunk scores its texts with
the answers of all shards.  So no n-gram is a row.  Both ways give one result.

A token is a word ``[^\\x20\\x09-\\x0D]+`` in lower case (A-Z), and one end per text, which is also what stands before
the first word.  The model interpolates: ``weight * c(v w) / c(v) + (1 - weight) * (c(w) + 1) / (N + V + 1)``, with every
count read from the filter.  Null text is empty: one end token.  Repeated rows are texts of their own and counted as
often; a null doc_id is in training.  Without training text all counts are 0, and N and V are 0.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm import textarrays as T
from panelweave.llm.suffix_dedup import release
from panelweave.sources.staging import discard, new_path, stage

END = T.seeds(1, 31)[0]
_PAIR = T.seeds(3, 32) | np.uint64(1)
_PROBE = T.seeds(64, 33)


@dataclass(frozen=True)
class LmSpec:
    """Filter bits per entry and probes per level; interpolation weight; sizes that bound memory.

    ``shard_bytes`` of text make one hash range, ``flush`` tokens are summed in a task before they are sent.
    ``chunk_bytes`` of text ask the shards together; a shard answers up to ``asked`` n-grams at a time.
    """

    bits: int = 8
    probes: int = 5
    weight: float = 0.7
    flush: int = 1_500_000
    shard_bytes: int = 8_000_000
    broadcast_bytes: int = 192_000_000
    chunk_bytes: int = 8_000_000
    asked: int = 300_000


def held_out(id: Column) -> Column:
    return F.coalesce(F.crc32(id.cast("string")) % 7 == 2, F.lit(False))


def tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows [lo, hi) with their token hashes, ends included, and where each row's begin."""
    data, offsets = T.utf8(column)
    for lo, hi in T.chunks(offsets):
        at = offsets[lo : hi + 1]
        w = T.words(T.LOWER[data[at[0] : at[-1]]], at - at[0])
        first = w.first + np.arange(len(w.first))
        out = np.full(first[-1], END, np.uint64)
        out[np.arange(len(w.row)) + w.row] = T.hashes(w)
        yield lo, hi, out, first


def pairs(token: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token before each token, and the hash of the two."""
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[first[:-1]] = END
    return before, T.mix64(T.mix64(before * _PAIR[0] + _PAIR[2]) + token * _PAIR[1])


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences by byte place, and counts, compressed."""
    step = np.diff(keys, prepend=np.uint64(0))
    raw = step.view(np.uint8).reshape(-1, 8).T.tobytes() + counts.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n = len(raw) // 12
    step = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view(np.uint64).ravel()
    return np.cumsum(step, dtype=np.uint64), np.ascontiguousarray(raw[8 * n :].reshape(4, n).T).view(np.uint32).ravel()


def pack_answers(levels: np.ndarray, counts: np.ndarray) -> bytes:
    """Levels as bytes, and counts by byte place, compressed."""
    raw = levels.astype(np.uint8).tobytes() + counts.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack_answers(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n = len(raw) // 9
    return raw[:n], np.ascontiguousarray(raw[n:].reshape(8, n).T).view(np.int64).ravel()


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys with their counts."""
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order].astype(np.int64)
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[heads], np.add.reduceat(counts, heads) if len(keys) else counts


def slots(keys: np.ndarray, level: int, size: np.ndarray | np.uint64, probes: int) -> Iterator[np.ndarray]:
    """The bit of every key for each probe of ``level``, in filters of ``size`` bits."""
    one = T.mix64(keys + _PROBE[level])
    two = T.mix64(one) | np.uint64(1)
    for _ in range(probes):
        yield ((one >> np.uint64(32)) * size) >> np.uint64(32)
        one = one + two


def build_filter(keys: np.ndarray, counts: np.ndarray, spec: LmSpec) -> np.ndarray:
    """The bits, as bytes, of one shard."""
    level = np.frexp(counts)[1]
    size = int(level.sum()) * spec.bits // 64 * 64 + 64
    bit = np.zeros(size, bool)
    for j in range(1, int(level.max(initial=0)) + 1):
        for at in slots(keys[level >= j], j, np.uint64(size), spec.probes):
            bit[at] = True
    return np.packbits(bit, bitorder="little")


@dataclass
class Filter:
    """Shards by hash range: the leading ``shift``-bit part of a key names its shard."""

    bits: np.ndarray
    first: np.ndarray
    size: np.ndarray
    lead: int
    probes: int

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key: membership probes of level 1, 2, ... until one fails."""
        out, alive, level = np.zeros(len(keys), np.int64), np.arange(len(keys)), 1
        while len(alive) and level < len(_PROBE):
            own = keys[alive]
            shard = (own >> np.uint64(64 - self.lead)).astype(np.int64) if self.lead else np.zeros(len(own), np.int64)
            base, size = self.first[shard], self.size[shard]
            hit = size > 0
            for at in slots(own, level, size, self.probes):
                at = np.where(hit, base + at, 0).astype(np.int64)
                hit &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
            alive = alive[hit]
            out[alive] = level
            level += 1
        return out


def of_level(level: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level."""
    return np.where(level > 0, 1.5 * np.exp2(level - 1.0) - 0.5, 0.0)


def by_shard(keys: np.ndarray, lead: int) -> list[tuple[int, int, int]]:
    """(shard, begin, end) of the runs of sorted keys that belong to one shard."""
    borders = np.searchsorted(keys, np.arange(1, 1 << lead, dtype=np.uint64) << np.uint64(64 - lead)) if lead else []
    cuts = [0, *map(int, borders), len(keys)]
    return [(i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]


def train(docs: DataFrame, spec: LmSpec) -> tuple[DataFrame, int]:
    """Shards (shard, lead, tokens, distinct, keys, bits) of the model, and the number of leading bits."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    lead = max(0, (size // spec.shard_bytes).bit_length())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {1: [], 2: []}
        waiting = 0

        def send() -> pa.RecordBatch:
            rows = []
            for order, parts in held.items():
                keys, counts = summed(np.concatenate(parts))
                rows += [(i, order, pack(keys[a:b], counts[a:b])) for i, a, b in by_shard(keys, lead)]
                parts.clear()
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["shard", "n", "grams"])

        for batch in batches:
            for _, _, token, first in tokens(batch.column(0)):
                held[1].append(token)
                held[2].append(pairs(token, first)[1])
                waiting += len(token)
                if waiting >= spec.flush:
                    yield send()
                    waiting = 0
        if waiting:
            yield send()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        shard = None

        def close() -> pa.RecordBatch:
            one, two = (summed(*map(np.concatenate, zip(*held[n], strict=True))) for n in (1, 2))
            bits = build_filter(np.concatenate([one[0], two[0]]), np.concatenate([one[1], two[1]]), spec)
            row = [shard, int(one[1].sum()), len(one[0]), one[0].tobytes(), one[1].astype(np.int64).tobytes(), bits.tobytes()]
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=["shard", "tokens", "distinct", "keys", "counts", "bits"])

        nothing = (np.zeros(0, np.uint64), np.zeros(0, np.uint32))
        for batch in batches:
            for row in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                at, n = row[0].as_py(), row[1].as_py()
                if at != shard:
                    if held:
                        yield close()
                    shard, held = at, {1: [nothing], 2: [nothing]}
                held[n].append(unpack(row[2].as_py()))
        if held:
            yield close()

    sent = docs.select("text").mapInArrow(count, "shard int, n int, grams binary")
    dealt = sent.repartition("shard").sortWithinPartitions("shard")
    return stage(dealt.mapInArrow(merge, "shard int, tokens long, distinct long, keys binary, counts binary, bits binary"), "lm-shards"), lead


def _exact_counts(shards: DataFrame, distinct: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and counts of all unigrams, fetched a partition at a time into arrays of the known size."""
    sizes = {r["shard"]: r["distinct"] for r in shards.select("shard", "distinct").collect()}
    order = sorted(sizes)
    first = dict(zip(order, np.cumsum([0, *(sizes[i] for i in order)]), strict=False))
    keys, counts = np.zeros(distinct, np.uint64), np.zeros(distinct, np.int64)
    for r in shards.select("shard", "keys", "counts").toLocalIterator():
        at = slice(first[r["shard"]], first[r["shard"]] + sizes[r["shard"]])
        keys[at], counts[at] = np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["counts"], np.int64)
    return keys, counts


def _whole_filter(shards: DataFrame, lead: int, spec: LmSpec) -> Filter:
    """All shards in one array, fetched a partition at a time."""
    sizes = np.zeros(max(1, 1 << lead), np.int64)
    for r in shards.select("shard", F.octet_length("bits").alias("n")).collect():
        sizes[r["shard"]] = r["n"]
    first = np.concatenate([[0], np.cumsum(sizes)])
    bits = np.zeros(max(1, int(first[-1])), np.uint8)
    for r in shards.select("shard", "bits").toLocalIterator():
        bits[first[r["shard"]] : first[r["shard"] + 1]] = np.frombuffer(r["bits"], np.uint8)
    return Filter(bits, first[:-1].astype(np.uint64) * np.uint64(8), sizes.astype(np.uint64) * np.uint64(8), lead, spec.probes)


def one_shard(shard: int, blob: bytes, lead: int, spec: LmSpec) -> Filter:
    """A filter of one shard; the others are empty."""
    size = np.zeros(max(1, 1 << lead), np.uint64)
    size[shard] = 8 * len(blob)
    return Filter(np.frombuffer(blob, np.uint8), np.zeros(len(size), np.uint64), size, lead, spec.probes)


def score_documents(docs: DataFrame, spec: LmSpec = LmSpec()) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities)."""
    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), held_out(docs["doc_id"]).alias("held_out"))
    shards, lead = train(narrow.filter("not held_out"), spec)
    octets = sum(F.octet_length(c) for c in ("keys", "counts", "bits"))
    got = shards.agg(F.sum("tokens").alias("n"), F.sum("distinct").alias("v"), F.sum(octets).alias("b")).first()
    total, distinct = got["n"] or 0, got["v"] or 0
    if (got["b"] or 0) <= spec.broadcast_bytes:
        return _score_broadcast(narrow, shards, lead, total, distinct, spec)
    return _score_dealt(narrow, shards, lead, total, distinct, spec)


OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(part: pa.RecordBatch | pa.Table, first: np.ndarray, here: np.ndarray, end: int, c: np.ndarray, seen: np.ndarray, two: np.ndarray, total: int, distinct: int, spec: LmSpec) -> list:
    """The columns of ``OUT`` for the rows of ``part`` (doc_id, held_out).

    ``here`` names each token, and ``end`` the end token, by place in ``c`` and ``seen``: exact counts, and counts by the filter;
    ``two`` has the latter of each bigram.
    """
    there = np.empty_like(here)
    there[1:] = here[:-1]
    there[first[:-1]] = end
    one = seen[there]
    joint = np.minimum(np.divide(two, one, out=np.zeros_like(two), where=one > 0), 1.0)
    p = spec.weight * joint + (1 - spec.weight) * (seen[here] + 1) / (total + distinct + 1)
    base = np.log10((c[here] + 1) / (total + distinct + 1))
    sums = [np.add.reduceat(x, first[:-1]) for x in ((c[here] > 0).astype(np.int64), base, np.log10(p))]
    return [part.column("doc_id"), part.column("held_out"), pa.array(np.diff(first)), pa.array(sums[0]), pa.array(np.full(len(first) - 1, total, np.int64)), pa.array(sums[1]), pa.array(sums[2])]


def _score_broadcast(docs: DataFrame, shards: DataFrame, lead: int, total: int, distinct: int, spec: LmSpec) -> DataFrame:
    """Every worker has the whole model, whose size was checked."""
    context = docs.sparkSession.sparkContext
    exact = context.broadcast(_exact_counts(shards, distinct))
    grams = context.broadcast(_whole_filter(shards, lead, spec))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known, times), levels = exact.value, grams.value
        for batch in batches:
            for lo, hi, token, first in tokens(batch.column(1)):
                pair = pairs(token, first)[1]
                word, place = np.unique(np.concatenate([token, [END]]), return_inverse=True)
                c = np.zeros(len(word), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, word), len(known) - 1)
                    c = np.where(known[at] == word, times[at], 0)
                seen = of_level(levels.levels(word))
                columns = _scored(batch.slice(lo, hi - lo), first, place[:-1], place[-1], c, seen, of_level(levels.levels(pair)), total, distinct, spec)
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in OUT.split(", ")])

    return docs.select("doc_id", "text", "held_out").mapInArrow(run, OUT)


def chunked(docs: DataFrame, spec: LmSpec) -> DataFrame:
    """``docs`` (doc_id, held_out, text) with the chunk of each row: neighbours of up to ``chunk_bytes``, or one longer text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            _, offsets = T.utf8(batch.column(2))
            size = np.concatenate([[0], np.cumsum(np.diff(offsets) + 8)])  # an empty text is a token, too
            for lo, hi in T.chunks(size, min(T.CHUNK, spec.chunk_bytes)):
                if held and held + size[hi] - size[lo] > spec.chunk_bytes:
                    chunk, held = chunk + 1, 0
                held += size[hi] - size[lo]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(hi - lo, chunk, np.int64)), *part.columns], names=["chunk", *part.schema.names])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "chunk long, doc_id long, held_out boolean, text string")


def _stored_chunks(docs: DataFrame, spec: LmSpec) -> tuple[DataFrame, str]:
    """The chunks written to the shared folder in buckets, so that grouping them needs no shuffle; and the name of the table."""
    spark = docs.sparkSession
    name = f"panelweave_lm_texts_{uuid.uuid4().hex}"
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 100_000)
    writer = chunked(docs, spec).write.format("parquet").option("path", new_path(spark, "lm-texts")).option("compression", "zstd")
    writer.bucketBy(parts, "chunk").saveAsTable(name)
    return spark.table(name), name


def chunk_grams(texts: pa.ChunkedArray) -> tuple[list[tuple], np.ndarray]:
    """Runs (lo, hi, tokens, where each row's begin, bigrams) of a chunk's texts, and its distinct n-grams in order."""
    runs = [(lo, hi, token, first, pairs(token, first)[1]) for lo, hi, token, first in tokens(texts)]
    return runs, summed(np.concatenate([x for r in runs for x in (r[2], r[4])]))[0]


def _answers(asks: DataFrame, shards: DataFrame, lead: int, spec: LmSpec) -> DataFrame:
    """(chunk, shard, answers) for asks (shard, chunk, grams): the level and exact count of every n-gram, in the order of the ask."""
    model = ["keys", "counts", "bits"]
    nothing = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    loads = shards.select("shard", *nothing("long", "chunk"), *nothing("binary", "grams"), *model)
    dealt = loads.unionByName(asks.select("shard", "chunk", "grams", *nothing("binary", *model)))
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", F.col("chunk").isNotNull())

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times, levels, loaded = np.zeros(0, np.uint64), np.zeros(0, np.int64), None, None
        asked: list[tuple[int, np.ndarray]] = []
        shard, waiting = None, 0

        def reply() -> pa.RecordBatch:
            keys = np.concatenate([k for _, k in asked])
            level, c = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
            if loaded == shard:
                level = levels.levels(keys)
                if len(known):
                    where = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                    c = np.where(known[where] == keys, times[where], 0)
            cuts = np.cumsum([0, *(len(k) for _, k in asked)])
            blobs = [pack_answers(level[a:b], c[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
            columns = [pa.array([i for i, _ in asked], pa.int64()), pa.array([shard] * len(asked), pa.int32()), pa.array(blobs, pa.binary())]
            asked.clear()
            return pa.RecordBatch.from_arrays(columns, names=["chunk", "shard", "answers"])

        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                at, chunk = row[0].as_py(), row[1].as_py()
                if asked and (at != shard or waiting >= spec.asked):
                    yield reply()
                    waiting = 0
                shard = at
                if chunk is None:
                    known, times = np.frombuffer(row[3].as_py(), np.uint64), np.frombuffer(row[4].as_py(), np.int64)
                    levels, loaded = one_shard(at, row[5].as_py(), lead, spec), at
                else:
                    asked.append((chunk, unpack(row[2].as_py())[0]))
                    waiting += len(asked[-1][1])
        if asked:
            yield reply()

    return dealt.mapInArrow(probe, "chunk long, shard int, answers binary")


def _score_dealt(docs: DataFrame, shards: DataFrame, lead: int, total: int, distinct: int, spec: LmSpec) -> DataFrame:
    """Chunks of texts ask the shards for their distinct n-grams; what is no longer needed is deleted on the way."""
    spark = docs.sparkSession
    release(spark)
    texts, name = _stored_chunks(docs, spec)

    def ask(rows: pa.Table) -> pa.Table:
        keys = chunk_grams(rows.column("text"))[1]
        sent = [(i, pack(keys[a:b], np.zeros(b - a))) for i, a, b in by_shard(keys, lead)]
        columns = [pa.array([i for i, _ in sent], pa.int32()), pa.array([rows.column("chunk")[0].as_py()] * len(sent), pa.int64()), pa.array([x for _, x in sent], pa.binary())]
        return pa.Table.from_arrays(columns, names=["shard", "chunk", "grams"])

    def score(rows: pa.Table, answers: pa.Table) -> pa.Table:
        runs, keys = chunk_grams(rows.column("text"))
        blobs = answers.column("answers")
        level, times = map(np.concatenate, zip(*(unpack_answers(blobs[int(i)].as_py()) for i in np.argsort(answers.column("shard").to_numpy())), strict=True))
        parts = []
        for lo, hi, token, first, pair in runs:
            own, place = np.unique(np.concatenate([token, pair, [END]]), return_inverse=True)
            at = np.searchsorted(keys, own)
            seen, n = of_level(level[at]), len(token)
            columns = _scored(rows.slice(lo, hi - lo), first, place[:n], place[-1], times[at], seen, seen[place[n:-1]], total, distinct, spec)
            parts.append(pa.Table.from_arrays(columns, names=[f.split()[0] for f in OUT.split(", ")]))
        return pa.concat_tables(parts)

    asks = texts.select("chunk", "text").groupBy("chunk").applyInArrow(ask, "shard int, chunk long, grams binary")
    answers = stage(_answers(asks, shards, lead, spec), "lm-levels")
    del asks
    release(spark)
    scored = stage(texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, OUT), "lm-scores")
    discard(texts, answers, shards)
    spark.sql(f"DROP TABLE {name}")
    return scored
