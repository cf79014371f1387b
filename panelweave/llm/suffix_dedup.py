"""Removal of bytes covered by a long string that an earlier document has, found on Burrows-Wheeler transforms.

Texts are UTF-8 bytes.  Equal texts are one class, represented by its least doc_id; a row with a greater id repeats
the class and loses everything (when it has ``length`` bytes at all).  Between classes:

1. Every window of ``length`` bytes has an anchor, the least hash among its ``anchor``-byte strings.  Equal windows have
   equal anchors.  Tasks send each anchor with an id by hash range; a range tells which anchors two ids share.
2. Documents with shared anchors are read again.  A run of windows with one shared anchor is a *segment*; equal
   segments become one row with the least id that has it.
3. Segments are dealt to blocks by anchor, so equal windows meet in one block.  A block's Burrows-Wheeler transform is
   searched breadth first: intervals are extended backward, a level at a time, and an interval's border gets its
   common-prefix value when it is first reached.  Values come in increasing order, and the search stops at ``length``:
   borders without a value lie inside runs of equal windows.  The least id of each run decides who keeps the string.
   Equal rows are one string of a block, and an anchor with a single string needs no search.
4. Covered windows go back to their documents, where runs are merged and removed.

Segments are cut to ``longest`` windows, and an anchor whose segments have more than ``hot_bytes`` together is cut into
single windows dealt by their own hash, so a block has at most ``block`` bytes and one anchor's.  A window that a segment
repeats (periodic text) is one row; its answer holds at all its places, which are looked up in the segment afterwards.
An id with several texts (null ids are one) is asked text by text which anchors it shares, so its list is not handed to each.

Null text is the empty text, shorter texts lose nothing.  Equal ids are not smaller than each other, so rows with one
doc_id never cost each other bytes; a null doc_id is after all others.  An empty table gives no rows.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.llm import textarrays as T
from panelweave.sources.staging import discard, stage

LAST_ID = (1 << 63) - 1
#: Symbols of 258 kinds that fit a 63-bit number.
PACKED = 7
_STEP = T.seeds(4, 51) | np.uint64(1)


@dataclass(frozen=True)
class RepeatSpec:
    """String length, anchor length, and the bounds of what a task holds."""

    length: int = 50
    anchor: int = 20
    flush: int = 1_000_000
    range_bytes: int = 12_000_000
    block: int = 600_000
    hot_bytes: int = 600_000
    longest: int = 5_000
    broadcast_ids: int = 1_000_000


# ---- anchors -----------------------------------------------------------------------------------


def runs(data: np.ndarray, offsets: np.ndarray, spec: RepeatSpec) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: anchor, row, start in the row, number of windows."""
    none = (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    n, k, width = len(data), spec.anchor, spec.length - spec.anchor + 1
    if n < spec.length:
        return none
    word = np.ndarray((n - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))
    value = word[: n - k + 1] * _STEP[0]
    for i, at in enumerate((8, k - 8)):
        value = (value ^ (value >> np.uint64(29))) * _STEP[i + 1] + word[at : at + n - k + 1]
    value = T.mix64(value)
    least, have = value, 1
    while 2 * have <= width:
        least, have = np.minimum(least[:-have], least[have:]), 2 * have
    least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    size = np.diff(offsets)
    row = np.flatnonzero(size >= spec.length)
    if not len(row):
        return none
    count = size[row] - spec.length + 1
    at = np.repeat(offsets[row] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    of = np.repeat(row, count)
    anchor = least[at]
    head = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1])]))
    # least hashes crowd near zero; mixed once more they fill the hash ranges evenly
    return T.mix64(anchor[head]), of[head], at[head] - offsets[of[head]], np.diff(np.append(head, len(at)))


def shared_anchors(classes: DataFrame, size: int, spec: RepeatSpec) -> DataFrame:
    """(m, anchor) for every anchor that documents ``classes`` (m, text) with different ids have; pairs may repeat."""
    lead = max(0, (size // spec.range_bytes).bit_length())
    press = {"level": 1}

    def packed(keys: np.ndarray, ids: np.ndarray) -> bytes:
        step = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()
        return zstandard.ZstdCompressor(**press).compress(step + ids.view(np.uint8).reshape(-1, 8).T.tobytes())

    def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
        keys, ids = (np.ascontiguousarray(x.reshape(8, -1).T).ravel() for x in (raw[: len(raw) // 2], raw[len(raw) // 2 :]))
        return np.cumsum(keys.view(np.uint64), dtype=np.uint64), ids.view(np.int64)

    def grouped(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (key, id) pairs in order; where a key begins; whether it has several ids."""
        order = np.lexsort((ids, keys))
        keys, ids = keys[order], ids[order]
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])]) if len(keys) else np.zeros(0, bool)
        keys, ids = keys[new], ids[new]
        head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        many = np.repeat(np.diff(np.append(head, len(keys))) > 1, np.diff(np.append(head, len(keys))))
        return keys, ids, head, many

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0

        def send() -> pa.RecordBatch:
            keys, ids, head, many = grouped(*map(np.concatenate, zip(*held, strict=True)))
            held.clear()
            # one entry per key, the least id, and for keys with several ids here the greatest too
            ends = np.append(head[1:], len(keys)) - 1
            entry = np.unique(np.concatenate([head, ends[many[head]]]))
            rows = []
            for which, at in enumerate((entry, np.flatnonzero(many))):
                borders = np.searchsorted(keys[at], np.arange(1, 1 << lead, dtype=np.uint64) << np.uint64(64 - lead)) if lead else []
                cuts = [0, *map(int, borders), len(at)]
                rows += [(i, which, packed(keys[at[a:b]], ids[at[a:b]])) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
            columns = zip(*rows, strict=True)
            kinds = (pa.int32(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["part", "known", "pairs"])

        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, offsets = T.utf8(batch.column(1))
            for lo, hi in T.chunks(offsets):
                at = offsets[lo : hi + 1]
                anchor, row, _, _ = runs(data[at[0] : at[-1]], at - at[0], spec)
                if len(anchor):
                    held.append((anchor, ids[lo:hi][row]))
                    waiting += len(anchor)
                if waiting >= spec.flush:
                    yield send()
                    waiting = 0
        if waiting:
            yield send()

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        part = None

        def rows(keys: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys.view(np.int64))], names=["m", "anchor"])

        def close() -> pa.RecordBatch:
            keys, ids, _, many = grouped(*map(np.concatenate, zip(*held, strict=True)))
            held.clear()
            return rows(keys[many], ids[many])

        for batch in batches:
            for at, known, blob in zip(*(batch.column(i) for i in range(3)), strict=True):
                if at.as_py() != part:
                    if held:
                        yield close()
                    part = at.as_py()
                pairs = unpacked(blob.as_py())
                if known.as_py():
                    yield rows(*pairs)
                else:
                    held.append(pairs)
        if held:
            yield close()

    sent = classes.select("m", "text").mapInArrow(find, "part int, known int, pairs binary")
    return sent.repartition("part").sortWithinPartitions("part").mapInArrow(tell, "m long, anchor long")


def anchors_by_text(texts: DataFrame, shared: DataFrame, spec: RepeatSpec) -> DataFrame:
    """(m, u, anchors): of every text (m, u, text) those of its anchors that ``shared`` (m, anchor) names for its id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, u = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, offsets = T.utf8(batch.column(2))
            for lo, hi in T.chunks(offsets):
                at = offsets[lo : hi + 1]
                anchor, row, _, _ = runs(data[at[0] : at[-1]], at - at[0], spec)
                columns = [m[lo:hi][row], u[lo:hi][row], anchor.view(np.int64)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["m", "u", "anchor"])

    own = texts.select("m", "u", "text").mapInArrow(run, "m long, u long, anchor long")
    return own.join(shared.distinct(), ["m", "anchor"], "left_semi").groupBy("m", "u").agg(F.collect_set("anchor").alias("anchors"))


# ---- segments ----------------------------------------------------------------------------------


def spans_of(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The byte spans as an Arrow binary column."""
    first = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=first[1:])
    at = np.repeat(starts - first[:-1], sizes) + np.arange(first[-1])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(first.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[at]))])


def segments(texts: DataFrame, spec: RepeatSpec) -> DataFrame:
    """(seg, m, u, start, n, anchor, bytes) of documents (m, u, text, anchors); bytes once per task and segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, u = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, offsets = T.utf8(batch.column(2))
            lists = batch.column(3)
            for lo, hi in T.chunks(offsets):
                at = offsets[lo : hi + 1]
                part, at = data[at[0] : at[-1]], at - at[0]
                anchor, row, start, n = runs(part, at, spec)
                own = lists.slice(lo, hi - lo)
                owner = np.repeat(np.arange(hi - lo), own.value_lengths().fill_null(0).to_numpy())
                asked = T.mix64(own.flatten().to_numpy().view(np.uint64) ^ T.mix64(owner.astype(np.uint64) + np.uint64(1)))
                hit = np.isin(T.mix64(anchor ^ T.mix64(row.astype(np.uint64) + np.uint64(1))), asked)
                anchor, row, start, n = anchor[hit], row[hit], start[hit], n[hit]
                if not len(anchor):
                    continue
                pieces = -(-n // spec.longest)
                if pieces.max() > 1:
                    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                    anchor, row, start, n = (np.repeat(x, pieces) for x in (anchor, row, start, n))
                    start, n = start + nth * spec.longest, np.minimum(n - nth * spec.longest, spec.longest)
                begin, size = at[row] + start, n + spec.length - 1
                spans = T.Words(part, begin, begin + size, row, at)
                seg = T.mix64(T.hashes(spans) + size.astype(np.uint64) * _STEP[3])
                _, first = np.unique(seg, return_index=True)
                new = np.zeros(len(seg), bool)
                new[first] = True
                columns = [seg.view(np.int64), m[lo:hi][row], u[lo:hi][row], start, n, anchor.view(np.int64)]
                shown = spans_of(part, begin, np.where(new, size, 0))
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), shown], names=["seg", "m", "u", "start", "n", "anchor", "bytes"])

    return texts.select("m", "u", "text", "anchors").mapInArrow(run, "seg long, m long, u long, start long, n long, anchor long, bytes binary")


# ---- blocks ------------------------------------------------------------------------------------


def suffix_ranks(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``text`` (symbols up to 256) ordered by at least ``depth`` symbols: order and its inverse.

    The first sort packs seven symbols into a number.  Each further one triples the depth (doubles it in blocks too long
    for three ranks in a number) and sorts only the suffixes that still have equals, inside the places that these hold.
    Suffixes that agree in ``depth`` symbols may stand in any order.
    """
    n = len(text)
    padded = np.concatenate([text.astype(np.int64) + 1, np.zeros(PACKED, np.int64)])
    rank = padded[:n].copy()
    for i in range(1, PACKED):
        rank *= 258
        rank += padded[i : n + i]
    order = np.argsort(rank)
    new = np.ones(n, bool)
    new[1:] = rank[order[1:]] != rank[order[:-1]]
    step = PACKED
    while True:
        # a suffix's rank is the first place of its equals
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, n))
        rank[order] = np.repeat(head, size)
        tied = np.flatnonzero(np.repeat(size > 1, size))
        if step >= depth or not len(tied):
            break
        at = order[tied]
        key, times = rank[at], 3 if (n + 1) ** 3 < 1 << 63 else 2
        for i in range(1, times):
            key = key * (n + 1)
            inside = np.flatnonzero(at + i * step < n)
            key[inside] += rank[at[inside] + i * step] + 1
        by = np.argsort(key)
        order[tied] = at[by]
        key = key[by]
        new[tied[1:]] = key[1:] != key[:-1]
        step *= times
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return order, place


def repeat_classes(text: np.ndarray, length: int) -> np.ndarray:
    """For each position a number that positions share exactly when the next ``length`` symbols are equal.

    ``border[i]`` belongs to the suffixes of rank i - 1 and i; it gets their common prefix when that is below
    ``length``.  Level by level, an interval of suffixes with a common prefix w of the level's length is extended
    backward by each symbol c before it; the suffixes that begin with cw form an interval again, and when the border
    at its end has no value yet, the value is the level and the interval is extended in the next one.
    """
    n = len(text)
    order, place = suffix_ranks(text, length + 1)
    small = np.int32 if n < 1 << 21 else np.int64
    symbol = text[order - 1].astype(small)
    back = place[order - 1].astype(small)
    border = np.full(n + 1, -1, small)
    border[[0, n]] = 0
    low, high = np.zeros(1, small), np.full(1, n, small)
    for level in range(length):
        size = high - low
        first = np.concatenate([[0], np.cumsum(size)]).astype(small)
        at = np.repeat(low - first[:-1], size) + np.arange(first[-1], dtype=small)
        key = np.repeat(np.arange(len(low), dtype=small) * small(512), size) + symbol[at]
        by = np.argsort(key, kind="stable")
        key, to = key[by], back[at[by]]
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        low, high = np.minimum.reduceat(to, head), np.maximum.reduceat(to, head) + small(1)
        new = border[high] < 0
        low, high = low[new], high[new]
        border[high] = level
        if not len(low):
            break
    out = np.empty(n, np.int64)
    out[order] = np.cumsum(border[:n] >= 0)
    return out


def block_owners(parts: list[bytes], ids: np.ndarray, spec: RepeatSpec) -> list[np.ndarray]:
    """For each segment and window, the least id among all segments that hold an equal window."""
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    first = np.concatenate([[0], np.cumsum(size + 1)])
    text = np.full(first[-1], 256, np.int16)
    inside = np.ones(first[-1], bool)
    inside[first[1:] - 1] = False
    text[inside] = np.frombuffer(b"".join(parts), np.uint8)
    number = repeat_classes(text, spec.length)
    count = size - spec.length + 1
    begin = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(first[:-1] - begin[:-1], count) + np.arange(begin[-1])
    least = np.full(int(number.max(initial=0)) + 1, LAST_ID, np.int64)
    np.minimum.at(least, number[at], np.repeat(ids, count))
    found = least[number[at]]
    return [found[a:b] for a, b in zip(begin, begin[1:], strict=False)]


def answered(batches: Iterator[pa.RecordBatch], spec: RepeatSpec, owners: Callable = block_owners) -> Iterator[pa.RecordBatch]:
    """Rows (seg, group, offset, least, bytes), sorted by group and least, to (seg, offset, n) as in ``earlier_windows``.

    Equal rows of a group are one string of the block: they come by rising id, so all windows of a later one with a greater
    id are covered.  It is answered at once and not held, however many there are.  A group with one string has no other
    owner to find, since equal windows have one group, and takes no place in the block.
    """
    held: list[tuple] = []
    seen: dict[bytes, int] = {}
    group, size, begin = None, 0, 0

    def sent(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["seg", "offset", "n"])

    def close() -> pa.RecordBatch:
        rows = []
        for (seg, offset, _, least), owner in zip(held, owners([h[2] for h in held], np.array([h[3] for h in held]), spec), strict=True):
            early = np.concatenate([[0], (owner < least).view(np.int8), [0]])
            turn = np.flatnonzero(np.diff(early))
            rows += [(seg, offset + int(a), int(b - a)) for a, b in zip(turn[::2], turn[1::2], strict=True)]
        return sent(rows)

    for batch in batches:
        again = []
        for seg, own, offset, least, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own != group:
                if len(held) == begin + 1:
                    size -= len(held.pop()[2])
                if size >= spec.block:
                    yield close()
                    held, size = [], 0
                group, seen, begin = own, {}, len(held)
            if seen.setdefault(blob, least) < least:
                again.append((seg, offset, len(blob) - spec.length + 1))
                continue
            held.append((seg, offset, blob, least))
            size += len(blob)
        if again:
            yield sent(again)
    if len(held) == begin + 1:
        held.pop()
    if held:
        yield close()


def earlier_windows(unique: DataFrame, spec: RepeatSpec) -> DataFrame:
    """(seg, offset, n): runs of windows of ``unique`` (seg, group, offset, least, bytes) that a smaller id has."""
    dealt = unique.select("seg", "group", "offset", "least", "bytes").repartition("group").sortWithinPartitions("group", "least")
    return dealt.mapInArrow(lambda batches: answered(batches, spec), "seg long, offset long, n long")


def distinct_windows(batches: Iterator[pa.RecordBatch], spec: RepeatSpec) -> Iterator[pa.RecordBatch]:
    """Segments (seg, least, bytes) to their distinct windows (seg, offset, least, bytes), each at its first offset."""
    names, kinds = ["seg", "offset", "least", "bytes"], (pa.int64(), pa.int64(), pa.int64(), pa.binary())

    def sent(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    rows: list[tuple] = []
    for batch in batches:
        for seg, least, blob in zip(*batch.columns, strict=True):
            seg, least, blob = seg.as_py(), least.as_py(), blob.as_py()
            first: dict[bytes, int] = {}
            for i in range(len(blob) - spec.length + 1):
                first.setdefault(blob[i : i + spec.length], i)
            rows += [(seg, i, least, window) for window, i in first.items()]
            if len(rows) >= 50_000:
                yield sent(rows)
                rows = []
    if rows:
        yield sent(rows)


def single_windows(spread: DataFrame, spec: RepeatSpec) -> DataFrame:
    """Segments of crowded anchors as rows of one distinct window each, dealt by the window's own bytes."""
    windows = spread.select("seg", "least", "bytes").mapInArrow(lambda b: distinct_windows(b, spec), "seg long, offset long, least long, bytes binary")
    return windows.withColumn("group", F.xxhash64("bytes"))


def all_places(batches: Iterator[pa.RecordBatch], spec: RepeatSpec) -> Iterator[pa.RecordBatch]:
    """Segments (seg, bytes, early) whose ``early`` names distinct windows to (seg, early) with runs of all equal windows."""
    for batch in batches:
        found = []
        for blob, early in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            named = {blob[e["offset"] : e["offset"] + spec.length] for e in early}
            hit = [blob[i : i + spec.length] in named for i in range(len(blob) - spec.length + 1)]
            turn = np.flatnonzero(np.diff(np.array([False, *hit, False]).view(np.int8)))
            found.append([{"offset": int(a), "n": int(b - a)} for a, b in zip(turn[::2], turn[1::2], strict=True)])
        kind = pa.list_(pa.struct([("offset", pa.int64()), ("n", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["seg", "early"])


# ---- removal -----------------------------------------------------------------------------------


def removed_bytes(texts: DataFrame) -> DataFrame:
    """Per document (m, u, text, spans of start and end): m, u, n_removed, n_spans, kept_sha256, kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["m", "u", "n_removed", "n_spans", "kept_sha256", "kept"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            rows = []
            for m, u, text, spans in zip(*batch.columns, strict=True):
                data = np.frombuffer(text.as_py().encode(), np.uint8)
                pairs = spans.values.flatten()
                edge = np.zeros(len(data) + 1, np.int64)
                np.add.at(edge, pairs[0].to_numpy(), 1)
                np.add.at(edge, pairs[1].to_numpy(), -1)
                gone = np.cumsum(edge[:-1]) > 0
                left = data[~gone].tobytes()
                n_spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
                rows.append((m.as_py(), u.as_py(), int(gone.sum()), n_spans, hashlib.sha256(left).hexdigest(), left.decode(errors="replace")))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return texts.select("m", "u", "text", "spans").mapInArrow(run, "m long, u long, n_removed long, n_spans long, kept_sha256 string, kept string")


def only(docs: DataFrame, ids: DataFrame, limit: int) -> DataFrame:
    """Rows of ``docs`` whose m is in ``ids``: a broadcast filter when the ids are few, else a shuffled one."""
    return docs.join(F.broadcast(ids) if ids.count() <= limit else ids, "m", "left_semi")


def release(spark: SparkSession) -> None:
    """Drop what refers to finished phases, so that Spark's cleaner deletes their shuffle files now.

    Their results are stored, so nothing reads those files again.
    """
    gc.collect()
    spark._jvm.System.gc()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder, and the shuffle files of the phase released."""
    spark, out = df.sparkSession, stage(df, name, codec="zstd")
    del df
    release(spark)
    return out


def deduplicate(docs: DataFrame, spec: RepeatSpec = RepeatSpec(), with_text: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256.

    ``with_text`` adds ``kept``, the remaining bytes as text (broken characters become U+FFFD).
    """
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST_ID)).alias("m"), text.alias("text"))
    rows = rows.withColumn("sha", F.sha2("text", 256)).withColumn("n_bytes", F.octet_length("text").cast("long")).withColumn("u", F.xxhash64("text"))
    narrow = stage(rows.select("doc_id", "m", "u", "sha", "n_bytes"), "repeat-rows")
    first = stage(narrow.groupBy("sha").agg(F.min("m").alias("least")), "repeat-classes")
    judged = stage(narrow.join(first, "sha"), "repeat-judged")
    again = judged.filter("m > least").select("m", "u").distinct()
    few = again.count() <= spec.broadcast_ids
    leaders = rows.select("m", "u", "text").join(F.broadcast(again) if few else again, ["m", "u"], "left_anti")
    size = narrow.agg(F.sum("n_bytes")).first()[0] or 0

    several = stage(narrow.groupBy("m").agg(F.min("u").alias("a"), F.max("u").alias("b")).filter("a <> b").select("m"), "repeat-several")
    pairs = shared_anchors(leaders, size, spec)
    if several.isEmpty():
        shared = stored(pairs.groupBy("m").agg(F.collect_set("anchor").alias("anchors")), "repeat-anchors")
        asked = only(leaders, shared.select("m"), spec.broadcast_ids).join(shared, "m")
    else:
        pairs = stored(pairs, "repeat-pairs")
        apart = F.broadcast(several) if several.count() <= spec.broadcast_ids else several
        lists = pairs.join(apart, "m", "left_anti").groupBy("m").agg(F.collect_set("anchor").alias("anchors"))
        by_text = anchors_by_text(leaders.join(apart, "m", "left_semi"), pairs.join(apart, "m", "left_semi"), spec)
        shared = stored(lists.select("m", F.lit(None).cast("long").alias("u"), "anchors").unionByName(by_text), "repeat-anchors")
        plain = only(leaders, shared.filter("u is null").select("m"), spec.broadcast_ids)
        asked = plain.join(shared.filter("u is null").drop("u"), "m").unionByName(leaders.join(shared.filter("u is not null"), ["m", "u"]))
    members = stored(segments(asked, spec), "repeat-segments")
    discard(shared)

    unique = members.groupBy("seg").agg(F.min("m").alias("least"), F.first("anchor").alias("group"), F.max("bytes").alias("bytes"))
    unique = stored(unique.withColumn("offset", F.lit(0).cast("long")), "repeat-unique")
    least = unique.select("seg", "least")
    crowded = unique.groupBy("group").agg(F.sum(F.octet_length("bytes")).alias("b")).filter(F.col("b") > spec.hot_bytes).select("group")
    spread = None
    if not crowded.isEmpty():
        crowded = stage(crowded, "repeat-crowded")
        spread = stage(unique.join(crowded, "group", "left_semi").select("seg", "least", "bytes"), "repeat-spread", codec="zstd")
        unique = unique.join(crowded, "group", "left_anti").unionByName(single_windows(spread, spec))
    early = stored(earlier_windows(unique, spec), "repeat-early").groupBy("seg").agg(F.collect_list(F.struct("offset", "n")).alias("early"))
    if spread is not None:
        named = early.join(spread.select("seg", "bytes"), "seg").select("seg", "bytes", "early")
        places = named.mapInArrow(lambda b: all_places(b, spec), "seg long, early array<struct<offset: long, n: long>>")
        early = early.join(spread.select("seg"), "seg", "left_anti").unionByName(places)

    found = members.select("seg", "m", "u", "start", "n").join(least, "seg").join(early, "seg", "left")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("offset"), F.col("n").alias("n")))
    runs_of = F.explode(F.when(F.col("m") > F.col("least"), whole).otherwise(F.col("early")))
    covered = found.select("m", "u", "start", runs_of.alias("w"))
    begin = F.col("start") + F.col("w.offset")
    covered = covered.select("m", "u", F.struct(begin.alias("start"), (begin + F.col("w.n") + (spec.length - 1)).alias("end")).alias("span"))
    spans = stored(covered.groupBy("m", "u").agg(F.collect_list("span").alias("spans")), "repeat-spans")

    hit = only(leaders, spans.select("m").distinct(), spec.broadcast_ids).join(spans, ["m", "u"])
    done = removed_bytes(hit)
    done = stage((done if with_text else done.drop("kept")).dropDuplicates(["m", "u"]), "repeat-removed")
    out = judged.join(done, ["m", "u"], "left")
    gone = (F.col("m") > F.col("least")) & (F.col("n_bytes") >= spec.length)
    columns = [
        "doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    ]
    if with_text:
        whole_text = rows.select(F.col("sha").alias("_sha"), F.col("text").alias("_text")).dropDuplicates(["_sha"])
        out = out.join(whole_text, F.col("sha") == F.col("_sha"))
        columns.append(F.when(gone, "").otherwise(F.coalesce("kept", "_text")).alias("kept"))
    return out.select(*columns)
