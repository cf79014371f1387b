"""Language of every word by a linear-chain conditional random field, and of every text by its words' marginals.

A word is a run of letters (A-Z, a-z and all bytes of non-ASCII characters), folded to lower case in ASCII and Latin-1.
Its scores per language are sums of learned weights: hashed prefixes and suffixes of up to four bytes, hashed byte trigrams
with the word's borders, and a lexicon (log-odds of the word's hash bucket among the languages).  Transitions between
languages are learned with them.  Forward-backward gives each word's probability per language, so a text may switch;
the text's language is the one with the most expected words, and its share of them is the score.

What is learned from how much: the lexicon counts the words of *all* labelled training texts, in tasks, as sparse rows of
``BUCKETS`` buckets per language.  The weights and transitions are fitted on a bounded sample: per language the ``docs``
distinct texts with the least hash, and of each a run of ``words`` words at a hashed place; the runs of different languages are
strung together, which is where the transitions come from.  The model has a fixed size per language, is collected and broadcast.

Nulls: a text that is null or has no letter is ``und`` with score 0.  Null labels and null ids are not learned from.  A very long
text is processed whole, by itself.  Equal texts get equal answers; ties go to the language that sorts first.  Without any
labelled text all are ``und``.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.llm import textarrays as ta
from panelweave.sources.staging import stage

UNKNOWN = "und"
BUCKETS = 1 << 14
TABLE = 1 << 17
AFFIX = (2, 3, 4)
LANGS_HELD = 32


@dataclass(frozen=True)
class CrfSpec:
    """``docs`` texts per language and ``words`` words of each bound the sample that the weights are fitted on."""

    docs: int = 300
    words: int = 160
    run: int = 16
    runs: int = 4
    epochs: int = 6
    batch: int = 64
    rate: float = 0.15
    decay: float = 1e-4
    seed: int = 12


_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, ta.Words]:
    """The folded bytes with a blank after every row, the rows' new offsets, and the words."""
    rows = len(offsets) - 1
    out = np.full(len(data) + rows + 4, 0x20, np.uint8)
    moved = offsets + np.arange(rows + 1)
    for i in range(rows):
        out[moved[i] : moved[i + 1] - 1] = _FOLD[data[offsets[i] : offsets[i + 1]]]
    capital = np.flatnonzero((out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)) + 1
    out[capital] += 0x20
    return out, moved, ta.words(out[: moved[-1]], moved)


@dataclass
class Features:
    """Table rows of every byte's trigram and every word's affixes, and the words' buckets."""

    grams: np.ndarray
    first: np.ndarray
    affixes: np.ndarray
    buckets: np.ndarray


def _place(code: np.ndarray, kind: int) -> np.ndarray:
    return ((code + np.uint32(0x85EBCA6B * kind & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)) >> np.uint32(16)


def features(data: np.ndarray, w: ta.Words) -> Features:
    size = w.ends - w.starts
    first = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=first[1:])
    at = np.arange(first[-1]) + np.repeat(w.starts - first[:-1], size)
    wide = data.astype(np.uint32)
    before = np.where(at > 0, wide[at - 1], np.uint32(0x20))
    before[first[:-1]] = 0x20
    grams = _place(before << np.uint32(16) | wide[at] << np.uint32(8) | wide[at + 1], 0)
    affixes = np.empty((2 * len(AFFIX), len(size)), np.uint32)
    head, tail = np.zeros(len(size), np.uint32), np.zeros(len(size), np.uint32)
    k = 0
    for j in range(max(AFFIX)):
        inside = size > j
        head = head << np.uint32(8) | np.where(inside, wide[w.starts + j], 0).astype(np.uint32)
        tail = tail << np.uint32(8) | np.where(inside, wide[np.maximum(w.ends - 1 - j, 0)], 0).astype(np.uint32)
        if j + 1 in AFFIX:
            affixes[k], affixes[k + 1] = _place(head, 2 * j + 1), _place(tail, 2 * j + 2)
            k += 2
    buckets = (ta.hashes(w) >> np.uint64(50)).astype(np.int64)
    return Features(grams, first, affixes + np.uint32(TABLE // 2), buckets)


@dataclass(frozen=True)
class CrfModel:
    """``langs`` in ascending order; ``table`` (TABLE, K), ``change`` (K, K), ``lexicon`` (BUCKETS, K), ``trust`` (K,)."""

    langs: tuple[str, ...]
    table: np.ndarray
    change: np.ndarray
    lexicon: np.ndarray
    trust: np.ndarray

    def scores(self, f: Features) -> np.ndarray:
        out = self.lexicon[f.buckets] * self.trust
        for places in f.affixes:
            out += self.table[places]
        if len(f.grams):
            for k in range(len(self.langs)):
                out[:, k] += np.add.reduceat(self.table[: TABLE // 2, k].copy()[f.grams], f.first[:-1])
        return out


def marginals(scores: np.ndarray, counts: np.ndarray, change: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Probabilities of every word's labels in chains of ``counts`` words, and the expected label changes if asked for.

    Chains are cut into segments of a fixed length.  The matrix products of all segments advance together, a short
    pass over each chain's segments carries the messages from border to border, and one more pass fills the segments.
    """
    n, k = scores.shape
    if not n:
        return scores, np.zeros((k, k)) if pairs else None
    length = 32 * max(1, k * k // 64)
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    a = np.exp(change - change.max())
    ends = np.cumsum(counts)
    begins = ends - counts
    per = -(-counts // length)
    order = np.argsort(-per, kind="stable")
    seg_first = np.cumsum(per) - per
    chain = np.repeat(np.arange(len(counts)), per)
    head = begins[chain] + length * (np.arange(len(chain)) - seg_first[chain])
    size = np.minimum(ends[chain] - head, length)
    longest = np.argsort(-size, kind="stable")  # segments that still have a word at step j come first
    size, head, is_first = size[longest], head[longest], head[longest] == begins[chain[longest]]
    place = np.empty_like(longest)
    place[longest] = np.arange(len(longest))
    steps = int(size[0])
    alive = np.searchsorted(-size, -np.arange(steps), side="left")
    prod = np.broadcast_to(np.eye(k), (len(chain), k, k)).copy()
    for j in range(steps):
        m = alive[j]
        moved = (prod[:m].reshape(-1, k) @ a).reshape(m, k, k)
        if j == 0:
            moved[is_first] = np.eye(k)
        moved *= e[head[:m] + j][:, None, :]
        if j % 4 == 3:
            moved /= moved.sum(axis=(1, 2), keepdims=True)
        prod[:m] = moved

    into, out = np.ones((len(chain), k)), np.ones((len(chain), k))
    active = np.searchsorted(-per[order], -np.arange(int(per.max())), side="left")
    v = np.ones((len(counts), k))
    for s in range(int(per.max())):
        c = order[: active[s]]
        at = place[seg_first[c] + s]
        into[at] = v[c]
        moved = np.matmul(v[c][:, None, :], prod[at])[:, 0, :]
        v[c] = moved / moved.sum(axis=1, keepdims=True)
    v = np.ones((len(counts), k))
    for s in reversed(range(int(per.max()))):
        c = order[: active[s]]
        at = place[seg_first[c] + s]
        out[at] = v[c]
        moved = np.matmul(prod[at], v[c][:, :, None])[:, :, 0]
        v[c] = moved / moved.sum(axis=1, keepdims=True)
    del prod

    alpha, beta = np.empty((n, k)), np.empty((n, k))
    for j in range(steps):
        m = alive[j]
        moved = into[:m] @ a
        if j == 0:
            moved[is_first] = 1.0
        moved *= e[head[:m] + j]
        moved /= moved.sum(axis=1, keepdims=True)
        into[:m] = alpha[head[:m] + j] = moved
    for j in reversed(range(steps)):
        m = alive[j]
        at = head[:m] + j
        beta[at] = out[:m]
        moved = (e[at] * out[:m]) @ a.T
        out[:m] = moved / moved.sum(axis=1, keepdims=True)
    both = alpha * beta
    both /= both.sum(axis=1, keepdims=True)
    if not pairs:
        return both, None
    later = np.ones(n, bool)
    later[begins[counts > 0]] = False
    here = np.flatnonzero(later)
    left, right = alpha[here - 1], e[here] * beta[here]
    whole = np.einsum("ni,ij,nj->n", left, a, right)
    return both, a * ((left / whole[:, None]).T @ right)


def fit(langs: tuple[str, ...], lexicon: np.ndarray, runs: list[tuple[int, bytes]], spec: CrfSpec) -> CrfModel:
    """Weights that raise the likelihood of the labels of ``runs`` (language, folded words), strung together.

    Each run is cut into pieces of ``spec.run`` words; seeded order puts pieces of different languages side by side.
    """
    k = len(langs)
    text = [r for _, r in runs]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in text])]).astype(np.int64)
    data, _, w = letters(np.frombuffer(b"".join(text), np.uint8), offsets)
    f = features(data, w)
    label = np.array([lang for lang, _ in runs], np.int64)[w.row]
    place = np.arange(len(w.row)) - w.first[w.row]
    piece_heads = np.flatnonzero(place % spec.run == 0)
    piece_ends = np.append(piece_heads[1:], len(label))
    table, change, trust = np.zeros((TABLE, k), np.float32), np.zeros((k, k)), np.full(k, 0.5)
    seen = [np.full(x.shape, 1e-3, x.dtype) for x in (table, change, trust)]
    rng = np.random.default_rng(spec.seed)
    one = np.eye(k)
    for _ in range(spec.epochs):
        order = rng.permutation(len(piece_heads))
        for lo in range(0, len(order), spec.batch * spec.runs):
            picked = order[lo : lo + spec.batch * spec.runs]
            spans = [np.arange(piece_heads[p], piece_ends[p]) for p in picked]
            at = np.concatenate(spans)
            counts = np.add.reduceat([len(s) for s in spans], np.arange(0, len(spans), spec.runs))
            size = (f.first[1:] - f.first[:-1])[at]
            first = np.concatenate([[0], np.cumsum(size)])
            grams = f.grams[np.repeat(f.first[:-1][at] - first[:-1], size) + np.arange(first[-1])]
            part = Features(grams, first, f.affixes[:, at], f.buckets[at])
            model = CrfModel(langs, table, change, lexicon, trust)
            got, moves = marginals(model.scores(part), counts, change, pairs=True)
            error = one[label[at]] - got
            grad = np.empty_like(table)
            for j in range(k):
                whole = np.bincount(grams, np.repeat(error[:, j], size), TABLE)
                for places in part.affixes:
                    whole += np.bincount(places, error[:, j], TABLE)
                grad[:, j] = whole
            starts = np.cumsum(counts) - counts
            pair = np.ones(len(at), bool)
            pair[starts] = False
            to = np.flatnonzero(pair)
            real = np.zeros((k, k))
            np.add.at(real, (label[at][to - 1], label[at][to]), 1.0)
            steps = (grad - spec.decay * len(at) * table, real - moves, (error * lexicon[part.buckets]).sum(axis=0))
            for value, total, step in zip((table, change, trust), seen, steps, strict=True):
                total += step * step
                value += spec.rate * step / np.sqrt(total)
    return CrfModel(langs, table, change, lexicon, trust)


def is_held_out(doc_id: Column) -> Column:
    """Documents whose CRC of the id leaves no rest when divided by 5; a null id is not one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _rows(batch: pa.RecordBatch):
    """Chunks of a batch with texts: first row, folded bytes, words."""
    data, offsets = ta.utf8(batch.column("text"))
    for lo, hi in ta.chunks(offsets):
        part = data[offsets[lo] : offsets[hi]]
        out, _, w = letters(part, offsets[lo : hi + 1] - offsets[lo])
        yield lo, out, w


def _count_words(batches):
    """(lang, bucket, n): the words of the task's texts by language and hash bucket."""

    def flush(held):
        for lang, sums in held.items():
            used = np.flatnonzero(sums)
            yield pa.RecordBatch.from_pydict(
                {"lang": pa.array([lang] * len(used), pa.string()), "bucket": pa.array(used, pa.int32()), "n": pa.array(sums[used], pa.int64())}
            )

    held: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for lo, _, w in _rows(batch):
            buckets = (ta.hashes(w) >> np.uint64(50)).astype(np.int64)
            names, code = np.unique(np.array(langs[lo : lo + len(w.first) - 1], dtype=object), return_inverse=True)
            of_word = code[w.row]
            for i, name in enumerate(names):
                if name not in held and len(held) == LANGS_HELD:
                    yield from flush(held)
                    held = {}
                sums = np.bincount(buckets[of_word == i], minlength=BUCKETS)
                held[name] = held[name] + sums if name in held else sums
    yield from flush(held)


def lexicon(labelled: DataFrame) -> DataFrame:
    """(lang, buckets, counts) over all texts of ``labelled`` (lang, text)."""
    rows = labelled.select("lang", "text").mapInArrow(_count_words, "lang string, bucket int, n long")
    sums = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    return sums.groupBy("lang").agg(F.collect_list("bucket").alias("buckets"), F.collect_list("n").alias("counts"))


def sample(labelled: DataFrame, spec: CrfSpec) -> DataFrame:
    """(lang, h, run): the folded words, at a hashed place, of the ``spec.docs`` distinct texts with the least hash per language.

    A language's texts are first thinned by their hash to a few times that number, so the ranked group is small.
    """
    rows = labelled.select("lang", "text", F.xxhash64("text", F.lit(spec.seed)).alias("h"))
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    unit = F.pmod("h", F.lit(1 << 40)) / F.lit(float(1 << 40))
    few = rows.join(F.broadcast(counts), "lang").where(unit * F.col("rows") < 4 * spec.docs)
    once = few.groupBy("lang", "h").agg(F.min(F.length("text")).alias("size"))
    ranked = once.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 40)), "h"))).where(F.col("r") <= spec.docs)
    picked = few.join(F.broadcast(ranked.select("lang", "h")), ["lang", "h"]).select("lang", "h", "text")
    length = spec.words

    def cut(batches):
        for batch in batches:
            runs = []
            hashed = batch.column("h").to_pylist()
            for lo, out, w in _rows(batch):
                for i, (a, b) in enumerate(zip(w.first[:-1], w.first[1:], strict=True)):
                    a += hashed[lo + i] % max(b - a - length + 1, 1)
                    b = min(b, a + length)
                    runs.append(out[w.starts[a] : w.ends[b - 1]].tobytes() if b > a else b"")
            yield pa.RecordBatch.from_pydict({"lang": batch.column("lang"), "h": batch.column("h"), "run": pa.array(runs, pa.binary())})

    return picked.mapInArrow(cut, "lang string, h long, run binary").dropDuplicates(["lang", "h"])


def train(docs: DataFrame, spec: CrfSpec = CrfSpec()) -> CrfModel | None:
    """The model of ``docs`` (lang, text), or None when no text has a label.

    What reaches the driver has ``BUCKETS`` counts and ``spec.docs`` runs per language, whatever the table's size.
    """
    labelled = docs.select("lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counted = {r["lang"]: r for r in stage(lexicon(labelled), "lexicon").collect()}
    runs = sorted((r["lang"], r["h"], bytes(r["run"])) for r in stage(sample(labelled, spec), "crf-sample").collect())
    langs = tuple(sorted({lang for lang, _, run in runs if run}))
    if not langs:
        return None
    sums = np.zeros((BUCKETS, len(langs)))
    for i, lang in enumerate(langs):
        if lang in counted:
            sums[counted[lang]["buckets"], i] = counted[lang]["counts"]
    odds = np.log((sums + 0.5) / (sums.sum(axis=0) + 0.5 * BUCKETS))
    odds = np.clip(odds - odds.mean(axis=1, keepdims=True), -4.0, 4.0)
    code = {lang: i for i, lang in enumerate(langs)}
    return fit(langs, odds, [(code[lang], run) for lang, _, run in runs if run], spec)


def _predict(shared):
    def run(batches):
        model: CrfModel | None = shared.value
        for batch in batches:
            texts = batch.column("text")
            lettered = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_numpy(zero_copy_only=False)
            names, best = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            for lo, out, w in _rows(batch) if model else ():
                got, _ = marginals(model.scores(features(out, w)), w.counts, model.change)
                some = np.flatnonzero(w.counts > 0)
                if len(some):
                    share = np.add.reduceat(got, w.first[some], axis=0) / w.counts[some][:, None]
                    some_best = np.round(share, 9).argmax(axis=1)
                    names[lo + some] = [model.langs[i] for i in some_best]
                    best[lo + some] = np.minimum(share[np.arange(len(some)), some_best], 1.0)
            names[~lettered], best[~lettered] = UNKNOWN, 0.0
            keys = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*keys, pa.array(names, pa.string()), pa.array(best, pa.float64())], names=[*batch.schema.names[:-1], "lang_pred", "score"]
            )

    return run


def predict(docs: DataFrame, model: CrfModel | None, keys: list[str]) -> DataFrame:
    """``keys`` of ``docs`` with lang_pred and score; only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keys, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(_predict(shared), f"{schema}, lang_pred string, score double")


def _spans(shared):
    def run(batches):
        model: CrfModel | None = shared.value
        for batch in batches:
            spans: list[list] = [[] for _ in range(batch.num_rows)]
            for lo, out, w in _rows(batch) if model else ():
                got, _ = marginals(model.scores(features(out, w)), w.counts, model.change)
                best = got.argmax(axis=1) if len(got) else np.zeros(0, int)
                begin = np.concatenate([[0], np.cumsum(w.first[1:] - w.first[:-1])])
                row_at = _row_starts(batch, lo, len(w.counts))
                for i in range(len(w.counts)):
                    mine = np.arange(begin[i], begin[i + 1])
                    if len(mine):
                        cuts = np.flatnonzero(np.diff(best[mine])) + 1
                        for part in np.split(mine, cuts):
                            spans[lo + i].append((int(w.starts[part[0]] - row_at[i]), int(w.ends[part[-1]] - row_at[i]), model.langs[best[part[0]]]))
            cells = pa.array([[{"start": a, "end": b, "lang": lang} for a, b, lang in s] for s in spans], SPANS)
            keys = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*keys, cells], names=[*batch.schema.names[:-1], "spans"])

    return run


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))


def _row_starts(batch: pa.RecordBatch, lo: int, rows: int) -> np.ndarray:
    _, offsets = ta.utf8(batch.column("text"))
    return offsets[lo : lo + rows] - offsets[lo] + np.arange(rows)


def label_words(docs: DataFrame, model: CrfModel | None, keys: list[str]) -> DataFrame:
    """``keys`` with ``spans``: stretches of words in one language, as byte positions in the UTF-8 text, end exclusive."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keys, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(_spans(shared), f"{schema}, spans array<struct<start: bigint, end: bigint, lang: string>>")


def identify_documents(docs: DataFrame, spec: CrfSpec = CrfSpec()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row; learned from labelled rows that are not held out."""
    known = docs.select("doc_id", "lang", "text").where(F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    rows = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(rows, train(known, spec), ["doc_id", "held_out"])

