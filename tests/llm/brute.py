"""Plain Python versions of the operators, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def sha(text) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def words(text, lower=False):
    text = text or ""
    return WORD.findall(text.translate(LOWER) if lower else text)


def counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    w, text = words(text), text or ""
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(8)}
    lines = [line for line in text.split("\n") if words(line)]
    dup = len(lines) - len(set(lines))
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def lm_base(rows):
    """Per row: held_out, n_tokens, n_known, train_tokens, base_score."""
    held = [id is not None and zlib.crc32(str(id).encode()) % 7 == 2 for id, _ in rows]
    tokens = [[*words(t, True), None] for _, t in rows]
    c = Counter(x for h, ts in zip(held, tokens) if not h for x in ts)
    total, distinct = sum(c.values()), len(c)
    return [
        (h, len(ts), sum(c[x] > 0 for x in ts), total, sum(math.log10((c[x] + 1) / (total + distinct + 1)) for x in ts))
        for h, ts in zip(held, tokens)
    ]


def shingle_set(text):
    w = words(text, True)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(rows, percent):
    """(n_shingles, component_id) per row of (doc_id, text)."""
    sets = [shingle_set(t) for _, t in rows]
    parent = {id: id for id, _ in rows if id is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows[:i]):
            if a is None or b is None or not sets[i] or not sets[j]:
                continue
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [(len(s), None if id is None else find(id)) for (id, _), s in zip(rows, sets)]


def repeats(rows, length=50):
    """(n_bytes, n_removed, n_spans, kept_sha256) per row; a null id is after all others."""
    data = [(math.inf if id is None else id, (t or "").encode()) for id, t in rows]
    first = {}
    for id, b in data:
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            first[s] = min(id, first.get(s, math.inf))
    out = []
    for id, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < id:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1])), sha(kept)))
    return out


def lm_scores(rows, weight=0.7):
    """log10 probability of every text under the bigram model with counts kept as powers of two, without a filter."""
    held = [id is not None and zlib.crc32(str(id).encode()) % 7 == 2 for id, _ in rows]
    tokens = [[*words(t, True), None] for _, t in rows]
    one, two = Counter(), Counter()
    for h, ts in zip(held, tokens):
        if not h:
            one.update(ts)
            two.update(zip([None, *ts], ts))
    total, distinct = sum(one.values()), len(one)
    middle = lambda c: 1.5 * 2 ** math.floor(math.log2(c)) - 0.5 if c else 0.0
    out = []
    for ts in tokens:
        s = 0.0
        for v, w in zip([None, *ts], ts):
            a, b = middle(two[v, w]), middle(one[v])
            joint = min(a / b, 1.0) if b else 0.0
            s += math.log10(weight * joint + (1 - weight) * (middle(one[w]) + 1) / (total + distinct + 1))
        out.append((len(ts), s))
    return out
