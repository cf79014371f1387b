"""Line-first cleaning: rules judge each line, failing lines go, documents that lose too much go too.

A line is a ``\\n``-separated part of the text.  Lines without a word (``[^\\x20\\x09-\\x0D]+``) are neutral: they
are kept and no rule sees them.  The other lines are judged by three rules:

* navigation: at least ``nav_marks`` separator characters (``|``, ``»``, ``›``), at least one to every three words;
* boilerplate: one of ``BOILERPLATE`` occurs in the line, case aside (A-Z), and the line has at most
  ``boilerplate_words`` words;
* punctuation: more than ``loose_words`` words and no ``. ! ? : ; …``, quotation mark or closing bracket at the end;
  or more than one fifth of the words end in a symbol of ``# * $ % & | < >``.

A document is kept when the base rules pass and the lines that remain hold at least ``keep_share`` percent of the
words.  Null and empty texts have no words: all counts are 0, the base rules fail and the document is not kept.
Repeated rows are judged alike, each for itself; other columns are passed over.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Phrases of the boilerplate rule, in lower case.
BOILERPLATE = (
    "accept all cookies",
    "all rights reserved",
    "click here to",
    "cookie policy",
    "enable javascript",
    "log in to continue",
    "privacy policy",
    "share on facebook",
    "sign up for our newsletter",
    "skip to content",
    "subscribe to our",
    "terms of service",
    "terms of use",
)
NAV_MARKS = ("|", "»", "›")
SYMBOLS = "#*$%&|<>"
ENDINGS = (".", "!", "?", ":", ";", "…", '"', "'", "”", "’", "»", ")", "]", "}")

# Texts are judged as UTF-8: ``bytes.split()`` cuts at exactly the six characters that end a word.
_BLANKS = " \t\n\v\f\r"
_MARKS = [m.encode() for m in NAV_MARKS]
_ENDS = tuple(e.encode() for e in ENDINGS)
_SYMBOL_END = re.compile(rb"[#*$%&|<>](?=[\x20\x09-\x0D]|\Z)")
_PHRASE = re.compile("|".join(map(re.escape, BOILERPLATE)).encode())


@dataclass(frozen=True)
class LineRules:
    """The line rules' thresholds and the share of words, in percent, that must remain."""

    nav_marks: int = 3
    boilerplate_words: int = 40
    loose_words: int = 30
    keep_share: int = 50


def line_fails(line: bytes, n_words: int, rules: LineRules) -> str | None:
    """The name of the first rule that a line with ``n_words`` words fails."""
    marks = sum(map(line.count, _MARKS))
    if marks >= rules.nav_marks and 3 * marks >= n_words:
        return "navigation"
    if n_words <= rules.boilerplate_words and _PHRASE.search(line.lower()):
        return "boilerplate"
    if n_words > rules.loose_words and not line.rstrip().endswith(_ENDS):
        return "punctuation"
    if 5 * len(_SYMBOL_END.findall(line)) > n_words:
        return "punctuation"
    return None


def repeated_window_words(tokens: list[bytes], length: int = 8) -> int:
    """Words covered by a window of ``length`` words that occurs at least twice; overlaps count.

    Windows are named by doubling: pairs of equal word numbers get one number, then pairs of pairs.
    """
    n = len(tokens) - length + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    name = np.fromiter((numbers.setdefault(t, len(numbers)) for t in tokens), np.int64, len(tokens))
    step = 1
    while step < length:
        name = name[:-step] * (len(tokens) + 1) + name[step:]
        name = np.unique(name, return_inverse=True)[1]
        step *= 2
    twice = np.bincount(name)[name] > 1
    edge = np.zeros(len(tokens) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length, -1)
    return int(np.count_nonzero(np.cumsum(edge)[:-1]))


def judge(text: str | None, rules: LineRules) -> tuple:
    """Counts, verdicts and cleaned text of one document, in the order of ``FIELDS``."""
    text = text or ""
    data = text.encode()
    tokens = data.split()
    n_words, n_symbols = len(tokens), sum(map(text.count, SYMBOLS))
    n_repeat = repeated_window_words(tokens)
    seen: set[bytes] = set()
    dup, lost, kept_lines, failed = 0, 0, [], Counter()
    for line in data.split(b"\n"):
        in_line = len(line.split())
        if not in_line:
            kept_lines.append(line)
            continue
        if line in seen:
            dup += 1
        seen.add(line)
        rule = line_fails(line, in_line, rules)
        if rule:
            lost += in_line
            failed[rule] += 1
        else:
            kept_lines.append(line)
    base_failed = n_words < 20 or 100 * n_repeat > 30 * n_words
    kept = not base_failed and 100 * (n_words - lost) >= rules.keep_share * n_words
    return (
        n_words, len(text) - sum(map(text.count, _BLANKS)), n_symbols, dup, n_repeat, base_failed, kept,
        sum(failed.values()), failed["navigation"], failed["boilerplate"], failed["punctuation"], lost,
        b"\n".join(kept_lines).decode(),
    )


FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, n_failed_lines long, n_navigation long, n_boilerplate long, n_punctuation long, n_lost_words long, "
    "clean_text string"
)
_ARROW = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 5 + [pa.string()]
NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def judge_documents(
    docs: DataFrame, rules: LineRules = LineRules(), id: str = "doc_id", text: str = "text", with_text: bool = False
) -> DataFrame:
    """One row per input row: its id, the counts, ``base_failed``, ``kept`` and the lines lost to each rule.

    ``with_text`` adds ``clean_text``, the text without the failing lines.  Each row is judged by itself in
    the scan's own partitions: nothing is shuffled.
    """
    names = NAMES if with_text else NAMES[:-1]
    narrow = docs.select(docs[id].alias("doc_id"), docs[text].alias("text"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                rows = [judge(t.as_py(), rules)[: len(names)] for t in part.column(1)]
                columns = list(zip(*rows, strict=True))
                arrays = [pa.array(c, t) for c, t in zip(columns, _ARROW, strict=False)]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=[id, *names])

    fields = ", ".join(f for f, n in zip(FIELDS.split(", "), NAMES, strict=True) if n in names)
    return narrow.mapInArrow(run, f"{id} {id_type}, {fields}")


def clean_documents(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """Documents that are kept, with their failing lines removed and ``n_chars`` counted anew.

    The columns, their order and their types are those of ``docs``; a column ``n_chars`` may be missing.
    """
    fields = docs.schema
    at_text, at_chars = fields.names.index("text"), fields.names.index("n_chars") if "n_chars" in fields.names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                rows = [judge(t.as_py(), rules) for t in part.column(at_text)]
                keep = pa.array([i for i, r in enumerate(rows) if r[6]], pa.int32())
                part, rows = part.take(keep), [r for r in rows if r[6]]
                columns = part.columns
                columns[at_text] = pa.array([r[-1] for r in rows], columns[at_text].type)
                if at_chars is not None:
                    columns[at_chars] = pa.array([len(r[-1]) for r in rows], pa.int64()).cast(columns[at_chars].type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(run, fields)
