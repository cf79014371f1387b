"""Secret scans over an incremental blob ledger.

A blob is a distinct text, named by its SHA-256.  The ledger, a Parquet folder, has one row per blob and rule version
that was ever scanned, with the spans found.  A scan names the blobs of its documents, keeps those the ledger does not
have under the current rule version, scans each once, appends them, and joins the findings back to every document
(path or version) with that text.  A rerun, or a run over a table that mostly repeats, scans only what is new.

Spans count code points, end exclusive; per kind they are leftmost and do not overlap, kinds may overlap each other.
Null text is the empty text, which has no spans.  Repeated rows get one result row each; other columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.sources.staging import new_path

SPANS = "array<struct<kind:string,start:int,end:int>>"
#: Known blob names up to this many (about 100 bytes each) are broadcast to filter documents before any text is shuffled.
BROADCAST_SEEN = 200_000
#: Findings of up to this many bytes (100 a blob, 40 a span) are broadcast to the documents to be redacted.
BROADCAST_DIRTY = 32_000_000


@dataclass(frozen=True)
class Rule:
    """A pattern whose matches count when group ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


# The patterns of the base kinds, then those this scan adds; spans are listed in this order.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
# A private key runs to its END line, or without one to its last base64 line, which may be short; lines may be escaped,
# quoted or prefixed.
_BREAK = r"""(?:\\+[nrt]|<br ?/?>|[\x20\t\r\n"'`,;>#|*-])*"""
_HEADER = r"[A-Z][A-Za-z-]{0,40}:[^\n\\]*(?:\n|\\+[nr])"
_LAST = r"""[A-Za-z0-9+/]{1,19}(?:={1,2}|(?m:$)|[\r\\"'`<])"""
_LINES = rf"(?:(?:{_BREAK}{_HEADER})*(?:{_BREAK}[A-Za-z0-9+/]{{20,}}={{0,2}})+(?:{_BREAK}{_LAST})?)?"
ADDED = (
    Rule("pem", rf"-----BEGIN [A-Z ]{{0,40}}PRIVATE KEY-----(?:[^-]*(?:-{{1,4}}[^-]+)*-{{5,}}END [A-Z ]{{0,40}}PRIVATE KEY-----|{_LINES})"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("login", r"[a-z]{2,10}://[^\s/:@]+:([^\s/:@]{6,})@", 1, 6),
)
RULES = BASE + ADDED
VERSION = "rules-3"
# The same matches in linear time.  A run of hexadecimal digits that is too short can be skipped: the next match starts
# after it either way.  A token is sought only in runs that two more parts follow; it begins at ``s``.
_FAST = {
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}",
    "jwt": r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]{11,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8})[A-Za-z0-9_-]*?"
    r"(?P<s>)eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++",
}


def find_spans(text: str, patterns: list[tuple[Rule, re.Pattern]]) -> list[tuple[str, int, int]]:
    """All spans of ``text``, ordered by start and then by kind as listed."""
    found = []
    for at, (rule, pattern) in enumerate(patterns):
        first = "s" if "s" in pattern.groupindex else 0
        for m in pattern.finditer(text):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                found.append((m.start(first), at, m.end()))
    found.sort()
    return [(patterns[at][0].kind, start, end) for start, at, end in found]


def compile_rules(rules: tuple[Rule, ...]) -> list[tuple[Rule, re.Pattern]]:
    return [(r, re.compile(_FAST[r.kind], re.ASCII) if r in RULES and r.kind in _FAST else r.compiled()) for r in rules]


def blob_name(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


class BlobLedger:
    """Findings per (blob, rule version), in a folder every executor reaches."""

    def __init__(self, spark: SparkSession, path: str | None = None, rules: tuple[Rule, ...] = RULES, version: str = VERSION):
        self.spark, self.rules, self.version = spark, rules, version
        self.path = path or new_path(spark, "blob-ledger")

    def entries(self) -> DataFrame | None:
        """Every row ever written, or None when the ledger is new."""
        try:
            return self.spark.read.schema(f"blob string, version string, spans {SPANS}").parquet(self.path)
        except AnalysisException as err:
            if err.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def scan(self, docs: DataFrame, text: str = "text") -> None:
        """Scan the blobs of ``docs`` that have no row under this rule version, and append their rows."""
        named = docs.select(blob_name(docs[text]).alias("blob"), F.coalesce(docs[text], F.lit("")).alias("_text"))
        known = self.entries()
        known = None if known is None else known.filter(F.col("version") == self.version).select("blob").distinct()
        small = known is not None and known.count() <= BROADCAST_SEEN
        if small:
            named = named.join(F.broadcast(known), "blob", "left_anti")
        blobs = named.groupBy("blob").agg(F.first("_text").alias("_text"))
        if known is not None and not small:
            blobs = blobs.join(known, "blob", "left_anti")
        rules, version = self.rules, self.version

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            patterns = compile_rules(rules)
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            for batch in batches:
                spans = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in find_spans(t.as_py(), patterns)] for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([version] * len(spans), pa.string()), pa.array(spans, kind)],
                    names=["blob", "version", "spans"],
                )

        scanned = blobs.select("blob", "_text").mapInArrow(run, f"blob string, version string, spans {SPANS}")
        scanned.write.mode("append").parquet(self.path)

    def findings(self) -> DataFrame:
        """Blobs with at least one span under this rule version, once each."""
        rows = self.entries().filter((F.col("version") == self.version) & (F.size("spans") > 0))
        return rows.dropDuplicates(["blob"]).select("blob", "spans")


def scan_documents(docs: DataFrame, ledger: BlobLedger, text: str = "text") -> DataFrame:
    """``docs`` with ``blob`` and ``spans`` (empty when clean); only unseen blobs are scanned."""
    ledger.scan(docs, text)
    found = ledger.findings().withColumnRenamed("blob", "_blob").withColumnRenamed("spans", "_spans")
    named = docs.withColumn("blob", blob_name(docs[text]))
    joined = named.join(found, F.col("blob") == F.col("_blob"), "left").drop("_blob")
    return joined.withColumn("spans", F.coalesce("_spans", F.array().cast(SPANS))).drop("_spans")


def listed(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, ledger: BlobLedger, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span, merged where spans overlap, replaced by ``mask``; ``n_chars`` counted anew.

    Columns, order and types stay those of ``docs``.  A null text stays null.
    """
    ledger.scan(docs)
    dirty = ledger.findings().select(F.col("blob").alias("__found"), F.col("spans").alias("__spans"))
    held = dirty.agg(F.sum(F.lit(100) + 40 * F.size("__spans"))).first()[0] or 0
    dirty = F.broadcast(dirty) if held <= BROADCAST_DIRTY else dirty
    named = docs.withColumn("__blob", blob_name(docs["text"]))
    joined = named.join(dirty, F.col("__blob") == F.col("__found"), "left")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for t, spans in zip(batch.column(at), batch.column(batch.num_columns - 1), strict=True):
                value, spans = t.as_py(), spans.as_py()
                if value is not None and spans:
                    parts, end = [], 0
                    for s in spans:
                        if s["start"] >= end:
                            parts += [value[end : s["start"]], mask]
                        end = max(end, s["end"])
                    value = "".join([*parts, value[end:]])
                texts.append(value)
            columns = batch.columns[:-1]
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    out = joined.select(*docs.columns, "__spans").mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
