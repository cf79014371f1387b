"""Mixing sources to target weights by weighted sampling without replacement (Efraimidis and Spirakis).

Every document gets the key ``-ln(u) / quality`` with a ``u`` in (0, 1) hashed from seed and id.  Sources are put in
code point order, null last, and weigh ``weights`` in turn; they share the sum of all sizes.  A target stops at
``most`` times its source's size and the excess is shared anew.  A source first gives its complete epochs
(``floor(target / size)`` times every document) and then, in ascending key order, the documents whose middle word lies
within the words still missing.

The order is never made for a whole source.  Keys fall into buckets on a logarithmic scale, of which none holds more
than a small share of a source whatever the weights; bucket sizes are summed first, and only the one bucket per
source in which the budget ends is sorted.

The sums of a source's buckets are added up in one window group: ``buckets_per_octave`` times the octaves that keys span,
some hundred thousand rows at most, however many documents there are.  Rows that are equal in id and text count as one group
there and in the sorted bucket, with their number, so even a source of copies is a few rows.

Null text, and text without words, has size 0 and is taken 0 times; it may belong to any source.  A null id has the key
of its text.  Equal keys (repeated rows) are ordered by id and size, so identical rows are interchangeable and the result
is the same in every run.  A source without words has target 0.  An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.llm.attach import attach
from panelweave.sources.staging import stage

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """Weights dealt to the ordered sources in turn, the largest number of epochs, the seed of the keys."""

    weights: tuple[int, ...] = (5, 2, 1)
    most: int = 3
    seed: str = "mix-1"
    buckets_per_octave: int = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column, size: Column) -> Column:
    """Words per word or stray symbol: 1 for plain prose, less the more of ``#*$%&|<>`` there is."""
    symbols = F.coalesce(F.length(text) - F.length(F.translate(text, "#*$%&|<>", "")), F.lit(0))
    return (size + 1) / (size + 1 + symbols)


def uniform(seed: str, id: Column, text: Column) -> Column:
    """A number in (0, 1) from the first 48 bits of an MD5 digest of the id, or of the text where that is null."""
    nameless = F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id.cast("string"), nameless)))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def ranked(table: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``table`` with its row number in ``order`` from 0, by a distributed sort and one count per partition."""
    at = stage(table.sort(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33)
    counts = at.groupBy(part.alias("_part")).count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_before"))
    row = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return at.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(name, row).drop("_at", "_part", "_before")


def targets(sources: DataFrame, mix: Mix) -> DataFrame:
    """``sources`` (source, source_size) with ``target``; one aggregation per round of resharing."""
    weight = F.element_at(F.array(*map(F.lit, mix.weights)), (F.col("_rank") % len(mix.weights) + 1).cast("int"))
    order = [F.col("source").isNull(), F.col("source")]
    table = stage(ranked(sources, order, "_rank").withColumn("_weight", weight).drop("_rank"), "sources")
    cap, total, level, capped = F.col("source_size") * mix.most, None, None, -1
    while True:
        full = F.lit(False) if level is None else F.col("_weight") * F.lit(level) >= cap
        got = table.agg(
            F.sum("source_size").alias("total"), F.sum(F.when(full, cap)).alias("fixed"),
            F.sum(F.when(~full, F.col("_weight"))).alias("weight"), F.count(F.when(full, 1)).alias("full"),
        ).first()
        total = got["total"] or 0
        if got["full"] == capped or not got["weight"]:
            break
        capped, level = got["full"], (total - (got["fixed"] or 0)) / got["weight"]
    return table.select("source", "source_size", F.least(F.col("_weight") * F.lit(level or 0.0), cap.cast("double")).alias("target"))


def with_sources(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Attach the columns of ``sources``; one source may have most of the documents."""
    return attach(docs, sources, "source", F.col("doc_id"), "inner")


def _keyed(docs: DataFrame, mix: Mix, *kept: Column) -> DataFrame:
    """doc_id, source, size, _tie (a hash of the text), _key and the columns ``kept``."""
    size, text = n_words(docs["text"]), docs["text"]
    key = -F.log(uniform(mix.seed, docs["doc_id"], text))
    sized = docs.select(docs["doc_id"], docs["source"], size.alias("size"), F.xxhash64(text).alias("_tie"), quality(text, size).alias("_quality"), key.alias("_log"), *kept)
    return sized.withColumn("_key", F.col("_log") / F.col("_quality")).drop("_quality", "_log")


def _bucketed(keyed: DataFrame, mix: Mix) -> DataFrame:
    return keyed.withColumn("_bucket", F.floor(F.log2("_key") * mix.buckets_per_octave))


def _plan(scored: DataFrame, mix: Mix) -> DataFrame:
    """Per source: size, target, complete epochs, words still missing, and the bucket in which they end."""
    filled = scored.groupBy("source", "_bucket").agg(F.sum("size").alias("_words"))
    aims = stage(targets(scored.groupBy("source").agg(F.sum("size").alias("source_size")), mix), "mix-targets")
    aims = aims.withColumn("_epochs", F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)))
    aims = aims.withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size"))
    upto = F.sum("_words").over(Window.partitionBy("source").orderBy("_bucket"))
    steps = with_sources(filled.withColumn("_upto", upto).withColumn("doc_id", F.col("_bucket")), aims)
    ends = steps.filter((F.col("_upto") > F.col("_rest")) & (F.col("_upto") - F.col("_words") <= F.col("_rest")))
    ends = ends.select(F.col("source").alias("_s"), F.col("_bucket").alias("_end"), (F.col("_upto") - F.col("_words")).alias("_before"))
    return stage(aims.join(ends, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s"), "mix-plan")


def _whole(placed: DataFrame) -> DataFrame:
    """Rows outside the last bucket of their source, with their number of copies."""
    more = F.when(F.col("_bucket") < F.col("_end"), 1).otherwise(0)
    out = placed.filter(F.col("_end").isNull() | (F.col("_bucket") != F.col("_end")))
    return out.withColumn("copies", F.col("_epochs") + F.coalesce(more, F.lit(0)))


def _edge(placed: DataFrame) -> DataFrame:
    """The last buckets' groups of rows with one id and text: their number ``_rows``, and ``_more``, how many of them are
    taken once more because their middle word is within the words missing."""
    about = ["_before", "_rest", "_epochs", "source_size", "target"]
    same = placed.filter(F.col("_bucket") == F.col("_end")).groupBy("source", "_key", "doc_id", "_tie", "size").agg(
        F.count(F.lit(1)).alias("_rows"), *[F.first(c).alias(c) for c in about]
    )
    order = Window.partitionBy("source").orderBy("_key", "doc_id", "size", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    words = F.col("_rows") * F.col("size")
    left = F.col("_rest") - (F.col("_before") + F.sum(words).over(order) - words)
    fit = F.when(F.col("size") == 0, F.when(left >= 0, F.col("_rows")).otherwise(0)).otherwise(F.floor((2 * left + F.col("size")) / (2 * F.col("size"))))
    return same.withColumn("_more", F.least(F.greatest(fit, F.lit(0)), F.col("_rows")).cast("long"))


def _times(df: DataFrame, n: str, name: str) -> DataFrame:
    """Every row ``n`` times, numbered from 1, in steps of short lists."""
    step = 4096
    blocks = df.filter(F.col(n) > 0).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({n} - 1) div {step}"))))
    first = F.col("_block") * step + 1
    return blocks.withColumn(name, F.explode(F.sequence(first, F.least(first + step - 1, F.col(n))))).drop("_block")


def mix_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken (words, repeats counted), copies."""
    scored = _bucketed(stage(_keyed(docs, mix), "mix-keys"), mix)
    placed = with_sources(scored, _plan(scored, mix))
    edge = _times(_edge(placed), "_rows", "_number").withColumn("copies", F.col("_epochs") + (F.col("_number") <= F.col("_more")).cast("int"))
    names = ["doc_id", "size", "source_size", "target", "copies"]
    both = _whole(placed).select(*names).unionByName(edge.select(*names))
    return both.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), F.col("copies").cast("long").alias("copies"))


def mixed_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with the columns of ``docs``.

    Documents without words are in no budget and left out.  Only rows of the last buckets are looked up, by id and text; what
    a group of such rows is given there is dealt out among its rows, which may differ in other columns.
    """
    scored = _bucketed(stage(_keyed(docs, mix), "mix-keys"), mix)
    plan = _plan(scored, mix)
    names = ["source", "doc_id", "_tie", "size"]
    edge = stage(_edge(with_sources(scored, plan)).select(*[F.col(c).alias(f"_e{c}") for c in names], "_more"), "mix-edge")
    placed = with_sources(_bucketed(_keyed(docs, mix, F.struct(*[docs[c] for c in docs.columns]).alias("_row")), mix), plan)
    at_end = placed.filter(F.col("_bucket") == F.col("_end"))
    distinct = at_end.groupBy(*names, "_row").agg(F.count(F.lit(1)).alias("_rows"), F.first("_epochs").alias("_epochs"))
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"_e{c}"))
    before = F.sum("_rows").over(Window.partitionBy(*names).orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_rows")
    dealt = distinct.withColumn("_dealt", before).join(edge, same)
    more = F.greatest(F.least(F.col("_more") - F.col("_dealt"), F.col("_rows")), F.lit(0))
    looked_up = dealt.withColumn("copies", F.col("_epochs") * F.col("_rows") + more).select("_row", "size", "copies")
    both = _whole(placed).select("_row", "size", "copies").unionByName(looked_up).filter("size > 0 and copies > 0")
    return _times(both.withColumn("copies", F.col("copies").cast("long")), "copies", "_number").select("_row.*")
