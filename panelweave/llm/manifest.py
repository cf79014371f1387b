"""Merkle manifest of a dataset: a digest per row, a tree per source, a tree of the sources, and a proof per row.

Nodes are labelled with the interval of leaf ranks that they cover.  A level is built from the one below by grouping 16
neighbours; a node then finds its parent by a join on the level's bucket (first rank divided by the span of that level)
and containment of the intervals, and what the parent covers before and after it are its siblings.  A parent has at most 16
children, so no join key and no group is larger than that, whatever a source holds.

Ranks need no sort of a whole source in one task: rows are range-partitioned by (source, doc_id, leaf), numbered inside
their range, and the ranges' counts are summed up per source.

Nulls: a null field is `-` in the leaf; the null source is a source of its own and comes first; null ids come first in
their source, ordered by leaf, and are never tampered with.  Empty texts are `0:`.  Repeated rows are leaves of their own,
side by side.  Equal ids are ordered by leaf.  An empty table has no rows and no root.  Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.sources.staging import stage

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(c: Column) -> Column:
    """`-` for null, else the number of bytes, a colon and the value."""
    text = c.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def joined(digests: Column) -> Column:
    return F.concat_ws("", digests)


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (a stored table with ``tree``) with ``rank``, from 0 inside the tree, and ``n``, the tree's rows.

    The place in the file is the last sort key, so that even a large group of equal rows is dealt over many ranges.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["tree", *order, "__at", "__file"]
    placed = rows.select("*", F.col("_metadata.row_index").alias("__at"), F.col("_metadata.file_name").alias("__file"))
    placed = placed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("__at", "__file")
    pos = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    stored = stage(placed.withColumns({"range": F.spark_partition_id(), "pos": pos}), "ranges")
    counts = stored.groupBy("tree", "range").agg(F.count(F.lit(1)).alias("c"), F.min("pos").alias("first"))
    tree = Window.partitionBy("tree")
    before = F.sum("c").over(tree.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(
        F.col("tree").alias("__tree"), F.col("range").alias("__range"),
        (F.coalesce(before, F.lit(0)) - F.col("first")).alias("__shift"), F.sum("c").over(tree).alias("n"),
    )
    same = F.col("tree").eqNullSafe(F.col("__tree")) & (F.col("range") == F.col("__range"))
    return stored.join(starts, same).withColumn("rank", F.col("pos") + F.col("__shift")).drop("__tree", "__range", "__shift", "range", "pos")


@dataclass(frozen=True)
class Tree:
    """``levels[i]``: the nodes of level i + 1, as (tree, n, lo, hi, digest, children); ``tops``: one node per tree.

    A tree of a single leaf has one node of level 1 that carries the leaf's own digest.
    """

    levels: list[DataFrame]
    tops: DataFrame


def nodes_at(level: int) -> Column:
    """Number of the tree's nodes at a level, from its number of leaves."""
    return F.expr(f"(n + {FAN**level - 1}) div {FAN**level}")


def build(leaves: DataFrame, order: list[str], payload: list[str]) -> Tree:
    """The trees over ``leaves`` (stored; tree, digest, ``payload``), each in the order of ``order``."""
    rows = ranked(leaves, order).withColumns({"lo": F.col("rank"), "hi": F.col("rank") + 1}).drop("rank")
    levels, extra = [], payload
    while True:
        level = len(levels) + 1
        child = F.struct("lo", "hi", "digest", *extra)
        runs = rows.groupBy("tree", F.expr(f"lo div {FAN**level}").alias("bucket")).agg(
            F.first("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.array_sort(F.collect_list(child)).alias("children")
        )
        whole = F.sha2(joined(F.col("children.digest")), 256)
        digest = F.when(F.col("n") == 1, F.element_at("children", 1)["digest"]).otherwise(whole)
        levels.append(stage(runs.select("tree", "n", "lo", "hi", digest.alias("digest"), "children"), "merkle"))
        rest = levels[-1].where(nodes_at(level) > 1)
        if not rest.take(1):
            break
        rows, extra = rest.drop("children"), []
    tops = [nodes.where(nodes_at(i + 1) == 1).select("tree", "digest") for i, nodes in enumerate(levels)]
    top = tops[0]
    for more in tops[1:]:
        top = top.unionByName(more)
    return Tree(levels, top)


def step(children: Column, lo: Column, hi: Column) -> Column:
    """The siblings of the child [lo, hi): what its parent covers before and after that interval."""
    left = F.filter(children, lambda c: c["hi"] <= lo)
    right = F.filter(children, lambda c: c["lo"] >= hi)
    return F.struct(
        joined(F.transform(left, lambda c: c["digest"])).alias("left"), joined(F.transform(right, lambda c: c["digest"])).alias("right")
    )


def leaf_paths(tree: Tree, above: DataFrame, payload: list[str]) -> DataFrame:
    """One row per leaf: tree, digest, ``payload``, and ``steps``, its siblings from the run of leaves up to the root.

    ``above`` has (tree, steps) for the steps beyond a tree's top and further columns, which are passed on.
    """
    more = [c for c in above.columns if c not in ("tree", "steps")]
    above = above.select(F.col("tree").alias("__tree"), "steps", *more)
    known = None
    for i in reversed(range(len(tree.levels))):
        nodes, level = tree.levels[i], i + 1
        top = nodes.where(nodes_at(level) == 1).join(above, F.col("tree").eqNullSafe(F.col("__tree"))).drop("__tree")
        if known is not None:
            span = FAN ** (level + 1)
            parent = known.select(
                F.col("tree").alias("__tree"), F.expr(f"lo div {span}").alias("__bucket"), F.col("lo").alias("__lo"), F.col("hi").alias("__hi"),
                F.col("children").alias("__children"), "steps", *more,
            )
            inside = (
                F.col("tree").eqNullSafe(F.col("__tree")) & (F.expr(f"lo div {span}") == F.col("__bucket"))
                & (F.col("__lo") <= F.col("lo")) & (F.col("hi") <= F.col("__hi"))
            )
            own = F.array(step(F.col("__children"), F.col("lo"), F.col("hi")))
            lower = nodes.where(nodes_at(level) > 1).join(parent, inside)
            top = top.unionByName(lower.withColumn("steps", F.concat(own, F.col("steps"))).select(*top.columns))
        known = top
    leaf = known.select("tree", "n", "children", "steps", *more, F.explode("children").alias("leaf"))
    own = F.array(step(F.col("children"), F.col("leaf.lo"), F.col("leaf.hi")))
    steps = F.when(F.col("n") == 1, F.col("steps")).otherwise(F.concat(own, F.col("steps")))
    return leaf.select("tree", "leaf.digest", *[f"leaf.{c}" for c in payload], steps.alias("steps"), *more)


def folded(start: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(steps, start, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def tampered(columns: dict[str, Column]) -> Column:
    """The digest of a row whose text lost its capitals A-Z, where 5 divides the CRC of its id; else null."""
    changed = {**columns, "text": F.translate(columns["text"], UPPER, LOWER)}
    hit = F.crc32(columns["doc_id"].cast("string").cast("binary")) % 5 == 0
    return F.when(hit, leaf_digest(list(changed.values())))


def manifest(docs: DataFrame, claimed: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row.

    ``claimed`` is the leaf that a holder presents for checking, or null for the row's own; by default the one of
    ``tampered``.  ``verified`` tells whether it folds to the root with the original siblings.
    """
    columns = {c: F.col(c) for c in FIELDS}
    claim = tampered(columns) if claimed is None else claimed
    leaves = stage(docs.select(F.col("source").alias("tree"), "doc_id", leaf_digest(list(columns.values())).alias("digest"), claim.alias("claim")), "leaves")
    sources = build(leaves, ["doc_id", "digest"], ["doc_id", "claim"])
    subroots = stage(sources.tops.select(F.lit(0).alias("tree"), F.col("tree").alias("source"), "digest"), "subroots")
    whole = build(subroots, ["source"], ["source"])
    end = whole.tops.select("tree", F.col("digest").alias("root"), F.expr("cast(array() as array<struct<left: string, right: string>>)").alias("steps"))
    above = leaf_paths(whole, end, ["source"]).select(F.col("source").alias("tree"), "steps", F.col("digest").alias("subroot"), "root")
    paths = leaf_paths(sources, above, ["doc_id", "claim"])
    proof = F.sha2(joined(F.transform("steps", lambda s: F.concat(s["left"], s["right"]))), 256)
    fold = folded(F.coalesce("claim", "digest"), F.col("steps"))
    out = paths.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), fold.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
