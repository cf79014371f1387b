"""MinHash near-dedup on b-bit signatures.

Only the low bits of the minima are kept, packed into words; similarity is estimated by bit counts and corrected for
chance agreement after bands have proposed clusters, and links are confirmed on the full shingle sets
(``near_links`` has the steps and their bounds).  Linked documents form components; the least id of each is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.near_links import NearSpec, near_components
from panelweave.sources.staging import stage

#: Ids and text hashes of up to this many dropped documents are broadcast to the documents (16 bytes each).
BROADCAST_DROPPED = 1_000_000


def deduplicate(docs: DataFrame, spec: NearSpec = NearSpec()) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept (the row's id is its component's least id).

    Null and wordless texts are linked with nothing and kept.  A null doc_id is linked with nothing and kept.
    """
    out = near_components(docs, spec).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, spec: NearSpec = NearSpec()) -> DataFrame:
    """``docs`` with one document of every component: the one with the least id, and of its texts one with the first set.

    Rows go by (doc_id, text), so another text under the same id stays when it is no copy.  Rows that repeat both are one.
    """
    stands = F.col("first") & (F.col("doc_id") == F.col("component_id"))
    full = near_components(docs, spec).filter("doc_id is not null and digest is not null")
    judged = stage(full.select("doc_id", "tie", "digest", stands.alias("kept")), "judged")
    copies = judged.filter("not kept").select("doc_id", "tie")
    # texts of one id with equal sets: the one with the least hash stays
    same = judged.filter("kept").groupBy("doc_id", "digest").agg(F.min("tie").alias("least"), F.max("tie").alias("most")).filter("least <> most")
    also = judged.join(same, ["doc_id", "digest"]).filter("tie <> least").select("doc_id", "tie")
    dropped = stage(copies.unionByName(also).distinct(), "dropped").withColumnsRenamed({"doc_id": "__id", "tie": "__tie"})
    if dropped.count() <= BROADCAST_DROPPED:
        dropped = F.broadcast(dropped)
    kept = docs.join(dropped, (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__tie")), "left_anti")
    repeated = docs.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id")
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    again = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(repeated, "doc_id", "left_anti").unionByName(again).select(*docs.columns)
