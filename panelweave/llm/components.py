"""Connected components of an edge table, by alternating large and small stars.

A large star hangs a node's larger neighbours on the least neighbour, a small star does the same for the smaller ones;
after a logarithmic number of rounds every node hangs on the least node of its component.  A round is two joins on
aggregates with a map-side combine, written to the shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from panelweave.sources.staging import new_path


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a, b) with a > b after one star operation."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        moved = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        moved = moved.unionByName(least.select("a", F.col("m").alias("b")))
    return moved.filter("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its least node.

    Nodes may be of any ordered type.  Order, direction and repeats of the edges do not matter; loops and edges with a null end are left out.
    """
    spark = edges.sparkSession
    greater, lesser = F.greatest("a", "b"), F.least("a", "b")
    table = edges.filter("a is not null and b is not null and a != b").select(greater.alias("a"), lesser.alias("b")).distinct()
    before = None
    while True:
        seen, path = Observation(), new_path(spark, "stars")
        mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        table.observe(seen, F.count(F.lit(1)).alias("n"), mark.alias("h")).write.parquet(path)
        now = (seen.get["n"], seen.get["h"])
        table = spark.read.schema(table.schema).parquet(path)
        if now == before or not now[0]:
            break
        before = now
        table = _stars(_stars(table, True), False)
    return table.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        table.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
