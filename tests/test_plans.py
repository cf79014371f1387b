"""Physical plans: pushdown, shuffles, no Python where none is needed."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from panelweave.functions import timegrid as TG
from panelweave.operators import series, splits
from panelweave.plans import retail
from panelweave.sources.staging import stage
from panelweave.workloads import standins as S
from panelweave.workloads.queries import QUERIES

PYTHON = {"group_apply", "predict_external_model"}


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "2000")
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", ["trajectory_prep", "star_assembly", "panel_windows", "forward_fill", "scale_by_group",
             "encode_labels", "quantile_pinball_loss", "predict_quantiles", "importance_table"],
)
def test_core_operators_stay_in_the_jvm(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert "Python" not in text and "Pandas" not in text and "MapInArrow" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_bounds_reach_the_scan(spark, sf):
    lines = S.table(spark, sf, "lineitem").select("l_orderkey", "l_shipdate")
    text = plan(splits.between(lines, "l_shipdate", date(1996, 1, 1), date(1996, 6, 30)))
    assert "GreaterThanOrEqual(l_shipdate" in text and "LessThanOrEqual(l_shipdate" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_shipdate:timestamp_ntz>" in text
    orders = S.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    text = plan(orders.where(TG.from_year(F.col("o_orderdate"), 1998)))
    assert "GreaterThanOrEqual(o_orderdate" in text


def test_facts_are_shuffled_once(spark, sf):
    """Gap filling, four fills and the group filter: one exchange of the rows, on (id, piece)."""
    train = stage(S.train(spark, sf), "train")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(retail.trajectory_prep(train))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchanges = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    by_piece = [line for line in exchanges if "__piece" in line]
    # the rows, the map-side combined summary, the finished summary; and the summary by id
    assert len(by_piece) == 3
    assert len(exchanges) == 4
    # all window functions over the rows share one operator
    assert sum("Window [" in line and "rowframe" in line.lower() and "onpromotion" in line for line in text.splitlines()) >= 1


def test_a_hot_entity_is_cut_into_pieces(spark):
    """One entity with all rows is spread over many window groups of a bounded size."""
    spec = S.HOURLY.with_(chunk_steps=100)
    df = spark.range(5000).select(
        F.lit(1).alias("id"),
        F.timestamp_seconds(F.col("id") * 3600).cast("timestamp_ntz").alias("ts"),
        F.when(F.col("id") % 777 == 0, F.col("id").cast("double")).alias("y"),
    )
    pieces = series.with_piece(df, spec).groupBy(series.PIECE).count()
    assert pieces.count() == 50
    assert pieces.agg(F.max("count")).first()[0] == 100
    filled = series.forward_fill(df, spec, ["y"])
    hour = (F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).cast("int")
    assert filled.where(F.col("y") != F.floor(hour / 777) * 777).isEmpty()


def test_python_queries_are_the_declared_ones(spark, sf):
    for name in ("group_apply", "predict_external_model"):
        assert "Python" in plan(QUERIES[name](spark, sf)) or "Pandas" in plan(QUERIES[name](spark, sf))
        assert name in PYTHON
