"""Every registered query against its SQL on the small tables."""

import pytest

from __spark_entry__ import entry
from panelweave.workloads.oracles import ORACLES
from panelweave.workloads.queries import QUERIES
from tests.compare import connect, differences


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf, con, name):
    assert differences(QUERIES[name](spark, sf), con, ORACLES[name]) == []


def test_every_query_is_checked():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["id", "windows", "last_sum", "split"]
    assert df.count() > 0


def test_training_lowers_the_loss(spark, sf):
    history = {r["epoch"]: r["train_loss"] for r in QUERIES["fit_history"](spark, sf).collect()}
    assert history[2] < history[1] < history[0]
