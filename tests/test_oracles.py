"""Every registered query against its SQL, at the smallest scale."""

import pytest

import __spark_entry__ as entry
import check_oracles
import plans
from ledgerwatch import registry

NAMES = sorted(registry.QUERIES)


@pytest.fixture(scope="module")
def con(sf_dir):
    return check_oracles.connect(sf_dir)


def no_all_pairs_and_no_row_udf(df):
    plan = plans.text(df)
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert node not in plan


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, sf_dir, name):
    ok, note = check_oracles.compare(spark, con, sf_dir, name, inspect=no_all_pairs_and_no_row_udf)
    assert ok, note


def test_entry(spark):
    assert entry.entry(spark).count() == 412


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_aggregates(spark, sf_dir):
    row = entry.queries()["velocity_features"](spark, sf_dir).selectExpr(
        "count(*)", "sum(isFraud)", "count(distinct nameOrig)", "sum(velocity_1hr)", "sum(velocity_3hr)",
        "sum(velocity_24hr)", "sum(velocity_cumcount)", "count_if(velocity_24hr > 5)",
    ).first()
    assert tuple(row) == (412, 17, 4, 486, 618, 1866, 21413, 138)
