"""Every registered query against independent SQL on the smallest data."""

import pytest

import __spark_entry__ as entry
from tests.compare import DATA, compare, oracle

FOLDER = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_same_rows_as_sql(spark, con, name):
    assert compare(spark, con, name, FOLDER) == ""


def test_flagship_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["ShipSiteName", "Loc", "FrtTermsFix", "MUnits", "Miles", "Freight"]
    assert df.count() > 0


def test_sql_only_for_registered_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_spoiled_plan_shows_every_rule(spark):
    rules = {r["Rule"] for r in entry.queries()["spoiled_plan_every_rule"](spark, FOLDER).select("Rule").distinct().collect()}
    assert rules == {"supply", "demand", "link", "negative_outbound", "site_balance"}
