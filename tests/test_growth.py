"""Steps whose cost has to keep pace with the tables: what moves, how often, and into how many tasks."""

import pytest
from pyspark.sql import functions as F

from freightnet import scale
from freightnet.catalog import common as c
from freightnet.catalog import load
from freightnet.plans import bidding, check, history, network, scenario
from freightnet.sources.adapter import Tables

FOLDER = "/root/testdata/sf0.001"


def plan_text(df) -> str:
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


@pytest.mark.parametrize("tasks", [None, 3])
def test_history_is_grouped_last(spark, tasks):
    """The stop numbers are there before the lines are, so that no row as wide as the history is joined or moved again."""
    erp = Tables(spark, FOLDER).erp()
    headers = history.stopped_headers(erp, "1995-06-30")
    rows = history.grouped_history(history.order_lines(erp, "1995-06-30", headers=headers, tasks=tasks), tasks)
    assert set(history.STOPS) < set(rows.columns)
    top = plan_text(rows).split("HashAggregate")[0]
    assert "Join" not in top and "Exchange" not in top
    plain = history.grouped_history(history.order_lines(erp, "1995-06-30"))
    want = history.add_stops(plain).select(rows.columns)
    assert sorted(map(str, rows.collect())) == sorted(map(str, want.collect()))


def test_distances_are_dealt_by_their_rows(spark, monkeypatch):
    """The customers' file is one row group: their distances must not stay in the one task that reads it."""
    monkeypatch.setattr(scale, "TASK_ROWS", 50)
    t = Tables(spark, FOLDER)
    rows = t.customer.count() * len(t.site_list)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert t.customer.rdd.getNumPartitions() == 1
        assert t.raw_distances().rdd.getNumPartitions() == -(-rows // 50) > 4
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("name", ["split_share", "split_share_by_part", "allocate_forecast", "column_span"])
def test_wide_rows_are_dealt_by_their_number(spark, monkeypatch, name):
    """Twice the lines, twice the tasks, also where they are added up, and part data meets the lines before order data."""
    monkeypatch.setattr(scale, "TASK_ROWS", 500)
    t = Tables(spark, FOLDER)
    tasks = -(-t.lineitem.count() // 500)
    assert t.tasks == tasks > 8
    plan = plan_text(load()[name].build(t))
    dealt = [row for row in plan.splitlines() if "REPARTITION_BY_NUM" in row and f", {tasks})" in row]
    assert any("l_orderkey" in row for row in dealt) and any("MSTName" in row for row in dealt)
    deepest = lambda key: max(row.index(row.strip(" +-:|")[0]) for row in plan.splitlines() if "Join" in row and key in row)
    assert deepest("l_partkey") > deepest("l_orderkey")


def test_bids_are_written_before_they_are_ranked_again(spark, monkeypatch):
    """Dealing by range reads its input twice: that must be a written table, not the ranking of the step before."""
    plans = []
    plain = scale.slice_rows
    monkeypatch.setattr(bidding, "slice_rows", lambda df, *rest: (plans.append(plan_text(df)), plain(df, *rest))[1])
    types = "MSTName string, Loc string, FTerms string, RPType string, MUnits double"
    demand = spark.createDataFrame([("a", "X", "PPD", "P", 3.0), ("b", "X", "PPD", "P", 4.0)], types)
    supply = spark.createDataFrame([("M", "P", 5.0)], "MfgSite string, RPType string, Capacity double")
    paths = spark.createDataFrame([("M", "S", "X", 1.0)], "MfgSite string, ShipSite string, Dest string, UnitCost double")
    caps = spark.createDataFrame([("S", 4.0)], "ShipSite string, Cap double")
    flows = bidding.bid_plan(demand, supply, paths.withColumn("UnitCost", F.col("UnitCost").cast(bidding.UNIT)), caps)
    assert flows.agg(F.sum("MUnits")).first()[0] == 4.0
    assert len(plans) > 1 and not any("Window" in p or "HashAggregate(keys=[MSTName" in p for p in plans)


def test_a_plan_under_two_capacities_is_made_once(spark, monkeypatch):
    """Flows go to their customers once for both verdicts, customers are costed once for the set and its plan, and the
    moves are added up from the written flows."""
    t, seen, costed = Tables(spark, FOLDER), [], []
    rules, costs, plan = check.customer_rules, network.option_costs, scenario.open_plan
    monkeypatch.setattr(check, "customer_rules", lambda *a: seen.append("rules") or rules(*a))
    monkeypatch.setattr(scenario, "option_costs", lambda *a: costed.append("costs") or costs(*a))
    made = []
    monkeypatch.setattr(scenario, "open_plan", lambda *a, **k: made.append(plan(*a, **k)) or made[0])
    assert [tuple(r) for r in load()["best_open_plan_exact"].build(t).collect()] == [("given", False), ("wide", True)]
    assert (seen, costed, len(made)) == (["rules"], ["costs"], 1)
    out, moved = made[0]
    assert "Join" not in plan_text(out) and "FTerms" not in plan_text(moved)


@pytest.mark.parametrize("most", [1, 2])
def test_kept_costs_and_found_rules_change_nothing(spark, most):
    t = Tables(spark, FOLDER)
    need, have, sites = c.kept_demand(t), c.kept_supply(t), t.site_names
    units = network.unit_costs(t.distances(), c.inbound(t), sites)
    costs, chosen = scenario.site_costs(need, units, sites, most), [sites[3], sites[1], sites[4]]
    rows = lambda df: sorted(map(str, df.collect()))
    sets = [rows(scenario.open_site_scenarios(need, units, sites, 1, 3, sites_per_customer=most, costs=k)) for k in (None, costs)]
    assert sets[0] == sets[1]
    plans = [scenario.open_plan(need, units, c.inbound(t), sites, chosen, most, **k) for k in ({}, {"costs": costs, "keep": True})]
    assert [rows(df) for df in plans[0]] == [rows(df) for df in plans[1]]
    out, moved = plans[1]
    less = need.where("MSTName LIKE '%3'")
    for caps in (None, c.caps(t)):
        plain = check.check_plan(out, moved, less, have, caps, 1, 2)
        found = check.flow_rules(out, moved, less, 1)
        assert rows(check.check_plan(out, moved, less, have, caps, 1, 2, found=found)) == rows(plain) != []
