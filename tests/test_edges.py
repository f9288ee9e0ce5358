"""Input that the given tables do not have: fractions, NULL keys, repeated calls, very large sums."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from freightnet import schemas
from freightnet.functions.scalar import freight
from freightnet.operators import tables as op
from freightnet.plans import check, demand, scenario
from freightnet.scale import cut, scratch
from freightnet.sources.adapter import Tables
from freightnet.sources.readers import read_table
from tests.compare import DATA

SMALL = f"{DATA}/sf0.001"


def test_freight_of_fractional_miles(spark):
    df = spark.createDataFrame([(1e6, 12.345), (1e6, 0.004), (0.5, 1000.0)], "m double, d double")
    got = [r[0] for r in df.select(freight("m", "d")).collect()]
    assert got == [Decimal("75921.750000"), Decimal("24.600000"), Decimal("3.075000")]


def test_null_keys_are_a_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0)], "k string, v double")
    got = sorted((r["v"], r["Pct"]) for r in op.share(df, ["k"], "v").collect())
    assert got == [(1.0, 0.25), (2.0, 1.0), (3.0, 0.75)]
    assert sorted(r["t"] for r in op.with_group_total(df, ["k"], "v", "t").collect()) == [2.0, 4.0, 4.0]


def test_sums_do_not_depend_on_the_order(spark):
    df = spark.range(200_000).select(F.lit("k").alias("k"), (F.col("id") * 0.1 + 1e6).alias("v"))
    assert op.total(df, ["k"], "v").first() == op.total(df.repartition(7, "v"), ["k"], "v").first()


def test_large_fractional_plans_balance(spark):
    flows = spark.range(100_000).select(
        F.lit("S").alias("ShipSite"), F.lit("P").alias("RPType"), (F.col("id") * 20.000001 + 0.1).alias("MUnits")
    )
    assert check.balance_rule(flows, flows.repartition(5, "MUnits")).count() == 0
    less = flows.withColumn("MUnits", F.col("MUnits") * 0.999)
    assert [r["Rule"] for r in check.balance_rule(flows, less).collect()] == ["site_balance"]


@pytest.mark.parametrize("column", ["OLMUnits", "Capacity"])
def test_capacity_sheet_with_its_own_schema(spark, tmp_path, column):
    rows = [("A", "Alpha", "G", "T", 3.0), ("A", "Alpha", "G", "T", 4.0), ("B", None, "G", "T", 5.0), ("B", "Beta", "G", "T", 0.0)]
    sheet = spark.createDataFrame(rows, f"MfgSite string, MfgSiteName string, PrintGroup string, PartType string, {column} double")
    other = "Capacity" if column == "OLMUnits" else "OLMUnits"
    sheet.withColumn(other, F.lit(None).cast("double")).write.parquet(str(tmp_path / "capacity"))
    got = demand.supply_from_capacity(read_table(spark, str(tmp_path / "capacity"), schemas.CAPACITY)).collect()
    assert [tuple(r) for r in got] == [("Alpha", "G", "T", 7.0)]


def test_short_lists_only(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("a",)], "v string")
    assert op.values_of(df, "v") == [None, "a", "b"]
    with pytest.raises(ValueError):
        op.values_of(df, "v", most=1)
    with pytest.raises(ValueError):
        scenario.site_sets(13, 1, 13)
    assert len(scenario.site_sets(13, 13, 13, most_sites=13)) == 1


def test_sites_come_from_the_table(spark, tmp_path):
    spark.createDataFrame([(3, "North"), (9, "South")], "r_regionkey int, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    t = Tables(spark, str(tmp_path))
    assert t.site_names == ["North", "South"]
    assert t.inter_site_rates().count() == 4


@pytest.mark.parametrize("name", ["written_table", "written_tsv", "forecast_from_sql_view"])
def test_a_query_built_twice_keeps_both_results(spark, name):
    build = entry.queries()[name]
    views = {v.name for v in spark.catalog.listTables()}
    first, second = build(spark, SMALL), build(spark, SMALL)
    assert sorted(first.collect()) == sorted(second.collect())
    assert {v.name for v in spark.catalog.listTables()} == views


def test_scope_removes_what_it_wrote(spark):
    with scratch(spark) as folder:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        kept = cut(spark.range(5))
        assert kept.count() == 5
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        assert files.exists(path)
    assert not files.exists(path)


def test_unknown_customers_of_the_sheet_are_kept(spark):
    got = entry.queries()["sheet_demand_located"](spark, SMALL)
    assert got.where("Loc is null").count() > 0


def test_no_volume_is_repeated_by_geocodes(spark):
    t = Tables(spark, SMALL)
    got = entry.queries()["demand_by_city_geocoded"](spark, SMALL)
    assert got.select("MSTCity", "MSTState", "FrtTermsFix").distinct().count() == got.count()
    assert got.agg(F.sum("MUnits")).first()[0] <= t.history("MUnits").agg(F.sum("MUnits")).first()[0]


def test_bills_join_several_orders(spark):
    bills = entry.queries()["freight_by_bill"](spark, SMALL)
    assert bills.count() < Tables(spark, SMALL).orders.count()


@pytest.mark.parametrize("per_customer", [1, 2])
def test_plan_of_a_site_set_costs_what_the_scenario_says(spark, per_customer):
    from freightnet.plans import network

    demand_ = spark.createDataFrame(
        [(f"c{k}", f"P{k % 3}", "PPD", f"r{j}", float(1 + k * j)) for k in range(12) for j in range(3)],
        "MSTName string, Loc string, FTerms string, RPType string, MUnits double",
    )
    dist = spark.createDataFrame(
        [(s, f"P{p}", float(100 + 77 * ((i * 5 + p * 3) % 7))) for i, s in enumerate("ABC") for p in range(3) if (s, p) != ("B", 2)],
        "Orig string, Dest string, Miles double",
    )
    inbound = spark.createDataFrame(
        [(s, f"r{j}", "M", Decimal((i + j) % 3)) for i, s in enumerate("ABC") for j in range(3)],
        "ShipSite string, RPType string, MfgSite string, Inbound decimal(28,6)",
    )
    sites = ["A", "B", "C"]
    units = network.unit_costs(dist, inbound, sites)
    for row in scenario.open_site_scenarios(demand_, units, sites, sites_per_customer=per_customer).collect():
        if row["Unserved"]:
            continue
        chosen = row["OpenSites"].split("+")
        out, moved = scenario.open_plan(demand_, units, inbound, sites, chosen, per_customer)
        priced = out.join(dist, (F.col("ShipSite") == F.col("Orig")) & (F.col("Loc") == F.col("Dest")))
        lanes = priced.agg(F.sum(freight("MUnits", "Miles"))).first()[0]
        inward = moved.join(inbound, ["ShipSite", "RPType", "MfgSite"]).agg(F.sum(F.col("MUnits") * F.col("Inbound"))).first()[0]
        assert float(lanes) + float(inward) == pytest.approx(float(row["Cost"]), abs=1e-3)
        assert set(r[0] for r in out.select("ShipSite").distinct().collect()) <= set(chosen)
        assert out.groupBy("MSTName").agg(F.countDistinct("ShipSite").alias("n")).where(F.col("n") > per_customer).count() == 0
