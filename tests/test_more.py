"""Operators of the third round: checks in few shuffles, bids, site search, medians, counts of drops, layout on disk."""

import random
import statistics

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

import __spark_entry__ as entry
from freightnet.catalog import common as c
from freightnet.catalog import historic
from freightnet.operators import tables as op
from freightnet.plans import bidding, check, demand, geo, network, scenario, waterfall
from freightnet.scale import cut
from freightnet.sources import readers, writers
from freightnet.sources.adapter import Tables
from tests.compare import DATA

SMALL = f"{DATA}/sf0.001"
CUSTOMERS = "MSTName string, Loc string, FTerms string, RPType string, MUnits double"


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_check_moves_flows_once_and_adds_up_once(spark):
    t = Tables(spark, SMALL)
    need, have = c.kept_demand(t), c.kept_supply(t)
    assigned = network.single_source_assign(need, network.unit_costs(t.distances(), c.inbound(t), t.site_names), t.site_names)
    out, moved = (cut(x) for x in network.assigned_plan(need, assigned, c.inbound(t), keep=True))
    caps = cut(c.caps(t))
    every = check.check_plan(out, moved, need, have, caps, sites_per_customer=1, closed=["ASIA"], arc_limit=4000.0)
    assert plan_text(every).count("Exchange ") == 2
    assert every.count() > 0


def test_null_keys_meet_in_a_check(spark):
    need = spark.createDataFrame([("a", None, "PPD", "p", 5.0)], CUSTOMERS)
    out = need.select(F.lit("S").alias("ShipSite"), "*")
    moved = spark.createDataFrame([("M", "S", "p", 5.0)], "MfgSite string, ShipSite string, RPType string, MUnits double")
    have = spark.createDataFrame([("M", "p", 5.0)], "MfgSite string, RPType string, Capacity double")
    assert check.check_plan(out, moved, need, have, sites_per_customer=1).isEmpty()
    less = have.withColumn("Capacity", F.lit(4.0))
    assert [tuple(r) for r in check.check_plan(out, moved, need, less).collect()] == [("supply", "M|p", 5.0, 4.0)]


def network_of(spark, sites: int, places: int, seed: int = 3):
    rng = random.Random(seed)
    at = [(rng.random(), rng.random()) for _ in range(places)]
    hubs = [(rng.random(), rng.random()) for _ in range(sites)]
    names = [f"s{k:02d}" for k in range(sites)]
    far = lambda a, b: round(1000 * ((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5, 3)
    dist = [(n, f"p{j}", far(h, p)) for n, h in zip(names, hubs) for j, p in enumerate(at)]
    need = [(f"c{k}", f"p{k % places}", "PPD", "r", float(rng.randrange(1, 9))) for k in range(4 * places)]
    rates = [(n, n, 0.0) for n in names]
    return (
        names,
        spark.createDataFrame(need, CUSTOMERS),
        spark.createDataFrame(dist, "Orig string, Dest string, Miles double"),
        spark.createDataFrame(rates, "Plant string, ShipSite string, CostPerMUnit double"),
    )


@pytest.mark.parametrize("seed", [1, 2])
def test_bids_keep_every_limit(spark, seed):
    names, need, dist, rates = network_of(spark, 4, 9, seed)
    volume = need.agg(F.sum("MUnits")).first()[0]
    have = spark.createDataFrame([(n, "r", volume / 3.7) for n in names], "MfgSite string, RPType string, Capacity double")
    caps = spark.createDataFrame([(n, volume / 3.9 + k) for k, n in enumerate(names)], "ShipSite string, Cap double")
    flows = cut(bidding.bid_plan(need, have, bidding.ways(dist, rates), caps, slices=3))
    out, moved = waterfall.legs(flows)
    assert check.check_plan(cut(out), cut(moved), need, have, caps).isEmpty()
    assert waterfall.shortfall(need, flows).isEmpty()
    tight = caps.withColumn("Cap", F.col("Cap") / 2)
    flows = cut(bidding.bid_plan(need, have, bidding.ways(dist, rates), tight))
    out, moved = waterfall.legs(flows)
    rules = {r["Rule"] for r in check.check_plan(cut(out), cut(moved), need, have, tight).collect()}
    short = waterfall.shortfall(need, flows).agg(F.sum("Short")).first()[0]
    assert rules == {"demand"} and short == pytest.approx(volume - tight.agg(F.sum("Cap")).first()[0], abs=1e-4)


def test_forty_sites_are_searched(spark):
    names, need, dist, rates = network_of(spark, 40, 30)
    have = spark.createDataFrame([(n, "r", 1e9) for n in names], "MfgSite string, RPType string, Capacity double")
    units = network.unit_costs(dist, network.cheapest_inbound(have, rates), names)
    with pytest.raises(ValueError, match="search_open_sites"):
        scenario.open_site_scenarios(need, units, names)
    steps = scenario.search_open_sites(need, units, names, max_open=4, closed=[names[0]]).orderBy("Step").collect()
    assert len(steps) > 4 and steps[0]["OpenSites"] == "" and steps[0]["Unserved"] > 0
    last = steps[-1]
    assert last["Unserved"] == 0 and last["NOpen"] <= 4 and names[0] not in last["OpenSites"].split("+")
    costs = [(s["Unserved"], s["Cost"]) for s in steps]
    assert costs == sorted(costs, reverse=True) and last["Bound"] <= last["Cost"]
    miles = {(r["Orig"], r["Dest"]): r["Miles"] for r in dist.collect()}
    own = last["OpenSites"].split("+")
    want = sum(r["MUnits"] * min(miles[s, r["Loc"]] for s in own) for r in need.collect()) * 6.15 / 1000
    assert last["Cost"] == pytest.approx(want, abs=0.01)


def test_search_reaches_the_best_of_all_sets(spark):
    names, need, dist, rates = network_of(spark, 6, 12)
    have = spark.createDataFrame([(n, "r", 1e9) for n in names], "MfgSite string, RPType string, Capacity double")
    units = network.unit_costs(dist, network.cheapest_inbound(have, rates), names)
    best = scenario.open_site_scenarios(need, units, names, 1, 3, top=1).first()
    found = scenario.search_open_sites(need, units, names, 3).orderBy(F.desc("Step")).first()
    assert found["Cost"] == pytest.approx(float(best["Cost"])) and found["OpenSites"] == best["OpenSites"]


@pytest.mark.parametrize("n", [1, 2, 7, 5000, 5001])
def test_medians_are_exact(spark, n):
    rng = random.Random(n)
    shapes = {
        "a": [rng.gauss(0, 1e6) for _ in range(n)],
        "b": [float(rng.random() < 0.5) for _ in range(n)],
        "c": [1.0] * n,
        "d": [rng.choice([1.0, 2.0, rng.random()]) for _ in range(n)],
    }
    rows = [(*x, None) for x in zip(*shapes.values())]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e int").repartition(3)
    got = {r["column"]: r["median"] for r in op.exact_medians(df, most=10, accuracy=100).collect()}
    assert got == {**{k: statistics.median(v) for k, v in shapes.items()}, "e": None}


def test_drops_ride_on_the_job(spark):
    raw = spark.createDataFrame(
        [("x", "NY"), ("y", None), ("z", "EX"), ("GNANGARA", "WA"), (None, "WA"), ("w", "HI")], "`de.City` string, `de.State` string"
    )
    seen = Observation("drops")
    kept = op.observed_drops(raw, geo.distance_drops(), seen)
    assert kept.count() == op.on_network(raw, "de.City", "de.State").count() == 2
    assert seen.get == {"null_key": 1, "off_network_state": 2, "miscoded_place": 1}
    assert {r["reason"]: r["n"] for r in op.drop_counts(raw, geo.distance_drops()).collect()} == seen.get


def test_cells_are_dropped_by_reason(spark):
    sheet = spark.createDataFrame([("ITEM", "p", "k1"), ("i", "p", "12"), ("i", "p", "x"), ("i", "p", " "), ("i", "p", "-3"), (None, "p", "4")], "ITEM string, Print string, `12345678 A` string")
    cells = demand.sheet_cells(sheet, ["12345678 A"])
    assert {r["reason"]: r["n"] for r in op.drop_counts(cells, demand.sheet_drops()).collect()} == {
        "null_key": 1, "header": 1, "empty": 1, "unreadable": 1, "not_positive": 1,
    }
    assert [r["MUnits"] for r in demand.unpivot_demand_sheet(sheet, ["12345678 A"]).collect()] == [12.0]


def test_a_lookup_of_one_fails_and_names_the_key(spark):
    need = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    dim = spark.createDataFrame([("a", 10.0), ("b", 20.0), ("unused", 1.0), ("unused", 2.0)], "key string, x double")
    assert sorted(map(tuple, op.lookup_one(need, dim, {"k": "key"}).collect())) == [("a", 1, 10.0), ("b", 2, 20.0)]
    for bad, said in ((dim.unionByName(dim.limit(4)), "found 2 rows"), (dim.where("key != 'b'"), "found 0 rows instead of one for k = b")):
        with pytest.raises(Exception, match=said):
            op.lookup_one(need, bad, {"k": "key"}).select(F.lit(1)).collect()


def test_months_are_read_by_folder(spark, tmp_path):
    t = Tables(spark, SMALL)
    rows = t.history("ShipMonth", "MUnits")
    writers.land_by(rows, str(tmp_path / "h"), ["ShipMonth"])
    read = readers.read_table(spark, str(tmp_path / "h"), rows.schema).where(F.col("ShipMonth") == 199807)
    text = plan_text(read)
    assert "PartitionFilters: [isnotnull(ShipMonth" in text and "PushedFilters: []" in text
    assert read.count() == rows.where("ShipMonth = 199807").count()


def test_landed_tables_join_without_a_shuffle(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines, orders = historic.landed_orders(Tables(spark, SMALL), buckets=4)
        joined = lines.join(orders, "nbr")
        assert "SortMergeJoin" in plan_text(joined) and "Exchange" not in plan_text(joined)
        assert joined.count() == Tables(spark, SMALL).lineitem.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_leaves_of_any_document(spark):
    doc = '{"a": {"x": 1, "y": {"z": [true, null, "s"]}}, "b": 2.5}'
    rows = readers.document_leaves(spark.createDataFrame([(doc,)], "doc string"), "doc").collect()
    assert {("/".join(r["path"]), r["value"]) for r in rows} == {("a/x", "1"), ("a/y/z/0", "true"), ("a/y/z/1", None), ("a/y/z/2", "s"), ("b", "2.5")}
    with pytest.raises(Exception, match="deeper than expected: a/y"):
        readers.document_leaves(spark.createDataFrame([(doc,)], "doc string"), "doc", depth=2).collect()


def test_null_axis_keeps_its_volume(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", None, 7.0), ("b", None, 2.0)], "k string, p string, v double")
    values = op.values_of(df, "p")
    assert values == [None, "x"]
    got = {(r["k"], r["p"]): r["v"] for r in op.densify(df, ["k"], "p", values, "v").collect()}
    assert got == {("a", None): 7.0, ("a", "x"): 1.0, ("b", None): 2.0, ("b", "x"): 0.0}
    wide = {r["k"]: r.asDict() for r in op.widen(df, ["k"], "p", values, "v").collect()}
    assert wide["a"] == {"k": "a", op.NO_NAME: 7.0, "x": 1.0}


def test_cut_check_is_gone():
    assert "spoiled_plan_check" not in entry.queries()
