"""Small cases with known results."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from freightnet.functions import scalar as s
from freightnet.operators import tables as op
from freightnet.plans import bidding, bound, check, history, network, scenario, waterfall
from freightnet.sources import readers

DEMAND = "MSTName STRING, Loc STRING, FTerms STRING, RPType STRING, MUnits DOUBLE"
SUPPLY = "MfgSite STRING, RPType STRING, Capacity DOUBLE"
DIST = "Orig STRING, Dest STRING, Miles DOUBLE"
RATES = "Plant STRING, ShipSite STRING, CostPerMUnit DOUBLE"


def own_site_rates(spark, plants):
    """Every plant ships from its own site only, at no inter-site cost."""
    return spark.createDataFrame([(p, p, 0.0) for p in plants], RATES)


# Two canneries, three markets, dollars per case per 1000 miles.
CANNERY = [
    ("seattle", "new_york", 2.5, 50.0), ("seattle", "chicago", 1.7, 300.0), ("seattle", "topeka", 1.8, 0.0),
    ("san_diego", "new_york", 2.5, 275.0), ("san_diego", "chicago", 1.8, 0.0), ("san_diego", "topeka", 1.4, 275.0),
]
CANNERY_TEXT = ["", "plants    new_york chicago topeka", "seattle   2.5      1.7     1.8", "san_diego 2.5      1.8     1.4"]


@pytest.fixture(scope="module")
def cannery(spark):
    out = spark.createDataFrame([(o, d, d, "PPD", "case", q) for o, d, _, q in CANNERY], f"ShipSite STRING, {DEMAND}")
    dist = spark.createDataFrame([(o, d, m) for o, d, m, _ in CANNERY], DIST)
    need = spark.createDataFrame([(d, d, "PPD", "case", q) for d, q in [("new_york", 325.0), ("chicago", 300.0), ("topeka", 275.0)]], DEMAND)
    have = spark.createDataFrame([("seattle", "case", 350.0), ("san_diego", "case", 600.0)], SUPPLY)
    moved = out.groupBy(F.col("ShipSite").alias("MfgSite"), "ShipSite", "RPType").agg(F.sum("MUnits").alias("MUnits"))
    return out, moved, need, have, dist, own_site_rates(spark, ["seattle", "san_diego"])


def test_cannery_plan_costs_153_675(cannery):
    out, moved, _, _, dist, rates = cannery
    legs = {r["Leg"]: r for r in network.plan_cost(out, moved, dist, rates, Decimal(90)).collect()}
    assert legs["outbound"]["Cost"] == Decimal("153.675") and legs["inter_site"]["Cost"] == 0
    assert legs["outbound"]["MUnits"] == 900


def test_cannery_plan_is_clean(cannery):
    out, moved, need, have, _, _ = cannery
    assert check.is_exact(check.check_plan(out, moved, need, have))
    assert [r["Rule"] for r in check.check_plan(out, moved, need, have, sites_per_customer=1).collect()] == ["sites_per_customer"]


def test_cannery_bound_and_waterfall_enclose_the_optimum(cannery):
    _, _, need, have, dist, rates = cannery
    sites = ["seattle", "san_diego"]
    found = bound.price_bound(need, have, dist, rates, sites, iterations=6, step=0.02, rate=Decimal(90))
    plan = waterfall.waterfall_plan(need, have, waterfall.cheapest_routes(dist, rates, Decimal(90)))
    cost = float(plan.agg(F.sum("Cost")).first()[0])
    assert found.trace[-1][2] <= 153.675 + 1e-9 <= cost + 1e-9
    assert [b for _, _, b in found.trace] == sorted(b for _, _, b in found.trace)


def test_cannery_table_is_read_from_ragged_text(spark, tmp_path):
    path = tmp_path / "d.txt"
    path.write_text("\n".join(CANNERY_TEXT))
    wide = readers.read_ws_table(spark, str(path), ["plants", "new_york", "chicago", "topeka"])
    rows = op.lengthen(wide, ["plants"], ["new_york", "chicago", "topeka"], "market", "miles")
    got = {(r["plants"], r["market"]): float(r["miles"]) for r in rows.collect()}
    assert got == {(o, d): m for o, d, m, _ in CANNERY}


# Three mills, seven customers, dollars per ton; least cost 196200.
MILLS = {"GARY": 1400.0, "CLEV": 2600.0, "PITT": 2900.0}
PLACES = {"FRA": 900.0, "DET": 1200.0, "LAN": 600.0, "WIN": 400.0, "STL": 1700.0, "FRE": 1100.0, "LAF": 1000.0}
TON_COST = [[39, 14, 11, 14, 16, 82, 8], [27, 9, 12, 9, 26, 95, 17], [24, 14, 17, 13, 28, 99, 20]]


@pytest.fixture(scope="module")
def mills(spark):
    need = spark.createDataFrame([(d, d, "PPD", "steel", q) for d, q in PLACES.items()], DEMAND)
    have = spark.createDataFrame([(o, "steel", q) for o, q in MILLS.items()], SUPPLY)
    # 1000 miles per dollar at a rate of 1: the lane cost is the ton cost.
    dist = spark.createDataFrame([(o, d, 1000.0 * c) for o, row in zip(MILLS, TON_COST) for d, c in zip(PLACES, row)], DIST)
    return need, have, dist, own_site_rates(spark, MILLS)


def test_mills_are_balanced(mills):
    need, have, _, _ = mills
    row = network.balance_check(have, need).first()
    assert (row["Supply"], row["Demand"], row["Slack"], row["Enough"]) == (6900.0, 6900.0, 0.0, True)


def test_mills_bound_below_and_waterfall_above_196200(mills):
    need, have, dist, rates = mills
    found = bound.price_bound(need, have, dist, rates, list(MILLS), iterations=8, step=8.0, rate=Decimal(1))
    plan = waterfall.waterfall_plan(need, have, waterfall.cheapest_routes(dist, rates, Decimal(1)))
    out, moved = waterfall.legs(plan)
    assert check.check_plan(out, moved, need, have).isEmpty()
    assert waterfall.shortfall(need, plan).isEmpty()
    assert found.trace[-1][2] <= 196200 <= float(plan.agg(F.sum("Cost")).first()[0])
    assert found.trace[-1][2] > found.trace[0][1]


def test_mills_gap_encloses_196200(mills):
    """A plan recovered from the price steps lies above the optimum, the bound below it; both are close."""
    need, have, dist, rates = mills
    ways = bidding.ways(dist, rates, Decimal(1))
    found = bound.price_bound(need, have, dist, rates, list(MILLS), iterations=20, step=12.0, rate=Decimal(1), keep=True)
    plan = bound.recover_plan(found, need, have, ways).cache()
    over = bound.gap(plan, found, need, have)
    cost = float(plan.agg(F.sum("Cost")).first()[0])
    assert found.best <= 196200 <= cost and over == pytest.approx(cost / found.best - 1)
    assert over < 0.15
    bids = bidding.bid_plan(need, have, ways)
    assert float(bids.agg(F.sum("Cost")).first()[0]) >= 196200
    with pytest.raises(ValueError, match="demand"):
        bound.gap(plan.where(F.col("Loc") != "FRA"), found, need, have)


def test_unreached_demand_is_shown_and_refused(mills, spark):
    need, have, dist, rates = mills
    more = need.unionByName(spark.createDataFrame([("X", "NOWHERE", "PPD", "steel", 5.0)], DEMAND))
    found = bound.price_bound(more, have, dist, rates, list(MILLS), iterations=1, rate=Decimal(1))
    assert [tuple(r) for r in found.unserved.collect()] == [("NOWHERE", "steel", 5.0)]
    with pytest.raises(ValueError, match="no way leads"):
        bound.gap(need.limit(0), found, more, have)


def test_nearest_site_is_no_dearer_than_the_optimum(mills):
    need, _, dist, _ = mills
    best = network.cheapest_site(need, dist, Decimal(1))
    want = sum(q * min(row[i] for row in TON_COST) for i, q in enumerate(PLACES.values()))
    assert float(best.agg(F.sum("Cost")).first()[0]) == want <= 196200


def test_single_source_bound_is_at_most_any_clean_plan(mills, spark):
    need, have, dist, rates = mills
    wide = have.withColumn("Capacity", F.lit(6900.0))
    found = bound.price_bound(need, wide, dist, rates, list(MILLS), iterations=2, rate=Decimal(1), single_source=True)
    units = network.unit_costs(dist, network.cheapest_inbound(wide, rates), list(MILLS), Decimal(1))
    assigned = network.single_source_assign(need, units, list(MILLS))
    out, moved = network.assigned_plan(need, assigned, network.cheapest_inbound(wide, rates))
    assert check.check_plan(out, moved, need, wide, sites_per_customer=1).isEmpty()
    assert found.trace[-1][2] <= float(assigned.agg(F.sum("Cost")).first()[0])


# Three products; supply by mill, demand by place, tons.
PRODUCT_SUPPLY = {"bands": [400, 700, 800], "coils": [800, 1600, 1800], "plate": [200, 300, 300]}
PRODUCT_DEMAND = {
    "bands": [300, 300, 100, 75, 650, 225, 250],
    "coils": [500, 750, 400, 250, 950, 850, 500],
    "plate": [100, 100, 0, 50, 200, 100, 250],
}


def test_arc_and_served_rules_over_products(spark, mills):
    _, _, dist, rates = mills
    need = spark.createDataFrame([(d, d, "PPD", p, float(q)) for p, row in PRODUCT_DEMAND.items() for d, q in zip(PLACES, row)], DEMAND)
    have = spark.createDataFrame([(o, p, float(q)) for p, row in PRODUCT_SUPPLY.items() for o, q in zip(MILLS, row)], SUPPLY)
    plan = waterfall.waterfall_plan(need, have, waterfall.cheapest_routes(dist, rates, Decimal(1)))
    out, moved = waterfall.legs(plan)
    flows = [tuple(r) for r in out.select("ShipSite", "Loc", "MUnits").collect()]
    arcs, served = {}, {}
    for o, d, q in flows:
        arcs[o, d] = arcs.get((o, d), 0) + q
        served.setdefault(o, set()).add(d)
    got = check.check_plan(out, moved, need.where("MUnits > 0"), have, arc_limit=625, max_served=4).collect()
    assert {r["Key"]: r["Actual"] for r in got if r["Rule"] == "arc"} == {f"{o}|{d}": q for (o, d), q in arcs.items() if q > 625}
    assert {r["Key"]: r["Actual"] for r in got if r["Rule"] == "max_served"} == {o: len(d) for o, d in served.items() if len(d) > 4}
    assert {r["Rule"] for r in got} <= {"arc", "max_served"} and any(r["Rule"] == "arc" for r in got)


# 63 routes, tons per pair of cities at most 700.
ORIGINS = ["BANGKOK", "LONDON", "PARIS"]
CITIES = ["SINGAPORE", "NEWYORK", "ISTANBUL", "DUBAI", "KUALALUMPUR", "HONGKONG", "BARCELONA"]
PAIR_SUPPLY = {"smartphone": [500, 800, 600], "tablet": [1000, 1500, 1700], "laptop": [150, 250, 400]}
PAIR_DEMAND = {
    "smartphone": [400, 200, 100, 175, 550, 200, 275],
    "tablet": [600, 650, 300, 350, 950, 750, 600],
    "laptop": [90, 110, 0, 65, 185, 150, 200],
}


def test_pair_cap_and_origins_per_product(spark):
    routes = spark.createDataFrame([(p, o, d) for p in PAIR_SUPPLY for o in ORIGINS for d in CITIES], "p STRING, o STRING, d STRING")
    assert routes.count() == 63
    lists = {r["p"]: r["origins"] for r in op.distinct_lists(routes, ["p"], "o", "origins").collect()}
    assert lists == {p: sorted(ORIGINS) for p in PAIR_SUPPLY}
    need = spark.createDataFrame([(d, d, "PPD", p, float(q)) for p, row in PAIR_DEMAND.items() for d, q in zip(CITIES, row)], DEMAND)
    have = spark.createDataFrame([(o, p, float(q)) for p, row in PAIR_SUPPLY.items() for o, q in zip(ORIGINS, row)], SUPPLY)
    for r in network.balance_check(have, need).collect():
        assert r["Slack"] == 0.0
    dist = spark.createDataFrame([(o, d, 1.0) for o in ORIGINS for d in CITIES], DIST)
    plan = waterfall.waterfall_plan(need, have, waterfall.cheapest_routes(dist, own_site_rates(spark, ORIGINS), Decimal(1)))
    out, _ = waterfall.legs(plan)
    sums = {(r["ShipSite"], r["Loc"]): r["q"] for r in out.groupBy("ShipSite", "Loc").agg(F.sum("MUnits").alias("q")).collect()}
    got = {r["Key"]: r["Actual"] for r in check.arc_rule(out, "ShipSite", "Loc", 700).collect()}
    assert got == {f"{o}|{d}": q for (o, d), q in sums.items() if q > 700} and got


# A nested network with four plants, four sites, two customers and two products.
JSON_DEMAND = """{"customers": {"C1": {"products": {"T1": {"demand": 600}, "T2": {"demand": 500}}},
                                "C2": {"products": {"T1": {"demand": 800}, "T2": {"demand": 200}}}}}"""
JSON_CAPACITY = """{"plants": {"P1": {"products": {"T1": {"capacity": 600}, "T2": {"capacity": 350}}},
                               "P2": {"products": {"T1": {"capacity": 100}, "T2": {"capacity": 150}}},
                               "P3": {"products": {"T1": {"capacity": 500}, "T2": {"capacity": 150}}},
                               "P4": {"products": {"T1": {"capacity": 300}, "T2": {"capacity": 150}}}}}"""
JSON_LANES = """{"distances": {"P1 => S1": 0, "P1 => S2": 6, "P1 => S3": 24, "P1 => S4": 7, "S1 => C1": 24, "S1 => C2": 10,
 "P2 => S1": 6, "P2 => S2": 0, "P2 => S3": 10, "P2 => S4": 12, "S2 => C1": 5, "S2 => C2": 20,
 "P3 => S1": 24, "P3 => S2": 20, "P3 => S3": 0, "P3 => S4": 8, "S3 => C1": 45, "S3 => C2": 7,
 "P4 => S1": 7, "P4 => S2": 12, "P4 => S3": 8, "P4 => S4": 0, "S4 => C1": 30, "S4 => C2": 6}}"""


@pytest.fixture(scope="module")
def nested(spark):
    def one(text):
        return spark.createDataFrame([(text,)], "doc STRING")

    lanes = readers.flatten_lanes(one(JSON_LANES), "doc")
    need = readers.flatten_products(one(JSON_DEMAND), "doc", "customers", "demand").select(
        F.col("owner").alias("MSTName"), F.col("owner").alias("Loc"), F.lit("PPD").alias("FTerms"),
        F.col("product").alias("RPType"), F.col("demand").alias("MUnits"),
    )
    have = readers.flatten_products(one(JSON_CAPACITY), "doc", "plants", "capacity").toDF("MfgSite", "RPType", "Capacity")
    dist = lanes.where(F.col("orig").startswith("S")).toDF("Orig", "Dest", "Miles")
    rates = lanes.where(F.col("orig").startswith("P")).toDF("Plant", "ShipSite", "CostPerMUnit")
    return need, have, dist, rates


def test_nested_totals(nested):
    need, have, _, _ = nested
    got = {r["RPType"]: (r["Supply"], r["Demand"]) for r in network.balance_check(have, need).collect()}
    assert got == {"T1": (1500.0, 1400.0), "T2": (800.0, 700.0)}


def test_nested_single_source_and_scenarios(nested):
    need, have, dist, rates = nested
    sites = ["S1", "S2", "S3", "S4"]
    inbound = network.cheapest_inbound(have, rates)
    units = network.unit_costs(dist, inbound, sites, Decimal(1000))
    lane = {(r["Orig"], r["Dest"]): r["Miles"] for r in dist.collect()}
    into = {(r["ShipSite"], r["RPType"]): float(r["Inbound"]) for r in inbound.collect()}
    rows = need.collect()

    def cost(c, s):
        return sum(r["MUnits"] * (lane[s, c] + into[s, r["RPType"]]) for r in rows if r["Loc"] == c)

    got = {r["Loc"]: (r["ShipSite"], float(r["Cost"])) for r in network.single_source_assign(need, units, sites).collect()}
    assert got == {c: min((cost(c, s), s) for s in sites)[::-1] for c in ("C1", "C2")}

    ranked = {r["OpenSites"]: float(r["Cost"]) for r in scenario.open_site_scenarios(need, units, sites).collect()}
    assert len(ranked) == 15
    for names, total in ranked.items():
        assert total == sum(min(cost(c, s) for s in names.split("+")) for c in ("C1", "C2"))
    best = [min(v for k, v in ranked.items() if len(k.split("+")) <= n) for n in range(1, 5)]
    assert best == sorted(best, reverse=True)


def test_two_sites_per_customer_never_cost_more(nested):
    need, have, dist, rates = nested
    sites = ["S1", "S2", "S3", "S4"]
    units = network.unit_costs(dist, network.cheapest_inbound(have, rates), sites, Decimal(1000))
    one = {r["Mask"]: r["Cost"] for r in scenario.open_site_scenarios(need, units, sites).collect()}
    two = {r["Mask"]: r["Cost"] for r in scenario.open_site_scenarios(need, units, sites, sites_per_customer=2).collect()}
    assert all(two[m] <= one[m] for m in one)


def test_a_closed_site_is_in_no_scenario():
    assert scenario.site_sets(5, 1, 5) == list(range(1, 32))
    assert all(not m & 0b10010 for m in scenario.site_sets(5, 1, 5, [1, 4]))
    with pytest.raises(ValueError):
        scenario.site_sets(13, 1, 13)


def test_customer_without_a_way_is_counted(nested, spark):
    need, have, dist, rates = nested
    sites = ["S1", "S2"]
    lost = need.unionByName(spark.createDataFrame([("C9", "NOWHERE", "PPD", "T1", 5.0)], DEMAND))
    units = network.unit_costs(dist, network.cheapest_inbound(have, rates), sites, Decimal(1000))
    assert {r["Unserved"] for r in scenario.open_site_scenarios(lost, units, sites).collect()} == {1}
    assert [r["ShipSite"] for r in network.single_source_assign(lost, units, sites).where("MSTName = 'C9'").collect()] == [None]


# Capacity rows of one study, by plant and part.
PART_SUPPLY = [("VISALIA", "LHRDS016", 34974.0)]


def test_supply_is_added_up_and_zero_rows_go(spark):
    from freightnet.plans.demand import supply_from_capacity

    rows = [("1", *PART_SUPPLY[0][:1], "G", *PART_SUPPLY[0][1:]), ("2", "VISALIA", "G", "LHRDS016", 6.0), ("3", "KENTON", "G", "X", 0.0), ("4", None, "G", "X", 5.0)]
    sheet = spark.createDataFrame(rows, "MfgSite STRING, MfgSiteName STRING, PrintGroup STRING, PartType STRING, OLMUnits DOUBLE")
    assert [tuple(r) for r in supply_from_capacity(sheet).collect()] == [("VISALIA", "G", "LHRDS016", 34980.0)]


def test_one_stop_and_two_stop_bills(spark):
    rows = [("045-56996", "A"), ("045-56996", "A"), ("031-96291", "A"), ("031-96291", "B"), ("031-96291", "B")]
    got = history.add_stops(spark.createDataFrame(rows, "MasterBOL STRING, MST STRING"))
    assert {(r["MasterBOL"], r["MST"], r["StopNbrFix"], r["BOLMasterShipToCount"]) for r in got.collect()} == {
        ("045-56996", "A", 1, 1),
        ("031-96291", "A", 1, 2),
        ("031-96291", "B", 2, 2),
    }
    assert got.count() == len(rows)


def test_carrier_modes_ignore_case_and_blanks(spark):
    codes = {"NLAT": "IM", "exla": "LTL", " cpu ": "CPU", "CUST": "CPU", "PAGE": "OCEAN", "FEDX": "AIR", "usit": "TL", "PAPT": "TL", "??": "UNKNOWN", None: "UNKNOWN"}
    df = history.with_mode(spark.createDataFrame([(c,) for c in codes], "t STRING"), "t", history.carriers(spark), "m")
    assert {r["t"]: r["m"] for r in df.collect()} == codes


def test_pick_up_costs_nothing_but_counts_in_the_plan(spark):
    df = spark.createDataFrame([(2.0, 1000.0, "PPD"), (2.0, 1000.0, "CPU")], "m DOUBLE, d DOUBLE, t STRING")
    got = [tuple(r) for r in df.select(s.freight("m", "d", "t"), s.freight("m", "d")).collect()]
    assert got == [(Decimal("12.3"), Decimal("12.3")), (Decimal(0), Decimal("12.3"))]


def test_negative_and_unlinked_flows_are_reported(cannery, spark):
    out, moved, need, have, _, _ = cannery
    bad = out.unionByName(spark.createDataFrame([("seattle", "topeka", "topeka", "PPD", "case", -5.0), ("seattle", "chicago", "chicago", "PPD", "case", 400.0)], out.schema))
    rules = {r["Rule"] for r in check.check_plan(bad, moved, need, have).collect()}
    assert {"negative_outbound", "link", "demand", "site_balance"} <= rules
    caps = spark.createDataFrame([("seattle", 10.0)], "ShipSite STRING, Cap DOUBLE")
    assert [r["Key"] for r in check.throughput_rule(out, caps).collect()] == ["seattle"]


def test_demand_sheet(spark):
    from freightnet.plans.demand import unpivot_demand_sheet

    rows = [("A", "P", "5", "1"), ("ITEM", "P", "98034627 x", "98034627 y"), (None, "P", "7", "7"), ("A", "P", "n/a", "-3"), ("B", "P", None, "2.5")]
    sheet = spark.createDataFrame(rows, "ITEM STRING, Print STRING, `98034627 NORTH` STRING, `98034627 SOUTH` STRING")
    got = unpivot_demand_sheet(sheet, sheet.columns[2:])
    assert {tuple(r) for r in got.collect()} == {("P", "A", "98034627", 6.0), ("P", "B", "98034627", 2.5)}
