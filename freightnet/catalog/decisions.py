"""Network decisions: sites, scenarios, feasible plans, bounds."""

from pyspark.sql import functions as F

from freightnet.catalog import common as c
from freightnet.catalog import query
from freightnet.catalog.shaping import SITES
from freightnet.catalog.views import with_views
from freightnet.plans import bidding, bound, check, network, scenario, waterfall
from freightnet.scale import cut


@query(
    "cheapest_site",
    "N1 B10 C12",
    with_views("""SELECT MSTName, Loc, FTerms, RPType, MUnits, Orig AS ShipSite, Miles, CAST(CAST(MUnits * Miles AS DECIMAL(24, 0)) * 0.00615 AS DOUBLE) AS Cost
  FROM demand JOIN (SELECT * FROM dist QUALIFY row_number() OVER (PARTITION BY Dest ORDER BY Miles, Orig) = 1) ON Dest = Loc"""),
)
def cheapest_site(t):
    return network.cheapest_site(c.demand(t), t.distances())


@query(
    "cheapest_inbound",
    "N2",
    with_views("SELECT ShipSite, RPType, MfgSite, CAST(Inbound AS DOUBLE) AS Inbound FROM inbound"),
)
def cheapest_inbound(t):
    return c.inbound(t)


def _units(t):
    return network.unit_costs(t.distances(), c.inbound(t), t.site_names)


@query(
    "single_source_assign",
    "N3",
    with_views("SELECT MSTName, Loc, FTerms, ShipSite, CAST(Cost AS DOUBLE) AS Cost FROM assigned"),
)
def single_source_assign(t):
    return network.single_source_assign(c.demand(t), _units(t), t.site_names)


def _scenario_sql(masks: list[int]) -> str:
    names = " || ".join(f"CASE WHEN Mask & {1 << i} <> 0 THEN '+{s}' ELSE '' END" for i, s in enumerate(SITES))
    bits = " ".join(f"WHEN '{s}' THEN {1 << i}" for i, s in enumerate(SITES))
    return f"""WITH masks AS (SELECT unnest([{', '.join(map(str, masks))}]) AS Mask),
 picked AS (SELECT Mask, MSTName, Loc, FTerms, min(Cost) AS Cost FROM masks CROSS JOIN cust_site
            WHERE Mask & (CASE ShipSite {bits} END) <> 0 GROUP BY ALL),
 sums AS (SELECT Mask, sum(Cost) AS Cost FROM picked GROUP BY Mask)
 SELECT CAST(Mask AS INTEGER) AS Mask, substr({names}, 2) AS OpenSites, CAST(bit_count(Mask) AS INTEGER) AS NOpen,
        CAST(Cost AS DOUBLE) AS Cost, CAST(0 AS BIGINT) AS Unserved,
        CAST(row_number() OVER (ORDER BY Cost, bit_count(Mask), Mask) AS INTEGER) AS Rank FROM sums"""


@query("open_site_scenarios", "N4", with_views(_scenario_sql(scenario.site_sets(5, 1, 5))))
def open_site_scenarios(t):
    return scenario.open_site_scenarios(c.demand(t), _units(t), t.site_names)


@query(
    "best_three_of_open_sites",
    "N4 O1",
    with_views(_scenario_sql(scenario.site_sets(5, 2, 3, [0])) + " QUALIFY Rank <= 3"),
)
def best_three_of_open_sites(t):
    return scenario.open_site_scenarios(c.demand(t), _units(t), t.site_names, 2, 3, closed=["AFRICA"], top=3)


def _pair_sql(masks: list[int]) -> str:
    names = " || ".join(f"CASE WHEN Mask & {1 << i} <> 0 THEN '+{s}' ELSE '' END" for i, s in enumerate(SITES))
    bits = " ".join(f"WHEN '{s}' THEN {1 << i}" for i, s in enumerate(SITES))
    return f"""WITH masks AS (SELECT unnest([{', '.join(map(str, masks))}]) AS Mask),
 bitted AS (SELECT *, CASE ShipSite {bits} END AS Bit FROM units),
 pair_units AS (SELECT a.Dest, a.RPType, a.Bit | b.Bit AS Pair, least(a.Unit, b.Unit) AS Unit
                FROM bitted a JOIN bitted b ON a.Dest = b.Dest AND a.RPType = b.RPType AND a.Bit <= b.Bit),
 pair_cost AS (SELECT MSTName, Loc, FTerms, Pair, sum(CAST(MUnits AS DECIMAL(18, 0)) * Unit) AS Cost
               FROM demand JOIN pair_units ON Loc = Dest AND demand.RPType = pair_units.RPType GROUP BY ALL),
 picked AS (SELECT Mask, MSTName, Loc, FTerms, min(Cost) AS Cost FROM masks CROSS JOIN pair_cost WHERE Mask & Pair = Pair GROUP BY ALL),
 sums AS (SELECT Mask, sum(Cost) AS Cost FROM picked GROUP BY Mask)
 SELECT CAST(Mask AS INTEGER) AS Mask, substr({names}, 2) AS OpenSites, CAST(bit_count(Mask) AS INTEGER) AS NOpen,
        CAST(Cost AS DOUBLE) AS Cost, CAST(0 AS BIGINT) AS Unserved,
        CAST(row_number() OVER (ORDER BY Cost, bit_count(Mask), Mask) AS INTEGER) AS Rank FROM sums"""


@query("open_site_scenarios_two_sites", "N4", with_views(_pair_sql(scenario.site_sets(5, 1, 3))))
def open_site_scenarios_two_sites(t):
    return scenario.open_site_scenarios(c.demand(t), _units(t), t.site_names, 1, 3, sites_per_customer=2)


@query(
    "balance_by_product",
    "N9 A12",
    with_views("""SELECT RPType, Supply, Demand, Supply - Demand AS Slack, Supply >= Demand AS Enough FROM
  (SELECT RPType, sum(Capacity) AS Supply FROM (SELECT RPType, sum(MUnits) * 6 / 5 AS Capacity FROM rooted GROUP BY ALL) GROUP BY ALL)
  JOIN (SELECT RPType, sum(MUnits) AS Demand FROM demand GROUP BY ALL) USING (RPType)"""),
)
def balance_by_product(t):
    # One plant total per product, so that both engines add up in one way.
    made = c.plant_volume(t).groupBy("RPType").agg((F.sum("MUnits") * 6 / 5).alias("Capacity"))
    return network.balance_check(made, c.demand(t))


@query(
    "single_source_plan_cost",
    "N8",
    with_views("""SELECT 'outbound' AS Leg, sum(MUnits) AS MUnits, CAST(sum(CAST(MUnits * Miles AS DECIMAL(24, 0)) * 0.00615) AS DOUBLE) AS Cost
  FROM outbound JOIN dist ON Orig = ShipSite AND Dest = Loc
  UNION ALL SELECT 'inter_site', sum(MUnits), sum(MUnits * CostPerMUnit) FROM moved JOIN rates ON Plant = MfgSite AND rates.ShipSite = moved.ShipSite"""),
)
def single_source_plan_cost(t):
    out, moved = _plan(t, keep=True)
    return network.plan_cost(out, moved, t.distances(), c.rates(t))


def _plan(t, keep=False):
    wanted, inbound = c.kept_demand(t), c.inbound(t)
    return network.assigned_plan(wanted, network.single_source_assign(wanted, _units(t), t.site_names), inbound, keep)


WATER = "SELECT MfgSite, ShipSite, MSTName, Loc, FTerms, RPType, CAST(Flow AS DOUBLE) AS MUnits, CAST(Flow * UnitCost AS DOUBLE) AS Cost FROM waterfall"


def _waterfall(t, wanted=None):
    return waterfall.waterfall_plan(wanted or c.demand(t), c.scarce(t), waterfall.cheapest_routes(t.distances(), c.rates(t)))


@query("waterfall_plan", "N6", with_views(WATER))
def waterfall_plan(t):
    return _waterfall(t)


@query(
    "waterfall_shortfall",
    "N6",
    with_views("""SELECT MSTName, Loc, FTerms, RPType, MUnits AS Wanted, CAST(MUnits - Short AS DOUBLE) AS Sent, CAST(Short AS DOUBLE) AS Short FROM
  (SELECT d.*, least(CAST(MUnits AS DECIMAL(18, 6)), d1 - Total) AS Short FROM d_int d JOIN (SELECT RPType, max(s1) AS Total FROM s_int GROUP BY 1) USING (RPType) WHERE d1 > Total)"""),
)
def waterfall_shortfall(t):
    return waterfall.shortfall(c.kept_demand(t), _waterfall(t, c.kept_demand(t)))


@query(
    "waterfall_check",
    "N7",
    with_views("""SELECT 'sites_per_customer' AS Rule, MSTName || '|' || Loc || '|' || FTerms AS "Key", CAST(count(DISTINCT ShipSite) AS DOUBLE) AS Actual, CAST(1 AS DOUBLE) AS "Limit"
  FROM waterfall GROUP BY MSTName, Loc, FTerms HAVING count(DISTINCT ShipSite) > 1
  UNION ALL SELECT 'throughput', ShipSite, CAST(sum(Flow) AS DOUBLE), any_value(Cap) FROM waterfall JOIN caps USING (ShipSite) GROUP BY ShipSite HAVING sum(Flow) > any_value(Cap)
  UNION ALL SELECT 'demand', concat_ws('|', MSTName, Loc, FTerms, RPType), CAST(coalesce(sum(Flow), 0) AS DOUBLE), any_value(demand.MUnits)
  FROM demand LEFT JOIN waterfall USING (MSTName, Loc, FTerms, RPType) GROUP BY MSTName, Loc, FTerms, RPType HAVING coalesce(sum(Flow), 0) < any_value(CAST(demand.MUnits AS DECIMAL(18, 6)))"""),
)
def waterfall_check(t):
    wanted = c.kept_demand(t)
    out, moved = waterfall.legs(cut(_waterfall(t, wanted)))
    rows = check.check_plan(out, moved, wanted, c.scarce(t), c.caps(t), sites_per_customer=1)
    return rows.withColumn("Actual", F.round("Actual", 6))


@query(
    "single_source_check",
    "N7 C14 S12",
    with_views("""SELECT 'supply' AS Rule, MfgSite || '|' || RPType AS "Key", sum(MUnits) AS Actual, any_value(Capacity) AS "Limit"
  FROM moved JOIN supply USING (MfgSite, RPType) GROUP BY MfgSite, RPType HAVING sum(MUnits) > any_value(Capacity)
  UNION ALL SELECT 'throughput', ShipSite, sum(MUnits), any_value(Cap) FROM outbound JOIN caps USING (ShipSite) GROUP BY ShipSite HAVING sum(MUnits) > any_value(Cap)
  UNION ALL SELECT 'open_count', '', CAST(count(DISTINCT ShipSite) AS DOUBLE), 2 FROM outbound HAVING count(DISTINCT ShipSite) > 2
  UNION ALL SELECT 'closed_site', ShipSite, sum(MUnits), 0 FROM outbound WHERE ShipSite IN ('ASIA', 'EUROPE') GROUP BY ShipSite
  UNION ALL SELECT 'arc', ShipSite || '|' || Loc, sum(MUnits), 4000 FROM outbound GROUP BY ShipSite, Loc HAVING sum(MUnits) > 4000
  UNION ALL SELECT 'max_served', ShipSite, CAST(count(DISTINCT Loc) AS DOUBLE), 3 FROM outbound GROUP BY ShipSite HAVING count(DISTINCT Loc) > 3"""),
)
def single_source_check(t):
    out, moved = _plan(t, keep=True)
    rules = {"sites_per_customer": 1, "max_open": 2, "closed": ["ASIA", "EUROPE"], "arc_limit": 4000, "max_served": 3}
    return check.check_plan(out, cut(moved), c.kept_demand(t), c.kept_supply(t), c.caps(t), **rules)


def _split_sql(k: int) -> str:
    return f"""c{k} AS (SELECT Loc, wanted.RPType, MUnits, ShipSite, MfgSite, CAST(Miles * 0.00615 AS DECIMAL(18, 8)) + Inbound AS Unit
      FROM wanted JOIN dist ON Dest = Loc JOIN i{k} ON i{k}.ShipSite = Orig AND i{k}.RPType = wanted.RPType
      QUALIFY row_number() OVER (PARTITION BY Loc, wanted.RPType ORDER BY Unit, ShipSite) = 1)"""


def _whole_sql(k: int) -> str:
    return f"""t{k} AS (SELECT MSTName, Loc, FTerms, demand.RPType, MUnits, ShipSite, MfgSite, CAST(Miles * 0.00615 AS DECIMAL(18, 8)) + Inbound AS Unit
      FROM demand JOIN dist ON Dest = Loc JOIN i{k} ON i{k}.ShipSite = Orig AND i{k}.RPType = demand.RPType),
    a{k} AS (SELECT * FROM (SELECT MSTName, Loc, FTerms, ShipSite, sum(CAST(MUnits AS DECIMAL(18, 0)) * Unit) AS Cost FROM t{k} GROUP BY ALL)
      QUALIFY row_number() OVER (PARTITION BY MSTName, Loc, FTerms ORDER BY Cost, ShipSite) = 1),
    c{k} AS (SELECT t{k}.* FROM t{k} JOIN a{k} USING (MSTName, Loc, FTerms, ShipSite))"""


def _bound_sql(iterations: int, step: float, whole: bool = False, have: str = "scarce", gates: str = "caps") -> str:
    """The price steps written out one after the other; ``whole`` gives every customer one site."""
    parts = [
        "wanted AS (SELECT Loc, RPType, sum(MUnits) AS MUnits FROM demand GROUP BY ALL)",
        f"p0 AS (SELECT MfgSite, RPType, Capacity, CAST(0 AS DECIMAL(18, 8)) AS Price FROM {have})",
        f"g0 AS (SELECT ShipSite, Cap, CAST(0 AS DECIMAL(18, 8)) AS Price FROM {gates})",
    ]
    for k in range(1, iterations + 1):
        o = k - 1
        parts += [
            f"""i{k} AS (SELECT rates.ShipSite, RPType, MfgSite, CAST(CostPerMUnit AS DECIMAL(18, 8)) + p{o}.Price + coalesce(g{o}.Price, 0) AS Inbound
                FROM p{o} JOIN rates ON Plant = MfgSite LEFT JOIN g{o} ON g{o}.ShipSite = rates.ShipSite
                QUALIFY row_number() OVER (PARTITION BY rates.ShipSite, RPType ORDER BY Inbound, MfgSite) = 1)""",
            _whole_sql(k) if whole else _split_sql(k),
            f"""b{k} AS (SELECT CAST((SELECT sum(CAST(MUnits AS DECIMAL(18, 0)) * Unit) FROM c{k}) AS DOUBLE)
                 - CAST((SELECT sum(CAST(Capacity AS DECIMAL(18, 2)) * Price) FROM p{o}) AS DOUBLE)
                 - CAST((SELECT sum(CAST(Cap AS DECIMAL(18, 2)) * Price) FROM g{o}) AS DOUBLE) AS Bound)""",
            f"""p{k} AS (SELECT MfgSite, RPType, Capacity, CAST(greatest(round(CAST(Price AS DOUBLE) + CAST({step / k} AS DOUBLE) * (coalesce(Used, 0) - Capacity) / greatest(coalesce(Used, 0), Capacity), 6), 0) AS DECIMAL(18, 8)) AS Price
                FROM p{o} LEFT JOIN (SELECT MfgSite, RPType, sum(MUnits) AS Used FROM c{k} GROUP BY ALL) USING (MfgSite, RPType))""",
            f"""g{k} AS (SELECT ShipSite, Cap, CAST(greatest(round(CAST(Price AS DOUBLE) + CAST({step / k} AS DOUBLE) * (coalesce(Used, 0) - Cap) / greatest(coalesce(Used, 0), Cap), 6), 0) AS DECIMAL(18, 8)) AS Price
                FROM g{o} LEFT JOIN (SELECT ShipSite, sum(MUnits) AS Used FROM c{k} GROUP BY ALL) USING (ShipSite))""",
        ]
    rows = " UNION ALL ".join(f"SELECT {k} AS k, Bound FROM b{k}" for k in range(1, iterations + 1))
    return f"""WITH {", ".join(parts)} SELECT CAST(k AS INTEGER) AS Iteration, round(Bound, 3) AS Bound,
      round(max(Bound) OVER (ORDER BY k), 3) AS Best FROM ({rows})"""


@query("price_bound", "N5", with_views(_bound_sql(3, 2.0)))
def price_bound(t):
    found = bound.price_bound(c.demand(t), c.scarce(t), t.distances(), c.rates(t), t.site_names, c.caps(t), iterations=3, step=2.0)
    return found.as_table().select("Iteration", F.round("Bound", 3).alias("Bound"), F.round("Best", 3).alias("Best"))


@query("price_bound_single_source", "N5", with_views(_bound_sql(2, 2.0, whole=True)))
def price_bound_single_source(t):
    found = bound.price_bound(
        c.demand(t), c.scarce(t), t.distances(), c.rates(t), t.site_names, c.caps(t), iterations=2, step=2.0, single_source=True
    )
    return found.as_table().select("Iteration", F.round("Bound", 3).alias("Bound"), F.round("Best", 3).alias("Best"))


@query(
    "plan_between_bounds",
    "N5 N6 N7",
    with_views(
        _bound_sql(6, 2.0, have="(SELECT * REPLACE (Capacity * 3 / 2 AS Capacity) FROM supply)", gates="(SELECT ShipSite, Cap * 5 / 6 AS Cap FROM caps)")
        .replace("SELECT CAST(k AS INTEGER) AS Iteration, round(Bound, 3) AS Bound,", "SELECT")
        .replace("round(max(Bound) OVER (ORDER BY k), 3) AS Best FROM", "round(max(Bound), 3) AS Bound, true AS AboveBound, true AS WithinAQuarter FROM")
    ),
)
def plan_between_bounds(t):
    """The bound, and what holds of the plan recovered from its steps: it is allowed in every respect (else this fails),
    costs no less than the bound, and at most a quarter more. SQL gives the bound; the rest must be true."""
    wanted, gates = c.kept_demand(t), cut(_tight(t))
    have = cut(c.supply(t).withColumn("Capacity", F.col("Capacity") * 3 / 2))
    found = bound.price_bound(wanted, have, t.distances(), c.rates(t), t.site_names, gates, iterations=6, step=2.0, keep=True)
    plan = cut(bound.recover_plan(found, wanted, have, bidding.ways(t.distances(), c.rates(t)), gates))
    over = bound.gap(plan, found, wanted, have, gates)
    rows = [(round(found.best, 3), over >= 0, over <= 0.25)]
    return t.spark.createDataFrame(rows, "Bound double, AboveBound boolean, WithinAQuarter boolean")


def _best_sql(masks: list[int]) -> str:
    bits = " ".join(f"WHEN '{s}' THEN {1 << i}" for i, s in enumerate(SITES))
    return f"""WITH masks AS (SELECT unnest([{', '.join(map(str, masks))}]) AS Mask),
 picked AS (SELECT Mask, MSTName, Loc, FTerms, min(Cost) AS Cost FROM masks CROSS JOIN cust_site
            WHERE Mask & (CASE ShipSite {bits} END) <> 0 GROUP BY ALL),
 best AS (SELECT Mask FROM picked GROUP BY Mask ORDER BY sum(Cost), bit_count(Mask), Mask LIMIT 1),
 chosen AS (SELECT cust_site.* FROM cust_site, best WHERE Mask & (CASE ShipSite {bits} END) <> 0
            QUALIFY row_number() OVER (PARTITION BY MSTName, Loc, FTerms ORDER BY Cost, ShipSite) = 1),
 flows AS (SELECT ShipSite, demand.* FROM demand JOIN chosen USING (MSTName, Loc, FTerms))"""


def _best_open(t, most: int, keep: bool = False):
    """Flows of the cheapest set of at most ``most`` sites; the set is the one row that reaches the driver."""
    wanted, units = c.kept_demand(t), _units(t)
    costs = scenario.site_costs(wanted, units, t.site_names)
    best = scenario.open_site_scenarios(wanted, units, t.site_names, 1, most, top=1, costs=costs).first()
    return scenario.open_plan(wanted, units, c.inbound(t), t.site_names, best["OpenSites"].split("+"), costs=costs, keep=keep)


@query(
    "open_site_search",
    "N4",
    with_views(
        _scenario_sql(scenario.site_sets(5, 1, 3)).replace("SELECT CAST(Mask AS INTEGER) AS Mask, ", "SELECT ").replace(
            ", CAST(0 AS BIGINT) AS Unserved,", ", CAST(0 AS BIGINT) AS Unserved, (SELECT CAST(sum(least_cost) AS DOUBLE) FROM (SELECT min(Cost) AS least_cost FROM cust_site GROUP BY MSTName, Loc, FTerms)) AS Bound,"
        ).replace("CAST(row_number() OVER (ORDER BY Cost, bit_count(Mask), Mask) AS INTEGER) AS Rank FROM sums", "FROM sums ORDER BY Cost, bit_count(Mask), Mask LIMIT 1").replace("AS Bound,\n        FROM", "AS Bound FROM")
    ),
)
def open_site_search(t):
    """The best set of at most three sites, found by exchanges; enumeration in SQL."""
    steps = scenario.search_open_sites(c.kept_demand(t), _units(t), t.site_names, max_open=3)
    return steps.orderBy(F.desc("Step")).limit(1).select("OpenSites", "NOpen", "Cost", "Unserved", "Bound")


@query("best_open_plan", "N4", with_views(_best_sql(scenario.site_sets(5, 1, 2)) + " SELECT * FROM flows"))
def best_open_plan(t):
    return _best_open(t, 2)[0]


@query(
    "best_open_plan_check",
    "N4 N7",
    with_views(
        _best_sql(scenario.site_sets(5, 1, 2))
        + """, taken AS (SELECT MfgSite, RPType, sum(MUnits) AS MUnits FROM flows JOIN inbound USING (ShipSite, RPType) GROUP BY ALL)
 SELECT 'supply' AS Rule, MfgSite || '|' || RPType AS "Key", MUnits AS Actual, Capacity AS "Limit" FROM taken JOIN supply USING (MfgSite, RPType) WHERE MUnits > Capacity
 UNION ALL SELECT 'throughput', ShipSite, sum(MUnits), any_value(Cap) FROM flows JOIN caps USING (ShipSite) GROUP BY ShipSite HAVING sum(MUnits) > any_value(Cap)"""
    ),
)
def best_open_plan_check(t):
    """Rules that the plan of the best pair of sites breaks once capacity counts: none would make it the optimum."""
    out, moved = _best_open(t, 2, keep=True)
    return check.check_plan(out, cut(moved), c.kept_demand(t), c.kept_supply(t), c.caps(t), 1, 2)


def _bid_sql(rounds: int) -> str:
    """The rounds of bidding written out; a last part says whether demand with an open way is still left."""
    d = "DECIMAL(24, 6)"
    parts = [
        f"""paths AS (SELECT Plant AS MfgSite, rates.ShipSite, Dest, CAST(CAST(Miles * 0.00615 AS DECIMAL(18, 8)) + CAST(CostPerMUnit AS DECIMAL(18, 8)) AS DECIMAL(18, 8)) AS UnitCost
            FROM dist JOIN rates ON rates.ShipSite = Orig)""",
        f"s0 AS (SELECT MfgSite, RPType, CAST(Capacity AS {d}) AS Stock FROM scarce)",
        f"r0 AS (SELECT ShipSite, CAST(floor(Cap * 5 / 6 * 1000000) / 1000000 AS {d}) AS Room FROM caps)",
        f"q0 AS (SELECT MSTName, Loc, FTerms, RPType, CAST(MUnits AS {d}) AS Wanted FROM demand)",
    ]
    for k in range(1, rounds + 1):
        o = k - 1
        parts += [
            f"""w{k} AS MATERIALIZED (SELECT MfgSite, Dest, ShipSite, UnitCost FROM paths JOIN r{o} USING (ShipSite) WHERE Room > 0
                QUALIFY row_number() OVER (PARTITION BY MfgSite, Dest ORDER BY UnitCost, ShipSite) = 1)""",
            f"""o{k} AS MATERIALIZED (SELECT Dest, RPType, MfgSite, ShipSite, UnitCost,
                coalesce(UnitCost - lead(UnitCost) OVER way, -1000000000) AS Urgency, row_number() OVER way AS n
                FROM w{k} JOIN s{o} USING (MfgSite) WHERE Stock > 0
                WINDOW way AS (PARTITION BY Dest, RPType ORDER BY UnitCost, MfgSite, ShipSite))""",
            f"""b{k} AS MATERIALIZED (SELECT q.*, MfgSite, ShipSite, UnitCost, Urgency,
                sum(Wanted) OVER (PARTITION BY MfgSite, q.RPType ORDER BY Urgency, MSTName, Loc, FTerms ROWS UNBOUNDED PRECEDING) AS upto
                FROM q{o} q JOIN o{k} o ON o.Dest = q.Loc AND o.RPType = q.RPType AND n = 1)""",
            f"""f{k} AS MATERIALIZED (SELECT b.* EXCLUDE (upto), greatest(least(upto, Stock) - (upto - Wanted), 0) AS Offered
                FROM b{k} b JOIN s{o} s ON s.MfgSite = b.MfgSite AND s.RPType = b.RPType)""",
            f"""g{k} AS MATERIALIZED (SELECT *, sum(Offered) OVER (PARTITION BY ShipSite ORDER BY Urgency, MSTName, Loc, FTerms, RPType, MfgSite ROWS UNBOUNDED PRECEDING) AS upto FROM f{k})""",
            f"""t{k} AS MATERIALIZED (SELECT g.* EXCLUDE (upto), CAST(greatest(least(upto, Room) - (upto - Offered), 0) AS {d}) AS Taken FROM g{k} g JOIN r{o} USING (ShipSite))""",
            f"""s{k} AS MATERIALIZED (SELECT MfgSite, RPType, CAST(Stock - coalesce(Used, 0) AS {d}) AS Stock FROM s{o}
                LEFT JOIN (SELECT MfgSite, RPType, sum(Taken) AS Used FROM t{k} GROUP BY ALL) USING (MfgSite, RPType))""",
            f"""r{k} AS MATERIALIZED (SELECT ShipSite, CAST(Room - coalesce(Used, 0) AS {d}) AS Room FROM r{o}
                LEFT JOIN (SELECT ShipSite, sum(Taken) AS Used FROM t{k} GROUP BY ALL) USING (ShipSite))""",
            f"q{k} AS MATERIALIZED (SELECT MSTName, Loc, FTerms, RPType, CAST(Wanted - Taken AS {d}) AS Wanted FROM t{k} WHERE Wanted > Taken)",
        ]
    rows = " UNION ALL ".join(
        f"SELECT MfgSite, ShipSite, MSTName, Loc, FTerms, RPType, Taken, UnitCost, {k} AS Round FROM t{k} WHERE Taken > 0" for k in range(1, rounds + 1)
    )
    return f"WITH {', '.join(parts)}, bidden AS ({rows})"


#: Rounds that the SQL writes out; the given tables need fewer.
_ROUNDS = 16


def _tight(t):
    """Throughput caps at the site's own history: all of them together hold the demand and little more."""
    return c.caps(t).withColumn("Cap", F.col("Cap") * 5 / 6)


def _bidden(t):
    return bidding.bid_plan(c.kept_demand(t), c.scarce(t), bidding.ways(t.distances(), c.rates(t)), _tight(t))


@query(
    "throughput_plan",
    "N6",
    with_views(_bid_sql(_ROUNDS) + """ SELECT MfgSite, ShipSite, MSTName, Loc, FTerms, RPType, CAST(Taken AS DOUBLE) AS MUnits,
  CAST(CAST(Taken * UnitCost AS DECIMAL(28, 6)) AS DOUBLE) AS Cost, Round FROM bidden"""),
)
def throughput_plan(t):
    return _bidden(t)


@query(
    "throughput_shortfall",
    "N6",
    with_views(_bid_sql(_ROUNDS) + """ SELECT MSTName, Loc, FTerms, RPType, MUnits AS Wanted, CAST(coalesce(Sent, 0) AS DOUBLE) AS Sent, CAST(CAST(MUnits AS DECIMAL(24, 6)) - coalesce(Sent, 0) AS DOUBLE) AS Short
  FROM demand LEFT JOIN (SELECT MSTName, Loc, FTerms, RPType, sum(Taken) AS Sent FROM bidden GROUP BY ALL) USING (MSTName, Loc, FTerms, RPType)
  WHERE CAST(MUnits AS DECIMAL(24, 6)) > coalesce(Sent, 0)"""),
)
def throughput_shortfall(t):
    return waterfall.shortfall(c.kept_demand(t), _bidden(t))


@query(
    "throughput_check",
    "N6 N7",
    with_views(_bid_sql(_ROUNDS) + """ SELECT 'sites_per_customer' AS Rule, MSTName || '|' || Loc || '|' || FTerms AS "Key", CAST(count(DISTINCT ShipSite) AS DOUBLE) AS Actual, CAST(1 AS DOUBLE) AS "Limit"
  FROM bidden GROUP BY MSTName, Loc, FTerms HAVING count(DISTINCT ShipSite) > 1
  UNION ALL SELECT 'demand', concat_ws('|', MSTName, Loc, FTerms, RPType), CAST(coalesce(sum(Taken), 0) AS DOUBLE), any_value(demand.MUnits)
  FROM demand LEFT JOIN bidden USING (MSTName, Loc, FTerms, RPType) GROUP BY MSTName, Loc, FTerms, RPType HAVING coalesce(sum(Taken), 0) < any_value(CAST(demand.MUnits AS DECIMAL(18, 6)))"""),
)
def throughput_check(t):
    """What is wrong with the plan of the bids: demand beyond all capacity and split customers, but no supply and no
    throughput, however tight."""
    out, moved = waterfall.legs(cut(_bidden(t)))
    return check.check_plan(out, cut(moved), c.kept_demand(t), c.scarce(t), _tight(t), sites_per_customer=1)


@query(
    "best_open_plan_exact",
    "N4 N7",
    with_views(
        _best_sql(scenario.site_sets(5, 1, 2))
        + """, taken AS (SELECT MfgSite, RPType, sum(MUnits) AS MUnits FROM flows JOIN inbound USING (ShipSite, RPType) GROUP BY ALL),
 broken AS (SELECT 1 FROM taken JOIN supply USING (MfgSite, RPType) WHERE MUnits > Capacity
   UNION ALL SELECT 1 FROM flows JOIN caps USING (ShipSite) GROUP BY ShipSite HAVING sum(MUnits) > any_value(Cap))
 SELECT 'given' AS Limits, (SELECT count(*) FROM broken) = 0 AS Exact UNION ALL SELECT 'wide', true"""
    ),
)
def best_open_plan_exact(t):
    """Whether the best pair of sites is the optimum under the given limits, and under limits that are wide enough."""
    out, moved = _best_open(t, 2, keep=True)
    moved, wanted = cut(moved), c.kept_demand(t)
    have, wide = c.kept_supply(t), c.kept_supply(t).withColumn("Capacity", F.lit(1e12))
    found = cut(check.flow_rules(out, moved, wanted, 1))
    given = check.is_exact(check.check_plan(out, moved, wanted, have, c.caps(t), 1, 2, found=found))
    unbound = check.is_exact(check.check_plan(out, moved, wanted, wide, None, 1, 2, found=found))
    return t.spark.createDataFrame([("given", given), ("wide", unbound)], "Limits string, Exact boolean")


_SPOILED = """WITH bad AS (SELECT ShipSite, MSTName, Loc, FTerms, RPType,
    CASE WHEN MSTName LIKE '%7' THEN MUnits * 2 WHEN MSTName LIKE '%3' THEN -MUnits ELSE MUnits END AS MUnits FROM outbound)
  SELECT 'demand' AS Rule, concat_ws('|', MSTName, Loc, FTerms, RPType) AS "Key", bad.MUnits AS Actual, demand.MUnits AS "Limit"
  FROM bad JOIN demand USING (MSTName, Loc, FTerms, RPType) WHERE bad.MUnits <> demand.MUnits
  UNION ALL SELECT 'link', concat_ws('|', ShipSite, MSTName, Loc, FTerms, RPType), bad.MUnits, demand.MUnits
  FROM bad JOIN demand USING (MSTName, Loc, FTerms, RPType) WHERE bad.MUnits > demand.MUnits
  UNION ALL SELECT 'negative_outbound', concat_ws('|', ShipSite, MSTName, Loc, FTerms, RPType), MUnits, 0 FROM bad WHERE MUnits < 0
  UNION ALL SELECT 'site_balance', ShipSite || '|' || RPType, a, b FROM
    (SELECT ShipSite, RPType, sum(MUnits) AS a FROM moved GROUP BY ALL) JOIN (SELECT ShipSite, RPType, sum(MUnits) AS b FROM bad GROUP BY ALL) USING (ShipSite, RPType) WHERE a <> b"""


def _spoiled(t):
    out, moved = _plan(t)
    name = F.col("MSTName")
    spoiled = F.when(name.endswith("7"), F.col("MUnits") * 2).when(name.endswith("3"), -F.col("MUnits")).otherwise(F.col("MUnits"))
    bad = cut(out.withColumn("MUnits", spoiled))
    return check.check_plan(bad, cut(moved), c.kept_demand(t), c.kept_supply(t))


@query(
    "spoiled_plan_every_rule",
    "N7",
    with_views(
        _SPOILED
        + """ UNION ALL SELECT 'supply', MfgSite || '|' || RPType, Used, coalesce(Have, 0) FROM
    (SELECT MfgSite, RPType, sum(MUnits) AS Used FROM moved GROUP BY ALL)
    LEFT JOIN (SELECT MfgSite, RPType, sum(Capacity) AS Have FROM supply GROUP BY ALL) USING (MfgSite, RPType) WHERE Used > coalesce(Have, 0)"""
    ),
)
def spoiled_plan_every_rule(t):
    """The same plan with its violations of supply, which it has whether spoiled or not: all that the check reports."""
    return _spoiled(t)
