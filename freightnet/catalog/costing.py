"""Cost of today's flows and of lanes."""

from pyspark.sql import functions as F

from freightnet.catalog import common as c
from freightnet.catalog import query
from freightnet.catalog.views import with_views
from freightnet.functions.scalar import EARLIER_RATES, freight
from freightnet.operators import tables as op
from freightnet.plans import cost
from freightnet.plans.network import CUSTOMER

FREIGHT = "CASE WHEN FrtTermsFix = 'CPU' THEN 0 ELSE CAST(CAST(MUnits * Miles AS DECIMAL(24, 0)) * {rate} AS DOUBLE) END"
FLOWS = "(SELECT ShipSiteName, Loc, FrtTermsFix, sum(MUnits) AS MUnits FROM clean GROUP BY ALL)"


@query(
    "baseline_outbound",
    "B12 J2 A1 F4 F5 C12",
    with_views(f"SELECT ShipSiteName, Loc, FrtTermsFix, MUnits, Miles, {FREIGHT.format(rate='0.00615')} AS Freight FROM {FLOWS} JOIN dist ON Orig = ShipSiteName AND Dest = Loc"),
)
def baseline_outbound(t):
    return cost.baseline_outbound(c.clean(t, "FrtTermsFix"), t.distances())


@query(
    "baseline_freight_by_site",
    "B12 A1 A2",
    with_views(f"""SELECT ShipSiteName, sum(MUnits) AS MUnits, sum({FREIGHT.format(rate='0.00615')}) AS Freight FROM
  (SELECT ShipSiteName, FrtTermsFix, sum(MUnits * Miles) AS mm, sum(MUnits) AS MUnits FROM clean JOIN dist ON Orig = ShipSiteName AND Dest = Loc GROUP BY ALL)
  GROUP BY ShipSiteName""").replace("MUnits * Miles AS DECIMAL", "mm AS DECIMAL"),
)
def baseline_freight_by_site(t):
    rows = cost.baseline_outbound(c.clean(t, "FrtTermsFix"), t.distances())
    return rows.groupBy("ShipSiteName").agg(F.sum("MUnits").alias("MUnits"), F.sum("Freight").alias("Freight"))


@query(
    "freight_by_rate",
    "C12",
    with_views("""SELECT Loc, CAST(CAST(sum(MUnits * Miles) AS DECIMAL(24, 0)) * 0.005565 AS DOUBLE) AS f5565,
  CAST(CAST(sum(MUnits * Miles) AS DECIMAL(24, 0)) * 0.00564 AS DOUBLE) AS f564,
  CAST(CAST(sum(MUnits * Miles) AS DECIMAL(24, 0)) * 0.00577 AS DOUBLE) AS f577 FROM clean JOIN dist ON Orig = ShipSiteName AND Dest = Loc GROUP BY Loc"""),
)
def freight_by_rate(t):
    flows = op.lookup(op.total(c.clean(t), ["ShipSiteName", "Loc"], "MUnits"), t.distances(), {"ShipSiteName": "Orig", "Loc": "Dest"}, "inner")
    names = ["f5565", "f564", "f577"]
    return flows.groupBy("Loc").agg(*[F.sum(freight("MUnits", "Miles", None, r)).alias(n) for n, r in zip(names, EARLIER_RATES)])


@query(
    "baseline_inter_site",
    "B13 J2 P5 K8",
    with_views("""SELECT MfgSiteName, ShipSiteName, MUnits, CostPerMUnit, MUnits * CostPerMUnit AS Freight
  FROM (SELECT MfgSiteName, ShipSiteName, sum(MUnits) AS MUnits FROM clean GROUP BY ALL) LEFT JOIN rates ON Plant = MfgSiteName AND ShipSite = ShipSiteName"""),
)
def baseline_inter_site(t):
    return cost.baseline_inter_site(c.site_volume(t), c.rates(t))


@query("production_by_plant", "B14", with_views("SELECT MfgSiteName, sum(MUnits) AS MUnits FROM clean GROUP BY ALL"))
def production_by_plant(t):
    return cost.production_by_plant(c.site_volume(t))


@query(
    "unit_miles",
    "B15 F3 A1 F5 C1 J2 P5",
    with_views("""SELECT ShipSiteName, MSTCity, MSTState, FrtTermsFix, MUnits, MSTCity || ', ' || MSTState AS Dest, Miles, MUnits * Miles AS MUnitMiles
  FROM (SELECT ShipSiteName, MSTCity, MSTState, FrtTermsFix, sum(MUnits) AS MUnits FROM hist WHERE FrtTermsFix <> 'CPU' GROUP BY ALL)
  JOIN dist ON Orig = ShipSiteName AND Dest = MSTCity || ', ' || MSTState"""),
)
def unit_miles(t):
    return cost.unit_miles(t.history("ShipSiteName", "MSTCity", "MSTState", "FrtTermsFix", "MUnits"), t.distances())


@query(
    "lanes_with_cost",
    "B10 J6 J7 C12",
    with_views("""SELECT MSTName, Loc, FTerms, Orig AS ShipSite, Miles, CAST(Miles * 0.00615 AS DECIMAL(18, 8))::DOUBLE AS Cost
  FROM (SELECT DISTINCT MSTName, Loc, FTerms FROM demand) JOIN dist ON Dest = Loc"""),
)
def lanes_with_cost(t):
    customers = c.demand(t).select(*CUSTOMER).distinct()
    return cost.lane_cost(cost.lanes(customers, t.distances()))


@query(
    "routes",
    "J8 B10",
    with_views("""SELECT MSTName, Loc, FTerms, Orig AS ShipSite, Miles, RPType, MUnits FROM demand JOIN dist ON Dest = Loc"""),
)
def routes(t):
    wanted = c.demand(t)
    return cost.routes(cost.lanes(wanted.select(*CUSTOMER).distinct(), t.distances()), wanted)


@query(
    "inter_site_penalty",
    "B11 S5",
    with_views("""SELECT MfgSiteName, ShipSiteName, MUnits, c AS CostPerMUnit, MUnits * c AS Freight
  FROM (SELECT MfgSiteName, ShipSiteName, sum(MUnits) AS MUnits FROM clean GROUP BY ALL)
  JOIN (SELECT Plant, ShipSite, CASE WHEN Plant <> ShipSite AND ShipSite = 'ASIA' THEN 100 ELSE CostPerMUnit END AS c FROM rates) ON Plant = MfgSiteName AND ShipSite = ShipSiteName"""),
)
def inter_site_penalty(t):
    return cost.baseline_inter_site(c.site_volume(t), cost.inter_site_cost(c.rates(t), 100.0, "ASIA"))


@query(
    "inter_site_penalty_everywhere",
    "B11",
    with_views("""SELECT MfgSiteName, ShipSiteName, MUnits, c AS CostPerMUnit, MUnits * c AS Freight
  FROM (SELECT MfgSiteName, ShipSiteName, sum(MUnits) AS MUnits FROM clean GROUP BY ALL)
  JOIN (SELECT Plant, ShipSite, CASE WHEN Plant <> ShipSite THEN 100 ELSE CostPerMUnit END AS c FROM rates) ON Plant = MfgSiteName AND ShipSite = ShipSiteName"""),
)
def inter_site_penalty_everywhere(t):
    return cost.baseline_inter_site(c.site_volume(t), cost.inter_site_cost(c.rates(t), 100.0))


@query(
    "baseline_outbound_fractions",
    "B12 C12 A1",
    with_views("""SELECT ShipSiteName, Loc, FrtTermsFix, CAST(m AS DOUBLE) AS MUnits, Miles + 0.375 AS Miles,
    CASE WHEN FrtTermsFix = 'PPD' THEN CAST(CAST(CAST(m AS DECIMAL(20, 6)) * CAST(CAST(Miles + 0.375 AS DECIMAL(14, 6)) * 0.00615 AS DECIMAL(18, 10)) AS DECIMAL(28, 6)) AS DOUBLE) ELSE 0 END AS Freight
  FROM (SELECT ShipSiteName, Loc, FrtTermsFix, sum(CAST(MUnits / 8 + 0.001 AS DECIMAL(20, 6))) AS m FROM clean WHERE l_linenumber <> 3 GROUP BY ALL)
  JOIN dist ON Orig = ShipSiteName AND Dest = Loc"""),
)
def baseline_outbound_fractions(t):
    """The same over fractional volumes and miles, with lines that have no freight terms."""
    rows = c.clean(t, "FrtTermsFix", "l_linenumber").withColumns(
        {"MUnits": F.col("MUnits") / 8 + 0.001, "FrtTermsFix": F.when(F.col("l_linenumber") != 3, F.col("FrtTermsFix"))}
    )
    dist = t.distances().withColumn("Miles", F.col("Miles") + 0.375)
    return cost.baseline_outbound(rows, dist)
