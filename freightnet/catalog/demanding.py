"""Demand, supply, forecast and its split."""

from pyspark.sql import functions as F

from freightnet.catalog import query
from freightnet.catalog import common as c
from freightnet.catalog.shaping import KEY_LENGTH, demand_sheet
from freightnet.catalog.views import with_views
from freightnet.functions.scalar import place
from freightnet.operators import tables as op
from freightnet.plans import demand as d
from freightnet.plans import forecast as fc

SWAPS = {"SMALL": "LARGE"}


@query("demand_by_customer", "B5 J4 J11 B8 C11 F4 F5 C1 C3 A1", with_views("SELECT * FROM demand"))
def demand_by_customer(t):
    return c.demand(t)


@query(
    "demand_prepaid_by_city",
    "B5 F3 J4",
    with_views("SELECT Loc, sum(MUnits) AS MUnits FROM hist WHERE FrtTermsFix = 'PPD' AND Loc IN (SELECT Dest FROM dist) GROUP BY Loc"),
)
def demand_prepaid_by_city(t):
    rows = t.history("MSTCity", "MSTState", "FrtTermsFix", "MUnits").where(F.col("FrtTermsFix") == "PPD")
    return d.demand(rows.withColumn("Loc", place("MSTCity", "MSTState")), t.distances(), ["Loc"])


@query(
    "demand_by_city_geocoded",
    "B5 J13 F1 F5",
    with_views("""SELECT h.MSTCity, h.MSTState, FrtTermsFix, MUnits, h.MSTCity || ', ' || h.MSTState AS Dest, MSTZip, lat, lon
  FROM (SELECT MSTCity, MSTState, FrtTermsFix, sum(MUnits) AS MUnits FROM hist GROUP BY ALL) h
  JOIN (SELECT * FROM geo WHERE MSTZip IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY MSTCity, MSTState ORDER BY MSTZip, lat, lon) = 1) geo
    ON geo.MSTCity = h.MSTCity AND geo.MSTState = h.MSTState"""),
)
def demand_by_city_geocoded(t):
    return d.demand_by_city(t.history("MSTCity", "MSTState", "FrtTermsFix", "MUnits"), t.geocodes())


@query("supply_from_history", "B6 A1 F6 P4", with_views("SELECT MfgSiteName AS MfgSite, RPType, sum(MUnits) AS Capacity FROM rooted GROUP BY ALL"))
def supply_from_history(t):
    return d.supply(c.plant_volume(t))


@query(
    "supply_from_capacity_sheet",
    "B6 S6 P2 P4 F5 F6",
    with_views("""SELECT MfgSiteName AS MfgSite, PrintGroup, PartType, sum(MUnits) * 6 / 5 AS Capacity FROM clean
  GROUP BY ALL HAVING max(l_partkey) % 13 <> 0"""),
)
def supply_from_capacity_sheet(t):
    return d.supply_from_capacity(t.capacity_sheet())


@query(
    "root_products",
    "B8 S7 J11 C11",
    with_views("SELECT PTypeFix, PartType, RootPartType, RPType, sum(MUnits) AS MUnits FROM rooted JOIN root_key USING (PartType) GROUP BY ALL").replace("PartType, RootPartType, RPType, sum", "PartType, root_key.RootPartType, RPType, sum"),
)
def root_products(t):
    return op.total(c.plant_volume(t), ["PTypeFix", "PartType", "RootPartType", "RPType"], "MUnits")


@query(
    "sheet_demand_located",
    "B9 J1 P6 A1",
    """SELECT 'Master ' || (c_custkey - c_custkey % 3) AS MSTName, n_name || ', ' || substr(r_name, 1, 2) AS Loc, p_type AS ITEM, 'PPD' AS FTerms, CAST(sum(v) AS DOUBLE) AS MUnits
FROM (SELECT *, (p_partkey * (i + 3)) % 19 - 4 AS v, i // 3 AS ms FROM part CROSS JOIN range(78) r(i))
LEFT JOIN (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE c_custkey % 13 <> 5) ON c_custkey = ms
WHERE p_partkey % 29 <> 0 AND p_partkey % 31 <> 0 AND v > 0 GROUP BY ALL""",
)
def sheet_demand_located(t):
    sheet, cols = demand_sheet(t)
    return d.locate_demand(d.unpivot_demand_sheet(sheet, cols, KEY_LENGTH), t.masters(KEY_LENGTH))


@query("forecast_by_plant", "B4 J10 A8 F8", with_views("SELECT * FROM fcst"))
def forecast_by_plant(t):
    return fc.forecast(t.forecast_sheet(), t.sites(), "200112", "200102", "200107")


SPLIT = """WITH placed AS (SELECT MSTName, Loc, 'PPD' AS FTerms, PrintGroup, replace(PartType, 'SMALL', 'LARGE') AS PartType, MUnits FROM clean),
 base AS (SELECT MSTName, Loc, FTerms, PrintGroup, PartType, sum(MUnits) AS MUnits FROM placed GROUP BY ALL),
 shares AS (SELECT MSTName, Loc, FTerms, PrintGroup, PartType, MUnits / nullif(sum(MUnits) OVER (PARTITION BY {by}), 0) AS Pct FROM base),
 parts AS (SELECT PrintGroup, replace(PartType, 'SMALL', 'LARGE') AS PartType, sum(OLMUnits) AS u FROM fcst GROUP BY ALL)
 """


def _history(t):
    return c.clean(t, "MSTName", "FrtTermsFix", "PrintGroup", "PartType")


def _forecast(t):
    return fc.forecast(t.forecast_sheet(), t.sites(), "200112", "200102", "200107")


@query("split_share", "W3 B7 C4 P6 P3", with_views(SPLIT.format(by="PrintGroup, PartType") + "SELECT * FROM shares"))
def split_share(t):
    return fc.split_share(_history(t), SWAPS, tasks=t.tasks)


@query("split_share_by_part", "W3", with_views(SPLIT.format(by="PartType") + "SELECT * FROM shares"))
def split_share_by_part(t):
    return fc.split_share(_history(t), SWAPS, by=("PartType",), tasks=t.tasks)


@query(
    "allocate_forecast",
    "B7 J12 A4 P5 P2",
    with_views(SPLIT.format(by="PrintGroup, PartType") + "SELECT MSTName, Loc, FTerms, PrintGroup, PartType, Pct * u AS MUnits FROM shares JOIN parts USING (PrintGroup, PartType)"),
)
def allocate_forecast(t):
    return fc.allocate_forecast(fc.split_share(_history(t), SWAPS, tasks=t.tasks), _forecast(t), SWAPS)


@query(
    "forecast_without_history",
    "Q5 J5",
    with_views("""SELECT PrintGroup, PartType, sum(OLMUnits) AS OLMUnits FROM fcst
  WHERE (PrintGroup, PartType) NOT IN (SELECT (PrintGroup, PartType) FROM clean) GROUP BY ALL"""),
)
def forecast_without_history(t):
    return fc.lost_forecast(fc.split_share(_history(t), tasks=t.tasks), _forecast(t))
