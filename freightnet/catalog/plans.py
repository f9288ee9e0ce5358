"""Plan tables and map rows."""

from pyspark.sql import functions as F

from freightnet.catalog import common as c
from freightnet.catalog import query
from freightnet.catalog.decisions import _plan
from freightnet.catalog.views import with_views
from freightnet.functions.scalar import lid_or_cup
from freightnet.operators import tables as op
from freightnet.plans import cost, demand, forecast, geo, network, report
from freightnet.scale import cut, fresh_path
from freightnet.schemas import VOLUME
from freightnet.sources.readers import read_table
from freightnet.sources.writers import write_table, write_tsv

FREIGHT = "CASE WHEN FTerms = 'PPD' THEN CAST(CAST(MUnits * Miles AS DECIMAL(24, 0)) * 0.00615 AS DOUBLE) ELSE 0 END"
OUT = f"""(SELECT ShipSite, MSTName AS Cust, Loc AS Dest, FTerms, RPType AS PType, MUnits, {FREIGHT} AS Freight, Miles
  FROM outbound JOIN dist ON Orig = ShipSite AND dist.Dest = Loc)"""


def _outbound(t):
    return report.outbound_rows(_plan(t)[0], t.distances())


@query("plan_outbound", "K1 J3 C12 C13", with_views(f"SELECT * FROM {OUT}"))
def plan_outbound(t):
    return _outbound(t)


@query(
    "plan_inter_site",
    "K2",
    with_views("""SELECT MfgSite, moved.ShipSite, RPType AS PType, MUnits, MUnits * CostPerMUnit AS Freight
  FROM moved JOIN rates ON Plant = MfgSite AND rates.ShipSite = moved.ShipSite WHERE MfgSite <> moved.ShipSite"""),
)
def plan_inter_site(t):
    return report.inter_site_rows(_plan(t)[1], c.rates(t))


@query("plan_by_ship_site", "K3", with_views(f"SELECT ShipSite, sum(MUnits) AS SumMUnits, CAST(sum(CAST(Freight AS DECIMAL(24, 6))) AS DOUBLE) AS Freight FROM {OUT} GROUP BY ALL"))
def plan_by_ship_site(t):
    return report.site_summary(_outbound(t), "ShipSite")


@query(
    "plan_lane_summary",
    "K4 J13",
    with_views(f"SELECT ShipSite, o.Dest, sum(MUnits) AS MUnits, any_value(lat) AS lat, any_value(lon) AS lon FROM {OUT} o JOIN cent ON cent.Dest = o.Dest GROUP BY ALL"),
)
def plan_lane_summary(t):
    return report.lane_summary(_outbound(t), geo.dest_centroids(t.geocodes()))


@query(
    "inter_site_lane_summary",
    "K4",
    with_views("SELECT MfgSiteName AS MfgSite, ShipSiteName AS ShipSite, sum(MUnits) AS MUnits FROM clean WHERE MfgSiteName <> ShipSiteName GROUP BY ALL"),
)
def inter_site_lane_summary(t):
    moved = c.site_volume(t).where(F.col("MfgSiteName") != F.col("ShipSiteName"))
    return report.inter_site_lanes(moved.withColumnsRenamed({"MfgSiteName": "MfgSite", "ShipSiteName": "ShipSite"}))


MOVES = """(SELECT MfgSite, moved.ShipSite, RPType AS PType, MUnits, MUnits * CostPerMUnit AS Freight
  FROM moved JOIN rates ON Plant = MfgSite AND rates.ShipSite = moved.ShipSite WHERE MfgSite <> moved.ShipSite)"""


def _moves(t):
    return report.inter_site_rows(_plan(t)[1], c.rates(t))


@query(
    "plan_by_plant",
    "K3",
    with_views(f"SELECT MfgSite, sum(MUnits) AS SumMUnits, CAST(sum(CAST(Freight AS DECIMAL(24, 6))) AS DOUBLE) AS Freight FROM {MOVES} GROUP BY ALL"),
)
def plan_by_plant(t):
    return report.site_summary(_moves(t), "MfgSite")


@query("plan_inter_site_lanes", "K4", with_views(f"SELECT MfgSite, ShipSite, sum(MUnits) AS MUnits FROM {MOVES} GROUP BY ALL"))
def plan_inter_site_lanes(t):
    return report.inter_site_lanes(_moves(t))


@query(
    "plan_lane_lines",
    "K6 J14 W4",
    with_views(f"""SELECT ShipSite, Dest, MUnits, sum(MUnits) OVER (PARTITION BY Dest) AS DestMUnits, Latitude AS OrigLat, Longitude AS OrigLon, lat AS DestLat, lon AS DestLon
  FROM (SELECT ShipSite, Dest, sum(MUnits) AS MUnits FROM {OUT} GROUP BY ALL) LEFT JOIN fac ON Name = ShipSite LEFT JOIN cent USING (Dest)"""),
)
def plan_lane_lines(t):
    lanes = op.total(_outbound(t), ["ShipSite", "Dest"], "MUnits")
    return report.lane_lines(cut(lanes), t.facilities(), geo.dest_centroids(t.geocodes()))


@query(
    "plan_inter_site_lines",
    "K6 J14 W4",
    with_views(f"""SELECT MfgSite, ShipSite, MUnits, sum(MUnits) OVER (PARTITION BY ShipSite) AS SiteMUnits, a.Latitude AS OrigLat, a.Longitude AS OrigLon, b.Latitude AS DestLat, b.Longitude AS DestLon
  FROM (SELECT MfgSite, ShipSite, sum(MUnits) AS MUnits FROM {MOVES} GROUP BY ALL) LEFT JOIN fac a ON a.Name = MfgSite LEFT JOIN fac b ON b.Name = ShipSite"""),
)
def plan_inter_site_lines(t):
    return report.inter_site_lines(cut(report.inter_site_lanes(_moves(t))), t.facilities())


FORECAST_PLAN = """WITH placed AS (SELECT MSTName, Loc, 'PPD' AS FTerms, PrintGroup, PartType, MUnits FROM clean),
 base AS (SELECT MSTName, Loc, FTerms, PrintGroup, PartType, sum(MUnits) AS MUnits FROM placed GROUP BY ALL),
 shares AS (SELECT MSTName, Loc, FTerms, PrintGroup, PartType, MUnits / nullif(sum(MUnits) OVER (PARTITION BY PrintGroup, PartType), 0) AS Pct FROM base),
 parts AS (SELECT PrintGroup, PartType, sum(OLMUnits) AS u FROM fcst GROUP BY ALL),
 wanted AS (SELECT MSTName, Loc, FTerms, CASE WHEN substr(PartType, 1, 1) = 'L' THEN PartType ELSE RootPartType END AS RPType,
                   sum(CAST(Pct * u AS DECIMAL(24, 6))) AS MUnits
            FROM shares JOIN parts USING (PrintGroup, PartType) JOIN root_key USING (PartType)
            WHERE Loc IN (SELECT Dest FROM dist) GROUP BY ALL),
 costs AS (SELECT MSTName, Loc, FTerms, ShipSite, sum(CAST(MUnits * Unit AS DECIMAL(28, 6))) AS Cost
           FROM wanted JOIN units ON Loc = Dest AND wanted.RPType = units.RPType GROUP BY ALL),
 chosen AS (SELECT * FROM costs QUALIFY row_number() OVER (PARTITION BY MSTName, Loc, FTerms ORDER BY Cost, ShipSite) = 1),
 flows AS (SELECT ShipSite, wanted.* FROM wanted JOIN chosen USING (MSTName, Loc, FTerms))
 SELECT ShipSite, round(CAST(sum(MUnits) AS DOUBLE), 3) AS SumMUnits, round(CAST(sum(CAST(MUnits * CAST(Miles * 0.00615 AS DECIMAL(18, 10)) AS DECIMAL(28, 6))) AS DOUBLE), 2) AS Freight
 FROM flows JOIN dist ON Orig = ShipSite AND dist.Dest = Loc GROUP BY ShipSite"""


def _forecast_plan(t):
    """Past shares spread the forecast over customers; root products and lanes decide the site."""
    shares = forecast.split_share(c.clean(t, "MSTName", "FrtTermsFix", "PrintGroup", "PartType"), tasks=t.tasks)
    expected = forecast.forecast(t.forecast_sheet(), t.sites(), "200112", "200102", "200107")
    spread = forecast.allocate_forecast(shares, expected).withColumn("PTypeFix", lid_or_cup("PartType"))
    rooted = demand.root_product_key(spread, c.root_list(t))
    wanted = cut(demand.demand(rooted, t.distances(), [*network.CUSTOMER, "RPType"]))
    units = network.unit_costs(t.distances(), c.inbound(t), t.site_names)
    return network.assigned_plan(wanted, network.single_source_assign(wanted, units, t.site_names), c.inbound(t))


@query("forecast_plan_by_site", "B7 B8 N3 K1 K3", with_views(FORECAST_PLAN))
def forecast_plan_by_site(t):
    """From the forecast to a plan, summed by site."""
    rows = report.site_summary(report.outbound_rows(_forecast_plan(t)[0], t.distances()), "ShipSite")
    return rows.select("ShipSite", F.round("SumMUnits", 3).alias("SumMUnits"), F.round(F.col("Freight").cast("double"), 2).alias("Freight"))


_FLOWS = FORECAST_PLAN[: FORECAST_PLAN.rindex(" SELECT ShipSite, round(")]


def _three(column: str):
    """Rounded as decimals are, so that both engines round halves alike."""
    return F.round(F.col(column).cast(VOLUME), 3).cast("double")


def _rounded(rows):
    money = F.round(F.col("Freight").cast(VOLUME), 2).cast("double")
    return rows.withColumns({"MUnits": _three("MUnits"), "Freight": money})


@query(
    "forecast_outbound",
    "B7 K1",
    with_views(_FLOWS + """ SELECT ShipSite, MSTName AS Cust, Loc AS Dest, FTerms, RPType AS PType, CAST(CAST(MUnits AS DECIMAL(24, 3)) AS DOUBLE) AS MUnits,
  CAST(CAST(CAST(MUnits * CAST(Miles * 0.00615 AS DECIMAL(18, 10)) AS DECIMAL(28, 6)) AS DECIMAL(28, 2)) AS DOUBLE) AS Freight
  FROM flows JOIN dist ON Orig = ShipSite AND dist.Dest = Loc WHERE MUnits > 0"""),
)
def forecast_outbound(t):
    """Outbound flows that the forecast asks for."""
    rows = report.outbound_rows(_forecast_plan(t)[0], t.distances()).drop("Miles")
    return _rounded(rows)


@query(
    "forecast_inter_site",
    "B7 K2",
    with_views(_FLOWS + """ SELECT MfgSite, flows.ShipSite, flows.RPType AS PType, CAST(CAST(sum(MUnits) AS DECIMAL(24, 3)) AS DOUBLE) AS MUnits,
  CAST(CAST(sum(MUnits) * CAST(any_value(CostPerMUnit) AS DECIMAL(10, 2)) AS DECIMAL(28, 2)) AS DOUBLE) AS Freight
  FROM flows JOIN inbound ON inbound.ShipSite = flows.ShipSite AND inbound.RPType = flows.RPType
  JOIN rates ON Plant = MfgSite AND rates.ShipSite = flows.ShipSite WHERE MfgSite <> flows.ShipSite GROUP BY ALL"""),
)
def forecast_inter_site(t):
    """Moves between plants and sites that the forecast asks for."""
    rows = report.inter_site_rows(_forecast_plan(t)[1], c.rates(t))
    return _rounded(rows)


@query(
    "forecast_lanes",
    "B7 K4 J13",
    with_views(_FLOWS + """ SELECT ShipSite, cent.Dest, CAST(CAST(sum(MUnits) AS DECIMAL(24, 3)) AS DOUBLE) AS MUnits, any_value(lat) AS lat, any_value(lon) AS lon
  FROM flows JOIN cent ON cent.Dest = Loc GROUP BY ALL"""),
)
def forecast_lanes(t):
    """Lanes of the forecast with the coordinates of their ends."""
    out = report.outbound_rows(_forecast_plan(t)[0], t.distances())
    return report.lane_summary(out, geo.dest_centroids(t.geocodes())).withColumn("MUnits", _three("MUnits"))


@query(
    "demand_bubbles",
    "K5 J13 C15",
    with_views("SELECT Loc, MUnits, lat, lon, floor(MUnits / 5000) * 5000 AS SizeBin FROM (SELECT Loc, sum(MUnits) AS MUnits FROM clean GROUP BY Loc) LEFT JOIN cent ON Dest = Loc"),
)
def demand_bubbles(t):
    return report.bubbles(c.clean(t), geo.dest_centroids(t.geocodes()), step=5000)


@query(
    "demand_bubbles_prepaid",
    "K5 F3",
    with_views("SELECT Loc, MUnits, lat, lon, floor(MUnits / 2000) * 2000 AS SizeBin FROM (SELECT Loc, sum(MUnits) AS MUnits FROM clean WHERE FrtTermsFix = 'PPD' GROUP BY Loc) LEFT JOIN cent ON Dest = Loc"),
)
def demand_bubbles_prepaid(t):
    rows = c.clean(t, "FrtTermsFix").where(F.col("FrtTermsFix") == "PPD")
    return report.bubbles(rows, geo.dest_centroids(t.geocodes()), step=2000)


@query(
    "lane_lines",
    "K6 J14 W4",
    with_views("""SELECT ShipSite, Dest, MUnits, sum(MUnits) OVER (PARTITION BY Dest) AS DestMUnits, Latitude AS OrigLat, Longitude AS OrigLon, lat AS DestLat, lon AS DestLon
  FROM (SELECT ShipSiteName AS ShipSite, Loc AS Dest, sum(MUnits) AS MUnits FROM clean GROUP BY ALL) LEFT JOIN fac ON Name = ShipSite LEFT JOIN cent USING (Dest)"""),
)
def lane_lines(t):
    rows = c.clean(t).withColumnsRenamed({"ShipSiteName": "ShipSite", "Loc": "Dest"})
    lanes = op.total(rows, ["ShipSite", "Dest"], "MUnits")
    return report.lane_lines(lanes, t.facilities(), geo.dest_centroids(t.geocodes()))


@query(
    "inter_site_lines",
    "K6 J14 W4",
    with_views("""SELECT MfgSite, ShipSite, MUnits, sum(MUnits) OVER (PARTITION BY ShipSite) AS SiteMUnits, a.Latitude AS OrigLat, a.Longitude AS OrigLon, b.Latitude AS DestLat, b.Longitude AS DestLon
  FROM (SELECT MfgSiteName AS MfgSite, ShipSiteName AS ShipSite, sum(MUnits) AS MUnits FROM clean GROUP BY ALL) LEFT JOIN fac a ON a.Name = MfgSite LEFT JOIN fac b ON b.Name = ShipSite"""),
)
def inter_site_lines(t):
    rows = c.site_volume(t).withColumnsRenamed({"ShipSiteName": "ShipSite", "MfgSiteName": "MfgSite"})
    return report.inter_site_lines(report.inter_site_lanes(rows), t.facilities())


BASE = """SELECT MfgSiteName, ShipSiteName, MUnits, CostPerMUnit, MUnits * CostPerMUnit AS Freight
  FROM (SELECT MfgSiteName, ShipSiteName, sum(MUnits) AS MUnits FROM clean GROUP BY ALL) LEFT JOIN rates ON Plant = MfgSiteName AND ShipSite = ShipSiteName"""


def _inter_site(t):
    rows = cost.baseline_inter_site(c.site_volume(t), c.rates(t))
    return rows.withColumn("Freight", F.col("Freight").cast("double"))


@query("written_table", "K7 S1", with_views(BASE))
def written_table(t):
    rows = _inter_site(t)
    path = fresh_path(t.spark, "inter-site")
    write_table(rows, path)
    return read_table(t.spark, path, rows.schema)


@query("written_tsv", "K8", with_views(BASE))
def written_tsv(t):
    rows = _inter_site(t)
    path = fresh_path(t.spark, "inter-site-tsv")
    write_tsv(rows, path)
    return t.spark.read.schema(rows.schema).option("sep", "\t").option("header", True).csv(path)
