"""Scans, filters, reshaping, profiles and checks."""

from pyspark.sql import functions as F

from freightnet.catalog import query
from freightnet.catalog.common import clean, demand, kept_supply, rates, site_volume
from freightnet.catalog.views import with_views
from freightnet.functions import scalar as s
from freightnet.operators import quality as ql
from freightnet.operators import tables as op
from freightnet.plans import geo
from freightnet.plans.demand import sheet_cells, sheet_drops, unpivot_demand_sheet
from freightnet.plans.waterfall import cheapest_routes
from freightnet.scale import deal
from freightnet.sources import readers

# The columns that the SQL versions name.
SITES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query(
    "scan_history_month",
    "S1 P1 F3",
    with_views("""SELECT l_orderkey, l_linenumber, ShipSiteName, MSTName, MSTCity, FrtTermsFix, PartType, PrintGroup, MUnits
 FROM hist WHERE ShipMonth = 199807 AND FrtTermsFix = 'PPD'"""),
)
def scan_history_month(t):
    cols = ["l_orderkey", "l_linenumber", "ShipSiteName", "MSTName", "MSTCity", "FrtTermsFix", "PartType", "PrintGroup", "MUnits"]
    # A range on the stored date, not a test on the derived month, so that it reaches the scan.
    july = (F.col("l_shipdate") >= "1998-07-01") & (F.col("l_shipdate") < "1998-08-01")
    return t.history(*cols, "l_shipdate").where(july & (F.col("FrtTermsFix") == "PPD")).select(*cols)


@query(
    "distances_with_gaps",
    "S2 F9 P4",
    with_views("""SELECT or_city AS "or.City", or_state AS "or.State", de_city AS "de.City", de_state AS "de.State",
  Miles * 1.5 AS "Distance.Distance", Miles FROM raw_dist WHERE Miles IS NULL"""),
)
def distances_with_gaps(t):
    return op.rows_with_missing(t.raw_distances(), "Distance.Distance", "Miles")


@query("clean_distances", "B2 F1 F2 P2 P8 C1", with_views("SELECT Orig, Dest, Miles FROM clean_dist"))
def clean_distances(t):
    return geo.clean_distances(t.raw_distances())


@query(
    "distances_wide",
    "R1",
    with_views("""SELECT Dest, max(Miles) FILTER (Orig = 'AFRICA') AS "AFRICA", max(Miles) FILTER (Orig = 'AMERICA') AS "AMERICA",
  max(Miles) FILTER (Orig = 'ASIA') AS "ASIA", max(Miles) FILTER (Orig = 'EUROPE') AS "EUROPE",
  max(Miles) FILTER (Orig = 'MIDDLE EAST') AS "MIDDLE EAST" FROM clean_dist GROUP BY Dest"""),
)
def distances_wide(t):
    return geo.distances_wide(geo.clean_distances(t.raw_distances()), t.site_names)


@query(
    "distance_pairs",
    "R4",
    with_views("SELECT Dest, Orig, max(Miles) AS Miles FROM clean_dist GROUP BY ALL HAVING max(Miles) IS NOT NULL"),
)
def distance_pairs(t):
    wide = geo.distances_wide(geo.clean_distances(t.raw_distances()), t.site_names)
    return op.lengthen(wide, ["Dest"], wide.columns[1:], "Orig", "Miles").where(F.col("Miles").isNotNull())


@query("dest_centroids", "B3 S3 A3", with_views("SELECT Dest, lat, lon FROM cent"))
def dest_centroids(t):
    return geo.dest_centroids(t.geocodes())


@query(
    "volume_by_facility",
    "S4 P1 J1",
    with_views("""SELECT Name, Latitude, Longitude, sum(MUnits) AS MUnits FROM hist JOIN fac ON Name = ShipSiteName GROUP BY ALL"""),
)
def volume_by_facility(t):
    sums = op.total(t.volume("ShipSiteName"), ["ShipSiteName"], "MUnits")
    return op.lookup(sums.withColumnRenamed("ShipSiteName", "Name"), t.facilities().select("Name", "Latitude", "Longitude"), {"Name": "Name"}, "inner").select("Name", "Latitude", "Longitude", "MUnits")


@query(
    "inter_site_rates_used",
    "S5 A5 J2",
    with_views("""SELECT DISTINCT MfgSiteName AS Plant, ShipSiteName AS ShipSite, CostPerMUnit FROM clean
  JOIN rates ON Plant = MfgSiteName AND ShipSite = ShipSiteName"""),
)
def inter_site_rates_used(t):
    pairs = site_volume(t).select(F.col("MfgSiteName").alias("Plant"), F.col("ShipSiteName").alias("ShipSite")).distinct()
    return pairs.join(rates(t), ["Plant", "ShipSite"])


@query(
    "forecast_from_sql_view",
    "S9 J10 A8",
    with_views("SELECT * FROM fcst"),
)
def forecast_from_sql_view(t):
    # The frames are arguments of the statement: no view name is left behind in the session.
    return t.spark.sql(
        """SELECT ForecastSet, MfgSite, SiteName AS MfgSiteName, PrintGroup, PartType, SUM(OLMUnits) AS OLMUnits
           FROM {forecast} LEFT JOIN {sites} ON SiteCode = MfgSite
           WHERE ForecastSet = '200112' AND YearMonth BETWEEN '200102' AND '200107'
           GROUP BY ForecastSet, MfgSite, SiteName, PrintGroup, PartType""",
        forecast=t.forecast_sheet(),
        sites=t.sites(),
    )


@query(
    "ragged_text_table",
    "S10 C10 P8",
    """SELECT o_orderpriority[1:1] AS prio, count(*) AS n, sum(CAST(o_custkey AS DOUBLE)) AS total FROM orders GROUP BY ALL""",
)
def ragged_text_table(t):
    line = F.concat(
        F.lit("  "), F.left("o_orderpriority", F.lit(1)), F.repeat(F.lit(" "), (F.col("o_orderkey") % 4 + 1).cast("int")),
        F.col("o_orderkey").cast("string"), F.lit(" \t "), F.col("o_custkey").cast("string"), F.lit(" "),
    )
    parsed = readers.parse_ws_table(t.orders.select(line.alias("value")), ["prio", "order", "cust"])
    return parsed.groupBy("prio").agg(F.count(F.lit(1)).alias("n"), F.sum(s.number("cust")).alias("total"))


@query(
    "network_json_capacity",
    "S11 A12",
    with_views("""SELECT RPType AS product, count(*) AS owners, CAST(sum(CAST(MUnits AS DECIMAL(24, 6))) AS DOUBLE) AS demand FROM demand GROUP BY ALL"""),
)
def network_json_capacity(t):
    key = F.concat_ws("/", "MSTName", "Loc", "FTerms")
    leaf = F.struct(F.col("RPType").alias("k"), F.struct(F.col("MUnits").alias("demand")).alias("v"))
    # One document per customer; its products are at most the product list.
    body = demand(t).groupBy(key.alias("owner")).agg(F.collect_list(leaf).alias("leaves"))
    products = F.struct(F.map_from_entries("leaves").alias("products"))
    docs = body.select(F.to_json(F.struct(F.create_map("owner", products).alias("customers"))).alias("doc"))
    rows = readers.flatten_products(docs, "doc", "customers", "demand")
    return rows.groupBy("product").agg(F.count(F.lit(1)).alias("owners"), F.sum(F.col("demand").cast("decimal(24,6)")).alias("demand"))


@query(
    "network_json_lanes",
    "S11",
    with_views("SELECT or_city AS orig, c AS dest, Miles AS miles FROM (SELECT or_city, de_city AS c, Miles FROM raw_dist WHERE Miles IS NOT NULL)"),
)
def network_json_lanes(t):
    # One document per known distance: a destination may be that of any number of customers.
    entry = F.create_map(F.concat_ws(" => ", "`or.City`", "`de.City`"), "Miles")
    docs = t.raw_distances().where("Miles IS NOT NULL").select(F.to_json(F.struct(entry.alias("distances"))).alias("doc"))
    return readers.flatten_lanes(docs, "doc")


@query(
    "network_document_leaves",
    "S11",
    with_views("""SELECT 'demand' AS section, Loc || '/' || FTerms AS owner, RPType AS item, count(*) AS n, CAST(sum(CAST(MUnits AS DECIMAL(24, 6))) AS DOUBLE) AS amount FROM demand GROUP BY ALL
  UNION ALL SELECT 'capacity', MfgSite, RPType, 1, CAST(CAST(Capacity AS DECIMAL(24, 6)) AS DOUBLE) FROM supply
  UNION ALL SELECT 'distances', '', Orig || ' => ' || Dest, 1, Miles FROM dist"""),
)
def network_document_leaves(t):
    """Documents with sections of different depth, several lanes and owners each, read without a schema."""
    entry = lambda k, v: F.struct(F.col(k).alias("k"), v.alias("v"))
    wanted = demand(t).withColumn("Place", F.concat_ws("/", "Loc", "FTerms"))
    leaf = F.map_from_entries(F.collect_list(entry("RPType", F.struct(F.col("MUnits").alias("demand")))))
    needs = wanted.groupBy("MSTName", "Place").agg(leaf.alias("products"))
    needs = needs.groupBy(F.col("MSTName").alias("owner")).agg(F.map_from_entries(F.collect_list(entry("Place", F.struct("products")))).alias("m"))
    have = kept_supply(t).groupBy(F.col("MfgSite").alias("owner")).agg(F.map_from_entries(F.collect_list(entry("RPType", F.col("Capacity")))).alias("m"))
    lanes = t.distances().withColumn("lane", F.concat_ws(" => ", "Orig", "Dest"))
    lanes = lanes.groupBy(F.col("Orig").alias("owner")).agg(F.map_from_entries(F.collect_list(entry("lane", F.col("Miles")))).alias("m"))
    docs = [
        needs.select(F.to_json(F.struct(F.struct(F.col("m").alias("places")).alias("demand"))).alias("doc")),
        have.select(F.to_json(F.struct(F.create_map("owner", "m").alias("capacity"))).alias("doc")),
        lanes.select(F.to_json(F.struct(F.col("m").alias("distances"))).alias("doc")),
    ]
    rows = readers.document_leaves(docs[0].unionByName(docs[1]).unionByName(docs[2]), "doc")
    section, amount = F.get("path", F.lit(0)), F.col("value").try_cast("double")
    deep = section == "demand"
    owner = F.when(deep, F.get("path", F.lit(2))).when(section == "capacity", F.get("path", F.lit(1))).otherwise("")
    item = F.when(deep, F.get("path", F.lit(4))).when(section == "capacity", F.get("path", F.lit(2))).otherwise(F.get("path", F.lit(1)))
    named = rows.select(section.alias("section"), owner.alias("owner"), item.alias("item"), amount.cast("decimal(24,6)").alias("amount"))
    return named.groupBy("section", "owner", "item").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))


@query(
    "lanes_checked",
    "J7 Q4",
    with_views("SELECT ShipSiteName, Loc, sum(MUnits) AS MUnits, any_value(Miles) AS Miles FROM clean JOIN dist ON Orig = ShipSiteName AND Dest = Loc GROUP BY ALL"),
)
def lanes_checked(t):
    """Flows to known places with the one distance of their lane; a lane with none or several would fail the job."""
    flows = op.total(op.keep_known(clean(t), t.distances(), {"Loc": "Dest"}), ["ShipSiteName", "Loc"], "MUnits")
    return op.lookup_one(flows, t.distances(), {"ShipSiteName": "Orig", "Loc": "Dest"})


@query(
    "dropped_rows",
    "F1 F6 F7 C10 B9",
    with_views("""WITH d AS (SELECT CASE WHEN substr(de_city, length(de_city)) <> '4' THEN de_state END AS s, de_city AS c FROM raw_dist),
  cells AS (SELECT p_partkey, i, (p_partkey * (i + 3)) % 19 - 4 AS v FROM part CROSS JOIN range(78) r(i)),
  typed AS (SELECT CASE WHEN p_partkey % 31 = 0 AND p_partkey % 29 <> 0 THEN 'null_key' WHEN p_partkey % 29 = 0 THEN 'header' WHEN v = 0 THEN 'empty'
                        WHEN v = 7 THEN 'unreadable' WHEN v < 0 THEN 'not_positive' END AS reason FROM cells)
  SELECT 'distances' AS step, reason, count(*) AS n FROM
    (SELECT CASE WHEN s IS NULL THEN 'null_key' WHEN s IN ('EX', 'PR', 'HI', 'XX') THEN 'off_network_state' WHEN c = 'GNANGARA' AND s = 'WA' THEN 'miscoded_place' END AS reason FROM d)
  WHERE reason IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'demand_sheet', reason, count(*) FROM typed WHERE reason IS NOT NULL GROUP BY ALL"""),
)
def dropped_rows(t):
    """How many rows the cleaning steps leave out, by reason: some places without a state, some cells that are no numbers."""
    state = F.col("`de.State`")
    raw = t.raw_distances().withColumn("de.State", F.when(~F.col("`de.City`").endswith("4"), state))
    sheet, cols = demand_sheet(t)
    sheet = sheet.select("ITEM", "Print", *[F.when(F.col(c) == "7", "n/a").otherwise(F.col(c)).alias(c) for c in cols])
    lost = op.drop_counts(raw, geo.distance_drops()).withColumn("step", F.lit("distances"))
    cells = op.drop_counts(sheet_cells(sheet, cols), sheet_drops()).withColumn("step", F.lit("demand_sheet"))
    return lost.unionByName(cells).where(F.col("n") > 0).select("step", "reason", "n")


@query(
    "history_medians",
    "A11 Q2",
    with_views("""SELECT 'ShipMonth' AS "column", median(ShipMonth) AS median FROM hist UNION ALL SELECT 'MUnits', median(MUnits) FROM hist
  UNION ALL SELECT 'Price', median(l_extendedprice) FROM lineitem"""),
)
def history_medians(t):
    """The middle values that a profile of the history shows, exact without a sort."""
    price = op.exact_medians(t.lineitem.selectExpr("l_extendedprice AS Price"), most=1000)
    return op.exact_medians(t.history("ShipMonth", "MUnits"), most=1000).unionByName(price)


@query(
    "third_party_excluded",
    "F4 A2 C16",
    with_views("SELECT sum(MUnits) AS MUnits, printf('%,d', CAST(sum(MUnits) AS BIGINT)) AS Text FROM hist WHERE ShipSiteName <> 'MIDDLE EAST'"),
)
def third_party_excluded(t):
    kept = op.own_sites(t.volume("ShipSiteName"), third_party=["MIDDLE EAST"])
    return kept.agg(F.sum("MUnits").alias("MUnits")).withColumn("Text", s.thousands("MUnits"))


@query(
    "known_plants_only",
    "F5 F3",
    with_views("SELECT MfgSiteName, PrintGroup, count(*) AS n, sum(MUnits) AS MUnits FROM hist WHERE MfgSiteName IS NOT NULL AND PrintGroup = 'Brand#7' GROUP BY ALL"),
)
def known_plants_only(t):
    rows = t.history("MfgSiteName", "PrintGroup", "MUnits").where(F.col("PrintGroup") == "Brand#7").na.drop(subset=["MfgSiteName"])
    return rows.groupBy("MfgSiteName", "PrintGroup").agg(F.count(F.lit(1)).alias("n"), F.sum("MUnits").alias("MUnits"))


@query(
    "two_parts_two_cities",
    "F10",
    with_views("""SELECT MSTCity, PartType, sum(MUnits) AS MUnits FROM hist
  WHERE PartType IN ('LARGE', 'SMALL') AND MSTCity IN ('NATION_3', 'NATION_8') GROUP BY ALL"""),
)
def two_parts_two_cities(t):
    rows = t.history("MSTCity", "PartType", "MUnits")
    kept = rows.where(F.col("PartType").isin("LARGE", "SMALL") & F.col("MSTCity").isin("NATION_3", "NATION_8"))
    return op.total(kept, ["MSTCity", "PartType"], "MUnits")


@query(
    "rows_without_plant",
    "F9 Q2",
    with_views("SELECT l_orderkey, l_linenumber, l_partkey, ShipSiteName, MUnits FROM hist WHERE MfgSiteName IS NULL"),
)
def rows_without_plant(t):
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "ShipSiteName", "MUnits"]
    return op.rows_with_missing(t.history(*cols, "MfgSiteName"), "MfgSiteName", "ShipSiteName").select(*cols)


@query(
    "column_span",
    "P3 A4 P4",
    with_views("SELECT MSTName AS Customer, Loc, FrtTermsFix, PrintGroup, PartType, sum(MUnits) AS MUnits FROM hist GROUP BY ALL"),
)
def column_span(t):
    rows = t.history("MSTName", "MSTCity", "MSTState", "FrtTermsFix", "PrintGroup", "PartType", "MUnits", "Truck")
    placed = rows.select("MSTName", s.place("MSTCity", "MSTState").alias("Loc"), "FrtTermsFix", "PrintGroup", "PartType", "MUnits", "Truck")
    keys = op.cols_between(placed, "MSTName", "PartType")
    return op.total(op.total(deal(placed, t.tasks, *keys), [*keys, "Truck"], "MUnits"), keys, "MUnits").withColumnsRenamed({"MSTName": "Customer"})


@query(
    "lid_cup_volume",
    "C3 P5",
    with_views("SELECT PTypeFix, PartType, sum(MUnits) AS MUnits FROM hist GROUP BY ALL"),
)
def lid_cup_volume(t):
    rows = t.volume("PartType").withColumn("PTypeFix", s.lid_or_cup("PartType"))
    return op.total(rows, ["PTypeFix", "PartType"], "MUnits")


@query(
    "part_substitution",
    "C4 A4",
    with_views("SELECT replace(replace(PartType, 'SMALL', 'LARGE'), 'PROMO', 'LARGE-P') AS PartType, sum(MUnits) AS MUnits FROM hist GROUP BY 1"),
)
def part_substitution(t):
    swapped = t.volume("PartType").withColumn("PartType", s.substituted("PartType", {"SMALL": "LARGE", "PROMO": "LARGE-P"}))
    return op.total(swapped, ["PartType"], "MUnits")


@query(
    "forced_terms",
    "P6 A1",
    with_views("SELECT Loc, 'PPD' AS FrtTermsFix, sum(MUnits) AS MUnits FROM hist GROUP BY ALL"),
)
def forced_terms(t):
    rows = op.force_terms(t.history("MSTCity", "MSTState", "FrtTermsFix", "MUnits")).withColumn("Loc", s.place("MSTCity", "MSTState"))
    return op.total(rows, ["Loc", "FrtTermsFix"], "MUnits")


@query(
    "numbers_in_text",
    "C10 F6 F7 C2",
    """SELECT substr(c_name, 1, 8) AS Prefix, count(*) AS n, count(v) AS numeric_cells, sum(CASE WHEN v > 0 THEN v END) AS positive
FROM (SELECT c_name, TRY_CAST(CASE WHEN c_custkey % 7 = 0 THEN 'ITEM' WHEN c_custkey % 5 = 0 THEN '' ELSE CAST(c_custkey - 50 AS VARCHAR) END AS DOUBLE) AS v FROM customer) GROUP BY 1""",
)
def numbers_in_text(t):
    cell = F.when(F.col("c_custkey") % 7 == 0, "ITEM").when(F.col("c_custkey") % 5 == 0, "").otherwise((F.col("c_custkey") - 50).cast("string"))
    rows = t.customer.select(F.left("c_name", F.lit(8)).alias("Prefix"), s.number(cell).alias("v"))
    return rows.groupBy("Prefix").agg(
        F.count(F.lit(1)).alias("n"), F.count("v").alias("numeric_cells"), F.sum(F.when(F.col("v") > 0, F.col("v"))).alias("positive")
    )


@query(
    "destinations_without_distance",
    "J5 Q5",
    with_views("SELECT Loc, count(*) AS rows, sum(MUnits) AS MUnits FROM hist WHERE Loc NOT IN (SELECT Dest FROM dist) GROUP BY Loc"),
)
def destinations_without_distance(t):
    rows = t.history("MSTCity", "MSTState", "MUnits").withColumn("Loc", s.place("MSTCity", "MSTState"))
    return ql.unmatched(rows, t.distances(), {"Loc": "Dest"}, "MUnits")


@query(
    "destinations_with_distance",
    "J4",
    with_views("SELECT Loc, count(*) AS rows, sum(MUnits) AS MUnits FROM hist WHERE Loc IN (SELECT Dest FROM dist) GROUP BY Loc"),
)
def destinations_with_distance(t):
    rows = t.history("MSTCity", "MSTState", "MUnits").withColumn("Loc", s.place("MSTCity", "MSTState"))
    return op.keep_known(rows, t.distances(), {"Loc": "Dest"}).groupBy("Loc").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("MUnits").alias("MUnits")
    )


@query(
    "lane_lookup_faults",
    "Q4 J7",
    with_views("""SELECT ShipSiteName, Loc, CAST(count(Miles) AS BIGINT) AS hits FROM (SELECT DISTINCT ShipSiteName, Loc FROM hist)
  LEFT JOIN dist ON Orig = ShipSiteName AND Dest = Loc GROUP BY ALL HAVING count(Miles) <> 1"""),
)
def lane_lookup_faults(t):
    rows = t.history("ShipSiteName", "MSTCity", "MSTState").withColumn("Loc", s.place("MSTCity", "MSTState"))
    return ql.lookup_faults(rows, t.distances(), {"ShipSiteName": "Orig", "Loc": "Dest"})


@query(
    "raw_distance_duplicates",
    "Q4",
    with_views("""SELECT "or.City", Dest, hits FROM (SELECT or_city AS "or.City", de_city || ', ' || de_state AS Dest, CAST(count(*) AS BIGINT) AS hits FROM raw_dist GROUP BY ALL) WHERE hits <> 1"""),
)
def raw_distance_duplicates(t):
    raw = t.raw_distances().select("`or.City`", s.place("`de.City`", "`de.State`").alias("Dest")).withColumnRenamed("or.City", "Orig")
    return ql.lookup_faults(raw, raw, {"Orig": "Orig", "Dest": "Dest"}).withColumnRenamed("Orig", "or.City")


@query(
    "volume_kept",
    "Q1",
    with_views("""SELECT b AS before, a AS after, b - a AS delta, (b - a) / b AS pct FROM
  (SELECT sum(MUnits) AS b, sum(MUnits) FILTER (MfgSiteName IS NOT NULL AND Loc IN (SELECT Dest FROM dist)) AS a FROM hist)"""),
)
def volume_kept(t):
    kept = op.keep_known(clean(t), t.distances(), {"Loc": "Dest"})
    return ql.reconcile(t.history("MUnits"), kept, "MUnits")


@query(
    "prepaid_share",
    "Q3",
    with_views("SELECT p AS part, a AS total, p / a AS pct FROM (SELECT sum(MUnits) FILTER (FrtTermsFix = 'PPD') AS p, sum(MUnits) AS a FROM hist)"),
)
def prepaid_share(t):
    return ql.conditional_share(t.history("FrtTermsFix", "MUnits"), "FrtTermsFix", "PPD", "MUnits")


def _profile_sql(cols: dict[str, bool]) -> str:
    each = [
        f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS missing, CAST(min({c}) AS VARCHAR) AS min, "
        f"CAST(max({c}) AS VARCHAR) AS max, {f'avg({c})' if num else 'CAST(NULL AS DOUBLE)'} AS mean FROM hist"
        for c, num in cols.items()
    ]
    return " UNION ALL ".join(each)


@query(
    "history_profile",
    "A11 Q2",
    with_views(_profile_sql({"MfgSiteName": False, "ShipSiteName": False, "MSTName": False, "ShipMonth": True, "MUnits": True})),
)
def history_profile(t):
    return op.profile(t.history("MfgSiteName", "ShipSiteName", "MSTName", "ShipMonth", "MUnits"))


@query(
    "history_totals",
    "A2",
    with_views("SELECT count(*) AS n, sum(MUnits) AS MUnits, sum(MUnits) FILTER (FrtTermsFix = 'PPD') AS Prepaid FROM hist"),
)
def history_totals(t):
    return t.history("FrtTermsFix", "MUnits").agg(
        F.count(F.lit(1)).alias("n"), F.sum("MUnits").alias("MUnits"), F.sum(F.when(F.col("FrtTermsFix") == "PPD", F.col("MUnits"))).alias("Prepaid")
    )


@query(
    "customers_distinct",
    "A5 R6",
    with_views("SELECT DISTINCT MSTName || '/' || Loc || '/' || FrtTermsFix AS Cust FROM hist"),
)
def customers_distinct(t):
    rows = t.history("MSTName", "MSTCity", "MSTState", "FrtTermsFix")
    keyed = rows.select(F.struct("MSTName", s.place("MSTCity", "MSTState").alias("Loc"), F.col("FrtTermsFix").alias("FTerms")).alias("Cust"))
    return keyed.distinct().select(F.concat_ws("/", "Cust.MSTName", "Cust.Loc", "Cust.FTerms").alias("Cust"))


@query(
    "products_per_customer",
    "A6",
    with_views("SELECT MSTName, FrtTermsFix, string_agg(DISTINCT PartType, ',' ORDER BY PartType) AS Products FROM hist GROUP BY ALL"),
)
def products_per_customer(t):
    return op.distinct_lists(t.history("MSTName", "FrtTermsFix", "PartType"), ["MSTName", "FrtTermsFix"], "PartType", "Products")


@query(
    "origins_per_product",
    "A6",
    with_views("SELECT PrintGroup, PartType, string_agg(DISTINCT MfgSiteName, ',' ORDER BY MfgSiteName) AS Origins FROM clean GROUP BY ALL"),
)
def origins_per_product(t):
    rows = t.volume("PrintGroup", "PartType", "MfgSiteName").na.drop()
    return op.distinct_lists(rows, ["PrintGroup", "PartType"], "MfgSiteName", "Origins")


@query(
    "smallest_customers",
    "O1 O2",
    with_views("SELECT MSTName, PartType, sum(MUnits) AS MUnits FROM hist GROUP BY ALL ORDER BY MUnits, MSTName, PartType LIMIT 10"),
)
def smallest_customers(t):
    return op.smallest(op.total(t.history("MSTName", "PartType", "MUnits"), ["MSTName", "PartType"], "MUnits"), "MUnits", 10, "MSTName", "PartType")


# Part types as the sheets have them: some parts have none.
SOME_PARTS = "CASE WHEN l_partkey % 53 <> 0 THEN PartType END"


def _some_parts(rows):
    return rows.withColumn("PartType", F.when(F.col("l_partkey") % 53 != 0, F.col("PartType")))


@query(
    "demand_grid_zero_filled",
    "R5",
    with_views(f"""WITH h AS (SELECT MSTName, {SOME_PARTS} AS PartType, MUnits FROM hist)
  SELECT c.MSTName, p.PartType, coalesce(sum(MUnits), 0) AS MUnits FROM (SELECT DISTINCT MSTName FROM h) c
  CROSS JOIN (SELECT DISTINCT PartType FROM h) p LEFT JOIN h ON h.MSTName = c.MSTName AND h.PartType IS NOT DISTINCT FROM p.PartType GROUP BY ALL"""),
)
def demand_grid_zero_filled(t):
    rows = _some_parts(t.history("MSTName", "PartType", "l_partkey", "MUnits")).drop("l_partkey")
    return op.densify(rows, ["MSTName"], "PartType", op.values_of(rows, "PartType"), "MUnits")


@query(
    "months_transposed",
    "R3",
    with_views(
        f"""WITH h AS (SELECT CASE WHEN l_partkey % 7 <> 0 THEN ShipSiteName END AS ShipSiteName, {SOME_PARTS} AS PartType, MUnits FROM hist)
        SELECT coalesce(PartType, '(none)') AS PartType, sum(MUnits) FILTER (ShipSiteName IS NULL) AS "(none)", """
        + ", ".join(f"sum(MUnits) FILTER (ShipSiteName = '{x}') AS \"{x}\"" for x in SITES)
        + " FROM h GROUP BY ALL"
    ),
)
def months_transposed(t):
    """A sheet of part types by site turned round; volume without a part type or without a site keeps its place."""
    rows = _some_parts(t.volume("ShipSiteName", "PartType", "l_partkey"))
    rows = rows.withColumn("ShipSiteName", F.when(F.col("l_partkey") % 7 != 0, F.col("ShipSiteName")))
    sums = op.total(rows, ["ShipSiteName", "PartType"], "MUnits")
    by_site = op.widen(sums, ["ShipSiteName"], "PartType", op.values_of(sums, "PartType"), "MUnits")
    return op.transpose(by_site, "ShipSiteName", [None, *t.site_names], "PartType")


# Wide enough for every customer key.
KEY_LENGTH = 16
SHEET_PREFIX = [f"9803{i:012d}" for i in range(26)]


def demand_sheet(t):
    """Demand sheet with one text column per customer: three volumes per key, repeated headers, empty items."""
    cols = [f"{p} DC{j}" for p in SHEET_PREFIX for j in range(3)]
    item = F.when(F.col("p_partkey") % 29 == 0, F.lit("ITEM")).when(F.col("p_partkey") % 31 != 0, F.col("p_type"))
    cells = []
    for i, c in enumerate(cols):
        v = (F.col("p_partkey") * (i + 3)) % 19 - 4
        cells.append(F.when(F.col("p_partkey") % 29 == 0, F.lit(c)).when(v != 0, v.cast("string")).alias(c))
    return t.part.select(item.alias("ITEM"), F.col("p_brand").alias("Print"), *cells), cols


@query(
    "demand_sheet_unpivoted",
    "B9 S8 R2 C2 F5 F6 F7 C10 A1",
    """SELECT p_brand AS Print, p_type AS ITEM, '9803' || lpad(CAST(i // 3 AS VARCHAR), 12, '0') AS MST, CAST(sum(v) AS DOUBLE) AS MUnits
FROM (SELECT *, (p_partkey * (i + 3)) % 19 - 4 AS v FROM part CROSS JOIN range(78) r(i))
WHERE p_partkey % 29 <> 0 AND p_partkey % 31 <> 0 AND v > 0 GROUP BY ALL""",
)
def demand_sheet_unpivoted(t):
    sheet, cols = demand_sheet(t)
    return unpivot_demand_sheet(sheet, cols, KEY_LENGTH)


@query(
    "supply_scaled",
    "S8 P7 F5 A1",
    """SELECT r_name AS MfgSiteName, p_type AS PartType, sum(CAST(p_size AS DOUBLE) * 1000 + 10) AS MUnits
FROM part JOIN region ON r_regionkey = p_partkey % 5 WHERE p_partkey % 19 <> 0 GROUP BY ALL""",
)
def supply_scaled(t):
    sheet = t.part.join(t.region, F.col("p_partkey") % 5 == F.col("r_regionkey")).select(
        F.col("r_name").alias("MfgSiteName"),
        F.col("p_type").alias("PartType"),
        F.when(F.col("p_partkey") % 19 != 0, F.col("p_brand")).alias("PrintGroup"),
        F.col("p_size").cast("double").alias("MMUnits"),
    )
    return op.total(op.scale_supply(sheet.na.drop(subset=["PrintGroup"])), ["MfgSiteName", "PartType"], "MUnits")


@query(
    "size_bins",
    "C15",
    with_views("SELECT floor(m / 500) * 500 AS SizeBin, count(*) AS n FROM (SELECT MSTName, sum(MUnits) AS m FROM hist GROUP BY 1) GROUP BY 1"),
)
def size_bins(t):
    sums = op.total(t.history("MSTName", "MUnits"), ["MSTName"], "MUnits")
    return sums.groupBy(s.size_bin("MUnits", 500).alias("SizeBin")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "destination_totals",
    "W4",
    with_views("SELECT *, sum(MUnits) OVER (PARTITION BY Loc) AS DestMUnits FROM (SELECT ShipSiteName, Loc, sum(MUnits) AS MUnits FROM hist GROUP BY ALL)"),
)
def destination_totals(t):
    rows = t.history("ShipSiteName", "MSTCity", "MSTState", "MUnits").withColumn("Loc", s.place("MSTCity", "MSTState"))
    return op.with_group_total(op.total(rows, ["ShipSiteName", "Loc"], "MUnits"), ["Loc"], "MUnits", "DestMUnits")


@query(
    "noise_free_rows",
    "C13 F6",
    """SELECT l_returnflag, count(*) AS n FROM lineitem WHERE abs(l_discount - 0.05) > 1e-10 GROUP BY 1""",
)
def noise_free_rows(t):
    rows = t.lineitem.withColumn("d", F.col("l_discount") - 0.05)
    return rows.where(s.flows("d")).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query(
    "link_limits",
    "C14",
    with_views("""SELECT MfgSite, ShipSite, Dest, RPType, least(Capacity, MUnits) AS Most
  FROM (SELECT Loc, RPType, sum(MUnits) AS MUnits FROM demand GROUP BY ALL) JOIN best_route ON Dest = Loc JOIN supply USING (MfgSite, RPType)"""),
)
def link_limits(t):
    """The most each route can carry: what its plant has and its place wants."""
    wanted = op.total(demand(t), ["Loc", "RPType"], "MUnits").withColumnRenamed("Loc", "Dest")
    routes = cheapest_routes(t.distances(), rates(t)).select("MfgSite", "ShipSite", "Dest")
    both = wanted.join(routes, "Dest").join(kept_supply(t), ["MfgSite", "RPType"])
    return both.select("MfgSite", "ShipSite", "Dest", "RPType", s.link_limit("Capacity", "MUnits").alias("Most"))


