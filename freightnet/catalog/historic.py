"""Shipment history, bills and carriers."""

from pyspark.sql import functions as F

from freightnet.catalog import query
from freightnet.catalog.views import with_views
from freightnet.functions.scalar import terms, year_month, year_start
from freightnet.operators import tables as op
from freightnet.plans import history as h
from freightnet.scale import fresh_path, rank_and_count
from freightnet.sources import readers, writers

AS_OF = "1995-06-30"

ERP_SQL = """
 header AS (
  SELECT CASE WHEN o_orderkey % 50 = 7 THEN '038' ELSE '037' END AS dom, o_orderkey AS nbr, o_custkey,
         'S' || (o_custkey % 5) AS ih_site, CAST(o_orderdate AS DATE) AS ship_date, o_orderpriority AS via,
         CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Prepaid' WHEN '2' THEN 'PREPAID' WHEN '3' THEN 'prepaid' ELSE 'Collect' END AS frt,
         lpad(CAST(o_orderkey // 4 AS VARCHAR), 9, '0') || '-' || (o_orderkey % 4) AS bol,
         CASE WHEN o_orderstatus = 'O' THEN 'Y' ELSE 'N' END AS custpu, 'L' || (o_orderkey % 100) AS ld,
         ['cpu', 'NLAT', 'CNWY', 'CPU', 'PAGE', 'UPS', 'SWFT', 'ZZZZ'][CAST(o_orderkey % 8 AS INTEGER) + 1] AS truck,
         CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 500 AS DOUBLE) END AS base,
         CASE WHEN o_orderkey % 11 = 0 THEN 'MEM' ELSE 'INV' END AS chr01
  FROM orders),
 detail AS (
  SELECT CASE WHEN l_orderkey % 50 = 7 THEN '038' ELSE '037' END AS ddom, l_orderkey AS dnbr, l_partkey,
         CASE WHEN l_suppkey % 20 = 3 THEN '531' ELSE 'S' || (l_suppkey % 5) END AS idh_site,
         CASE WHEN l_linenumber <> 7 THEN l_quantity END AS qty
  FROM lineitem),
 parts AS (
  SELECT p_partkey, p_type, p_brand, CAST(p_size AS DOUBLE) AS pt_size, CAST(50 * (1 + p_partkey % 20) AS DOUBLE) AS case_pk,
         'S' || (p_partkey % 5) AS psite, CAST(p_partkey % 41 AS DOUBLE) AS casep FROM part),
 names AS (
  SELECT c_custkey, CASE WHEN c_custkey % 53 = 0 THEN 'Samples ' || c_name WHEN c_custkey % 101 <> 0 THEN c_name END AS cm_name
  FROM customer),
 charges AS (
  SELECT 'S' || (o_custkey % 5) AS csite, o_orderkey AS so, CAST(o_orderdate AS DATE) AS cdate,
         CAST(o_orderkey % 900 AS DOUBLE) AS Miles,
         CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 1000 AS DOUBLE) END AS Freight,
         CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 700 AS DOUBLE) END AS EstimatedFreight,
         CASE WHEN o_orderkey % 2 <> 0 THEN CAST(o_orderkey % 800 AS DOUBLE) END AS InvFrt,
         CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderkey % 600 AS DOUBLE) END AS ActualFreight,
         CAST(o_orderkey % 2 AS INTEGER) AS PaidFlag
  FROM orders WHERE o_orderkey % 3 = 0),
 ms AS (
  SELECT c_custkey AS st, CAST(c_custkey - c_custkey % 3 AS VARCHAR) AS MST, 'Master ' || (c_custkey - c_custkey % 3) AS MSTName,
         MSTCity, MSTState, lpad(CAST(c_custkey % 50 AS VARCHAR), 5, '0') AS MSTZip, 'US' AS MSTCountry,
         CASE WHEN c_custkey % 2 = 0 THEN 'DC' ELSE 'STORE' END AS MSTSetup
  FROM customer JOIN places ON c_nationkey = nation WHERE c_custkey % 37 <> 0)"""

MODE_SQL = """CASE WHEN upper(trim({c})) = 'NLAT' THEN 'IM' WHEN upper(trim({c})) = 'CNWY' THEN 'LTL'
  WHEN upper(trim({c})) = 'CPU' THEN 'CPU' WHEN upper(trim({c})) = 'PAGE' THEN 'OCEAN'
  WHEN upper(trim({c})) = 'UPS' THEN 'AIR' WHEN upper(trim({c})) = 'SWFT' THEN 'TL' ELSE 'UNKNOWN' END"""


@query(
    "ship_history",
    "B1 J9 A7 W1 W2 F8 C2 C5 C6 C7 C8 C9",
    with_views(f"""WITH {ERP_SQL},
 grouped AS (
  SELECT ship_date, idh_site, MST, MSTSetup, MSTName, MSTCity, MSTState, MSTZip, MSTCountry, via, upper(frt) AS frt,
         p_brand, p_type, substr(bol, 1, 9) AS bill, ld, truck, custpu, base, Miles, Freight, EstimatedFreight, InvFrt,
         ActualFreight, PaidFlag,
         sum(coalesce(qty, 0)) AS Cases, sum(coalesce(qty, 0) * case_pk) / 1000 AS MUnits,
         sum(coalesce(qty, 0) * pt_size) AS cube_,
         CAST(sum(CAST(coalesce(qty / nullif(pal.casep, 0), 0) AS DECIMAL(24, 6))) AS DOUBLE) AS Pallets
  FROM header
  LEFT JOIN detail ON dom = ddom AND nbr = dnbr
  LEFT JOIN parts ON ddom = '037' AND l_partkey = p_partkey
  LEFT JOIN names ON names.c_custkey = o_custkey
  LEFT JOIN (SELECT p_partkey AS pk, psite AS ps, casep FROM parts) pal ON pk = l_partkey AND ps = idh_site
  LEFT JOIN charges ON csite = ih_site AND so = nbr AND cdate = ship_date
  LEFT JOIN ms ON st = o_custkey
  WHERE dom = '037' AND chr01 = 'INV' AND ship_date >= date_trunc('year', DATE '{AS_OF}')
    AND upper(cm_name) NOT LIKE '%SAMPL%' AND idh_site <> '531'
  GROUP BY ALL)
 SELECT CAST(year(ship_date) * 100 + month(ship_date) AS INTEGER) AS ShipMonth, CAST(ship_date AS VARCHAR) AS ShipDate,
        idh_site AS ShipSite, MST, MSTSetup, MSTName, MSTCity, MSTState, MSTZip, MSTCountry, via AS shipVia,
        frt AS FrtTerms, CASE WHEN frt = 'PREPAID' THEN 'PPD' ELSE 'CPU' END AS FrtTermsFix, bill AS MasterBOL,
        custpu AS CustPUFlag,
        CAST(dense_rank() OVER (PARTITION BY bill ORDER BY MST NULLS FIRST) AS INTEGER) AS StopNbrFix,
        CAST(dense_rank() OVER (PARTITION BY bill ORDER BY MST NULLS FIRST)
           + dense_rank() OVER (PARTITION BY bill ORDER BY MST DESC NULLS LAST) - 1 AS INTEGER) AS BOLMasterShipToCount,
        ld AS "Load", truck AS Truck, {MODE_SQL.format(c="truck")} AS ModeFix, p_type AS PartType, p_brand AS PrintGroup,
        Cases, MUnits, cube_ AS "Cube", Pallets, coalesce(base, 0) AS xxih__base_chrg, coalesce(Miles, 0) AS Miles,
        coalesce(Freight, 0) AS Freight, coalesce(EstimatedFreight, 0) AS EstimatedFreight, coalesce(InvFrt, 0) AS InvFrt,
        coalesce(ActualFreight, 0) AS ActualFreight, CAST(coalesce(PaidFlag, 0) AS INTEGER) AS PaidFlag
 FROM grouped"""),
)
def ship_history(t):
    return h.ship_history(t.erp(), AS_OF, tasks=t.tasks)


@query(
    "bill_stops",
    "W1 W2",
    with_views("""
 SELECT DISTINCT MasterBOL, MST, CAST(dense_rank() OVER (PARTITION BY MasterBOL ORDER BY MST) AS INTEGER) AS StopNbr,
   CAST(dense_rank() OVER (PARTITION BY MasterBOL ORDER BY MST)
      + dense_rank() OVER (PARTITION BY MasterBOL ORDER BY MST DESC) - 1 AS INTEGER) AS Stops
 FROM hist"""),
)
def bill_stops(t):
    return rank_and_count(t.history("MasterBOL", "MST"), ["MasterBOL"], "MST", "StopNbr", "Stops")


@query(
    "plant_stops_null_counts",
    "W2",
    with_views("""
 SELECT DISTINCT ShipMonth, MfgSiteName, CAST(dense_rank() OVER (PARTITION BY ShipMonth ORDER BY MfgSiteName NULLS FIRST) AS INTEGER) AS Nbr,
   CAST(dense_rank() OVER (PARTITION BY ShipMonth ORDER BY MfgSiteName NULLS FIRST)
      + dense_rank() OVER (PARTITION BY ShipMonth ORDER BY MfgSiteName DESC NULLS LAST) - 1 AS INTEGER) AS N
 FROM hist"""),
)
def plant_stops_null_counts(t):
    return rank_and_count(t.history("ShipMonth", "MfgSiteName"), ["ShipMonth"], "MfgSiteName", "Nbr", "N")


@query(
    "freight_by_bill",
    "A9",
    """SELECT 'S' || (o_custkey % 5) AS xxtrf__site, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS xxtrf__ship_date,
       o_custkey // 50 AS xxtrf__bol, o_custkey // 100 AS xxtrf__mstr_bol,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS xxtrf__chrg
FROM orders GROUP BY ALL""",
)
def freight_by_bill(t):
    return h.freight_by_bill(
        t.orders.select(
            F.concat(F.lit("S"), (F.col("o_custkey") % 5).cast("string")).alias("xxtrf__site"),
            # Bills are written once a month for some fifty customers, so that several orders share one.
            F.to_date(F.date_trunc("month", "o_orderdate")).alias("xxtrf__ship_date"),
            F.expr("o_custkey div 50").alias("xxtrf__bol"),
            F.expr("o_custkey div 100").alias("xxtrf__mstr_bol"),
            F.col("o_totalprice").cast("decimal(18,2)").alias("xxtrf__chrg"),
        )
    )


@query(
    "site_month_volume",
    "A10 F8",
    with_views(f"""WITH {ERP_SQL}
 SELECT idh_site, CAST(year(ship_date) AS INTEGER) AS ShipYear, CAST(month(ship_date) AS INTEGER) AS ShipMonthNbr,
        chr01 AS xxih__chr01, frt AS ih_fr_terms, sum(qty * case_pk) / 1000 AS MUnits
 FROM header JOIN detail ON dom = ddom AND nbr = dnbr LEFT JOIN parts ON l_partkey = p_partkey
 WHERE idh_site = 'S4' AND dom = '037' AND chr01 = 'INV' AND year(ship_date) = 1999 AND month(ship_date) = 1
 GROUP BY ALL"""),
)
def site_month_volume(t):
    return h.site_month(t.erp(), "S4", 1999, 1)


@query(
    "mode_mix",
    "C6 A1",
    with_views(f"""SELECT ModeFix, sum(MUnits) AS MUnits FROM (SELECT {MODE_SQL.format(c="Truck")} AS ModeFix, MUnits FROM hist)
 GROUP BY ModeFix"""),
)
def mode_mix(t):
    rows = h.with_mode(op.total(t.history("Truck", "MUnits"), ["Truck"], "MUnits"), "Truck", h.carriers(t.spark))
    return op.total(rows, ["ModeFix"], "MUnits")


@query(
    "mode_mix_own_list",
    "C6",
    with_views("""SELECT CASE Truck WHEN 'ZZZZ' THEN 'DRAY' WHEN 'UPS' THEN 'PARCEL' WHEN 'SWFT' THEN 'TL' ELSE 'UNKNOWN' END AS ModeFix,
  sum(MUnits) AS MUnits FROM hist GROUP BY 1"""),
)
def mode_mix_own_list(t):
    """Another list of carriers: new codes, and codes that two modes share."""
    rows = [("zzzz", "DRAY", 1), ("UPS", "AIR", 5), (" UPS", "PARCEL", 2), ("SWFT", "TL", 3), ("SWFT", "UNTIL", 3)]
    known = t.spark.createDataFrame(rows, "scac STRING, mode STRING, priority INT")
    sums = op.total(t.history("Truck", "MUnits"), ["Truck"], "MUnits")
    return op.total(h.with_mode(sums, "Truck", known), ["ModeFix"], "MUnits")


@query(
    "order_terms",
    "C5 C7 C9",
    """SELECT CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS ShipMonth,
       CASE WHEN upper(trim(CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN ' Prepaid' ELSE o_orderpriority END)) = 'PREPAID'
            THEN 'PPD' ELSE 'CPU' END AS FrtTermsFix, count(*) AS n
FROM orders WHERE o_orderdate >= DATE '2000-01-01' GROUP BY ALL""",
)
def order_terms(t):
    raw = F.when(F.left("o_orderpriority", F.lit(1)) == "1", " Prepaid").otherwise(F.col("o_orderpriority"))
    kept = t.orders.where(F.col("o_orderdate") >= year_start("2000-05-17")).withColumn("raw", raw)
    return kept.groupBy(year_month("o_orderdate").alias("ShipMonth"), terms("raw").alias("FrtTermsFix")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "landed_month",
    "S1 K7",
    with_views("""SELECT ShipMonth, ShipSiteName, FrtTermsFix, count(*) AS n, sum(MUnits) AS MUnits FROM hist
 WHERE ShipMonth BETWEEN 199807 AND 199809 GROUP BY ALL"""),
)
def landed_month(t):
    """History landed by month; a quarter is read from the folders of its months alone."""
    path = fresh_path(t.spark, "history-by-month")
    rows = t.history("ShipMonth", "ShipSiteName", "FrtTermsFix", "MUnits")
    writers.land_by(rows, path, ["ShipMonth"])
    read = readers.read_table(t.spark, path, rows.schema).where(F.col("ShipMonth").between(199807, 199809))
    sums = op.total(read, ["ShipMonth", "ShipSiteName", "FrtTermsFix"], "MUnits")
    counts = read.groupBy("ShipMonth", "ShipSiteName", "FrtTermsFix").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(sums, ["ShipMonth", "ShipSiteName", "FrtTermsFix"])


def landed_orders(t, buckets: int = 16):
    """Lines and orders as tables that are bucketed and sorted by order: they join without a shuffle of either."""
    lines = t.lineitem.selectExpr("l_orderkey AS nbr", "l_quantity AS MUnits")
    orders = t.orders.selectExpr("o_orderkey AS nbr", "o_custkey AS cust", "o_orderpriority AS via")
    return writers.land_bucketed(lines, "lines", "nbr", buckets), writers.land_bucketed(orders, "orders", "nbr", buckets)


@query(
    "landed_orders_joined",
    "K7 J9",
    "SELECT o_orderpriority AS via, count(*) AS n, count(DISTINCT o_custkey) AS customers, sum(l_quantity) AS MUnits FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
)
def landed_orders_joined(t):
    lines, orders = landed_orders(t)
    both = lines.join(orders, "nbr")
    return both.groupBy("via").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("cust").alias("customers"), op.exact_sum(both, "MUnits").alias("MUnits")
    )
