"""Plan tables and map rows."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightnet.functions.scalar import RATE, flows, freight, size_bin
from freightnet.operators.tables import exact_sum, lookup, total, with_group_total
from freightnet.schemas import MONEY, VOLUME


def outbound_rows(outbound: DataFrame, dist: DataFrame, rate: Decimal = RATE) -> DataFrame:
    """Flows to customers with miles; only prepaid flows carry freight."""
    located = lookup(outbound.where(flows("MUnits")), dist, {"ShipSite": "Orig", "Loc": "Dest"}, "inner")
    cost = F.when(F.col("FTerms") == "PPD", freight("MUnits", "Miles", None, rate)).otherwise(F.lit(0).cast(MONEY))
    return located.select(
        "ShipSite",
        F.col("MSTName").alias("Cust"),
        F.col("Loc").alias("Dest"),
        "FTerms",
        F.col("RPType").alias("PType"),
        "MUnits",
        cost.alias("Freight"),
        "Miles",
    )


def inter_site_rows(inbound: DataFrame, rates: DataFrame) -> DataFrame:
    """Flows between different sites with their freight."""
    moved = inbound.where((F.col("MUnits") > 0) & (F.col("MfgSite") != F.col("ShipSite")))
    priced = lookup(moved, rates, {"MfgSite": "Plant", "ShipSite": "ShipSite"}, "inner")
    cost = (F.col("MUnits").cast(VOLUME) * F.col("CostPerMUnit").cast("decimal(18,6)")).cast(MONEY)
    return priced.select("MfgSite", "ShipSite", F.col("RPType").alias("PType"), "MUnits", cost.alias("Freight"))


def site_summary(rows: DataFrame, site: str) -> DataFrame:
    return rows.groupBy(site).agg(exact_sum(rows, "MUnits").alias("SumMUnits"), exact_sum(rows, "Freight").alias("Freight"))


def lane_summary(rows: DataFrame, centroids: DataFrame) -> DataFrame:
    """Volume per ship site and destination with the coordinates of the destination."""
    return lookup(total(rows, ["ShipSite", "Dest"], "MUnits"), centroids, {"Dest": "Dest"}, "inner")


def inter_site_lanes(rows: DataFrame) -> DataFrame:
    return total(rows, ["MfgSite", "ShipSite"], "MUnits")


def bubbles(rows: DataFrame, centroids: DataFrame, place: str = "Loc", step: float = 100_000.0) -> DataFrame:
    """Volume per destination with coordinates and the lower edge of its size bin."""
    sums = total(rows, [place], "MUnits")
    return lookup(sums, centroids, {place: "Dest"}).withColumn("SizeBin", size_bin("MUnits", step))


def lane_lines(lanes: DataFrame, facilities: DataFrame, centroids: DataFrame) -> DataFrame:
    """Line ends of each lane, and the total volume of its destination."""
    sites = facilities.select("Name", F.col("Latitude").alias("OrigLat"), F.col("Longitude").alias("OrigLon"))
    ends = centroids.select("Dest", F.col("lat").alias("DestLat"), F.col("lon").alias("DestLon"))
    drawn = lanes.select("ShipSite", F.col("Dest"), "MUnits")
    drawn = with_group_total(drawn, ["Dest"], "MUnits", "DestMUnits")
    return lookup(lookup(drawn, sites, {"ShipSite": "Name"}), ends, {"Dest": "Dest"})


def inter_site_lines(lanes: DataFrame, facilities: DataFrame) -> DataFrame:
    """Line ends of each plant-to-site move, and the total volume into the site."""
    start = facilities.select("Name", F.col("Latitude").alias("OrigLat"), F.col("Longitude").alias("OrigLon"))
    end = facilities.select("Name", F.col("Latitude").alias("DestLat"), F.col("Longitude").alias("DestLon"))
    drawn = with_group_total(lanes.select("MfgSite", "ShipSite", "MUnits"), ["ShipSite"], "MUnits", "SiteMUnits")
    return lookup(lookup(drawn, start, {"MfgSite": "Name"}), end, {"ShipSite": "Name"})
