"""Cost of today's flows, lanes and inter-site rates."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightnet.functions.scalar import RATE, freight, lane_rate
from freightnet.operators.tables import lookup, total
from freightnet.schemas import MONEY, VOLUME


def site_flows(history: DataFrame) -> DataFrame:
    """Volume by ship site, place and terms; rows with a missing key dropped."""
    keys = ["ShipSiteName", "Loc", "FrtTermsFix"]
    return total(history, keys, "MUnits").na.drop()


def baseline_outbound(history: DataFrame, dist: DataFrame, rate: Decimal = RATE) -> DataFrame:
    """Freight of today's flows to customers. Volumes are added up before they meet the distances."""
    located = lookup(site_flows(history), dist, {"ShipSiteName": "Orig", "Loc": "Dest"}, "inner")
    known = located.where(F.col("Miles").isNotNull())
    return known.withColumn("Freight", freight("MUnits", "Miles", "FrtTermsFix", rate))


def baseline_inter_site(history: DataFrame, rates: DataFrame) -> DataFrame:
    """Freight of today's moves from plant to ship site; pairs without a rate keep a NULL freight."""
    sums = total(history, ["MfgSiteName", "ShipSiteName"], "MUnits")
    located = lookup(sums, rates, {"ShipSiteName": "ShipSite", "MfgSiteName": "Plant"})
    return located.withColumn("Freight", (F.col("MUnits").cast(VOLUME) * unit_cost("CostPerMUnit")).cast(MONEY))


def unit_cost(col: str) -> Column:
    return F.col(col).cast("decimal(18,6)")


def production_by_plant(history: DataFrame) -> DataFrame:
    return total(history, ["MfgSiteName"], "MUnits")


def unit_miles(history: DataFrame, dist: DataFrame) -> DataFrame:
    """Volume times miles of the flows that are not picked up by the customer."""
    keys = ["ShipSiteName", "MSTCity", "MSTState", "FrtTermsFix"]
    sums = total(history.where(F.col("FrtTermsFix") != "CPU"), keys, "MUnits").na.drop()
    named = sums.withColumn("Dest", F.concat("MSTCity", F.lit(", "), "MSTState"))
    located = lookup(named, dist, {"ShipSiteName": "Orig", "Dest": "Dest"}, "inner")
    return located.where(F.col("Miles").isNotNull()).withColumn("MUnitMiles", F.col("MUnits") * F.col("Miles"))


def lanes(customers: DataFrame, dist: DataFrame) -> DataFrame:
    """One lane per customer and site that reaches the customer's place.

    The place is the join key, so sites x customers comes out without a cross join.
    """
    return lookup(customers, dist.withColumnRenamed("Orig", "ShipSite"), {"Loc": "Dest"}, "inner")


def lane_cost(lane_table: DataFrame, rate: Decimal = RATE) -> DataFrame:
    return lane_table.withColumn("Cost", lane_rate("Miles", rate))


def routes(lane_table: DataFrame, demand: DataFrame) -> DataFrame:
    """Lanes with the products that the customer takes, and the volume of each."""
    keys = ["MSTName", "Loc", "FTerms"]
    return lane_table.join(demand, keys, "inner")


def inter_site_cost(rates: DataFrame, penalty: float | None = None, closed_to_others: str | None = None) -> DataFrame:
    """Rate per plant and site. With a penalty, shipping in from another plant costs that much: into every
    site, or only into the one named."""
    if penalty is None:
        return rates
    foreign = F.col("Plant") != F.col("ShipSite")
    if closed_to_others is not None:
        foreign = foreign & (F.col("ShipSite") == closed_to_others)
    return rates.withColumn("CostPerMUnit", F.when(foreign, F.lit(float(penalty))).otherwise(F.col("CostPerMUnit")))
