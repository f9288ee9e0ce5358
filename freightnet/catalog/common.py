"""Inputs that several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightnet.functions.scalar import lid_or_cup
from freightnet.operators.tables import total
from freightnet.plans import demand as d
from freightnet.plans.network import CUSTOMER, cheapest_inbound
from freightnet.scale import cut
from freightnet.sources.adapter import Tables, cached
from freightnet.sources.readers import coalesce_cost


def clean(t: Tables, *cols: str) -> DataFrame:
    """Cleaned history with place and the given columns besides those that cleaning needs."""
    need = ["ShipSiteName", "MfgSiteName", "MSTCity", "MSTState", "MUnits"]
    return d.clean_history(t.history(*dict.fromkeys([*need, *cols])))


def site_volume(t: Tables, *cols: str) -> DataFrame:
    """Cleaned volume by plant, ship site and part columns, for sums that need no customer."""
    return d.clean_history(t.volume("ShipSiteName", "MfgSiteName", *cols))


@cached
def root_list(t: Tables) -> DataFrame:
    return d.root_list(t.roots())


def rooted(t: Tables, *cols: str) -> DataFrame:
    return d.root_product_key(clean(t, "PartType", *cols), root_list(t))


def plant_volume(t: Tables) -> DataFrame:
    """Volume by plant and root product."""
    made = t.volume("MfgSiteName", "PartType").na.drop(subset=["MfgSiteName"])
    return d.root_product_key(made.withColumn("PTypeFix", lid_or_cup("PartType")), root_list(t))


def demand(t: Tables) -> DataFrame:
    """Volume by customer, place, terms and root product."""
    ship = rooted(t, "MSTName", "FrtTermsFix").withColumnRenamed("FrtTermsFix", "FTerms")
    return d.demand(ship, t.distances(), [*CUSTOMER, "RPType"])


@cached
def kept_demand(t: Tables) -> DataFrame:
    """The demand table written once, for queries that read it more than once."""
    return cut(demand(t))


@cached
def kept_supply(t: Tables) -> DataFrame:
    return cut(supply(t))


def supply(t: Tables) -> DataFrame:
    """Capacity at 1.2 x history by plant and root product; two plants do not make every product."""
    site, product = F.col("MfgSite"), F.col("RPType")
    lacks = ((site == "ASIA") & (product == "LARGE")) | ((site == "EUROPE") & (product == "S-A"))
    return d.supply(plant_volume(t)).where(~lacks).withColumn("Capacity", F.col("Capacity") * 6 / 5)


def scarce(t: Tables) -> DataFrame:
    """The same with one plant cut to a quarter, so that capacity binds."""
    return kept_supply(t).withColumn(
        "Capacity", F.when(F.col("MfgSite") == "ASIA", F.col("Capacity") / 4).otherwise(F.col("Capacity"))
    )


def caps(t: Tables) -> DataFrame:
    """Throughput cap per site at 1.2 x history."""
    sums = total(site_volume(t), ["ShipSiteName"], "MUnits")
    return sums.select(F.col("ShipSiteName").alias("ShipSite"), (F.col("MUnits") * 6 / 5).alias("Cap"))


def rates(t: Tables) -> DataFrame:
    return coalesce_cost(t.inter_site_rates())


@cached
def inbound(t: Tables) -> DataFrame:
    """Cheapest plant per site and product; a small table that several steps read."""
    return cut(cheapest_inbound(kept_supply(t), rates(t)))
