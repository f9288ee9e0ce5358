"""Which site serves which customer when nothing is scarce, and what a plan costs."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightnet.functions.scalar import RATE, flows, freight, lane_rate
from freightnet.operators.tables import lookup, total
from freightnet.scale import cut
from freightnet.schemas import MONEY, VOLUME

CUSTOMER = ["MSTName", "Loc", "FTerms"]
PRODUCT = "RPType"


def cheapest_site(demand: DataFrame, dist: DataFrame, rate: Decimal = RATE) -> DataFrame:
    """All demand on the nearest site, ties to the first name.

    Without capacity the transport problem separates by customer, so this is the optimum. The best site
    depends on the place alone: the minimum is taken over the distance table, never over the demand.
    """
    nearest = (
        dist.where(F.col("Miles").isNotNull())
        .groupBy("Dest")
        .agg(F.min(F.struct("Miles", "Orig")).alias("best"))
        .select("Dest", F.col("best.Orig").alias("ShipSite"), F.col("best.Miles").alias("Miles"))
    )
    return lookup(demand, nearest, {"Loc": "Dest"}, "inner").withColumn("Cost", freight("MUnits", "Miles", None, rate))


def inbound_options(supply: DataFrame, rates: DataFrame) -> DataFrame:
    """(ShipSite, product, MfgSite, Inbound): every plant with supply and its rate into every site."""
    stocked = supply.where(F.col("Capacity") > 0).select("MfgSite", PRODUCT)
    priced = rates.select(F.col("Plant").alias("MfgSite"), "ShipSite", F.col("CostPerMUnit").cast(MONEY).alias("Inbound"))
    return stocked.join(priced, "MfgSite").where(F.col("Inbound").isNotNull())


def cheapest_inbound(supply: DataFrame, rates: DataFrame) -> DataFrame:
    """Cheapest plant with supply per site and product, ties to the first name."""
    best = inbound_options(supply, rates).groupBy("ShipSite", PRODUCT).agg(
        F.min(F.struct("Inbound", "MfgSite")).alias("best")
    )
    return best.select("ShipSite", PRODUCT, "best.MfgSite", "best.Inbound")


def unit_costs(dist: DataFrame, inbound: DataFrame, sites: Sequence[str], rate: Decimal = RATE) -> DataFrame:
    """One row per place and product, one unit cost per site (lane plus inbound), NULL where no way leads.

    The size is places x products; it does not grow with customers. Written, so that this true size decides
    the join with the demand.
    """
    lanes = dist.select(F.col("Orig").alias("ShipSite"), "Dest", lane_rate("Miles", rate).alias("Lane"))
    both = lanes.join(inbound.select("ShipSite", PRODUCT, "Inbound"), "ShipSite")
    cost = (F.col("Lane") + F.col("Inbound")).cast("decimal(18,8)")
    cells = [F.min(F.when(F.col("ShipSite") == s, cost)).alias(f"u{i}") for i, s in enumerate(sites)]
    return cut(both.groupBy("Dest", PRODUCT).agg(*cells))


def option_costs(demand: DataFrame, units: DataFrame, options: Sequence[Sequence[int]]) -> DataFrame:
    """Cost per customer of being served by each option: a site, or a set of sites that splits by product.

    One column per option instead of one row per lane: demand is joined and shuffled once, whatever the
    number of sites. An option that cannot bring some product to the customer costs NULL.
    """
    joined = lookup(demand, units, {"Loc": "Dest", PRODUCT: PRODUCT})
    volume = F.col("MUnits").cast(VOLUME)
    aggs = []
    for i, option in enumerate(options):
        unit = F.least(*[F.col(f"u{s}") for s in option]) if len(option) > 1 else F.col(f"u{option[0]}")
        served = F.count(unit) == F.count(F.lit(1))
        aggs.append(F.when(served, F.sum((volume * unit).cast(MONEY))).alias(f"o{i}"))
    return joined.groupBy(*CUSTOMER).agg(*aggs)


def single_source_assign(demand: DataFrame, units: DataFrame, sites: Sequence[str]) -> DataFrame:
    """The one site that serves each customer at the least total cost over all products."""
    costs = option_costs(demand, units, [(i,) for i in range(len(sites))])
    ranked = [
        F.when(F.col(f"o{i}").isNotNull(), F.struct(F.col(f"o{i}").alias("Cost"), F.lit(s).alias("ShipSite")))
        for i, s in enumerate(sites)
    ]
    best = F.least(*ranked) if len(ranked) > 1 else ranked[0]
    return costs.select(*CUSTOMER, best.alias("best")).select(*CUSTOMER, "best.ShipSite", "best.Cost")


def assigned_plan(demand: DataFrame, assigned: DataFrame, inbound: DataFrame, keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """Outbound and inter-site flows of a single-source assignment.

    ``keep`` writes the outbound flows once, for callers that read both legs or one of them several times.
    """
    sites = assigned.where(F.col("ShipSite").isNotNull()).select(*CUSTOMER, "ShipSite")
    outbound = demand.join(sites, CUSTOMER).select("ShipSite", *CUSTOMER, PRODUCT, "MUnits")
    outbound = cut(outbound) if keep else outbound
    needs = total(outbound, ["ShipSite", PRODUCT], "MUnits")
    moved = needs.join(inbound, ["ShipSite", PRODUCT]).select("MfgSite", "ShipSite", PRODUCT, "MUnits")
    return outbound, moved


def plan_cost(outbound: DataFrame, inbound: DataFrame, dist: DataFrame, rates: DataFrame, rate: Decimal = RATE) -> DataFrame:
    """Objective by leg. Customer pick-up is costed like any other flow here."""
    out = total(outbound.where(flows("MUnits")), ["ShipSite", "Loc"], "MUnits")
    out = lookup(out, dist, {"ShipSite": "Orig", "Loc": "Dest"}).select(
        F.lit("outbound").alias("Leg"), "MUnits", freight("MUnits", "Miles", None, rate).alias("Cost")
    )
    moved = total(inbound.where(flows("MUnits")), ["MfgSite", "ShipSite"], "MUnits")
    moved = lookup(moved, rates, {"MfgSite": "Plant", "ShipSite": "ShipSite"}).select(
        F.lit("inter_site").alias("Leg"),
        "MUnits",
        (F.col("MUnits").cast(VOLUME) * F.col("CostPerMUnit").cast("decimal(18,6)")).cast(MONEY).alias("Cost"),
    )
    return out.unionByName(moved).groupBy("Leg").agg(F.sum("MUnits").alias("MUnits"), F.sum("Cost").alias("Cost"))


def balance_check(supply: DataFrame, demand: DataFrame, product: str = PRODUCT) -> DataFrame:
    """Supply, demand and slack per product; a product on one side only counts 0 on the other."""
    have = total(supply, [product], "Capacity", "Supply")
    need = total(demand, [product], "MUnits", "Demand")
    both = have.join(need, product, "full").na.fill(0.0, ["Supply", "Demand"])
    slack = F.col("Supply") - F.col("Demand")
    return both.select(product, "Supply", "Demand", slack.alias("Slack"), (slack >= 0).alias("Enough"))
