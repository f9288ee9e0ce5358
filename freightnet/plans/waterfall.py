"""A feasible plan under plant capacity."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freightnet.functions.scalar import RATE, lane_rate
from freightnet.operators.tables import lookup, total
from freightnet.plans.network import CUSTOMER, PRODUCT
from freightnet.scale import cut, running_total, slice_rows
from freightnet.schemas import MONEY, VOLUME


def cheapest_routes(dist: DataFrame, rates: DataFrame, rate: Decimal = RATE) -> DataFrame:
    """Cheapest site between each plant and place, ties to the first name; a small written table."""
    lanes = dist.select(F.col("Orig").alias("ShipSite"), "Dest", lane_rate("Miles", rate).alias("Lane"))
    moves = rates.select(F.col("Plant").alias("MfgSite"), "ShipSite", F.col("CostPerMUnit").cast(MONEY).alias("Inbound"))
    both = lanes.join(moves, "ShipSite").withColumn("UnitCost", (F.col("Lane") + F.col("Inbound")).cast("decimal(18,8)"))
    best = both.where(F.col("UnitCost").isNotNull()).groupBy("MfgSite", "Dest")
    return cut(
        best.agg(F.min(F.struct("UnitCost", "ShipSite")).alias("best")).select(
            "MfgSite", "Dest", "best.ShipSite", "best.UnitCost"
        )
    )


def demand_slices(demand: DataFrame, slices: int | None = None) -> DataFrame:
    """Exact volume per customer and product, sliced for the running total of each product."""
    wanted = total(demand, [*CUSTOMER, PRODUCT], "MUnits").where(F.col("MUnits") > 0)
    return slice_rows(wanted.withColumn("MUnits", F.col("MUnits").cast(VOLUME)), [PRODUCT], CUSTOMER, slices)


def supply_intervals(supply: DataFrame) -> DataFrame:
    """Each plant's capacity as an interval. One row per plant and product, so a plain window will do."""
    have = total(supply.where(F.col("Capacity") > 0), ["MfgSite", PRODUCT], "Capacity")
    exact = have.withColumn("Capacity", F.col("Capacity").cast(VOLUME))
    upto = Window.partitionBy(PRODUCT).orderBy("MfgSite").rowsBetween(Window.unboundedPreceding, 0)
    s1 = F.sum("Capacity").over(upto)
    return exact.withColumn("s1", s1).withColumn("s0", F.col("s1") - F.col("Capacity")).drop("Capacity")


def overlaps(wanted: DataFrame, have: DataFrame, keys: Sequence[str] = (PRODUCT,)) -> DataFrame:
    """Where demand intervals [d0, d1) and supply intervals [s0, s1) of a product (or other ``keys``) meet.

    Demand comes in slices of near-equal rows, however its volume is spread. The few supply intervals are matched to
    the range of each slice, and the rows meet them on (product, slice): each row lies in one slice, so no pair is
    formed twice and no product is joined in one piece.
    """
    ranges = wanted.groupBy(*keys, "__slice").agg(F.min("d0").alias("__lo"), F.max("d1").alias("__hi"))
    near = ranges.join(have, list(keys)).where((F.col("s0") < F.col("__hi")) & (F.col("__lo") < F.col("s1")))
    # One row per slice and border of a supply interval. Written, so that its true size decides the join.
    near = cut(near.drop("__lo", "__hi"))
    start, end = F.greatest("d0", "s0"), F.least("d1", "s1")
    met = wanted.join(near, [*keys, "__slice"]).where(start < end).drop("__slice")
    return met.withColumn("MUnits", (end - start).cast(VOLUME))


def waterfall_plan(demand: DataFrame, supply: DataFrame, routes: DataFrame, slices: int | None = None) -> DataFrame:
    """Plants in name order fill customers in name order, product by product.

    Feasible for plant capacity, not optimal, and blind to site throughput and to one-site rules. Each flow
    takes the cheapest site between its plant and its customer.
    """
    wanted = running_total(demand_slices(demand, slices), [PRODUCT], CUSTOMER, "MUnits", "d0", "d1", keep_slice=True)
    met = overlaps(wanted.drop("MUnits"), supply_intervals(supply))
    located = lookup(met, routes, {"MfgSite": "MfgSite", "Loc": "Dest"})
    return located.select(
        "MfgSite",
        "ShipSite",
        *CUSTOMER,
        PRODUCT,
        F.col("MUnits").cast("double").alias("MUnits"),
        (F.col("MUnits") * F.col("UnitCost")).cast(MONEY).alias("Cost"),
    )


def legs(plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Outbound and inter-site flows of a waterfall plan."""
    outbound = total(plan, ["ShipSite", *CUSTOMER, PRODUCT], "MUnits")
    return outbound, total(plan, ["MfgSite", "ShipSite", PRODUCT], "MUnits")


def shortfall(demand: DataFrame, plan: DataFrame) -> DataFrame:
    """Demand that the plan leaves unmet, per customer and product."""
    keys = [*CUSTOMER, PRODUCT]
    exact = F.col("MUnits").cast(VOLUME)
    wanted = demand.groupBy(*keys).agg(F.sum(exact).alias("Wanted"))
    got = plan.groupBy(*keys).agg(F.sum(exact).alias("Sent"))
    both = wanted.join(got, keys, "left").withColumn("Sent", F.coalesce("Sent", F.lit(0).cast(VOLUME)))
    short = both.withColumn("Short", F.col("Wanted") - F.col("Sent")).where(F.col("Short") > 0)
    return short.select(*keys, *[F.col(c).cast("double").alias(c) for c in ("Wanted", "Sent", "Short")])
