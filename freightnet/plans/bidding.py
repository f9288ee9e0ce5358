"""A feasible plan under plant capacity and site throughput, by rounds of bidding.

In each round all demand that is left bids for the cheapest way (plant and site) that still has both supply and room.
Running totals decide who is served: those who would lose most by their next best plant come first, and the last one is
served in part. What is left bids again without the ways that are full. A round serves all its bids or fills a limit, so
there are no more rounds than limits. One number per round reaches the driver: whether demand is left.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightnet.functions.scalar import RATE, lane_rate
from freightnet.operators.tables import lookup, total
from freightnet.plans.network import CUSTOMER, PRODUCT
from freightnet.scale import cut, running_total, slice_rows
from freightnet.schemas import MONEY, VOLUME

UNIT = "decimal(18,8)"


def ways(dist: DataFrame, rates: DataFrame, rate: Decimal = RATE) -> DataFrame:
    """(MfgSite, ShipSite, Dest, UnitCost) of every plant, site and place that are linked: a small written table."""
    lanes = dist.select(F.col("Orig").alias("ShipSite"), "Dest", lane_rate("Miles", rate).alias("Lane"))
    moves = rates.select(F.col("Plant").alias("MfgSite"), "ShipSite", F.col("CostPerMUnit").cast(MONEY).alias("Inbound"))
    cost = (F.col("Lane") + F.col("Inbound")).cast(UNIT)
    both = lanes.join(moves, "ShipSite").select("MfgSite", "ShipSite", "Dest", cost.alias("UnitCost"))
    return cut(both.where(F.col("UnitCost").isNotNull()))


def _offers(paths: DataFrame, stock: DataFrame, room: DataFrame) -> DataFrame:
    """Cheapest open way per place and product, and what the next best plant would cost more."""
    free = paths.join(room, "ShipSite", "left").where(F.col("Room").isNull() | (F.col("Room") > 0))
    gate = (F.col("UnitCost") + F.coalesce("Gate", F.lit(0))).cast(UNIT).alias("Rank")
    best = free.groupBy("MfgSite", "Dest").agg(F.min(F.struct(gate, "ShipSite", "UnitCost")).alias("way"))
    stocked = best.join(stock.where(F.col("Stock") > 0), "MfgSite")
    # A list holds one entry per plant.
    rank = (F.col("way.Rank") + F.col("Price")).cast(UNIT).alias("Rank")
    listed = F.sort_array(F.collect_list(F.struct(rank, "MfgSite", "way.ShipSite", "way.UnitCost")))
    ranked = stocked.groupBy("Dest", PRODUCT).agg(listed.alias("ways"))
    first, second = F.get("ways", F.lit(0)), F.get("ways", F.lit(1))
    return ranked.select(
        "Dest", PRODUCT, first["MfgSite"].alias("MfgSite"), first["ShipSite"].alias("ShipSite"),
        first["UnitCost"].alias("UnitCost"), (second["Rank"] - first["Rank"]).cast(UNIT).alias("Regret"),
    )


def _served(limit: str) -> Column:
    """How much of [start, end) on the running total lies within the limit; no limit serves all."""
    inside = F.least("end", F.col(limit)) - F.col("start")
    return F.when(F.col(limit).isNull(), F.col("MUnits")).otherwise(F.greatest(inside.cast(VOLUME), F.lit(0).cast(VOLUME)))


def _accepted(bids: DataFrame, by: list[str], limits: DataFrame, limit: str, order: list[str], slices: int | None) -> DataFrame:
    """Bids in order of regret against what is left of each limit; ``MUnits`` becomes what is served."""
    ranked = running_total(slice_rows(bids, by, order, slices), by, order, "MUnits", "start", "end")
    return ranked.join(limits, by, "left").withColumn("MUnits", _served(limit).cast(VOLUME)).drop("start", "end", limit)


def bid_plan(
    demand: DataFrame,
    supply: DataFrame,
    paths: DataFrame,
    caps: DataFrame | None = None,
    slices: int | None = None,
    plant_prices: DataFrame | None = None,
    site_prices: DataFrame | None = None,
) -> DataFrame:
    """Flows (MfgSite, ShipSite, customer, product, MUnits, Cost, Round); ``caps`` is (ShipSite, Cap).

    Prices of scarce limits, (MfgSite, product, Price) and (ShipSite, Price), add to what a way counts in the choice, not
    to its cost: with those of ``price_bound`` the bids leave scarce ways to those who need them most. Feasible for supply and throughput, not optimal; a customer may be served by several sites. Demand without an open
    way, or beyond all limits, is left to ``waterfall.shortfall``.
    """
    session = demand.sparkSession
    rest = total(demand, [*CUSTOMER, PRODUCT], "MUnits").where(F.col("MUnits") > 0)
    rest = rest.withColumn("MUnits", F.col("MUnits").cast(VOLUME))
    stock = total(supply, ["MfgSite", PRODUCT], "Capacity", "Stock").withColumn("Stock", F.col("Stock").cast(VOLUME))
    price = F.lit(0).cast(UNIT)
    if plant_prices is not None:
        stock = stock.join(plant_prices, ["MfgSite", PRODUCT], "left")
        price = F.coalesce("Price", price)
    stock = stock.withColumn("Price", price)
    if site_prices is not None:
        paths = cut(paths.join(site_prices.withColumnRenamed("Price", "Gate"), "ShipSite", "left"))
    else:
        paths = paths.withColumn("Gate", F.lit(0).cast(UNIT))
    none = session.createDataFrame([], "ShipSite string, Cap double")
    # A cap is rounded down, so that no sum of flows exceeds it.
    down = F.floor(F.col("Cap") * 1_000_000) / F.lit(1_000_000).cast("decimal(7,0)")
    room = (none if caps is None else caps).select("ShipSite", down.cast(VOLUME).alias("Room"))
    stock, room = cut(stock), cut(room)
    order = ["Urgency", *CUSTOMER, PRODUCT, "MfgSite"]
    rounds: list[DataFrame] = []
    while True:
        offers = cut(_offers(paths, stock, room))
        # Those of the first round are added up once, not once to find the ranges and once to deal by them.
        bids = lookup(rest if rounds else cut(rest), offers, {"Loc": "Dest", PRODUCT: PRODUCT}, "inner")
        # Those without another plant come first, then the largest regret.
        bids = bids.withColumn("Urgency", F.coalesce(-F.col("Regret"), F.lit(-1e9).cast(UNIT))).withColumn("Wanted", F.col("MUnits"))
        taken = _accepted(bids.drop("Regret"), ["MfgSite", PRODUCT], stock.drop("Price"), "Stock", order, slices)
        if caps is not None:
            # Written first: dealing by range reads its rows twice, and these would be ranked anew for that.
            taken = _accepted(cut(taken), ["ShipSite"], room, "Room", order, slices)
        taken = cut(taken.select("MfgSite", "ShipSite", *CUSTOMER, PRODUCT, "UnitCost", "Wanted", "MUnits"))
        rounds.append(taken.where(F.col("MUnits") > 0).withColumn("Round", F.lit(len(rounds) + 1)))
        left = F.col("Wanted") - F.col("MUnits")
        rest = taken.where(left > 0).select(*CUSTOMER, PRODUCT, left.cast(VOLUME).alias("MUnits"))
        if rest.isEmpty():
            break
        used = taken.groupBy("MfgSite", PRODUCT).agg(F.sum("MUnits").alias("Used"))
        stock = cut(less(stock, used, ["MfgSite", PRODUCT], "Stock"))
        if caps is not None:
            room = cut(less(room, taken.groupBy("ShipSite").agg(F.sum("MUnits").alias("Used")), ["ShipSite"], "Room"))
    flows = reduce(DataFrame.unionByName, rounds)
    cost = (F.col("MUnits") * F.col("UnitCost")).cast(MONEY)
    return flows.select(
        "MfgSite", "ShipSite", *CUSTOMER, PRODUCT, F.col("MUnits").cast("double").alias("MUnits"), cost.alias("Cost"), "Round"
    )


def less(limits: DataFrame, used: DataFrame, keys: list[str], limit: str) -> DataFrame:
    """Limits less what is used of them."""
    left = F.col(limit) - F.coalesce("Used", F.lit(0).cast(VOLUME))
    return limits.join(used, keys, "left").withColumn(limit, left.cast(VOLUME)).drop("Used")
