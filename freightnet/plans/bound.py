"""A lower bound on the capacitated cost, by pricing scarce supply and throughput."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freightnet.functions.scalar import RATE
from freightnet.operators.tables import keep_known, keep_unknown, lookup, total
from freightnet.plans.bidding import bid_plan, less
from freightnet.plans.check import check_plan
from freightnet.plans.network import CUSTOMER, PRODUCT, inbound_options, single_source_assign, unit_costs
from freightnet.plans.waterfall import legs, overlaps
from freightnet.scale import cut, null_safe_join, running_total, slice_rows
from freightnet.schemas import MONEY, VOLUME

PRICE = "decimal(18,8)"


@dataclass
class Bound:
    """Bound per step, and the prices after the last one. Prices approximate the shadow prices."""

    trace: list[tuple[int, float, float]]
    limits: DataFrame
    #: (Loc, product, MUnits) that no open way leads to: the bound says nothing about it.
    unserved: DataFrame
    #: With ``keep``: (Step, Loc, product, MfgSite, ShipSite), what each place and product chose in each step.
    choices: DataFrame | None = None

    @property
    def best(self) -> float:
        return self.trace[-1][2]

    @property
    def plant_prices(self) -> DataFrame:
        return self.limits.where(F.col("MfgSite").isNotNull()).select("MfgSite", PRODUCT, "Price")

    @property
    def site_prices(self) -> DataFrame:
        return self.limits.where(F.col("ShipSite").isNotNull()).select("ShipSite", "Price")

    def as_table(self) -> DataFrame:
        return self.limits.sparkSession.createDataFrame(self.trace, "Iteration INT, Bound DOUBLE, Best DOUBLE")


def _limits(supply: DataFrame, caps: DataFrame | None) -> DataFrame:
    """One row per limit, unpriced: supply of a plant and product, and throughput of a site."""
    none = F.lit(None).cast("string")
    free = F.lit(0).cast(PRICE).alias("Price")
    have = total(supply.where(F.col("Capacity") > 0), ["MfgSite", PRODUCT], "Capacity")
    rows = have.select("MfgSite", none.alias("ShipSite"), PRODUCT, F.col("Capacity").alias("Limit"), free)
    if caps is not None:
        gates = caps.select(none.alias("MfgSite"), "ShipSite", none.alias(PRODUCT), F.col("Cap").alias("Limit"), free)
        rows = rows.unionByName(gates)
    return cut(rows)


def _priced_inbound(options: DataFrame, limits: DataFrame) -> DataFrame:
    """Cheapest plant per site and product once supply and throughput carry their prices."""
    plants = limits.where(F.col("MfgSite").isNotNull()).select("MfgSite", PRODUCT, F.col("Price").alias("u"))
    gates = limits.where(F.col("ShipSite").isNotNull()).select("ShipSite", F.col("Price").alias("v"))
    priced = options.join(plants, ["MfgSite", PRODUCT]).join(gates, "ShipSite", "left")
    cost = (F.col("Inbound") + F.col("u") + F.coalesce("v", F.lit(0))).cast(PRICE)
    best = priced.groupBy("ShipSite", PRODUCT).agg(F.min(F.struct(cost.alias("Inbound"), "MfgSite")).alias("best"))
    return best.select("ShipSite", PRODUCT, "best.MfgSite", "best.Inbound")


def _split_choice(wanted: DataFrame, units: DataFrame, sites: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every place and product takes its cheapest site on its own: volume and cost by site, and the choices."""
    picks = [
        F.when(F.col(f"u{i}").isNotNull(), F.struct(F.col(f"u{i}").alias("unit"), F.lit(s).alias("site")))
        for i, s in enumerate(sites)
    ]
    best = F.least(*picks) if len(picks) > 1 else picks[0]
    chosen = lookup(wanted, units, {"Loc": "Dest", PRODUCT: PRODUCT}, "inner").withColumn("best", best)
    chosen = chosen.where(F.col("best").isNotNull())
    volume = F.col("MUnits").cast(VOLUME)
    used = cut(
        chosen.groupBy(F.col("best.site").alias("ShipSite"), PRODUCT).agg(
            F.sum("MUnits").alias("MUnits"), F.sum((volume * F.col("best.unit")).cast(MONEY)).alias("Cost")
        )
    )
    return used.drop("Cost"), used.select("Cost"), chosen.select("Loc", PRODUCT, F.col("best.site").alias("ShipSite"))


def _whole_choice(wanted: DataFrame, units: DataFrame, sites: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every customer takes one site for all of its products."""
    assigned = cut(single_source_assign(wanted, units, sites).where(F.col("ShipSite").isNotNull()))
    used = total(wanted.join(assigned.drop("Cost"), CUSTOMER), ["ShipSite", PRODUCT], "MUnits")
    return cut(used), assigned.select("Cost"), assigned.select(*CUSTOMER, "ShipSite")


def unserved(demand: DataFrame, dist: DataFrame, options: DataFrame) -> DataFrame:
    """(Loc, product, MUnits) of demand without a lane to a site that some plant with supply can reach."""
    reached = dist.where(F.col("Miles").isNotNull()).select(F.col("Orig").alias("ShipSite"), "Dest")
    ways = reached.join(options.select("ShipSite", PRODUCT).distinct(), "ShipSite").select("Dest", PRODUCT).distinct()
    return keep_unknown(total(demand, ["Loc", PRODUCT], "MUnits"), ways, {"Loc": "Dest", PRODUCT: PRODUCT})


def _step(limits: DataFrame, used: DataFrame, inbound: DataFrame, step: float) -> DataFrame:
    """Prices rise where use exceeds the limit and fall, never below zero, where it does not."""
    none = F.lit(None).cast("string")
    sourced = used.join(inbound.select("ShipSite", PRODUCT, "MfgSite"), ["ShipSite", PRODUCT])
    by_plant = sourced.select("MfgSite", none.alias("ShipSite"), PRODUCT, "MUnits")
    by_gate = used.select(none.alias("MfgSite"), "ShipSite", none.alias(PRODUCT), "MUnits")
    keys = ["MfgSite", "ShipSite", PRODUCT]
    sums = total(by_plant.unionByName(by_gate), keys, "MUnits", "Used")
    joined = null_safe_join(limits, sums, keys, "left").na.fill(0.0, ["Used"])
    gap = F.try_divide(F.col("Used") - F.col("Limit"), F.greatest("Used", "Limit"))
    moved = F.col("Price").cast("double") + F.lit(step) * F.coalesce(gap, F.lit(0.0))
    # Rounded once and used in this rounded form on both sides, so the bound holds for these very prices.
    return cut(joined.withColumn("Price", F.greatest(F.round(moved, 6), F.lit(0.0)).cast(PRICE)).drop("Used"))


def price_bound(
    demand: DataFrame,
    supply: DataFrame,
    dist: DataFrame,
    rates: DataFrame,
    sites: Sequence[str],
    caps: DataFrame | None = None,
    iterations: int = 10,
    step: float = 1.0,
    gap: float = 0.0,
    single_source: bool = False,
    rate: Decimal = RATE,
    keep: bool = False,
) -> Bound:
    """Lagrangian bound: price supply (and throughput), let every customer choose freely, adjust prices.

    Any prices >= 0 give a valid lower bound for the chosen mode, so the best one over the steps is
    reported; the bound is never claimed to be the optimum. Without ``single_source`` choices depend on
    place and product only, and demand is folded to that grain once: the steps no longer grow with customers.
    Stops early when a step improves the best bound by a share of no more than ``gap``. Demand that no way leads to has
    no part in the bound and is returned as ``unserved``. ``keep`` writes the choices of each step, for ``recover_plan``.
    """
    if keep and single_source:
        raise ValueError("choices are kept for places and products, not for whole customers")
    reachable = keep_known(demand, dist, {"Loc": "Dest"})
    wanted = cut(total(reachable, [*CUSTOMER, PRODUCT] if single_source else ["Loc", PRODUCT], "MUnits"))
    choose = _whole_choice if single_source else _split_choice
    options = cut(inbound_options(supply, rates))
    limits = _limits(supply, caps)

    trace: list[tuple[int, float, float]] = []
    kept: list[DataFrame] = []
    for k in range(1, iterations + 1):
        inbound = _priced_inbound(options, limits)
        used, costs, chosen = choose(wanted, unit_costs(dist, inbound, sites, rate), sites)
        if keep:
            plants = inbound.select("ShipSite", PRODUCT, "MfgSite")
            kept.append(cut(chosen.join(plants, ["ShipSite", PRODUCT]).withColumn("Step", F.lit(k))))
        held = limits.select((-F.col("Price") * F.col("Limit").cast(VOLUME)).cast(MONEY).alias("Cost"))
        bound = float(costs.unionAll(held).agg(F.sum("Cost")).first()[0] or 0)
        best = max(bound, trace[-1][2]) if trace else bound
        stalled = len(trace) > 0 and gap > 0 and best - trace[-1][2] <= gap * abs(best)
        trace.append((k, bound, best))
        if stalled:
            break
        limits = _step(limits, used, inbound, step / k)
    return Bound(trace, limits, unserved(demand, dist, options), reduce(DataFrame.unionByName, kept) if kept else None)


def _floor(value: Column) -> Column:
    """To the last digit of VOLUME that is not above."""
    return (F.floor(value.cast("decimal(38,12)") * 1_000_000) / F.lit(1_000_000).cast("decimal(7,0)")).cast(VOLUME)


def recover_plan(
    bound: Bound, demand: DataFrame, supply: DataFrame, paths: DataFrame, caps: DataFrame | None = None
) -> DataFrame:
    """A feasible plan near the bound: flows (MfgSite, ShipSite, customer, product, MUnits, Cost).

    The mean of the choices over the steps, later ones weighing more, tends to the best split of each place and product
    over plants and sites. Where it exceeds a limit all flows over it shrink alike, and what that leaves unserved bids
    for what is left of the limits. The flows of a place and product are then dealt to its customers by intervals.
    """
    pair = ["Loc", PRODUCT]
    wanted = total(demand, pair, "MUnits").withColumn("Wanted", F.col("MUnits").cast(VOLUME)).drop("MUnits")
    shares = bound.choices.groupBy(*pair, "MfgSite", "ShipSite").agg(F.sum("Step").alias("Weight"))
    sums = shares.groupBy(*pair).agg(F.sum("Weight").alias("All"))
    mean = shares.join(sums, pair).join(wanted, pair)
    flow = F.col("Wanted") * F.col("Weight") / F.col("All")
    mean = cut(mean.select(*pair, "MfgSite", "ShipSite", _floor(flow).alias("Flow")))

    stock = total(supply, ["MfgSite", PRODUCT], "Capacity", "Stock").withColumn("Stock", F.col("Stock").cast(VOLUME))
    by_plant = mean.groupBy("MfgSite", PRODUCT).agg(F.sum("Flow").alias("Used")).join(stock, ["MfgSite", PRODUCT])
    ratio = lambda limit: F.least(F.lit(1), F.try_divide(F.col(limit), F.col("Used")))
    kept = mean.join(by_plant.select("MfgSite", PRODUCT, ratio("Stock").alias("f1")), ["MfgSite", PRODUCT])
    factor = F.coalesce("f1", F.lit(1))
    if caps is not None:
        room = caps.select("ShipSite", _floor(F.col("Cap")).alias("Room"))
        by_site = mean.groupBy("ShipSite").agg(F.sum("Flow").alias("Used")).join(room, "ShipSite")
        kept = kept.join(by_site.select("ShipSite", ratio("Room").alias("f2")), "ShipSite", "left")
        factor = F.least(factor, F.coalesce("f2", F.lit(1)))
    kept = cut(kept.select("MfgSite", "ShipSite", *pair, _floor(F.col("Flow") * factor).alias("MUnits")))

    served = kept.groupBy(*pair).agg(F.sum("MUnits").alias("Sent"))
    short = F.col("Wanted") - F.coalesce("Sent", F.lit(0).cast(VOLUME))
    left = wanted.join(served, pair, "left").select(F.lit("").alias("MSTName"), "Loc", F.lit("").alias("FTerms"), PRODUCT, short.alias("MUnits"))
    used = kept.groupBy("MfgSite", PRODUCT).agg(F.sum("MUnits").alias("Used"))
    more_stock = cut(less(stock, used, ["MfgSite", PRODUCT], "Stock")).withColumnRenamed("Stock", "Capacity")
    more_room = None
    if caps is not None:
        used = kept.groupBy("ShipSite").agg(F.sum("MUnits").alias("Used"))
        more_room = cut(less(room, used, ["ShipSite"], "Room")).withColumnRenamed("Room", "Cap")
    more = bid_plan(cut(left), more_stock, paths, more_room, None, bound.plant_prices, bound.site_prices).select("MfgSite", "ShipSite", *pair, F.col("MUnits").cast(VOLUME).alias("MUnits"))
    flows = kept.unionByName(more).groupBy(*pair, "MfgSite", "ShipSite").agg(F.sum("MUnits").alias("Flow")).where("Flow > 0")

    # A place and product has a flow per plant and site at most: a plain window will do.
    upto = Window.partitionBy(*pair).orderBy("MfgSite", "ShipSite").rowsBetween(Window.unboundedPreceding, 0)
    have = cut(flows.withColumn("s1", F.sum("Flow").over(upto)).withColumn("s0", F.col("s1") - F.col("Flow")).drop("Flow"))
    who = ["MSTName", "FTerms"]
    each = total(demand, [*CUSTOMER, PRODUCT], "MUnits").where(F.col("MUnits") > 0)
    each = slice_rows(each.withColumn("MUnits", F.col("MUnits").cast(VOLUME)), pair, who)
    each = running_total(each, pair, who, "MUnits", "d0", "d1", keep_slice=True)
    met = lookup(overlaps(each.drop("MUnits"), have, pair), paths, {"MfgSite": "MfgSite", "ShipSite": "ShipSite", "Loc": "Dest"})
    cost = (F.col("MUnits") * F.col("UnitCost")).cast(MONEY).alias("Cost")
    return met.select("MfgSite", "ShipSite", *CUSTOMER, PRODUCT, F.col("MUnits").cast("double").alias("MUnits"), cost)


def gap(plan: DataFrame, bound: Bound, demand: DataFrame, supply: DataFrame, caps: DataFrame | None = None) -> float:
    """Cost of a plan over the best bound, less one. Refused unless the plan serves all demand and breaks no rule, and all
    demand had a part in the bound: only then does the cheapest plan lie between the two."""
    lost = bound.unserved.agg(F.sum("MUnits")).first()[0] or 0
    if lost > 0:
        raise ValueError(f"no way leads to a demand of {lost}")
    out, moved = legs(plan)
    broken = check_plan(cut(out), cut(moved), demand, supply, caps).groupBy("Rule").count().orderBy("Rule").collect()
    if broken:
        raise ValueError("the plan breaks rules: " + ", ".join(f"{r['Rule']} ({r['count']})" for r in broken))
    cost = float(plan.agg(F.sum("Cost")).first()[0] or 0)
    return cost / bound.best - 1
