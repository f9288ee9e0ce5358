"""Cost of every allowed set of open sites."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freightnet.operators.tables import lookup, total
from freightnet.plans.network import CUSTOMER, PRODUCT, option_costs
from freightnet.scale import cut

#: Sites whose sets are enumerated unless the caller allows more: each one doubles the sets.
MOST_SITES = 12
#: Sets that one pass over the customers adds up.
SETS_PER_PASS = 64


def site_sets(n: int, min_open: int, max_open: int, closed: Sequence[int] = (), most_sites: int = MOST_SITES) -> list[int]:
    """Bit masks of the allowed sets of open sites; more than ``most_sites`` sites are refused."""
    if n > most_sites:
        raise ValueError(f"{n} sites give {2**n - 1} sets; at most {most_sites} are enumerated: use search_open_sites")
    shut = sum(1 << i for i in closed)
    return [m for m in range(1, 1 << n) if not m & shut and min_open <= m.bit_count() <= max_open]


def _options(sites: Sequence[int], sites_per_customer: int) -> list[tuple[int, ...]]:
    return [c for k in range(1, sites_per_customer + 1) for c in combinations(sites, k)]


def site_costs(demand: DataFrame, units: DataFrame, sites: Sequence[str], sites_per_customer: int = 1) -> DataFrame:
    """What each customer costs by site, or set of up to ``sites_per_customer`` sites. Written once, a row per customer:
    the choice of sites and the plan of the chosen ones both read it."""
    return cut(option_costs(demand, units, _options(range(len(sites)), sites_per_customer)))


def _set_sums(costs: DataFrame, options: Sequence[Sequence[int]], masks: Sequence[int]) -> DataFrame:
    """(Mask, Cost, Unserved): the cost of each set and the number of customers that it cannot serve."""
    bits = [sum(1 << s for s in option) for option in options]
    aggs = []
    for m in masks:
        usable = [F.col(f"o{i}") for i, b in enumerate(bits) if m & b == b]
        best = F.least(*usable) if len(usable) > 1 else usable[0]
        aggs += [F.sum(best).alias(f"c{m}"), F.count(F.when(best.isNull(), 1)).alias(f"n{m}")]
    rows = [F.struct(F.lit(m).alias("Mask"), F.col(f"c{m}").alias("Cost"), F.col(f"n{m}").alias("Unserved")) for m in masks]
    return costs.agg(*aggs).select(F.inline(F.array(*rows)))


def open_site_scenarios(
    demand: DataFrame,
    units: DataFrame,
    sites: Sequence[str],
    min_open: int = 1,
    max_open: int | None = None,
    closed: Sequence[str] = (),
    sites_per_customer: int = 1,
    top: int | None = None,
    most_sites: int = MOST_SITES,
    costs: DataFrame | None = None,
) -> DataFrame:
    """Total cost of each set of open sites, best first.

    Exact while capacity does not bind. With capacity it is a lower bound, and the optimum whenever the
    plan it implies passes ``check_plan``. An open site may stay idle, so "exactly k open" costs the same
    as "at most k". Sets that leave a customer without a site rank last and report how many. ``costs`` are the
    ``site_costs`` of the same demand, for callers that have them.
    """
    n = len(sites)
    masks = site_sets(n, min_open, max_open or n, [list(sites).index(s) for s in closed], most_sites)
    options = _options(range(n), sites_per_customer)

    # Sets are columns of one aggregate, so a customer stays one row; beyond a block of sets the costs, written once,
    # are read again for each block.
    blocks = [masks[k : k + SETS_PER_PASS] for k in range(0, len(masks), SETS_PER_PASS)]
    if costs is None:
        costs = option_costs(demand, units, options)
        costs = cut(costs) if len(blocks) > 1 else costs
    sums = reduce(DataFrame.unionByName, [_set_sums(costs, options, block) for block in blocks])
    names = [F.when(F.col("Mask").bitwiseAND(F.lit(1 << i)) != 0, s) for i, s in enumerate(sites)]
    named = sums.select(
        "Mask",
        F.concat_ws("+", *names).alias("OpenSites"),
        F.bit_count("Mask").alias("NOpen"),
        "Cost",
        "Unserved",
    )
    # At most 2^12 - 1 rows are left here.
    order = Window.orderBy("Unserved", F.col("Cost").asc_nulls_last(), "NOpen", "Mask")
    ranked = named.withColumn("Rank", F.row_number().over(order))
    return ranked if top is None else ranked.orderBy("Rank").limit(top)


def open_plan(
    demand: DataFrame,
    units: DataFrame,
    inbound: DataFrame,
    sites: Sequence[str],
    chosen: Sequence[str],
    sites_per_customer: int = 1,
    costs: DataFrame | None = None,
    keep: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Outbound and inter-site flows when only the ``chosen`` sites are open.

    Each customer gets its cheapest site, or set of up to ``sites_per_customer`` sites of which each product
    takes the cheaper one; ties go to the first site and the smaller set. The flows cost what
    ``open_site_scenarios`` says, and are the optimum if they pass ``check_plan`` with the real capacities.

    ``costs`` are the ``site_costs`` of the same demand, for callers that have them. ``keep`` writes the outbound flows
    once, for callers that read both legs or one of them several times.
    """
    options = _options([list(sites).index(s) for s in sorted(chosen)], sites_per_customer)
    if costs is None:
        costs = option_costs(demand, units, options)
    else:
        every = _options(range(len(sites)), sites_per_customer)
        own = [F.col(f"o{every.index(tuple(sorted(option)))}").alias(f"o{i}") for i, option in enumerate(options)]
        costs = costs.select(*CUSTOMER, *own)
    ranked = [
        F.when(F.col(f"o{i}").isNotNull(), F.struct(F.col(f"o{i}").alias("Cost"), F.lit(i).alias("Option")))
        for i in range(len(options))
    ]
    best = F.least(*ranked) if len(ranked) > 1 else ranked[0]
    served = costs.select(*CUSTOMER, best.alias("best")).where(F.col("best").isNotNull()).select(*CUSTOMER, "best.Option")
    priced = lookup(demand.join(served, CUSTOMER), units, {"Loc": "Dest", PRODUCT: PRODUCT})
    site = F.lit(None).cast("string")
    for i, option in enumerate(options):
        cheapest = [F.struct(F.col(f"u{s}").alias("u"), F.lit(sites[s]).alias("s")) for s in option]
        one = F.least(*cheapest) if len(cheapest) > 1 else cheapest[0]
        if len(cheapest) > 1:  # a site without a way for the product is no choice
            one = F.least(*[F.when(F.col(f"u{s}").isNotNull(), c) for s, c in zip(option, cheapest)])
        site = F.when(F.col("Option") == i, one["s"]).otherwise(site)
    outbound = priced.select(site.alias("ShipSite"), *CUSTOMER, PRODUCT, "MUnits")
    outbound = cut(outbound) if keep else outbound
    needs = total(outbound, ["ShipSite", PRODUCT], "MUnits")
    moved = needs.join(inbound, ["ShipSite", PRODUCT]).select("MfgSite", "ShipSite", PRODUCT, "MUnits")
    return outbound, moved


def _moves(chosen: frozenset[int], allowed: Sequence[int], max_open: int) -> list[tuple[int | None, int | None]]:
    """(site to close, site to open) of every neighbour of a set."""
    free = [a for a in allowed if a not in chosen]
    adds = [(None, a) for a in free] if len(chosen) < max_open else []
    return adds + [(d, None) for d in sorted(chosen)] + [(d, a) for d in sorted(chosen) for a in free]


def search_open_sites(
    demand: DataFrame,
    units: DataFrame,
    sites: Sequence[str],
    max_open: int,
    closed: Sequence[str] = (),
    start: Sequence[str] = (),
    most_steps: int = 1000,
) -> DataFrame:
    """Steps (Step, Opened, Closed, OpenSites, NOpen, Cost, Unserved, Bound) to a good set of at most ``max_open`` sites.

    For more sites than can be enumerated: from ``start``, the best of all sets that differ by one site opened, closed or
    exchanged, until none is better. All neighbours of a set are columns of one aggregate over the customers, who know
    their cheapest and next cheapest open site; so a step is one pass for every ``SETS_PER_PASS`` of them, and only their
    sums reach the driver. The end is a local optimum. ``Bound`` is the cost with all allowed sites open: no set costs less.
    """
    n = len(sites)
    allowed = [i for i in range(n) if sites[i] not in closed]
    costs = cut(option_costs(demand, units, [(i,) for i in range(n)]))
    every = [F.col(f"o{i}") for i in allowed]
    bound = costs.agg(F.sum(F.least(*every) if len(every) > 1 else every[0]).cast("double")).first()[0]

    def measured(chosen: frozenset[int], moves: Sequence[tuple[int | None, int | None]]) -> list[tuple]:
        found = []
        for k in range(0, len(moves), SETS_PER_PASS):
            block = moves[k : k + SETS_PER_PASS]
            entries = [F.when(F.col(f"o{i}").isNotNull(), F.struct(F.col(f"o{i}").alias("cost"), F.lit(i).alias("at"))) for i in sorted(chosen)]
            if entries:
                ranked = costs.withColumn("__r", F.slice(F.sort_array(F.array_compact(F.array(*entries))), 1, 2))
                one, two = F.get("__r", F.lit(0)), F.get("__r", F.lit(1))
                ranked = ranked.withColumns({"__at": one["at"], "__1": one["cost"], "__2": two["cost"]})
            else:
                none = F.lit(None).cast(costs.schema["o0"].dataType)
                ranked = costs.withColumns({"__at": F.lit(None).cast("int"), "__1": none, "__2": none})
            aggs = []
            for j, (d, a) in enumerate(block):
                cost = F.col("__1") if d is None else F.when(F.col("__at") == d, F.col("__2")).otherwise(F.col("__1"))
                cost = cost if a is None else F.least(cost, F.col(f"o{a}"))
                aggs += [F.count(F.when(cost.isNull(), 1)).alias(f"n{j}"), F.sum(cost).alias(f"c{j}")]
            row = ranked.agg(*aggs).first()
            found += [(row[f"n{j}"], row[f"c{j}"] or 0, move) for j, move in enumerate(block)]
        return found

    chosen = frozenset(list(sites).index(s) for s in start)
    best = measured(chosen, [(None, None)])[0][:2]
    trace: list[tuple] = []
    pending: tuple[int | None, int | None] = (None, None)
    name = lambda i: None if i is None else sites[i]
    while True:
        opened = "+".join(sites[i] for i in sorted(chosen))
        trace.append((len(trace), name(pending[1]), name(pending[0]), opened, len(chosen), float(best[1]), best[0], bound))
        moves = _moves(chosen, allowed, max_open)
        if not moves or len(trace) > most_steps:
            break
        unserved, cost, pending = min(measured(chosen, moves), key=lambda x: (x[0], x[1]))
        if (unserved, cost) >= best:
            break
        best = (unserved, cost)
        chosen = (chosen - {pending[0]}) | ({pending[1]} if pending[1] is not None else set())
    schema = "Step INT, Opened STRING, Closed STRING, OpenSites STRING, NOpen INT, Cost DOUBLE, Unserved BIGINT, Bound DOUBLE"
    return demand.sparkSession.createDataFrame(trace, schema)
