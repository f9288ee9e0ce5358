"""Rule-by-rule check of a plan: one row per violation, none for a clean plan."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightnet.plans.network import CUSTOMER, PRODUCT
from freightnet.schemas import VOLUME

#: Least difference that counts, and the share of the limit that does not.
TOLERANCE, RELATIVE = 1e-6, 1e-9


def _slack(limit: Column) -> Column:
    return F.greatest(F.lit(TOLERANCE), F.abs(limit) * RELATIVE)


def _violation(rule: str, keys: Sequence[Column], actual: Column, limit: Column, when: Column) -> Column:
    """A row of the result where ``when`` holds, else NULL."""
    key = F.concat_ws("|", *keys) if keys else F.lit("")
    row = F.struct(
        F.lit(rule).alias("Rule"), key.alias("Key"), actual.cast("double").alias("Actual"), limit.cast("double").alias("Limit")
    )
    return F.when(when, row)


def _over(rule: str, keys: Sequence[Column], actual: Column, limit: Column) -> Column:
    return _violation(rule, keys, actual, limit, actual > limit + _slack(limit))


def _shown(df: DataFrame, rows: Column) -> DataFrame:
    """The rows of an array of violations, NULLs left out."""
    return df.select(F.inline(F.filter(rows, lambda x: x.isNotNull())))


def _exact(measure: str) -> Column:
    return F.col(measure).cast(VOLUME)


def customer_rules(outbound: DataFrame, demand: DataFrame, sites_per_customer: int | None = None) -> DataFrame:
    """Rules of demand, links and sites per customer.

    Flows and demand move once, to their customer. Everything after that (sums by site, by product, by customer) finds its
    rows together already. What a customer gathers is a row per product and site.
    """
    none = F.lit(None)
    sent = outbound.select(*CUSTOMER, PRODUCT, "ShipSite", _exact("MUnits").alias("Sent"), F.col("MUnits").alias("Row"), none.cast(VOLUME).alias("Wanted"))
    wanted = demand.select(*CUSTOMER, PRODUCT, none.cast("string").alias("ShipSite"), none.cast(VOLUME).alias("Sent"), none.cast("double").alias("Row"), _exact("MUnits").alias("Wanted"))
    dealt = sent.withColumn("Row", F.col("Row").cast("double")).unionByName(wanted).repartition(*CUSTOMER)
    zero = F.lit(0).cast(VOLUME)
    by_site = dealt.groupBy(*CUSTOMER, PRODUCT, "ShipSite").agg(
        F.sum("Sent").alias("Sent"), F.max("Row").alias("Row"), F.sum("Wanted").alias("Wanted"), F.count("Row").alias("n")
    )
    site = F.when(F.col("n") > 0, F.struct("ShipSite", F.col("Sent").cast("double").alias("Sent"), "Row"))
    by_product = by_site.groupBy(*CUSTOMER, PRODUCT).agg(
        F.coalesce(F.sum("Sent"), zero).cast("double").alias("Sent"),
        F.coalesce(F.sum("Wanted"), zero).cast("double").alias("Wanted"),
        F.collect_list(site).alias("Sites"),
    )
    by_customer = by_product.groupBy(*CUSTOMER).agg(F.collect_list(F.struct(PRODUCT, "Sent", "Wanted", "Sites")).alias("Products"))

    who = [F.col(c) for c in CUSTOMER]
    differs = lambda p: F.abs(p["Sent"] - p["Wanted"]) > _slack(p["Wanted"])
    unequal = F.transform("Products", lambda p: _violation("demand", [*who, p[PRODUCT]], p["Sent"], p["Wanted"], differs(p)))
    links = F.flatten(
        F.transform(
            "Products",
            lambda p: F.transform(p["Sites"], lambda s: _over("link", [s["ShipSite"], *who, p[PRODUCT]], s["Sent"], p["Wanted"])),
        )
    )
    found = [unequal, links]
    if sites_per_customer is not None:
        every = F.flatten(F.transform("Products", lambda p: p["Sites"]))
        used = F.array_distinct(F.transform(F.filter(every, lambda s: s["Row"] > TOLERANCE), lambda s: s["ShipSite"]))
        found.append(F.array(_over("sites_per_customer", who, F.size(used).cast("double"), F.lit(float(sites_per_customer)))))
    return _shown(by_customer, F.concat(*found))


def _share(kind: str, a: str | Column, b: str | Column | None, actual: Column | None, limit: Column | None, cap: Column | None = None) -> Column:
    """What one row adds to one sum: the sums of all site rules are one aggregate over such rows."""
    col = lambda c: F.lit(None).cast("string") if c is None else (F.col(c) if isinstance(c, str) else c)
    zero = F.lit(0).cast(VOLUME)
    return F.struct(
        F.lit(kind).alias("Kind"), col(a).alias("A"), col(b).alias("B"),
        (zero if actual is None else actual.cast(VOLUME)).alias("Actual"),
        (zero if limit is None else limit.cast(VOLUME)).alias("Limit"),
        F.lit(None).cast("double").alias("Cap") if cap is None else cap.cast("double").alias("Cap"),
        (F.lit(None).cast("double") if actual is None else actual.cast("double")).alias("Row"),
    )


def _sums(parts: Sequence[tuple[DataFrame, list[Column]]]) -> DataFrame:
    """(Kind, A, B) with the sums of the shares of all rows: combined before the one shuffle."""
    rows = reduce(DataFrame.unionByName, [df.select(F.inline(F.array(*shares))) for df, shares in parts])
    return rows.groupBy("Kind", "A", "B").agg(
        F.sum("Actual").cast("double").alias("Actual"), F.sum("Limit").cast("double").alias("Limit"),
        F.max("Cap").alias("Cap"), F.max("Row").alias("Row"), F.count("Row").alias("n"),
    )


def _site_violations(sums: DataFrame, closed: Sequence[str] = (), arc_limit: float | None = None) -> DataFrame:
    kind, a, b = F.col("Kind"), F.col("A"), F.col("B")
    actual, limit, cap = F.col("Actual"), F.col("Limit"), F.col("Cap")
    differs = F.abs(actual - limit) > _slack(limit)
    rows = [
        F.when(kind == "supply", _over("supply", [a, b], actual, limit)),
        F.when(kind == "balance", _violation("site_balance", [a, b], actual, limit, differs)),
        F.when((kind == "site") & (F.col("n") > 0), _over("throughput", [a], actual, cap)),
    ]
    if closed:
        rows.append(F.when((kind == "site") & a.isin(*closed), _over("closed_site", [a], actual, F.lit(0.0))))
    if arc_limit is not None:
        rows.append(F.when(kind == "arc", _over("arc", [a, b], actual, F.lit(float(arc_limit)))))
    return _shown(sums, F.array(*rows))


def _counts(sums: DataFrame, max_open: int | None, max_served: int | None) -> list[DataFrame]:
    """Rules on how many sites are used and how many places each serves, from the sums."""
    out, used = [], F.col("Row") > TOLERANCE
    if max_open is not None:
        n = sums.where((F.col("Kind") == "site") & used).agg(F.count(F.lit(1)).cast("double").alias("n"))
        out.append(_shown(n, F.array(_over("open_count", [], F.col("n"), F.lit(float(max_open))))))
    if max_served is not None:
        n = sums.where((F.col("Kind") == "arc") & used).groupBy("A").agg(F.count(F.lit(1)).cast("double").alias("n"))
        out.append(_shown(n, F.array(_over("max_served", [F.col("A")], F.col("n"), F.lit(float(max_served))))))
    return out


def balance_rule(outbound: DataFrame, inbound: DataFrame) -> DataFrame:
    """What a site receives of a product is what it sends."""
    moved = [_share("balance", "ShipSite", PRODUCT, F.col("MUnits"), None)]
    sent = [_share("balance", "ShipSite", PRODUCT, None, F.col("MUnits"))]
    return _site_violations(_sums([(inbound, moved), (outbound, sent)]))


def throughput_rule(outbound: DataFrame, caps: DataFrame) -> DataFrame:
    """``caps`` is (ShipSite, Cap); a site without a cap is not limited."""
    used = [_share("site", "ShipSite", None, F.col("MUnits"), None)]
    return _site_violations(_sums([(outbound, used), (caps, [_share("site", "ShipSite", None, None, None, F.col("Cap"))])]))


def arc_rule(plan: DataFrame, origin: str, dest: str, most: float) -> DataFrame:
    """Cap on the flow of all products together over one origin and destination."""
    return _site_violations(_sums([(plan, [_share("arc", origin, dest, F.col("MUnits"), None)])]), arc_limit=most)


def non_negative_rule(outbound: DataFrame, inbound: DataFrame) -> DataFrame:
    """Each flow by itself: nothing moves."""
    zero, flow = F.lit(0.0), F.col("MUnits")
    below = lambda rule, keys: F.array(_violation(rule, [F.col(k) for k in keys], flow, zero, flow < -TOLERANCE))
    out = _shown(outbound, below("negative_outbound", ["ShipSite", *CUSTOMER, PRODUCT]))
    return out.unionByName(_shown(inbound, below("negative_inbound", ["MfgSite", "ShipSite", PRODUCT])))


def flow_rules(outbound: DataFrame, inbound: DataFrame, demand: DataFrame, sites_per_customer: int | None = None) -> DataFrame:
    """The part of ``check_plan`` that knows no capacity: rules of customers, and of each flow by itself."""
    return customer_rules(outbound, demand, sites_per_customer).unionByName(non_negative_rule(outbound, inbound))


def check_plan(
    outbound: DataFrame,
    inbound: DataFrame,
    demand: DataFrame,
    supply: DataFrame,
    caps: DataFrame | None = None,
    sites_per_customer: int | None = None,
    max_open: int | None = None,
    closed: Sequence[str] = (),
    arc_limit: float | None = None,
    max_served: int | None = None,
    found: DataFrame | None = None,
) -> DataFrame:
    """Violations of every rule that is asked for, none for a clean plan.

    Two shuffles whatever the number of rules: flows and demand to their customers, and the sums of all site rules in one
    aggregate, combined before it moves. Read the plan from a written table: it is scanned for each of the two. Callers
    that check one plan under several capacities write its ``flow_rules`` once and give them as ``found``: the flows then
    go to their customers once.
    """
    flow = F.col("MUnits")
    out = [_share("balance", "ShipSite", PRODUCT, None, flow)]
    if caps is not None or closed or max_open is not None:
        out.append(_share("site", "ShipSite", None, flow, None))
    if arc_limit is not None or max_served is not None:
        out.append(_share("arc", "ShipSite", "Loc", flow, None))
    parts = [
        (outbound, out),
        (inbound, [_share("balance", "ShipSite", PRODUCT, flow, None), _share("supply", "MfgSite", PRODUCT, flow, None)]),
        (supply, [_share("supply", "MfgSite", PRODUCT, None, F.col("Capacity"))]),
    ]
    if caps is not None:
        parts.append((caps, [_share("site", "ShipSite", None, None, None, F.col("Cap"))]))
    sums = _sums(parts)
    rules = [
        flow_rules(outbound, inbound, demand, sites_per_customer) if found is None else found,
        _site_violations(sums, closed, arc_limit),
        *_counts(sums, max_open, max_served),
    ]
    return reduce(DataFrame.unionByName, rules)


def is_exact(violations: DataFrame) -> bool:
    """True when a capacity-free optimum also keeps every capacity rule, so that it is the optimum."""
    return violations.isEmpty()
