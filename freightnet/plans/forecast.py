"""Forecast, and its spread over customers by their share of past volume."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightnet.functions.scalar import substituted
from freightnet.operators.tables import force_terms, lookup, share, total
from freightnet.scale import deal

CUSTOMER = ["MSTName", "Loc", "FTerms", "PrintGroup", "PartType"]


def forecast(sheet: DataFrame, sites: DataFrame, forecast_set: str, first: str, last: str) -> DataFrame:
    """Units by plant, print group and part type of one forecast set over a span of months.

    The sum runs before the join with site names, so only the totals meet the names.
    """
    kept = sheet.where((F.col("ForecastSet") == forecast_set) & F.col("YearMonth").between(first, last))
    sums = total(kept, ["ForecastSet", "MfgSite", "PrintGroup", "PartType"], "OLMUnits")
    named = lookup(sums, sites.withColumnRenamed("SiteName", "MfgSiteName"), {"MfgSite": "SiteCode"})
    return total(named, ["ForecastSet", "MfgSite", "MfgSiteName", "PrintGroup", "PartType"], "OLMUnits")


def split_share(
    ship: DataFrame,
    swaps: Mapping[str, str] | None = None,
    by: Sequence[str] = ("PrintGroup", "PartType"),
    tasks: int | None = None,
) -> DataFrame:
    """Share of each customer in the volume of a part, all terms counted as prepaid.

    ``by=("PartType",)`` shares over all print groups at once; shares then add up to 1 per part only.
    ``tasks`` is the number of tasks that the rows are dealt to, by default Spark's choice.
    """
    prepaid = force_terms(ship).withColumnRenamed("FrtTermsFix", "FTerms")
    swapped = prepaid.withColumn("PartType", substituted("PartType", swaps or {}))
    # The terms are all the same, so they are no key to deal by.
    dealt = deal(swapped, tasks, *[c for c in CUSTOMER if c != "FTerms"])
    return share(total(dealt, CUSTOMER, "MUnits"), by, "MUnits").select(*CUSTOMER, "Pct")


def allocate_forecast(shares: DataFrame, fcst: DataFrame, swaps: Mapping[str, str] | None = None) -> DataFrame:
    """Forecast volume per customer; parts no longer in the forecast are dropped."""
    swapped = fcst.withColumn("PartType", substituted("PartType", swaps or {}))
    parts = total(swapped, ["PrintGroup", "PartType"], "OLMUnits", "__units")
    joined = lookup(shares, parts, {"PrintGroup": "PrintGroup", "PartType": "PartType"}, "inner")
    kept = joined.where(F.col("__units").isNotNull())
    return kept.withColumn("MUnits", F.col("Pct") * F.col("__units")).drop("Pct", "__units")


def lost_forecast(shares: DataFrame, fcst: DataFrame) -> DataFrame:
    """Forecast volume of parts that no customer took in the past."""
    parts = total(fcst, ["PrintGroup", "PartType"], "OLMUnits")
    return parts.join(shares.select("PrintGroup", "PartType"), ["PrintGroup", "PartType"], "left_anti")
