"""Demand and supply tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightnet.functions.scalar import lid_or_cup, number, place
from freightnet.operators.tables import (
    THIRD_PARTY_SITES,
    first_per_key,
    first_reason,
    keep_known,
    lengthen,
    lookup,
    own_sites,
    total,
)
from freightnet.scale import cut


def clean_history(ship: DataFrame, third_party: Sequence[str] = THIRD_PARTY_SITES) -> DataFrame:
    """History of own sites with a known plant; Loc and the lid/cup class where their columns are there."""
    kept = own_sites(ship.na.drop(subset=["MfgSiteName"]), "ShipSiteName", third_party)
    if "MSTCity" in ship.columns:
        kept = kept.withColumn("Loc", place("MSTCity", "MSTState"))
    return kept.withColumn("PTypeFix", lid_or_cup("PartType")) if "PartType" in ship.columns else kept


def root_list(roots: DataFrame) -> DataFrame:
    """(PartType, RootPartType), one row per part type, from the sheet of root part types.

    Written, so that its true size decides later joins: a short list never makes the history move.
    """
    named = roots.select(F.col("`Part Type`").alias("PartType"), F.col("`Root Part Type`").alias("RootPartType"))
    return cut(first_per_key(named.distinct(), "PartType", "RootPartType"))


def root_product_key(ship: DataFrame, roots: DataFrame) -> DataFrame:
    """RPType: the part type for lids, its root part type for cups. Parts without a root are dropped."""
    joined = lookup(ship, roots, {"PartType": "PartType"}, "inner")
    return joined.withColumn(
        "RPType", F.when(F.col("PTypeFix") == "LID", F.col("PartType")).otherwise(F.col("RootPartType"))
    )


def demand(ship: DataFrame, dist: DataFrame, keys: Sequence[str], measure: str = "MUnits") -> DataFrame:
    """Volume by ``keys`` for the destinations that have a distance."""
    return total(keep_known(ship, dist, {"Loc": "Dest"}), keys, measure)


def demand_by_city(ship: DataFrame, geocodes: DataFrame) -> DataFrame:
    """Volume by city and terms with one geocode of the city, that of its first zip, so that no volume is repeated;
    cities without a zip are dropped."""
    sums = total(ship, ["MSTCity", "MSTState", "FrtTermsFix"], "MUnits")
    coded = geocodes.na.drop(subset=["MSTZip"]).select("MSTCity", "MSTState", F.struct("MSTZip", "lat", "lon").alias("g"))
    coded = coded.groupBy("MSTCity", "MSTState").agg(F.min("g").alias("g")).select("MSTCity", "MSTState", "g.*")
    kept = sums.where(~F.col("MSTState").isin("EX", "PR", "HI") & (F.col("MSTCity") != "GNANGARA"))
    return kept.withColumn("Dest", place("MSTCity", "MSTState")).join(coded, ["MSTCity", "MSTState"])


def supply(history: DataFrame, product: str = "RPType") -> DataFrame:
    """Capacity = what each plant made; empty and zero rows dropped."""
    made = total(history.na.drop(subset=["MfgSiteName", product]), ["MfgSiteName", product], "MUnits", "Capacity")
    return made.withColumnRenamed("MfgSiteName", "MfgSite").where(F.col("Capacity") != 0)


def supply_from_capacity(capacity: DataFrame, keys: Sequence[str] = ("MfgSite", "PrintGroup", "PartType")) -> DataFrame:
    """Capacity sheet by plant name and part; rows with a missing key or no capacity dropped.

    The sheet names its amount OLMUnits or Capacity; where it has both columns, the one that is filled counts.
    """
    amounts = [F.col(c).cast("double") for c in ("OLMUnits", "Capacity") if c in capacity.columns]
    amount = amounts[0] if len(amounts) == 1 else F.coalesce(*amounts)
    whole = capacity.withColumn("__amount", amount).drop("MfgSite", "OLMUnits", "Capacity")
    kept = whole.withColumnsRenamed({"__amount": "Capacity", "MfgSiteName": "MfgSite"})
    return total(kept.na.drop(subset=[*keys, "Capacity"]).where(F.col("Capacity") != 0), keys, "Capacity")


def unpivot_demand_sheet(sheet: DataFrame, customers: Sequence[str], key_length: int = 8) -> DataFrame:
    """Volume by print, item and customer key from a sheet with one column per customer.

    Repeated header lines, empty items, cells that are not numbers and volumes of zero or less are dropped.
    Columns that share a key prefix are added up.
    """
    rows = sheet_cells(sheet, customers).where(first_reason(sheet_drops()).isNull())
    typed = rows.select("Print", "ITEM", F.left("MST", F.lit(key_length)).alias("MST"), number("cell").alias("MUnits"))
    return total(typed, ["Print", "ITEM", "MST"], "MUnits")


def sheet_cells(sheet: DataFrame, customers: Sequence[str]) -> DataFrame:
    """(ITEM, Print, MST, cell) of every cell of a demand sheet."""
    return lengthen(sheet, ["ITEM", "Print"], customers, "MST", "cell")


def sheet_drops() -> dict[str, Column]:
    """Why ``unpivot_demand_sheet`` leaves a cell out, first reason first."""
    return {
        "null_key": F.col("ITEM").isNull(),
        "header": F.col("ITEM") == "ITEM",
        "empty": F.col("cell").isNull() | (F.trim("cell") == ""),
        "unreadable": number("cell").isNull(),
        "not_positive": number("cell") <= 0,
    }


def locate_demand(sheet_demand: DataFrame, master: DataFrame) -> DataFrame:
    """Sheet demand by master name, place and item, all prepaid."""
    named = lookup(sheet_demand, master.select("MST", "MSTName", "MSTCity", "MSTState"), {"MST": "MST"})
    placed = named.withColumn("Loc", place("MSTCity", "MSTState")).withColumn("FTerms", F.lit("PPD"))
    return total(placed, ["MSTName", "Loc", "ITEM", "FTerms"], "MUnits")
