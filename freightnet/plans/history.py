"""Shipment history from the ERP tables, and the two diagnostics that go with it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freightnet.functions.scalar import CARRIERS, terms, year_month, year_start
from freightnet.scale import deal, null_safe_join, rank_and_count
from freightnet.schemas import VOLUME

# Fixed values of the extract.
DOMAIN = "037"
INVOICED = "INV"
EXCLUDED_SITES = ("531",)
SAMPLE_NAME = "%SAMPL%"
BILL_LENGTH = 9

MASTER = ["MST", "MSTSetup", "MSTName", "MSTCity", "MSTState", "MSTZip", "MSTCountry"]
STOPS = ["StopNbrFix", "BOLMasterShipToCount"]
CHARGES = ["Miles", "Freight", "EstimatedFreight", "InvFrt", "ActualFreight", "PaidFlag"]


def order_headers(erp: Mapping[str, DataFrame], as_of: str, domain: str = DOMAIN) -> DataFrame:
    """Invoiced orders since the start of the year, with their freight record and master ship-to.

    The customer name must exist and not be a sample, so that join is inner.
    """
    header = erp["ih_hist_all"].where(
        (F.col("ih_domain") == domain)
        & (F.col("xxih__chr01") == INVOICED)
        & (F.col("ih_ship_date") >= year_start(as_of))
    )
    named = erp["cm_mstr_all"].where((F.col("cm_domain") == domain) & ~F.upper("cm_name").like(SAMPLE_NAME))
    address = erp["ad_mstr_all"].where(F.col("ad_domain") == domain)
    customers = address.join(named, F.col("ad_addr") == F.col("cm_addr")).select("ad_addr")
    paid = erp["Freight"].withColumnsRenamed({"ShipSite": "frt_site", "ShipDate": "frt_date"})
    charged = (
        (F.col("frt_site") == F.col("ih_site"))
        & (F.col("SalesOrderNo") == F.col("ih_nbr"))
        & (F.col("frt_date") == F.col("ih_ship_date"))
    )
    return (
        header.join(customers, F.col("ih_ship") == F.col("ad_addr"))
        .join(erp["MasterShipTo"], F.col("ST") == F.col("ih_ship"), "left")
        .join(paid, charged, "left")
    )


def order_lines(
    erp: Mapping[str, DataFrame],
    as_of: str,
    domain: str = DOMAIN,
    excluded: Sequence[str] = EXCLUDED_SITES,
    headers: DataFrame | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Order lines of those orders with part and pallet data, without the excluded sites.

    Part and pallet data meet the lines while these are narrow; everything that hangs on the order is joined before, at the
    smaller grain (``headers`` are ``order_headers`` unless given). Tables that are bucketed by order
    (``writers.land_bucketed``) meet without a shuffle, unless ``tasks`` says into how many tasks the lines are dealt.
    """
    made = (F.col("idh_domain") == F.col("pt_domain")) & (F.col("idh_part") == F.col("pt_part"))
    packed = (F.col("Part") == F.col("idh_part")) & (F.col("Site") == F.col("idh_site"))
    described = _kept_lines(erp, excluded).join(erp["pt_mstr_all"], made, "left").join(erp["Pallets"], packed, "left")
    headers = order_headers(erp, as_of, domain) if headers is None else headers
    lines, headers = deal(described, tasks, "idh_domain", "idh_nbr"), deal(headers, tasks, "ih_domain", "ih_nbr")
    return lines.join(headers, _ordered())


def _kept_lines(erp: Mapping[str, DataFrame], excluded: Sequence[str]) -> DataFrame:
    return erp["idh_hist_all"].where(~F.col("idh_site").isin(*excluded))


def _ordered() -> Column:
    return (F.col("ih_domain") == F.col("idh_domain")) & (F.col("ih_nbr") == F.col("idh_nbr"))


def _bill() -> Column:
    return F.left("ih_bol", F.lit(BILL_LENGTH)).alias("MasterBOL")


def stopped_headers(
    erp: Mapping[str, DataFrame], as_of: str, domain: str = DOMAIN, excluded: Sequence[str] = EXCLUDED_SITES
) -> DataFrame:
    """Order headers with the stops of their master bill, as ``add_stops`` gives them.

    A stop counts if an order with lines goes there, so the ranks are known before the lines are joined: headers are a
    fraction of the lines, and no row as wide as the history moves for its stop number.
    """
    headers = order_headers(erp, as_of, domain).withColumn("MasterBOL", _bill())
    keys = _kept_lines(erp, excluded).select("idh_domain", "idh_nbr")
    used = headers.select("ih_domain", "ih_nbr", "MasterBOL", "MST").join(keys, _ordered(), "left_semi")
    return _with_ranks(headers, used)


def grouped_history(lines: DataFrame, tasks: int | None = None) -> DataFrame:
    """One row per ship date, site, master ship-to, bill, carrier, part type and charge set.

    With ``tasks`` the lines are dealt by what hangs on the order: those of an order stay next to each other, so that its
    wide columns are packed once and not once per line, and the groups need no other shuffle. Stop numbers that the lines
    carry are kept.
    """
    qty = F.coalesce("idh_qty_ship", F.lit(0.0))
    pallets = F.coalesce(F.try_divide("idh_qty_ship", "CasepPallet"), F.lit(0.0))
    stops = [c for c in STOPS if c in lines.columns]
    # The headers that carry stop numbers have the bill already.
    lines = lines.withColumn("FrtTerms", F.upper("ih_fr_terms")).withColumn("MasterBOL", _bill())
    ordered = [
        "ih_ship_date", *MASTER, "ih_shipvia", "FrtTerms", "MasterBOL",
        "xxih__load", "xxih__truck", "xxih__custpu", "xxih__base_chrg", *CHARGES, *stops,
    ]
    return deal(lines, tasks, *ordered).groupBy(*ordered, "idh_site", "pt_group", "pt_part_type").agg(
        F.sum(qty).alias("Cases"),
        (F.sum(qty * F.col("xxpt__case_pk")) / 1000).alias("MUnits"),
        F.sum(qty * F.col("pt_size")).alias("Cube"),
        F.sum(pallets.cast(VOLUME)).cast("double").alias("Pallets"),
    )


def add_stops(df: DataFrame, bill: str = "MasterBOL", stop: str = "MST") -> DataFrame:
    """Stop number of each row in its master bill, and the number of stops of the bill."""
    return _with_ranks(df, df, bill, stop)


def _with_ranks(df: DataFrame, used: DataFrame, bill: str = "MasterBOL", stop: str = "MST") -> DataFrame:
    """Rows of ``df`` with the stops that ``used`` makes."""
    return null_safe_join(df, rank_and_count(used, [bill], stop, *STOPS), [bill, stop])


def carriers(spark: SparkSession) -> DataFrame:
    """(scac, mode, priority) of the known carriers; a code may be listed under several modes."""
    rows = [(code, mode, k) for k, (mode, codes) in enumerate(CARRIERS.items()) for code in codes.split()]
    return spark.createDataFrame(rows, "scac STRING, mode STRING, priority INT")


def with_mode(df: DataFrame, truck: str, known: DataFrame, out: str = "ModeFix") -> DataFrame:
    """Transport mode of a carrier code: of the modes that list it the one of least priority, UNKNOWN without any.

    ``known`` is a table like ``carriers``: new codes and modes are rows, not code. It is as long as the list of carriers,
    so Spark broadcasts it by its size.
    """
    code = F.upper(F.trim("scac"))
    first = known.groupBy(code.alias("__scac")).agg(F.min_by("mode", F.struct("priority", "mode")).alias("__mode"))
    joined = df.join(first, F.upper(F.trim(F.col(truck))) == F.col("__scac"), "left")
    return joined.withColumn(out, F.coalesce("__mode", F.lit("UNKNOWN"))).drop("__scac", "__mode")


def ship_history(
    erp: Mapping[str, DataFrame],
    as_of: str,
    domain: str = DOMAIN,
    excluded: Sequence[str] = EXCLUDED_SITES,
    known: DataFrame | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """The shipment history table.

    The wide rows of the history move once, to their group: the stop numbers come with the headers. ``tasks`` is the number
    of tasks that the lines are dealt to, by default Spark's choice.
    """
    headers = stopped_headers(erp, as_of, domain, excluded)
    grouped = grouped_history(order_lines(erp, as_of, domain, excluded, headers, tasks), tasks)
    known = carriers(grouped.sparkSession) if known is None else known
    zero = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("xxih__base_chrg", *CHARGES)]
    return with_mode(grouped, "xxih__truck", known).select(
        year_month("ih_ship_date").alias("ShipMonth"),
        F.to_date("ih_ship_date").alias("ShipDate"),
        F.col("idh_site").alias("ShipSite"),
        *MASTER,
        F.col("ih_shipvia").alias("shipVia"),
        "FrtTerms",
        terms("FrtTerms").alias("FrtTermsFix"),
        "MasterBOL",
        F.col("xxih__custpu").alias("CustPUFlag"),
        "StopNbrFix",
        "BOLMasterShipToCount",
        F.col("xxih__load").alias("Load"),
        F.col("xxih__truck").alias("Truck"),
        "ModeFix",
        F.col("pt_part_type").alias("PartType"),
        F.col("pt_group").alias("PrintGroup"),
        "Cases",
        "MUnits",
        "Cube",
        "Pallets",
        *zero,
    )


def freight_by_bill(charges: DataFrame) -> DataFrame:
    """Charges by site, ship date, bill and master bill."""
    keys = ["xxtrf__site", "xxtrf__ship_date", "xxtrf__bol", "xxtrf__mstr_bol"]
    return charges.groupBy(*keys).agg(F.sum("xxtrf__chrg").alias("xxtrf__chrg"))


def site_month(erp: Mapping[str, DataFrame], site: str, year: int, month: int, domain: str = DOMAIN) -> DataFrame:
    """Volume of one site in one month, by invoice status and freight terms."""
    first = F.make_date(F.lit(year), F.lit(month), F.lit(1))
    header = erp["ih_hist_all"].where(
        (F.col("ih_domain") == domain)
        & (F.col("xxih__chr01") == INVOICED)
        & (F.col("ih_ship_date") >= first)
        & (F.col("ih_ship_date") < F.add_months(first, 1))
    )
    lines = header.join(
        erp["idh_hist_all"].where(F.col("idh_site") == site),
        (F.col("ih_domain") == F.col("idh_domain")) & (F.col("ih_nbr") == F.col("idh_nbr")),
    ).join(
        erp["pt_mstr_all"],
        (F.col("idh_domain") == F.col("pt_domain")) & (F.col("idh_part") == F.col("pt_part")),
        "left",
    )
    keys = [
        "idh_site",
        F.year("ih_ship_date").alias("ShipYear"),
        F.month("ih_ship_date").alias("ShipMonthNbr"),
        "xxih__chr01",
        "ih_fr_terms",
    ]
    return lines.groupBy(*keys).agg((F.sum(F.col("idh_qty_ship") * F.col("xxpt__case_pk")) / 1000).alias("MUnits"))
