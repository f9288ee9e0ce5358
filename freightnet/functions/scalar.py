"""Column expressions: all built-in, so they stay inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from freightnet.schemas import LANE, MONEY, VOLUME

# Freight in dollars per M per 1000 miles, as used in successive studies.
RATE = Decimal("6.15")
EARLIER_RATES = (Decimal("5.565"), Decimal("5.64"), Decimal("5.77"))

# Carrier codes by transport mode; the first list that holds a code wins (see plans/history.py).
CARRIERS = {
    "IM": "NLAT QPMT SCDS SNCK SNLU RBIN ANVI HUBG GRSF COYY BTIU HJBI HBGI",
    "LTL": """CNWY CTII CWCE CWWE DHRN FXFE HMES PITD RDWY RETL SAIA UPFG UPGF YFSW XPO
              YFSY FXNL EXLA SEFL PYLE LAXV TONI HJBA NPME""",
    "CPU": "CPU CUST",
    "OCEAN": "PAGE",
    "AIR": "FEAF UPS FEDX DBYA UPSA",
    "TL": """AMNO BIOS CFAA CRCR GATI HANY HJBT IWXP KMTN LDWY LRGR RBTW RISI RLOG
             SCNN SWFT TBIF USIT WMSN WSXI SNCY MKTN CLLQ WSGS TRCR GRTV SDAT
             HJBB WENP ANIQ HJBL AXLL CLNC CVYI LFRN HYBL ECHS EGBL
             ABXN DBOI AVGW XPON DETR DCLK KLFM CMMS CEQT PTWT TTMS HNRF BKLI EOSA
             CHXD XPOL LTCA CONV PLYD QRKQ ERWN SWIF FTMG CVYE VITI XPOX NAAF WOLH
             RCXV TTFO NWLS GULF PTWB HGTN DDOG TFFO GRLO DEBE CNVY JBHU PAPT""",
}


def place(city: str, state: str) -> Column:
    """'City, ST'; NULL when either part is missing."""
    return F.concat(F.col(city), F.lit(", "), F.col(state))


def lid_or_cup(part_type: str) -> Column:
    return F.when(F.left(F.col(part_type), F.lit(1)) == "L", "LID").otherwise("CUP")


def substituted(part_type: str, swaps: Mapping[str, str]) -> Column:
    """Literal replacements in the given order; a later swap sees what an earlier one made."""
    out = F.col(part_type)
    for old, new in swaps.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def terms(raw: str) -> Column:
    return F.when(F.upper(F.trim(F.col(raw))) == "PREPAID", "PPD").otherwise("CPU")


def year_month(date: str) -> Column:
    return (F.year(date) * 100 + F.month(date)).cast("int")


def year_start(as_of: str) -> Column:
    """First day of the year that holds the ISO date ``as_of``."""
    return F.trunc(F.to_date(F.lit(as_of)), "YEAR")


def number(text: str | Column) -> Column:
    """Number in a text cell, NULL when there is none."""
    cell = F.col(text) if isinstance(text, str) else text
    return F.trim(cell.cast("string")).try_cast("double")


def lane_rate(miles: str, rate: Decimal = RATE) -> Column:
    """Dollars per M over a lane of ``miles``, unrounded for any distance in millionths of a mile."""
    return (F.col(miles).cast("decimal(14,6)") * F.lit(Decimal(rate) / 1000).cast("decimal(12,8)")).cast(LANE)


def freight(munits: str, miles: str, frt_terms: str | None = None, rate: Decimal = RATE) -> Column:
    """Freight dollars of a flow; customer pick-up costs nothing when the terms column is given."""
    cost = (F.col(munits).cast(VOLUME) * lane_rate(miles, rate)).cast(MONEY)
    if frt_terms is None:
        return cost
    return F.when(F.col(frt_terms) == "CPU", F.lit(0).cast(MONEY)).otherwise(cost)


def flows(munits: str, tolerance: float = 1e-10) -> Column:
    """True for a flow that is not just solver noise."""
    return F.abs(F.col(munits)) > F.lit(tolerance)


def size_bin(value: str, step: float) -> Column:
    return F.floor(F.col(value) / F.lit(float(step))) * F.lit(float(step))


def thousands(value: str) -> Column:
    """Report text such as 12,345."""
    return F.format_number(F.col(value), 0)


def link_limit(supply: str, demand: str) -> Column:
    """The most one route can carry: the smaller of supply and demand."""
    return F.least(F.col(supply), F.col(demand))
