"""Column types shared by the whole package, and the fixed schemas of the business tables."""

from pyspark.sql import types as T

# Exact types: totals do not depend on the order in which tasks add up.
VOLUME = T.DecimalType(24, 6)
MONEY = T.DecimalType(28, 6)
# Dollars per M of a lane: rounded to MONEY only once it is multiplied by a volume.
LANE = T.DecimalType(18, 10)

# DDL text, which readers take as it is.

SHIP_HISTORY = (
    """ShipMonth INT, ShipDate DATE, ShipSite STRING, MST STRING, MSTSetup STRING, MSTName STRING,
       MSTCity STRING, MSTState STRING, MSTZip STRING, MSTCountry STRING, shipVia STRING, FrtTerms STRING,
       FrtTermsFix STRING, MasterBOL STRING, CustPUFlag STRING, StopNbrFix INT, BOLMasterShipToCount INT,
       `Load` STRING, Truck STRING, ModeFix STRING, PartType STRING, PrintGroup STRING, Cases DOUBLE,
       MUnits DOUBLE, `Cube` DOUBLE, Pallets DOUBLE, xxih__base_chrg DECIMAL(18,6), Miles DOUBLE,
       Freight DECIMAL(18,6), EstimatedFreight DECIMAL(18,6), InvFrt DECIMAL(18,6),
       ActualFreight DECIMAL(18,6), PaidFlag INT, ShipSiteName STRING, MfgSiteName STRING"""
)
DISTANCES = (
    "`or.City` STRING, `or.State` STRING, `de.City` STRING, `de.State` STRING, `Distance.Distance` DOUBLE, Miles DOUBLE"
)
GEOCODES = "MSTCity STRING, MSTState STRING, MSTZip STRING, lat DOUBLE, lon DOUBLE"
FACILITIES = "Name STRING, Latitude DOUBLE, Longitude DOUBLE"
INTER_SITE_LANES = "Plant STRING, ShipSite STRING, CostPerMUnit DOUBLE, CostPerM DOUBLE"
FORECAST = (
    "ForecastSet STRING, YearMonth STRING, MfgSite STRING, PrintGroup STRING, PartType STRING, OLMUnits DOUBLE"
)
SITES = "SiteCode STRING, SiteName STRING"
CAPACITY = (
    "MfgSite STRING, MfgSiteName STRING, PrintGroup STRING, PartType STRING, OLMUnits DOUBLE, Capacity DOUBLE"
)
ROOT_PART_TYPES = "`Part Type` STRING, `Root Part Type` STRING"
SUPPLY_SHEET = "MfgSiteName STRING, PartType STRING, PrintGroup STRING, MMUnits DOUBLE"
OUTBOUND_PLAN = (
    "ShipSite STRING, Cust STRING, Dest STRING, FTerms STRING, PType STRING, MUnits DOUBLE, Freight DOUBLE"
)
INTER_SITE_PLAN = "MfgSite STRING, ShipSite STRING, PType STRING, MUnits DOUBLE, Freight DOUBLE"
