"""Views of the order tables (lineitem, orders, customer, ...) as shipping-network tables.

Every view is a lazy DataFrame over the Parquet tables; ``history`` joins only the tables that the wanted
columns need.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freightnet.operators.tables import total
from freightnet.scale import deal, most_tasks

TRUCKS = "'NLAT', 'CNWY', 'CPU', 'PAGE', 'UPS', 'SWFT', 'ZZZZ'"
#: Regions that may be sites, unless the caller allows more: their names become columns of lane tables.
MOST_SITES = 50

SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": """p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT,
               p_retailprice DOUBLE""",
    "orders": """o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE,
                 o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING""",
    "lineitem": """l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE,
                   l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING,
                   l_linestatus STRING, l_shipdate TIMESTAMP_NTZ""",
}

CUSTOMER_COLS = {"MSTName", "MSTCity", "MSTState"}
ORDER_COLS = CUSTOMER_COLS | {"MST", "FrtTermsFix", "OrderMonth", "o_orderdate"}
PART_COLS = {"PartType", "PrintGroup"}


HISTORY = {
    "ShipDate": "to_date(l_shipdate)",
    "ShipMonth": "year(l_shipdate) * 100 + month(l_shipdate)",
    "OrderMonth": "date_format(o_orderdate, 'yyyyMM')",
    "ShipSiteName": "home_site",
    "MST": "CAST(o_custkey AS STRING)",
    "MSTName": "c_name",
    "FrtTermsFix": "CASE WHEN left(o_orderpriority, 1) IN ('1', '2', '3') THEN 'PPD' ELSE 'CPU' END",
    "MasterBOL": "l_orderkey div 4",
    "Truck": f"element_at(array({TRUCKS}), CAST((l_orderkey + l_linenumber) % 7 + 1 AS INT))",
    "PartType": "p_type",
    "PrintGroup": "p_brand",
    "MUnits": "l_quantity",
}


def cached(view: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    """Build the plan of a view once per query."""

    @wraps(view)
    def once(self: Tables) -> DataFrame:
        key = f"__{view.__name__}"
        if key not in self.__dict__:
            self.__dict__[key] = view(self)
        return self.__dict__[key]

    return once


class Tables:
    def __init__(self, spark: SparkSession, folder: str, most_sites: int = MOST_SITES):
        self.spark = spark
        self.folder = folder
        self.most_sites = most_sites

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        # Kept on the object, so that each table is listed once per query.
        self.__dict__[name] = self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")
        return self.__dict__[name]

    @property
    def site_list(self) -> list[tuple[int, str]]:
        """Key and name of every site in order of the key, read from the regions once per query."""
        if "_sites" not in self.__dict__:
            rows = self.region.orderBy("r_regionkey").limit(self.most_sites + 1).collect()
            if len(rows) > self.most_sites:
                raise ValueError(f"more than {self.most_sites} sites")
            self.__dict__["_sites"] = [(r["r_regionkey"], r["r_name"]) for r in rows]
        return self.__dict__["_sites"]

    @property
    def tasks(self) -> int | None:
        """Number of tasks for steps over the lines, by their number: counted once per query, from the footers. None while
        they are so few that Spark's own choice will do."""
        if "_tasks" not in self.__dict__:
            need = most_tasks(self.spark, self.lineitem.count())
            self.__dict__["_tasks"] = need if need > self.spark.sparkContext.defaultParallelism else None
        return self.__dict__["_tasks"]

    @property
    def site_names(self) -> list[str]:
        return [name for _, name in self.site_list]

    def site_name(self, key: str) -> str:
        """Name of a site by key. The sites are a short list, so no join is needed."""
        cases = " ".join(f"WHEN {k} THEN '{name}'" for k, name in self.site_list)
        return f"CASE {key} {cases} END"

    def _to_sites(self, df: DataFrame) -> DataFrame:
        """Each row once per site, without a cross join."""
        keys = ", ".join(str(k) for k, _ in self.site_list)
        spread = df.selectExpr("*", f"explode(array({keys})) AS site_key")
        return spread.selectExpr("*", f"{self.site_name('site_key')} AS site")

    @cached
    def places(self) -> DataFrame:
        """(nation, MSTCity, MSTState, home_site) of every nation."""
        home = self.site_name("n_regionkey")
        return self.nation.selectExpr(
            "n_nationkey AS nation", "n_name AS MSTCity", f"left({home}, 2) AS MSTState", f"{home} AS home_site"
        )

    def history(self, *cols: str) -> DataFrame:
        """Shipment rows with the wanted columns."""
        return self._described(self.lineitem, cols)

    def volume(self, *cols: str) -> DataFrame:
        """Shipped MUnits for columns that hang on part, plant or ship site only.

        The lines are added up by part and supplier key before those tables are joined, so that the joins
        see a row per key instead of a row per line.
        """
        need = set(cols)
        keys = ["l_partkey"] if need & (PART_COLS | {"MfgSiteName", "l_partkey"}) else []
        keys += ["l_suppkey"] if "ShipSiteName" in need else []
        sums = total(self.lineitem, keys, "l_quantity")
        return self._described(sums, (*cols, "MUnits"))

    def _described(self, df: DataFrame, cols: tuple[str, ...]) -> DataFrame:
        need = set(cols)
        # What hangs on part and supplier meets the lines while these are narrow; the wide order data comes last.
        if need & PART_COLS:
            df = df.join(self.part, F.expr("l_partkey = p_partkey"))
        if "ShipSiteName" in need:
            # One join after the other, so that each table is judged by its own size.
            homes = self.places().selectExpr("nation AS home", "home_site")
            df = df.join(self.supplier, F.expr("l_suppkey = s_suppkey")).join(homes, F.expr("s_nationkey = home"))
        if need & ORDER_COLS:
            # Customers meet the orders, not the lines: the lines are shuffled by order key only.
            header = self.orders
            if need & CUSTOMER_COLS:
                header = header.join(self.customer, F.expr("o_custkey = c_custkey"))
                header = header.join(self.places(), F.expr("c_nationkey = nation")).drop("home_site")
            # Wide rows are sorted and added up there: a task takes no more of them as the tables grow.
            ordered = deal(header, self.tasks, "o_orderkey")
            df = deal(df, self.tasks, "l_orderkey").join(ordered, F.expr("l_orderkey = o_orderkey"))
        plant = f"CASE WHEN l_partkey % 97 != 0 THEN {self.site_name('l_partkey % 5')} END" if "MfgSiteName" in need else ""
        terms = {**HISTORY, "MfgSiteName": plant}
        return df.selectExpr(*[f"{terms.get(c, c)} AS {c}" for c in cols])

    @cached
    def distances(self) -> DataFrame:
        """(Orig, Dest, Miles) from every site to every place but one."""
        return self._to_sites(self.places().where("nation != 24")).selectExpr(
            "site AS Orig",
            "concat(MSTCity, ', ', MSTState) AS Dest",
            "CAST(100 + 37 * ((site_key * 25 + nation) % 29) AS DOUBLE) AS Miles",
        )

    def raw_distances(self) -> DataFrame:
        """Distance sheet with one destination per customer, off-network ones and gaps included."""
        # Dealt by the rows that come of them: the file of the customers may be a single row group, so a single task.
        dealt = self.customer.repartition(most_tasks(self.spark, self.customer.count() * len(self.site_list)), "c_custkey")
        rows = self._to_sites(dealt.join(self.places(), F.expr("c_nationkey = nation"))).selectExpr(
            "site AS `or.City`",
            "left(site, 2) AS `or.State`",
            "CASE WHEN c_custkey % 62 = 0 THEN 'GNANGARA' ELSE c_name END AS `de.City`",
            """CASE WHEN c_custkey % 31 = 0 THEN 'WA' WHEN nation = 3 THEN 'EX' WHEN nation = 7 THEN 'PR'
               WHEN nation = 11 THEN 'HI' WHEN nation = 15 THEN 'XX' ELSE MSTState END AS `de.State`""",
            """CASE WHEN (c_custkey + site_key) % 45 != 0
               THEN CAST(50 + (c_custkey * 13 + site_key * 211) % 2900 AS DOUBLE) END AS Miles""",
        )
        return rows.selectExpr(
            "`or.City`", "`or.State`", "`de.City`", "`de.State`", "Miles * 1.5D AS `Distance.Distance`", "Miles"
        )

    def geocodes(self) -> DataFrame:
        """One geocode per customer: several per destination."""
        return self.customer.join(self.places(), F.expr("c_nationkey = nation")).selectExpr(
            "MSTCity",
            "MSTState",
            "CASE WHEN c_custkey % 17 != 0 THEN lpad(CAST(c_custkey % 50 AS STRING), 5, '0') END AS MSTZip",
            "25 + nation + (c_custkey % 4) * 0.25D AS lat",
            "-120 + 2 * nation + (c_custkey % 4) * 0.25D AS lon",
        )

    def facilities(self) -> DataFrame:
        return self.region.selectExpr(
            "r_name AS Name",
            "CAST(30 + 2 * r_regionkey AS DOUBLE) AS Latitude",
            "CAST(-110 + 5 * r_regionkey AS DOUBLE) AS Longitude",
        )

    @cached
    def inter_site_rates(self) -> DataFrame:
        """(Plant, ShipSite, CostPerMUnit, CostPerM): the sheet uses either cost name."""
        return self._to_sites(self.region.selectExpr("r_regionkey AS pk", "r_name AS Plant")).selectExpr(
            "Plant",
            "site AS ShipSite",
            "CASE WHEN (pk + site_key) % 2 = 0 THEN abs(pk - site_key) * 1.25D END AS CostPerMUnit",
            "CASE WHEN (pk + site_key) % 2 != 0 THEN abs(pk - site_key) * 1.25D END AS CostPerM",
        )

    def masters(self, key_length: int) -> DataFrame:
        """Ship-to master by key; some customers of the demand sheet are not in it."""
        rows = self.customer.where("c_custkey % 13 != 5").join(self.places(), F.expr("c_nationkey = nation"))
        return rows.selectExpr(
            f"'9803' || lpad(CAST(c_custkey AS STRING), {key_length - 4}, '0') AS MST",
            "'Master ' || (c_custkey - c_custkey % 3) AS MSTName",
            "MSTCity",
            "MSTState",
        )

    def sites(self) -> DataFrame:
        """Site codes and names; the last code has no name."""
        return self.region.where("r_regionkey != 4").selectExpr("left(r_name, 2) AS SiteCode", "r_name AS SiteName")

    def forecast_sheet(self) -> DataFrame:
        """Two forecast sets: 2001 orders, and half the volume of 2000 orders."""
        rows = self.history("l_partkey", "MfgSiteName", "PrintGroup", "PartType", "OrderMonth", "o_orderdate", "MUnits")
        recent = "o_orderdate >= TIMESTAMP_NTZ'2000-01-01' AND o_orderdate < TIMESTAMP_NTZ'2002-01-01'"
        return rows.where(f"{recent} AND MfgSiteName IS NOT NULL").selectExpr(
            "left(OrderMonth, 4) || '12' AS ForecastSet",
            "OrderMonth AS YearMonth",
            "left(MfgSiteName, 2) AS MfgSite",
            # Some parts are forecast under a print group that was never shipped.
            "CASE WHEN l_partkey % 41 = 0 THEN 'New ' || PrintGroup ELSE PrintGroup END AS PrintGroup",
            "PartType",
            "CASE WHEN left(OrderMonth, 4) = '2001' THEN MUnits ELSE MUnits / 2 END AS OLMUnits",
        )

    def roots(self) -> DataFrame:
        """Root part types, with more than one row per part type."""
        return self.part.selectExpr(
            "p_type AS `Part Type`",
            "left(p_type, 1) || CASE WHEN p_size > 25 THEN '-B' ELSE '-A' END AS `Root Part Type`",
        )

    def capacity_sheet(self) -> DataFrame:
        """1.2 x history by plant, print group and part; a few empty and zero rows."""
        rows = self.volume("l_partkey", "MfgSiteName", "PrintGroup", "PartType")
        sums = rows.groupBy("MfgSiteName", "PrintGroup", "PartType").agg(
            F.expr("CASE WHEN max(l_partkey) % 13 != 0 THEN sum(MUnits) * 6 / 5 ELSE 0D END").alias("OLMUnits")
        )
        return sums.selectExpr("*", "left(MfgSiteName, 2) AS MfgSite")

    def erp(self) -> dict[str, DataFrame]:
        """The eight tables of the order system."""
        header = self.orders.selectExpr(
            "CASE WHEN o_orderkey % 50 = 7 THEN '038' ELSE '037' END AS ih_domain",
            "o_orderkey AS ih_nbr",
            "CAST(o_custkey AS STRING) AS ih_ship",
            "'S' || (o_custkey % 5) AS ih_site",
            "to_date(o_orderdate) AS ih_ship_date",
            "o_orderpriority AS ih_shipvia",
            """CASE left(o_orderpriority, 1) WHEN '1' THEN 'Prepaid' WHEN '2' THEN 'PREPAID'
               WHEN '3' THEN 'prepaid' ELSE 'Collect' END AS ih_fr_terms""",
            "lpad(CAST(o_orderkey div 4 AS STRING), 9, '0') || '-' || (o_orderkey % 4) AS ih_bol",
            "CASE WHEN o_orderstatus = 'O' THEN 'Y' ELSE 'N' END AS xxih__custpu",
            "'L' || (o_orderkey % 100) AS xxih__load",
            f"element_at(array('cpu', {TRUCKS}), CAST(o_orderkey % 8 + 1 AS INT)) AS xxih__truck",
            "CASE WHEN o_orderkey % 3 != 0 THEN CAST(o_orderkey % 500 AS DECIMAL(18,6)) END AS xxih__base_chrg",
            "CASE WHEN o_orderkey % 11 = 0 THEN 'MEM' ELSE 'INV' END AS xxih__chr01",
        )
        line = self.lineitem.selectExpr(
            "CASE WHEN l_orderkey % 50 = 7 THEN '038' ELSE '037' END AS idh_domain",
            "l_orderkey AS idh_nbr",
            "l_partkey AS idh_part",
            "CASE WHEN l_suppkey % 20 = 3 THEN '531' ELSE 'S' || (l_suppkey % 5) END AS idh_site",
            "CASE WHEN l_linenumber != 7 THEN l_quantity END AS idh_qty_ship",
        )
        parts = self.part.selectExpr(
            "'037' AS pt_domain",
            "p_partkey AS pt_part",
            "p_type AS pt_part_type",
            "p_brand AS pt_group",
            "CAST(p_size AS DOUBLE) AS pt_size",
            "50D * (1 + p_partkey % 20) AS xxpt__case_pk",
        )
        address = self.customer.selectExpr("CAST(c_custkey AS STRING) AS ad_addr", "'037' AS ad_domain")
        names = self.customer.selectExpr(
            "CAST(c_custkey AS STRING) AS cm_addr",
            "'037' AS cm_domain",
            """CASE WHEN c_custkey % 53 = 0 THEN 'Samples ' || c_name
               WHEN c_custkey % 101 != 0 THEN c_name END AS cm_name""",
        )
        pallets = self.part.selectExpr(
            "p_partkey AS Part", "'S' || (p_partkey % 5) AS Site", "CAST(p_partkey % 41 AS DOUBLE) AS CasepPallet"
        )

        def dollars(name: str, divisor: int, missing: int) -> str:
            amount = f"CAST(o_orderkey % {divisor} AS DECIMAL(18,6))"
            return f"CASE WHEN o_orderkey % {missing} != 0 THEN {amount} END AS {name}"

        charges = self.orders.where("o_orderkey % 3 = 0").selectExpr(
            "'S' || (o_custkey % 5) AS ShipSite",
            "o_orderkey AS SalesOrderNo",
            "to_date(o_orderdate) AS ShipDate",
            "CAST(o_orderkey % 900 AS DOUBLE) AS Miles",
            dollars("Freight", 1000, 7),
            dollars("EstimatedFreight", 700, 5),
            dollars("InvFrt", 800, 2),
            dollars("ActualFreight", 600, 13),
            "CAST(o_orderkey % 2 AS INT) AS PaidFlag",
        )
        named = self.customer.where("c_custkey % 37 != 0").join(self.places(), F.expr("c_nationkey = nation"))
        ship_to = named.selectExpr(
            "CAST(c_custkey AS STRING) AS ST",
            "CAST(c_custkey - c_custkey % 3 AS STRING) AS MST",
            "'Master ' || (c_custkey - c_custkey % 3) AS MSTName",
            "MSTCity",
            "MSTState",
            "lpad(CAST(c_custkey % 50 AS STRING), 5, '0') AS MSTZip",
            "'US' AS MSTCountry",
            "CASE WHEN c_custkey % 2 = 0 THEN 'DC' ELSE 'STORE' END AS MSTSetup",
        )
        return {
            "ih_hist_all": header,
            "idh_hist_all": line,
            "pt_mstr_all": parts,
            "ad_mstr_all": address,
            "cm_mstr_all": names,
            "Pallets": pallets,
            "Freight": charges,
            "MasterShipTo": ship_to,
        }
