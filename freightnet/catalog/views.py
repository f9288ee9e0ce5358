"""The adapter views once more, as SQL; ``with_views`` puts the ones a query names in front of it."""

from __future__ import annotations

import re

VIEWS = {
    "places": """
        SELECT n_nationkey AS nation, n_name AS MSTCity, substr(r_name, 1, 2) AS MSTState, r_name AS home_site
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "hist": """
        SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_shipdate AS DATE) AS ShipDate,
               CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INTEGER) AS ShipMonth,
               strftime(o_orderdate, '%Y%m') AS OrderMonth,
               sp.home_site AS ShipSiteName,
               CASE WHEN l_partkey % 97 <> 0 THEN mk.r_name END AS MfgSiteName,
               CAST(c_custkey AS VARCHAR) AS MST, c_name AS MSTName, cp.MSTCity, cp.MSTState,
               cp.MSTCity || ', ' || cp.MSTState AS Loc,
               CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2', '3') THEN 'PPD' ELSE 'CPU' END AS FrtTermsFix,
               l_orderkey // 4 AS MasterBOL,
               ['NLAT', 'CNWY', 'CPU', 'PAGE', 'UPS', 'SWFT', 'ZZZZ'][CAST((l_orderkey + l_linenumber) % 7 AS INTEGER) + 1] AS Truck,
               p_type AS PartType, p_brand AS PrintGroup,
               CASE WHEN substr(p_type, 1, 1) = 'L' THEN 'LID' ELSE 'CUP' END AS PTypeFix,
               l_quantity AS MUnits
        FROM lineitem
        JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey
        JOIN places cp ON c_nationkey = cp.nation
        JOIN supplier ON l_suppkey = s_suppkey
        JOIN places sp ON s_nationkey = sp.nation
        JOIN part ON l_partkey = p_partkey
        JOIN region mk ON mk.r_regionkey = l_partkey % 5""",
    "clean": "SELECT * FROM hist WHERE MfgSiteName IS NOT NULL",
    "dist": """
        SELECT r.r_name AS Orig, MSTCity || ', ' || MSTState AS Dest,
               CAST(100 + 37 * ((r.r_regionkey * 25 + nation) % 29) AS DOUBLE) AS Miles
        FROM region r CROSS JOIN places WHERE nation <> 24""",
    "raw_dist": """
        SELECT r.r_name AS or_city, substr(r.r_name, 1, 2) AS or_state,
               CASE WHEN c_custkey % 62 = 0 THEN 'GNANGARA' ELSE c_name END AS de_city,
               CASE WHEN c_custkey % 31 = 0 THEN 'WA' WHEN nation = 3 THEN 'EX' WHEN nation = 7 THEN 'PR'
                    WHEN nation = 11 THEN 'HI' WHEN nation = 15 THEN 'XX' ELSE MSTState END AS de_state,
               CASE WHEN (c_custkey + r.r_regionkey) % 45 <> 0
                    THEN CAST(50 + (c_custkey * 13 + r.r_regionkey * 211) % 2900 AS DOUBLE) END AS Miles
        FROM customer JOIN places ON c_nationkey = nation CROSS JOIN region r""",
    "clean_dist": """
        SELECT or_city AS Orig, de_city || ', ' || de_state AS Dest, Miles FROM raw_dist
        WHERE de_state NOT IN ('EX', 'PR', 'HI', 'XX') AND NOT (de_city = 'GNANGARA' AND de_state = 'WA')""",
    "geo": """
        SELECT MSTCity, MSTState, MSTCity || ', ' || MSTState AS Dest,
               CASE WHEN c_custkey % 17 <> 0 THEN lpad(CAST(c_custkey % 50 AS VARCHAR), 5, '0') END AS MSTZip,
               25 + nation + CAST(c_custkey % 4 AS DOUBLE) * CAST(0.25 AS DOUBLE) AS lat,
               -120 + 2 * nation + CAST(c_custkey % 4 AS DOUBLE) * CAST(0.25 AS DOUBLE) AS lon
        FROM customer JOIN places ON c_nationkey = nation""",
    "cent": "SELECT Dest, avg(lat) AS lat, avg(lon) AS lon FROM geo GROUP BY Dest",
    "fac": """
        SELECT r_name AS Name, CAST(30 + 2 * r_regionkey AS DOUBLE) AS Latitude,
               CAST(-110 + 5 * r_regionkey AS DOUBLE) AS Longitude FROM region""",
    "rates": """
        SELECT p.r_name AS Plant, s.r_name AS ShipSite,
               CAST(abs(p.r_regionkey - s.r_regionkey) * 1.25 AS DOUBLE) AS CostPerMUnit
        FROM region p CROSS JOIN region s""",
    "fsheet": """
        SELECT substr(OrderMonth, 1, 4) || '12' AS ForecastSet, OrderMonth AS YearMonth,
               substr(MfgSiteName, 1, 2) AS MfgSite,
               CASE WHEN l_partkey % 41 = 0 THEN 'New ' || PrintGroup ELSE PrintGroup END AS PrintGroup, PartType,
               CASE WHEN substr(OrderMonth, 1, 4) = '2001' THEN MUnits ELSE MUnits / 2 END AS OLMUnits
        FROM clean WHERE substr(OrderMonth, 1, 4) IN ('2000', '2001')""",
    "fcst": """
        SELECT ForecastSet, MfgSite, r_name AS MfgSiteName, PrintGroup, PartType, sum(OLMUnits) AS OLMUnits
        FROM fsheet LEFT JOIN (SELECT * FROM region WHERE r_regionkey <> 4) ON substr(r_name, 1, 2) = MfgSite
        WHERE ForecastSet = '200112' AND YearMonth BETWEEN '200102' AND '200107'
        GROUP BY ALL""",
    "root_key": """
        SELECT p_type AS PartType, min(substr(p_type, 1, 1) || CASE WHEN p_size > 25 THEN '-B' ELSE '-A' END) AS RootPartType
        FROM part GROUP BY p_type""",
    "rooted": """
        SELECT clean.*, CASE WHEN PTypeFix = 'LID' THEN PartType ELSE RootPartType END AS RPType
        FROM clean JOIN root_key USING (PartType)""",
    "demand": """
        SELECT MSTName, Loc, FrtTermsFix AS FTerms, RPType, sum(MUnits) AS MUnits FROM rooted
        WHERE Loc IN (SELECT Dest FROM dist) GROUP BY ALL""",
    "supply": """
        SELECT MfgSiteName AS MfgSite, RPType, sum(MUnits) * 6 / 5 AS Capacity FROM rooted
        WHERE NOT (MfgSiteName = 'ASIA' AND RPType = 'LARGE') AND NOT (MfgSiteName = 'EUROPE' AND RPType = 'S-A')
        GROUP BY ALL""",
    "scarce": """
        SELECT MfgSite, RPType, CASE WHEN MfgSite = 'ASIA' THEN Capacity / 4 ELSE Capacity END AS Capacity FROM supply""",
    "caps": "SELECT ShipSiteName AS ShipSite, sum(MUnits) * 6 / 5 AS Cap FROM clean GROUP BY ALL",
    "inbound_all": """
        SELECT ShipSite, RPType, MfgSite, CAST(CostPerMUnit AS DECIMAL(18, 8)) AS Inbound
        FROM supply JOIN rates ON Plant = MfgSite WHERE Capacity > 0""",
    "inbound": """
        SELECT ShipSite, RPType, MfgSite, Inbound FROM inbound_all
        QUALIFY row_number() OVER (PARTITION BY ShipSite, RPType ORDER BY Inbound, MfgSite) = 1""",
    "units": """
        SELECT Dest, RPType, ShipSite, CAST(Miles * 0.00615 AS DECIMAL(18, 8)) + Inbound AS Unit
        FROM dist JOIN inbound ON Orig = ShipSite""",
    "cust_site": """
        SELECT MSTName, Loc, FTerms, ShipSite, sum(CAST(MUnits AS DECIMAL(18, 0)) * Unit) AS Cost
        FROM demand JOIN units ON Loc = Dest AND demand.RPType = units.RPType GROUP BY ALL""",
    "assigned": """
        SELECT * FROM cust_site
        QUALIFY row_number() OVER (PARTITION BY MSTName, Loc, FTerms ORDER BY Cost, ShipSite) = 1""",
    "outbound": """
        SELECT ShipSite, demand.* FROM demand JOIN assigned USING (MSTName, Loc, FTerms)""",
    "moved": """
        SELECT MfgSite, ShipSite, RPType, sum(MUnits) AS MUnits
        FROM outbound JOIN inbound USING (ShipSite, RPType) GROUP BY ALL""",
    "best_route": """
        SELECT Plant AS MfgSite, Dest, dist.Orig AS ShipSite,
               CAST(Miles * 0.00615 AS DECIMAL(18, 8)) + CAST(CostPerMUnit AS DECIMAL(18, 8)) AS UnitCost
        FROM dist JOIN rates ON Orig = ShipSite
        QUALIFY row_number() OVER (PARTITION BY Plant, Dest ORDER BY UnitCost, Orig) = 1""",
    "d_int": """
        SELECT *, sum(CAST(MUnits AS DECIMAL(18, 6))) OVER (PARTITION BY RPType ORDER BY MSTName, Loc, FTerms) AS d1
        FROM demand""",
    "s_int": """
        SELECT *, sum(CAST(Capacity AS DECIMAL(18, 6))) OVER (PARTITION BY RPType ORDER BY MfgSite) AS s1
        FROM scarce""",
    "waterfall": """
        SELECT s.MfgSite, ShipSite, MSTName, Loc, FTerms, d.RPType,
               least(d1, s1) - greatest(d1 - CAST(MUnits AS DECIMAL(18, 6)), s1 - CAST(Capacity AS DECIMAL(18, 6))) AS Flow,
               UnitCost
        FROM d_int d JOIN s_int s ON d.RPType = s.RPType
             AND d1 - CAST(MUnits AS DECIMAL(18, 6)) < s1 AND s1 - CAST(Capacity AS DECIMAL(18, 6)) < d1
        JOIN best_route b ON b.MfgSite = s.MfgSite AND b.Dest = Loc""",
}


def with_views(select: str) -> str:
    """``select`` with every view it names, and the views those name, as leading common tables."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in order and re.search(rf"\b{name}\b", text):
                visit_body(name, body)

    def visit_body(name: str, body: str) -> None:
        for other, inner in VIEWS.items():
            if other != name and other not in order and re.search(rf"\b{other}\b", body):
                visit_body(other, inner)
        if name not in order:
            order.append(name)

    visit(select)
    if not order:
        return select
    heads = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order)
    joiner = ", " if select.lstrip().upper().startswith("WITH ") else " "
    rest = select.lstrip()[5:] if joiner == ", " else select
    return f"WITH {heads}{joiner}{rest}"
