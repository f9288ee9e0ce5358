"""Run every query on both engines and compare: ``python -m tests.compare sf0.01 [name ...]``."""

from __future__ import annotations

import sys
import time
from math import isclose

import duckdb
from pyspark.sql import SparkSession

import __spark_entry__ as entry

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def session(cpus: str = "4") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def oracle(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _sortable(row: tuple) -> tuple:
    return tuple((v is not None, str(round(v, 3)) if isinstance(v, float) else str(v)) for v in row)


def _same(a, b, exact: bool) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b if exact else isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return type(a) is type(b) and a == b


def compare(spark: SparkSession, con: duckdb.DuckDBPyConnection, name: str, folder: str, exact: bool = True) -> str:
    """'' when both engines give the same columns and rows, else what differs."""
    df = entry.queries()[name](spark, folder)
    got = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return "" if got else "no rows"
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(cols)}"
    order = sorted(df.columns)
    mine = sorted([tuple(r[df.columns.index(c)] for c in order) for r in got], key=_sortable)
    theirs = sorted([tuple(r[cols.index(c)] for c in order) for r in want], key=_sortable)
    if len(mine) != len(theirs):
        return f"{len(mine)} rows != {len(theirs)}"
    for a, b in zip(mine, theirs):
        bad = [c for c, x, y in zip(order, a, b) if not _same(x, y, exact)]
        if bad:
            i = order.index(bad[0])
            return f"{bad}: {a[i]!r} != {b[i]!r} in {a} / {b}"
    return "" if mine else "no rows on either side"


def main() -> int:
    folder = f"{DATA}/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.01'}"
    names = sys.argv[2:] or list(entry.queries())
    spark, con, bad = session("8"), oracle(folder), 0
    spark.sparkContext.setLogLevel("ERROR")
    for name in names:
        start = time.time()
        try:
            fault = compare(spark, con, name, folder)
        except Exception as e:  # noqa: BLE001
            fault = f"{type(e).__name__}: {str(e)[:700]}"
        bad += bool(fault)
        print(f"{'FAIL' if fault else 'ok  '} {name} {time.time() - start:.1f}s {fault}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(main())
