"""Readers, writers and small operators."""

import pytest
from pyspark.sql import functions as F

from freightnet import schemas
from freightnet.operators import quality as ql
from freightnet.operators import tables as op
from freightnet.sources import readers, writers


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_table_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame([("LOS, ANGELES", "CA", "90001", 34.0, -118.0), ("X", None, None, None, 1.0)], schemas.GEOCODES)
    path = str(tmp_path / fmt)
    writers.write_table(df, path, fmt)
    writers.write_table(df, path, fmt)
    assert sorted(readers.read_table(spark, path, schemas.GEOCODES, fmt).collect(), key=str) == sorted(df.collect(), key=str)


def test_tab_separated(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.write_tsv(spark.createDataFrame([("a b", 1.5)], "n STRING, v DOUBLE").coalesce(1), path)
    text = "".join(p.read_text() for p in (tmp_path / "t").glob("part-*"))
    assert text == "n\tv\na b\t1.5\n"


@pytest.mark.parametrize("spec", [v for k, v in vars(schemas).items() if k.isupper() and isinstance(v, str)])
def test_schemas_parse(spark, spec):
    assert len(spark.createDataFrame([], spec).columns) >= 2


def test_jdbc_read_is_split(monkeypatch):
    """No database is at hand: this checks the options that the reader is given."""
    seen = {}

    class Reader:
        def format(self, f):
            seen["format"] = f
            return self

        def option(self, k, v):
            seen[k] = v
            return self

        def options(self, **kw):
            seen.update(kw)
            return self

        def load(self):
            return seen

    class Session:
        read = Reader()

    got = readers.read_jdbc(Session(), "jdbc:x", "SELECT 1", "YearMonth", "202206", "202305", 12, {"user": "u"})
    assert got["dbtable"] == "(SELECT 1) q" and got["partitionColumn"] == "YearMonth" and got["numPartitions"] == 12 and got["user"] == "u"


def test_cost_column_goes_by_two_names(spark):
    a = spark.createDataFrame([("P", "S", 2.0)], "Plant STRING, ShipSite STRING, CostPerM DOUBLE")
    assert readers.coalesce_cost(a).first()["CostPerMUnit"] == 2.0


def test_missing_state_is_dropped_and_miscoded_place_too(spark):
    rows = [("A", "PA"), ("GNANGARA", "WA"), ("SEATTLE", "WA"), ("X", "HI"), ("Y", None), (None, "WA")]
    got = op.on_network(spark.createDataFrame(rows, "c STRING, s STRING"), "c", "s").collect()
    assert [tuple(r) for r in got] == [("A", "PA"), ("SEATTLE", "WA"), (None, "WA")]


def test_semi_join_never_multiplies(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k STRING, v INT")
    dim = spark.createDataFrame([("a",), ("a",)], "d STRING")
    assert [r["v"] for r in op.keep_known(df, dim, {"k": "d"}).collect()] == [1]
    assert sorted(r["v"] for r in op.keep_unknown(df, dim, {"k": "d"}).collect()) == [2, 3]


def test_first_per_key_is_by_order(spark):
    df = spark.createDataFrame([("k", 2, "x"), ("k", 1, "z"), ("k", 1, "y"), ("q", 5, "w")], "k STRING, o INT, v STRING")
    assert sorted(map(tuple, op.first_per_key(df, "k", "o").collect())) == [("k", 1, "y"), ("q", 5, "w")]


def test_transpose(spark):
    df = spark.createDataFrame([("r1", 1.0, 2.0), ("r2", 3.0, 4.0)], "h STRING, a DOUBLE, b DOUBLE")
    assert sorted(map(tuple, op.transpose(df, "h", ["r1", "r2"], "col").collect())) == [("a", 1.0, 3.0), ("b", 2.0, 4.0)]


def test_densify_fills_with_zero(spark):
    df = spark.createDataFrame([("c1", "x", 1.0), ("c1", "x", 2.0), ("c2", "y", 5.0)], "c STRING, p STRING, m DOUBLE")
    assert sorted(map(tuple, op.densify(df, ["c"], "p", ["x", "y"], "m").collect())) == [("c1", "x", 3.0), ("c1", "y", 0.0), ("c2", "x", 0.0), ("c2", "y", 5.0)]


def test_reconcile_and_empty_sides(spark):
    a = spark.createDataFrame([(1.5,), (2.5,)], "m DOUBLE")
    assert tuple(ql.reconcile(a, a.where("m > 2"), "m").first()) == (4.0, 2.5, 1.5, 0.375)
    assert tuple(ql.reconcile(a.where("m > 9"), a.where("m > 9"), "m").first()) == (0.0, 0.0, 0.0, None)


def test_profile(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 3.0)], "s STRING, v DOUBLE")
    assert [tuple(r) for r in op.profile(df).collect()] == [("s", 2, 1, "a", "a", None), ("v", 2, 0, "1.0", "3.0", 2.0)]


def test_lookup_faults(spark):
    need = spark.createDataFrame([("a",), ("b",), ("c",)], "k STRING")
    dim = spark.createDataFrame([("a",), ("b",), ("b",)], "d STRING")
    assert sorted(map(tuple, ql.lookup_faults(need, dim, {"k": "d"}).collect())) == [("b", 2), ("c", 0)]


def test_no_cross_join_in_lanes(spark):
    from freightnet.plans.cost import lanes

    cust = spark.createDataFrame([("m", "l", "PPD")], "MSTName STRING, Loc STRING, FTerms STRING")
    dist = spark.createDataFrame([("s1", "l", 1.0), ("s2", "l", 2.0), ("s1", "z", 3.0)], "Orig STRING, Dest STRING, Miles DOUBLE")
    out = lanes(cust, dist)
    assert sorted(r["ShipSite"] for r in out.collect()) == ["s1", "s2"]
    assert "CartesianProduct" not in out._jdf.queryExecution().toString()
    assert out.where(F.col("Loc") != "l").isEmpty()
