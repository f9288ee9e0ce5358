"""Two-level ranks and totals, interval overlaps and cuts: same result as the plain form, also when one group is hot."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from freightnet import scale
from freightnet.operators import tables as op
from freightnet.plans.waterfall import overlaps, waterfall_plan


@pytest.fixture
def hot(spark):
    """6000 rows; a third of them in one group."""
    group = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 50).cast("string")))
    return spark.range(6000).select(
        group.alias("g"),
        F.format_string("k%05d", (F.col("id") * 7919) % 6007).alias("k"),
        ((F.col("id") * 31) % 97).cast("decimal(24,6)").alias("v"),
    )


def test_running_total_equals_plain_window(spark, hot):
    got = scale.running_total(scale.slice_rows(hot, ["g"], ["k"]), ["g"], ["k"], "v", "a", "b").select("g", "k", F.col("a").cast("double"), F.col("b").cast("double"))
    w = Window.partitionBy("g").orderBy("k")
    b = F.sum("v").over(w)
    want = hot.select("g", "k", (b - F.col("v")).cast("double").alias("a"), b.cast("double").alias("b"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_hot_group_is_spread_over_slices(spark, hot):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sliced = scale.slice_rows(hot, ["g"], ["k"])
        largest = sliced.where("g = 'hot'").groupBy("__slice").count().agg(F.max("count")).first()[0]
        assert largest < 1500
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_rank_and_count_with_nulls(spark):
    rows = [("x", None), ("x", "b"), ("x", "b"), ("x", "a"), ("y", "q"), (None, "z"), (None, "z"), ("n", None)]
    got = scale.rank_and_count(spark.createDataFrame(rows, "g STRING, v STRING"), ["g"], "v", "r", "n").collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [("x", None, 1, 3), ("x", "a", 2, 3), ("x", "b", 3, 3), ("y", "q", 1, 1), (None, "z", 1, 1), ("n", None, 1, 1)], key=str
    )


def test_rank_and_count_equals_dense_rank(spark, hot):
    got = scale.rank_and_count(hot, ["g"], "k", "r", "n")
    up, down = Window.partitionBy("g").orderBy("k"), Window.partitionBy("g").orderBy(F.desc("k"))
    want = hot.select("g", "k", F.dense_rank().over(up).alias("r"), (F.dense_rank().over(up) + F.dense_rank().over(down) - 1).alias("n")).distinct()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("rows_per_slice", [1, 7, 10_000])
def test_overlaps_equal_brute_force(spark, rows_per_slice):
    demand, supply, at = [], [], 0.0
    for i in range(60):
        size = (i * 37) % 23 + 0.5
        demand.append(("P", f"c{i:02d}", at, at + size))
        at += size
    edge = 0.0
    for j, size in enumerate([at / 3, 11.25, at / 2, at]):
        supply.append(("P", f"m{j}", edge, edge + size))
        edge += size
    types = "RPType STRING, {} STRING, {} DECIMAL(24,6), {} DECIMAL(24,6)"
    from decimal import Decimal

    def exact(rows):
        return [(p, n, Decimal(f"{a:.6f}"), Decimal(f"{b:.6f}")) for p, n, a, b in rows]

    demand, supply = exact(demand), exact(supply)
    wanted = spark.createDataFrame(demand, types.format("cust", "d0", "d1"))
    number = F.floor(F.substring("cust", 2, 9).cast("int") / rows_per_slice)
    got = overlaps(wanted.withColumn("__slice", number), spark.createDataFrame(supply, types.format("MfgSite", "s0", "s1")))
    want = [
        (c, m, min(d1, s1) - max(d0, s0)) for _, c, d0, d1 in demand for _, m, s0, s1 in supply if max(d0, s0) < min(d1, s1)
    ]
    assert sorted(tuple(r) for r in got.select("cust", "MfgSite", "MUnits").collect()) == sorted(want)


def test_a_giant_customer_leaves_slices_even(spark):
    """One customer with nearly all volume: the rows still meet in slices of near-equal rows."""
    rows = [(f"c{k:05d}", "X, YZ", "PPD", "P", 1e9 if k == 77 else 1.0) for k in range(4000)]
    demand = spark.createDataFrame(rows, "MSTName string, Loc string, FTerms string, RPType string, MUnits double")
    supply = spark.createDataFrame([("A", "P", 5e8), ("B", "P", 6e8)], "MfgSite string, RPType string, Capacity double")
    routes = spark.createDataFrame(
        [("A", "S", "X, YZ", 1.0), ("B", "S", "X, YZ", 2.0)], "MfgSite string, ShipSite string, Dest string, UnitCost double"
    ).withColumn("UnitCost", F.col("UnitCost").cast("decimal(18,8)"))
    plan = waterfall_plan(demand, supply, routes, slices=8)
    assert plan.agg(F.sum("MUnits")).first()[0] == 1e9 + 3999 and plan.count() == 4001
    sizes = scale.slice_rows(demand, ["RPType"], ["MSTName"], slices=8).groupBy("__slice").count().collect()
    assert max(r["count"] for r in sizes) < 4 * 4000 / 8


def test_cut_writes_to_the_shared_folder(spark):
    folder = scale.scratch_dir(spark)
    df = scale.cut(spark.range(10).withColumn("x", F.col("id") * 2))
    assert df.count() == 10 and all(folder in f for f in df.inputFiles())


def test_a_cluster_must_name_the_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        applicationId, master = "app-1", "spark://head:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        scale.scratch_dir(Session())
    Context.master = "local[4]"
    assert scale.scratch_dir(Session()) == scale.scratch_dir(Session())


def test_share_adds_up_to_one_for_a_hot_group(spark, hot):
    rows = op.share(hot.withColumn("v", F.col("v").cast("double")), ["g"], "v")
    for total in rows.groupBy("g").agg(F.sum("Pct").alias("s")).collect():
        assert total["s"] == pytest.approx(1.0)


def test_share_of_an_empty_total_is_null(spark):
    rows = op.share(spark.createDataFrame([("a", 0.0)], "g STRING, v DOUBLE"), ["g"], "v").collect()
    assert rows[0]["Pct"] is None


def test_no_task_holds_a_hot_group_in_share(spark, hot):
    plan = op.share(hot.withColumn("v", F.col("v").cast("double")), ["g"], "v")._jdf.queryExecution().toString()
    assert "Window" not in plan
