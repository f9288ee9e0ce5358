"""Helpers that keep jobs whole on very large or very uneven data.

A plain window over a group puts the whole group into one task. When one master bill, product or
site can hold a third of all rows that task never ends, so ranks and running totals here work in two
levels: range slices of near-equal size, then one short pass over the slice totals.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: By application: the folder of a local session without a shared one, and that of the scope in use.
_LOCAL_FOLDERS: dict[str, str] = {}
_SCOPES: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """Folder of this application for intermediate tables, in the shared folder of spark.checkpoint.dir.

    Nothing in it is needed once the application has ended. Only a local session without that setting
    falls back to a folder of its own.
    """
    app = spark.sparkContext.applicationId
    if app in _SCOPES:
        return _SCOPES[app]
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        if app not in _LOCAL_FOLDERS:
            _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="freightnet-")
        shared = _LOCAL_FOLDERS[app]
    return f"{shared}/freightnet-{app}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets, so that what is written there keeps its readers."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Within this scope intermediate tables go to a folder of their own, which is removed at its end.

    Take what is needed out of it (write or collect the result) before the scope ends.
    """
    before = _SCOPES.get(app := spark.sparkContext.applicationId)
    _SCOPES[app] = f"{scratch_dir(spark)}/scope-{uuid.uuid4().hex}"
    try:
        yield _SCOPES[app]
    finally:
        folder = _SCOPES.pop(app)
        if before:
            _SCOPES[app] = before
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows that one task takes where rows meet by key. Sorting and adding them up takes under 2 KB of memory for a wide one.
TASK_ROWS = 250_000


def most_tasks(spark: SparkSession, rows: int) -> int:
    """Number of tasks for a step over ``rows`` rows: a task holds no more of them as the tables grow.

    Left to itself Spark cuts shuffles by their packed size, which says little about the memory that wide rows take.
    """
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def deal(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """Rows dealt to ``tasks`` by their keys, or left as they are without a number.

    Sums by these and more keys follow without another shuffle. For keys so fine that adding up before the shuffle saves
    little and holds as many wide groups in memory as there are rows.
    """
    return df.repartition(tasks, *keys) if tasks else df


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Ends the lineage like a checkpoint, survives lost executors, and, being Parquet, still gives later
    readers column pruning, filter pushdown and true sizes for the choice of join.
    """
    path = fresh_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which NULL equals NULL; the key columns of ``left`` are kept."""
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = [left[k].eqNullSafe(renamed[f"__{k}"]) for k in keys]
    return left.join(renamed, on, how).drop(*[f"__{k}" for k in keys])


def slice_rows(df: DataFrame, by: Sequence[str], order: Sequence[str], slices: int | None = None) -> DataFrame:
    """Range-partition on (by, order) and freeze the slice number of every row in a written table.

    ``slices`` is the number of slices of near-equal rows, by default ``spark.sql.shuffle.partitions``: choose it so
    that a slice fits a task.
    """
    keys = [F.col(c) for c in (*by, *order)]
    ranged = df.repartitionByRange(slices, *keys) if slices else df.repartitionByRange(*keys)
    return cut(ranged.withColumn("__slice", F.spark_partition_id()))


def _with_offsets(
    sliced: DataFrame, by: Sequence[str], order: Sequence[str], amount: Column, zero: Column
) -> DataFrame:
    """Add ``__before`` (sum of ``amount`` ahead of the row) and ``__total`` (sum of the group).

    The group is one struct key, in which NULL equals NULL, and the join uses the very keys of the window:
    the rows move once for both.
    """
    keys = ["__group", "__slice"]
    rows = sliced.withColumn("__group", F.struct(*by)).withColumn("__kept", F.col("__slice"))
    totals = rows.groupBy(*keys).agg(F.sum(amount).alias("__slice_total"))
    # One row per slice of a group: bounded by the number of partitions, never by the number of rows.
    group = Window.partitionBy("__group")
    ahead = group.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        F.coalesce(F.sum("__slice_total").over(ahead), zero).alias("__offset"),
        F.sum("__slice_total").over(group).alias("__total"),
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumn("__inside", F.coalesce(F.sum(amount).over(inside), zero))
    return (
        ranked.join(offsets, keys)
        .withColumn("__before", F.col("__offset") + F.col("__inside"))
        .drop(*keys, "__offset", "__inside")
        .withColumnRenamed("__kept", "__slice")
    )


def running_total(
    sliced: DataFrame, by: Sequence[str], order: Sequence[str], value: str, start: str, end: str, keep_slice: bool = False
) -> DataFrame:
    """Add the half-open interval [start, end) that ``value`` takes on the running total of its group.

    Takes rows from ``slice_rows`` with the same keys. (by, order) must be unique. ``value`` should be a
    decimal, so that both levels add up exactly.
    """
    dtype = sliced.select(F.sum(value).alias("v")).schema["v"].dataType
    amount = F.col(value).cast(dtype)
    spread = _with_offsets(sliced, by, order, amount, F.lit(0).cast(dtype))
    return (
        spread.withColumn(start, F.col("__before").cast(dtype))
        .withColumn(end, (F.col("__before") + amount).cast(dtype))
        .drop("__before", "__total", *([] if keep_slice else ["__slice"]))
    )


def rank_and_count(df: DataFrame, by: Sequence[str], value: str, rank: str, count: str) -> DataFrame:
    """Distinct (by, value) pairs with the dense rank of the value and the number of values per group.

    NULL is the lowest value and counts as one, as in DENSE_RANK ascending + descending - 1.
    """
    pairs = df.select(*by, value).distinct()
    spread = _with_offsets(slice_rows(pairs, by, [value]), by, [value], F.lit(1), F.lit(0))
    return spread.select(
        *by,
        value,
        (F.col("__before") + 1).cast("int").alias(rank),
        F.col("__total").cast("int").alias(count),
    )
