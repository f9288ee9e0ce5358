"""Result tables. Writes are distributed: one file per partition, no single-task export."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightnet.scale import fresh_path


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def land_by(df: DataFrame, path: str, folders: Sequence[str]) -> None:
    """Parquet with one folder per value of ``folders``; readers that filter on them open those folders only.

    Rows are dealt to tasks by those values and by a salt, so that a folder gets few files and a large one still several.
    """
    salted = df.repartition(*folders, _salt(df))
    salted.write.mode("overwrite").partitionBy(*folders).parquet(path)


def _salt(df: DataFrame, parts: int = 8) -> Column:
    return F.pmod(F.xxhash64(*df.columns), F.lit(parts))


def land_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """A table in the shared folder, bucketed and sorted by ``key``, read back under a name of its own.

    Two tables with the same number of buckets join and group by ``key`` without a shuffle. Choose the number so that a
    bucket fits a task at the size the table will have.
    """
    table = f"{name}_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, key)
    writer = dealt.write.bucketBy(buckets, key).sortBy(key).format("parquet")
    writer.option("path", fresh_path(df.sparkSession, name)).saveAsTable(table)
    return df.sparkSession.table(table)
