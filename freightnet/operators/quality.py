"""Checks between steps: volume kept, keys matched, lookups unique."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightnet.operators.tables import keep_unknown
from freightnet.schemas import VOLUME


def reconcile(before: DataFrame, after: DataFrame, measure: str) -> DataFrame:
    """Totals of ``measure`` before and after a step, the loss, and the loss as a share."""

    def side(df: DataFrame, name: str) -> DataFrame:
        amount = F.col(measure).cast(VOLUME)
        is_before = F.lit(name == "before")
        zero = F.lit(0).cast(VOLUME)
        return df.select(
            F.when(is_before, amount).otherwise(zero).alias("before"),
            F.when(is_before, zero).otherwise(amount).alias("after"),
        )

    both = side(before, "before").unionAll(side(after, "after"))
    sums = both.agg(
        F.coalesce(F.sum("before").cast("double"), F.lit(0.0)).alias("before"),
        F.coalesce(F.sum("after").cast("double"), F.lit(0.0)).alias("after"),
    )
    delta = F.col("before") - F.col("after")
    return sums.select("before", "after", delta.alias("delta"), F.try_divide(delta, F.col("before")).alias("pct"))


def conditional_share(df: DataFrame, flag: str, value: str, measure: str) -> DataFrame:
    """Volume with ``flag`` = ``value``, total volume, and their ratio."""
    part = F.sum(F.when(F.col(flag) == value, F.col(measure)).otherwise(0.0))
    sums = df.agg(part.alias("part"), F.sum(measure).alias("total"))
    return sums.withColumn("pct", F.try_divide("part", "total"))


def lookup_faults(needed: DataFrame, dim: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """Needed keys that the dimension does not hold exactly once, with the number of hits."""
    names = list(on)
    hits = dim.groupBy(*[F.col(r).alias(k) for k, r in on.items()]).agg(F.count(F.lit(1)).alias("hits"))
    keys = needed.select(*names).distinct()
    found = keys.join(hits, names, "left").select(*names, F.coalesce("hits", F.lit(0)).alias("hits"))
    return found.where(F.col("hits") != 1)


def unmatched(df: DataFrame, dim: DataFrame, on: Mapping[str, str], measure: str) -> DataFrame:
    """Rows and volume per key that an inner join with ``dim`` would lose; NULL keys are kept and shown."""
    lost = keep_unknown(df, dim, on)
    return lost.groupBy(*on).agg(F.count(F.lit(1)).alias("rows"), F.sum(measure).alias(measure))
