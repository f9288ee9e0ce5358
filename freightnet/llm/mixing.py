"""Mixing sources to target weights.

Every document gets a key that is random but fixed (a digest of its id and text). Within each source the documents are
range-sorted by that key, a prefix sum of their sizes runs over the sorted slices, and the mix takes words in that order
up to the very word at which the source's budget ends. A budget beyond the source's size repeats it: whole epochs first,
then the part that is left.

Budgets share 100 % of all sizes by weight. None may exceed ``most`` times its source's size; what is cut off there is
shared among the others by weight until no budget is above its limit.

Only (id, source, size, key) is sorted, in slices of near-equal rows: a source that holds a third of all rows is cut into
as many slices as it needs. The table of sources is the mix's own recipe, one row per source.

Defined cases: a NULL text has size 0; a NULL source is a source of its own, last in order; a document without words
takes none; repeated rows are documents of their own; rows that agree in id and text are interchangeable.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freightnet.scale import cut, running_total, slice_rows

WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str | Column) -> Column:
    """Number of words between ASCII white space; 0 for NULL."""
    text = F.col(text) if isinstance(text, str) else text
    # Each word becomes one letter, then the white space goes.
    letters = F.translate(F.regexp_replace(text, WORD, "x"), " \t\n\x0b\x0c\r", "")
    return F.coalesce(F.length(letters), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """Target of each source from its size: (source, source_size, target).

    Sources in code-point order, NULL last, get the weights in turn. With the sources sorted by the size at which their
    limit is met, the water level is the first at which the sources below it are exactly those cut off by it.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__at") % len(weights) + 1).cast("int"))
    limit = (F.col("source_size") * F.lit(float(most))).cast("double")
    rows = sizes.withColumn("__at", F.row_number().over(ordered) - 1).withColumn("__weight", weight)
    rows = rows.withColumn("__limit", limit).withColumn("__met", F.col("__limit") / F.col("__weight"))
    below = Window.orderBy("__met", "__at").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("__met", "__at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # Level if exactly the sources ahead of this one are at their limit.
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("__limit").over(below), F.lit(0.0))
    open_weight = F.sum("__weight").over(everything) - F.coalesce(F.sum("__weight").over(below), F.lit(0.0))
    rows = rows.withColumn("__level", left / open_weight)
    # The first level that its own source does not exceed; all later sources share it.
    holds = F.when(F.col("__level") <= F.col("__met"), F.col("__level"))
    level = F.first(holds, ignorenulls=True).over(everything)
    target = F.least(F.col("__limit"), F.col("__weight") * F.coalesce(level, F.lit(float("inf"))))
    return rows.select("source", "source_size", target.alias("target"))


def mix_sources(
    documents: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    most: float = 3.0,
    seed: int = 0,
    id_col: str = "doc_id",
) -> DataFrame:
    """One row per document: id, size, source_size, target, epochs (whole repeats), rest (words of the last, partial
    one), taken (epochs * size + rest)."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"), F.md5(F.coalesce("text", F.lit("")))))
    rows = documents.select(
        F.col(id_col), F.col("source"), word_count("text").alias("size"), key.alias("__key")
    )
    sliced = slice_rows(rows, ["source"], ["__key"])
    targets = cut(source_targets(sliced.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    placed = running_total(sliced, ["source"], ["__key"], "size", "__from", "__to")
    joined = placed.withColumnRenamed("source", "__source").join(
        targets, F.col("__source").eqNullSafe(F.col("source")), "left"
    )
    budget = F.floor("target").cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("bigint")
    rest = budget - F.col("epochs") * F.col("source_size") - F.col("__from")
    return (
        joined.withColumn("epochs", epochs)
        .withColumn("rest", F.greatest(F.lit(0).cast("bigint"), F.least(rest, F.col("size"))))
        .select(
            id_col, "size", "source_size", "target", "epochs", "rest",
            (F.col("epochs") * F.col("size") + F.col("rest")).alias("taken"),
        )
    )
