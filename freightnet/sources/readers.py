"""Readers. Workbook sheets are landed as CSV or Parquet first; every read has a fixed schema."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.schema(schema)
    if fmt == "csv":
        # Columns are matched by position in CSV; a header that disagrees with the schema fails the read.
        return reader.option("header", True).option("enforceSchema", False).csv(path)
    return reader.format(fmt).load(path)


def read_jdbc(
    spark: SparkSession,
    url: str,
    query: str,
    split_column: str,
    lower: str | int,
    upper: str | int,
    splits: int = 32,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """Partitioned read of a query from a database. Login and driver come in ``options``."""
    reader = spark.read.format("jdbc").options(**(options or {}))
    reader = reader.option("url", url).option("dbtable", f"({query}) q")
    bounds = {"partitionColumn": split_column, "lowerBound": lower, "upperBound": upper, "numPartitions": splits}
    return reader.options(**bounds).load()


def parse_ws_table(lines: DataFrame, fields: Sequence[str], line: str = "value") -> DataFrame:
    """Columns from lines of text parted by runs of white space; header and blank lines are dropped.

    Columns are strings; the caller casts. A line counts as header when its first cell is the first name.
    """
    cells = F.split(F.trim(F.col(line)), r"\s+")
    parsed = lines.where(F.trim(F.col(line)) != "").select(
        *[F.get(cells, F.lit(i)).alias(name) for i, name in enumerate(fields)]
    )
    return parsed.where(F.col(fields[0]) != fields[0])


def read_ws_table(spark: SparkSession, path: str, fields: Sequence[str]) -> DataFrame:
    return parse_ws_table(spark.read.text(path), fields)


def coalesce_cost(lanes: DataFrame) -> DataFrame:
    """Inter-site lanes with one cost column, whichever of the two names the sheet used."""
    present = [c for c in ("CostPerMUnit", "CostPerM") if c in lanes.columns]
    return lanes.select("Plant", "ShipSite", F.coalesce(*present).alias("CostPerMUnit"))


def flatten_products(docs: DataFrame, doc: str, owners: str, amount: str) -> DataFrame:
    """(owner, product, amount) rows from {owners: {name: {"products": {product: {amount: x}}}}}."""
    leaf = f"STRUCT<{amount}: DOUBLE>"
    spec = f"{owners} MAP<STRING, STRUCT<products: MAP<STRING, {leaf}>>>"
    parsed = docs.select(F.from_json(F.col(doc), spec)[owners].alias("m"))
    owned = parsed.select(F.explode("m").alias("owner", "body"))
    return owned.select("owner", F.explode("body.products").alias("product", "leaf")).select(
        "owner", "product", F.col("leaf")[amount].alias(amount)
    )


def flatten_lanes(docs: DataFrame, doc: str, field: str = "distances") -> DataFrame:
    """(orig, dest, miles) rows from {field: {"A => B": miles}}."""
    parsed = docs.select(F.from_json(F.col(doc), f"{field} MAP<STRING, DOUBLE>")[field].alias("m"))
    ends = F.split("lane", " => ")
    return parsed.select(F.explode("m").alias("lane", "miles")).select(
        ends[0].alias("orig"), ends[1].alias("dest"), "miles"
    )


def document_leaves(docs: DataFrame, doc: str, depth: int = 6) -> DataFrame:
    """(path, value) of every leaf of JSON documents of any shape: the keys that lead to it, and its text.

    Sections may differ in depth and owners need not be known. Each level is one step over the rows of the level above, so
    nothing is gathered; what is deeper than ``depth`` fails. A document that is no JSON fails too.
    """
    level = docs.select(F.array().cast("array<string>").alias("path"), F.parse_json(doc).alias("v"))
    leaves = []
    for _ in range(depth):
        nested = F.schema_of_variant("v").startswith("OBJECT") | F.schema_of_variant("v").startswith("ARRAY")
        leaves.append(level.where(~nested).select("path", F.col("v").cast("string").alias("value")))
        inner = docs.sparkSession.tvf.variant_explode(F.col("v").outer()).select(F.col("key"), F.col("pos"), F.col("value").alias("inner"))
        step = level.where(nested).lateralJoin(inner)
        key = F.coalesce("key", F.col("pos").cast("string"))
        level = step.select(F.concat("path", F.array(key)).alias("path"), F.col("inner").alias("v"))
    too_deep = F.raise_error(F.concat(F.lit("deeper than expected: "), F.array_join("path", "/")))
    nested = F.schema_of_variant("v").startswith("OBJECT") | F.schema_of_variant("v").startswith("ARRAY")
    last = F.when(nested, too_deep.cast("string")).otherwise(F.col("v").cast("string"))
    leaves.append(level.select("path", last.alias("value")))
    return reduce(DataFrame.unionByName, leaves)
