"""Filters, joins, reshaping and column profiles that the plans are made of."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from freightnet.scale import null_safe_join
from freightnet.schemas import VOLUME

# Destinations outside the road network, and one foreign city coded as a US state.
OFF_NETWORK_STATES = ("EX", "PR", "HI", "XX")
MISCODED_PLACE = ("GNANGARA", "WA")
THIRD_PARTY_SITES = ("PLASTICS INGENUITY",)


def cols_between(df: DataFrame, first: str, last: str) -> list[str]:
    names = df.columns
    return names[names.index(first) : names.index(last) + 1]


def rows_with_missing(df: DataFrame, *cols: str) -> DataFrame:
    return df.where(reduce(Column.__or__, [F.col(f"`{c}`").isNull() for c in cols]))


def on_network(df: DataFrame, city: str, state: str, states: Sequence[str] = OFF_NETWORK_STATES) -> DataFrame:
    """Drop off-network states and the miscoded place; rows without a state are dropped too."""
    c, s = F.col(f"`{city}`"), F.col(f"`{state}`")
    bad_place = F.coalesce((c == MISCODED_PLACE[0]) & (s == MISCODED_PLACE[1]), F.lit(False))
    return df.where(~s.isin(*states) & ~bad_place)


def own_sites(df: DataFrame, site: str = "ShipSiteName", third_party: Sequence[str] = THIRD_PARTY_SITES) -> DataFrame:
    return df.where(~F.col(site).isin(*third_party))


def force_terms(df: DataFrame, col: str = "FrtTermsFix", value: str = "PPD") -> DataFrame:
    return df.withColumn(col, F.lit(value))


def scale_supply(df: DataFrame, source: str = "MMUnits", target: str = "MUnits", pad: float = 10.0) -> DataFrame:
    """Thousands of M to M, plus a small pad that keeps supply above demand."""
    return df.withColumn(target, F.col(source) * 1000 + F.lit(pad))


def exact_sum(df: DataFrame, measure: str) -> Column:
    """Sum of a column; floating numbers are added as decimals, so that the order of tasks changes nothing."""
    floating = df.schema[measure].dataType.typeName() in ("double", "float")
    return F.sum(F.col(measure).cast(VOLUME)).cast("double") if floating else F.sum(measure)


def total(df: DataFrame, keys: Sequence[str], measure: str, out: str | None = None) -> DataFrame:
    return df.groupBy(*keys).agg(exact_sum(df, measure).alias(out or measure))


def values_of(df: DataFrame, column: str, most: int = 1000) -> list[str | None]:
    """The distinct values of a short column in order, NULL first, for operators that turn values into columns.

    More than ``most`` values are refused: such a column does not belong in the columns of a table.
    """
    rows = df.select(column).distinct().orderBy(F.col(column).asc_nulls_first()).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{column} has more than {most} values")
    return [r[0] for r in rows]


def keep_known(df: DataFrame, known: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """Rows whose key exists in ``known``; never multiplies rows."""
    return _existence(df, known, on, "left_semi")


def keep_unknown(df: DataFrame, known: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """Rows whose key is missing from ``known``: what an inner join would lose."""
    return _existence(df, known, on, "left_anti")


def _existence(df: DataFrame, known: DataFrame, on: Mapping[str, str], how: str) -> DataFrame:
    keys = known.select(*[F.col(r).alias(f"__{i}") for i, r in enumerate(on.values())])
    cond = [df[left] == keys[f"__{i}"] for i, left in enumerate(on)]
    return df.join(keys, cond, how)


def lookup(df: DataFrame, dim: DataFrame, on: Mapping[str, str], how: str = "left") -> DataFrame:
    """Join a dimension whose key columns have other names; only its other columns are added."""
    marked = dim.withColumnsRenamed({r: f"__{i}" for i, r in enumerate(on.values())})
    cond = [df[left] == marked[f"__{i}"] for i, left in enumerate(on)]
    return df.join(marked, cond, how).drop(*[f"__{i}" for i in range(len(on))])


def first_per_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per key: the first by ``order``. A min over a struct, so it combines before the shuffle."""
    rest = [c for c in df.columns if c not in (key, *order)]
    picked = df.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("__first"))
    return picked.select(*[key if c == key else F.col(f"__first.`{c}`").alias(c) for c in df.columns])


#: Name of the column that holds what has NULL in the place of a column name.
NO_NAME = "(none)"


def widen(df: DataFrame, keys: Sequence[str], column: str, values: Sequence[str | None], measure: str) -> DataFrame:
    """Long to wide over a known list of columns; (keys, column) holds one value each. One shuffle.

    None in ``values`` stands for NULL and becomes the column ``NO_NAME``.
    """
    cells = [F.max(F.when(F.col(column).eqNullSafe(F.lit(v)), F.col(measure))).alias(NO_NAME if v is None else v) for v in values]
    return df.groupBy(*keys).agg(*cells)


def lengthen(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str, measure: str) -> DataFrame:
    """Wide to long; columns may be chosen by position with ``df.columns[a:b]``."""
    return df.unpivot(list(keys), list(columns), name, measure)


def transpose(df: DataFrame, header: str, headers: Sequence[str], name: str) -> DataFrame:
    """Turn the value columns into rows and the known values of ``header`` into columns."""
    rest = [c for c in df.columns if c != header]
    return widen(lengthen(df, [header], rest, name, "__v"), [name], header, headers, "__v")


def densify(df: DataFrame, keys: Sequence[str], axis: str, values: Sequence[str | None], measure: str) -> DataFrame:
    """Every key with every value of ``axis``, absent measures as 0; None stands for NULL, which is a value like others.

    One aggregation with map-side partial sums, then a narrow unpivot: no cross join, one shuffle.
    """
    names = [f"__{i}" for i in range(len(values))]
    cells = [
        F.sum(F.when(F.col(axis).eqNullSafe(F.lit(v)), F.col(measure)).otherwise(0)).alias(n) for n, v in zip(names, values)
    ]
    long = df.groupBy(*keys).agg(*cells).unpivot(list(keys), names, "__name", measure)
    listed = F.array(*[F.lit(v).cast(df.schema[axis].dataType) for v in values])
    value = F.element_at(listed, F.substring("__name", 3, 10).cast("int") + 1)
    return long.select(*keys, value.alias(axis), measure)


def distinct_lists(df: DataFrame, key: Sequence[str], item: str, out: str) -> DataFrame:
    """Sorted distinct items per key. A list is no longer than the catalogue of items (plants, products);
    duplicates are removed before anything is collected."""
    pairs = df.select(*key, item).distinct()
    return pairs.groupBy(*key).agg(F.sort_array(F.collect_list(item)).alias(out))


def share(df: DataFrame, by: Sequence[str], measure: str, out: str = "Pct") -> DataFrame:
    """Share of each row in the total of its group; NULL where the total is 0. NULL keys are a group of their own.

    The totals are a partial-then-final aggregate joined back, so a hot group is never sorted in one task.
    """
    totals = total(df, by, measure, "__total")
    joined = null_safe_join(df, totals, by)
    return joined.withColumn(out, F.try_divide(F.col(measure), F.col("__total"))).drop("__total")


def with_group_total(df: DataFrame, by: Sequence[str], measure: str, out: str) -> DataFrame:
    """Every row with the total of its group. NULL keys are a group of their own."""
    return null_safe_join(df, total(df, by, measure, out), by)


def smallest(df: DataFrame, measure: str, n: int, *ties: str) -> DataFrame:
    """The n smallest rows, ties broken by the given columns."""
    return df.orderBy(measure, *ties).limit(n)


def profile(df: DataFrame, *cols: str) -> DataFrame:
    """One row per column: rows, missing, min, max, mean. One pass over the data."""
    cols = cols or tuple(df.columns)
    numeric = {f.name for f in df.schema if f.dataType.typeName() in ("integer", "long", "double", "float", "decimal")}
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(cols):
        x = F.col(f"`{c}`")
        mean = F.avg(x) if c in numeric else F.lit(None)
        aggs += [
            F.count(x).alias(f"c{i}"),
            F.min(x).cast("string").alias(f"lo{i}"),
            F.max(x).cast("string").alias(f"hi{i}"),
            mean.cast("double").alias(f"avg{i}"),
        ]
    entries = [
        F.struct(
            F.lit(c).alias("column"),
            F.col("n").alias("rows"),
            (F.col("n") - F.col(f"c{i}")).alias("missing"),
            F.col(f"lo{i}").alias("min"),
            F.col(f"hi{i}").alias("max"),
            F.col(f"avg{i}").alias("mean"),
        )
        for i, c in enumerate(cols)
    ]
    return df.agg(*aggs).select(F.inline(F.array(*entries)))


def exact_medians(df: DataFrame, *cols: str, most: int = 10_000, accuracy: int = 10_000) -> DataFrame:
    """(column, median) of numeric columns: the mean of the two middle values, exact, without sorting the table.

    A mergeable sketch brackets the middle ranks of all columns in one pass; the next pass counts exactly what lies below
    and inside each bracket, and narrows it again if more than ``most`` values are inside. Each pass leaves a few
    ``accuracy``-ths of the rows, so two or three do at any size. Only the values of the last bracket reach the driver.
    """
    numeric = [f.name for f in df.schema if f.dataType.typeName() in ("integer", "long", "double", "float", "decimal", "short")]
    cols = cols or tuple(numeric)
    x = {c: F.col(f"`{c}`").cast("double") for c in cols}
    first = df.agg(*[F.count(x[c]).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    size = {c: first[f"n{i}"] for i, c in enumerate(cols)}
    #: Places of the middle values that are still sought, and the values of those that were found.
    sought = {c: {(n - 1) // 2, n // 2} for c, n in size.items() if n}
    found: dict[str, dict[int, float]] = {c: {} for c in cols}
    #: The sought values lie above the first and below the second; rows below and inside.
    bracket: dict[str, tuple[float | None, float | None, int, int]] = {c: (None, None, 0, n) for c, n in size.items()}

    def inside(c: str) -> Column:
        low, high, _, _ = bracket[c]
        above = F.lit(True) if low is None else x[c] > low
        return above if high is None else above & (x[c] < high)

    while wide := [c for c in sought if sought[c] and bracket[c][3] > most]:
        aggs = []
        for i, c in enumerate(wide):
            _, _, below, n = bracket[c]
            shares = [max(0.0, (min(sought[c]) - below) / n - 2 / accuracy), min(1.0, (max(sought[c]) + 1 - below) / n + 2 / accuracy)]
            aggs.append(F.percentile_approx(F.when(inside(c), x[c]), shares, accuracy).alias(f"q{i}"))
        ends = df.agg(*aggs).first()
        counts = []
        for i, c in enumerate(wide):
            low, high = ends[f"q{i}"]
            parts = {"b": x[c] < low, "l": x[c] == low, "m": (x[c] > low) & (x[c] < high)}
            counts += [F.count(F.when(rule, 1)).alias(f"{k}{i}") for k, rule in parts.items()]
        row = df.agg(*counts).first()
        for i, c in enumerate(wide):
            (low, high), (below, at_low, middle) = ends[f"q{i}"], (row[f"{k}{i}"] for k in "blm")
            for rank in list(sought[c]):
                if below <= rank < below + at_low:
                    found[c][rank] = low
                elif below + at_low + middle <= rank:
                    found[c][rank] = high
            sought[c] -= set(found[c])
            bracket[c] = (low, high, below + at_low, middle)
    cells = []
    for c in cols:
        ranks = sorted({(size[c] - 1) // 2, size[c] // 2}) if size[c] else []
        listed = F.sort_array(F.collect_list(F.when(inside(c), x[c])))
        values = [F.lit(found[c][r]) if r in found[c] else F.get(listed, F.lit(r - bracket[c][2])) for r in ranks]
        middle = (values[0] + values[-1]) / 2 if values else F.lit(None).cast("double")
        cells.append(F.struct(F.lit(c).alias("column"), middle.alias("median")))
    return df.agg(F.array(*cells).alias("__m")).select(F.inline("__m"))


def first_reason(rules: Mapping[str, Column]) -> Column:
    """Name of the first rule that holds, NULL where none does."""
    out = F.lit(None).cast("string")
    for name, rule in reversed(list(rules.items())):
        out = F.when(F.coalesce(rule, F.lit(False)), name).otherwise(out)
    return out


def drop_counts(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(reason, n): rows by the first rule that drops them; rules that drop nothing are listed with 0."""
    counts = [F.count(F.when(F.col("__reason") == name, 1)).alias(name) for name in rules]
    rows = [F.struct(F.lit(name).alias("reason"), F.col(f"`{name}`").alias("n")) for name in rules]
    return df.select(first_reason(rules).alias("__reason")).agg(*counts).select(F.inline(F.array(*rows)))


def observed_drops(df: DataFrame, rules: Mapping[str, Column], observation: Observation) -> DataFrame:
    """``df`` without the rows that a rule drops; the counts by reason ride on the job that reads it, at no extra pass.

    They are in ``observation.get`` once an action has run.
    """
    marked = df.withColumn("__reason", first_reason(rules))
    counts = [F.count(F.when(F.col("__reason") == name, 1)).alias(name) for name in rules]
    return marked.observe(observation, *counts).where(F.col("__reason").isNull()).drop("__reason")


def lookup_one(df: DataFrame, dim: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """Join a dimension that must hold each needed key exactly once: the job fails and names the key otherwise.

    The number of rows of a key travels with the dimension, which is aggregated by its own key for it. The join takes the
    place of the plain one and moves no more of ``df``. Duplicate keys that no row needs are no fault.
    """
    keys = list(on.values())
    rest = [c for c in dim.columns if c not in keys]
    one = dim.groupBy(*keys).agg(F.count(F.lit(1)).alias("__hits"), *[F.first(c).alias(c) for c in rest])
    joined = lookup(df, one, on)
    shown = F.concat_ws(", ", *[F.concat(F.lit(f"{k} = "), F.coalesce(F.col(k).cast("string"), F.lit("NULL"))) for k in on])
    hits = F.coalesce("__hits", F.lit(0))
    said = F.concat(F.lit("found "), hits.cast("string"), F.lit(" rows instead of one for "), shown)
    # A filter that either passes or fails: unlike a value, it stays whichever columns are read.
    passes = F.when(hits == 1, F.lit(True)).otherwise(F.raise_error(said).cast("boolean"))
    return joined.where(passes).drop("__hits")
