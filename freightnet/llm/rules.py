"""Quality rules as weak supervision.

Each rule looks at simple counts of a text and votes good (1), bad (-1) or abstains (0). How far each rule can be
trusted is not set by hand: expectation-maximisation over the votes of all documents estimates how accurate each rule is
on good and on bad documents and the share of good ones, and a document is kept by its posterior probability of being
good instead of having to pass every rule.

The estimate needs no more than how often each pattern of votes occurs: at most 3 ** (number of rules) counts, whatever
the number of documents. The counts of each text come from sorted arrays inside its row; no word leaves its task.

Only DataFrame functions are used.

Defined cases: NULL and empty texts have counts of 0 and fail the base rules; repeated rows count as often as they
occur; without documents there are no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightnet.scale import cut

SPACE = r"[\x20\x09-\x0D]+"
# Frequent function words of the four languages.
FUNCTION_WORDS = (
    "the of and to in is that for it as with was on are by this from "
    "der die das und ist von mit den ein eine nicht für auf im zu sich "
    "le la les de des et un une est que pour dans sur par en du au "
    "el los las y es una por con para del se no su al lo"
).split()
ROUNDS = 25


def _counts(df: DataFrame, text: str) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and a few shares."""
    spaces = " \t\n\x0b\x0c\r"
    df = df.withColumn("__text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    df = df.withColumn("__bare", F.btrim(F.col("__text"), F.lit(spaces)))
    none = F.expr("cast(array() as array<string>)")
    df = df.withColumn("__words", F.when(F.col("__bare") == "", none).otherwise(F.split("__bare", SPACE)))
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("__lines", lines)
    size = lambda c: F.size(c).cast("bigint")
    length = lambda c: F.length(c).cast("bigint")
    without = lambda pattern: F.length("__text") - F.length(F.regexp_replace("__text", pattern, ""))
    common = F.array(*[F.lit(w) for w in FUNCTION_WORDS])
    df = df.withColumns(
        {
            "n_words": size("__words"),
            "word_chars": length(F.array_join("__words", "")),
            "n_symbols": without(r"[#*$%&|<>]+").cast("bigint"),
            "n_lines": size("__lines"),
            "n_dup_lines": size("__lines") - size(F.array_distinct("__lines")),
            "__marks": without("!+"),
            "__upper": without("[A-Z]+"),
            "__common": F.size(F.array_intersect("__words", common)),
            "__hash": F.transform("__words", lambda w: F.xxhash64(w)),
        }
    )
    return _repeats(df).drop("__text", "__bare", "__words", "__lines", "__hash")


def _repeats(df: DataFrame) -> DataFrame:
    """Add n_repeat_words: the words in windows of three that occur twice or more.

    Window hashes are sorted with their places in the low bits, so that equal ones are neighbours; those few that
    agree in the high bits are then compared by the whole hash.
    """
    rest = lambda k: F.slice("__hash", k, F.greatest(F.col("n_words").cast("int") - 2, F.lit(0)))
    pairs = F.zip_with(rest(1), rest(2), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn("__window", F.zip_with(pairs, rest(3), lambda ab, c: F.xxhash64(ab, c)))
    df = df.withColumn("__bits", F.length(F.bin(F.col("n_words"))))
    packed = F.transform("__window", lambda h, i: F.call_function("shiftleft", h, F.col("__bits")).bitwiseOR(i.cast("bigint")))
    df = df.withColumn("__sorted", F.sort_array(packed))
    high = lambda x: F.call_function("shiftright", x, F.col("__bits"))
    near = lambda i: F.get("__sorted", i)
    maybe = F.filter(
        "__sorted",
        lambda x, i: F.coalesce(high(x) == high(near(i + 1)), F.lit(False))
        | F.when(i > 0, high(x) == high(near(i - 1))).otherwise(False),
    )
    places = F.transform(maybe, lambda x: x - F.call_function("shiftleft", high(x), F.col("__bits")))
    df = df.withColumn(
        "__maybe",
        F.sort_array(
            F.transform(
                places,
                lambda p: F.struct(F.get("__window", p.cast("int")).alias("h"), p.alias("p")),
            )
        ),
    )
    same = F.filter(
        "__maybe",
        lambda x, i: F.coalesce(x["h"] == F.get("__maybe", i + 1)["h"], F.lit(False))
        | F.when(i > 0, x["h"] == F.get("__maybe", i - 1)["h"]).otherwise(False),
    )
    zero = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n"))
    covered = F.aggregate(
        F.sort_array(F.transform(same, lambda x: x["p"])),
        zero,
        lambda s, p: F.struct((p + 3).alias("end"), (s["n"] + p + 3 - F.greatest(p, s["end"])).alias("n")),
        lambda s: s["n"],
    )
    return df.withColumn("n_repeat_words", covered).drop("__window", "__bits", "__sorted", "__maybe")


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes() -> dict[str, Column]:
    """The labelling rules over the counts; shares of an empty text are NULL, and NULL abstains."""
    words = F.nullif(F.col("n_words"), F.lit(0))
    per_word = lambda c: F.col(c) / words
    mean = per_word("word_chars")
    sign_share = F.col("n_symbols") / F.nullif(F.col("word_chars"), F.lit(0))
    duplicate = F.col("n_dup_lines") / F.nullif(F.col("n_lines"), F.lit(0))
    return {
        "length": _vote(F.col("n_words") >= 80, F.col("n_words") < 50),
        "word_length": _vote(mean.between(3, 12), (mean < 2) | (mean > 20)),
        "symbols": _vote(per_word("n_symbols") < 0.02, per_word("n_symbols") > 0.1),
        "duplicate_lines": _vote(duplicate < 0.05, duplicate > 0.3),
        "repeats": _vote(per_word("n_repeat_words") < 0.2, per_word("n_repeat_words") > 0.5),
        "sign_share": _vote(sign_share < 0.01, sign_share > 0.04),
        "marks": _vote(per_word("__marks") < 0.05, per_word("__marks") > 0.3),
        "upper": _vote(F.col("__upper") / words < 0.5, F.col("__upper") / words > 2),
        "function_words": _vote(F.col("__common") >= 4, F.col("__common") < 2),
    }


#: Chances of the votes bad, abstain and good at the start, for good and for bad documents.
REJECTS_GOOD, REJECTS_BAD = 0.03, 0.1
START_GOOD, START_BAD = (0.04, 0.16, 0.8), (0.5, 0.3, 0.2)


def fit(patterns: DataFrame, rules: int, rounds: int = ROUNDS) -> tuple[float, list[list[float]], list[list[float]]]:
    """Share of good documents, and each rule's chances of its three votes for good and for bad documents, by
    expectation-maximisation.

    ``patterns`` has (votes: array<int>, n): one row per pattern of votes. All of it is one array in one row, bounded
    by 3 ** rules entries; the rounds are one expression over it.
    """
    one = patterns.agg(F.array_sort(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n")))).alias("all"))
    table = lambda row: F.array(*[F.array(*[F.lit(x) for x in row])] * rules)
    start = F.struct(F.lit(0.8).alias("prior"), table(START_GOOD).alias("good"), table(START_BAD).alias("bad"))

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)

    def estimate(x: Column) -> Column:
        """One maximisation step from the patterns with their expected number of good documents."""
        sides = {"good": lambda p: p["good"], "bad": lambda p: p["n"] - p["good"]}
        smooth = {"good": START_GOOD, "bad": START_BAD}

        def chances(side: str, k: int) -> Column:
            part = lambda v: total(
                F.transform(x, lambda p: F.when(p["votes"][k] == v, sides[side](p)).otherwise(0.0))
            )
            every = total(F.transform(x, sides[side])) + 10
            share = [(part(v) + 10 * smooth[side][v + 1]) / every for v in (-1, 0, 1)]
            # A rule is no worse than stated: it seldom rejects a good document and does reject bad ones.
            share[0] = F.least(share[0], F.lit(REJECTS_GOOD)) if side == "good" else F.greatest(share[0], F.lit(REJECTS_BAD))
            return F.array(*share)

        good, every = total(F.transform(x, sides["good"])), total(F.transform(x, lambda p: p["n"]))
        return F.struct(
            ((good + 8) / (every + 10)).alias("prior"),
            *[F.array(*[chances(side, k) for k in range(rules)]).alias(side) for side in ("good", "bad")],
        )

    def turn(state: Column, _: Column) -> Column:
        expected = F.array(
            F.transform(
                "all",
                lambda p: F.struct(
                    p["votes"].alias("votes"), p["n"].alias("n"),
                    (p["n"] * posterior(state["prior"], state["good"], state["bad"], p["votes"])).alias("good"),
                ),
            )
        )
        # Bound once by a one-element array, read many times by the step.
        return F.get(F.transform(expected, estimate), F.lit(0))

    row = one.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, turn).alias("s")).select("s.*").first()
    return row["prior"], [list(x) for x in row["good"]], [list(x) for x in row["bad"]]


def posterior(prior: Column, good: Column, bad: Column, cast: Column) -> Column:
    """Probability that a document with these votes is good, the rules independent of each other."""
    likelihood = F.zip_with(
        F.zip_with(good, bad, lambda g, b: F.struct(g.alias("g"), b.alias("b"))),
        cast,
        lambda c, v: F.ln(F.get(c["g"], v + 1) / F.get(c["b"], v + 1)),
    )
    odds = F.aggregate(likelihood, F.ln(prior / (1 - prior)), lambda a, b: a + b)
    return 1 / (1 + F.exp(-odds))


def judge(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, rounds: int = ROUNDS
) -> DataFrame:
    """One row per document: id, the counts, base_failed, votes, p_good, kept."""
    counted = _counts(documents.select(F.col(id_col), F.col(text_col)), text_col).drop(text_col)
    rules = votes()
    counted = counted.withColumn("votes", F.array(*rules.values()))
    counted = cut(counted.drop("__marks", "__upper", "__common"))
    prior, *sides = fit(counted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")), len(rules), rounds)
    good, bad = (F.array(*[F.array(*[F.lit(x) for x in row]) for row in side]) for side in sides)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    p_good = posterior(F.lit(prior), good, bad, F.col("votes"))
    return counted.withColumns({"base_failed": failed, "p_good": p_good, "kept": ~failed & (p_good >= least)})
