"""Secret scan: three fixed patterns, and a randomness test battery over long tokens.

Each token is given an encoding by its characters (digits, hex, letters of one case, base32, base36, base62, base64).
Under the hypothesis that it was written by people its characters repeat, run and correlate; three statistics measure
how random it is:

* chi-squared of the character counts against the uniform alphabet of the encoding,
* runs of characters above and below the middle of the alphabet,
* lag-one serial correlation of the places in the alphabet.

Each gives a p-value under randomness; three times the least of them is that of all three together. The reverse question,
whether people wrote it, is answered by how many of its neighbouring characters are an odd pair: of two classes, or of one
class but a pair that words or numbers seldom have, and not a repetition of what has just been there. What is seldom has a
rate for each encoding, so that digits alone or letters of one case can be told too. The p-value as written text is divided
by the one as a random token, which can only raise it. The result goes through Benjamini-Hochberg control within each class
of lengths, so that many short tokens cannot use up the error allowance of a few long ones. It is ranked by way of a
histogram of bounded size, counted where the rows are: no token list is sorted or collected.

Only DataFrame functions are used; Python never sees a row.

Defined cases: NULL and empty texts have no spans; repeated rows give repeated results; extra columns pass through
``scan`` untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freightnet.scale import cut

# The base patterns, their kinds in listed order and the least length of what they find.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
ALPHABETS = {
    "digits": "0123456789",
    "hex": "0123456789abcdef",
    "letters": "abcdefghijklmnopqrstuvwxyz",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: Each letter with those that often follow it in English, German, French or Spanish words: 291 of 676 pairs.
FOLLOWERS = (
    "abcdfghiklmnprstuvwy baeiloruy caehiklortu dadeioru eabcdefghiklmnpqrstuvwxyz faefilortu gaeghilnorstu "
    "haeilmnortu iabcdefghlmnoprstvz jaeou kaeilort labdefgiklmostuy mabeimopsu nacdefgiknostuvyz "
    "oabcdfghiklmnoprstuvwy paefhiloprstu qu rabcdefgiklmnoprstuvyz sacehiklmnopstuw tacehilorstuwyz "
    "uabcdefgilmnprstvx vaeio waehiou xipt yeos zaeiouw"
)
LETTER_PAIRS = [x[0] + y for x in FOLLOWERS.split(" ") for y in x[1:]]
#: Written numbers repeat a digit, count up or down, or have zeros.
DIGIT_PAIRS = [f"{a}{b}" for a in range(10) for b in range(10) if (a - b) % 10 in (0, 1, 9) or 0 in (a, b)]
ORDINARY = " ".join([*LETTER_PAIRS, *[x.upper() for x in LETTER_PAIRS], *DIGIT_PAIRS, "++", "+/", "/+", "//"])
#: At most so many of the neighbouring pairs of a written token are odd: letters of one case, and all others.
WRITTEN_LETTERS, WRITTEN_OTHERS = 0.1, 0.15
#: A pair is no evidence if it and the character before it have been among so many characters before.
REPEAT_WITHIN = 24
#: Bins of -log10 p, a tenth wide; beyond the last all p-values are as good as 0.
P_BINS = 400
FALSE_DISCOVERY = 0.01
#: A token that looks less random than this in the three tests together is none, whatever the rest says.
LEAST_RANDOM = 1e-4


def _spans(text: Column, pattern: str, kind: str, least: int = 0) -> Column:
    """Array of (start, end, kind) of the leftmost non-overlapping matches; code points, end exclusive.

    The pieces between matches and the matches themselves give the places as running sums of their lengths.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    sizes = F.zip_with(gaps, found, lambda g, f: F.struct(F.length(g).alias("gap"), F.length(f).alias("size")))
    if least:
        secret = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        sizes = F.zip_with(
            sizes, secret, lambda x, t: F.struct(x["gap"].alias("gap"), x["size"].alias("size"), F.length(t).alias("secret"))
        )
    else:
        sizes = F.transform(
            sizes, lambda x: F.struct(x["gap"].alias("gap"), x["size"].alias("size"), x["size"].alias("secret"))
        )
    empty = F.expr("cast(array() as array<struct<start:bigint,end:bigint,kind:int>>)")
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("spans"))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + x["gap"]
        end = start + F.coalesce(x["size"], F.lit(0))
        one = F.struct(start.alias("start"), end.alias("end"), F.lit(KINDS.index(kind)).alias("kind"))
        kept = F.when(x["secret"] >= least, F.concat(s["spans"], F.array(one))).otherwise(s["spans"])
        return F.struct(end.alias("at"), kept.alias("spans"))

    spans = F.aggregate(sizes, zero, step, lambda s: s["spans"])
    # Most texts have no match; the sums are then never made.
    return F.when(text.rlike(pattern), spans).otherwise(empty)


def _normal_tail(z: Column) -> Column:
    """P(Z > z): fixed polynomial of Abramowitz and Stegun 26.2.17, absolute error below 1e-7 times the density."""
    a = F.abs(z)
    t = 1 / (1 + a * 0.2316419)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def encoding(token: Column) -> Column:
    """The smallest alphabet that holds all characters of a token, padding aside."""
    return (
        F.when(token.rlike(r"^[0-9]+=*$"), "digits")
        .when(token.rlike(r"^([0-9a-f]+|[0-9A-F]+)=*$"), "hex")
        .when(token.rlike(r"^([a-z]+|[A-Z]+)=*$"), "letters")
        .when(token.rlike(r"^([a-z2-7]+|[A-Z2-7]+)=*$"), "base32")
        .when(token.rlike(r"^([0-9a-z]+|[0-9A-Z]+)=*$"), "base36")
        .when(token.rlike(r"^[0-9A-Za-z]+=*$"), "base62")
        .otherwise("base64")
    )


def _add(tokens: str, **fields) -> Column:
    """The array of token structs with more fields; each call binds what the next one reads several times."""
    return F.transform(tokens, lambda x: _with(x, fields))


def _with(x: Column, fields: dict) -> Column:
    for name, make in fields.items():
        x = x.withField(name, make(x))
    return x


def _changes(codes: Column, kind) -> Column:
    """How often ``kind`` differs between neighbours."""
    n = F.size(codes)
    pairs = F.zip_with(F.slice(codes, 1, n - 1), F.slice(codes, 2, n - 1), lambda a, b: kind(a) != kind(b))
    return F.size(F.filter(pairs, lambda p: p)).cast("double")


def _odd_pairs(bare: Column) -> Column:
    """How many neighbouring characters are no ordinary pair and no repetition; linear in the length."""
    zero = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("odd"))

    def step(s: Column, c: Column) -> Column:
        pair = F.concat(F.right(s["last"], F.lit(1)), c)
        new = F.position(F.concat(F.right(s["last"], F.lit(2)), c), s["last"]) == 0
        odd = (s["last"] != "") & (F.position(pair, F.lit(ORDINARY)) == 0) & new
        last = F.right(F.concat(s["last"], c), F.lit(REPEAT_WITHIN))
        return F.struct(last.alias("last"), (s["odd"] + F.when(odd, 1.0).otherwise(0.0)).alias("odd"))

    return F.aggregate(F.split(bare, ""), zero, step, lambda s: s["odd"])


def with_randomness(df: DataFrame, tokens: str) -> DataFrame:
    """Give each struct (start, end, token) of an array column its encoding and the p-values of the tests: chi_p, runs_p and
    serial_p as a random token, written_p as written text, and p, which combines them."""
    alphabet = F.create_map(*[F.lit(v) for kv in ALPHABETS.items() for v in kv])
    df = df.withColumn(tokens, _add(tokens, kind=lambda x: encoding(x["token"])))
    bare = {
        "bare": lambda x: F.translate(
            F.regexp_replace(
                F.when(x["kind"].isin("hex", "letters", "base36"), F.lower(x["token"]))
                .when(x["kind"] == "base32", F.upper(x["token"]))
                .otherwise(x["token"]),
                "=+$", "",
            ), "-_", "+/",
        ),
        "alphabet": lambda x: F.element_at(alphabet, x["kind"]),
    }
    df = df.withColumn(tokens, _add(tokens, **bare))
    codes = {
        "codes": lambda x: F.transform(F.split(x["bare"], ""), lambda c: F.position(c, x["alphabet"]).cast("double")),
        "n": lambda x: F.length(x["bare"]).cast("double"),
        "size": lambda x: F.length(x["alphabet"]).cast("double"),
    }
    df = df.withColumn(tokens, _add(tokens, **codes))
    half = lambda x: (x["size"] + 1) / 2
    sums = {
        # Squares of the character counts: each character adds the number of its equals.
        "squares": lambda x: F.aggregate(
            F.array_distinct(x["codes"]),
            F.lit(0.0),
            lambda s, k: s + F.pow(F.size(F.filter(x["codes"], lambda c: c == k)).cast("double"), F.lit(2.0)),
        ),
        "runs": lambda x: _changes(x["codes"], lambda c: c > half(x)) + 1,
        "above": lambda x: F.size(F.filter(x["codes"], lambda c: c > half(x))).cast("double"),
        "products": lambda x: F.aggregate(
            F.zip_with(
                F.slice(x["codes"], 1, F.size(x["codes"]) - 1),
                F.slice(x["codes"], 2, F.size(x["codes"]) - 1),
                lambda a, b: (a - half(x)) * (b - half(x)),
            ),
            F.lit(0.0), lambda s, v: s + v,
        ),
        "odd": lambda x: _odd_pairs(x["bare"]),
    }
    df = df.withColumn(tokens, _add(tokens, **sums))
    df = df.withColumn(
        tokens,
        F.transform(
            tokens,
            lambda x: F.struct(
                *[x[c].alias(c) for c in ("start", "end", "kind", "n")],
                _chi_p(x).alias("chi_p"),
                _runs_p(x).alias("runs_p"),
                _serial_p(x).alias("serial_p"),
                _binomial_tail(
                    x["odd"], x["n"] - 1,
                    F.when(x["kind"] == "letters", WRITTEN_LETTERS).otherwise(WRITTEN_OTHERS),
                ).alias("written_p"),
            ),
        ),
    )
    return df.withColumn(tokens, _add(tokens, p=_combined_p))


def _combined_p(x: Column) -> Column:
    """The p-value as written text, divided by the one of all three tests as a random token (Bonferroni, at most 1)."""
    random = F.least(F.lit(1.0), 3 * F.least(x["chi_p"], x["runs_p"], x["serial_p"]))
    return F.when(random >= LEAST_RANDOM, F.least(F.lit(1.0), x["written_p"] / random)).otherwise(1.0)


def _binomial_tail(k: Column, n: Column, rate: Column) -> Column:
    """P(at least k of n), or a little more: Stirling's bound of P(k), and Feller's of the tail by it."""
    share = k / n
    distance = share * F.log(share / rate) + (1 - share) * F.log((1 - share) / (1 - rate))
    point = F.exp(-n * distance) * F.sqrt(n / (2 * math.pi * k * (n - k)))
    tail = point * (k + 1) * (1 - rate) / (k + 1 - (n + 1) * rate)
    return F.when(k <= n * rate, 1.0).when(k >= n, F.pow(rate, n)).otherwise(F.least(F.lit(1.0), tail))


def _chi_p(x: Column) -> Column:
    """Upper tail of chi-squared by the cube-root normal approximation."""
    df = x["size"] - 1
    chi = x["squares"] * x["size"] / x["n"] - x["n"]
    third = F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3))
    return _normal_tail((third - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))


def _runs_p(x: Column) -> Column:
    """Two-sided runs test; a token on one side of the middle only has no randomness to show."""
    a, n = x["above"], x["n"]
    both = 2 * a * (n - a)
    spread = F.sqrt(both * (both - n) / (n * n * (n - 1)))
    return F.when((a > 0) & (a < n) & (both > n), 2 * _normal_tail(F.abs(x["runs"] - both / n - 1) / spread)).otherwise(0.0)


def _serial_p(x: Column) -> Column:
    """Two-sided lag-one serial correlation about the middle of the alphabet."""
    variance = (x["size"] * x["size"] - 1) / 12
    return 2 * _normal_tail(F.abs(x["products"]) / (variance * F.sqrt(x["n"] - 1)))


def length_class(n: Column) -> Column:
    """0 for 20 to 31 characters, 1 below 64, 2 below 128, 3 for longer ones."""
    return F.when(n < 32, 0).when(n < 64, 1).when(n < 128, 2).otherwise(3)


def _p_bin(p: Column) -> Column:
    return F.when(p <= 0, P_BINS).otherwise(F.least(F.lit(P_BINS), F.floor(-10 * F.log10(p)))).cast("int")


def discovery_bins(df: DataFrame, tokens: str, rate: float = FALSE_DISCOVERY) -> dict[int, int]:
    """Least bin of -log10 p that is a discovery in each class of lengths (Benjamini-Hochberg).

    At most 4 x 401 counts leave the tasks, whatever the number of tokens; 4 numbers reach the driver.
    """
    one = df.select(F.explode(tokens).alias("x")).select(
        length_class(F.col("x.n")).alias("long"), _p_bin(F.col("x.p")).alias("bin")
    )
    counts = one.groupBy("long", "bin").count()
    falling = Window.partitionBy("long").orderBy(F.col("bin").desc())
    ranked = counts.withColumn("rank", F.sum("count").over(falling)).withColumn(
        "all", F.sum("count").over(Window.partitionBy("long"))
    )
    passed = F.pow(F.lit(10.0), -F.col("bin") / 10) <= rate * F.col("rank") / F.col("all")
    rows = ranked.where(passed).groupBy("long").agg(F.min("bin").alias("bin")).collect()
    return {r["long"]: r["bin"] for r in rows}


def base_spans(text: Column) -> Column:
    """All spans of the fixed patterns, by start and then by kind as listed."""
    every = F.concat(_spans(text, ASSIGN, "assign", 8), _spans(text, ACCESS, "access"), _spans(text, HEX, "hex"))
    return F.array_sort(
        F.transform(every, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    )


def scan(documents: DataFrame, rate: float = FALSE_DISCOVERY) -> DataFrame:
    """The documents with two more columns: ``secret_base`` and ``secret_random``, arrays of (start, kind, end)
    in code points, ``kind`` an index into KINDS. The base spans come first in time: the randomness tests add spans
    outside them and never take one away.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    tokens = F.transform(
        _spans(text, TOKEN, "random"),
        lambda x: F.struct(
            x["start"].alias("start"), x["end"].alias("end"),
            F.substring(text, x["start"].cast("int") + 1, (x["end"] - x["start"]).cast("int")).alias("token"),
        ),
    )
    found = documents.withColumn("secret_base", base_spans(text)).withColumn("__tokens", tokens)
    inside = lambda x: F.exists(
        "secret_base", lambda b: (b["start"] <= x["start"]) & (x["end"] <= b["end"])
    )
    found = found.withColumn("__tokens", F.filter("__tokens", lambda x: ~inside(x)))
    found = cut(with_randomness(found, "__tokens"))
    bins = discovery_bins(found, "__tokens", rate)

    def secret(x: Column) -> Column:
        least = F.lit(None).cast("int")
        for long, at in bins.items():
            least = F.when(length_class(x["n"]) == long, at).otherwise(least)
        return F.coalesce(_p_bin(x["p"]) >= least, F.lit(False))

    spans = F.transform(
        F.filter("__tokens", secret),
        lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end")),
    )
    return found.withColumn("secret_random", spans).drop("__tokens")


def redact(scanned: DataFrame, mark: str = "<SECRET>") -> DataFrame:
    """Put ``mark`` in place of every span, overlapping spans together; ``n_chars`` follows the new text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr("cast(array() as array<string>)").alias("kept"))

    def step(s: Column, x: Column) -> Column:
        gap = F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))
        kept = F.when(x["start"] >= s["at"], F.concat(s["kept"], F.array(gap))).otherwise(s["kept"])
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), kept.alias("kept"))

    spans = F.array_sort(F.concat("secret_base", "secret_random"))
    clean = F.aggregate(
        spans, zero, step,
        lambda s: F.array_join(F.concat(s["kept"], F.array(F.substring(text, (s["at"] + 1).cast("int"), F.length(text)))), mark),
    )
    clean = F.when(F.size(spans) > 0, clean).otherwise(F.col("text"))
    out = scanned.withColumn("text", clean).drop("secret_base", "secret_random")
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in out.columns else out
