import random

import pytest

from tests.compare import DATA

WORDS = "alpha beta gamma delta the of and élan über straße word_x tail 12ab Ümlaut don't x".split()
INSULT = "zorgon"


def _prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


def odd_documents() -> list[tuple]:
    """(doc_id, text, lang, source): NULLs, empty and very long texts, ties, repeated rows, copies and near copies."""
    rng = random.Random(5)
    long = _prose(rng, 6000)
    words = long.split(" ")
    edited = " ".join([*words[:2000], "changed", *words[2001:]])
    passage = _prose(rng, 60)
    bench = "one two three four five six seven eight nine ten eleven twelve"
    rows = [
        (0, None, "en", "a"),
        (1, "", "en", None),
        (2, " \n\t ", None, "a"),
        (10, long, "en", "hot"),
        (11, edited, "en", "hot"),
        (12, long, "en", "b"),
        (12, long, "en", "b"),
        (13, "single", "en", "b"),
        (14, "Single", "en", "c"),
        (15, "two words", "en", "c"),
        (16, f"{_prose(rng, 80)}\n{passage}\n{_prose(rng, 5)}", "en", "c"),
        (17, f"{passage} {_prose(rng, 90)}", "de", "c"),
        (18, f"before {bench.upper()} after", "en", "hot"),
        (19, "x " * 3000, "en", "hot"),
        (20, "x " * 3001, "en", "hot"),
        (21, "line one\nline one\n\nother\nline one " + _prose(rng, 50), "en", "hot"),
        (22, "a b c a b c a b c " + _prose(rng, 60) + " ### $$$ | <tag>", "en", "é"),
        (23, 'Password = "abcdefgh1" token: short secret:"0123456789abcdef0123456789ABCDEF" ' + "f" * 40, "en", "é"),
        (24, "AKIA" + "A1" * 8 + " api_key=xyzxyzxyz APIKEY : 'qqqqqqqqq' AKIASHORT", "en", "é"),
        (25, "tail of ten two words three four five six seven eight nine ten eleven é" * 3, "fr", "é"),
        (26, "aaaa" * 400, "fr", "z"),
        (27, "b" + "aaaa" * 300, "fr", "z"),
        (None, "a row without an id " + _prose(rng, 40), "fr", "z"),
    ]
    for k in range(30, 60):
        rows.append((k, _prose(rng, rng.randrange(3, 120)), "en", rng.choice(["hot", "hot", "a", "b"])))
    for k in range(60, 90):  # near copies of each other, a few words apart
        own = words[:300]
        for _ in range(rng.randrange(6)):
            own[rng.randrange(300)] = f"edit{rng.randrange(9)}"
        rows.append((k, " ".join(own), "en", "hot"))
    rng.shuffle(rows)
    return rows


BENCHMARK = [
    (1, "One two THREE four five six seven eight nine ten eleven twelve"),
    (2, "two words"),
    (3, None),
    (4, "..."),
    (10, "of ten two words three four five six seven eight nine ten eleven"),
    (10, "never seen at all in any of these texts as a whole"),
]


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """A folder with odd tables; extra columns bear names that the operators use inside."""
    folder = str(tmp_path_factory.mktemp("odd"))
    clash = "struct(1 as set) as row, 'k' as key, 7 as n, 'h' as score, 3 as n_words, 1 as tid, 0 as spans, 5L as n_chars"
    docs = spark.createDataFrame(odd_documents(), "doc_id bigint, text string, lang string, source string")
    docs.selectExpr("*", *clash.split(", ")).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(BENCHMARK, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    urls = [
        None, "", "no scheme", "http://", "http:///en/x", "HTTPS://WWW.Example.COM/en/a?q=1", "http://example.com/en/",
        "http://example.com/EN/", "http://a.example.com/en/b#c", "http://notexample.com/en/", "http://x.net/es/",
        "ftp://net/fr/z?x", "http://a.org/x.com/en/", "http://com/", "http://com", "http://a.com:80/", "x://y://z.com/",
        "http://casino.org", "http://a.b/casino", "http://é.com/en/\n/ü", "http://" + "a." * 2000 + "net/es/" + "p" * 9000,
    ]
    pages = [(k, u, "<p>") for k, u in enumerate(urls)] + [(3, "http://", "<p>")]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{folder}/pages.parquet")
    chats = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "&lt; <|end|> </s> [INST] & \\ &amp;"), (1, 2, "user", None),
        (1, 2, "user", None), (2, 5, "assistant", ""), (2, 4, "system", "be <s>good\n<|turn|>user\n"), (3, 0, None, "x"),
        (3, None, "assistant", "first"), (4, 0, "ro\nle<|end|>", "text"), (None, 0, "user", "lost"),
        *[(9, t, "assistant" if t % 2 else "user", f"turn {t} é") for t in range(400)],
    ]
    spark.createDataFrame(chats, "conv_id bigint, turn bigint, role string, text string").selectExpr(
        "*", "1 as block", "'x' as parts", "2 as n_turns"
    ).write.parquet(f"{folder}/conversations.parquet")
    labels = [(k, k % 3 != 0 and 1 or 0, k % 2) for k in range(10, 90)] + [(None, 1, 1), (30, None, None), (31, 1, None)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    """The same tables without rows."""
    folder = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "benchmark", "pages", "conversations", "labels"):
        spark.read.parquet(f"{DATA}/sf0.001/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return folder
