"""Parts of the operators that the queries do not show."""

import os
import pathlib
import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from freightnet.llm import chat, decontaminate, jaccard, language, mixing, quality, repeats, rules, secrets, toxicity, urls
from freightnet.llm.decontaminate import TestSuffixes, _match_slice, find_contamination
from freightnet.llm.graph import components
from freightnet.llm.suffixes import permuted_common_prefixes, suffix_array
from freightnet.llm.texts import slices
from freightnet.scale import scratch
from tests.llm import brute


def test_glob_automaton_over_several_words():
    globs = ["a*c", "**x**y**", "*.com/**", "b" * 70 + "*", "", "*", "**"]
    texts = ["ac", "abbc", "a/c", "xy", "x/1/y!", "a.com/", "a.com/b/c", "b/.com/", "b" * 70, "b" * 71, "b" * 69, "", "é"]
    fits = urls.Automaton(globs).run(texts)
    for text, row in zip(texts, fits):
        for glob, got in zip(globs, row):
            import re

            pattern = re.escape(glob).replace(r"\*\*", "\0").replace(r"\*", "[^/]*").replace("\0", ".*")
            assert got == bool(re.fullmatch(pattern, text, re.S)), (glob, text)


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(1)
    for trial in range(150):
        text = rng.integers(0, rng.integers(1, 5), rng.integers(1, 50)).astype(np.uint8)
        text = np.tile(text, 3) if trial % 4 == 0 else text
        order = suffix_array(text)
        assert list(order) == sorted(range(len(text)), key=lambda i: text[i:].tobytes())
        shared = permuted_common_prefixes(text, order, 20)
        for a, b in zip(order[:-1], order[1:]):
            n = 0
            while n < 20 and max(a, b) + n < len(text) and text[a + n] == text[b + n]:
                n += 1
            assert shared[b] == n


def test_parts_become_placeholders(spark):
    parts = [
        ("text", "see & <|image|> ", None, None, None, None, None),
        ("image", None, "i.png", 56, 57, None, None),
        ("audio", None, "a.wav", None, None, 1.5, None),
        ("text", None, None, None, None, None, None),
        ("document", None, "d.pdf", None, None, None, 3),
        ("hologram", None, "h", None, None, None, None),
        (None, "!", None, None, None, None, None),
    ]
    rows = [(1, 1, "user", parts), (1, 0, "system", None), (1, 2, "assistant", [parts[0], parts[1]])]
    df = spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts array<{chat.PART}>")
    got = chat.format_chat(df).withColumn("back", chat.read_back("formatted")).withColumn("learnt", chat.under_loss()).first()
    found = [(a["kind"], a["ref"], a["tokens"]) for a in got["attachments"]]
    user = [("image", "i.png", 6), ("audio", "a.wav", 38), ("document", "d.pdf", 1536), ("document", "h", 512)]
    assert found == [*user, ("image", "i.png", 6)]
    for a in got["attachments"]:
        mark = chat.MARKS[a["kind"]]
        assert got["formatted"][a["at"] : a["at"] + len(mark)] == mark
    assert got["n_tokens"] == sum(t for _, _, t in found) and got["n_chars"] == len(got["formatted"])
    assert got["formatted"].count("<|image|>") == 2  # the one in the text is escaped
    assert [b["role"] for b in got["back"]] == ["system", "user", "assistant"]
    assert got["learnt"] == "see & <|image|> <|image|>"


def test_targets_are_reshared_until_none_is_above(spark):
    sizes = {"a": 10, "b": 1000, "c": 500, "d": 3, None: 40, "e": 0}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    from tests.llm.brute import targets

    want = targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-9 for s in want)
    assert abs(sum(got.values()) - sum(sizes.values())) < 1e-6


def test_mix_repeats_epochs(spark):
    rows = [(k, "w " * (k % 7), "small" if k < 5 else "big", "x") for k in range(200)] + [(3, "w w w", "small", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size string")
    got = mixing.mix_sources(df, weights=(1, 9)).collect()
    assert {r["epochs"] for r in got if r["source_size"] < 100} == {3}
    assert len(got) == 201


def test_random_tokens_are_found_and_words_are_not(spark):
    rng = random.Random(1)
    letters = secrets.ALPHABETS["base62"]
    token = lambda n: "".join(rng.choice(letters) for _ in range(n))
    words = ["donaudampfschifffahrtsgesellschaft", "internationalization-of-everything", "a" * 40, "0123456789" * 4]
    docs = [(k, f"key {token(40)} and {rng.choice(words)} end") for k in range(30)] + [(99, " ".join(words)), (98, None)]
    got = secrets.scan(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    hits = 0
    for r in got:
        for s in r["secret_random"]:
            assert (s["start"], s["end"]) == (4, 44) and r["doc_id"] < 30
            hits += 1
    assert hits >= 28


def test_rare_tokens_of_one_class_are_found(spark):
    """Planted tokens of digits, of letters of one case and in base32, each 1 in 1000 words of its class of lengths; digits
    from 32 on are found as hex. Numbers that people write are left."""
    rng = random.Random(6)
    parts = "schiff fahrt land haus nation ation inter ment able over under stand work zeit gesell schaft ville port".split()
    word = lambda: "".join(rng.choice(parts) for _ in range(12))[: rng.randrange(20, 44)]
    written = ["2024013123595920240131", "1234567890" * 3, "0" * 24 + "4711", "192837465" * 3, "qwxzk" * 8, "AAAABBBB" * 5]
    words = [word() for _ in range(18_000 - len(written))] + written
    rng.shuffle(words)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", secrets.ALPHABETS["base32"]]
    docs = [(k, " ".join(words[k * 10 : k * 10 + 10])) for k in range(1800)]
    planted = {}
    for k in range(17):
        letters, size = ("0123456789", 31) if k % 2 else (alphabets[k // 2 % 3], 56)
        text = docs[k * 100][1]
        planted[k * 100, len(text) + 1, len(text) + 1 + size] = size
        docs[k * 100] = (k * 100, f"{text} {''.join(rng.choice(letters) for _ in range(size))}")
    found = secrets.scan(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4))
    got = {(r["doc_id"], s["start"], s["end"]) for r in found.collect() for s in r["secret_random"]}
    hits = Counter(planted[x] for x in got)
    assert got <= set(planted) and hits[56] == 9 and hits[31] >= 4


def test_redaction_joins_overlapping_spans(spark):
    text = 'é token = "' + "0123456789abcdef" * 3 + '" end ' + "ab" * 20
    docs = [(1, text, 0, "x"), (2, None, 0, "x"), (3, "clean", 0, "x"), (1, text, 0, "x")]
    scanned = secrets.scan(spark.createDataFrame(docs, "doc_id bigint, text string, n_chars bigint, kind string"))
    got = Counter(tuple(r) for r in secrets.redact(scanned).collect())
    mark = 'é <SECRET>" end <SECRET>'
    assert got == Counter({(1, mark, len(mark), "x"): 2, (2, None, None, "x"): 1, (3, "clean", 5, "x"): 1})


def test_rules_learn_from_votes(spark):
    """Votes drawn from known accuracies: the estimate finds the good documents."""
    rng = random.Random(2)
    rows = []
    for k in range(4000):
        good = rng.random() < 0.8
        cast = [0 if rng.random() < 0.2 else (1 if (rng.random() < a) == good else -1) for a in (0.95, 0.9, 0.85, 0.9)]
        rows.append((good, cast))
    df = spark.createDataFrame(rows, "good boolean, votes array<int>")
    prior, *sides = rules.fit(df.groupBy("votes").agg(F.count("*").alias("n")), 4)
    good, bad = (F.array(*[F.array(*[F.lit(x) for x in row]) for row in side]) for side in sides)
    p = rules.posterior(F.lit(prior), good, bad, F.col("votes"))
    right = df.where((p >= 0.5) == F.col("good")).count() / len(rows)
    assert right > 0.93
    assert rules.fit(df.limit(0).groupBy("votes").agg(F.count("*").alias("n")), 4)[0] > 0


def test_matches_have_places(spark):
    items = [("q", "a b c d e f g h i j k l")]
    docs = [(1, "x a b c d e f g h i j k l y a b c d e f g h i j")]
    schema = "doc_id bigint, text string"
    found = find_contamination(
        spark.createDataFrame(docs, schema), spark.createDataFrame(items, "item_id string, text string"), block_words=2
    ).first()
    places = sorted((m["at"], m["item_at"], m["words"]) for m in found["matches"])
    assert places == [(1, 0, 12), (14, 0, 10)] and found["n_hit"] == 22


def test_search_against_all_windows():
    for seed in range(40):
        rng = random.Random(seed)
        letters, window = "abcdefgh"[: rng.choice([1, 2, 3, 8])], rng.choice([2, 4])
        items = [(str(k), " ".join(rng.choice(letters) for _ in range(rng.randrange(0, 14)))) for k in range(rng.randrange(0, 12))]
        texts = [" ".join(rng.choice(letters + "z") for _ in range(rng.randrange(0, 40))) for _ in range(12)]
        part = next(slices(pa.array(texts)))
        bounds, found, (at, item, item_at, words) = _match_slice(part, TestSuffixes(items, window=window))
        rows = np.searchsorted(bounds, at, "right") - 1
        got = [(int(r), int(a), int(n)) for r, a, n in zip(rows, at - bounds[rows], words)]
        for (row, a, n), i, p in zip(got, item, item_at):
            assert texts[row].split()[a : a + n] == items[i][1].split()[p : p + n]
        want, named = [], {}
        for row, text in enumerate(texts):
            reach, text = -1, text.split()
            for a in range(len(text)):
                longest = 0
                for k, (_, q) in enumerate(items):
                    q = q.split()
                    for p in range(len(q)):
                        both = zip(text[a:], q[p:])
                        n = next((n for n, (x, y) in enumerate(both) if x != y), min(len(text) - a, len(q) - p))
                        if n >= window or (len(q) < window and n == len(q)):
                            longest = max(longest, n)
                            named.setdefault(row, set()).add(k)
                if longest and a + longest > reach:
                    want.append((row, a, longest))
                    reach = a + longest
        assert got == want
        assert {row: set(own.tolist()) for row, own in found} == named


def test_repeated_words_do_not_multiply():
    tests = TestSuffixes([("q", " ".join(["a"] * 2000)), ("r", " ".join(["a"] * 30))])
    part = next(slices(pa.array([" ".join(["a"] * 200_000)])))
    ids = tests.known(part.hashes(*part.words(decontaminate.WORD_BY_LETTER)[:2]))
    at, found, _ = tests.search(ids, np.array([0, len(ids)]))
    assert len(at) == 200_000 - 9 and set(found) == {0}
    _, items, (at, _, _, words) = _match_slice(part, tests)
    assert [(row, own.tolist()) for row, own in items] == [(0, [0, 1])]
    assert len(at) == 198_001 and set(words) == {2000}


def test_components_of_paths_and_hubs(spark):
    links = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{k: 100 for k in range(100, 140)}, 200: 200, 201: 200}


def test_tree_loses_no_pair():
    rng = np.random.default_rng(3)
    base = [np.unique(rng.integers(0, 2**63, 60, dtype=np.uint64)) for _ in range(12)]
    sets = []
    for k in range(300):
        own = base[k % 12].copy()
        own[rng.integers(0, len(own), rng.integers(0, 5))] = rng.integers(0, 2**63, 1, dtype=np.uint64)
        sets.append(np.unique(own))
    places = jaccard.Places(
        np.array([jaccard.point(s) for s in sets]),
        np.array([jaccard.digest(s).tobytes() for s in sets], object),
        np.array([len(s) for s in sets]),
    )
    pairs = lambda tree: {tuple(sorted(x)) for p, q, _ in tree.pairs(90) for x in zip(p.tolist(), q.tolist())}
    found = pairs(jaccard.Tree(places))
    groups = rng.integers(0, 4, 300)
    assert pairs(jaccard.Tree(places, groups)) == {(a, b) for a, b in found if groups[a] != groups[b]}
    for i in range(300):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                assert (j, i) in found
                assert set(jaccard.keys(sets[i], 90)) & set(jaccard.keys(sets[j], 90)) or set(sets[i]) == set(sets[j])


def test_gradient_of_the_network():
    rng = np.random.default_rng(2)
    s, d = toxicity.STATES, toxicity.INPUTS
    w = {k: rng.normal(0, 0.4, (d, 3 * s)) for k in ("in_f", "in_b")}
    w |= {k: rng.normal(0, 0.4, (s, 3 * s)) for k in ("rec_f", "rec_b")} | {k: rng.normal(0, 0.1, 3 * s) for k in ("bias_f", "bias_b")}
    w |= {"attend": rng.normal(0, 0.5, 2 * s), "out": rng.normal(0, 0.5, 2 * s), "bias": rng.normal(0, 0.1, 1)}
    net = toxicity.Network(w)
    x, ids = rng.normal(0, 1, (7, d)), rng.integers(0, 7, (5, 4))
    live = np.arange(5)[:, None] < np.array([5, 3, 1, 4])
    y, weight = np.array([1.0, 0, 1, 0]), np.array([1.0, 2, 0.5, 1])
    _, grads, dx = net.gradient(x, ids, live, y, weight)
    for name, array, g in [*((k, w[k], grads[k]) for k in grads), ("x", x, dx)]:
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in array.shape)
            old, out = array[at], []
            for step in (1e-5, -1e-5):
                array[at] = old + step
                out.append(net.gradient(x, ids, live, y, weight)[0])
            array[at] = old
            assert (out[0] - out[1]) / 2e-5 == pytest.approx(g[at], rel=1e-4, abs=1e-7), name


def _insulting(rng, n, words):
    text = [rng.choice(words) for _ in range(n)]
    for k in rng.sample(range(n), 3):
        text[k] = "zorgon" + rng.choice("abc")
    return " ".join(text)


def test_network_finds_passages_in_long_texts():
    rng = random.Random(8)
    words = [a + b + c for a in "ptk" for b in "aeiou" for c in ("la", "mi", "n")]
    clean = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(5, 300)))
    texts = [clean() for _ in range(200)] + [_insulting(rng, rng.randrange(20, 300), words) for _ in range(60)]
    net = toxicity.train(texts, [0] * 200 + [1] * 60, rounds=4)
    long = " ".join(clean() for _ in range(40)) + " " + _insulting(rng, 100, words) + " " + " ".join(clean() for _ in range(20))
    held = [clean() for _ in range(50)] + ["", "ta"] + [_insulting(rng, 150, words) for _ in range(20)] + [long]
    score = np.concatenate([net.score_texts(p) for p in slices(pa.array(held))])
    assert (score[:52] < 0.5).all() and (score[52:] >= 0.5).mean() > 0.9 and score[-1] >= 0.5
    assert net.score_texts(next(slices(pa.array([long]))))[0] == pytest.approx(score[-1])


def test_windows_cover_and_overlap():
    bounds = np.array([0, 0, 1, 129, 129 + 400])
    text, at, size = toxicity.windows(bounds)
    assert set(text) == {1, 2, 3}
    for t in (1, 2, 3):
        mine = [(a, a + s) for x, a, s in zip(text, at, size) if x == t]
        assert mine[0][0] == bounds[t] and max(b for _, b in mine) == bounds[t + 1]
        assert all(b[0] < a[1] for a, b in zip(mine[:-1], mine[1:]))


def test_ordered_grades():
    rng = random.Random(3)
    vocabulary = {0: ["bad", "worse", "poor"], 1: ["fair", "so", "mid"], 2: ["good", "great", "fine"]}
    texts, grades = [], []
    for _ in range(600):
        g = rng.randrange(3)
        texts.append(" ".join(rng.choice(vocabulary[g] + ["the", "of"]) for _ in range(20)))
        grades.append(g)
    model = quality.train(texts, grades, 3)
    assert (np.diff(model.thresholds) > 0).all()
    tail = model.at_least(next(slices(pa.array(["bad poor worse the", "fair mid so of", "good great the", ""]))))
    assert (tail[:, 0] >= tail[:, 1]).all()
    expected = tail.sum(axis=1)
    assert expected[0] < expected[1] < expected[2]
    assert quality.train([], [], 3).at_least(next(slices(pa.array(["x"]))))[0].tolist() == pytest.approx([1, 1])
    assert quality.train(["a"], [0], 3).at_least(next(slices(pa.array(["x"]))))[0].tolist() == pytest.approx([0, 0])


def _tables(folder):
    """Columns of every table that lies in a folder."""
    written = {f.parent: f for f in pathlib.Path(folder).glob("*/*.parquet")}
    return [set(pq.read_schema(f).names) for f in written.values()]


def test_near_copies_leave_no_keys(spark):
    """No table of keys, points or shingles stays behind."""
    words = [f"w{k}" for k in range(12)]
    rows = [(k, " ".join([*words, *["more"] * (k % 2)])) for k in range(4)] + [(90, None), (91, "alone")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    with scratch(spark) as folder:
        assert {r["component_id"] for r in jaccard.link_documents(docs, 5, 80).collect()} == {0, 90, 91}
        assert not any({"keys", "point", "found", "key"} & names for names in _tables(folder.removeprefix("file:")))


def test_search_rounds_change_no_pair(spark, monkeypatch):
    sets = [np.arange(40, dtype=np.uint64) * np.uint64(2**57 + 12345) + np.uint64(k // 2) for k in range(6)]
    points = [(k, len(s), jaccard.point(s).tolist(), bytearray(jaccard.digest(s).tobytes())) for k, s in enumerate(sets)]
    points = spark.createDataFrame(points, "set bigint, n bigint, point array<int>, digest binary")
    known = spark.createDataFrame([(key, k, k) for key in range(4) for k in range(6)], "key bigint, set bigint, component bigint")
    want = sorted(map(tuple, jaccard._searched(known.join(points, "set"), 80).collect()))
    searched, search = [], jaccard._searched
    monkeypatch.setattr(jaccard, "_searched", lambda *args: searched.append(1) or search(*args))
    monkeypatch.setattr(jaccard, "ROWS_A_TEXT", 2)
    got = sorted(map(tuple, jaccard._search_rounds(known, points, 6, 80, False).collect()))
    assert got == want != [] and len(searched) == 2


def test_pairs_are_answered_in_rounds_before_words(spark, monkeypatch):
    """The counts of pairs are gone when the words are answered."""
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice("a b c d e f g h".split()) for _ in range(30))) for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(2)
    seen, pairs, word = [], language._pair_answers, language._word_answers

    def pairs_answered(counts, *args):
        seen.append([f.removeprefix("file://") for f in counts.inputFiles()])
        return pairs(counts, *args)

    def words_answered(*args):
        assert seen and not any(os.path.exists(f) for files in seen for f in files)
        return word(*args)

    monkeypatch.setattr(language, "_pair_answers", pairs_answered)
    monkeypatch.setattr(language, "_word_answers", words_answered)
    assert language.score_documents(docs, F.col("doc_id") == 0).where("score < 0").count() == 8
    assert len(seen) == language.ANSWER_ROUNDS > 1


def test_a_shared_passage_sends_few_pieces(spark):
    """Strings inside a passage that all texts share go to its shards once a slice, not once a text."""
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = letters(2000)
    docs = [(k, letters(40) + passage + letters(40)) for k in range(200)]
    texts = spark.createDataFrame(docs, "tid bigint, text string").coalesce(1)
    texts = texts.withColumn("first", F.col("tid")).join(repeats._shared_anchors(texts, 1, 50), "tid").coalesce(1)
    pieces = repeats._pieces(texts, 1, 50).collect()
    assert 0 < sum(len(r["bytes"]) for r in pieces) < 50 * len(passage)  # at the edges of the passage each text has a piece of its own
    got = repeats.remove_repeats(spark.createDataFrame(docs, "doc_id bigint, text string"))
    got = {(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got.collect()}
    assert got == set(brute.without_repeats(docs))


def test_anchors_tell_which_strings_name_them():
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("ab "), n)) for n in (0, 49, 50, 51, 130, 400)] + ["a" * 90]
    (part,) = slices(pa.array(texts))
    text, at, h, reach = repeats.anchors(part)
    named = sorted((int(t), int(w)) for t, a, f, e in zip(text, at, *reach.astype(int)) for w in range(a - f, a - e + 1))
    assert named == [(t, w) for t, x in enumerate(texts) for w in range(len(x) - 49)]
    by = {(int(t), int(w)): int(x) for t, a, x, f, e in zip(text, at, h, *reach.astype(int)) for w in range(a - f, a - e + 1)}
    strings = {}
    for (t, w), x in by.items():
        assert strings.setdefault(texts[t][w : w + 50], x) == x


def test_points_and_digests_travel_in_few_bytes():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 2, 63, 64, 65, 300, 1000, 20_000)]
    sets += [np.unique(np.append(s[: -len(s) // 9], rng.integers(0, 2**63, len(s) // 9, dtype=np.uint64))) for s in sets[2:]]
    for s in sets:
        assert len(jaccard.point_bytes(s)) + jaccard.digest(s).nbytes <= 72 + len(s) // 2 + 64 * (len(s) > 10_000)
    blobs = pa.array([jaccard.point_bytes(s) for s in sets], pa.binary())
    assert (jaccard._points(blobs) == np.array([jaccard.point(s) for s in sets])).all()
    digests = np.array([jaccard.digest(s).tobytes() for s in sets], object)
    for k, s in enumerate(sets):
        differ = jaccard._differ(np.array([digests[k]] * len(sets), object), digests)
        for other, d in zip(sets, differ):
            assert d <= len(np.setxor1d(s, other))
            assert (d == 0) == (other is s) or len(other) < 3


def _places(sets, fold=None):
    """Points, digests and sizes of sets; folded by a function from columns to columns."""
    columns = [pa.array([jaccard.point_bytes(x) for x in sets], pa.binary()), pa.array([jaccard.digest(x).tobytes() for x in sets])]
    names = ["set", "n", "point", "digest"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sets))), pa.array([len(x) for x in sets]), *columns], names=names)
    return jaccard.Places.of(fold(batch), dimensions=jaccard.FEW_DIMENSIONS) if fold else jaccard.Places.of(batch)


@pytest.mark.parametrize("share", [80, 90])
def test_sets_that_fall_short_of_a_link_are_no_candidates(share):
    """Of a group of sets that all have much in common, but not enough, next to no pair is left to verify."""
    rng = np.random.default_rng(share)
    new = lambda n: rng.integers(0, 2**63, n, dtype=np.uint64)
    common = new(300)
    # 300 shingles in common and as many own ones as make each pair similar by six hundredths less than a link.
    own = round(300 * (100 / (share - 6) - 1) / 2)
    sets = [np.unique(np.append(common, new(own))) for _ in range(60)]
    assert sum(len(p) for p, _, _ in jaccard.Tree(_places(sets)).pairs(share)) <= 0.01 * 60 * 59 / 2


@pytest.mark.parametrize("share", [80, 90])
@pytest.mark.parametrize("n", [1, 6, 40, 300, 3000, 20_000])
def test_folded_points_lose_no_link(share, n, monkeypatch):
    rng = np.random.default_rng(n)
    new = lambda n: np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
    sets = [new(n) for _ in range(20)]
    sets += [x[rng.permutation(len(x))[: -(-share * len(x) // 100)]] for x in sets]
    sets = [np.sort(x) for x in sets]
    monkeypatch.setattr(jaccard, "as_arrow", lambda df, fold, schema: fold)
    full, folded = _places(sets), _places(sets, jaccard._folded(SimpleNamespace(select=lambda *names: None), share))
    assert sum(map(len, folded.digests)) <= sum(map(len, full.digests)) and folded.points.shape[1] < full.points.shape[1]
    found = {tuple(sorted(x)) for p, q, _ in jaccard.Tree(folded).pairs(share) for x in zip(p.tolist(), q.tolist())}
    assert found >= {(k, k + 20) for k in range(20)}
    assert n < 40 or len(found) <= 30  # sets with nothing in common are told apart


def test_sets_that_meet_by_chance_are_not_searched(spark, monkeypatch):
    """Texts that have a phrase in common share keys; next to only those that are near another go on with whole
    points."""
    rng = random.Random(9)
    phrase = " ".join(f"p{k}" for k in range(30))
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    rows = [(k, f"{text(40)} {phrase} {text(40)}") for k in range(60)]
    start = text(100)  # 100 and 102 link through 101 only
    rows += [(100 + k, " ".join([*(f"x{j}" for j in range(18 * k)), phrase, start])) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    sent, searched = [], jaccard._searched

    def search(rows, share, nearest, *dimensions):
        if dimensions in ((), (jaccard.DIMENSIONS,)):
            sent.append(rows.select("set").distinct().count())
        return searched(rows, share, nearest, *dimensions)

    monkeypatch.setattr(jaccard, "_searched", search)
    monkeypatch.setattr(jaccard, "_bounded", lambda pairs, *args: pairs.where("false"))  # all is left to the searches
    got = {r["doc_id"]: r["component_id"] for r in jaccard.link_documents(docs, 5, 80).collect()}
    assert got == {**{k: k for k in range(60)}, 100: 100, 101: 100, 102: 100}
    assert sent and max(sent) <= 6


def test_only_new_links_are_followed(spark, monkeypatch):
    """Components are found again only when a search has found links, and not from all links that were there before."""
    words = [f"w{k}" for k in range(60)]
    docs = [(k, " ".join(words[: 60 - k % 2])) for k in range(20)] + [(99, "alone it is")]
    calls, found = [], jaccard.components
    monkeypatch.setattr(jaccard, "components", lambda links: calls.append(links.count()) or found(links))
    docs = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)
    assert {r["component_id"] for r in jaccard.link_documents(docs, 5, 80).collect()} == {0, 99}
    assert len(calls) == 1


def test_numbers_pack_small_and_come_back():
    rng = np.random.default_rng(6)
    for kind in (np.int32, np.int64, np.uint64, np.float32, np.float64):
        for n in (0, 1, 1000):
            values = rng.integers(0, 2**20, n).astype(kind)
            assert (language.unpack(language.pack(values), kind) == values).all()
    assert len(language.pack(rng.integers(0, 2**16, 20_000))) < 2.1 * 20_000


def test_slices_have_their_words_in_order(spark):
    """So that the pairs of a slice ascend in their buckets, by small steps."""
    rng = random.Random(9)
    docs = [(k, " ".join(f"w{rng.randrange(300)}" for _ in range(100))) for k in range(20)]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)
    sliced = language._sliced(docs, F.lit(False), "doc_id")
    known = language._numbered(sliced, language._word_counts(language._word_asks(sliced, 4), 4), 4)
    (row,) = known.collect()
    numbers, counts = language.unpack(row["b"], np.int64).reshape(2, -1)
    assert (np.diff(numbers) > 0).all() and counts.sum() == 20 * 101
    tokens = language.unpack(row["a"], np.int32)
    assert (np.bincount(tokens, minlength=len(numbers)) == counts).all()
    (pairs,) = language._pair_counts(language._pair_asks(known, 1)).collect()
    ((number, at),) = language._asked(pairs["d"])
    first = language._Pairs(tokens, numbers, language.unpack(row["c"], np.int64)).u
    assert number == row["key"] and (np.diff(at)[first[1:] >= 0] > 0).all()
