"""Spelling variants of a corpus' words, found in k-d trees over letter counts.

Words are points with one coordinate per letter. One replaced letter raises one coordinate by one and lowers another,
one inserted letter raises one: near words lie at an L1 distance of two at most. For each pair of lengths (equal ones, and
one with the next) the shorter words are searched in a tree over the longer ones. The search goes down the tree with the
steps that are left, up and down one coordinate each; a branch whose box lies further away is cut off. What it finds is
kept if the counts are that near and the letters also stand in the right order.

The upper part of a tree deals the work: its branches are fitted on a bounded sample of the words of a length
(``SAMPLED`` for each leaf, ``MOST_SAMPLED`` in all) and then hold all of them. A word goes to its own leaf, and as a query
to each leaf whose box is near enough. Leaves that come out larger than twice ``LEAF_WORDS`` are split by hash, with the
queries sent to each part. Each task builds the lower part over its leaf and lets the queries stream through.

Defined cases: NULL and empty texts have no words; repeated rows count each time; a NULL id is an empty string before
the colon of the checksum; very long runs are words like others; extra columns are ignored; without words no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightnet.llm.texts import as_arrow
from freightnet.scale import cut

LEAST_LETTERS, LEAST_COUNT = 6, 5
#: A form must occur so many times as often as the word.
TIMES = 5
#: Of the checksums one in so many takes a letter from its run.
SLIP = 199
LEAF_WORDS, SAMPLED, MOST_SAMPLED = 4096, 64, 100_000
#: Words in a leaf of the lower part, pairs compared at once.
LOCAL_LEAF, AT_ONCE = 12, 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ANY, _UNUSED, _FORBIDDEN = 90, -1, -2


def _coordinates(letters: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Counts by letter of words given as Latin-1 bytes, one behind the other."""
    at = np.where(letters >= 0xC0, letters.astype(np.int64) - 0xC0 + 26, letters.astype(np.int64) - 97)
    rows = np.repeat(np.arange(len(width)), width)
    counts = np.bincount(rows * _ANY + at, minlength=len(width) * _ANY)
    return counts.reshape(len(width), _ANY).astype(np.int32)


def points_of(words: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    return _coordinates(data, np.array([len(w) for w in words], np.int64))


class KdTree:
    """Binary tree over integer points: up to ``cut`` in coordinate ``axis`` to the left, above it to the right."""

    def __init__(self, points: np.ndarray, leaf: int) -> None:
        axis, cuts, left, right, members = [], [], [], [], []
        todo = [(np.arange(len(points)), -1, 0)]
        while todo:
            own, parent, side = todo.pop()
            node = len(axis)
            if parent >= 0:
                (right if side else left)[parent] = node
            axis.append(-1)
            cuts.append(0)
            left.append(-1)
            right.append(-1)
            members.append(own)
            if len(own) <= leaf:
                continue
            inside = points[own]
            best = int(inside.var(axis=0).argmax())
            values = inside[:, best]
            at = int(np.median(values))
            at = at if at < values.max() else at - 1
            if values.min() == values.max():
                continue  # equal points
            low = values <= at
            axis[node], cuts[node], members[node] = best, at, own[:0]
            todo += [(own[low], node, 0), (own[~low], node, 1)]
        self.axis, self.cuts = np.array(axis), np.array(cuts)
        self.left, self.right = np.array(left), np.array(right)
        leaves = np.flatnonzero(self.axis < 0)
        #: Leaves have numbers of their own.
        self.number = np.full(len(axis), -1)
        self.number[leaves] = np.arange(len(leaves))
        self.members = [members[k] for k in leaves]

    def search(self, points: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf number) for all leaves that may hold a point with one coordinate higher by one and, with
        ``lower``, another one lower by one; also those of the point itself."""
        query, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        up = np.full(len(points), _UNUSED)
        down = np.full(len(points), _UNUSED if lower else _FORBIDDEN)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(query):
            axis = self.axis[node]
            if (ended := axis < 0).any():
                done.append((query[ended], self.number[node[ended]]))
                query, node, up, down, axis = (x[~ended] for x in (query, node, up, down, axis))
            here = points[query, axis] + (up == axis) - (down == axis)
            cuts = self.cuts[node]
            rise = (here == cuts) & (up == _UNUSED) & (down != axis)
            fall = (here == cuts + 1) & (down == _UNUSED) & (up != axis)
            main = np.where(here <= cuts, self.left[node], self.right[node])
            query = np.concatenate([query, query[rise], query[fall]])
            node = np.concatenate([main, self.right[node[rise]], self.left[node[fall]]])
            up, down = (
                np.concatenate([up, axis[rise], up[fall]]),
                np.concatenate([down, down[rise], axis[fall]]),
            )
        if not done:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([x[0] for x in done]), np.concatenate([x[1] for x in done])


def signatures(points: np.ndarray) -> np.ndarray:
    """Two words of bits for each point: which letters it has, and which of a to z twice. One step along a coordinate
    changes one bit at most."""
    bits = np.zeros((len(points), 128), bool)
    bits[:, :_ANY] = points > 0
    bits[:, _ANY : _ANY + 26] = points[:, :26] > 1
    return np.packbits(bits, axis=1).view(np.uint64)


def _one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Rows of letters that differ by one replaced letter (equal widths) or one more letter in ``long``."""
    n = short.shape[1]
    same = short == long[:, :n]
    if long.shape[1] == n:
        return np.count_nonzero(~same, axis=1) == 1
    ahead = np.where(same.all(axis=1), n, same.argmin(axis=1))
    shifted = short == long[:, 1:]
    behind = np.where(shifted.all(axis=1), n, shifted[:, ::-1].argmin(axis=1))
    return ahead + behind >= n


def _letters(words: list[str]) -> np.ndarray:
    """Words of one length as a matrix of letters."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), len(words[0]))


class Leaf:
    """The words of a leaf, of one length, in a tree of their own."""

    def __init__(self, words: list[str], counts: list[int]) -> None:
        order = np.argsort(np.array([w.encode("latin-1") for w in words], object), kind="stable")
        self.words = [words[k] for k in order]
        self.counts = np.array(counts, np.int64)[order]
        self.points, self.letters = points_of(self.words), _letters(self.words)
        self.signs = signatures(self.points)
        self.tree = KdTree(self.points, LOCAL_LEAF)
        self.sizes = np.array([len(m) for m in self.tree.members])
        self.starts = np.append(0, np.cumsum(self.sizes))
        self.flat = np.concatenate(self.tree.members)

    def near(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(query, own word) pairs that are one edit apart; the queries have one length."""
        points, letters = points_of(words), _letters(words)
        equal = letters.shape[1] == self.letters.shape[1]
        signs, most = signatures(points), 2 if equal else 1
        query, leaf = self.tree.search(points, lower=equal)
        pairs = self.sizes[leaf]
        out = []
        bounds = np.append(0, np.cumsum(pairs))
        at = 0
        while at < len(query):
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + AT_ONCE, "right")) - 1)
            q = np.repeat(query[at:to], pairs[at:to])
            inside = np.arange(bounds[at], bounds[to]) - np.repeat(bounds[at:to], pairs[at:to])
            w = self.flat[np.repeat(self.starts[leaf[at:to]], pairs[at:to]) + inside]
            bits = np.bitwise_count(signs[q, 0] ^ self.signs[w, 0]) + np.bitwise_count(signs[q, 1] ^ self.signs[w, 1])
            q, w = q[bits <= most], w[bits <= most]
            fits = np.abs(points[q] - self.points[w]).sum(axis=1) <= most
            q, w = q[fits], w[fits]
            fits = _one_edit(letters[q], self.letters[w])
            out.append((q[fits], w[fits]))
            at = to
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def word_counts(documents: DataFrame, id_col: str) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    runs = F.regexp_extract_all("text", F.lit(f"[A-Za-zÀ-ÿ]{{{LEAST_LETTERS},}}"), F.lit(0))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    found = documents.select(key.alias("key"), F.col("text").cast("string").alias("text")).select("key", F.explode(runs).alias("run"))
    found = found.select("key", F.translate("run", _UPPER, _LOWER).alias("run"))
    found = found.withColumn("h", F.crc32(F.concat("key", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word: Column = F.when(F.col("h") % SLIP == 0, slipped).otherwise(F.col("run"))
    words = found.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.where((F.length("word") >= LEAST_LETTERS) & (F.col("n") >= LEAST_COUNT))


class Router:
    """Upper parts of the trees, by word length, and the parts of leaves that came out large."""

    def __init__(self, trees: dict[int, KdTree], parts: dict[tuple[int, int], int] | None = None) -> None:
        self.trees, self.parts = trees, parts or {}

    def leaves(self, size: int, points: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
        if size not in self.trees:
            return np.arange(len(points)), np.zeros(len(points), np.int64)
        return self.trees[size].search(points, lower)

    def own(self, size: int, points: np.ndarray) -> np.ndarray:
        """The leaf that holds each point."""
        if size not in self.trees:
            return np.zeros(len(points), np.int64)
        tree, node = self.trees[size], np.zeros(len(points), np.int64)
        while (inner := tree.axis[node] >= 0).any():
            here = points[np.arange(len(points)), np.maximum(tree.axis[node], 0)]
            onward = np.where(here <= tree.cuts[node], tree.left[node], tree.right[node])
            node = np.where(inner, onward, node)
        return tree.number[node]


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, list[str]]]:
    words = np.array(batch.column("word").to_pylist(), object)
    sizes = np.array([len(w) for w in words])
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield int(size), rows, list(words[rows])


def _fitted(words: DataFrame) -> Router:
    """Trees of the lengths that have more words than a leaf holds, on samples by hash."""
    sized = words.select("word", F.length("word").alias("size"))
    many = {r["size"]: r["count"] for r in sized.groupBy("size").count().where(F.col("count") > LEAF_WORDS).collect()}
    if not many:
        return Router({})
    share = min(SAMPLED / LEAF_WORDS, MOST_SAMPLED / sum(many.values()))
    chosen = F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(share * (1 << 30))
    by_size: dict[int, list[str]] = {size: [] for size in many}
    for r in sized.where(chosen & F.col("size").isin(list(many))).collect():
        by_size[r["size"]].append(r["word"])
    router = Router({size: KdTree(points_of(sorted(own)), SAMPLED) for size, own in by_size.items() if own})

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        size_of, leaf = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        for size, rows, own in _by_length(batch):
            size_of[rows], leaf[rows] = size, router.own(size, points_of(own))
        return pa.RecordBatch.from_arrays([pa.array(size_of), pa.array(leaf)], names=["size", "leaf"])

    placed = as_arrow(words.select("word"), place, "size bigint, leaf bigint")
    large = placed.groupBy("size", "leaf").count().where(F.col("count") > 2 * LEAF_WORDS).collect()
    return Router(router.trees, {(r["size"], r["leaf"]): -(-r["count"] // LEAF_WORDS) for r in large})


def _routed(words: DataFrame, router: Router) -> DataFrame:
    """(size, leaf, part, role, word, n): each word where it is held (role 0) and wherever it searches (1)."""

    def route(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes = batch.column("h").to_numpy(zero_copy_only=False)
        out: list[tuple[np.ndarray, ...]] = []
        for size, rows, own in _by_length(batch):
            points = points_of(own)
            for to, role in ((size, 0), (size, 1), (size + 1, 1)):
                if role:
                    q, leaf = router.leaves(to, points, lower=to == size)
                else:
                    q, leaf = np.arange(len(own)), router.own(to, points)
                parts = np.array([router.parts.get((to, int(x)), 1) for x in leaf], np.int64)
                if role:
                    part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                    q, leaf = np.repeat(q, parts), np.repeat(leaf, parts)
                else:
                    part = hashes[rows] % parts
                out.append((np.full(len(q), to), leaf, part, np.full(len(q), role), rows[q]))
        columns = [np.concatenate(x) for x in zip(*out)]
        at = pa.array(columns.pop())
        arrays = [*[pa.array(c.astype(np.int64)) for c in columns], batch.column("word").take(at), batch.column("n").take(at)]
        return pa.RecordBatch.from_arrays(arrays, names=["size", "leaf", "part", "role", "word", "n"])

    rows = words.select("word", "n", F.pmod(F.xxhash64("word"), F.lit(1 << 40)).alias("h"))
    return as_arrow(rows, route, "size bigint, leaf bigint, part bigint, role bigint, word string, n bigint")


def _found(words: list[str], counts: np.ndarray, own: np.ndarray, near: list[str], near_n: np.ndarray, other: np.ndarray):
    """For each word in a pair: itself, its number of near words, and the best of them."""
    order = np.lexsort((other, -near_n[other], own))
    own, other = own[order], other[order]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(own)))
    return [words[k] for k in own[first]], n, near_n[other[first]], [near[k] for k in other[first]]


def near_words(words: DataFrame, router: Router) -> DataFrame:
    """(word, n_near, best): the number of near words, and (-n, word) of the one that is most frequent, then first."""
    keys = ["size", "leaf", "part"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, leaf = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in (*keys, "role")]
            names, counts = batch.column("word").to_pylist(), batch.column("n").to_numpy(zero_copy_only=False)
            change = np.any([c[1:] != c[:-1] for c in columns], axis=0)
            cuts = np.concatenate([[0], np.flatnonzero(change) + 1, [batch.num_rows]])
            got: list[tuple] = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                key, role = tuple(int(c[a]) for c in columns[:3]), columns[3][a]
                if key != now:
                    now, held, leaf = key, [], None
                if role == 0:
                    held.append((names[a:b], counts[a:b]))
                elif held or leaf is not None:
                    if leaf is None:
                        leaf = Leaf([w for x, _ in held for w in x], [int(n) for _, x in held for n in x])
                        held = []
                    own = sorted(range(a, b), key=lambda k: names[k])
                    for size in sorted({len(names[k]) for k in own}):
                        part = [k for k in own if len(names[k]) == size]
                        queries, n = [names[k] for k in part], counts[part]
                        q, w = leaf.near(queries)
                        got.append(_found(queries, n, q, leaf.words, leaf.counts, w))
                        if size != now[0]:  # a shorter word is also near to each longer one that it found
                            got.append(_found(leaf.words, leaf.counts, w, queries, n, q))
            if got:
                flat = [w for g in got for w in g[0]], np.concatenate([g[1] for g in got])
                best = np.concatenate([g[2] for g in got]), [w for g in got for w in g[3]]
                arrays = [pa.array(flat[0], pa.string()), pa.array(flat[1].astype(np.int64))]
                arrays += [pa.array(-best[0].astype(np.int64)), pa.array(best[1], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=["word", "n_near", "less", "near"])

    dealt = _routed(words, router).repartition(*keys).sortWithinPartitions(*keys, "role")
    found = dealt.mapInArrow(search, "word string, n_near bigint, less bigint, near string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "near")).alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) by following (word, form); each round doubles the steps taken."""
    roots = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = cut(roots.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        roots = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            return roots


def spelling_variants(documents: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root."""
    words = cut(word_counts(documents, id_col))
    near = near_words(words, _fitted(words))
    enough = -F.col("best.less") >= TIMES * F.col("n")
    found = cut(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"),
        )
    )
    roots = _roots(found.where("form is not null"))
    return found.join(roots, "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")
    )
