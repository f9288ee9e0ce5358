"""Benchmark decontamination with suffix arrays over the words of the training texts.

A slice of whole texts is a shard. Its suffix array holds the word positions at which a match can begin: only words of
the benchmark's own vocabulary, in unbroken runs as long as the shortest possible match. Suffixes are sorted by as many
words as a window has, and every distinct window of the test suffixes is looked up by binary search. Where one is found,
the test suffixes that begin with it are searched for the longest verbatim match from there. Texts never leave their
task, so nothing is shuffled and a passage that a third of all texts share costs no more than any other; nor do repeated
words multiply: a word position has as many windows as there are lengths of windows.

The benchmark is the stated query set. It travels in blocks of at most ``block_words`` words; each block is one pass
over the texts in the same stage, so that no broadcast grows with the benchmark.

Defined cases: a NULL or empty text has no words and no match; a NULL item id is named ``""``; items without words never
occur; items that repeat an id count once; repeated rows give repeated results; all other columns travel inside one struct, so
that none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightnet.llm.texts import WORD_BY_LETTER, Slice, as_arrow, mix, slices, small_batches

_BASE = np.uint64(0x9E3779B97F4A7C15)
WINDOW = 10
BLOCK_WORDS = 2_000_000
MATCH = "array<struct<item_id:string,item_at:bigint,at:bigint,words:bigint>>"
_MATCH = pa.list_(
    pa.struct([("item_id", pa.string()), ("item_at", pa.int64()), ("at", pa.int64()), ("words", pa.int64())])
)


def _keys(ids: np.ndarray, at: np.ndarray, length: np.ndarray, window: int) -> np.ndarray:
    """Byte strings that sort like the first ``window`` words from each position, zeros beyond ``length``."""
    steps = np.arange(window)
    held = steps[None, :] < length[:, None]
    matrix = np.where(held, ids[np.minimum(at[:, None] + steps, len(ids) - 1)], 0).astype(">u4")
    return np.ascontiguousarray(matrix).view(f"S{4 * window}").ravel()


def _ranked(ids: np.ndarray, longest: int) -> np.ndarray:
    """Rank of the suffix at each place, by its first ``longest`` words at least; ranks of doubled prefixes."""
    rank, step = ids, 1
    while step < longest:
        ahead = np.append(rank[step:], np.zeros(min(step, len(rank)), np.int64))
        found, rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + ahead, return_inverse=True)
        if len(found) == len(ids):
            break
        rank, step = rank + 1, 2 * step
    return rank


def _sums(ids: np.ndarray) -> np.ndarray:
    """Sums that ``_same`` compares: of the words so far, each times a power of the base by its place."""
    up = np.full(len(ids), _BASE)
    up[:1] = 1
    return np.append(np.zeros(1, np.uint64), np.cumsum(mix(ids.astype(np.uint64) + np.uint64(1)) * np.multiply.accumulate(up)))


def _same(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, words: np.ndarray, up: np.ndarray) -> np.ndarray:
    """Whether so many words from place i of one array are those from place j of another, by their sums."""
    return (a[i + words] - a[i]) * up[np.maximum(j - i, 0)] == (b[j + words] - b[j]) * up[np.maximum(i - j, 0)]


class TestSuffixes:
    """The suffixes of a block of benchmark items, in order. Equal windows are one, with all items that have it, so that
    what a text is compared with does not grow with repetition in the items or in the text."""

    __test__ = False

    def __init__(self, items: Sequence[tuple[str, str]], window: int = WINDOW) -> None:
        self.window = window
        self.names = [name for name, _ in items]
        hashed: list[np.ndarray] = []
        for part in slices(pa.array([text for _, text in items], pa.string())):
            first, last, bounds = part.words(WORD_BY_LETTER)
            hashed += np.split(part.hashes(first, last), bounds[1:-1])
        self.vocabulary = np.unique(np.concatenate(hashed)) if hashed else np.zeros(0, np.uint64)
        top = np.zeros(1 << 16, bool)
        top[self.vocabulary >> np.uint64(48)] = True
        self.top = top
        sizes = np.array([len(h) for h in hashed], np.int64)
        # Items one behind the other, each ended by the number of no word.
        begin = np.cumsum(sizes + 1) - (sizes + 1)
        self.ids = np.zeros(int((sizes + 1).sum()) + 1, np.int64)
        if hashed:
            self.ids[np.arange(sizes.sum()) + np.repeat(np.arange(len(sizes)), sizes)] = self.known(np.concatenate(hashed))
        self.sums = _sums(self.ids)
        # A suffix for each whole window; one for all of a shorter item.
        count = np.where(sizes >= window, sizes - window + 1, np.minimum(sizes, 1))
        item = np.repeat(np.arange(len(sizes)), count)
        item_at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = begin[item] + item_at
        keys = _keys(self.ids, at, np.minimum(sizes[item], window), window)
        rank = _ranked(self.ids, int(sizes.max(initial=0)))
        order = np.lexsort((item, rank[at], keys))
        self.item, self.item_at, self.at = item[order], item_at[order], at[order]
        self.left = sizes[self.item] - self.item_at  # words to the end of the item
        keys = keys[order]
        #: Distinct windows: their first suffix in the order, and the one beyond their last.
        self.begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        self.end = np.append(self.begin[1:], len(keys))[: len(self.begin)]
        self.keys = keys[self.begin]
        self.length = np.minimum(self.left[self.begin], window)
        self.first = self.ids[self.at[self.begin]]
        self.short_first = np.zeros(len(self.vocabulary) + 1, bool)
        self.short_first[self.first[self.length < window]] = True
        self.shortest = int(self.length.min()) if len(self.length) else window
        # Windows of one and the same set of items are of one class.
        which = np.repeat(np.arange(len(self.begin)), self.end - self.begin)
        pairs = np.unique(np.stack([which, self.item], axis=1), axis=0)
        mark = np.zeros(len(self.begin), np.uint64)
        np.add.at(mark, pairs[:, 0], mix(pairs[:, 1].astype(np.uint64) + np.uint64(1)))
        _, some, self.kind = np.unique(mark, return_index=True, return_inverse=True)
        low, high = np.searchsorted(pairs[:, 0], some, "left"), np.searchsorted(pairs[:, 0], some, "right")
        self.items_of = [pairs[a:b, 1] for a, b in zip(low, high)]

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """1-based rank of each word in the vocabulary, 0 for other words."""
        out = np.zeros(len(hashes), np.int64)
        if len(self.vocabulary):
            maybe = np.flatnonzero(self.top[hashes >> np.uint64(48)])
            rank = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
            out[maybe] = np.where(self.vocabulary[rank] == hashes[maybe], rank + 1, 0)
        return out

    def search(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word position, distinct window) of every occurrence in a shard of texts, split at ``bounds``, and the known
        words from each position on. A position has one whole window at most, and one shorter one of each length."""
        n = len(ids)
        stop = ids == 0
        # Words up to the next unknown word or the end of the text.
        limit = np.full(n + 1, n)
        limit[:-1][stop] = np.flatnonzero(stop)
        limit[bounds] = bounds
        ahead = np.minimum.accumulate(limit[::-1])[::-1]
        following = np.append(ahead[1:], n)[:n]  # a text begins at its own bound: look past it
        run = np.where(stop, 0, following - np.arange(n))
        at = np.flatnonzero((run >= self.window) | ((run >= self.shortest) & self.short_first[ids]))
        if not len(at) or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), run
        keys = _keys(ids, at, np.minimum(run[at], self.window), self.window)
        order = np.argsort(keys, kind="stable")  # the suffix array of the shard
        keys, at = keys[order], at[order]
        seen = np.zeros(len(self.vocabulary) + 1, bool)
        seen[ids[at]] = True
        test = np.flatnonzero(seen[self.first])
        low = np.searchsorted(keys, self.keys[test], "left")
        # All suffixes that begin with the (maybe shorter) test suffix.
        above = self.keys[test].copy().view(np.uint8).reshape(len(test), 4 * self.window)
        above[np.arange(4 * self.window)[None, :] >= 4 * self.length[test][:, None]] = 255
        high = np.searchsorted(keys, above.view(f"S{4 * self.window}").ravel(), "right")
        found = high - low
        suffix = np.repeat(test, found)
        place = np.arange(found.sum()) - np.repeat(np.cumsum(found) - found, found) + np.repeat(low, found)
        return at[place], suffix, run

    def longest(self, ids: np.ndarray, at: np.ndarray, found: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, ...]:
        """The longest verbatim match from each word position that has a window, those inside the one before left out:
        word position, item, position in it, words.

        The suffixes that begin with the window are in order: the place of the text among them is searched by halves, and
        one of the two neighbours there has most words in common with it."""
        if not len(at):
            return (np.zeros(0, np.int64),) * 4
        ids = np.append(ids, 0)
        sums = _sums(ids)
        up = np.full(max(len(sums), len(self.sums)), _BASE)
        up[0] = 1
        up = np.multiply.accumulate(up)
        low, high = self.begin[found].copy(), self.end[found].copy()
        first, last = low.copy(), high - 1

        def common(suffix: np.ndarray) -> np.ndarray:
            most = np.minimum(run[at], self.left[suffix])
            words = np.zeros(len(at), np.int64)
            for k in range(int(most.max()).bit_length() - 1, -1, -1):
                more = np.flatnonzero(words + (1 << k) <= most)
                i, j = at[more] + words[more], self.at[suffix[more]] + words[more]
                words[more[_same(sums, i, self.sums, j, np.full(len(more), 1 << k), up)]] += 1 << k
            return words

        while (low < high).any():
            middle = np.minimum((low + high) // 2, last)
            words = common(middle)
            # A text ends where its known words do.
            here = np.where(words < run[at], ids[at + np.minimum(words, run[at])], 0)
            above = here > self.ids[self.at[middle] + words]
            todo = low < high
            low, high = np.where(todo & above, middle + 1, low), np.where(todo & ~above, middle, high)
        before, after = np.maximum(low - 1, first), np.minimum(low, last)
        words, other = common(before), common(after)
        best = np.where(other > words, after, before)
        words = np.maximum(words, other)
        order = np.lexsort((-words, at))
        at, best, words = at[order], best[order], words[order]
        reach = np.maximum.accumulate(at + words)
        new = np.append(True, (at + words)[1:] > reach[:-1])
        return at[new], self.item[best[new]], self.item_at[best[new]], words[new]

    def items(self, found: np.ndarray) -> np.ndarray:
        """The items of some windows."""
        return np.unique(np.concatenate([self.items_of[k] for k in np.unique(self.kind[found])]))


def _match_slice(part: Slice, tests: TestSuffixes) -> tuple[np.ndarray, list[tuple[int, np.ndarray]], tuple[np.ndarray, ...]]:
    """Words up to each text, (text, items) of those with a window, and the longest matches."""
    first, last, bounds = part.words(WORD_BY_LETTER)
    ids = tests.known(part.hashes(first, last))
    at, found, run = tests.search(ids, bounds)
    rows = np.searchsorted(bounds, at, "right") - 1
    order = np.argsort(rows, kind="stable")
    cuts = np.flatnonzero(np.append(True, np.diff(rows[order]) != 0)) if len(order) else np.zeros(0, np.int64)
    items = [(int(rows[own[0]]), tests.items(found[own])) for own in np.split(order, cuts[1:]) if len(own)]
    return bounds, items, tests.longest(ids, at, found, run)


def benchmark_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of bounded size, each fetched by a query of its own."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, -(-int(total) // (4 * block_words)))  # some four characters a word at least
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    for k in range(count):
        yield [(r[0], r[1]) for r in items.where(block == k).toLocalIterator()]


def find_contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per document: row (its columns but the text), text, n_words, n_hit, items (sorted ids of all that have a
    window there), matches (the longest verbatim match from each word on, in each block of the benchmark, unless the one
    before holds it: one item that has it, word in the item, word in the document, words)."""
    small_batches(documents.sparkSession)
    row = F.struct(*[F.col(c) for c in documents.columns if c != "text"]).alias("row")
    found = documents.select(row, F.col("text").cast("string").alias("text"))
    schema = f"row {found.schema['row'].dataType.simpleString()}, text string, n_words bigint, names array<string>, matches {MATCH}"
    found = found.withColumn("names", F.lit(None).cast("array<string>")).withColumn("matches", F.lit(None).cast(MATCH))
    for block in benchmark_blocks(benchmark, block_words):
        # One broadcast a block, bounded by block_words.
        tests = documents.sparkSession.sparkContext.broadcast(TestSuffixes(block, window))

        def search(batch: pa.RecordBatch, tests=tests) -> pa.RecordBatch:
            n_words = np.zeros(batch.num_rows, np.int64)
            names = [x or [] for x in batch.column("names").to_pylist()]
            matches = [m or [] for m in batch.column("matches").to_pylist()]
            for part in slices(batch.column("text")):
                bounds, items, (at, item, item_at, words) = _match_slice(part, tests.value)
                n_words[part.rows] = np.diff(bounds)
                for row, own in items:
                    names[part.rows[row]] += [tests.value.names[k] for k in own]
                rows = np.searchsorted(bounds, at, "right") - 1
                for row, *m in zip(rows, item, item_at, at - bounds[rows], words):
                    name = tests.value.names[m[0]]
                    matches[part.rows[row]].append(
                        {"item_id": name, "item_at": int(m[1]), "at": int(m[2]), "words": int(m[3])}
                    )
            columns = [batch.column("row"), batch.column("text"), pa.array(n_words)]
            columns += [pa.array(names, pa.list_(pa.string())), pa.array(matches, _MATCH)]
            return pa.RecordBatch.from_arrays(columns, names=["row", "text", "n_words", "names", "matches"])

        found = as_arrow(found.select("row", "text", "names", "matches"), search, schema)
    spans = F.transform("matches", lambda m: F.struct(m["at"].alias("at"), (m["at"] + m["words"]).alias("to")))
    # Spans in order: each adds what reaches beyond all earlier ones.
    zero = F.struct(F.lit(0).cast("bigint").alias("hit"), F.lit(0).cast("bigint").alias("end"))
    hit = F.aggregate(
        F.array_sort(spans),
        zero,
        lambda s, m: F.struct(
            (s["hit"] + F.greatest(F.lit(0).cast("bigint"), m["to"] - F.greatest(m["at"], s["end"]))).alias("hit"),
            F.greatest(s["end"], m["to"]).alias("end"),
        ),
        lambda s: s["hit"],
    )
    items = F.array_sort(F.array_distinct("names"))
    return found.select("row", "text", "n_words", hit.alias("n_hit"), items.alias("items"), "matches")
