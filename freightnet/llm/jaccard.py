"""N-gram Jaccard join with count vectors as points.

Texts become sets of hashed word shingles. Shingles are hashed into groups; how many fall into each group is a point, and
the overlap of two sets is at most the sum of the smaller coordinates, so pairs whose bound is too small are never
compared. A digest, of two to four times as many finer groups as the set has shingles one bit each (whether it holds an odd
number of them), tightens the bound at the leaves: each group that differs holds a shingle that only one of the sets has.
Surviving pairs are verified on the sets themselves. Points travel as bytes where their coordinates fit.

Bringing pairs together. Two sets that link differ in at most D = (a + b)(1 - s)/(1 + s) shingles. Cut into D + 1 + E groups
they agree in the whole content of E + 1 groups at least, so unless both leave more than E groups empty a digest of some
group's content is a key that both have. E grows with the number of groups that sets of that size leave empty, so few
leave more; those also meet under their least shingles, of which two linked sets share one. D follows the size of a set,
in bands whose neighbours overlap by as much as sizes of linked sets may differ. Nothing is lost and no key is dropped.

Under each key, first every set is compared with one of them, which joins large groups of copies with one comparison a
set. Only keys whose sets are then still in different components are searched: an R-tree over their points (nodes with
the largest coordinates below them) walks pairs of nodes whose bound is large enough. Most sets meet others by chance only,
the more of them the larger the table: a first search, over points and digests folded to a part of their length, finds the
sets that are near another at all, and only these are searched with all they have. Of a group of copies that are all
near each other only few pairs need to be verified: first each set's nearest one in another component is, and only what
is still in different components after that is verified pair by pair.

Sets, not documents, are compared: equal sets are one from the start.

Defined cases: texts without words and NULL texts have size 0 and are alone; texts of fewer words than a shingle have one
shingle, the whole sequence; repeated rows and equal ids fall together; a NULL id is never a component id unless nothing
else is in the component; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightnet.llm.graph import components
from freightnet.llm.steps import forget, step
from freightnet.llm.texts import WORD_BY_SPACE, Slice, as_arrow, mix, slices, text_of

SHINGLE = 3
SHARE = 90
DIMENSIONS, LEAST_DIGEST = 64, 64
#: Coordinates of a folded point.
FEW_DIMENSIONS = 16
#: Rows of two numbers that are broadcast to meet the texts; more of them are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: The keys meet in so many rounds, each a share of them, so that only that share is on the way at a time.
KEY_ROUNDS = 4
#: Rounds in which only the nearest set in another component is verified, before all pairs that are left.
NEAREST_ROUNDS = 2
#: Rows with points, on average for each text, that are dealt by key at a time: more of them are searched in rounds.
ROWS_A_TEXT = 8
LEAF = 32
_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingles(part: Slice, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text of a slice."""
    first, last, bounds = part.words(WORD_BY_SPACE)
    hashes = part.hashes(first, last)
    n = len(hashes)
    joined = np.zeros(max(n - size + 1, 0), np.uint64)
    for k in range(size):
        joined = joined * _STEP + hashes[k : n - size + 1 + k]
    joined = mix(joined)
    for row, start, end in zip(part.rows, bounds[:-1], bounds[1:]):
        if end - start >= size:
            yield row, np.unique(joined[start : end - size + 1])
        else:
            whole = np.full(min(end - start, 1), end - start, np.uint64)
            for k in range(start, end):
                whole = mix(whole * _STEP + hashes[k])
            yield row, whole


@lru_cache
def _groups(differ: int, least: int) -> int:
    """Groups of a band: as many as sets may differ in and one more, and as many again as a set of ``least`` shingles is
    likely to leave empty. ``differ`` + 3 where a set is too small for that."""
    for groups in range(differ + 3, 4 * differ + 16):
        empty = groups * math.exp(-least / groups)
        if groups - differ - 1 >= empty + 3 * empty**0.5:
            return groups
    return differ + 3


@lru_cache
def _band(share: int, k: int) -> tuple[int, int, int, int]:
    """Least size, size beyond, most differing shingles and groups of the band of a number."""
    low = max(1, (100 + share) // (2 * (100 - share))) if k == 0 else _band(share, k - 1)[1]
    high = low + max(1, low // 2)
    differ = 2 * (high - 1) * (100 - share) // (100 + share)
    return low, high, differ, _groups(differ, -(-share * low // 100))


def _band_keys(found: np.ndarray, band: int, differ: int, groups: int, share: int) -> np.ndarray:
    """A digest of the content of each group. A set with so many empty groups that those might be all it shares with
    another such set also has the first of its shingles, in the order of their hashes, as keys."""
    group = ((found >> np.uint64(20)) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    used, at = np.unique(group[order], return_index=True)
    content = np.add.reduceat(mix(found[order] ^ _STEP), at)
    out = mix(content + (used + 1).astype(np.uint64) * _STEP + np.uint64(band + 1 << 40))
    if groups - len(used) < groups - differ:
        return out
    first = len(found) - -(-share * len(found) // 100) + 1
    return np.append(out, mix(mix(np.sort(mix(found))[:first]) + np.uint64(7)))


def keys(found: np.ndarray, share: int) -> np.ndarray:
    """Keys of a set: those of its band, and of the next one if a larger linked set may be there."""
    out, n, k = [], len(found), 0
    while True:
        low, high, differ, groups = _band(share, k)
        if n * 100 < share * low:
            break
        if n < high and differ:
            out.append(_band_keys(found, k, differ, groups, share))
        k += 1
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def point(found: np.ndarray) -> np.ndarray:
    return np.bincount((found >> np.uint64(48)).astype(np.int64) % DIMENSIONS, minlength=DIMENSIONS)


def _in_bytes(at: np.ndarray) -> bytes:
    """Coordinates in as few bytes each as the largest one takes."""
    return at.astype(next(k for k in ("<u1", "<u2", "<u4") if at.max() <= np.iinfo(k).max)).tobytes()


def point_bytes(found: np.ndarray) -> bytes:
    return _in_bytes(point(found))


def _points(column: pa.Array, dimensions: int = DIMENSIONS) -> np.ndarray:
    """One row of coordinates for each point, written as bytes or as a list."""
    if not pa.types.is_binary(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
    blobs = column.to_pylist()
    out, sizes = np.zeros((len(blobs), dimensions), np.int32), np.array([len(x) for x in blobs], np.int64)
    for width in (1, 2, 4):
        at = np.flatnonzero(sizes == width * dimensions)
        out[at] = np.frombuffer(b"".join(blobs[k] for k in at), f"<u{width}").reshape(-1, dimensions)
    return out


def digest(found: np.ndarray) -> np.ndarray:
    """Whether each of some groups holds an odd number of shingles; the number of groups is a power of two, from twice the
    size to four times. Each shingle that only one of two sets has turns a bit, unless another one in its group turns it back."""
    groups = max(LEAST_DIGEST, 2 << max(len(found) - 1, 1).bit_length())
    counts = np.bincount((found >> np.uint64(32)).astype(np.int64) % groups, minlength=groups)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little")


def _fold(bits: bytes, n: int, share: int) -> bytes:
    """A digest of as few groups, a power of two, as still tell sets of size ``n`` apart that have nothing in common: these
    differ in half of the groups give or take some of their square root, linked ones in at most 2 n (1 - s)/(1 + s)."""
    words, differ = np.frombuffer(bits, np.uint64), 2 * n * (100 - share) // (100 + share)
    groups = LEAST_DIGEST
    while groups < 64 * len(words) and groups - 2 * differ < max(0.25 * groups, (12 * groups) ** 0.5):
        groups *= 2
    return np.bitwise_xor.reduce(words.reshape(-1, groups // 64), axis=0).tobytes()


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Groups that differ between the digests of each row; the longer one is folded to the length of the shorter."""
    sizes = np.array([[len(x) for x in a], [len(x) for x in b]], np.int64).reshape(2, -1)
    out = np.zeros(sizes.shape[1], np.int64)
    for pair in np.unique(sizes, axis=1).T:
        at, least = np.flatnonzero((sizes == pair[:, None]).all(axis=0)), int(pair.min())
        x, y = (
            np.bitwise_xor.reduce(np.frombuffer(b"".join(d[at]), np.uint64).reshape(len(at), -1, least // 8), axis=1)
            for d in (a, b)
        )
        out[at] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return out


def set_id(found: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.append(0, np.cumsum([len(v) for v in values])).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(offsets, pa.array(flat.astype(kind.to_pandas_dtype()), kind))


def features(documents: DataFrame, id_col: str, size: int, share: int) -> DataFrame:
    """One row per document: id, version (hash of the text), n, set, keys, point, digest."""
    kind = documents.schema[id_col].dataType.simpleString()

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, sets = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        found_keys: list = [None] * batch.num_rows
        points: list = [None] * batch.num_rows
        digests: list = [None] * batch.num_rows
        for part in slices(batch.column("text")):
            for row, found in shingles(part, size):
                n[row], sets[row] = len(found), set_id(found)
                found_keys[row] = keys(found, share).view(np.int64)
                if len(found):
                    points[row] = point_bytes(found)
                digests[row] = digest(found).tobytes()
        columns = [batch.column(id_col), batch.column("version"), pa.array(n), pa.array(sets, mask=n == 0)]
        columns += [_lists(found_keys, pa.int64()), pa.array(points, pa.binary())]
        names = [id_col, "version", "n", "set", "keys", "point", "digest"]
        return pa.RecordBatch.from_arrays([*columns, pa.array(digests, pa.binary())], names=names)

    rows = text_of(documents, id_col).withColumn("version", F.xxhash64("text")).select(id_col, "version", "text")
    schema = f"{id_col} {kind}, version bigint, n bigint, set bigint, keys array<bigint>, point binary, digest binary"
    return as_arrow(rows, of, schema)


def _folded(points: DataFrame, share: int) -> DataFrame:
    """The points in fewer coordinates and their digests in fewer bits. Folded, they bound a link as well, less tightly."""

    def fold(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = _points(batch.column("point")).reshape(batch.num_rows, -1, FEW_DIMENSIONS).sum(axis=1)
        digests = zip(batch.column("digest").to_pylist(), batch.column("n").to_pylist())
        columns = [pa.array([_in_bytes(x) for x in at], pa.binary()), pa.array([_fold(*x, share) for x in digests], pa.binary())]
        return pa.RecordBatch.from_arrays(
            [batch.column("set"), batch.column("n"), *columns], names=["set", "n", "point", "digest"]
        )

    return as_arrow(points.select("set", "n", "point", "digest"), fold, "set bigint, n bigint, point binary, digest binary")


def _apart(a: Places, b: Places, share: int) -> np.ndarray:
    """Least share of shingles in which the sets of each row differ, by their digests; infinite where the bounds forbid a
    link."""
    most = np.minimum(a.points, b.points).sum(axis=1)
    both = a.sizes + b.sizes
    out = np.full(len(both), np.inf)
    at = np.flatnonzero(100 * most >= share * (both - most))
    differ = _differ(a.digests[at], b.digests[at])
    near = (100 + share) * differ <= (100 - share) * both[at]
    out[at[near]] = differ[near] / both[at[near]]
    return out


def _bounded(pairs: DataFrame, points: DataFrame, share: int) -> DataFrame:
    """Pairs (a, b) whose bounds allow a link."""
    for c in ("a", "b"):
        own = points.select(F.col("set").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("n", "point", "digest")])
        pairs = pairs.join(own, c)

    def bound(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = pa.array(np.isfinite(_apart(Places.of(batch, "_a"), Places.of(batch, "_b"), share)))
        return pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], names=["a", "b"])

    return as_arrow(pairs, bound, "a bigint, b bigint")


def _small(rows: DataFrame) -> DataFrame:
    """A written table of ids and versions, broadcast while its rows are few: the texts then stay where they are."""
    rows = step(rows)
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _sets(documents: DataFrame, where: DataFrame, pairs: DataFrame, id_col: str, size: int) -> DataFrame:
    """(set, found): the shingles of the sets in ``pairs``, cut again from one text of each."""
    wanted = pairs.select(F.col("a").alias("set")).unionByName(pairs.select(F.col("b").alias("set"))).distinct()
    where = where.join(wanted, "set").select(F.col(id_col).alias("__id"), F.col("version").alias("__version"))
    where = _small(where)
    rows = text_of(documents, id_col).withColumn("version", F.xxhash64("text"))
    rows = rows.join(
        where, (F.col("version") == F.col("__version")) & F.col(id_col).eqNullSafe(F.col("__id")), "left_semi"
    ).select("text")

    def cut_up(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [f for part in slices(batch.column("text")) for _, f in shingles(part, size)]
        blobs = pa.array([f.tobytes() for f in found], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([set_id(f) for f in found], pa.int64()), blobs], names=["set", "found"])

    return step(as_arrow(rows, cut_up, "set bigint, found binary").dropDuplicates(["set"]))


def _verified(pairs: DataFrame, documents: DataFrame, where: DataFrame, id_col: str, size: int, share: int) -> DataFrame:
    """Pairs (a, b) of a written table that link. Only texts of sets that occur in a pair are cut into shingles again."""
    sets = _sets(documents, where, pairs, id_col, size)
    both = pairs
    for c in ("a", "b"):
        both = both.join(sets.select(F.col("set").alias(c), F.col("found").alias(f"found_{c}")), c)

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = np.zeros(batch.num_rows, bool)
        for k, (x, y) in enumerate(zip(batch.column("found_a"), batch.column("found_b"))):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep[k] = 100 * both >= share * (len(x) + len(y) - both)
        kept = pa.array(keep)
        return pa.RecordBatch.from_arrays([batch.column(c).filter(kept) for c in ("a", "b")], names=["a", "b"])

    out = step(as_arrow(both.select("a", "b", "found_a", "found_b"), verify, "a bigint, b bigint"))
    forget(sets)
    return out


@dataclass
class Places:
    """Points, digests and sizes of some sets."""

    points: np.ndarray
    digests: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch, end: str = "", dimensions: int = DIMENSIONS) -> Places:
        points = _points(batch.column("point" + end), dimensions)
        digests = np.array([*batch.column("digest" + end).to_pylist(), None], object)[:-1]
        return cls(points, digests, batch.column("n" + end).to_numpy(zero_copy_only=False))

    def take(self, at) -> Places:
        return Places(self.points[at], self.digests[at], self.sizes[at])


class Tree:
    """R-tree packed from points sorted by group and size; a node knows the largest coordinates, the size range and the
    range of groups below it. Without groups every point is its own."""

    def __init__(self, places: Places, groups: np.ndarray | None = None) -> None:
        points, sizes = places.points, places.sizes
        groups = np.arange(len(points)) if groups is None else groups
        spread = points.std(axis=0).argsort()[::-1][:2] if len(points) else []
        by_size = [*[points[:, k] for k in spread], sizes]
        alone = len(np.unique(groups)) == len(groups)
        self.order = np.lexsort(by_size if alone else (*by_size, groups))
        self.groups = groups[self.order]
        self.places = places.take(self.order)
        self.points, self.sizes = self.places.points, self.places.sizes
        bounds = np.append(np.arange(0, len(points), LEAF), len(points))
        top, low, high, least, most = self.points, self.sizes, self.sizes, self.groups, self.groups
        self.levels = []
        while True:
            top = np.maximum.reduceat(top, bounds[:-1], axis=0)
            low, high = np.minimum.reduceat(low, bounds[:-1]), np.maximum.reduceat(high, bounds[:-1])
            least, most = np.minimum.reduceat(least, bounds[:-1]), np.maximum.reduceat(most, bounds[:-1])
            self.levels.append((bounds, top, low, high, least, most))
            if len(top) == 1:
                break
            bounds = np.append(np.arange(0, len(top), LEAF), len(top))

    def pairs(self, share: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Index pairs (one before the other) of different groups whose bound allows a link, and how far they are apart."""
        todo = [(len(self.levels) - 1, 0, 0)]
        while todo:
            level, i, j = todo.pop()
            bounds = self.levels[level][0]
            x, y = slice(bounds[i], bounds[i + 1]), slice(bounds[j], bounds[j + 1])
            if level:
                _, top, low, high, least, last = self.levels[level - 1]
            else:
                top, low, high, least, last = self.points, self.sizes, self.sizes, self.groups, self.groups
            most = np.minimum(top[x][:, None, :], top[y][None, :, :]).sum(axis=2)
            fits = 100 * most >= share * (low[x][:, None] + low[y][None, :] - most)
            fits &= (100 * high[x][:, None] >= share * low[y][None, :]) & (100 * high[y][None, :] >= share * low[x][:, None])
            # Nodes of one and the same group hold no pair of different groups.
            fits &= (least[x][:, None] != last[y][None, :]) | (last[x][:, None] != least[y][None, :])
            if i == j:
                fits &= np.tri(*fits.shape, k=0 if level else -1, dtype=bool)
            p, q = np.nonzero(fits)
            p, q = p + bounds[i], q + bounds[j]
            if level:
                todo += [(level - 1, int(a), int(b)) for a, b in zip(p, q)]
            elif len(p):
                apart = _apart(self.places.take(p), self.places.take(q), share)
                near = np.isfinite(apart)
                yield self.order[p[near]], self.order[q[near]], apart[near]


def _nearest(pairs: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each of ``n`` sets the pair with the nearest one."""
    best, other = np.full(n, np.inf), np.full(n, -1)
    for p, q, apart in pairs:
        for a, b in ((p, q), (q, p)):
            order = np.lexsort((b, apart, a))
            first = order[np.append(True, a[order][1:] != a[order][:-1])[: len(order)]]
            first = first[apart[first] < best[a[first]]]
            best[a[first]], other[a[first]] = apart[first], b[first]
    own = np.flatnonzero(other >= 0)
    if len(own):
        yield own, other[own]


def _searched(rows: DataFrame, share: int, nearest: bool = False, dimensions: int = DIMENSIONS) -> DataFrame:
    """(key, set, component, n, point, digest) to the pairs of different components under a key whose bound allows a link;
    with ``nearest`` only one of them for each set, the one that is least apart."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[list[np.ndarray]] = []

        def run(key, sets, comps, sizes, points, digests) -> pa.RecordBatch | None:
            left, right = [], []
            cuts = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
            for x, y in zip(cuts[:-1], cuts[1:]):
                s, c = sets[x:y], comps[x:y]
                found = Tree(Places(points[x:y], digests[x:y], sizes[x:y]), c).pairs(share)
                for p, q in _nearest(found, y - x) if nearest else (f[:2] for f in found):
                    left.append(np.minimum(s[p], s[q]))
                    right.append(np.maximum(s[p], s[q]))
            if not left:
                return None
            pair = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            places = Places.of(batch, dimensions=dimensions)
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "set", "component")]
            now += [places.sizes, places.points, places.digests]
            # The last key may go on in the next batch; what is held is put together once, when its key has ended.
            at = int(np.searchsorted(now[0], now[0][-1], "left"))
            if at or (rest and rest[-1][0][-1] != now[0][0]):
                done = [np.concatenate(x) for x in zip(*rest, [x[:at] for x in now])]
                rest = []
                if len(done[0]) and (out := run(*done)) is not None:
                    yield out
            rest.append([x[at:] for x in now])
        if rest and (out := run(*[np.concatenate(x) for x in zip(*rest)])) is not None:
            yield out

    dealt = rows.repartition("key").sortWithinPartitions("key")
    dealt = dealt.select("key", "set", "component", "n", "point", "digest")
    return dealt.mapInArrow(search, "a bigint, b bigint").distinct()


def _search_rounds(
    known: DataFrame, points: DataFrame, texts: int, share: int, nearest: bool, dimensions: int = DIMENSIONS
) -> DataFrame:
    """``_searched`` over (key, set, component) in as many rounds as keep what is dealt at a time in proportion to the texts:
    each key is in one round, so rounds change no pair, and the rows that go with points never lie on disk all at once."""
    rounds = max(1, -(-known.count() // max(1, ROWS_A_TEXT * texts)))
    if rounds == 1:
        return _searched(known.join(points, "set"), share, nearest, dimensions)
    parts = [known.where(F.pmod("key", F.lit(rounds)) == k).join(points, "set") for k in range(rounds)]
    return reduce(DataFrame.unionByName, [step(_searched(part, share, nearest, dimensions)) for part in parts]).distinct()


def _open_rows(together: DataFrame, grouped: DataFrame) -> DataFrame:
    """(key, set, component) of the keys that still have sets of different components."""
    known = together.select("key", "set").join(grouped.withColumnRenamed("node", "set"), "set", "left")
    known = step(known.withColumn("component", F.coalesce("component", "set")))
    open_keys = known.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y")
    rows = step(known.join(open_keys.select("key"), "key"))
    forget(known)
    return rows


def _rows_of(together: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of ``together`` of the sets that occur in ``pairs``, in its place."""
    out = step(together.join(pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct(), "set", "left_semi"))
    forget(together)
    return out


def _near_others(together: DataFrame, grouped: DataFrame, points: DataFrame, texts: int, share: int) -> DataFrame:
    """The rows of ``together`` of sets that are near one of another component by folded points, in its place. Each set of a
    link that is still to be found is one of these, whichever other links are found first."""
    rows = _open_rows(together, grouped)
    folded = step(_folded(points, share))
    pairs = step(_search_rounds(rows, folded, texts, share, True, FEW_DIMENSIONS))
    together = _rows_of(together, pairs)
    for old in (rows, folded, pairs):
        forget(old)
    return together


def link_documents(
    documents: DataFrame, size: int = SHINGLE, share: int = SHARE, id_col: str = "doc_id"
) -> DataFrame:
    """One row per document: id, version (hash of its text), n_shingles, component_id (least id that links reach, its
    own included), stays (true for one document of each component)."""
    found = step(features(documents, id_col, size, share))
    points = found.where("n > 0").select("set", "n", "point", "digest").dropDuplicates(["set"])
    where = found.where("n > 0").groupBy("set").agg(F.min(F.struct(id_col, "version")).alias("w"))
    where = where.select("set", "w.*")

    keyed = found.select("set", F.explode("keys").alias("key"))
    together = None
    for k in range(KEY_ROUNDS):
        part = keyed.where(F.pmod("key", F.lit(KEY_ROUNDS)) == k)
        shared = part.groupBy("key").agg(F.min("set").alias("hub"), F.max("set").alias("last")).where("hub < last")
        part = step(part.join(shared.select("key", "hub"), "key").distinct())
        together = part if together is None else together.unionByName(part)
    met = together.select("set").distinct()
    points = step(points.join(met, "set"))
    where = step(where.join(met, "set"))
    # The keys of all sets are the largest table: they go before the search begins.
    nodes = step(found.select(id_col, "version", "n", "set"))
    texts = nodes.count()
    forget(found)
    stars = together.where("set != hub").select(F.col("hub").alias("a"), F.col("set").alias("b")).distinct()
    pairs = step(_bounded(stars, points, share))
    links = _verified(pairs, documents, where, id_col, size, share)
    forget(pairs)

    grouped, found_none = components(links), False
    together = _near_others(together, grouped, points, texts, share)
    for nearest in [*[True] * NEAREST_ROUNDS, False]:
        if nearest and found_none:  # the same components: the same search would find nothing again
            continue
        rows = _open_rows(together, grouped)
        if rows.isEmpty():  # no key has sets of two components
            forget(rows)
            break
        pairs = step(_search_rounds(rows, points, texts, share, nearest))
        forget(rows)
        if nearest:
            # Links found only make fewer sets of other components: one that is near none of them now never will be.
            together = _rows_of(together, pairs)
        more = _verified(pairs, documents, where, id_col, size, share)
        forget(pairs)
        found_none = more.isEmpty()
        if not found_none:
            # Each set is next to the least one of its component already: only the new links have a way to go.
            grouped = components(grouped.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    for old in (together, points, where):
        forget(old)

    nodes = nodes.join(grouped, F.col("set") == F.col("node"), "left")
    nodes = nodes.withColumn("component", F.coalesce("component", "set"))
    first = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("version").alias("v"))
    least = nodes.where("n > 0").groupBy("component").agg(F.min(id_col).alias("__least"), F.min(first).alias("__first"))
    out = nodes.join(least, "component", "left")
    stays = F.col("__first.id").eqNullSafe(F.col(id_col)) & (F.col("__first.v") == F.col("version"))
    return out.select(
        id_col, "version", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("__least")).otherwise(F.col(id_col)).alias("component_id"),
        (F.coalesce(stays, F.lit(False)) | (F.col("n") == 0)).alias("stays"),
    )


def one_of_each(documents: DataFrame, size: int = SHINGLE, share: int = SHARE, id_col: str = "doc_id") -> DataFrame:
    """The documents with one of each component: rows that repeat id and text count as one, empty texts all stay."""
    found = step(link_documents(documents, size, share, id_col))
    key = [F.col(id_col).alias("__id"), F.col("version").alias("__version")]
    go = found.where("not stays").select(*key).distinct()
    again = found.where("stays and n_shingles > 0").groupBy(*key).count().where("count > 1").select("__id", "__version")
    own = documents.withColumn("__own", F.xxhash64(F.col("text").cast("string")))
    same = F.col("__id").eqNullSafe(F.col(id_col)) & (F.col("__own") == F.col("__version"))
    rest = own.join(_small(go.unionByName(again)), same, "left_anti")
    repeated = own.join(_small(again), same, "left_semi").dropDuplicates([id_col, "__own"])
    return rest.unionByName(repeated).select(*documents.columns)
