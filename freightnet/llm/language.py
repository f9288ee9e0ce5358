"""A hierarchical Pitman-Yor language model over word pairs: trained on part of the texts, it scores all.

Each word is a restaurant in which the words seen after it sit; all restaurants share one parent, whose customers are
their tables, and the parent's own parent is uniform over all words and one that stands for the unseen. How many tables a
word has in a restaurant is sampled: a Gibbs sweep seats all its customers anew, one after another as in a Chinese
restaurant, given all other tables of the restaurant and the parent's probabilities as the sweep before left them.
Seating one by one does not weigh all arrangements right, so ``PATHS`` of them are drawn and one is chosen by its weight.
Sweeps alternate between the restaurants and the parent. ``BURN_IN`` of them are thrown away; the probabilities
of the other ``SAMPLES`` are averaged. Discounts follow from how many pairs were seen once and twice.

At scale. Texts are cut into slices of whole texts, which keep each token as a number. Slices ask for words and pairs in
packed messages, one per slice and bucket of a hash; a bucket gives counts over all slices, and later answers. So a
pair moves once per slice that has it, the counts cover the whole corpus, and no key is hot: a slice asks for each only
once. Pairs seen once always have one table; only the others take part in the sweeps, as one packed sheet a bucket that
asks in the same way for the tables of its first words and the parent's probabilities of its second ones, each once, and
tells how many tables it adds to them. Random numbers are hashes of the pair, the sweep and the step: reruns agree.

Beyond ``ONE_BY_ONE`` customers of a word in a restaurant, those that follow sit down in blocks of a sixteenth of those
seated, with a Poisson number of new tables.

Defined cases: NULL and empty texts are one token, the end; repeated rows count and are scored each; a NULL id is trained
on as if it were not held out, unless the caller's ``held_out`` says so; without training texts N is 0 and all words are
equally likely; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightnet.llm.steps import LARGE_ROWS, forget, step
from freightnet.llm.texts import WORD_BY_SPACE, mix, slices, text_of


BURN_IN, SAMPLES = 2, 2
#: Strength of the restaurants and of their parent.
STRENGTH, PARENT_STRENGTH = 1.0, 1.0
PATHS, ONE_BY_ONE = 3, 64
#: Added to each count of the base score.
ADDED = 0.1
#: Slices for each bucket of words and of pairs.
SLICES_A_BUCKET, SLICES_A_PAIR_BUCKET = 8, 2
#: Bytes of text that are cut into words at once, and tokens of a slice: a task holds some hundred bytes for each.
SLICE_BYTES, SLICE_TOKENS = 1 << 20, 1 << 19
#: Rounds in which pairs are answered, each a share of their buckets.
ANSWER_ROUNDS = 2
#: Rows of a table that are worked on together.
TOGETHER = 200_000
_START = -1
_END_HASH = np.uint64(1)
_MESSAGE = "key bigint, kind int, part bigint, a binary, b binary, c binary, d binary"
_NAMES = ["key", "kind", "part", "a", "b", "c", "d"]
_MIXED = np.uint64(0x9E3779B97F4A7C15)


def pack(values: np.ndarray) -> bytes:
    """Compressed, the first bytes of all values ahead of their second ones and so on: high bytes are much alike."""
    raw = np.ascontiguousarray(values)
    planes = raw.reshape(-1, 1).view(np.uint8).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(blob: bytes, kind) -> np.ndarray:
    planes = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _messages(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=_NAMES)


def _each(rows: DataFrame, work: Callable[..., Iterator[pa.RecordBatch]], schema: str = _MESSAGE) -> DataFrame:
    """``work`` on every message by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from work(*[batch.column(c)[k].as_py() for c in _NAMES])

    return rows.select(*_NAMES).mapInArrow(run, schema)


def _gathered(rows: DataFrame, work: Callable[[int, list], Iterator[pa.RecordBatch]], schema: str = _MESSAGE) -> DataFrame:
    """``work`` on the messages of each key, sorted by kind and part. A key holds few messages by design."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                key = batch.column("key")[k].as_py()
                if held and key != now:
                    yield from work(now, held)
                    held = []
                now = key
                held.append([batch.column(c)[k].as_py() for c in _NAMES[1:]])
        if held:
            yield from work(now, held)

    dealt = rows.select(*_NAMES).repartition("key").sortWithinPartitions("key", "kind", "part")
    return dealt.mapInArrow(run, schema)


def _sliced(documents: DataFrame, held_out: Column, id_col: str) -> DataFrame:
    """Messages by slice: tokens as places in its words, the words' hashes, tokens per text, (id, held_out) as a table."""

    def message(number: int, held: list[tuple[np.ndarray, np.ndarray, pa.Table]]) -> pa.RecordBatch:
        words, tokens = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        sizes, own = np.concatenate([h[1] for h in held]), pa.concat_tables([h[2] for h in held]).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, own.schema) as out:
            out.write_table(own)
        blobs = pack(tokens.astype(np.int32)), pack(words), pack(sizes.astype(np.int64)), sink.getvalue().to_pybytes()
        return _messages([(number, 0, 0, *blobs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, []
        for batch in batches:
            for part in slices(batch.column("text"), SLICE_BYTES):
                first, last, bounds = part.words(WORD_BY_SPACE)
                texts = len(part.rows)
                sizes = np.diff(bounds) + 1
                hashes = np.full(len(first) + texts, _END_HASH)
                inside = np.ones(len(hashes), bool)
                inside[np.cumsum(sizes) - 1] = False
                hashes[inside] = part.hashes(first, last)
                rows = pa.array(part.rows)
                own = pa.Table.from_arrays([batch.column(c).take(rows) for c in (id_col, "held_out")], ["id", "held"])
                held.append((hashes, sizes, own))
                if sum(len(h[0]) for h in held) >= SLICE_TOKENS:
                    yield message(number, held)
                    number, held = number + 1, []
        if held:
            yield message(number, held)

    flag = F.coalesce(held_out, F.lit(False)).alias("held_out")
    return text_of(documents.withColumn("held_out", flag), id_col, "held_out").mapInArrow(run, _MESSAGE)


def _documents(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def _trains(sizes: np.ndarray, own: pa.Table) -> np.ndarray:
    """Whether each token is trained on."""
    return np.repeat(~own.column("held").to_numpy(zero_copy_only=False).astype(bool), sizes)


def _split(buckets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(buckets, kind="stable")
    cuts = np.flatnonzero(np.append(True, np.diff(buckets[order]) != 0)) if len(order) else np.zeros(0, np.int64)
    for a, b in zip(cuts, [*cuts[1:], len(order)]):
        yield int(buckets[order[a]]), order[a:b]


def _word_asks(sliced: DataFrame, buckets: int) -> DataFrame:
    """Each slice's words to their buckets: hashes and how often they stand in texts that are trained on."""

    def ask(key, kind, part, tokens, words, sizes, own) -> Iterator[pa.RecordBatch]:
        words, tokens = unpack(words, np.uint64), unpack(tokens, np.int32)
        trained = np.bincount(tokens[_trains(unpack(sizes, np.int64), _documents(own))], minlength=len(words))
        rows = [(b, 0, key, words[at].tobytes(), pack(trained[at]), b"", b"") for b, at in _split((words % np.uint64(buckets)).astype(np.int64))]
        yield _messages(rows)

    return _each(sliced, ask)


def _word_counts(asks: DataFrame, buckets: int) -> DataFrame:
    """Answers by slice (kind 1: numbers and counts of its words) and, under key -1, the words of each bucket (kind 2)."""

    def count(bucket: int, held: list) -> Iterator[pa.RecordBatch]:
        hashes = [np.frombuffer(h[2], np.uint64) for h in held]
        words, at = np.unique(np.concatenate(hashes), return_inverse=True)
        totals = np.zeros(len(words), np.int64)
        np.add.at(totals, at, np.concatenate([unpack(h[3], np.int64) for h in held]))
        numbers = np.arange(len(words)) * buckets + bucket
        rows, start = [(-1, 2, bucket, pack(numbers), pack(totals), b"", b"")], 0
        for h, own in zip(held, hashes):
            mine = at[start : start + len(own)]
            rows.append((h[1], 1, bucket, pack(numbers[mine]), pack(totals[mine]), b"", b""))
            start += len(own)
        yield _messages(rows)

    return _gathered(asks, count)


def _numbered(sliced: DataFrame, answers: DataFrame, buckets: int) -> DataFrame:
    """Slices with tokens, numbers of their words, counts of their words, and sizes and texts in one. Words are in the order
    of their numbers, and so are the pairs that slices ask for: steps between them are small."""

    def put(key: int, held: list) -> Iterator[pa.RecordBatch]:
        _, _, tokens, words, sizes, own = held[0]
        words = unpack(words, np.uint64)
        numbers, counts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        answered = {h[1]: h for h in held[1:]}
        for bucket, at in _split((words % np.uint64(buckets)).astype(np.int64)):
            numbers[at], counts[at] = unpack(answered[bucket][2], np.int64), unpack(answered[bucket][3], np.int64)
        order = np.argsort(numbers)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        tokens = pack(place[unpack(tokens, np.int32)])
        yield _messages([(key, 0, 0, tokens, pack(np.concatenate([numbers[order], counts[order]])), sizes, own)])

    return _gathered(sliced.unionByName(answers.where("key >= 0")), put)


class _Pairs:
    """The pairs of a slice, each once: their words, a hash, and the pair of each token."""

    def __init__(self, tokens: np.ndarray, numbers: np.ndarray, sizes: np.ndarray) -> None:
        self.before = np.roll(tokens, 1).astype(np.int64)
        self.before[np.cumsum(sizes) - sizes] = len(numbers)  # the start of a text
        keys, self.at = np.unique(self.before * len(numbers) + tokens, return_inverse=True)
        first, self.last = np.divmod(keys, max(len(numbers), 1))
        self.u = np.append(numbers, _START)[first]
        self.w = numbers[self.last]
        self.hash = pair_hash(self.u, self.w)

    def buckets(self, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
        return _split((self.hash % np.uint64(buckets)).astype(np.int64))


def pair_hash(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(mix(u.astype(np.int64).view(np.uint64) * _MIXED) + w.astype(np.int64).view(np.uint64))


def _pair_asks(known: DataFrame, buckets: int) -> DataFrame:
    """Each slice's pairs to their buckets: both words, and how often they stand in texts that are trained on."""

    def ask(key, kind, part, tokens, words, sizes, own) -> Iterator[pa.RecordBatch]:
        sizes, numbers = unpack(sizes, np.int64), unpack(words, np.int64).reshape(2, -1)[0]
        pairs = _Pairs(unpack(tokens, np.int32), numbers, sizes)
        trained = np.bincount(pairs.at[_trains(sizes, _documents(own))], minlength=len(pairs.u))
        yield _messages([(b, 1, key, pack(np.diff(pairs.u[at], prepend=0)), pack(pairs.w[at]), pack(trained[at]), b"") for b, at in pairs.buckets(buckets)])

    return _each(known, ask)


def _pair_counts(asks: DataFrame) -> DataFrame:
    """Messages by bucket: both words and the count of every pair, and which of them each slice asked for."""

    def count(bucket: int, held: list) -> Iterator[pa.RecordBatch]:
        u = np.concatenate([np.cumsum(unpack(h[2], np.int64)) for h in held])
        w = np.concatenate([unpack(h[3], np.int64) for h in held])
        counts = [unpack(h[4], np.int64) for h in held]
        # Both words as one number, which puts pairs in the order of their words.
        span = int(w.max()) + 1
        pairs, at = np.unique((u + 1) * span + w, return_inverse=True)
        totals = np.bincount(at, weights=np.concatenate(counts), minlength=len(pairs)).astype(np.int64)
        u, w = np.divmod(pairs, span)
        u -= 1
        asked = pack(np.array([[h[1] for h in held], [len(c) for c in counts]], np.int64))
        # Steps are small, as the words and the places of each slice's pairs ascend.
        where = len(asked).to_bytes(8, "little") + asked + pack(np.diff(at.astype(np.int32), prepend=np.int32(0)))
        yield _messages([(bucket, 1, 0, pack(np.diff(u, prepend=0)), pack(w), pack(totals), where)])

    return _gathered(asks, count)


def _asked(blob: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """Each slice and the places of its pairs in the bucket."""
    n = int.from_bytes(blob[:8], "little")
    (numbers, sizes), at = unpack(blob[8 : 8 + n], np.int64).reshape(2, -1), np.cumsum(unpack(blob[8 + n :], np.int32), dtype=np.int32)
    for number, end, size in zip(numbers, np.cumsum(sizes), sizes):
        yield int(number), at[end - size : end]


class _Sheet:
    """The pairs of a bucket that were seen more than once: their first and second words, each once, the places of both in
    those, counts, tables, and tables summed over the samples."""

    def __init__(self, words: bytes, places: bytes, counts: bytes, tables: bytes) -> None:
        words = unpack(words, np.int64)
        self.sides = np.split(words[1:], words[:1])
        self.places = unpack(places, np.int32).reshape(2, -1)
        self.counts = unpack(counts, np.int64)
        self.tables, self.kept = unpack(tables, np.int64).reshape(2, -1)

    def hash(self) -> np.ndarray:
        return pair_hash(*[words[at] for words, at in zip(self.sides, self.places)])


def _sheets(counts: DataFrame) -> DataFrame:
    """A sheet by bucket (kind 0), at first with one table for each pair."""

    def sheet(bucket, kind, part, u, w, c, where) -> Iterator[pa.RecordBatch]:
        c = unpack(c, np.int64)
        many = c > 1
        if many.any():
            found = [np.unique(x[many], return_inverse=True) for x in (np.cumsum(unpack(u, np.int64)), unpack(w, np.int64))]
            words = np.concatenate([[len(found[0][0])], found[0][0], found[1][0]]).astype(np.int64)
            places = np.concatenate([at for _, at in found]).astype(np.int32)
            n = int(many.sum())
            tables = np.concatenate([np.ones(n, np.int64), np.zeros(n, np.int64)])
            yield _messages([(bucket, 0, 0, pack(words), pack(places), pack(c[many]), pack(tables))])

    return _each(counts, sheet)


def _rare(counts: DataFrame) -> tuple[int, int]:
    """How many pairs were seen once and twice."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in batch.column("c"):
                c = unpack(c.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([np.count_nonzero(c == k)]) for k in (1, 2)], names=["n1", "n2"])

    n = counts.select("c").mapInArrow(rows, "n1 bigint, n2 bigint").agg(F.sum("n1").alias("n1"), F.sum("n2").alias("n2")).first()
    return n["n1"] or 0, n["n2"] or 0


def _by_side(counts: DataFrame, side: int, name: str) -> DataFrame:
    """Sums over the pairs of each first (0) or second (1) word: total, single (seen once), many (more often). Each task
    adds up its buckets, ``TOGETHER`` pairs and more at a time, before rows move."""

    def flush(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        c = np.concatenate([h[1] for h in held])
        sums = [np.bincount(at, weights=x, minlength=len(ids)).astype(np.int64) for x in (c, c == 1, c > 1)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, *sums)], names=[name, "total", "single", "many"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for k in range(batch.num_rows):
                words, c = (unpack(batch.column(x)[k].as_py(), np.int64) for x in ("ab"[side], "c"))
                seen = c > 0
                held.append(((words if side else np.cumsum(words))[seen], c[seen]))
                if sum(len(h[1]) for h in held) >= TOGETHER:
                    yield flush(held)
                    held = []
        if held:
            yield flush(held)

    rows = counts.select("ab"[side], "c").mapInArrow(run, f"{name} bigint, total bigint, single bigint, many bigint")
    return rows.groupBy(name).agg(*[F.sum(c).alias(c) for c in ("total", "single", "many")])


def _random(keys: np.ndarray, k: int) -> np.ndarray:
    """A number from 0 to 1 for each key, another for each k."""
    salt = np.array([(k + 1) * 0xD1B54A32D192ED03 % 2**64], np.uint64)
    return (mix(keys + salt) >> np.uint64(11)).astype(np.float64) / 2**53


def seat(c: np.ndarray, rest: np.ndarray, p: np.ndarray, strength: float, discount: float, keys: np.ndarray, sweep: int) -> np.ndarray:
    """Tables of ``c`` customers who all have the same dish, of parent probability ``p``, in a restaurant with ``rest``
    other tables: ``PATHS`` seatings, one of them by weight."""
    order = np.argsort(-c, kind="stable")
    c, rest, p, keys = c[order], rest[order].astype(np.float64), p[order], keys[order]
    ways, weights = np.ones((PATHS, len(c)), np.int64), np.zeros((PATHS, len(c)))
    most = int(c[0]) if len(c) else 0
    for path in range(PATHS):  # two customers have one seating to choose by weight: the first path will do
        tables, weight = ways[path], weights[path]
        # A number of its own for each step of each path, whatever else is in the batch.
        seated, draw = 1, (sweep << 24) + (path << 20)
        while seated < most:
            n = int(np.searchsorted(-c, -max(seated, 2 if path else 1), "left"))  # dishes with more than are seated
            block = 1 if seated < ONE_BY_ONE else seated // 16
            size = np.minimum(c[:n] - seated, block)
            new = (strength + discount * (rest[:n] + tables[:n])) * p[:n]
            old = seated + (size - 1) / 2 - discount * tables[:n]
            draw += 1
            if block == 1:
                more = _random(keys[:n], draw) * (new + old) < new
            else:
                more = np.minimum(_poisson(size * new / (new + old), _random(keys[:n], draw)), size)
            tables[:n] += more
            weight[:n] += size * np.log(new + old)
            seated += block
    chance = np.exp(weights - weights.max(axis=0)) if len(c) else weights
    chance[1:, c <= 2] = 0
    chosen = (np.cumsum(chance, axis=0) < _random(keys, (sweep << 24) + (PATHS << 20)) * chance.sum(axis=0)).sum(axis=0)
    out = np.empty(len(c), np.int64)
    out[order] = np.minimum(ways[np.minimum(chosen, PATHS - 1), np.arange(len(c))], c)
    return out


def _poisson(mean: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Poisson numbers from uniform ones."""
    out, term = np.zeros(len(mean), np.int64), np.exp(-mean)
    total = term.copy()
    for k in range(1, int(mean.max() + 12 * np.sqrt(mean.max()) + 12) if len(mean) else 0):
        below = total < u
        if not below.any():
            break
        out[below] = k
        term = term * mean / k
        total += term
    return out


def _larger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that are worth a numpy call: ``TOGETHER`` rows each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= TOGETHER:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _columns(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False) for c in names]


def _parent_sweep(parent: DataFrame, discount: float, others: int, base: float, sweep: int) -> DataFrame:
    """Words at the parent with their ``r`` customers seated anew, given the ``others`` there were."""
    kept = [c for c in parent.columns if c != "t"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _larger(batches):
            w, r, t = _columns(batch, "w", "r", "t")
            rest = np.maximum(others - t, 0)
            keys = mix(w.astype(np.int64).view(np.uint64) * _MIXED)
            t = seat(r, rest, np.full(len(r), base), PARENT_STRENGTH, discount, keys, 2 * sweep + 1)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(t)], names=[*kept, "t"])

    rows = parent.select(*kept, "t")
    return rows.mapInArrow(work, rows.schema)


def _side_answers(sheets: DataFrame, contexts: DataFrame, seats: DataFrame, buckets: int) -> DataFrame:
    """Answers by sheet: the tables of its first words (kind 1) and the parent's p of its second ones (kind 2)."""

    def ask(sheet, kind, part, words, b, c, d) -> Iterator[pa.RecordBatch]:
        words = unpack(words, np.int64)
        sides = np.split(words[1:], words[:1])
        yield _messages([(b, 2 + k, sheet, pack(ids[at]), b"", b"", b"") for k, ids in enumerate(sides) for b, at in _split(ids % buckets)])

    def answer(bucket: int, held: list) -> Iterator[pa.RecordBatch]:
        told = []
        for side in (0, 1):
            own = [h for h in held if h[0] == side]
            ids = np.concatenate([np.frombuffer(h[2], np.int64) for h in own] or [np.zeros(0, np.int64)])
            values = np.concatenate([np.frombuffer(h[3], np.float64) for h in own] or [np.zeros(0)])
            order = np.argsort(ids)
            told.append((ids[order], values[order]))
        rows = []
        for kind, sheet, words, *_ in held:
            if kind > 1:
                ids, values = told[kind - 2]
                rows.append((sheet, kind - 1, bucket, pack(values[np.searchsorted(ids, unpack(words, np.int64))]), b"", b"", b""))
        if rows:
            yield _messages(rows)

    first = _packed(contexts, F.pmod("u", F.lit(buckets)), 0, ["u", "tables"])
    second = _packed(seats, F.pmod("w", F.lit(buckets)), 1, ["w", "p"])
    return _gathered(first.unionByName(second).unionByName(_each(sheets, ask)), answer)


def _sweep(sheets: DataFrame, answers: DataFrame, buckets: int, discount: float, sweep: int, counts: bool) -> DataFrame:
    """Sheets with tables drawn anew, added to those that are kept if the sweep counts."""

    def draw(bucket: int, held: list) -> Iterator[pa.RecordBatch]:
        same = held[0][2:5]
        sheet, values = _Sheet(*held[0][2:]), []
        for side, ids in enumerate(sheet.sides):
            answered = {h[1]: h[2] for h in held[1:] if h[0] == side + 1}
            own = np.zeros(len(ids))
            for b, at in _split(ids % buckets):
                own[at] = unpack(answered[b], np.float64)
            values.append(own[sheet.places[side]])
        t = seat(sheet.counts, values[0] - sheet.tables, values[1], STRENGTH, discount, sheet.hash(), 2 * sweep)
        yield _messages([(bucket, 0, 0, *same, pack(np.concatenate([t, sheet.kept + t * counts])))])

    return _gathered(sheets.unionByName(answers), draw)


def _tables_by_word(sheets: DataFrame) -> DataFrame:
    """(side, id, t): the tables of all pairs of each first (side 0) and second word (1). Each task adds up its sheets,
    ``TOGETHER`` words and more at a time, before rows move."""

    def flush(held: list[list[tuple[np.ndarray, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        for side, own in enumerate(held):
            ids, at = np.unique(np.concatenate([h[0] for h in own]), return_inverse=True)
            t = np.bincount(at, weights=np.concatenate([h[1] for h in own]), minlength=len(ids)).astype(np.int64)
            arrays = [pa.array(np.full(len(ids), side, np.int32)), pa.array(ids), pa.array(t)]
            yield pa.RecordBatch.from_arrays(arrays, names=["side", "id", "t"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
        for batch in batches:
            for k in range(batch.num_rows):
                sheet = _Sheet(*[batch.column(c)[k].as_py() for c in "abcd"])
                for side, (ids, at) in enumerate(zip(sheet.sides, sheet.places)):
                    held[side].append((ids, np.bincount(at, weights=sheet.tables, minlength=len(ids))))
                if sum(len(h[0]) for own in held for h in own) >= TOGETHER:
                    yield from flush(held)
                    held = [[], []]
        if held[0]:
            yield from flush(held)

    rows = sheets.select("a", "b", "c", "d").mapInArrow(run, "side int, id bigint, t bigint")
    return rows.groupBy("side", "id").agg(F.sum("t").alias("t"))


def _discount(once: int, twice: int) -> float:
    return min(max(once / max(once + 2 * twice, 1), 0.05), 0.95)


class Model:
    """Counts and samples of a trained model."""

    def __init__(self, counts: DataFrame, words: int, buckets: int) -> None:
        self.base = 1 / (words + 1)
        self.discount = _discount(*_rare(counts))
        one = F.lit(1).cast("bigint")
        # At first each pair has one table, and so has each word at the parent.
        tables = F.col("single") + F.col("many")
        self.contexts = step(_by_side(counts, 0, "u").select("u", "total", "single", tables.alias("tables")))
        parent = step(_by_side(counts, 1, "w").select("w", "single", tables.alias("r"), one.alias("t")))
        self.sheets = step(_sheets(counts), LARGE_ROWS)
        n = parent.agg(*[F.count(F.when(F.col("r") == k, 1)).alias(f"n{k}") for k in (1, 2)]).first()
        self.parent_discount = _discount(n["n1"], n["n2"])
        others, self.unseen = parent.count(), []
        for sweep in range(BURN_IN + SAMPLES):
            counts = sweep >= BURN_IN
            superseded = [self.sheets, self.contexts, parent]
            drawn = step(_parent_sweep(parent, self.parent_discount, others, self.base, sweep))
            sums = drawn.agg(F.coalesce(F.sum("r"), F.lit(0)).alias("r"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
            others = sums["t"]
            left = (PARENT_STRENGTH + self.parent_discount * others) * self.base
            weight = 1 / (PARENT_STRENGTH + sums["r"])
            p = ((F.col("r") - self.parent_discount * F.col("t") + left) * weight).alias("p")
            answers = _side_answers(self.sheets, self.contexts.select("u", "tables"), drawn.select("w", p), buckets)
            self.sheets = step(_sweep(self.sheets, answers, buckets, self.discount, sweep, counts), LARGE_ROWS)
            del answers
            sums = step(_tables_by_word(self.sheets))
            # Samples that count stay as columns of their own: tables0, p0 and so on.
            own = sums.where("side = 0").select(F.col("id").alias("u"), "t")
            tables = (F.col("single") + F.coalesce("t", F.lit(0))).alias("tables")
            fresh = self.contexts.drop("tables").join(own, "u", "left").select("*", tables).drop("t")
            seats = drawn.withColumn("p", p) if counts else drawn
            if counts:
                fresh = fresh.withColumn(f"tables{len(self.unseen)}", F.col("tables"))
                seats = seats.withColumnRenamed("p", f"p{len(self.unseen)}")
                self.unseen.append(left * weight)
            self.contexts = step(fresh)
            more = sums.where("side = 1").select(F.col("id").alias("w"), F.col("t").alias("more"))
            r = (F.col("single") + F.coalesce("more", F.lit(0))).alias("r")
            after = seats.drop("r").join(more, "w", "left").select("*", r).drop("more")
            parent = step(after.withColumn("t", F.least("t", "r")))
            for old in [*superseded, drawn, sums]:
                forget(old)
        self.parent = parent

    def by_word(self) -> DataFrame:
        """(id, total, tables of each sample, p of each sample): a word as context, 0 if it is none, and as word."""
        seats = self.parent.select(F.col("w").alias("id"), *[f"p{k}" for k in range(SAMPLES)])
        both = self.contexts.withColumnRenamed("u", "id").join(seats, "id", "full")
        zero = [F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("total", *[f"tables{k}" for k in range(SAMPLES)])]
        return both.select("id", *zero, *[F.coalesce(f"p{k}", F.lit(p)).alias(f"p{k}") for k, p in enumerate(self.unseen)])


def _width() -> int:
    return 1 + 2 * SAMPLES


def _packed(rows: DataFrame, bucket: Column, kind: int, columns: list[str]) -> DataFrame:
    """Rows as messages of a kind to their buckets: the first column as it is, the others as one table of floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _larger(batches):
            key, *values = _columns(batch, "bucket", *columns)
            table = np.stack([v.astype(np.float64) for v in values[1:]], axis=1)
            rows = [(b, kind, 0, values[0][at].tobytes(), table[at].tobytes(), b"", b"") for b, at in _split(key)]
            if rows:
                yield _messages(rows)

    return rows.select(bucket.alias("bucket"), *columns).mapInArrow(run, _MESSAGE)


def _word_answers(known: DataFrame, model: Model, buckets: int) -> DataFrame:
    """Answers by slice (kind 1): the model's columns for its words."""

    def ask(key, kind, part, tokens, words, sizes, own) -> Iterator[pa.RecordBatch]:
        numbers = unpack(words, np.int64).reshape(2, -1)[0]
        rows = [(b, 1, key, numbers[at].tobytes(), b"", b"", b"") for b, at in _split(numbers % buckets)]
        yield _messages(rows)

    nothing = np.array([0.0] * (1 + SAMPLES) + model.unseen)

    def answer(bucket: int, held: list) -> Iterator[pa.RecordBatch]:
        told = [h for h in held if h[0] == 0]
        ids = np.concatenate([np.frombuffer(h[2], np.int64) for h in told] or [np.zeros(0, np.int64)])
        table = np.concatenate([np.frombuffer(h[3], np.float64) for h in told] or [np.zeros(0)]).reshape(-1, _width())
        order = np.argsort(ids)
        ids, table = np.append(ids[order], np.iinfo(np.int64).max), np.vstack([table[order], nothing])
        rows = []
        for h in held:
            if h[0] == 1:
                numbers = np.frombuffer(h[2], np.int64)
                at = np.searchsorted(ids, numbers)
                rows.append((h[1], 1, bucket, pack(table[np.where(ids[at] == numbers, at, len(ids) - 1)].astype(np.float32)), b"", b"", b""))
        if rows:
            yield _messages(rows)

    names = ["id", "total", *[f"{c}{k}" for c in ("tables", "p") for k in range(SAMPLES)]]
    told = _packed(model.by_word().where("id >= 0"), F.pmod("id", F.lit(buckets)), 0, names)
    return _gathered(told.unionByName(_each(known, ask)), answer)


def _pair_answers(counts: DataFrame, sheets: DataFrame) -> DataFrame:
    """Answers by slice (kind 2): the counts of its pairs and their tables, summed over the samples."""

    def answer(bucket: int, held: list) -> Iterator[pa.RecordBatch]:
        own = [_Sheet(*h[2:]) for h in held if h[0] == 0]
        for _, _, u, w, totals, where in (h for h in held if h[0] == 1):
            totals = unpack(totals, np.int64)
            kept = SAMPLES * np.minimum(totals, 1)
            for sheet in own:  # its pairs are in the same order
                kept[totals > 1] = sheet.kept
            yield _messages([(number, 2, bucket, pack(totals[at]), pack(kept[at]), b"", b"") for number, at in _asked(where)])

    return _gathered(sheets.unionByName(counts), answer)


def score_documents(documents: DataFrame, held_out: Column, id_col: str = "doc_id") -> DataFrame:
    """One row per document: its id, held_out, n_tokens, n_known, train_tokens, base_score (add-0.1 unigrams), score."""
    sliced = step(_sliced(documents, held_out, id_col), LARGE_ROWS)
    n_slices = sliced.count()
    buckets, pair_buckets = max(1, n_slices // SLICES_A_BUCKET), max(1, n_slices // SLICES_A_PAIR_BUCKET)
    answers = step(_word_counts(_word_asks(sliced, buckets), buckets), LARGE_ROWS)

    def sums(key, kind, part, numbers, counts, c, d) -> Iterator[pa.RecordBatch]:
        counts = unpack(counts, np.int64)
        arrays = [pa.array([int(np.count_nonzero(counts))]), pa.array([int(counts.sum())])]
        yield pa.RecordBatch.from_arrays(arrays, names=["words", "tokens"])

    found = _each(answers.where("key = -1"), sums, "words bigint, tokens bigint")
    found = found.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("words", "tokens")]).first()
    n_words, n_tokens = found["words"], found["tokens"]

    known = step(_numbered(sliced, answers, buckets), LARGE_ROWS)
    forget(sliced)
    forget(answers)
    counts = step(_pair_counts(_pair_asks(known, pair_buckets)), LARGE_ROWS)
    model = Model(counts, n_words, buckets)
    # Pair answers come first and in rounds of their buckets: counts, answers and the shuffle between them lie on disk
    # together, and the counts go before the words are answered.
    told = None
    for k in range(ANSWER_ROUNDS):
        own = F.pmod("key", F.lit(ANSWER_ROUNDS)) == k
        part = step(_pair_answers(counts.where(own), model.sheets.where(own)), LARGE_ROWS)
        told = part if told is None else told.unionByName(part)
    for old in (counts, model.sheets):
        forget(old)
    told = told.unionByName(step(_word_answers(known, model, buckets), LARGE_ROWS))
    first = model.by_word().where(F.col("id") == _START).first()
    at_start = [first["total"], *[first[f"tables{k}"] for k in range(SAMPLES)]] if first else [0.0] * (1 + SAMPLES)
    bottom = n_tokens + ADDED * (n_words + 1)
    discount = model.discount
    for old in (model.contexts, model.parent):  # all they say is in the answers
        forget(old)

    def score(key: int, held: list) -> Iterator[pa.RecordBatch]:
        _, _, tokens, words, sizes, own = held[0]
        own, sizes, tokens = _documents(own), unpack(sizes, np.int64), unpack(tokens, np.int32)
        numbers, counts = unpack(words, np.int64).reshape(2, -1)
        by_kind = {k: {h[1]: h for h in held[1:] if h[0] == k} for k in (1, 2)}
        table = np.zeros((len(numbers) + 1, _width()))
        table[-1, : 1 + SAMPLES] = at_start
        for bucket, at in _split(numbers % buckets):
            table[at] = unpack(by_kind[1][bucket][2], np.float32).reshape(-1, _width())
        pairs = _Pairs(tokens, numbers, sizes)
        left = np.zeros(len(pairs.u))
        for bucket, at in pairs.buckets(pair_buckets):
            totals, kept = (unpack(x, np.int64) for x in by_kind[2][bucket][2:4])
            left[at] = totals - discount * (kept / SAMPLES)  # of the counts after the discount, averaged over samples
        p = np.zeros(len(pairs.u))
        before = np.zeros(len(pairs.u), np.int64)
        before[pairs.at] = pairs.before
        for k in range(SAMPLES):
            p += left + (STRENGTH + discount * table[before, 1 + k]) * table[pairs.last, 1 + SAMPLES + k]
        p = np.log10(p / SAMPLES / (STRENGTH + table[before, 0]))[pairs.at]
        base = np.log10((counts + ADDED) / bottom)[tokens]
        starts = np.cumsum(sizes) - sizes
        arrays = [own.column("id").combine_chunks(), own.column("held").combine_chunks(), pa.array(sizes)]
        arrays += [pa.array(np.add.reduceat((counts > 0).astype(np.int64)[tokens], starts)), pa.array(np.full(len(sizes), n_tokens))]
        arrays += [pa.array(np.add.reduceat(x, starts)) for x in (base, p)]
        yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = documents.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return _gathered(known.unionByName(told), score, schema)
