"""Removal of passages that an earlier document already has, by suffix arrays over shards.

A passage is a string of ``length`` bytes that also starts in a document with a smaller id; every byte under one goes.

Equal passages must meet in one shard without moving all suffixes. Every string of ``length`` bytes names one of its own
places, the one whose ``GRAM`` bytes have the least hash; equal strings name the same place. These anchors, about one in
seventeen bytes, go through three steps:

1. Their hashes meet by value, in packed blobs; only those that two different texts share go on.
2. The bytes of the strings that name a shared anchor go to the shard of its hash: from the first such string to the end
   of the last one. A shard joins its distinct pieces to one text and builds the suffix array by induced sorting and the
   permuted common prefixes; runs of suffixes that share ``length`` bytes give each string its smallest document, and each
   piece the places to remove.
3. The places of a text come together and are removed.

Equal texts are one text from the start: later copies go as a whole. Of equal pieces in a slice of texts only those of the
smallest document go to the shard, as all others are under earlier strings whatever else there is; these travel without
their bytes, under keys of their own. So a passage that very many texts share sends its shard some pieces a slice, and
shards grow in number with the input, not in size.

Defined cases: NULL and empty texts have no bytes; a NULL id counts as larger than all others; rows with equal id and
text are not repeats of each other; texts shorter than ``length`` lose nothing; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightnet.llm.steps import step
from freightnet.llm.suffixes import permuted_common_prefixes, suffix_array
from freightnet.llm.texts import _POWERS, Slice, as_arrow, mix, slices, small_batches
from freightnet.scale import cut

LENGTH, GRAM = 50, 16
#: Bytes of text per part of the anchor hashes, and bytes of pieces per shard: both are worked off in memory.
PART_BYTES, SHARD_BYTES = 64 << 20, 2 << 20
#: Ids are compared as numbers; NULL is beyond them all.
NO_ID = 2**63 - 1
_BYTE = np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Ends a piece within a shard: a byte that UTF-8 never uses.
_END = 0xFF


def _grams(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes from each place, of hashes of half as many."""
    one = _BYTE[data]
    h, width = one, 1
    for bit in bin(gram)[3:]:
        h, width = h[:-width] * np.uint64(pow(int(_STEP), width, 2**64)) + h[width:], 2 * width
        if bit == "1":
            h, width = h[:-1] * _STEP + one[width:], width + 1
    return mix(h)


def anchors(part: Slice, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text (index in the slice), place in it, hash of every anchor, and how far before it the first and the last string
    begin that name it (one row each).

    A hash carries its place, modulo a power of two beyond the places in a string, in its low bits: the least of a string
    tells both. Of equal hashes one is named; equal strings may then name another one of them, which has the same hash."""
    n, width = len(part.data) - gram + 1, length - gram + 1
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none, none.astype(np.uint64), np.zeros((2, 0), np.uint8)
    bits = int(width).bit_length()
    low = np.uint64((1 << bits) - 1)
    least, size = _grams(part.data, gram), 1
    least &= ~low
    least |= np.arange(n, dtype=np.uint64) & low
    # Least hash of each window, windows of doubling width.
    while size < width:
        shift = min(size, width - size)
        least = np.minimum(least[shift:], least[:-shift])
        size += shift
    # Only windows inside a text count.
    edge = np.zeros(len(part.data) + 1, np.int8)
    long = part.ends - part.starts >= length
    np.add.at(edge, part.starts[long], 1)
    np.add.at(edge, part.ends[long] - length + 1, -1)
    inside = np.flatnonzero(np.cumsum(edge[: len(least)], dtype=np.int8) > 0)
    named = least[inside]
    place = inside + ((named - inside.astype(np.uint64)) & low).astype(np.int64)
    # Runs of strings, one behind the other, that name the same place.
    new = np.append(True, place[1:] != place[:-1])[: len(place)]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(place))[: len(first)] - 1
    at = place[first]
    text = np.searchsorted(part.starts, at, "right") - 1
    reach = np.stack([at - inside[first], at - inside[last]]).astype(np.uint8)
    return text, at - part.starts[text], named[first] >> np.uint64(bits), reach


def _blob(values: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(values, kind).tobytes()


def _unblob(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _whole_groups(df: DataFrame, key: str, function, schema: str) -> DataFrame:
    """Bring the rows of each key together and call ``function`` with all batches of one key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            keys = batch.column(key).to_numpy(zero_copy_only=False)
            cuts = np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys))
            for a, b in zip(cuts[:-1], cuts[1:]):
                if held and held[-1].column(key)[0].as_py() != keys[a]:
                    yield from function(held)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from function(held)

    return df.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def _shared_anchors(texts: DataFrame, parts: int, length: int) -> DataFrame:
    """(tid, places): the anchors of each text that another text has too, each with the reach of its strings in the low
    two bytes."""
    packed = pa.schema([("part", pa.int32()), ("hashes", pa.binary()), ("tids", pa.binary()), ("places", pa.binary())])

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        tids, rows = batch.column("tid").to_numpy(), []
        for piece in slices(batch.column("text")):
            text, place, h, reach = anchors(piece, length)
            place = (place << 16) | (reach[0].astype(np.int64) << 8) | reach[1]
            # The part from the upper half of the hash; within a part the lower half identifies an anchor, as other
            # anchors that agree in it cost work but change nothing.
            part = ((h >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)
            by = np.argsort(part, kind="stable")
            cuts = np.append(0, np.cumsum(np.bincount(part, minlength=parts)))
            for k in np.flatnonzero(np.diff(cuts)):
                own = by[cuts[k] : cuts[k + 1]]
                low = h[own] & np.uint64(0xFFFFFFFF)
                rows.append(
                    (int(k), _blob(low, "<u4"), _blob(tids[piece.rows[text[own]]], "<i8"), _blob(place[own], "<i8"))
                )
        return _batch(rows, packed) if rows else None

    found = pa.schema([("bucket", pa.int32()), ("tids", pa.binary()), ("places", pa.binary())])

    def meet(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = np.concatenate([_unblob(b.column("hashes"), "<u4") for b in held])
        tids = np.concatenate([_unblob(b.column("tids"), "<i8") for b in held])
        places = np.concatenate([_unblob(b.column("places"), "<i8") for b in held])
        by = np.lexsort((tids, hashes))
        hashes, tids, places = hashes[by], tids[by], places[by]
        first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        last = np.append(first[1:], len(hashes)) - 1
        shared = np.repeat(tids[first] != tids[last], last - first + 1)
        tids, places = tids[shared], places[shared]
        # Back to their texts, packed again: each bucket of texts gets one row from each part.
        bucket = (mix(tids.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        cuts = np.append(0, np.cumsum(np.bincount(bucket, minlength=parts)))
        for k in np.flatnonzero(np.diff(cuts)):
            own = by[cuts[k] : cuts[k + 1]]
            yield _batch([(int(k), _blob(tids[own], "<i8"), _blob(places[own], "<i8"))], found)

    each = pa.schema([("tid", pa.int64()), ("places", pa.binary())])

    def gather(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tids = np.concatenate([_unblob(b.column("tids"), "<i8") for b in held])
        places = np.concatenate([_unblob(b.column("places"), "<i8") for b in held])
        by = np.argsort(tids, kind="stable")
        tids, places = tids[by], places[by]
        cuts = np.append(np.flatnonzero(np.append(True, tids[1:] != tids[:-1])), len(tids))
        # Copies of a text name the same places.
        rows = [(int(tids[a]), _blob(np.unique(places[a:b]), "<i8")) for a, b in zip(cuts[:-1], cuts[1:])]
        for k in range(0, len(rows), 5000):
            yield _batch(rows[k : k + 5000], each)

    packed_rows = as_arrow(texts, pack, "part int, hashes binary, tids binary, places binary")
    met = _whole_groups(packed_rows, "part", meet, "bucket int, tids binary, places binary")
    return _whole_groups(met, "bucket", gather, "tid bigint, places binary")


_PIECES = pa.schema(
    [("shard", pa.int32()), ("owners", pa.binary()), ("firsts", pa.binary()), ("starts", pa.binary()),
     ("sizes", pa.binary()), ("bytes", pa.binary())]
)


def _pieces(texts: DataFrame, shards: int, length: int) -> DataFrame:
    """(tid, first, text, places) to the bytes of the strings that name each shared anchor, packed by shard; under negative
    keys the places of pieces that go as a whole."""

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        tids, firsts, rows = batch.column("tid").to_numpy(), batch.column("first").to_numpy(), []
        places, none = batch.column("places").to_pylist(), np.zeros(0, np.uint8)
        for piece in slices(batch.column("text")):
            wanted = [np.frombuffer(places[r], "<i8") for r in piece.rows]
            text = np.repeat(np.arange(len(wanted)), [len(w) for w in wanted])
            wanted = np.concatenate(wanted)
            at = (wanted >> 16) + piece.starts[text]
            start = at - (wanted >> 8 & 255)
            size = at - (wanted & 255) + length - start
            h = np.zeros(len(at), np.uint64)
            for k in range(GRAM):
                h = h * _STEP + _BYTE[piece.data[at + k]]
            shard = (mix(mix(h) ^ _STEP) % np.uint64(shards)).astype(np.int64)
            # A piece that a smaller document of the slice has too is known to go: its key is beyond the shards.
            _, equal = np.unique(_contents(piece.data, start, size), return_inverse=True)
            first = firsts[piece.rows[text]]
            smallest = np.full(len(equal), NO_ID)
            np.minimum.at(smallest, equal, first)
            shard = np.where(smallest[equal] < first, shards, shard)
            by = np.argsort(shard, kind="stable")
            cuts = np.append(0, np.cumsum(np.bincount(shard, minlength=shards + 1)))
            row = piece.rows[text]
            for k in np.flatnonzero(np.diff(cuts)):
                own = by[cuts[k] : cuts[k + 1]]
                # Bytes only where a shard is to search them.
                content = piece.data[_ranges(start[own], size[own])] if k < shards else none
                place = start[own] - piece.starts[text[own]]
                key = int(k) if k < shards else -1 - int(tids[row[own[0]]]) % shards
                rows.append(
                    (key, _blob(tids[row[own]], "<i8"), _blob(firsts[row[own]], "<i8"), _blob(place, "<i4"),
                     _blob(size[own], "u1"), content.tobytes())
                )
        return _batch(rows, _PIECES) if rows else None

    return as_arrow(texts, pack, "shard int, owners binary, firsts binary, starts binary, sizes binary, bytes binary")


def _contents(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes of each piece."""
    up, down = _POWERS.get(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[start + size] - sums[start]) * down[start] + size.astype(np.uint64))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the given ranges behind each other."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


def _search_shard(data: np.ndarray, size: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
    """Smallest document of the string at each place of pieces that lie behind each other, each ended by one byte;
    NO_ID where no whole string begins."""
    order = suffix_array(data, length)
    shared = permuted_common_prefixes(data, order, length)
    ends = np.cumsum(size + 1) - 1
    piece = np.repeat(np.arange(len(size)), size + 1)
    whole = ends[piece] - np.arange(len(data)) >= length
    # Runs of suffixes that share a whole string; the rest are runs of their own.
    head = np.append(True, (shared[order[1:]] < length) | ~whole[order[1:]] | ~whole[order[:-1]])
    runs = np.flatnonzero(head)
    smallest = np.minimum.reduceat(first[piece[order]], runs)
    out = np.full(len(data), NO_ID)
    out[order] = np.repeat(smallest, np.diff(np.append(runs, len(order))))
    out[~whole] = NO_ID
    return out


_SPANS = pa.schema([("tid", pa.int64()), ("starts", pa.binary()), ("ends", pa.binary())])


def _spans(pieces: DataFrame, length: int) -> DataFrame:
    """(tid, starts, ends): the bytes of each text to remove, in overlapping spans; several rows per text."""

    def search(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner = np.concatenate([_unblob(b.column("owners"), "<i8") for b in held])
        first = np.concatenate([_unblob(b.column("firsts"), "<i8") for b in held])
        start = np.concatenate([_unblob(b.column("starts"), "<i4") for b in held])
        size = np.concatenate([_unblob(b.column("sizes"), "u1") for b in held]).astype(np.int64)
        if held[0].column("shard")[0].as_py() < 0:
            yield from spans(owner, start, start + size)
            return
        data = np.concatenate([_unblob(b.column("bytes"), "u1") for b in held])
        # Equal pieces are searched once, for the smallest document that has them.
        at = np.cumsum(size) - size
        content = [hashlib.blake2b(data[a : a + s], digest_size=16).digest() for a, s in zip(at, size)]
        _, some, which = np.unique(np.array(content, "V16").view("S16"), return_index=True, return_inverse=True)
        which = which.ravel()
        own_first = np.full(len(some), NO_ID)
        np.minimum.at(own_first, which, first)
        own_size = size[some]
        joined = np.full(int((own_size + 1).sum()), _END, np.uint8)
        begin = np.cumsum(own_size + 1) - (own_size + 1)
        joined[_ranges(begin, own_size)] = data[_ranges(at[some], own_size)]
        smallest = _search_shard(joined, own_size, own_first, length)
        # For each place of the distinct pieces: does the string there belong to a smaller document than the owner's?
        count = np.maximum(size - length + 1, 0)
        place = _ranges(begin[which], count)
        mine = np.repeat(np.arange(len(size)), count)
        gone = smallest[place] < first[mine]
        mine, offset = mine[gone], (place - begin[which][mine])[gone]
        new = np.append(True, (mine[1:] != mine[:-1]) | (offset[1:] != offset[:-1] + 1)) if len(mine) else np.zeros(0, bool)
        run = np.flatnonzero(new)
        end = np.append(run[1:], len(mine)) - 1 if len(run) else run
        yield from spans(owner[mine[run]], start[mine[run]] + offset[run], start[mine[run]] + offset[end] + length)

    def spans(tid: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[pa.RecordBatch]:
        by = np.lexsort((low, tid))
        tid, low, high = tid[by], low[by], high[by]
        cuts = np.append(np.flatnonzero(np.append(True, tid[1:] != tid[:-1])) if len(tid) else [], len(tid)).astype(int)
        rows = [(int(tid[a]), _blob(low[a:b], "<i4"), _blob(high[a:b], "<i4")) for a, b in zip(cuts[:-1], cuts[1:])]
        for k in range(0, len(rows), 5000):
            yield _batch(rows[k : k + 5000], _SPANS)

    return _whole_groups(pieces, "shard", search, "tid bigint, starts binary, ends binary")


def _removed(texts: DataFrame) -> DataFrame:
    """(tid, text, starts, ends: lists of blobs) to tid, spans, n_removed, kept_sha256."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def remove(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans, gone, digests = [], [], []
        for text, starts, ends in zip(*[batch.column(c).to_pylist() for c in ("text", "starts", "ends")]):
            data = np.frombuffer(text.encode(), np.uint8)
            low, high = (np.frombuffer(b"".join(x), "<i4").astype(np.int64) for x in (starts, ends))
            by = np.argsort(low, kind="stable")
            low, high = low[by], np.maximum.accumulate(high[by])
            new = np.flatnonzero(np.append(True, low[1:] > high[:-1]))
            low, high = low[new], high[np.append(new[1:], len(high)) - 1]
            out = np.zeros(len(data) + 1, np.int8)
            out[low] += 1
            out[high] -= 1
            out = np.cumsum(out[:-1]) > 0
            spans.append([{"start": int(a), "end": int(b)} for a, b in zip(low, high)])
            gone.append(int(out.sum()))
            digests.append(hashlib.sha256(data[~out].tobytes()).hexdigest())
        columns = [batch.column("tid"), pa.array(spans, kind), pa.array(gone, pa.int64()), pa.array(digests, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["tid", "spans", "n_removed", "kept_sha256"])

    schema = "tid bigint, spans array<struct<start:bigint,end:bigint>>, n_removed bigint, kept_sha256 string"
    return as_arrow(texts, remove, schema)


def remove_repeats(documents: DataFrame, length: int = LENGTH, id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, spans (removed bytes, end exclusive, in order) and
    kept_sha256 (of the bytes that are left, joined)."""
    if not GRAM <= length <= 128:
        raise ValueError("a string is at least as long as an anchor, and a piece of two strings fits a byte")
    small_batches(documents.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = documents.select(F.xxhash64(text).alias("tid"), text.alias("text"))
    rows = cut(
        documents.select(
            F.col(id_col),
            F.xxhash64(text).alias("tid"),
            F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("__id"),
            F.octet_length(text).cast("bigint").alias("n_bytes"),
            F.sha2(F.encode(text, "utf-8"), 256).alias("__sha"),
        )
    )
    firsts = rows.groupBy("tid").agg(F.min("__id").alias("first"))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0

    shared = step(_shared_anchors(texts, max(1, -(-total // PART_BYTES)), length))
    wanted = shared.join(firsts, "tid")
    bytes_ = (shared.agg(F.sum(F.octet_length("places"))).first()[0] or 0) // 8 * (length + (length - GRAM) // 2)
    shards = max(1, -(-bytes_ // SHARD_BYTES))
    candidates = step(texts.join(wanted, "tid").dropDuplicates(["tid"]).select("tid", "first", "text", "places"))
    spans = step(_spans(_pieces(candidates, shards, length), length))
    spans = spans.groupBy("tid").agg(F.collect_list("starts").alias("starts"), F.collect_list("ends").alias("ends"))
    changed = _removed(candidates.select("tid", "text").join(spans, "tid").select("tid", "text", "starts", "ends"))

    out = rows.join(firsts, "tid").join(changed, "tid", "left")
    copy = (F.col("__id") > F.col("first")) & (F.col("n_bytes") >= length)
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    every = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_bytes").alias("end")))
    out = out.withColumn("spans", F.when(copy, every).otherwise(F.coalesce("spans", none)))
    empty = hashlib.sha256(b"").hexdigest()
    return out.select(
        id_col,
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        "spans",
        F.when(copy, F.lit(empty)).otherwise(F.coalesce("kept_sha256", "__sha")).alias("kept_sha256"),
    )
