"""Byte-level helpers for Arrow batches of whole texts.

A batch is worked off in slices of whole documents with a bounded number of bytes, so memory follows the slice
(or the single longest text), not the batch. Nothing here is cut short: every byte of every text is seen.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freightnet.llm.steps import step

SLICE_BYTES = 4 << 20
#: Rows in an Arrow batch: with it, a batch of long texts stays at some tens of MB.
BATCH_ROWS = 1000

_RNG = np.random.default_rng(20240607)
#: A random value per byte; upper-case A-Z share the value of the lower-case letter.
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)

SPACES = [0x20, *range(0x09, 0x0E)]


def byte_set(members: list[int], inside: bool = True) -> np.ndarray:
    """Boolean table over the 256 byte values."""
    table = np.full(256, not inside)
    table[members] = inside
    return table


#: Bytes of words between ASCII white space.
WORD_BY_SPACE = byte_set(SPACES, inside=False)
#: Bytes of words of ASCII letters, digits and anything beyond ASCII.
WORD_BY_LETTER = byte_set([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that all their bits can be used."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class _Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 20)
            steps = np.full(n, _BASE, np.uint64)
            back = np.full(n, _INVERSE, np.uint64)
            steps[0] = back[0] = 1
            self.up, self.down = np.multiply.accumulate(steps), np.multiply.accumulate(back)
        return self.up, self.down


_POWERS = _Powers()


@dataclass
class Slice:
    """Whole texts behind each other; each text is followed by one newline that is not part of it."""

    rows: np.ndarray  # position of each text in its batch
    data: np.ndarray  # uint8
    starts: np.ndarray  # first byte of each text
    ends: np.ndarray  # first byte after each text

    def words(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each word, and the number of words up to each text (len(rows) + 1 values)."""
        inside = np.zeros(len(self.data) + 2, np.int8)
        inside[1:-1] = table[self.data]
        edge = np.diff(inside)
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        bounds = np.append(np.searchsorted(first, self.starts), len(first))
        return first, last, bounds

    def hashes(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """64-bit hash of the bytes of each span, A-Z folded to lower case."""
        up, down = _POWERS.get(len(self.data))
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * up[: len(self.data)], out=sums[1:])
        return mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))


def slices(column: pa.ChunkedArray | pa.Array, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string column into slices of whole texts; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, pa.scalar("", column.type))
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    at = 0
    before = np.append(0, np.cumsum(sizes))
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(before, before[at] + most, "right")) - 1)
        part = column.slice(at, to - at)
        text = pc.binary_join_element_wise(part, pa.scalar("", part.type), pa.scalar("\n", part.type))
        if isinstance(text, pa.ChunkedArray):
            text = text.combine_chunks()
        width = np.int64 if pa.types.is_large_string(text.type) else np.int32
        offsets = np.frombuffer(text.buffers()[1], width)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        yield Slice(np.arange(at, to), data, offsets[:-1], offsets[1:] - 1)
        at = to


#: Bytes of a slice of training texts on the driver.
TRAINING_SLICE = 1 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the rows of an Arrow batch for this session: whole texts are long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) <= 0 or int(spark.conf.get(name)) > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def text_of(df: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and the text as a string, for functions over Arrow batches."""
    small_batches(df.sparkSession)
    return df.select(*keep, F.col("text").cast("string").alias("text"))


def as_arrow(df: DataFrame, function, schema: str | T.StructType) -> DataFrame:
    """mapInArrow for functions from one record batch to one dict of columns or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = function(batch)
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


def one_text(documents: DataFrame, id_col: str) -> DataFrame:
    """(id, version, size): hash and length of one text of each id, that of the least hash."""
    own = F.struct(F.xxhash64("text").alias("version"), F.length("text").alias("size"))
    found = documents.where(F.col("text").isNotNull()).groupBy(id_col).agg(F.min(own).alias("own"))
    return found.select(id_col, "own.*")


def chosen_texts(documents: DataFrame, chosen: DataFrame, id_col: str) -> DataFrame:
    """(__id, text, ...): the text of each of a few ids with ``version``, one row however many documents repeat it."""
    few = F.broadcast(chosen.withColumnsRenamed({id_col: "__id", "version": "__version"}))
    own = (F.col(id_col) == F.col("__id")) & (F.xxhash64("text") == F.col("__version"))
    rows = documents.select(id_col, "text").join(few, own).drop(id_col, "__version")
    return rows.groupBy(*[c for c in rows.columns if c != "text"]).agg(F.min("text").alias("text"))


def labelled_sample(
    documents: DataFrame, labelled: DataFrame, most: dict[int, int], most_chars: int, long_chars: int, id_col: str
) -> DataFrame:
    """(h: hash of the id, text, label) of a bounded sample: by label at most ``most`` texts by the hash of their id, those of
    at most ``most_chars`` characters first. Longer ones fill up what is missing, whole ones in order while they have
    ``long_chars`` together at most; the first of a label is cut there. ``labelled`` has one row (id, label) per id.

    Choice is among ids of documents that exist. An id has one text in it, that of the least hash, however many rows
    repeat the id."""
    # The ids of labelled documents that exist, with hash and length of their text; texts stay where they are.
    known = step(labelled.join(one_text(documents, id_col), id_col))
    chosen = None
    for label, limit in most.items():
        order = (F.col("size") > most_chars, F.xxhash64(id_col), F.col(id_col))
        picks = known.where(F.col("label") == label).orderBy(*order).limit(limit)
        chosen = picks if chosen is None else chosen.unionByName(picks)
    # At most as many rows as the limits allow: the running total of the long ones.
    own = F.when(F.col("size") > most_chars, F.col("size")).otherwise(0)
    order = Window.partitionBy("label").orderBy(F.xxhash64(id_col), id_col).rowsBetween(Window.unboundedPreceding, 0)
    chosen = chosen.withColumn("total", F.sum(own).over(order))
    fits = (F.col("size") <= most_chars) | (F.col("total") <= long_chars) | (F.col("total") == F.col("size"))
    rows = chosen_texts(documents, chosen.where(fits), id_col)
    return rows.select(F.xxhash64("__id").alias("h"), F.substring("text", 1, long_chars).alias("text"), F.col("label").cast("int"))


def collected(sample: DataFrame) -> list[tuple[int, str, int]]:
    """The rows of a bounded sample in an order that does not depend on tasks."""
    return sorted((r["h"], r["text"], r["label"]) for r in sample.collect())


def fitted_in_a_task(sample: DataFrame, fit: Callable[[list[str], list[int]], object]) -> object:
    """What ``fit`` makes of the texts and labels of a bounded sample: in one task, so that only the model reaches the
    driver. A lost task is run again and comes to the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(row for b in batches for row in zip(*[b.column(c).to_pylist() for c in ("h", "text", "label")]))
        model = fit([t for _, t, _ in rows], [y for _, _, y in rows])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    found = sample.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(found["model"]) if found else fit([], [])
