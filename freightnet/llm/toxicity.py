"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text is read as overlapping windows of words. The input of a word is the sum of its own embedding and of those of its
character n-grams (with marks for the beginning and end of the word), all hashed. Two gated recurrent networks run over
each window in both directions, attention pools their states, and one logit judges the window. The score of a text is
the calibrated logit of its worst window, so one bad passage in a very long text counts and its length does not.

Only whole texts carry labels. Training picks the window that speaks most for the label in each toxic text, and the
window that speaks most against it in each clean one, again in every round. It sees a bounded sample of labelled texts,
long ones only where there are too few others, and then as a whole; scoring sees every window of every text, where the
texts are: no shuffle.

Defined cases: NULL and empty texts have no window and the score of one that says nothing; label rows without a label or
a text are ignored, rows that disagree count as toxic; without any toxic or any clean labelled text all scores are the
share of toxic ones, or one half without labels; repeated rows get equal scores; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightnet.llm.texts import (
    TRAINING_SLICE,
    WORD_BY_LETTER,
    Slice,
    as_arrow,
    fitted_in_a_task,
    labelled_sample,
    slices,
    small_batches,
)

WORDS, STRIDE = 128, 64
#: Windows, and rows of a product, that scoring always works on together: products round alike only at one shape.
TOGETHER = 1024
BUCKETS, INPUTS, STATES = 1 << 15, 12, 8
GRAMS = (3, 5)
#: The training sample: most toxic and clean texts. Texts of more than MOST_CHARS characters fill up what is missing, whole
#: ones in order while all of a label have LONG_CHARS at most; the first of them is cut there.
MOST_TOXIC, MOST_CLEAN, MOST_CHARS, LONG_CHARS = 1000, 2500, 20_000, 6_000_000
ROUNDS, BATCH, RATE = 6, 256, 0.02
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += 32
_FOLD += 3


@dataclass
class Vocabulary:
    """Distinct words of some texts: hashed word, hashed n-grams with the word they belong to, and each word's place."""

    key: np.ndarray
    word: np.ndarray
    gram: np.ndarray
    owner: np.ndarray
    ids: np.ndarray  # distinct word of each running word
    bounds: np.ndarray  # running words up to each text


def vocabulary(part: Slice) -> Vocabulary:
    first, last, bounds = part.words(WORD_BY_LETTER)
    hashes, at, ids = np.unique(part.hashes(first, last), return_index=True, return_inverse=True)
    first, size = first[at], (last - first)[at] + 2
    end = np.cumsum(size)
    start = end - size
    owner = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(owner)) - start[owner]
    codes = np.full(len(owner), 1, np.uint64)
    inner = (place > 0) & (place < size[owner] - 1)
    codes[inner] = _FOLD[part.data[(first[owner] + place - 1)[inner]]]
    codes[place == size[owner] - 1] = 2
    grams, owners = [], []
    for n in GRAMS:
        here = np.flatnonzero(place + n <= size[owner])
        h = np.full(len(here), n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[here + k]
        h ^= h >> np.uint64(29)
        grams.append((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(49))
        owners.append(owner[here])
    word = (hashes >> np.uint64(49)).astype(np.int64)
    return Vocabulary(hashes, word, np.concatenate(grams).astype(np.int32), np.concatenate(owners), ids.ravel(), bounds)


def _merged(parts: list[Vocabulary]) -> Vocabulary:
    """The vocabulary of several slices behind each other; each word keeps the n-grams of the slice that has it first."""
    key, first, place = np.unique(np.concatenate([v.key for v in parts]), return_index=True, return_inverse=True)
    place = place.ravel()
    at, ids, bounds, grams, owners = 0, [], [np.zeros(1, np.int64)], [], []
    for v in parts:
        own = place[at : at + len(v.key)]
        new = first[own] == np.arange(at, at + len(v.key))
        keep = new[v.owner]
        grams.append(v.gram[keep].astype(np.int32))
        owners.append(own[v.owner[keep]].astype(np.int32))
        ids.append(own[v.ids].astype(np.int32))
        bounds.append(v.bounds[1:] + bounds[-1][-1])
        at += len(v.key)
    owner = np.concatenate(owners)
    by = np.argsort(owner, kind="stable")
    word = (key >> np.uint64(49)).astype(np.int64)
    return Vocabulary(key, word, np.concatenate(grams)[by], owner[by], np.concatenate(ids), np.concatenate(bounds))


def windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and number of words of all windows; each text with words has one at least."""
    n = np.diff(bounds)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WORDS) // STRIDE)), 0)
    text = np.repeat(np.arange(len(n)), count)
    step = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = bounds[text] + step * STRIDE
    return text, start, np.minimum(WORDS, bounds[text + 1] - start)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """The weights by name, the calibration of the worst window's logit, and the score without any evidence."""

    w: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0
    constant: float | None = None

    def inputs(self, v: Vocabulary) -> np.ndarray:
        x = self.w["word"][v.word]
        for k in range(x.shape[1]):
            x[:, k] += np.bincount(v.owner, self.w["gram"][v.gram, k], len(v.word)).astype(x.dtype)
        return x

    def _direction(self, p: np.ndarray, ids: np.ndarray, live: np.ndarray, side: str, keep: bool):
        """States (words, windows, STATES) of one direction; p: projected distinct words, ids: (words, windows)."""
        rec, steps = self.w["rec_" + side], range(len(ids))
        h = np.zeros((ids.shape[1], STATES), p.dtype)
        states, saved = np.empty((len(ids), *h.shape), p.dtype), []
        for t in steps if side == "f" else reversed(steps):
            a, u = p[ids[t]], h @ rec
            gates = _sigmoid(a[:, : 2 * STATES] + u[:, : 2 * STATES])
            r, z = gates[:, :STATES], gates[:, STATES:]
            new = np.tanh(a[:, 2 * STATES :] + r * u[:, 2 * STATES :])
            m = live[t][:, None]
            if keep:
                saved.append((t, h, r, z, new, u[:, 2 * STATES :], m))
            h = np.where(m, z * h + (1 - z) * new, h)
            states[t] = h
        return states, saved

    def forward(self, x: np.ndarray, ids: np.ndarray, live: np.ndarray, keep: bool = False):
        """Logit of each window; ids and live are (words, windows)."""
        sides = []
        for s in ("f", "b"):
            sides.append(self._direction(_product(x, self.w["in_" + s]) + self.w["bias_" + s], ids, live, s, keep))
        states = np.concatenate([s[0] for s in sides], axis=2)
        e = np.where(live, (states * self.w["attend"]).sum(axis=2), -1e9)
        e = np.exp(e - e.max(axis=0))
        alpha = (e / e.sum(axis=0)).astype(x.dtype)
        pooled = np.einsum("tb,tbh->bh", alpha, states)
        logit = (pooled * self.w["out"]).sum(axis=1) + self.w["bias"][0]
        return logit, (sides, states, alpha, pooled) if keep else None

    def gradient(self, x: np.ndarray, ids: np.ndarray, live: np.ndarray, target: np.ndarray, weight: np.ndarray):
        """Mean weighted log loss, its gradient for each weight but the embeddings, and for the inputs ``x``."""
        logit, (sides, states, alpha, pooled) = self.forward(x, ids, live, keep=True)
        loss = np.mean(weight * (np.logaddexp(0, logit) - target * logit))
        d = weight * (_sigmoid(logit) - target) / len(target)
        g = {"out": d @ pooled, "bias": np.array([d.sum()], x.dtype)}
        dpool = d[:, None] * self.w["out"]
        dalpha = np.einsum("bh,tbh->tb", dpool, states)
        de = alpha * (dalpha - (alpha * dalpha).sum(axis=0))
        g["attend"] = np.einsum("tb,tbh->h", de, states)
        dstates = alpha[:, :, None] * dpool + de[:, :, None] * self.w["attend"]
        dx = np.zeros_like(x)
        for k, s in enumerate(("f", "b")):
            rec, w_in = self.w["rec_" + s], self.w["in_" + s]
            dh, drec = np.zeros_like(dpool[:, :STATES]), np.zeros_like(rec)
            every = np.empty((*ids.shape, 3 * STATES), x.dtype)
            for t, h, r, z, new, un, m in reversed(sides[k][1]):
                dh = dh + dstates[t, :, k * STATES : (k + 1) * STATES]
                on = np.where(m, dh, 0)
                dnew = on * (1 - z) * (1 - new * new)
                da = np.concatenate([dnew * un * r * (1 - r), on * (h - new) * z * (1 - z), dnew], axis=1)
                du = da.copy()
                du[:, 2 * STATES :] *= r
                drec += h.T @ du
                every[t] = da
                dh = np.where(m, on * z, dh) + du @ rec.T
            dp = np.stack([np.bincount(ids.ravel(), every[:, :, c].ravel(), len(x)) for c in range(3 * STATES)], axis=1)
            dp = dp.astype(x.dtype)
            g["rec_" + s], g["in_" + s], g["bias_" + s] = drec, x.T @ dp, dp.sum(axis=0)
            dx += dp @ w_in.T
        return loss, g, dx

    def logits(self, v: Vocabulary, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Logit of the windows that begin at ``at``: the same bits for the same words, whatever else is scored with them.

        Every block has TOGETHER windows of WORDS words; the last one is filled up with windows of one word.
        """
        n = len(at)
        x, out = self.inputs(v), np.zeros(-(-n // TOGETHER) * TOGETHER, np.float32)
        at, size = (np.append(a, np.full(len(out) - len(a), fill)) for a, fill in ((at, 0), (size, 1)))
        for k in range(0, len(out), TOGETHER):
            block = slice(k, k + TOGETHER)
            out[block] = self.forward(x, *_matrix(v, at[block], size[block], WORDS))[0]
        return out[:n]

    def score_texts(self, part: Slice) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(part.rows), self.constant)
        v = vocabulary(part)
        text, at, size = windows(v.bounds)
        worst = np.full(len(part.rows), -np.inf)
        if len(at):
            np.maximum.at(worst, text, self.logits(v, at, size))
        worst[np.isinf(worst)] = self.w["bias"][0]
        return _sigmoid(self.scale * worst.astype(np.float64) + self.shift)


def _product(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w in blocks of one shape, the last one filled up with zeros."""
    filled = np.zeros((-(-len(x) // TOGETHER) * TOGETHER, x.shape[1]), x.dtype)
    filled[: len(x)] = x
    return (filled.reshape(-1, TOGETHER, x.shape[1]) @ w).reshape(-1, w.shape[1])[: len(x)]


def _matrix(v: Vocabulary, at: np.ndarray, size: np.ndarray, words: int = 0) -> tuple[np.ndarray, np.ndarray]:
    steps = np.arange(words or int(size.max()))[:, None]
    live = steps < size
    return v.ids[np.where(live, at + steps, at)], live


def _evidence(v: Vocabulary, ids: np.ndarray, owner: np.ndarray, toxic: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Log odds that a text with a hashed feature is toxic, less for rare ones, 0 below three texts.

    Long texts hold more features whatever their label, so they are compared with each other only."""
    begin = np.searchsorted(owner, np.arange(len(v.word) + 1))  # owners are in order
    kinds = [k for k in (~long, long) if len(np.unique(toxic[k])) == 2] or [np.ones(len(toxic), bool)]
    every, level = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for kind in kinds:
        bad, seen_in = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for k in np.flatnonzero(kind):
            words = np.unique(v.ids[v.bounds[k] : v.bounds[k + 1]])
            size = begin[words + 1] - begin[words]
            place = np.repeat(begin[words] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            seen = np.unique(ids[place])
            seen_in[seen] += 1
            bad[seen] += toxic[k]
        odds = np.log((bad + 0.5) / (toxic[kind].sum() + 1)) - np.log((seen_in - bad + 0.5) / ((~toxic[kind]).sum() + 1))
        every += seen_in
        level += odds * seen_in
    odds = level / np.maximum(every, 1)
    return np.where(every >= 3, np.clip(odds, -1, 4) * every / (every + 5), 0)


def train(texts: Sequence[str], labels: Sequence[int], rounds: int = ROUNDS, seed: int = 7) -> Network:
    """Fit the network to whole labelled texts."""
    toxic = np.array(labels, bool)
    if not len(toxic) or toxic.all() or not toxic.any():
        return Network({}, constant=float(toxic.mean()) if len(toxic) else 0.5)
    rng = np.random.default_rng(seed)
    v = _merged([vocabulary(part) for part in slices(pa.array(texts, pa.large_string()), TRAINING_SLICE)])
    text, at, size = windows(v.bounds)
    long = np.array([len(t or "") > MOST_CHARS for t in texts])
    w = {}
    for name, ids, owner in (("word", v.word, np.arange(len(v.word))), ("gram", v.gram, v.owner)):
        known = _evidence(v, ids, owner, toxic, long)
        w[name] = np.where((known != 0)[:, None], rng.normal(0, 0.05, (BUCKETS, INPUTS)), 0).astype(np.float32)
        w[name][:, 0] = 0.3 * known
    for s in ("f", "b"):
        w["in_" + s] = rng.normal(0, INPUTS**-0.5, (INPUTS, 3 * STATES)).astype(np.float32)
        w["rec_" + s] = rng.normal(0, 0.5 * STATES**-0.5, (STATES, 3 * STATES)).astype(np.float32)
        w["bias_" + s] = np.zeros(3 * STATES, np.float32)
    w["attend"] = rng.normal(0, 0.5, 2 * STATES).astype(np.float32)
    w["out"] = rng.normal(0, 0.5, 2 * STATES).astype(np.float32)
    w["bias"] = np.zeros(1, np.float32)
    net = Network(w)
    # At first the evidence of single words names each text's worst window.
    sums = np.append(0, np.cumsum(np.maximum(net.inputs(v)[:, 0], 0)[v.ids]))
    level = sums[at + size] - sums[at]
    moments = {k: (np.zeros_like(a), np.zeros_like(a)) for k, a in w.items()}
    steps = 0
    for _ in range(rounds):
        worst = _worst(text, level, len(toxic))
        bad, good = worst[toxic & (worst >= 0)], worst[~toxic & (worst >= 0)]
        hard = good[np.argsort(-level[good], kind="stable")[: max(len(bad), 256)]]
        other = np.flatnonzero(~toxic[text])
        other = rng.choice(other, min(len(other), max(len(bad), 256)), replace=False)
        pick = np.concatenate([bad, hard, other])
        y = np.concatenate([np.ones(len(bad)), np.zeros(len(hard) + len(other))]).astype(np.float32)
        weight = np.where(y > 0, len(y) / (2 * max(len(bad), 1)), len(y) / (2 * (len(hard) + len(other)))).astype(np.float32)
        order = rng.permutation(len(pick))
        for k in range(0, len(order), BATCH):
            b = order[k : k + BATCH]
            steps += 1
            _step(net, v, at[pick[b]], size[pick[b]], y[b], weight[b], moments, steps)
        level = net.logits(v, at, size)
    worst = _worst(text, level, len(toxic))
    value = np.where(worst >= 0, level[worst], w["bias"][0]).astype(np.float64)
    net.scale, net.shift = _calibrate(value, toxic)
    return net


def _worst(text: np.ndarray, level: np.ndarray, n: int) -> np.ndarray:
    """Window of the highest level of each text, -1 for texts without one."""
    out = np.full(n, -1)
    order = np.argsort(level, kind="stable")
    out[text[order]] = order
    return out


def _step(net, v, at, size, y, weight, moments, step) -> None:
    """One Adam step; only the words of the batch are looked at."""
    ids, live = _matrix(v, at, size)
    used, ids = np.unique(ids, return_inverse=True)
    ids = ids.reshape(live.shape)
    begin, end = np.searchsorted(used, v.owner), np.searchsorted(used, v.owner, "right")
    mine = begin < end
    own = Vocabulary(v.key[used], v.word[used], v.gram[mine], begin[mine], ids, v.bounds)
    _, g, dx = net.gradient(net.inputs(own), ids, live, y, weight)
    for name, rows, grad in (("word", own.word, dx), ("gram", own.gram, dx[own.owner])):
        g[name] = np.stack([np.bincount(rows, grad[:, k], BUCKETS) for k in range(INPUTS)], axis=1).astype(np.float32)
    rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
    for name, grad in g.items():
        first, second = moments[name]
        first += 0.1 * (grad - first)
        second += 0.001 * (grad * grad - second)
        speed = 0.05 * rate if name in ("word", "gram") else rate
        net.w[name] -= (speed * first / (np.sqrt(second) + 1e-6)).astype(np.float32)


def _calibrate(value: np.ndarray, toxic: np.ndarray, rounds: int = 30) -> tuple[float, float]:
    """Logistic regression on one value, lightly held towards (1, 0)."""
    x, theta = np.stack([value, np.ones_like(value)], axis=1), np.array([1.0, 0.0])
    for _ in range(rounds):
        p = np.clip(_sigmoid(x @ theta), 1e-9, 1 - 1e-9)
        slope = x.T @ (p - toxic) + 0.5 * (theta - [1.0, 0.0])
        bend = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(2)
        theta = theta - np.linalg.solve(bend, slope)
    return float(max(theta[0], 0.05)), float(theta[1])


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def training_sample(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(h, text, label): at most MOST_TOXIC + MOST_CLEAN labelled texts by the hash of their id, those of at most MOST_CHARS characters first.

    An id has one text in it, that of the least hash, however many rows repeat the id."""
    usable = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull() & ~held_out(id_col))
    usable = usable.groupBy(id_col).agg(F.max("toxic").alias("toxic"))
    usable = usable.withColumnRenamed("toxic", "label")
    return labelled_sample(documents, usable, {1: MOST_TOXIC, 0: MOST_CLEAN}, MOST_CHARS, LONG_CHARS, id_col)


def fit_network(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> Network:
    """The network trained on a sample; labels of held-out ids are not read. ``constant`` is set without both labels."""
    return fitted_in_a_task(training_sample(documents, labels, id_col), train)


def score_toxicity(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: row (its columns but the text), text, held_out, score; labels of held-out ids are not read."""
    return apply_network(documents, fit_network(documents, labels, id_col), id_col)


def apply_network(documents: DataFrame, net: Network, id_col: str = "doc_id") -> DataFrame:
    """One row per document: row (its columns but the text), text, held_out, score."""
    spark = documents.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(net)  # a fixed number of weights
    row = F.struct(*[F.col(c) for c in documents.columns if c != "text"]).alias("row")
    rows = documents.select(row, F.col("text").cast("string").alias("text"), held_out(id_col).alias("held_out"))

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = np.zeros(batch.num_rows)
        for part in slices(batch.column("text")):
            out[part.rows] = shared.value.score_texts(part)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "score"])

    schema = f"row {rows.schema['row'].dataType.simpleString()}, text string, held_out boolean, score double"
    return as_arrow(rows, score, schema)
