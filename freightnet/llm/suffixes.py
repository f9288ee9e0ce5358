"""Suffix arrays by induced sorting, and permuted common prefixes, in bulk numpy steps.

The classical scan touches one suffix at a time. Here the suffixes of one bucket move together: all that a bucket induces
into itself is a next round, all that it induces elsewhere is appended to those buckets in order.
"""

from __future__ import annotations

import numpy as np


def types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one (S-type); the last suffix is larger than nothing."""
    n = len(text)
    up = np.zeros(n, bool)
    if n < 2:
        return up
    step = np.sign(text[1:].astype(np.int32) - text[:-1].astype(np.int32))
    # Equal neighbours take the answer of the next place that differs.
    place = np.where(step != 0, np.arange(n - 1), n - 1)
    following = np.minimum.accumulate(place[::-1])[::-1]
    up[:-1] = np.append(step, -1)[following] > 0
    return up


def leftmost_smaller(up: np.ndarray) -> np.ndarray:
    """Places of S-type whose left neighbour is not: the suffixes from which all others are induced."""
    return np.flatnonzero(up[1:] & ~up[:-1]) + 1


def _induce(text: np.ndarray, up: np.ndarray, ordered: np.ndarray, size: int) -> np.ndarray:
    """All suffixes in order, from the leftmost-smaller ones in theirs."""
    n = len(text)
    ends = np.cumsum(np.bincount(text, minlength=size))
    heads = ends - np.bincount(text, minlength=size)
    seeds = ordered[np.argsort(text[ordered], kind="stable")]
    seed_at = np.append(0, np.cumsum(np.bincount(text[seeds], minlength=size)))
    order = np.full(n, -1, np.int64)

    def append(found: np.ndarray, free: np.ndarray, back: bool) -> None:
        letters = text[found]
        by = np.argsort(letters, kind="stable")
        found, letters = found[by], letters[by]
        count = np.bincount(letters, minlength=size)
        rank = np.arange(len(found)) - (np.cumsum(count) - count)[letters]
        if back:
            order[free[letters] - 1 - rank] = found
            free -= count
        else:
            order[free[letters] + rank] = found
            free += count

    def before(here: np.ndarray, small: bool) -> np.ndarray:
        left = here[here > 0] - 1
        return left[up[left] == small]

    free = heads.copy()
    # The end of the text is smaller than any letter: the last suffix, L-type, comes first in its bucket.
    order[free[text[-1]]] = n - 1
    free[text[-1]] += 1
    for c in range(size):
        at = heads[c]
        while at < free[c]:
            now, at = order[at : free[c]], free[c]
            append(before(now, False), free, False)
        if seed_at[c] < seed_at[c + 1]:
            append(before(seeds[seed_at[c] : seed_at[c + 1]], False), free, False)
    large_end, free = free, ends.copy()
    for c in range(size - 1, -1, -1):
        at = ends[c]
        while at > free[c]:
            now, at = order[free[c] : at][::-1], free[c]
            append(before(now, True), free, True)
        if heads[c] < large_end[c]:
            append(before(order[heads[c] : large_end[c]][::-1], True), free, True)
    return order


def _same_substrings(text: np.ndarray, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Are the substrings that begin at a and b equal? All places are compared in step, those that differ drop out."""
    same = size_a == size_b
    live, k = np.flatnonzero(same), 0
    while len(live):
        live = live[k < size_a[live]]
        equal = text[a[live] + k] == text[b[live] + k]
        same[live[~equal]] = False
        live, k = live[equal], k + 1
    return same


def _rank_reduced(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of the reduced string, by at least ``depth`` of its letters.

    The reduced string would go through the same procedure again, but nearly every letter of it is its own bucket, and
    buckets of one cannot move in bulk. Its suffixes are therefore ranked by doubling, only those not yet alone.
    """
    rank, n, width = names.astype(np.int64), len(names), 1
    order = np.argsort(rank, kind="stable")
    while width < depth:
        sorted_rank = rank[order]
        tied = np.zeros(n, bool)
        equal = sorted_rank[1:] == sorted_rank[:-1]
        tied[1:] |= equal
        tied[:-1] |= equal
        if not tied.any():
            break
        at = np.flatnonzero(tied)
        who = order[at]
        next_rank = np.where(who + width < n, rank[np.minimum(who + width, n - 1)] + 1, 0)
        by = np.lexsort((next_rank, rank[who]))
        who, next_rank, first = who[by], next_rank[by], rank[who[by]]
        order[at] = who
        # A rank is the place of the first of its equals, so ranks that stay alone never change.
        new = np.ones(len(at), bool)
        new[1:] = (first[1:] != first[:-1]) | (next_rank[1:] != next_rank[:-1])
        rank[who] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        if width == 1:
            alone = np.flatnonzero(~tied)
            rank[order[alone]] = alone
        width *= 2
    return order


def suffix_array(text: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Suffixes of a text of small non-negative integers in order, by at least their first ``depth`` letters."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    size = int(text.max()) + 1
    up = types(text)
    small = leftmost_smaller(up)
    if not len(small):
        return _induce(text, up, small, size)
    first = _induce(text, up, small, size)
    is_small = np.zeros(n, bool)
    is_small[small] = True
    ordered = first[is_small[first]]
    # Name the substrings up to and with the next leftmost-smaller place; the last one reaches the end.
    number = np.empty(n, np.int64)
    number[small] = np.arange(len(small))
    reach = np.append(small[1:] + 1, n + 1) - small
    a, b = ordered[:-1], ordered[1:]
    last = small[-1]
    same = _same_substrings(text, a, b, np.where(a == last, -1, reach[number[a]]), np.where(b == last, -2, reach[number[b]]))
    names = np.empty(len(small), np.int64)
    place = np.arange(len(ordered))
    names[number[ordered]] = np.append(0, np.maximum.accumulate(np.where(same, 0, place[1:])))
    if same.any():
        # Names are at least two letters apart.
        ordered = small[_rank_reduced(names, len(small) if depth is None else depth // 2 + 1)]
    return _induce(text, up, ordered, size)


def permuted_common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each place of a byte text: letters shared with the suffix ahead of it in the order, up to ``most``."""
    n = len(data)
    ahead = np.full(n, -1, np.int64)
    ahead[order[1:]] = order[:-1]
    padded = np.append(data, np.zeros(most + 8, np.uint8))
    words = np.zeros(n + most, np.uint64)  # eight bytes from each place, the first one lowest
    for k in range(8):
        words |= padded[k : k + n + most].astype(np.uint64) << np.uint64(8 * k)
    shared = np.zeros(n, np.int64)
    live = np.flatnonzero(ahead >= 0)
    for k in range(0, most, 8):
        differ = words[live + k] ^ words[ahead[live] + k]
        odd = differ != 0
        low = differ[odd] & (~differ[odd] + np.uint64(1))
        shared[live[odd]] = k + np.log2(low.astype(np.float64)).astype(np.int64) // 8
        live = live[~odd]
        shared[live] = k + 8
    ends = n - np.maximum(np.arange(n), ahead)
    return np.minimum(np.minimum(shared, most), ends)
