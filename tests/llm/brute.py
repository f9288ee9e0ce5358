"""Plain Python versions of what the ten queries promise, over lists of rows."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTER_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def url(page_id, url, rules, globs=(), default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0].translate(LOWER)
        path = re.match(r"[^?#]*", rest[len(re.match(r"[^/?#]*", rest)[0]) :], re.S)[0]
    best = None
    for r in rules:
        if host and (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path):
            if best is None or len(r.text) > len(best.text):
                best = r
    if best:
        return page_id, host, path, best.text, best.verdict
    for glob, verdict in globs:
        pattern = re.escape(glob).replace(r"\*\*", "\0").replace(r"\*", "[^/]*").replace("\0", ".*")
        if host and re.fullmatch(pattern, f".{host}{path}", re.S):
            return page_id, host, path, None, verdict
    return page_id, host, path, None, default


def contamination(docs, items, window=10):
    shapes = {}
    for name, text in items:
        words = tuple(LETTER_WORD.findall((text or "").translate(LOWER)))
        if words:
            n = min(window, len(words))
            for i in range(len(words) - n + 1):
                shapes.setdefault(words[i : i + n], set()).add("" if name is None else str(name))
    sizes = {len(s) for s in shapes}
    out = []
    for doc, text in docs:
        words = LETTER_WORD.findall((text or "").translate(LOWER))
        hit, names = set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                found = shapes.get(tuple(words[i : i + n]))
                if found:
                    names |= found
                    hit.update(range(i, i + n))
        out.append((doc, len(words), len(hit), len(names), sha(",".join(sorted(names))), bool(hit)))
    return out


def secrets(doc, text):
    text = text or ""
    spans = []
    key = r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for k, (pattern, least, group) in enumerate(
        [(key, 8, 1), (r"AKIA[A-Z0-9]+", 16, 0), (r"[0-9a-f]+", 32, 0)]
    ):
        spans += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    spans.sort()
    names = ("assign", "access", "hex")
    joined = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)
    return (doc, *[sum(s[1] == k for s in spans) for k in range(3)], sha(joined)), joined


def targets(sizes: dict, weights=(5, 2, 1), most=3.0):
    order = sorted(sizes, key=lambda s: (s is None, "" if s is None else s.encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, list(order), float(sum(sizes.values()))
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if share * weight[s] > most * sizes[s]]
        if not full:
            target |= {s: share * weight[s] for s in open_}
            break
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


def rules(doc, text):
    text = text or ""
    words = SPACE_WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    repeat = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if SPACE_WORD.search(x)]
    failed = len(words) < 50 or 100 * len(repeat) > 50 * len(words)
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return doc, len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(repeat), failed


def conversation(conv, turns):
    """turns: (turn, role, text) in order."""
    loss = "".join(t or "" for _, r, t in turns if r == "assistant")
    every = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in turns)
    return conv, len(turns), sha(every), len(loss), sha(loss)


def without_repeats(docs, length=50):
    """docs: (id, text). Remove bytes under strings that also start in a document with a smaller id."""
    first: dict[bytes, int] = {}
    data = [(d, (t or "").encode()) for d, t in docs]
    for d, b in data:
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            first[s] = min(first.get(s, d), d)
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), spans, sha(kept)))
    return out


def near_copies(docs, share=90):
    """docs: (id, text) -> (id, n_shingles, component)."""
    sets = []
    for d, t in docs:
        w = SPACE_WORD.findall((t or "").translate(LOWER))
        sets.append((d, frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else [])))
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by: dict = {}
    for d, s in sets:
        for x in s:
            by.setdefault(x, []).append((d, s))
    seen = set()
    for group in by.values():
        for i, (a, s) in enumerate(group):
            for b, r in group[:i]:
                if (a, b) in seen or min(len(s), len(r)) * 100 < share * max(len(s), len(r)):
                    continue
                seen.add((a, b))
                both = len(s & r)
                if 100 * both >= share * (len(s) + len(r) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return [(d, len(s), find(d)) for d, s in sets]
