"""Plain Python versions of conversation repair, spelling variants and the base of the language scores."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

from tests.llm.brute import LOWER, SPACE_WORD

STEPS = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
NAMES = {"u": "user", "a": "assistant"}


def damage(rows):
    """rows: (conv, turn, role, text) with None."""
    text_of = lambda x: " " if x is None else str(x)
    out = []
    for conv, turn, role, text in rows:
        what = zlib.crc32(f"{text_of(conv)}:{text_of(turn)}".encode()) % 20
        role, text = text_of(role), text_of(text)
        if what == 0:
            continue
        if what == 1:
            text = ""
        if what == 2:
            text = re.sub("[.!?]", "", text)
        if what == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if what == 3 else 1)
    return out


def repair(rows):
    """rows: (turn, role, text) of one conversation -> gaps, blank, duplicate, truncated, illegal, cost, audit, digest."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    seen, faults = set(), []
    for _, role, text in rows:
        if not SPACE_WORD.search(text):
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append(None if re.search(r"[.!?][\x20\x09-\x0D]*\Z", text) else "truncated")
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))

    n = len(rows)

    def arcs(i, q):
        for x in "ua":
            if x in STEPS[q]:
                yield 3, "I", (i, STEPS[q][x]), ("I", NAMES[x])
        if i == n:
            return
        yield 4, "D", (i + 1, q), None
        if faults[i] in ("blank", "duplicate"):
            return
        extra, own = 3 * (faults[i] == "truncated"), rows[i][1][:1]
        if own == "":
            yield extra, "K", (i + 1, q), ("K", rows[i][1])
        elif own in STEPS[q]:
            yield extra, "K", (i + 1, STEPS[q][own]), ("K", rows[i][1])
        for x in "ua":
            if x in STEPS[q] and x != own:
                yield 3 + extra, "R", (i + 1, STEPS[q][x]), ("R", NAMES[x])

    far = defaultdict(lambda: math.inf, {(n, 0): 0, (n, 3): 0})
    for i in range(n, -1, -1):
        for _ in range(4):
            for q in range(4):
                far[i, q] = min([far[i, q]] + [c + far[to] for c, _, to, _ in arcs(i, q)])
    # All nodes that the least letters so far reach on cheapest ways, with what was done on the way.
    at, audit = {(0, 0): []}, ""
    while not any(node in ((n, 0), (n, 3)) for node in at):
        best = {}
        for node, done in at.items():
            for c, letter, to, what in arcs(*node):
                if c + far[to] == far[node]:
                    best.setdefault(letter, {}).setdefault(to, [*done, (node[0], what)])
        letter = min(best)
        audit, at = audit + letter, best[letter]
    done = next(d for node, d in at.items() if node in ((n, 0), (n, 3)))
    lines = [f"{w[1]}:{'' if w[0] == 'I' else rows[i][2]}" for i, w in done if w]
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, far[0, 0], audit, digest)


def repairs(rows):
    by = defaultdict(list)
    for conv, *rest in damage(rows):
        by[conv].append(tuple(rest))
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    return [(conv, *(repair(by[conv]) if conv in by else nothing)) for conv in {r[0] for r in rows}]


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelling(docs):
    """docs: (id, text) -> (word, form, root, n, n_near, form_n)."""
    counts = Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    by_size = defaultdict(list)
    for w in words:
        by_size[len(w)].append(w)
    form, n_near = {}, {}
    for w, n in words.items():
        others = [x for k in (-1, 0, 1) for x in by_size[len(w) + k] if near(w, x)]
        n_near[w] = len(others)
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * n else None

    def root(w):
        return root(form[w]) if form[w] else w

    return [(w, form[w], root(w), n, n_near[w], words[form[w]] if form[w] else None) for w, n in words.items()]


def base_scores(docs):
    """docs: (id, text) -> (id, held_out, n_tokens, n_known, train_tokens, base_score)."""
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    tokens = [(d, [*SPACE_WORD.findall((t or "").translate(LOWER)), None]) for d, t in docs]
    c = Counter(x for d, own in tokens if not held(d) for x in own)
    n, v = sum(c.values()), len(c)
    score = lambda x: math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1)))
    return [(d, held(d), len(own), sum(c[x] > 0 for x in own), n, sum(map(score, own))) for d, own in tokens]
