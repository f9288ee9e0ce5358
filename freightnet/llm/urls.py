"""URL filter: all glob rules run at once as one bit-parallel Shift-And automaton.

Every rule is one run of positions in a few 64-bit words. A position holds a literal character; a wildcard is a
loop on the position before which it stands: ``*`` passes any character but ``/``, ``**`` any character. One step
per character moves the states of all rules of all urls of a batch together.

Defined cases: a NULL url and one without ``://`` have empty host and path and fit no host rule; repeated rows give
repeated results; of equally long fitting rules the one listed first wins.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightnet.llm.texts import as_arrow, small_batches

HOST = r"(?s)^.*?://([^/?#]*)"
PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A host with its subdomains and the beginning of a path, to allow or block."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        """Canonical urls begin with a dot, so that a host is matched at the border of a label only."""
        return f"*.{self.host}{self.path}**"


class Automaton:
    """Shift-And masks of several globs packed behind each other into 64-bit words."""

    def __init__(self, globs: Sequence[str]) -> None:
        literals: list[str] = []  # the character of each position; "" is the start of a glob
        loops: dict[int, str] = {}  # position -> wildcard that loops on it
        self.ends: list[int] = []
        for glob in globs:
            literals.append("")
            i = 0
            while i < len(glob):
                if glob[i] == "*":
                    star = "**" if glob[i : i + 2] == "**" else "*"
                    at = len(literals) - 1
                    loops[at] = max(loops.get(at, ""), star)
                    i += len(star)
                else:
                    literals.append(glob[i])
                    i += 1
            self.ends.append(len(literals) - 1)
        self.words = max(1, -(-len(literals) // 64))
        letters = sorted({c for c in literals if c} | {"/"})
        self.code = {c: k + 1 for k, c in enumerate(letters)}
        # Per character class: the positions that may be entered, and those that may loop.
        self.enter = np.zeros((len(letters) + 1, self.words), np.uint64)
        self.loop = np.zeros_like(self.enter)
        self.begin = np.zeros(self.words, np.uint64)
        for at, c in enumerate(literals):
            word, bit = at // 64, np.uint64(1 << (at % 64))
            if c:
                self.enter[self.code[c], word] |= bit
            else:
                self.begin[word] |= bit
            if at in loops:
                self.loop[:, word] |= bit
                if loops[at] == "*":
                    self.loop[self.code["/"], word] &= ~bit

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Character classes of all texts behind each other, and the offset of each text."""
        sizes = np.array([len(t) for t in texts], np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        table = np.zeros(0x110000, np.uint16)
        for c, k in self.code.items():
            table[ord(c)] = k
        return table[points], np.append(0, np.cumsum(sizes))

    def run(self, texts: Sequence[str]) -> np.ndarray:
        """Boolean texts x globs: does the glob fit the whole text?"""
        classes, offsets = self.encode(texts)
        order = np.argsort(-np.diff(offsets), kind="stable")
        starts, sizes = offsets[:-1][order], np.diff(offsets)[order]
        state = np.tile(self.begin, (len(texts), 1))
        for step in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -step, "left"))  # longest first: texts with a character here
            c, now = classes[starts[:live] + step], state[:live]
            moved = now << np.uint64(1)
            if self.words > 1:
                moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            # A start position is entered by no character, so no glob runs into the next one.
            state[:live] = (moved & self.enter[c]) | (now & self.loop[c])
        fits = np.empty((len(texts), len(self.ends)), bool)
        for k, end in enumerate(self.ends):
            fits[order, k] = (state[:, end // 64] >> np.uint64(end % 64)) & np.uint64(1) > 0
        return fits


def canonical(url) -> tuple:
    """Host (A-Z lower-cased) and path of a url column; both empty without ``://``."""
    url = F.coalesce(F.col(url).cast("string") if isinstance(url, str) else url, F.lit(""))
    host = F.translate(F.regexp_extract(url, HOST, 1), UPPER, LOWER)
    return host, F.regexp_extract(url, PATH, 1)


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    globs: Sequence[tuple[str, str]] = (),
    default: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict.

    The longest fitting rule decides. Without one, the first fitting pair (glob over ``.host/path``, verdict) of
    ``globs`` does, else ``default``. Rows stay where they are: no shuffle.
    """
    host, path = canonical(url_col)
    ranked = sorted(range(len(rules)), key=lambda k: -len(rules[k].text))
    automaton = Automaton([*(rules[k].glob for k in ranked), *(g for g, _ in globs)])
    names = np.array([*(rules[k].text for k in ranked), *([None] * (len(globs) + 1))], object)
    verdicts = np.array([*(rules[k].verdict for k in ranked), *(v for _, v in globs), default], object)

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
        fits = automaton.run([f".{h}{p}" if h else "" for h, p in zip(hosts, paths)])
        best = np.append(fits, np.ones((len(fits), 1), bool), axis=1).argmax(axis=1)
        columns = [batch.column(c) for c in (id_col, "host", "path")]
        columns += [pa.array(names[best], pa.string()), pa.array(verdicts[best], pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=[id_col, "host", "path", "rule", "verdict"])

    small_batches(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()
    narrow = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    return as_arrow(narrow, judge, f"{id_col} {kind}, host string, path string, rule string, verdict string")
