"""Repair of conversation structure by an auction for shortest paths.

A conversation becomes a lattice: a node is a row number with what the kept roles so far allow next (nothing yet, after
a system role, after a user, after an assistant). Arcs keep, re-role or delete a row or insert an empty turn, at integer
costs; a path from the first row to the end is a repair whose roles read ``(s?(ua)+)?``. The auction holds a price for
each node and one path. Where the path's last node is worth more than its price, the price rises and the path contracts
by that node; else the path is extended by the arc that attains the price. It ends at the destination, and no arc is then
cheaper than the fall of prices along it: all cheapest paths run on arcs that are exactly as dear (tight). These
are walked from the start, a set of nodes at a time, by the least letter, to the first of all cheapest repairs.

A conversation may hold a third of all rows, so it is cut into blocks of ``BLOCK`` rows. A block is reduced to the cost
and the rank of the best letters from each way in to each way out; ``BLOCK`` of these make a block of the next level, on
whose lattice the same auction runs, until one is left. Choices then go back down. That gives the same letters:
blocks end with the use of a row, so among repairs of the same rows none is the beginning of another, and the order of
letters is that of their pieces. Rows of equal shape are priced once a task.

Defined cases: NULL counts as one space, in any column; rows go by turn, NULLs first, then by role and text; a row whose
role is empty adds no letter when kept; repeated rows are duplicates of the first; conversations without rows get zeros.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freightnet.llm.texts import as_arrow
from freightnet.scale import cut, null_safe_join, slice_rows

BLOCK = 64
#: What may come next: nothing yet, after a system role, after a user, after an assistant.
STATES = 4
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: By state: the state after a role's initial.
_AFTER = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
_ENDS = (0, 3)
_SPACE = r"[\x20\x09-\x0D]"

#: An arc: cost, label, mark of what it does, node it leads to.
Arc = tuple[int, object, str, int]


class Auction:
    """Prices over a graph of arcs with one destination; what has been learnt serves later origins."""

    def __init__(self, arcs: list[list[Arc]], to: int) -> None:
        back: list[list[int]] = [[] for _ in arcs]
        for k, own in enumerate(arcs):
            for a in own:
                back[a[3]].append(k)
        self.leads, todo = {to}, [to]
        while todo:
            more = [k for k in back[todo.pop()] if k not in self.leads]
            self.leads.update(more)
            todo += more
        self.arcs = [[a for a in own if a[3] in self.leads] for own in arcs]
        self.to, self.prices = to, [0] * len(arcs)

    def cost(self, origin: int) -> int | None:
        """Cost of the cheapest path from ``origin``, None without a path."""
        if origin not in self.leads:
            return None
        prices, path = self.prices, [origin]
        while path[-1] != self.to:
            node = path[-1]
            best, onward = min((a[0] + prices[a[3]], a[3]) for a in self.arcs[node])
            if prices[node] == best:
                path.append(onward)  # extend
                continue
            prices[node] = best
            if len(path) > 1:
                path.pop()  # contract
        return prices[origin] - prices[self.to]

    def least_labels(self, origin: int) -> tuple[list[object], list[str]]:
        """Labels and marks along the cheapest path whose labels come first, by arcs that are tight and lead on."""
        tight = [[a for a in own if a[0] + self.prices[a[3]] == self.prices[k]] for k, own in enumerate(self.arcs)]
        back: list[list[int]] = [[] for _ in self.arcs]
        for k, own in enumerate(tight):
            for a in own:
                back[a[3]].append(k)
        alive, todo = {self.to}, [self.to]
        while todo:
            more = [k for k in back[todo.pop()] if k not in alive]
            alive.update(more)
            todo += more
        # Each step holds the nodes that the same labels reach, and for each the node and arc it was reached by.
        steps: list[dict[int, tuple[int, Arc | None]]] = [{origin: (-1, None)}]
        while self.to not in steps[-1]:
            out = [(a[1], k, a) for k in steps[-1] for a in tight[k] if a[3] in alive]
            first = min(a[0] for a in out)
            reached: dict[int, tuple[int, Arc | None]] = {}
            for label, k, a in out:
                if label == first:
                    reached.setdefault(a[3], (k, a))
            steps.append(reached)
        labels, marks, at = [], [], self.to
        for step in reversed(steps[1:]):
            at, arc = step[at]
            labels.append(arc[1])
            marks.append(arc[2])
        return labels[::-1], marks[::-1]


def _row_arcs(code: str, state: int) -> Iterator[tuple[int, str, str, int]]:
    """Cost, letter, mark and next state of each way to use a row."""
    kind, extra = (code.lower(), TRUNCATED) if code.isupper() else (code, 0)
    if kind != "d":
        if kind == "e":
            yield KEEP + extra, "K", "K", state
        elif kind in _AFTER[state]:
            yield KEEP + extra, "K", "K", _AFTER[state][kind]
        for role in "ua":
            if role in _AFTER[state] and role != kind:
                yield REROLE + extra, "R", role, _AFTER[state][role]
    yield DELETE, "D", "D", state


def _lattice(codes: str, last: bool) -> list[list[Arc]]:
    """Arcs of a block of rows; behind the last block turns may be inserted and the end reached (label '')."""
    n, end = len(codes), (len(codes) + 1) * STATES
    arcs: list[list[Arc]] = [[] for _ in range(end + 1)]
    for i in range(n + last):
        for state in range(STATES):
            own = arcs[i * STATES + state]
            for role in "ua":
                if role in _AFTER[state]:
                    own.append((INSERT, "I", role, i * STATES + _AFTER[state][role]))
            if i < n:
                own += [(c, x, m, (i + 1) * STATES + s) for c, x, m, s in _row_arcs(codes[i], state)]
            elif state in _ENDS:
                own.append((0, "", "", end))
    return arcs


def _joined(costs: list[list[int]], ranks: list[list[int]], last: bool) -> list[list[Arc]]:
    """Arcs of a block of blocks."""
    n, end = len(costs), (len(costs) + 1) * STATES
    arcs: list[list[Arc]] = [[] for _ in range(end + 1)]
    for i in range(n):
        final = last and i == n - 1
        for a in range(STATES):
            for b in range(STATES):
                cost = costs[i][a * STATES + b]
                if cost >= 0:
                    to = end if final else (i + 1) * STATES + b
                    arcs[i * STATES + a].append((cost, ranks[i][a * STATES + b], str(b), to))
    return arcs


def _reduced(arcs: list[list[Arc]], layers: int, first: bool, last: bool) -> tuple[list[int], list[int]]:
    """Cost (-1: no way) and rank of the best labels by way in and way out; the last block has one way out."""
    costs, found = [-1] * (STATES * STATES), {}
    for out in range(1 if last else STATES):
        auction = Auction(arcs, (layers + 1) * STATES if last else layers * STATES + out)
        for into in range(1 if first else STATES):
            cost = auction.cost(into)
            if cost is not None:
                costs[into * STATES + out] = cost
                found[into * STATES + out] = auction.least_labels(into)[0]
    order = {labels: k for k, labels in enumerate(sorted({tuple(x) for x in found.values()}))}
    return costs, [order[tuple(found[k])] if k in found else -1 for k in range(STATES * STATES)]


def _marks(arcs: list[list[Arc]], layers: int, into: int, out: int, last: bool) -> tuple[list[object], list[str]]:
    auction = Auction(arcs, (layers + 1) * STATES if last else layers * STATES + out)
    auction.cost(into)
    return auction.least_labels(into)


@lru_cache(maxsize=100_000)
def _block(codes: str, first: bool, last: bool) -> tuple[list[int], list[int]]:
    return _reduced(_lattice(codes, last), len(codes), first, last)


@lru_cache(maxsize=100_000)
def _edits(codes: str, into: int, out: int, last: bool) -> tuple[int, list[str]]:
    """Cost, and for each row the turns inserted before it, the letter and the new role; a last one for the end."""
    labels, marks = _marks(_lattice(codes, last), len(codes), into, out, last)
    rows, before, cost = [], "", 0
    for label, mark in zip(labels, marks):
        if label == "I":
            before, cost = before + mark, cost + INSERT
        elif label:
            code = codes[len(rows)]
            cost += {"K": KEEP, "R": REROLE, "D": DELETE}[label]
            cost += TRUNCATED if code.isupper() and label != "D" else 0
            rows.append(f"{before}{label}{mark if label == 'R' else ''}")
            before = ""
    return cost, [*rows, before]


def _bools(batch: pa.RecordBatch, name: str) -> list[bool]:
    return batch.column(name).to_pylist()


def _up(rows: DataFrame) -> DataFrame:
    """(group, block, first, last, costs, ranks) of each block to those of BLOCK blocks together."""
    parts = F.sort_array(F.collect_list(F.struct("block", "costs", "ranks")))
    grouped = rows.groupBy("group", F.floor(F.col("block") / BLOCK).cast("bigint").alias("block")).agg(
        parts.alias("parts"), F.max("first").alias("first"), F.max("last").alias("last")
    )

    def price(batch: pa.RecordBatch) -> pa.RecordBatch:
        costs, ranks = [], []
        for parts, first, last in zip(batch.column("parts").to_pylist(), _bools(batch, "first"), _bools(batch, "last")):
            arcs = _joined([p["costs"] for p in parts], [p["ranks"] for p in parts], last)
            c, r = _reduced(arcs, len(parts), first, last)
            costs.append(c)
            ranks.append(r)
        kept = [batch.column(c) for c in ("group", "block", "first", "last", "parts")]
        arrays = [*kept, pa.array(costs, pa.list_(pa.int64())), pa.array(ranks, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(arrays, names=["group", "block", "first", "last", "parts", "costs", "ranks"])

    group = rows.schema["group"].dataType.simpleString()
    inner = "array<struct<block:bigint,costs:array<bigint>,ranks:array<bigint>>>"
    schema = f"group {group}, block bigint, first boolean, last boolean, parts {inner}, costs array<bigint>, ranks array<bigint>"
    return as_arrow(grouped.select("group", "block", "first", "last", "parts"), price, schema)


def _down(level: DataFrame, ways: DataFrame) -> DataFrame:
    """(group, block, way in, way out) of the blocks of a level to those of the blocks they were made of."""

    def choose(batch: pa.RecordBatch) -> pa.RecordBatch:
        groups, blocks, into, out = [], [], [], []
        columns = [batch.column(c).to_pylist() for c in ("group", "parts", "last", "into", "out")]
        for group, parts, last, start, end in zip(*columns):
            arcs = _joined([p["costs"] for p in parts], [p["ranks"] for p in parts], last)
            at = start
            for part, mark in zip(parts, _marks(arcs, len(parts), start, end, last)[1]):
                groups.append(group)
                blocks.append(part["block"])
                into.append(at)
                at = int(mark)
                out.append(at)
        kind = batch.schema.field("group").type
        arrays = [pa.array(groups, kind), *[pa.array(x, pa.int64()) for x in (blocks, into, out)]]
        return pa.RecordBatch.from_arrays(arrays, names=["group", "block", "into", "out"])

    group = level.schema["group"].dataType.simpleString()
    both = null_safe_join(level.select("group", "block", "parts", "last"), ways, ["group", "block"])
    return as_arrow(both.select("group", "parts", "last", "into", "out"), choose, f"group {group}, block bigint, into bigint, out bigint")


def _blocks(rows: DataFrame) -> DataFrame:
    """(group, block, codes, first, last, illegal): the rows of a block as one letter each."""
    # The first row of a block is also seen by the block before it, for what stands next to each other.
    border = (F.col("pos") % BLOCK == 0) & (F.col("pos") > 0)
    own = F.floor(F.col("pos") / BLOCK).cast("bigint")
    spread = rows.withColumn("block", F.explode(F.when(border, F.array(own, own - 1)).otherwise(F.array(own))))
    seen = F.sort_array(F.collect_list(F.struct("pos", "code", "initial")))
    inside = F.filter("seen", lambda x: F.floor(x["pos"] / BLOCK) == F.col("block"))
    pair = F.zip_with(
        F.slice("seen", 1, F.size("seen") - 1),
        F.slice("seen", 2, F.size("seen") - 1),
        lambda a, b: F.concat(a["initial"], b["initial"]),
    )
    legal = F.array(*[F.lit(x) for x in ("su", "ua", "au")])
    return (
        spread.groupBy("group", "block")
        .agg(seen.alias("seen"), F.max("total").alias("total"))
        .select(
            "group",
            "block",
            F.array_join(F.transform(inside, lambda x: x["code"]), "").alias("codes"),
            (F.col("block") == 0).alias("first"),
            ((F.col("block") + 1) * BLOCK >= F.col("total")).alias("last"),
            F.size(F.filter(pair, lambda x: ~F.array_contains(legal, x))).cast("bigint").alias("illegal"),
        )
    )


def _numbered(rows: DataFrame) -> DataFrame:
    """Add ``pos`` (from 0) and ``total`` within the conversation, in two levels: slices, then rows of a slice."""
    order = ["turn", "role", "text"]
    sliced = slice_rows(rows, ["group"], order)
    counts = sliced.groupBy("group", "__slice").count()
    ahead = Window.partitionBy("group").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "group",
        "__slice",
        F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("__before"),
        F.sum("count").over(Window.partitionBy("group")).alias("total"),
    )
    inside = Window.partitionBy("group", "__slice").orderBy(*order)
    ranked = sliced.withColumn("__rank", F.row_number().over(inside))
    found = null_safe_join(ranked, offsets, ["group", "__slice"])
    return found.withColumn("pos", F.col("__before") + F.col("__rank") - 1).drop("__before", "__rank", "__slice")


def _faults(rows: DataFrame) -> DataFrame:
    """Add ``fault`` (the first of blank, duplicate, truncated), ``initial`` and the letter of a row."""
    text = F.col("text")
    same = ["group", "role", "text_id"]
    rows = rows.withColumn("text_id", F.sha2(F.encode(text, "utf-8"), 256))
    first = rows.groupBy(*same).agg(F.min("pos").alias("pos")).select("group", "pos", F.lit(True).alias("is_first"))
    rows = null_safe_join(rows.drop("text_id"), first, ["group", "pos"], "left")
    fault = (
        F.when(~text.rlike(rf"[^\x20\x09-\x0D]"), "blank")
        .when(F.col("is_first").isNull(), "duplicate")
        .when(~text.rlike(rf"[.!?]{_SPACE}*\z"), "truncated")
    )
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).when(initial == "", "e").otherwise("x")
    code = F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper(letter))
    rows = rows.withColumn("fault", fault).withColumn("initial", initial).drop("is_first")
    return rows.withColumn("code", code.otherwise(letter))


def _digests(lines: DataFrame) -> DataFrame:
    """(group, pos, letters, line) to (group, audit, digest of the newline-joined lines), in one pass over sorted rows."""
    kind = lines.schema["group"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun, audit, digest = None, False, [], None

        def out(groups, audits, digests, field):
            arrays = [pa.array(groups, field.type), pa.array(audits, pa.string()), pa.array(digests, pa.string())]
            return pa.RecordBatch.from_arrays(arrays, names=["group", "audit", "digest"])

        field = None
        for batch in batches:
            field, done = batch.schema.field("group"), ([], [], [])
            for group, letters, line in zip(*[batch.column(c).to_pylist() for c in ("group", "letters", "line")]):
                if not begun or group != now:
                    if begun:
                        for x, y in zip(done, (now, "".join(audit), digest.hexdigest())):
                            x.append(y)
                    now, begun, audit, digest, joined = group, True, [], hashlib.sha256(), False
                audit.append(letters)
                if line is not None:
                    digest.update((("\n" if joined else "") + line).encode())
                    joined = True
            yield out(*done, field)
        if begun:
            yield out([now], ["".join(audit)], [digest.hexdigest()], field)

    rows = lines.repartition("group").sortWithinPartitions("group", "pos").select("group", "letters", "line")
    return rows.mapInArrow(run, f"group {kind}, audit string, digest string")


def repair_conversations(conversations: DataFrame, conv_col: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """Two tables. One row per conversation: its key, gaps, blank, duplicate, truncated, illegal, cost, audit, digest.
    And one per row of the input, and per end of a conversation: key, pos, turn, role, text, fault, inserted (roles of
    turns before it), edit (K, R or D), new_role (for R)."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(
        F.col(conv_col).alias("group"), F.col("turn").cast("bigint").alias("turn"),
        space("role").alias("role"), space("text").alias("text"),
    )
    rows = cut(_faults(_numbered(rows)))
    blocks = cut(_blocks(rows))

    def price(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [_block(*x) for x in zip(batch.column("codes").to_pylist(), _bools(batch, "first"), _bools(batch, "last"))]
        arrays = [batch.column(c) for c in ("group", "block", "first", "last")]
        arrays += [pa.array([f[k] for f in found], pa.list_(pa.int64())) for k in (0, 1)]
        return pa.RecordBatch.from_arrays(arrays, names=["group", "block", "first", "last", "costs", "ranks"])

    kind = rows.schema["group"].dataType.simpleString()
    schema = f"group {kind}, block bigint, first boolean, last boolean, costs array<bigint>, ranks array<bigint>"
    level = cut(as_arrow(blocks.select("group", "block", "codes", "first", "last"), price, schema))
    levels = []
    # One level for each factor of BLOCK in the longest conversation.
    while not level.where("block > 0").isEmpty():
        more = level.where("not (first and last)")
        levels.append(cut(_up(more)))
        level = levels[-1].select("group", "block", "first", "last", "costs", "ranks")
    # Conversations that one block of a level holds start there; the others get their ways from the level above.
    alone = lambda rows: rows.where("first and last").selectExpr("group", "block", "0L as into", "0L as out")
    ways = None
    for upper in reversed(levels):
        ways = cut(_down(upper, alone(upper) if ways is None else alone(upper).unionByName(ways)))
    ways = alone(blocks) if ways is None else alone(blocks).unionByName(ways)

    def edit(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = [batch.column(c).to_pylist() for c in ("codes", "into", "out", "last")]
        found = [_edits(*x) for x in zip(*columns)]
        edits = pa.array([x[1] if last else x[1][:-1] for x, last in zip(found, columns[3])], pa.list_(pa.string()))
        arrays = [batch.column("group"), batch.column("block"), pa.array([x[0] for x in found], pa.int64()), edits]
        return pa.RecordBatch.from_arrays(arrays, names=["group", "block", "cost", "edits"])

    both = null_safe_join(blocks, ways, ["group", "block"]).select("group", "block", "codes", "into", "out", "last", "illegal")
    made = as_arrow(both.drop("illegal"), edit, f"group {kind}, block bigint, cost bigint, edits array<string>")
    made = cut(made)
    edits = made.select("group", (F.col("block") * BLOCK).alias("at"), F.posexplode("edits"))
    edits = edits.select(
        "group", (F.col("at") + F.col("pos")).alias("pos"),
        F.regexp_extract("col", "^[ua]*", 0).alias("inserted"),
        F.nullif(F.regexp_extract("col", "[KRD]", 0), F.lit("")).alias("edit"),
        F.when(F.col("col").endswith("Ru"), "user").when(F.col("col").endswith("Ra"), "assistant").alias("new_role"),
    )
    plain = rows.select("group", "pos", "turn", "role", "text", "fault")
    detail = null_safe_join(edits, plain, ["group", "pos"], "left")

    opened = F.regexp_replace(F.regexp_replace("inserted", "u", "user:\n"), "a", "assistant:\n")
    kept = F.when(F.col("edit").isin("K", "R"), F.concat(F.coalesce("new_role", "role"), F.lit(":"), "text"))
    lines = detail.select(
        "group", "pos",
        F.concat(F.regexp_replace("inserted", "[ua]", "I"), F.coalesce("edit", F.lit(""))).alias("letters"),
        F.when(kept.isNotNull(), F.concat(opened, kept))
        .when(F.col("inserted") != "", F.regexp_replace(opened, r"\n\z", "")).alias("line"),
    )
    count = lambda f: F.count(F.when(F.col("fault") == f, 1)).alias(f)
    turns = rows.groupBy("group", "turn").agg(*[F.sum(F.when(F.col("fault") == f, 1).otherwise(0)).alias(f) for f in ("blank", "duplicate", "truncated")])
    facts = turns.groupBy("group").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"),
        *[F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")],
    )
    sums = made.groupBy("group").agg(F.sum("cost").alias("cost"))
    pairs = blocks.groupBy("group").agg(F.sum("illegal").alias("illegal"))
    found = null_safe_join(null_safe_join(facts, pairs, ["group"]), sums, ["group"])
    found = null_safe_join(found, _digests(lines), ["group"])
    every = conversations.select(F.col(conv_col).alias("group")).distinct()
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    whole = null_safe_join(every, found, ["group"], "left").select(
        F.col("group").alias(conv_col), *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("digest", nothing).alias("digest"),
    )
    return whole, detail.withColumnRenamed("group", conv_col)


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with faults put in by the checksum of their key: dropped, emptied, cut, repeated or made a user's."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text: Column = F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.regexp_replace("text", "[.!?]", ""))
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), what.alias("what"))
    rows = rows.where("what != 0").withColumn("text", text.otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("what") == 4, "user").otherwise(F.col("role")))
    times = F.when(F.col("what") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", "role", "text", F.explode(times).alias("copy")).drop("copy")
