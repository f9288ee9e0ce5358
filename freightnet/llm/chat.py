"""Chat formatting over typed content parts.

A message is an array of parts: text, image, audio or document. One pass over the parts in order writes the escaped text
of text parts and a placeholder for each attachment, and records for every attachment its reference, the place of its
placeholder and the number of tokens it will expand to. Messages are joined in turn order by a template whose control
strings cannot occur in any text, nor across the parts of a message: the first character of each is escaped reversibly.

A conversation is put together in two steps, blocks of turns first, so that sorting and escaping a very long one is
spread over many tasks; the last step only joins finished blocks, as one formatted conversation is one value.

Only DataFrame functions are used.

Defined cases: NULL texts and roles count as empty, a NULL part list has no part; a NULL turn comes first; equal turns
are ordered by role and parts; repeated rows are turns of their own; a NULL conversation id is an id of its own; a part
of unknown kind is kept as a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The control strings of this template and of others that texts are known to imitate.
TURN, END = "<|turn|>", "<|end|>"
MARKS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
FOREIGN = ("<s>", "</s>", "[INST]", "[/INST]")

BLOCK_TURNS = 64
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Pixels on the side of an image patch, audio tokens a second, tokens a document page.
PATCH, PER_SECOND, PER_PAGE = 28, 25, 512


def escape(text: Column) -> Column:
    """Reversible: afterwards no control string occurs."""
    text = F.replace(text, F.lit("&"), F.lit("&amp;"))
    text = F.replace(text, F.lit("<|"), F.lit("&lt;|"))
    for mark in FOREIGN:
        first = {"<": "&lt;", "[": "&#91;"}[mark[0]]
        text = F.replace(text, F.lit(mark), F.lit(first + mark[1:]))
    return text


def escape_end(text: Column) -> Column:
    """Also escapes the beginning of a control string at the end of an escaped text, which the next part may go on with."""
    text = F.regexp_replace(text, r"<(?=(?:s|/|/s)?\z)", "&lt;")
    return F.regexp_replace(text, r"\[(?=/?(?:I|IN|INS|INST)?\z)", "&#91;")


def unescape(text: Column) -> Column:
    for code, char in (("&lt;", "<"), ("&#91;", "["), ("&#10;", "\n"), ("&amp;", "&")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def text_part(text: str | Column) -> Column:
    """A message of one text part."""
    text = F.col(text) if isinstance(text, str) else text
    none = {"kind": F.lit("text"), "text": text, "ref": F.lit(None)}
    fields = [none.get(f, F.lit(None)).alias(f) for f in ("kind", "text", "ref", "width", "height", "seconds", "pages")]
    return F.array(F.struct(*fields)).cast(f"array<{PART}>")


def part_tokens(p: Column) -> Column:
    """Tokens that an attachment expands to; NULL measures count as the least."""
    side = lambda n: F.greatest(F.lit(1), F.ceil(F.coalesce(p[n], F.lit(1)) / PATCH))
    image = side("width") * side("height")
    audio = F.greatest(F.lit(1), F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * PER_SECOND))
    pages = F.greatest(F.lit(1), F.coalesce(p["pages"], F.lit(1))) * PER_PAGE
    return F.when(p["kind"] == "image", image).when(p["kind"] == "audio", audio).otherwise(pages).cast("bigint")


def flatten(parts: str | Column) -> tuple[Column, Column]:
    """The content string of a message, and its attachments (at, kind, ref, tokens) in order."""
    parts = F.coalesce(F.col(parts) if isinstance(parts, str) else parts, F.expr(f"cast(array() as array<{PART}>)"))
    kind = lambda p: F.when(p["kind"].isin("image", "audio"), p["kind"]).otherwise("document")
    is_text = lambda p: F.coalesce(p["kind"], F.lit("text")) == "text"
    mark = lambda p: F.when(p["kind"] == "image", MARKS["image"]).when(
        p["kind"] == "audio", MARKS["audio"]
    ).otherwise(MARKS["document"])
    escaped = lambda p: escape(F.coalesce(p["text"], F.lit("")))
    safe = lambda p: F.when(F.size(parts) > 1, escape_end(escaped(p))).otherwise(escaped(p))
    written = lambda p: F.when(is_text(p), safe(p)).otherwise(mark(p))
    content = F.array_join(F.transform(parts, written), "")
    empty = F.expr("cast(array() as array<struct<at:bigint,kind:string,ref:string,tokens:bigint>>)")
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("found"))

    def visit(s: Column, p: Column) -> Column:
        one = F.struct(s["at"].alias("at"), kind(p).alias("kind"), p["ref"].alias("ref"), part_tokens(p).alias("tokens"))
        return F.struct(
            (s["at"] + F.length(written(p))).alias("at"),
            F.when(is_text(p), s["found"]).otherwise(F.concat(s["found"], F.array(one))).alias("found"),
        )

    # Messages of text alone, nearly all, need no second visit.
    found = F.when(F.forall(parts, is_text), empty).otherwise(F.aggregate(parts, zero, visit, lambda s: s["found"]))
    return content, found


def _shift(array: Column, by: Column, fields: tuple[str, ...]) -> Column:
    def moved(x: Column) -> Column:
        for f in fields:
            x = x.withField(f, x[f] + by)
        return x

    return F.transform(array, moved)


def _join(pieces: str) -> Column:
    """Concatenate structs (text, n, loss, attachments) with the places moved to the joined text."""
    empty = [
        F.lit(0).cast("bigint").alias("n"),
        F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("loss"),
        F.expr("cast(array() as array<struct<at:bigint,kind:string,ref:string,tokens:bigint>>)").alias("attachments"),
    ]
    return F.aggregate(
        F.col(pieces),
        F.struct(*empty),
        lambda s, x: F.struct(
            (s["n"] + x["n"]).alias("n"),
            F.concat(s["loss"], _shift(x["loss"], s["n"], ("start", "end"))).alias("loss"),
            F.concat(s["attachments"], _shift(x["attachments"], s["n"], ("at",))).alias("attachments"),
        ),
    )


def format_chat(messages: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """(conv_id, turn, role, parts) to one row per conversation: conv_id, formatted, n_turns, n_chars, loss (spans of
    code points, end exclusive, over the formatted text), attachments (at, kind, ref, tokens), n_tokens of attachments.
    """
    content, found = flatten("parts")
    role = F.replace(escape(F.coalesce(F.col("role"), F.lit(""))), F.lit("\n"), F.lit("&#10;"))
    rows = messages.select(
        "conv_id",
        F.col("turn"),
        F.floor(F.col("turn") / BLOCK_TURNS).alias("block"),
        F.concat(F.lit(TURN), role, F.lit("\n")).alias("head"),
        content.alias("content"),
        (F.coalesce(F.col("role"), F.lit("")) == trained_role).alias("train"),
        found.alias("attachments"),
    )
    turn = F.struct("turn", "head", "content", "train", "attachments")
    blocks = rows.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    blocks = blocks.withColumn("pieces", F.transform("turns", _piece))
    blocks = blocks.select(
        "conv_id",
        "block",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["content"], F.lit(END + "\n"))), "").alias("text"),
        _join("pieces").alias("places"),
    )
    block = F.struct(
        "block", "text", F.col("places.n").alias("n"), F.col("places.loss").alias("loss"),
        F.col("places.attachments").alias("attachments"), "n_turns",
    )
    whole = blocks.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(block)).alias("blocks"), F.sum("n_turns").alias("n_turns")
    )
    whole = whole.withColumn("places", _join("blocks"))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("blocks", lambda b: b["text"]), "").alias("formatted"),
        "n_turns",
        F.col("places.n").alias("n_chars"),
        F.col("places.loss").alias("loss"),
        F.col("places.attachments").alias("attachments"),
        F.aggregate("places.attachments", F.lit(0).cast("bigint"), lambda s, a: s + a["tokens"]).alias("n_tokens"),
    )


def _piece(t: Column) -> Column:
    start, size = F.length(t["head"]).cast("bigint"), F.length(t["content"]).cast("bigint")
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    span = F.array(F.struct(start.alias("start"), (start + size).alias("end")))
    return F.struct(
        (start + size + len(END) + 1).alias("n"),
        F.when(t["train"] & (size > 0), span).otherwise(none).alias("loss"),
        _shift(t["attachments"], start, ("at",)).alias("attachments"),
    )


def read_back(formatted: str | Column) -> Column:
    """Array of (role, content) of a formatted conversation, unescaped; placeholders stay in the content."""
    formatted = F.col(formatted) if isinstance(formatted, str) else formatted
    turns = F.filter(F.split(formatted, r"<\|turn\|>"), lambda x: x != "")

    def parse(x: Column) -> Column:
        head = F.substring_index(x, "\n", 1)
        body = F.substring(x, F.length(head) + 2, F.length(x) - F.length(head) - 1 - len(END) - 1)
        return F.struct(unescape(head).alias("role"), unescape(body).alias("content"))

    return F.transform(turns, parse)


def under_loss(formatted: str = "formatted", loss: str = "loss") -> Column:
    """The unescaped text under the loss mask, spans joined without anything between."""
    part = lambda s: F.substring(
        F.col(formatted), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")
    )
    return unescape(F.array_join(F.transform(F.col(loss), part), ""))
