"""Chat formatting with typed content parts, in DataFrame functions only.

A message is an ordered array of parts. A visitor flattens them: text is escaped and written in place;
an image, audio or document part becomes a placeholder ``<image 0>``, numbered in order through the
whole conversation, with its reference and the number of tokens it expands to recorded beside under that number.
Turns are written as ``<turn role="user">…</turn>`` lines. In texts and roles ``&``, ``<`` and ``"`` are
written as entities, so no text can open or close a turn or fake a placeholder, and reading the output
back gives every text unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
OPEN, MIDDLE, CLOSE = '<turn role="', '">', "</turn>\n"
KINDS = ("image", "audio", "document")
PATCH, IMAGE_LEAST = 28, 1  # pixels of a patch side; tokens of an image of unknown size
AUDIO_RATE, PAGE_TOKENS = 25.0, 512  # tokens a second; tokens a page
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;"))


def escape(text: Column) -> Column:
    """Null becomes empty."""
    text = F.coalesce(text, F.lit(""))
    for plain, entity in ENTITIES:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def unescape(text: Column) -> Column:
    for plain, entity in reversed(ENTITIES):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def text_part(text: Column) -> Column:
    """A message of a single text part."""
    empty = [F.lit(None).cast(kind).alias(name) for name, kind in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), *empty))


def part_tokens(part: Column) -> Column:
    """Tokens that an attachment expands to; text parts count as 0 here."""
    side = lambda n: F.ceil(F.coalesce(n, F.lit(0)) / F.lit(float(PATCH)))
    return (
        F.when(part["type"] == "image", F.greatest(side(part["width"]) * side(part["height"]), F.lit(IMAGE_LEAST).cast("long")))
        .when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * F.lit(AUDIO_RATE)))
        .when(part["type"] == "document", F.coalesce(part["pages"], F.lit(0)).cast("long") * F.lit(PAGE_TOKENS))
        .otherwise(F.lit(0).cast("long"))
    )


def flatten_parts(parts: Column, first: Column | None = None) -> tuple[Column, Column]:
    """(content, attachments) of one message, whose first attachment has the number ``first`` (0). Parts of an
    unknown type are written as text."""
    first = F.lit(0) if first is None else first
    is_attachment = lambda p: F.coalesce(p["type"], F.lit("text")).isin(*KINDS)
    attached = F.filter(parts, is_attachment)
    attachments = F.transform(
        attached,
        lambda p, i: F.struct((first + i).cast("int").alias("index"), p["type"].alias("type"), p["ref"].alias("ref"), part_tokens(p).alias("tokens")),
    )

    def visit(part: Column, at: Column) -> Column:
        before = F.size(F.filter(F.slice(parts, F.lit(1), at), is_attachment))
        mark = F.concat(F.lit("<"), part["type"], F.lit(" "), (first + before).cast("string"), F.lit(">"))
        return F.when(is_attachment(part), mark).otherwise(escape(part["text"]))

    return F.concat_ws("", F.transform(parts, visit)), attachments


def attachments_of_none() -> Column:
    return F.expr("cast(array() as array<struct<index:int,type:string,ref:string,tokens:bigint>>)")


def format_chats(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts") -> DataFrame:
    """(conv, formatted, spans, attachments, expanded_tokens): one row per conversation.

    Turns are ordered by number (null first), repeated numbers by role and content; repeated rows are
    all written. ``spans`` has one entry per turn: start and length of its content in ``formatted``, in
    code points, and ``loss``, true for assistant turns. Null parts count as an empty message, a null
    role as an empty one; a null conversation is a conversation. An empty table gives an empty result.
    """
    parts = F.coalesce(F.col(parts_col), F.expr(f"cast(array() as array<{PART}>)"))
    content, attachments = flatten_parts(F.col("parts"))
    rows = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), parts.alias("parts"))
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MIDDLE))
    many = F.size(attachments)
    held = [F.coalesce("role", F.lit("")).alias("role"), head.alias("head"), content.alias("content"), many.alias("many"), F.when(many > 0, F.col("parts")).alias("parts")]
    rows = rows.select("conv", "turn", *held)  # parts travel for messages with attachments only
    so_far = Window.partitionBy("conv").orderBy("turn", "role", "content").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("first", F.coalesce(F.sum("many").over(so_far), F.lit(0)))
    numbered, attachments = flatten_parts(F.col("parts"), F.col("first"))
    none = attachments_of_none()
    rows = rows.withColumn("own", F.when((F.col("many") > 0) & (F.col("first") > 0), numbered).otherwise(F.col("content")))
    rows = rows.withColumn("attachments", F.coalesce(F.when(F.col("many") > 0, attachments), none))
    piece = F.concat("head", "own", F.lit(CLOSE))
    rows = rows.withColumn("at", F.coalesce(F.sum(F.char_length(piece).cast("long")).over(so_far), F.lit(0)))
    span = F.struct(
        (F.col("at") + F.char_length("head")).alias("start"),
        F.char_length("own").cast("long").alias("length"),
        (F.col("role") == "assistant").alias("loss"),
    )
    turn = F.struct("at", piece.alias("piece"), span.alias("span"), "attachments")
    turns = rows.groupBy("conv").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    out = turns.select(
        "conv",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform("turns", lambda t: t["span"]).alias("spans"),
        F.flatten(F.transform("turns", lambda t: t["attachments"])).alias("attachments"),
    )
    total = F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"])
    return out.withColumn("expanded_tokens", total)


def split_turns(formatted: Column) -> Column:
    pieces = F.split(formatted, CLOSE, -1)
    return F.slice(pieces, F.lit(1), F.size(pieces) - 1)


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from the output. Placeholders stay as they were written."""

    def read(piece: Column) -> Column:
        halves = F.split(piece, MIDDLE, 2)
        role = F.substr(F.get(halves, F.lit(0)), F.lit(len(OPEN) + 1))
        return F.struct(unescape(role).alias("role"), unescape(F.get(halves, F.lit(1))).alias("text"))

    return F.transform(split_turns(formatted), read)


def loss_text(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped: cut from the output, turn by turn, at the masked spans
    (a turn's content ends where the turn does)."""

    def cut(piece: Column, span: Column) -> Column:
        length = span["length"].cast("int")
        under = unescape(F.substr(piece, F.char_length(piece) - length + 1, length))
        return F.when(span["loss"], under).otherwise(F.lit(""))

    return F.array_join(F.zip_with(split_turns(formatted), spans, cut), "")
