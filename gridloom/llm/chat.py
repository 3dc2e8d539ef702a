"""Chat formatting: typed content parts, control marks, loss mask. DataFrame
functions only.

A visitor walks the content parts of every turn in order. Text is escaped;
image, audio and document parts become numbered placeholders, their references
are recorded and their expanded token counts added up. All control marks start
with ``<`` or ``[``, and escaping takes these two letters (and the escape letter
itself) out of every text, so no text can hold a mark and escaping is reversible.

One shuffle by conversation; a conversation is one output row, as it is one
training example.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import whole

BEGIN, TURN, SEP, END = "<s>", "[TURN]", "[SEP]", "</s>"
PART = "struct<type:string,text:string,ref:string,width:bigint,height:bigint,units:bigint>"
# Expanded tokens: image patches of 14 x 14 points, one per 40 ms of audio, 512 a document page.
PATCH, AUDIO_MS, PAGE_TOKENS = 14, 40, 512


def escape(text: Column) -> Column:
    """Text without ``\\``, ``<`` and ``[`` beyond the escape letter's own use."""
    text = F.replace(text, F.lit("\\"), F.lit("\\e"))
    return F.replace(F.replace(text, F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\b"))


def unescape(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("["))
    return F.replace(text, F.lit("\\e"), F.lit("\\"))


def expanded_tokens(part: Column) -> Column:
    """Tokens that an attachment takes in the model's input; texts count none here."""

    def size(name):
        return F.greatest(F.coalesce(part[name], F.lit(0)), F.lit(0))

    def ceil_div(a, b):
        return F.floor((a + (b - 1)) / b).cast("long")

    return (
        F.when(part["type"] == "image", ceil_div(size("width"), PATCH) * ceil_div(size("height"), PATCH))
        .when(part["type"] == "audio", ceil_div(size("units"), AUDIO_MS))
        .when(part["type"] == "document", size("units") * PAGE_TOKENS)
        .otherwise(F.lit(0))
        .cast("long")
    )


def visit(part: Column) -> Column:
    """A content part as text of the template. Unknown types count as text."""
    kind = part["type"]
    mark = F.concat(F.lit("[ATTACH "), kind, F.lit(" "), escape(F.coalesce(part["ref"], F.lit(""))), F.lit("]"))
    return F.when(kind.isin("image", "audio", "document"), mark).otherwise(
        escape(F.coalesce(part["text"], F.lit("")))
    )


def text_parts(text: Column) -> Column:
    """A plain text as its list of content parts."""
    return F.array(
        F.struct(
            F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"),
            *[F.lit(None).cast("long").alias(c) for c in ("width", "height", "units")],
        )
    ).cast(f"array<{PART}>")


def format_chats(turns: DataFrame, learned: str = "assistant") -> DataFrame:
    """One row per conversation: formatted text, loss spans and attachments.

    ``turns`` has conv_id, turn, role and parts (array of content parts).
    Turns go by number; equal numbers by role and content, repeated rows stay.
    Null numbers come first, null roles are empty, null or empty parts an empty
    text, and a null conv_id is a conversation of its own. Result:
    ``formatted``; ``loss`` (array of start and length in code points: the whole
    content of every ``learned`` turn); ``attachments`` (type, ref, tokens in
    order); ``attachment_tokens``.
    """
    parts = F.coalesce("parts", F.array().cast(f"array<{PART}>"))
    row = F.struct(
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.array_join(F.transform(parts, visit), "").alias("content"),
        F.transform(
            F.filter(parts, lambda p: p["type"].isin("image", "audio", "document")),
            lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens")),
        ).alias("files"),
    )
    chats = turns.select("conv_id", row.alias("t")).groupBy("conv_id").agg(
        F.sort_array(F.collect_list("t")).alias("t")
    )
    lead = lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(SEP))
    chats = chats.withColumn(
        "formatted",
        F.concat(
            F.lit(BEGIN),
            F.array_join(F.transform("t", lambda t: F.concat(lead(t), t["content"])), ""),
            F.lit(END),
        ),
    )
    # Ends of all turns as running sums, by one fold over the lengths.
    sizes = F.transform(
        "t",
        lambda t: F.struct(
            F.length(lead(t)).cast("long").alias("lead"),
            F.length(t["content"]).cast("long").alias("body"),
            (t["role"] == learned).alias("learned"),
        ),
    )
    start = F.struct(F.lit(len(BEGIN)).cast("long").alias("at"), F.expr("array()").cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    chats = chats.withColumn(
        "loss",
        F.aggregate(
            sizes,
            start,
            lambda acc, s: F.struct(
                (acc["at"] + s["lead"] + s["body"]).alias("at"),
                F.when(
                    s["learned"],
                    F.concat(
                        acc["spans"],
                        F.array(F.struct((acc["at"] + s["lead"]).alias("start"), s["body"].alias("length"))),
                    ),
                ).otherwise(acc["spans"]).alias("spans"),
            ),
            lambda acc: acc["spans"],
        ),
    )
    files = F.flatten(F.transform("t", lambda t: t["files"]))
    return chats.select(
        "conv_id",
        "formatted",
        "loss",
        files.alias("attachments"),
        F.aggregate(files, F.lit(0).cast("long"), lambda n, f: n + f["tokens"]).alias("attachment_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """Roles and texts of a formatted conversation, read back in order.
    Placeholders stay as they are, since they stand for no text."""
    body = F.substring(formatted, len(BEGIN) + 1, F.length(formatted) - len(BEGIN) - len(END))
    pieces = F.filter(F.split(body, r"\[TURN\]"), lambda x: x != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring_index(p, SEP, 1)).alias("role"),
            unescape(F.substring(p, F.locate(SEP, p) + len(SEP), F.length(p))).alias("text"),
        ),
    )


def masked_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return unescape(F.array_join(F.transform(loss, lambda s: F.substring(formatted, s["start"] + 1, s["length"])), ""))


def plain_turns(conversations: DataFrame) -> DataFrame:
    """Turns of plain texts in the form that ``format_chats`` takes."""
    return conversations.select("conv_id", "turn", "role", text_parts(whole("text")).alias("parts"))
