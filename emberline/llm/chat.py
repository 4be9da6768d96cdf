"""Chat formatting with typed content parts.

A turn is a list of parts. A visitor flattens them in order: text is escaped,
and every image, audio or document part becomes a numbered placeholder with its
reference and the tokens it will expand to. Everything is SQL expressions; the
only thing gathered for a conversation is the conversation itself, which is one
row of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template's control strings.
BEGIN, END = "<s>", "</s>"
OPEN, BODY, CLOSE = "[INST]", "<|>", "[/INST]"
#: What may open a control string; an escape mark goes after its first character.
CONTROL = r"([\[<])(/?INST\]|/?s>|\|)"
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Tokens by part: pixels on a side of an image patch, tokens a second of audio, tokens a document page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 512


def escaped(text: Column) -> Column:
    """text with every backslash doubled and every control string broken by one; unescaped() undoes it."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(CONTROL), F.lit(r"$1\\$2"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"(?s)\\(.)"), F.lit("$1"))


def is_attachment(part: Column) -> Column:
    return F.coalesce(part["type"] != "text", F.lit(False))


def part_tokens(part: Column) -> Column:
    """Tokens a part expands to; unknown sizes count as one patch, second or page, unknown types as one token."""
    side = lambda c: F.ceil(F.greatest(F.coalesce(c, F.lit(1)), F.lit(1)) / F.lit(PATCH))
    words = F.size(F.array_remove(F.split(F.coalesce(part["text"], F.lit("")), r"\s+"), ""))
    return (
        F.when(~is_attachment(part), words)
        .when(part["type"] == "image", side(part["width"]) * side(part["height"]))
        .when(part["type"] == "audio", F.ceil(F.greatest(F.coalesce(part["seconds"], F.lit(1.0)), F.lit(0.0)) * AUDIO_RATE))
        .when(part["type"] == "document", F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)) * PAGE_TOKENS)
        .otherwise(1)
        .cast("long")
    )


def text_part(text: Column) -> Column:
    none = lambda kind: F.lit(None).cast(kind)
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), none("string").alias("ref"), none("int").alias("width"), none("int").alias("height"), none("double").alias("seconds"), none("int").alias("pages")))


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, n_turns, formatted, loss_spans, attachments, n_tokens) from (conv_id, turn, role, parts).

    loss_spans are code point ranges of formatted, end exclusive, one for each turn of
    loss_role. attachments are (index, type, ref, tokens) in order. Turns go by turn
    number, nulls first, then role, text and other parts where numbers tie; repeated rows stay.
    A null role is an empty one, null parts and null texts are empty, a null
    conv_id is a conversation of its own. Other columns are ignored.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>")).alias("parts"))
    media = F.filter("parts", is_attachment)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", F.array_join(F.transform("parts", lambda p: F.coalesce(p["text"], F.lit(""))), ""), F.to_json("parts"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("k", F.row_number().over(order)).withColumn("first_media", F.coalesce(F.sum(F.size(media)).over(before), F.lit(0)))
    shown = F.transform(
        "parts",
        lambda p, i: F.when(is_attachment(p), F.concat(F.lit("<|"), escaped(p["type"]), F.lit(":"), (F.col("first_media") + F.size(F.filter(F.slice("parts", F.lit(1), i), is_attachment))).cast("string"), F.lit("|>"))).otherwise(escaped(F.coalesce(p["text"], F.lit("")))),
    )
    rows = rows.withColumn("head", F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(BODY))).withColumn("content", F.array_join(shown, ""))
    rows = rows.withColumn("piece", F.concat("head", "content", F.lit(CLOSE)))
    rows = rows.withColumn("start", F.lit(len(BEGIN)) + F.coalesce(F.sum(F.length("piece")).over(Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.length("head"))
    refs = F.transform(media, lambda p, i: F.struct((F.col("first_media") + i).cast("int").alias("index"), p["type"].alias("type"), p["ref"].alias("ref"), part_tokens(p).alias("tokens")))
    tokens = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + part_tokens(p))
    rows = rows.select("conv_id", F.struct("k", "piece", "start", (F.col("start") + F.length("content")).alias("end"), (F.col("role") == loss_role).alias("loss"), refs.alias("media"), tokens.alias("tokens")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    return chats.select(
        "conv_id",
        F.size("ts").cast("long").alias("n_turns"),
        F.concat(F.lit(BEGIN), F.array_join("ts.piece", ""), F.lit(END)).alias("formatted"),
        F.transform(F.filter("ts", lambda t: t["loss"]), lambda t: F.struct(t["start"].cast("int").alias("start"), t["end"].cast("int").alias("end"))).alias("loss_spans"),
        F.flatten("ts.media").alias("attachments"),
        F.aggregate("ts", F.lit(0).cast("long"), lambda a, t: a + t["tokens"]).alias("n_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role,text>> of a formatted conversation; placeholders stay in the text."""
    body = F.substring(formatted, F.lit(len(BEGIN) + 1), F.length(formatted) - len(BEGIN) - len(END))
    pieces = F.split(body, r"\[/INST\]")

    def turn(p: Column) -> Column:
        cut = F.position(F.lit(BODY), p)
        return F.struct(unescaped(F.substring(p, F.lit(len(OPEN) + 1), cut - len(OPEN) - 1)).alias("role"), unescaped(F.substring(p, cut + len(BODY), F.length(p))).alias("text"))

    return F.transform(F.filter(pieces, lambda p: p.startswith(OPEN)), turn)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")
