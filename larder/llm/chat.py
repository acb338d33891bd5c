"""Chat formatting of typed content parts, in DataFrame operations only.

A turn's content is an array of parts: struct<kind, text, ref, width, height, seconds, pages>. A visitor (one expression per
kind, applied by transform) flattens them in order: text is escaped, anything else becomes a placeholder <|kind_N|>, N being
its number among the turn's attachments; its reference and the tokens it expands to are recorded. A plain text column is an
array of one text part.

Template, per turn:  <|im_start|>ROLE\\nTEXT<|im_end|>\\n

Escaping: every "<", any backslashes, "|" gets one more backslash after "<", so a text never holds "<|" and taking one
away gives the text back. In roles, "%" and line feeds are percent-encoded as well.

Turns are ordered by (turn, role, content); repeated rows stay, each a turn of its own. Null texts and roles are empty, null
kinds are text, unknown kinds get a placeholder of no tokens. Null conversation ids make one conversation. The loss mask
covers the assistant's texts: as spans (start, length in code points of the output) and as a flag per turn.
A conversation's output is one string, so a conversation is put together in one task by the nature of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
START, END, LOSS_ROLE = "<|im_start|>", "<|im_end|>\n", "assistant"
#: Tokens an attachment expands to: image patches of so many pixels a side, per second of audio, per page of a document.
PATCH, PER_SECOND, PER_PAGE = 28, 25, 600


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", "<$1|")


def escape_role(c: Column) -> Column:
    return escape(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(c: Column) -> Column:
    return F.replace(F.replace(unescape(c), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def text_parts(text: Column) -> Column:
    """A text column as content."""
    return F.array(
        F.struct(
            F.lit("text").alias("kind"), text.cast("string").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("width"),
            F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"),
        )
    )


def is_text(part: Column) -> Column:
    return F.coalesce(part["kind"], F.lit("text")) == "text"


def part_tokens(part: Column) -> Column:
    """Tokens that an attachment expands to; 0 for text and unknown kinds."""
    side = lambda name: F.ceil(F.coalesce(part[name], F.lit(0)) / F.lit(PATCH))
    return (
        F.when(part["kind"] == "image", side("width") * side("height"))
        .when(part["kind"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * PER_SECOND))
        .when(part["kind"] == "document", F.coalesce(part["pages"], F.lit(0)) * PER_PAGE)
        .otherwise(F.lit(0))
        .cast("long")
    )


def flatten(parts: Column) -> Column:
    """The content as one string of escaped texts and placeholders, in order."""
    number = lambda i: F.size(F.filter(F.slice(parts, F.lit(1), i + 1), lambda p: ~is_text(p)))
    visit = lambda p, i: F.when(is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), F.regexp_replace(p["kind"], r"[^A-Za-z0-9]", ""), F.lit("_"), number(i).cast("string"), F.lit("|>")))
    return F.array_join(F.transform(parts, visit), "")


def attachments(parts: Column) -> Column:
    return F.transform(F.filter(parts, lambda p: ~is_text(p)), lambda p, i: F.struct((i + 1).alias("number"), p["kind"].alias("kind"), p["ref"].alias("ref"), part_tokens(p).alias("tokens")))


def format_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", parts: Column | None = None) -> DataFrame:
    """conv, n_turns, formatted, loss_spans, loss_turns, attachments (with the turn's place), expanded_tokens; a row per conversation."""
    content = parts if parts is not None else text_parts(F.col(text))
    turns = df.select(F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("_role"), content.alias("_parts"))
    turns = turns.select("_conv", "_turn", "_role", flatten(F.col("_parts")).alias("_body"), attachments(F.col("_parts")).alias("_att"))
    head = F.concat(F.lit(START), escape_role(F.col("_role")), F.lit("\n"))
    turns = turns.select("*", head.alias("_head"), F.concat(head, F.col("_body"), F.lit(END)).alias("_piece"))
    order = Window.partitionBy("_conv").orderBy("_turn", "_role", "_body")
    before = F.coalesce(F.sum(F.length("_piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    turns = turns.select(
        "_conv",
        F.struct(
            F.row_number().over(order).alias("place"), F.col("_piece").alias("piece"), (F.col("_role") == LOSS_ROLE).alias("loss"),
            F.struct((before + F.length("_head")).alias("start"), F.length("_body").cast("long").alias("length")).alias("span"), F.col("_att").alias("att"),
        ).alias("_t"),
    )
    whole = turns.groupBy("_conv").agg(F.sort_array(F.collect_list("_t")).alias("_ts"))
    flat = F.flatten(F.transform("_ts", lambda t: F.transform(t["att"], lambda a: F.struct(t["place"].alias("turn"), a["number"].alias("number"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    return whole.select(
        F.col("_conv").alias(conv), F.size("_ts").cast("long").alias("n_turns"), F.array_join(F.col("_ts.piece"), "").alias("formatted"),
        F.transform(F.filter("_ts", lambda t: t["loss"]), lambda t: t["span"]).alias("loss_spans"), F.col("_ts.loss").alias("loss_turns"), flat.alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of an output string, unescaped."""
    segments = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda s: F.startswith(s, F.lit(START)))
    return F.transform(
        segments,
        lambda s: F.struct(
            unescape_role(F.substring_index(F.substr(s, F.lit(len(START) + 1)), "\n", 1)).alias("role"),
            unescape(F.substr(s, F.length(F.substring_index(s, "\n", 1)) + 2)).alias("text"),
        ),
    )


def read_back(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Digests of what the outputs of format_conversations say."""
    turns = formatted.select(conv, F.length("formatted").cast("long").alias("formatted_chars"), "loss_turns", read_turns(F.col("formatted")).alias("_ts"))
    lost = F.array_join(F.transform(F.filter(F.arrays_zip(F.col("_ts.text").alias("text"), F.col("loss_turns").alias("loss")), lambda z: z["loss"]), lambda z: z["text"]), "")
    said = F.array_join(F.transform("_ts", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        conv, F.size("_ts").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length(lost).cast("long").alias("loss_chars"), F.sha2(lost.cast("binary"), 256).alias("loss_sha256"), "formatted_chars"
    )
