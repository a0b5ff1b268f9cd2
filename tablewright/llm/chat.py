"""Operator 3: chat formatting with typed content parts, in SQL functions only.

A turn holds parts ``struct<kind, text, uri, units>`` (kind text, image, audio or document).
Each part becomes escaped text or a placeholder; attachments keep turn, part, kind, uri and
their expanded token count. A formatted conversation is a series of segments of neighbouring
turns, so that a very long one is never built up in one row; segments joined in order are the
whole conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import plain_text

START, END = "<|im_start|>", "<|im_end|>\n"
#: Tokens of one unit: an image tile, a second of audio, a document page.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 768}
#: Turn numbers that share a segment.
SEGMENT_TURNS = 256
PART_TYPE = "array<struct<kind:string,text:string,uri:string,units:bigint>>"


def escape(text: Column) -> Column:
    """A backslash after every ``<``: no control string is left, nor made where two parts meet."""
    return F.replace(text, F.lit("<"), F.lit("<\\"))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit("<\\"), F.lit("<"))


def _role(role: Column) -> Column:
    """A role is one line: a line feed in it is written as a control string of its own."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<|line|>"))


def text_parts(text: str | Column) -> Column:
    """One text part, for plain turns."""
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("kind"), plain_text(text).alias("text"), none.cast("string").alias("uri"), none.cast("bigint").alias("units")))


def _visited(part: Column) -> Column:
    """What one part becomes: its place in the text, and its attachment's token count."""
    kind = F.lower(F.coalesce(part["kind"], F.lit("text")))
    units = F.coalesce(part["units"], F.lit(1)).cast("bigint")
    shown, tokens = plain_text(escape(part["text"])), F.lit(None).cast("bigint")
    for name, each in UNIT_TOKENS.items():
        shown = F.when(kind == name, F.lit(f"<|{name}|>")).otherwise(shown)
        tokens = F.when(kind == name, units * each).otherwise(tokens)
    return F.struct(shown.alias("shown"), kind.alias("kind"), part["uri"].alias("uri"), tokens.alias("tokens"))


def format_chat(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """``(conv_id, segment, n_turns, formatted, loss_spans, attachments, attachment_tokens)``.

    Turns are ordered by turn number, ties by role and content; repeated rows are repeated
    turns. loss_spans are code point ranges of ``formatted`` (start, end) that hold assistant
    content. NULL conversations form one of their own, a NULL turn number comes first, a NULL
    role or text is empty, NULL or no parts make an empty turn, an unknown kind counts as
    text. Other columns are not read; an empty table gives no rows.
    """
    seen = F.transform(F.coalesce(F.col(parts), F.array().cast(PART_TYPE)), _visited)
    header = F.concat(F.lit(START), _role(plain_text(role)), F.lit("\n"))
    rows = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), plain_text(role).alias("role"),
        F.floor(F.coalesce(F.col(turn), F.lit(-1)).cast("bigint") / SEGMENT_TURNS).cast("bigint").alias("segment"), header.alias("header"),
        F.array_join(F.transform(seen, lambda p: p["shown"]), "").alias("body"),
        F.filter(F.transform(seen, lambda p, i: F.struct(i.alias("part"), p["kind"].alias("kind"), p["uri"].alias("uri"), p["tokens"].alias("tokens"))), lambda a: a["tokens"].isNotNull()).alias("files"))
    segments = rows.groupBy("conv_id", "segment").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "header", "body", "files"))).alias("t"))
    lengths = F.transform("t", lambda x: F.length(x["header"]) + F.length(x["body"]) + len(END))
    segments = segments.withColumn("size", lengths)
    segments = segments.withColumn("begin", F.transform("t", lambda x, i: F.aggregate(F.slice("size", 1, i), F.lit(0), lambda s, v: s + v) + F.length(x["header"])))
    spans = F.filter(F.transform("t", lambda x, i: F.struct(F.get("begin", i).alias("start"), (F.get("begin", i) + F.length(x["body"])).alias("end"), x["role"].alias("role"))), lambda x: x["role"] == "assistant")
    files = F.flatten(F.transform("t", lambda x: F.transform(x["files"], lambda f: F.struct(
        x["turn"].alias("turn"), f["part"].alias("part"), f["kind"].alias("kind"), f["uri"].alias("uri"), f["tokens"].alias("tokens")))))
    return segments.select(
        "conv_id", "segment", F.size("t").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("t", lambda x: F.concat(x["header"], x["body"], F.lit(END))), "").alias("formatted"),
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("loss_spans"),
        files.alias("attachments"),
    ).withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda s, a: s + a["tokens"]))


def read_chat(formatted: DataFrame) -> DataFrame:
    """``(conv_id, segment, n_turns, turns, loss_text, n_chars)`` from formatted segments alone.

    turns: ``role LF text LF`` of each turn; loss_text: what the spans cover; both unescaped.
    """
    turns = F.slice(F.split("formatted", r"<\|im_end\|>\n"), 1, F.size(F.split("formatted", r"<\|im_end\|>\n")) - 1)

    def parsed(t: Column) -> Column:
        line = F.substring_index(t, "\n", 1)
        role = unescape(F.replace(F.substr(line, F.lit(len(START) + 1)), F.lit("<|line|>"), F.lit("\n")))
        body = unescape(F.substr(t, F.length(line) + 2))
        return F.concat(role, F.lit("\n"), body, F.lit("\n"))

    covered = F.transform("loss_spans", lambda s: unescape(F.substr("formatted", s["start"] + 1, s["end"] - s["start"])))
    return formatted.select(
        "conv_id", "segment", F.size(turns).cast("bigint").alias("n_turns"), F.array_join(F.transform(turns, parsed), "").alias("turns"),
        F.array_join(covered, "").alias("loss_text"), F.length("formatted").cast("bigint").alias("n_chars"))


def chat_digest(conversations: DataFrame) -> DataFrame:
    """Digest columns of every conversation, read back from the formatted segments.

    A SHA-256 runs over one whole string, so each conversation's segments meet at the end.
    """
    parts = conversations.select("conv_id", "turn", "role", text_parts("text").alias("parts"))
    read = read_chat(format_chat(parts))
    whole = read.groupBy("conv_id").agg(
        F.sum("n_turns").alias("n_turns"), F.sum("n_chars").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.struct("segment", "turns", "loss_text"))).alias("s"))
    loss, turns = F.array_join("s.loss_text", ""), F.array_join("s.turns", "")
    return whole.select("conv_id", "n_turns", F.sha2(turns, 256).alias("turns_sha256"), F.length(loss).cast("bigint").alias("loss_chars"),
                        F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
