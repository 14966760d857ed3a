"""Relational chat formatting: turns to template text and back, in Spark expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, SEP = "<|im_start|>", "<|im_end|>\n", "<|im_sep|>"
#: Escapes in order; unescaped in reverse. No control string survives in an escaped text.
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;")]
#: In a role a line feed would end the header.
ROLE_ESCAPES = [*ESCAPES, ("\n", "&#10;")]


def escape(text: Column, escapes: list[tuple[str, str]] = ESCAPES) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), escapes, text)


def unescape(text: Column, escapes: list[tuple[str, str]] = ESCAPES) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[1]), F.lit(e[0])), reversed(escapes), text)


def _quoted(literal: str) -> str:
    return literal.replace("|", "\\|")


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, its blocks (role, loss, bodies), and the loss mask: spans (start and
    chars, in characters from 0) of `formatted` that are learned.

    `turns` has conv_id, turn, role and text; other columns are ignored. A conversation's rows are collected as
    structs and sorted by turn (null first), then role and text, so ties have one order. Adjacent turns of one
    role merge into a block, whose bodies are joined by a separator, so that reading back gives the turns
    themselves. A null role or text counts as empty; null conv_ids form one conversation. An empty table gives
    no rows. `loss` marks the blocks whose bodies are learned.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    n = F.size("turns")
    turn = lambda i: F.get(F.col("turns"), i)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (turn(i)["role"] != turn(i - 1)["role"]))
    grouped = grouped.withColumn("starts", starts)
    stop = lambda k: F.coalesce(F.get(F.col("starts"), k + 1), n)
    blocks = F.transform(
        "starts",
        lambda s, k: F.struct(
            turn(s)["role"].alias("role"),
            (turn(s)["role"] == loss_role).alias("loss"),
            F.transform(F.slice("turns", s + 1, stop(k) - s), lambda t: escape(t["text"])).alias("bodies"),
        ),
    )
    grouped = grouped.select("conv_id", blocks.alias("blocks"))
    text = F.transform("blocks", lambda b: F.concat(F.lit(START), escape(b["role"], ROLE_ESCAPES), F.lit("\n"), F.array_join(b["bodies"], SEP), F.lit(END)))
    return grouped.select("conv_id", F.array_join(text, "").alias("formatted"), "blocks", loss_spans(F.col("blocks")).alias("loss_spans"))


def loss_spans(blocks: Column) -> Column:
    """Where the learned bodies stand in the text of these blocks: each body is one span."""
    size = lambda c: F.char_length(c).cast("long")
    step = lambda at, spans: F.struct(at.alias("at"), spans.alias("spans"))

    def through_body(learned: Column, sofar: Column, body: Column) -> Column:
        own = F.array(F.struct(sofar["at"].alias("start"), size(body).alias("chars")))
        return step(sofar["at"] + size(body) + len(SEP), F.when(learned, F.concat(sofar["spans"], own)).otherwise(sofar["spans"]))

    def through_block(sofar: Column, block: Column) -> Column:
        first = sofar["at"] + len(START) + size(escape(block["role"], ROLE_ESCAPES)) + 1
        done = F.aggregate(block["bodies"], step(first, sofar["spans"]), lambda a, b: through_body(block["loss"], a, b))
        return step(done["at"] - len(SEP) + len(END), done["spans"])

    none = F.array().cast("array<struct<start:bigint,chars:bigint>>")
    return F.aggregate(blocks, step(F.lit(0).cast("long"), none), through_block)["spans"]


def under_mask(formatted: Column, spans: Column) -> Column:
    """The learned text: what stands in a formatted text under its mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["chars"].cast("int")))), "")


def read_back(formatted: Column) -> Column:
    """The turns in a formatted text: array of (role, text)."""
    parts = F.filter(F.split(formatted, _quoted(START)), lambda part, i: i > 0)

    def turns(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        body = F.substring(part, F.length(role) + 2, F.length(part) - F.length(role) - 1 - len(END))
        return F.transform(F.split(body, _quoted(SEP)), lambda b: F.struct(unescape(role, ROLE_ESCAPES).alias("role"), unescape(b).alias("text")))

    return F.flatten(F.transform(parts, turns))


def chat_digests(turns: DataFrame) -> DataFrame:
    """What the formatted text says when read back, and what stands in it under its loss mask."""
    out = format_conversations(turns).withColumn("turns", read_back(F.col("formatted")))
    out = out.withColumn("learned", under_mask(F.col("formatted"), F.col("loss_spans")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
