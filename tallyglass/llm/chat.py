"""Chat logs to training text: fold events into messages, render them with a reversible template, read them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.common import let

# Fixed values of the template.  A turn is OPEN, the role, COLON, the text, CLOSE.
OPEN, COLON, CLOSE = "<turn>### ", ": ", "</turn>\n"
TRAINED = "assistant"
# What may not appear inside a role or a text, and how it is written there; the backslash itself comes first.
ESCAPES = [("\\", "\\\\"), ("<turn", "<\\turn"), ("</turn", "<\\/turn"), ("##", "#\\#")]


def escaped(text: Column) -> Column:
    for raw, written in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(written))
    return text


def unescaped(text: Column) -> Column:
    """Every backslash stands before the character it protects."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit(":"), F.lit("\\:"))


def fold_events(events: DataFrame) -> DataFrame:
    """From a log ``conv_id, seq, message, op, role, text`` to ``conv_id, turns``: array of ``message, role, text``.

    The log is partitioned by conversation, once; in it, events are taken in order of ``seq``, which counts over the whole
    conversation (ties by op, role, text), so they may arrive in any order and messages may interleave.  ``delta`` adds its
    text to its message, ``edit`` replaces what the message says, ``regenerate`` starts the message anew with its text
    (null: empty); deltas that follow add to either.  The role is the last one given.  Each message is folded in one pass over its
    events; then a conversation's messages are put in order of ``message``.  Both steps keep the first partitioning.  A
    conversation is one row in the end, so it must fit in one.  Null texts add nothing, null roles count as empty
    if no event gives one, unknown ops count as ``delta``, events without a conversation or message are their own
    conversation or message null, and repeated events apply repeatedly.  Other columns, whatever their names, are not read.
    """
    event = F.struct("seq", "op", "role", "text")
    logs = events.select("conv_id", "message", "seq", "op", "role", "text").repartition("conv_id")
    each = logs.groupBy("conv_id", "message").agg(F.sort_array(F.collect_list(event)).alias("log"))

    def final(log: Column) -> Column:
        resets = F.filter(F.transform(log, lambda e, i: F.when(e["op"].isin("edit", "regenerate"), i)), lambda i: i.isNotNull())
        start = F.coalesce(F.array_max(resets), F.lit(0))
        texts = F.transform(F.slice(log, start + 1, F.size(log)), lambda e: F.coalesce(e["text"], F.lit("")))
        return F.array_join(texts, "")

    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())
    messages = each.select("conv_id", F.struct(
        "message", F.coalesce(F.get(roles, F.size(roles) - 1), F.lit("")).alias("role"), let(F.col("log"), final).alias("text")
    ).alias("turn"))
    return messages.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))


def render(conversations: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_spans``: the text and where (``start`` from 0, ``length``) the model is to learn.

    Spans hold the written (escaped) assistant texts; they do not touch each other, as the template lies between.
    """
    written = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(OPEN), _role(t["role"]), F.lit(COLON)).alias("head"), escaped(t["text"]).alias("body"),
        (t["role"] == TRAINED).alias("trained")))
    formatted = F.array_join(F.transform("w", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
    sized = F.transform("w", lambda t: F.struct(F.length(t["head"]).cast("bigint").alias("head"), F.length(t["body"]).cast("bigint").alias("body"), t["trained"].alias("trained")))
    return conversations.select("conv_id", written.alias("w")).select(
        "conv_id", formatted.alias("formatted"), sized.alias("sized")).select(
        "conv_id", "formatted", _spans(F.col("sized")).alias("loss_spans"))


def _spans(sized: Column) -> Column:
    """Running sums of the lengths, by one fold that carries only the place and the spans so far."""
    empty = F.array().cast("array<struct<start:bigint,length:bigint>>")
    state = F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("spans"))
    one = F.lit(1).cast("bigint")

    def step(s: Column, t: Column) -> Column:
        span = F.array(F.struct((s["at"] + t["head"]).alias("start"), t["body"].alias("length")))
        return F.struct((s["at"] + t["head"] + t["body"] + one * len(CLOSE)).alias("at"),
                        F.when(t["trained"], F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(sized, state, step, lambda s: s["spans"])


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text, as an array of ``role, text``: the inverse of the template."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda p: p != "")

    def turn(piece: Column) -> Column:
        head = F.regexp_extract(piece, rf"(?s)^{OPEN}((?:[^:\\]|\\.)*+): ", 1)
        return F.struct(unescaped(head).alias("role"),
                        unescaped(F.substring(piece, F.lit(len(OPEN) + len(COLON) + 1) + F.length(head), F.length(piece))).alias("text"))

    return F.transform(pieces, turn)


def under_loss(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask, in order."""
    return F.transform(spans, lambda s: unescaped(
        F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))


def format_chats(events: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_spans`` of every conversation of an event log; see ``fold_events`` for odd rows."""
    return render(fold_events(events))
