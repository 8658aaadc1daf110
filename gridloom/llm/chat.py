"""Chat formatting from event logs, with DataFrame functions alone.

A log has events (conv_id, seq, kind, message, role, text). Kinds: ``message`` and ``edit`` set a
message's text, ``regenerate`` empties it, ``delta`` appends to it. ``reconstruct`` folds the events
of each message in order of seq, from its last set or emptied state on; a message stands where its
first event does, and takes the last role that is given. ``render`` turns the messages of a
conversation into segments with a loss flag, whose texts joined are the formatted conversation.

Template of a turn: ``<|im_start|>`` role, line feed, text ``<|im_end|>``, line feed. Inside texts
and roles a backslash is doubled, ``<|`` becomes ``<\\|`` (and a line feed in a role ``<\\+``); raw
backslashes come in pairs then, so no text can hold a control string, and the steps undone in
reverse give every text back. Only the texts of assistant turns carry loss.

Nulls: a null text is empty, a null role is an empty one, a null seq comes first, and null
conversation ids are one conversation. Events that agree in all columns count once, as logs may
deliver them twice; rows of a table of finished turns (``events_of``) count each, repeated ones too.
Ties in seq are ordered by message, kind, role and text. Other columns are ignored; an empty log gives
no rows. Events of a message, and then messages by ranges of their places, are gathered before
conversations are, so only finished parts meet in a long one; a conversation must fit in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
RANGE = 1024


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\+"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\+"), F.lit("\n")))


def reconstruct(events: DataFrame) -> DataFrame:
    """(conv_id, place, message, role, text): the final messages; place: the seq of the first event."""
    log = events.select("conv_id", "seq", "message", "kind", "role", "text").distinct()
    rows = log.groupBy("conv_id", "message").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "role", "text"))).alias("events"))
    # array_sort puts null fields first within structs, as a null seq is meant to come
    whole = F.array_max(F.transform("events", lambda e, i: F.when(e["kind"] == "delta", 0).otherwise(i)))
    used = F.slice("events", whole + 1, F.size("events"))
    text = F.array_join(F.transform(used, lambda e: F.when(e["kind"] == "regenerate", "").otherwise(F.coalesce(e["text"], F.lit("")))), "")
    roles = F.filter("events", lambda e: e["role"].isNotNull())
    return rows.select("conv_id", F.col("events")[0]["seq"].alias("place"), "message", F.coalesce(F.get(roles, F.size(roles) - 1)["role"], F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, mask array<struct<chars, loss>>) of each conversation.

    The mask covers the formatted text: three runs for each turn, its head, its text and its close.
    """
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    turn = F.array(
        segment(F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")), F.lit(False)),
        segment(escape(F.col("text")), F.col("role") == "assistant"),
        segment(F.lit(END + "\n"), F.lit(False)),
    )
    turns = messages.select("conv_id", "place", "message", turn.alias("turn"))
    parts = turns.groupBy("conv_id", F.floor(F.col("place") / RANGE).alias("part")).agg(F.array_sort(F.collect_list(F.struct("place", "message", "turn"))).alias("turns"))
    segments = F.flatten(F.col("turns.turn"))
    mask = F.transform(segments, lambda s: F.struct(F.char_length(s["text"]).alias("chars"), s["loss"].alias("loss")))
    own = parts.select("conv_id", F.struct("part", F.array_join(segments["text"], "").alias("text"), mask.alias("mask")).alias("part"))
    whole = own.groupBy("conv_id").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return whole.select("conv_id", F.array_join(F.col("parts.text"), "").alias("formatted"), F.flatten("parts.mask").alias("mask"))


def _turns(formatted: Column) -> Column:
    """What follows each start of a turn; no text or role can hold one."""
    return F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1 << 30)


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation, read back: array<struct<role, text>>."""
    close = len(END) + 1

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        text = F.substring(part, F.char_length(role) + 2, F.char_length(part) - F.char_length(role) - 1 - close)
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    return F.transform(_turns(formatted), turn)


def loss_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, cut out of the formatted conversation and unescaped."""

    def cut(part: Column, i: Column) -> Column:
        head, text = F.get(mask, 3 * i), F.get(mask, 3 * i + 1)
        return F.when(text["loss"], unescape(F.substring(part, head["chars"] - len(START) + 1, text["chars"]))).otherwise("")

    return F.array_join(F.transform(_turns(formatted), cut), "")


def events_of(conversations: DataFrame, deltas: int = 3) -> DataFrame:
    """A table of finished turns (conv_id, turn, role, text) as the log that led to them.

    A turn of the assistant was streamed: a first attempt that was given up for a regeneration, whose
    text came in ``deltas`` parts. Any other turn was sent empty and then edited. Rows that repeat are
    turns of their own: the number of each copy is part of its message. A null turn comes first;
    turns that tie are ordered by role and by the SHA-256 of their texts.
    """
    rows = conversations.select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 50))).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    turns = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    size = F.char_length("text")

    def event(step: int, kind: str, text: Column) -> Column:
        return F.struct((F.col("turn") * (deltas + 3) + step).alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))

    def piece(i: int, of: int) -> Column:
        low, high = F.floor(size * i / of), F.floor(size * (i + 1) / of)
        return F.substring("text", low + 1, high - low)

    none = F.lit(None).cast("string")
    streamed = [event(0, "message", none), event(1, "delta", piece(0, 4)), event(2, "regenerate", none), *[event(3 + i, "delta", piece(i, deltas)) for i in range(deltas)]]
    sent = [event(0, "message", none), event(1, "edit", F.col("text"))]
    log = turns.select("conv_id", "role", F.struct("turn", "role", F.sha2("text", 256).alias("digest"), "copy").alias("message"), F.explode(F.when(F.col("role") == "assistant", F.array(*streamed)).otherwise(F.array(*sent))).alias("event"))
    return log.select("conv_id", "event.seq", "event.kind", "message", "role", "event.text")
