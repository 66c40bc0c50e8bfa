"""Chat formatting from an event log: fold the events of a conversation, then render its messages.

An event is ``(conv_id, seq, kind, role, text)``:

- ``message`` opens a message with ``role`` and a first ``text``;
- ``delta`` appends ``text`` to the message opened last;
- ``edit`` replaces the text of the message opened last;
- ``regenerate`` drops that text, so that later deltas start anew.

Folding is windows over ``(conv_id, seq)``; only a finished conversation is ever one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Escaped in texts and roles; "&" goes first and comes back last.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("[", "&lb;"), ("]", "&rb;"))
OPEN, CLOSE_ROLE, END = "<s>[", "]", "</s>"


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def fold_events(events: DataFrame) -> DataFrame:
    """``(conv_id, position, role, text)``: the final messages of an event log ``(conv_id, seq, kind, role, text)``.

    An optional column ``message`` numbers the message an event belongs to, so an edit may reach any earlier one; without it, or
    where it is null, messages are numbered as they open and an event belongs to the last. Messages come in the order of their
    numbers. Events of a message that is never opened and unknown kinds are ignored; a null text or
    role is empty. Events with equal ``seq`` are taken by kind, role and text. Repeated events count
    as often as they occur. An empty log has no messages; other columns are not read.
    """
    order = Window.partitionBy("conv_id").orderBy("seq", "kind", "role", "text")
    number = F.col("message").cast("long") if "message" in events.columns else F.lit(None).cast("long")
    log = events.select("conv_id", "seq", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), number.alias("number"))
    opened = F.sum((F.col("kind") == "message").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    numbered = log.withColumns({"position": F.coalesce("number", opened), "step": F.row_number().over(order)})
    starts = F.col("kind").isin("message", "edit", "regenerate")
    within = Window.partitionBy("conv_id", "position")
    from_step = F.max(F.when(starts, F.col("step"))).over(within)
    known = F.max((F.col("kind") == "message").cast("int")).over(within) == 1
    pieces = numbered.withColumns({"start": from_step, "known": known}).filter("known AND (step >= start OR kind = 'message')")
    part = F.when((F.col("step") >= F.col("start")) & F.col("kind").isin("message", "delta", "edit"), F.struct("step", "text"))
    return pieces.groupBy("conv_id", "position").agg(
        F.max(F.when(F.col("kind") == "message", F.col("role"))).alias("role"),
        F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda p: p["text"]), "").alias("text"))


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``(conv_id, formatted, loss)``; ``loss`` lists the half-open code point spans under the loss mask."""
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(CLOSE_ROLE))
    body = escape(F.col("text"))
    turns = messages.select(
        "conv_id", "position", (F.col("role") == loss_role).alias("lossy"), F.char_length(head).alias("lead"),
        F.char_length(body).alias("inside"), F.concat(head, body, F.lit(END)).alias("turn"))
    order = Window.partitionBy("conv_id").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow - 1)
    placed = turns.withColumn("at", F.coalesce(F.sum(F.char_length("turn").cast("long")).over(order), F.lit(0)))
    begin = F.col("at") + F.col("lead")
    span = F.when(F.col("lossy"), F.struct(begin.alias("start"), (begin + F.col("inside")).alias("stop")))
    return placed.groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "turn"))), lambda t: t["turn"]), "").alias("formatted"),
        F.sort_array(F.collect_list(span)).alias("loss"))


def parse(formatted: Column) -> Column:
    """The array of ``(role, text)`` behind a formatted conversation."""
    turns = F.filter(F.split(formatted, END), lambda t: t != "")
    def turn(t: Column) -> Column:
        inner = F.substr(t, F.lit(len(OPEN) + 1))
        return F.struct(
            unescape(F.substring_index(inner, CLOSE_ROLE, 1)).alias("role"),
            unescape(F.substr(inner, F.instr(inner, CLOSE_ROLE) + 1)).alias("text"))
    return F.transform(turns, turn)


def masked_text(formatted: Column, loss: Column) -> Column:
    """The unescaped text under the loss mask, spans joined by nothing."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")))), "")


def format_chats(events: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Fold an event log and render it: ``(conv_id, formatted, loss)``, one row per conversation."""
    return render(fold_events(events), loss_role)


# Characters of the drafts that a made log begins some messages with, and where its late edits are numbered from.
DRAFT, LATE = 12, 1 << 40


def events_from_turns(turns: DataFrame) -> DataFrame:
    """An event log, with message numbers, whose final messages are the turns ``(conv_id, turn, role, text)``.

    By a hash of its place a message is streamed in two deltas, or begins with a draft that is regenerated before
    these, or opens with a draft that is edited after the conversation's last message. Turns of equal number are
    ordered by role and text; a repeated row is a turn of its own.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = turns.select("conv_id", "turn", "role", "text").withColumn("n", F.row_number().over(order).cast("long"))
    half = F.floor(F.char_length("text") / 2).cast("int")
    none, way = F.lit(None).cast("string"), F.pmod(F.xxhash64("conv_id", "n"), F.lit(3))
    draft = F.concat(F.lit("draft "), F.left("text", F.lit(DRAFT)))
    def event(k: int, kind: str, role: Column, text: Column, late: int = 0) -> Column:
        return F.struct((F.col("n") * 8 + k + late).alias("seq"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"), F.col("n").alias("message"))
    opened, deltas = event(0, "message", F.col("role"), none), [event(3, "delta", none, F.left("text", half)), event(4, "delta", none, F.substr("text", half + 1))]
    log = (F.when(way == 0, F.array(opened, event(1, "delta", none, draft), event(2, "regenerate", none, none), *deltas))
           .when(way == 1, F.array(event(0, "message", F.col("role"), draft), event(1, "edit", none, F.col("text"), LATE)))
           .otherwise(F.array(opened, *deltas)))
    return numbered.select("conv_id", F.inline(log))
