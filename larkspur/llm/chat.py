"""Chat formatting by event-sourced reconstruction.

Only DataFrame functions. A log of events is dealt by conversation once; each message's events, sorted by sequence,
are folded (deltas append, an edit replaces, a regeneration starts anew, a deletion removes), and the messages are
rendered in the order of their first events. Both steps use the one partitioning.

The template is `<s>role\\ntext</s>` a turn. In roles and texts &, <, [ (and in roles line ends) are written as
entities, so no control string of this or another template (`<s>`, `</s>`, `[INST]`, `[/INST]`, `<<SYS>>`) can occur
inside a turn, and reading an output back is exact.

Defined cases: a null text or role is the empty string; a null conversation is one of its own; events of equal
sequence follow by kind, role and text; repeated rows of a table of turns are turns of their own; an empty table
gives no rows; other columns' names don't matter, only the named ones are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Characters that may begin a control string, and their entities, in the order of escaping.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
LINE_END = ("\n", "&#10;")


def escaped(c: Column, role: bool = False) -> Column:
    for a, b in (*ENTITIES, LINE_END) if role else ENTITIES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescaped(c: Column, role: bool = False) -> Column:
    for a, b in reversed((*ENTITIES, LINE_END) if role else ENTITIES):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def fold_events(events: DataFrame) -> DataFrame:
    """Rows (conv_id, first, message, role, text) from rows (conv_id, seq, kind, message, role, text).

    kind: message (or null) and edit replace a message's text, regenerate empties it, delta appends, delete removes the
    message until a later event writes it again. A message's role is that of its last event that has one.
    """
    events = events.select("conv_id", "seq", F.coalesce("kind", F.lit("message")).alias("kind"), "message", "role", F.coalesce("text", F.lit("")).alias("text"))
    event = F.struct("seq", "kind", "role", "text")
    out = events.repartition("conv_id").groupBy("conv_id", "message").agg(F.sort_array(F.collect_list(event)).alias("log"))
    out = out.withColumn("start", F.aggregate(F.transform("log", lambda x, i: F.when(x.kind != "delta", i + 1).otherwise(0)), F.lit(0), lambda a, i: F.greatest(a, i)))
    since = F.slice("log", F.greatest(F.col("start"), F.lit(1)), F.size("log"))
    head = F.when(F.col("start") > 0, F.get("log", F.col("start") - 1).kind)
    text = F.array_join(F.transform(F.filter(since, lambda x: ~x.kind.isin("regenerate", "delete")), lambda x: x.text), "")
    roles = F.filter(F.transform("log", lambda x: x.role), lambda x: x.isNotNull())
    gone = F.coalesce(head == "delete", F.lit(False)) & (F.size(since) == 1)
    return out.filter(~gone).select("conv_id", F.get("log", F.lit(0)).seq.alias("first"), "message", F.coalesce(F.element_at(F.when(F.size(roles) > 0, roles), -1), F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """Rows (conv_id, formatted, mask: spans (start from 0, length) of code points that count for the loss).

    Loss counts on the texts of assistants, escaped as they stand in the output. An offset is a running sum over the
    conversation's sorted turns; turns meet only in the row of their conversation.
    """
    head = F.concat(F.lit("<s>"), escaped(F.col("role"), True), F.lit("\n"))
    body = escaped(F.col("text"))
    out = messages.select("conv_id", F.struct("first", "role", "text", "message").alias("at"), "role", F.length(head).alias("head"), F.length(body).alias("body"), F.concat(head, body, F.lit("</s>")).alias("piece"))
    by = W.partitionBy("conv_id").orderBy("at")
    out = out.withColumn("n", F.row_number().over(by)).withColumn("end", F.sum(F.length("piece")).over(by.rowsBetween(W.unboundedPreceding, 0)))
    span = F.struct((F.col("end") - F.length("piece") + F.col("head")).alias("start"), F.col("body").cast("long").alias("length"))
    turn = F.struct("n", "piece", F.when(F.col("role") == "assistant", span).alias("span"))
    out = out.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    mask = F.filter(F.transform("turns", lambda x: x.span), lambda x: x.isNotNull())
    return out.select("conv_id", F.array_join(F.transform("turns", lambda x: x.piece), "").alias("formatted"), mask.alias("mask"))


def read_turns(formatted: Column) -> Column:
    """An output's turns, array<struct<role, text>>, unescaped."""
    pieces = F.slice(F.split(formatted, "<s>", -1), 2, 1 << 30)
    line = lambda x: F.locate("\n", x)
    return F.transform(pieces, lambda x: F.struct(
        unescaped(F.substring(x, F.lit(1), line(x) - 1), True).alias("role"),
        unescaped(F.substring(x, line(x) + 1, F.length(x) - line(x) - 4)).alias("text"),
    ))


def read_loss(formatted: Column, mask: Column) -> Column:
    """The texts under an output's mask, unescaped, nothing between them."""
    return F.array_join(F.transform(mask, lambda s: unescaped(F.substring(formatted, (s.start + 1).cast("int"), s.length.cast("int")))), "")
