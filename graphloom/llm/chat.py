r"""Event-sourced chat formatting (operator 7), DataFrame functions only.

``fold_events`` rebuilds final messages from a log of events
(conv_id, seq, turn, kind, role, text), kinds being

* ``message``: sets role and text of a turn,
* ``delta``: appends to the turn's text,
* ``edit``: replaces the turn's text,
* ``regenerate``: empties the turn's text, and drops what later turns got before it.

``render`` writes a turn as ``<|turn|>ROLE<|text|>TEXT<|end|>\n``. Inside roles
and texts a backslash is put into every ``<|`` (and one more into ``<\|`` and so
on), which ``read_back`` undoes, so no text can forge a marker. The loss mask is
a list of runs over the output's code points; the texts of one role are under it.

Defined results: null roles and texts count as empty; an event of another kind
changes nothing but makes its turn exist; events of equal seq apply in the order
of kind, role, text; null seq and turn come first; a null conv_id is a
conversation of its own; other columns are ignored. A conversation becomes one
row, so its output is bounded by Spark's 2 GB for a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the final messages of each conversation."""
    event = F.struct("seq", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = events.groupBy("conv_id", "turn").agg(
        F.sort_array(F.collect_list(event)).alias("log"), F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("again")
    )
    earlier = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("since", F.max("again").over(earlier))
    live = F.when(F.col("since").isNull(), F.col("log")).otherwise(F.filter("log", lambda e: e["seq"] > F.col("since")))
    turns = turns.withColumn("log", live).where(F.size("log") > 0)
    # texts from the last event on that sets the text anew; roles from the last message that has one
    starts = F.transform("log", lambda e, i: F.when(e["kind"].isin("message", "edit", "regenerate"), i + 1).otherwise(F.lit(0)))
    turns = turns.withColumn("first", F.greatest(F.array_max(starts), F.lit(1)))
    kept = F.filter(
        F.slice("log", F.col("first"), F.size("log")), lambda e: e["kind"].isin("message", "edit", "delta")
    )
    roles = F.filter("log", lambda e: e["role"] != "")
    return turns.select(
        "conv_id", "turn",
        F.coalesce(F.try_element_at(roles, F.lit(-1))["role"], F.lit("")).alias("role"),
        F.array_join(F.transform(kept, lambda e: e["text"]), "").alias("text"),
    )


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted and mask, an array of (chars, loss) runs that cover ``formatted``."""
    turns = messages.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct(
            "turn", F.col("role").alias("plain"), F.col("text").alias("body"), escape(F.col("role")).alias("role"), escape(F.col("text")).alias("text"),
        ))).alias("turns")
    )
    return turns.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: F.concat(F.lit(TURN), t["role"], F.lit(TEXT), t["text"], F.lit(END))), "").alias("formatted"),
        F.flatten(F.transform("turns", lambda t: F.array(
            F.struct((F.length(t["role"]) + len(TURN) + len(TEXT)).cast("long").alias("chars"), F.lit(False).alias("loss")),
            F.struct(F.length(t["text"]).cast("long").alias("chars"), (t["plain"] == loss_role).alias("loss")),
            F.struct(F.lit(len(END)).cast("long").alias("chars"), F.lit(False).alias("loss")),
        ))).alias("mask"),
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """conv_id, formatted and turns, an array of (role, text, loss), parsed from the output and its mask."""
    parts = F.split("formatted", r"<\|end\|>\n")
    pieces = rendered.withColumn("pieces", F.slice(parts, F.lit(1), F.size(parts) - 1))
    halves = pieces.withColumn("halves", F.transform("pieces", lambda p: F.split(p, r"<\|text\|>")))
    turns = F.transform("halves", lambda h, i: F.struct(
        unescape(F.substring(h[0], len(TURN) + 1, 2147483647)).alias("role"), unescape(h[1]).alias("text"),
        F.element_at(F.col("mask"), i * 3 + 2)["loss"].alias("loss"),
    ))
    return halves.select("conv_id", "formatted", turns.alias("turns"))


def turn_events(conversations: DataFrame) -> DataFrame:
    """Each row of (conv_id, turn, role, text) as a message event of its own, in the order of turn, role, text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("seq", F.row_number().over(order))
    return rows.select("conv_id", "seq", F.col("seq").alias("turn"), F.lit("message").alias("kind"), "role", "text")
