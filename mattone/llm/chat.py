"""Chat formatting from event logs: fold streamed deltas, edits and regenerations into final messages, then render.

Events are (conv_id, seq, message, role, kind, text). ``open`` starts a message, ``delta`` adds to it, ``edit`` puts a
text in place of all so far, ``regenerate`` throws it away. The last ``edit`` or ``regenerate`` of a message is its base;
its final text is the base's text and the deltas after it, in order of ``seq``. Folding is by (conversation, message), so
a long conversation is folded in many tasks; only the final texts meet in one row per conversation, which is what the
rendered text is. The role is that of the ``open`` event.

Template: ``### role: text</turn>`` and a line end for each turn. In roles and texts a backslash becomes ``\\\\``, ``#``
becomes ``\\h``, ``<`` becomes ``\\l``, in roles ``:`` becomes ``\\c``; so no text can hold a mark, and unescaping is exact. The loss
mask covers the texts of the assistant.

Rules: a null text or role is empty; a null kind, like an unknown one, changes nothing. Events with equal seq go in order
of kind and text. Messages follow each other by their first seq. A null conversation is one of its own. Empty tables give
an empty result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BASES = ("edit", "regenerate")


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, message, at, role, text): the final messages; ``at`` is the message's first seq."""
    whole = Window.partitionBy("conv_id", "message")
    order = F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"))
    marked = events.select("conv_id", "message", "role", F.col("kind"), order.alias("_o")).withColumn("_base", F.max(F.when(F.col("kind").isin(*BASES), F.col("_o"))).over(whole))
    adds = F.col("kind").eqNullSafe("delta") & (F.col("_base").isNull() | (F.col("_o") > F.col("_base")))
    counts = adds | (F.col("kind").eqNullSafe("edit") & (F.col("_o") == F.col("_base")))
    parts = F.array_sort(F.collect_list(F.when(counts, F.col("_o"))))
    return (marked.groupBy("conv_id", "message")
            .agg(F.min("_o.seq").alias("at"), F.min_by("role", F.when(F.col("kind") == "open", F.col("_o"))).alias("role"), parts.alias("_parts"))
            .select("conv_id", "message", "at", F.coalesce("role", F.lit("")).alias("role"),
                    F.array_join(F.transform("_parts", lambda p: p["text"]), "").alias("text")))


def escaped(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("#"), F.lit("\\h")), F.lit("<"), F.lit("\\l"))
    return F.replace(out, F.lit(":"), F.lit("\\c")) if role else out


def unescaped(text: Column) -> Column:
    # Pairs are read from the left: a doubled backslash is set aside before the letters are looked at.
    parts = F.split(text, r"\\\\", -1)
    plain = F.transform(parts, lambda p: F.replace(F.replace(F.replace(p, F.lit("\\h"), F.lit("#")), F.lit("\\l"), F.lit("<")), F.lit("\\c"), F.lit(":")))
    return F.array_join(plain, "\\")


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted)."""
    turn = F.concat(F.lit("### "), escaped(F.col("role"), True), F.lit(": "), escaped(F.col("text")), F.lit("</turn>\n"))
    turns = F.array_sort(F.collect_list(F.struct("at", "message", turn.alias("turn"))))
    return messages.groupBy("conv_id").agg(turns.alias("_t")).select("conv_id", F.array_join(F.transform("_t", lambda t: t["turn"]), "").alias("formatted"))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns of a rendered text. A ``<`` or ``#`` in it is always a mark."""
    turns = F.filter(F.split(formatted, "</turn>\n", -1), lambda t: t != "")
    cut = F.transform(turns, lambda t: F.struct(F.substring_index(F.substring(t, 5, 2147483647), ": ", 1).alias("role"), t.alias("turn")))
    return F.transform(cut, lambda t: F.struct(unescaped(t["role"]).alias("role"),
                                               unescaped(F.substring(t["turn"], F.length(t["role"]) + 7, F.length(t["turn"]))).alias("text")))
