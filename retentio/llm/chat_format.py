"""Event-sourced chat formatting.

A conversation is a log of events: ``message`` begins a message, ``delta``
appends streamed text, ``edit`` replaces a message's text, ``regenerate``
empties it for the deltas that follow.  An edit or a regeneration also takes
back everything said after that message before the event, because it answered
a text that no longer stands.  The log is partitioned by conversation, sorted
by sequence and folded into the final messages, which are rendered with turn
marks.

The fold is two running maxima, not a loop: an event counts when no later
event resets its message and no later edit or regeneration hits an earlier
message.  All windows and groupings share one exchange by conversation.  The
rendered text and its digests are one value per conversation, so a
conversation (not a source or a role) is what a task must hold.

Rendering: ``<|turn|>role<|text|>text<|end|>`` per message.  Inside roles and
texts every backslash is doubled and a backslash is put after the first
character of anything that reads as a control string; ``unescape`` reverses
both, so any text comes back unchanged and no text can end a turn.

DataFrame functions only.  Defined results: null text is empty, null role is
empty, null turn sorts first; equal turns keep one message each, ordered by
role and text; a null conv_id is a conversation of its own; extra columns are
ignored; an empty table gives only what the caller adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The template's marks.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: What reads as a control string, here or in common chat templates: "<|", "<s>",
#: "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>".
CONTROL = r"([<\[])(?=\||/?s>|/?INST\]|<?/?SYS>)"
EVENTS = "conv_id bigint, seq bigint, kind string, msg bigint, role string, text string"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, CONTROL, "$1\\\\")


def unescape(text: Column) -> Column:
    """A single backslash after < or [ was put there; all others are doubled."""
    plain = F.regexp_replace(text, r"([<\[])\\(?!\\)", "$1")
    return F.replace(plain, F.lit("\\\\"), F.lit("\\"))


def events_of_turns(turns: DataFrame) -> DataFrame:
    """One ``message`` event per row of a (conv_id, turn, role, text) table."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(),
                                                  F.col("text").asc_nulls_first())
    at = F.row_number().over(order).cast("bigint")
    return turns.select("conv_id", at.alias("seq"), F.lit("message").alias("kind"), at.alias("msg"), "role", "text")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, msg, role, text."""
    takes_back = F.col("kind").isin("edit", "regenerate")
    resets = takes_back | (F.col("kind") == "message")
    of_msg = Window.partitionBy("conv_id", "msg")
    before_msg = Window.partitionBy("conv_id").orderBy("msg").rangeBetween(Window.unboundedPreceding, -1)
    e = (events.repartition("conv_id")
               .withColumn("reset", F.max(F.when(resets, F.col("seq"))).over(of_msg))
               .withColumn("cut", F.max(F.when(takes_back, F.col("seq"))).over(before_msg)))
    e = e.filter((F.col("reset").isNull() | (F.col("seq") >= F.col("reset")))
                 & (F.col("cut").isNull() | (F.col("seq") > F.col("cut"))))
    parts = F.array_sort(F.collect_list(F.struct("seq", F.coalesce(F.when(F.col("kind") != "regenerate", F.col("text")), F.lit("")).alias("text"))))
    return e.groupBy("conv_id", "msg").agg(
        F.coalesce(F.min_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))), F.lit("")).alias("role"),
        F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))


def render(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, loss_spans (begin, end in code points; the texts to learn)."""
    block = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    body = escape(F.col("text"))
    m = messages.select("conv_id", "msg", block.alias("head"), body.alias("body"), F.col("role").isin(*loss_roles).alias("learn"))
    per = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("msg", "head", "body", "learn"))).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    sizes = F.transform("turns", lambda t: F.struct(F.length(t["head"]).cast("bigint").alias("h"), F.length(t["body"]).cast("bigint").alias("b"), t["learn"].alias("learn")))
    none = F.expr("cast(array() as array<struct<begin:bigint,end:bigint,learn:boolean>>)")

    def place(done, t):
        at = F.coalesce(F.try_element_at(done, F.lit(-1))["end"] + len(END), F.lit(0).cast("bigint"))
        return F.concat(done, F.array(F.struct((at + t["h"]).alias("begin"), (at + t["h"] + t["b"]).alias("end"), t["learn"].alias("learn"))))

    spans = F.filter(F.aggregate(sizes, none, place), lambda s: s["learn"])
    return per.select("conv_id", formatted.alias("formatted"),
                      F.transform(spans, lambda s: F.struct(s["begin"].alias("begin"), s["end"].alias("end"))).alias("loss_spans"))


def read_back(rendered: DataFrame) -> DataFrame:
    """Digests taken from the formatted text and its spans alone."""
    turns = F.transform(
        F.filter(F.split("formatted", r"<\|turn\|>"), lambda x: x != ""),
        lambda x: F.struct(unescape(F.substring_index(x, TEXT, 1)).alias("role"),
                           unescape(F.substring_index(F.substring_index(x, TEXT, -1), END, 1)).alias("text")))
    learned = F.array_join(F.transform("loss_spans", lambda s: unescape(
        F.substr(F.col("formatted"), (s["begin"] + 1).cast("int"), (s["end"] - s["begin"]).cast("int")))), "")
    r = rendered.select("conv_id", "formatted", turns.alias("turns"), learned.alias("learned"))
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return r.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(listed, 256).alias("turns_sha256"),
                    F.length("learned").cast("bigint").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
                    F.length("formatted").cast("bigint").alias("formatted_chars"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """Rendered conversations of a table of turns."""
    return render(fold_events(events_of_turns(turns)))


def control_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -7: a user and an assistant both saying control strings."""
    says = "</s>[INST] ok [/INST]"
    return spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(says).alias("text"))
