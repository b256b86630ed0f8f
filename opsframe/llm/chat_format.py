"""Chat formatting by prefix-target expansion, in DataFrame functions alone.

Every assistant turn becomes one example: all turns before it are the context
and only its own text is trainable. Turns that follow the last assistant turn
would be in no example, so a conversation that does not end with an assistant
turn gets one more row, context only, with an empty loss span.

A turn is written ``<s>role[INST]text</s>``. Role and text are escaped: each
backslash is doubled, then a backslash goes between the first character of a
control string and its rest. Both steps can be undone exactly.

Defined cases: null role or text counts as empty; turns sort by (turn, role,
text), null turn first; repeated rows stay; a null conv_id is a conversation of
its own; an empty table gives no rows; extra columns are ignored. An example
holds its conversation as one value, so a conversation has to fit into a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, HEAD, END = "<s>", "[INST]", "</s>"
#: Control strings of common templates: <s> </s> [INST] [/INST] <<SYS>> <</SYS>> <|
_CONTROL = r"(/?s>|/?INST\]|</?SYS>>|\|)"


def escape(c: Column) -> Column:
    doubled = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, r"([<\[])" + _CONTROL, r"$1\\$2")


def unescape(c: Column) -> Column:
    single = F.regexp_replace(c, r"([<\[])\\" + _CONTROL, "$1$2")
    return F.replace(single, F.lit("\\\\"), F.lit("\\"))


def prefix_target_examples(conversations: DataFrame) -> DataFrame:
    """conv_id, target_index (from 1), n_context, formatted, loss_start (from 1), loss_length, is_last."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.select("conv_id", F.struct(F.col("turn"), role.alias("role"), text.alias("text")).alias("t"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    segments = F.transform("turns", lambda t: F.concat(F.lit(START), escape(t["role"]), F.lit(HEAD), escape(t["text"]), F.lit(END)))
    replies = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.element_at("turns", i)["role"] == "assistant")
    targets = F.array_distinct(F.concat(replies, F.array(F.size("turns"))))
    exploded = (
        grouped.select("conv_id", segments.alias("segments"), F.transform("turns", lambda t: t["role"] == "assistant").alias("reply"), F.size("turns").alias("n"), targets.alias("targets"))
        .select("conv_id", "segments", "reply", "n", F.explode("targets").alias("target_index"))
    )
    k, trainable = F.col("target_index"), F.element_at("reply", F.col("target_index"))
    context = F.array_join(F.slice("segments", F.lit(1), k - 1), "")
    head = len(START) + len("assistant") + len(HEAD)
    return exploded.select(
        "conv_id",
        "target_index",
        F.when(trainable, k - 1).otherwise(k).alias("n_context"),
        F.concat(context, F.element_at("segments", k)).alias("formatted"),
        F.when(trainable, F.length(context) + head + 1).otherwise(F.lit(1)).alias("loss_start"),
        F.when(trainable, F.length(F.element_at("segments", k)) - head - len(END)).otherwise(F.lit(0)).alias("loss_length"),
        (k == F.col("n")).alias("is_last"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role,text>> out of a formatted string."""
    parts = F.filter(F.split(formatted, END), lambda p: p != "")

    def turn(p: Column) -> Column:
        body = F.substr(p, F.lit(len(START) + 1))
        role = F.substring_index(body, HEAD, 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substr(body, F.length(role) + len(HEAD) + 1)).alias("text"))

    return F.transform(parts, turn)


def conversation_digests(examples: DataFrame) -> DataFrame:
    """One row a conversation, everything read back from the formatted examples."""
    loss = unescape(F.substr("formatted", F.col("loss_start"), F.col("loss_length")))
    per_example = examples.select(
        "conv_id",
        F.length("formatted").cast("long").alias("chars"),
        F.struct("target_index", loss.alias("loss")).alias("reply"),
        F.when(F.col("is_last"), read_turns(F.col("formatted"))).alias("turns"),
    ).select(
        "conv_id",
        "chars",
        "reply",
        F.size("turns").cast("long").alias("n"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("sha"),
    )
    summed = per_example.groupBy("conv_id").agg(
        F.max("n").alias("n_turns"),
        F.max("sha").alias("turns_sha256"),
        F.array_join(F.transform(F.sort_array(F.collect_list("reply")), lambda r: r["loss"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
        F.count("*").alias("n_examples"),
    )
    return summed.select(
        "conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples"
    )
