"""Chat formatting with Spark expressions only.

Turns are collected as structs, sorted, adjacent turns of one role are merged into a block by array
functions, and the blocks are concatenated. The template:

    <s> block* where a block is
    [SYS]text[/SYS]      role system
    [INST]text[/INST]    role user
    [OUT]text</s>        role assistant
    [ROLE]role[BODY]text[/ROLE]   any other role

Texts of one block are separated by [SEP]. A control string inside a text or role gets a backslash
after its first character (one more, if it has some already), so the output holds no control string
that the template did not put there and the escape is reversed by removing one backslash.

Only assistant texts are under the loss mask; markers and separators never are.

Defined cases: null text and null role count as empty; turns sort by (turn, role, text), null turns
first, so ties and repeated rows have one order and each repeated row is a turn of its own; rows of a
null conv_id form one conversation; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL = r"/?s>|/?INST\]|/?SYS\]|OUT\]|SEP\]|/?ROLE\]|BODY\]"
ESCAPE = rf"([<\[])(\\*)({CONTROL})"
UNESCAPE = rf"([<\[])\\(\\*)({CONTROL})"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2$3")


def _opener(role: Column) -> Column:
    return (
        F.when(role == "system", F.lit("[SYS]"))
        .when(role == "user", F.lit("[INST]"))
        .when(role == "assistant", F.lit("[OUT]"))
        .otherwise(F.concat(F.lit("[ROLE]"), escape(role), F.lit("[BODY]")))
    )


def _closer(role: Column) -> Column:
    return (
        F.when(role == "system", F.lit("[/SYS]"))
        .when(role == "user", F.lit("[/INST]"))
        .when(role == "assistant", F.lit("</s>"))
        .otherwise(F.lit("[/ROLE]"))
    )


def chat_format(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, blocks (role, texts), segments (text, loss) whose texts
    concatenate to formatted, and formatted. One shuffle, on conv_id."""
    arr = F.array_sort(F.collect_list(F.struct(
        F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )))
    rows = turns.select("conv_id", "turn", "role", "text").groupBy("conv_id").agg(arr.alias("turns"))
    rows = rows.withColumn("starts", F.filter(
        F.sequence(F.lit(0), F.size("turns") - 1),
        lambda i: (i == 0) | (F.get("turns", i - 1)["role"] != F.get("turns", i)["role"]),
    ))
    rows = rows.withColumn("blocks", F.transform("starts", lambda b, k: F.struct(
        F.get("turns", b)["role"].alias("role"),
        F.transform(
            F.slice("turns", b + 1, F.coalesce(F.get("starts", k + 1), F.size("turns")) - b), lambda t: t["text"]
        ).alias("texts"),
    )))

    def segments(block: Column) -> Column:
        role = block["role"]
        inner = F.transform(block["texts"], lambda t, i: F.array(
            F.struct(F.when(i == 0, _opener(role)).otherwise(F.lit("[SEP]")).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t).alias("text"), (role == "assistant").alias("loss")),
        ))
        return F.concat(F.flatten(inner), F.array(F.struct(_closer(role).alias("text"), F.lit(False).alias("loss"))))

    first = F.array(F.struct(F.lit("<s>").alias("text"), F.lit(False).alias("loss")))
    rows = rows.withColumn("segments", F.concat(first, F.flatten(F.transform("blocks", segments))))
    return rows.select(
        "conv_id", "blocks", "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) read back from a formatted conversation."""
    blocks = F.filter(F.split(formatted, r"(?=\[(?:SYS|INST|OUT|ROLE)\])"), lambda x, i: i > 0)

    def turns(block: Column) -> Column:
        body = F.regexp_replace(block, r"^\[(?:SYS|INST|OUT)\]|^(?s:\[ROLE\].*?\[BODY\])|(?:\[/SYS\]|\[/INST\]|</s>|\[/ROLE\])$", "")
        role = (
            F.when(block.startswith("[SYS]"), F.lit("system")).when(block.startswith("[INST]"), F.lit("user"))
            .when(block.startswith("[OUT]"), F.lit("assistant"))
            .otherwise(unescape(F.regexp_extract(block, r"^\[ROLE\]((?s:.*?))\[BODY\]", 1)))
        )
        return F.transform(F.split(body, r"\[SEP\]"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    kept = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(kept, lambda s: unescape(s["text"])), "")
