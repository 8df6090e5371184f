"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only its
reply is under the loss mask. Turns behind the last reply form one more example without a loss, so
that nothing is lost. DataFrame functions only.

Template: <|im_start|>ROLE\\nTEXT<|im_end|>\\n for every turn. A control string inside a text gets a
backslash behind its first character, one more if there are some already; reading takes one away.
In roles a backslash and a line end are escaped.

Defined results: a null text or role is empty; rows of a conversation stand in the order of turn
(null first), then role and text, so repeated rows and ties are kept; a null conv_id is a
conversation of its own; an empty table gives an empty result; more columns are ignored. A
conversation is one row at a time, since its digest reads it in order; examples are rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, END = "<|im_start|>", "<|im_end|>"
#: What follows the first character of a control string.
_TAIL = r"(/?s>|/?SYS>|<SYS>|/?INST\]|\|[A-Za-z_]+\|>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _TAIL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _TAIL, "$1$2$3")


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    # pairs of backslashes first, so that an escaped backslash before an n stays what it is
    parts = F.transform(F.split(role, r"\\\\"), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n")))
    return unescape(F.array_join(parts, "\\"))


def formatted_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(BEGIN), _escape_role(role), F.lit("\n"), escape(text), F.lit(END + "\n"))


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: the formatted turns of each conversation in order, with their roles."""
    row = F.struct(
        F.col("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    ordered = conversations.select("conv_id", row.alias("_row")).groupBy("conv_id").agg(F.array_sort(F.collect_list("_row")).alias("_rows"))
    formatted = F.transform(
        "_rows",
        lambda x: F.struct(
            (x["role"] == "assistant").alias("reply"),
            formatted_turn(x["role"], x["text"]).alias("text"),
            F.char_length(escape(x["text"])).alias("chars"),
        ),
    )
    return ordered.select("conv_id", formatted.alias("turns"))


def examples(conversations: DataFrame) -> DataFrame:
    """One row per example: conv_id, example (from 0), last, text, loss_start, loss_chars (code
    points of text under the loss mask, escapes included; 0 for an example without a reply)."""
    ends = F.filter(F.transform("turns", lambda x, i: F.when(x["reply"] | (i == F.size("turns") - 1), i + 1)), lambda x: x.isNotNull())
    spread = turns(conversations).select("conv_id", "turns", F.size("turns").alias("_n"), F.posexplode(ends).alias("example", "_end"))
    target = F.element_at("turns", F.col("_end"))
    text = F.array_join(F.transform(F.slice("turns", 1, F.col("_end")), lambda x: x["text"]), "")
    chars = F.when(target["reply"], target["chars"]).otherwise(F.lit(0))
    return (
        spread.withColumn("text", text)
        .withColumn("loss_chars", chars)
        .select(
            "conv_id",
            "example",
            (F.col("_end") == F.col("_n")).alias("last"),
            "text",
            (F.char_length("text") - len(END) - 1 - F.col("loss_chars")).alias("loss_start"),
            "loss_chars",
        )
    )


def read_turns(text: Column) -> Column:
    """The (role, text) rows of a formatted text."""
    pieces = F.filter(F.split(text, r"<\|im_end\|>\n"), lambda x: x != "")
    bare = F.transform(pieces, lambda x: F.substring(x, F.lit(len(BEGIN) + 1), F.char_length(x)))

    def turn(x: Column) -> Column:
        at = F.call_function("locate", F.lit("\n"), x)
        return F.struct(
            _unescape_role(F.substring(x, F.lit(1), at - 1)).alias("role"),
            unescape(F.substring(x, at + 1, F.char_length(x))).alias("text"),
        )

    return F.transform(bare, turn)


def read_loss(text: Column, start: Column, chars: Column) -> Column:
    """The text under the loss mask, without escapes."""
    return unescape(F.substring(text, start + 1, chars))
