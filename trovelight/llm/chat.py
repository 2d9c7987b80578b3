"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own, with all
turns before it as context and only its own text trainable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovelight.llm.common import prepared

# The template: a mark and the role, the text, and the end of the turn.
MARK, AFTER_ROLE, END = "### ", ":\n", "</turn>\n"
# Signs of the template and how they are written inside texts. Every backslash of an escaped text starts
# one of these, so that they can be undone one after the other, the backslash itself last.
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))


def escaped(text: Column) -> Column:
    """`text` without `#`, `<` and `:`, so that no part of the template can occur in it."""
    for sign, written in ESCAPES:
        text = F.replace(text, F.lit(sign), F.lit(written))
    return text


def unescaped(text: Column) -> Column:
    for sign, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(sign))
    return text


def examples(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target: str = "assistant") -> DataFrame:
    """Examples of every conversation: conv_id, example (from 0), formatted, loss_start and loss_end.

    The trainable text of an example is formatted[loss_start:loss_end] in code points, and is escaped. A
    conversation whose last turn is not an assistant's ends with an example of all turns and no
    trainable text (nulls), so that every turn is in some example.

    Turns are ordered by number, null numbers last, then by role and text; repeated rows are turns of
    their own. Null texts and roles count as empty. Rows without a conversation id form one conversation.
    A conversation's turns meet in one task, as each of its examples holds a prefix of it.
    """
    prepared(turns.sparkSession)
    one = F.struct(
        F.isnull(F.col(f"`{turn}`")).alias("late"),
        F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    whole = turns.groupBy(F.col(f"`{conv_id}`").alias("conv_id")).agg(F.array_sort(F.collect_list(one)).alias("turns"))
    marked = whole.select(
        "conv_id",
        F.transform(
            "turns",
            lambda t: F.struct(
                (t["role"] == target).alias("own"),
                F.concat(F.lit(MARK), escaped(t["role"]), F.lit(AFTER_ROLE)).alias("head"),
                escaped(t["text"]).alias("body"),
            ),
        ).alias("marked"),
    )
    ends = F.filter(
        F.transform("marked", lambda m, i: F.when(m["own"] | (i == F.size("marked") - 1), i)), lambda i: i.isNotNull()
    )
    each = marked.select("conv_id", "marked", F.posexplode(ends).alias("example", "at"))
    before = F.array_join(F.transform(F.slice("marked", F.lit(1), F.col("at")), lambda m: F.concat(m["head"], m["body"], F.lit(END))), "")
    parts = each.select("conv_id", "example", before.alias("context"), F.col("marked")[F.col("at")].alias("last"))
    start = F.length("context") + F.length("last.head")
    return parts.select(
        "conv_id",
        "example",
        F.concat("context", "last.head", "last.body", F.lit(END)).alias("formatted"),
        F.when(F.col("last.own"), start).alias("loss_start"),
        F.when(F.col("last.own"), start + F.length("last.body")).alias("loss_end"),
    )


def turns_of(formatted: Column) -> Column:
    """The turns of a formatted example as structs role and text, unescaped."""
    def parsed(part: Column) -> Column:
        role = F.substring_index(part, AFTER_ROLE, 1)
        return F.struct(
            unescaped(role.substr(F.lit(len(MARK) + 1), F.length(role))).alias("role"),
            unescaped(part.substr(F.length(role) + len(AFTER_ROLE) + 1, F.length(part))).alias("text"),
        )

    ended = F.split(formatted, END, -1)
    return F.transform(F.slice(ended, F.lit(1), F.size(ended) - 1), parsed)


def trained_text(formatted: Column, start: Column, end: Column) -> Column:
    """The trainable text of an example, unescaped; null where there is none."""
    return unescaped(formatted.substr(start + 1, end - start))
