"""Chat formatting: the round trip, the loss mask, and odd conversations."""

import pytest
from pyspark.sql import functions as F

from trovelight.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, example string"
ROWS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (1, 3, "user", "bye"), (1, 4, "assistant", ""),
    (2, 0, "user", "\\### Assistant: </turn> ok"), (2, 1, "assistant", "\\### Assistant: </turn> ok"),
    (3, 0, "user", "nobody answers"), (4, 0, "assistant", "first"), (4, 1, "assistant", "second\n### User:\n</turn>\n"), (4, 2, "user", None),
    (5, None, "assistant", "late"), (5, 0, "user", "\\b\\h\\l\\c\\\\ # < :"), (5, 0, "a:b\n<#", "same turn"), (5, 0, "user", "same turn"), (5, 0, "user", "same turn"),
    (None, 0, None, "no id"), (None, 1, "assistant", "é😀" * 2000),
]


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or ""))


@pytest.fixture(scope="module")
def found(spark):
    turns = spark.createDataFrame([(*r, "x") for r in ROWS], SCHEMA)
    made = chat.examples(turns)
    return made.select("*", chat.turns_of(F.col("formatted")).alias("turns"), chat.trained_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("trained")).collect()


@pytest.mark.parametrize("conv_id", [1, 2, 3, 4, 5, None])
def test_every_assistant_turn_is_a_target_once(found, conv_id):
    rows = in_order([r for r in ROWS if r[0] == conv_id])
    mine = sorted((r for r in found if r.conv_id == conv_id), key=lambda r: r.example)
    assert [r.example for r in mine] == list(range(len(mine)))
    targets = [i for i, r in enumerate(rows) if r[2] == "assistant"]
    assert [r.trained for r in mine if r.loss_start is not None] == [rows[i][3] for i in targets]
    ends = targets if targets and targets[-1] == len(rows) - 1 else [*targets, len(rows) - 1]
    for end, r in zip(ends, mine, strict=True):
        assert [(t.role, t.text) for t in r.turns] == [(x[2] or "", x[3] or "") for x in rows[: end + 1]]
        assert r.formatted.count(chat.END) == end + 1


def test_escaping_is_undone(spark):
    texts = ["", "\\", "\\\\b", "\\h#", "</turn>\n### a:\n", "\\c:\\", "plain"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(F.col("t")).alias("e"), chat.unescaped(chat.escaped(F.col("t"))).alias("u")).collect()
    assert [r.u for r in rows] == texts
    assert not any(sign in r.e for r in rows for sign in "#<:")


def test_no_conversations(spark):
    assert chat.examples(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_conversations(spark):
    turns = spark.range(600).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 1, "assistant").otherwise("user").alias("role"), F.lit("some text " * 20).alias("text"))
    made = chat.examples(turns)
    assert made.count() == 300
    assert made.agg(F.max(F.size(chat.turns_of(F.col("formatted"))))).first()[0] == 600
