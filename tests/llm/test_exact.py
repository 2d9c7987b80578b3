"""Radix partitioning against a dictionary of normalised texts."""

import re

import pytest
from pyspark.sql import functions as F

from trovelight.llm import exact

TEXTS = [
    "same text", "same  text", "same\ttext", " same text", "same text ", "", None, "   ", "\n", "a", "a", "b",
    "x" * 64, "x" * 64, "x" * 65, "x" * 63 + "é", "x" * 63 + "é", "é" * 5000 + "1", "é" * 5000 + "2", "é" * 5000 + "1",
    "long " * 9000 + "end", "long " * 9000 + "END", "long  " * 9000 + "end", "same text\u00a0", "same text\u00a0", "nul\x00", "nul",
]


def plain(rows):
    """(id, text) rows to (keep_id, size) by id, null ids last."""
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(doc_id)
    return {key: (min((i for i in ids if i is not None), default=None), len(ids)) for key, ids in groups.items()}


@pytest.mark.parametrize("options", [{}, {"broadcast_rows": 0, "rows_per_part": 1}, {"first_digit": 1, "growth": 2}])
def test_groups(spark, options):
    rows = list(enumerate(TEXTS))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = exact.equal_texts(docs, **options).select("row.doc_id", "row.text", "keep_id", "group_size", "kept").collect()
    expected = plain(rows)
    assert sorted(r.doc_id for r in found) == list(range(len(TEXTS)))
    for r in found:
        keep, size = expected[re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")]
        assert (r.keep_id, r.group_size, r.kept) == (keep, size, r.doc_id == keep)


def test_null_ids_repeated_rows_and_clashing_names(spark):
    rows = [(None, "t", 1), (5, "t", 2), (5, "t", 3), (None, "u", 4), (None, "u", 5), (9, "v" * 200, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gid long").withColumn("size", F.col("gid")).withColumn("rest", F.lit("r"))
    found = exact.equal_texts(docs)
    kept = exact.without_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "u"), (5, "t"), (9, "v" * 200)]
    assert {(r.row.gid, r.keep_id, r.group_size) for r in found.collect()} == {
        (1, 5, 3), (2, 5, 3), (3, 5, 3), (4, None, 2), (5, None, 2), (6, 9, 1)
    }


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact.equal_texts(docs).count() == 0
    assert exact.without_copies(docs).columns == docs.columns


def test_a_third_of_all_rows_in_one_group(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("copy " * 300)).otherwise(F.concat(F.lit("copy " * 200), F.col("id").cast("string"))).alias("text"))
    found = exact.equal_texts(docs, carry=["doc_id"], broadcast_rows=0, rows_per_part=100)
    assert found.count() == 3000
    sizes = {(r.keep_id, r.group_size): r["count"] for r in found.groupBy("keep_id", "group_size").count().where("count > 1").collect()}
    assert sizes == {(0, 1000): 1000}
    assert found.where("kept").count() == 2001
