"""Passages of texts: the same offsets everywhere, and nothing lost."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trovelight.operators import passages


def windows(text, size=100, overlap=20):
    return list(passages.windows(text, size, overlap))


def test_known_windows():
    assert windows("A small note about a door.") == [(0, 26)]
    assert windows("") == windows(" \n\n\t ") == []
    assert windows("x" * 250) == [(0, 100), (100, 200), (200, 250)]


@settings(max_examples=300, deadline=None)
@given(
    st.text(alphabet=" \n\tabcé🙂 ", max_size=400),
    st.integers(2, 60),
    st.integers(0, 30),
)
def test_windows_cover_every_word(text, size, overlap):
    found = windows(text, size, overlap)
    covered = set()
    for start, end in found:
        assert 0 < end - start <= size
        assert text[start:end] == text[start:end].strip()
        covered.update(range(start, end))
    assert all(place in covered for place, c in enumerate(text) if not c.isspace())
    starts = [start for start, _ in found]
    assert starts == sorted(starts)


def test_words_stay_whole_and_windows_overlap():
    text = " ".join(f"word{n}" for n in range(300))
    found = windows(text)
    whole = set(text.split())
    for (start, end), (following, _) in zip(found, found[1:]):
        assert {text[start:end].split()[0], text[start:end].split()[-1]} <= whole
        assert following < end


def test_chunks_of_all_documents(spark, documents):
    files = documents.select(
        F.col("doc_id").alias("asset_id"), F.col("lang").alias("collection"), "text"
    )
    texts = {row.asset_id: row.text for row in files.collect()}
    chunks = passages.chunk_text(files).collect()
    by_asset = {}
    for row in chunks:
        assert texts[row.asset_id][row.start_char : row.end_char] == row.text
        by_asset.setdefault(row.asset_id, []).append(row)
    for asset_id, rows in by_asset.items():
        rows.sort(key=lambda row: row.unit_index)
        assert [row.unit_index for row in rows] == list(range(len(rows)))
        assert [(r.start_char, r.end_char) for r in rows] == list(
            passages.windows(texts[asset_id], 1600, 240)
        )


@pytest.mark.parametrize(
    ("content", "expected"),
    [(b"\xef\xbb\xbfabc", "abc"), (b"abc", "abc"), (b"\xef\xbb\xbf", ""), ("é".encode(), "é")],
)
def test_byte_order_mark_is_dropped(spark, content, expected):
    df = spark.createDataFrame([(bytearray(content),)], "content binary")
    assert passages.decode_text(df).first().text == expected


def test_summary_is_whole_up_to_the_budget(spark):
    df = spark.createDataFrame([("x" * 40,), ("x" * 41,)], "text string")
    rows = passages.summary_text(df, 10).orderBy(F.length("text")).collect()
    assert [(len(r.summary), r.summary_of) for r in rows] == [(40, "whole"), (40, "head")]
