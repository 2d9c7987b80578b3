"""Phrases against a plain search, templates word by word."""

import re

import pytest
from pyspark.sql import functions as F

from trovelight.llm import licenses, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain(text):
    words = WORD.findall(lowered(text))
    places = []
    for phrase, label in licenses.PHRASES:
        own = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(own)] == own]
    return len(words), places


def labels(text):
    scanner = licenses.Scanner(licenses.PHRASES, licenses.TEMPLATES)
    return {label for _, _, label in scanner.scan(lowered(text).encode())[1]}


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Licensed under the Apache License, Version 2.0.", {"apache-2.0"}),
        ("Licensed under the Apache License, Version 2.0 (the 'License')", {"apache-2.0"}),
        ("Licensed under an Apache License, Version 2.0.", set()),
        ("Licensed under CC BY-NC 4.0.", {"cc-by-nc-4.0"}),
        ("licensed under a Creative Commons Attribution 4.0 International License", {"cc-by-4.0"}),
        ("licensed under the terms of the GNU General Public License, version 3", {"gpl-3.0"}),
        ("licensed under the GNU General Public License (GPL) v2 or, at your option, any later version", {"gpl-2.0"}),
        ("Released under the MIT License.", {"mit"}),
        ("SPDX-License-Identifier: MIT", {"spdx"}),
        ("ALL RIGHTS RESERVED", {"all-rights-reserved"}),
        ("all right reserved", set()),
        ("", set()),
    ],
)
def test_wording(text, expected):
    assert labels(text) == expected


def test_regions_of_a_template():
    automaton = licenses.compiled("x", "we grant [[to you [[all]]]] a {{2}} permit {{now|soon}}")
    ends = {
        "we grant a permit now": 5, "we grant to you a permit soon": 7, "we grant to you all a very broad permit now": 10,
        "we grant to a permit now": None, "we grant a very very broad permit now": None, "we grant a permit later": None,
        "we grant a permit permit now": 6,
    }
    for text, end in ends.items():
        assert automaton.longest(text.encode().split(), 0) == end, text
    assert automaton.anchor == b"permit"
    with pytest.raises(ValueError):
        licenses.compiled("x", "some [[ open")


def test_the_longest_reading_counts():
    scanner = licenses.Scanner((), (("a", "one two [[three four]]"),))
    assert scanner.scan(b"zero one two three four one two three")[1] == [(1, 5, "a"), (5, 7, "a")]


def test_odd_texts(spark):
    odd = ["", None, "cc by cc by", "CC-BY", "ccby", "xcc by", "cc byx", "écc by", "mit license" * 3000, "gnu general\npublic\tlicense", "!!!", "x"]
    docs = spark.createDataFrame(list(enumerate(odd)), "n_words long, text string")
    rows = licenses.scanned(docs, ["n_words"]).select(F.col("row.n_words").alias("id"), "n_words", "base", "found", "score").collect()
    assert len(rows) == len(odd)
    for row in rows:
        count, places = plain(odd[row.id])
        assert row.n_words == count
        assert sorted((s.start, s.label) for s in row.base) == sorted(places)
        assert 0 <= row.score <= 1
    assert licenses.scanned(docs.limit(0), ["n_words"]).count() == 0


def test_the_query_on_whole_tables(spark, documents):
    rows = {r.doc_id: r for r in queries.op8_license_scan(spark, "/root/testdata/sf0.001").collect()}
    for doc in documents.collect():
        count, places = plain(doc.text)
        row = rows[doc.doc_id]
        assert (row.n_words, row.n_base) == (count, len(places))
        assert row.first_word == min((i for i, _ in places), default=None)
        assert row.last_word == max((i for i, _ in places), default=None)
        assert row.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(row.base_labels.split(",")) - {""} <= set(row.labels.split(","))
