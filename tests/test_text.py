"""Texts: sentences, words, stems, marked matches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trovelight.functions import text as tx
from trovelight.functions.stem import Stemmer, stem, stem_words
from trovelight.operators import explain, keyword, passages


def split(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(tx.sentences(F.col("t")).alias("s")).first()
    return [(s.start, s.end, s.text) for s in row.s]


@pytest.mark.parametrize("mark", [".", "!", "?"])
def test_sentences_joined_at_random_come_apart_again(spark, mark):
    random = np.random.default_rng(ord(mark))
    made = [" ".join(["Kelp", *random.choice(["reef", "cove", "mast"], int(random.integers(2, 7)))]) + mark for _ in range(300)]
    text = " ".join(made)
    found = split(spark, text)
    assert [s for _, _, s in found] == made
    assert all(text[start:end] == s for start, end, s in found)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Prof. Lund measured it. Nobody else did.", ["Prof. Lund measured it.", "Nobody else did."]),
        ("Written by K. Moss. Read it.", ["Written by K. Moss.", "Read it."]),
        ("Bring:\n- rope\n- a lamp\nThen go.", ["Bring:", "- rope", "- a lamp", "Then go."]),
        ("3. Close the hatch. Wait.", ["3. Close the hatch.", "Wait."]),
        ("Low tide\n\nHigh tide", ["Low tide", "High tide"]),
        ("Only the one", ["Only the one"]),
        ("", []),
        ("\t \n", []),
        ("*** -- ~~", []),
    ],
)
def test_where_sentences_end(spark, text, expected):
    found = split(spark, text)
    assert [s for _, _, s in found] == expected
    assert all(text[start:end] == s for start, end, s in found)


def test_offsets_count_characters(spark):
    text = " ".join(f"Nö {n} 🌊 ist Flut." for n in range(700))
    found = split(spark, text)
    assert len(found) == 700
    assert all(text[start:end] == s for start, end, s in found)


@pytest.mark.parametrize("seed", range(6))
def test_windows_follow_their_rule(seed):
    random = np.random.default_rng(seed)
    text = "".join(random.choice(list("abc  \n"), int(random.integers(0, 400))))
    size, overlap = int(random.integers(5, 40)), int(random.integers(0, 5))
    places, covered = list(passages.windows(text, size, overlap)), set()
    for start, end in places:
        assert 0 < end - start <= size
        assert text[start:end] == text[start:end].strip()
        covered.update(range(start, end))
    assert [start for start, _ in places] == sorted(start for start, _ in places)
    # Nothing but white space is left out, and neighbours share no more than the overlap.
    assert all(text[i].isspace() for i in range(len(text)) if i not in covered)
    assert all(a[1] - b[0] <= overlap for a, b in zip(places, places[1:], strict=False))


def test_published_stems(spark):
    pairs = {
        "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre",
        "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat",
        "sized": "size", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi",
        "sky": "sky", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam",
        "predication": "predic", "operator": "oper", "hopefulness": "hope", "triplicate": "triplic",
        "formative": "form", "electrical": "electr", "revival": "reviv", "adjustable": "adjust",
        "replacement": "replac", "adoption": "adopt", "probate": "probat", "rate": "rate",
        "cease": "ceas", "controlling": "control", "roll": "roll", "lyaned": "lyan", "typing": "type",
    }
    assert {word: stem(word) for word in pairs} == pairs
    df = spark.createDataFrame([(word,) for word in pairs], "w string")
    assert {r.w: r.s for r in df.select("w", stem_words("w").alias("s")).collect()} == pairs


def test_words_that_are_not_plain_english_stay():
    assert [stem(w) for w in ("is", "où", "b2s", "größen")] == ["is", "où", "b2s", "größen"]
    stems = Stemmer()
    assert (stems["masts"], stems["masts"], len(stems)) == ("mast", "mast", 1)


def test_what_counts_as_search_syntax(spark):
    plain = ["kelp", "kelp reef", "orbit", "for reef", "kelp-reef", "reef- kelp"]
    syntax = ['"kelp"', 'kelp "', "kelp OR reef", "or", "reef -kelp", "-kelp"]
    df = spark.createDataFrame([(q,) for q in plain + syntax], "q string")
    found = {r.q: r.s for r in df.select("q", keyword.uses_search_syntax(F.col("q")).alias("s")).collect()}
    assert found == {**dict.fromkeys(plain, False), **dict.fromkeys(syntax, True)}


def test_queries_are_trimmed_and_keep_their_case(spark):
    df = spark.createDataFrame([("\t Kelp  \n REEF\t\tcove ",)], "q string")
    assert df.select(keyword.normalise_query(F.col("q"))).first()[0] == "Kelp REEF cove"


def explained(spark, text, query, length=20):
    df = spark.createDataFrame([(text, query)], "t string, q string")
    t, q = F.col("t"), F.col("q")
    row = df.select(
        explain.count_matches(t, q).alias("n"),
        explain.excerpt_around(t, q, length).alias("excerpt"),
        explain.highlight_spans(t, q).alias("pieces"),
    ).first()
    return row.n, row.excerpt, row.pieces


def test_matches_start_words_in_any_case(spark):
    n, excerpt, pieces = explained(spark, "Reefs at dawn; a REEF, unreef.", "reef dawn")
    assert n == 3
    assert excerpt == "Reefs at dawn; a REE…"
    assert pieces == ["", "Reef", "s at ", "dawn", "; a ", "REEF", ", unreef."]


def test_signs_in_queries_are_plain(spark):
    assert explained(spark, "depth [m] is 3.5 now", "3.5 [m]")[0] == 1
    assert explained(spark, "water", "? + |")[0] == 0


def test_excerpts_are_cut_on_both_sides(spark):
    text = "a" * 70 + " gull " + "b" * 70
    found = explained(spark, text, "gull", 50)[1]
    assert found[0] == found[-1] == "…"
    assert len(found) == 52
    assert found[1:-1] in text and "gull" in found


def test_without_a_match_the_text_stays_whole(spark):
    for query in ("fern", "x y"):
        assert explained(spark, "kelp and reef", query) == (0, None, ["kelp and reef"])
