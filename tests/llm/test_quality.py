"""Quality measures and verdicts against plain counting; the cascade's order."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trovelight.llm import quality

CLEAN = " ".join(f"word{i}" for i in range(80))
TEXTS = [
    "", None, "one", CLEAN, CLEAN + "\n" + CLEAN, "a b c " * 30, "a b c a b c", "a a a a", "x y\nx y\nx y\n\n \n", "#*$%&|<> # word",
    "é ñ 北京 \u00a0 ß", CLEAN.upper(), CLEAN.replace(" ", "!! "), CLEAN.replace(" ", " | "), "\n".join(["line of text"] * 60),
    " ".join(f"w{i % 997}" for i in range(30_000)), " ".join(f"u{i}" for i in range(200_000)), "p q r s " * 5000, "a b c x a b c",
]


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    repeated = len(lines) - len(set(lines))
    letters, capitals = sum(c.isalpha() for c in text), sum(c.isupper() for c in text)
    kept = not (
        len(words) < 50
        or 10 * len(covered) > 5 * len(words)
        or 10 * symbols > len(words)
        or 10 * text.count("!") > 3 * len(words)
        or 10 * capitals > 3 * letters
        or 10 * repeated > 4 * len(lines)
    )
    return len(words), sum(map(len, words)), symbols, repeated, len(covered), kept


def test_measures_and_verdicts(spark):
    docs = spark.createDataFrame([(i, t, "q") for i, t in enumerate(TEXTS)], "n_words long, text string, quality string")
    rows = quality.rated(docs).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        q = r.quality
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.rejected_by is None) == plain(TEXTS[r.n_words])
    kept = quality.passing(docs)
    assert kept.columns == docs.columns
    assert sorted(r.n_words for r in kept.collect()) == [i for i, t in enumerate(TEXTS) if plain(t)[-1]]


@pytest.mark.parametrize("rule", quality.RULES, ids=lambda rule: rule.name)
def test_each_rule_names_itself(spark, rule):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    names = {r.found for r in docs.select(quality.verdict(F.col("text"), [rule]).alias("found")).collect()}
    assert names == {None, rule.name}


def test_order_is_by_rejections_per_cost(spark, documents):
    never = quality.Rule("never", lambda f: F.length(f.text) < 0)
    cheap = quality.Rule("cheap", lambda f: F.length(f.text) >= 0)
    dear = quality.Rule("dear", lambda f: quality.repeated_words(f.words) >= 0, lambda f: F.length(f.text) * 9)
    order = [rule.name for rule in quality.ordered(documents, "text", (never, dear, cheap))]
    assert order[0] == "cheap"


def test_the_order_changes_no_verdict(spark, documents):
    either = [quality.verdict(F.col("text"), list(order)).isNull().alias(name) for name, order in (("a", quality.RULES), ("b", quality.RULES[::-1]))]
    assert documents.select(*either).where("a != b").count() == 0


def test_the_order_depends_on_rows_alone(spark, documents):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    first = [rule.name for rule in quality.ordered(docs, "text", quality.RULES, 300)]
    for parts in (1, 3, 7):
        assert [rule.name for rule in quality.ordered(docs.repartition(parts), "text", quality.RULES, 300)] == first
    found = [r.quality.rejected_by for r in quality.rated(documents, order=list(quality.RULES)).orderBy("doc_id").collect()]
    again = [r.quality.rejected_by for r in quality.rated(documents.repartition(5), order=list(quality.RULES)).orderBy("doc_id").collect()]
    assert found == again and len(set(found)) > 2


def test_nothing_but_expressions(spark, documents):
    plan = quality.rated(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan
    assert "Arrow" not in plan
    assert "Exchange" not in plan


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert quality.rated(docs).count() == 0
    assert quality.passing(docs).columns == docs.columns
