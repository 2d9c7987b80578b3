"""Base spans against Python's patterns, candidates, the trained model and redaction."""

import re

import pytest
from pyspark.sql import functions as F

from trovelight.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ODD = [
    "", None, "a@b.c.@d.e", "a@b.c%d@e.f x.@y.z", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255", "4111 1111 1111 1111 4111-1111-1111-1111",
    "4111111111111111", "+1 (637) 555-5817 x +49 30 123456", "é😀 a@b.co 😀 1.2.3.4", "1 " * 6000, "a." * 8000 + "@b" + ".c" * 9000,
    "1" * 20000, "foo@bar@b.c", "a@b..c", "password=e3b3ed3cc8548923d6 x", "+1+2 3 4 5 6 7 8 9", "x@y.z\n1.2.3.4 -- 4111 1111  1111 1111",
    "a@b.c " * 700, "@" * 50_000, "no data at all", "4111 1111 1111 1112", "+12 345", "1.2.3.4" * 3,
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        value = int(c) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def plain(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda m=m: all(int(part) <= 255 for part in m[0].split(".")),
                "card": lambda digits=digits: 16 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda digits=digits: 8 <= len(digits) <= 15,
            }[kind]()
            if good:
                found.append((kind, m.start(), m.end()))
    return found


@pytest.fixture(scope="module")
def model(spark):
    return pii.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text"), sample_docs=4000)


def spans(column):
    return [(s.kind, s.start, s.end) for s in column]


def test_base_spans_of_odd_texts(spark, model):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    rows = pii.found_spans(docs, model).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert spans(r.base) == plain(ODD[r.doc_id]), ODD[r.doc_id]
        ends = sorted((s, e) for _, s, e in spans(r.added))
        assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False))
        for _, start, end in spans(r.added):
            assert not any(s < end and start < e for _, s, e in spans(r.base))


def test_base_spans_of_whole_documents(spark, documents, model):
    for r in pii.found_spans(documents.select("doc_id", "text"), model).collect():
        assert spans(r.base) == plain(r.text)


def test_the_model_finds_named_secrets_and_leaves_numbers(spark, model):
    texts = {
        1: 'the token = "3f2a9c0d17be55aa0921" here', 2: "password=9d04ab1c77e2f00131 x", 3: "version 2.0 of 2024-11-05, 1 2 3 4 5 6 7 8 9",
        4: "order 4111 1111 1111 1112 and 300.400.500.600", 5: "plain words only",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.added] for r in pii.found_spans(docs, model).collect()}
    assert rows == {1: ["3f2a9c0d17be55aa0921"], 2: ["9d04ab1c77e2f00131"], 3: [], 4: [], 5: []}


def test_clean_documents_are_left_alone(spark, documents, model):
    found = pii.found_spans(documents.select("doc_id", "text"), model)
    wrong = [r.text[s.start - 20 : s.end] for r in found.collect() for s in r.added if s.kind != "secret" or not re.search(r"(token|password)\W{1,4}$", r.text[: s.start])]
    assert wrong == []


def test_redaction(spark):
    text = "mail a@b.co or +1 (637) 555-5817, é 1.2.3.4" + " filler" * 2000 + " x@y.zz"
    docs = spark.createDataFrame([(1, text, "k"), (2, None, "k"), (3, "nothing", "k"), (4, "", "k")], "base long, text string, added string")
    rows = {r.base: r for r in pii.redacted(docs).collect()}
    assert rows[1].text == "mail [EMAIL] or [PHONE], é [IP]" + " filler" * 2000 + " [EMAIL]"
    assert [rows[i].text for i in (2, 3, 4)] == [None, "nothing", ""]
    assert pii.redacted(docs).columns == docs.columns


def test_overlapping_spans_become_one(spark):
    kind = "array<struct<kind:string,start:bigint,end:bigint>>"
    df = spark.createDataFrame([("0123456789", [("b", 2, 5), ("a", 4, 7)], [("c", 7, 8)])], f"text string, base {kind}, added {kind}")
    assert df.select(pii.redacted_text(F.col("text"), F.col("base"), F.col("added"), block=3)).first()[0] == "01[B][C]89"


def test_without_candidates_there_is_no_model(spark):
    docs = spark.createDataFrame([(1, "nothing"), (2, None)], "doc_id long, text string")
    assert pii.train(docs) == pii.Model((), (), {})
    assert pii.redacted(docs.limit(0)).count() == 0
    row = pii.found_spans(spark.createDataFrame([(1, "a@b.c")], "doc_id long, text string"), pii.Model((), (), {})).first()
    assert (spans(row.base), row.added) == ([("email", 0, 5)], [])


def test_kinds_are_found_however_many_documents_lack_them(spark):
    few = [f"{'password' if n % 2 else 'commit'} = {n:06x}9d04ab1c77e2f" for n in range(40)] + [f"mail a{n}@b{n}.org or a{n}@b{n}" for n in range(40)]
    docs = spark.createDataFrame([(t,) for t in few], "text string")
    many = docs.unionByName(spark.range(3000).select(F.concat(F.lit("plain words "), F.col("id").cast("string")).alias("text")))
    many = many.unionByName(spark.range(2000).select(F.concat(F.lit("version 1.2."), F.col("id").cast("string"), F.lit(" of it")).alias("text")))
    small, large = pii.train(docs), pii.train(many, sample_docs=200)
    assert {"email", "secret"} <= set(small.least)
    assert {"email", "secret"} <= set(large.least)


def test_thresholds_cover_documents_outside_the_sample(spark, monkeypatch):
    docs = spark.createDataFrame([(f"password = {n:06x}9d04ab1c77e2f, a{n}@b.org, 10.0.0.{n % 250}",) for n in range(300)], "text string")
    monkeypatch.setattr(pii, "_drawn", lambda found, sample_docs: found.where(~F.exists("own", pii._held)))
    assert {"email", "secret"} <= set(pii.train(docs).least)


def test_trees_score_as_spark_does():
    trees, weights = pii._trees(
        "Model\n  Tree 0 (weight 1.0):\n    If (feature 3 <= 0.5)\n     Predict: -1.0\n    Else (feature 3 > 0.5)\n     If (feature 1 <= 2.5)\n      Predict: 0.5\n     Else (feature 1 > 2.5)\n      Predict: 1.0\n  Tree 1 (weight 0.1):\n    Predict: 0.25\n"
    )
    assert trees == ((3, 0.5, -1.0, (1, 2.5, 0.5, 1.0)), 0.25)
    assert weights == (1.0, 0.1)


def test_nothing_but_expressions(spark, documents, model):
    plan = pii.found_spans(documents, model)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Exchange", plan)
