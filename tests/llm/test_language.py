"""Languages: held-out accuracy, mixtures, and texts with nothing to go by."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trovelight.llm import language, queries


@pytest.fixture(scope="module")
def model(spark, documents):
    return language.learned(documents.where(~language.held_out(F.col("doc_id"))))


def test_trigrams_see_letters_only():
    assert list(language.trigrams(b"A1b")) == list(language.trigrams(b" a, b "))
    assert len(language.trigrams(b"12 34")) == 0
    assert len(language.trigrams(b"abc")) == 3


def test_proportions_maximise_the_likelihood():
    random = np.random.default_rng(1)
    likely = random.random((3, 200)) + 0.01
    counts = random.integers(1, 5, 200).astype(float)
    shares, value = language._fitted(likely, counts, counts.sum())
    assert shares.sum() == pytest.approx(1)
    for _ in range(200):
        other = random.dirichlet(np.ones(3))
        assert counts @ np.log(other @ likely) <= value + 0.05


def test_held_out_documents(spark):
    rows = queries.op7_language_id(spark, "/root/testdata/sf0.01").collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_a_text_in_two_languages(model, documents):
    texts = {name: " ".join(r.text for r in documents.where((F.col("lang") == name) & (F.length("text") > 500)).limit(6).collect()) for name in ("en", "de")}
    main, share, shares = model.mixture((texts["en"][:3000] + texts["de"][:1500]).encode())
    assert main == "en"
    assert set(shares) == {"en", "de"}
    assert share == pytest.approx(2 / 3, abs=0.12)
    assert set(model.mixture(texts["de"][:3000].encode())[2]) == {"de"}


def test_nothing_to_go_by(spark, model):
    odd = [None, "", "123 !?", "\n\t", "a", "Ω", "x" * 200_000]
    docs = spark.createDataFrame(list(enumerate(odd)), "score long, text string")
    rows = language.predicted(docs, model, ["score"]).select(F.col("row.score").alias("id"), "lang_pred", F.col("score").alias("share")).orderBy("id").collect()
    assert [r.lang_pred == "und" for r in rows] == [True, True, True, True, False, False, False]
    assert [r.share for r in rows[:4]] == [0.0] * 4
    nothing = language.learned(spark.createDataFrame([], "text string, lang string"))
    assert nothing.languages == ()
    assert {r.lang_pred for r in language.predicted(docs, nothing, ["score"]).collect()} == {"und"}
    assert language.predicted(docs.limit(0), model, ["score"]).count() == 0


def test_rows_without_text_or_language_teach_nothing(spark):
    some = spark.createDataFrame([("abc", None), (None, "en"), ("abc", "en"), ("xyz", "fr")], "text string, lang string")
    found = language.learned(some)
    assert found.languages == ("en", "fr")
    assert found.mixture(b"abc")[0] == "en"
    assert found.mixture(b"xyz")[0] == "fr"
