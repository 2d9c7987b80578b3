"""Models: look-ups, answers, caches and batches."""

import json

import pytest
from pyspark.sql import functions as F

from trovelight.operators import enrich

GOOD = {"title": "t", "description": "d", "tags": ["a"], "visible_text": "", "image_type": None}


def changed(**fields):
    return json.dumps({**GOOD, **fields})


@pytest.mark.parametrize(
    ("body", "valid"),
    [
        (changed(), True),
        (changed(image_type="photo", extra=[1]), True),
        (changed(tags=[]), True),
        (changed(image_type="painting"), False),
        (changed(title=5), False),
        (changed(tags=["a", 1]), False),
        (changed(tags=[None]), False),
        (changed(tags="a"), False),
        (changed(visible_text=None), False),
        (json.dumps({k: v for k, v in GOOD.items() if k != "image_type"}), False),
        (json.dumps({k: v for k, v in GOOD.items() if k != "visible_text"}), False),
        ('{"title": "Half', False),
        ("[]", False),
        (None, False),
    ],
)
def test_answers_are_checked(spark, body, valid):
    df = spark.createDataFrame([(body,)], "body string")
    row = enrich.validate_answers(df).first()
    assert row.valid is valid
    assert (row.metadata is not None) is valid


BROKEN = '{"title": '


@pytest.mark.parametrize(
    ("answers", "expected"),
    [
        ([(1, 1, 200, changed())], ("described", 1, 1)),
        ([(1, 1, 429, None), (2, 1, 200, changed())], ("described", 2, 1)),
        ([(1, 1, 503, None), (2, 1, 429, None)], ("overloaded", 2, 1)),
        ([(1, 1, 200, BROKEN), (1, 2, 200, changed())], ("described", 1, 2)),
        ([(1, 1, 200, BROKEN), (1, 2, 200, BROKEN), (2, 1, 200, changed())], ("invalid", 1, 2)),
        ([(1, 1, 200, BROKEN), (1, 2, 503, None), (2, 1, 200, changed())], ("described", 2, 1)),
        ([(1, 1, 500, None), (2, 1, 200, changed())], ("error", 1, 1)),
        # A second answer nobody asked for does not count.
        ([(1, 1, 429, None), (1, 2, 200, changed()), (2, 1, 500, None)], ("error", 2, 1)),
    ],
)
def test_answers_are_chosen(spark, answers, expected):
    rows = spark.createDataFrame(
        [(7, *a) for a in answers], "asset_id int, model_rank int, try int, http_code int, body string"
    )
    [row] = enrich.select_answer(rows).collect()
    assert (row.outcome, row.model_rank, row["try"]) == expected
    assert (row.metadata is not None) is (expected[0] == "described")


def test_descriptions_by_name(spark):
    assets = spark.createDataFrame(
        [(1, "known.jpg", "image"), (2, "new.jpg", "image"), (3, "new.txt", "text"), (4, "an_invalid.txt", "text")],
        "asset_id int, filename string, asset_type string",
    )
    table = spark.createDataFrame(
        [("known.jpg", "A key", "On a hook.", ["key"], "", "photo")],
        "filename string, title string, description string, tags array<string>, visible_text string, image_type string",
    )
    for bound in (10, 0):
        described, failures = enrich.describe_lookup(assets, table, bound)
        rows = {r.asset_id: (r.title, r.description, r.image_type) for r in described.collect()}
        assert rows == {
            1: ("A key", "On a hook.", "photo"),
            2: ("new.jpg", "An uploaded image.", "other"),
            3: ("new.txt", "An uploaded text file.", None),
        }
        assert [(r.asset_id, r.error_class) for r in failures.collect()] == [(4, "ValidationError")]


def test_requests_are_told_apart_by_every_field(spark):
    def key(**changes):
        fields = {"model": "m", "dims": 8, "kind": "text", "content": "h", **changes}
        columns = {name: F.lit(value) for name, value in fields.items()}
        return spark.range(1).select(enrich.request_key(**columns)).first()[0]

    assert key() == key()
    others = [key(model="n"), key(dims=9), key(kind="image"), key(content="i"), key(model=None)]
    assert len({key(), *others}) == 6


def test_only_unknown_requests_reach_the_model(spark):
    asked = []

    def model(rows):
        asked.append(sorted(r.request for r in rows.collect()))
        return rows.where("request <> 'fails'").select("request", F.upper("text").alias("answer"))

    inputs = spark.createDataFrame(
        [(1, "a", "x"), (2, "b", "y"), (3, "b", "y"), (4, "fails", "z")],
        "id int, request string, text string",
    )
    cache = spark.createDataFrame([("a", "OLD")], "request string, answer string")
    answered, new = enrich.infer_incremental(inputs, cache, model, ["answer"], rows_per_part=1)
    assert asked == [["b", "fails"]]
    assert {r.id: r.answer for r in answered.collect()} == {1: "OLD", 2: "Y", 3: "Y", 4: None}
    assert [tuple(r) for r in new.collect()] == [("b", "Y")]


def test_vectors_are_checked(spark):
    inputs = spark.createDataFrame([(n,) for n in range(5)], "id int")
    vectors = spark.createDataFrame(
        [(0, [1.0, 2.0]), (1, [1.0]), (2, None), (3, [1.0, 2.0]), (3, [1.0, 2.0])],
        "id int, embedding array<float>",
    )
    found = enrich.check_vectors(inputs, vectors, "id", 2).collect()
    assert {r.id: r.problem for r in found} == {
        1: "length 1",
        2: "missing",
        3: "more than one",
        4: "missing",
    }


def test_batches_keep_their_order_and_a_failure_takes_its_owner(spark):
    rows = spark.createDataFrame(
        [(n, n // 10, f"{n}") for n in range(95)], "id int, owner int, t string"
    )

    def embed(texts):
        assert len(texts) <= 4
        if "37" in texts:
            raise ConnectionError("down")
        return [[float(text), 1.0] for text in texts]

    found = enrich.embed_batches(rows, "id", "owner", "t", embed, batch=4).collect()
    assert len(found) == 95
    bad = {r.owner for r in found if r.error}
    assert 3 in bad and len(bad) < 10
    for row in found:
        if row.owner in bad:
            assert row.embedding is None and row.error == "ConnectionError: down"
        else:
            assert row.embedding == [float(row.id), 1.0]


def test_a_wrong_number_of_vectors_is_an_error(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (2, 2, "b")], "id int, owner int, t string").coalesce(1)
    found = enrich.embed_batches(rows, "id", "owner", "t", lambda texts: []).collect()
    assert {r.error for r in found} == {"ValueError: 0 vectors for 2 inputs"}


def test_models_by_name():
    enrich.register_model("embed", "sizes", lambda settings: lambda rows: rows)
    assert enrich.get_model("embed", "sizes")(5) == 5
    with pytest.raises(ValueError, match="known: .*sizes"):
        enrich.get_model("embed", "none")
    with pytest.raises(ValueError, match="unknown role"):
        enrich.register_model("translate", "x", lambda settings: None)


def test_prepared_inputs(spark):
    rows = spark.createDataFrame(
        [(1, "c", bytearray(b"\xef\xbb\xbfone two"))], "asset_id int, collection string, content binary"
    )
    summaries, chunks = enrich.prepare_inputs(rows)
    assert summaries.first().summary == "one two"
    assert [(r.start_char, r.end_char, r.text) for r in chunks.collect()] == [(0, 7, "one two")]


def test_every_text_is_sent_once(spark):
    sent = spark.sparkContext.accumulator(0)

    def embed(texts):
        sent.add(len(texts))
        return [[1.0] for _ in texts]

    rows = spark.createDataFrame([(n, n // 4, f"text {n}") for n in range(50)], "id int, owner int, t string").repartition(5)
    found = enrich.embed_batches(rows, "id", "owner", "t", embed)
    assert found.count() == 50
    assert found.where("error is null").count() == 50
    assert sent.value == 50


def test_every_request_is_asked_once(spark):
    asked = spark.sparkContext.accumulator(0)

    def model(rows):
        def answer(batches):
            for batch in batches:
                asked.add(len(batch))
                yield batch.assign(answer=batch["t"].str.upper())[["request", "answer"]]

        return rows.select("request", "t").mapInPandas(answer, "request string, answer string")

    inputs = spark.createDataFrame([(n, f"t{n % 7}") for n in range(40)], "id int, t string")
    inputs = inputs.withColumn("request", enrich.request_key(text=F.col("t")))
    cache = spark.createDataFrame([], "request string, answer string")
    answered, new = enrich.infer_incremental(inputs, cache, model, ["answer"])
    assert answered.where("answer = upper(t)").count() == 40
    assert new.count() == 7
    assert asked.value == 7
