"""Streams: the same tables as batches, and batches that may run again."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trovelight.operators import enrich, passages
from trovelight.operators.keyword import keyword_search
from trovelight.operators.units import embed_hashed_words
from trovelight.settings import Settings
from trovelight.sources.files import read_files, read_files_stream
from trovelight.streaming.ingest import Ingest, Models, uploads_from_files
from trovelight.streaming.leases import watch_leases

DESCRIPTIONS = (
    "filename string, title string, description string, tags array<string>, visible_text string, "
    "image_type string"
)


def ingest(spark, root, embed=lambda units: embed_hashed_words(units, dims=16), embed_images=None):
    table = spark.createDataFrame([("a.txt", "First", "The first.", ["one"], "", None)], DESCRIPTIONS)

    def describe(work):
        return enrich.answered(*enrich.describe_lookup(work, table))

    models = Models(describe, embed, embed_images)
    return Ingest(str(root), models, Settings(blob_digits=1, max_attempts=2), shards=4)


def write(folder, **files):
    folder.mkdir(parents=True, exist_ok=True)
    for name, content in files.items():
        (folder / name.replace("_", ".", 1)).write_bytes(content)


def states(run, spark):
    return {r.filename: (r.status, r.attempts) for r in run.assets(spark).collect()}


def test_files_stream_as_they_are_read(spark, tmp_path):
    write(tmp_path / "in", a_txt=b"one", b_txt=b"two", c_txt=b"three")
    stream = read_files_stream(spark, str(tmp_path / "in"), files_per_batch=2)
    query = (
        stream.writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "progress"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    columns = ["filename", "size_bytes", F.col("content").cast("string").alias("content")]
    batch = read_files(spark, str(tmp_path / "in"))
    streamed = spark.read.schema(batch.schema).parquet(str(tmp_path / "out"))
    assert sorted(streamed.select(*columns).collect()) == sorted(batch.select(*columns).collect())


def test_files_become_units_and_later_files_join_them(spark, tmp_path):
    run = ingest(spark, tmp_path / "root")
    folder = tmp_path / "in" / "demo"
    text = " ".join(f"word{n} and so on." for n in range(400)).encode()
    write(folder, a_txt=text, b_txt=b"\x00", invalid_txt=b"a note")

    def take_in():
        stream = uploads_from_files(read_files_stream(spark, str(tmp_path / "in")))
        run.start(stream, str(tmp_path / "progress")).awaitTermination()

    take_in()
    assert states(run, spark) == {"a.txt": ("ready", 1), "invalid.txt": ("failed", 2)}
    assert [(r.filename, r.collection) for r in run.rejects(spark).collect()] == [("b.txt", "demo")]
    index = run.index(spark)
    units = index.units.collect()
    content = sorted((r.start_char, r.end_char) for r in units if r.kind == "content")
    assert content == list(passages.windows(text.decode(), 1600, 240))
    assert {r.kind for r in units} == {"metadata", "filename", "content"}
    assert [len(r.embedding) for r in index.vectors.collect()] == [16] * len(units)
    found = search(spark, index, "word399")
    assert [(r.kind, r.unit_id) for r in found] == [(r.kind, r.unit_id) for r in units if "word399" in r.body]

    # The same bytes under another name, and the same in another collection.
    write(folder, copy_txt=text, d_txt=b"a new one")
    write(tmp_path / "in" / "other", a_txt=text)
    take_in()
    rows = run.assets(spark).collect()
    assert sorted((r.collection, r.filename, r.status) for r in rows) == [
        ("demo", "a.txt", "ready"),
        ("demo", "d.txt", "ready"),
        ("demo", "invalid.txt", "failed"),
        ("other", "a.txt", "ready"),
    ]
    assert [r.alias for r in run.aliases(spark).collect()] == ["copy.txt"]
    assert [r.error for r in rows if r.status == "failed"] == [
        "The AI model's answer did not match the expected format."
    ]


UPLOADS = "collection string, filename string, arrival long, content binary"


def search(spark, index, query):
    asked = spark.createDataFrame([(1, "demo", query)], "query_id int, collection string, q string")
    return keyword_search(asked, index.postings, index.units).orderBy("rank").collect()


def uploads(spark, *rows):
    return spark.createDataFrame([(c, f, n, bytearray(b)) for n, (c, f, b) in enumerate(rows, 1)], UPLOADS)


def test_a_batch_may_run_again(spark, tmp_path):
    run = ingest(spark, tmp_path / "root")
    first = uploads(spark, ("demo", "a.txt", b"one"))
    second = uploads(spark, ("demo", "b.txt", b"one"), ("demo", "c.txt", b"two"), ("demo", "a.txt", b"one"))

    def everything():
        index = run.index(spark)
        return (
            sorted((r.asset_id, r.filename, r.status, r.attempts) for r in run.assets(spark).collect()),
            sorted(r.alias for r in run.aliases(spark).collect()),
            sorted((r.unit_id, r.body) for r in index.units.collect()),
            sorted((r.unit_id, r.term, r.tf) for r in index.postings.collect()),
            sorted(r.unit_id for r in index.vectors.collect()),
        )

    run.run_batch(first, 0)
    run.run_batch(second, 1)
    before = everything()
    run.run_batch(second, 1)
    assert everything() == before
    assert [(asset, name) for asset, name, _, _ in before[0]] == [(1, "a.txt"), (3, "c.txt")]
    assert before[1] == ["b.txt"]
    units = [unit for unit, _ in before[2]]
    assert len(units) == len(set(units)) == 6
    assert before[4] == units


def test_a_batch_that_did_not_end_is_not_seen(spark, tmp_path):
    run = ingest(spark, tmp_path / "root")
    run.run_batch(uploads(spark, ("demo", "a.txt", b"one")), 0)

    def lost(units):
        raise ConnectionError("the driver is gone")

    broken = ingest(spark, tmp_path / "root", lost)
    with pytest.raises(ConnectionError):
        broken.run_batch(uploads(spark, ("demo", "b.txt", b"two")), 1)
    assert states(run, spark) == {"a.txt": ("ready", 1)}
    assert run.index(spark).units.count() == 3
    run.run_batch(uploads(spark, ("demo", "b.txt", b"two")), 1)
    assert states(run, spark) == {"a.txt": ("ready", 1), "b.txt": ("ready", 1)}


def test_a_failed_attempt_leaves_nothing_behind(spark, tmp_path):
    asked = []

    def embed(units):
        # The first time one unit gets no vector.
        asked.append(units.count())
        made = embed_hashed_words(units, dims=16)
        if len(asked) > 1:
            return made
        return made.where("body <> 'keep this one'")

    run = ingest(spark, tmp_path / "root", embed)
    run.run_batch(uploads(spark, ("demo", "a.txt", b"keep this one"), ("demo", "b.txt", b"and this")), 0)
    assert states(run, spark) == {"a.txt": ("ready", 2), "b.txt": ("ready", 1)}
    assert asked == [6, 3]
    index = run.index(spark)
    units = [r.unit_id for r in index.units.collect()]
    assert len(units) == len(set(units)) == 6
    assert sorted(r.unit_id for r in index.vectors.collect()) == sorted(units)
    assert [r.kind for r in search(spark, index, "keep")] == ["content"]


def test_images_need_a_model_for_them(spark, tmp_path):
    rows = uploads(spark, ("demo", "p.jpg", b"\xff\xd8\xff\xe0 picture"))
    run = ingest(spark, tmp_path / "without")
    run.run_batch(rows, 0)
    [row] = run.assets(spark).collect()
    assert (row.status, row.attempts, row.error) == ("failed", 2, "ValueError: a unit has no vector")
    assert run.index(spark).units.count() == run.index(spark).postings.count() == 0

    def embed_images(images):
        return images.withColumns(
            {
                "embedding": F.array(F.octet_length("content").cast("float")),
                "embedding_model": F.lit("sizes"),
            }
        )

    run = ingest(spark, tmp_path / "with", embed_images=embed_images)
    run.run_batch(rows, 0)
    index = run.index(spark)
    vectors = {r.kind: (r.embedding_model, len(r.embedding)) for r in index.vectors.collect()}
    assert vectors["image"] == ("sizes", 1)
    assert set(vectors) == {r.kind for r in index.units.collect()} == {"metadata", "filename", "image"}


def test_nothing_new_and_nothing_at_all(spark, tmp_path):
    run = ingest(spark, tmp_path / "root")
    run.run_batch(spark.createDataFrame([], UPLOADS), 0)
    assert run.assets(spark).count() == run.index(spark).units.count() == 0
    run.run_batch(uploads(spark, ("demo", "a.txt", b"one")), 1)
    run.run_batch(uploads(spark, ("demo", "z.txt", b"one")), 2)
    assert states(run, spark) == {"a.txt": ("ready", 1)}
    assert [r.alias for r in run.aliases(spark).collect()] == ["z.txt"]


def test_models_by_name(spark, tmp_path):
    enrich.register_model("describe", "none", lambda settings: lambda work: work)
    enrich.register_model("embed", "hashed", lambda settings: lambda units: embed_hashed_words(units, dims=settings.page_size))
    models = Models.registered(Settings(page_size=8), "none", "hashed")
    made = models.embed(spark.createDataFrame([(1, "a b")], "unit_id int, body string")).first()
    assert len(made.embedding) == 8 and models.embed_images is None


CHANGES = "asset_id long, status string, started_at timestamp, attempts int"


def test_leases_run_out_on_a_stream(spark, tmp_path):
    source = tmp_path / "changes"
    now = datetime.now()
    rows = [
        (1, "processing", now, 1),
        (2, "processing", now, 3),
        (3, "processing", now, 1),
        (3, "ready", None, 1),
        (4, "processing", now + timedelta(hours=1), 1),
    ]
    spark.createDataFrame(rows, CHANGES).coalesce(1).write.parquet(str(source))
    changes = spark.readStream.schema(CHANGES).parquet(str(source))
    query = (
        watch_leases(changes, lease_minutes=2 / 60)
        .writeStream.format("memory")
        .queryName("ended")
        .option("checkpointLocation", str(tmp_path / "progress"))
        .trigger(processingTime="1 second")
        .start()
    )
    try:
        deadline = time.time() + 90
        while spark.table("ended").count() < 2 and time.time() < deadline:
            time.sleep(1)
    finally:
        query.stop()
    ended = {r.asset_id: (r.status, r.error) for r in spark.table("ended").collect()}
    assert ended == {
        1: ("pending", None),
        2: ("failed", "Processing did not finish within the lease 3 times."),
    }
