"""The index: tables written when they are read, and postings that travel by term."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from checks.views import Views, forget_index
from tests.conftest import DATA
from trovelight.functions.vectors import counted_vectors
from trovelight.operators import catalog, units
from trovelight.operators.keyword import term_shard
from trovelight.plans import index as index_module

ASSETS = "asset_id long, collection string, filename string, asset_type string, title string, description string, tags array<string>, visible_text string, image_type string"
CHUNKS = "asset_id long, collection string, unit_index int, start_char int, end_char int, text string"


@pytest.fixture
def growing(spark, tmp_path):
    assets = [(n, "shore" if n % 3 else None, f"file {n}.txt", "text", f"reef {n}", "kelp and reef", ["kelp"], None, None) for n in range(-3, 30)]
    chunks = [(n, "shore" if n % 3 else None, i, 0, 9, f"kelp reef tide {n % 4} kelp {i}") for n in range(-3, 30) for i in range(3)]
    return index_module.GrowingIndex(
        spark,
        lambda: spark.createDataFrame(assets, ASSETS),
        lambda: spark.createDataFrame(chunks, CHUNKS).repartition(3),
        str(tmp_path),
        lambda rows: units.embed_hashed_words(rows, dims=8),
        stem=False,
        shards=2,
    )


def test_only_the_tables_that_are_read_are_written(spark, growing, tmp_path):
    assert not os.listdir(tmp_path)
    assert growing.assets.count() == 33 and os.listdir(tmp_path) == ["assets"]
    assert growing.vectors.count() == growing.units.where("body IS NOT NULL").count()
    assert sorted(os.listdir(tmp_path)) == ["assets", "units", "vectors"]
    whole = growing.whole()
    assert sorted(os.listdir(tmp_path)) == sorted(index_module.TABLES)
    # Nothing searches units without a collection.
    assert whole.blocks.agg(F.sum("n")).first()[0] == whole.postings.where("collection IS NOT NULL").count()


def test_a_list_of_collections_writes_no_units(spark):
    forget_index()
    index = Views(spark, DATA).index()
    assert catalog.list_collections(index.assets).count()
    assert os.listdir(index._folder.removeprefix("file:")) == ["assets"]
    # Another view of the same tables reads what there is.
    assert Views(spark, DATA).index()._folder == index._folder


def test_postings_that_travel_by_term_are_the_same(spark, growing):
    shard = index_module.shard_column(2)
    expected = units.build_postings(growing.units, False).withColumn(shard, term_shard(F.col("term"), 2))
    names = expected.columns
    assert sorted(map(repr, growing.postings.select(*names).collect())) == sorted(map(repr, expected.collect()))
    # A term of a batch of units is one row, and every file is in order of its terms.
    by_term = units.build_postings_by_term(growing.units.coalesce(1), False)
    assert by_term.where("term = 'kelp'").count() < expected.where("term = 'kelp'").count()
    files = growing.postings.withColumn("_file", F.input_file_name()).withColumn("_place", F.monotonically_increasing_id()).orderBy("_place").collect()
    for name in {row._file for row in files}:
        terms = [row.term for row in files if row._file == name]
        assert terms == sorted(terms)
    assert spark.conf.get(index_module.OPEN_WRITERS) == "0"


def test_units_of_unknown_types_keep_them(spark):
    rows = [(1_000_000, "c", 1, "content", None, "kelp"), (2_000_000, None, 2, "content", "film", "kelp"), (-1_500_000, "c", -2, "content", "text", "kelp")]
    made = spark.createDataFrame(rows, "unit_id long, collection string, asset_id long, kind string, asset_type string, body string")
    by_term = units.as_postings(units.build_postings_by_term(made, False), made.schema["asset_id"].dataType)
    assert sorted(map(repr, by_term.collect())) == sorted(map(repr, units.build_postings(made, False).collect()))


def test_words_of_a_large_batch_are_counted_in_parts(spark):
    seen = []

    def counting(lists, dims):
        seen.append(len(lists))
        return counted_vectors(lists, dims)

    rows = spark.range(700).select("id", F.concat(F.lit("kelp reef "), F.col("id").cast("string")).alias("body"))
    rows = rows.coalesce(1)
    embedded = units.embed_hashed_words(rows, dims=8)
    assert embedded.where("embedding IS NOT NULL").count() == 700
    words = pa.array([["kelp", "reef"], [], ["tide"]] * 300)
    whole = counting(words, 8).to_pylist()
    parts = [v for start in range(0, 900, 250) for v in counting(words.slice(start, 250), 8).to_pylist()]
    assert whole == parts and max(seen[1:]) == units.EMBEDDED_AT_ONCE


def test_steps_of_a_store_are_made_when_they_are_asked_for(spark, tmp_path):
    from checks import registered

    rows = [(n, f"kelp reef {n}", ["en", "fr"][n % 2], "src7" if n % 3 else "src1", 9) for n in range(8)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    registered._changed.clear()
    views = Views(spark, str(tmp_path))
    run, retried = registered.changed(views, "retried")
    _, seen, _ = registered._changed[spark.sparkContext.applicationId, str(tmp_path)]
    assert list(seen) == ["retried"] and run.assets(spark, retried).count() == 8
    assert run.assets(spark, retried).where("status = 'failed'").count() > 0
    assert registered.changed(views, "compact")[0] is run
    assert list(seen) == ["retried", "deleted", "again", "compact"]
    # What a snapshot holds stays, whatever came after it.
    assert run.assets(spark, registered.changed(views, "retried")[1]).count() == 8
