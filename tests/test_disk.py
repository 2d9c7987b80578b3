"""What writes leave on disk: no shuffle files, no tables that nothing reads any more, and postings that travel in few bytes."""

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.test_streaming import ingest, uploads
from trovelight.functions.packed import pack_ids, unpack_ids
from trovelight.operators import blockmax, units
from trovelight.plans import index as index_module
from trovelight.plans import lineage

UNITS = "unit_id long, collection string, asset_id long, kind string, asset_type string, unit_index int, start_char int, end_char int, body string"


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    return {os.path.basename(name) for name in files if os.path.basename(name).startswith("shuffle_")}


def some_units(spark):
    rows = [(n * units.UNITS_PER_ASSET, "shore" if n % 2 else "bay", n, "content", "text", 0, 0, 9, f"kelp reef tide{n % 7} kelp") for n in range(200)]
    return spark.createDataFrame(rows, UNITS).repartition(3)


def test_a_written_table_leaves_no_shuffle_files(spark, tmp_path):
    index_module.write_postings(some_units(spark), f"{tmp_path}/first", False, 2)
    # Planning them counts units, which is no write.
    blocks = blockmax.build_blocks(spark.read.parquet(f"{tmp_path}/first"))
    before = shuffle_files(spark)
    setting = spark.conf.get(lineage.CLEAN_SHUFFLES)
    table = lineage.written(some_units(spark).repartition(4, "unit_id"), "kept")
    index_module.write_partitioned(some_units(spark), f"{tmp_path}/units", "collection")
    index_module.write_postings(some_units(spark), f"{tmp_path}/postings", False, 2)
    lineage.write_table(blocks, f"{tmp_path}/blocks", "collection")
    assert not shuffle_files(spark) - before
    assert spark.conf.get(lineage.CLEAN_SHUFFLES) == setting
    # A plan that was made meanwhile, or is run twice, is not affected.
    with lineage.without_shuffles(spark):
        counted = table.groupBy("collection").count()
    assert sorted(counted.collect()) == sorted(counted.collect())
    path = table.written_path.removeprefix("file:")
    assert os.path.isdir(path) and table.count() == 200
    lineage.discard(table)
    assert not os.path.exists(path)


def test_a_batch_leaves_the_tables_of_the_store_alone(spark, tmp_path, monkeypatch):
    made = []
    whole = lineage.new_folder

    def new_folder(session, name):
        made.append((name, whole(session, name)))
        return made[-1][1]

    monkeypatch.setattr(lineage, "new_folder", new_folder)
    run = ingest(spark, tmp_path / "root")
    run.run_batch(uploads(spark, ("demo", "a.txt", b"kelp one"), ("demo", "invalid.txt", b"kelp two")), 0)
    run.retry(spark, collection="demo")
    assert {"blobs", "contents", "units", "committed"} <= {name for name, _ in made}
    left = {name for name, path in made if os.path.exists(path.removeprefix("file:"))}
    # Nothing that holds contents, passages or vectors.
    assert not left & {"blobs", "blob-rows", "contents", "claimed", "answers", "units", "vectors", "committed", "attempted", "waiting"}
    assert run.index(spark).units.count() > 0


def test_postings_of_a_shard_travel_together(spark):
    random = np.random.default_rng(3)
    rows = pa.table(
        {
            "collection": pa.array(["bay", None, "shore"]).take(pa.array(random.integers(0, 3, 500))),
            "shard": pa.array(random.integers(0, 2, 500).astype(np.int32)),
            "term": pa.array([f"word{n}" for n in random.integers(0, 9, 500)]),
            # Some assets are not those that the units' ids tell.
            "unit_id": random.permutation(500) * 700_000 - 10**8,
            "asset_id": random.integers(-(10**12), 10**12, 500),
            "code": random.integers(0, 9, 500),
            "tf": random.integers(1, 400, 500),
        }
    ).to_batches()[0]
    together = blockmax._together(rows)
    assert together.num_rows < 60
    keys = [(name, "ascending") for name in blockmax.BLOCK_KEYS]
    apart = blockmax._apart(pa.Table.from_batches([together]).sort_by(keys).combine_chunks().to_batches()[0])
    assert apart.to_pylist() == pa.Table.from_batches([rows]).sort_by([*keys, ("unit_id", "ascending")]).to_pylist()
    sizes = np.array([3, 1, 2])
    numbers = np.array([5, -(2**62), 2**61, 7, 0, 300])
    assert (unpack_ids(*pack_ids(numbers, np.array([0, 3, 4])), sizes) == numbers).all()


def test_stored_postings_travel_by_term_again(spark):
    posted = units.build_postings(some_units(spark), False)
    by_term = units.postings_by_term(posted.coalesce(1))
    assert by_term.count() == posted.select("collection", "term").distinct().count()
    again = units.as_postings(by_term, posted.schema["asset_id"].dataType)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, posted.collect()))
    assert again.agg(F.sum("tf")).first()[0] == 800
