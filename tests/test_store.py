"""The stored tables: retry of failed files, deletion, snapshots, compaction, and which folders a batch opens."""

import pytest
from pyspark.sql import functions as F

from tests.test_streaming import UPLOADS, ingest, search, states, uploads
from trovelight.streaming.store import TIER, Line, Snapshot, Store, crowded


def everything(run, spark, snapshot=None):
    index = run.index(spark, snapshot)
    return (
        sorted((r.asset_id, r.collection, r.filename, r.status) for r in run.assets(spark, snapshot).collect()),
        sorted((r.asset_id, r.alias) for r in run.aliases(spark, snapshot).collect()),
        sorted((r.unit_id, r.body) for r in index.units.collect()),
        sorted((r.unit_id, r.term, r.tf) for r in index.postings.collect()),
        sorted(r.unit_id for r in index.vectors.collect()),
    )


def test_failed_files_are_taken_up_again(spark, tmp_path):
    run = ingest(spark, tmp_path / "root")
    run.run_batch(uploads(spark, ("demo", "a.txt", b"kelp one"), ("demo", "invalid.txt", b"kelp two"), ("demo", "invalid2.txt", b"kelp three")), 0)
    assert states(run, spark) == {"a.txt": ("ready", 1), "invalid.txt": ("failed", 2), "invalid2.txt": ("failed", 2)}
    # The same bytes again change nothing.
    run.run_batch(uploads(spark, ("demo", "invalid.txt", b"kelp two")), 1)
    assert states(run, spark)["invalid.txt"] == ("failed", 2)
    # A retry that fails again, and one that is asked for what cannot be retried.
    ids = {r.filename: r.asset_id for r in run.assets(spark).collect()}
    answers = run.retry(spark, spark.createDataFrame([(ids["a.txt"],), (ids["invalid.txt"],), (99,)], "asset_id long"))
    assert {r.asset_id: r.outcome for r in answers.collect()} == {ids["a.txt"]: "refused", ids["invalid.txt"]: "retried", 99: "unknown"}
    assert states(run, spark)["invalid.txt"] == ("failed", 2)

    from trovelight.operators import enrich
    from trovelight.streaming.ingest import Models

    table = spark.createDataFrame([], "filename string, title string, description string, tags array<string>, visible_text string, image_type string")

    def describe(work):
        named = work.withColumn("filename", F.regexp_replace("filename", "invalid", "fixed"))
        return enrich.answered(*enrich.describe_lookup(named, table))

    mended = type(run)(run.root, Models(describe, run.models.embed), run.settings, run.stem, run.shards)
    before = mended.snapshot(spark)
    assert {r.outcome for r in mended.retry(spark, collection="demo").collect()} == {"retried"}
    assert states(mended, spark) == {"a.txt": ("ready", 1), "invalid.txt": ("ready", 1), "invalid2.txt": ("ready", 1)}
    found = search(spark, mended.index(spark), "kelp")
    assert sorted(r.asset_id for r in found) == sorted(ids.values())
    # A reader of the snapshot before sees what was there then.
    assert states_at(run, spark, before)["invalid.txt"] == ("failed", 2)
    assert mended.retry(spark, collection="demo").count() == 0
    # Putting all folders together keeps the newest states.
    after = everything(mended, spark)
    assert mended.compact(spark, whole=True) > 0
    assert everything(mended, spark) == after
    assert len(mended.snapshot(spark).folders("assets")) == 1


def states_at(run, spark, snapshot):
    return {r.filename: (r.status, r.attempts) for r in run.assets(spark, snapshot).collect()}


def test_a_deleted_collection_is_gone_and_may_come_back(spark, tmp_path):
    run = ingest(spark, tmp_path / "root")
    run.run_batch(uploads(spark, ("demo", "a.txt", b"kelp one"), ("demo", "b.txt", b"kelp two"), ("other", "a.txt", b"kelp one")), 0)
    before = run.snapshot(spark)
    assert run.delete_collection(spark, "nothing") == 0
    assert run.snapshot(spark) == before
    assert run.delete_collection(spark, "demo") == 2
    assert [r.collection for r in run.assets(spark).collect()] == ["other"]
    assert search(spark, run.index(spark), "kelp") == []
    assert {r.collection for r in run.index(spark).units.collect()} == {"other"}
    # One of the files again: a new asset, found once; the old ones stay hidden.
    run.run_batch(uploads(spark, ("demo", "a.txt", b"kelp one")), 1)
    found = search(spark, run.index(spark), "kelp")
    assert len(found) == 1 and len({r.asset_id for r in run.assets(spark).collect()} & {found[0].asset_id}) == 1
    assert run.assets(spark, before).count() == 3
    after = everything(run, spark)
    run.compact(spark, whole=True)
    assert everything(run, spark) == after
    assert run.snapshot(spark).deleted() == {}
    # Readers of the old snapshot go on until it expires.
    assert run.assets(spark, before).count() == 3
    gone = run.store.expire(spark, keep=1)
    assert any(name.startswith("units/batch-0") for name in gone)
    assert everything(run, spark) == after


def test_folders_stay_few_and_a_dying_compaction_changes_nothing(spark, tmp_path, monkeypatch):
    run = ingest(spark, tmp_path / "root")
    for batch in range(TIER + 1):
        run.run_batch(uploads(spark, ("demo", f"f{batch}.txt", f"kelp number{batch}".encode())), batch)
    before, tables = run.snapshot(spark), everything(run, spark)
    assert len(before.folders("units")) == TIER + 1

    def dies(*_):
        raise ConnectionError("the driver is gone")

    with monkeypatch.context() as patch:
        patch.setattr(Store, "commit", dies)
        with pytest.raises(ConnectionError):
            run.compact(spark)
    assert run.snapshot(spark) == before and everything(run, spark) == tables
    assert run.compact(spark) > 0
    assert everything(run, spark) == tables
    assert {table: len(run.snapshot(spark).folders(table)) for table in ("units", "postings", "vectors", "assets", "blobs")} == dict.fromkeys(
        ("units", "postings", "vectors", "assets", "blobs"), 1
    )
    # A batch that has been put together with others does not run again; the next one goes on from there.
    run.run_batch(uploads(spark, ("demo", "f3.txt", b"kelp number3")), 3)
    assert everything(run, spark) == tables
    run.run_batch(uploads(spark, ("demo", "again.txt", b"kelp number3"), ("demo", "new.txt", b"kelp new")), TIER + 1)
    assert sorted(r.alias for r in run.aliases(spark).collect()) == ["again.txt"]
    assert run.assets(spark).count() == TIER + 2
    assert len(search(spark, run.index(spark), "kelp")) == TIER + 2


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path):
    store = Store(str(tmp_path))
    empty = store.snapshot(spark)
    first = store.commit(spark, empty, [Line("t", "a", 0, 1, 5)])
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        store.commit(spark, empty, [Line("t", "b", 0, 1, 5)])
    assert store.snapshot(spark) == first
    assert store.snapshot(spark, 1).folders("t")[0].folder == "a"


def test_only_folders_that_may_hold_a_content_are_opened(spark, tmp_path):
    store = Store(str(tmp_path))
    lines = []
    for number in range(12):
        rows = spark.range(number * 1000, number * 1000 + 500).select(F.sha2(F.col("id").cast("string"), 256).alias("sha256"))
        lines.append(store.described(Line("assets", f"batch-{number}", number, number + 1), rows, "sha256"))
    fresh = spark.range(10**6, 10**6 + 100).select(F.sha2(F.col("id").cast("string"), 256).alias("sha256"))
    assert store.holding(lines, fresh, "sha256") == []
    known = fresh.unionByName(spark.range(3100, 3101).select(F.sha2(F.col("id").cast("string"), 256).alias("sha256")))
    assert [line.folder for line in store.holding(lines, known, "sha256")] == ["batch-3"]
    assert store.holding(lines, fresh.limit(0), "sha256") == []
    # A folder without a filter is looked into where its range allows it.
    wide = Line("assets", "large", None, 1, 10**9, 0, None, "0", "f" * 64)
    assert store.holding([wide], fresh, "sha256") == [wide]
    assert store.holding([Line("assets", "empty", None, 1)], fresh, "sha256") == []


def test_a_new_batch_opens_no_old_folder(spark, tmp_path, monkeypatch):
    run = ingest(spark, tmp_path / "root")
    for batch in range(3):
        run.run_batch(uploads(spark, ("demo", f"f{batch}.txt", f"kelp number{batch}".encode())), batch)
    opened = []
    whole = Store.read

    def read(self, session, snapshot, table, ddl, lines=None):
        opened.extend((table, line.folder) for line in (snapshot.folders(table) if lines is None else lines))
        return whole(self, session, snapshot, table, ddl, lines)

    monkeypatch.setattr(Store, "read", read)
    run.run_batch(uploads(spark, *[("demo", f"new{n}.txt", f"fresh {n}".encode()) for n in range(10)]), 3)
    assert {folder for _, folder in opened} == {"batch-3"}
    opened.clear()
    run.run_batch(uploads(spark, ("demo", "copy.txt", b"kelp number1")), 4)
    assert {folder for _, folder in opened} <= {"batch-1", "batch-4"} and ("assets", "batch-1") in opened


def test_tiers():
    small = [Line("t", f"s{n}", n, n, 10) for n in range(TIER + 1)]
    large = [Line("t", f"l{n}", n, n, 10**7) for n in range(TIER)]
    assert crowded(small + large) == [small]
    assert crowded(large) == []
    assert Snapshot(1, tuple(small)).last() == 0


def test_an_empty_upload_is_a_batch(spark, tmp_path):
    run = ingest(spark, tmp_path / "root")
    run.run_batch(spark.createDataFrame([], UPLOADS), 0)
    assert run.compact(spark, whole=True) == 0 or run.assets(spark).count() == 0
    assert run.retry(spark, collection="demo").count() == 0
