"""The life of assets, and the catalogue."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from trovelight import fixed_values as fixed
from trovelight.operators import catalog, evaluate, lifecycle
from trovelight.schemas import ASSETS, need_table

NOON = datetime(2026, 1, 1, 12, 0)


def at(hour, minute=0):
    return datetime(2026, 1, 1, hour, minute)


def assets(spark, *rows):
    """(id, status, attempts, started_at) as assets of one collection, older ids first."""
    columns = "asset_id long, status string, attempts int, started_at timestamp"
    table = spark.createDataFrame(rows, columns)
    blank = {
        name: F.lit(None).cast(kind)
        for name, kind in (part.split() for part in ASSETS.split(", "))
        if name not in table.columns
    }
    return table.withColumns(
        {
            **blank,
            "collection": F.lit("demo"),
            "asset_type": F.lit("text"),
            "error": F.when(F.col("status") == "failed", F.lit("old")),
            "created_at": F.timestamp_seconds(F.col("asset_id") * 60),
        }
    )


def states(df):
    return {r.asset_id: (r.status, r.attempts, r.error, r.started_at) for r in df.collect()}


def now(spark):
    return F.lit("2026-01-01 12:00:00").cast("timestamp")


def test_the_oldest_pending_are_claimed(spark):
    table = assets(spark, (3, "pending", 0, None), (1, "ready", 1, None), (2, "pending", 1, None), (4, "pending", 0, None))
    need_table(table, ASSETS)
    after = lifecycle.claim(table, 2, now(spark))
    assert {r.asset_id for r in after.where("claimed").collect()} == {2, 3}
    found = states(after)
    assert found[2] == ("processing", 2, None, NOON)
    assert found[4] == ("pending", 0, None, None)
    assert lifecycle.claim(table.where("asset_id = 1"), 2, now(spark)).where("claimed").count() == 0


@pytest.mark.parametrize("moments", [1, 7, 10**9])
def test_large_claims_are_the_oldest_too(spark, monkeypatch, moments):
    monkeypatch.setattr(lifecycle, "FEW", 3)
    monkeypatch.setattr(lifecycle, "RANGES", 4)
    rows = [(n * 7919 % 500, "pending" if n % 5 else "ready", 0, None) for n in range(500)]
    # Many rows of one moment, or each of its own.
    table = assets(spark, *rows).withColumn("created_at", F.timestamp_seconds(F.pmod(F.col("asset_id") * 31, F.lit(moments))))
    waiting = sorted((n * 31 % moments, n) for n, status, *_ in rows if status == "pending")
    for n in (4, 57, 399, 400, 1000):
        after = lifecycle.claim(table, n, now(spark))
        assert after.count() == 500
        assert sorted(r.asset_id for r in after.where("claimed").collect()) == sorted(asset for _, asset in waiting[:n])
    plan = lifecycle.claim(table, 1000, now(spark))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Join" not in plan


def errors(spark, *rows):
    return spark.createDataFrame(
        rows, "asset_id long, started_at timestamp, error_class string, message string"
    )


def test_failures_are_recorded_under_the_lease(spark):
    table = assets(spark, *[(n, "processing", n, at(11)) for n in (1, 2, 3)], (4, "processing", 1, at(11)))
    hit = errors(
        spark,
        (1, at(11), "OSError", "x" * 2000),
        (2, at(11), "ValidationError", "secret"),
        (3, at(11), "OSError", "gone"),
        (4, at(10), "OSError", "another lease"),
    )
    found = states(lifecycle.record_failure(table, hit))
    assert found[1][0] == "pending" and found[1][2] == ("OSError: " + "x" * 2000)[:1000]
    assert found[2] == ("pending", 2, fixed.INVALID_ANSWER, None)
    assert found[3] == ("failed", 3, "OSError: gone", None)
    assert found[4] == ("processing", 1, None, at(11))


def test_expired_leases_are_ended(spark):
    table = assets(
        spark,
        (1, "processing", 1, at(11, 49)),
        (2, "processing", 3, at(11, 49)),
        (3, "processing", 3, at(11, 50)),
        (4, "ready", 3, at(1)),
    )
    reaped = lifecycle.reap(table, now(spark))
    found = states(reaped)
    assert found[1] == ("pending", 1, None, None)
    assert found[2][0] == "failed" and "did not finish within the lease 3 times" in found[2][2]
    assert found[3][0] == "processing" and found[4][0] == "ready"
    assert lifecycle.reap_counts(reaped).first().asDict() == {"n_failed": 1, "n_released": 1}


def test_only_failed_assets_are_retried(spark):
    table = assets(spark, (1, "failed", 3, None), (2, "ready", 1, None))
    ids = spark.createDataFrame([(1,), (1,), (2,), (9,)], "asset_id long")
    after, answers = lifecycle.retry(table, ids)
    assert states(after) == {1: ("pending", 0, None, None), 2: ("ready", 1, None, None)}
    assert {r.asset_id: (r.outcome, r.message) for r in answers.collect()} == {
        1: ("retried", None),
        2: ("refused", "Only a failed asset can be retried; this one is ready."),
        9: ("unknown", "Asset not found."),
    }
    bulk = lifecycle.retry_collection(table, "demo")
    assert [r.asset_id for r in bulk.where("retried").collect()] == [1]
    assert lifecycle.retry_collection(table, "other").where("retried").count() == 0


UNITS = "unit_id long, asset_id long, collection string, kind string"
WORK = (
    "asset_id long, started_at timestamp, title string, description string, tags array<string>, "
    "visible_text string, image_type string, vision_model string"
)


def test_commit_needs_the_lease_and_every_vector(spark):
    table = assets(spark, *[(n, "processing", 1, at(11)) for n in (1, 2, 3)])
    work = spark.createDataFrame(
        [(n, at(10) if n == 2 else at(11), "T", "D", ["x"], "", None, "m") for n in (1, 2, 3)], WORK
    )
    units = spark.createDataFrame([(n * 10 + u, n, "demo", "content") for n in (1, 2, 3) for u in (0, 1)], UNITS)
    vectors = spark.createDataFrame(
        [(u, [1.0], "m") for u in (10, 11, 20, 21, 30)], "unit_id long, embedding array<float>, embedding_model string"
    )
    after, inserted = lifecycle.commit_units(table, work, units, vectors)
    assert {n: s for n, (s, *_) in states(after).items()} == {1: "ready", 2: "processing", 3: "processing"}
    assert sorted(r.unit_id for r in inserted.collect()) == [10, 11]
    ready = after.where("status = 'ready'").first()
    # A text file shows no text, which is not the same as an empty one.
    assert (ready.title, ready.visible_text) == ("T", None)
    # The same commit again finds no lease and adds nothing.
    again, more = lifecycle.commit_units(after, work, units, vectors)
    assert more.count() == 0 and states(again) == states(after)


def test_catalogue(spark):
    table = assets(spark, (1, "ready", 1, None), (2, "pending", 0, None), (3, "failed", 3, None))
    other = table.withColumns({"collection": F.lit("other"), "asset_id": F.col("asset_id") + 10})
    both = table.union(other.select(*table.columns))
    assert [r.asset_id for r in catalog.list_assets(both, "demo").collect()] == [3, 2, 1]
    assert [tuple(r) for r in catalog.list_collections(both).collect()] == [("demo", 3), ("other", 3)]
    summary = {r.collection: r for r in catalog.status_summary(both).collect()}["demo"]
    assert (summary.total, summary.pending, summary.ready, summary.failed) == (3, 1, 1, 1)
    view = {r.asset_id: r for r in catalog.asset_view(table).collect()}
    assert view[1].metadata is not None and view[2].metadata is None
    units = spark.createDataFrame([(1, 1, "demo", "content"), (2, 11, "other", "content")], UNITS)
    names = spark.createDataFrame(
        [("demo", "h", 1, "z", 9), ("demo", "h", 1, "y", 9), ("other", "h", 11, "x", 3)],
        "collection string, sha256 string, asset_id long, alias string, first_arrival long",
    )
    kept, deleted = catalog.delete_collection("demo", both, units=units, aliases=names)
    assert {name: rows.count() for name, rows in kept.items()} == {"assets": 3, "units": 1, "aliases": 1}
    assert deleted.first().deleted == 3
    assert catalog.delete_collection("none", both)[1].first().deleted == 0
    shown = catalog.asset_aliases(table, names).orderBy("place").collect()
    assert [(r.asset_id, r.alias, r.place) for r in shown] == [(1, "y", 1), (1, "z", 2)]
    ids = spark.createDataFrame([(2,), (99,)], "asset_id long")
    assert {r.asset_id: r.found for r in catalog.get_assets(ids, both).collect()} == {2: True, 99: False}


def test_ingest_metrics(spark):
    rows = spark.createDataFrame(
        [(1, "ready", 2, at(11), at(11, 1)), (2, "failed", 3, at(11), at(11, 1))],
        "asset_id long, status string, attempts int, started_at timestamp, finished_at timestamp",
    )
    units = spark.createDataFrame([(10, 1, "demo", "content"), (11, 1, "demo", "content")], UNITS)
    [row] = evaluate.ingest_metrics(rows, units).collect()
    assert (row.asset_id, row.attempts, row.units, row.duration_ms) == (1, 2, 2, 60_000)


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="created_at"):
        catalog.list_assets(spark.range(1).selectExpr("id AS asset_id", "'x' AS collection"), "x")
