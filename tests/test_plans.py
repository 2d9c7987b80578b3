"""Join strategies on skewed keys, and the shape of the plans that searches run."""

import pytest
from pyspark.sql import functions as F

from checks.views import Views
from tests.conftest import DATA
from trovelight.operators import keyword, nearest
from trovelight.operators.results import Scorer
from trovelight.plans.hybrid import hybrid_search
from trovelight.plans.sizing import fits_broadcast, lookup, row_count_up_to
from trovelight.sources.blobs import get_blobs, put_blobs


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_hot_keys_are_cut_into_parts(spark, how):
    # A third of all rows share one key, and some keys are not there to look up.
    rows = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("key")
    )
    unique = spark.range(40).select(F.col("id").alias("key"), (F.col("id") * 2).alias("value"))
    plain = rows.join(unique, "key", how)
    for rows_per_part in (10, 100, 10_000):
        cut = lookup(rows, unique, ["key"], how, rows_per_part=rows_per_part)
        assert cut.columns == plain.columns
        assert sorted(cut.collect()) == sorted(plain.collect())


def test_row_counts_stop_at_the_bound(spark):
    assert row_count_up_to(spark.range(10), 10) == 10
    assert row_count_up_to(spark.range(11), 10) is None


def test_a_broadcast_is_bounded_in_rows_and_bytes(spark):
    rows = spark.range(10).select("id", F.repeat(F.lit("é"), 1000).alias("text"))
    assert fits_broadcast(rows, 10) and not fits_broadcast(rows, 9)
    assert fits_broadcast(rows, 10, 30_000) and not fits_broadcast(rows, 10, 20_000)
    assert fits_broadcast(rows.limit(0), 0, 0)


@pytest.fixture(scope="module")
def views(spark):
    return Views(spark, DATA)


def test_keyword_search_prunes_and_limits_before_it_shuffles(views):
    hits = keyword.keyword_search(views.queries(), views.index().postings, k=7, stem=False)
    text = plan(hits)
    # Only the collections and shards of the queries are read, and only what ranking needs.
    scans = [line for line in text.splitlines() if "FileScan parquet" in line and "postings" in line]
    assert scans and all("PartitionFilters: [collection" in line for line in scans)
    assert any("positions" not in line.split("Batched")[0] for line in scans)
    # Every task hands on seven hits a query at most.
    assert "row_number(), 7, Partial" in text and "row_number(), 7, Final" in text


def test_both_keyword_joins_give_the_same(views):
    small = keyword.keyword_search(views.queries(), views.index().postings, stem=False)
    large = keyword.keyword_search(
        views.queries(), views.index().postings, stem=False, max_broadcast_rows=0, rows_per_part=200
    )
    assert sorted(small.collect()) == sorted(large.collect())


def test_vector_search_reads_only_its_spaces(views):
    hits = nearest.vector_search(views.query_vectors(), views.index().vectors, k=7)
    text = plan(hits)
    assert "PartitionFilters: [isnotnull(embedding_model" in text
    assert "hashed-64" in hits._jdf.queryExecution().optimizedPlan().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def assets_by_query(rows):
    found = {}
    for r in rows.orderBy("query_id", "position").collect():
        found.setdefault(r.query_id, []).append((r.asset_id, r.relevance, r.sentence_start))
    return found


def test_models_that_fail_leave_the_results(views, tmp_path):
    def broken(rows):
        def fail(batches):
            raise ConnectionError("no model")
            yield from batches

        return rows.withColumn("relevance", F.lit(0.5)).mapInPandas(fail, "model string, q string, text string, relevance double")

    def no_sentences(rows):
        return broken(rows.select(F.lit("m").alias("model"), F.lit("q").alias("q"), "text"))

    def search(embed, relevance):
        index = views.index()
        return assets_by_query(
            hybrid_search(
                views.queries().withColumn("order", F.lit("relevance")), views.query_vectors().drop("collection"),
                index.postings, index.units, index.vectors, index.assets, embed, relevance, stem=False, rank_digits=6,
            )
        )

    plain = search(None, None)
    assert search(no_sentences, Scorer("m", broken, str(tmp_path / "cache"))) == plain
    assert {relevance for rows in plain.values() for _, relevance, _ in rows} == {None}


def test_a_second_search_asks_the_model_nothing(spark, views, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    def score(pairs):
        def answer(batches):
            for batch in batches:
                asked.add(len(batch))
                yield batch.assign(relevance=batch["text"].str.len() % 10 / 10)

        return pairs.mapInPandas(answer, "model string, q string, text string, relevance double")

    index = views.index()
    scorer = Scorer("lengths", score, str(tmp_path / "cache"))
    found = []
    for _ in range(2):
        hits = hybrid_search(
            views.queries(), views.query_vectors().drop("collection"), index.postings, index.units, index.vectors,
            index.assets, None, scorer, stem=False, rank_digits=6,
        )
        found.append((assets_by_query(hits), asked.value))
    assert found[0] == found[1]
    assert found[0][1] > 0


def test_bodies_and_contents_are_not_moved_to_look_things_up(spark, tmp_path):
    path = str(tmp_path / "blobs")
    rows = spark.range(600).select(F.sha2((F.col("id") % 200).cast("string"), 256).alias("sha256"), F.repeat(F.lit("x"), F.lit(50)).cast("binary").alias("content"))
    put_blobs(rows, path, digits=1)
    put_blobs(rows, path, digits=1)
    assert spark.read.parquet(path).count() == 200
    keys = spark.range(300).select(F.when(F.col("id") < 100, F.sha2(F.lit("7"), 256)).otherwise(F.sha2(F.col("id").cast("string"), 256)).alias("sha256"))
    found = get_blobs(keys, path, digits=1)
    assert (found.count(), found.where("missing").count()) == (300, 100)
    text = found._jdf.queryExecution().optimizedPlan().toString()
    # The store meets the hashes asked for where it is read.
    assert "Join LeftSemi" in text and "rightHint=(strategy=broadcast)" in text


def test_no_query_pairs_everything(views):
    from checks.registered import QUERIES

    for name in ("h8_cap_and_page", "j1_query_matrix", "a8_collect_aliases", "d5_retry"):
        text = plan(QUERIES[name](views))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_a_sentence_model_that_fails_is_told(views, monkeypatch):
    from checks import registered

    def no_vectors(rows):
        return rows.withColumn("embedding", F.lit(None).cast("array<float>"))

    index = views.index()
    found = hybrid_search(
        views.queries(), views.query_vectors().drop("collection"), index.postings, index.units, index.vectors,
        index.assets, no_vectors, stem=False, rank_digits=6, blocks=index.blocks,
    ).collect()
    told = {(r.match == "semantic", "no vector" in (r.sentence_error or ""), r.sentence_start) for r in found}
    assert told == {(True, True, None), (False, False, None)}
    monkeypatch.setattr(registered, "embed_sentences", no_vectors)
    for name in ("h12_closest_sentence", "h13_hybrid_search"):
        with pytest.raises(Exception, match="the model gave sentences no vector"):
            registered.QUERIES[name](views)
