"""Block-max search against summing every posting, and how much of the postings it decodes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trovelight.operators import blockmax, keyword
from trovelight.operators.units import build_postings

POSTINGS = "collection string, term string, unit_id long, asset_id long, kind string, asset_type string, tf int, positions array<int>"
ASKED = "query_id long, collection string, q string"


@pytest.fixture(scope="module")
def postings(spark):
    """Words from one to all of 6,000 units, some words together more often than by chance."""
    random = np.random.default_rng(17)
    rows = []
    for number, share in enumerate((1.0, 0.5, 0.2, 0.05, 0.01, 0.001)):
        for unit in np.flatnonzero(random.random(6000) < share).tolist():
            tf = int(random.geometric(0.5 if number else 0.8))
            rows.append(("shore", f"word{number}", unit * 7, unit // 5, "content", "text", tf, [1]))
    rows.append(("inland", "word0", 3, 1, "image", "image", 300, [1]))
    # Ids that lie far apart.
    rows += [("inland", "word1", 10**15 * n, -n, "metadata", "text", 1, [1]) for n in range(1, 5)]
    return spark.createDataFrame(rows, POSTINGS).repartition(5)


@pytest.fixture(scope="module")
def blocks(spark, postings, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("blocks") / "b")
    blockmax.build_blocks(postings, units_per_shard=1500).write.parquet(path)
    return spark.read.parquet(path)


def test_blocks_hold_every_posting(postings, blocks):
    assert blocks.agg(F.sum("n")).first()[0] == postings.count()
    assert blocks.agg(F.max("n")).first()[0] == blockmax.BLOCK
    assert blocks.where("collection = 'shore'").select("shard").distinct().count() > 1
    # A shard holds all words of its units.
    shards = blocks.where("collection = 'shore'").groupBy("term").agg(F.count_distinct("shard").alias("n")).collect()
    assert max(row.n for row in shards) == blocks.where("collection = 'shore'").select("shard").distinct().count()
    largest = {(r.collection, r.term): r.most for r in blocks.groupBy("collection", "term").agg(F.max("most").alias("most")).collect()}
    expected = {(r.collection, r.term): r.most for r in postings.groupBy("collection", "term").agg(F.max("tf").alias("most")).collect()}
    assert largest == expected


@pytest.mark.parametrize("k", [1, 7, 100, 10_000])
def test_the_best_units_are_those_of_all_sums(spark, postings, blocks, k):
    texts = ["word0", "word1 word2", "word0 word4", "word5 word0 word3", "word0 word1 word2 word3 word4 word5", "word9", "word9 word4", "the", ""]
    asked = spark.createDataFrame([*[(n, "shore", q) for n, q in enumerate(texts)], (100, "inland", "word0 word1"), (101, "nowhere", "word0")], ASKED)
    by_sums = keyword.keyword_search(asked, postings, k=k, stem=False)
    by_blocks = keyword.keyword_search(asked, postings, k=k, stem=False, blocks=blocks)
    assert by_blocks.columns == by_sums.columns
    assert sorted(by_blocks.collect()) == sorted(by_sums.collect())


def test_two_words_decode_less_than_half(spark):
    # Passages of one file follow each other, so what a file is about stands in neighbouring units.
    random = np.random.default_rng(5)
    tf = {"everywhere": np.ones(6000, int), "often": random.random(6000) < 0.3, "topic": np.zeros(6000, int), "theme": np.zeros(6000, int)}
    tf["everywhere"][random.choice(6000, 60, replace=False)] = 4
    for word, start, size in (("topic", 700, 60), ("topic", 4000, 30), ("theme", 2000, 500), ("theme", 4010, 300)):
        tf[word][start : start + size] = random.integers(1, 6, size)
    rows = [("shore", word, unit, unit // 40, "content", "text", int(n), [1]) for word, counts in tf.items() for unit, n in enumerate(counts) if n]
    postings = spark.createDataFrame(rows, POSTINGS)
    blocks = blockmax.build_blocks(postings).cache()
    for words in (["topic", "everywhere"], ["theme", "everywhere"], ["topic", "often"], ["topic", "theme"], ["theme", "often"]):
        asked = spark.createDataFrame([(1, "shore", " ".join(words))], ASKED)
        terms = spark.createDataFrame([(1, "shore", 2, word) for word in words], "query_id long, collection string, n_terms int, term string")
        counted = spark.sparkContext.accumulator(0)
        blockmax.best_by_blocks(terms, blocks, 10, 9, counted).count()
        every = blocks.where(F.col("term").isin(words)).agg(F.sum("n")).first()[0]
        assert 0 < counted.value < every / 2, words
        found = keyword.keyword_search(asked, postings, k=10, stem=False, blocks=blocks)
        assert sorted(found.collect()) == sorted(keyword.keyword_search(asked, postings, k=10, stem=False).collect())


def test_structured_queries_still_read_positions(spark):
    rows = [(1, "shore", 1, "content", "text", "kelp reef"), (2, "shore", 1, "content", "text", "reef kelp")]
    units = spark.createDataFrame(rows, "unit_id long, collection string, asset_id long, kind string, asset_type string, body string")
    postings = build_postings(units, False)
    asked = spark.createDataFrame([(1, "shore", '"kelp reef"'), (2, "shore", "kelp reef")], ASKED)
    found = keyword.keyword_search(asked, postings, stem=False, blocks=blockmax.build_blocks(postings))
    assert sorted((r.query_id, r.unit_id) for r in found.collect()) == [(1, 1), (2, 1), (2, 2)]
