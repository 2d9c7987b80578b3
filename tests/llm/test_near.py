"""Near duplicates against comparing every pair, signatures against the similarity they estimate."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from trovelight.llm import near
from trovelight.llm.shingles import Shingles, signature, similarity, weights


def weighted(text):
    shingles, counts = Shingles(5).of((text or "").encode())
    return shingles, weights(counts)


def classes_of(rows):
    """The smallest id of each id's component, every pair compared."""
    made = [(i, weighted(t)) for i, t in rows]
    head = {i: i for i, _ in rows}

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for (i, a), (j, b) in itertools.combinations(made, 2):
        if similarity(*a, *b) >= 0.8 - 1e-9:
            low, high = sorted((find(i), find(j)))
            head[high] = low
    return {i: find(i) for i, _ in rows}


def found_classes(docs, **options):
    return {r.doc_id: r.class_id for r in near.near_classes(docs, **options).select("row.doc_id", "class_id").collect()}


def test_shingles():
    maker = Shingles(5)
    assert len(maker.of(b"a b c d e f")[0]) == 2
    assert len(maker.of(b"a b c")[0]) == 1
    assert len(maker.of(b" \t\n")[0]) == len(maker.of(b"")[0]) == 0
    assert list(maker.of(b"a b c d e a b c d e")[1]).count(2) == 1
    assert list(maker.of(b" a  b\tc\nd e")[0]) == list(maker.of(b"a b c d e")[0])
    assert list(maker.of(b"ab c")[0]) != list(maker.of(b"a bc")[0])
    assert len(maker.of(b"x" * 100_000)[0]) == 1


def test_similarity_of_plain_and_weighted_sets():
    a, b = np.arange(10, dtype=np.uint64), np.arange(4, 14, dtype=np.uint64)
    one = np.ones(10)
    assert similarity(a, one, b, one) == pytest.approx(6 / 14)
    assert similarity(a, 3 * one, a, one) == pytest.approx(1)
    random = np.random.default_rng(0)
    wa, wb = random.random(10) + 0.1, random.random(10) + 0.1
    x = dict(zip(a.tolist(), wa, strict=True))
    y = dict(zip(b.tolist(), wb, strict=True))
    slow = sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in {*x, *y}) for d in x.keys() & y.keys())
    assert similarity(a, wa, b, wb) == pytest.approx(slow)


@pytest.mark.parametrize("size", [1, 3, 40, 600])
def test_signatures_estimate_the_similarity(size):
    random = np.random.default_rng(size)
    shared = random.integers(0, 2**63, size, dtype=np.uint64)
    own = random.integers(0, 2**63, max(1, size // 3), dtype=np.uint64)
    a, b = np.unique(shared), np.unique(np.concatenate([shared, own]))
    wa, wb = 1 + a.astype(float) % 3, 1 + b.astype(float) % 2
    places = 4000
    agree = (signature(a, wa, places) == signature(b, wb, places)).mean()
    assert agree == pytest.approx(similarity(a, wa, b, wb), abs=0.035)


def varied(random, count, base):
    """Texts of 120 words that replace a few words of a base text."""
    rows = []
    for _ in range(count):
        words = list(base)
        for at in random.choice(len(words), int(random.integers(0, 4)), replace=False):
            words[at] = f"new{random.integers(10**6)}"
        rows.append(" ".join(words))
    return rows


@pytest.mark.parametrize("options", [{}, {"broadcast_rows": 0, "rows_per_part": 2, "block": 4}])
def test_classes(spark, options):
    random = np.random.default_rng(8)
    texts = []
    for group in range(12):
        base = [f"g{group}w{random.integers(5000)}" for _ in range(120)]
        texts += varied(random, int(random.integers(1, 12)), base)
    passage = [f"p{i}" for i in range(60)]
    texts += [" ".join([*passage, *(f"s{n}x{i}" for i in range(45))]) for n in range(25)]
    texts += ["", None, " ", "one two", "one two", "one  two", "one", "same words here", "word " * 3000, "word " * 3100]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found_classes(docs, **options) == classes_of(rows)


def test_whole_documents(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert found_classes(documents) == classes_of(rows)


def test_kept_rows_ids_and_names(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(None, text, 1), (4, text + " z", 2), (4, text + " z", 3), (9, "other " + text[40:], 4), (None, "lonely text of its own kind", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node long").withColumn("class", F.col("node"))
    kept = near.without_near_copies(docs)
    assert kept.columns == docs.columns
    found = kept.collect()
    assert len(found) == 3
    assert [r.class_id for r in near.near_classes(docs).orderBy("row.node").collect()] == [4, 4, 4, 9, None]
    assert sum(r.text == text + " z" for r in found) == 1
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near.near_classes(empty).count() == 0


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 200)]
    star = [(1, i) for i in range(2, 90)]
    links = spark.createDataFrame([*chain, *star, (500, 501)], "a long, b long")
    for part in (2, 100_000):
        found = {r.node: r["class"] for r in near.components(links, rows_per_part=part).collect()}
        assert found == {**dict.fromkeys(range(100, 201), 100), **dict.fromkeys(range(1, 90), 1), 500: 500, 501: 500}


def test_a_large_group_of_copies_is_one_node(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit(text)).otherwise(F.concat(F.lit("t"), F.col("id").cast("string"), F.lit(" a b c d e f"))).alias("text"))
    rows = near.near_classes(docs, rows_per_part=50)
    assert rows.where("class_id = 0").count() == 667
    assert rows.where("kept").count() == 1334


def test_a_pair_that_meets_in_one_large_bucket_only_is_compared(spark):
    same = " ".join(f"w{i}" for i in range(100))
    texts = {1: same, 2: same + " more", **{n: f"c{n} " * 9 for n in range(3, 40)}}
    pair = np.arange(80, dtype="<u4")
    # The pair shares the first band with all others, the second with each other, as equal signatures do.
    sigs = {n: pair if n < 3 else np.concatenate([pair[:4], 1000 * n + pair[4:]]).astype("<u4") for n in texts}
    nodes = spark.createDataFrame([(n, bytearray(sigs[n].tobytes())) for n in texts], "node long, sig binary")
    members = spark.createDataFrame([(7, 0, n) for n in texts], "key long, band int, node long")
    classes = spark.createDataFrame([], "node long, class long")
    rows = spark.createDataFrame(list(texts.items()), "node long, text string")
    for block in (500, 3):
        found = near._across(members, classes, nodes, rows, 1000, 1000, block)
        assert [tuple(r) for r in found.collect()] == [(1, 2)]
