"""The n-gram join against comparing every pair, and its bounds."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from trovelight.llm import ngram_join

SPACE = " \t\n\v\f\r"


def shingles(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in SPACE else c for c in lowered).split(" ") if w]
    size = min(3, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def components_of(rows, percent=90):
    sets = [(i, shingles(t)) for i, t in rows]
    head = {n: n for n in range(len(rows))}

    def find(n):
        while head[n] != n:
            n = head[n]
        return n

    for (n, (_, a)), (m, (_, b)) in itertools.combinations(enumerate(sets), 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            head[find(n)] = find(m)
    groups = {}
    for n, (i, _) in enumerate(sets):
        groups.setdefault(find(n), []).append(i)
    return sorted((i, len(s), min(groups[find(n)])) for n, (i, s) in enumerate(sets))


def found(docs, **options):
    rows = ngram_join.jaccard_components(docs, **options).select("row.doc_id", "n_shingles", "component_id")
    return sorted(tuple(r) for r in rows.collect())


def varied(random, base, changes):
    words = list(base)
    for at in random.choice(len(words), changes, replace=False):
        words[at] = f"x{random.integers(10**6)}"
    return " ".join(words)


SMALL = {"broadcast_rows": 0, "rows_per_part": 2, "block": 3}


@pytest.mark.parametrize("options", [{}, SMALL])
def test_components_as_comparing_every_pair(spark, options):
    random = np.random.default_rng(3)
    texts = []
    for group in range(10):
        base = [f"g{group}w{random.integers(3000)}" for _ in range(int(random.integers(60, 400)))]
        texts += [varied(random, base, int(random.integers(0, 9))) for _ in range(int(random.integers(1, 14)))]
    passage = " ".join(f"p{n}" for n in range(50))
    texts += [f"{passage} " + " ".join(f"own{n}t{k}" for k in range(int(random.integers(5, 300)))) for n in range(30)]
    # Chains whose ends are not similar, sizes at the edge, repeats, and texts of few words or none.
    chain = [f"c{n}" for n in range(200)]
    texts += [" ".join(chain[n : n + 150]) for n in range(0, 50, 3)]
    texts += [" ".join(f"e{n}" for n in range(size)) for size in (92, 102, 112)]
    texts += ["", None, " \n", "one", "ONE", "one two", "one  two", "one two three", "one two three", "É a b", "é a b", "word " * 500, "word " * 400]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(docs, **options) == components_of(rows)


def test_whole_documents_as_comparing_every_pair(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert found(documents) == components_of(rows)


def test_another_threshold_and_shingle_size(spark):
    random = np.random.default_rng(9)
    base = [f"w{n}" for n in range(120)]
    rows = list(enumerate(varied(random, base, int(random.integers(0, 20))) for _ in range(25)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs, percent=60) == components_of(rows, 60)
    assert found(docs, percent=100) == components_of(rows, 100)


def test_a_large_group_of_copies_and_of_near_copies(spark):
    same = " ".join(f"w{n}" for n in range(100))
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.lit(same)).when(F.col("id") % 3 == 1, F.concat(F.lit(same + " tail"), F.col("id"))).otherwise(F.concat(F.lit("lone a b c "), F.col("id"), F.lit(" d "), F.col("id") + 1)).alias("text"),
    )
    rows = ngram_join.jaccard_components(docs, rows_per_part=50, block=100).collect()
    assert {r.component_id for r in rows if r.row.doc_id % 3 != 2} == {0}
    assert all(r.component_id == r.row.doc_id and r.component_size == 1 for r in rows if r.row.doc_id % 3 == 2)


def test_null_ids_clashing_names_and_empty_tables(spark):
    text = " ".join(f"w{n}" for n in range(60))
    rows = [(None, text, 1), (7, text + " z", 2), (7, text + " z", 3), (None, "", 4), (3, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long").withColumn("class", F.col("n")).withColumn("row", F.col("n"))
    made = {r.row.n: (r.component_id, r.component_size) for r in ngram_join.jaccard_components(docs).collect()}
    assert made == {1: (7, 3), 2: (7, 3), 3: (7, 3), 4: (None, 1), 5: (3, 1)}
    assert ngram_join.jaccard_components(docs).select("row.*").columns == docs.columns
    assert ngram_join.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_overlaps_and_prefixes():
    random = np.random.default_rng(1)
    sets = [np.unique(random.integers(0, 9000, size)).astype(np.uint64) for size in (1, 5, 3000, 8000, 40)]
    expected = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert ngram_join.overlaps(sets, sets).tolist() == expected
    assert ngram_join.overlaps(sets[:1], sets[2:]).tolist() == [expected[0][2:]]
    for a, b in itertools.product(range(1, 60), repeat=2):
        least = ngram_join.needed(a, b, 90)
        assert all((100 * o >= 90 * (a + b - o)) == (o >= least) for o in range(min(a, b) + 1))
    assert [ngram_join.prefix_length(n, 90) for n in (1, 9, 10, 11, 100)] == [1, 1, 2, 2, 11]


@pytest.mark.parametrize("block", [1, 500])
def test_postings_without_a_partner_of_another_class_leave(spark, block):
    random = np.random.default_rng(5)
    rows = []
    for token in range(40):
        count = int(random.integers(2, 12))
        for grp in range(count):
            n = int(random.integers(50, 130))
            place = int(random.integers(0, ngram_join.prefix_length(n, 90)))
            rows.append((token, 100 * token + grp, n, place, count, None if random.integers(6) == 0 else int(random.integers(3))))
    expected = set()
    for a, b in itertools.combinations(rows, 2):
        other = a[5] is None or b[5] is None or a[5] != b[5]
        if a[0] == b[0] and other and min(a[2] - a[3], b[2] - b[3]) >= ngram_join.needed(a[2], b[2], 90):
            expected |= {(a[0], a[1], a[3]), (b[0], b[1], b[3])}
    postings = spark.createDataFrame(rows, "token long, grp long, n long, place long, groups long, class long")
    kept = [tuple(r) for r in ngram_join._feasible(postings, 90, block).select("token", "grp", "place").collect()]
    assert len(kept) == len(set(kept)) and set(kept) == expected and 0 < len(kept) < len(rows)


def test_texts_are_not_written(spark, monkeypatch):
    tables = {}
    write = ngram_join.written

    def noted(df, name):
        tables[name] = df.columns
        return write(df, name)

    monkeypatch.setattr(ngram_join, "written", noted)
    base = " ".join(f"w{n}" for n in range(100))
    docs = spark.createDataFrame([(1, base), (2, base + " x"), (3, base), (4, "lone words here")], "doc_id long, text string")
    assert found(docs, carry=["doc_id"]) == [(1, 98, 1), (2, 99, 1), (3, 98, 1), (4, 1, 4)]
    assert "ngram-sketches" in tables and not any("text" in columns for columns in tables.values())
