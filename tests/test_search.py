"""Both search paths against plain restatements of their rules, over texts and vectors drawn at random."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trovelight.operators import approximate, keyword, nearest
from trovelight.operators.units import assign_unit_ids, build_postings, build_units, embed_hashed_words

UNITS = "unit_id long, collection string, asset_id long, kind string, asset_type string, body string"
ASKED = "query_id long, collection string, q string"
# Words that are neither stop words nor changed by stemming, and one that is a stop word.
WORDS = ["kelp", "brim", "otter", "reef", "cove", "loam", "gull", "fern", "mast", "hull"]
STOP = "the"


@pytest.fixture(scope="module")
def bodies():
    """Unit bodies by id: runs of the words above, in two collections, one body missing."""
    random = np.random.default_rng(21)
    made = {}
    for n in range(1, 61):
        size = int(random.integers(1, 14))
        made[n] = " ".join(random.choice([*WORDS, STOP], size).tolist())
    made[17] = None
    return made


@pytest.fixture(scope="module")
def units(spark, bodies):
    rows = [(n, "shore" if n % 4 else "inland", n // 3, "content", "text", body) for n, body in bodies.items()]
    return spark.createDataFrame(rows, UNITS)


def weight(times):
    return sum(1 / (j * j) for j in range(1, times + 1))


class Plain:
    """One unit, and whether it satisfies a query given as alternatives of (negated, words, phrase)."""

    def __init__(self, body):
        self.words = (body or "").split()

    def holds(self, words, phrase):
        asked = [w for w in words if w != STOP]
        if not phrase:
            return all(w in self.words for w in asked)
        places = range(-len(words), len(self.words))
        return any(
            all(w == STOP or (0 <= at + i < len(self.words) and self.words[at + i] == w) for i, w in enumerate(words))
            for at in places
        )

    def score(self, asked):
        return sum(weight(self.words.count(w)) for w in set(asked) if w != STOP)

    def judge(self, alternatives):
        """Whether any alternative holds, and the score: words asked for by those that hold."""
        counted, total = set(), set()
        matched = False
        for literals in alternatives:
            literals = [x for x in literals if any(w != STOP for w in x[1])]
            asked = {w for negated, words, _ in literals if not negated for w in words if w != STOP}
            total |= asked
            if literals and all(self.holds(words, phrase) != negated for negated, words, phrase in literals):
                matched = True
                counted |= asked
        return matched, round(self.score(counted) / max(1, len(total)), 9)


def ranked(rows, k):
    """(unit, all_words, score) in the order of a keyword search."""
    return sorted(rows, key=lambda r: (not r[1], -r[2], r[0]))[:k]


def search(spark, units, query, k=100, **options):
    asked = spark.createDataFrame([(5, "shore", query)], ASKED)
    found = keyword.keyword_search(asked, build_postings(units, False), units, k, stem=False, **options)
    rows = found.orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    return [(r.unit_id, r.all_words, r.keyword_score) for r in rows]


FORMS = [
    ('"{0} {1}"', [[(False, "{0} {1}", True)]]),
    ('"{0} the {1}" {2}', [[(False, "{0} the {1}", True), (False, "{2}", False)]]),
    ("{0} -{1}", [[(False, "{0}", False), (True, "{1}", False)]]),
    ('{0} -"{1} {2}"', [[(False, "{0}", False), (True, "{1} {2}", True)]]),
    ("{0} OR {1} {2}", [[(False, "{0}", False)], [(False, "{1}", False), (False, "{2}", False)]]),
    ("{0} or {1} -{2}", [[(False, "{0}", False)], [(False, "{1}", False), (True, "{2}", False)]]),
    ("-{0} -{1}", [[(True, "{0}", False), (True, "{1}", False)]]),
    ("{0} or -{1}", [[(False, "{0}", False)], [(True, "{1}", False)]]),
]


@pytest.mark.parametrize("form", FORMS, ids=lambda form: form[0])
@pytest.mark.parametrize("options", [{}, {"max_broadcast_rows": 0, "rows_per_part": 5}], ids=["sent", "shuffled"])
def test_search_syntax_as_restated(spark, units, bodies, form, options):
    typed, shape = form
    words = np.random.default_rng(len(typed)).choice(WORDS, 3, replace=False).tolist()
    alternatives = [[(no, text.format(*words).split(), phrase) for no, text, phrase in one] for one in shape]
    expected = []
    for n, body in bodies.items():
        matched, score = Plain(body).judge(alternatives)
        if n % 4 and matched:
            expected.append((n, True, score))
    assert search(spark, units, typed.format(*words), **options) == ranked(expected, 100)


@pytest.mark.parametrize("options", [{}, {"max_broadcast_rows": 0, "rows_per_part": 5}], ids=["sent", "shuffled"])
@pytest.mark.parametrize("asked", [["kelp"], ["reef", "gull", "nowhere"], ["otter", "the", "mast"]])
def test_plain_queries_as_restated(spark, units, bodies, asked, options):
    needed = [w for w in asked if w != STOP]
    expected = []
    for n, body in bodies.items():
        unit = Plain(body)
        held = [w for w in needed if w in unit.words]
        if n % 4 and held:
            expected.append((n, len(held) == len(needed), round(unit.score(needed) / len(needed), 9)))
    assert search(spark, units, " ".join(asked), k=7, **options) == ranked(expected, 7)


def test_exclusions_alone_find_the_first_units_without_the_word(spark):
    rows = spark.range(1, 400).select(
        F.col("id").alias("unit_id"), F.lit("shore").alias("collection"), F.lit(1).cast("long").alias("asset_id"),
        F.lit("content").alias("kind"), F.lit("text").alias("asset_type"),
        F.when((F.col("id") < 90) | (F.col("id") % 2 == 0), "kelp reef").otherwise("reef").alias("body"),
    )
    # More of the first units hold the word than are looked at first.
    assert [unit for unit, _, _ in search(spark, rows, "-kelp", k=4)] == [91, 93, 95, 97]
    assert [unit for unit, _, _ in search(spark, rows, "-fern", k=4)] == [1, 2, 3, 4]
    assert search(spark, rows, "-reef", k=4) == []


def test_stemmed_words_meet(spark):
    rows = spark.createDataFrame([(1, "shore", 1, "content", "text", "Ferns growing"), (2, "shore", 1, "content", "text", "grow")], UNITS)
    asked = spark.createDataFrame([(1, "shore", "fern grows")], ASKED)
    found = keyword.keyword_search(asked, build_postings(rows), rows).orderBy("rank").collect()
    assert [(r.unit_id, r.all_words) for r in found] == [(1, True), (2, False)]


def test_parts_of_a_token_belong_together(spark):
    rows = [(1, "kelp-reef map"), (2, "reef of a map"), (3, "kelp")]
    table = spark.createDataFrame([(n, "shore", 1, "content", "text", body) for n, body in rows], UNITS)
    assert {unit for unit, _, _ in search(spark, table, "reef-kelp")} == {1}
    assert {unit for unit, _, _ in search(spark, table, "map reef-kelp")} == {1, 2}


@pytest.mark.parametrize("query", ["kelp ~^{}", "kelp <->", "kelp %_", "kelp\\", "{kelp}", "kelp -"])
def test_signs_are_no_words(spark, query):
    rows = spark.createDataFrame([(1, "shore", 1, "content", "text", "kelp")], UNITS)
    assert [unit for unit, _, _ in search(spark, rows, query)] == [1]


@pytest.mark.parametrize("query", ["", " ", "%%", '""', "the", "or or", "--"])
def test_nothing_asked_finds_nothing(spark, query):
    rows = spark.createDataFrame([(1, "shore", 1, "content", "text", "kelp the reef")], UNITS)
    assert search(spark, rows, query) == []


# --- vectors -----------------------------------------------------------------------------------

VECTORS = (
    "unit_id long, asset_id long, collection string, kind string, asset_type string, "
    "embedding array<float>, embedding_model string"
)
QUERY = "query_id long, collection string, embedding array<float>, embedding_model string"


def table_of(spark, matrix, spaces):
    rows = [
        (n, n // 2, *spaces[n % len(spaces)][:1], "content", "text", row.tolist(), *spaces[n % len(spaces)][1:])
        for n, row in enumerate(matrix)
    ]
    return spark.createDataFrame(rows, VECTORS)


def queries_of(spark, matrix, space):
    return spark.createDataFrame([(n, space[0], row.tolist(), space[1]) for n, row in enumerate(matrix)], QUERY)


def cosine(a, b):
    lengths = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
    product = a.astype(float) @ b.astype(float).T
    return np.divide(product, lengths, out=np.zeros_like(product), where=lengths > 0)


def lists(hits):
    result = {}
    for row in hits.orderBy("query_id", "rank").collect():
        result.setdefault(row.query_id, []).append(row.unit_id)
    return result


@pytest.fixture(scope="module")
def space():
    """Vectors with copies, zeros and opposites; every third row is of another model, every fourth elsewhere."""
    random = np.random.default_rng(31)
    matrix = random.standard_normal((480, 12)).astype(np.float32)
    matrix[::5] = matrix[0]
    matrix[7] = 0
    matrix[8] = -matrix[0]
    asked = np.concatenate([matrix[[0, 9]], np.zeros((1, 12), np.float32), random.standard_normal((6, 12)).astype(np.float32)])
    return matrix, asked


SPACES = [("shore", "m"), ("shore", "other"), ("inland", "m")]


@pytest.mark.parametrize("options", [{}, {"max_broadcast_vectors": 0, "units_per_cell": 25, "queries_per_cell": 2}], ids=["sent", "cells"])
def test_vectors_as_brute_force(spark, space, options):
    matrix, asked = space
    mine = np.array([n for n in range(len(matrix)) if SPACES[n % 3] == ("shore", "m")])
    scores = np.round(cosine(asked, matrix[mine]), 6)
    expected = {n: mine[np.lexsort((mine, -row))][:40].tolist() for n, row in enumerate(scores)}
    found = nearest.vector_search(queries_of(spark, asked, SPACES[0]), table_of(spark, matrix, SPACES), 40, rank_digits=6, **options)
    assert lists(found) == expected


def test_units_and_queries_without_vectors_are_left_out(spark):
    rows = spark.createDataFrame([(1, 1, "shore", "content", "text", None, "m"), (2, 1, "shore", "content", "text", [1.0], "m")], VECTORS)
    asked = spark.createDataFrame([(1, "shore", [1.0], "m"), (2, "shore", None, "m")], QUERY)
    assert lists(nearest.vector_search(asked, rows)) == {1: [2]}


def test_the_best_so_far_does_not_depend_on_the_batches():
    from trovelight.functions.vectors import NearestSoFar

    random = np.random.default_rng(2)
    vectors = random.integers(-3, 4, (200, 4)).astype(float)
    asked = random.standard_normal((5, 4))
    units = np.column_stack([np.arange(200), np.arange(200), np.zeros(200, int)])
    order = random.permutation(200)
    found = []
    for parts in (1, 13):
        nearest_so_far = NearestSoFar(asked, 9, 6)
        for part in np.array_split(order if parts > 1 else np.arange(200), parts):
            nearest_so_far.add(units[part], vectors[part])
        found.append({q: rows[:, 0].tolist() for q, _, rows in nearest_so_far.rows()})
    assert found[0] == found[1]


def test_units_stay_where_they_are_past_the_broadcast_bound(spark, space):
    matrix, asked = space
    found = nearest.vector_search(queries_of(spark, asked, SPACES[0]), table_of(spark, matrix, SPACES), 5, max_broadcast_vectors=0, queries_per_cell=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert exchanges and all("hashpartitioning(query_id" in line for line in exchanges)


def test_far_blocks_are_left_out_of_the_product():
    from trovelight.functions import vectors

    random = np.random.default_rng(4)
    near = np.array([1.0, 0, 0]) + 0.01 * random.standard_normal((50, 3))
    far = np.array([-1.0, 0, 0]) + 0.01 * random.standard_normal((50, 3))
    nearest_so_far = vectors.NearestSoFar(np.array([[1.0, 0, 0]]), 10, None)
    units = np.column_stack([np.arange(50)] * 3)
    nearest_so_far.add(units, near)
    assert not (nearest_so_far._reach(far) >= nearest_so_far.bars).any()
    assert (nearest_so_far._reach(near) >= nearest_so_far.bars).all()


def sparse_of(spark, matrix, key):
    rows = [(n, int(b), float(w)) for n, row in enumerate(matrix) for b, w in enumerate(row) if w]
    return spark.createDataFrame(rows, f"{key} long, bucket int, weight float")


@pytest.mark.parametrize("options", [{}, {"max_broadcast_vectors": 2}])
def test_sparse_vectors_as_dense_ones(spark, options):
    random = np.random.default_rng(12)
    matrix = (random.random((300, 40)) < 0.06) * random.integers(1, 5, (300, 40)).astype(np.float32)
    matrix[matrix.sum(axis=1) == 0, 0] = 1
    matrix[::7] = matrix[0]
    asked = (random.random((5, 40)) < 0.1) * random.integers(-2, 5, (5, 40)).astype(np.float32)
    asked[asked.any(axis=1) == 0, 1] = 1
    scores = np.round(cosine(asked, matrix), 6)
    expected = {n: np.lexsort((np.arange(300), -row))[:120].tolist() for n, row in enumerate(scores)}
    space = [("shore", "m")]
    units = table_of(spark, matrix, space).drop("embedding")
    queries = queries_of(spark, asked, space[0]).drop("embedding")
    found = nearest.vector_search_sparse(queries, sparse_of(spark, asked, "query_id"), units, sparse_of(spark, matrix, "unit_id"), 40, 120, rank_digits=6, **options)
    # 120 of 300 reach into the units that share no place with a query.
    assert (scores == 0).any() and lists(found) == expected


def test_the_approximate_search_finds_nine_tenths_in_full_lists(spark, space, tmp_path):
    matrix, asked = space
    everywhere = [("shore", "m")]
    scores = np.round(cosine(asked, matrix), 6)
    exact = {n: np.lexsort((np.arange(len(matrix)), -row))[:60].tolist() for n, row in enumerate(scores)}
    index = approximate.build_vector_lists(table_of(spark, matrix, everywhere), str(tmp_path / "lists"), 60, units_per_cell=100)
    assert index.codes.count() == len(matrix)
    found = lists(approximate.vector_search_approx(queries_of(spark, asked, everywhere[0]), index, 60, rank_digits=6))
    assert {query: len(units) for query, units in found.items()} == dict.fromkeys(exact, 60)
    with_length = [q for q in exact if asked[q].any()]
    assert np.mean([len(set(found[q]) & set(exact[q])) / 60 for q in with_length]) >= 0.9
    # Fewer units than asked for: all of them, in the exact order; past the broadcast bound too.
    index = approximate.build_vector_lists(table_of(spark, matrix[:30], everywhere), str(tmp_path / "few"))
    scores = np.round(cosine(asked[:2], matrix[:30]), 6)
    for options in ({}, {"max_broadcast_rows": 0, "max_broadcast_vectors": 1}):
        few = lists(approximate.vector_search_approx(queries_of(spark, asked[:2], everywhere[0]), index, 60, rank_digits=6, **options))
        assert few == {n: np.lexsort((np.arange(30), -row)).tolist() for n, row in enumerate(scores)}


def test_spaces_without_units_and_no_units_at_all(spark, space, tmp_path):
    matrix, asked = space
    index = approximate.build_vector_lists(table_of(spark, matrix[:40], SPACES), str(tmp_path / "lists"), 5)
    assert index.models.count() == 3
    assert approximate.vector_search_approx(queries_of(spark, asked, ("nowhere", "m")), index, 5).count() == 0
    index = approximate.build_vector_lists(table_of(spark, matrix[:0], SPACES), str(tmp_path / "none"), 5)
    assert approximate.vector_search_approx(queries_of(spark, asked, SPACES[0]), index, 5).count() == 0


def test_a_query_scores_few_codes_of_a_large_space(spark, tmp_path):
    # Forty clusters: what a query needs lies in few lists.
    random = np.random.default_rng(6)
    centres = random.standard_normal((40, 16))
    matrix = np.concatenate([c + 0.2 * random.standard_normal((100, 16)) for c in centres]).astype(np.float32)
    asked = (centres[:10] + 0.1 * random.standard_normal((10, 16))).astype(np.float32)
    queries = queries_of(spark, asked, ("shore", "m"))
    index = approximate.build_vector_lists(table_of(spark, matrix, [("shore", "m")]), str(tmp_path / "lists"), 50)
    counted = spark.sparkContext.accumulator(0)
    approximate._candidates(queries, index, 200, 50, 100, counted).count()
    assert counted.value <= 0.2 * len(matrix) * len(asked)
    found = lists(approximate.vector_search_approx(queries, index, 50))
    scores = cosine(asked, matrix)
    assert np.mean([len(set(found[q]) & set(np.argsort(-scores[q])[:50])) / 50 for q in range(10)]) >= 0.9


def test_the_registered_approximate_search_finds_nine_tenths(spark):
    from checks.registered import QUERIES
    from checks.views import Views

    views = Views(spark, "/root/testdata/sf0.01")
    exact = lists(nearest.vector_search(views.query_vectors(), views.index().vectors, rank_digits=6))
    found = lists(QUERIES["g5_vector_search_approx"](views))
    assert {query: len(units) for query, units in found.items()} == {query: len(units) for query, units in exact.items()}
    assert np.mean([len(set(found[query]) & set(units)) / len(units) for query, units in exact.items()]) >= 0.9


def test_hashed_words_count_words(spark):
    texts = {1: "reef kelp reef", 2: "Kelp; REEF? reef!", 3: "gull", 4: "--", 5: None}
    rows = spark.createDataFrame(list(texts.items()), "id int, body string")
    found = {r.id: r for r in embed_hashed_words(rows, dims=512).collect()}
    assert found[1].embedding == found[2].embedding != found[3].embedding
    assert np.linalg.norm(found[1].embedding) == pytest.approx(1)
    assert [found[n].embedding_model for n in (3, 4, 5)] == ["hashed-512", None, None]
    assert found[4].embedding is None and found[5].embedding is None


# --- units -------------------------------------------------------------------------------------


def test_units_of_every_kind(spark):
    assets = spark.createDataFrame(
        [
            (8, "shore", "image", "cove-2.png", "A cove", "Water and rock.", ["water"], "KEEP OUT"),
            (9, "shore", "text", "log.txt", "A log", "Days at sea.", ["sea", "log"], None),
        ],
        "asset_id long, collection string, asset_type string, filename string, title string, "
        "description string, tags array<string>, visible_text string",
    )
    chunks = spark.createDataFrame([(9, "shore", 0, 0, 4, "Rain"), (9, "shore", 1, 5, 9, "Wind")], "asset_id long, collection string, unit_index int, start_char int, end_char int, text string")
    rows = build_units(assets, chunks).collect()
    found = {(r.asset_id, r.kind, r.unit_index): r.body for r in rows}
    assert found == {
        (8, "metadata", 0): "A cove\n\nWater and rock.\n\ntags: water",
        (8, "filename", 0): "cove-2.png cove 2 png",
        (8, "image", 0): None,
        (8, "visible_text", 0): "KEEP OUT",
        (9, "metadata", 0): "A log\n\nDays at sea.\n\ntags: sea, log",
        (9, "filename", 0): "log.txt log txt",
        (9, "content", 0): "Rain",
        (9, "content", 1): "Wind",
    }
    by_id = sorted(rows, key=lambda r: r.unit_id)
    assert [r.asset_id for r in by_id] == sorted(r.asset_id for r in rows)


def test_ids_that_do_not_fit_are_refused(spark):
    rows = spark.range(1).select(F.col("id").alias("asset_id"), F.lit("content").alias("kind"), F.lit(100_000).alias("unit_index"))
    with pytest.raises(Exception, match="no unit id"):
        assign_unit_ids(rows).collect()


def test_stop_words_keep_their_places_in_postings(spark, units, bodies):
    found = {(r.unit_id, r.term): (r.tf, list(r.positions)) for r in build_postings(units, False).collect()}
    expected = {}
    for n, body in bodies.items():
        for at, word in enumerate((body or "").split(), 1):
            if word != STOP:
                times, places = expected.get((n, word), (0, []))
                expected[n, word] = (times + 1, [*places, at])
    assert found == expected
