"""From two rankings to a page of results, against plain restatements over rankings drawn at random."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trovelight.operators import evaluate, fusion, results

HITS = (
    "query_id int, unit_id long, asset_id long, kind string, asset_type string, "
    "all_words boolean, rank int"
)
KINDS = ["content", "metadata", "filename"]
TIERS = {"exact": 0, "partial": 1, "semantic": 2}


def asset_of(unit):
    return unit % 7


@pytest.fixture(scope="module")
def rankings():
    """Two rankings for each of four queries: (unit, whether it holds all words) from best to worst."""
    random = np.random.default_rng(40)
    found = {}
    for query in range(4):
        keyword = random.permutation(30)[: int(random.integers(0, 20))].tolist()
        full = int(random.integers(0, len(keyword) + 1))
        vector = random.permutation(30)[: int(random.integers(1, 20))].tolist()
        found[query] = ([(unit, place < full) for place, unit in enumerate(keyword)], vector)
    return found


def table(spark, lists):
    rows = [
        (query, unit, asset_of(unit), KINDS[unit % 3], "text" if unit % 2 else "image", every, place)
        for query, units in lists.items()
        for place, (unit, every) in enumerate(units, 1)
    ]
    return spark.createDataFrame(rows, HITS)


@pytest.fixture(scope="module")
def units(spark, rankings):
    keyword = table(spark, {q: k for q, (k, _) in rankings.items()})
    vector = table(spark, {q: [(u, False) for u in v] for q, (_, v) in rankings.items()})
    return fusion.relative_score(fusion.fuse_units(keyword, vector))


def restated(rankings):
    """(query, unit) to its score, its share of the query's best score, and its kind of match."""
    found = {}
    for query, (keyword, vector) in rankings.items():
        scores, kinds = defaultdict(float), {}
        for place, unit in enumerate(vector, 1):
            scores[unit] += 1 / (60 + place)
            kinds[unit] = "semantic"
        for place, (unit, every) in enumerate(keyword, 1):
            scores[unit] += 1 / (60 + place)
            kinds[unit] = "exact" if every else "partial"
        top = max(scores.values())
        found |= {(query, unit): (score, score / top, kinds[unit]) for unit, score in scores.items()}
    return found


def assets_restated(fused):
    """(query, asset) to score, match, the unit shown and the best unit."""
    by_asset = defaultdict(list)
    for (query, unit), (_, score, kind) in fused.items():
        by_asset[query, asset_of(unit)].append((score, kind, unit))
    found = {}
    for key, members in by_asset.items():
        best = min(members, key=lambda m: (-m[0], m[2]))
        shown = min(members, key=lambda m: (TIERS[m[1]], -m[0], m[2]))
        found[key] = (best[0], shown[1], shown[2], best[2])
    return found


def test_fused_scores_and_kinds(units, rankings):
    found = {(r.query_id, r.unit_id): (r.score, r.match) for r in units.collect()}
    expected = restated(rankings)
    assert found.keys() == expected.keys()
    for key, (score, _, kind) in expected.items():
        assert found[key] == (pytest.approx(score), kind)


def test_assets_show_their_strongest_unit(units, rankings):
    rows = fusion.group_by_asset(units).collect()
    found = {(r.query_id, r.asset_id): (r.score, r.match, r.unit_id, r.best_unit_id) for r in rows}
    for key, (score, match, shown, best) in assets_restated(restated(rankings)).items():
        assert found.pop(key) == (pytest.approx(score), match, shown, best)
    assert not found


@pytest.mark.parametrize("types", [None, ["text"]])
@pytest.mark.parametrize("kinds", [None, ["metadata"], ["content", "filename"]])
def test_filters_take_units_and_leave_scores(units, rankings, types, kinds):
    def chosen(values):
        return (F.array(*[F.lit(v) for v in values]) if values else F.lit(None)).cast("array<string>")

    kept = fusion.filter_units(units.withColumns({"asset_types": chosen(types), "unit_kinds": chosen(kinds)}))
    expected = {
        key: score
        for key, (score, _, _) in restated(rankings).items()
        if (not types or ("text" if key[1] % 2 else "image") in types) and (not kinds or KINDS[key[1] % 3] in kinds)
    }
    assert {(r.query_id, r.unit_id): r.score for r in kept.collect()} == pytest.approx(expected)


@pytest.mark.parametrize("order", ["blended", "relevance", "exact_first", "tiered"])
def test_orders(units, rankings, order):
    tier = {"exact_first": lambda m: min(TIERS[m], 1), "tiered": lambda m: TIERS[m]}.get(order, lambda m: 0)
    grouped = fusion.group_by_asset(units).withColumn("order", F.lit(order))
    found = defaultdict(list)
    for r in fusion.order_matches(grouped).orderBy("query_id", "position").collect():
        found[r.query_id].append(r.asset_id)
    expected = defaultdict(list)
    for (query, asset), row in sorted(assets_restated(restated(rankings)).items(), key=lambda x: (x[0][0], tier(x[1][1]), -x[1][0], x[1][3])):
        expected[query].append(asset)
    assert found == expected


@pytest.mark.parametrize("page", [1, 2, 4, 9])
@pytest.mark.parametrize("cap", [5, 50])
def test_pages_cut_what_the_cap_leaves(spark, page, cap):
    rows = spark.range(1, 12).selectExpr("1 AS query_id", "id AS position", f"{page} AS page")
    shown = fusion.cap_and_page(rows, cap, 3).orderBy("position").collect()
    total = min(11, cap)
    assert [r.position for r in shown] == list(range(3 * page - 2, min(3 * page, total) + 1))
    assert all(r.has_more == (total > 3 * page) for r in shown)


# --- relevance ---------------------------------------------------------------------------------


def shown(spark, texts, order="relevance", page=1, match="semantic"):
    rows = [(3, 100 + n, "kelp", order, page, n, text, match) for n, text in texts]
    made = spark.createDataFrame(
        rows, "query_id int, asset_id int, q string, `order` string, page int, position int, t string, match string"
    )
    kind = "struct<kind:string,text:string,start_char:int,end_char:int>"
    return made.withColumn("snippet", F.struct(F.lit("metadata"), "t", F.lit(None), F.lit(None)).cast(kind))


def given(spark, scores):
    return spark.createDataFrame([("kelp", t, s) for t, s in scores.items()], "q string, text string, relevance double")


def in_order(rows):
    return [(r.t, r.relevance) for r in rows.orderBy("position").collect()]


@pytest.mark.parametrize("order", ["relevance", "tiered"])
def test_the_first_candidates_are_sorted_by_relevance(spark, order):
    random = np.random.default_rng(4)
    scores = {f"text {n}": float(s) for n, s in enumerate(random.permutation(12) / 12)}
    found = in_order(results.rerank(shown(spark, list(enumerate(scores, 1)), order), given(spark, scores), candidates=8, page_size=10))
    texts = list(scores)
    first = sorted(texts[:8], key=lambda t: -scores[t]) if order == "relevance" else texts[:8]
    assert found == [(t, scores[t]) for t in first] + [(t, None) for t in texts[8:10]]


def test_pages_are_cut_after_sorting_and_gaps_close(spark):
    texts = [(1, "kelp"), (3, "reef"), (4, "cove"), (6, "mast")]
    scores = given(spark, {"kelp": 0.1, "reef": 0.4, "cove": 0.2, "mast": 0.3})
    found = results.rerank(shown(spark, texts, page=2), scores, candidates=4, page_size=2)
    assert in_order(found) == [("cove", 0.2), ("kelp", 0.1)]
    beyond = results.rerank(shown(spark, texts, page=3).where("position > 4"), scores, candidates=4, page_size=2)
    assert in_order(beyond) == [("mast", None)]


def test_a_reranker_that_did_not_answer_changes_nothing(spark):
    rows = shown(spark, [(1, "kelp"), (2, "reef"), (3, "cove")])
    for relevance in (None, given(spark, {"reef": 0.9, "cove": 0.8})):
        assert in_order(results.rerank(rows, relevance)) == [("kelp", None), ("reef", None), ("cove", None)]


def test_what_the_cache_knows_is_not_asked_again(spark):
    asked = spark.sparkContext.accumulator(0)

    def score(pairs):
        def answer(batches):
            for batch in batches:
                asked.add(len(batch))
                yield batch.assign(relevance=batch["text"].str.len() / 100)

        return pairs.mapInPandas(answer, "model string, q string, text string, relevance double")

    cache = spark.createDataFrame([("m1", "kelp", "reef", 0.9)], "model string, q string, text string, relevance double")
    rows = shown(spark, [(1, "cove"), (2, "reef"), (3, "cove"), (4, "mast bay")])
    scores, new = results.rerank_cached(rows, cache, "m1", score)
    found = in_order(results.rerank(rows, scores))
    assert found == [("reef", 0.9), ("mast bay", 0.08), ("cove", 0.04), ("cove", 0.04)]
    assert sorted(r.text for r in new.collect()) == ["cove", "mast bay"]
    assert asked.value == 2
    assert results.rerank_cached(rows, cache, "m2", score)[1].count() == 3


def test_the_share_of_words(spark):
    df = spark.createDataFrame([("Kelp reef mast cove", "KELPER and unreefed")], "q string, t string")
    assert df.select(results.word_share(F.col("q"), F.col("t"))).first()[0] == pytest.approx(0.5)


def test_the_closest_sentence(spark):
    def embed(rows):
        counts = [F.length("text") - F.length(F.replace("text", F.lit(c))) for c in "kr"]
        return rows.withColumn("embedding", F.array(*counts).cast("array<float>"))

    vectors = spark.createDataFrame([(3, [0.0, 1.0])], "query_id int, embedding array<float>")
    text = "Kkk kk. Rr kr. Rrr rr. Rr."
    rows = shown(spark, [(1, text), (2, "Kk k."), (3, "?!")]).unionByName(
        shown(spark, [(4, text)], match="exact")
    )
    found = {
        r.asset_id: (r.sentence_start, r.sentence_end)
        for r in results.closest_sentence(rows, vectors, embed, 6).collect()
    }
    first = (text.index("Rrr"), text.index("Rrr") + len("Rrr rr."))
    assert found == {101: first, 102: (0, 5), 103: (None, None), 104: (None, None)}


# --- rows of results ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def stored(spark):
    kinds = ["content", "metadata", "image", "visible_text", "filename"]
    units = spark.createDataFrame(
        [("shore", 50 + n, kind, f"body {n}", n, n + 6) for n, kind in enumerate(kinds)],
        "collection string, unit_id int, kind string, body string, start_char int, end_char int",
    )
    assets = spark.createDataFrame(
        [("shore", n, f"{n}.txt", "text", f"title {n}", f"description {n}", f"shown {n}") for n in range(5)],
        "collection string, asset_id int, filename string, asset_type string, title string, description string, visible_text string",
    )
    matches = spark.createDataFrame(
        [(q, "shore", n, 50 + n) for q in (1, 2) for n in range(5)], "query_id int, collection string, asset_id int, unit_id int"
    )
    return matches, units, assets


@pytest.mark.parametrize("few", [True, False])
def test_snippets_by_kind(stored, few):
    rows = results.fetch_results(*stored, few).where("query_id = 2").collect()
    found = {r.asset_id: (r.filename, r.snippet.text, r.snippet.start_char, r.snippet.end_char) for r in rows}
    assert found == {
        0: ("0.txt", "body 0", 0, 6),
        1: ("1.txt", "description 1", None, None),
        2: ("2.txt", "description 2", None, None),
        3: ("3.txt", "shown 3", None, None),
        4: ("4.txt", "4.txt", None, None),
    }


@pytest.mark.parametrize("few", [True, False])
def test_assets_that_are_gone_drop_out(stored, few):
    matches, units, assets = stored
    rows = results.fetch_results(matches, units, assets.where("asset_id > 2"), few).collect()
    assert sorted((r.query_id, r.asset_id) for r in rows) == [(1, 3), (1, 4), (2, 3), (2, 4)]


def test_bodies_are_not_broadcast(stored):
    plan = results.fetch_results(*stored, True)._jdf.queryExecution().optimizedPlan().toString()
    hinted = [line for line in plan.splitlines() if "strategy=broadcast" in line]
    assert hinted and all("LeftSemi" in line and "rightHint" in line for line in hinted)


def test_unknown_kinds_are_an_error(stored):
    matches, units, assets = stored
    with pytest.raises(Exception, match="unknown unit kind"):
        results.fetch_results(matches, units.withColumn("kind", F.lit("page")), assets).collect()


def test_the_query_matrix_counts_what_was_expected(spark):
    places = spark.createDataFrame([(7, 1, 1), (7, 2, 21), (7, 3, 4), (8, 4, 2)], "query_id int, asset_id int, position int")
    expected = spark.createDataFrame(
        [(7, 1, "must_hit"), (7, 2, "must_hit"), (7, 3, "must_hit"), (7, 9, "must_hit"), (8, 4, "must_not_top"), (9, 1, "must_not_top")],
        "query_id int, asset_id int, expected string",
    )
    rows = {r.query_id: r for r in evaluate.query_matrix(places, expected).collect()}
    assert (rows[7].must_hit, rows[7].hits, rows[7].best_position, rows[7].recall) == (4, 2, 1, 0.5)
    assert [(rows[q].must_hit, rows[q].on_top, rows[q].recall) for q in (8, 9)] == [(0, 0, None), (0, 0, None)]


def test_texts_that_hold_an_item(spark):
    from trovelight.operators import evaluate

    docs = {
        1: "one two three four five six", 2: "xone two three four fivex", 3: "one two  three four five", 4: None, 5: "", 6: "a b",
        7: "bab a ba", 8: "two three", 9: "one two three four\nfive", 10: "two three four two three four five",
    }
    items = {1: "one two three four five", 2: "two three", 3: "ab a b", 4: "a", 5: "", 6: None, 7: "wo thre", 8: "one two three four\nfive", 9: "o t", 10: " two ", 11: "not there at all ever"}
    expected = sorted((d, i) for d, text in docs.items() for i, item in items.items() if text and item and item in text)
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(list(items.items()), "query_id long, text string")
    for options in ({}, {"max_broadcast_rows": 0, "rows_per_part": 2}):
        found = evaluate.texts_holding(table, asked, **options)
        assert sorted((r.doc_id, r.query_id) for r in found.collect()) == expected


def test_few_rows_that_nobody_asked_for_pass_the_filter(spark):
    from trovelight.plans.bloom import likely

    rows = spark.range(50_000).select(F.col("id").alias("unit_id"), F.lit("c").alias("collection"), F.concat(F.lit("body "), F.col("id")).alias("body"))
    asked = spark.range(0, 50_000, 97).select(F.lit("c").alias("collection"), F.col("id").alias("unit_id"))
    passed = likely(rows, ["collection", "unit_id"], asked, asked.count())
    assert passed.columns == rows.columns
    assert passed.join(asked, ["collection", "unit_id"]).count() == asked.count()
    assert passed.count() <= 2 * asked.count()


# --- sentence models that fail -----------------------------------------------------------------


def test_sentences_without_a_vector_are_an_error(spark):
    vectors = spark.createDataFrame([(3, [0.0, 1.0])], "query_id int, embedding array<float>")
    rows = shown(spark, [(1, "Kelp here. Reef there."), (3, "?!")])

    def vector(column):
        return lambda sentences: sentences.withColumn("embedding", column)

    filled = F.array(F.lit(1.0), F.lit(1.0)).cast("array<float>")
    some = F.when(F.col("start") == 0, filled)
    for embed in (
        vector(F.lit(None).cast("array<float>")),
        vector(some),
        lambda sentences: vector(filled)(sentences).where("start = 0"),
        lambda sentences: vector(filled)(sentences).where("false"),
    ):
        with pytest.raises(Exception, match="the model gave sentences no vector"):
            results.closest_sentence(rows, vectors, embed).collect()
    for wrong in (F.array(F.lit(1.0)), F.array(F.lit(float("nan")), F.lit(1.0))):
        with pytest.raises(Exception, match="cannot be compared"):
            results.closest_sentence(rows, vectors, vector(wrong.cast("array<float>"))).collect()
    # Results that come twice, and queries without a vector, are no failure.
    twice = results.closest_sentence(rows.unionByName(rows), vectors.unionByName(vectors), vector(filled)).collect()
    assert sorted((r.asset_id, r.sentence_start is None) for r in twice) == [(101, False)] * 2 + [(103, True)] * 2
    none = results.closest_sentence(rows, vectors.where("false"), vector(filled)).collect()
    assert {r.sentence_start for r in none} == {None}
