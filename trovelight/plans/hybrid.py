"""Hybrid search: both paths, fused, grouped, ordered, paged and explained."""

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovelight.operators import fusion, results
from trovelight.operators.keyword import keyword_search, normalise_query
from trovelight.operators.nearest import vector_search
from trovelight.plans.lineage import cut_lineage, written
from trovelight.plans.sizing import row_count_up_to
from trovelight.schemas import need
from trovelight.settings import DEFAULTS, Settings

logger = logging.getLogger(__name__)


def rank_assets(
    queries: DataFrame, keyword_hits: DataFrame, vector_hits: DataFrame, settings: Settings = DEFAULTS
) -> DataFrame:
    """The ordered assets of every query, at most `settings.max_assets` each.

    Scores are measured against the best unit before any filter, and the cap comes after all filters.

    Returns:
        (query_id, choices, asset_id, unit_id, best_unit_id, score, match, position, n_matches).
    """
    chosen = fusion.with_choices(queries).select("query_id", "collection", "q", *fusion.CHOICES)
    units = fusion.relative_score(fusion.fuse_units(keyword_hits, vector_hits))
    units = fusion.filter_units(units.join(chosen, "query_id"))
    matches = fusion.group_by_asset(units, "collection", "q", *fusion.CHOICES)
    matches = fusion.order_matches(fusion.filter_matches(matches))
    return fusion.cap_matches(matches, settings.max_assets)


def hybrid_search(
    queries: DataFrame,
    query_vectors: DataFrame,
    postings: DataFrame,
    units: DataFrame,
    vectors: DataFrame,
    assets: DataFrame,
    embed_sentences: Callable[[DataFrame], DataFrame] | None = None,
    relevance: Callable[[Column, Column], Column] | results.Scorer | None = results.word_share,
    settings: Settings = DEFAULTS,
    stem: bool = True,
    rank_digits: int | None = None,
    blocks: DataFrame | None = None,
    sentences_required: bool = False,
) -> DataFrame:
    """One page of assets for every query, in the order it chose.

    Args:
        queries: (query_id, collection, q) and any of `fusion.CHOICES`.
        query_vectors: (query_id, embedding, embedding_model).
        postings: From `build_postings`, with the same `stem`.
        units: (unit_id, asset_id, collection, asset_type, kind, start_char, end_char, body).
        vectors: Units with embedding and embedding_model.
        assets: Described assets.
        embed_sentences: The queries' model on rows with `text`; None marks no sentences. Where it fails none are
            marked, and `sentence_error` says so.
        relevance: The reranker, as a function of columns or as a model that is asked once for every
            query and text; None for none. Where a model fails, results keep their order.
        settings: Sizes.
        stem: Whether words are stemmed.
        rank_digits: Digits similarities are rounded to before ranking.
        blocks: The postings in blocks, where the index has them.
        sentences_required: Whether a sentence model that fails is an error of the search.

    Returns:
        (query_id, position, asset_id, filename, asset_type, score, match, relevance, snippet,
        has_more, title, description, visible_text, the closest sentence's offsets, and `sentence_error`: why
        the result, found by meaning, was not looked through for them).
    """
    need(queries, "query_id", "collection", "q")
    asked = queries.withColumn("q", normalise_query(F.col("q")))
    k = settings.units_per_path
    keyword_hits = keyword_search(
        asked, postings, units, k, stem, settings.max_broadcast_rows, settings.rows_per_part, blocks=blocks
    )
    with_vector = asked.select("query_id", "collection").join(query_vectors, "query_id")
    vector_hits = vector_search(
        with_vector,
        vectors,
        k,
        rank_digits,
        settings.max_broadcast_vectors,
        settings.units_per_cell,
        settings.queries_per_cell,
    )
    # At most `max_assets` narrow rows a query: the bodies are read in a step of their own.
    matches = cut_lineage(rank_assets(asked, keyword_hits, vector_hits, settings))

    # A page that starts among the candidates needs all of them: any may be sorted onto it.
    page_end = F.col("page") * settings.page_size
    page_start = page_end - settings.page_size
    first = F.when(page_start < settings.rerank_candidates, 0).otherwise(page_start)
    last = F.when(
        page_start < settings.rerank_candidates, F.greatest(F.lit(settings.rerank_candidates), page_end)
    ).otherwise(page_end)
    shown = matches.where((F.col("position") > first) & (F.col("position") <= last)).withColumn(
        "has_more", F.col("n_matches") > page_end
    )
    # The matches of a query are bounded, so the number of queries bounds them all.
    rows_per_query = settings.max_assets
    few = (
        row_count_up_to(asked.select("query_id"), settings.max_broadcast_rows // rows_per_query)
        is not None
    )
    found = results.fetch_results(shown, units, assets, few)
    if isinstance(relevance, results.Scorer):
        found = written(found, "candidates")
        relevance = relevance.scores(found, settings.rerank_candidates)
    found = results.rerank(
        found, relevance, settings.rerank_candidates, settings.page_size
    )
    failure = None
    if embed_sentences is not None:
        # A page of rows a query, read twice: for its sentences and to put them back.
        page = written(found, "page")
        try:
            found = written(
                results.closest_sentence(page, query_vectors, embed_sentences, rank_digits), "explained"
            )
        except Exception as error:
            if sentences_required:
                raise
            logger.warning("no sentences are marked: %s", error)
            failure = f"{type(error).__name__}: {error}"
            found, embed_sentences = page, None
    if embed_sentences is None:
        found = found.withColumns(
            {name: F.lit(None).cast("int") for name in ("sentence_start", "sentence_end")}
        )
    found = found.withColumn("sentence_error", F.when(F.col("match") == "semantic", F.lit(failure).cast("string")))
    return found.select(
        "query_id",
        "q",
        "order",
        "position",
        "asset_id",
        "unit_id",
        "filename",
        "asset_type",
        "title",
        "description",
        "visible_text",
        "score",
        "match",
        "relevance",
        "snippet",
        "sentence_start",
        "sentence_end",
        "sentence_error",
        "has_more",
    )
