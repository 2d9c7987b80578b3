"""From two ranked lists of units to one ordered list of assets per query."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trovelight.fixed_values import RRF_K
from trovelight.schemas import need
from trovelight.settings import DEFAULTS

UNIT_COLUMNS = ["unit_id", "asset_id", "kind", "asset_type"]

# What a query may choose, and what it gets when it does not.
CHOICES = {
    "order": "string",
    "page": "int",
    "match_kinds": "array<string>",
    "asset_types": "array<string>",
    "unit_kinds": "array<string>",
}


def with_choices(queries: DataFrame) -> DataFrame:
    """Queries with every choice as a column: order "relevance", page 1 and no filter by default."""
    missing = {name: kind for name, kind in CHOICES.items() if name not in queries.columns}
    filled = queries.withColumns({n: F.lit(None).cast(kind) for n, kind in missing.items()})
    return filled.withColumns(
        {
            "order": F.coalesce("order", F.lit("relevance")),
            "page": F.coalesce("page", F.lit(1)),
        }
    )


def reciprocal_rank(rank: Column) -> Column:
    """What a place in one list adds to a unit's score; nothing when the list does not hold it."""
    return F.coalesce(F.lit(1.0) / (RRF_K + rank), F.lit(0.0))


def match_kind(in_keyword: Column, all_words: Column) -> Column:
    """"exact" with every word, "partial" with some, "semantic" when only the vectors found it."""
    return (
        F.when(in_keyword & all_words, F.lit("exact"))
        .when(in_keyword, F.lit("partial"))
        .otherwise(F.lit("semantic"))
    )


def match_tier(match: Column) -> Column:
    """0 for the strongest kind of match."""
    return F.when(match == "exact", 0).when(match == "partial", 1).otherwise(2)


def fuse_units(keyword_hits: DataFrame, vector_hits: DataFrame) -> DataFrame:
    """Every unit either path found, scored by reciprocal rank fusion.

    Args:
        keyword_hits: (query_id, unit columns, all_words, rank).
        vector_hits: (query_id, unit columns, rank).

    Returns:
        (query_id, unit columns, keyword_rank, vector_rank, score, match).
    """
    # Both lists laid under each other and grouped: one exchange, where a full outer join takes two.
    both = keyword_hits.select(
        "query_id",
        *UNIT_COLUMNS,
        "all_words",
        F.col("rank").alias("keyword_rank"),
        F.lit(None).cast("int").alias("vector_rank"),
    ).unionByName(
        vector_hits.select(
            "query_id",
            *UNIT_COLUMNS,
            F.lit(False).alias("all_words"),
            F.lit(None).cast("int").alias("keyword_rank"),
            F.col("rank").alias("vector_rank"),
        )
    )
    return (
        both.groupBy("query_id", *UNIT_COLUMNS)
        .agg(
            F.bool_or("all_words").alias("_all_words"),
            F.min("keyword_rank").alias("keyword_rank"),
            F.min("vector_rank").alias("vector_rank"),
        )
        .select(
            "query_id",
            *UNIT_COLUMNS,
            "keyword_rank",
            "vector_rank",
            (
                reciprocal_rank(F.col("keyword_rank")) + reciprocal_rank(F.col("vector_rank"))
            ).alias("score"),
            match_kind(F.col("keyword_rank").isNotNull(), F.col("_all_words")).alias("match"),
        )
    )


def relative_score(units: DataFrame) -> DataFrame:
    """`relative_score`: a unit's score over the best of its query. To be taken before any filter."""
    need(units, "query_id", "score")
    best = F.max("score").over(W.partitionBy("query_id"))
    return units.withColumn("relative_score", F.col("score") / best)


def _chosen(value: Column, choice: Column) -> Column:
    return choice.isNull() | F.array_contains(choice, value)


def filter_units(units: DataFrame) -> DataFrame:
    """Units of the asset types and parts their query chose; a null choice keeps all."""
    need(units, "kind", "asset_type", "asset_types", "unit_kinds")
    return units.where(
        _chosen(F.col("asset_type"), F.col("asset_types"))
        & _chosen(F.col("kind"), F.col("unit_kinds"))
    )


def group_by_asset(units: DataFrame, *keep: str) -> DataFrame:
    """One match per query and asset.

    Returns:
        (query_id, asset_id, *keep, unit_id, best_unit_id, score, match). The score is that of the
        best unit; the match is the strongest of all units, and unit_id, the unit to show, the best
        of those that match that strongly. best_unit_id breaks ties between assets.
    """
    need(units, "query_id", "asset_id", "unit_id", "relative_score", "match", *keep)
    tier = match_tier(F.col("match"))
    strongest = F.struct(tier, -F.col("relative_score"), F.col("unit_id"))
    best = F.struct(-F.col("relative_score"), F.col("unit_id"))
    return units.groupBy("query_id", "asset_id").agg(
        *[F.first(name).alias(name) for name in keep],
        F.min_by("unit_id", strongest).alias("unit_id"),
        F.min_by("unit_id", best).alias("best_unit_id"),
        F.max("relative_score").alias("score"),
        F.min_by("match", strongest).alias("match"),
    )


def filter_matches(matches: DataFrame) -> DataFrame:
    """Assets whose strongest match is of a kind their query chose; a null choice keeps all."""
    need(matches, "match", "match_kinds")
    return matches.where(_chosen(F.col("match"), F.col("match_kinds")))


def order_matches(matches: DataFrame) -> DataFrame:
    """`position`: the place of an asset in the order its query chose, from 1.

    "exact_first" puts exact matches first, "tiered" sorts by kind of match, "blended" and
    "relevance" by score alone; assets of one tier keep their score order.
    """
    need(matches, "query_id", "order", "match", "score", "best_unit_id")
    tier = match_tier(F.col("match"))
    group = (
        F.when(F.col("order") == "exact_first", F.least(tier, F.lit(1)))
        .when(F.col("order") == "tiered", tier)
        .otherwise(0)
    )
    in_order = W.partitionBy("query_id").orderBy(group, F.col("score").desc(), "best_unit_id")
    return matches.withColumn("position", F.row_number().over(in_order))


def cap_matches(matches: DataFrame, cap: int = DEFAULTS.max_assets) -> DataFrame:
    """The first `cap` assets of every query: how many results a query has at all.

    `n_matches` counts them, per query.
    """
    need(matches, "query_id", "position")
    return matches.where(F.col("position") <= cap).withColumn(
        "n_matches", F.count("*").over(W.partitionBy("query_id")).cast("int")
    )


def cap_and_page(
    matches: DataFrame, cap: int = DEFAULTS.max_assets, page_size: int = DEFAULTS.page_size
) -> DataFrame:
    """The page every query asked for, of its first `cap` assets; `has_more` when others follow."""
    need(matches, "query_id", "position", "page")
    page_end = F.col("page") * page_size
    return (
        cap_matches(matches, cap)
        .withColumn("has_more", F.col("n_matches") > page_end)
        .where((F.col("position") > page_end - page_size) & (F.col("position") <= page_end))
    )
