"""The keyword path: query terms, matching units by words, scoring and ranking them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trovelight.functions import text as tx
from trovelight.functions.kinds import asset_type_of, kind_of, unit_code
from trovelight.functions.stem import stem_lists
from trovelight.operators.blockmax import best_by_blocks
from trovelight.plans.lineage import cut_lineage
from trovelight.plans.sizing import lookup, row_count_up_to
from trovelight.schemas import need
from trovelight.settings import DEFAULTS

# Scores are sums over terms, in whatever order rows arrive; rounding them makes equal sums equal, so
# the same query always gives the same order.
SCORE_DIGITS = 9

# Collections named in a filter on the postings; those of more are found by a join, which prunes folders as well.
MOST_PARTS = 1000
# Up to so many parsed queries are held by the driver while a search is planned.
MOST_PLANNED = 10_000

UNIT_COLUMNS = ["unit_id", "asset_id", "kind", "asset_type"]


def normalise_query(q: Column) -> Column:
    """Trimmed, runs of whitespace one space, case kept."""
    return tx.collapse(q)


def uses_search_syntax(q: Column) -> Column:
    """True when the query holds a quote, the word "or", or a word that starts with "-"."""
    return q.contains('"') | F.exists(
        tx.tokens(F.lower(q)), lambda word: (word == "or") | word.startswith("-")
    )


# What is asked of one word.
TERM = (
    "struct<alternative:int,literal:int,negated:boolean,kind:string,term:string,position:int>"
)


def parse_queries(queries: DataFrame, stem: bool = True) -> DataFrame:
    """One row per query with its words in an array; see `query_terms` for their meaning.

    Args:
        queries: (query_id, collection, q).
        stem: Stem the words, as the postings' words were.

    Returns:
        (query_id, collection, syntax, terms, n_terms, structured). n_terms counts the distinct words
        a unit should hold. A query is structured when single words do not describe it: it uses
        search syntax, or a token of it holds several words.
    """
    need(queries, "query_id", "collection", "q")
    # Pieces: an optional minus with a quoted part, or a run without whitespace and quotes.
    pieces = F.regexp_extract_all(
        F.lower("q"), F.lit(rf'-?"[^"]*"?|[^"{tx.SPACE[1:-1]}]+'), F.lit(0)
    )

    def terms_of(query):
        syntax, all_pieces = query["syntax"], query["pieces"]

        def literal(piece, place):
            parts_before = F.slice(all_pieces, F.lit(1), place)
            separators = F.size(F.filter(parts_before, lambda one: one == "or"))

            def placed(found):
                return F.filter(
                    F.transform(
                        found,
                        lambda word, position: F.when(
                            ~tx.is_stop_word(word),
                            F.struct(
                                F.when(syntax, separators).otherwise(0).alias("alternative"),
                                place.alias("literal"),
                                (syntax & piece.startswith("-")).alias("negated"),
                                F.when(syntax & piece.contains('"'), F.lit("phrase"))
                                .otherwise(F.lit("words"))
                                .alias("kind"),
                                word.alias("term"),
                                position.alias("position"),
                            ),
                        ),
                    ),
                    lambda term: term.isNotNull(),
                )

            return F.when(syntax & (piece == "or"), F.array().cast(f"array<{TERM}>")).otherwise(
                tx.let(tx.words(piece), placed)
            )

        return F.flatten(F.transform(all_pieces, literal))

    # Inside a lambda an expression is computed for every element, so what all need is bound first.
    query = F.struct(uses_search_syntax(F.col("q")).alias("syntax"), pieces.alias("pieces"))
    asked = F.filter("terms", lambda term: ~term["negated"])
    literals = F.transform("terms", lambda term: term["literal"])
    parsed = queries.select(
        "query_id",
        "collection",
        uses_search_syntax(F.col("q")).alias("syntax"),
        tx.let(query, terms_of).alias("terms"),
    )
    if stem:
        stems = parsed.withColumn("_stems", stem_lists(F.transform("terms", lambda t: t["term"])))
        parsed = stems.withColumn(
            "terms",
            F.zip_with("terms", "_stems", lambda term, to: term.withField("term", to)),
        ).drop("_stems")
    return parsed.withColumns(
        {
            "n_terms": F.size(F.array_distinct(F.transform(asked, lambda term: term["term"]))),
            "structured": F.col("syntax") | (F.size(F.array_distinct(literals)) < F.size("terms")),
        }
    )


def query_terms(queries: DataFrame, stem: bool = True) -> DataFrame:
    """The words of every query and what is asked of them, one row per word.

    Returns:
        (query_id, collection, syntax, alternative, literal, negated, kind, term, position).

        A plain query is a list of literals, one per typed token; a unit matches with any of them.
        A query with search syntax is a list of alternatives, cut at the word "or"; a unit matches
        with any alternative, and an alternative needs all its literals. A literal is a word, the
        words of one token (all needed), or a quoted phrase (at these positions, next to each other);
        a negated literal must not hold. Stop words vanish, but keep their place in a phrase.
    """
    return parse_queries(queries, stem).select(
        "query_id", "collection", "syntax", F.inline("terms")
    )


def _distinct_terms(parsed: DataFrame) -> DataFrame:
    """(query_id, collection, n_terms, term), every word of a query once."""
    terms = F.array_distinct(F.transform("terms", lambda term: term["term"]))
    return parsed.select("query_id", "collection", "n_terms", F.explode(terms).alias("term"))


def shard_column(shards: int) -> str:
    """The column that splits the postings of a collection; its name tells into how many parts."""
    return f"shard_of_{shards}"


def term_shard(term: Column, shards: int) -> Column:
    """The part of a collection's postings that holds a term."""
    return F.pmod(F.xxhash64(term), F.lit(shards)).cast("int")


def _shards(postings: DataFrame) -> dict[str, int]:
    """The shard column of the postings with its number of parts, if they have one."""
    names = [name for name in postings.columns if name.startswith("shard_of_")]
    return {name: int(name.removeprefix("shard_of_")) for name in names}


def _joined(postings: DataFrame, terms: DataFrame, small: bool, rows_per_part: int) -> DataFrame:
    """Postings with every query that asks for their term.

    The terms go to every machine when they fit. Otherwise both sides are shuffled by collection and
    term; a term with more than `rows_per_part` postings is cut into parts of about that size, and only
    such terms are repeated.
    """
    keys = ["collection", "term"]
    for name, shards in _shards(postings).items():
        terms = terms.withColumn(name, term_shard(F.col("term"), shards))
        keys.append(name)
    if small:
        return postings.join(F.broadcast(terms), keys)
    hot = (
        postings.groupBy(F.xxhash64("collection", "term").alias("_key"))
        .agg(F.ceil(F.count("*") / rows_per_part).cast("int").alias("_parts"))
        .where("_parts > 1")
    )
    parts = F.coalesce("_parts", F.lit(1))

    def in_parts(side: DataFrame, part: Column) -> DataFrame:
        known = side.withColumn("_key", F.xxhash64("collection", "term")).join(F.broadcast(hot), "_key", "left")
        return known.withColumn("_part", part).drop("_key", "_parts")

    spread = in_parts(postings, F.pmod(F.xxhash64("unit_id"), parts).cast("int"))
    repeated = in_parts(terms, F.explode(F.sequence(F.lit(0), parts - 1)))
    return spread.join(repeated, [*keys, "_part"]).drop("_part")


def _weight_of(tf: int) -> float:
    total = 0.0
    for j in range(1, tf + 1):
        total += 1.0 / (j * j)
    return total


def term_weight(tf: Column) -> Column:
    """The sum of 1 / j² for j = 1 … tf: more occurrences weigh more, each one less than the last.

    Most terms occur a few times in a passage, and for those the sum is written out.
    """
    weight = F.when(tf == 1, F.lit(1.0))
    for few in range(2, 9):
        weight = weight.when(tf == few, F.lit(_weight_of(few)))
    return weight.otherwise(
        F.aggregate(
            F.sequence(F.lit(1), tf), F.lit(0.0), lambda so_far, j: so_far + F.lit(1.0) / (j * j)
        )
    )


def _plain_matches(postings, parsed, small, rows_per_part, digits) -> DataFrame:
    """Units with any word of queries whose tokens are single words: one sum per unit and query."""
    sums = (
        _joined(postings.drop("positions"), _distinct_terms(parsed), small, rows_per_part)
        .groupBy("query_id", "unit_id")
        .agg(
            F.max("asset_id").alias("asset_id"),
            F.max(unit_code(F.col("kind"), F.col("asset_type"))).alias("_code"),
            F.max("n_terms").alias("n_terms"),
            F.count("*").alias("_held"),
            F.sum(term_weight(F.col("tf"))).alias("_weight"),
        )
    )
    return sums.select(
        "query_id",
        "unit_id",
        "asset_id",
        kind_of(F.col("_code")).alias("kind"),
        asset_type_of(F.col("_code")).alias("asset_type"),
        (F.col("_held") == F.col("n_terms")).alias("all_words"),
        F.round(F.col("_weight") / F.col("n_terms"), digits).alias("keyword_score"),
    )


def _alternatives(terms: Column) -> Column:
    """Terms as nested arrays: alternatives of literals of words."""

    def distinct(rows, name):
        return F.array_distinct(F.transform(rows, lambda row: row[name]))

    def literals(of_alternative):
        return F.transform(
            distinct(of_alternative, "literal"),
            lambda number: tx.let(
                F.filter(of_alternative, lambda row: row["literal"] == number),
                lambda rows: F.struct(
                    rows[0]["negated"].alias("negated"),
                    rows[0]["kind"].alias("kind"),
                    F.transform(
                        rows,
                        lambda row: F.struct(
                            row["term"].alias("term"), row["position"].alias("position")
                        ),
                    ).alias("terms"),
                ),
            ),
        )

    return F.transform(
        distinct(terms, "alternative"),
        lambda number: tx.let(
            F.filter(terms, lambda row: row["alternative"] == number), literals
        ),
    )


def _holds(literal: Column, places: Column) -> Column:
    """True when a unit, given as a map from term to positions, holds a literal."""
    in_a_row = F.aggregate(
        F.slice(literal["terms"], F.lit(2), F.greatest(F.size(literal["terms"]) - 1, F.lit(0))),
        F.transform(
            places[literal["terms"][0]["term"]], lambda at: at - literal["terms"][0]["position"]
        ),
        lambda starts, asked: F.array_intersect(
            starts, F.transform(places[asked["term"]], lambda at: at - asked["position"])
        ),
    )
    all_there = F.forall(literal["terms"], lambda asked: F.map_contains_key(places, asked["term"]))
    return all_there & ((literal["kind"] != "phrase") | (F.size(in_a_row) > 0))


def _excluding(asked: DataFrame) -> DataFrame:
    """The queries with an alternative of exclusions only, which units without any asked word satisfy."""
    only = F.exists("alternatives", lambda one: F.forall(one, lambda literal: literal["negated"]))
    return asked.where(F.col("syntax") & only).select("query_id", "collection")


def _structured_matches(postings, parsed, small, rows_per_part, digits, units, k) -> DataFrame:
    """Units that satisfy queries with phrases, exclusions, alternatives or tokens of several words.

    What a unit holds of a query's words, at most as many as the query has, is gathered in one row
    and the query's structure is read against it. The score counts the words asked for, in a query with
    search syntax those of the alternatives that hold; excluded words never count.

    Args:
        k: Where set, of the units that satisfy a query by holding none of its words only those that can
            be among its best `k` need to be found: all have score 0, so the ones with the smallest ids.
    """
    asked = parsed.select(
        "query_id",
        "collection",
        "syntax",
        "n_terms",
        _alternatives(F.col("terms")).alias("alternatives"),
    )
    held = (
        _joined(postings.drop("tf"), _distinct_terms(parsed), small, rows_per_part)
        .groupBy("query_id", *UNIT_COLUMNS)
        .agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("_places"))
    )
    if units is not None:
        held = held.unionByName(
            _without_words(units.select("collection", *UNIT_COLUMNS), _excluding(asked), held, k)
            .withColumn("_places", F.create_map().cast("map<string,array<int>>"))
        )

    places = F.col("_places")
    any_alternative = F.exists(
        "alternatives",
        lambda one: F.forall(one, lambda literal: _holds(literal, places) != literal["negated"]),
    )
    any_literal = F.exists(
        "alternatives", lambda one: F.exists(one, lambda literal: _holds(literal, places))
    )
    holding = F.filter(
        "alternatives",
        lambda one: F.forall(one, lambda literal: _holds(literal, places) != literal["negated"]),
    )
    asked_for = F.flatten(
        F.transform(
            F.filter(F.flatten(holding), lambda literal: ~literal["negated"]),
            lambda literal: F.transform(literal["terms"], lambda word: word["term"]),
        )
    )
    counted = F.when(F.col("syntax"), F.array_distinct(asked_for)).otherwise(F.map_keys(places))
    weight = F.aggregate(
        counted, F.lit(0.0), lambda so_far, term: so_far + term_weight(F.size(places[term]))
    )
    return (
        lookup(held, asked.drop("collection"), ["query_id"], fits_broadcast=small)
        .where(F.when(F.col("syntax"), any_alternative).otherwise(any_literal))
        .select(
            "query_id",
            *UNIT_COLUMNS,
            (F.col("syntax") | (F.size(places) == F.col("n_terms"))).alias("all_words"),
            F.round(weight / F.greatest("n_terms", F.lit(1)), digits).alias("keyword_score"),
        )
    )


def _without_words(units: DataFrame, queries: DataFrame, held: DataFrame, k: int | None) -> DataFrame:
    """(query_id, unit columns) of units that hold none of a query's words.

    All of them, or with `k` for every query its `k` with the smallest ids: first tried on the units with
    the smallest ids of each collection, and on all units for the queries that this is not enough for.
    """
    taken = held.select("query_id", "unit_id")

    def rest(some: DataFrame, of: DataFrame) -> DataFrame:
        pairs = lookup(some, of, ["collection"], fits_broadcast=True).select("query_id", *UNIT_COLUMNS)
        return pairs.join(taken, ["query_id", "unit_id"], "left_anti")

    if k is None or row_count_up_to(queries, DEFAULTS.max_broadcast_rows) is None:
        return lookup(units, queries, ["collection"]).select("query_id", *UNIT_COLUMNS).join(taken, ["query_id", "unit_id"], "left_anti")
    by_id = W.partitionBy("collection").orderBy("unit_id")
    # A partial limit of the ranks is taken where the units are read, so a large collection is no hot spot.
    first = units.withColumn("_rank", F.row_number().over(by_id)).where(F.col("_rank") <= 8 * k).drop("_rank")
    found = cut_lineage(rest(first, queries))
    # A query whose collection is smaller than that has all its units in it.
    whole = first.groupBy("collection").agg((F.count("*") < 8 * k).alias("_whole"))
    counts = found.groupBy("query_id").agg(F.count("*").alias("_n"))
    short = (
        queries.join(counts, "query_id", "left").join(whole, "collection", "left")
        .where((F.coalesce("_n", F.lit(0)) < k) & ~F.coalesce("_whole", F.lit(True)))
        .select("query_id", "collection")
    )
    short = cut_lineage(short)
    if short.isEmpty():
        return found
    return found.join(short, "query_id", "left_anti").unionByName(rest(units, short))


def match_units(
    queries: DataFrame,
    postings: DataFrame,
    units: DataFrame | None = None,
    stem: bool = True,
    max_broadcast_rows: int = DEFAULTS.max_broadcast_rows,
    rows_per_part: int = DEFAULTS.rows_per_part,
    digits: int = SCORE_DIGITS,
    k: int | None = None,
    blocks: DataFrame | None = None,
) -> DataFrame:
    """Every unit every query matches: (query_id, unit columns, all_words, keyword_score), unranked.

    The queries are parsed and counted while the result is planned; postings and units are only read by
    the result itself.

    Args:
        queries: (query_id, collection, q).
        postings: From `build_postings`, with the same `stem`.
        units: All units; only needed for queries that do nothing but exclude words.
        max_broadcast_rows: Query terms up to this number are broadcast, more are shuffled.
        rows_per_part: Postings of one term that a task joins when they are shuffled.
        digits: Digits scores are rounded to, so that sums in any order are equal.
        k: Units a query asks for, where it is known; spares exclusions from listing all others.
        blocks: The same postings from `build_blocks`. With these and `k`, queries whose tokens are single words only
            get units that can be among their best `k`, and postings that cannot matter are not decoded.
    """
    need(postings, "collection", "term", *UNIT_COLUMNS, "tf", "positions")
    # Read by every step below, and small: a row per query. Few are planned with where the driver is.
    parsed = parse_queries(queries, stem)
    held = parsed.limit(MOST_PLANNED + 1).toArrow()
    planned = held.num_rows <= MOST_PLANNED
    parsed = queries.sparkSession.createDataFrame(held, parsed.schema) if planned else cut_lineage(parsed)
    # The size check, on the queries alone: how many words they have, which forms are needed, and
    # which parts of the postings hold their words.
    shards = _shards(postings)
    words = parsed.select(
        "collection",
        "structured",
        F.explode_outer(F.transform("terms", lambda term: term["term"])).alias("term"),
    )
    asked = words.agg(
        F.count("term").alias("n_words"),
        F.bool_or("structured").alias("structured"),
        F.bool_or(~F.col("structured")).alias("plain"),
        *[F.collect_set(term_shard(F.col("term"), n)).alias(name) for name, n in shards.items()],
    ).first()
    small = asked.n_words <= max_broadcast_rows
    # As literals these reach the scan, and folders of other collections and shards are not listed.
    named = parsed.select("collection").distinct()
    if planned:
        few = sorted({name for name in held.column("collection").to_pylist() if name is not None})
    else:
        few = [row.collection for row in named.limit(MOST_PARTS + 1).collect()]
    if len(few) <= MOST_PARTS:
        postings = postings.where(F.col("collection").isin(few))
    elif small:
        postings = postings.join(F.broadcast(named), "collection", "left_semi")
    for name in shards:
        postings = postings.where(F.col(name).isin(asked[name]))
    any_plain, any_structured = asked.plain or not asked.structured, asked.structured

    found = []
    if any_plain:
        plain = parsed.where(~F.col("structured"))
        if blocks is not None and k is not None and small:
            found.append(best_by_blocks(_distinct_terms(plain), blocks, k, digits))
        else:
            found.append(_plain_matches(postings, plain, small, rows_per_part, digits))
    if any_structured:
        structured = parsed.where("structured")
        found.append(_structured_matches(postings, structured, small, rows_per_part, digits, units, k))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def keyword_search(
    queries: DataFrame,
    postings: DataFrame,
    units: DataFrame | None = None,
    k: int = DEFAULTS.units_per_path,
    stem: bool = True,
    max_broadcast_rows: int = DEFAULTS.max_broadcast_rows,
    rows_per_part: int = DEFAULTS.rows_per_part,
    digits: int = SCORE_DIGITS,
    blocks: DataFrame | None = None,
) -> DataFrame:
    """The best `k` units of every query: those with all its words first, then by score, then by id.

    Returns:
        (query_id, unit columns, all_words, keyword_score, rank), ranks from 1 without gaps.
    """
    matches = match_units(queries, postings, units, stem, max_broadcast_rows, rows_per_part, digits, k, blocks)
    best_first = W.partitionBy("query_id").orderBy(
        F.col("all_words").desc(), F.col("keyword_score").desc(), "unit_id"
    )
    return matches.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
