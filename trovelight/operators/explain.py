"""Showing why a result matched: matches counted, excerpts cut around them, words marked."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovelight import fixed_values as fixed
from trovelight.functions import text as tx
from trovelight.schemas import need

ELLIPSIS = "…"


def count_matches(text: Column, query: Column) -> Column:
    """How often the query's words of two or more characters start a word of the text, in any case."""
    return tx.match_count(text, tx.marking_pattern(query))


def highlight_spans(text: Column, query: Column) -> Column:
    """The text in pieces: the first and every other one plain, those between them matches."""
    return tx.marked_pieces(text, tx.marking_pattern(query))


def excerpt_around(text: Column, query: Column, length: int) -> Column:
    """`length` characters from 40 before the first match, with an ellipsis where cut; null without."""
    return tx.let(
        F.struct(text.alias("text"), highlight_spans(text, query).alias("pieces")),
        lambda given: _excerpt(given["text"], given["pieces"], length),
    )


def _excerpt(text: Column, pieces: Column, length: int) -> Column:
    start = F.greatest(F.length(pieces[0]) - fixed.CONTEXT_BEFORE_MATCH, F.lit(0))
    return F.when(
        F.size(pieces) > 1,
        F.concat(
            F.when(start > 0, F.lit(ELLIPSIS)).otherwise(F.lit("")),
            F.substring(text, start + 1, F.lit(length)),
            F.when(start + length < F.length(text), F.lit(ELLIPSIS)).otherwise(F.lit("")),
        ),
    )


def passage_preview(results: DataFrame) -> DataFrame:
    """`preview`, what a result shows first, and `more_matches`, the matches it leaves out.

    A passage has an ellipsis before it unless it starts the file, and after it unless it ends a
    sentence. The preview starts at the closest sentence, else around the first match.
    """
    need(results, "q", "snippet", "sentence_start", "sentence_end")
    kind = F.col("snippet.kind")
    text = F.col("snippet.text")
    is_passage = kind == "content"
    opening = F.when(is_passage & (F.col("snippet.start_char") > 0), F.lit(ELLIPSIS)).otherwise(
        F.lit("")
    )
    closing = F.when(is_passage & ~tx.strip(text).rlike(r"[.!?]\z"), F.lit(ELLIPSIS)).otherwise(
        F.lit("")
    )
    framed = results.withColumn("_closing", closing).withColumn(
        "_full", F.concat(opening, text, closing)
    )
    has_sentence = F.col("sentence_start").isNotNull() & F.col("sentence_end").isNotNull()
    from_sentence = F.concat(
        F.when((F.col("sentence_start") > 0) | (opening != ""), F.lit(ELLIPSIS)).otherwise(
            F.lit("")
        ),
        F.substring(text, F.col("sentence_start") + 1, F.length(text)),
        F.col("_closing"),
    )
    around = F.when(
        kind.isin("content", "visible_text"),
        F.coalesce(excerpt_around(F.col("_full"), F.col("q"), fixed.PASSAGE_EXCERPT), "_full"),
    ).otherwise(F.col("_full"))
    shown = framed.withColumn("preview", F.when(has_sentence, from_sentence).otherwise(around))
    left_out = count_matches(F.col("_full"), F.col("q")) - count_matches(F.col("preview"), F.col("q"))
    return shown.withColumn(
        "more_matches", F.when(is_passage, left_out).otherwise(F.lit(0))
    ).drop("_full", "_closing")


def image_text_excerpt(results: DataFrame) -> DataFrame:
    """`image_text`: the part of an image's text around the first match, unless the snippet is that."""
    need(results, "q", "asset_type", "visible_text", "snippet")
    shows = (
        (F.col("asset_type") == "image")
        & (F.coalesce("visible_text", F.lit("")) != "")
        & (F.col("snippet.kind") != "visible_text")
    )
    return results.withColumn(
        "image_text",
        F.when(shows, excerpt_around(F.col("visible_text"), F.col("q"), fixed.IMAGE_TEXT_EXCERPT)),
    )
