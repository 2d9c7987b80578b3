"""Text as columns: whitespace, words, tokens, search terms, sentences and marked matches.

All of it runs in the JVM. Patterns are spelled out rather than left to `\\s` and `\\b`, which mean
different characters in different engines.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from trovelight.fixed_values import SHORTEST_MARKED_WORD, STOP_WORDS

# Every character with the Unicode property White_Space, and the four ASCII separators.
SPACE = (
    r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
NOT_SPACE = SPACE.replace("[", "[^", 1)

# Runs of letters and digits: what a posting and a query term are made of.
WORD = r"[\p{L}\p{N}]+"
# The same with the underscore: what the hashed bag of words is made of.
WORD_OR_UNDERSCORE = r"[\p{L}\p{N}_]+"

# Characters that Unicode sets aside as "not a character", so no text holds them.
HIDDEN_DOT = "\ufdd0"
CUT = "\ufdd1"


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often `body` reads it.

    Inside a lambda nothing is shared between calls, so an array that every call reads has to be
    bound first.
    """
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Without the whitespace at both ends."""
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def collapse(text: Column) -> Column:
    """Stripped, and every run of whitespace one space."""
    return strip(F.regexp_replace(text, f"{SPACE}+", " "))


def tokens(text: Column) -> Column:
    """The pieces between whitespace."""
    return F.regexp_extract_all(text, F.lit(f"{NOT_SPACE}+"), F.lit(0))


def words(text: Column) -> Column:
    """Runs of letters and digits, lower-case, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def hashed_words(text: Column) -> Column:
    """Runs of letters, digits and underscores, lower-case, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_OR_UNDERSCORE), F.lit(0))


def is_stop_word(word: Column) -> Column:
    return word.isin(STOP_WORDS)


def has_word(text: Column) -> Column:
    """True when the text holds a letter or a digit."""
    return text.rlike(r"[\p{L}\p{N}]")


# --- marked matches ----------------------------------------------------------------------------


def marking_pattern(query: Column) -> Column:
    """A pattern for any query word of two or more characters at the start of a word, in any case.

    Null when no word is long enough. A word starts where an ASCII letter, digit or underscore
    meets anything else, as it does in a browser.
    """
    long_words = F.filter(tokens(query), lambda w: F.length(w) >= SHORTEST_MARKED_WORD)
    escaped = F.transform(
        long_words, lambda w: F.regexp_replace(w, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    )
    word_edge = (
        "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
    )
    return F.when(
        F.size(long_words) > 0,
        F.concat(F.lit(f"(?iu){word_edge}("), F.array_join(escaped, "|"), F.lit(")")),
    )


def marked_pieces(text: Column, pattern: Column) -> Column:
    """The text cut at its matches: even places of the array are plain, odd places are matches."""
    cut = F.regexp_replace(text, pattern, F.lit(f"{CUT}$1{CUT}"))
    return F.when(pattern.isNull(), F.array(text)).otherwise(F.split(cut, CUT, -1))


def match_count(text: Column, pattern: Column) -> Column:
    return F.when(pattern.isNull(), F.lit(0)).otherwise(F.regexp_count(text, pattern))


# --- sentences ---------------------------------------------------------------------------------

# Before a name or a number these never end a sentence.
TITLES = "Mr|Mrs|Ms|Dr|Prof|St|Mt|Gen|Col|Capt|Lt|Sgt|Gov|Sen|Rep|Rev|Hon|Jr|Sr|No|Fig|vs|e\\.g|i\\.e"
# These end one only when a capital follows.
SHORTENED = (
    "etc|Inc|Ltd|Co|Corp|Bros|dept|Dept|est|approx|min|max|Ave|Blvd|Rd|a\\.m|p\\.m|"
    "Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec"
)

# (pattern, replacement), applied in this order; every pattern is plain RE2 without look-around. A dot
# that does not end a sentence is hidden behind one other character, so that offsets stay right.
SENTENCE_RULES = [
    # The number of a list item at the start of a line.
    (r"(^|[\n\r])([ \t]*[0-9]{1,3})\.([ \t])", rf"$1$2{HIDDEN_DOT}$3"),
    (rf"\b({TITLES})\.", rf"$1{HIDDEN_DOT}"),
    (rf"\b({SHORTENED})\.({SPACE}+[\p{{Ll}}0-9])", rf"$1{HIDDEN_DOT}$2"),
    # Initials.
    (r"\b([A-Z])\.( )", rf"$1{HIDDEN_DOT}$2"),
    # Sentence marks with the quotes and brackets that close after them, then whitespace.
    (rf"([.!?]+[\"'\)\]”’]*{SPACE}+)", rf"$1{CUT}"),
    (r"([\n\r]+)", rf"$1{CUT}"),
]


# Pieces walked together. Appending to an array copies it, so a text of n pieces is walked in blocks:
# n * 128 copies instead of n * n / 2.
BLOCK = 256

SPANS = "array<struct<start:int,end:int>>"


def _walk_block(pieces: Column) -> Column:
    """The length of some pieces, and the spans of those with a word, counted from the first piece."""

    def step(state, piece):
        left = F.length(piece) - F.length(F.regexp_replace(piece, rf"\A{SPACE}+", ""))
        right = F.length(F.regexp_replace(piece, rf"{SPACE}+\z", ""))
        span = F.struct((state["at"] + left).alias("start"), (state["at"] + right).alias("end"))
        return F.struct(
            (state["at"] + F.length(piece)).alias("at"),
            F.when(has_word(piece), F.concat(state["found"], F.array(span)))
            .otherwise(state["found"])
            .alias("found"),
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("found"))
    return F.aggregate(pieces, start, step)


def _join_blocks(blocks: Column) -> Column:
    """The spans of all blocks, counted from the start of the text."""

    def step(state, block):
        moved = F.transform(
            block["found"],
            lambda span: F.struct(
                (span["start"] + state["at"]).alias("start"),
                (span["end"] + state["at"]).alias("end"),
            ),
        )
        return F.struct(
            (state["at"] + block["at"]).alias("at"),
            F.concat(state["found"], F.array(moved)).alias("found"),
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("found"))
    return F.aggregate(blocks, start, step, lambda state: F.flatten(state["found"]))


def sentences(text: Column) -> Column:
    """The sentences of a text as an array of (start, end, text), `text` being that slice of it.

    A sentence ends at ".", "!" or "?" before whitespace and at the end of a line; abbreviations,
    initials and the numbers of list items do not end one. Whitespace at the edges is left out, and
    so are pieces without a letter or digit.
    """
    cut = text
    for pattern, replacement in SENTENCE_RULES:
        cut = F.regexp_replace(cut, pattern, replacement)

    def spans(pieces):
        last_block = F.floor((F.size(pieces) - 1) / BLOCK).cast("int")
        blocks = F.transform(
            F.sequence(F.lit(0), last_block),
            lambda block: _walk_block(F.slice(pieces, block * BLOCK + 1, F.lit(BLOCK))),
        )
        return _join_blocks(blocks)

    return let(
        text,
        lambda whole: F.transform(
            let(F.split(cut, CUT, -1), spans),
            lambda span: F.struct(
                span["start"].alias("start"),
                span["end"].alias("end"),
                F.substring(whole, span["start"] + 1, span["end"] - span["start"]).alias("text"),
            ),
        ),
    )
