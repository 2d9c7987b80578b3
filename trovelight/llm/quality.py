"""Quality rules as a short-circuit cascade: cheap rules that reject much come first.

Only DataFrame functions; the rules of one document are branches of one CASE, which stops at the first
rule that fails.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovelight.llm.common import discard, let, prepared, written

SPACE = r"[\x20\x09-\x0D]+"
# Rows the cost and the selectivity of rules are estimated on.
SAMPLE_ROWS = 2000


def words(text: Column) -> Column:
    """The runs of `[^\\x20\\x09-\\x0D]`; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE, -1), "")


def repeated_words(found: Column) -> Column:
    """How many words stand in a window of three words that occurs twice or more; all occurrences count.

    Windows are compared by 64-bit hashes. Where none repeats, which one hash set tells, nothing is
    sorted. Where few do, windows are looked up among those; else they are sorted with their places. The
    work is n log n in a text's words at most.
    """

    def windows(w: Column) -> Column:
        return F.transform(
            F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))),
            lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)),
        )

    def twice(g: Column) -> Column:
        return let(F.sort_array(g), lambda s: F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i - 1))))

    def places_of(g: Column, some: Column) -> Column:
        return F.filter(F.transform(g, lambda x, i: F.when(F.array_contains(some, x), i)), lambda i: i.isNotNull())

    def places(s: Column) -> Column:
        same = lambda p, k: F.coalesce(F.get(s, k)["w"] == p["w"], F.lit(False))
        marked = F.transform(s, lambda p, k: F.when(same(p, k - 1) | same(p, k + 1), p["i"]))
        return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))

    def covered(p: Column) -> Column:
        own = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(own, F.lit(0), lambda a, x: a + x)

    def count(g: Column) -> Column:
        numbered = F.transform(g, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
        found = let(twice(g), lambda some: F.when(F.size(some) <= 32, places_of(g, some)).otherwise(let(F.sort_array(numbered), places)))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(let(found, covered))

    return let(windows(found), count).cast("long")


def symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[#*$%&|<>]"))


def lines(text: Column) -> Column:
    """The `\\n`-split lines with a word."""
    return F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def repeated_lines(found: Column) -> Column:
    return F.size(found) - F.size(F.array_distinct(found))


@dataclass(frozen=True)
class Facts:
    """What rules judge: a text (never null), its words, and the count of repeated ones where it is known."""

    text: Column
    words: Column
    known_repeated: Column | None = None

    @property
    def n_words(self) -> Column:
        return F.size(self.words)

    @property
    def repeated(self) -> Column:
        return repeated_words(self.words) if self.known_repeated is None else self.known_repeated


@dataclass(frozen=True)
class Rule:
    """A name, from the facts of a text whether the rule rejects it, and about how many characters it has to look at for that."""

    name: str
    rejects: Callable[[Facts], Column]
    work: Callable[[Facts], Column] = lambda f: F.length(f.text)


def _share(part: Column, tenths: int, whole: Column) -> Column:
    return part * 10 > whole * tenths


# Work in characters of one pass over a text; a window of words costs about as much as twenty.
RULES = (
    Rule("few_words", lambda f: f.n_words < 50, lambda f: F.lit(1)),
    Rule("repeated_words", lambda f: _share(f.repeated, 5, f.n_words), lambda f: f.n_words * 20),
    Rule("symbols", lambda f: _share(symbols(f.text), 1, f.n_words)),
    Rule("exclamations", lambda f: _share(F.regexp_count(f.text, F.lit("!")), 3, f.n_words)),
    Rule("capitals", lambda f: _share(F.regexp_count(f.text, F.lit(r"\p{Lu}")), 3, F.length(F.regexp_replace(f.text, r"\P{L}+", ""))), lambda f: F.length(f.text) * 3),
    Rule("repeated_lines", lambda f: let(lines(f.text), lambda found: _share(repeated_lines(found), 4, F.size(found))), lambda f: F.length(f.text) * 2),
)


def ordered(docs: DataFrame, text: str, rules: tuple[Rule, ...], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """`rules` by rejections per cost, each among the documents that those before it let through.

    Both are estimated on the texts of about `sample_rows` rows, drawn from the whole table by hash: a rule's cost is
    its work over them. The same rows give the same order, however they are split and whenever it is asked for; equal
    rules stay in the order given. The order decides what is computed, never what is rejected.
    """
    total = docs.count()
    drawn = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    drawn = drawn.where(F.pmod(F.xxhash64("t", F.lit(11)), F.lit(max(1, total // sample_rows))) == 0)
    # A text counts with its copies, but is looked at once.
    sample = written(drawn.groupBy("t").agg(F.count("*").alias("n")), "quality-sample")

    def alone(made: Callable[[Facts], Column]) -> Column:
        return let(words(F.col("t")), lambda w: made(Facts(F.col("t"), w)))

    fired = [F.coalesce(alone(rule.rejects), F.lit(False)).alias(rule.name) for rule in rules]
    work = [(F.col("n") * alone(rule.work)).cast("long").alias(f"work_{rule.name}") for rule in rules]
    # At most one row per combination of rules that reject together.
    groups = (
        sample.select("n", *fired, *work)
        .groupBy(*[rule.name for rule in rules])
        .agg(F.sum("n").alias("n"), *[F.sum(f"work_{rule.name}").alias(f"work_{rule.name}") for rule in rules])
        .collect()
    )
    discard(sample)
    cost = {rule.name: max(1, sum(g[f"work_{rule.name}"] for g in groups)) for rule in rules}
    left, order = list(rules), []
    while left:
        best = max(left, key=lambda rule: sum(g["n"] for g in groups if g[rule.name]) / cost[rule.name])
        groups = [g for g in groups if not g[best.name]]
        left.remove(best)
        order.append(best)
    return order


def cascade(facts: Facts, order: list[Rule]) -> Column:
    """The name of the first rule that rejects a text, or null; later rules are not computed."""
    first, *others = order
    found = F.when(first.rejects(facts), F.lit(first.name))
    for rule in others:
        found = found.when(rule.rejects(facts), F.lit(rule.name))
    return found


def verdict(text: Column, order: list[Rule]) -> Column:
    """The name of the rule that rejects a text, or null; null texts are judged as empty."""
    whole = F.coalesce(text, F.lit(""))
    return let(words(whole), lambda w: cascade(Facts(whole, w), order))


def measured(text: Column, order: list[Rule]) -> Column:
    """The verdict as struct field rejected_by, with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.

    The measures are of whole texts, also of rejected ones; a null text has no words.
    """
    whole = F.coalesce(text, F.lit(""))

    def fields(w: Column, repeated: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            (F.length(whole) - F.regexp_count(whole, F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
            symbols(whole).cast("long").alias("n_symbols"),
            let(lines(whole), repeated_lines).cast("long").alias("n_dup_lines"),
            repeated.alias("n_repeat_words"),
            cascade(Facts(whole, w, repeated), order).alias("rejected_by"),
        )

    return let(words(whole), lambda w: let(repeated_words(w), lambda repeated: fields(w, repeated)))


def rated(
    docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, order: list[Rule] | None = None
) -> DataFrame:
    """`docs` with struct column quality: the measures of every text, and rejected_by, which is null for
    documents that pass every rule, else the first that rejects in the order used: `order` or, without it, `ordered`.

    Nothing is shuffled. Empty and null texts have too few words. Other columns, whatever their names,
    stay as they are; a column named quality is replaced.
    """
    prepared(docs.sparkSession)
    order = ordered(docs, text, rules, sample_rows) if order is None else order
    return docs.withColumn("quality", measured(F.col(f"`{text}`"), order))


def passing(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of `docs` that pass every rule."""
    prepared(docs.sparkSession)
    return docs.where(verdict(F.col(f"`{text}`"), ordered(docs, text, rules, sample_rows)).isNull())
