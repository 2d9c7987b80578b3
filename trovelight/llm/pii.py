"""Personal data: generators propose overlapping spans, boosted trees score them, calibrated thresholds select.

Only DataFrame functions: spans are arrays in their document's row, so nothing is shuffled, and the trees
of the trained model are CASE expressions. Spans that the base patterns find always stay.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovelight.llm.common import let, prepared, row_of, written

# Base patterns, by kind in the order of reports. Written so that Java's matcher neither backtracks into
# long runs nor recurses: possessive runs, starts only where a run starts or the last match ended, and
# one character per repetition of a group.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-](?:(?!\.(?![A-Za-z0-9-]))[A-Za-z0-9.-])*+",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:(?![\x20-](?![0-9]))[0-9\x20-])*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Looser patterns for candidates of each kind.
GENERATORS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++){0,8}",
    "ip": r"(?<![0-9.])[0-9]{1,4}(?:\.[0-9]{1,4}){2,5}(?![0-9])",
    "card": r"[0-9](?:(?![\x20-](?![0-9]))[0-9\x20-])*+",
    "phone": r"(?<![0-9A-Za-z+])(?:\+|00)?\(?[0-9][0-9\x20().-]{5,20}[0-9](?![0-9A-Za-z])",
    "secret": r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{12,}+",
}
KINDS = tuple(GENERATORS)
# A text without any of these has neither base spans nor candidates.
_ANY = r"[0-9@]|[(\[]at[)\]]"
# Words that name a kind, looked for right before a candidate.
_NAMES = {
    "email": r"(?i)mail|contact",
    "ip": r"(?i)\bip\b|host|server|address",
    "card": r"(?i)card|visa|credit|konto|carte|tarjeta",
    "phone": r"(?i)phone|tel|call|fax|mobile",
    "secret": r"(?i)(?:passw(?:or)?d|passwort|token|secret|api[_-]?key)[\"']?\s?[=:]\s?[\"']?$",
}
_BEFORE, _AFTER = 24, 12

# Documents with candidates that the trees are taught on, and how exact a kind's threshold has to be.
SAMPLE_DOCS = 20_000
PRECISION = 0.98
TREES, DEPTH, STEP = 16, 5, 0.3


def _running(values: Column, start: Column) -> Column:
    """The sum of `start` and all values before each value."""
    zero = F.struct(start.cast("long").alias("total"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(
        values,
        zero,
        lambda s, x: F.struct((s["total"] + x).alias("total"), F.concat(s["out"], F.array(s["total"])).alias("out")),
        lambda s: s["out"],
    )


def _sums_before(values: Column, block: int = 256) -> Column:
    """As `_running` from 0, over blocks of blocks, so that long arrays are not copied for each value."""

    def sums(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + x))
        return let(_running(totals, F.lit(0)), lambda starts: F.flatten(F.transform(blocks, lambda b, i: _running(b, starts[i]))))

    cut = F.transform(F.sequence(F.lit(0), F.ceil(F.size(values) / block).cast("int") - 1), lambda b: F.slice(values, b * block + 1, F.lit(block)))
    return F.when(F.size(values) > 0, let(cut, sums)).otherwise(F.array().cast("array<bigint>"))


def matches(text: Column, pattern: str) -> Column:
    """All leftmost matches as structs start, end (code points, end exclusive), m, before and after.

    The pieces between the matches tell where they stand.
    """

    def placed(gaps: Column, found: Column) -> Column:
        lengths = F.transform(found, lambda m, i: (F.length(m) + F.length(gaps[i])).cast("long"))
        return let(
            _sums_before(lengths),
            lambda sums: F.transform(
                found,
                lambda m, i: F.struct(
                    (sums[i] + F.length(gaps[i])).alias("start"),
                    (sums[i] + F.length(gaps[i]) + F.length(m)).alias("end"),
                    m.alias("m"),
                    F.substring(gaps[i], -_BEFORE, _BEFORE).alias("before"),
                    F.substring(gaps[i + 1], 1, _AFTER).alias("after"),
                ),
            ),
        )

    return let(F.split(text, pattern, -1), lambda gaps: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: placed(gaps, found)))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def worth(d: Column, i: Column) -> Column:
        once = d.cast("int")
        twice = once * 2
        return F.when(i % 2 == 0, once).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    each = F.transform(F.array_remove(F.split(F.reverse(digits), "", -1), ""), worth)
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


_OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"


def _valid(kind: str, m: Column) -> Column:
    """The conditions that base matches of a kind must meet."""
    count = F.length(_digits(m))
    if kind == "ip":
        return m.rlike(_OCTETS)
    if kind == "card":
        return F.when(count.between(16, 19), _luhn(_digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return count.between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    return F.filter(matches(text, BASE[kind]), lambda s: _valid(kind, s["m"]))


def _named(spans: Column, kind: str, *fields: str) -> Column:
    """Spans of one kind as structs of that kind and some of their fields."""
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), *[s[name].alias(name) for name in fields]))


def candidates(text: Column) -> Column:
    """Proposed spans of every kind, overlapping ones included, as structs with their kind."""
    found = []
    for kind in KINDS:
        spans = _named(matches(text, GENERATORS[kind]), kind, "start", "end", "m", "before", "after")
        found.append(F.filter(spans, lambda s: F.length(_digits(s["m"])) >= 9) if kind == "card" else spans)
    return F.concat(*found)


def features(c: Column) -> list[Column]:
    """Numbers about a candidate's format and what stands around it."""
    m = c["m"]
    flag = lambda condition: F.coalesce(condition, F.lit(False)).cast("double")
    count = lambda pattern: F.regexp_count(m, F.lit(pattern)).cast("double")
    return [
        *[flag(c["kind"] == kind) for kind in KINDS],
        F.length(m).cast("double"),
        count("[0-9]"),
        count("[A-Za-z]"),
        count(r"[\x20-]"),
        count(r"\."),
        count("[^0-9a-f]"),
        flag(m.rlike(r"^(?:\+|00)")),
        flag(m.contains("@") | m.rlike(r"[(\[]at[)\]]")),
        flag(m.rlike(r"\([0-9]+\)")),
        flag(m.rlike(r"(?:\.|dot[)\]]\x20?)[A-Za-z]{2,}$")),
        flag(m.rlike(_OCTETS)),
        flag(F.when(F.length(_digits(m)).between(13, 19), _luhn(_digits(m)))),
        *[flag(c["before"].rlike(_NAMES[kind])) for kind in KINDS],
        flag(c["before"].rlike(r"[=:]\s?[\"']?$")),
        flag(c["before"].rlike(r"[A-Za-z0-9]$")),
        flag(c["after"].rlike(r"^[A-Za-z0-9]")),
    ]


def variants(c: Column) -> Column:
    """A candidate and near misses of it: every form with every context.

    Forms are without plus and parentheses, with other digits, without separators, twice, half, with its
    digits apart, and with letters for some digits. Contexts are its own, none, and the name of a secret.
    """
    m = c["m"]
    forms = [
        m,
        F.regexp_replace(m, r"^\+|[()]", ""),
        F.translate(m, "0123456789", "1357902468"),
        F.regexp_replace(m, r"[\x20.()-]", ""),
        F.concat(m, F.lit(" "), m),
        F.concat(m, m),
        m.substr(F.lit(1), F.greatest(F.length(m) / 2, F.lit(12)).cast("int")),
        F.regexp_replace(m, "([0-9])(?=[0-9])", "$1 "),
        F.translate(m, "0123456789", "ab2cd4ef78"),
    ]
    contexts = [c["before"], F.lit(""), F.lit('api_key="')]
    return F.array(
        *[F.struct(c["kind"].alias("kind"), form.alias("m"), before.alias("before"), c["after"].alias("after")) for form in forms for before in contexts]
    )


def label(c: Column) -> Column:
    """What a candidate is taught as, by conditions on its own kind."""
    m = c["m"]
    count = F.length(_digits(m))
    return (
        F.when(c["kind"] == "email", m.rlike(r"(?:\.|dot[)\]]\x20?)[A-Za-z]{2,}$"))
        .when(c["kind"] == "ip", m.rlike(_OCTETS))
        .when(c["kind"] == "card", F.when(count.between(13, 19), _luhn(_digits(m))).otherwise(F.lit(False)))
        .when(c["kind"] == "phone", count.between(8, 15) & m.rlike(r"^(?:\+|00|\()") & m.rlike(r"[0-9][\x20().-]+[0-9]"))
        .otherwise(c["before"].rlike(_NAMES["secret"]))
    )


@dataclass(frozen=True)
class Model:
    """Boosted trees as nested (feature, threshold, low, high) or a leaf's number, their weights, and each
    kind's least score; without trees nothing is added to the base spans."""

    trees: tuple
    weights: tuple[float, ...]
    least: dict[str, float]

    def score(self, c: Column) -> Column:
        """The probability that a candidate is personal data."""

        def value(node, f: Column) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            feature, threshold, low, high = node
            return F.when(f[feature] <= threshold, value(low, f)).otherwise(value(high, f))

        def margin(f: Column) -> Column:
            total = F.lit(0.0)
            for tree, weight in zip(self.trees, self.weights, strict=True):
                total = total + value(tree, f) * weight
            return total

        return let(F.array(*features(c)), lambda f: 1.0 / (1.0 + F.exp(margin(f) * -2.0)))


def _trees(described: str) -> tuple[tuple, tuple[float, ...]]:
    """The trees of Spark's printed model."""
    lines = [line.strip() for line in described.splitlines()]
    at = 0

    def node():
        nonlocal at
        line = lines[at]
        at += 1
        if leaf := re.fullmatch(r"Predict: (\S+)", line):
            return float(leaf[1])
        feature, threshold = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        low = node()
        at += 1  # the line with Else
        return int(feature), float(threshold), low, node()

    trees, weights = [], []
    while at < len(lines):
        head = re.fullmatch(r"Tree \d+ \(weight (\S+)\):", lines[at])
        at += 1
        if head:
            weights.append(float(head[1]))
            trees.append(node())
    return tuple(trees), tuple(weights)


def _held(c: Column) -> Column:
    """Whether a candidate is kept from the trees, for the thresholds."""
    return F.pmod(F.xxhash64(c["before"], c["m"], c["after"]), F.lit(10)) < 3


def _drawn(found: DataFrame, sample_docs: int) -> DataFrame:
    """The rows of `found` (at: a random number below 1, own: candidates), or of more than `sample_docs` at most about so many.

    Every kind has an equal part of the sample, and a kind in fewer documents all of them, so that the trees
    are taught every kind however large the table is.
    """

    def has(kind: str) -> Column:
        return F.exists("own", lambda c: c["kind"] == kind)

    counts = found.agg(F.count("*").alias("rows"), *[F.count_if(has(kind)).alias(kind) for kind in KINDS]).first()
    if counts["rows"] <= sample_docs:
        return found
    part = sample_docs / len(KINDS)
    shares = [F.when(has(kind), F.lit(part / max(counts[kind], 1))).otherwise(F.lit(0.0)) for kind in KINDS]
    return found.where(F.col("at") < F.greatest(*shares))


def train(docs: DataFrame, text: str = "text", sample_docs: int = SAMPLE_DOCS, precision: float = PRECISION) -> Model:
    """Boosted trees for candidates, taught on the candidates of about `sample_docs` documents that have any.

    Labels come from conditions on the spans and on the words before them; near misses of each candidate
    are taught with it, so that the trees learn what makes the difference. Three tenths of the candidates
    are held out of that; a kind's threshold is the least score from which on the held-out candidates of all
    documents are right with `precision`. With candidates of one label only there is no model.
    """
    whole = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    every = whole.where(F.col("t").rlike(_ANY)).select(F.rand(5).alias("at"), candidates(F.col("t")).alias("own"))
    found = written(every.where(F.size("own") > 0), "pii-found")

    def near(rows: DataFrame, held: bool) -> DataFrame:
        """The candidates of `rows` that are held out, or the others, and their near misses, as c."""
        own = rows.select(F.explode(F.filter("own", _held if held else lambda c: ~_held(c))).alias("own"))
        return own.select(F.explode(variants(F.col("own"))).alias("c"))

    taught = written(
        near(_drawn(found, sample_docs), held=False)
        .select(label(F.col("c")).cast("double").alias("label"), F.array(*features(F.col("c"))).alias("f"))
        .repartition(4),
        "pii-candidates",
    )
    labels = {row["label"] for row in taught.groupBy("label").count().collect()}
    if labels != {0.0, 1.0}:
        return Model((), (), {})
    size = len(features(F.col("c")))
    columns = [F.col("f")[i].alias(f"f{i}") for i in range(size)]
    vectors = VectorAssembler(inputCols=[f"f{i}" for i in range(size)], outputCol="features")
    booster = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=1, labelCol="label", featuresCol="features")
    fitted = booster.fit(vectors.transform(taught.select("label", *columns)).select("label", "features"))
    trees, weights = _trees(fitted.toDebugString)
    model = Model(trees, weights, {})
    # A row per kind and hundredth of the score at most.
    bins = (
        near(found, held=True)
        .select(F.col("c.kind").alias("kind"), label(F.col("c")).cast("double").alias("label"), F.floor(model.score(F.col("c")) * 100).alias("bin"))
        .groupBy("kind", "bin").agg(F.sum("label").alias("right"), F.count("*").alias("all")).collect()
    )
    least = {}
    for kind in KINDS:
        right = every = 0.0
        for row in sorted((row for row in bins if row["kind"] == kind), key=lambda row: -row["bin"]):
            right, every = right + row["right"], every + row["all"]
            if right >= precision * every and row["bin"] >= 50:
                least[kind] = row["bin"] / 100
    return Model(trees, weights, least)


def _selected(text: Column, base: Column, model: Model) -> Column:
    """Spans (kind, start, end) the model adds: above their kind's threshold, clear of base spans and of each other, leftmost first."""
    nothing = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    if not model.least:
        return nothing

    def least(c: Column) -> Column:
        found = F.lit(2.0)
        for kind, bound in model.least.items():
            found = F.when(c["kind"] == kind, F.lit(bound)).otherwise(found)
        return found

    def narrow(c: Column) -> Column:
        return F.struct(c["start"].alias("start"), (-c["end"]).alias("back"), c["kind"].alias("kind"))

    def apart(ordered: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("end"), nothing.alias("out"))
        return F.aggregate(
            ordered,
            zero,
            lambda s, c: F.when(
                c["start"] >= s["end"],
                F.struct((-c["back"]).alias("end"), F.concat(s["out"], F.array(F.struct(c["kind"].alias("kind"), c["start"].alias("start"), (-c["back"]).alias("end")))).alias("out")),
            ).otherwise(s),
            lambda s: s["out"],
        )

    def clear(c: Column) -> Column:
        return ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))

    good = F.filter(candidates(text), lambda c: (model.score(c) >= least(c)) & clear(c))
    return apart(F.array_sort(F.transform(good, narrow)))


def found_spans(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with columns base and added (which replace any of those names): arrays of (kind, start, end) over whole texts; null counts as empty.

    Base spans are ordered by kind and start, added ones by start. Empty texts have none.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    nothing = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    each = [_named(base_spans(whole, kind), kind, "start", "end") for kind in BASE]
    based = docs.withColumn("base", F.when(whole.rlike(_ANY), F.concat(*each)).otherwise(nothing))
    return based.withColumn("added", F.when(whole.rlike(_ANY), _selected(whole, F.col("base"), model)).otherwise(nothing))


def redacted_text(text: Column, base: Column, added: Column, block: int = 4096) -> Column:
    """`text` with every run of overlapping spans replaced by the kind of its first one, as in [EMAIL].

    Pieces are cut from blocks of the text, so that many spans in a long text do not each walk all of it.
    """

    def merged(spans: Column) -> Column:
        kind = "struct<start:bigint,end:bigint,kind:string>"
        zero = F.struct(F.lit(None).cast(kind).alias("last"), F.array().cast(f"array<{kind}>").alias("out"))

        def step(s: Column, c: Column) -> Column:
            joined = F.struct(s["last"]["start"].alias("start"), F.greatest(s["last"]["end"], c["end"]).alias("end"), s["last"]["kind"].alias("kind"))
            closed = F.when(s["last"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(s["last"])))
            return F.when(s["last"].isNotNull() & (c["start"] < s["last"]["end"]), F.struct(joined.alias("last"), s["out"].alias("out"))).otherwise(
                F.struct(c.alias("last"), closed.alias("out"))
            )

        return F.aggregate(spans, zero, step, lambda s: F.concat(s["out"], F.array(s["last"])))

    def rebuilt(blocks: Column, spans: Column) -> Column:
        def cut(start: Column, end: Column) -> Column:
            first = F.floor(start / block).cast("int")
            last = F.floor(end / block).cast("int")
            near = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
            return near.substr((start - first * block + 1).cast("int"), (end - start).cast("int"))

        before = F.transform(
            spans,
            lambda s, i: F.concat(cut(F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(spans, i - 1)["end"]), s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]")),
        )
        return F.concat(F.array_join(before, ""), cut(spans[F.size(spans) - 1]["end"], F.length(text).cast("long")))

    ordered = F.array_sort(F.transform(F.concat(base, added), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    return F.when(
        F.size(base) + F.size(added) > 0, let(merged(ordered), lambda spans: let(pieces, lambda blocks: rebuilt(blocks, spans)))
    ).otherwise(text)


def redacted(docs: DataFrame, text: str = "text", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """`docs` with personal data in `text` replaced by its kind in brackets; null texts stay null, other columns stay."""
    prepared(docs.sparkSession)
    model = train(docs, text, sample_docs)
    # Under names of its own, so that columns of `docs` cannot clash.
    inner = docs.select(row_of(docs), F.col(f"`{text}`").alias("text"))
    spans = found_spans(inner, model)
    new = redacted_text(F.col("text"), F.col("base"), F.col("added"))
    return spans.select(*[(new if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
