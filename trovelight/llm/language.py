"""Languages of documents as a mixture: expectation maximisation over n-gram likelihoods gives each
document's language proportions, and a penalised likelihood selects the set of languages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trovelight.llm.common import prepared, row_field, row_of

# Byte trigrams are counted in so many buckets.
BUCKETS = 1 << 16
# Added to every bucket's count of a language.
SMOOTHING = 0.05
ROUNDS = 40
SETTLED = 1e-4
# Logarithms of the likelihood that a further language has to gain, times the logarithm of the n-grams.
PENALTY = 3.0
# Learned languages times buckets have to fit the driver and each task; 8 bytes each.
MOST_LANGUAGES = 2_000

# Bytes as n-grams see them: ASCII letters in lower case, other bytes up to 0x7F as a space.
_SEEN = np.arange(256, dtype=np.uint8)
_SEEN[:128] = 0x20
_SEEN[0x61:0x7B] = np.arange(0x61, 0x7B)
_SEEN[0x41:0x5B] = np.arange(0x61, 0x7B)


def trigrams(text: bytes) -> np.ndarray:
    """The buckets of a text's byte trigrams, spaces around it; those with a space in the middle are left out."""
    seen = np.empty(len(text) + 2, np.uint32)
    seen[0] = seen[-1] = 0x20
    seen[1:-1] = _SEEN[np.frombuffer(text, np.uint8)]
    three = (seen[:-2] << np.uint32(16)) | (seen[1:-1] << np.uint32(8)) | seen[2:]
    three = three[seen[1:-1] != 0x20]
    return ((three * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def held_out(doc_id: Column) -> Column:
    """Whether the CRC-32 of an id as text leaves 2 divided by 4; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass(frozen=True)
class Model:
    """Languages in order, and the logarithm of each bucket's probability in each."""

    languages: tuple[str, ...]
    log: np.ndarray

    def mixture(self, text: bytes) -> tuple[str, float, dict[str, float]]:
        """The main language of a text, its proportion, and all proportions of the selected languages.

        Languages enter by their proportion when all are allowed; each has to raise the likelihood by more than
        the penalty. Ties go to the language that sorts first.
        """
        grams = np.sort(trigrams(text))
        if not len(grams):
            even = 1.0 / len(self.languages)
            return self.languages[0], even, dict.fromkeys(self.languages, even)
        first = np.flatnonzero(np.diff(grams, prepend=np.uint16(grams[0] ^ 1)))
        counts = np.diff(first, append=len(grams)).astype(np.float64)
        log = self.log[:, grams[first]]
        total = counts.sum()
        # Scaled by the likeliest language of each n-gram, which no proportion depends on.
        top = log.max(axis=0)
        likely = np.exp(log - top)
        offset = float(counts @ top)
        single = log @ counts
        order = np.argsort(-single, kind="stable")
        best = [int(order[0])]
        value, shares = float(single[best[0]]), np.ones(1)
        if len(self.languages) > 1:
            every, _ = _fitted(likely, counts, total)
            rest = [int(i) for i in np.argsort(-every, kind="stable") if i != best[0]]
            for language in rest:
                if every[language] * total < 1:
                    break
                wider = [*best, language]
                mixed, gained = _fitted(likely[wider], counts, total)
                if gained + offset <= value + PENALTY * np.log(total):
                    break
                best, value, shares = wider, gained + offset, mixed
        main = int(np.argmax(shares))
        return self.languages[best[main]], float(shares[main]), {self.languages[i]: float(s) for i, s in zip(best, shares, strict=True)}


def _fitted(likely: np.ndarray, counts: np.ndarray, total: float) -> tuple[np.ndarray, float]:
    """Proportions by expectation maximisation from even ones, and the logarithm of the likelihood."""
    shares = np.full(len(likely), 1.0 / len(likely))
    for _ in range(ROUNDS):
        new = shares * (likely @ (counts / (shares @ likely))) / total
        moved = np.abs(new - shares).max()
        shares = new
        if moved < SETTLED:
            break
    return shares, float(counts @ np.log(shares @ likely))


def learned(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Trigram counts of every language over all rows with a text and a language.

    Each task counts its own rows into arrays and hands on a row per language and bucket it met, so what
    is shuffled and collected is bounded by languages times buckets, whatever the rows.
    """
    prepared(docs.sparkSession)
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                counts = found.setdefault(name, np.zeros(BUCKETS, np.int64))
                grams = trigrams(value.as_py())
                if len(grams) > BUCKETS // 8:
                    counts += np.bincount(grams, minlength=BUCKETS)
                else:
                    np.add.at(counts, grams, 1)
        for name, counts in found.items():
            met = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(met), pa.string()), pa.array(met, pa.int32()), pa.array(counts[met])], names=schema.names)

    known = docs.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")).where("lang is not null and text is not null")
    sums = known.mapInArrow(count, schema).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = sums.toArrow()
    names = sorted(set(table.column("lang").to_pylist()))
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"{len(names)} languages; at most {MOST_LANGUAGES} are learned")
    counts = np.full((len(names), BUCKETS), SMOOTHING)
    at = {name: i for i, name in enumerate(names)}
    rows = np.array([at[name] for name in table.column("lang").to_pylist()], np.int64)
    if len(rows):
        counts[rows, table.column("bucket").to_numpy()] += table.column("n").to_numpy()
    return Model(tuple(names), np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32))


def predicted(docs: DataFrame, model: Model, carry: list[str] | None = None, text: str = "text") -> DataFrame:
    """The carried columns (by default all) as struct `row` with lang_pred, score and proportions of every row's whole text.

    A text that is null or has no letter, and every text where nothing was learned, is `und` with score 0.
    """
    prepared(docs.sparkSession)
    schema = T.StructType(
        [
            row_field(docs, carry),
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("proportions", T.MapType(T.StringType(), T.DoubleType())),
        ]
    )

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, shares = [], [], []
            for value in batch.column(1).cast(pa.binary()):
                one = value.as_py()
                name, score, all_ = ("und", 0.0, {}) if one is None or not model.languages else model.mixture(one)
                names.append(name)
                scores.append(min(max(score, 0.0), 1.0))
                shares.append(list(all_.items()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, pa.map_(pa.string(), pa.float64()))],
                names=schema.names,
            )

    lettered = F.when(F.col(f"`{text}`").rlike(r"\p{L}"), F.col(f"`{text}`"))
    return docs.select(row_of(docs, carry), lettered.alias("text")).mapInArrow(infer, schema)
