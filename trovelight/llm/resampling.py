"""Importance resampling towards a target: documents weighed by hashed word runs, drawn by perturbed weight.

Runs of one to three words fall into buckets by CRC-32. A bucket's gain is the logarithm of how much more
often the target text uses it than all documents do; a document's weight is the sum over its runs. Adding
Gumbel noise that follows from the document's id and taking the largest scores draws without replacement.

Runs are interned block by block in an open-addressed table of NumPy arrays: keys are xxhash64 of a run's
bytes, equal keys count as one run only if the bytes agree, and each slot stores a bucket and a count. What
is counted or gathered goes by the slot of each occurrence.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trovelight.llm.common import prepared, row_field, row_of, written

BUCKETS = 10_000
LONGEST = 3
# Words whose runs are interned together: their table fits a processor's cache, and a text of any length is
# many blocks.
BLOCK = 1 << 15

# Bytes as words see them: A-Z in lower case, everything between words as 0.
_SEEN = np.arange(256, dtype=np.uint8)
_SEEN[0x41:0x5B] = np.arange(0x61, 0x7B)
_SEEN[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0

# The primes of xxhash64: fixed values.
_PRIME_1 = np.uint64(0x9E3779B185EBCA87)
_PRIME_2 = np.uint64(0xC2B2AE3D27D4EB4F)
_PRIME_3 = np.uint64(0x165667B19E3779F9)
_PRIME_4 = np.uint64(0x85EBCA77C2B2AE63)
_PRIME_5 = np.uint64(0x27D4EB2F165667C5)

# Words up to so many bytes are appended to a run's CRC by table.
_TABLED = 128


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


# What one byte does to the inner state of a CRC-32.
_STEP = np.array([zlib.crc32(bytes([b])) for b in range(256)], np.uint32) ^ np.uint32(zlib.crc32(b"\0"))


def _crc_shifts() -> np.ndarray:
    """[length, place, byte]: what the byte at that place of a CRC-32 becomes after so many zero bytes."""
    shifts = np.empty((_TABLED + 1, 4, 256), np.uint32)
    shifts[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for length in range(_TABLED):
        shifts[length + 1] = _STEP[shifts[length] & np.uint32(255)] ^ (shifts[length] >> np.uint32(8))
    return shifts


_SHIFTS = _crc_shifts()
# What a space before so many bytes adds to their CRC.
_SPACES = np.bitwise_xor.reduce([_SHIFTS[:, place, (zlib.crc32(b" ") >> (8 * place)) & 255] for place in range(4)])


class Tight:
    """Texts as one buffer of lower-case words, one space after each, with the place and text of every word."""

    def __init__(self, texts: list[bytes]) -> None:
        joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        seen = _SEEN[joined]
        inside = seen != 0
        after = np.zeros(len(seen), bool)
        after[1:] = inside[:-1]
        kept = inside | after
        self.data = np.concatenate([seen[kept], np.zeros(40, np.uint8)])
        self.data[: len(self.data) - 40][self.data[: len(self.data) - 40] == 0] = 0x20
        begins = np.flatnonzero(inside & ~after)
        ends = np.flatnonzero(~inside & after)
        self.lengths = ends - begins
        self.starts = np.cumsum(self.lengths + 1) - self.lengths - 1
        first = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.text = np.searchsorted(first, begins, side="right") - 1
        # Eight and four bytes from any place on.
        self.eight = np.ndarray(len(self.data) - 7, "<u8", self.data, 0, (1,))
        self.four = np.ndarray(len(self.data) - 3, "<u4", self.data, 0, (1,))

    def bytes_at(self, start: int, length: int) -> bytes:
        return self.data[start : start + length].tobytes()

    def xxhash64(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """xxhash64, seed 0, of each slice of the buffer."""
        order = np.argsort(np.minimum(lengths, 32).astype(np.uint8), kind="stable")
        at, size = starts[order], lengths[order]
        short = int(np.searchsorted(size, 32))
        out = np.empty(len(order), np.uint64)
        place, n = at[:short].copy(), size[:short]
        h = _PRIME_5 + n.astype(np.uint64)
        for lane in range(3):
            begin = int(np.searchsorted(n, 8 * lane + 8))
            k = _turned(self.eight[place[begin:]] * _PRIME_2, 31) * _PRIME_1
            h[begin:] = _turned(h[begin:] ^ k, 27) * _PRIME_1 + _PRIME_4
            place[begin:] += 8
        some = np.flatnonzero(n & 4)
        k = self.four[place[some]].astype(np.uint64) * _PRIME_1
        h[some] = _turned(h[some] ^ k, 23) * _PRIME_2 + _PRIME_3
        place[some] += 4
        for left in range(3):
            some = np.flatnonzero((n & 3) > left)
            h[some] = _turned(h[some] ^ (self.data[place[some]].astype(np.uint64) * _PRIME_5), 11) * _PRIME_1
            place[some] += 1
        h = (h ^ (h >> np.uint64(33))) * _PRIME_2
        h = (h ^ (h >> np.uint64(29))) * _PRIME_3
        out[order[:short]] = h ^ (h >> np.uint64(32))
        out[order[short:]] = [xxhash.xxh64_intdigest(self.bytes_at(s, n)) for s, n in zip(at[short:].tolist(), size[short:].tolist(), strict=True)]
        return out

    def crc32(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The CRC-32 of each slice of the buffer."""
        order = np.argsort(np.minimum(lengths, _TABLED).astype(np.uint8), kind="stable")
        at, size = starts[order], lengths[order]
        short = int(np.searchsorted(size, _TABLED))
        crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
        for done in range(int(size[short - 1]) if short else 0):
            live = slice(int(np.searchsorted(size[:short], done, side="right")), short)
            crc[live] = _STEP[(crc[live] ^ self.data[at[live] + done]) & np.uint32(255)] ^ (crc[live] >> np.uint32(8))
        crc = ~crc
        crc[short:] = [zlib.crc32(self.bytes_at(s, n)) for s, n in zip(at[short:].tolist(), size[short:].tolist(), strict=True)]
        out = np.empty_like(crc)
        out[order] = crc
        return out

    def same_bytes(self, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Whether the slices from `a` and from `b` hold the same bytes."""
        same = np.ones(len(a), bool)
        live = np.flatnonzero(a != b)
        done = 0
        while len(live):
            left = lengths[live] - done
            apart = self.eight[a[live] + done] ^ self.eight[b[live] + done]
            # Of the last eight bytes only those that belong to the slices.
            apart <<= (8 * np.maximum(8 - left, 0)).astype(np.uint64)
            same[live[apart != 0]] = False
            live = live[(apart == 0) & (left > 8)]
            done += 8
            if done >= 256:
                size = lengths[live].tolist()
                same[live] = [self.bytes_at(x, n) == self.bytes_at(y, n) for x, y, n in zip(a[live].tolist(), b[live].tolist(), size, strict=True)]
                break
        return same


class Interned:
    """The runs that start at words `low` to `high` of `tight`, in an open-addressed table.

    `slot` and `text` have the slot and the text of every occurrence, `bucket` and `count` the bucket and the
    number of occurrences of every slot.
    """

    def __init__(self, tight: Tight, low: int, high: int, buckets: int = BUCKETS, longest: int = LONGEST) -> None:
        words = np.arange(low, high)
        first, last = [words], [words]
        for more in range(1, longest):
            begin = words[: max(0, min(high, len(tight.starts) - more) - low)]
            begin = begin[tight.text[begin] == tight.text[begin + more]]
            first.append(begin)
            last.append(begin + more)
        at, to = np.concatenate(first), np.concatenate(last)
        starts = tight.starts[at]
        lengths = tight.starts[to] + tight.lengths[to] - starts
        self.text = tight.text[at]
        keys = tight.xxhash64(starts, lengths)
        capacity = 1 << max(4, (2 * len(at)).bit_length())
        owner = np.full(capacity, -1, np.int32)
        probe = (keys & np.uint64(capacity - 1)).astype(np.int64)
        self.slot = np.empty(len(at), np.int64)
        waiting = np.arange(len(at), dtype=np.int32)
        while len(waiting):
            place = probe[waiting]
            free = owner[place] < 0
            # Of several that claim a slot at once one gets it.
            owner[place[free]] = waiting[free]
            holder = owner[place]
            fits = (keys[holder] == keys[waiting]) & (lengths[holder] == lengths[waiting])
            likely = np.flatnonzero(fits)
            fits[likely] = tight.same_bytes(starts[holder[likely]], starts[waiting[likely]], lengths[waiting[likely]])
            self.slot[waiting[fits]] = place[fits]
            waiting = waiting[~fits]
            probe[waiting] = (probe[waiting] + 1) & (capacity - 1)
        self.used = np.flatnonzero(owner >= 0)
        self.count = np.bincount(self.slot, minlength=capacity)
        self.bucket = np.zeros(capacity, np.int64)
        held = owner[self.used]
        self.bucket[self.used] = self._crc32(tight, low, high, held, at[held], to[held]) % buckets

    def _crc32(self, tight: Tight, low: int, high: int, held: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
        """The CRC-32 of the runs `held`, of words `at` to `to`: a word's is computed once, then words are appended."""
        # Occurrences 0 to high - low are the single words; the last run may reach beyond `high`.
        end = min(high + LONGEST, len(tight.starts))
        alone = held[at == to]
        single = np.empty(len(self.count), np.uint32)
        single[self.slot[alone]] = tight.crc32(tight.starts[low + alone], tight.lengths[low + alone])
        words = np.concatenate([single[self.slot[: high - low]], tight.crc32(tight.starts[high:end], tight.lengths[high:end])])
        # A space before each.
        appended = words ^ _SPACES[np.minimum(tight.lengths[low:end], _TABLED)]
        crc = words[at - low]
        for step in range(1, int((to - at).max(initial=0)) + 1):
            longer = np.flatnonzero(to - at >= step)
            word = at[longer] + step
            tabled = tight.lengths[word] < _TABLED
            longer, word = longer[tabled], word[tabled]
            size, old = tight.lengths[word] + 1, crc[longer]
            new = appended[word - low]
            for place in range(4):
                new = new ^ _SHIFTS[size, place, (old >> np.uint32(8 * place)) & np.uint32(255)]
            crc[longer] = new
        long_words = np.concatenate([[0], np.cumsum(tight.lengths[low:end] >= _TABLED)])
        for i in np.flatnonzero(long_words[to + 1 - low] > long_words[at + 1 - low]).tolist():
            start = int(tight.starts[at[i]])
            crc[i] = zlib.crc32(tight.data[start : int(tight.starts[to[i]] + tight.lengths[to[i]])])
        return crc


def _blocks(tight: Tight, buckets: int) -> Iterator[Interned]:
    for low in range(0, len(tight.starts), BLOCK):
        yield Interned(tight, low, min(low + BLOCK, len(tight.starts)), buckets)


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many runs of all texts fall into each bucket. A task hands on one row a bucket; so does the driver read."""
    prepared(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            tight = Tight([v.as_py() or b"" for v in batch.column(0).cast(pa.binary())])
            for block in _blocks(tight, buckets):
                total += np.bincount(block.bucket[block.used], block.count[block.used], buckets).astype(np.int64)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], names=["bucket", "n"])

    each = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(counted, "bucket long, n long")
    total = np.zeros(buckets, np.int64)
    for row in each.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[row.bucket] = row.n
    return total


def learned_gains(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Each bucket's gain: thousandths of the logarithm of its smoothed share in the target over that in all documents."""
    source, aimed = bucket_counts(docs, text, buckets), bucket_counts(target, target_text, buckets)
    all_source, all_aimed = int(source.sum()), int(aimed.sum())
    return np.array(
        [
            math.floor(1000 * math.log(((t + 1) * (all_source + buckets)) / ((s + 1) * (all_aimed + buckets))))
            for s, t in zip(source.tolist(), aimed.tolist(), strict=True)
        ],
        np.int64,
    )


def weighed(docs: DataFrame, gains: np.ndarray, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Every row's carried columns as struct `row`, with n_words, n_features and weight, the sum of its runs' gains."""
    fields = [T.StructField(name, T.LongType()) for name in ("n_words", "n_features", "weight")]
    schema = T.StructType([row_field(docs, carry), *fields])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tight = Tight([v.as_py() or b"" for v in batch.column(1).cast(pa.binary())])
            features, weight = np.zeros((2, batch.num_rows), np.int64)
            for block in _blocks(tight, len(gains)):
                features += np.bincount(block.text, minlength=batch.num_rows)
                # Sums of whole numbers far under 2^53.
                weight += np.bincount(block.text, gains[block.bucket][block.slot], batch.num_rows).astype(np.int64)
            words = np.bincount(tight.text, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(column, pa.int64()) for column in (words, features, weight))], names=schema.names
            )

    return docs.select(row_of(docs, carry), F.col(f"`{text}`").alias("text")).mapInArrow(weigh, schema)


def drawn(
    docs: DataFrame,
    target: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    target_text: str = "text",
    percent: int = 5,
    least_words: int = 20,
    seed: int = 42,
    buckets: int = BUCKETS,
    carry: list[str] | None = None,
) -> DataFrame:
    """Every row of `docs` as struct `row` with n_words, n_features, weight, score and rank.

    Of the N rows with at least `least_words` words the floor(percent * N / 100) with the highest scores are
    drawn and numbered from 1; all others have no rank. Equal scores go by the smaller id, null ids last, and
    repeated rows in any order. A null text has no words and weighs 0; a null id is hashed as an empty one. An
    empty target or table is allowed. Carried columns, by default all, may have any names.

    Weights are computed in one pass after the pass that counts buckets, and written. Ranks come from ranges of
    scores that tasks number side by side, so no task sorts everything and equal scores are no hot key.
    """
    spark = prepared(docs.sparkSession)
    carry = docs.columns if carry is None else carry
    own = docs.select(row_of(docs, carry), F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    gains = learned_gains(docs, target, text, target_text, buckets)
    part = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("row.id").cast("string"), F.lit(""))), 256), 1, 8)
    uniform = (F.conv(part, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    scores = written(
        weighed(own, gains, carry=["row", "id"]).select(
            F.col("row.row").alias("row"), F.col("row.id").alias("id"), "n_words", "n_features", "weight",
            (F.col("weight") + F.floor(-1000 * F.log(-F.log(uniform))).cast("long")).alias("score"),
            F.monotonically_increasing_id().alias("tie"),
        ),
        "resampling-scores",
    )
    eligible = scores.where(F.col("n_words") >= least_words)
    wanted = eligible.count() * percent // 100
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("tie")]
    ranges = written(
        eligible.select("score", "id", "tie").repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "resampling-ranges"
    )
    # One row a partition.
    sizes = {row.part: row.n for row in ranges.groupBy("part").agg(F.count("*").alias("n")).collect()}
    before = {part: sum(n for other, n in sizes.items() if other < part) for part in sizes}
    reached = [(part, n) for part, n in before.items() if n < wanted]
    starts = spark.createDataFrame(reached, "part int, before long")
    ranks = (
        ranges.join(F.broadcast(starts), "part")
        .select("tie", (F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order))).alias("rank"))
        .where(F.col("rank") <= wanted)
    )
    return scores.join(ranks, "tie", "left").select("row", "n_words", "n_features", "weight", "score", "rank")


def resampled(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that `drawn` draws, with its columns only."""
    chosen = drawn(docs, target, **options).where("rank is not null")
    return chosen.select(*[F.col(f"row.`{c}`") for c in docs.columns])
