"""Bloom filters built by tasks: rows that cannot find a partner are left where they are, not shuffled."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits a key and probes: about one in forty thousand others passes.
BITS_PER_KEY = 32
PROBES = 6
# The largest filter (64 MB). With more keys than fit, more rows pass that need not; none is ever lost.
MOST_BITS = 1 << 29


def probes(*key: Column) -> Column:
    """The hashes of a key that a filter is asked for."""
    return F.array(*[F.xxhash64(*key, F.lit(i)) for i in range(PROBES)])


def filter_of(keys: DataFrame, on: list[str], count: int, most_bits: int = MOST_BITS) -> np.ndarray:
    """A filter of `count` keys. Its bits are put together by tasks; the driver reads its words, whose number the keys bound."""
    bits = min(most_bits, 1 << max(10, (BITS_PER_KEY * count - 1).bit_length()))
    bit = F.explode(F.transform(probes(*[F.col(name) for name in on]), lambda hashed: F.pmod(hashed, F.lit(bits)))).alias("bit")
    words = (
        keys.select(bit)
        .groupBy(F.shiftright("bit", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("value"))
        .toArrow()
    )
    table = np.zeros(bits // 64, np.int64)
    table[words.column("word").to_numpy()] = words.column("value").to_numpy()
    return table


def in_filter(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For rows of `probes` whether their key may be in the filter; never false for one that is."""
    at = hashes & np.int64(64 * len(table) - 1)
    return (((table[at >> 6] >> (at & 63)) & 1) == 1).all(axis=1)


def probed(batch: pa.RecordBatch, column: int = -1) -> np.ndarray:
    """A column of `probes` as rows."""
    return batch.column(column if column >= 0 else batch.num_columns + column).flatten().to_numpy().reshape(-1, PROBES)


def likely(rows: DataFrame, on: list[str], keys: DataFrame, count: int) -> DataFrame:
    """The rows whose key is among `count` keys, and a few others: what a join that follows need not move stays where it is."""
    table = rows.sparkSession.sparkContext.broadcast(filter_of(keys, on, count))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            passing = batch.filter(pa.array(in_filter(table.value, probed(batch))))
            yield passing.select(passing.schema.names[:-1])

    return rows.withColumn("_probes", probes(*[F.col(name) for name in on])).mapInArrow(sift, rows.schema)
