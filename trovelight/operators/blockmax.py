"""Postings in blocks that tell their largest weight, and a top-k search that only decodes blocks that matter.

A collection's units are dealt over shards, which hold all words of their units. A word's postings in a shard
are cut into blocks of some hundred; a block tells its range of units and the most one of them can gain. A task
first weighs the units that hold a query's rarest word, then cuts the others where blocks begin and end and adds
up what the blocks over each interval promise; either way the most promising come first, until what is left
cannot be among a query's best.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trovelight.functions.kinds import asset_type_of, kind_of, unit_code
from trovelight.functions.packed import bytes_needed, pack, pack_ids, packed, unpack, unpack_ids
from trovelight.operators.units import UNITS_PER_ASSET
from trovelight.plans.sizing import lookup, row_count_up_to
from trovelight.schemas import need
from trovelight.settings import DEFAULTS

# Postings of a block, and about the units of a shard.
BLOCK = 128
UNITS_PER_SHARD = 8_192
# Units and intervals that are weighed first; each round takes twice as many.
FIRST_UNITS = 16
FIRST_INTERVALS = 8
# More than additions in any order can differ by.
SLACK = 1e-9

# Postings that are cut into blocks at once.
ROWS_AT_ONCE = 100_000

BLOCK_KEYS = ["collection", "shard", "term"]
BLOCK_NUMBERS = ["unit_id", "asset_id", "code", "tf"]
BLOCKS = T.StructType(
    [
        T.StructField("collection", T.StringType()),
        T.StructField("shard", T.IntegerType()),
        T.StructField("term", T.StringType()),
        T.StructField("first", T.LongType()),
        T.StructField("last", T.LongType()),
        T.StructField("most", T.IntegerType()),
        T.StructField("n", T.IntegerType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("tfs", T.BinaryType()),
        T.StructField("assets", T.BinaryType()),
        T.StructField("codes", T.BinaryType()),
    ]
)


def _wide(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(packed, f"<u{len(packed) // n}").astype(np.int64)


# Postings of a term in a shard that travel together, as `functions.packed` has them. Assets are told by how far they
# are from those of `assign_unit_ids`, which is 0 wherever it gave out the ids.
TRAVELLING = {
    "n": T.IntegerType(), "low": T.LongType(), "ids": T.BinaryType(), "least_apart": T.LongType(),
    "apart": T.BinaryType(), "codes": T.BinaryType(), "tfs": T.BinaryType(),
}


def _keys(rows: pa.RecordBatch) -> np.ndarray:
    """Numbers that tell rows of different collection, shard and term apart."""
    keys = np.zeros(rows.num_rows, np.int64)
    for name in BLOCK_KEYS:
        encoded = rows.column(name).dictionary_encode()
        codes = encoded.indices.fill_null(len(encoded.dictionary)).to_numpy().astype(np.int64)
        keys = np.unique(keys * (len(encoded.dictionary) + 1) + codes, return_inverse=True)[1]
    return keys


def _together(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Postings, those of a term in a shard in one row."""
    keys = _keys(rows)
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.diff(keys[order], prepend=-1))
    ids, assets, codes, tfs = [rows.column(name).to_numpy()[order] for name in BLOCK_NUMBERS]
    heads = pa.array(order[first])
    return pa.RecordBatch.from_arrays(
        [
            *[rows.column(name).take(heads) for name in BLOCK_KEYS],
            pa.array(np.diff(first, append=len(keys)).astype(np.int32)),
            *pack_ids(ids, first),
            *pack_ids(assets - ids // UNITS_PER_ASSET, first),
            pack(codes, first),
            pack(tfs, first),
        ],
        names=[*BLOCK_KEYS, *TRAVELLING],
    )


def _apart(rows: pa.RecordBatch) -> pa.RecordBatch:
    """The postings of rows from `_together`, which come in order of their keys, those of a key in order of unit."""
    sizes = rows.column("n").to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    ids = unpack_ids(rows.column("low"), rows.column("ids"), sizes)
    numbers = [
        ids,
        unpack_ids(rows.column("least_apart"), rows.column("apart"), sizes) + ids // UNITS_PER_ASSET,
        unpack(rows.column("codes"), sizes),
        unpack(rows.column("tfs"), sizes),
    ]
    order = np.lexsort((ids, _places(rows)[row]))
    taken = pa.array(row[order])
    return pa.RecordBatch.from_arrays(
        [*[rows.column(name).take(taken) for name in BLOCK_KEYS], *[pa.array(column[order]) for column in numbers]],
        names=[*BLOCK_KEYS, *BLOCK_NUMBERS],
    )


def _places(rows: pa.RecordBatch) -> np.ndarray:
    """For rows in order of their keys the place of each one's key."""
    return np.cumsum(np.diff(_keys(rows), prepend=-1) != 0)


def _blocks(rows: pa.RecordBatch) -> pa.RecordBatch:
    """The blocks of postings in order of collection, shard, term and unit, all at once."""
    groups = np.flatnonzero(np.diff(_keys(rows), prepend=-1))
    end = rows.num_rows
    places = np.arange(end) - np.repeat(groups, np.diff(groups, append=end))
    firsts = np.flatnonzero(places % BLOCK == 0)
    sizes = np.diff(firsts, append=end)
    ids, assets, codes, tfs = [rows.column(name).to_numpy() for name in BLOCK_NUMBERS]
    lowest = np.minimum.reduceat(assets, firsts)
    from_first, from_lowest = ids - np.repeat(ids[firsts], sizes), assets - np.repeat(lowest, sizes)

    def widths(numbers):
        return np.repeat(bytes_needed(np.maximum.reduceat(numbers, firsts)), sizes)

    at = pa.array(firsts)
    columns = [
        *[rows.column(name).take(at) for name in BLOCK_KEYS],
        pa.array(ids[firsts]),
        pa.array(ids[firsts + sizes - 1]),
        pa.array(np.maximum.reduceat(tfs, firsts).astype(np.int32)),
        pa.array(sizes.astype(np.int32)),
        packed(from_first, widths(from_first), firsts),
        packed(tfs, widths(tfs), firsts),
        # The lowest asset in eight bytes comes before the others.
        packed(np.insert(from_lowest, firsts, lowest), np.insert(widths(from_lowest), firsts, 8), firsts + np.arange(len(firsts))),
        packed(codes, widths(codes), firsts),
    ]
    return pa.RecordBatch.from_arrays(columns, names=BLOCKS.names)


def build_blocks(postings: DataFrame, units_per_shard: int = UNITS_PER_SHARD) -> DataFrame:
    """The postings in blocks; a shuffle and a sort of the postings without their positions.

    What is read together of a term and a shard travels in one row, in few bytes: postings in order of their terms, as
    an index has them, travel in about the bytes of their blocks.

    Args:
        postings: From `build_postings`.
        units_per_shard: About how many units share a shard; a unit's shard follows from its asset.
    """
    need(postings, "collection", "term", "unit_id", "asset_id", "kind", "asset_type", "tf")
    sizes = postings.groupBy("collection").agg(F.greatest(F.ceil(F.approx_count_distinct("unit_id") / units_per_shard), F.lit(1)).cast("int").alias("_shards"))
    few = row_count_up_to(sizes, DEFAULTS.max_broadcast_rows) is not None
    rows = lookup(postings.select("collection", "term", "unit_id", "asset_id", "kind", "asset_type", "tf"), sizes, ["collection"], fits_broadcast=few)
    sharded = rows.select(
        "collection",
        F.pmod(F.xxhash64("asset_id"), F.col("_shards")).cast("int").alias("shard"),
        "term",
        F.col("unit_id").cast("bigint").alias("unit_id"),
        F.col("asset_id").cast("bigint").alias("asset_id"),
        unit_code(F.col("kind"), F.col("asset_type")).cast("bigint").alias("code"),
        F.col("tf").cast("bigint").alias("tf"),
    )
    together = sharded.mapInArrow(
        lambda batches: _at_once(batches, lambda batch: batch.num_rows, lambda rows, last: (_together(rows), rows.num_rows)),
        T.StructType([*BLOCKS.fields[:3], *[T.StructField(name, kind) for name, kind in TRAVELLING.items()]]),
    )
    ordered = together.repartition("collection", "shard").sortWithinPartitions(*BLOCK_KEYS, "low")

    def cut(rows: pa.RecordBatch, last: bool) -> tuple[pa.RecordBatch | None, int]:
        # More of the last term may follow. A shard's units bound how much that is.
        end = rows.num_rows if last else int(np.flatnonzero(np.diff(_places(rows), prepend=0))[-1])
        return (_blocks(_apart(rows.slice(0, end))) if end else None), end

    return ordered.mapInArrow(lambda batches: _at_once(batches, lambda batch: pc.sum(batch.column("n")).as_py() or 0, cut), BLOCKS)


def _at_once(batches: Iterator[pa.RecordBatch], size, made) -> Iterator[pa.RecordBatch]:
    """What `made` makes of the rows of about ROWS_AT_ONCE postings, as (batch, rows taken); those it leaves come again."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += size(batch)
        if n >= ROWS_AT_ONCE:
            rows = pa.concat_batches(held)
            found, taken = made(rows, False)
            if found is not None:
                yield found
            # A copy, so that the rows before it are let go.
            rest = rows.slice(taken)
            rest = rest.take(pa.array(np.arange(rest.num_rows)))
            held, n = ([rest], size(rest)) if rest.num_rows else ([], 0)
    if held:
        yield made(pa.concat_batches(held), True)[0]


def _weights(largest: int) -> np.ndarray:
    """The weight of every number of occurrences up to `largest`: 1 + 1/4 + 1/9 + …, from 0 on."""
    return np.concatenate([[0.0], np.cumsum(1.0 / np.arange(1, largest + 1, dtype=np.float64) ** 2)])


class Best:
    """The `k` best units of a query so far: each with the words it holds, its weight, and a posting of it (row, place)."""

    def __init__(self, k: int, n_terms: int, digits: int):
        self.k, self.n_terms, self.digits = k, n_terms, digits
        self.columns = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)]

    def _scores(self, weights: np.ndarray) -> np.ndarray:
        return np.round(weights / self.n_terms, self.digits)

    def add(self, *columns: np.ndarray) -> None:
        """More units, none of them known yet."""
        units, held, weights, *_ = both = [np.concatenate(pair) for pair in zip(self.columns, columns, strict=True)]
        order = np.lexsort((units, -self._scores(weights), held != self.n_terms))[: self.k]
        self.columns = [column[order] for column in both]

    def open_to(self, whole: bool) -> bool:
        """Whether a unit that has, or has not, all words may still be among them."""
        units, held, *_ = self.columns
        return len(units) < self.k or whole or bool(held[-1] != self.n_terms)

    def promising(self, whole: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Which of units with at most these weights may be."""
        units, held, weights, *_ = self.columns
        if len(units) < self.k:
            return np.ones(len(most), bool)
        bar = self._scores(weights[-1:])[0]
        bar_whole = held[-1] == self.n_terms
        return (whole > bar_whole) | ((whole == bar_whole) & (self._scores(most + SLACK) + SLACK >= bar))


class Shard:
    """The blocks of one shard, decoded when they are needed; `decoded` counts their postings."""

    def __init__(self, blocks: pa.Table):
        self.first, self.last, self.most, self.n = (blocks.column(name).to_numpy() for name in ("first", "last", "most", "n"))
        self.ids, self.tfs, self.assets, self.codes = (blocks.column(name).to_pylist() for name in ("ids", "tfs", "assets", "codes"))
        self.weight = _weights(int(self.most.max(initial=1)))
        self.top = self.weight[self.most]
        self.rows: dict[str, list[int]] = {}
        for row, term in enumerate(blocks.column("term").to_pylist()):
            self.rows.setdefault(term, []).append(row)
        self._known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.decoded = 0

    def postings(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """The units and weights of a block."""
        if row not in self._known:
            n = int(self.n[row])
            self._known[row] = (_wide(self.ids[row], n) + self.first[row], self.weight[_wide(self.tfs[row], n)])
            self.decoded += n
        return self._known[row]

    def best(self, terms: list[str], k: int, n_terms: int, digits: int) -> "Best":
        """The `k` best units: those with all words, then by score, then by id.

        First the units that hold the rarest word, which is decoded whole: each one's promise is its own weight and what
        the other words' blocks that it lies in offer. Then units without it, by intervals; none of these has all words.
        """
        found = Best(k, n_terms, digits)
        lists = sorted((np.array(self.rows[term]) for term in terms if term in self.rows), key=lambda rows: int(self.n[rows].sum()))
        if lists:
            rare = self._with_rarest(lists, found)
            if len(lists) > 1 and found.open_to(False):
                self._by_intervals(np.concatenate(lists[1:]), rare, found)
        return found

    def _with_rarest(self, lists: list[np.ndarray], found: "Best") -> np.ndarray:
        """Weigh the units of the first list that can be among the best; returns all of its units."""
        blocks = [self.postings(row) for row in lists[0].tolist()]
        ids, own = (np.concatenate(column) for column in zip(*blocks, strict=True))
        sizes = self.n[lists[0]]
        where, places = np.repeat(lists[0], sizes), np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        most, cover, located = own.copy(), np.ones(len(ids), np.int64), []
        for rows in lists[1:]:
            at = rows[np.maximum(np.searchsorted(self.first[rows], ids, side="right") - 1, 0)]
            inside = (self.first[at] <= ids) & (ids <= self.last[at])
            most += np.where(inside, self.top[at], 0.0)
            cover += inside
            located.append(np.where(inside, at, -1))
        whole = cover == found.n_terms
        left = np.lexsort((-most, ~whole))
        take = FIRST_UNITS
        while len(left):
            left = left[found.promising(whole[left], most[left])]
            now, left = np.sort(left[:take]), left[take:]
            take *= 2
            weights, held = own[now].copy(), np.ones(len(now), np.int64)
            for rows in located:
                here = rows[now]
                for row in np.unique(here[here >= 0]).tolist():
                    theirs, gain = self.postings(row)
                    asked = np.flatnonzero(here == row)
                    at = np.minimum(np.searchsorted(theirs, ids[now[asked]]), len(theirs) - 1)
                    hit = theirs[at] == ids[now[asked]]
                    weights[asked[hit]] += gain[at[hit]]
                    held[asked[hit]] += 1
            found.add(ids[now], held, weights, where[now], places[now])
        return ids

    def _by_intervals(self, rows: np.ndarray, rare: np.ndarray, found: "Best") -> None:
        """Weigh the units of these blocks that are not among `rare`, from the most promising intervals on."""
        edges = np.unique(np.concatenate([self.first[rows], self.last[rows] + 1]))
        begin, end = np.searchsorted(edges, self.first[rows]), np.searchsorted(edges, self.last[rows] + 1)
        promised = np.cumsum(np.bincount(begin, self.top[rows], len(edges)) - np.bincount(end, self.top[rows], len(edges)))
        covered = np.cumsum(np.bincount(begin, minlength=len(edges)) - np.bincount(end, minlength=len(edges)))
        left = np.argsort(-promised, kind="stable")
        left = left[covered[left] > 0]
        take = FIRST_INTERVALS
        while len(left):
            left = left[found.promising(np.zeros(len(left), bool), promised[left])]
            now, left = left[:take], left[take:]
            take *= 2
            chosen = np.zeros(len(edges) + 1, np.int64)
            chosen[now + 1] = 1
            before = np.cumsum(chosen)
            needed = rows[before[end] > before[begin]]
            if not len(needed):
                continue
            decoded = [self.postings(row) for row in needed.tolist()]
            ids, gain = (np.concatenate(column) for column in zip(*decoded, strict=True))
            at = np.minimum(np.searchsorted(rare, ids), len(rare) - 1)
            inside = np.flatnonzero((chosen[np.searchsorted(edges, ids, side="right")] == 1) & (rare[at] != ids))
            sizes = self.n[needed]
            row = np.repeat(needed, sizes)[inside]
            place = (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes))[inside]
            units, first, number = np.unique(ids[inside], return_index=True, return_inverse=True)
            held, weights = np.bincount(number, minlength=len(units)), np.bincount(number, gain[inside], len(units))
            found.add(units, held, weights, row[first], place[first])

    def asset(self, row: int, place: int) -> int:
        packed = self.assets[row]
        return int.from_bytes(packed[:8], "little", signed=True) + int(_wide(packed[8:], int(self.n[row]))[place])

    def code(self, row: int, place: int) -> int:
        return int(_wide(self.codes[row], int(self.n[row]))[place])


def best_by_blocks(terms: DataFrame, blocks: DataFrame, k: int, digits: int, counted=None) -> DataFrame:
    """Of every query the `k` best units of each shard: (query_id, unit_id, asset_id, kind, asset_type, all_words, keyword_score).

    Args:
        terms: (query_id, collection, n_terms, term), every word of a query once; a checked number of rows,
            which go to every task.
        blocks: From `build_blocks`.
        counted: An accumulator that gets how many postings were decoded.
    """
    need(blocks, *BLOCKS.names)
    asked = terms.select("query_id", "collection", "n_terms", "term").toArrow()
    query_type = asked.schema.field("query_id").type
    queries: dict[str, dict] = {}
    for query, collection, n_terms, term in zip(*[asked.column(name).to_pylist() for name in asked.column_names], strict=True):
        queries.setdefault(collection, {}).setdefault(query, (n_terms, []))[1].append(term)
    shared = terms.sparkSession.sparkContext.broadcast(queries)
    wanted = terms.select("collection", "term").distinct()
    collections = [name for name in queries if name is not None]
    here = blocks.where(F.col("collection").isin(collections)).join(F.broadcast(wanted), ["collection", "term"], "left_semi")
    schema = T.StructType(
        [
            T.StructField("query_id", terms.schema["query_id"].dataType),
            *[T.StructField(name, T.LongType()) for name in ("unit_id", "asset_id", "_code", "_held", "_n_terms")],
            T.StructField("_weight", T.DoubleType()),
        ]
    )

    def search(table: pa.Table) -> pa.Table:
        table = table.sort_by([("term", "ascending"), ("first", "ascending")])
        shard = Shard(table)
        columns = [[] for _ in schema.names]
        for query, (n_terms, words) in shared.value[table.column("collection")[0].as_py()].items():
            units, held, weights, rows, places = shard.best(words, k, n_terms, digits).columns
            where = list(zip(rows.tolist(), places.tolist(), strict=True))
            found = (
                [query] * len(units), units.tolist(), [shard.asset(*at) for at in where], [shard.code(*at) for at in where],
                held.tolist(), [n_terms] * len(units), weights.tolist(),
            )
            for column, values in zip(columns, found, strict=True):
                column.extend(values)
        if counted is not None:
            counted.add(shard.decoded)
        kinds = [query_type, *[pa.int64()] * 5, pa.float64()]
        return pa.table({name: pa.array(column, kind) for name, column, kind in zip(schema.names, columns, kinds, strict=True)})

    found = here.groupBy("collection", "shard").applyInArrow(search, schema)
    return found.select(
        "query_id",
        "unit_id",
        "asset_id",
        kind_of(F.col("_code")).alias("kind"),
        asset_type_of(F.col("_code")).alias("asset_type"),
        (F.col("_held") == F.col("_n_terms")).alias("all_words"),
        F.round(F.col("_weight") / F.col("_n_terms"), digits).alias("keyword_score"),
    )
