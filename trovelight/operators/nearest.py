"""The vector path: nearest units by cosine, exact and approximate."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trovelight.functions.kinds import asset_type_of, kind_of, unit_code
from trovelight.functions.vectors import NearestSoFar, matrix
from trovelight.plans.lineage import written
from trovelight.schemas import need
from trovelight.settings import DEFAULTS

SPACE = ["collection", "embedding_model"]
# Bytes of query vectors that are sent to every task at once.
MAX_BROADCAST_BYTES = 256 << 20
FOUND = "query_id {query_id}, unit_id bigint, asset_id bigint, _code bigint, similarity double"


def same_space(units: DataFrame, queries: DataFrame) -> DataFrame:
    """The units some query may be compared with: of its collection, and embedded by its model."""
    need(units, *SPACE)
    need(queries, *SPACE)
    return units.join(queries.select(*SPACE).distinct(), SPACE, "left_semi")


def _coded(units: DataFrame) -> DataFrame:
    """Units with a vector, their kind and type as one number."""
    return units.where(F.col("embedding").isNotNull()).select(
        *SPACE,
        F.col("unit_id").cast("bigint").alias("unit_id"),
        F.col("asset_id").cast("bigint").alias("asset_id"),
        unit_code(F.col("kind"), F.col("asset_type")).alias("_code"),
        "embedding",
    )


def _decoded(found: DataFrame) -> DataFrame:
    return found.select(
        "query_id",
        "unit_id",
        "asset_id",
        kind_of(F.col("_code")).alias("kind"),
        asset_type_of(F.col("_code")).alias("asset_type"),
        "similarity",
    )


def _unit_rows(batch) -> np.ndarray:
    return np.column_stack(
        [batch.column(name).to_numpy(zero_copy_only=False) for name in ("unit_id", "asset_id", "_code")]
    ).astype(np.int64)


def _list_column(batch, name):
    column = batch.column(name)
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _places_by_space(rows) -> dict[tuple, list[int]]:
    """The places of the rows of every collection and model."""
    places = {}
    keys = zip(*[rows.column(name).to_pylist() for name in SPACE])
    for place, key in enumerate(keys):
        places.setdefault(key, []).append(place)
    return places


def _found_batch(query_ids, query_type, nearest: NearestSoFar):
    for query, scores, units in nearest.rows():
        n = len(scores)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([query_ids[query]] * n, query_type),
                pa.array(units[:, 0]),
                pa.array(units[:, 1]),
                pa.array(units[:, 2]),
                pa.array(scores),
            ],
            names=["query_id", "unit_id", "asset_id", "_code", "similarity"],
        )


def _passes(asked: DataFrame, most: int, max_bytes: int, extra: tuple[str, ...] = ("embedding",)):
    """The queries in blocks that fit every task, as Arrow tables; nearly always one block.

    A block has at most `most` queries and, going by the longest, about `max_bytes` bytes of doubles.
    """
    columns = ["query_id", *SPACE, *extra]
    longest = F.max(F.size(extra[0]))
    count, places = asked.agg(F.count("*"), longest).first()
    block = max(1, min(most, max_bytes // (8 * max(1, places or 1))))
    blocks = -(-count // block)
    if blocks <= 1:
        yield asked.select(*columns).toArrow().combine_chunks()
        return
    asked = written(asked.select(*columns, F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("_block")), "query-blocks")
    for number in range(blocks):
        yield asked.where(F.col("_block") == number).select(*columns).toArrow().combine_chunks()


def _of_spaces(units: DataFrame, spaces) -> DataFrame:
    """The units of these (collection, model); as literals these reach the scan, so other partitions are not read."""
    models = sorted({model for _, model in spaces if model is not None})
    collections = sorted({name for name, _ in spaces if name is not None})
    return units.where(F.col("collection").isin(collections)).where(F.col("embedding_model").isin(models))


def _in_place(units: DataFrame, passes, query_type, asking, adding) -> DataFrame:
    """One pass over the units for each block of queries; a task holds the block and reads its units once.

    No unit is shuffled, and a task hands on at most `k` units a query, whatever it has read.

    Args:
        asking: From a space's queries, as an Arrow table, to what a task keeps of them.
        adding: From that to (what has been found so far, a function that takes a batch of units).
    """
    spark = units.sparkSession
    schema = FOUND.format(query_id=query_type.simpleString())
    found = None
    for rows in passes:
        spaces = {}
        for key, places in _places_by_space(rows).items():
            here = rows.take(pa.array(places))
            spaces[key] = (here.column("query_id").to_pylist(), asking(here))
        shared = spark.sparkContext.broadcast((rows.schema.field("query_id").type, spaces))

        def search(batches, shared=shared):
            id_type, by_space = shared.value
            nearest = {key: adding(kept) for key, (_, kept) in by_space.items()}
            for batch in batches:
                for key, places in _places_by_space(batch).items():
                    if key in nearest:
                        nearest[key][1](batch.take(pa.array(places)))
            for key, (so_far, _) in nearest.items():
                yield from _found_batch(by_space[key][0], id_type, so_far)

        here = _of_spaces(units, spaces).mapInArrow(search, schema)
        found = here if found is None else found.unionByName(here)
    return found


def _ranked(found: DataFrame, k: int) -> DataFrame:
    nearest_first = W.partitionBy("query_id").orderBy(F.col("similarity").desc(), "unit_id")
    return found.withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") <= k)


def vector_search(
    queries: DataFrame,
    units: DataFrame,
    k: int = DEFAULTS.units_per_path,
    rank_digits: int | None = None,
    max_broadcast_vectors: int = DEFAULTS.max_broadcast_vectors,
    units_per_cell: int = DEFAULTS.units_per_cell,
    queries_per_cell: int = DEFAULTS.queries_per_cell,
) -> DataFrame:
    """The `k` units nearest to every query by cosine, ties by unit id; exact, and without a threshold.

    Every query is compared with every unit of its collection and model, as matrix products inside
    the tasks; pairs never become rows. A block of units that lies too far from a query to hold one of its
    best so far is left out.

    Args:
        queries: (query_id, collection, embedding, embedding_model).
        units: (unit_id, asset_id, collection, kind, asset_type, embedding, embedding_model); units
            without a vector are never found.
        k: Units per query.
        rank_digits: Round similarities to this many digits before ranking; None leaves them.
        max_broadcast_vectors: Up to this many queries are sent to every task, where the units are
            read; with more, the units are read once for each block of them. Units never move.
        units_per_cell: Units compared at once.
        queries_per_cell: The least size of a block of queries.

    Returns:
        (query_id, unit_id, asset_id, kind, asset_type, similarity, rank), ranks from 1.
    """
    need(queries, "query_id", *SPACE, "embedding")
    need(units, "unit_id", "asset_id", "kind", "asset_type", *SPACE, "embedding")
    asked = queries.where(F.col("embedding").isNotNull())
    passes = _passes(asked, max(max_broadcast_vectors, queries_per_cell), MAX_BROADCAST_BYTES)

    def adding(vectors):
        so_far = NearestSoFar(vectors, k, rank_digits)

        def add(part):
            rows, theirs = _unit_rows(part), matrix(_list_column(part, "embedding"))
            for start in range(0, len(rows), units_per_cell):
                so_far.add(rows[start : start + units_per_cell], theirs[start : start + units_per_cell])

        return so_far, add

    found = _in_place(
        _coded(units), passes, queries.schema["query_id"].dataType, lambda rows: matrix(_list_column(rows, "embedding")), adding
    )
    return _ranked(_decoded(found), k)


class _SparseQueries:
    """The queries of one space by the places that hold something."""

    def __init__(self, buckets: pa.ListArray, weights: pa.ListArray):
        sizes = np.diff(buckets.offsets.to_numpy())
        owner = np.repeat(np.arange(len(sizes)), sizes)
        places = buckets.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        values = weights.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        self.lengths = np.sqrt(np.bincount(owner, values * values, len(sizes)))
        order = np.argsort(places, kind="stable")
        self.places, first = np.unique(places[order], return_index=True)
        self.owners = np.split(owner[order], first[1:])
        self.values = np.split(values[order], first[1:])
        # The most a unit can gain from a place, for any of the queries.
        inverse = np.divide(1.0, self.lengths, out=np.zeros(len(sizes)), where=self.lengths > 0)
        self.most = np.array([(np.abs(v) * inverse[o]).max(initial=0) for o, v in zip(self.owners, self.values, strict=True)])


class _SparseNearest(NearestSoFar):
    """`NearestSoFar` of vectors given by their places, without ever filling in the others."""

    def __init__(self, asked: _SparseQueries, k: int, digits: int | None):
        super().__init__(np.zeros((len(asked.lengths), 1)), k, digits)
        self.asked = asked

    def add_places(self, units: np.ndarray, buckets: pa.ListArray, weights: pa.ListArray) -> None:
        sizes = np.diff(buckets.offsets.to_numpy())
        rows = np.repeat(np.arange(len(units)), sizes)
        places = buckets.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        values = weights.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        lengths = np.sqrt(np.bincount(rows, values * values, len(units)))
        known = np.searchsorted(self.asked.places, places)
        known[known == len(self.asked.places)] = 0
        held = self.asked.places[known] == places if len(self.asked.places) else np.zeros(len(places), bool)
        rows, known, values = rows[held], known[held], values[held]
        # Units that cannot reach the worst list are not scored.
        most = np.bincount(rows, np.abs(values) * self.asked.most[known], len(units)) if len(rows) else np.zeros(len(units))
        most = np.divide(most, lengths, out=np.zeros(len(units)), where=lengths > 0)
        hopeful = np.flatnonzero(most + self.slack >= self.bars.min(initial=np.inf))
        number = np.full(len(units), -1)
        number[hopeful] = np.arange(len(hopeful))
        kept = number[rows] >= 0
        rows, known, values = number[rows[kept]], known[kept], values[kept]
        order = np.argsort(known, kind="stable")
        rows, known, values = rows[order], known[order], values[order]
        ends = np.flatnonzero(np.diff(known, append=-1)) + 1
        step = max(1, 4_000_000 // max(1, len(self.found)))
        everyone = np.arange(len(self.found))
        for start in range(0, len(hopeful), step):
            block = hopeful[start : start + step]
            scores = np.zeros((len(block), len(self.found)))
            begin = 0
            for end in ends:
                here, weight = rows[begin:end] - start, values[begin:end]
                inside = (here >= 0) & (here < len(block))
                place = known[begin]
                scores[np.ix_(here[inside], self.asked.owners[place])] += np.outer(weight[inside], self.asked.values[place])
                begin = end
            lengths_both = np.outer(lengths[block], self.asked.lengths)
            scores = np.divide(scores, lengths_both, out=np.zeros_like(scores), where=lengths_both > 0)
            if self.digits is not None:
                scores = np.round(scores, self.digits) + 0.0
            self.add_scores(units[block], scores, everyone)


def _gathered(places: DataFrame, key: str) -> DataFrame:
    """(key, buckets, weights): a vector's places, which are as many as hold something, in order."""
    need(places, key, "bucket", "weight")
    held = F.sort_array(F.collect_list(F.struct("bucket", "weight")))
    return places.groupBy(key).agg(held.alias("_held")).select(
        key, F.col("_held.bucket").alias("buckets"), F.col("_held.weight").alias("weights")
    )


def vector_search_sparse(
    queries: DataFrame,
    query_places: DataFrame,
    units: DataFrame,
    unit_places: DataFrame,
    dims: int,
    k: int = DEFAULTS.units_per_path,
    rank_digits: int | None = None,
    max_broadcast_vectors: int = DEFAULTS.max_broadcast_vectors,
) -> DataFrame:
    """`vector_search` over vectors given by the places that hold something.

    Joining both sides by place would make a row of every query and unit that share a common word, and
    lose the units that share none. Here a row holds a vector's places and weights; a task multiplies
    its units with the queries place by place, leaves out units whose places cannot gain them a place in any list, and
    keeps the tail of units without similarity, by id. Other places are never filled in.

    Args:
        queries: (query_id, collection, embedding_model).
        query_places: (query_id, bucket, weight).
        units: (unit_id, asset_id, collection, kind, asset_type, embedding_model).
        unit_places: (unit_id, bucket, weight), one row a place.
        dims: The length of the vectors.
    """
    need(queries, "query_id", *SPACE)
    need(units, "unit_id", *SPACE)
    asked = queries.join(_gathered(query_places, "query_id"), "query_id")
    rows = units.join(_gathered(unit_places, "unit_id"), "unit_id").select(
        *SPACE,
        F.col("unit_id").cast("bigint").alias("unit_id"),
        F.col("asset_id").cast("bigint").alias("asset_id"),
        unit_code(F.col("kind"), F.col("asset_type")).alias("_code"),
        "buckets",
        "weights",
    )
    passes = _passes(asked, max(1, max_broadcast_vectors), MAX_BROADCAST_BYTES, ("buckets", "weights"))

    def adding(kept):
        so_far = _SparseNearest(kept, k, rank_digits)
        return so_far, lambda part: so_far.add_places(_unit_rows(part), _list_column(part, "buckets"), _list_column(part, "weights"))

    found = _in_place(
        rows,
        passes,
        queries.schema["query_id"].dataType,
        lambda table: _SparseQueries(_list_column(table, "buckets"), _list_column(table, "weights")),
        adding,
    )
    return _ranked(_decoded(found), k)
