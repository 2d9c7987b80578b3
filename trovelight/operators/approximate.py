"""Approximate vector search: inverted lists of product-quantised residuals, re-ranked exactly.

Every space (a collection's vectors of one model) gets centroids, learned by k-means, and its units are laid
out by the centroid they are nearest to. What a unit lacks from its centroid is stored as a code of one byte
for each few dimensions. A search looks into the lists nearest to a query until these hold the share of the
space that its recall needs, scores codes, and reads the vectors of the best few only.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from trovelight.functions.vectors import NearestSoFar, matrix
from trovelight.operators.nearest import (
    MAX_BROADCAST_BYTES,
    SPACE,
    _coded,
    _decoded,
    _in_place,
    _list_column,
    _passes,
    _ranked,
    _unit_rows,
    vector_search,
)
from trovelight.plans.lineage import written
from trovelight.plans.sizing import lookup, row_count_up_to
from trovelight.schemas import need
from trovelight.settings import DEFAULTS

# Dimensions that share a byte of a code, and the values a byte has.
DIMS_PER_BYTE = 4
VALUES = 256
# Lists of a space grow with the square root of its units, up to a number every task can hold.
LISTS_PER_ROOT = 4
MOST_LISTS = 16_384
# A space's centroids are learned from at most so many of its units, and bytes of their vectors, drawn by hash of their ids.
MOST_LEARNED = 200_000
MOST_LEARNED_BYTES = 256 << 20
# Units of a space that are searched for exactly, to learn which share of the space a recall needs.
PROBED = 128
ROUNDS = 8
MODEL = T.StructType(
    [
        T.StructField("collection", T.StringType()),
        T.StructField("embedding_model", T.StringType()),
        T.StructField("dims", T.IntegerType()),
        T.StructField("centroids", T.BinaryType()),
        T.StructField("books", T.BinaryType()),
    ]
)
CODES = T.StructType(
    [
        *MODEL.fields[:2],
        *[T.StructField(name, T.LongType()) for name in ("unit_id", "asset_id", "_code")],
        T.StructField("list", T.IntegerType()),
        T.StructField("code", T.BinaryType()),
    ]
)


@dataclass(frozen=True)
class VectorLists:
    """The stored tables of an approximate index.

    `models` has a row a space, with the sizes of its lists and the share a recall needs; `codes` has a
    row a unit, by space and list; `vectors` is what was indexed.
    """

    models: DataFrame
    codes: DataFrame
    vectors: DataFrame

    @staticmethod
    def read(spark: SparkSession, folder: str, vectors: DataFrame) -> "VectorLists":
        models = T.StructType([*MODEL.fields, T.StructField("sizes", T.BinaryType()), T.StructField("share", T.DoubleType())])
        return VectorLists(spark.read.schema(models).parquet(f"{folder}/models"), spark.read.schema(CODES).parquet(f"{folder}/codes"), vectors)


def _directions(vectors: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, lengths, out=np.zeros_like(vectors), where=lengths > 0)


def _nearest_centre(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(axis=1) / 2
    step = max(1, 8_000_000 // max(1, len(centres)))
    return np.concatenate([np.argmin(half - rows[at : at + step] @ centres.T, axis=1) for at in range(0, max(1, len(rows)), step)])


def learned_centres(rows: np.ndarray, count: int, random: np.random.Generator, balanced: bool = False) -> np.ndarray:
    """`count` centres by k-means, seeded by distinct rows; where `balanced`, an empty or small centre moves into the heaviest list."""
    distinct = np.unique(rows, axis=0)
    centres = distinct[random.choice(len(distinct), min(count, len(distinct)), replace=False)].astype(np.float32)
    for turn in range(ROUNDS):
        own = _nearest_centre(rows, centres)
        sizes = np.bincount(own, minlength=len(centres))
        order = np.argsort(own, kind="stable")
        held = np.flatnonzero(sizes)
        starts = np.cumsum(sizes)[held] - sizes[held]
        centres[held] = np.add.reduceat(rows[order], starts, axis=0) / sizes[held, None]
        if balanced and turn < ROUNDS - 2:
            light = np.argsort(sizes, kind="stable")
            heavy = light[::-1]
            for few, many in zip(light[: len(light) // 8], heavy, strict=False):
                if sizes[many] <= 3 * len(rows) / len(centres):
                    break
                # One of the heavy list's rows takes the light one's place.
                centres[few] = rows[random.choice(np.flatnonzero(own == many))]
    return centres


def _byte_slices(dims: int) -> list[slice]:
    return [slice(at, min(at + DIMS_PER_BYTE, dims)) for at in range(0, dims, DIMS_PER_BYTE)]


class _Space:
    """The centroids and code books of one space."""

    def __init__(self, dims: int, centroids: bytes, books: bytes, sizes: bytes = b"", share: float = 1.0):
        self.dims = dims
        self.centroids = np.frombuffer(centroids, np.float32).reshape(-1, dims)
        self.books = np.frombuffer(books, np.float32).reshape(VALUES, dims)
        self.sizes = np.frombuffer(sizes, np.int64)
        self.share = share

    def encoded(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list of every vector, and its code."""
        rows = _directions(vectors).astype(np.float32)
        own = _nearest_centre(rows, self.centroids)
        rest = rows - self.centroids[own]
        parts = [_nearest_centre(rest[:, part], self.books[:, part]) for part in _byte_slices(self.dims)]
        return own, np.stack(parts, axis=1).astype(np.uint8)

    def decoded(self, own: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """About the vectors of these lists and codes, looked up byte by byte."""
        rows = self.centroids[own].copy()
        for place, part in enumerate(_byte_slices(self.dims)):
            rows[:, part] += self.books[codes[:, place], part]
        return rows

    def order(self, directions: np.ndarray) -> np.ndarray:
        """The lists by their distance from every query, nearest first."""
        half = (self.centroids * self.centroids).sum(axis=1) / 2
        return np.argsort(half - directions @ self.centroids.T, axis=1, kind="stable")

    def looked_into(self, directions: np.ndarray, least: int) -> np.ndarray:
        """Whether each query looks into each list: the nearest until these hold the share, and `least` units."""
        total = int(self.sizes.sum())
        order = self.order(directions)
        before = np.cumsum(self.sizes[order], axis=1) - self.sizes[order]
        chosen = np.zeros(order.shape, bool)
        np.put_along_axis(chosen, order, before < max(self.share * total, min(least, total)), axis=1)
        return chosen

    def shares_until(self, directions: np.ndarray, own: np.ndarray) -> np.ndarray:
        """For pairs of a direction and a list: the share of the space a query has looked into once it has seen that list."""
        total = max(1, int(self.sizes.sum()))
        found = np.empty(len(own))
        step = max(1, 4_000_000 // max(1, len(self.centroids)))
        for at in range(0, len(own), step):
            order = self.order(directions[at : at + step])
            before = np.cumsum(self.sizes[order], axis=1) - self.sizes[order]
            rank = np.argmax(order == own[at : at + step, None], axis=1)
            found[at : at + step] = before[np.arange(len(order)), rank] / total
        return found


def _learned(rows: DataFrame, lists_per_root: int, seed: int) -> DataFrame:
    """A model row for every space, learned in one task each from a bounded number of units."""
    sizes = rows.groupBy(*SPACE).agg(F.count("*").alias("_n"))
    drawn = lookup(rows.select(*SPACE, "unit_id", "embedding"), sizes, SPACE, fits_broadcast=row_count_up_to(sizes, DEFAULTS.max_broadcast_rows) is not None)
    most = F.least(F.lit(float(MOST_LEARNED)), F.lit(float(MOST_LEARNED_BYTES)) / (F.size("embedding") * 4))
    drawn = drawn.where(F.pmod(F.xxhash64("unit_id", F.lit(seed)), F.ceil(F.col("_n") / most)) == 0)

    def learn(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("unit_id").to_numpy(), kind="stable")
        sample = _directions(matrix(_list_column(table, "embedding"))).astype(np.float32)[order]
        random = np.random.default_rng(seed)
        n = table.column("_n")[0].as_py()
        count = min(MOST_LISTS, max(1, int(lists_per_root * n**0.5)), max(1, len(sample) // 2))
        centroids = learned_centres(sample, count, random, balanced=True)
        rest = sample - centroids[_nearest_centre(sample, centroids)]
        books = np.zeros((VALUES, sample.shape[1]), np.float32)
        for part in _byte_slices(sample.shape[1]):
            book = learned_centres(rest[:, part], VALUES, random)
            books[: len(book), part] = book
            books[len(book) :, part] = book[0]
        return pa.table(
            {
                "collection": table.column("collection")[:1],
                "embedding_model": table.column("embedding_model")[:1],
                "dims": pa.array([sample.shape[1]], pa.int32()),
                "centroids": pa.array([centroids.astype(np.float32).tobytes()], pa.binary()),
                "books": pa.array([books.tobytes()], pa.binary()),
            }
        )

    return drawn.groupBy(*SPACE).applyInArrow(learn, MODEL)


def _encoded(rows: DataFrame, models: DataFrame, units_per_cell: int) -> DataFrame:
    """Every unit with its list and code; a space's units are dealt over as many tasks as they need."""
    sizes = rows.groupBy(*SPACE).agg(F.ceil(F.count("*") / units_per_cell).cast("int").alias("_parts"))
    few = row_count_up_to(sizes, DEFAULTS.max_broadcast_rows) is not None
    cells = lookup(rows, sizes, SPACE, fits_broadcast=few).withColumn("_part", F.pmod(F.xxhash64("unit_id"), F.col("_parts")).cast("int")).drop("_parts")
    repeated = models.join(sizes, SPACE).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    cell = [*SPACE, "_part"]
    def encode(units: pa.Table, model: pa.Table) -> pa.Table:
        if not units.num_rows or not model.num_rows:
            return to_arrow_schema(CODES).empty_table()
        space = _Space(*[model.column(name)[0].as_py() for name in ("dims", "centroids", "books")])
        own, codes = space.encoded(matrix(_list_column(units, "embedding")))
        made = units.select([*SPACE, "unit_id", "asset_id", "_code"])
        made = made.append_column("list", pa.array(own.astype(np.int32)))
        return made.append_column("code", pa.array([code.tobytes() for code in codes], pa.binary()))

    return cells.groupBy(*cell).cogroup(repeated.toDF(*repeated.columns).groupBy(*cell)).applyInArrow(encode, CODES)


def _needed_share(models: DataFrame, codes: DataFrame, vectors: DataFrame, k: int, recall: float, seed: int) -> DataFrame:
    """(collection, embedding_model, share): the share of a space that finds `recall` of the `k` nearest.

    About PROBED units of every space are searched for exactly, themselves left out. The share is the least at
    which they find as many on average, two standard errors left as a margin.
    """
    counted = codes.groupBy(*SPACE).agg(F.count("*").alias("_n"))
    few = row_count_up_to(counted, DEFAULTS.max_broadcast_rows) is not None
    drawn = lookup(vectors.where(F.col("embedding").isNotNull()).select("unit_id", *SPACE, "embedding"), counted, SPACE, fits_broadcast=few)
    drawn = drawn.where(F.pmod(F.xxhash64("unit_id", F.lit(seed + 1)), F.ceil(F.col("_n") / PROBED)) == 0)
    asked = written(drawn.select(F.col("unit_id").alias("query_id"), *SPACE, "embedding"), "probed")
    exact = vector_search(asked, vectors, k + 1).where("query_id != unit_id").select("query_id", "unit_id")
    found = exact.join(asked, "query_id").join(codes.select(*SPACE, "unit_id", "list"), [*SPACE, "unit_id"])
    schema = T.StructType([*MODEL.fields[:2], T.StructField("share", T.DoubleType())])

    def share(hits: pa.Table, model: pa.Table) -> pa.Table:
        if not hits.num_rows or not model.num_rows:
            return to_arrow_schema(schema).empty_table()
        space = _Space(*[model.column(name)[0].as_py() for name in ("dims", "centroids", "books", "sizes")])
        directions = _directions(matrix(_list_column(hits, "embedding"))).astype(np.float32)
        until = space.shares_until(directions, hits.column("list").to_numpy())
        queries, number = np.unique(hits.column("query_id").to_numpy(), return_inverse=True)
        least = 1.0
        for tried in np.arange(0.01, 1.0, 0.01):
            each = np.bincount(number, until < tried, len(queries)) / np.bincount(number)
            if each.mean() - 2 * each.std() / np.sqrt(len(each)) >= recall:
                least = float(tried)
                break
        return pa.table({"collection": hits.column("collection")[:1], "embedding_model": hits.column("embedding_model")[:1], "share": [least]})

    return found.groupBy(*SPACE).cogroup(models.groupBy(*SPACE)).applyInArrow(share, schema)


def build_vector_lists(
    units: DataFrame,
    folder: str,
    k: int = DEFAULTS.units_per_path,
    recall: float = 0.95,
    lists_per_root: int = LISTS_PER_ROOT,
    units_per_cell: int = DEFAULTS.units_per_cell,
    seed: int = 42,
) -> VectorLists:
    """Write the approximate index of all units with a vector and read it back.

    Centroids and code books are learned from at most MOST_LEARNED units of a space; every unit is indexed. A space
    with many equal vectors has fewer lists than asked for, since equal vectors share one. A heavy list is no hot
    key: codes are read where they are stored, whatever list they are of.

    Args:
        units: As for `vector_search`; a stored table.
        folder: A folder all machines see.
        k: The number of units the recall is for.
        recall: What the lists looked into should hold of the `k` nearest units, on average.
    """
    need(units, "unit_id", "asset_id", "kind", "asset_type", *SPACE, "embedding")
    spark = units.sparkSession
    rows = _coded(units)
    learned = written(_learned(rows, lists_per_root, seed), "learned")
    encoded = _encoded(rows, learned, units_per_cell)
    # Ranges of lists, so that a search for few queries skips the row groups of other lists.
    laid = encoded.repartitionByRange(*SPACE, "list").sortWithinPartitions(*SPACE, "list")
    laid.write.mode("overwrite").partitionBy(*SPACE).parquet(f"{folder}/codes")
    codes = spark.read.schema(CODES).parquet(f"{folder}/codes")
    sizes = codes.groupBy(*SPACE, "list").agg(F.count("*").alias("n")).groupBy(*SPACE).agg(F.sort_array(F.collect_list(F.struct("list", "n"))).alias("held"))

    schema = T.StructType([*MODEL.fields, T.StructField("sizes", T.BinaryType())])

    def add_sizes(batches):
        for batch in batches:
            made = []
            for dims, centroids, held in zip(*[batch.column(name).to_pylist() for name in ("dims", "centroids", "held")], strict=True):
                counts = np.zeros(len(centroids) // (4 * dims), np.int64)
                for one in held:
                    counts[one["list"]] = one["n"]
                made.append(counts.tobytes())
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in MODEL.fields], pa.array(made, pa.binary())], names=schema.names)

    models = written(learned.join(sizes, SPACE).mapInArrow(add_sizes, schema), "sized")
    shares = _needed_share(models, codes, units, k, recall, seed)
    # Spaces with nothing to measure are looked through as a whole.
    models.join(shares, SPACE, "left").withColumn("share", F.coalesce("share", F.lit(1.0))).write.mode("overwrite").parquet(f"{folder}/models")
    return VectorLists.read(spark, folder, units)


class _CodedNearest(NearestSoFar):
    """`NearestSoFar` of units given by list and code, each query seeing its lists only."""

    def __init__(self, space: _Space, vectors: np.ndarray, k: int, least: int):
        directions = _directions(vectors).astype(np.float32)
        super().__init__(np.zeros((len(directions), 1)), k, None)
        self.space, self.asked = space, directions
        self.chosen = space.looked_into(directions, least)
        self.scored = 0

    def add_codes(self, units: np.ndarray, own: np.ndarray, codes: np.ndarray) -> None:
        wanted = self.chosen.any(axis=0)[own]
        units, own, codes = units[wanted], own[wanted], codes[wanted]
        about = self.space.decoded(own, codes)
        for query, lists in enumerate(self.chosen):
            here = np.flatnonzero(lists[own])
            if len(here):
                self.scored += len(here)
                self.add_scores(units[here], (about[here] @ self.asked[query]).astype(np.float64)[:, None], np.array([query]))


def vector_search_approx(
    queries: DataFrame,
    index: VectorLists,
    k: int = DEFAULTS.units_per_path,
    rerank: int = 4,
    rank_digits: int | None = None,
    max_broadcast_vectors: int = DEFAULTS.max_broadcast_vectors,
    max_broadcast_rows: int = DEFAULTS.max_broadcast_rows,
) -> DataFrame:
    """`vector_search` among the units of the lists nearest to each query.

    A task reads codes where they are stored and hands on `rerank * k` units a query; the vectors of the best
    `rerank * k` of all tasks are read and compared exactly. Similarities and order are exact, and a list is as long as
    the exact one: a query looks into lists until they hold `k` units. Units of other lists are missed.
    """
    need(queries, "query_id", *SPACE, "embedding")
    asked = queries.where(F.col("embedding").isNotNull()).select("query_id", *SPACE, "embedding")
    found = _candidates(asked, index, rerank * k, k, max_broadcast_vectors)
    best = _ranked(found, rerank * k).select("query_id", "unit_id")
    return rerank_exactly(asked, written(best, "candidates"), index.vectors, k, rank_digits, max_broadcast_rows)


def _candidates(asked: DataFrame, index: VectorLists, k: int, least: int, max_broadcast_vectors: int, counted=None) -> DataFrame:
    """Up to `k` units a query and task, by the codes in the query's lists, which hold `least` units or all there are.

    `counted`, an accumulator, gets how many codes were scored.
    """
    wanted = asked.select(*SPACE).distinct()
    fields = ("dims", "centroids", "books", "sizes", "share")
    # A row a space that is asked for; its size follows from its lists and dimensions.
    spaces = {
        (row.collection, row.embedding_model): [row[name] for name in fields]
        for row in index.models.join(F.broadcast(wanted), SPACE, "left_semi").collect()
    }

    def asking(rows):
        key = (rows.column("collection")[0].as_py(), rows.column("embedding_model")[0].as_py())
        return spaces.get(key), matrix(_list_column(rows, "embedding"))

    def adding(kept):
        model, vectors = kept
        if model is None:
            return NearestSoFar(vectors, k, None), lambda part: None
        so_far = _CodedNearest(_Space(*model), vectors, k, least)

        def add(part):
            codes = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(part.num_rows, -1)
            so_far.add_codes(_unit_rows(part), part.column("list").to_numpy(), codes)
            if counted is not None:
                counted.add(so_far.scored)
                so_far.scored = 0

        return so_far, add

    return _in_place(
        index.codes, _passes(asked, max(1, max_broadcast_vectors), MAX_BROADCAST_BYTES), asked.schema["query_id"].dataType, asking, adding
    )


def rerank_exactly(
    asked: DataFrame, candidates: DataFrame, vectors: DataFrame, k: int, rank_digits: int | None = None, max_broadcast_rows: int = DEFAULTS.max_broadcast_rows
) -> DataFrame:
    """The `k` nearest by cosine of each query's candidates (query_id, unit_id).

    Candidates and the queries' vectors go to where vectors are read, while their number allows; past that
    vectors of candidates only are shuffled, each once for a query it is a candidate of.
    """
    pairs = candidates.join(asked, "query_id")
    units = _coded(vectors).withColumnRenamed("embedding", "_theirs")
    few = row_count_up_to(candidates, max_broadcast_rows) is not None
    if few:
        pairs = F.broadcast(candidates.join(asked.select("query_id", *SPACE), "query_id"))
        met = units.join(pairs, [*SPACE, "unit_id"]).join(F.broadcast(asked.select("query_id", "embedding")), "query_id")
    else:
        met = pairs.join(units, [*SPACE, "unit_id"])
    narrow = met.select("query_id", "unit_id", "asset_id", "_code", "embedding", "_theirs")
    schema = T.StructType([*narrow.schema.fields[:4], T.StructField("similarity", T.DoubleType())])

    def compare(batches):
        for batch in batches:
            # A batch may hold several models, whose vectors differ in length.
            sizes = np.diff(batch.column(5).offsets.to_numpy())
            for size in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == size)))
                a, b = matrix(part.column(4)), matrix(part.column(5))
                lengths = np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1))
                found = np.divide((a * b).sum(axis=1), lengths, out=np.zeros(len(a)), where=lengths > 0)
                found = found if rank_digits is None else np.round(found, rank_digits) + 0.0
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(4)], pa.array(found)], names=schema.names)

    return _ranked(_decoded(narrow.mapInArrow(compare, schema)), k)
