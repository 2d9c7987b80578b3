"""The stored tables a search reads: assets, units, postings and vectors in one shared folder."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trovelight.operators.blockmax import build_blocks
from trovelight.operators.keyword import shard_column, term_shard
from trovelight.operators.units import as_postings, build_postings_by_term, build_units
from trovelight.plans.lineage import write_table
from trovelight.schemas import need

TABLES = ("assets", "units", "postings", "vectors", "blocks")
VECTOR_COLUMNS = [
    "unit_id", "asset_id", "collection", "asset_type", "kind", "embedding", "embedding_model",
]


OPEN_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
# Folders a task writes to at once; the rows of more are sorted by folder.
MOST_WRITERS = 32


@dataclass(frozen=True)
class Index:
    """The tables of one index."""

    assets: DataFrame
    units: DataFrame
    postings: DataFrame
    vectors: DataFrame
    # The postings without positions, as `build_blocks` makes them; a store may be without.
    blocks: DataFrame | None = None

    @staticmethod
    def read(spark: SparkSession, folder: str, like: "Index | None" = None) -> "Index":
        """The index of a folder; one read before tells the schemas, which need not be looked up again."""

        def table(name: str) -> DataFrame:
            known = None if like is None else getattr(like, name)
            return (spark.read if known is None else spark.read.schema(known.schema)).parquet(f"{folder}/{name}")

        return Index(*[table(name) for name in TABLES])


def write_partitioned(rows: DataFrame, path: str, *by: str, sort: tuple[str, ...] = ()) -> None:
    """Write a table split into folders by some columns.

    Rows are rebalanced first: few files a folder, and a folder that holds a third of all rows is
    split over many tasks.
    """
    balanced = rows.hint("rebalance", *by)
    if sort:
        balanced = balanced.sortWithinPartitions(*by, *sort)
    write_table(balanced, path, *by, mode="overwrite")


def write_postings(units: DataFrame, path: str, stem: bool, shards: int) -> None:
    """Write the postings of units, split by collection and by hash of the term, sorted by term.

    They are moved and sorted by batches of units, a row for each term of a batch, and laid out as rows where they
    are written. Rows leave a task in order of their folders, but Spark cannot know that after laying them out and
    would sort them all again for the writers; so a task may keep the writers of a few folders open instead.
    """
    by_term = build_postings_by_term(units, stem).withColumn(shard_column(shards), term_shard(F.col("term"), shards))
    write_postings_by_term(by_term, path, shards, units.schema["asset_id"].dataType)


def write_postings_by_term(by_term: DataFrame, path: str, shards: int, asset_type: T.DataType) -> None:
    """`write_postings` of postings by term that know their shards."""
    spark, shard = by_term.sparkSession, shard_column(shards)
    ordered = by_term.hint("rebalance", "collection", shard).sortWithinPartitions("collection", shard, "term")
    before = spark.conf.get(OPEN_WRITERS)
    spark.conf.set(OPEN_WRITERS, str(MOST_WRITERS))
    try:
        write_table(as_postings(ordered, asset_type), path, "collection", shard, mode="overwrite")
    finally:
        spark.conf.set(OPEN_WRITERS, before)


class GrowingIndex:
    """An index whose tables are written when they are first asked for, each from the one before it.

    A search that reads vectors alone needs no postings, and a list of collections needs no units. Nothing is
    computed twice, and a lost executor costs one table's tasks. Units are split by collection; postings by
    collection and by hash of the term, sorted by term, so a query reads the parts its words are in, and once more
    in blocks for the best units only; vectors by collection and model.

    Args:
        assets: Described and cleaned up assets; a function, called when their table is written.
        chunks: Their passages; likewise.
        folder: A folder all machines see.
        embed: From units with `body` to the same rows with embedding and embedding_model.
        image_vectors: (asset_id, embedding, embedding_model) of image units.
        stem: Whether words are stemmed.
        shards: Parts of a collection's postings.
        schemas: Of the tables written in this folder so far; added to. Callers that share a folder share these.
    """

    def __init__(
        self,
        spark: SparkSession,
        assets: Callable[[], DataFrame],
        chunks: Callable[[], DataFrame],
        folder: str,
        embed: Callable[[DataFrame], DataFrame],
        image_vectors: DataFrame | None = None,
        stem: bool = True,
        shards: int = 64,
        schemas: dict[str, T.StructType] | None = None,
    ):
        self._spark, self._folder = spark, folder
        self._assets, self._chunks, self._embed, self._image_vectors = assets, chunks, embed, image_vectors
        self._stem, self._shards = stem, shards
        self._schemas = {} if schemas is None else schemas
        self._read: dict[str, DataFrame] = {}

    def _table(self, name: str) -> DataFrame:
        if name not in self._read:
            path = f"{self._folder}/{name}"
            if name not in self._schemas:
                getattr(self, f"_write_{name}")(path)
                self._schemas[name] = self._spark.read.parquet(path).schema
            self._read[name] = self._spark.read.schema(self._schemas[name]).parquet(path)
        return self._read[name]

    assets = property(lambda self: self._table("assets"))
    units = property(lambda self: self._table("units"))
    postings = property(lambda self: self._table("postings"))
    vectors = property(lambda self: self._table("vectors"))
    # The postings without positions, as `build_blocks` makes them.
    blocks = property(lambda self: self._table("blocks"))

    def whole(self) -> Index:
        """All tables, those written that are not there yet."""
        return Index(*[self._table(name) for name in TABLES])

    def _write_assets(self, path: str) -> None:
        assets = self._assets()
        need(assets, "asset_id", "collection", "filename", "asset_type")
        write_partitioned(assets, path, "collection")

    def _write_units(self, path: str) -> None:
        write_partitioned(build_units(self.assets, self._chunks()), path, "collection")

    def _write_postings(self, path: str) -> None:
        write_postings(self.units, path, self._stem, self._shards)

    def _write_blocks(self, path: str) -> None:
        write_table(build_blocks(self.postings), path, "collection", mode="overwrite")

    def _write_vectors(self, path: str) -> None:
        units = self.units
        vectors = self._embed(units.where(F.col("body").isNotNull())).select(*VECTOR_COLUMNS)
        if self._image_vectors is not None:
            images = units.where(F.col("kind") == "image").join(self._image_vectors, "asset_id")
            vectors = vectors.unionByName(images.select(*VECTOR_COLUMNS))
        write_partitioned(vectors.where(F.col("embedding").isNotNull()), path, "collection", "embedding_model")


def build_index(
    assets: DataFrame,
    chunks: DataFrame,
    folder: str,
    embed: Callable[[DataFrame], DataFrame],
    image_vectors: DataFrame | None = None,
    stem: bool = True,
    shards: int = 64,
) -> Index:
    """Write the whole index of described assets and read it back; see `GrowingIndex` for its tables."""
    growing = GrowingIndex(assets.sparkSession, lambda: assets, lambda: chunks, folder, embed, image_vectors, stem, shards)
    return growing.whole()
