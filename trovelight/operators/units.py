"""Search units: building them, their ids, their postings and their hashed vectors."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trovelight.fixed_values import UNIT_KINDS
from trovelight.functions import text as tx
from trovelight.functions.packed import pack, pack_ids, unpack, unpack_ids
from trovelight.functions.stem import Stemmer, stem_words
from trovelight.functions.vectors import coded_words, counted_vectors
from trovelight.operators.metadata import filename_body, metadata_body
from trovelight.schemas import need

UNITS_PER_ASSET = 1_000_000
UNITS_PER_KIND = 100_000

HASHED_MODEL = "hashed-{dims}"
# Rows whose words are counted at once.
EMBEDDED_AT_ONCE = 250


def build_units(assets: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every search unit of every asset.

    An asset has a metadata unit and a filename unit; an image also has an image unit, without a
    body, and a visible_text unit when it shows text; a text file has a content unit per passage.

    Args:
        assets: Described assets.
        chunks: (asset_id, collection, unit_index, start_char, end_char, text), of those assets.
    """
    need(assets, "asset_id", "collection", "asset_type", "filename", "visible_text")
    need(chunks, "asset_id", "collection", "unit_index", "start_char", "end_char", "text")

    def unit(kind, body, when=None):
        made = F.struct(F.lit(kind).alias("kind"), body.cast("string").alias("body"))
        return made if when is None else F.when(when, made)

    is_image = F.col("asset_type") == "image"
    shows_text = is_image & (F.coalesce("visible_text", F.lit("")) != "")
    # One pass over the assets: their units are built side by side, then laid out as rows.
    own = (
        assets.select(
            "asset_id",
            "collection",
            "asset_type",
            F.explode(
                F.array_compact(
                    F.array(
                        unit("metadata", metadata_body(assets)),
                        unit("filename", filename_body(F.col("filename"))),
                        unit("image", F.lit(None), is_image),
                        unit("visible_text", F.col("visible_text"), shows_text),
                    )
                )
            ).alias("_unit"),
        )
        .select(
            "asset_id",
            "collection",
            "asset_type",
            "_unit.kind",
            F.lit(0).alias("unit_index"),
            F.lit(None).cast("int").alias("start_char"),
            F.lit(None).cast("int").alias("end_char"),
            "_unit.body",
        )
    )
    content = chunks.select(
        "asset_id",
        "collection",
        F.lit("text").alias("asset_type"),
        F.lit("content").alias("kind"),
        "unit_index",
        "start_char",
        "end_char",
        F.col("text").alias("body"),
    )
    return assign_unit_ids(own.unionByName(content))


def kind_number(kind: Column) -> Column:
    """The place of a unit's kind in the order units are built, from 0."""
    return (F.array_position(F.array(*[F.lit(k) for k in UNIT_KINDS]), kind) - 1).cast("int")


def assign_unit_ids(units: DataFrame) -> DataFrame:
    """`unit_id` first: unique, and ordered by asset, then kind, then place. No row has to move."""
    need(units, "asset_id", "kind", "unit_index")
    in_range = (F.col("unit_index") < UNITS_PER_KIND) & (kind_number(F.col("kind")) >= 0)
    unit_id = (
        F.col("asset_id").cast("bigint") * UNITS_PER_ASSET
        + kind_number(F.col("kind")) * UNITS_PER_KIND
        + F.col("unit_index")
    )
    refused = F.raise_error(
        F.concat(F.lit("no unit id for kind "), F.col("kind"), F.lit(" index "), "unit_index")
    )
    return units.select(F.when(in_range, unit_id).otherwise(refused).alias("unit_id"), "*")


def asset_of_unit(unit_id: Column) -> Column:
    """The asset of a unit id from `assign_unit_ids`, of negative ones as well."""
    return F.call_function("div", unit_id - F.pmod(unit_id, F.lit(UNITS_PER_ASSET)), F.lit(UNITS_PER_ASSET))


# Postings of one Arrow batch handed back.
POSTINGS_OUT = 50_000

CARRIED = ["collection", "unit_id", "asset_id", "kind", "asset_type"]
POSTING_COLUMNS = ["collection", "term", "unit_id", "asset_id", "kind", "asset_type", "tf", "positions"]
# What a term's row is for, and what it holds of its postings: their number, the units above the lowest one, their
# counts and all positions; see `functions.packed`.
TERM_KEYS = ["collection", "kind", "asset_type", "term"]
OF_TERM = {"n": T.IntegerType(), "low": T.LongType(), "ids": T.BinaryType(), "tfs": T.BinaryType(), "places": T.BinaryType()}
# Postings that are put together by term at once.
POSTINGS_BY_TERM = 300_000


def _postings_of(batch: pa.RecordBatch, stems: Stemmer | None) -> pa.RecordBatch:
    """The postings of a batch of units: its words sorted by unit and term, cut where either changes."""
    rows, places, codes, words = coded_words(batch.column("words"))
    if stems is not None:
        encoded = pa.array([stems[word] for word in words], pa.string()).dictionary_encode()
        codes = encoded.indices.to_numpy(zero_copy_only=False)[codes]
        words = encoded.dictionary.to_pylist()
    keys = rows.astype(np.int64) * max(1, len(words)) + codes
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    ends = np.append(first, len(keys)).astype(np.int32)
    unit = pa.array(rows[order[first]])
    positions = pa.ListArray.from_arrays(pa.array(ends), pa.array(places[order].astype(np.int32)))
    return pa.RecordBatch.from_arrays(
        [
            *[batch.column(name).take(unit) for name in CARRIED],
            pa.array(words, pa.string()).take(pa.array(codes[order[first]])),
            pa.array(np.diff(ends).astype(np.int32)),
            positions,
        ],
        names=[*CARRIED, "term", "tf", "positions"],
    )


def _by_term(postings: pa.RecordBatch) -> pa.RecordBatch:
    """Postings of a batch of units, those of a term in units of one collection, kind and type in one row."""
    keys = np.zeros(postings.num_rows, np.int64)
    for name in TERM_KEYS:
        encoded = postings.column(name).dictionary_encode()
        # Numbers of null and of what there is; pairs of numbers become one number again, so none grows too large.
        codes = encoded.indices.fill_null(len(encoded.dictionary)).to_numpy().astype(np.int64)
        keys = np.unique(keys * (len(encoded.dictionary) + 1) + codes, return_inverse=True)[1]
    ids = postings.column("unit_id").to_numpy().astype(np.int64)
    order = np.lexsort((ids, keys))
    first = np.flatnonzero(np.diff(keys[order], prepend=-1))
    heads = pa.array(order[first])
    positions = postings.column("positions").take(pa.array(order))
    tfs = np.diff(positions.offsets.to_numpy()).astype(np.int64)
    low, packed_ids = pack_ids(ids[order], first)
    places = pack(positions.flatten().to_numpy().astype(np.int64), (np.cumsum(tfs) - tfs)[first])
    return pa.RecordBatch.from_arrays(
        [
            *[postings.column(name).take(heads) for name in TERM_KEYS],
            pa.array(np.diff(first, append=len(keys)).astype(np.int32)),
            low,
            packed_ids,
            pack(tfs, first),
            places,
        ],
        names=[*TERM_KEYS, *OF_TERM],
    )


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of postings by term, a bounded number of postings at once."""

    def made(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_term = _by_term(pa.concat_batches(held))
        for start in range(0, by_term.num_rows, POSTINGS_OUT // 10):
            yield by_term.slice(start, POSTINGS_OUT // 10)

    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= POSTINGS_BY_TERM:
            yield from made(held)
            held, n = [], 0
    if held:
        yield from made(held)


def _laid_out(batch: pa.RecordBatch, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The postings of rows by term, in their order, with the columns `names` of these."""
    sizes = batch.column("n").to_numpy().astype(np.int64)
    # A row may hold many postings, a batch many rows: about POSTINGS_OUT at once.
    part = (np.cumsum(sizes) - sizes) // POSTINGS_OUT
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    for start, end in zip(starts.tolist(), np.append(starts[1:], len(sizes)).tolist(), strict=True):
        rows, n = batch.slice(start, end - start), sizes[start:end]
        tfs = unpack(rows.column("tfs"), n)
        row = np.repeat(np.arange(len(n)), n)
        places = unpack(rows.column("places"), np.bincount(row, tfs, len(n)).astype(np.int64))
        offsets = pa.array(np.concatenate([[0], np.cumsum(tfs)]).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [
                *[rows.column(name).take(pa.array(row)) for name in names],
                pa.array(unpack_ids(rows.column("low"), rows.column("ids"), n)),
                pa.array(tfs.astype(np.int32)),
                pa.ListArray.from_arrays(offsets, pa.array(places.astype(np.int32))),
            ],
            names=[*names, "unit_id", "tf", "positions"],
        )


def build_postings(units: DataFrame, stemmed: bool = True) -> DataFrame:
    """One row per unit and term, with the count and the positions of the term.

    Words are lower-cased, stop words left out (their places still count), and the rest stemmed. A
    batch of units is turned into postings where it is read; nothing moves between machines.
    """
    return _posted(units, stemmed, by_term=False).select(*POSTING_COLUMNS)


def build_postings_by_term(units: DataFrame, stemmed: bool = True) -> DataFrame:
    """`build_postings` as (collection, kind, asset_type, term, n, low, ids, tfs, places): a row holds what many units
    have of a term, in few bytes.

    For whoever moves postings: a term travels once for many units. `as_postings` lays them out as rows.

    Args:
        units: With ids from `assign_unit_ids`, since these tell the assets.
        stemmed: Whether words are stemmed.
    """
    return _posted(units, stemmed, by_term=True)


def postings_by_term(postings: DataFrame) -> DataFrame:
    """Postings that were laid out as rows, by term again, put together where they are read.

    Args:
        postings: From `build_postings`, with ids from `assign_unit_ids`.
    """
    need(postings, *TERM_KEYS, "unit_id", "positions")
    kept = postings.select(*TERM_KEYS, F.col("unit_id").cast("bigint").alias("unit_id"), "positions")
    return kept.mapInArrow(_grouped, _by_term_schema(postings))


def _by_term_schema(rows: DataFrame) -> T.StructType:
    types = {field.name: field.dataType for field in rows.schema.fields} | {"term": T.StringType()}
    return T.StructType([T.StructField(name, kind) for name, kind in ({name: types[name] for name in TERM_KEYS} | OF_TERM).items()])


def as_postings(by_term: DataFrame, asset_type: T.DataType) -> DataFrame:
    """The postings of `build_postings_by_term`, as rows in the order of these; other columns stay.

    Args:
        by_term: Postings by term.
        asset_type: The type of asset ids.
    """
    others = [name for name in by_term.columns if name not in (*TERM_KEYS, *OF_TERM)]
    names = [*TERM_KEYS, *others]
    schema = T.StructType(
        [
            *[by_term.schema[name] for name in names],
            T.StructField("unit_id", T.LongType()),
            T.StructField("tf", T.IntegerType()),
            T.StructField("positions", T.ArrayType(T.IntegerType())),
        ]
    )

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from _laid_out(batch, names)

    laid_out = by_term.select(*names, *OF_TERM).mapInArrow(lay_out, schema)
    return laid_out.withColumn("asset_id", asset_of_unit(F.col("unit_id")).cast(asset_type)).select(*POSTING_COLUMNS, *others)


def _posted(units: DataFrame, stemmed: bool, by_term: bool) -> DataFrame:
    need(units, *CARRIED, "body")
    words = F.transform(
        tx.words(F.col("body")), lambda word: F.when(~tx.is_stop_word(word), word)
    )
    if by_term:
        schema = _by_term_schema(units)
    else:
        types = {field.name: field.dataType for field in units.schema.fields}
        types |= {"term": T.StringType(), "tf": T.IntegerType(), "positions": T.ArrayType(T.IntegerType())}
        schema = T.StructType([T.StructField(name, types[name]) for name in (*CARRIED, "term", "tf", "positions")])

    def post(batches):
        stems = Stemmer() if stemmed else None
        made = (_postings_of(batch, stems) for batch in batches)
        if by_term:
            yield from _grouped(made)
            return
        for batch in made:
            for start in range(0, batch.num_rows, POSTINGS_OUT):
                yield batch.slice(start, POSTINGS_OUT)

    with_words = units.where(F.col("body").isNotNull()).select(*CARRIED, words.alias("words"))
    return with_words.mapInArrow(post, schema)


def stem_vocabulary(postings: DataFrame) -> DataFrame:
    """(term, stem): one row per distinct term."""
    need(postings, "term")
    return postings.select("term").distinct().withColumn("stem", stem_words("term"))


def embed_hashed_words(
    rows: DataFrame, text: str = "body", dims: int = 1024, keep: tuple[str, ...] | None = None
) -> DataFrame:
    """`embedding` and `embedding_model`: a hashed bag of words of length 1.

    Text without words gets no vector and no model. Words are counted a batch of rows at a time; no
    row moves.

    Args:
        rows: Any rows with a text column.
        text: That column.
        dims: The length of the vectors.
        keep: The columns to keep; all of them when left out.
    """
    need(rows, text)
    kept = list(keep or rows.columns)
    schema = T.StructType(
        [rows.schema[name] for name in kept]
        + [T.StructField("embedding", T.ArrayType(T.FloatType()))]
    )

    def embed(batches):
        for batch in batches:
            # A batch may hold millions of words, and what is counted at once is many times their size.
            for start in range(0, batch.num_rows, EMBEDDED_AT_ONCE):
                part = batch.slice(start, EMBEDDED_AT_ONCE)
                vectors = counted_vectors(part.column("_words"), dims)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(name) for name in kept], vectors], names=[*kept, "embedding"]
                )

    words = F.coalesce(tx.hashed_words(F.col(text)), F.array().cast("array<string>"))
    embedded = rows.select(*kept, words.alias("_words")).mapInArrow(embed, schema)
    return embedded.withColumn(
        "embedding_model",
        F.when(F.col("embedding").isNotNull(), F.lit(HASHED_MODEL.format(dims=dims))),
    )


def sparse_vectors(rows: DataFrame, key: str, text: str = "body", dims: int = 1024) -> DataFrame:
    """The hashed bag of words as rows (key, bucket, weight), places that hold nothing left out."""
    need(rows, key, text)
    return (
        embed_hashed_words(rows, text, dims, keep=(key,))
        .select(key, F.posexplode("embedding").alias("bucket", "weight"))
        .where(F.col("weight") > 0)
    )
