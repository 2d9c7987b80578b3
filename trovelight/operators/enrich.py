"""Descriptions and vectors from models: looked up, validated, cached, or computed in batches."""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trovelight import fixed_values as fixed
from trovelight.operators.passages import chunk_text, decode_text, summary_text
from trovelight.plans.lineage import written
from trovelight.plans.sizing import fits_broadcast, lookup
from trovelight.schemas import need
from trovelight.settings import DEFAULTS, Settings

METADATA = ["title", "description", "tags", "visible_text", "image_type"]

# --- models by name ----------------------------------------------------------------------------

ROLES = ("describe", "embed", "rerank")
_builders: dict[tuple[str, str], Callable] = {}


def register_model(role: str, name: str, builder: Callable) -> None:
    """Make a model known: `builder(settings)` returns a function from DataFrame to DataFrame."""
    if role not in ROLES:
        raise ValueError(f"unknown role {role!r}; one of {', '.join(ROLES)}")
    _builders[role, name] = builder


def get_model(role: str, name: str, settings: Settings = DEFAULTS) -> Callable:
    """The model of a role; raises ValueError naming the known ones when there is none of that name."""
    if (role, name) not in _builders:
        known = sorted(other for kind, other in _builders if kind == role)
        raise ValueError(f"unknown {role} model {name!r}; known: {', '.join(known) or 'none'}")
    return _builders[role, name](settings)


# --- descriptions ------------------------------------------------------------------------------


def prepare_inputs(files: DataFrame, settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """What models see of text files: (asset_id, collection, summary, summary_of), and the passages.

    Everything that describes or embeds a file prepares it here, so that the same file always makes
    the same requests and cached answers are found again.

    Args:
        files: (asset_id, collection, content).
        settings: Sizes.
    """
    need(files, "asset_id", "collection", "content")
    decoded = decode_text(files).select("asset_id", "collection", "text")
    summaries = summary_text(decoded, settings.summary_token_budget).drop("text")
    return summaries, chunk_text(decoded, settings.chunk_size, settings.chunk_overlap)


def describe_lookup(
    assets: DataFrame, descriptions: DataFrame, max_broadcast_rows: int = DEFAULTS.max_broadcast_rows
) -> tuple[DataFrame, DataFrame]:
    """Metadata from a table by file name: the stand-in for a description model.

    Args:
        assets: (asset_id, filename, asset_type, …).
        descriptions: (filename, title, description, tags, visible_text, image_type), one per name.
        max_broadcast_rows: A table of more rows, or of more bytes than the settings allow, is joined by shuffling.

    Returns:
        The described assets, those of unknown names in general words; and the failures, files with
        "invalid" in their name: (asset_id, error_class, message).
    """
    need(assets, "asset_id", "filename", "asset_type")
    need(descriptions, "filename", *METADATA)
    fails = F.col("filename").contains(fixed.INVALID_MARKER)
    is_image = F.col("asset_type") == "image"
    general = F.struct(
        F.col("filename").alias("title"),
        F.when(is_image, F.lit(fixed.UNKNOWN_IMAGE))
        .otherwise(F.lit(fixed.UNKNOWN_TEXT))
        .alias("description"),
        F.array().cast("array<string>").alias("tags"),
        F.lit("").alias("visible_text"),
        F.when(is_image, F.lit("other")).alias("image_type"),
    )
    known = descriptions.select("filename", F.struct(*METADATA).alias("_known"))
    # Descriptions are texts, so their bytes count as well as their rows.
    few = fits_broadcast(known, max_broadcast_rows)
    kept = [name for name in assets.columns if name not in (*METADATA, "vision_model")]
    described = (
        lookup(assets.where(~fails).select(*kept), known, ["filename"], "left", few)
        .withColumn("_metadata", F.coalesce("_known", general))
        .select(*kept, "_metadata.*", F.lit(fixed.STAND_IN_MODEL).alias("vision_model"))
    )
    failures = assets.where(fails).select(
        "asset_id",
        F.lit("ValidationError").alias("error_class"),
        F.lit("the answer is not complete").alias("message"),
    )
    return described, failures


def validate_answers(answers: DataFrame) -> DataFrame:
    """`metadata` of every answer that is a whole record, and `valid`.

    An answer is JSON with title, description and visible_text as strings, tags as an array of
    strings, and image_type as one of the types or null; a field that is missing or of another type
    makes it invalid.

    Args:
        answers: Rows with `body`.
    """
    need(answers, "body")
    parsed = F.try_parse_json(F.col("body"))

    def kind(path):
        return F.schema_of_variant(F.variant_get(F.col("_json"), path, "variant"))

    def text(path):
        return F.try_variant_get(F.col("_json"), path, "string")

    texts = [kind(f"$.{name}") == "STRING" for name in ("title", "description", "visible_text")]
    image_type = F.when(
        kind("$.image_type") == "STRING", text("$.image_type").isin(fixed.IMAGE_TYPES)
    ).otherwise(kind("$.image_type") == "VOID")
    rules = [*texts, kind("$.tags").isin("ARRAY<STRING>", "ARRAY<VOID>"), image_type]
    valid = F.lit(True)
    for rule in rules:
        valid = valid & F.coalesce(rule, F.lit(False))
    tags = F.try_variant_get(F.col("_json"), "$.tags", "array<string>")
    # An array of nulls has the same type as an empty one, and is not an array of strings.
    valid = valid & F.coalesce(F.forall(tags, lambda tag: tag.isNotNull()), F.lit(False))
    metadata = F.struct(
        text("$.title").alias("title"),
        text("$.description").alias("description"),
        tags.alias("tags"),
        text("$.visible_text").alias("visible_text"),
        text("$.image_type").alias("image_type"),
    )
    return (
        answers.withColumn("_json", parsed)
        .withColumn("valid", valid)
        .withColumn("metadata", F.when(F.col("valid"), metadata))
        .drop("_json")
    )


def select_answer(answers: DataFrame) -> DataFrame:
    """Per asset the answer that counts, along the order of the models.

    A model that is overloaded (429 or 503) passes on to the next. One that gives an invalid answer
    is asked once more, and that answer counts. Any other error ends the search.

    Args:
        answers: (asset_id, model_rank, try, http_code, body): what every model would answer, `try`
            being 1 or 2.

    Returns:
        (asset_id, outcome, model_rank, try, metadata), outcome being "described", "invalid",
        "error" or "overloaded"; metadata only for "described".
    """
    need(answers, "asset_id", "model_rank", "try", "http_code", "body")
    judged = validate_answers(answers)
    overloaded = F.col("http_code").isin(429, 503)
    verdict = (
        F.when(overloaded, F.lit("overloaded"))
        .when(F.col("http_code") != 200, F.lit("error"))
        .when(F.col("valid"), F.lit("described"))
        .otherwise(F.lit("invalid"))
    )
    row = F.struct("verdict", "model_rank", "try", "metadata")

    def answered(attempt):
        return F.first(F.when(F.col("try") == attempt, row), ignorenulls=True)

    # What one model came to: its second answer only counts when the first was invalid.
    per_model = (
        judged.withColumn("verdict", verdict)
        .groupBy("asset_id", "model_rank")
        .agg(answered(1).alias("_first"), answered(2).alias("_second"))
        .select(
            "asset_id",
            "model_rank",
            F.when(F.col("_first.verdict") == "invalid", F.coalesce("_second", "_first"))
            .otherwise(F.col("_first"))
            .alias("_row"),
        )
    )
    # The first model that is not overloaded ends the search; when all are, the last one tells so.
    rank = F.col("model_rank")
    return (
        per_model.groupBy("asset_id")
        .agg(
            F.min_by("_row", F.when(F.col("_row.verdict") != "overloaded", rank)).alias("_end"),
            F.max_by("_row", rank).alias("_last"),
        )
        .select("asset_id", F.coalesce("_end", "_last").alias("_row"))
        .select(
            "asset_id",
            F.col("_row.verdict").alias("outcome"),
            F.col("_row.model_rank").alias("model_rank"),
            F.col("_row.try").alias("try"),
            F.when(F.col("_row.verdict") == "described", F.col("_row.metadata")).alias("metadata"),
        )
    )


def answered(described: DataFrame, failures: DataFrame) -> DataFrame:
    """Described assets and failures (asset_id, error_class, message) as one table, a row per asset."""
    need(described, "asset_id", *METADATA, "vision_model")
    need(failures, "asset_id", "error_class", "message")
    return described.unionByName(
        failures.select("asset_id", "error_class", "message"), allowMissingColumns=True
    )


# --- requests and their cache ------------------------------------------------------------------


def request_key(**fields: Column) -> Column:
    """The fingerprint of a request: SHA-256 of its fields as JSON, names in order, nulls included."""
    ordered = [fields[name].alias(name) for name in sorted(fields)]
    return F.sha2(F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"}), 256)


def infer_incremental(
    inputs: DataFrame,
    cache: DataFrame,
    model: Callable[[DataFrame], DataFrame],
    answer: list[str],
    rows_per_part: int = DEFAULTS.rows_per_part,
) -> tuple[DataFrame, DataFrame]:
    """Answers for all inputs, asking the model only for requests the cache does not hold.

    Equal requests are asked once, however many inputs make them.

    Args:
        inputs: Rows with `request` (see `request_key`) and what the model reads.
        cache: (request, *answer): answers kept from before.
        model: From rows with `request` to (request, *answer); a request it fails on is left out.
        answer: The columns of an answer.
        rows_per_part: Inputs of one request that a single task hands an answer to.

    Returns:
        The inputs with their answer, null where the model failed; and the answers to keep.
    """
    need(inputs, "request")
    need(cache, "request", *answer)
    others = [name for name in inputs.columns if name != "request"]
    # Equal requests are folded where they are read, so a request that most inputs make is one row.
    distinct = (
        inputs.groupBy("request")
        .agg(F.first(F.struct(*others)).alias("_input"))
        .select("request", "_input.*")
    )
    unknown = distinct.join(cache.select("request"), "request", "left_anti")
    # Written, so that the model is asked once whatever is done with its answers.
    new = written(model(unknown).select("request", *answer), "answers")
    known = cache.select("request", *answer).unionByName(new)
    return lookup(inputs, known, ["request"], "left", rows_per_part=rows_per_part).select(
        *inputs.columns, *answer
    ), new


# --- vectors -----------------------------------------------------------------------------------


def check_vectors(inputs: DataFrame, vectors: DataFrame, key: str, dims: int) -> DataFrame:
    """Inputs whose vector is not right, (key, problem): "missing", "more than one" or "length n"."""
    need(inputs, key)
    need(vectors, key, "embedding")
    found = vectors.groupBy(key).agg(
        F.count("embedding").alias("_n"),
        F.min(F.size("embedding")).alias("_shortest"),
        F.max(F.size("embedding")).alias("_longest"),
    )
    off = F.when(F.col("_shortest") != dims, F.col("_shortest")).otherwise(F.col("_longest"))
    problem = (
        F.when(F.coalesce("_n", F.lit(0)) == 0, F.lit("missing"))
        .when(F.col("_n") > 1, F.lit("more than one"))
        .when(
            (F.col("_shortest") != dims) | (F.col("_longest") != dims),
            F.concat(F.lit("length "), off.cast("string")),
        )
    )
    return (
        inputs.select(key)
        .join(found, key, "left")
        .select(key, problem.alias("problem"))
        .where("problem IS NOT NULL")
    )


def embed_batches(
    rows: DataFrame,
    key: str,
    owner: str,
    text: str,
    embed: Callable[[list], list],
    batch: int = 100,
) -> DataFrame:
    """Embed texts with any function, at most `batch` texts a call.

    Every task makes one call after the other, so as many calls run at a time as the session has task slots;
    the number of partitions follows from the rows. The answers are written, so a text is sent once
    whatever is done with them.

    Args:
        rows: (key, owner, text).
        key: The id of a row.
        owner: The id a failure counts against: when any row of it fails, none gets a vector.
        text: What is embedded.
        embed: From a list of texts to one vector each; runs in the tasks.
        batch: Texts of one call.

    Returns:
        (key, owner, embedding, error), exactly one of the last two set.
    """
    need(rows, key, owner, text)
    types = {name: rows.schema[name].dataType for name in (key, owner)}
    schema = T.StructType(
        [
            T.StructField(key, types[key]),
            T.StructField(owner, types[owner]),
            T.StructField("embedding", T.ArrayType(T.FloatType())),
            T.StructField("error", T.StringType()),
        ]
    )

    def answers(batches: Iterator[pa.RecordBatch]):
        for found in batches:
            for start in range(0, found.num_rows, batch):
                part = found.slice(start, batch)
                texts = part.column(text).to_pylist()
                error = None
                vectors = [None] * len(texts)
                try:
                    given = list(embed(texts))
                    if len(given) != len(texts):
                        raise ValueError(f"{len(given)} vectors for {len(texts)} inputs")
                    vectors = given
                except Exception as raised:
                    error = f"{type(raised).__name__}: {raised}"
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(key),
                        part.column(owner),
                        pa.array(vectors, pa.list_(pa.float32())),
                        pa.array([error] * len(texts), pa.string()),
                    ],
                    names=[key, owner, "embedding", "error"],
                )

    embedded = written(rows.select(key, owner, text).mapInArrow(answers, schema), "embedded")
    failed = (
        embedded.where(F.col("error").isNotNull())
        .groupBy(owner)
        .agg(F.min("error").alias("_failed"))
    )
    # The rows of one owner are the units of one file, which its size bounds.
    return embedded.join(failed, owner, "left").select(
        key,
        owner,
        F.when(F.col("_failed").isNull(), F.col("embedding")).alias("embedding"),
        F.col("_failed").alias("error"),
    )
