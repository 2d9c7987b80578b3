"""Intake: which files are accepted, and which of them are new."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovelight import fixed_values as fixed
from trovelight.functions import text as tx
from trovelight.plans.sizing import lookup
from trovelight.schemas import need
from trovelight.settings import DEFAULTS

UPLOAD = ["upload_id", "arrival", "collection", "filename", "sha256"]
# Columns of an upload that its asset keeps, where they are there.
KEPT = ["filename", "asset_type", "mime", "size_bytes"]


def check_size(files: DataFrame, max_bytes: int = DEFAULTS.max_upload_bytes) -> DataFrame:
    """`size_bytes`, and `size_error`: a message when the file is larger than allowed, else null."""
    need(files, "content")
    message = fixed.FILE_TOO_LARGE.format(megabytes=max_bytes // (1024 * 1024))
    return files.withColumn("size_bytes", F.octet_length("content")).withColumn(
        "size_error", F.when(F.col("size_bytes") > max_bytes, F.lit(message))
    )


# --- telling images and texts apart ------------------------------------------------------------

# How files of a format begin, in hexadecimal.
JPEG = "FFD8FF"
PNG = "89504E470D0A1A0A"
RIFF = "52494646"
WEBP = "57454250"
# Formats of images that are not accepted and could pass for text: GIF87a and GIF89a, the PNM family
# (P1 to P6 and whitespace), XPM, XBM, EPS and FITS. Others hold bytes that no text holds.
IMAGE_TEXT_FORMS = (
    "^(474946383761|474946383961|503[1-6](20|09|0A|0D)|2F2A2058504D202A2F|"
    "23646566696E6520[0-9A-F]{2,64}5F776964746820|252150532D41646F6265|53494D504C4520203D)"
)


def _hex_at(start: int, count: int) -> Column:
    return F.hex(F.substring("content", start, count))


def _number(hexadecimal: Column) -> Column:
    return F.conv(hexadecimal, 16, 10).cast("bigint")


def _reversed_bytes(hexadecimal: Column) -> Column:
    """Three bytes, the lowest first, as they are written in numbers."""
    return F.concat(*[F.substring(hexadecimal, at, 2) for at in (5, 3, 1)])


def sniff(files: DataFrame) -> DataFrame:
    """`asset_type`, `mime` and `reject_reason`, from the bytes alone.

    JPEG (also in its form with several pictures), PNG and WebP are images; another image format is
    refused, and so is a PNG or extended WebP whose header claims too many pixels. Other bytes are
    text when they are strict UTF-8 without a NUL. An empty file is refused.
    """
    need(files, "content")
    is_png = _hex_at(1, 8) == PNG
    is_webp = (_hex_at(1, 4) == RIFF) & (_hex_at(9, 4) == WEBP)
    png_pixels = _number(_hex_at(17, 4)) * _number(_hex_at(21, 4))
    webp_pixels = (_number(_reversed_bytes(_hex_at(25, 3))) + 1) * (
        _number(_reversed_bytes(_hex_at(28, 3))) + 1
    )
    image_mime = (
        F.when(_hex_at(1, 3) == JPEG, F.lit("image/jpeg"))
        .when(is_png & (png_pixels <= fixed.MAX_IMAGE_PIXELS), F.lit("image/png"))
        .when(
            is_webp & ((_hex_at(13, 4) != "56503858") | (webp_pixels <= fixed.MAX_IMAGE_PIXELS)),
            F.lit("image/webp"),
        )
    )
    is_text = (
        F.is_valid_utf8(F.col("content").cast("string"))
        & ~F.contains(F.col("content"), F.lit(bytes([0])))
        & ~_hex_at(1, 64).rlike(IMAGE_TEXT_FORMS)
    )
    empty = F.octet_length("content") == 0
    mime = F.when(~empty, F.coalesce(image_mime, F.when(is_text, F.lit("text/plain"))))
    return files.withColumns(
        {
            "mime": mime,
            "asset_type": F.when(mime == "text/plain", F.lit("text")).when(
                mime.isNotNull(), F.lit("image")
            ),
            "reject_reason": F.when(empty, F.lit(fixed.EMPTY_FILE)).when(
                mime.isNull(), F.lit(fixed.UNSUPPORTED_FILE)
            ),
        }
    )


def split_rejects(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The accepted files, and the refused ones with one `reason` each; size is looked at first."""
    need(files, "size_error", "reject_reason")
    reason = F.coalesce("size_error", "reject_reason")
    plain = files.drop("size_error", "reject_reason")
    return (
        files.where(reason.isNull()).select(*plain.columns),
        files.where(reason.isNotNull()).select(*plain.columns, reason.alias("reason")),
    )


def content_hash(files: DataFrame) -> DataFrame:
    """`sha256` of the bytes, in hexadecimal."""
    need(files, "content")
    return files.withColumn("sha256", F.sha2("content", 256))


# --- one asset per content ---------------------------------------------------------------------


def dedup_assets(uploads: DataFrame) -> DataFrame:
    """One asset per collection and content: the first upload, under its own name.

    Copies are folded where they are read, so a content that makes up a third of all uploads still
    reaches the shuffle as one row per task.
    """
    need(uploads, *UPLOAD)
    kept = [name for name in KEPT if name in uploads.columns]
    first = F.min_by(F.struct("upload_id", "arrival", *kept), F.struct("arrival", "upload_id"))
    return (
        uploads.groupBy("collection", "sha256")
        .agg(first.alias("_first"))
        .select(
            F.col("_first.upload_id").alias("asset_id"),
            "collection",
            "sha256",
            F.col("_first.arrival").alias("arrival"),
            *[F.col(f"_first.{name}").alias(name) for name in kept],
        )
    )


def collect_aliases(
    uploads: DataFrame, assets: DataFrame, rows_per_part: int = DEFAULTS.rows_per_part
) -> DataFrame:
    """The other names an asset's content was uploaded under, a row each: schema `ALIASES`.

    `first_arrival` gives their order. Names stay rows, never an array: nothing bounds how many
    names a content has.
    """
    need(uploads, *UPLOAD)
    need(assets, "asset_id", "collection", "sha256", "filename")
    names = uploads.groupBy("collection", "sha256", F.col("filename").alias("alias")).agg(
        F.min("arrival").alias("first_arrival")
    )
    owners = assets.select("collection", "sha256", "asset_id", F.col("filename").alias("_own"))
    return (
        lookup(names, owners, ["collection", "sha256"], rows_per_part=rows_per_part)
        .where(F.col("alias") != F.col("_own"))
        .select("collection", "sha256", "asset_id", "alias", "first_arrival")
    )


def dedup_incremental(
    uploads: DataFrame,
    assets: DataFrame,
    aliases: DataFrame,
    rows_per_part: int = DEFAULTS.rows_per_part,
) -> tuple[DataFrame, DataFrame]:
    """New uploads against stored assets.

    Returns:
        The assets to insert, and the alias rows to append: names that their asset, stored or new,
        does not have yet. Stored assets are not touched, so a copy of a failed one stays failed.
    """
    need(assets, "asset_id", "collection", "sha256", "filename")
    need(aliases, "collection", "sha256", "alias")
    content = ["collection", "sha256"]
    first = dedup_assets(uploads)
    inserts = first.join(assets.select(*content), content, "left_anti")
    owners = assets.select("asset_id", *content, "filename").unionByName(
        inserts.select("asset_id", *content, "filename")
    )
    names = collect_aliases(uploads, owners, rows_per_part)
    return inserts, names.join(aliases.select(*content, "alias"), [*content, "alias"], "left_anti").select(
        *names.columns
    )


# --- requests ----------------------------------------------------------------------------------


def check_collection_name(rows: DataFrame) -> DataFrame:
    """`name_ok`: 1 to 64 of a-z, 0-9, "_" and "-"."""
    need(rows, "collection")
    return rows.withColumn(
        "name_ok", F.coalesce(F.col("collection").rlike(fixed.COLLECTION_NAME[:-1] + r"\z"), F.lit(False))
    )


def check_query_params(queries: DataFrame, max_chars: int = DEFAULTS.max_query_chars) -> DataFrame:
    """`reject_reason` of a query: the first rule its parameters break, or null.

    Args:
        queries: (collection, q, page, order, match_kinds, asset_types, unit_kinds).
        max_chars: The longest query.
    """
    need(queries, "collection", "q", "page", "order", "match_kinds", "asset_types", "unit_kinds")

    def outside(column, allowed):
        return F.size(F.array_except(column, F.array(*[F.lit(value) for value in allowed]))) > 0

    checked = check_collection_name(queries)
    return checked.withColumn(
        "reject_reason",
        F.when(~F.col("name_ok"), F.lit("collection: not a collection name."))
        .when(F.length("q") > max_chars, F.lit(f"q: at most {max_chars} characters."))
        .when(F.col("page") < 1, F.lit("page: must be 1 or more."))
        .when(~F.col("order").isin(fixed.ORDERS), F.lit("order: not one of the orders."))
        .when(outside("match_kinds", fixed.MATCH_KINDS), F.lit("match: not one of the matches."))
        .when(
            outside("asset_types", fixed.ASSET_TYPES), F.lit("asset_type: not one of the types.")
        )
        .when(outside("unit_kinds", fixed.UNIT_KINDS), F.lit("found_in: not one of the parts."))
        .when(tx.strip(F.col("q")) == "", F.lit(fixed.BLANK_QUERY)),
    ).drop("name_ok")
