"""Metadata of files: cleaning it up, the tags every kind of file gets, and a photo's own details."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovelight import fixed_values as fixed
from trovelight.functions import text as tx
from trovelight.schemas import need


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(value) for value in values]).cast("array<string>")


def type_tags(asset_type: Column, image_type: Column) -> Column:
    """The fixed tags of a kind of file; those of an image of no known kind are the shared two."""
    tags = F.when(asset_type == "text", _strings(fixed.TEXT_TYPE_TAGS))
    for name, values in fixed.IMAGE_TYPE_TAGS.items():
        tags = tags.when(image_type == name, _strings(values))
    return tags.otherwise(_strings(fixed.IMAGE_TYPE_TAGS["other"]))


def _kept_image_type() -> Column:
    return F.when(F.col("asset_type") == "image", F.coalesce("image_type", F.lit("other")))


def _model_tags() -> Column:
    """The model's tags: lower-case, one space between words, distinct, not too long, not too many."""
    tidy = F.transform("tags", lambda tag: tx.collapse(F.lower(tx.strip(tag))))
    fitting = F.filter(tidy, lambda tag: (tag != "") & (F.length(tag) <= fixed.TAG_MAX_CHARS))
    kept = F.when(F.col("asset_type") == "image", fixed.IMAGE_TAGS_KEPT).otherwise(
        fixed.TEXT_TAGS_KEPT
    )
    return F.slice(F.array_distinct(fitting), F.lit(1), kept)


def normalise_metadata(rows: DataFrame) -> DataFrame:
    """Clean up title, description, tags, visible_text and image_type.

    Texts are trimmed and cut to their limits, the model's tags tidied and capped, and the fixed tags
    of the kind of file added after the cap. A text file has no image type; an image always has one.
    """
    need(rows, "asset_type", "title", "description", "tags", "visible_text", "image_type")
    image_type = _kept_image_type()
    return rows.withColumns(
        {
            "title": F.substring(tx.strip(F.col("title")), 1, fixed.TITLE_MAX_CHARS),
            "description": F.substring(
                tx.strip(F.col("description")), 1, fixed.DESCRIPTION_MAX_CHARS
            ),
            "visible_text": F.substring(
                tx.strip(F.col("visible_text")), 1, fixed.VISIBLE_TEXT_MAX_CHARS
            ),
            # array_union keeps the first of equal tags, so a fixed tag the model gave stays in place.
            "tags": F.array_union(_model_tags(), type_tags(F.col("asset_type"), image_type)),
            "image_type": image_type,
        }
    )


def metadata_trim_report(rows: DataFrame) -> DataFrame:
    """What cleaning up leaves out: `truncated`, the cut fields in order, and `tags_dropped`.

    Rows that lose nothing are not reported.
    """
    need(rows, "asset_id", "asset_type", "title", "description", "tags", "visible_text")
    limits = {
        "title": fixed.TITLE_MAX_CHARS,
        "description": fixed.DESCRIPTION_MAX_CHARS,
        "visible_text": fixed.VISIBLE_TEXT_MAX_CHARS,
    }
    cut = [
        F.when(F.length(tx.strip(F.col(name))) > limit, F.lit(name))
        for name, limit in limits.items()
    ]
    return rows.select(
        "asset_id",
        F.array_compact(F.array(*cut)).alias("truncated"),
        (F.size("tags") - F.size(_model_tags())).alias("tags_dropped"),
    ).where((F.size("truncated") > 0) | (F.col("tags_dropped") > 0))


def metadata_body(rows: DataFrame) -> Column:
    """The text of a metadata unit: title, description and tags, a blank line between them."""
    need(rows, "title", "description", "tags")
    tags = F.concat(F.lit("tags: "), F.array_join("tags", ", "))
    return F.concat_ws("\n\n", "title", "description", tags)


def filename_body(filename: Column) -> Column:
    """The text of a filename unit: the name, then its runs of letters and digits."""
    runs = F.regexp_extract_all(filename, F.lit(tx.WORD), F.lit(0))
    return F.concat_ws(" ", filename, runs)


def photo_details(photos: DataFrame) -> DataFrame:
    """`taken_at`, `latitude` and `longitude` from a photo's own tags, read into columns before.

    Args:
        photos: taken ("YYYY:MM:DD HH:MM:SS"), and for both axes an array of degrees, minutes and
            seconds with the letter of its half: latitude_parts, latitude_half, longitude_parts,
            longitude_half.

    A position needs both halves; all three are null when the photo carries neither date nor place,
    or when any of them cannot be read: a date of another form, or a place that is not three numbers.
    """
    need(photos, "taken", "latitude_parts", "latitude_half", "longitude_parts", "longitude_half")

    def degrees(axis):
        parts = F.col(f"{axis}_parts")
        half = F.col(f"{axis}_half")
        value = F.get(parts, 0) + F.get(parts, 1) / 60 + F.get(parts, 2) / 3600
        return F.when(half.isin("S", "W"), -value).when(half.isNotNull(), value)

    def in_three(axis):
        parts = F.col(f"{axis}_parts")
        good = (F.size(parts) == 3) & ~F.exists(parts, lambda part: part.isNull())
        return parts.isNull() | F.col(f"{axis}_half").isNull() | good

    written = tx.strip(F.col("taken"))
    readable = F.coalesce(written.rlike("^[^ ]+ [^ ]+$"), F.lit(True)) & in_three("latitude") & in_three("longitude")
    both = readable & degrees("latitude").isNotNull() & degrees("longitude").isNotNull()
    date = F.replace(F.split_part(written, F.lit(" "), F.lit(1)), F.lit(":"), F.lit("-"))
    time = F.substring(F.split_part(written, F.lit(" "), F.lit(2)), 1, 5)
    return photos.withColumns(
        {
            "taken_at": F.when(readable, F.concat(date, F.lit(" "), time)),
            "latitude": F.when(both, degrees("latitude")),
            "longitude": F.when(both, degrees("longitude")),
        }
    )
