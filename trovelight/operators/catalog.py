"""What collections hold: listing, finding, counting and deleting."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trovelight.fixed_values import STATUSES
from trovelight.schemas import need


def list_assets(assets: DataFrame, collection: str) -> DataFrame:
    """Every asset of a collection, whatever its status, newest first."""
    need(assets, "asset_id", "collection", "created_at")
    return assets.where(F.col("collection") == collection).orderBy(
        F.col("created_at").desc(), "asset_id"
    )


def get_assets(ids: DataFrame, assets: DataFrame) -> DataFrame:
    """The asset of every id; `found` is false where there is none."""
    need(ids, "asset_id")
    return ids.join(assets.withColumn("found", F.lit(True)), "asset_id", "left").withColumn(
        "found", F.coalesce("found", F.lit(False))
    )


def list_collections(assets: DataFrame) -> DataFrame:
    """The name of every collection and how many assets it holds, by name."""
    need(assets, "collection")
    return (
        assets.groupBy("collection").agg(F.count("*").alias("asset_count")).orderBy("collection")
    )


def delete_collection(
    collection: str, assets: DataFrame, **others: DataFrame
) -> tuple[dict[str, DataFrame], DataFrame]:
    """What remains of every table, by name, and the number of assets deleted as one row.

    Every row carries its collection, so rows go without a join, and stored tables, which are split by
    collection, lose whole folders. Blobs stay, since other collections may share them; deleting a
    collection that is not there deletes nothing.

    Args:
        collection: The collection.
        assets: All assets.
        **others: Whatever belongs to assets: units, postings, vectors, aliases.
    """
    tables = {"assets": assets, **others}
    for table in tables.values():
        need(table, "collection")
    deleted = assets.agg(F.count_if(F.col("collection") == collection).alias("deleted"))
    return {
        name: table.where(F.col("collection") != collection) for name, table in tables.items()
    }, deleted


def status_summary(assets: DataFrame) -> DataFrame:
    """Per collection the number of assets, and of those pending, processing, ready and failed."""
    need(assets, "collection", "status")
    return assets.groupBy("collection").agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("status") == status).alias(status) for status in STATUSES],
    )


METADATA = ["title", "description", "tags", "visible_text", "image_type", "vision_model"]


def asset_view(assets: DataFrame) -> DataFrame:
    """The public form of an asset: its metadata as a struct, only once it is ready."""
    need(assets, "asset_id", "collection", "filename", "asset_type", "mime", "size_bytes", "status")
    need(assets, "error", "created_at", *METADATA)
    return assets.select(
        "asset_id",
        "collection",
        "filename",
        "asset_type",
        "mime",
        "size_bytes",
        "status",
        "error",
        "created_at",
        F.when(F.col("status") == "ready", F.struct(*METADATA)).alias("metadata"),
    )


def asset_aliases(assets: DataFrame, aliases: DataFrame) -> DataFrame:
    """The other names of every asset, a row each, in the order they came: (asset_id, alias, place).

    Part of the public form of an asset. Rows, not an array, since nothing bounds how many names a
    content has; places follow the first arrival, then the name.
    """
    need(assets, "asset_id")
    need(aliases, "asset_id", "alias", "first_arrival")
    known = aliases.join(assets.select("asset_id"), "asset_id", "left_semi")
    in_order = W.partitionBy("asset_id").orderBy("first_arrival", "alias")
    return known.select("asset_id", "alias", F.row_number().over(in_order).alias("place"))
