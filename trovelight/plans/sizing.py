"""Broadcast joins behind a check of the size, and salted joins beyond it."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovelight.settings import DEFAULTS


def row_count_up_to(df: DataFrame, bound: int) -> int | None:
    """The number of rows, or None when there are more than `bound`; reads no further than that."""
    found = df.limit(bound + 1).count()
    return found if found <= bound else None


def fits_broadcast(df: DataFrame, max_rows: int, max_bytes: int = DEFAULTS.max_broadcast_bytes) -> bool:
    """Whether a table is small enough to be sent to every machine, by its rows and by about the bytes of their text."""
    bytes_of = F.octet_length(F.to_json(F.struct(*[F.col(f"`{name}`") for name in df.columns])))
    rows, total = df.limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum(bytes_of), F.lit(0))).first()
    return rows <= max_rows and total <= max_bytes


def spread(df: DataFrame) -> DataFrame:
    """`df` over at least as many partitions as there are cores.

    For small inputs in few files whose rows are heavy to work on; with as many splits as cores, as
    any large table has, nothing moves.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def lookup(
    rows: DataFrame,
    unique: DataFrame,
    keys: list[str],
    how: str = "inner",
    fits_broadcast: bool = False,
    rows_per_part: int = DEFAULTS.rows_per_part,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Join many rows with a side that holds one row per key, whatever a key's share of the rows.

    Where `unique` cannot be broadcast both sides are shuffled by key, and a key with more than
    `rows_per_part` rows is cut into parts of about that size: its rows are spread over them, and its
    one row is repeated for each. Other keys are joined as they are.

    Args:
        rows: The long side; one key may hold a large share of it.
        unique: The side looked things up in.
        keys: The columns both sides share.
        how: "inner", "left", "left_semi" or "left_anti".
        fits_broadcast: True when the caller has checked the size of `unique`.
        rows_per_part: The size of a part.
        counted: Rows with the same keys that cost less to count, such as the stored table that `rows` is
            computed from; by default `rows` itself is counted.
    """
    if fits_broadcast:
        return rows.join(F.broadcast(unique), keys, how)
    # Counted where the rows are read, by hash: a number and a count for each key of more than
    # `rows_per_part` rows, so 16 bytes for each million rows at most. A key that shares its hash with such
    # a key is cut as well, on both sides alike.
    hot = (
        (rows if counted is None else counted)
        .groupBy(F.xxhash64(*keys).alias("_key"))
        .agg(F.ceil(F.count("*") / rows_per_part).cast("int").alias("_parts"))
        .where(F.col("_parts") > 1)
    )
    parts = F.coalesce("_parts", F.lit(1))

    def in_parts(side: DataFrame, part) -> DataFrame:
        known = side.withColumn("_key", F.xxhash64(*keys)).join(F.broadcast(hot), "_key", "left")
        return known.withColumn("_part", part).drop("_key", "_parts")

    spread_rows = in_parts(rows, F.pmod(_spread_by(rows, keys), parts).cast("int"))
    repeated = in_parts(unique, F.explode(F.sequence(F.lit(0), parts - 1)))
    return spread_rows.join(repeated, [*keys, "_part"], how).drop("_part")


def _spread_by(rows: DataFrame, keys: list[str]) -> Column:
    """A number that tells rows of one key apart: by their numbers, their strings, or their places."""
    kinds = {field.name: field.dataType.typeName() for field in rows.schema.fields}
    others = [name for name in kinds if name not in keys]
    numbers = [name for name in others if kinds[name] in ("long", "integer", "timestamp")]
    strings = [name for name in others if kinds[name] == "string"]
    found = numbers or strings
    return F.xxhash64(*found) if found else F.monotonically_increasing_id()
