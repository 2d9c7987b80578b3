"""What the operators of this folder share: written intermediate tables and joins that hold under skew."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A side of a join is broadcast up to this many rows and bytes of keys and values.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16 << 20
# Rows of one key that a single task joins.
ROWS_PER_PART = 100_000


def prepared(spark: SparkSession) -> SparkSession:
    """`spark` with Arrow batches small enough for whole texts; functions travel with their code."""
    cloudpickle.register_pickle_by_value(sys.modules["trovelight"])
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "32MB")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it is unset and everything runs in one process, as in tests, a folder of this machine; on a
    cluster without the setting this is an error, since executors could not see such a folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="trovelight-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/trovelight/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder as Parquet and read back.

    What follows does not compute it again, and a lost executor costs its running tasks only. Ids from
    `monotonically_increasing_id` are fixed by this.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.written_path = path
    return back


def discard(table: DataFrame) -> None:
    """Delete a table from `written` that nothing reads any more, through the file system Spark writes with."""
    context = table.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(table.written_path)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def row_of(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Columns of `df`, by default all, as one struct `row`, so that no name can clash with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in (df.columns if columns is None else columns)]).alias("row")


def row_field(df: DataFrame, columns: list[str] | None = None) -> T.StructField:
    """The field of `row_of`."""
    return T.StructField("row", T.StructType([df.schema[c] for c in (df.columns if columns is None else columns)]))


def let(value: Column, body) -> Column:
    """`body` of `value`, which is computed once however often `body` names it, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def attach(
    rows: DataFrame,
    groups: DataFrame,
    keys: list[str],
    size: str,
    spread_by: list[str],
    how: str = "left",
    wide: bool = False,
    broadcast_rows: int = BROADCAST_ROWS,
    rows_per_part: int = ROWS_PER_PART,
) -> DataFrame:
    """Join many rows with a written table of one row per key, whatever a key's share of the rows.

    Both sides are shuffled by key. A key of more than `rows_per_part` rows is cut into parts, its rows are
    spread over them by `spread_by`, and its one row is repeated for each part. Where `rows` is `wide`,
    as whole texts are, and the groups are up to `broadcast_rows` rows and BROADCAST_BYTES, those are
    broadcast instead, so that the texts stay in place.

    Args:
        rows: The long side.
        groups: One row per key, written; column `size` has how many rows of `rows` have the key. Keys
            are never null.
    """
    if wide:
        row = F.lit(0)
        for field in groups.schema.fields:
            variable = field.dataType.typeName() in ("string", "binary")
            row = row + (F.coalesce(F.octet_length(field.name), F.lit(0)) if variable else F.lit(16))
        count, total = groups.agg(F.count("*"), F.coalesce(F.sum(row), F.lit(0))).first()
        if count <= broadcast_rows and total <= BROADCAST_BYTES:
            return rows.join(F.broadcast(groups), keys, how)
    largest = groups.agg(F.max(size)).first()[0] or 0
    if largest <= rows_per_part:
        return rows.join(groups, keys, how)
    key = F.xxhash64(*keys)
    # Few: each stands for more than `rows_per_part` rows. A cold key with the same hash is cut as well,
    # on both sides alike.
    hot = (
        groups.where(F.col(size) > rows_per_part)
        .groupBy(key.alias("_key"))
        .agg(F.ceil(F.max(size) / rows_per_part).cast("int").alias("_parts"))
    )
    parts = F.coalesce("_parts", F.lit(1))
    spread = (
        rows.withColumn("_key", key)
        .join(F.broadcast(hot), "_key", "left")
        .withColumn("_part", F.pmod(F.xxhash64(*spread_by), parts).cast("int"))
        .drop("_key", "_parts")
    )
    repeated = (
        groups.withColumn("_key", key)
        .join(F.broadcast(hot), "_key", "left")
        .withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
        .drop("_key", "_parts")
    )
    return spread.join(repeated, [*keys, "_part"], how).drop("_part")
