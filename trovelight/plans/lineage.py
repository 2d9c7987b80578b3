"""Writing an intermediate result down, so that what follows does not compute it again."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the one spark.checkpoint.dir names.

    Where it is unset and everything runs in this process, as in tests, one of this machine is set. On
    a cluster without the setting this is an error, since executors could not see such a folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="trovelight-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """`df` written to the cluster's checkpoint folder and read from there.

    For small results that several later steps read.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


@contextmanager
def without_shuffles(spark: SparkSession) -> Iterator[None]:
    """What runs inside leaves no shuffle files behind.

    Only for writes: nothing runs such a plan again, while Spark would keep its files as long as the driver holds the plan.
    """
    before = spark.conf.get(CLEAN_SHUFFLES, "false")
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)


def write_table(rows: DataFrame, path: str, *by: str, mode: str = "error") -> None:
    """Write rows as Parquet, split into folders by some columns; the shuffle files go with the write."""
    writer = rows.write.mode(mode).option("compression", "zstd")
    with without_shuffles(rows.sparkSession):
        (writer.partitionBy(*by) if by else writer).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder as Parquet and read back.

    For what a model was asked, and for anything large: whatever reads it does not compute it again, and
    reads only the columns it needs.
    """
    path = new_folder(df.sparkSession, name)
    write_table(df, path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.written_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete tables from `written` that nothing reads any more, through the file system Spark writes with."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.written_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
