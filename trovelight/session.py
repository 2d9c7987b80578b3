"""The session settings the operators rely on."""

import sys

from pyspark import cloudpickle
from pyspark.sql import SparkSession

# What every session needs, on a laptop or a cluster. Shuffle partitions start high and adaptive
# execution merges the small ones, so one setting serves both ends of the scale.
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join even where that costs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # An Arrow batch is bounded by rows and by bytes, since texts may have 10 MiB.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "64MB",
}


def configure(spark: SparkSession) -> SparkSession:
    """Put the settings above on a session that somebody else built.

    Functions of this package travel to the tasks with their code, so the package need not be
    installed there.
    """
    cloudpickle.register_pickle_by_value(sys.modules["trovelight"])
    for name, value in CONF.items():
        spark.conf.set(name, value)
    return spark


def local_session(cpus: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session of this machine, for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("trovelight")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for name, value in CONF.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
