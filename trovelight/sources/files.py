"""Files as rows, in batch and as a stream."""

import hashlib

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BINARY_FILE = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


# Files of more bytes are hashed piece by piece where they lie; smaller ones by Spark, as it reads them.
LARGE = 64 << 20
PIECE = 8 << 20


def _digest(path: str, size: int) -> str:
    """The SHA-256 of a file of any size, read by the task."""
    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        local = "/" + (rest if colon else path).lstrip("/")
        opened = open(local, "rb")
    else:
        store, name = fs.FileSystem.from_uri(path)
        opened = store.open_input_stream(name)
    digest, n = hashlib.sha256(), 0
    with opened as file:
        while piece := file.read(PIECE):
            digest.update(piece)
            n += len(piece)
    if n != size:
        raise OSError(f"{path} has {n} bytes, {size} when it was listed")
    return digest.hexdigest()


def _shape(files: DataFrame, digest: bool) -> DataFrame:
    columns = [
        F.col("path"),
        F.regexp_extract("path", "([^/]+)$", 1).alias("filename"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified_at"),
        F.col("content"),
    ]
    if not digest:
        return files.select(*columns)
    # Read apart, so that nobody who asks for the hash alone reads a large file into one value.
    small, large = files.where(F.col("length") <= LARGE), files.where(F.col("length") > LARGE)
    piecewise = F.udf(_digest, "string", useArrow=False)("path", "length")
    return small.select(*columns, F.sha2("content", 256).alias("sha256")).unionByName(
        large.select(*columns, piecewise.alias("sha256"))
    )


def read_files(spark: SparkSession, path: str, pattern: str = "*", digest: bool = False) -> DataFrame:
    """Every file below a folder: (path, filename, size_bytes, modified_at, content).

    Empty files are not listed by Spark's file sources, so they are left out here rather than refused
    later. A file of more than 2 GB is an error for whoever reads its content, since no value holds it.

    Args:
        spark: The session.
        path: The folder.
        pattern: The names of the files.
        digest: Whether to add `sha256`, that of the whole file whatever its size. Large files must lie in a store that
            Python reads as well: a folder all machines see, or one that `pyarrow.fs` knows.
    """
    return _shape(
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(path),
        digest,
    )


def read_files_stream(
    spark: SparkSession, path: str, pattern: str = "*", files_per_batch: int = 1000, digest: bool = False
) -> DataFrame:
    """The same as a stream: files that arrive in the folder, at most some thousand a micro-batch.

    With `digest` the folder is two sources of the stream, its small and its large files.
    """
    return _shape(
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILE)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(path),
        digest,
    )


def files_of_documents(documents: DataFrame) -> DataFrame:
    """Files from a table of texts, for collections that arrive as rows: one upload per document."""
    return documents.select(
        F.col("doc_id").alias("upload_id"),
        F.col("doc_id").alias("arrival"),
        F.col("lang").alias("collection"),
        F.concat("source", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias(
            "filename"
        ),
        F.encode("text", "UTF-8").alias("content"),
    )
