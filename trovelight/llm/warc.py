"""A Spark data source for web archives (WARC 1.1): partitions by file, filters on record types and headers.

Headers are parsed first; the payload of a record that the filters reject, or that is not wanted, is passed over
without being read (plain files) or decompressed (gzip members that tell their length, as this writer's do; other
gzip files have to be decompressed to find the next record).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    StringStartsWith,
    WriterCommitMessage,
)

from trovelight.llm.common import attach, prepared, written

SCHEMA = T.StructType(
    [
        T.StructField("record_type", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload_length", T.LongType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("date", T.StringType()),
    ]
)
# The headers of the string columns. The last one is an extension: the length of a payload that a revisit leaves out.
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "date": "WARC-Date",
}
LENGTH = "X-Payload-Length"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# A commit's list of its files, under a name of its own.
MANIFEST = re.compile(r"_manifest(-[0-9a-f]+)?\.json")
# Records whose payload is their block; the digest of a payload says nothing of the others' blocks.
WHOLE_BLOCKS = ("response", "resource", "conversion")
# Bytes after which a writer starts another file, and files a reader's partition takes together.
FILE_BYTES = 128 << 20
BATCH_BYTES = 4 << 20
WINDOW = 1 << 20


@dataclass
class Files(InputPartition):
    """Files that one task reads."""

    def __init__(self, paths: tuple[str, ...]) -> None:
        self.paths = paths


@dataclass
class Written(WriterCommitMessage):
    """Files that one task wrote, with their sizes."""

    files: tuple[tuple[str, int], ...]


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _one_line(value: str) -> str:
    """Control characters, which would end a header, as percent escapes."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _bare(value: str | None) -> str | None:
    return value[1:-1] if value and value[0] == "<" and value[-1] == ">" else value


def member(data: bytes) -> bytes:
    """`data` as a gzip member whose header tells its length: the extra field "sl" of compressed and plain bytes."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    if max(size, len(data)) >= 1 << 32:
        return gzip.compress(data, 6, mtime=0)
    head = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(data))
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def member_length(head: bytes) -> int | None:
    """The compressed length of the member that starts here, where its header tells it."""
    if len(head) < 24 or head[:4] != b"\x1f\x8b\x08\x04":
        return None
    extra, name, size, length, _ = struct.unpack("<H2sHII", head[10:24])
    return length if (extra, name, size) == (12, b"sl", 8) else None


def record(row: dict, date: str) -> bytes:
    """One record in WARC form; a revisit has no block. `date` is for rows without one."""
    kind, payload = row["record_type"], row["payload"] or b""
    row = {**row, "date": row["date"] or date}
    lines = ["WARC/1.1"]
    for column, header in HEADERS.items():
        if row[column] is not None:
            value = _one_line(row[column])
            lines.append(f"{header}: <{value}>" if column in ("record_id", "refers_to") else f"{header}: {value}")
    lines.append(f"{LENGTH}: {row['payload_length']}")
    if kind == "revisit":
        lines.append(f"WARC-Profile: {PROFILE}")
        payload = b""
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""]
    return b"".join(["\r\n".join(lines).encode(), payload, b"\r\n\r\n"])


class Writer(DataSourceArrowWriter):
    """Every task writes files under names of its own; the job's commit lists those of the attempts that count.

    A commit's list joins those that are there. One that overwrites names the lists it replaces, so that the old
    files are gone at once, and then removes both.
    """

    def __init__(self, options: dict, overwrite: bool = False) -> None:
        self.path = options["path"].rstrip("/")
        self.zipped = options.get("compression", "none") == "gzip"
        self.date = options.get("date") or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        self.overwrite = overwrite
        self.file_bytes = int(options.get("filebytes", FILE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = _opened(self.path)
        system.create_dir(folder, recursive=True)
        files, out, name, size = [], None, "", 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    data = record(row, self.date)
                    data = member(data) if self.zipped else data
                    if out is None:
                        name, size = f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.zipped, 0
                        # Compression is done by record, not detected from the name.
                        out = system.open_output_stream(f"{folder}/{name}", compression=None)
                    out.write(data)
                    size += len(data)
                    if size >= self.file_bytes:
                        out.close()
                        files.append((name, size))
                        out = None
        finally:
            if out is not None:
                out.close()
        if out is not None:
            files.append((name, size))
        return Written(tuple(files))

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = _opened(self.path)
        system.create_dir(folder, recursive=True)
        listed = sorted(tuple(file) for message in messages if message for file in message.files)
        old = _listed_files(system, folder) if self.overwrite else []
        others = [info.base_name for info in system.get_file_info(fs.FileSelector(folder))] if self.overwrite else []
        replaced = [name for name in others if MANIFEST.fullmatch(name)]
        with system.open_output_stream(f"{folder}/_manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps({"files": listed, "replaces": replaced}).encode())
        for name in [*(name for name, _ in old), *replaced]:
            system.delete_file(f"{folder}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        """Nothing is listed, so nothing is read."""


def _listed_files(system: fs.FileSystem, folder: str) -> list[tuple[str, int]]:
    """The archive's files and sizes: what all commits list, or, where there is no list, what lies in the folder."""
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    lists = {}
    for info in found:
        if MANIFEST.fullmatch(info.base_name):
            with system.open_input_stream(f"{folder}/{info.base_name}") as file:
                held = json.loads(file.read())
            lists[info.base_name] = held if isinstance(held, dict) else {"files": held, "replaces": []}
    if not lists:
        return sorted((info.base_name, info.size) for info in found if re.search(r"\.warc(\.gz)?$", info.base_name))
    replaced = {name for one in lists.values() for name in one["replaces"]}
    return sorted((name, size) for key, one in lists.items() if key not in replaced for name, size in one["files"])


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"].rstrip("/")
        self.payloads = options.get("payloads", "true") == "true"
        self.verify = options.get("verify", "true") == "true"
        self.file_bytes = int(options.get("filebytes", FILE_BYTES))
        self.filters: list[tuple[str, str, tuple[str, ...]]] = []
        # Bytes that gzip members were decompressed to.
        self.decompressed = 0

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality on a header and prefixes of one are tested before the payload; the others are Spark's."""
        for one in filters:
            column = one.attribute[0] if getattr(one, "attribute", None) and len(one.attribute) == 1 else None
            if column in HEADERS and isinstance(one, EqualTo) and isinstance(one.value, str):
                self.filters.append((column, "in", (one.value,)))
            elif column in HEADERS and isinstance(one, In) and all(isinstance(v, str) for v in one.value):
                self.filters.append((column, "in", tuple(one.value)))
            elif column in HEADERS and isinstance(one, StringStartsWith):
                self.filters.append((column, "prefix", (one.value,)))
            else:
                yield one

    def partitions(self) -> list[Files]:
        """The archive's files, large ones alone and small ones together up to `filebytes`.

        A folder that this source wrote is read by its list; any other by what lies in it.
        """
        system, folder = _opened(self.path)
        if system.get_file_info(folder).type != fs.FileType.Directory:
            raise FileNotFoundError(self.path)
        sizes = _listed_files(system, folder)
        parts, together, total = [], [], 0
        for name, size in sizes:
            if together and total + size > self.file_bytes:
                parts.append(Files(tuple(together)))
                together, total = [], 0
            together.append(name)
            total += size
        return [*parts, Files(tuple(together))]

    def _wanted(self, row: dict) -> bool:
        for column, how, values in self.filters:
            value = row[column]
            if value is None or (value not in values if how == "in" else not value.startswith(values[0])):
                return False
        return True

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(f.name, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[f.dataType.typeName()]) for f in SCHEMA.fields])
        system, folder = _opened(self.path)
        rows, held = [], 0
        for name in partition.paths:
            with system.open_input_file(f"{folder}/{name}") as raw:
                for row in self._rows(raw, name):
                    rows.append(row)
                    held += len(row["payload"] or b"") + 200
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def _rows(self, raw, name: str) -> Iterator[dict]:
        if not name.endswith(".gz"):
            yield from self._records(raw, name)
            return
        at = 0
        while (length := member_length(raw.read(24))) is not None:
            raw.seek(at)
            yield from self._records(_Member(raw, length, self), name)
            at += length
            raw.seek(at)
        raw.seek(at)
        yield from self._records(gzip.GzipFile(fileobj=raw), name)

    def _records(self, source, name: str) -> Iterator[dict]:
        data, at, offset = b"", 0, 0  # offset: of data[0] in the file

        def up_to(stop: int) -> None:
            nonlocal data
            while len(data) < stop and (more := source.read(max(WINDOW, stop - len(data)))):
                data += more

        while True:
            while (end := data.find(b"\r\n\r\n", at)) < 0:
                more = source.read(WINDOW)
                if not more:
                    if data[at:].strip():
                        raise ValueError(f"{name}: a record at byte {offset + at} has no end of its headers")
                    return
                data, at, offset = data[at:] + more, 0, offset + at
            version, *lines = data[at:end].decode("utf-8", "replace").split("\r\n")
            if not version.startswith("WARC/"):
                raise ValueError(f"{name}: no record starts at byte {offset + at}")
            headers = {key.strip().lower(): value.strip() for key, _, value in (line.partition(":") for line in lines)}
            length = int(headers["content-length"])
            row = {column: _bare(headers.get(header.lower())) for column, header in HEADERS.items()}
            start, stop = end + 4, end + 4 + length + 4
            wanted = self._wanted(row)
            if wanted:
                http = row["record_type"] == "response" and headers.get("content-type", "").lower().startswith("application/http")
                whole = self.payloads and row["record_type"] != "revisit"
                if whole or http:
                    # Without payloads the head of a message still tells how long its entity is.
                    up_to(stop if whole else start + min(length, HTTP_HEAD))
                block = data[start : start + length]
                if whole and len(block) < length:
                    raise ValueError(f"{name}: the payload at byte {offset + start} is cut short")
                entity = entity_of(block) if http else 0
                row["payload_length"] = int(headers.get(LENGTH.lower(), length - entity))
                row["payload"] = block[entity:] if whole else None
                if whole and self.verify:
                    self._verify(row, block, headers.get("warc-block-digest", ""), f"{name}: the payload at byte {offset + start}")
                yield row
            if stop <= len(data):
                at = stop
            else:
                source.seek(offset + stop)
                data, at, offset = b"", 0, offset + stop

    def _verify(self, row: dict, block: bytes, of_block: str, where: str) -> None:
        """The digest of a payload covers the entity of an HTTP message, not its head; other types only tell their block's."""
        of_payload = (row["payload_digest"] or "") if row["record_type"] in WHOLE_BLOCKS else ""
        for told, held in ((of_payload, row["payload"]), (of_block, block)):
            if told.lower().startswith("sha1:") and digest(held).lower() != told.lower():
                raise ValueError(f"{where} has another digest than its header")


# Bytes in which the head of an HTTP message is looked for where its payload is not read.
HTTP_HEAD = 1 << 16


def entity_of(block: bytes) -> int:
    """Where the entity of an HTTP message starts: after the first empty line, at the end where there is none.

    The entity stays as it was sent, chunked or encoded as it may be.
    """
    found = re.search(rb"\r?\n\r?\n", block)
    return found.end() if found else len(block)


class _Member:
    """One gzip member of a known length as a file; what is passed over at its end is not decompressed."""

    def __init__(self, raw, length: int, reader: Reader) -> None:
        self.raw, self.left, self.reader = raw, length, reader
        self.inflate = zlib.decompressobj(31)
        self.at = 0

    def read(self, size: int) -> bytes:
        """About `size` bytes; few at first, since the headers may be all that is wanted."""
        made = b""
        while not made and self.left:
            packed = self.raw.read(min(self.left, 1 << 12 if not self.at else size))
            self.left -= len(packed)
            made = self.inflate.decompress(packed)
            if not packed:
                break
        self.at += len(made)
        self.reader.decompressed += len(made)
        return made

    def seek(self, place: int) -> None:
        """Only ever to the end of the record, which ends the member."""
        self.left = 0


class Warc(DataSource):
    """Options: path (any place that pyarrow opens), compression (none or gzip), payloads and verify (true or
    false, for reading), date (WARC-Date of rows without one; else the time of writing), filebytes.

    mode("append") adds to what is there, mode("overwrite") takes its place."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer(dict(self.options), overwrite)


def digest(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def registered(spark: SparkSession) -> SparkSession:
    """`spark` with the format "warc" and filters handed to Python sources."""
    prepared(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Warc)
    return spark


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(payload: Column) -> Column:
    """The SHA-1 of a binary column in base 32: every five hexadecimal digits are four letters."""
    hexed = F.sha1(payload)
    letters = []
    for group in range(8):
        number = F.conv(F.substring(hexed, 5 * group + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(_LETTERS), F.shiftright(number, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*letters)


def as_records(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, date: str | None = None
) -> DataFrame:
    """Pages as records in the source's schema: of equal payloads the page with the largest id is a
    response and the others revisit it.

    Payloads under `least` bytes are responses, all of them; so are all rows that share the largest id, and
    rows without an id whose equals have none either. Null payloads count as empty, null urls get no header. `date`
    names a column of WARC dates; other columns do not go into an archive.
    Payloads are equal by SHA-1 and length, as in archives. Digests are grouped with partial
    aggregation; pages stay in place unless the payloads found more than once outgrow a broadcast.
    """
    pages = pages.select(
        F.col(f"`{page_id}`").alias("page_id"),
        F.col(f"`{url}`").alias("url"),
        F.coalesce(F.col(f"`{payload}`"), F.lit("")).cast("binary").alias("payload"),
        (F.lit(None) if date is None else F.col(f"`{date}`")).cast("string").alias("date"),
    ).withColumn("digest", F.unhex(F.sha1("payload"))).withColumn("length", F.octet_length("payload").cast("long"))
    groups = written(
        pages.where(F.col("length") >= least).groupBy("digest", "length")
        .agg(F.max("page_id").alias("kept"), F.count("*").alias("copies")).where("copies > 1"),
        "warc-copies",
    )
    joined = attach(pages, groups, ["digest", "length"], "copies", ["page_id"], wide=True)
    named = lambda column: F.concat(F.lit("urn:page:"), F.col(column).cast("string"))
    revisit = F.coalesce((F.col("length") >= least) & F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept")), F.lit(False))
    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        named("page_id").alias("record_id"),
        F.col("url").alias("target_uri"),
        F.when(revisit, named("kept")).alias("refers_to"),
        F.concat(F.lit("sha1:"), sha1_base32(F.col("payload"))).alias("payload_digest"),
        F.col("length").alias("payload_length"),
        F.when(~revisit, F.col("payload")).alias("payload"),
        "date",
    )


def page_of(record_id: Column) -> Column:
    """The page id in a record's id."""
    return F.regexp_extract(record_id, r"^urn:page:(-?[0-9]+)$", 1).try_cast("long")
