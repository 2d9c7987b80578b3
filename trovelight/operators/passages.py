"""From decoded text to passages, and what a description model reads of a file."""

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trovelight.fixed_values import CHARS_PER_TOKEN
from trovelight.functions import text as tx
from trovelight.schemas import need
from trovelight.settings import DEFAULTS

BYTE_ORDER_MARK = "\ufeff"
# Rows of one Arrow batch handed back; a long file's passages leave in several.
ROWS_OUT = 2000


def decode_text(files: DataFrame) -> DataFrame:
    """`text`: the content as UTF-8, without one leading byte order mark."""
    need(files, "content")
    text = F.col("content").cast("string")
    return files.withColumn(
        "text",
        F.when(text.startswith(BYTE_ORDER_MARK), F.substring(text, F.lit(2), F.length(text)))
        .otherwise(text),
    )


def summary_text(
    files: DataFrame, token_budget: int = DEFAULTS.summary_token_budget
) -> DataFrame:
    """`summary`: what a description is made from, and `summary_of`: "whole" or "head"."""
    need(files, "text")
    budget = token_budget * CHARS_PER_TOKEN
    fits = F.length("text") <= budget
    return files.withColumn(
        "summary", F.when(fits, F.col("text")).otherwise(F.substring("text", 1, budget))
    ).withColumn("summary_of", F.when(fits, F.lit("whole")).otherwise(F.lit("head")))


def windows(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """The (start, end) of every passage of one text, edges trimmed; see `chunk_text`.

    The places of all spaces are listed once; where a window ends and the next one starts are searches
    in that list.
    """
    spaces = [found.start() for found in re.finditer(" ", text)]
    start, end = 0, 0
    while end < len(text):
        end = min(start + size, len(text))
        if end < len(text) and (before := bisect_left(spaces, end)) and spaces[before - 1] > start:
            end = spaces[before - 1]
        if body := text[start:end].strip():
            first = text.index(body, start)
            yield first, first + len(body)
        after = bisect_left(spaces, max(end - overlap, start + 1))
        start = spaces[after] + 1 if after < len(spaces) and spaces[after] < end else end


def chunk_text(
    files: DataFrame,
    size: int = DEFAULTS.chunk_size,
    overlap: int = DEFAULTS.chunk_overlap,
    keys: tuple[str, ...] = ("asset_id", "collection"),
) -> DataFrame:
    """Overlapping passages of every text, as rows (*keys, unit_index, start_char, end_char, text).

    A window holds at most `size` characters and ends before its last space; the next one starts
    after a space within the last `overlap` characters. Every cut depends on the one before it, so
    a text is walked in Python, a batch of texts at a time and without a shuffle.
    """
    need(files, *keys, "text")
    key_types = {name: files.schema[name].dataType for name in keys}
    schema = T.StructType(
        [T.StructField(name, key_types[name]) for name in keys]
        + [
            T.StructField("unit_index", T.IntegerType()),
            T.StructField("start_char", T.IntegerType()),
            T.StructField("end_char", T.IntegerType()),
            T.StructField("text", T.StringType()),
        ]
    )

    def cut(batches):
        for batch in batches:
            names = [*keys, "unit_index", "start_char", "end_char", "text"]
            rows = []
            texts = batch.column("text")
            for place, key in enumerate(zip(*[batch.column(name).to_pylist() for name in keys])):
                # One text at a time: as strings a batch takes several times its bytes.
                text = texts[place].as_py() or ""
                for index, (start, end) in enumerate(windows(text, size, overlap)):
                    rows.append((*key, index, start, end, text[start:end]))
                    if len(rows) == ROWS_OUT:
                        yield _batch(rows, names, batch, keys)
                        rows = []
            if rows:
                yield _batch(rows, names, batch, keys)

    return files.select(*keys, "text").mapInArrow(cut, schema)


def _batch(rows, names, batch, keys):
    types = [batch.schema.field(name).type for name in keys]
    types += [pa.int32(), pa.int32(), pa.int32(), pa.string()]
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(column, kind) for column, kind in zip(columns, types)], names=names
    )


def split_sentences(rows: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """The sentences of every text, as rows (*keys, start, end, text); see `functions.text.sentences`."""
    need(rows, *keys, text)
    return rows.select(*keys, F.explode(tx.sentences(F.col(text))).alias("_sentence")).select(
        *keys, "_sentence.start", "_sentence.end", "_sentence.text"
    )
