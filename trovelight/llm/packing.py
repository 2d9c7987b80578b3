"""Best-fit packing of token sequences, as a tree: partitions pack, emit nearly full bins, and hand on the
others, which are packed again as items of fewer and fewer tasks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trovelight.llm.common import BROADCAST_ROWS, prepared, row_field, row_of, written
from trovelight.llm.tokens import encoder_of_json

CAPACITY = 2048
# A bin with less room than this is nearly full and emitted.
SLACK = 32
# Underfull bins that one task of the first merging round packs, and how many times that a later one may.
BINS_PER_TASK = 100_000
MOST_BINS = 16
# Ids in an output batch.
BATCH_IDS = 1 << 20


def token_pieces(
    docs: DataFrame, tokenizer: str, carry: list[str] | None = None, text: str = "text", capacity: int = CAPACITY, added_tokens: bool = False
) -> DataFrame:
    """The token ids of each row of `docs` followed by id 0, cut into pieces of at most `capacity` ids.

    A document that fits is one piece. A longer one is cut so that all pieces but the first are full.
    A null text counts as empty, and an empty one is the single id 0. The result has the carried
    columns (by default all) as struct `row`, piece (from 0), start (the document's ids before it), length, and ids: little-endian unsigned
    32-bit numbers, as training loaders map them.

    Args:
        tokenizer: The path of a byte-level BPE in the JSON form of the tokenizers library, on every executor.
        added_tokens: Whether the contents of its added tokens in a text are those tokens, not ordinary text.
    """
    prepared(docs.sparkSession)
    schema = T.StructType(
        [
            row_field(docs, carry),
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_of_json(tokenizer, added_tokens)
        for batch in batches:
            rows, pieces, starts, lengths, ids, held = [], [], [], [], [], 0

            def out():
                kept = batch.column(0).take(pa.array(rows, pa.int32()))
                return pa.RecordBatch.from_arrays(
                    [kept, pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary())],
                    names=schema.names,
                )

            for row, value in enumerate(batch.column(1)):
                tokens = np.array([*encode(value.as_py() or ""), 0], "<u4")
                start, end = 0, len(tokens) % capacity or capacity
                piece = 0
                while start < len(tokens):
                    part = tokens[start:end]
                    rows.append(row)
                    pieces.append(piece)
                    starts.append(start)
                    lengths.append(len(part))
                    ids.append(part.tobytes())
                    start, end, piece = end, end + capacity, piece + 1
                held += len(tokens)
                if held >= BATCH_IDS:
                    yield out()
                    rows, pieces, starts, lengths, ids, held = [], [], [], [], [], 0
            if rows:
                yield out()

    return docs.select(row_of(docs, carry), F.col(f"`{text}`").alias("text")).mapInArrow(cut, schema)


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Longest first, each item goes to the bin whose room it leaves smallest, or to a new one.

    Gives each item's bin and place, and each bin's fill. Rooms are whole numbers, so the bins wait in
    one stack per room and the bits of one integer tell which stacks have any.
    """
    bins, places, fills = [0] * len(lengths), [0] * len(lengths), []
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        length = lengths[item]
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            chosen = waiting[room].pop()
            if not waiting[room]:
                rooms ^= 1 << room
        else:
            room, chosen = capacity, len(fills)
            fills.append(0)
        bins[item], places[item] = chosen, capacity - room
        fills[chosen] = capacity - room + length
        if room > length:
            waiting[room - length].append(chosen)
            rooms |= 1 << (room - length)
    return bins, places, fills


def pack(
    items: DataFrame,
    length: str = "length",
    capacity: int = CAPACITY,
    slack: int = SLACK,
    bins_per_task: int = BINS_PER_TASK,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Every row of `items` as struct `row` with sequence_id, offset and fill of the bin it is packed into.

    Every partition packs its own items and holds only their lengths and other columns, which should be
    narrow. Bins with less than `slack` room are emitted; the others are packed as items of ceil(bins /
    bins_per_task) tasks, then of half as many, and so on until one task has seen all that is left; every round deals
    bins anew. A task holds at most MOST_BINS times `bins_per_task` bins; where more than one task needs to stay,
    because bins are too full to go together, rounds end once one saves less than a hundredth of the bins. Items are 1 to `capacity` long; other lengths are an error. An empty table gives an
    empty one.
    """
    spark = prepared(items.sparkSession)
    schema = T.StructType(
        [row_field(items), *[T.StructField(name, T.LongType()) for name in ("bin", "place", "fill")]]
    )

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        lengths = table.column(1).to_pylist()
        if min(lengths) < 1 or max(lengths) > capacity:
            raise ValueError(f"items have lengths {min(lengths)} to {max(lengths)}; bins hold 1 to {capacity}")
        bins, places, fills = best_fit(lengths, capacity)
        chosen = np.array(bins, np.int64)
        columns = [chosen + first, np.array(places, np.int64), np.array(fills, np.int64)[chosen]]
        table = table.select([0])
        for name, values in zip(("bin", "place", "fill"), columns, strict=True):
            table = table.append_column(name, pa.array(values))
        yield from table.combine_chunks().to_batches()

    placed = written(items.select(row_of(items), F.col(f"`{length}`").cast("long").alias("length")).mapInArrow(local, schema), "packed")

    # Underfull bins by now: which bin, where in it, and how full that is. The member at shift 0 stands for the bin.
    merged = T.StructType([T.StructField(name, T.LongType()) for name in ("bin", "into", "shift", "fill")])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        member, into, shift, fill = (table.column(i).to_numpy() for i in range(4))
        bins, index, which = np.unique(into, return_index=True, return_inverse=True)
        chosen, places, fills = (np.array(x, np.int64) for x in best_fit(fill[index].tolist(), capacity))
        ids = np.zeros(len(fills), np.int64)
        ids[chosen[places == 0]] = bins[places == 0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(member), pa.array(ids[chosen[which]]), pa.array(shift + places[which]), pa.array(fills[chosen[which]])],
            names=merged.names,
        )

    underfull = F.col("fill") <= capacity - slack
    live = placed.where(underfull & (F.col("place") == 0)).select("bin", F.col("bin").alias("into"), F.lit(0).cast("long").alias("shift"), "fill")
    moved, left = None, live.count()
    tasks, turn = 2 * math.ceil(left / bins_per_task), 0
    while left > 1:
        least = math.ceil(left / (MOST_BINS * bins_per_task))
        before, tasks, turn = tasks, max(least, min(math.ceil(left / bins_per_task), tasks // 2)), turn + 1
        spread = live.repartition(tasks, F.xxhash64("into", F.lit(turn))) if tasks > 1 else live.repartition(1)
        done = written(spread.mapInArrow(merge, merged), "merged")
        now = done.where("shift = 0").count()
        finished = tasks == 1 or (tasks == before and now > 0.99 * left)
        settled = done if finished else done.where(~underfull)
        moved = settled if moved is None else moved.unionByName(settled)
        if finished:
            break
        live = done.where(underfull)
        left = live.where("shift = 0").count()
    if moved is None:
        moved = spark.createDataFrame([], merged)
    small = moved.count() <= broadcast_rows
    moved = moved.select("bin", "into", "shift", F.col("fill").alias("_fill"))
    return placed.join(F.broadcast(moved) if small else moved, "bin", "left").select(
        "row",
        F.coalesce("into", "bin").alias("sequence_id"),
        (F.col("place") + F.coalesce("shift", F.lit(0))).alias("offset"),
        F.coalesce("_fill", "fill").alias("fill"),
    )


def sequences(pieces: DataFrame, packed: DataFrame, keys: list[str]) -> DataFrame:
    """The packed sequences themselves, sequence_id and ids: `pieces` with unique `keys` and ids, `packed` with keys and places."""
    joined = pieces.select(*keys, "ids").join(packed.select(*keys, "sequence_id", "offset"), keys)
    return joined.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts")
    ).select("sequence_id", F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"])).alias("ids"))


def packed_documents(
    docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, added_tokens: bool = False
) -> DataFrame:
    """Every piece of every document with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset, fill."""
    pieces = token_pieces(docs, tokenizer, [doc_id], text, capacity, added_tokens)
    narrow = pieces.select(F.col(f"row.`{doc_id}`").alias("doc_id"), "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(narrow, capacity=capacity).select("row.*", "sequence_id", "offset", "fill")
