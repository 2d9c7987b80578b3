"""Byte-level BPE: encoding by a segment tree over a piece's byte positions, and decoding.

A leaf of the tree holds the rank of the pair that starts at its position, an inner node the smallest rank
below it. A merge goes down to the leftmost smallest leaf, joins the pair, and updates the leaves of the two
neighbours and of the position that fell away, each in as many steps as the tree has levels.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trovelight.llm.common import prepared, row_field, row_of
from trovelight.llm.tokens import ranks_of_lines

NONE = np.int32(2**31 - 1)
# Pieces of up to so many bytes go through trees side by side.
TOGETHER = 64
# Pieces whose ids a task remembers.
REMEMBERED = 400_000
# Trees that are worked on at once.
TREES = 20_000


class Vocabulary:
    """Ranks of tokens, and the rank of every pair of tokens that makes one."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[key] for key in self.keys.tolist()], np.int32)
        self.bytes_pairs = self.rank(np.repeat(self.single, 256), np.tile(self.single, 256)).reshape(256, 256)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, NONE where they make no token."""
        wanted = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.merged[at], NONE)

    def together(self, pieces: list[bytes], width: int) -> list[tuple[int, ...]]:
        """The ids of pieces of 2 to `width` bytes, a power of two: one tree a piece, merged in step."""
        count = len(pieces)
        lengths = np.array([len(piece) for piece in pieces])
        text = np.frombuffer(b"".join(piece.ljust(width, b"\0") for piece in pieces), np.uint8).reshape(count, width)
        ids = self.single[text]
        place = np.arange(width)
        after = np.tile(np.arange(1, width + 1), (count, 1))
        before = np.tile(np.arange(-1, width - 1), (count, 1))
        live = place < lengths[:, None]
        tree = np.full((count, 2 * width), NONE, np.int32)
        tree[:, width : 2 * width - 1] = np.where(live[:, 1:], self.bytes_pairs[text[:, :-1], text[:, 1:]], NONE)
        for node in range(width - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])

        def update(rows: np.ndarray, at: np.ndarray, rank: np.ndarray) -> None:
            node = at + width
            tree[rows, node] = rank
            while (node := node >> 1)[0]:
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        rows = np.flatnonzero(tree[:, 1] != NONE)
        while len(rows):
            least = tree[rows, 1]
            node = np.ones(len(rows), np.int64)
            for _ in range(width.bit_length() - 1):
                node = 2 * node
                node += tree[rows, node] != least
            at = node - width
            gone = after[rows, at]
            then = after[rows, gone]
            ids[rows, at] = least
            live[rows, gone] = False
            after[rows, at] = then
            follows = then < lengths[rows]
            before[rows[follows], then[follows]] = at[follows]
            update(rows, gone, np.full(len(rows), NONE))
            right = ids[rows, np.minimum(then, width - 1)]
            update(rows, at, np.where(follows, self.rank(least, right), NONE))
            first = before[rows, at]
            has = first >= 0
            if has.any():
                update(rows[has], first[has], self.rank(ids[rows[has], first[has]], least[has]))
            rows = rows[tree[rows, 1] != NONE]
        flat = ids[live].tolist()
        ends = np.cumsum(live.sum(axis=1)).tolist()
        return [tuple(flat[start:end]) for start, end in zip([0, *ends], ends, strict=False)]

    def alone(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one long piece."""
        count = len(piece)
        width = 1 << (count - 1).bit_length()
        none = int(NONE)
        pairs = dict(zip(self.keys.tolist(), self.merged.tolist(), strict=True)) if not hasattr(self, "pairs") else self.pairs
        self.pairs = pairs
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, count + 1)), list(range(-1, count - 1))
        tree = [none] * (2 * width)
        for i in range(count - 1):
            tree[width + i] = pairs.get(ids[i] << 32 | ids[i + 1], none)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def update(at: int, rank: int) -> None:
            node = at + width
            tree[node] = rank
            while node := node >> 1:
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    return
                tree[node] = least

        while (least := tree[1]) != none:
            node = 1
            while node < width:
                node = 2 * node
                node += tree[node] != least
            at = node - width
            gone = after[at]
            then = after[gone]
            ids[at], ids[gone] = least, -1
            after[at] = then
            update(gone, none)
            if then < count:
                before[then] = at
                update(at, pairs.get(least << 32 | ids[then], none))
            else:
                update(at, none)
            if (first := before[at]) >= 0:
                update(first, pairs.get(ids[first] << 32 | least, none))
        return tuple(i for i in ids if i >= 0)

    def encode(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each piece; a piece that is a token is that token."""
        found: list[tuple[int, ...]] = [()] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for number, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                found[number] = (whole,)
            elif len(piece) > TOGETHER:
                found[number] = self.alone(piece)
            else:
                by_width.setdefault(1 << (len(piece) - 1).bit_length(), []).append(number)
        for width, numbers in by_width.items():
            for start in range(0, len(numbers), TREES):
                some = numbers[start : start + TREES]
                for number, ids in zip(some, self.together([pieces[n] for n in some], width), strict=True):
                    found[number] = ids
        return found


class Decoder:
    """Ids back to bytes."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(token) for token in tokens])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.store = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ids):
            return b""
        return self.store[np.repeat(self.starts[ids] - ends + lengths, lengths) + np.arange(ends[-1])].tobytes()


def encoded(docs: DataFrame, ranks_path: str, pattern: str, carry: list[str] | None = None, text: str = "text") -> DataFrame:
    """The carried columns of every row as struct `row`, ids of its text, and the bytes those ids decode to.

    Every match of `pattern` is encoded by itself, without special tokens; null counts as empty, and an
    empty text has no ids. Nothing is shuffled; a task holds one Arrow batch and at most REMEMBERED pieces.

    Args:
        ranks_path: A file with a base64 token and its rank on every line, read on the driver.
        pattern: The regular expression that cuts texts into pieces.
        carry: Columns to carry along, by default all.
    """
    prepared(docs.sparkSession)
    vocabulary = Vocabulary(ranks_of_lines(ranks_path))
    schema = T.StructType(
        [row_field(docs, carry), T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.BinaryType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = regex.compile(pattern).findall
        decoder = Decoder(vocabulary.ranks)
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 250):
                part = batch.slice(start, 250)
                texts = [cut(value or "") for value in part.column(1).to_pylist()]
                if len(known) > REMEMBERED:
                    known.clear()
                new = list(set(chain.from_iterable(texts)).difference(known))
                known.update(zip(new, vocabulary.encode([piece.encode() for piece in new]), strict=True))
                ids = [np.fromiter(chain.from_iterable(map(known.__getitem__, pieces)), np.int32) for pieces in texts]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                decoded = pa.array([decoder.decode(x) for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), lists, decoded], names=schema.names)

    return docs.select(row_of(docs, carry), F.col(f"`{text}`").alias("text")).mapInArrow(run, schema)
