"""Vectors as columns, and the block product the vector searches share."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def cosine_similarity(first: Column, second: Column) -> Column:
    """The dot product over the product of the lengths; 0.0 when either vector has length zero."""

    def total(products):
        return F.aggregate(products, F.lit(0.0), lambda so_far, product: so_far + product)

    def dot(a, b):
        return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))

    lengths = F.sqrt(dot(first, first)) * F.sqrt(dot(second, second))
    return F.when(lengths == 0, F.lit(0.0)).otherwise(dot(first, second) / lengths)


def coded_words(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """The words of a batch of rows as numbers, nulls left out.

    Returns:
        For every word the row it stands in, its place there from 1, and its number in the list of
        distinct words, which comes last.
    """
    offsets = lists.offsets.to_numpy()
    sizes = np.diff(offsets)
    encoded = lists.flatten().dictionary_encode()
    codes = encoded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    places = np.arange(len(codes)) - np.repeat(offsets[:-1] - offsets[0], sizes) + 1
    held = codes >= 0
    return rows[held], places[held], codes[held], encoded.dictionary.to_pylist()


def word_bucket(word: str, dims: int) -> int:
    """The place of a word in a vector: its SHA-256, as one number, modulo `dims`."""
    return int.from_bytes(hashlib.sha256(word.encode()).digest(), "big") % dims


def counted_vectors(lists: pa.ListArray, dims: int) -> pa.ListArray:
    """For every row the unit vector that counts its words by bucket; null for a row without words."""
    rows, _, codes, distinct = coded_words(lists)
    buckets = np.array([word_bucket(word, dims) for word in distinct], dtype=np.int64)
    n = len(lists)
    places = rows * dims + (buckets[codes] if len(codes) else codes)
    counts = np.bincount(places, minlength=n * dims).reshape(n, dims)
    # Counts are whole numbers, so lengths are exact whatever the order of the words.
    lengths = np.sqrt((counts * counts).sum(axis=1).astype(np.float64))
    filled = lengths > 0
    unit = (counts[filled] / lengths[filled, None]).astype(np.float32)
    offsets = np.concatenate([[0], np.cumsum(filled * dims)]).astype(np.int32)
    return pa.ListArray.from_arrays(
        pa.array(offsets), pa.array(unit.ravel()), mask=pa.array(~filled)
    )


def matrix(vectors: pa.ListArray) -> np.ndarray:
    """The vectors of one space as a matrix of doubles; raises ValueError when their lengths differ."""
    lengths = np.unique(np.diff(vectors.offsets.to_numpy()))
    if len(lengths) > 1:
        raise ValueError(f"vectors of one model have different lengths: {lengths.tolist()}")
    dims = int(lengths[0]) if len(lengths) else 0
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def similarities(units: np.ndarray, queries: np.ndarray, digits: int | None) -> np.ndarray:
    """Cosine similarity of every unit (rows) with every query (columns); 0.0 for a zero vector."""
    lengths = np.outer(
        np.sqrt((units * units).sum(axis=1)), np.sqrt((queries * queries).sum(axis=1))
    )
    product = units @ queries.T
    found = np.divide(product, lengths, out=np.zeros_like(product), where=lengths > 0)
    return found if digits is None else np.round(found, digits) + 0.0


def _directions(vectors: np.ndarray) -> np.ndarray:
    """Vectors at length 1; zero vectors stay, a right angle away from everything."""
    lengths = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return np.divide(vectors, lengths, out=np.zeros_like(vectors), where=lengths > 0)


class NearestSoFar:
    """The best `k` units of every query of one block, kept while units stream by.

    Never more than `k` rows a query are held, and a unit that cannot be among them is dropped
    before anything is sorted. A unit is a row of whole numbers, its id first.
    """

    def __init__(self, queries: np.ndarray, k: int, digits: int | None):
        self.queries = queries
        self.k = k
        self.digits = digits
        self.found = [None] * len(queries)
        # What a unit has to reach to be among the best of each query.
        self.bars = np.full(len(queries), -np.inf)
        self.directions = _directions(queries)
        # Rounding may lift a similarity.
        self.slack = 1e-9 if digits is None else 10.0**-digits

    def add(self, units: np.ndarray, vectors: np.ndarray) -> None:
        # A slice of units at a time, so the product stays small whatever the number of queries.
        step = max(1, 4_000_000 // max(1, len(self.queries)))
        for start in range(0, len(units), step):
            part = vectors[start : start + step]
            asking = np.flatnonzero(self._reach(part) + self.slack >= self.bars)
            if len(asking):
                scores = similarities(part, self.queries[asking], self.digits)
                self.add_scores(units[start : start + step], scores, asking)

    def add_scores(self, units: np.ndarray, scores: np.ndarray, asking: np.ndarray) -> None:
        """Units (rows) whose similarities to the queries numbered `asking` (columns) are known."""
        # Once lists are full, few queries have anything to gain from a slice.
        for column in np.flatnonzero((scores >= self.bars[asking]).any(axis=0)):
            self._merge(asking[column], scores[:, column], units)

    def _reach(self, vectors: np.ndarray) -> np.ndarray:
        """The most similar any of these vectors can be to each query: the angle to their centre, less their spread."""
        if np.isneginf(self.bars).all() or not len(vectors):
            return np.full(len(self.queries), 1.0)
        directions = _directions(vectors)
        centre = _directions(directions.sum(axis=0, keepdims=True))[0]
        spread = np.arccos(np.clip((directions @ centre).min(), -1, 1))
        apart = np.arccos(np.clip(self.directions @ centre, -1, 1))
        return np.cos(np.maximum(apart - spread, 0))

    def _merge(self, query: int, scores: np.ndarray, units: np.ndarray) -> None:
        if self.found[query] is not None:
            best, best_units = self.found[query]
            keep = scores >= self.bars[query]
            scores, units = scores[keep], units[keep]
            scores = np.concatenate([best, scores])
            units = np.concatenate([best_units, units])
        if len(scores) > self.k:
            bar = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            keep = scores >= bar
            scores, units = scores[keep], units[keep]
        order = np.lexsort((units[:, 0], -scores))[: self.k]
        self.found[query] = (scores[order], units[order])
        if len(order) == self.k:
            self.bars[query] = scores[order[-1]]

    def rows(self):
        """(query number, similarities, units) of every query that found something."""
        for query, found in enumerate(self.found):
            if found is not None:
                yield query, *found
