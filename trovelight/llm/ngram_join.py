"""N-gram Jaccard join: texts whose sets of word shingles overlap enough, by grouped prefixes, exactly.

Shingles are put in one order, rare ones first. Two sets that are similar enough share a shingle among their
first few, the prefix. Distinct sets with the same prefix and size form a group; only groups are looked up
by the shingles of their prefix. Group pairs are filtered by size and by the places of the shared shingle,
then expand to their members, which are filtered by a bound on their overlap and compared in full.

As only components are asked for, pairs are never listed within a group or a shingle: first every member is
compared with one leader, and what that leaves in several components is compared block by block, each
task handing on no more links than join what it compared.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trovelight.llm.common import (
    BROADCAST_ROWS,
    ROWS_PER_PART,
    attach,
    discard,
    prepared,
    row_field,
    row_of,
    written,
)
from trovelight.llm.near import components
from trovelight.llm.shingles import Shingles
from trovelight.plans.bloom import PROBES, filter_of, in_filter, likely, probed, probes

WORDS = 3
PERCENT = 90
# Occurrences are counted in so many slots, by the first bits of a shingle's hash, to put frequent shingles last.
SLOT_BITS = 16
# A set's shingles are counted in so many parts of the hash range; the lesser counts bound an overlap.
PARTS = 64
# Members of a block; two blocks meet in a task.
BLOCK = 500
# Rows of cells that one call of Python looks at.
ROWS_PER_CALL = 1_000
# Rounds in which cells that share members find a common call.
ROUNDS = 3
# Postings that one call of Python looks at, and pairs of one shingle's postings that are tried there.
POSTINGS_PER_CALL = 20_000
MOST_TRIED = 1 << 22
# Pairs whose parts are compared at once.
PAIRS = 1 << 16
# Columns of the 0/1 matrices that are multiplied at once.
COLUMNS = 4_096

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
LINK = T.StructType([T.StructField(name, T.LongType()) for name in ("a", "b")])


def needed(a, b, percent: int):
    """The least overlap of sets of `a` and `b` elements whose Jaccard similarity is at least `percent` percent."""
    return -(-(percent * (a + b)) // (100 + percent))


def prefix_length(size: int, percent: int) -> int:
    """How many of a set's first shingles are enough to share one with every set similar enough."""
    return size - -(-percent * size // 100) + 1


def frequency_classes(docs: DataFrame, text: str, words: int) -> np.ndarray:
    """For each slot the logarithm of how many shingles of all texts fall into it; the driver reads one row a slot."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Shingles(words)
        total = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            hashes = [maker.every((v.as_py() or b"").translate(_LOWER)) for v in batch.column(0).cast(pa.binary())]
            total += np.bincount((np.concatenate(hashes) >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=len(total))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], names=["slot", "n"])

    each = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(counted, "slot long, n long")
    classes = np.zeros(1 << SLOT_BITS, np.uint8)
    for row in each.groupBy("slot").agg(F.sum("n").alias("n")).collect():
        classes[row.slot] = int(row.n).bit_length()
    return classes


def _sketched(docs: DataFrame, text: str, doc_id: str, carry: list[str] | None, words: int, percent: int) -> DataFrame:
    """Every row's carried columns as `row`, its id, body (a digest of the text), n (its shingles), content (a digest of the set),
    prefix (its first shingles), shape (a digest of prefix and size) and parts."""
    classes = frequency_classes(docs, text, words)
    schema = T.StructType(
        [
            row_field(docs, carry),
            T.StructField("id", docs.schema[doc_id].dataType),
            T.StructField("body", T.BinaryType()),
            T.StructField("n", T.LongType()),
            T.StructField("content", T.BinaryType()),
            T.StructField("shape", T.BinaryType()),
            T.StructField("prefix", T.ArrayType(T.LongType())),
            T.StructField("parts", T.BinaryType()),
        ]
    )

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Shingles(words)
        for batch in batches:
            sizes, contents, shapes, prefixes, parts = [], [], [], [], []
            for value in batch.column(3).cast(pa.binary()):
                found = np.unique(maker.every((value.as_py() or b"").translate(_LOWER)))
                order = np.argsort(classes[(found >> np.uint64(64 - SLOT_BITS)).astype(np.int64)], kind="stable")
                prefix = found[order[: prefix_length(len(found), percent)]] if len(found) else found
                sizes.append(len(found))
                contents.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                shapes.append(hashlib.blake2b(prefix.tobytes() + len(found).to_bytes(8, "little"), digest_size=16).digest())
                prefixes.append(prefix.view(np.int64))
                parts.append(_parts(found).tobytes())
            ends = np.cumsum([0, *map(len, prefixes)], dtype=np.int32)
            flat = np.concatenate(prefixes) if prefixes else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in range(3)),
                    pa.array(sizes, pa.int64()),
                    pa.array(contents, pa.binary()),
                    pa.array(shapes, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                    pa.array(parts, pa.binary()),
                ],
                names=schema.names,
            )

    whole = F.col(f"`{text}`")
    return docs.select(row_of(docs, carry), F.col(f"`{doc_id}`").alias("id"), _body(whole).alias("body"), whole.alias("text")).mapInArrow(sketch, schema)


def _body(text: Column) -> Column:
    """The digest by which a text is found again where texts are read."""
    return F.unhex(F.md5(text))


def _texts(docs: DataFrame, text: str, wanted: DataFrame, count: int) -> DataFrame:
    """body and text of the `count` wanted bodies, read from `docs`; a task hands on one copy of a text."""
    table = docs.sparkSession.sparkContext.broadcast(filter_of(wanted, ["body"], count))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            at = []
            bodies = batch.column(0)
            for place in np.flatnonzero(in_filter(table.value, probed(batch))).tolist():
                body = bodies[place].as_py()
                if body is not None and body not in seen:
                    seen.add(body)
                    at.append(place)
            yield batch.take(pa.array(at, pa.int64())).select(["body", "text"])

    whole = F.col(f"`{text}`")
    each = docs.select(_body(whole).alias("body"), whole.alias("text"), probes(_body(whole)).alias("probes"))
    return each.mapInArrow(sift, "body binary, text string")


def _parts(found: np.ndarray) -> np.ndarray:
    """How many shingles lie in each part of the hash range, in one byte each, or four where a count needs more."""
    counts = np.bincount((found >> np.uint64(64 - PARTS.bit_length() + 1)).astype(np.int64), minlength=PARTS)
    return counts.astype("<u1" if counts.max() < 256 else "<u4")


def _counts(parts: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A row of counts for each value of `_parts`."""
    rows = parts.to_pylist()
    if all(len(row) == PARTS for row in rows):
        return np.frombuffer(b"".join(rows), "<u1").reshape(len(rows), PARTS).astype(np.int32)
    return np.stack([np.frombuffer(row, "<u1" if len(row) == PARTS else "<u4").astype(np.int32) for row in rows])


def _may_link(a: Column, place_a: Column, b: Column, place_b: Column, percent: int) -> Column:
    """Whether sets of these sizes whose first common shingle stands at these places can be similar enough."""
    least = F.ceil(F.lit(percent) * (a + b) / F.lit(100 + percent))
    return (F.least(a, b) * 100 >= F.greatest(a, b) * percent) & (F.least(a - place_a, b - place_b) >= least)


def _postings(heads: DataFrame, rows_per_part: int) -> DataFrame:
    """token, grp, n and place of every group and shingle of its prefix that another group shares, written."""
    listed = heads.select("grp", "n", F.posexplode("prefix").alias("place", "token"))
    shared = written(listed.groupBy("token").agg(F.count("*").alias("groups")).where("groups > 1"), "ngram-shared")
    count = shared.count()
    # Shingles of one group only, nearly all, go where they are read; the filter lets few of them pass.
    table = heads.sparkSession.sparkContext.broadcast(filter_of(shared, ["token"], count))
    asked = heads.select("grp", "n", "prefix", F.transform("prefix", lambda token: probes(token)).alias("probes"))

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            tokens = lists.flatten().to_numpy()
            good = in_filter(table.value, batch.column(3).flatten().flatten().to_numpy().reshape(-1, PROBES))
            places = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(tokens[good]),
                    pa.array(np.repeat(batch.column(0).to_numpy(), sizes)[good]),
                    pa.array(np.repeat(batch.column(1).to_numpy(), sizes)[good]),
                    pa.array(places[good]),
                ],
                names=["token", "grp", "n", "place"],
            )

    found = asked.mapInArrow(passing, "token long, grp long, n long, place long")
    postings = written(attach(found, shared, ["token"], "groups", ["grp"], "inner", rows_per_part=rows_per_part), "ngram-postings")
    discard(shared)
    return postings


def _packed(cells: DataFrame) -> DataFrame:
    """Cells dealt over calls of Python that take several each."""
    count = cells.count()
    return cells.withColumn("call", F.pmod(F.xxhash64("key", "i", "j", F.lit(11)), F.lit(max(1, math.ceil(count / ROWS_PER_CALL)))))


def _each_cell(table: pa.Table) -> Iterator[pa.Table]:
    """The cells of one call."""
    if not table.num_rows:
        return
    key, i, j = (table.column(name).to_numpy() for name in ("key", "i", "j"))
    order = np.lexsort((j, i, key))
    turns = np.flatnonzero((np.diff(key[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)) + 1
    for at in np.split(order, turns):
        yield table.take(pa.array(at))


def _sides(cell: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    left = cell.column("left").to_numpy(zero_copy_only=False)
    return np.flatnonzero(left), np.flatnonzero(~left)


def _promising(cells: DataFrame, prefixes: DataFrame | None, percent: int, rows_per_part: int) -> DataFrame:
    """The rows of cells that have, in their cell, a member of another class they may be similar to; written.

    Cells have key, i, j, node, class, n, place, minor (outside the key's main class), left and parts. What a pair shares
    before its first common shingle is nothing, so `place` bounds the rest; the parts of the hash range bound
    the overlap.

    Args:
        prefixes: node and prefix; with these a pair counts only where its first common shingle has brought it
            together, which leaves one cell for each pair.
    """
    first_only = prefixes is not None
    full = _packed(cells)
    if first_only:
        uses = written(cells.groupBy("node").agg(F.count("*").alias("uses")), "ngram-prefix-uses")
        known = written(likely(prefixes, ["node"], uses, uses.count()).join(uses, "node"), "ngram-prefixes")
        full = attach(full, known, ["node"], "uses", ["key"], "inner", rows_per_part=rows_per_part).drop("uses")
        full = full.withColumn("prefix", F.slice("prefix", 1, F.col("place").cast("int")))
    schema = T.StructType([cells.schema[name] for name in ("key", "i", "j", "node", "class", "n", "place", "minor", "left", "parts")])

    def hopeful(table: pa.Table) -> pa.Table:
        out = []
        for cell in _each_cell(table):
            node, n, place, group = (cell.column(name).to_numpy() for name in ("node", "n", "place", "class"))
            minor = cell.column("minor").to_numpy(zero_copy_only=False)
            left, right = _sides(cell)
            # Two members outside the main class meet twice.
            good = (group[left][:, None] != group[right]) & (~minor[right] | (node[left][:, None] < node[right]))
            least = needed(n[left][:, None], n[right], percent)
            good &= np.minimum((n - place)[left][:, None], (n - place)[right]) >= least
            good &= np.minimum(n[left][:, None], n[right]) >= least
            ones, others = np.nonzero(good)
            if not len(ones):
                continue
            counts = _counts(cell.column("parts"))
            hopes = np.concatenate(
                [
                    np.minimum(counts[left[ones[at : at + PAIRS]]], counts[right[others[at : at + PAIRS]]]).sum(axis=1)
                    for at in range(0, len(ones), PAIRS)
                ]
            ) >= least[ones, others]
            ones, others = ones[hopes], others[hopes]
            if first_only and len(ones):
                earlier = [np.array(prefix, np.int64) for prefix in cell.column("prefix").to_pylist()]
                here = overlaps([earlier[x] for x in left], [earlier[y] for y in right])[ones, others] == 0
                ones, others = ones[here], others[here]
            keep = np.zeros(cell.num_rows, bool)
            keep[left[ones]] = keep[right[others]] = True
            if len(ones):
                out.append(cell.filter(pa.array(keep)).select(schema.names))
        return pa.concat_tables(out) if out else table.slice(0, 0).select(schema.names)

    found = written(full.groupBy("call").applyInArrow(hopeful, schema), "ngram-promising")
    if first_only:
        discard(known)
    return found


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each set on the left shares with each on the right, as products of 0/1 matrices."""
    if len(left) == 1 and len(right) < 20:
        return np.array([[len(np.intersect1d(left[0], other, assume_unique=True)) for other in right]])
    shared = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    total = np.zeros((len(left), len(right)), np.int64)
    if not len(shared):
        return total
    columns, rows = {}, {}
    for name, sets in (("left", left), ("right", right)):
        flat = np.concatenate(sets)
        at = np.minimum(np.searchsorted(shared, flat), len(shared) - 1)
        hit = shared[at] == flat
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[hit]
        order = np.argsort(at[hit], kind="stable")
        columns[name], rows[name] = at[hit][order], owner[order]
    for low in range(0, len(shared), COLUMNS):
        matrices = []
        for name, sets in (("left", left), ("right", right)):
            begin, end = np.searchsorted(columns[name], [low, low + COLUMNS])
            matrix = np.zeros((len(sets), min(COLUMNS, len(shared) - low)), np.float32)
            matrix[rows[name][begin:end], columns[name][begin:end] - low] = 1
            matrices.append(matrix)
        total += (matrices[0] @ matrices[1].T).astype(np.int64)
    return total


def _dealt(cells: DataFrame, rows_per_part: int) -> DataFrame:
    """Cells dealt over calls of Python; those that share members tend to meet in one call, which gets a text once; written."""
    places = cells.select("key", "i", "j", "node")
    met = places.withColumn("home", F.col("key"))
    for _ in range(ROUNDS):
        nodes = written(met.groupBy("node").agg(F.min("home").alias("home"), F.count("*").alias("uses")), "ngram-homes")
        near = attach(places, nodes, ["node"], "uses", ["key"], "inner", rows_per_part=rows_per_part)
        each = written(near.groupBy("key", "i", "j").agg(F.min("home").alias("home"), F.count("*").alias("rows")), "ngram-dealt-cells")
        met = attach(places, each, ["key", "i", "j"], "rows", ["node"], "inner", rows_per_part=rows_per_part)
    homes = each.groupBy("home").agg(F.sum("rows").alias("all"), F.count("*").alias("cells"))
    # The cells of a home beyond one call go to several.
    each = attach(each, written(homes, "ngram-homes"), ["home"], "cells", ["key", "i", "j"], "inner", rows_per_part=rows_per_part)
    part = F.pmod(F.xxhash64("key", "i", "j", F.lit(13)), F.ceil(F.col("all") / ROWS_PER_CALL))
    calls = F.lit(max(1, math.ceil(cells.count() / ROWS_PER_CALL)))
    each = written(each.select("key", "i", "j", "rows", F.pmod(F.xxhash64("home", part, F.lit(11)), calls).alias("call")), "ngram-calls")
    dealt = attach(cells, each, ["key", "i", "j"], "rows", ["node"], "inner", rows_per_part=rows_per_part)
    return written(dealt.select("call", "key", "i", "j", "node", "class", "n", "left"), "ngram-dealt")


def _verified(
    cells: DataFrame, bodies: DataFrame, docs: DataFrame, text: str, words: int, percent: int, broadcast_rows: int, rows_per_part: int
) -> DataFrame:
    """Links (a, b) of cells' left and right members of different classes that are similar enough, of each cell only as many
    as join them; written.

    Texts travel rather than their shingles, which take more bytes and do not compress, and once to each call.

    Args:
        bodies: node and body of every row.
    """
    dealt = _dealt(cells, rows_per_part)
    asked = written(dealt.select("call", "node").distinct(), "ngram-asked")
    wanted = written(likely(bodies, ["node"], asked, asked.count()).join(asked, "node"), "ngram-wanted")
    count = wanted.count()
    # Where few are wanted, texts move to their calls only.
    told = F.broadcast(wanted) if count <= broadcast_rows else wanted
    sent = _texts(docs, text, wanted, count).join(told, "body").select("call", "node", "text")

    def linked(table: pa.Table, texts: pa.Table) -> pa.Table:
        maker = Shingles(words)
        a, b = [], []
        sets = dict(zip(texts.column("node").to_pylist(), texts.column("text").cast(pa.binary()), strict=True))
        sets = {node: np.unique(maker.every(value.as_py().translate(_LOWER))) for node, value in sets.items()}
        for cell in _each_cell(table):
            node, group, n = (cell.column(name).to_numpy() for name in ("node", "class", "n"))
            left, right = _sides(cell)
            if not len(left) or not len(right):
                continue
            both = overlaps([sets[x] for x in node[left].tolist()], [sets[y] for y in node[right].tolist()])
            good = both >= needed(n[left][:, None], n[right][None, :], percent)
            good &= group[left][:, None] != group[right][None, :]
            head = {int(c): int(c) for c in group}

            def find(c: int, head=head) -> int:
                while head[c] != c:
                    head[c] = head[head[c]]
                    c = head[c]
                return c

            for x, y in np.argwhere(good).tolist():
                one, other = find(int(group[left[x]])), find(int(group[right[y]]))
                if one != other:
                    head[one] = other
                    a.append(int(node[left[x]]))
                    b.append(int(node[right[y]]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    links = written(dealt.groupBy("call").cogroup(sent.groupBy("call")).applyInArrow(linked, LINK), "ngram-links")
    for table in (dealt, asked, wanted):
        discard(table)
    return links


def _leading(postings: DataFrame, members: DataFrame, parts: DataFrame, percent: int, rows_per_part: int, block: int) -> DataFrame:
    """Cells in which every member meets its group's head, and every group's head the leader of each shingle it may be similar by."""
    # One order for all shingles, so that a group of copies has few leaders.
    order = F.xxhash64("grp")
    head = F.struct("grp", "n", "place")
    leaders = written(
        postings.groupBy("token").agg(F.min_by(head, order).alias("leader"), F.max_by(head, order).alias("other"), F.count("*").alias("groups")),
        "ngram-leaders",
    )
    # Nearly always two groups share a shingle, which need no look-up of who they are.
    two = leaders.where("groups = 2").select("leader", "other.*")
    more = leaders.where("groups > 2").drop("other")
    met = attach(postings.where("groups > 2").drop("groups"), more, ["token"], "groups", ["grp"], "inner", rows_per_part=rows_per_part)
    met = two.unionByName(met.select("leader", "grp", "n", "place"))
    met = met.where((F.col("grp") != F.col("leader.grp")) & _may_link(F.col("n"), F.col("place"), F.col("leader.n"), F.col("leader.place"), percent))
    by_shingle = met.select(F.col("leader.grp").alias("key"), F.col("leader.n").alias("key_n"), F.col("grp").alias("node"), "n")
    by_group = members.where("node != grp").select(F.col("grp").alias("key"), F.col("n").alias("key_n"), "node", "n")
    pairs = written(by_shingle.unionByName(by_group).distinct(), "ngram-pairs")
    discard(leaders)

    joined = pairs
    for name in ("key", "node"):
        uses = written(pairs.groupBy(name).agg(F.count("*").alias("uses")), "ngram-part-uses")
        asked = likely(parts.withColumnRenamed("node", name), [name], uses, uses.count())
        known = written(asked.withColumnRenamed("parts", f"parts_{name}").join(uses, name), "ngram-parts")
        joined = attach(joined, known, [name], "uses", ["node" if name == "key" else "key"], "inner", rows_per_part=rows_per_part).drop("uses")

    def hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bound = np.minimum(_counts(batch.column("parts_key")), _counts(batch.column("parts_node"))).sum(axis=1)
                good = bound >= needed(batch.column("key_n").to_numpy(), batch.column("n").to_numpy(), percent)
                yield batch.select(["key", "key_n", "node", "n"]).filter(pa.array(good))

    narrow = joined.select("key", "key_n", "node", "n", "parts_key", "parts_node")
    hopes = written(narrow.mapInArrow(hopeful, pairs.select("key", "key_n", "node", "n").schema), "ngram-hopes")
    sizes = written(hopes.groupBy("key").agg(F.max("key_n").alias("key_n"), F.count("*").alias("pairs")), "ngram-leads")
    count = F.ceil(F.col("pairs") / block).cast("int")
    met_by = attach(hopes.drop("key_n"), sizes, ["key"], "pairs", ["node"], "inner", rows_per_part=rows_per_part)
    right = met_by.select("key", F.lit(0).alias("i"), F.pmod(F.xxhash64("node", F.lit(7)), count).cast("int").alias("j"), "node", F.col("node").alias("class"), "n", F.lit(False).alias("left"))
    # A leader's row for the blocks there are.
    left = right.select("key", "j").distinct().join(sizes, "key").select("key", F.lit(0).alias("i"), "j", F.col("key").alias("node"), F.col("key").alias("class"), F.col("key_n").alias("n"), F.lit(True).alias("left"))
    return written(left.unionByName(right), "ngram-leading")


def _of_three(postings: DataFrame, groups: DataFrame, broadcast_rows: int) -> DataFrame:
    """The postings of shingles that three or more sets share; the pair of any other has been compared."""
    several = written(groups.where("members > 1").select("grp"), "ngram-several")
    several = F.broadcast(several) if several.count() <= broadcast_rows else several
    two = postings.where("groups = 2")
    tokens = two.join(several, "grp", "left_semi").select("token").distinct()
    return written(postings.where("groups > 2").unionByName(two.join(tokens, "token", "left_semi").select(postings.columns)), "ngram-of-three")


def _feasible(postings: DataFrame, percent: int, block: int) -> DataFrame:
    """The postings whose shingle has one of another class that sizes and places let them be similar to; written.

    Postings are token, grp, n, place, groups and class, null for a group of several classes. In one shingle's postings by
    size, those that may be similar to a smaller one stand next to it. Shingles of many groups are cut into
    ranges of sizes, a posting going to all that it may be similar in. Where there is too much to try, all are kept.
    """
    most = F.least(F.floor(F.lit(100 + percent) * (F.col("n") - F.col("place")) / percent) - F.col("n"), F.floor(F.lit(100) * F.col("n") / percent))
    # The logarithm's rounding does not change the order of sizes.
    band = lambda size: F.floor(F.log(size) / math.log(max(100 / percent, 1.01)))
    bands = F.when(F.col("groups") > block, F.sequence(band(F.col("n")), band(F.greatest("n", most)))).otherwise(F.array(F.lit(0).cast("long")))
    each = postings.withColumn("most", most).withColumn("band", F.explode(bands)).withColumn("key", F.xxhash64("token", "band"))
    calls = max(1, math.ceil(postings.count() / POSTINGS_PER_CALL))
    each = each.withColumn("call", F.pmod(F.xxhash64("key", F.lit(11)), F.lit(calls)))
    schema = T.StructType([postings.schema[name] for name in ("token", "grp", "place", "groups")])

    def partnered(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.lexsort((table.column("n").to_numpy(), table.column("key").to_numpy()))))
        key, n, place, most = (table.column(name).to_numpy() for name in ("key", "n", "place", "most"))
        # A group of several classes is of a class of its own.
        group = table.column("class").is_null().to_numpy(zero_copy_only=False)
        group = np.where(group, -1 - np.arange(len(n)), table.column("class").fill_null(0).to_numpy())
        number = np.cumsum(np.diff(key, prepend=key[:1]) != 0)
        # Of a shingle's postings those from the next on to the last that is not too large.
        width = n.max() + 1
        after = np.arange(1, len(n) + 1)
        many = np.maximum(np.searchsorted(number * width + n, number * width + np.minimum(most, n.max()), side="right") - after, 0)
        keep = np.bincount(number, many)[number] > MOST_TRIED
        many[keep] = 0
        ends = np.cumsum(many)
        at = 0
        while at < len(n):
            # As many postings as make up some PAIRS pairs.
            begin = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, begin + PAIRS, side="right")))
            one = np.repeat(np.arange(at, to), many[at:to])
            other = np.arange(len(one)) - np.repeat(ends[at:to] - many[at:to] - begin, many[at:to]) + after[one]
            least = needed(n[one], n[other], percent)
            good = (group[one] != group[other]) & (np.minimum((n - place)[one], (n - place)[other]) >= least)
            keep[one[good]] = keep[other[good]] = True
            at = to
        return table.filter(pa.array(keep)).select(schema.names)

    narrow = each.select("call", "key", "token", "grp", "n", "place", "groups", "class", "most")
    found = written(narrow.groupBy("call").applyInArrow(partnered, schema), "ngram-feasible")
    # Only a shingle that was cut can name a posting twice.
    return found.where(F.col("groups") <= block).unionByName(found.where(F.col("groups") > block).dropDuplicates(["token", "grp"])).drop("groups")


def _open(postings: DataFrame, members: DataFrame, classes: DataFrame, parts: DataFrame, percent: int, rows_per_part: int, block: int) -> DataFrame:
    """Cells in which members of a shingle's, or a group's, smaller classes meet all its members, for those of several classes."""
    placed = written(members.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node")), "ngram-placed")
    held = written(placed.groupBy("grp", "class").agg(F.count("*").alias("nodes")), "ngram-held")
    only = F.when(F.count("*") == 1, F.min("class")).alias("class")
    by_group = written(held.groupBy("grp").agg(F.count("*").alias("classes"), only), "ngram-sizes")
    uses = postings.groupBy("grp").agg(F.count("*").alias("uses"))
    known = written(uses.join(by_group.select("grp", "class"), "grp"), "ngram-uses")
    full = attach(postings, known, ["grp"], "uses", ["token"], "inner", rows_per_part=rows_per_part).drop("uses")
    postings = _feasible(full, percent, block)

    def several(counted: DataFrame) -> DataFrame:
        """Keys of more than one class, with their main class."""
        each = counted.groupBy("key", "class").agg(F.sum("nodes").alias("nodes"))
        whole = each.groupBy("key").agg(F.sum("nodes").alias("members"), F.max("nodes").alias("largest"), F.max_by("class", "nodes").alias("main"))
        return whole.where("members > largest")

    # A group's classes go to each of its postings: as many rows as classes, one where it is one class.
    shingle_key = F.xxhash64("token", F.lit(1))
    open_shingles = written(several(postings.join(held, "grp").select(shingle_key.alias("key"), "class", "nodes")), "ngram-open")
    open_groups = written(several(held.join(by_group.where("classes > 1").select("grp"), "grp").select(F.xxhash64("grp", F.lit(2)).alias("key"), "class", "nodes")).where("members > 2"), "ngram-open")
    sized = open_shingles.withColumn("groups", F.col("members"))
    listed = attach(postings.select(shingle_key.alias("key"), "grp", "place"), sized, ["key"], "groups", ["grp"], "inner", rows_per_part=rows_per_part).drop("groups")
    own = members.where("node = grp").select(F.xxhash64("grp", F.lit(2)).alias("key"), "grp", F.lit(0).cast("long").alias("place")).join(open_groups, "key")
    entries = written(listed.unionByName(own.select(listed.columns)), "ngram-entries")
    # Groups expand to their members here, for open keys only.
    expanded = entries.join(placed.select("grp", "node", "class", "n").join(parts, "node"), "grp")
    blocks = lambda n: F.greatest(F.ceil(n / block).cast("int"), F.lit(1))
    all_blocks, few_blocks = blocks(F.col("members")), blocks(F.col("members") - F.col("largest"))
    dealt = lambda count: F.pmod(F.xxhash64("node", F.lit(7)), count).cast("int")
    each = ["node", "class", "n", "place", (F.col("class") != F.col("main")).alias("minor"), "parts"]
    left = expanded.where("class != main").select("key", dealt(few_blocks).alias("i"), F.explode(F.sequence(F.lit(0), all_blocks - 1)).alias("j"), *each, F.lit(True).alias("left"))
    right = expanded.select("key", F.explode(F.sequence(F.lit(0), few_blocks - 1)).alias("i"), dealt(all_blocks).alias("j"), *each, F.lit(False).alias("left"))
    return written(left.unionByName(right), "ngram-open-cells")


def jaccard_components(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    words: int = WORDS,
    percent: int = PERCENT,
    carry: list[str] | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    rows_per_part: int = ROWS_PER_PART,
    block: int = BLOCK,
) -> DataFrame:
    """Every row of `docs` with its carried columns as struct `row`, n_shingles, component_id and component_size.

    A text's set are its distinct shingles of `words` words, A-Z in lower case; a text of fewer words is one
    shingle. Texts link when 100 * intersection >= percent * union; component_id is the smallest id a row
    reaches by links, null only if all it reaches are null. Null and wordless texts have an empty set and link
    with nothing, not with each other either. No link is lost: prefixes, filters and comparisons are exact up to
    64-bit hashes of shingles and 128-bit digests of sets and texts. Equal sets are one node from the start, whatever their
    number. `docs` is read four times, and texts are not written but read again where they are compared, so every read
    must give the same rows.
    An empty table gives an empty result. Carried columns, by default all, may have any names.
    """
    prepared(docs.sparkSession)
    rows = written(_sketched(docs, text, doc_id, carry, words, percent).withColumn("rid", F.monotonically_increasing_id()), "ngram-sketches")
    nodes = written(
        rows.where("n > 0").groupBy("content", "shape", "n").agg(F.min("rid").alias("node"), F.count("*").alias("copies")), "ngram-nodes"
    )
    groups = written(nodes.groupBy("shape").agg(F.min("node").alias("grp"), F.count("*").alias("members")), "ngram-groups")
    members = written(attach(nodes.drop("content", "copies"), groups, ["shape"], "members", ["node"], "inner", rows_per_part=rows_per_part).select("node", "grp", "n"), "ngram-members")
    bodies, parts = rows.select(F.col("rid").alias("node"), "body"), rows.select(F.col("rid").alias("node"), "parts")
    # Prefixes of group heads; what is not one is told by its number where that is less.
    prefixes = rows.where("n > 0").select(F.col("rid").alias("grp"), "n", "prefix")
    others = rows.where("n > 0").select(F.col("rid").alias("grp")).join(groups.select("grp"), "grp", "left_anti")
    others = written(others, "ngram-others")
    few = others.count() <= broadcast_rows
    heads = prefixes.join(F.broadcast(others), "grp", "left_anti") if few else prefixes.join(groups.select("grp"), "grp")
    postings = _postings(heads, rows_per_part)

    options = (bodies, docs, text, words, percent, broadcast_rows, rows_per_part)
    links = _verified(_leading(postings, members, parts, percent, rows_per_part, block), *options)
    classes = components(links, rows_per_part)
    shared = _of_three(postings, groups, broadcast_rows)
    discard(postings)
    open_cells = _open(shared, members, classes, parts, percent, rows_per_part, block)
    discard(shared)
    hopes = _promising(open_cells, None, percent, rows_per_part)
    discard(open_cells)
    cells = _promising(hopes, rows.select(F.col("rid").alias("node"), "prefix"), percent, rows_per_part).drop("parts", "place", "minor")
    more = _verified(cells, *options)
    if not more.isEmpty():
        classes = components(links.unionByName(more), rows_per_part)

    named = written(
        nodes.join(classes, "node", "left").select("content", "copies", F.coalesce("class", "node").alias("class")), "ngram-named"
    )
    narrow = rows.where("n > 0").select("rid", "id", "content")
    labelled = written(attach(narrow, named, ["content"], "copies", ["rid"], "inner", rows_per_part=rows_per_part).select("rid", "id", "class"), "ngram-labelled")
    heads_of = written(labelled.groupBy("class").agg(F.min("id").alias("component_id"), F.count("*").alias("component_size")), "ngram-heads")
    decided = attach(labelled, heads_of, ["class"], "component_size", ["rid"], "inner", rows_per_part=rows_per_part)
    decided = written(decided.select("rid", "component_id", "component_size"), "ngram-decided")
    return rows.select("rid", "row", "id", "n").join(decided, "rid", "left").select(
        "row",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        F.coalesce("component_size", F.lit(1)).cast("long").alias("component_size"),
    )
