"""Near duplicates: ProbMinHash signatures of weighted word shingles, banding, verification, classes.

Pairs are never listed within a bucket. First every member of a bucket is compared with the bucket's
leader, which joins nearly all copies into classes. What is left are members of one bucket outside its main
class; blocks of them meet blocks of all members in one task, which compares what its signatures make
likely and hands on no more links than join its classes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trovelight.llm.common import BROADCAST_ROWS, ROWS_PER_PART, attach, discard, prepared, row_field, row_of, written
from trovelight.llm.shingles import Shingles, mixed, signature, similarity, weights

WORDS = 5
THRESHOLD = 0.8
# A pair of similarity 0.8 shares none of 20 bands of 4 places in about 1 of 38,000 cases.
BANDS = 20
ROWS = 4
# Pairs of different classes in one bucket are compared in full if their signatures agree on this share
# of the places; a pair of similarity 0.8 falls short by 5 standard deviations.
PROMISING = 0.575
# Members of a block; two blocks meet in a task.
BLOCK = 500

LINK = T.StructType([T.StructField(name, T.LongType()) for name in ("a", "b")])


def sketched(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Every row of `docs` as struct `row`, with id, content (a digest of its weighted shingles; of the
    text where it has none), n (its shingles) and sig (4 bytes a place)."""
    schema = T.StructType(
        [
            row_field(docs),
            T.StructField("id", docs.schema[doc_id].dataType),
            T.StructField("content", T.BinaryType()),
            T.StructField("n", T.IntegerType()),
            T.StructField("sig", T.BinaryType()),
        ]
    )

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Shingles(WORDS)
        for batch in batches:
            contents, counts, sigs = [], [], []
            for value in batch.column(2).cast(pa.binary()):
                shingles, times = maker.of(value.as_py() or b"")
                digest = hashlib.blake2b(shingles.tobytes(), digest_size=16)
                digest.update(times.tobytes())
                contents.append(digest.digest())
                counts.append(len(shingles))
                who = signature(shingles, weights(times), BANDS * ROWS) if len(shingles) else np.empty(0, np.uint64)
                sigs.append(mixed(who).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(contents, pa.binary()), pa.array(counts, pa.int32()), pa.array(sigs, pa.binary())],
                names=schema.names,
            )

    return docs.select(row_of(docs), F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(sketch, schema)


def _bands(sig: Column) -> Column:
    """A 64-bit key per band; the places of one band in equal signatures give equal keys."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda band: F.xxhash64(band, sig.substr(band * (4 * ROWS) + 1, F.lit(4 * ROWS))),
    )


def _sets(wanted: DataFrame, texts: DataFrame, broadcast_rows: int) -> DataFrame:
    """The shingles of the nodes in `wanted` (node, uses): set, and times where any occurs more than once; written."""
    joined = texts.join(F.broadcast(wanted) if wanted.count() <= broadcast_rows else wanted, "node")
    schema = T.StructType(
        [T.StructField("node", T.LongType()), T.StructField("uses", T.LongType()), T.StructField("set", T.BinaryType()), T.StructField("times", T.BinaryType())]
    )

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Shingles(WORDS)
        for batch in batches:
            made = [maker.of(value.as_py() or b"") for value in batch.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([shingles.tobytes() for shingles, _ in made], pa.binary()),
                    # Nearly always all 1, which needs no bytes.
                    pa.array([times.astype("<u4").tobytes() if times.max(initial=1) > 1 else b"" for _, times in made], pa.binary()),
                ],
                names=schema.names,
            )

    return written(joined.select("node", "uses", "text").mapInArrow(shingled, schema), "near-sets")


def _similar(a: tuple[bytes, bytes], b: tuple[bytes, bytes]) -> bool:
    """Whether two (set, times) are similar enough."""
    x, y = np.frombuffer(a[0], np.uint64), np.frombuffer(b[0], np.uint64)
    if not a[1] and not b[1]:
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both >= (THRESHOLD - 1e-9) * (len(x) + len(y) - both)
    wx, wy = (weights(np.frombuffer(t, "<u4")) if t else np.ones(len(s)) for s, t in ((x, a[1]), (y, b[1])))
    return similarity(x, wx, y, wy) >= THRESHOLD - 1e-9


def _verified(pairs: DataFrame, texts: DataFrame, broadcast_rows: int, rows_per_part: int) -> DataFrame:
    """Of pairs (a, b) of node ids those whose texts are similar enough, written.

    `texts` has node and text. Shingles are made once per node that occurs in a pair.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("uses"))
    sets = _sets(written(ends, "near-ends"), texts, broadcast_rows)

    def side(name: str) -> DataFrame:
        return sets.select(F.col("node").alias(name), F.col("uses").alias(f"uses_{name}"), F.col("set").alias(f"set_{name}"), F.col("times").alias(f"times_{name}"))

    joined = pairs
    for name, other in (("b", "a"), ("a", "b")):
        joined = attach(joined, side(name), [name], f"uses_{name}", [other], "inner", rows_per_part=rows_per_part).drop(f"uses_{name}")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(name).to_pylist() for name in ("set_a", "times_a", "set_b", "times_b")]
            good = [_similar((sa, ta), (sb, tb)) for sa, ta, sb, tb in zip(*columns, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    narrow = joined.select("a", "b", "set_a", "times_a", "set_b", "times_b")
    links = written(narrow.mapInArrow(compared, LINK), "near-links")
    discard(sets)
    return links


def components(links: DataFrame, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """The nodes of (a, b) links with the smallest node of their component: node, class; written.

    Every round a node takes the smallest label among its neighbours and then that label's own label, so
    a chain is halved each time. Tables of labels are written; a node with very many links is split.
    """
    both = written(links.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("by")), F.struct(F.col("b").alias("node"), F.col("a").alias("by")))).alias("e")).select("e.*").distinct(), "near-edges")
    labels = written(
        both.groupBy("node").agg(F.least("node", F.min("by")).alias("class"), F.count("*").alias("uses")), "near-labels"
    )
    while True:
        seen = labels.select(F.col("node").alias("by"), F.col("class").alias("theirs"), "uses")
        lowest = attach(both, seen, ["by"], "uses", ["node"], "inner", rows_per_part=rows_per_part).groupBy("node").agg(F.min("theirs").alias("lowest"))
        stepped = written(
            labels.join(lowest, "node").select("node", F.least("class", "lowest").alias("class"), F.col("class").alias("before"), "uses"), "near-step"
        )
        sizes = stepped.groupBy("class").agg(F.count("*").alias("members"))
        roots = written(
            sizes.join(stepped.select(F.col("node").alias("class"), F.col("class").alias("root")), "class"), "near-roots"
        )
        labels = written(
            attach(stepped, roots, ["class"], "members", ["node"], "inner", rows_per_part=rows_per_part)
            .select("node", F.col("root").alias("class"), "before", "uses"),
            "near-labels",
        )
        if labels.where("class != before").isEmpty():
            return labels.select("node", "class")
        labels = labels.drop("before")


def _decided(
    docs: DataFrame, text: str, doc_id: str, broadcast_rows: int, rows_per_part: int, block: int
) -> tuple[DataFrame, DataFrame]:
    """The rows of `docs` with a row id, and by row id the class's smallest id, its size, and whether the row is kept; both written."""
    rows = written(sketched(docs, text, doc_id).withColumn("rid", F.monotonically_increasing_id()), "near-sketches")
    # One node per content: the row with the smallest id, null ids last.
    nodes = written(
        rows.groupBy("content").agg(
            F.min(F.struct(F.isnull("id").alias("no_id"), "id", "rid")).alias("keep"),
            F.count("*").alias("size"),
            F.first("n").alias("n"),
            F.first("sig").alias("sig"),
        ).select("content", F.col("keep.rid").alias("node"), "size", "n", "sig"),
        "near-nodes",
    )
    texts = rows.select(F.col("rid").alias("node"), F.col(f"row.`{text}`").alias("text"))

    banded = nodes.where("n > 0").select("node", F.posexplode(_bands(F.col("sig"))).alias("band", "key"))
    # One order for all buckets, so that a group of copies has few leaders.
    order = F.xxhash64("node")
    buckets = written(
        banded.groupBy("key").agg(F.count("*").alias("members"), F.min_by("node", order).alias("leader")).where("members > 1"),
        "near-buckets",
    )
    members = written(
        attach(banded, buckets, ["key"], "members", ["node"], "inner", rows_per_part=rows_per_part).select("key", "band", "node", "leader"),
        "near-members",
    )
    pair = [F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")]
    tested = written(members.where("node != leader").select(*pair).distinct(), "near-pairs")
    links = _verified(tested, texts, broadcast_rows, rows_per_part)
    classes = components(links, rows_per_part)
    more = _across(members, classes, nodes, texts, broadcast_rows, rows_per_part, block)
    if not more.isEmpty():
        classes = components(links.unionByName(more), rows_per_part)

    # Content to the class of its node, then the smallest id over all rows of the class.
    named = written(
        nodes.select("content", "node", "size").join(classes, "node", "left").select("content", "size", F.coalesce("class", "node").alias("class")),
        "near-named",
    )
    labelled = written(
        attach(rows.select("id", "rid", "content"), named, ["content"], "size", ["rid"], "inner", rows_per_part=rows_per_part).select("id", "rid", "class"),
        "near-labelled",
    )
    heads = written(
        labelled.groupBy("class").agg(F.min(F.struct(F.isnull("id").alias("no_id"), "id", "rid")).alias("keep"), F.count("*").alias("class_size")),
        "near-heads",
    )
    decided = attach(labelled, heads, ["class"], "class_size", ["rid"], "inner", rows_per_part=rows_per_part).select(
        "rid", F.col("keep.id").alias("class_id"), "class_size", (F.col("rid") == F.col("keep.rid")).alias("kept")
    )
    return rows.select("rid", "row"), written(decided, "near-decided")


def near_classes(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    broadcast_rows: int = BROADCAST_ROWS,
    rows_per_part: int = ROWS_PER_PART,
    block: int = BLOCK,
) -> DataFrame:
    """Every row of `docs` as struct `row` with class_id, class_size and kept: classes of texts linked by a similarity of 0.8 or more.

    The similarity is the probability Jaccard of weighted shingles of five words; a class is a connected
    component of similar pairs. class_id is the smallest id in the class, null only if all are null; the
    row kept is one with that id. Texts with the same weighted shingles are one node from the start, so
    groups of copies of any size cost one node. Texts of one to four words are one shingle; texts without
    a word equal each other. Null counts as empty. An empty table gives an empty result. Columns may have
    any names.

    A pair is missed if it shares no band (1 of 38,000 at 0.8, fewer above). Buckets of any size are compared
    block against block.
    """
    prepared(docs.sparkSession)
    rows, decided = _decided(docs, text, doc_id, broadcast_rows, rows_per_part, block)
    return rows.join(decided, "rid").select("row", "class_id", "class_size", "kept")


def _across(
    members: DataFrame,
    classes: DataFrame,
    nodes: DataFrame,
    texts: DataFrame,
    broadcast_rows: int,
    rows_per_part: int,
    block: int,
) -> DataFrame:
    """Links (a, b) between classes that have members in one bucket, written.

    Blocks of a bucket's members outside its main class meet blocks of all its members. A pair is compared in
    the first bucket it shares only, if its signatures agree well and nothing in the task has joined its
    classes before; likelier pairs come first.
    """
    placed = members.select("key", "band", "node").join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    placed = written(placed, "near-placed")
    each = placed.groupBy("key", "class").agg(F.count("*").alias("n"))
    several = each.groupBy("key").agg(F.sum("n").alias("members"), F.max("n").alias("largest"), F.max_by("class", "n").alias("main"))
    # Buckets of several classes; a pair alone in one has been compared, as one of it leads.
    several = written(several.where("members > largest and members > 2"), "near-mixed")
    open_ = written(attach(placed, several, ["key"], "members", ["node"], "inner", rows_per_part=rows_per_part), "near-open")

    blocks = lambda n: F.greatest(F.ceil(n / block).cast("int"), F.lit(1))
    all_blocks, few_blocks = blocks(F.col("members")), blocks(F.col("members") - F.col("largest"))
    own = lambda count: F.pmod(F.xxhash64("node", F.lit(7)), count).cast("int")
    each = ["key", "band", "node", "class", (F.col("class") != F.col("main")).alias("minor")]
    left = open_.where("class != main").select(*each, F.lit(True).alias("left"), own(few_blocks).alias("i"), F.explode(F.sequence(F.lit(0), all_blocks - 1)).alias("j"))
    right = open_.select(*each, F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0), few_blocks - 1)).alias("i"), own(all_blocks).alias("j"))
    cells = left.unionByName(right)
    ends = written(open_.groupBy("node").agg(F.count("*").alias("uses")), "near-ends")
    sets = _sets(ends, texts, broadcast_rows)
    known = written(sets.join(nodes.select("node", "sig"), "node"), "near-known")
    discard(sets)
    full = attach(cells, known, ["node"], "uses", ["key"], "inner", rows_per_part=rows_per_part).drop("uses")

    def linked(cell: pa.Table) -> pa.Table:
        node, group = cell.column("node").to_numpy(), cell.column("class").to_numpy()
        minor = cell.column("minor").to_numpy(zero_copy_only=False)
        is_left = cell.column("left").to_numpy(zero_copy_only=False)
        sigs = np.frombuffer(b"".join(cell.column("sig").to_pylist()), "<u4").reshape(len(node), BANDS, ROWS)
        band = cell.column("band")[0].as_py()
        right = np.flatnonzero(~is_left)
        # Numbers in arrays: a hot cell has half a million likely pairs.
        likely = [np.empty((3, 0), np.int32)]
        for one in np.flatnonzero(is_left):
            # Two members outside the main class meet twice.
            others = right[(group[right] != group[one]) & (~minor[right] | (node[right] > node[one]))]
            if len(others):
                same = sigs[others] == sigs[one]
                shared = same.all(axis=2)
                agree = same.sum(axis=(1, 2))
                good = (shared.argmax(axis=1) == band) & (agree >= PROMISING * BANDS * ROWS)
                likely.append(np.stack([agree[good], np.full(good.sum(), one), others[good]]).astype(np.int32))
        head = {int(c): int(c) for c in group}

        def find(c: int) -> int:
            while head[c] != c:
                head[c] = head[head[c]]
                c = head[c]
            return c

        sets, times = cell.column("set"), cell.column("times")
        known = lambda at: (sets[int(at)].as_py(), times[int(at)].as_py())
        a, b = [], []
        scores, ones, twos = np.concatenate(likely, axis=1)
        for at in np.lexsort((twos, ones, -scores)):
            one, other = ones[at], twos[at]
            x, y = find(int(group[one])), find(int(group[other]))
            if x != y and _similar(known(one), known(other)):
                head[x] = y
                a.append(int(min(node[one], node[other])))
                b.append(int(max(node[one], node[other])))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    links = written(full.groupBy("key", "i", "j").applyInArrow(linked, LINK), "near-across")
    discard(known)
    return links


def without_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row of every class of near duplicates, with the columns of `docs`."""
    prepared(docs.sparkSession)
    rows, decided = _decided(docs, text, doc_id, broadcast_rows, ROWS_PER_PART, BLOCK)
    dropped = decided.where("not kept").select("rid")
    few = dropped.count() <= broadcast_rows
    return rows.join(F.broadcast(dropped) if few else dropped, "rid", "left_anti").select(*[F.col(f"row.`{c}`") for c in docs.columns])
