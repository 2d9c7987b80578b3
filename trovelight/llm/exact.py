"""Exact duplicates by distributed MSD radix partitioning.

Texts are split into groups by their first bytes, groups by their next bytes, and so on, until a group
has one text or its texts have ended. Texts that end in one group are equal byte for byte; no digest
takes part. Each round's digit is wider than the last, so a text of n bytes takes about log(n) rounds,
and only texts that still share everything so far are carried on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovelight.llm.common import BROADCAST_ROWS, ROWS_PER_PART, attach, discard, prepared, row_of, written

# Runs of white space other than one space.
_RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*+|\x20[\x20\x09-\x0D]++"


def normalised(text: Column) -> Column:
    """`text` with every run of `[\\x20\\x09-\\x0D]` as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUNS, " ")


def equal_texts(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    carry: list[str] | None = None,
    first_digit: int = 64,
    growth: int = 8,
    broadcast_rows: int = BROADCAST_ROWS,
    rows_per_part: int = ROWS_PER_PART,
) -> DataFrame:
    """One row per row of `docs`: its carried columns as struct `row`, keep_id, group_size and kept.

    Of equal texts the row with the smallest id is kept, null ids after all others, and of rows that
    share that id one. Null texts count as empty; empty texts equal each other. An empty table gives an
    empty result. Carried columns may have any names.

    `docs` is read three times and has to give the same rows each time, as a stored table does. Each round counts groups with partial aggregation, so that copies shrink before they are shuffled,
    writes the groups of two or more, and joins them back (see `attach` for hot groups). In the first
    round whole texts stay in place while the groups fit a broadcast; later rounds shuffle what is left of
    the texts that are still in a group.

    Args:
        carry: Columns to carry along, by default all.
        first_digit: Bytes of the first digit; each next one has `growth` times as many.
    """
    prepared(docs.sparkSession)
    rows = docs.select(
        row_of(docs, carry),
        F.col(f"`{doc_id}`").alias("id"),
        normalised(F.col(f"`{text}`")).cast("binary").alias("rest"),
    )
    digit = F.substring("rest", 1, first_digit)
    groups = written(
        rows.groupBy(digit.alias("digit")).agg(F.count("*").alias("size")).where("size > 1")
        .withColumn("gid", F.monotonically_increasing_id()),
        "radix-groups",
    )

    def with_groups(how: str) -> DataFrame:
        return attach(rows.withColumn("digit", digit), groups, ["digit"], "size", ["id"], how, wide=True,
                      broadcast_rows=broadcast_rows, rows_per_part=rows_per_part)

    # Rows that share their first digit are written with what is left of their texts; all others, most
    # of a corpus, are read where they are.
    live = written(
        with_groups("inner").select(
            "row", "id", F.monotonically_increasing_id().alias("rid"), "gid",
            F.col("rest").substr(F.lit(first_digit + 1), F.octet_length("rest")).alias("rest"),
        ),
        "radix-first",
    )
    alone = [
        F.col("row"),
        F.col("id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
    ]
    result = with_groups("left_anti").select(*alone)
    width, first = first_digit, live
    while not live.isEmpty():
        width *= growth
        keyed = live.withColumn("digit", F.substring("rest", 1, width)).withColumn("ended", F.octet_length("rest") <= width)
        groups = written(
            keyed.groupBy("gid", "digit", "ended")
            .agg(F.count("*").alias("size"), F.min(F.struct(F.isnull("id").alias("no_id"), "id", "rid")).alias("keep"))
            .where("size > 1")
            .withColumn("next_gid", F.monotonically_increasing_id()),
            "radix-groups",
        )
        joined = written(
            attach(keyed, groups, ["gid", "digit", "ended"], "size", ["rid"], rows_per_part=rows_per_part)
            .select("row", "id", "rid", F.col("next_gid").alias("gid"), "ended", "size", "keep",
                    F.when(F.col("size").isNotNull() & ~F.col("ended"),
                           F.col("rest").substr(F.lit(width + 1), F.octet_length("rest"))).alias("rest")),
            "radix-round",
        )
        result = result.unionByName(joined.where("size is null").select(*alone)).unionByName(
            joined.where("size is not null and ended").select(
                "row", F.col("keep.id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("rid") == F.col("keep.rid")).alias("kept")
            )
        )
        live = joined.where("size is not null and not ended").select("row", "id", "rid", "gid", "rest")
        if first is not None:
            # Only this round has read it; later rounds are part of the result.
            discard(first)
            first = None
    return result


def without_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of `docs` that `equal_texts` keeps, with their columns."""
    return equal_texts(docs, text, doc_id).where("kept").select(*[F.col(f"row.`{c}`") for c in docs.columns])
