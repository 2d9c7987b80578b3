"""How well searches do, and what searches and ingest did."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovelight.plans.lineage import written
from trovelight.plans.sizing import lookup, row_count_up_to
from trovelight.schemas import need
from trovelight.settings import DEFAULTS

# Words of a run that items are looked up by, and items without a whole word inside that one pass looks for.
RUN = 3
LOOSE_PER_PASS = 500


def _inner(text: Column) -> Column:
    """The words of a text but the first and the last, which may be parts of longer words where it is embedded."""
    words = F.split(text, r"\s+", -1)
    return F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))


def _runs(words: Column, size: int) -> Column:
    """Hashes of the distinct runs of so many words."""
    places = F.sequence(F.lit(1), F.size(words) - (size - 1))
    made = F.transform(places, lambda i: F.xxhash64(*[words[i - 1 + step] for step in range(size)]))
    return F.when(F.size(words) >= size, F.array_distinct(made)).otherwise(F.array().cast("array<bigint>"))


def texts_holding(
    docs: DataFrame,
    items: DataFrame,
    max_broadcast_rows: int = DEFAULTS.max_broadcast_rows,
    rows_per_part: int = DEFAULTS.rows_per_part,
) -> DataFrame:
    """(doc_id, query_id): the items whose whole text stands in a document, in whatever words it is embedded.

    Every item is looked up by one run of words inside it, the rarest over all documents; what shares that run is
    then compared as text. Items without a whole word inside are searched for as they are, a block of them at a
    time. Empty and null texts are found nowhere.

    Args:
        docs: (doc_id, text); a stored table, read three times.
        items: (query_id, text).
        max_broadcast_rows: Runs, and pairs to compare, that are sent to where documents are read; past that
            both sides are shuffled, and runs that very many documents share are split.
    """
    need(docs, "doc_id", "text")
    need(items, "query_id", "text")
    items = items.select("query_id", "text").where(F.col("text") != "")
    size = F.least(F.size(_inner(F.col("text"))), F.lit(RUN))
    sizes = [row["size"] for row in items.select(size.alias("size")).distinct().collect() if row["size"] > 0]
    by_size = F.array().cast("array<bigint>")
    for one in sizes:
        by_size = F.when(size == one, _runs(_inner(F.col("text")), one)).otherwise(by_size)
    keyed = written(items.withColumn("run", F.explode_outer(by_size)), "item-runs")
    asked = keyed.where("run IS NOT NULL").select("run").distinct()
    few = row_count_up_to(asked, max_broadcast_rows) is not None
    words = docs.select("doc_id", F.split("text", r"\s+", -1).alias("words"))
    runs = words.select("doc_id", F.explode(F.concat(F.array().cast("array<bigint>"), *[_runs(F.col("words"), one) for one in sizes])).alias("run"))
    held = written(lookup(runs, asked, ["run"], "left_semi", fits_broadcast=few, rows_per_part=rows_per_part), "held-runs")
    # A run that no document has rules its item out.
    counts = held.groupBy("run").agg(F.count("*").alias("documents"))
    rarest = (
        keyed.where("run IS NOT NULL").join(counts, "run", "left").groupBy("query_id")
        .agg(F.min_by("run", F.struct(F.coalesce("documents", F.lit(0)), "run")).alias("run"))
    )
    by_run = written(rarest.groupBy("run").agg(F.collect_list("query_id").alias("queries")), "rarest-runs")
    few = row_count_up_to(by_run, max_broadcast_rows) is not None
    pairs = lookup(held, by_run, ["run"], fits_broadcast=few, rows_per_part=rows_per_part)
    pairs = written(pairs.select("doc_id", F.explode("queries").alias("query_id")).distinct(), "item-pairs")
    few = row_count_up_to(pairs, max_broadcast_rows) is not None
    named = lookup(pairs, items.withColumnRenamed("text", "_item"), ["query_id"], rows_per_part=rows_per_part)
    compared = (F.broadcast(named) if few else named).join(docs.select("doc_id", "text"), "doc_id")
    found = compared.where(F.contains("text", F.col("_item"))).select("doc_id", "query_id")

    loose = written(keyed.where("run IS NULL").select("query_id", "text"), "loose-items")
    passes = -(-loose.count() // LOOSE_PER_PASS)
    for number in range(passes):
        block = loose.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == number).collect()
        listed = F.array(*[F.struct(F.lit(row.query_id).alias("query_id"), F.lit(row.text).alias("text")) for row in block])
        here = F.filter(listed, lambda item: F.contains(F.col("text"), item["text"]))
        if block:
            found = found.unionByName(docs.select("doc_id", F.explode(here).alias("item")).select("doc_id", F.col("item.query_id").alias("query_id")))
    return found.distinct()


def query_matrix(results: DataFrame, expectations: DataFrame, k: int = 20) -> DataFrame:
    """Per query what became of the assets it should find, and of those that should not be on top.

    Args:
        results: (query_id, asset_id, position).
        expectations: (query_id, asset_id, expected), expected being "must_hit" or "must_not_top".
        k: Recall counts hits among the first `k`.

    Returns:
        (query_id, must_hit, hits, best_position, recall, on_top), on_top counting assets that should
        not be first but are.
    """
    need(results, "query_id", "asset_id", "position")
    need(expectations, "query_id", "asset_id", "expected")
    judged = expectations.join(
        results.select("query_id", "asset_id", "position"), ["query_id", "asset_id"], "left"
    )
    wanted = F.col("expected") == "must_hit"
    hit = wanted & (F.col("position") <= k)
    return (
        judged.groupBy("query_id")
        .agg(
            F.count_if(wanted).alias("must_hit"),
            F.count_if(hit).alias("hits"),
            F.min(F.when(hit, F.col("position"))).alias("best_position"),
            F.count_if(~wanted & (F.col("position") == 1)).alias("on_top"),
        )
        .withColumn("recall", F.col("hits") / F.nullif(F.col("must_hit"), F.lit(0)))
    )


def search_metrics(
    queries: DataFrame,
    keyword_hits: DataFrame,
    vector_hits: DataFrame,
    matches: DataFrame,
    results: DataFrame,
) -> DataFrame:
    """Per query the units of both paths, the assets, and the results reranked and marked."""

    def counted(rows, name, column="*"):
        return rows.groupBy("query_id").agg(F.count(column).alias(name))

    found = (
        queries.select("query_id")
        .join(counted(keyword_hits, "units_keyword"), "query_id", "left")
        .join(counted(vector_hits, "units_vector"), "query_id", "left")
        .join(counted(matches, "assets"), "query_id", "left")
        .join(
            results.groupBy("query_id").agg(
                F.count("relevance").alias("reranked"),
                F.count("sentence_start").alias("sentences"),
            ),
            "query_id",
            "left",
        )
    )
    names = ["units_keyword", "units_vector", "assets", "reranked", "sentences"]
    return found.fillna(0, names)


def ingest_metrics(assets: DataFrame, units: DataFrame) -> DataFrame:
    """Per ready asset its attempts, units and milliseconds from claim to commit.

    Args:
        assets: (asset_id, status, attempts, started_at, finished_at).
        units: (asset_id, …).
    """
    need(assets, "asset_id", "status", "attempts", "started_at", "finished_at")
    counts = units.groupBy("asset_id").agg(F.count("*").alias("units"))
    return (
        assets.where(F.col("status") == "ready")
        .join(counts, "asset_id", "left")
        .select(
            "asset_id",
            "attempts",
            F.coalesce("units", F.lit(0)).alias("units"),
            (F.unix_millis("finished_at") - F.unix_millis("started_at")).alias("duration_ms"),
        )
    )
