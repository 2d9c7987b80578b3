"""Every operator as a query over the given tables, with the SQL it is checked against.

A query is a function from `Views` to a DataFrame. Its SQL, where there is one, reads the tables
alone. Arrays are compared as joined strings and times as text.
"""

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from checks import sql
from checks.sql import query as q
from checks.views import DIMS, IMAGE_BASE, Views
from trovelight import fixed_values as fixed
from trovelight.functions import text as tx
from trovelight.functions.vectors import cosine_similarity
from trovelight.operators import (
    approximate,
    catalog,
    enrich,
    evaluate,
    explain,
    fusion,
    intake,
    keyword,
    lifecycle,
    metadata,
    nearest,
    passages,
    results,
    units,
)
from trovelight.plans import hybrid
from trovelight.plans.lineage import new_folder, written
from trovelight.plans.sizing import spread
from trovelight.settings import Settings
from trovelight.sources import blobs, files
from trovelight.streaming import ingest
from trovelight.streaming.store import Snapshot

QUERIES: dict[str, Callable[[Views], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def add(function):
        QUERIES[name] = function
        if oracle is not None:
            SQL[name] = oracle
        return function

    return add


def joined(column, by=",") -> F.Column:
    return F.array_join(column, by)


def as_text(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def sql_time(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


def now():
    return F.lit("2026-01-01 12:00:00").cast("timestamp")

SQL_NOW = "TIMESTAMP '2026-01-01 12:00:00'"

# --- A: intake ---------------------------------------------------------------------------------


@register(
    "a1_read_files",
    q("SELECT upload_id, collection, filename, size_bytes, sha256 FROM uploads", "uploads"),
)
def _(v):
    return v.files().select(
        "upload_id",
        "collection",
        "filename",
        F.octet_length("content").alias("size_bytes"),
        F.sha2("content", 256).alias("sha256"),
    )


@register("a1_read_folder")
def _(v):
    found = files.read_files(v.spark, v.folder, "*.parquet", digest=True)
    return found.select("filename", "size_bytes", "sha256")


@register(
    "a3_check_size",
    """SELECT doc_id AS upload_id, strlen(text)::INT AS size_bytes,
       CASE WHEN strlen(text) > 8192 THEN 'File is larger than the 0 MB limit.' END AS size_error FROM documents""",
)
def _(v):
    return intake.check_size(v.files(), 8192).select("upload_id", "size_bytes", "size_error")


def mixed_files(v: Views) -> DataFrame:
    """Documents as files of five forms: text, UTF-16, JPEG, PNG and text with a NUL."""
    doc = F.col("doc_id")
    text = F.encode("text", "UTF-8")
    png = F.concat(
        F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")),
        F.unhex(F.lpad(F.hex(F.lit(20000)), 8, "0")),
        F.unhex(F.lpad(F.hex(doc * 20), 8, "0")),
        text,
    )
    content = (
        F.when(doc % 5 == 0, text)
        .when(doc % 5 == 1, F.encode("text", "UTF-16"))
        .when(doc % 5 == 2, F.concat(F.unhex(F.lit("FFD8FFE0")), text))
        .when(doc % 5 == 3, png)
        .otherwise(F.concat(text, F.unhex(F.lit("0041"))))
    )
    return v.table("documents").select(doc.alias("upload_id"), content.alias("content"))


sql.view(
    "sniffed",
    f"""SELECT doc_id AS upload_id,
       CASE doc_id % 5 WHEN 0 THEN 'text' WHEN 2 THEN 'image' WHEN 3 THEN CASE WHEN doc_id * 400000 <= {fixed.MAX_IMAGE_PIXELS} THEN 'image' END END AS asset_type,
       CASE doc_id % 5 WHEN 0 THEN 'text/plain' WHEN 2 THEN 'image/jpeg' WHEN 3 THEN CASE WHEN doc_id * 400000 <= {fixed.MAX_IMAGE_PIXELS} THEN 'image/png' END END AS mime
FROM documents""",
)


@register(
    "a4_sniff",
    q(
        f"""SELECT upload_id, asset_type, mime, CASE WHEN mime IS NULL THEN '{fixed.UNSUPPORTED_FILE}' END AS reject_reason FROM sniffed""",
        "sniffed",
    ),
)
def _(v):
    return intake.sniff(mixed_files(v)).select("upload_id", "asset_type", "mime", "reject_reason")


@register(
    "a5_split_rejects",
    q(
        f"""SELECT s.upload_id, CASE WHEN doc_id % 5 = 0 AND strlen(text) > 8192 THEN 'File is larger than the 0 MB limit.'
       WHEN mime IS NULL THEN '{fixed.UNSUPPORTED_FILE}' END AS reason
FROM sniffed s JOIN documents d ON d.doc_id = s.upload_id""",
        "sniffed",
    ),
)
def _(v):
    # Only plain texts are measured here, so that the sizes of the other forms need no SQL.
    checked = intake.sniff(intake.check_size(mixed_files(v), 8192)).withColumn(
        "size_error", F.when(F.col("upload_id") % 5 == 0, F.col("size_error"))
    )
    accepted, rejected = intake.split_rejects(checked)
    return (
        accepted.select("upload_id", F.lit(None).cast("string").alias("reason"))
        .unionByName(rejected.select("upload_id", "reason"))
    )


@register("a6_content_hash", "SELECT doc_id AS upload_id, sha256(text) AS sha256 FROM documents")
def _(v):
    return intake.content_hash(v.files()).select("upload_id", "sha256")


@register(
    "a7_dedup_assets",
    q("SELECT asset_id, collection, sha256, arrival, filename, size_bytes FROM assets_text", "assets_text"),
)
def _(v):
    return v.assets_text().select(
        "asset_id", "collection", "sha256", "arrival", "filename", "size_bytes"
    )


@register(
    "a8_collect_aliases",
    q(
        """SELECT a.asset_id, u.filename AS alias, min(u.arrival) AS first_arrival
FROM uploads u JOIN assets_text a USING (collection, sha256) WHERE u.filename <> a.filename GROUP BY ALL""",
        "uploads",
        "assets_text",
    ),
)
def _(v):
    uploads = v.uploads().drop("content")
    return intake.collect_aliases(uploads, intake.dedup_assets(uploads)).select(
        "asset_id", "alias", "first_arrival"
    )


@register(
    "a7b_dedup_incremental",
    q(
        """, stored AS (SELECT min(upload_id) AS asset_id, collection, sha256, arg_min(filename, upload_id) AS filename
    FROM uploads SEMI JOIN labels ON upload_id = doc_id GROUP BY collection, sha256),
stored_names AS (SELECT DISTINCT collection, sha256, filename FROM uploads SEMI JOIN labels ON upload_id = doc_id),
fresh AS (SELECT * FROM uploads ANTI JOIN labels ON upload_id = doc_id),
inserts AS (SELECT min(upload_id) AS asset_id, collection, sha256, arg_min(filename, upload_id) AS filename
    FROM fresh ANTI JOIN stored USING (collection, sha256) GROUP BY collection, sha256),
owners AS (SELECT * FROM stored UNION ALL SELECT * FROM inserts)
SELECT 'insert' AS what, asset_id, filename AS name FROM inserts
UNION ALL
SELECT 'alias', o.asset_id, f.filename FROM (SELECT DISTINCT collection, sha256, filename FROM fresh) f
JOIN owners o USING (collection, sha256)
ANTI JOIN stored_names s ON s.collection = f.collection AND s.sha256 = f.sha256 AND s.filename = f.filename
WHERE f.filename <> o.filename""".replace(", stored AS", ",\nstored AS", 1),
        "uploads",
    ),
)
def _(v):
    uploads = v.uploads().drop("content")
    labelled = v.table("labels").select(F.col("doc_id").alias("upload_id"))
    before = uploads.join(labelled, "upload_id", "left_semi")
    stored = intake.dedup_assets(before)
    stored_aliases = intake.collect_aliases(before, stored)
    fresh = uploads.join(labelled, "upload_id", "left_anti")
    inserts, aliases = intake.dedup_incremental(fresh, stored, stored_aliases)
    return inserts.select(
        F.lit("insert").alias("what"), "asset_id", F.col("filename").alias("name")
    ).unionByName(
        aliases.select(F.lit("alias").alias("what"), "asset_id", F.col("alias").alias("name"))
    )


@register(
    "a9_a10_blobs",
    """SELECT sha256, bool_and(size IS NULL) AS missing, max(size) AS size FROM (
  SELECT DISTINCT sha256(text) AS sha256, strlen(text)::INT AS size FROM documents
  UNION ALL SELECT DISTINCT sha256(text), NULL FROM benchmark) GROUP BY sha256""",
)
def _(v):
    folder = new_folder(v.spark, "blobs")
    hashed = intake.content_hash(v.files())
    blobs.put_blobs(hashed, folder, digits=1)
    # The second time there is nothing left to store.
    blobs.put_blobs(hashed, folder, digits=1)
    keys = (
        hashed.select("sha256")
        .unionByName(v.table("benchmark").select(F.sha2("text", 256).alias("sha256")))
        .distinct()
    )
    return blobs.get_blobs(keys, folder, digits=1).select(
        "sha256", "missing", F.octet_length("content").alias("size")
    )


@register(
    "a11_check_collection_name",
    r"""SELECT collection, regexp_matches(collection, '\A[a-z0-9_-]{1,64}\z') AS name_ok FROM (
  SELECT DISTINCT lang AS collection FROM documents UNION SELECT source || '_' || doc_id FROM documents
  UNION SELECT url FROM pages UNION SELECT upper(role) FROM conversations)""",
)
def _(v):
    docs = v.table("documents")
    names = (
        docs.select(F.col("lang").alias("collection"))
        .union(docs.select(F.concat("source", F.lit("_"), F.col("doc_id").cast("string"))))
        .union(v.table("pages").select("url"))
        .union(v.table("conversations").select(F.upper("role")))
        .distinct()
    )
    return intake.check_collection_name(names)


@register(
    "a12_check_query_params",
    rf"""SELECT conv_id, turn, CASE WHEN NOT regexp_matches(collection, '\A[a-z0-9_-]{{1,64}}\z') THEN 'collection: not a collection name.'
  WHEN length(text) > 500 THEN 'q: at most 500 characters.' WHEN page < 1 THEN 'page: must be 1 or more.'
  WHEN "order" NOT IN ('relevance', 'exact_first', 'tiered', 'blended') THEN 'order: not one of the orders.'
  WHEN match <> 'exact' THEN 'match: not one of the matches.' END AS reject_reason
FROM (SELECT *, CASE WHEN role = 'system' THEN 'System' ELSE role END AS collection,
  CASE WHEN turn % 7 = 6 THEN 0 ELSE turn + 1 END AS page, CASE WHEN conv_id % 3 = 0 THEN 'newest' ELSE 'tiered' END AS "order",
  CASE WHEN conv_id % 4 = 0 THEN 'close' ELSE 'exact' END AS match FROM conversations)""",
)
def _(v):
    conv = F.col("conv_id")
    asked = v.table("conversations").select(
        "conv_id",
        "turn",
        F.when(F.col("role") == "system", F.lit("System")).otherwise(F.col("role")).alias("collection"),
        F.col("text").alias("q"),
        F.when(F.col("turn") % 7 == 6, 0).otherwise(F.col("turn") + 1).alias("page"),
        F.when(conv % 3 == 0, F.lit("newest")).otherwise(F.lit("tiered")).alias("order"),
        F.array(F.when(conv % 4 == 0, F.lit("close")).otherwise(F.lit("exact"))).alias("match_kinds"),
        F.lit(None).cast("array<string>").alias("asset_types"),
        F.lit(None).cast("array<string>").alias("unit_kinds"),
    )
    return intake.check_query_params(asked).select("conv_id", "turn", "reject_reason")


@register(
    "a13_commit_units",
    q(
        """SELECT asset_id, CASE WHEN done THEN 'ready' ELSE status END AS status, CASE WHEN done THEN 'New ' || asset_id ELSE title END AS title,
       CASE WHEN done THEN 2 + coalesce(n, 0) ELSE 0 END::INT AS new_units
FROM (SELECT doc_id AS asset_id, (['pending', 'processing', 'ready', 'failed'])[doc_id % 4 + 1] AS status,
      CASE WHEN doc_id % 4 = 2 THEN 'Title ' || doc_id END AS title, doc_id % 4 = 1 AND doc_id % 3 <> 0 AND doc_id % 5 <> 0 AS done FROM documents)
LEFT JOIN (SELECT asset_id, count(*) AS n FROM chunks GROUP BY asset_id) USING (asset_id)""",
        "chunks",
    ),
)
def _(v):
    assets = v.assets_state()
    asset = F.col("asset_id")
    # Every third lease was lost, and every fifth asset lacks a vector.
    work = assets.where(F.col("status") == "processing").select(
        "asset_id",
        "collection",
        "asset_type",
        "filename",
        F.when(asset % 3 == 0, F.col("started_at") - F.expr("INTERVAL 1 HOUR"))
        .otherwise(F.col("started_at"))
        .alias("started_at"),
        F.concat(F.lit("New "), asset.cast("string")).alias("title"),
        F.lit("described").alias("description"),
        F.array(F.lit("new")).alias("tags"),
        F.lit("").alias("visible_text"),
        F.lit(None).cast("string").alias("image_type"),
        F.lit("fake-vision").alias("vision_model"),
    )
    chunks = v.chunks().join(work.select("asset_id"), "asset_id", "left_semi")
    made = units.build_units(work, chunks)
    vectors = units.embed_hashed_words(made, dims=DIMS, keep=("unit_id", "asset_id", "kind")).where(
        (asset % 5 != 0) | (F.col("kind") != "filename")
    )
    after, inserted = lifecycle.commit_units(assets, work, made, vectors)
    counts = inserted.groupBy("asset_id").agg(F.count("*").cast("int").alias("n"))
    return after.join(counts, "asset_id", "left").select(
        "asset_id", "status", "title", F.coalesce("n", F.lit(0)).alias("new_units")
    )


# --- B: texts and units ------------------------------------------------------------------------


@register("b1_decode_text", "SELECT doc_id AS upload_id, length(text)::INT AS n_chars, sha256(text) AS sha256 FROM documents")
def _(v):
    mark = F.unhex(F.lit("EFBBBF"))
    marked = v.files().withColumn(
        "content",
        F.when(F.col("upload_id") % 2 == 0, F.concat(mark, F.col("content"))).otherwise(F.col("content")),
    )
    return passages.decode_text(marked).select(
        "upload_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("sha256")
    )


@register(
    "b2_chunk_text",
    q("SELECT asset_id, unit_index, start_char, end_char, text FROM chunks", "chunks"),
)
def _(v):
    return v.chunks().select("asset_id", "unit_index", "start_char", "end_char", "text")


@register(
    "b3_summary_text",
    """SELECT doc_id AS asset_id, CASE WHEN length(text) <= 2000 THEN 'whole' ELSE 'head' END AS summary_of,
       sha256(substr(text, 1, 2000)) AS sha256 FROM documents""",
)
def _(v):
    texts = v.table("documents").select(F.col("doc_id").alias("asset_id"), "text")
    return passages.summary_text(texts, 500).select(
        "asset_id", "summary_of", F.sha2("summary", 256).alias("sha256")
    )


def raw_assets(v: Views) -> DataFrame:
    columns = ["asset_id", "collection", "filename", "asset_type", *enrich.METADATA]
    return v.described_text().select(*columns).unionByName(v.raw_images().select(*columns))


@register(
    "b4_normalise_metadata",
    q(
        "SELECT asset_id, title, description, array_to_string(tags, '|') AS tags, coalesce(visible_text, '') AS visible_text, image_type FROM assets",
        "assets",
    ),
)
def _(v):
    return metadata.normalise_metadata(raw_assets(v)).select(
        "asset_id", "title", "description", joined("tags", "|").alias("tags"), "visible_text", "image_type"
    )


@register(
    "b4b_metadata_trim_report",
    q(
        f"""SELECT asset_id, array_to_string(list_filter([
  CASE WHEN length({sql.strip("title")}) > 120 THEN 'title' END, CASE WHEN length({sql.strip("description")}) > 1000 THEN 'description' END,
  CASE WHEN length({sql.strip("visible_text")}) > 10000 THEN 'visible_text' END], lambda x: x IS NOT NULL), ',') AS truncated,
  (len(tags) - len(kept))::INT AS tags_dropped
FROM model_tags WHERE len(tags) > len(kept) OR length({sql.strip("title")}) > 120 OR length({sql.strip("description")}) > 1000
  OR length({sql.strip("visible_text")}) > 10000""",
        "model_tags",
    ),
)
def _(v):
    return metadata.metadata_trim_report(raw_assets(v)).select(
        "asset_id", joined("truncated").alias("truncated"), "tags_dropped"
    )


@register(
    "b5_type_tags",
    q("SELECT asset_id, array_to_string(fixed_tags, '|') AS tags FROM typed", "typed"),
)
def _(v):
    return v.assets().select(
        "asset_id",
        joined(metadata.type_tags(F.col("asset_type"), F.col("image_type")), "|").alias("tags"),
    )


@register(
    "b6_metadata_body",
    q("SELECT asset_id, body FROM unit_parts WHERE kind = 'metadata'", "unit_parts"),
)
def _(v):
    assets = v.assets()
    return assets.select("asset_id", metadata.metadata_body(assets).alias("body"))


@register(
    "b7_filename_body",
    q("SELECT asset_id, body FROM unit_parts WHERE kind = 'filename'", "unit_parts"),
)
def _(v):
    return v.assets().select("asset_id", metadata.filename_body(F.col("filename")).alias("body"))


@register(
    "b8_build_units",
    q(
        "SELECT unit_id, asset_id, collection, asset_type, kind, unit_index, start_char, end_char, body FROM units",
        "units",
    ),
)
def _(v):
    return v.units()


@register(
    "b9_assign_unit_ids",
    q(
        """SELECT unit_id, asset_id, kind, (row_number() OVER (PARTITION BY asset_id ORDER BY unit_id))::INT AS place FROM units""",
        "units",
    ),
)
def _(v):
    # The order of ids is the order units are built in.
    order = F.struct(units.kind_number(F.col("kind")), "unit_index")
    place = F.row_number().over(W.partitionBy("asset_id").orderBy(order))
    return v.units().select("unit_id", "asset_id", "kind", place.alias("place"))


@register(
    "b10_build_postings",
    q(
        "SELECT collection, term, unit_id, asset_id, kind, asset_type, tf, array_to_string(positions, ',') AS positions FROM postings",
        "postings",
    ),
)
def _(v):
    return v.postings().withColumn("positions", joined("positions"))


@register(
    "b10_build_postings_stemmed",
    q(
        "SELECT collection, term, unit_id, asset_id, kind, asset_type, tf, array_to_string(positions, ',') AS positions FROM postings_stemmed",
        "postings_stemmed",
    ),
)
def _(v):
    return v.postings(stemmed=True).withColumn("positions", joined("positions"))


@register(
    "b11_stem_vocabulary",
    q(
        "SELECT term, coalesce(stem, term) AS stem FROM (SELECT DISTINCT term FROM postings) LEFT JOIN stems ON word = term",
        "postings",
        "stems",
    ),
)
def _(v):
    return units.stem_vocabulary(v.postings())


sql.view(
    "doc_sentences",
    sql.sentences("(SELECT doc_id, text FROM documents)", "doc_id", "text"),
)


@register(
    "b12_split_sentences",
    q('SELECT doc_id, start_at AS "start", end_at AS "end", sentence AS text FROM doc_sentences', "doc_sentences"),
)
def _(v):
    return passages.split_sentences(v.documents(), "doc_id")


@register(
    "b13_photo_details",
    """SELECT event_id, CASE WHEN NOT broken THEN taken_at END AS taken_at,
  CASE WHEN NOT broken AND lat_half IS NOT NULL AND lon_half IS NOT NULL THEN CASE WHEN lat_half = 'S' THEN -lat ELSE lat END END AS latitude,
  CASE WHEN NOT broken AND lat_half IS NOT NULL AND lon_half IS NOT NULL THEN CASE WHEN lon_half = 'W' THEN -lon ELSE lon END END AS longitude
FROM (SELECT *, (event_id % 11 = 0 AND lat_half IS NOT NULL) OR (event_id % 13 = 0 AND lon_half IS NOT NULL) AS broken
FROM (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M') END AS taken_at,
  CASE event_id % 5 WHEN 0 THEN 'N' WHEN 1 THEN 'S' WHEN 2 THEN 'N' WHEN 3 THEN 'S' END AS lat_half,
  CASE event_id % 3 WHEN 0 THEN 'E' WHEN 1 THEN 'W' END AS lon_half,
  (user_id % 90)::DOUBLE + (event_id % 60)::DOUBLE / 60 + (event_id % 59)::DOUBLE / 3600 AS lat,
  (user_id % 180)::DOUBLE + (event_id % 58)::DOUBLE / 60 + (event_id % 57)::DOUBLE / 3600 AS lon FROM events))""",
)
def _(v):
    event = F.col("event_id")

    def parts(*numbers):
        return F.array(*[number.cast("double") for number in numbers])

    photos = v.table("events").select(
        "event_id",
        F.when(event % 7 != 0, F.date_format("ts", "yyyy:MM:dd HH:mm:ss")).alias("taken"),
        # Some photos have two numbers for a place, some lack one of them.
        F.when(event % 11 == 0, parts(event % 60, event % 59))
        .otherwise(parts(F.col("user_id") % 90, event % 60, event % 59))
        .alias("latitude_parts"),
        F.array(F.lit("N"), F.lit("S"), F.lit("N"), F.lit("S"), F.lit(None).cast("string"))[
            (event % 5).cast("int")
        ].alias("latitude_half"),
        parts(
            F.col("user_id") % 180, F.when(event % 13 != 0, event % 58), event % 57
        ).alias("longitude_parts"),
        F.array(F.lit("E"), F.lit("W"), F.lit(None).cast("string"))[(event % 3).cast("int")].alias(
            "longitude_half"
        ),
    )
    return metadata.photo_details(photos).select("event_id", "taken_at", "latitude", "longitude")


# --- C: models ---------------------------------------------------------------------------------


@register(
    "c1_describe_lookup",
    q(
        """SELECT a.asset_id, CASE WHEN bad THEN 'failed' WHEN d.filename IS NULL THEN 'general' ELSE 'known' END AS outcome,
  CASE WHEN bad THEN NULL WHEN d.filename IS NULL THEN name ELSE d.title END AS title,
  CASE WHEN bad THEN NULL WHEN d.filename IS NULL THEN 'An uploaded text file.' ELSE d.description END AS description
FROM (SELECT *, filename LIKE 'src7-%' AS bad, CASE WHEN filename LIKE 'src7-%' THEN 'invalid-' || filename ELSE filename END AS name FROM assets_text) a
LEFT JOIN descriptions d ON d.filename = a.filename""",
        "assets_text",
        "descriptions",
    ),
)
def _(v):
    bad = F.col("filename").startswith("src7-")
    assets = v.assets_text().withColumn(
        "filename", F.when(bad, F.concat(F.lit("invalid-"), "filename")).otherwise(F.col("filename"))
    )
    described, failures = enrich.describe_lookup(assets, v.descriptions())
    general = F.col("description") == fixed.UNKNOWN_TEXT
    nothing = F.lit(None).cast("string")
    return described.select(
        "asset_id",
        F.when(general, F.lit("general")).otherwise(F.lit("known")).alias("outcome"),
        "title",
        "description",
    ).unionByName(
        failures.select(
            "asset_id",
            F.lit("failed").alias("outcome"),
            nothing.alias("title"),
            nothing.alias("description"),
        )
    )


def answers(v: Views) -> DataFrame:
    """What up to three models would answer for every document, twice each; many answers are broken."""
    doc = F.col("doc_id")
    tried = v.table("documents").select(
        doc.alias("asset_id"),
        F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("model_rank"),
        "source",
    ).withColumn("try", F.explode(F.array(F.lit(1), F.lit(2))))
    number = (F.col("asset_id") * 7 + F.col("model_rank") * 5 + F.col("try") * 3) % 10
    title = F.concat(F.lit("Doc "), F.col("asset_id").cast("string"))
    whole = F.concat(
        F.lit('{"title": "'), title, F.lit('", "description": "From '), F.col("source"),
        F.lit('", "tags": ["a", "b"], "visible_text": "", "image_type": null}'),
    )
    body = (
        F.when(number == 0, F.lit('{"title": "Half an answer", "description": '))
        .when(number == 1, F.lit('{"title": "t", "description": "d", "tags": [], "image_type": null}'))
        .when(number == 2, F.lit('{"title": 5, "description": "d", "tags": [], "visible_text": "", "image_type": null}'))
        .when(number == 3, F.lit('{"title": "t", "description": "d", "tags": ["x", 1], "visible_text": "", "image_type": "photo"}'))
        .when(number == 4, F.lit('{"title": "t", "description": "d", "tags": [], "visible_text": "", "image_type": "painting"}'))
        .when(number == 5, F.lit('{"title": "t", "description": "d", "tags": [], "visible_text": "", "image_type": "photo", "extra": 1}'))
        .otherwise(whole)
    )
    code_number = (F.col("asset_id") + F.col("model_rank") * 3 + F.col("try")) % 11
    code = F.when(code_number < 3, 429).when(code_number == 3, 503).when(code_number == 4, 500).otherwise(200)
    return tried.select("asset_id", "model_rank", "try", code.alias("http_code"), body.alias("body"))


sql.view(
    "answers",
    """SELECT *, CASE number
  WHEN 0 THEN '{"title": "Half an answer", "description": '
  WHEN 1 THEN '{"title": "t", "description": "d", "tags": [], "image_type": null}'
  WHEN 2 THEN '{"title": 5, "description": "d", "tags": [], "visible_text": "", "image_type": null}'
  WHEN 3 THEN '{"title": "t", "description": "d", "tags": ["x", 1], "visible_text": "", "image_type": "photo"}'
  WHEN 4 THEN '{"title": "t", "description": "d", "tags": [], "visible_text": "", "image_type": "painting"}'
  WHEN 5 THEN '{"title": "t", "description": "d", "tags": [], "visible_text": "", "image_type": "photo", "extra": 1}'
  ELSE '{"title": "Doc ' || asset_id || '", "description": "From ' || source || '", "tags": ["a", "b"], "visible_text": "", "image_type": null}' END AS body,
  CASE WHEN code_number < 3 THEN 429 WHEN code_number = 3 THEN 503 WHEN code_number = 4 THEN 500 ELSE 200 END AS http_code
FROM (SELECT doc_id AS asset_id, model_rank, try, source, (doc_id * 7 + model_rank * 5 + try * 3) % 10 AS number,
      (doc_id + model_rank * 3 + try) % 11 AS code_number
      FROM documents, (SELECT unnest([1, 2, 3]) AS model_rank), (SELECT unnest([1, 2]) AS try))""",
)
sql.view(
    "judged",
    """SELECT *, coalesce(json_valid(body) AND json_type(body, '$.title') = 'VARCHAR' AND json_type(body, '$.description') = 'VARCHAR'
  AND json_type(body, '$.visible_text') = 'VARCHAR' AND json_type(body, '$.tags') = 'ARRAY'
  AND len(list_filter(json_extract(body, '$.tags[*]'), lambda t: json_type(t) <> 'VARCHAR')) = 0
  AND (json_type(body, '$.image_type') = 'NULL' OR json_extract_string(body, '$.image_type') IN ('photo', 'screenshot', 'document', 'diagram', 'other')), false) AS valid
FROM (SELECT * REPLACE (CASE WHEN json_valid(body) THEN body END AS body) FROM answers)""",
    "answers",
)


@register(
    "c2_validate_answers",
    q(
        """SELECT asset_id, model_rank, try, valid, CASE WHEN valid THEN json_extract_string(body, '$.title') END AS title,
  CASE WHEN valid THEN array_to_string(json_extract_string(body, '$.tags[*]'), ',') END AS tags FROM judged""",
        "judged",
    ),
)
def _(v):
    return enrich.validate_answers(answers(v)).select(
        "asset_id",
        "model_rank",
        "try",
        "valid",
        F.col("metadata.title").alias("title"),
        joined("metadata.tags").alias("tags"),
    )


@register(
    "c3_select_answer",
    q(
        """, verdicts AS (SELECT *, CASE WHEN http_code IN (429, 503) THEN 'overloaded' WHEN http_code <> 200 THEN 'error'
  WHEN valid THEN 'described' ELSE 'invalid' END AS verdict FROM judged),
models AS (SELECT a.asset_id, a.model_rank, CASE WHEN a.verdict = 'invalid' THEN b.verdict ELSE a.verdict END AS outcome,
  CASE WHEN a.verdict = 'invalid' THEN 2 ELSE 1 END AS try,
  CASE WHEN a.verdict = 'invalid' THEN b.body ELSE a.body END AS body
  FROM verdicts a JOIN verdicts b ON a.asset_id = b.asset_id AND a.model_rank = b.model_rank AND a.try = 1 AND b.try = 2),
ends AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY outcome = 'overloaded',
  CASE WHEN outcome = 'overloaded' THEN -model_rank ELSE model_rank END) AS place FROM models)
SELECT asset_id, outcome, model_rank, try, CASE WHEN outcome = 'described' THEN json_extract_string(body, '$.title') END AS title
FROM ends WHERE place = 1""".replace(", verdicts", ",\nverdicts", 1),
        "judged",
    ),
)
def _(v):
    return enrich.select_answer(answers(v)).select(
        "asset_id", "outcome", "model_rank", "try", F.col("metadata.title").alias("title")
    )


@register(
    "c5_check_vectors",
    """SELECT page_id, CASE WHEN vec_id IS NULL THEN 'missing' WHEN label % 3 = 0 THEN 'length ' || (len(embedding) - label) END AS problem
FROM pages LEFT JOIN embeddings ON vec_id = page_id WHERE vec_id IS NULL OR (label % 3 = 0 AND label > 0)""",
)
def _(v):
    # Vectors of every third label lost some numbers.
    label = F.col("label")
    vectors = v.table("embeddings").select(
        F.col("vec_id").alias("page_id"),
        F.when(label % 3 == 0, F.slice("embedding", F.lit(1), F.size("embedding") - label))
        .otherwise(F.col("embedding"))
        .alias("embedding"),
    )
    return enrich.check_vectors(v.table("pages"), vectors, "page_id", DIMS)


@register(
    "c6_infer_incremental",
    """, requests AS (SELECT doc_id, text, sha256(text) AS content FROM documents),
cache AS (SELECT DISTINCT content FROM requests SEMI JOIN labels USING (doc_id))
SELECT r.doc_id, length(r.text)::INT AS answer, c.content IS NOT NULL AS from_cache FROM requests r LEFT JOIN cache c USING (content)""".replace(
        ", requests", "WITH requests", 1
    ),
)
def _(v):
    def requests(docs):
        key = enrich.request_key(
            model=F.lit("length"), dims=F.lit(1), input_type=F.lit("document"),
            kind=F.lit("text"), content_sha256=F.sha2("text", 256),
        )
        return docs.select("doc_id", "text", key.alias("request"))

    def model(rows):
        return rows.select(
            "request", F.length("text").alias("answer"), F.lit(False).alias("from_cache")
        )

    inputs = requests(v.table("documents"))
    known = inputs.join(v.table("labels").select("doc_id"), "doc_id", "left_semi")
    cache = (
        known.groupBy("request")
        .agg(F.first(F.length("text")).alias("answer"))
        .withColumn("from_cache", F.lit(True))
    )
    answered, _ = enrich.infer_incremental(inputs, cache, model, ["answer", "from_cache"])
    return answered.select("doc_id", "answer", "from_cache")


@register(
    "c7_embed_hashed_words",
    q(
        """SELECT unit_id, (unnest(range(64)))::INT AS bucket, round(unnest(embedding)::DOUBLE, 6) AS weight FROM unit_dense""",
        "unit_dense",
    ),
)
def _(v):
    embedded = units.embed_hashed_words(v.units(), dims=DIMS, keep=("unit_id",))
    return embedded.select(
        "unit_id", F.posexplode("embedding").alias("bucket", "weight")
    ).withColumn("weight", F.round(F.col("weight").cast("double"), 6))


@register(
    "c7_sparse_vectors",
    q(
        """SELECT unit_id, bucket::INT AS bucket, round((n / sqrt((sum(n * n) OVER (PARTITION BY unit_id))::DOUBLE))::FLOAT::DOUBLE, 6) AS weight FROM unit_counts""",
        "unit_counts",
    ),
)
def _(v):
    return units.sparse_vectors(v.units(), "unit_id", dims=DIMS).withColumn(
        "weight", F.round(F.col("weight").cast("double"), 6)
    )


@register(
    "c9_embed_batches",
    q(
        """SELECT unit_id, length(body)::DOUBLE AS n_chars, (length(body) - length(replace(body, 'e', '')))::DOUBLE AS n_e, FALSE AS failed
FROM units WHERE body IS NOT NULL""",
        "units",
    ),
)
def _(v):
    def embed(texts):
        return [[float(len(text)), float(text.count("e"))] for text in texts]

    rows = v.units().where(F.col("body").isNotNull())
    embedded = enrich.embed_batches(rows, "unit_id", "asset_id", "body", embed, batch=100)
    return embedded.select(
        "unit_id",
        F.col("embedding")[0].cast("double").alias("n_chars"),
        F.col("embedding")[1].cast("double").alias("n_e"),
        F.col("error").isNotNull().alias("failed"),
    )


@register(
    "c9_embed_failing_calls",
    q(
        """SELECT unit_id, CASE WHEN NOT failed THEN length(body)::DOUBLE END AS n_chars, failed
FROM (SELECT *, bool_or(length(body) % 7 = 0) OVER (PARTITION BY asset_id) AS failed FROM units WHERE body IS NOT NULL)""",
        "units",
    ),
)
def _(v):
    """A call for every text, some of which fail: no text of their assets gets a vector."""

    def embed(texts):
        if any(len(text) % 7 == 0 for text in texts):
            raise ValueError("not today")
        return [[float(len(text))] for text in texts]

    rows = v.units().where(F.col("body").isNotNull())
    embedded = enrich.embed_batches(rows, "unit_id", "asset_id", "body", embed, batch=1)
    return embedded.select("unit_id", F.col("embedding")[0].cast("double").alias("n_chars"), F.col("error").isNotNull().alias("failed"))


@register(
    "c11_prepare_inputs",
    q(
        """SELECT t.asset_id, sha256(t.text) AS summary, count(c.asset_id) AS n_chunks FROM texts t LEFT JOIN chunks c USING (asset_id) GROUP BY ALL""",
        "texts",
        "chunks",
    ),
)
def _(v):
    contents = v.assets_text().select("asset_id", "collection").join(
        v.files().select(F.col("upload_id").alias("asset_id"), "content"), "asset_id"
    )
    summaries, chunks = enrich.prepare_inputs(contents)
    counts = chunks.groupBy("asset_id").agg(F.count("*").alias("n_chunks"))
    return summaries.join(counts, "asset_id", "left").select(
        "asset_id", F.sha2("summary", 256).alias("summary"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks")
    )


# --- D: life cycle -----------------------------------------------------------------------------

LIFE = ["asset_id", "status", "error", "attempts"]


def life(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*LIFE, as_text("started_at").alias("started_at"), *more)


@register(
    "d1_claim",
    q(
        f"""SELECT a.asset_id, CASE WHEN c.asset_id IS NULL THEN status ELSE 'processing' END AS status, error,
  CASE WHEN c.asset_id IS NULL THEN attempts ELSE attempts + 1 END AS attempts,
  {sql_time("CASE WHEN c.asset_id IS NULL THEN started_at ELSE " + SQL_NOW + " END")} AS started_at, c.asset_id IS NOT NULL AS claimed
FROM assets_state a LEFT JOIN (SELECT asset_id FROM assets_state WHERE status = 'pending' ORDER BY created_at, asset_id LIMIT 50) c USING (asset_id)""",
        "assets_state",
    ),
)
def _(v):
    return life(lifecycle.claim(v.assets_state(), 50, now()), "claimed")


def work(v: Views) -> DataFrame:
    """Work begun under leases of which every third has changed since."""
    asset = F.col("asset_id")
    return v.assets_state().where("status IN ('processing', 'pending')").select(
        "asset_id",
        F.when((asset % 3 == 0) | F.col("started_at").isNull(), F.col("created_at") - F.expr("INTERVAL 1 HOUR"))
        .otherwise(F.col("started_at"))
        .alias("started_at"),
    )


sql.view(
    "work",
    """SELECT asset_id, status, CASE WHEN asset_id % 3 = 0 OR started_at IS NULL THEN created_at - INTERVAL 1 HOUR ELSE started_at END AS lease,
  status = 'processing' AND asset_id % 3 <> 0 AS held FROM assets_state WHERE status IN ('processing', 'pending')""",
    "assets_state",
)


@register("d2_lease_guard", q("SELECT asset_id, held FROM work", "work"))
def _(v):
    held, lost = lifecycle.lease_guard(work(v), v.assets_state())
    return held.select("asset_id", F.lit(True).alias("held")).unionByName(
        lost.select("asset_id", F.lit(False).alias("held"))
    )


@register(
    "d3_record_failure",
    q(
        f"""SELECT a.asset_id, CASE WHEN w.held THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'pending' END ELSE a.status END AS status,
  CASE WHEN w.held THEN CASE WHEN a.asset_id % 2 = 0 OR a.asset_id % 5 = 0 THEN '{fixed.INVALID_ANSWER.replace("'", "''")}' ELSE substr('OSError: ' || d.text, 1, 1000) END ELSE error END AS error,
  attempts, {sql_time("CASE WHEN w.held THEN NULL ELSE started_at END")} AS started_at
FROM assets_state a JOIN documents d ON d.doc_id = a.asset_id LEFT JOIN work w ON w.asset_id = a.asset_id""",
        "assets_state",
        "work",
    ),
)
def _(v):
    asset = F.col("asset_id")
    texts = v.table("documents").select(F.col("doc_id").alias("asset_id"), F.col("text").alias("message"))
    errors = work(v).join(texts, "asset_id").withColumn(
        "error_class",
        F.when((asset % 2 == 0) | (asset % 5 == 0), F.lit("ValidationError")).otherwise(F.lit("OSError")),
    )
    return life(lifecycle.record_failure(v.assets_state(), errors))


@register(
    "d4_reap",
    q(
        f"""SELECT asset_id, CASE WHEN how = 'failed' THEN 'failed' WHEN how = 'released' THEN 'pending' ELSE status END AS status,
  CASE WHEN how = 'failed' THEN 'Processing did not finish within the lease 3 times.' ELSE error END AS error, attempts,
  {sql_time("CASE WHEN how IS NULL THEN started_at END")} AS started_at, how AS reaped
FROM (SELECT *, CASE WHEN status = 'processing' AND started_at < {SQL_NOW} - INTERVAL 10 MINUTE THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'released' END END AS how FROM assets_state)""",
        "assets_state",
    ),
)
def _(v):
    return life(lifecycle.reap(v.assets_state(), now()), "reaped")


@register(
    "d4_reap_counts",
    q(
        f"""SELECT count(*) FILTER (attempts >= 3) AS n_failed, count(*) FILTER (attempts < 3) AS n_released
FROM assets_state WHERE status = 'processing' AND started_at < {SQL_NOW} - INTERVAL 10 MINUTE""",
        "assets_state",
    ),
)
def _(v):
    return lifecycle.reap_counts(lifecycle.reap(v.assets_state(), now()))


def asked_ids(v: Views) -> DataFrame:
    """Ids to retry: labelled documents, and pages that are no assets."""
    return (
        v.table("labels")
        .select(F.col("doc_id").alias("asset_id"))
        .unionByName(v.table("pages").select((F.col("page_id") + 10_000_000).alias("asset_id")))
    )


@register(
    "d5_retry",
    q(
        """SELECT i.asset_id, CASE WHEN status IS NULL THEN 'unknown' WHEN status = 'failed' THEN 'retried' ELSE 'refused' END AS outcome,
  CASE WHEN status IS NULL THEN 'Asset not found.' WHEN status <> 'failed' THEN 'Only a failed asset can be retried; this one is ' || status || '.' END AS message,
  CASE WHEN status = 'failed' THEN 'pending' ELSE status END AS status_after, CASE WHEN status = 'failed' THEN 0 ELSE attempts END AS attempts_after
FROM (SELECT DISTINCT doc_id AS asset_id FROM labels UNION SELECT page_id + 10000000 FROM pages) i LEFT JOIN assets_state a USING (asset_id)""",
        "assets_state",
    ),
)
def _(v):
    after, outcomes = lifecycle.retry(v.assets_state(), asked_ids(v))
    now = after.select(
        "asset_id", F.col("status").alias("status_after"), F.col("attempts").alias("attempts_after")
    )
    return outcomes.join(now, "asset_id", "left")


@register(
    "d5_retry_collection",
    q(
        f"""SELECT asset_id, CASE WHEN hit THEN 'pending' ELSE status END AS status, CASE WHEN hit THEN NULL ELSE error END AS error,
  CASE WHEN hit THEN 0 ELSE attempts END AS attempts, {sql_time("CASE WHEN hit THEN NULL ELSE started_at END")} AS started_at, hit AS retried
FROM (SELECT *, collection = 'en' AND status = 'failed' AS hit FROM assets_state)""",
        "assets_state",
    ),
)
def _(v):
    return life(lifecycle.retry_collection(v.assets_state(), "en"), "retried")


_ingested: dict[tuple[str, str], ingest.Ingest] = {}


def ingested(v: Views) -> ingest.Ingest:
    """Documents and pages, the pages as images, taken in as a stream; once per application.

    Documents of one source are never described, so their assets fail after all their attempts.
    """
    key = (v.spark.sparkContext.applicationId, v.folder)
    if key in _ingested:
        return _ingested[key]

    def arriving(name: str) -> DataFrame:
        return (
            v.spark.readStream.schema(v.table(name).schema)
            .option("pathGlobFilter", f"{name}.parquet")
            .parquet(v.folder)
        )

    columns = ["collection", "filename", "arrival", "content"]
    documents = files.files_of_documents(arriving("documents")).select(*columns)
    images = arriving("pages").select(
        F.lit("web").alias("collection"),
        F.concat(F.lit("IMG_"), F.col("page_id").cast("string"), F.lit(".jpg")).alias("filename"),
        (F.col("page_id") + IMAGE_BASE).alias("arrival"),
        F.concat(F.unhex(F.lit("FFD8FFE0")), F.col("html").cast("binary")).alias("content"),
    )
    described = ["filename", *enrich.METADATA]
    known = v.descriptions().select(*described).unionByName(v.raw_images().select(*described))

    def describe(work):
        named = work.withColumn(
            "filename",
            F.when(F.col("filename").startswith("src7-"), F.concat(F.lit("invalid-"), "filename"))
            .otherwise(F.col("filename")),
        )
        return enrich.answered(*enrich.describe_lookup(named, known))

    def embed_images(images):
        numbers = [F.octet_length("content"), F.lit(1)]
        return images.withColumns(
            {
                "embedding": F.array(*[number.cast("float") for number in numbers]),
                "embedding_model": F.lit("sizes-2"),
            }
        )

    models = ingest.Models(
        describe, lambda rows: units.embed_hashed_words(rows, dims=DIMS), embed_images
    )
    run = ingest.Ingest(
        new_folder(v.spark, "ingest"), models, Settings(blob_digits=1), stem=False, shards=4
    )
    run.start(documents.unionByName(images), new_folder(v.spark, "progress")).awaitTermination()
    _ingested[key] = run
    return run


@register(
    "d7_ingest_stream",
    q(
        """SELECT a.asset_id, a.filename, CASE WHEN bad THEN 'failed' ELSE 'ready' END AS status, CASE WHEN bad THEN 3 ELSE 1 END AS attempts,
  CASE WHEN NOT bad THEN a.title END AS title, CASE WHEN bad THEN 0 ELSE n END AS n_units, CASE WHEN bad THEN 0 ELSE n END AS n_vectors,
  CASE WHEN bad THEN 0 ELSE coalesce(p.n_postings, 0) END AS n_postings
FROM (SELECT *, starts_with(filename, 'src7-') AS bad FROM assets) a
LEFT JOIN (SELECT asset_id, count(*) AS n FROM units GROUP BY 1) u USING (asset_id)
LEFT JOIN (SELECT asset_id, count(*) AS n_postings FROM postings GROUP BY 1) p USING (asset_id)""",
        "assets",
        "units",
        "postings",
    ),
)
def _(v):
    """Documents and pages as a stream: what batch operators make of them, made by `foreachBatch`."""
    run = ingested(v)
    index = run.index(v.spark)

    def counted(rows, name):
        return rows.groupBy("asset_id").agg(F.count("*").alias(name))

    assets = run.assets(v.spark)
    for rows, name in (
        (index.units, "n_units"),
        (index.vectors, "n_vectors"),
        (index.postings, "n_postings"),
    ):
        assets = assets.join(counted(rows, name), "asset_id", "left")
    # Ids are given out in the order of arrival, which tells what an asset was made from.
    return assets.select(
        F.unix_millis("created_at").alias("asset_id"),
        "filename",
        "status",
        "attempts",
        "title",
        *[F.coalesce(name, F.lit(0)).alias(name) for name in ("n_units", "n_vectors", "n_postings")],
    )


# The store of `changed` by application and folder: the ingest, the snapshots so far and the steps that are left.
_changed: dict[tuple[str, str], tuple[ingest.Ingest, dict[str, Snapshot], Iterator[str]]] = {}


def changed(v: Views, step: str) -> tuple[ingest.Ingest, Snapshot]:
    """Documents taken in by two batches, half of the failed ones "retried", a collection "deleted" and uploaded
    "again", all folders put together ("compact"): up to a step, with the snapshot after it. Each step is made once per
    application, when it or a later one is first asked for.

    Documents of one source cannot be described at first.
    """
    key = (v.spark.sparkContext.applicationId, v.folder)
    if key not in _changed:
        root = new_folder(v.spark, "changed")
        known = v.descriptions().select("filename", *enrich.METADATA)

        def made(broken: bool) -> ingest.Ingest:
            def describe(work):
                bad = F.col("filename").startswith("src7-") & F.lit(broken)
                named = work.withColumn("filename", F.when(bad, F.concat(F.lit("invalid-"), "filename")).otherwise(F.col("filename")))
                return enrich.answered(*enrich.describe_lookup(named, known))

            models = ingest.Models(describe, lambda rows: units.embed_hashed_words(rows, dims=DIMS))
            return ingest.Ingest(root, models, Settings(blob_digits=1), stem=False, shards=4)

        later = made(False)
        _changed[key] = later, {}, _changes(v, made(True), later)
    run, seen, left = _changed[key]
    try:
        while step not in seen:
            name = next(left)
            seen[name] = run.snapshot(v.spark)
    except BaseException:
        # What failed half-way is begun anew, in another folder.
        del _changed[key]
        raise
    return run, seen[step]


def _changes(v: Views, first: ingest.Ingest, later: ingest.Ingest) -> Iterator[str]:
    """The steps of `changed`, named once they are made."""
    uploaded = v.files().select("collection", "filename", "arrival", "content")
    middle = uploaded.agg(F.floor(F.avg("arrival"))).first()[0] or 0
    first.run_batch(uploaded.where(F.col("arrival") <= middle), 0)
    first.run_batch(uploaded.where(F.col("arrival") > middle), 1)
    failed = first.assets(v.spark).where("status = 'failed'")
    later.retry(v.spark, failed.where(F.unix_millis("created_at") % 2 == 0).select("asset_id"))
    yield "retried"
    later.delete_collection(v.spark, "fr")
    yield "deleted"
    later.run_batch(uploaded.where("collection = 'fr'"), 2)
    yield "again"
    later.compact(v.spark, whole=True)
    yield "compact"


def stored_states(v: Views, step: str) -> DataFrame:
    """What a snapshot holds of every asset, told apart by arrival."""
    run, snapshot = changed(v, step)
    index = run.index(v.spark, snapshot)
    found = run.assets(v.spark, snapshot)
    for rows, name in ((index.units, "n_units"), (index.vectors, "n_vectors"), (index.postings, "n_postings")):
        found = found.join(rows.groupBy("asset_id").agg(F.count("*").alias(name)), "asset_id", "left")
    return found.select(
        F.unix_millis("created_at").alias("asset_id"),
        "collection",
        "status",
        "attempts",
        *[F.coalesce(name, F.lit(0)).alias(name) for name in ("n_units", "n_vectors", "n_postings")],
    )


def stored_sql(bad: str, where: str) -> str:
    """`stored_states` where `bad` says which assets failed."""
    return q(
        f"""SELECT a.asset_id, collection, CASE WHEN bad THEN 'failed' ELSE 'ready' END AS status, CASE WHEN bad THEN 3 ELSE 1 END AS attempts,
  CASE WHEN bad THEN 0 ELSE n END AS n_units, CASE WHEN bad THEN 0 ELSE n END AS n_vectors, CASE WHEN bad THEN 0 ELSE coalesce(n_postings, 0) END AS n_postings
FROM (SELECT *, starts_with(filename, 'src7-') AND ({bad}) AS bad FROM assets WHERE collection <> 'web' AND ({where})) a
LEFT JOIN (SELECT asset_id, count(*) AS n FROM units GROUP BY 1) u USING (asset_id)
LEFT JOIN (SELECT asset_id, count(*) AS n_postings FROM postings GROUP BY 1) p USING (asset_id)""",
        "assets",
        "units",
        "postings",
    )


@register("d5_retry_stored", stored_sql("asset_id % 2 = 1", "true"))
def _(v):
    """Assets that failed three times, half of them retried by id from the stored blobs."""
    return stored_states(v, "retried")


@register("e4_delete_stored", stored_sql("asset_id % 2 = 1", "collection <> 'fr'"))
def _(v):
    """A collection deleted in the store: nothing of it is left to be read."""
    return stored_states(v, "deleted")


@register("d7_compact", stored_sql("asset_id % 2 = 1 AND collection <> 'fr'", "true"))
def _(v):
    """The deleted collection uploaded again, then all folders put together: every asset and unit once."""
    return stored_states(v, "compact")


@register(
    "e4_search_after_deletion",
    q(
        """SELECT query_id, asset_id, kind, unit_index, all_words, keyword_score, rank FROM (
  SELECT m.*, u.asset_id, u.kind, u.unit_index,
    (row_number() OVER (PARTITION BY m.query_id ORDER BY m.all_words DESC, m.keyword_score DESC, m.unit_id))::INT AS rank
  FROM keyword_matches m JOIN units u USING (unit_id) JOIN assets a ON a.asset_id = u.asset_id
  WHERE a.collection <> 'web' AND (a.collection = 'fr' OR a.asset_id % 2 = 0 OR NOT starts_with(a.filename, 'src7-'))) WHERE rank <= 100""",
        "keyword_matches",
        "units",
        "assets",
    ),
)
def _(v):
    """A search after a collection was deleted and uploaded again: its old units take none of the 100 places."""
    run, snapshot = changed(v, "again")
    index = run.index(v.spark, snapshot)
    found = keyword.keyword_search(v.queries(), index.postings, stem=False)
    came_from = index.assets.select("asset_id", F.unix_millis("created_at").alias("_origin"))
    return (
        found.join(index.units.select("unit_id", "unit_index"), "unit_id")
        .join(came_from, "asset_id")
        .select("query_id", F.col("_origin").alias("asset_id"), "kind", "unit_index", "all_words", "keyword_score", "rank")
    )


@register("a2_read_files_stream")
def _(v):
    arriving = files.read_files_stream(v.spark, v.folder, "*.parquet", files_per_batch=5, digest=True)
    hashed = arriving.select("filename", "size_bytes", "sha256")
    folder = new_folder(v.spark, "read")
    stream = (
        hashed.writeStream.format("parquet")
        .option("path", folder)
        .option("checkpointLocation", new_folder(v.spark, "progress"))
        .trigger(availableNow=True)
        .start()
    )
    stream.awaitTermination()
    return v.spark.read.schema(hashed.schema).parquet(folder)


# --- E: catalogue ------------------------------------------------------------------------------


@register(
    "e1_list_assets",
    q(
        f"""SELECT asset_id, filename, status, {sql_time("created_at")} AS created_at FROM assets_state WHERE collection = 'en'""",
        "assets_state",
    ),
)
def _(v):
    return catalog.list_assets(v.assets_state(), "en").select(
        "asset_id", "filename", "status", as_text("created_at").alias("created_at")
    )


@register(
    "e2_get_assets",
    q(
        """SELECT i.asset_id, a.asset_id IS NOT NULL AS found, a.filename FROM (SELECT doc_id AS asset_id FROM labels
  UNION ALL SELECT page_id + 10000000 FROM pages) i LEFT JOIN assets_state a USING (asset_id)""",
        "assets_state",
    ),
)
def _(v):
    return catalog.get_assets(asked_ids(v), v.assets_state()).select("asset_id", "found", "filename")


@register(
    "e3_list_collections",
    q("SELECT collection, count(*) AS asset_count FROM assets GROUP BY collection", "assets"),
)
def _(v):
    return catalog.list_collections(v.index().assets)


@register(
    "e4_delete_collection",
    q(
        """SELECT 'asset' AS what, asset_id AS id FROM assets WHERE collection <> 'en'
UNION ALL SELECT 'unit', unit_id FROM units WHERE collection <> 'en' UNION ALL SELECT 'vector', unit_id FROM vectors WHERE collection <> 'en'
UNION ALL SELECT 'posting', unit_id FROM postings WHERE collection <> 'en' GROUP BY unit_id
UNION ALL SELECT 'alias', a.asset_id FROM uploads u JOIN assets_text a USING (collection, sha256)
  WHERE u.filename <> a.filename AND collection <> 'en' GROUP BY a.asset_id
UNION ALL SELECT 'deleted', count(*) FROM assets WHERE collection = 'en'""",
        "assets",
        "units",
        "vectors",
        "postings",
        "uploads",
        "assets_text",
    ),
)
def _(v):
    index = v.index()
    uploads = v.uploads().drop("content")
    aliases = intake.collect_aliases(uploads, intake.dedup_assets(uploads))
    kept, deleted = catalog.delete_collection(
        "en",
        index.assets,
        units=index.units,
        vectors=index.vectors,
        postings=index.postings,
        aliases=aliases,
    )

    def ids(name, what, key):
        return kept[name].select(F.lit(what).alias("what"), F.col(key).cast("bigint").alias("id"))

    return (
        ids("assets", "asset", "asset_id")
        .unionByName(ids("units", "unit", "unit_id"))
        .unionByName(ids("vectors", "vector", "unit_id"))
        .unionByName(ids("postings", "posting", "unit_id").distinct())
        .unionByName(ids("aliases", "alias", "asset_id").distinct())
        .unionByName(deleted.select(F.lit("deleted").alias("what"), F.col("deleted").alias("id")))
    )


@register(
    "e5_status_summary",
    q(
        """SELECT collection, count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'processing') AS processing,
  count(*) FILTER (status = 'ready') AS ready, count(*) FILTER (status = 'failed') AS failed FROM assets_state GROUP BY collection""",
        "assets_state",
    ),
)
def _(v):
    return catalog.status_summary(v.assets_state())


@register(
    "e8_asset_view",
    q(
        f"""SELECT asset_id, collection, filename, size_bytes, status, error, {sql_time("created_at")} AS created_at,
  status = 'ready' AS has_metadata, CASE WHEN status = 'ready' THEN title END AS title, CASE WHEN status = 'ready' THEN array_to_string(tags, ',') END AS tags
FROM assets_state""",
        "assets_state",
    ),
)
def _(v):
    return catalog.asset_view(v.assets_state()).select(
        "asset_id",
        "collection",
        "filename",
        "size_bytes",
        "status",
        "error",
        as_text("created_at").alias("created_at"),
        F.col("metadata").isNotNull().alias("has_metadata"),
        F.col("metadata.title").alias("title"),
        joined("metadata.tags").alias("tags"),
    )


@register(
    "e8_asset_aliases",
    q(
        """SELECT asset_id, alias, (row_number() OVER (PARTITION BY asset_id ORDER BY first_arrival, alias))::INT AS place FROM (
SELECT a.asset_id, u.filename AS alias, min(u.arrival) AS first_arrival
FROM uploads u JOIN assets_text a USING (collection, sha256) WHERE u.filename <> a.filename GROUP BY ALL)""",
        "uploads",
        "assets_text",
    ),
)
def _(v):
    uploads = v.uploads().drop("content")
    assets = intake.dedup_assets(uploads)
    return catalog.asset_aliases(assets, intake.collect_aliases(uploads, assets))


# --- F: keyword path ---------------------------------------------------------------------------


@register(
    "f1_normalise_query",
    f"SELECT conv_id, turn, {sql.collapse('text')} AS q FROM conversations",
)
def _(v):
    return v.table("conversations").select(
        "conv_id", "turn", keyword.normalise_query(F.col("text")).alias("q")
    )


def typed(v: Views) -> DataFrame:
    """Queries as people type them: words, phrases, exclusions and alternatives of every item; `t` is
    the whole item as words, without the one that separates alternatives."""
    words = tx.tokens(F.col("text"))
    runs = F.regexp_extract_all(F.lower("text"), F.lit(tx.WORD), F.lit(0))
    return v.table("benchmark").select(
        F.col("item_id").alias("query_id"),
        F.array(*[F.lit(c) for c in ("en", "fr", "de", "es", "web")])[
            (F.col("item_id") % 5).cast("int")
        ].alias("collection"),
        F.element_at(words, 1).alias("a"),
        F.element_at(words, 2).alias("b"),
        F.element_at(words, 3).alias("c"),
        F.element_at(words, 4).alias("d"),
        F.element_at(words, -1).alias("z"),
        F.array_join(F.array_remove(runs, "or"), " ").alias("t"),
    )


def typed_queries(v: Views, form: str) -> DataFrame:
    """`form` with the words put in for {a}, {b}, {c}, {d}, {z} and the whole text for {t}."""
    made = F.lit(form)
    for name in "abcdzt":
        made = F.replace(made, F.lit("{" + name + "}"), F.replace(F.col(name), F.lit('"')))
    return typed(v).select("query_id", "collection", made.alias("q"))


sql.view(
    "typed_queries",
    f"""SELECT item_id AS query_id, (['en', 'fr', 'de', 'es', 'web'])[item_id % 5 + 1] AS collection, text,
  list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda x: x <> 'or') AS t,
  list_transform([words[1], words[2], words[3], words[4], words[-1]], lambda w: replace(w, '"', '')) AS w
FROM (SELECT *, regexp_extract_all(text, '{sql.NOT_SPACE}+') AS words FROM benchmark)""",
)


@register(
    "f2_uses_search_syntax",
    f"""SELECT conv_id, turn, contains(text, '"') OR len(list_filter(regexp_extract_all(lower(text), '{sql.NOT_SPACE}+'),
  lambda w: w = 'or' OR starts_with(w, '-'))) > 0 AS syntax FROM conversations""",
)
def _(v):
    return v.table("conversations").select(
        "conv_id", "turn", keyword.uses_search_syntax(F.col("text")).alias("syntax")
    )


@register(
    "f3_query_terms",
    q("SELECT query_id, literal::INT AS literal, term, position::INT AS position FROM query_terms", "query_terms"),
)
def _(v):
    return keyword.query_terms(v.queries(), stem=False).select(
        "query_id", "literal", "term", "position"
    )


@register(
    "f4_match_any",
    q("SELECT query_id, unit_id FROM keyword_matches", "keyword_matches"),
)
def _(v):
    return keyword.match_units(v.queries(), v.index().postings, stem=False).select("query_id", "unit_id")


@register(
    "f5_match_all",
    q("SELECT query_id, unit_id, all_words FROM keyword_matches", "keyword_matches"),
)
def _(v):
    return keyword.match_units(v.queries(), v.index().postings, stem=False).select(
        "query_id", "unit_id", "all_words"
    )


def words_of(n: int) -> str:
    """SQL for the words of the n-th word typed, with their places."""
    return f"regexp_extract_all(lower(w[{n}]), '[\\p{{L}}\\p{{N}}]+')"


# A unit as one array of its words, for SQL that looks at neighbours.
sql.view(
    "unit_words",
    r"""SELECT unit_id, collection, regexp_extract_all(lower(coalesce(body, '')), '[\p{L}\p{N}]+') AS words FROM units""",
    "units",
)


def asked_of(words: str) -> str:
    """The words of a list that are not stop words."""
    return f"list_filter({words}, lambda x: x NOT IN ({sql.STOPS}))"


def holds_all(words: str) -> str:
    return f"len(list_filter({asked_of(words)}, lambda x: NOT list_contains(words, x))) = 0"


def asks(words: str) -> str:
    return f"len({asked_of(words)}) > 0"


def follows(words: str) -> str:
    """The words stand next to each other in this order, stop words standing for any word."""
    return f"""len(list_filter(range(-len({words}), len(words) + 1), lambda s: len(list_filter(range(1, len({words}) + 1),
  lambda i: {words}[i] NOT IN ({sql.STOPS}) AND (s + i < 1 OR coalesce(words[s + i], '') <> {words}[i]))) = 0)) > 0"""


def weight(words: str) -> str:
    """The sum over the different words asked for of 1 + 1/4 + 1/9 + … over their occurrences."""
    return f"""coalesce(list_sum(list_transform(list_distinct({asked_of(words)}), lambda x: list_sum(list_transform(
  range(1, len(list_filter(words, lambda o: o = x)) + 1), lambda j: 1.0 / (j * j))))), 0)"""


def n_asked(words: str) -> str:
    return f"greatest(len(list_distinct({asked_of(words)})), 1)"


def best_units(matches: str) -> str:
    """The 100 best of (query_id, unit_id, score), as a keyword search returns them."""
    return q(
        f"""SELECT query_id, unit_id, TRUE AS all_words, keyword_score, rank FROM (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY keyword_score DESC, unit_id))::INT AS rank
  FROM (SELECT query_id, unit_id, round(score, 9) AS keyword_score FROM ({matches}))) WHERE rank <= 100""",
        "typed_queries",
        "unit_words",
    )


def searched(v: Views, form: str, units=None) -> DataFrame:
    hits = keyword.keyword_search(typed_queries(v, form), v.index().postings, units, stem=False)
    return hits.select("query_id", "unit_id", "all_words", "keyword_score", "rank")


A, B, C, D, Z = (words_of(n) for n in range(1, 6))
PHRASE = f"({A} || {B})"


@register(
    "f6_match_phrase",
    best_units(
        f"""SELECT t.query_id, u.unit_id, {weight(PHRASE)} / {n_asked(PHRASE)} AS score FROM typed_queries t JOIN unit_words u USING (collection)
WHERE {asks(PHRASE)} AND {holds_all(PHRASE)} AND {follows(PHRASE)}"""
    ),
)
def _(v):
    return searched(v, '"{a} {b}"')


@register(
    "f6_match_whole_text",
    best_units(
        f"""SELECT t.query_id, u.unit_id, {weight("t")} / {n_asked("t")} AS score FROM typed_queries t JOIN unit_words u USING (collection)
WHERE {asks("t")} AND {holds_all("t")} AND {follows("t")}"""
    ),
)
def _(v):
    return searched(v, '"{t}"')


@register(
    "f7_match_exclude",
    best_units(
        f"""SELECT t.query_id, u.unit_id, {weight(C)} / {n_asked(C)} AS score FROM typed_queries t JOIN unit_words u USING (collection)
WHERE {asks(C)} AND {holds_all(C)} AND NOT ({asks(D)} AND {holds_all(D)}) AND NOT ({asks(Z)} AND {holds_all(Z)})"""
    ),
)
def _(v):
    return searched(v, "{c} -{d} -{z}")


@register(
    "f7_only_exclude",
    best_units(
        f"""SELECT t.query_id, u.unit_id, 0.0 AS score FROM typed_queries t JOIN unit_words u USING (collection)
WHERE {asks(C)} AND NOT {holds_all(C)}"""
    ),
)
def _(v):
    return searched(v, "-{c}", v.index().units)


@register(
    "f7_exclude_in_one_alternative",
    best_units(
        f"""SELECT query_id, unit_id, {weight("held")} / {n_asked(f"({A} || {B})")} AS score FROM (
  SELECT *, CASE WHEN {asks(A)} AND {holds_all(A)} THEN {A} ELSE [] END
    || CASE WHEN {asks(B)} AND {holds_all(B)} AND NOT ({asks(D)} AND {holds_all(D)}) THEN {B} ELSE [] END AS held
  FROM typed_queries t JOIN unit_words u USING (collection)) WHERE {asks("held")}"""
    ),
)
def _(v):
    return searched(v, "{a} or {b} -{d}")


@register(
    "f8_match_or",
    best_units(
        f"""SELECT query_id, unit_id, {weight("held")} / {n_asked(f"(t || {C} || {D})")} AS score FROM (
  SELECT *, CASE WHEN {asks("t")} AND {holds_all("t")} THEN t ELSE [] END
    || CASE WHEN {asks(f"({C} || {D})")} AND {holds_all(C)} AND {holds_all(D)} THEN ({C} || {D}) ELSE [] END AS held
  FROM typed_queries t JOIN unit_words u USING (collection)) WHERE {asks("held")}"""
    ),
)
def _(v):
    return searched(v, "{t} or {c} {d}")


@register(
    "f9_keyword_score",
    q("SELECT query_id, unit_id, keyword_score FROM keyword_matches", "keyword_matches"),
)
def _(v):
    return keyword.match_units(v.queries(), v.index().postings, stem=False).select(
        "query_id", "unit_id", "keyword_score"
    )


@register(
    "f10_keyword_search",
    q(
        "SELECT query_id, unit_id, asset_id, kind, asset_type, all_words, keyword_score, rank FROM keyword_hits",
        "keyword_hits",
    ),
)
def _(v):
    return keyword.keyword_search(v.queries(), v.index().postings, stem=False, blocks=v.index().blocks)


@register(
    "f10_keyword_search_by_sums",
    q(
        "SELECT query_id, unit_id, asset_id, kind, asset_type, all_words, keyword_score, rank FROM keyword_hits",
        "keyword_hits",
    ),
)
def _(v):
    """Without blocks: every posting of every word is summed."""
    return keyword.keyword_search(v.queries(), v.index().postings, stem=False)


@register(
    "f10_keyword_search_stemmed",
    q(
        "SELECT query_id, unit_id, asset_id, kind, asset_type, all_words, keyword_score, rank FROM keyword_hits_stemmed",
        "keyword_hits_stemmed",
    ),
)
def _(v):
    return keyword.keyword_search(v.queries(), v.postings(stemmed=True))


# --- G: vector path ----------------------------------------------------------------------------


@register(
    "g1_cosine_similarity",
    """SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def _(v):
    first = v.table("embeddings").select("vec_id", "embedding")
    second = first.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return first.join(second, "vec_id").select(
        "vec_id", F.round(cosine_similarity(F.col("embedding"), F.col("other")), 9).alias("similarity")
    )


VECTOR_HITS = q(
    "SELECT query_id, unit_id, asset_id, kind, asset_type, similarity, rank FROM vector_hits", "vector_hits"
)


@register("g2_vector_search", VECTOR_HITS)
def _(v):
    return nearest.vector_search(v.query_vectors(), v.index().vectors, rank_digits=6)


@register("g2_vector_search_shuffled", VECTOR_HITS)
def _(v):
    return nearest.vector_search(
        v.query_vectors(), v.index().vectors, rank_digits=6, max_broadcast_vectors=0
    )


@register(
    "g2_given_vectors",
    """SELECT query_id, unit_id, similarity, rank FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, unit_id))::INT AS rank
FROM (SELECT a.vec_id AS query_id, b.vec_id AS unit_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity
      FROM embeddings a JOIN embeddings b ON a.label = b.label)) WHERE rank <= 10""",
)
def _(v):
    rows = v.table("embeddings").select(
        F.col("vec_id").alias("unit_id"),
        F.col("vec_id").alias("asset_id"),
        F.lit("image").alias("kind"),
        F.lit("image").alias("asset_type"),
        F.col("label").cast("string").alias("collection"),
        F.lit("given-64").alias("embedding_model"),
        "embedding",
    )
    asked = rows.select(F.col("unit_id").alias("query_id"), "collection", "embedding_model", "embedding")
    return nearest.vector_search(asked, rows, k=10, rank_digits=6).select(
        "query_id", "unit_id", "similarity", "rank"
    )


@register(
    "g3_same_space",
    q(
        """SELECT unit_id, embedding_model FROM vectors SEMI JOIN (SELECT DISTINCT collection FROM queries) USING (collection)
WHERE embedding_model = 'hashed-64'""",
        "vectors",
        "queries",
    ),
)
def _(v):
    return nearest.same_space(v.index().vectors, v.query_vectors()).select("unit_id", "embedding_model")


@register("g4_vector_search_sparse", VECTOR_HITS)
def _(v):
    model = F.lit(f"hashed-{DIMS}").alias("embedding_model")
    every = v.index().units
    asked = v.queries()
    return nearest.vector_search_sparse(
        asked.select("query_id", "collection", model),
        units.sparse_vectors(asked, "query_id", "q", DIMS),
        every.select("unit_id", "asset_id", "collection", "kind", "asset_type", model),
        units.sparse_vectors(every, "unit_id", dims=DIMS),
        DIMS,
        rank_digits=6,
    )


@register("g5_vector_search_approx")
def _(v):
    return approximate.vector_search_approx(v.query_vectors(), v.vector_lists(), rank_digits=6)


@register(
    "g5_rerank",
    q(
        """SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, unit_id))::INT AS rank
FROM similarity_pairs WHERE (unit_id + query_id) % 7 = 0) WHERE rank <= 100""",
        "similarity_pairs",
    ),
)
def _(v):
    # Candidates by a rule that SQL can state: what re-ranking makes of any.
    asked, vectors = v.query_vectors(), v.index().vectors
    candidates = asked.join(vectors.select("collection", "embedding_model", "unit_id"), ["collection", "embedding_model"])
    candidates = candidates.where((F.col("unit_id") + F.col("query_id")) % 7 == 0).select("query_id", "unit_id")
    return approximate.rerank_exactly(asked, candidates, vectors, 100, rank_digits=6)


# --- H: fusion and results ---------------------------------------------------------------------


def hits(v: Views) -> tuple[DataFrame, DataFrame]:
    return (
        keyword.keyword_search(v.queries(), v.index().postings, stem=False, blocks=v.index().blocks),
        nearest.vector_search(v.query_vectors(), v.index().vectors, rank_digits=6),
    )


def fused(v: Views) -> DataFrame:
    return fusion.fuse_units(*hits(v))


@register(
    "h1_fuse_units",
    q(
        "SELECT query_id, unit_id, keyword_rank, vector_rank, round(score, 12) AS score FROM fused", "fused"
    ),
)
def _(v):
    return fused(v).select(
        "query_id", "unit_id", "keyword_rank", "vector_rank", F.round("score", 12).alias("score")
    )


@register("h2_match_kind", q("SELECT query_id, unit_id, match FROM fused", "fused"))
def _(v):
    return fused(v).select("query_id", "unit_id", "match")


@register(
    "h3_relative_score",
    q("SELECT query_id, unit_id, round(relative_score, 9) AS relative_score FROM scaled", "scaled"),
)
def _(v):
    return fusion.relative_score(fused(v)).select(
        "query_id", "unit_id", F.round("relative_score", 9).alias("relative_score")
    )


def chosen(v: Views) -> DataFrame:
    return fusion.with_choices(v.queries()).select("query_id", "collection", "q", *fusion.CHOICES)


def kept_units(v: Views) -> DataFrame:
    scaled = fusion.relative_score(fused(v))
    return fusion.filter_units(scaled.join(chosen(v), "query_id"))


@register("h4_filter_units", q("SELECT query_id, unit_id FROM kept_units", "kept_units"))
def _(v):
    return kept_units(v).select("query_id", "unit_id")


@register(
    "h5_group_by_asset",
    q(
        "SELECT query_id, asset_id, unit_id, best_unit_id, round(score, 9) AS score, match FROM grouped", "grouped"
    ),
)
def _(v):
    return fusion.group_by_asset(kept_units(v)).select(
        "query_id", "asset_id", "unit_id", "best_unit_id", F.round("score", 9).alias("score"), "match"
    )


@register("h6_filter_matches", q("SELECT query_id, asset_id, match FROM ordered", "ordered"))
def _(v):
    grouped = fusion.group_by_asset(kept_units(v), "match_kinds")
    return fusion.filter_matches(grouped).select("query_id", "asset_id", "match")


@register(
    "h7_order_matches",
    q('SELECT query_id, asset_id, "order", position FROM ordered', "ordered"),
)
def _(v):
    grouped = fusion.group_by_asset(kept_units(v), "match_kinds", "order")
    return fusion.order_matches(fusion.filter_matches(grouped)).select(
        "query_id", "asset_id", "order", "position"
    )


def matches(v: Views) -> DataFrame:
    return hybrid.rank_assets(v.queries(), *hits(v))


@register(
    "h8_cap_and_page",
    q(
        """SELECT query_id, asset_id, position, n_matches > page * 20 AS has_more FROM capped
WHERE position > (page - 1) * 20 AND position <= page * 20""",
        "capped",
    ),
)
def _(v):
    return fusion.cap_and_page(matches(v).drop("n_matches")).select(
        "query_id", "asset_id", "position", "has_more"
    )


@register(
    "h9_fetch_results",
    q(
        """SELECT c.query_id, c.position, c.asset_id, a.filename, u.kind AS snippet_kind,
  CASE WHEN u.kind = 'content' THEN u.body WHEN u.kind IN ('metadata', 'image') THEN a.description
       WHEN u.kind = 'visible_text' THEN a.visible_text ELSE a.filename END AS snippet_text, u.start_char, u.end_char
FROM capped c JOIN units u USING (unit_id) JOIN assets a ON a.asset_id = c.asset_id
WHERE position > (page - 1) * 20 AND position <= page * 20""",
        "capped",
        "units",
        "assets",
    ),
)
def _(v):
    page = fusion.cap_and_page(matches(v).drop("n_matches"))
    return results.fetch_results(page, v.index().units, v.index().assets).select(
        "query_id",
        "position",
        "asset_id",
        "filename",
        F.col("snippet.kind").alias("snippet_kind"),
        F.col("snippet.text").alias("snippet_text"),
        F.col("snippet.start_char").alias("start_char"),
        F.col("snippet.end_char").alias("end_char"),
    )


def embed_sentences(rows: DataFrame) -> DataFrame:
    return units.embed_hashed_words(rows, "text", DIMS)


def search(v: Views, sentences: bool = True, relevance=results.word_share) -> DataFrame:
    """Hybrid search over all units, for every query."""
    return hybrid.hybrid_search(
        v.queries(),
        v.query_vectors().drop("collection"),
        v.index().postings,
        v.index().units,
        v.index().vectors,
        v.index().assets,
        embed_sentences if sentences else None,
        relevance,
        stem=False,
        rank_digits=6,
        blocks=v.index().blocks,
        sentences_required=True,
    )


@register(
    "h10_rerank",
    q("SELECT query_id, asset_id, position, round(relevance, 9) AS relevance FROM reranked", "reranked"),
)
def _(v):
    return search(v, sentences=False).select(
        "query_id", "asset_id", "position", F.round("relevance", 9).alias("relevance")
    )


@register(
    "h11_rerank_cached",
    q(
        f""", pairs AS (SELECT DISTINCT q, snippet_text, query_id FROM fetched WHERE page = 1 AND position <= 20)
SELECT q, snippet_text AS text, round(relevance, 9) AS relevance, bool_and(cached) AS cached FROM (
SELECT q, snippet_text, {sql.WORD_SHARE} AS relevance, query_id % 2 = 0 AS cached FROM pairs) GROUP BY ALL""".replace(
            ", pairs", ",\npairs", 1
        ),
        "fetched",
    ),
)
def _(v):
    shown = matches(v).where("page = 1 AND position <= 20").withColumn(
        "q", keyword.normalise_query(F.col("q"))
    )
    found = results.fetch_results(shown, v.index().units, v.index().assets)

    def score(pairs):
        return pairs.withColumn("relevance", results.word_share(F.col("q"), F.col("text")))

    # What was asked about every other query before is in the cache.
    before = found.where(F.col("query_id") % 2 == 0).select(
        F.lit("words").alias("model"), "q", F.col("snippet.text").alias("text")
    )
    cache = score(before.distinct())
    scores, new = results.rerank_cached(found, cache, "words", score)
    fresh = new.select("q", "text", F.lit(False).alias("_new"))
    return scores.join(fresh, ["q", "text"], "left").select(
        "q",
        "text",
        F.round("relevance", 9).alias("relevance"),
        F.coalesce("_new", F.lit(True)).alias("cached"),
    )


@register(
    "h12_closest_sentence",
    q(
        """SELECT r.query_id, r.asset_id, c.sentence_start, c.sentence_end FROM reranked r
LEFT JOIN closest c ON c.query_id = r.query_id AND c.asset_id = r.asset_id""",
        "reranked",
        "closest",
    ),
)
def _(v):
    return search(v).select("query_id", "asset_id", "sentence_start", "sentence_end")


@register(
    "h13_hybrid_search",
    q(
        """SELECT r.query_id, r.position, r.asset_id, r.filename, r.asset_type, round(r.score, 9) AS score, r.match, round(r.relevance, 9) AS relevance,
  r.snippet_kind, r.snippet_text, r.start_char, r.end_char, c.sentence_start, c.sentence_end, r.has_more
FROM reranked r LEFT JOIN closest c ON c.query_id = r.query_id AND c.asset_id = r.asset_id""",
        "reranked",
        "closest",
    ),
)
def hybrid_search(v):
    return search(v).select(
        "query_id",
        "position",
        "asset_id",
        "filename",
        "asset_type",
        F.round("score", 9).alias("score"),
        "match",
        F.round("relevance", 9).alias("relevance"),
        F.col("snippet.kind").alias("snippet_kind"),
        F.col("snippet.text").alias("snippet_text"),
        F.col("snippet.start_char").alias("start_char"),
        F.col("snippet.end_char").alias("end_char"),
        "sentence_start",
        "sentence_end",
        "has_more",
    )


# --- I: explanation ----------------------------------------------------------------------------


def asked_texts(v: Views) -> DataFrame:
    """Every turn of a conversation with the turn before it as the query."""
    turns = spread(v.table("conversations"))
    before = turns.select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("q")
    )
    return turns.select("conv_id", "turn", "text").join(before, ["conv_id", "turn"])


sql.view(
    "asked_texts",
    rf"""SELECT a.conv_id, a.turn, a.text, b.text AS q, list_transform(list_filter(regexp_extract_all(b.text, '{sql.NOT_SPACE}+'), lambda w: length(w) >= 2),
  lambda w: regexp_replace(w, '([.*+?^${{}}()|\[\]\\])', '\\\1', 'g')) AS words
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1""",
)
sql.view(
    "marked",
    rf"""SELECT *, CASE WHEN len(words) = 0 THEN [text] ELSE
  string_split(regexp_replace(text, '(?i)\b(' || array_to_string(words, '|') || ')', '{tx.CUT}\1{tx.CUT}', 'g'), '{tx.CUT}') END AS pieces FROM asked_texts""",
    "asked_texts",
)


@register(
    "i1_count_matches",
    q("SELECT conv_id, turn, ((len(pieces) - 1) // 2)::INT AS n FROM marked", "marked"),
)
def _(v):
    return asked_texts(v).select(
        "conv_id", "turn", explain.count_matches(F.col("text"), F.col("q")).alias("n")
    )


@register(
    "i2_excerpt_around",
    q(
        """SELECT conv_id, turn, CASE WHEN len(pieces) > 1 THEN (CASE WHEN start > 0 THEN '…' ELSE '' END) || substr(text, start + 1, 160)
  || (CASE WHEN start + 160 < length(text) THEN '…' ELSE '' END) END AS excerpt
FROM (SELECT *, greatest(length(pieces[1]) - 40, 0)::INT AS start FROM marked)""",
        "marked",
    ),
)
def _(v):
    return asked_texts(v).select(
        "conv_id", "turn", explain.excerpt_around(F.col("text"), F.col("q"), 160).alias("excerpt")
    )


@register(
    "i3_highlight_spans",
    q("SELECT conv_id, turn, array_to_string(pieces, '|') AS pieces FROM marked", "marked"),
)
def _(v):
    return asked_texts(v).select(
        "conv_id", "turn", joined(explain.highlight_spans(F.col("text"), F.col("q")), "|").alias("pieces")
    )


def pattern(words: str) -> str:
    return rf"'(?i)\b(' || array_to_string({words}, '|') || ')'"


def count_in(text: str) -> str:
    return f"(CASE WHEN len(words) = 0 THEN 0 ELSE len(regexp_extract_all({text}, {pattern('words')})) END)"


def excerpt_in(text: str, length: int) -> str:
    start = f"greatest(length(regexp_extract({text}, '(?s)\\A(.*?)' || {pattern('words').replace('(?i)', '(?i:')} || ')', 1)) - 40, 0)::INT"
    return f"""CASE WHEN {count_in(text)} > 0 THEN (CASE WHEN {start} > 0 THEN '…' ELSE '' END) || substr({text}, {start} + 1, {length})
  || (CASE WHEN {start} + {length} < length({text}) THEN '…' ELSE '' END) END"""


sql.view(
    "explained",
    rf"""SELECT r.*, c.sentence_start, c.sentence_end,
  list_transform(list_filter(regexp_extract_all(r.q, '{sql.NOT_SPACE}+'), lambda w: length(w) >= 2),
    lambda w: regexp_replace(w, '([.*+?^${{}}()|\[\]\\])', '\\\1', 'g')) AS words,
  CASE WHEN snippet_kind = 'content' AND start_char > 0 THEN '…' ELSE '' END AS opening,
  CASE WHEN snippet_kind = 'content' AND NOT regexp_matches({sql.strip("snippet_text")}, '[.!?]\z') THEN '…' ELSE '' END AS closing
FROM reranked r LEFT JOIN closest c ON c.query_id = r.query_id AND c.asset_id = r.asset_id""",
    "reranked",
    "closest",
)
sql.view(
    "previewed",
    f"""SELECT *, CASE WHEN sentence_start IS NOT NULL THEN (CASE WHEN sentence_start > 0 OR opening <> '' THEN '…' ELSE '' END) || substr(snippet_text, sentence_start + 1) || closing
  WHEN snippet_kind IN ('content', 'visible_text') THEN coalesce({excerpt_in("full_text", 300)}, full_text) ELSE full_text END AS preview
FROM (SELECT *, opening || snippet_text || closing AS full_text FROM explained)""",
    "explained",
)


@register(
    "i4_passage_preview",
    q(
        f"""SELECT query_id, asset_id, preview, (CASE WHEN snippet_kind = 'content' THEN {count_in("full_text")} - {count_in("preview")} ELSE 0 END)::INT AS more_matches FROM previewed""",
        "previewed",
    ),
)
def _(v):
    return explain.passage_preview(search(v)).select(
        "query_id", "asset_id", "preview", "more_matches"
    )


@register(
    "i5_image_text_excerpt",
    q(
        f"""SELECT query_id, asset_id, CASE WHEN asset_type = 'image' AND coalesce(visible_text, '') <> '' AND snippet_kind <> 'visible_text'
  THEN {excerpt_in("visible_text", 160)} END AS image_text FROM explained""",
        "explained",
    ),
)
def _(v):
    return explain.image_text_excerpt(search(v)).select("query_id", "asset_id", "image_text")


# --- J: evaluation -----------------------------------------------------------------------------


def expectations(v: Views) -> DataFrame:
    """Documents that hold a whole benchmark item should be found by it; one of another language
    should not be on top."""
    items = v.table("benchmark").select(F.col("item_id").alias("query_id"), "text")
    docs = v.documents().select(
        "doc_id", F.sha2("text", 256).alias("sha256"), F.col("lang").alias("collection")
    )
    assets = v.assets_text().select("asset_id", "collection", "sha256")
    expected = F.when(F.col("collection") == "en", F.lit("must_hit")).otherwise(F.lit("must_not_top"))
    return (
        evaluate.texts_holding(v.documents(), items)
        .join(docs, "doc_id")
        .join(assets, ["collection", "sha256"])
        .select("query_id", "asset_id", expected.alias("expected"))
        .distinct()
    )


sql.view(
    "expectations",
    """SELECT DISTINCT b.item_id AS query_id, a.asset_id, CASE WHEN d.lang = 'en' THEN 'must_hit' ELSE 'must_not_top' END AS expected
FROM benchmark b JOIN documents d ON contains(d.text, b.text) JOIN assets_text a ON a.collection = d.lang AND a.sha256 = sha256(d.text)""",
    "assets_text",
)


@register(
    "j1_query_matrix",
    q(
        """SELECT query_id, must_hit, hits, best_position, on_top, round(hits / nullif(must_hit, 0), 9) AS recall FROM (
SELECT e.query_id, count(*) FILTER (expected = 'must_hit') AS must_hit, count(*) FILTER (expected = 'must_hit' AND position <= 20) AS hits,
  min(position) FILTER (expected = 'must_hit' AND position <= 20) AS best_position, count(*) FILTER (expected = 'must_not_top' AND position = 1) AS on_top
FROM expectations e LEFT JOIN capped c ON c.query_id = e.query_id AND c.asset_id = e.asset_id GROUP BY e.query_id)""",
        "expectations",
        "capped",
    ),
)
def _(v):
    return evaluate.query_matrix(matches(v), expectations(v)).withColumn(
        "recall", F.round("recall", 9)
    )


@register(
    "j2_search_metrics",
    q(
        """SELECT q.query_id, coalesce(k.n, 0) AS units_keyword, coalesce(s.n, 0) AS units_vector, coalesce(c.n, 0) AS assets,
  coalesce(r.n, 0) AS reranked, coalesce(r.m, 0) AS sentences
FROM queries q LEFT JOIN (SELECT query_id, count(*) AS n FROM keyword_hits GROUP BY 1) k USING (query_id)
LEFT JOIN (SELECT query_id, count(*) AS n FROM vector_hits GROUP BY 1) s USING (query_id)
LEFT JOIN (SELECT query_id, count(*) AS n FROM capped GROUP BY 1) c USING (query_id)
LEFT JOIN (SELECT r.query_id, count(relevance) AS n, count(sentence_start) AS m FROM reranked r
  LEFT JOIN closest c ON c.query_id = r.query_id AND c.asset_id = r.asset_id GROUP BY 1) r USING (query_id)""",
        "queries",
        "keyword_hits",
        "vector_hits",
        "capped",
        "reranked",
        "closest",
    ),
)
def _(v):
    keyword_hits, vector_hits = hits(v)
    ranked = hybrid.rank_assets(v.queries(), keyword_hits, vector_hits)
    return evaluate.search_metrics(v.queries(), keyword_hits, vector_hits, ranked, search(v))


@register(
    "j3_ingest_metrics",
    q(
        """SELECT a.asset_id, a.attempts, coalesce(u.n, 0) AS units, a.size_bytes::BIGINT * 10 AS duration_ms
FROM assets_state a LEFT JOIN (SELECT asset_id, count(*) AS n FROM units GROUP BY 1) u USING (asset_id) WHERE a.status = 'ready'""",
        "assets_state",
        "units",
    ),
)
def _(v):
    finished = F.timestamp_millis(
        F.unix_millis("created_at") + F.col("size_bytes").cast("bigint") * 10
    )
    assets = v.assets_state().withColumn("started_at", F.col("created_at")).withColumn(
        "finished_at", finished
    )
    return evaluate.ingest_metrics(assets, v.index().units)


@register(
    "h14_search_only_ready",
    q(
        """SELECT query_id, asset_id, kind, unit_index, all_words, keyword_score, rank FROM (
  SELECT m.*, u.asset_id, u.kind, u.unit_index,
    (row_number() OVER (PARTITION BY m.query_id ORDER BY m.all_words DESC, m.keyword_score DESC, m.unit_id))::INT AS rank
  FROM keyword_matches m JOIN units u USING (unit_id) JOIN assets a ON a.asset_id = u.asset_id
  WHERE NOT starts_with(a.filename, 'src7-')) WHERE rank <= 100""",
        "keyword_matches",
        "units",
        "assets",
    ),
)
def _(v):
    """A search over the ingested tables: failed assets take none of the 100 places."""
    index = ingested(v).index(v.spark)
    found = keyword.keyword_search(v.queries(), index.postings, stem=False)
    came_from = index.assets.select("asset_id", F.unix_millis("created_at").alias("_origin"))
    return (
        found.join(index.units.select("unit_id", "unit_index"), "unit_id")
        .join(came_from, "asset_id")
        .select(
            "query_id",
            F.col("_origin").alias("asset_id"),
            "kind",
            "unit_index",
            "all_words",
            "keyword_score",
            "rank",
        )
    )
