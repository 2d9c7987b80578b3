"""Intake, blobs and metadata."""

import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from trovelight import fixed_values as fixed
from trovelight.operators import intake, metadata
from trovelight.sources import blobs, files

PNG = b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR"
WEBP_X = b"RIFF\x00\x00\x00\x00WEBPVP8X\x0a\x00\x00\x00\x00\x00\x00\x00"


@pytest.mark.parametrize(
    ("content", "asset_type", "mime"),
    [
        (b"\xff\xd8\xff\xe0\x00\x10JFIF", "image", "image/jpeg"),
        (PNG + struct.pack(">II", 4, 4), "image", "image/png"),
        (WEBP_X + b"\x03\x00\x00\x03\x00\x00", "image", "image/webp"),
        ("Grüße, ein Text.\n".encode(), "text", "text/plain"),
        (b"\xef\xbb\xbfwith a mark", "text", "text/plain"),
        (b"\xef\xbb\xbf", "text", "text/plain"),
        (b"BMW is a car", "text", "text/plain"),
    ],
)
def test_accepted(spark, content, asset_type, mime):
    row = intake.sniff(spark.createDataFrame([(bytearray(content),)], "content binary")).first()
    assert (row.asset_type, row.mime, row.reject_reason) == (asset_type, mime, None)


@pytest.mark.parametrize(
    ("content", "reason"),
    [
        (b"", fixed.EMPTY_FILE),
        (bytes(range(256)), fixed.UNSUPPORTED_FILE),
        ("Grüße".encode("latin-1"), fixed.UNSUPPORTED_FILE),
        (b"text \x00 text", fixed.UNSUPPORTED_FILE),
        (b"GIF89a\x04\x00\x04\x00", fixed.UNSUPPORTED_FILE),
        (b"P3\n4 4\n255\n0 0 0", fixed.UNSUPPORTED_FILE),
        (PNG + struct.pack(">II", 30000, 30000), fixed.UNSUPPORTED_FILE),
        (WEBP_X + b"\xff\xff\x00\xff\xff\x00", fixed.UNSUPPORTED_FILE),
    ],
)
def test_refused(spark, content, reason):
    row = intake.sniff(spark.createDataFrame([(bytearray(content),)], "content binary")).first()
    assert (row.asset_type, row.mime, row.reject_reason) == (None, None, reason)


def test_size_limit_is_inclusive_and_comes_first(spark):
    df = spark.createDataFrame([(bytearray(n),) for n in (10, 11)], "content binary")
    checked = intake.sniff(intake.check_size(df, 10))
    accepted, rejected = intake.split_rejects(checked)
    assert accepted.count() == 0
    reasons = {row.size_bytes: row.reason for row in rejected.collect()}
    assert reasons == {10: fixed.UNSUPPORTED_FILE, 11: "File is larger than the 0 MB limit."}


UPLOADS = "upload_id long, arrival long, collection string, filename string, sha256 string"


def test_first_upload_wins_and_others_become_aliases(spark):
    uploads = spark.createDataFrame(
        [
            (1, 5, "a", "late.txt", "h"),
            (2, 1, "a", "first.txt", "h"),
            (3, 2, "a", "second.txt", "h"),
            (4, 3, "a", "first.txt", "h"),
            (5, 4, "a", "second.txt", "h"),
            (6, 1, "b", "first.txt", "h"),
        ],
        UPLOADS,
    )
    assets = intake.dedup_assets(uploads)
    assert {(r.asset_id, r.collection, r.filename) for r in assets.collect()} == {
        (2, "a", "first.txt"),
        (6, "b", "first.txt"),
    }
    aliases = intake.collect_aliases(uploads, assets, rows_per_part=2).orderBy("first_arrival").collect()
    assert [(r.asset_id, r.alias, r.first_arrival) for r in aliases] == [
        (2, "second.txt", 2),
        (2, "late.txt", 5),
    ]


def test_incremental_uploads_do_not_touch_stored_assets(spark):
    stored = spark.createDataFrame(
        [(7, "a", "h", "own.txt", "failed")],
        "asset_id long, collection string, sha256 string, filename string, status string",
    )
    aliases = spark.createDataFrame(
        [("a", "h", "known.txt")], "collection string, sha256 string, alias string"
    )
    uploads = spark.createDataFrame(
        [
            (10, 1, "a", "own.txt", "h"),
            (11, 2, "a", "known.txt", "h"),
            (12, 3, "a", "new.txt", "h"),
            (13, 4, "a", "other.txt", "k"),
            (14, 5, "a", "copy.txt", "k"),
        ],
        UPLOADS,
    )
    inserts, names = intake.dedup_incremental(uploads, stored, aliases)
    assert [(r.asset_id, r.filename) for r in inserts.collect()] == [(13, "other.txt")]
    assert {(r.asset_id, r.alias) for r in names.collect()} == {(7, "new.txt"), (13, "copy.txt")}


def test_blobs_are_stored_once(spark, tmp_path):
    store = str(tmp_path / "blobs")
    rows = spark.createDataFrame(
        [(bytearray(b"one"),), (bytearray(b"two"),), (bytearray(b"one"),)], "content binary"
    )
    hashed = intake.content_hash(rows)
    blobs.put_blobs(hashed, store)
    blobs.put_blobs(hashed, store)
    assert blobs.read_blobs(spark, store).count() == 2
    keys = hashed.select("sha256").distinct().union(spark.sql("SELECT 'none'"))
    found = blobs.get_blobs(keys, store).collect()
    assert sorted((r.missing, bytes(r.content or b"")) for r in found) == [
        (False, b"one"),
        (False, b"two"),
        (True, b""),
    ]


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "demo").mkdir()
    (tmp_path / "demo" / "a.txt").write_bytes(b"hello")
    (tmp_path / "b.txt").write_bytes(b"hi")
    (tmp_path / "empty.txt").write_bytes(b"")
    rows = {r.filename: r for r in files.read_files(spark, str(tmp_path)).collect()}
    assert bytes(rows["a.txt"].content) == b"hello"
    assert rows["b.txt"].size_bytes == 2
    # Spark's file sources leave empty files out.
    assert "empty.txt" not in rows


def test_query_parameters(spark):
    schema = (
        "q string, collection string, page int, `order` string, match_kinds array<string>, "
        "asset_types array<string>, unit_kinds array<string>"
    )
    good = ("door", "demo", 1, "tiered", None, ["text"], ["content"])
    bad = [
        ("   ", *good[1:]),
        ("x" * 501, *good[1:]),
        ("door", "Demo!", *good[2:]),
        ("door", "demo", 0, *good[3:]),
        ("door", "demo", 1, "newest", *good[4:]),
        ("door", "demo", 1, "tiered", ["near"], None, None),
        ("door", "demo", 1, "tiered", None, ["video"], None),
        ("door", "demo", 1, "tiered", None, None, ["body"]),
    ]
    rows = intake.check_query_params(spark.createDataFrame([good, *bad], schema)).collect()
    assert [r.reject_reason is None for r in rows] == [True] + [False] * len(bad)
    assert rows[1].reject_reason == fixed.BLANK_QUERY


META = (
    "asset_id int, asset_type string, title string, description string, tags array<string>, "
    "visible_text string, image_type string"
)


def clean(spark, asset_type="image", tags=(), image_type=None, **fields):
    row = (
        1, asset_type, fields.get("title", "t"), fields.get("description", "d"), list(tags),
        fields.get("visible_text", ""), image_type,
    )
    raw = spark.createDataFrame([row], META)
    return metadata.normalise_metadata(raw).first(), metadata.metadata_trim_report(raw).first()


def test_tags_are_tidied_and_kept_in_order(spark):
    found, report = clean(
        spark, "text", ["  Door ", "GATE", "door", "Old \t Wall", "", " ", "x" * 51, "Document"]
    )
    assert found.tags == ["door", "gate", "old wall", "document", "text", "text file"]
    assert (report.truncated, report.tags_dropped) == ([], 4)


def test_tag_cap_comes_before_fixed_tags(spark):
    found, _ = clean(spark, "image", [f"tag{n}" for n in range(30)], "diagram")
    assert found.tags == [f"tag{n}" for n in range(20)] + ["image", "picture", "diagram", "drawing"]


@pytest.mark.parametrize("image_type", fixed.IMAGE_TYPES)
def test_fixed_tags_of_images(spark, image_type):
    found, report = clean(spark, "image", [], image_type)
    assert (found.tags, found.image_type) == (fixed.IMAGE_TYPE_TAGS[image_type], image_type)
    assert report is None


def test_image_types(spark):
    assert clean(spark, "image")[0].image_type == "other"
    assert clean(spark, "text", image_type="photo")[0].image_type is None


def test_long_fields_are_cut(spark):
    found, report = clean(
        spark, title="  " + "t" * 200, description="d" * 2000, visible_text="\n" + "v" * 20_000
    )
    assert (len(found.title), len(found.description), len(found.visible_text)) == (120, 1000, 10_000)
    assert report.truncated == ["title", "description", "visible_text"]


def test_filename_body(spark):
    names = ["notes-rome.txt", "IMG_2101.jpg", "crème brûlée.txt"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    bodies = [r[0] for r in df.select(metadata.filename_body(F.col("n"))).collect()]
    assert bodies == [
        "notes-rome.txt notes rome txt",
        "IMG_2101.jpg IMG 2101 jpg",
        "crème brûlée.txt crème brûlée txt",
    ]


def test_photo_details(spark):
    schema = (
        "taken string, latitude_parts array<double>, latitude_half string, "
        "longitude_parts array<double>, longitude_half string"
    )
    rows = spark.createDataFrame(
        [
            ("2026:08:11 14:32:05", [38.0, 30.0, 36.0], "S", [9.0, 15.0, 0.0], "W"),
            (" 2026:08:11 14:32:05 ", [38.0, 30.0, 36.0], "N", [9.0, 15.0, 0.0], None),
            (None, None, None, None, None),
            ("yesterday", [38.0, 30.0, 36.0], "N", [9.0, 15.0, 0.0], "E"),
            ("2026:08:11 14:32:05", [38.0, 30.0], "N", [9.0, 15.0, 0.0], "E"),
            ("2026:08:11 14:32:05", [38.0, None, 1.0], "N", [9.0, 15.0, 0.0], "E"),
            ("2026:08:11 14:32:05", [38.0], None, [], None),
        ],
        schema,
    )
    found = [(r.taken_at, r.latitude, r.longitude) for r in metadata.photo_details(rows).collect()]
    assert found == [
        ("2026-08-11 14:32", -38.51, -9.25),
        ("2026-08-11 14:32", None, None),
        (None, None, None),
        (None, None, None),
        (None, None, None),
        (None, None, None),
        ("2026-08-11 14:32", None, None),
    ]


def test_large_files_are_hashed_without_being_one_value(spark, tmp_path, monkeypatch):
    from checks.registered import QUERIES
    from checks.views import Views

    contents = {"a.parquet": b"x" * 8, "b c%20.parquet": bytes(range(256)) * 5, "d.parquet": b"y" * 9}
    (tmp_path / "in").mkdir()
    for name, content in contents.items():
        (tmp_path / "in" / name).write_bytes(content)
    expected = sorted((name, len(content), hashlib.sha256(content).hexdigest()) for name, content in contents.items())
    monkeypatch.setattr(files, "LARGE", 8)
    monkeypatch.setattr(files, "PIECE", 7)
    limit = "spark.sql.sources.binaryFile.maxLength"
    before = spark.conf.get(limit)
    # As Java's largest array limits a real file.
    spark.conf.set(limit, "8")
    try:
        for name in ("a1_read_folder", "a2_read_files_stream"):
            assert sorted(map(tuple, QUERIES[name](Views(spark, str(tmp_path / "in"))).collect())) == expected
        with pytest.raises(Exception, match="max length"):
            files.read_files(spark, str(tmp_path / "in"), digest=True).select("content").collect()
    finally:
        spark.conf.set(limit, before)
    whole = files.read_files(spark, str(tmp_path / "in"), digest=True).collect()
    assert {r.filename: bytes(r.content) for r in whole} == contents
