"""Archives: the round trip, revisits, filters, foreign files and broken ones."""

import base64
import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringStartsWith

from trovelight.llm import warc

PAGES = [
    (1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (7, "http://b/7", "<p>same</p>"), (3, "http://a/3", ""), (4, None, None),
    (5, "http://c/\r\nX: y", "é" * 70_000), (6, "http://a/6", "text\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"), (None, "http://n", "null id"), (8, "http://a/8", "x\x00y"),
]


@pytest.fixture(scope="module")
def session(spark):
    return warc.registered(spark)


@pytest.fixture(scope="module")
def pages(session):
    return session.createDataFrame(PAGES, "page_id long, url string, html string")


def sha(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_round_trip(session, pages, tmp_path, compression):
    path = f"{tmp_path}/archive"
    warc.as_records(pages).repartition(3).write.format("warc").mode("append").option("compression", compression).option("filebytes", 400).save(path)
    rows = {r.record_id: r for r in session.read.format("warc").load(path).collect()}
    assert len(rows) == len(PAGES)
    html = {i: (h or "").encode() for i, _, h in PAGES}
    for page_id, body in html.items():
        r = rows[None if page_id is None else f"urn:page:{page_id}"]
        same = [i for i, b in html.items() if b == body]
        first = max((i for i in same if i is not None), default=None)
        assert (r.payload_length, r.payload_digest) == (len(body), "sha1:" + sha(body))
        if page_id == first:
            assert (r.record_type, r.refers_to, bytes(r.payload)) == ("response", None, body)
        else:
            assert (r.record_type, r.refers_to, r.payload) == ("revisit", f"urn:page:{first}", None)
    assert rows["urn:page:5"].target_uri == "http://c/%0D%0AX: y"
    assert rows["urn:page:4"].target_uri is None


def test_small_payloads_are_responses(pages):
    types = {r.record_id: r.record_type for r in warc.as_records(pages, least=12).collect()}
    assert set(types.values()) == {"response"}


def test_spread_and_broadcast_agree(session):
    docs = session.range(900).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("html"))
    rows = warc.as_records(docs).collect()
    assert sum(r.record_type == "revisit" for r in rows) == 299
    assert {r.refers_to for r in rows} == {None, "urn:page:897"}


def test_filters_are_tested_before_payloads(session, pages, tmp_path):
    path = f"{tmp_path}/archive"
    warc.as_records(pages).write.format("warc").mode("append").save(path)
    reader = warc.Reader({"path": path})
    rest = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), StringStartsWith(("target_uri",), "http://a"), GreaterThan(("payload_length",), 3), In(("record_id",), ("urn:page:1", "urn:page:3"))]))
    assert rest == [GreaterThan(("payload_length",), 3)]
    rows = [r for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()]
    assert sorted(r["record_id"] for r in rows) == ["urn:page:1", "urn:page:3"]
    df = session.read.format("warc").load(path).where("record_type = 'response' and target_uri like 'http://a%'")
    assert sorted(r.record_id for r in df.collect()) == ["urn:page:6", "urn:page:8"]
    bare = session.read.format("warc").option("payloads", "false").load(path)
    assert bare.where("payload is not null").count() == 0
    assert bare.count() == len(PAGES)


def test_only_listed_files_are_read(session, pages, tmp_path):
    path = f"{tmp_path}/archive"
    warc.as_records(pages).coalesce(1).write.format("warc").mode("append").save(path)
    with open(f"{path}/part-of-a-lost-attempt.warc", "wb") as file:
        file.write(b"WARC/1.1\r\nWARC-Ty")
    assert session.read.format("warc").load(path).count() == len(PAGES)
    [manifest] = (tmp_path / "archive").glob("_manifest-*.json")
    assert len(json.loads(manifest.read_text())["files"]) == 1


def test_foreign_archives_and_partitions(tmp_path):
    body = b"WARC/1.0\r\nWARC-Type: metadata\r\nContent-Length: 2\r\n\r\nok\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(body * 3)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(body) * 2)
    (tmp_path / "c.txt").write_bytes(b"no archive")
    reader = warc.Reader({"path": str(tmp_path)})
    assert [p.paths for p in reader.partitions()] == [("a.warc", "b.warc.gz")]
    assert [p.paths for p in warc.Reader({"path": str(tmp_path), "filebytes": "10"}).partitions()] == [("a.warc",), ("b.warc.gz",)]
    rows = [r for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()]
    assert [(r["record_type"], r["payload"], r["payload_length"]) for r in rows] == [("metadata", b"ok", 2)] * 5


@pytest.mark.parametrize(
    ("data", "message"),
    [
        (b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 9\r\n\r\nshort", "cut short"),
        (b"junk\r\n\r\n", "no record starts"),
        (b"WARC/1.1\r\nContent-Length: 0", "no end of its headers"),
        (b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha1:AAAA\r\nContent-Length: 1\r\n\r\nx\r\n\r\n", "another digest"),
    ],
)
def test_broken_archives_are_errors(tmp_path, data, message):
    (tmp_path / "a.warc").write_bytes(data)
    reader = warc.Reader({"path": str(tmp_path)})
    with pytest.raises(ValueError, match=message):
        [list(reader.read(part)) for part in reader.partitions()]


def test_empty_table(session, pages, tmp_path):
    path = f"{tmp_path}/archive"
    warc.as_records(pages.limit(0)).write.format("warc").mode("append").save(path)
    assert session.read.format("warc").load(path).count() == 0


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_appends_add_up_and_overwriting_replaces(session, tmp_path, compression):
    path = f"{tmp_path}/archive"

    def save(ids, mode):
        rows = session.createDataFrame([(n, f"http://{n}", f"page {n}") for n in ids], "page_id long, url string, html string")
        warc.as_records(rows).write.format("warc").mode(mode).option("compression", compression).save(path)

    def held():
        return sorted(r.record_id for r in session.read.format("warc").load(path).collect())

    save([1, 2], "append")
    save([3], "append")
    assert held() == ["urn:page:1", "urn:page:2", "urn:page:3"]
    save([4, 5], "overwrite")
    assert held() == ["urn:page:4", "urn:page:5"]
    left = [f.name for f in (tmp_path / "archive").iterdir() if ".warc" in f.name or f.name.startswith("_manifest")]
    assert sum(name.startswith("_manifest") for name in left) == 1 and len(left) <= 3
    save([6], "append")
    assert held() == ["urn:page:4", "urn:page:5", "urn:page:6"]


def http_record(entity, payload_digest, kind="response", block_digest=None, head=b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"):
    block = head + entity
    lines = ["WARC/1.1", f"WARC-Type: {kind}", "WARC-Date: 2020-02-02T00:00:00Z", f"WARC-Payload-Digest: {payload_digest}"]
    lines += [f"WARC-Block-Digest: {block_digest}"] * (block_digest is not None)
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def test_http_messages_are_split_from_their_head(session, tmp_path):
    entity = b"<p>" + b"x" * 5000 + b"\r\n\r\n</p>"
    right = "sha1:" + sha(entity)
    (tmp_path / "a.warc").write_bytes(http_record(entity, right) + http_record(b"", "sha1:" + sha(b"")))
    # A request's payload digest says nothing of its block.
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(http_record(entity, right)) + gzip.compress(http_record(b"q", "sha1:none", "request")))
    rows = session.read.format("warc").load(str(tmp_path)).orderBy("payload_length").collect()
    responses = [r for r in rows if r.record_type == "response"]
    assert [(r.payload_length, bytes(r.payload)) for r in responses] == [(0, b""), (len(entity), entity), (len(entity), entity)]
    assert {r.date for r in rows} == {"2020-02-02T00:00:00Z"}
    [request] = [r for r in rows if r.record_type == "request"]
    assert bytes(request.payload).endswith(b"\r\n\r\nq")
    lengths = session.read.format("warc").option("payloads", "false").load(str(tmp_path)).where("record_type = 'response'").select("payload_length")
    assert sorted(r[0] for r in lengths.collect()) == [0, len(entity), len(entity)]


@pytest.mark.parametrize("wrong", ["payload", "block"])
def test_wrong_digests_of_http_messages_are_told(session, tmp_path, wrong):
    digest = "sha1:" + sha(b"entity")
    other = "sha1:" + sha(b"something else")
    record = http_record(b"entity", other) if wrong == "payload" else http_record(b"entity", digest, block_digest=other)
    (tmp_path / "a.warc").write_bytes(record)
    reader = warc.Reader({"path": str(tmp_path)})
    with pytest.raises(ValueError, match="another digest"):
        list(reader.read(reader.partitions()[0]))
    assert session.read.format("warc").option("verify", "false").load(str(tmp_path)).first().payload == b"entity"


def test_unwanted_members_are_not_decompressed(session, tmp_path):
    random = __import__("numpy").random.default_rng(1)
    noise = [base64.b64encode(random.bytes(300_000)).decode() for _ in range(20)]
    rows = session.createDataFrame([(n, f"http://{n}", text) for n, text in enumerate(noise)], "page_id long, url string, html string").coalesce(1)
    path = f"{tmp_path}/archive"
    warc.as_records(rows).coalesce(1).write.format("warc").mode("append").option("compression", "gzip").save(path)

    def decompressed(**filters):
        reader = warc.Reader({"path": path})
        list(reader.pushFilters([EqualTo((name,), value) for name, value in filters.items()]))
        found = sum(batch.num_rows for part in reader.partitions() for batch in reader.read(part))
        return found, reader.decompressed

    every, one = decompressed(), decompressed(target_uri="http://7")
    assert every[0] == 20 and one[0] == 1
    assert every[1] > 20 * 400_000 and one[1] < every[1] / 10
    # Any reader of gzip files reads them.
    [file] = (tmp_path / "archive").glob("*.gz")
    assert gzip.decompress(file.read_bytes()).count(b"WARC/1.1\r\n") == 20
