"""Packing: pieces against the tokenizers library, bins against their rules and the least number possible."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trovelight.llm import packing

JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(JSON)
    tokenizer.encode_special_tokens = True
    return tokenizer


def check_bins(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_pieces_and_bins(spark, library):
    texts = ["", None, "short", "word " * 3000, " " * 5000, "é😀" * 4000, "<|endoftext|>", "short", "x" * 20_000, "a b" * 1365]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, piece int")
    rows = packing.packed_documents(docs, JSON).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert sorted(by_doc) == list(range(len(texts)))
    for doc_id, pieces in by_doc.items():
        ids = [*library.encode(texts[doc_id] or "", add_special_tokens=False).ids, 0]
        pieces.sort(key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert all(r.length == 2048 for r in pieces[1:])
        assert len(pieces) == -(-len(ids) // 2048)
        for r in pieces:
            part = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(part)
        assert sum(r.length for r in pieces) == len(ids)
    check_bins(rows, 2048)


def test_best_fit():
    bins, places, fills = packing.best_fit([5, 7, 5, 3, 2, 8], 10)
    assert sorted(fills, reverse=True) == [10, 10, 10]
    assert packing.best_fit([], 10) == ([], [], [])
    assert len(packing.best_fit([6] * 9, 10)[2]) == 9


@pytest.mark.parametrize("partitions", [1, 16])
@pytest.mark.parametrize("bins_per_task", [3, 100_000])
def test_the_tree_comes_near_the_least_number(spark, partitions, bins_per_task):
    random = np.random.default_rng(partitions)
    lengths = [int(x) for x in np.minimum(random.lognormal(6, 1, 4000).astype(int) + 1, 2048)]
    items = spark.createDataFrame([(i, n, 0) for i, n in enumerate(lengths)], "id long, length long, bin long").repartition(partitions)
    rows = packing.pack(items, bins_per_task=bins_per_task).select("row.*", "sequence_id", "offset", "fill").collect()
    assert sorted((r.id, r.length) for r in rows) == list(enumerate(lengths))
    count = check_bins(rows, 2048)
    fill = {}
    for r in rows:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert all(fill[r.sequence_id] == r.fill for r in rows)
    assert count <= -(-sum(lengths) // 2048) * (1.02 if bins_per_task > 3 else 1.1)


def test_items_that_cannot_share(spark):
    items = spark.range(500).select("id", F.lit(1100).alias("length")).repartition(8)
    rows = packing.pack(items, bins_per_task=50).collect()
    assert len({r.sequence_id for r in rows}) == 500


def test_wrong_lengths_and_empty_tables(spark):
    with pytest.raises(Exception, match="bins hold"):
        packing.pack(spark.range(1).select("id", F.lit(9).alias("length")), capacity=8).collect()
    assert packing.pack(spark.range(0).select("id", F.lit(9).alias("length"))).count() == 0
    assert packing.packed_documents(spark.createDataFrame([], "doc_id long, text string"), JSON).count() == 0


def test_sequences_hold_the_documents(spark, library):
    docs = spark.createDataFrame([(i, f"text number {i} " * (i % 40)) for i in range(300)], "doc_id long, text string")
    pieces = packing.token_pieces(docs, JSON, ["doc_id"]).select("row.doc_id", "piece", "ids")
    packed = packing.packed_documents(docs, JSON)
    whole = {r.sequence_id: np.frombuffer(bytes(r.ids), "<u4") for r in packing.sequences(pieces, packed, ["doc_id", "piece"]).collect()}
    for r in packed.collect():
        ids = whole[r.sequence_id][r.offset : r.offset + r.length]
        assert ids[-1] == 0
        assert library.decode(ids[:-1].tolist()) == f"text number {r.doc_id} " * (r.doc_id % 40)


def test_the_query_and_the_pipeline_read_added_tokens_as_the_unmodified_library(spark, tmp_path):
    import corpus_pipeline
    from trovelight.llm import queries

    unmodified = Tokenizer.from_file(JSON)
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext| >", "é<|endoftext|>" * 3000, "plain", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    expected = {}
    for doc_id, text in enumerate(texts):
        ids = [*unmodified.encode(text or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        for start, end in zip(cuts, cuts[1:]):
            expected[doc_id, start] = (end - start, zlib.crc32(np.array(ids[start:end], "<u4").tobytes()))
    for found in (queries.op1_best_fit_packing(spark, str(tmp_path)), corpus_pipeline.best_fit_packing(spark, docs, str(tmp_path))):
        assert {(r.doc_id, r.start): (r.length, r.ids_crc32) for r in found.collect()} == expected


def test_one_task_sees_all_that_is_left_in_the_end(spark):
    # Every partition has one short item that fits none of its own bins.
    lengths = [700 if n % 10 == 0 else 1300 + n % 40 for n in range(2000)]
    items = spark.createDataFrame([(n, length) for n, length in enumerate(lengths)], "id int, length int").repartitionByRange(200, "id")
    made = {}
    for bins_per_task in (100_000, 100):
        packed = packing.pack(items, bins_per_task=bins_per_task)
        made[bins_per_task] = packed.select("sequence_id").distinct().count()
        assert packed.count() == len(lengths)
    assert made[100] <= made[100_000] + 2
