"""Encoding against the tiktoken library, and the round trip."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from trovelight.llm import bpe, queries
from trovelight.llm.tokens import ranks_of_json, ranks_of_lines

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [
    "", None, " ", "a", "\n\n  x", "don't we'll", "é😀 ñandú 北京市", "x" * 5000, "ab" * 3000, " " * 3000, "0123456789" * 50,
    "aaaabaaaabaaaab" * 40, "<|endoftext|> text", "Tab\tand\r\nline", "\x00\x01\x02", "ẞß" * 200,
]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks_of_lines(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(ranks_of_lines(RANKS))


def test_both_files_hold_the_same_vocabulary():
    assert ranks_of_json(public_tokenizers.path("byte_bpe_50k.json")) == ranks_of_lines(RANKS)


def test_pieces_of_every_length_as_the_library(vocabulary, library):
    random = np.random.default_rng(3)
    alphabet = np.array(list("abcdehinorst é-1"))
    pieces = ["".join(random.choice(alphabet, n)) for n in [*range(1, 140), 500, 4097]]
    expected = [tuple(library._core_bpe.encode_single_piece(p.encode())) for p in pieces]
    assert vocabulary.encode([p.encode() for p in pieces]) == expected


def test_one_long_tree_and_many_short_ones_agree(vocabulary):
    random = np.random.default_rng(4)
    pieces = [random.integers(97, 103, n).astype(np.uint8).tobytes() for n in range(2, 65)]
    assert [vocabulary.alone(p) for p in pieces] == [vocabulary.together([p], 1 << (len(p) - 1).bit_length())[0] for p in pieces]


def test_texts_and_round_trip(spark, library):
    docs = spark.createDataFrame(list(enumerate(ODD)), "ids long, text string")
    rows = bpe.encoded(docs, RANKS, public_tokenizers.PATTERN, ["ids"]).select("row.ids", F.col("ids").alias("found"), "decoded").toDF("n", "found", "decoded").collect()
    assert len(rows) == len(ODD)
    for row in rows:
        text = ODD[row.n] or ""
        assert row.found == library.encode_ordinary(text)
        assert bytes(row.decoded) == text.encode()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encoded(docs, RANKS, public_tokenizers.PATTERN, ["doc_id"]).count() == 0


def test_the_query_on_whole_tables(spark, documents, library):
    rows = {r.doc_id: r for r in queries.op10_bpe(spark, "/root/testdata/sf0.001").collect()}
    for doc in documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect():
        ids = library.encode_ordinary(doc.text)
        row = rows[doc.doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(doc.text.encode()).hexdigest()
