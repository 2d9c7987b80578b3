"""Importance resampling: the interned runs against plain counting, and the draw against sorting."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from trovelight.llm import resampling

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))


def buckets(text, count=10_000):
    found = words(text)
    return Counter(zlib.crc32(b" ".join(found[i : i + n])) % count for n in (1, 2, 3) for i in range(len(found) - n + 1))


@pytest.fixture(scope="module")
def texts():
    random = np.random.default_rng(8)
    made = ["".join(random.choice(list("abABé1 -_zß日"), int(random.integers(0, 600)))) for _ in range(40)]
    made += ["", None, " .,-", "one", "One two", "x" * 5000 + " y " + "z" * 127 + " " + "z" * 128 + " q " + "z" * 129 + " a b", "a " * 3000, "the cat " * 40]
    return made


@pytest.mark.parametrize("block", [7, 1 << 15])
def test_runs_as_plain_counting(texts, monkeypatch, block):
    monkeypatch.setattr(resampling, "BLOCK", block)
    tight = resampling.Tight([(t or "").encode() for t in texts])
    each, total = [Counter() for _ in texts], Counter()
    for made in resampling._blocks(tight, 10_000):
        for text, slot in zip(made.text.tolist(), made.slot.tolist(), strict=True):
            each[text][int(made.bucket[slot])] += 1
        for slot in made.used.tolist():
            total[int(made.bucket[slot])] += int(made.count[slot])
    expected = [buckets(t) for t in texts]
    assert each == expected and total == sum(expected, Counter())


def test_hashes_and_digests_of_slices():
    random = np.random.default_rng(0)
    tight = resampling.Tight([random.integers(97, 123, 4000).astype(np.uint8).tobytes() + b" ab ab ab"])
    starts, lengths = random.integers(0, 3500, 2000), random.integers(1, 300, 2000)
    slices = [tight.bytes_at(s, n) for s, n in zip(starts, lengths, strict=True)]
    assert tight.xxhash64(starts, lengths).tolist() == [xxhash.xxh64_intdigest(s) for s in slices]
    assert tight.crc32(starts, lengths).tolist() == [zlib.crc32(s) for s in slices]
    other = random.permutation(starts)
    expected = [tight.bytes_at(a, n) == tight.bytes_at(b, n) for a, b, n in zip(starts, other, lengths, strict=True)]
    assert tight.same_bytes(starts, other, lengths).tolist() == expected


def test_equal_keys_of_different_runs_are_told_apart(monkeypatch):
    # With one key for everything only the bytes tell runs apart.
    monkeypatch.setattr(resampling.Tight, "xxhash64", lambda self, starts, lengths: np.zeros(len(starts), np.uint64))
    tight = resampling.Tight([b"a b a c a b", b"b a"])
    [made] = resampling._blocks(tight, 10_000)
    assert len(made.used) == len({*words("a b a c"), b"a b", b"b a", b"a c", b"c a", b"a b a", b"b a c", b"a c a", b"c a b"})
    assert made.count[made.used].sum() == 6 + 5 + 4 + 2 + 1


def expected_draw(docs, target, percent=5, least=20):
    s, t = sum((buckets(x) for _, x in docs), Counter()), sum((buckets(x) for x in target), Counter())
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in range(10_000)]
    made = {}
    for doc, text in docs:
        found = buckets(text)
        h = int(hashlib.sha256(f"42:{doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * n for b, n in found.items())
        made[doc] = [sum(found.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    able = sorted((d for d, x in docs if len(words(x)) >= least), key=lambda d: (-made[d][2], d))
    for place, doc in enumerate(able[: percent * len(able) // 100], 1):
        made[doc][3] = place
    return {doc: tuple(values) for doc, values in made.items()}


def test_the_draw_as_sorting(spark, texts):
    random = np.random.default_rng(5)
    vocabulary = [f"w{n}" for n in range(300)]
    docs = [(n, " ".join(random.choice(vocabulary[: 20 + n], int(random.integers(5, 120))))) for n in range(240)]
    docs += [(1000 + n, t) for n, t in enumerate(texts)]
    target = [" ".join(random.choice(vocabulary[:40], 200)) for _ in range(5)] + [None]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(6).withColumn("score", F.lit(1)).withColumn("id", F.lit(2))
    aimed = spark.createDataFrame([(t,) for t in target], "text string")
    for percent in (5, 37, 100, 0):
        rows = resampling.drawn(table, aimed, percent=percent).collect()
        found = {r.row.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in rows}
        assert found == expected_draw(docs, target, percent)
    kept = resampling.resampled(table, aimed)
    assert kept.columns == table.columns and kept.count() == 5 * sum(len(words(t)) >= 20 for _, t in docs) // 100


def test_repeated_rows_null_ids_and_empty_tables(spark):
    text = " ".join(f"w{n}" for n in range(30))
    docs = spark.createDataFrame([(1, text)] * 40 + [(None, text)] * 20 + [(2, None)], "doc_id long, text string")
    target = spark.createDataFrame([("w1 w2",)], "text string")
    rows = resampling.drawn(docs, target, percent=50).collect()
    assert sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, 31))
    assert len({r.weight for r in rows if r.row.doc_id != 2}) == 1
    [nothing] = [r for r in rows if r.row.doc_id == 2]
    assert (nothing.n_features, nothing.weight, nothing["rank"]) == (0, 0, None)
    empty = docs.limit(0)
    assert resampling.drawn(empty, target).count() == 0
    assert resampling.drawn(docs, target.limit(0)).count() == 61
