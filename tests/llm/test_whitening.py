"""Whitening against plain double-precision algebra, and the refinement on hard spectra."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trovelight.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>"


def plain(vectors):
    x = np.floor(64.0 * np.asarray(vectors, np.float64)) + 1_000_000
    centred = x - x.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred / len(x))
    order = np.argsort(-values)
    return x, centred, values[order], axes[:, order]


@pytest.mark.parametrize(
    "values",
    [np.linspace(1, 2, 40), np.r_[np.ones(20), 1 + 1e-9 * np.arange(10), 5], np.r_[np.zeros(15), 1 + 1e-5 * np.arange(20)], [3.0], 1e6 * np.r_[1, 1, 1, 2, 2 + 1e-12], np.geomspace(1e-6, 1, 30), np.zeros(4)],
)
def test_eigenvectors_to_double_precision(values):
    values = np.asarray(values, float)
    turn, _ = np.linalg.qr(np.random.default_rng(len(values)).standard_normal((len(values), len(values))))
    matrix = (turn * values) @ turn.T
    matrix = (matrix + matrix.T) / 2
    found, axes = whitening.eigen(matrix)
    size = max(np.abs(values).max(), 1e-300)
    assert np.abs(found - np.sort(values)[::-1]).max() < 1e-13 * size
    assert np.abs(axes.T @ axes - np.eye(len(values))).max() < 1e-12
    assert np.abs(matrix @ axes - axes * found).max() < 1e-12 * size


def test_as_plain_algebra(spark):
    random = np.random.default_rng(2)
    vectors = (random.standard_normal((400, 12)) @ random.standard_normal((12, 12))).astype(np.float32)
    rows = [(n, row.tolist()) for n, row in enumerate(vectors)]
    rows += [(900, None), (901, [1.0] * 11 + [math.nan]), (902, [1.0] * 11 + [math.inf]), (903, []), (904, [1.0] * 11 + [None]), (5, vectors[5].tolist())]
    table = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("whitened", F.lit(1)).withColumn("deviation", F.lit(2))
    x, centred, values, axes = plain(np.concatenate([vectors, vectors[5:6]]))
    model = whitening.fitted(table, components=5)
    assert model.n == 401 and list(model.sums) == x.sum(axis=0).astype(int).tolist()
    assert np.allclose(model.values, values[:5], rtol=1e-12)
    assert np.allclose(model.explained, values[:5] / values.sum(), rtol=1e-12)
    assert whitening.identity_error(table, model) < 1e-9
    found = whitening.whitened(table, model).collect()
    assert len(found) == 401
    for r in found:
        exact = 401 * x[r.row.vec_id].astype(object) - np.array(model.sums, object)
        assert int(r.deviation) == int((exact * exact).sum())
        expected = centred[r.row.vec_id] @ axes[:, :5] / np.sqrt(values[:5])
        assert np.allclose(np.abs(r.whitened), np.abs(expected), rtol=1e-9, atol=1e-9)
        assert r.row.whitened == 1 and r.row.deviation == 2


def test_the_result_does_not_depend_on_partitions(spark):
    random = np.random.default_rng(4)
    table = spark.createDataFrame([(n, row.tolist()) for n, row in enumerate(random.standard_normal((200, 6)))], SCHEMA)
    one, other = whitening.fitted(table.coalesce(1)), whitening.fitted(table.repartition(7))
    assert one.sums == other.sums and (one.values == other.values).all() and (one.components == other.components).all()


def test_constant_equal_empty_and_huge(spark):
    flat = spark.createDataFrame([(n, [1.0, float(n), 2.0]) for n in range(10)], SCHEMA)
    model = whitening.fitted(flat)
    assert len(model.values) == 1 and whitening.identity_error(flat, model) < 1e-12
    same = spark.createDataFrame([(n, [1.0, 2.0]) for n in range(5)], SCHEMA)
    model = whitening.fitted(same)
    assert [r.whitened for r in whitening.whitened(same, model).collect()] == [[]] * 5
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.fitted(empty) is None and whitening.whitened(empty, None).count() == 0
    ragged = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], SCHEMA)
    with pytest.raises(ValueError, match="whitened together"):
        whitening.fitted(ragged)
    huge = spark.createDataFrame([(1, [3e38, 1.0]), (2, [-3e38, 1.0]), (3, [0.0, 4.0])], SCHEMA)
    model = whitening.fitted(huge)
    found = {r.row.vec_id: int(r.deviation) for r in whitening.whitened(huge, model).collect()}
    numbers = {1: [2**52 + 10**6, 10**6 + 64], 2: [-(2**52) + 10**6, 10**6 + 64], 3: [10**6, 10**6 + 256]}
    sums = [sum(v[i] for v in numbers.values()) for i in (0, 1)]
    assert found == {n: sum((3 * v[i] - sums[i]) ** 2 for i in (0, 1)) for n, v in numbers.items()}


def test_the_registered_query(spark):
    rows = queries.op12_embedding_whitening(spark, "/root/testdata/sf0.001").toPandas()
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").toPandas()
    x, centred, values, axes = plain(np.stack(table.embedding))
    assert len(rows) == 32 * len(table) and set(rows.n) == {len(table)} and rows.identity_error.max() < 1e-9
    by_component = rows.sort_values(["component", "vec_id"])
    order = np.argsort(table.vec_id.to_numpy())
    for component, part in by_component.groupby("component"):
        expected = (centred @ axes[:, component - 1] / math.sqrt(values[component - 1]))[order]
        made = part.whitened.to_numpy()
        assert np.allclose(made * np.sign(made @ expected), expected, atol=1e-8)
        assert np.allclose(part.explained, values[component - 1] / values.sum(), rtol=1e-9)
