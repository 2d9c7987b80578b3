"""The pipeline stage by stage against plain versions, and end to end."""

import re

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_near import classes_of
from tests.llm.test_quality import plain as plain_quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The result of every stage, written and read as the pipeline does."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path_factory.mktemp('stage')}/{name}"
        stage(spark, docs, SF).write.parquet(path)
        docs = found[name] = spark.read.parquet(path)
    return found


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(stages):
    for name in ("quality_rules", "exact_dedup", "near_dedup", "redact_pii"):
        assert stages[name].dtypes == stages["documents"].dtypes


def test_quality(stages):
    before, after = by_id(stages["documents"]), by_id(stages["quality_rules"])
    assert set(after) == {i for i, r in before.items() if plain_quality(r.text)[-1]}


def test_exact(stages):
    first = {}
    for i, r in sorted(by_id(stages["quality_rules"]).items()):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text), i)
    assert set(by_id(stages["exact_dedup"])) == set(first.values())


def test_near(stages):
    rows = [(i, r.text) for i, r in by_id(stages["exact_dedup"]).items()]
    assert set(by_id(stages["near_dedup"])) == set(classes_of(rows).values())


def test_pii(stages):
    before, after = by_id(stages["near_dedup"]), by_id(stages["redact_pii"])
    assert set(before) == set(after)
    for i, r in after.items():
        assert r.n_chars == len(r.text)
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r.text)
        if not re.search("[0-9@]", before[i].text):
            assert r == before[i]


def test_packing(stages):
    pieces = stages["best_fit_packing"].toPandas()
    assert set(pieces.doc_id) == set(by_id(stages["redact_pii"]))
    total = pieces.groupby("sequence_id").length.sum()
    assert total.max() <= 2048
    assert len(total) <= np.ceil(total.sum() / 2048) + 2


def test_run(spark, stages):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() == stages["best_fit_packing"].count()
