"""Each stage of the pipeline on its own input, against brute force."""

import brute
import corpus_pipeline
import pytest
from test_models import _check_packing

from karstflow.llm.common import stored


def _pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


@pytest.fixture(scope="module")
def steps(spark, sf):
    out = [spark.read.parquet(f"{sf}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], sf), name))
    return out


def test_order_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "decontamination", "packing"]
    assert all(x.schema == steps[0].schema for x in steps[1:-1])
    assert corpus_pipeline.ORACLE_SQL is None


def test_quality_stage(steps):
    before, after = _pairs(steps[0]), {i for i, _ in _pairs(steps[1])}
    for i, t in before:
        n, _, symbols, _, repeated = brute.base_counts(t)
        if n < 20 or 100 * repeated > 30 * n or symbols > 0.3 * n:
            assert i not in after
    assert 0.7 * len(before) < len(after) < len(before)


def test_line_stage(steps):
    want = sorted((i, t) for i, _, _, t in brute.line_dedup(_pairs(steps[1])))
    assert sorted(_pairs(steps[2])) == want
    assert all(r.n_chars == len(r.text) for r in steps[2].collect())


def test_near_stage(steps):
    assert sorted(i for i, _ in _pairs(steps[3])) == sorted(i for i, _, c in brute.near(_pairs(steps[2]), 5, 80) if i == c)


def test_benchmark_stage(spark, sf, steps):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert sorted(i for i, _ in _pairs(steps[4])) == sorted(x[0] for x in brute.contamination(_pairs(steps[3]), items) if not x[2])


def test_packing_stage(steps):
    assert _check_packing(dict(_pairs(steps[4])), steps[5].collect()) > 0.9


def test_run_is_the_stages(spark, sf, steps):
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).collect()) == sorted(tuple(r) for r in steps[5].collect())


def test_stages_on_nothing_and_on_odd_rows(spark, sf, odd, nothing):
    for docs in (odd, nothing):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            assert docs.columns == columns
            docs = stored(stage(spark, docs, sf), name)
        docs.count()
