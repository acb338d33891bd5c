"""The pipeline's stages against plain versions, each on its own input."""

import corpus_pipeline
from larder.llm import bpe, decontaminate
from larder.llm.common import materialize

from . import brute


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = materialize(stage(spark, docs, sf_dir), f"test-{k}")
        seen[name] = (before, {r.doc_id: r.text for r in docs.collect()})
        assert docs.columns[: len(columns)] == columns
    before, after = seen["language ID"]
    assert len(after) >= 0.98 * len(before)
    before, after = seen["n-gram Jaccard join"]
    assert set(after) == {c for c, _, _ in brute.near(list(before.items())).values()}
    before, after = seen["suffix-array dedup"]
    want = {r[0]: (r[1], r[2]) for r in brute.suffix(list(before.items()), corpus_pipeline.PASSAGE)}
    assert set(after) == set(before)
    for k, t in after.items():
        assert abs(len(t.encode()) - (want[k][0] - want[k][1])) <= 3 * 2 * max(1, want[k][1] > 0) * 3 and (want[k][1] > 0 or t == before[k])
    before, after = seen["benchmark decontamination"]
    items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    gone = {k for k, t in before.items() if any(i in decontaminate.normal(t) for i in items)}
    assert not gone & set(after)
    for k in set(before) - set(after) - gone:
        assert any(brute.edits(i, decontaminate.normal(before[k])) <= decontaminate.RATE * len(i) for i in items)
    assert docs.filter("not round_trip").count() == 0 and docs.count() == len(after)
    assert bpe.pieces("", 10) == [""]


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and {"doc_id", "ids", "n_tokens", "round_trip"} <= set(out.columns)
