"""The pipeline, stage by stage, against what the operators' brute-force forms say."""

import corpus_pipeline as pipeline
from loomwork.llm.common import written

from .test_decontaminate import brute as leaks
from .test_jaccard import brute as linked

D = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    names = docs.columns
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard", "decontaminate", "byte_bpe"]
    for name, stage in pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = written(stage(spark, docs, D), f"test-{name}")
        after = {r.doc_id for r in docs.collect()}
        if name != "byte_bpe":
            assert docs.columns == names
        if name == "ngram_jaccard":
            assert after == {c for _, _, c in linked(before)}
        if name == "decontaminate":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
            assert after == {x[0] for x in leaks(before, items) if not x[3]}
        if name == "byte_bpe":
            assert after == {d for d, _ in before}
            assert all(len(r.ids) == 4 * r.n_tokens for r in docs.collect())
