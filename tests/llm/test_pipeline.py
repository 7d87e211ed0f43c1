from collections import Counter

import brute
import corpus_pipeline as pipeline
from ladderspark.storage import materialize

SF = "/root/testdata/sf0.001"


def test_stages_do_their_part(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.collect()
    for name, stage in pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), f"test-{name}")
        after = docs.collect()
        if name == "quality":
            bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
            assert len(bad & {r.doc_id for r in before}) > len(bad & {r.doc_id for r in after}) and len(after) > len(before) / 2
        if name == "exact_dedup":
            assert sorted(r.doc_id for r in after) == sorted(i for i, _, _, kept, _ in brute.exact([(r.doc_id, r.text) for r in before]) if kept)
        if name == "near_dedup":
            assert sorted(r.doc_id for r in after) == sorted(i for i, _, c in brute.near([(r.doc_id, r.text) for r in before]) if i == c)
        if name == "mixing":
            assert {r.doc_id for r in after} <= {r.doc_id for r in before} and max(Counter(r.doc_id for r in after).values()) <= 2
        if name == "byte_bpe":
            assert len(after) == len(before) and all(r.ids_sha256 and r.n_tokens * 4 == len(r.ids) for r in after)
        else:
            assert set(docs.columns) == {"doc_id", "text", "lang", "source", "n_chars"}
        before = after
    assert sorted((r.doc_id, r.ids_sha256) for r in pipeline.run(spark, SF).collect()) == sorted((r.doc_id, r.ids_sha256) for r in before)


def test_stages_take_awkward_rows(spark):
    odd = brute.odd_rows(spark).selectExpr("doc_id", "text", "'en' AS lang", "source", "length(text) AS n_chars", "kept", "n AS score", "'x' AS text_in")
    for docs in (odd, odd.limit(0)):
        for name, stage in pipeline.STAGES:
            docs = materialize(stage(spark, docs, SF), f"test-{name}")
            assert name == "byte_bpe" or docs.columns == odd.columns
