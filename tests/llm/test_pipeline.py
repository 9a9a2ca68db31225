"""The pipeline against a plain run of the same decisions, and its stages on awkward rows."""

import re

import numpy as np
import plain
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from refrain.llm import queries


def test_pipeline_equals_plain_decisions(spark):
    docs = spark.read.parquet(f"{plain.SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    score = {r["doc_id"]: r["score"] for r in queries.op4_quality(spark, plain.SF).collect()}
    kept = {i: t for i, t in rows.items() if score[i] >= 0.3}
    best = {}
    for i, t in sorted(kept.items(), key=lambda x: (-len(x[1]), x[0])):
        best.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), i)
    kept = {i: kept[i] for i in sorted(best.values())}
    ids = list(kept)
    groups = plain.similar_groups([kept[i] for i in ids])
    kept = {ids[k]: kept[ids[k]] for k in sorted(set(groups))}
    items = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{plain.SF}/benchmark.parquet").collect()]
    kept = {i: t for i, t in kept.items() if not any(x in " ".join(t.lower().split()) for x in items)}
    library = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    expected = {i: library.encode(t, add_special_tokens=False).ids for i, t in kept.items()}
    found = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in corpus_pipeline.run(spark, plain.SF).collect()}
    assert found == expected


def test_stages_keep_the_columns_of_awkward_rows(spark):
    docs = plain.awkward(spark)
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, plain.SF)
        assert out.columns == docs.columns, name
        assert out.dtypes == docs.dtypes, name
        assert stage(spark, plain.empty(spark), plain.SF).count() == 0, name
    assert sorted(str(r["doc_id"]) for r in corpus_pipeline.exact_dedup(spark, docs, plain.SF).collect()) == sorted(
        ["1", "6", "None", "7", "8", "9", "10", "11", "12", "13"])
    assert corpus_pipeline.encode(spark, docs, plain.SF).count() == docs.count()
    filtered = corpus_pipeline.quality(spark, docs, plain.SF)
    assert filtered.columns == docs.columns
    assert corpus_pipeline.quality(spark, plain.empty(spark), plain.SF).count() == 0


def test_quality_keeps_good_rows_without_an_id(spark):
    docs = spark.read.parquet(f"{plain.SF_LABELLED}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, plain.SF_LABELLED).select("doc_id", "text").collect()
    good = [r["text"] for r in kept[:20]]
    nameless = docs.unionByName(spark.createDataFrame([(None, t) for t in good], "doc_id bigint, text string"), allowMissingColumns=True)
    left = corpus_pipeline.quality(spark, nameless, plain.SF_LABELLED)
    assert sorted(r["text"] for r in left.where("doc_id is null").collect()) == sorted(good)
