"""The learnt operators: held-out accuracy, probabilities that add up, awkward rows."""

import numpy as np
import plain
from pyspark.sql import functions as F

from refrain.llm import language_kneser_ney, quality_pu, queries, toxicity_ftrl




def _held_out(spark, query, column):
    labels = spark.read.parquet(f"{plain.SF_LABELLED}/labels.parquet")
    return query(spark, plain.SF_LABELLED).where("held_out").join(labels.select("doc_id", column), "doc_id").toPandas()


def test_quality_on_held_out_rows(spark):
    rows = _held_out(spark, queries.op4_quality, "quality")
    assert (rows.predicted == rows.quality).mean() > 0.95
    assert rows.score.between(0, 1).all()
    assert ((rows.score >= 0.3).astype(int) == rows.predicted).all()


def test_toxicity_on_held_out_rows(spark):
    rows = _held_out(spark, queries.op5_toxicity, "toxic")
    assert (rows.predicted == rows.toxic).mean() > 0.85
    assert rows.score[rows.toxic == 1].mean() > rows.score[rows.toxic == 0].mean()


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{plain.SF_LABELLED}/documents.parquet").select("doc_id", "lang")
    rows = queries.op10_language(spark, plain.SF_LABELLED).where("held_out").join(docs, "doc_id").toPandas()
    assert (rows.lang_pred == rows.lang).mean() > 0.97
    assert rows.score.between(0, 1).all()


def test_quality_of_awkward_rows(spark):
    docs = plain.awkward(spark)
    labels = spark.createDataFrame([(1, 1), (2, 1), (2, 0), (7, 0), (8, None), (None, 1), (99, 1)], "doc_id bigint, quality int")
    model = quality_pu.fit(docs, labels, F.lit(True))
    found = quality_pu.score(docs, model).collect()
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 for r in found)
    assert quality_pu.fit(docs, labels.limit(0), F.lit(True)) is None
    assert {r["score"] for r in quality_pu.score(docs, None).collect()} == {0.5}
    assert quality_pu.score(plain.empty(spark), model).count() == 0


def test_risk_is_held_at_zero():
    rng = np.random.default_rng(0)
    x = rng.random((6_000, quality_pu.N_FEATURES))
    x[:3_000, 0] += 1
    net = quality_pu.fit_network(x[:1_500], x, 0.5)
    assert net.score(x[:3_000]).mean() > 0.7 > 0.3 > net.score(x[3_000:]).mean()


def test_toxicity_of_awkward_rows(spark):
    docs = plain.awkward(spark)
    labels = spark.createDataFrame([(1, 0), (2, 0), (2, 1), (7, 1), (8, None), (None, 1)], "doc_id bigint, toxic int")
    model = toxicity_ftrl.fit(docs, labels, F.lit(True))
    found = toxicity_ftrl.score(docs, model).collect()
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 for r in found)
    nothing = toxicity_ftrl.fit(docs, labels.limit(0), F.lit(True))
    assert {r["score"] for r in toxicity_ftrl.score(docs, nothing).collect()} == {0.0}
    assert toxicity_ftrl.score(plain.empty(spark), model).count() == 0


def test_sparse_weights_find_the_words():
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"], 12)) + (" vile" if i % 3 == 0 else "") for i in range(300)]
    slots, weights = toxicity_ftrl.fit_rows(texts, [int(i % 3 == 0) for i in range(300)])
    table = np.zeros(toxicity_ftrl.SLOTS)
    table[slots] = weights
    scores = toxicity_ftrl.score_rows(["alpha beta vile", "alpha beta gamma", "", None], table)
    assert scores[0] > 0.7 and scores[1] < 0.3 and scores[2] == scores[3]
    assert len(slots) < 200


def test_languages_of_awkward_rows(spark):
    docs = plain.awkward(spark)
    models = language_kneser_ney.fit(docs, F.lit(True))
    found = {r["doc_id"]: r for r in language_kneser_ney.identify(docs, models).collect()}
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 for i in (4, 5, 6, 10))
    assert found[9]["lang_pred"] == "ru" and found[1]["lang_pred"] == "en"
    nothing = language_kneser_ney.fit(docs.where("lang IS NULL"), F.lit(True))
    assert {r["lang_pred"] for r in language_kneser_ney.identify(docs, nothing).collect()} == {"und"}
    assert language_kneser_ney.identify(plain.empty(spark), models).count() == 0


def test_kneser_ney_probabilities_add_up():
    texts = ["the cat sat on the mat and the hat", "a cat and a rat"]
    run, n = np.unique(language_kneser_ney.grams(texts)[1], return_counts=True)
    model = language_kneser_ney.smooth(run, n)
    for context in np.unique(run >> language_kneser_ney.BITS)[:40]:
        every = (int(context) << language_kneser_ney.BITS) + np.arange(language_kneser_ney.CLASSES)
        assert abs(np.exp(language_kneser_ney.log_probabilities(model, every)).sum() - 1) < 1e-9


def test_quality_sample_counts_an_id_once(spark):
    rows = [(7, "a good long text about many things")] * 300 + [(k, f"text {k} with its own words") for k in range(8, 20)] + [(None, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(7, 1, 0), (7, 1, 0), (9, 1, 0), (10, 0, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    seen = []
    kept = quality_pu.fit_network
    quality_pu.fit_network = lambda good, rest, prior: seen.append((len(good), len(rest))) or kept(good, rest, prior)
    try:
        quality_pu.fit(docs, labels, F.lit(True))
    finally:
        quality_pu.fit_network = kept
    assert seen == [(2, 13)]


def test_languages_are_calibrated_on_every_learning_row(spark):
    from refrain.llm import language_kneser_ney as kn

    words = {"a": ["bada", "dabe", "bedo"], "b": ["fink", "kilf", "niff"]}
    rows = [(i, " ".join(words["ab"[i % 2]][(i * k) % 3] for k in range(3 + i % 4)), "ab"[i % 2]) for i in range(5_000)]
    rows += [(5_000, None, "a"), (5_001, "123", "b"), (5_002, "bada", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    models = kn.fit(docs, F.col("doc_id") >= 0)
    losses, counts = kn.calibration(docs.where("text is not null and lang is not null").select("text", "lang"), models)
    assert counts.n.sum() == 5_000
    texts, langs = [r[1] for r in rows[:5_000]], [r[2] for r in rows[:5_000]]
    entropy, letters = models.entropies(texts)
    truth = np.array([models.langs.index(x) for x in langs])
    plain = [-np.log(np.maximum(models._softmax(entropy, letters, g)[np.arange(5_000), truth], 1e-12)).sum() for g in kn.SHARPNESS]
    assert np.allclose(losses, plain) and models.sharpness == kn.SHARPNESS[int(np.argmin(plain))]
    for k in range(2):
        own = np.sort(entropy[truth == k, k])
        wanted = own[int(np.ceil(kn.ACCEPTED_SHARE * len(own))) - 1]
        assert 0 <= models.limits[k] / 1.05 - wanted < 1.001 * kn.ENTROPY_STEP
