"""The classifiers learn in a task, so the driver holds neither the training texts nor the tables of training."""

import numpy as np

import corpus_pipeline
from corpusloom.llm import crf_language, ordinal
from corpusloom.llm.storage import table

SF = "/root/testdata/sf0.001"


def test_the_driver_gets_the_model_only(spark, monkeypatch):
    docs = table(spark, SF, "documents")
    # the sample is wanted in the order of ids
    texts, langs = map(list, zip(*[(r["text"], r["lang"]) for r in crf_language.training_sample(docs).orderBy("doc_id").collect()]))
    wanted = crf_language.fit_crf(texts, langs)
    labels = table(spark, SF, "labels")
    sample, graded = ordinal.training_sample(docs, labels)
    rows = sample.orderBy("doc_id").collect()
    severity = ordinal.fit_ordinal([r["text"] for r in rows], *ordinal._bounds(np.array([r["grade"] for r in rows]), graded))

    def refused(*args, **kwargs):
        raise AssertionError("learned in the driver")

    with monkeypatch.context() as held:
        for module, name in ((crf_language, "training_rows"), (ordinal, "training_rows")):
            held.setattr(module, name, refused)
        held.setattr(type(docs), "toArrow", refused)
        corpus_pipeline.language_stage(spark, docs, SF)
        corpus_pipeline.toxicity_stage(spark, docs, SF)
        found, found_severity = crf_language.learned(docs.repartition(5)), ordinal.learned(docs.repartition(5), labels)
    assert found.languages == wanted.languages
    assert np.array_equal(found.weights, wanted.weights) and np.array_equal(found.transitions, wanted.transitions)
    assert np.array_equal(found_severity.features, severity.features) and np.array_equal(found_severity.weights, severity.weights)


def test_nothing_to_learn_from(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    assert crf_language.learned(docs.limit(0)).languages == []
    assert crf_language.learned(docs.limit(0)).weights.shape == (crf_language.BUCKETS, 0)
    assert len(ordinal.learned(docs.limit(0), labels).features) == len(ordinal.learned(docs, labels.limit(0)).features) == 0


def test_training_holds_little_of_a_slice():
    texts = [" ".join(f"{word}{i % 97}" for word in ("alpha", "beta", "gamma", "delta")) for i in range(400)]
    batch = crf_language.pa.RecordBatch.from_arrays([crf_language.pa.array(texts), crf_language.pa.array([0] * len(texts))], names=["text", "label"])
    buckets, owner, code, label, n = crf_language._learned(batch)
    assert (buckets.dtype, owner.dtype, code.dtype, label.dtype) == (np.uint16, np.int32, np.int32, np.int32)
    assert n == 4 * 97 and len(code) == 1600 and owner.max() == n - 1
