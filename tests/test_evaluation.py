"""Metrics by labels, tables of runs, case rows and judged contents on small cases."""

from pyspark.sql import functions as F

from corpusloom.operators import metrics, quality


def test_metrics_by_label_equal_those_by_lists(spark):
    labels = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", 2), ("e", None), (None, 1), ("a", 1)], "chunk_id string, label int")
    cases = spark.createDataFrame([("q1", "x", "success", 1), ("q2", "x", "no_results", 2), ("q3", "y", "error", 2), ("q4", "y", "success", 9), ("q5", "y", "success", 2)], "case_id string, category string, status string, label int")
    results = spark.createDataFrame([("q1", 1, "c"), ("q1", 4, "b"), ("q1", 2, "a"), ("q5", 1, "e"), ("q5", 3, "d"), ("q2", 1, "c"), ("q4", 1, "a"), ("q1", 6, "d")], "case_id string, rank int, chunk_id string")
    lists = labels.where("chunk_id is not null and label is not null").groupBy("label").agg(F.collect_set("chunk_id").alias("relevant"))
    truth = cases.join(lists, "label", "left").select("case_id", "category", F.coalesce("relevant", F.array().cast("array<string>")).alias("relevant"))
    # lists take the first places, so the gap before q1's fourth result is filled
    filled = results.unionByName(spark.createDataFrame([("q1", 3, "none"), ("q5", 2, "none")], "case_id string, rank int, chunk_id string"))
    payloads = cases.select("case_id", "status").join(metrics.retrieved_ids(filled), "case_id", "left").withColumn("retrieved", F.coalesce("retrieved", F.array().cast("array<string>")))
    want = {r.case_id: tuple(r) for r in metrics.evaluate_cases(payloads, truth).collect()}
    got = {r.case_id: tuple(r) for r in metrics.evaluate_by_label(cases, results, labels).collect()}
    assert got == want and len(got) == 5


def test_runs_are_compared_in_one_pass(spark):
    scores = spark.createDataFrame([("a", "r1", 0.0), ("a", "r2", 0.5), ("a", "r3", 1.0), ("b", "r1", 1.0), ("b", "r2", 0.0), ("c", "r3", 0.0)], "case_id string, run string, value double")
    got = {r.run: tuple(r)[1:] for r in metrics.compare_runs(scores, ["r1", "r2", "r3"]).collect()}
    assert got == {"r1": (0.5, 2, 1, 0, 0, 0.0, 0.0), "r2": (0.25, 2, 1, 1, 1, -0.25, -0.25), "r3": (0.5, 2, 1, 1, 0, 0.0, 0.25)}


def test_case_rows_without_results(spark):
    cases = spark.createDataFrame([("a", ["red", "sky"], "red sky above"), ("b", ["x"], "x"), ("c", [], "")], "case_id string, keywords array<string>, expected string")
    results = spark.createDataFrame([("a", 2, 7, 0.123456, "a RED one"), ("a", 1, 9, 2.0, "above")], "case_id string, rank int, chunk_id int, score double, text string")
    got = {r.case_id: tuple(r)[1:] for r in metrics.case_rows(cases, results).collect()}
    assert got == {"a": (0.5, True, 0.666667, [9, 7], [2.0, 0.1235]), "b": (0.0, False, 0.0, [], []), "c": (0.0, False, 0.0, [], [])}


def test_a_useless_answer_leaves_the_heuristic(spark):
    columns = "doc_id int, content_text string, factual_text string, source_text string, context string, profile string, detail_level string"
    text = "planets circle stars and moons circle planets for a long time"
    contents = spark.createDataFrame([(i, text, text, text, None, None, None) for i in range(5)], columns)
    answers = {0: ("success", '{"relevance": 5, "coherence": 5, "adaptation": 5, "support": 4}', None), 1: ("success", '{"relevance": 5}', None), 2: ("success", "no json", None), 3: ("failed", None, "PROVIDER_TIMEOUT"), 4: ("success", '{"relevance": 1, "coherence": 5, "adaptation": 5, "support": 4}', None)}

    def judge(rows):
        told = spark.createDataFrame([(i, *a) for i, a in answers.items()], "doc_id int, status string, answer string, error_code string")
        return rows.join(told, "doc_id")

    got = {r.doc_id: (r.heuristic, r.semantic_status, r.error_code, r.semantic, r.verdict) for r in quality.evaluate_contents(contents, "doc_id", judge).collect()}
    assert got == {
        0: ("approved", "success", None, "approved", "approved"), 1: ("approved", "failed", "INVALID_MODEL_OUTPUT", None, "approved"), 2: ("approved", "failed", "INVALID_MODEL_OUTPUT", None, "approved"),
        3: ("approved", "failed", "PROVIDER_TIMEOUT", None, "approved"), 4: ("approved", "success", None, "rejected", "requires_revision"),
    }
