"""Reasons of terms: rows of terms do not hold the lists of their content."""

from corpusloom.operators import quality


def test_terms_are_grouped_without_lists(spark):
    rows = spark.createDataFrame([(1, "planets circle stars planets niche", "planets", "circle"), (2, None, "x", None)], "doc_id long, factual_text string, source_text string, context string")
    found = quality.term_reasons(rows, "doc_id", ["niche"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan and "__missing" not in plan.split("Aggregate")[1].split("\n")[0]
    assert {tuple(r) for r in found.collect()} == {(1, "planets", 2, "source"), (1, "circle", 1, "context"), (1, "stars", 1, "unsupported"), (1, "niche", 1, "presentation")}
