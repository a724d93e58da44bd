"""Steps that computed one thing many times, or held too much: how often an expression is in a plan, and the same results."""

import re
import tracemalloc

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import text as t
from corpusloom.llm import crf_language
from corpusloom.operators import embedding, metrics, quality
from corpusloom.plans import evaluation_queries, retrieval_queries


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_classes_of_characters_are_trees():
    several = t._one_of(t._SEVERAL)
    # no level tries more than a few runs one by one
    assert max(len(re.findall(r"\\x\{\w+\}-\\x\{\w+\}", level)) for level in re.split(r"[\[\]]", several)) <= 4


def test_forms_beside_plain_text(spark):
    texts = ["ab e\u0301x \uff21\u00bd e\u0323\u0302 end e", "e\u0301", "plain  text ", "\u03ac\u0301b\u2028", "  a\u00a0\tb\n\n c "]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", t.compose(F.col("x")).alias("c"), t.strip_accents(F.col("x")).alias("s"), t.squeeze(F.col("x")).alias("q"))
    got = {r.i: (r.c, r.s, r.q) for r in rows.collect()}
    assert got[0][:2] == ("ab \u00e9x A1\u20442 \u1ec7 end e", "ab ex A1\u20442 e end e") and got[1][:2] == ("\u00e9", "e")
    assert got[2][2] == "plain text" and got[4][2] == re.sub(r"[ \t\n]+", " ", texts[4]).strip(" ")


def test_next_text_of_runs(spark, monkeypatch):
    monkeypatch.setattr(evaluation_queries, "_RUN", 4)
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 != 0, F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"), F.when(F.col("id") % 5 != 0, (F.col("id") % 3).cast("string")).alias("source"), F.lit("en").alias("lang")).where("doc_id not between 20 and 33")
    found = evaluation_queries._with_next(docs)
    want = docs.withColumn("__after", F.lead("text").over(Window.partitionBy("source", "lang").orderBy("doc_id")))
    assert sorted(map(str, found.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_support_of_many_missing_terms(spark):
    terms = [f"w{i % 70}" for i in range(300)]
    got = spark.createDataFrame([(terms, ["w1", "w2"]), (terms, terms), ([], ["x"]), (None, ["x"])], "a array<string>, b array<string>").select(quality.support_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert [r.r for r in got] == [sum(x not in ("w1", "w2") for x in terms) / 300, 0.0, None, None]


def test_words_are_found_once(spark):
    docs = spark.createDataFrame([(1, "a b", "b c")], "doc_id long, x string, y string")
    plan = docs.select(t.normalize_terms(t.significant_words(F.col("x"))).alias("n"))._jdf.queryExecution().analyzed().toString()
    # one to find the words of a text, one in every normal form
    assert plan.count("regexp_extract_all") == 3
    assert _plan(docs.select(metrics.token_recall(F.col("x"), F.col("y")).alias("n"))).count("regexp_extract_all") == 4
    assert _plan(docs.select(metrics.lexical_overlap(F.col("x"), F.col("y")).alias("n"))).count("split(") == 2
    chunks = docs.select(F.col("doc_id").alias("case_id"), F.lit("md").alias("format"), F.lit(0).alias("chunk_order"), F.col("x").alias("text"))
    assert _plan(metrics.chunk_structure(chunks, ["md", "txt", "pdf"])).count("regexp_extract_all") == 6


def test_terms_of_claims_are_no_rows(spark):
    claims = spark.createDataFrame([("a", i, "factual", "planets circle unknown") for i in range(2000)] + [(None, 1, "factual", "planets")], "case_id string, claim_id int, role string, text string")
    sources = spark.createDataFrame([("a", "planets here"), ("a", "circle there")], "case_id string, source_text string")
    routed = quality.route_claims(claims, sources)
    assert "explode" not in _plan(routed)
    assert {(r.case_id, r.legacy_ratio) for r in routed.collect()} == {("a", 1 / 3), (None, None)}


def test_length_of_an_embedding_is_summed_once(spark):
    plan = _plan(embedding.feature_embeddings(spark.createDataFrame([(1, "a b b")], "chunk_id long, text string")))
    assert plan.count("aggregate(") == 1


def test_runs_compute_their_own_format_only(spark):
    rows = retrieval_queries._format_rows(spark, "/root/testdata/sf0.001", ["md"])
    assert {r.format for r in rows.select("format").distinct().collect()} == {"md"}


def test_training_holds_the_tables_of_a_piece():
    random = np.random.default_rng(1)
    model = crf_language.Crf(["a", "b", "c", "d"], np.zeros((1, 4)), random.normal(size=(4, 4)))
    emissions, code = random.normal(size=(500, 4)), random.integers(0, 500, 200_000)
    at = np.append(np.arange(0, len(code), 400), len(code))
    tracemalloc.start()
    p, moves = crf_language.in_pieces(model, emissions, code, at)
    few = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    whole, all_moves = model.marginals(emissions[code], at)
    assert few < tracemalloc.get_traced_memory()[1] / 4
    tracemalloc.stop()
    assert np.array_equal(p, whole) and np.allclose(moves, all_moves)
