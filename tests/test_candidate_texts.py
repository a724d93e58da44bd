"""Candidates get their texts without a shuffle of all texts."""

from pyspark.sql import functions as F

from corpusloom.operators import retrieval
from corpusloom.plans import contract_queries

SF = "/root/testdata/sf0.001"


def test_only_texts_of_candidates_are_shuffled(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = contract_queries.run_comparison(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "LeftSemi" in plan and "strategy=broadcast" in plan


def test_candidates_keep_their_rows(spark, monkeypatch):
    corpus = spark.range(50).select(F.col("id").alias("chunk_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    candidates = spark.createDataFrame([(1, 3), (1, 4), (2, 3), (2, 99)], "query_id long, chunk_id long")
    wanted = [(3, 1, "t3"), (3, 2, "t3"), (4, 1, "t4")]
    assert sorted(map(tuple, retrieval.with_texts(candidates, corpus).collect())) == wanted
    monkeypatch.setattr("corpusloom.sources.staging.BROADCAST_BYTES", 0)
    assert sorted(map(tuple, retrieval.with_texts(candidates, corpus).collect())) == wanted
    assert retrieval.with_texts(candidates.limit(0), corpus).count() == 0
