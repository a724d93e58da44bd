"""Hashed embeddings, the merged chunk table, the alignment re-ranker, provider calls and latency sketches."""

import os
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import embedding as e
from corpusloom.operators import providers
from corpusloom.operators import retrieval as r

TEXTS = [(1, None), (2, ""), (3, "uno dos tres dos"), (4, "Äpfel ÄPFEL 日本 x_1"), (5, "word " * 50_000)]


def vector(text, width=e.WIDTH):
    sums = [0] * width
    for word in re.findall(r"\w+", (text or "").lower()):
        place, sign = e.token_place(word, width)
        sums[place] += sign
    return sums


@pytest.mark.parametrize("width", [256, 7])
def test_embeddings_equal_a_plain_version(spark, width):
    rows = spark.createDataFrame([(*t, "old") for t in TEXTS], "id int, text string, counts string")
    got = {x.id: x.counts for x in e.hashed_counts(rows, width=width).collect()}
    assert got == {i: vector(t, width) for i, t in TEXTS}
    unit = {x.id: x.embedding for x in e.feature_embeddings(rows, width=width).collect()}
    assert all(np.allclose(unit[i], np.array(v) / max(1e-9, np.linalg.norm(v))) for i, v in got.items())


def test_near_copies_are_found_by_their_embeddings(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) > 400").select(F.col("doc_id").alias("chunk_id"), "text")
    docs = e.feature_embeddings(docs).select("chunk_id", "text", "embedding")
    edited = docs.select(F.col("chunk_id").alias("query_id"), F.concat(F.expr("substr(text, 40)"), F.lit(" other words here")).alias("text"))
    found = r.vector_topk(docs, e.feature_embeddings(edited).select("query_id", "embedding"), 3).where("query_id = chunk_id")
    assert found.select("query_id").distinct().count() / docs.count() >= 0.95


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_merge_writes_only_what_changed(spark, tmp_path):
    path, schema = str(tmp_path / "chunks"), "chunk_id string, version int, text string"
    rows = lambda *x: spark.createDataFrame(list(x), schema)
    calls = spark.sparkContext.accumulator(0)

    def embed(frame):
        def count(batches):
            for batch in batches:
                calls.add(batch.num_rows)
                yield batch

        return e.feature_embeddings(frame.mapInArrow(count, frame.schema))

    first = rows(*[(f"c{i}", 1, f"text {i}") for i in range(200)])
    assert e.merge_chunks(first, path, embed) == 200 and calls.value == 200
    before = files(path)
    assert e.merge_chunks(first, path, embed) == 0 and e.merge_chunks(first.limit(0), path, embed) == 0 and files(path) == before and calls.value == 200
    # newer, late, repeated and several versions of one key, and a new key
    assert e.merge_chunks(rows(("c7", 2, "two"), ("c7", 3, "three"), ("c8", 0, "late"), ("c9", 1, "same version"), ("new", 1, "new")), path, embed) == 2
    assert calls.value == 202
    after, stored = files(path), {x.chunk_id: x for x in spark.read.parquet(path).collect()}
    assert len(stored) == 201 and (stored["c7"].text, stored["c8"].text, stored["c9"].text) == ("three", "text 8", "text 9")
    assert np.allclose(stored["c7"].embedding, np.array(vector("three")))
    touched = {stored["c7"].bucket, stored["new"].bucket}
    bucket = lambda f: int(re.search(r"bucket=(\d+)", f)[1])
    assert {f for f in before if bucket(f) not in touched} == {f for f in after if bucket(f) not in touched} and len(before) > 30
    with pytest.raises(ValueError):
        e.merge_chunks(rows((None, 1, "x")), path, embed)


def aligned(query, text):
    q, w = re.findall(r"\w+", (query or "").lower()), re.findall(r"\w+", (text or "").lower())
    if not q:
        return 0.0
    gaps = [min((j - i for i, x in enumerate(w) for j in range(i + 1, len(w)) if x == a and w[j] == b), default=None) for a, b in zip(q, q[1:])]
    gaps = [g for g in gaps if g]
    return round(sum(x in w for x in q) / len(q) + ((0.5 * len(gaps) + 0.5 * sum(1 / g for g in gaps)) / (len(q) - 1) if len(q) > 1 else 0), 6)


def test_alignment_equals_a_plain_version(spark):
    pairs = [("a b c", "a b c"), ("a b c", "c b a"), ("a b c", "a x b x x c a b"), ("a a", "a x a"), ("a a", "a"), ("a", "b a"), ("", "x"), (None, None), ("A, b!", "B a b"), ("x y", ""), ("a b a b", "b a a b")]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, q string, t string")
    got = {x.i: x.s for x in rows.select("i", e.alignment_scorer(F.col("q"), F.col("t")).alias("s")).collect()}
    assert got == {i: aligned(*p) for i, p in enumerate(pairs)}


def test_alignment_finds_passages_better_than_fusion_alone(spark):
    """Queries are passages of documents; R@3 of the re-ranked list is not below that of the fusion."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) > 300").dropDuplicates(["text"]).select(F.col("doc_id").alias("chunk_id"), "text")
    docs = e.feature_embeddings(docs).select("chunk_id", "text", "embedding")
    words = F.slice(F.split("text", " "), 11, 12)
    asked = e.feature_embeddings(docs.select(F.col("chunk_id").alias("query_id"), F.array_join(words, " ").alias("text")).limit(40))
    asked = spark.createDataFrame(asked.collect(), asked.schema)
    fused = r.rrf(r.vector_topk(docs, asked, 15), r.bm25_topk(docs.select("chunk_id", "text"), asked, 15), cut=15)
    candidates = fused.join(docs.select("chunk_id", "text"), "chunk_id").join(asked.select("query_id", F.col("text").alias("query")), "query_id")
    found = r.rerank(candidates, e.alignment_scorer, None).where("query_id = chunk_id").collect()
    hits = lambda rank: sum(x[rank] <= 3 for x in found) / 40
    assert hits("rank") >= hits("rrf_rank") and hits("rank") >= 0.9


def test_every_call_has_one_status(spark):
    def make():
        seen = {}

        def client(text, seconds):
            seen[text] = seen.get(text, 0) + 1
            if text == "":
                return 5
            if text == "busy":
                if seen[text] < 3:
                    raise providers.ApiError(503, "UNAVAILABLE", "x")
                return "at last"
            if text == "hung":
                time.sleep(30)
            if text in ("key", "quota", "reset", "odd"):
                raise {"key": providers.ApiError(403), "quota": providers.ApiError(429), "reset": ConnectionError("x"), "odd": KeyError("x")}[text]
            return text.upper()

        return client

    rows = spark.createDataFrame([(i, t, "old") for i, t in enumerate(["ok", None, "busy", "hung", "key", "quota", "reset", "odd", "ok"])], "id int, text string, answer string").coalesce(1)
    policy = providers.Policy(concurrency=3, timeout_s=0.1, tries=3, backoff_s=0.01)
    began = time.time()
    got = {x.id: (x.status, x.answer, x.error_code, x.retryable, x.calls) for x in providers.call_provider(rows, make, policy=policy).collect()}
    assert time.time() - began < 25
    assert got == {
        0: ("success", "OK", None, None, 1), 1: ("failed", None, "INVALID_MODEL_OUTPUT", True, 3), 2: ("success", "at last", None, None, 3), 3: ("failed", None, "PROVIDER_TIMEOUT", True, 3), 4: ("failed", None, "PROVIDER_AUTH_ERROR", False, 1),
        5: ("failed", None, "RESOURCE_EXHAUSTED", True, 3), 6: ("failed", None, "PROVIDER_UNAVAILABLE", True, 3), 7: ("failed", None, "INTERNAL_ERROR", False, 1), 8: ("success", "OK", None, None, 1),
    }
    none = providers.call_provider(rows, lambda: None).collect()
    assert {(x.status, x.error_code, x.calls) for x in none} == {("unavailable", "not_configured", 0)} and len(none) == 9
    assert providers.call_provider(rows.limit(0), make).collect() == []


def test_latency_sketches_merge_with_bounded_error(spark):
    calls = spark.range(60_000).selectExpr("id % 2 AS g", "id % 7 AS day", "cast(pow(xxhash64(id) % 1000, 2) AS long) AS latency_ms")
    calls = calls.unionByName(spark.createDataFrame([(3, 0, None)], "g long, day long, latency_ms long"))
    merged = providers.latencies(providers.merged_latencies(providers.latency_sketches(calls, ["g", "day"]), ["g"])).collect()
    values = {g: np.sort([x.latency_ms for x in calls.where(f"g = {g}").collect()]) for g in (0, 1)}
    assert {x.g for x in merged} == {0, 1}
    for x in merged:
        v = values[x.g]
        assert (x.calls, x.low_ms, x.high_ms) == (len(v), v[0], v[-1]) and abs(x.mean_ms - v.mean()) < 1e-3
        for q, got in ((0.5, x.p50_ms), (0.95, x.p95_ms)):
            low, high = np.searchsorted(v, got, "left") / len(v), np.searchsorted(v, got, "right") / len(v)
            assert low - 0.01 <= q <= high + 0.01
