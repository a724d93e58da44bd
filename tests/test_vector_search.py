"""Vector search: the same as a search of all pairs, with few rows of a task, and copies searched once."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as t
from corpusloom.operators import embedding as e
from corpusloom.operators import retrieval as r
from corpusloom.plans import embedding_queries


def unit(rows):
    m = np.array(rows, np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def plain(vectors, queries, k):
    """(query, id, distance, rank) of all pairs; vectors and queries are lists of (id, vector)."""
    found = []
    points = unit([v for _, v in vectors])
    for q, vector in queries:
        distance = np.round(1 - points @ unit([vector])[0], r.DIGITS)
        best = sorted(zip(np.isnan(distance), distance, [i for i, _ in vectors]), key=lambda x: (x[0], 0 if x[0] else x[1], x[2]))[:k]
        found += [(q, i, str(abs(round(d, 6))), rank) for rank, (_, d, i) in enumerate(best, 1)]
    return sorted(found)


def rows(df):
    return sorted((x.query_id, x.chunk_id, str(abs(round(x.distance, 6))), x.vector_rank) for x in df.collect())


def sample(n, width=8, seed=3):
    """Vectors with exact and near copies, zeros and one that is no number."""
    random = np.random.default_rng(seed)
    v = random.integers(-2, 3, (n, width)).astype(float)
    v[n // 2 : n // 2 + n // 5] = v[0]
    v[-n // 10 :] = v[: n // 10] + 1e-7 * random.normal(size=(n // 10, width))
    v[3] = 0
    v[n // 3] = np.nan
    return [(int(i), list(map(float, x))) for i, x in zip(random.permutation(n), v)]


@pytest.mark.parametrize("small", [False, True])
def test_search_equals_all_pairs(spark, monkeypatch, small):
    vectors = sample(400)
    if small:
        for name, value in {"QUERIES": 3, "POINTS": 7, "PAIRS": 5, "QUERY_BLOCK_BYTES": 1200, "TOGETHER": 3}.items():
            monkeypatch.setattr(r, name, value)
    table = spark.createDataFrame(vectors + [(None, [1.0] * 8), (9999, None)], "chunk_id long, embedding array<double>").repartition(3)
    asked = table.where("chunk_id % 9 = 0").withColumnRenamed("chunk_id", "query_id")
    want = plain(vectors, [x for x in vectors if x[0] % 9 == 0], 5)
    assert rows(r.vector_topk(table, asked, 5)) == want
    keyed = lambda df: df.withColumn("key", F.array_join(F.transform("embedding", lambda x: x.cast("string")), ","))
    assert rows(r.different_topk(keyed(table), keyed(asked), 5)) == want
    named = table.withColumn("chunk_id", F.concat(F.lit("n"), F.col("chunk_id").cast("string")))
    assert rows(r.vector_topk(named, asked, 3)) == plain([(f"n{i}", v) for i, v in vectors], [x for x in vectors if x[0] % 9 == 0], 3)
    assert r.different_topk(keyed(table), keyed(asked).limit(0), 5).count() == r.different_topk(keyed(table).limit(0), keyed(asked), 5).count() == 0


def test_repeated_ids_stay(spark):
    table = spark.createDataFrame([(1, [1.0, 0.0], "a"), (1, [1.0, 0.0], "a"), (1, [0.0, 1.0], "b"), (2, [1.0, 0.0], "a")], "chunk_id long, embedding array<double>, key string")
    asked = table.where("key = 'a'").withColumnRenamed("chunk_id", "query_id").dropDuplicates(["query_id"])
    assert rows(r.different_topk(table, asked, 3)) == rows(r.vector_topk(table, asked, 3)) == sorted((q, i, "0.0", n) for q in (1, 2) for n, i in enumerate((1, 1, 2), 1))
    all_of = table.withColumnRenamed("chunk_id", "query_id")
    assert rows(r.different_topk(table, all_of, 5)) == rows(r.vector_topk(table, all_of, 5))


def test_a_task_gives_the_best_of_all_its_batches():
    """Before, each batch gave its k best of every query, so the rows shuffled grew with all pairs, and each pair was sorted."""
    random = np.random.default_rng(5)
    points = random.normal(size=(6000, 16)).astype(np.float32)
    listed = lambda m: pa.array(list(m), pa.list_(pa.float32()))
    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, i + 500)), listed(points[i : i + 500])], names=["chunk_id", "embedding"]) for i in range(0, 6000, 500)]
    block = pa.table({"query_id": pa.array(range(40)), "embedding": listed(points[:40])})
    calls = []
    exact = np.einsum

    def counted(form, a, b):
        calls.append(len(a))
        return exact(form, a, b)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(np, "einsum", counted)
        found = pa.Table.from_batches(list(r._nearest(block, 10, iter(batches))))
    assert found.num_rows == 400
    # of 240,000 pairs
    assert 400 <= sum(calls) < 24_000
    distance = np.round(1 - unit(points[:40]) @ unit(points).T, r.DIGITS)
    want = {(q, int(i)) for q in range(40) for i in np.argsort(distance[q], kind="stable")[:10]}
    assert set(zip(found.column("query_id").to_pylist(), found.column("chunk_id").to_pylist())) == want


def test_copies_are_searched_once(spark, monkeypatch):
    seen = []
    search = r.vector_topk
    monkeypatch.setattr(r, "vector_topk", lambda vectors, queries, k, **more: seen.append((vectors.count(), queries.count())) or search(vectors, queries, k, **more))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text")
    docs = docs.unionByName(docs.limit(50).withColumns({"chunk_id": F.col("chunk_id") + 1000, "text": F.lit("the same words")})).collect()
    table = e.feature_embeddings(spark.createDataFrame(docs, "chunk_id long, text string"), digest="key").cache()
    asked = table.where("chunk_id % 5 = 0").withColumnRenamed("chunk_id", "query_id")
    vectors = [(x.chunk_id, x.embedding) for x in table.collect()]
    assert rows(r.different_topk(table, asked, 15)) == plain(vectors, [x for x in vectors if x[0] % 5 == 0], 15)
    different = {tuple(v) for _, v in vectors}
    assert len(different) <= seen[0][0] <= len(vectors) - 49 and seen[0][1] < sum(x % 5 == 0 for x, _ in vectors)


def test_embedded_search_equals_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text")
    vectors = [(x.chunk_id, x.embedding) for x in e.feature_embeddings(docs).collect()]
    found = embedding_queries.embedded_search(spark, "/root/testdata/sf0.001")
    assert rows(found) == plain(vectors, [x for x in vectors if x[0] % 50 == 0], embedding_queries.N)
    assert found.dtypes == [("query_id", "bigint"), ("chunk_id", "bigint"), ("distance", "double"), ("vector_rank", "bigint")]


def test_words_with_spaces_are_the_words(spark):
    texts = ["", " ", "a", "-a-", "Ab,cD  x_1\n9", "Äpfel·日本 ½ é İI ß ſ", "\U0001d400\U0001f600x", "١٢٣ a\u0000b"]
    got = spark.createDataFrame([(x,) for x in texts], "x string").select(t.words(F.col("x")).alias("w"), t.spaced_words(F.col("x")).alias("s")).collect()
    assert all([w for w in x.s.split(" ") if w] == x.w for x in got) and sum(len(x.w) for x in got) > 12
    tokens = sorted({w for x in got for w in x.w})
    for width in (256, 7, 1):
        place, sign = e.token_places(pa.array(tokens), width)
        assert [(int(p), int(s)) for p, s in zip(place, sign)] == [e.token_place(w, width) for w in tokens]
    assert [len(x) for x in e.token_places(pa.array([], pa.string()))] == [0, 0] and e.token_places(pa.array([""]))[1].tolist() == [0]
