"""Queries of hashed embeddings, the merged chunk table and the alignment re-ranker, with their DuckDB equivalents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.operators import embedding as e
from corpusloom.operators import retrieval as r
from corpusloom.plans.retrieval_queries import _LEGS, _WORDS, N, _corpus, _queries, _rrf, _vectors
from corpusloom.sources.staging import shared_folder, staged
from corpusloom.sources.tables import read_table


def _digest(counts: str):
    return F.sha2(F.array_join(F.transform(F.col(counts), lambda x: x.cast("string")), ","), 256)


def feature_embeddings(spark, sf_dir):
    """The signed counts and the squared length that the vector is divided by."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    squares = F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x * x)
    return e.hashed_counts(docs).select("doc_id", squares.alias("squared_length"), _digest("counts").alias("counts_sha256"))


FEATURE_EMBEDDINGS = f"""WITH w AS (SELECT doc_id, unnest({_WORDS}) AS w FROM documents), k AS (
  SELECT doc_id, ('0x' || left(md5(w), 8))::BIGINT % {e.WIDTH} AS b, CASE WHEN ('0x' || substr(md5(w), 9, 1))::BIGINT % 2 = 1 THEN 1 ELSE -1 END AS s FROM w
), c AS (SELECT doc_id, b, sum(s)::BIGINT AS n FROM k GROUP BY ALL),
g AS (SELECT doc_id, b, coalesce(n, 0) AS n FROM (SELECT doc_id, unnest(range({e.WIDTH})) AS b FROM documents) LEFT JOIN c USING (doc_id, b))
SELECT doc_id, CAST(sum(n * n) AS BIGINT) AS squared_length, sha256(string_agg(n, ',' ORDER BY b)) AS counts_sha256 FROM g GROUP BY doc_id"""


def embed_upsert(spark, sf_dir):
    """All documents, then newer versions of some, late versions of others, and the same delivery once more."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.lit(1).alias("version"), "source", "text")
    path = f"{shared_folder(spark)}/chunks-{uuid.uuid4().hex}"
    again = docs.where("chunk_id % 5 = 0").withColumns({"version": F.lit(3), "text": F.concat("text", F.lit(" mended"))})
    older = docs.where("chunk_id % 3 = 0").withColumns({"version": F.lit(0), "text": F.lit("late")})
    between = docs.where("chunk_id % 10 = 0").withColumns({"version": F.lit(2), "text": F.lit("superseded")})
    applied = [e.merge_chunks(rows, path) for rows in (docs, again.unionByName(older).unionByName(between), again)]
    stored = spark.read.parquet(path)
    counts = F.lit(",".join(map(str, applied)))
    return stored.select("chunk_id", "version", "source", F.md5("text").alias("text_md5"), (F.size("embedding") == e.WIDTH).alias("embedded"), counts.alias("applied"))


EMBED_UPSERT = """SELECT doc_id AS chunk_id, CASE WHEN doc_id % 5 = 0 THEN 3 ELSE 1 END AS version, source, md5(text || CASE WHEN doc_id % 5 = 0 THEN ' mended' ELSE '' END) AS text_md5, true AS embedded,
  (SELECT count(*) || ',' || count(*) FILTER (doc_id % 5 = 0) || ',0' FROM documents) AS applied FROM documents"""


def aligned_rerank(spark, sf_dir):
    """The whole pipeline with the alignment as its re-ranker."""
    found = r.search(_corpus(spark, sf_dir), _vectors(spark, sf_dir), _queries(spark, sf_dir), scorer=e.alignment_scorer)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "cross_score", "rrf_score")


_WORDS_OF = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
ALIGNED_RERANK = f"""{_LEGS}, fu AS ({_rrf('1.0', '1.0', 'WHERE rrf_rank <= 15')}),
c AS (SELECT fu.*, {_WORDS_OF.format('b.text')} AS q, {_WORDS_OF.format('d.text')} AS w FROM fu JOIN documents AS d ON d.doc_id = chunk_id JOIN benchmark AS b ON b.item_id = query_id),
p AS (SELECT query_id, chunk_id, unnest(range(1, len(q))) AS i FROM c WHERE len(q) > 1),
t AS (SELECT query_id, chunk_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM c),
f AS (SELECT p.query_id, p.chunk_id, i, j, word = q[i] AS here, word = q[i + 1] AS next FROM p JOIN c USING (query_id, chunk_id) JOIN t USING (query_id, chunk_id) WHERE word = q[i] OR word = q[i + 1]),
l AS (SELECT *, max(CASE WHEN here THEN j END) OVER (PARTITION BY query_id, chunk_id, i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM f),
g AS (SELECT query_id, chunk_id, i, min(j - last) AS gap FROM l WHERE next AND last IS NOT NULL GROUP BY ALL),
s AS (SELECT query_id, chunk_id, count(*) AS n, sum(1.0::DOUBLE / gap) AS near FROM g GROUP BY ALL),
x AS (SELECT c.query_id, c.chunk_id, rrf_score, rrf_rank, round(CASE WHEN len(q) = 0 THEN 0 ELSE len(list_filter(q, lambda y: list_contains(w, y))) / len(q) + CASE WHEN len(q) > 1 THEN (0.5 * coalesce(n, 0) + 0.5 * coalesce(near, 0)) / (len(q) - 1) ELSE 0 END END, 6) AS cross_score
  FROM c LEFT JOIN s USING (query_id, chunk_id))
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY cross_score DESC, rrf_rank) AS rank, chunk_id, cross_score, rrf_score FROM x) WHERE rank <= {r.TOP_K}"""


def embedded_search(spark, sf_dir):
    """Every document whose id is divisible by 50 against all of them, by hashed embeddings."""
    docs = staged(e.feature_embeddings(_corpus(spark, sf_dir).select("chunk_id", "text"), digest="key").select("chunk_id", "embedding", "key"), "embedded")
    queries = docs.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "embedding", "key")
    return r.different_topk(docs, queries, N).withColumn("vector_rank", F.col("vector_rank").cast("long"))


QUERIES = {
    "feature_embeddings": (feature_embeddings, FEATURE_EMBEDDINGS),
    "embed_upsert": (embed_upsert, EMBED_UPSERT),
    "aligned_rerank": (aligned_rerank, ALIGNED_RERANK),
    "embedded_search": (embedded_search, None),
}
