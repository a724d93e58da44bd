"""Queries of the contract rules, checked retrieval, review texts and the listing order, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as t
from corpusloom.operators import atoms, lifecycle
from corpusloom.operators import metrics as m
from corpusloom.operators import quality as q
from corpusloom.operators import retrieval as r
from corpusloom.plans.evaluation_queries import _ATOMS, _atoms
from corpusloom.plans.retrieval_queries import _LEGS, SIGNALS, _bm25, _corpus, _queries, _rrf, _vectors, signals
from corpusloom.sources.tables import read_table


def retrieval_contracts(spark, sf_dir):
    """V2, V3: a retrieval answer a document, its lines as results; rules on the ids break some of them."""
    i = F.col("doc_id")
    lines = F.split("text", "\n")
    rank = lambda at: F.when((i % 7 == 0) & (at == 1), 9).otherwise(at + 1)
    results = F.transform(lines, lambda x, at: F.struct(rank(at).alias("rank"), x.alias("text")))
    rows = read_table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(i % 11 == 0, "1.0").otherwise("2.0").alias("contract_version"),
        F.when(i % 13 == 0, 3).otherwise(5).alias("top_k"),
        F.when(i % 17 == 0, "bm25").otherwise("cross_encoder").alias("score_type"),
        F.when(i % 5 == 0, "no_results").when(i % 19 == 0, "lost").when(i % 4 == 0, "error").otherwise("success").alias("status"),
        F.when((i % 10 == 0) | (i % 4 == 0), F.filter(results, lambda x: F.lit(False))).otherwise(results).alias("results"),
        F.when((i % 4 == 0) & (i % 3 != 0), F.lit("failed")).alias("error"),
    )
    return q.violations(rows, "doc_id", q.retrieval_rules()).select("doc_id", F.array_join("violations", ",").alias("violations"))


RETRIEVAL_CONTRACTS = """WITH d AS (SELECT doc_id AS i, CASE WHEN doc_id % 10 = 0 OR doc_id % 4 = 0 THEN 0 ELSE len(string_split(text, chr(10))) END AS n,
  CASE WHEN doc_id % 5 = 0 THEN 'no_results' WHEN doc_id % 19 = 0 THEN 'lost' WHEN doc_id % 4 = 0 THEN 'error' ELSE 'success' END AS status FROM documents),
v AS (SELECT i AS doc_id, concat_ws(',', CASE WHEN i % 11 = 0 THEN 'version' END, CASE WHEN i % 13 = 0 THEN 'top_k' END, CASE WHEN i % 17 = 0 THEN 'score_type' END, CASE WHEN status = 'lost' THEN 'status' END,
  CASE WHEN (status = 'success') <> (n > 0) THEN 'results' END, CASE WHEN (status = 'error') <> (i % 4 = 0 AND i % 3 <> 0) THEN 'error' END, CASE WHEN i % 7 = 0 AND n > 1 THEN 'rank' END) AS violations FROM d)
SELECT * FROM v WHERE violations <> ''"""


def format_evidence(spark, sf_dir):
    """A generated format a document with its lines as evidence; rules on the ids break some of them."""
    i = F.col("doc_id")
    name = lambda at: F.when((i % 6 == 0) & (at == 1), 0).otherwise(at)
    rank = lambda at: F.when((i % 10 == 0) & (at == 2), 2).otherwise(at + 1)
    chunk = lambda x, at: F.struct(F.concat(F.lit("c"), name(at)).alias("chunk_id"), F.when((i % 14 == 0) & (at == 0), "other").otherwise(F.col("source")).alias("document_id"), rank(at).alias("rank"))
    rows = read_table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("source").alias("document_id"),
        F.when(i % 3 == 0, "processing").when(i % 3 == 1, "success").otherwise("failed").alias("status"),
        F.when((i % 3 == 1) & (i % 4 != 0) | (i % 9 == 0), F.col("lang")).alias("content"),
        F.when((i % 3 == 0) & (i % 15 != 0) | (i % 22 == 0), F.array().cast("array<struct<chunk_id:string,document_id:string,rank:int>>")).otherwise(F.transform(F.split("text", "\n"), chunk)).alias("chunks"),
        F.when(i % 21 == 0, "late").alias("error_message"),
    )
    return q.violations(rows, "doc_id", q.format_rules() | q.evidence_rules()).select("doc_id", F.array_join("violations", ",").alias("violations"))


FORMAT_EVIDENCE = """WITH d AS (SELECT doc_id AS i, CASE WHEN doc_id % 3 = 0 AND doc_id % 15 <> 0 OR doc_id % 22 = 0 THEN 0 ELSE len(string_split(text, chr(10))) END AS n, doc_id % 3 = 1 AND doc_id % 4 <> 0 OR doc_id % 9 = 0 AS content FROM documents),
v AS (SELECT i AS doc_id, concat_ws(',', CASE WHEN i % 3 = 0 AND (content OR n > 0 OR i % 21 = 0) THEN 'processing' END, CASE WHEN i % 3 = 1 AND NOT (content AND n > 0) THEN 'success' END,
  CASE WHEN i % 6 = 0 AND n > 1 THEN 'chunk_ids' END, CASE WHEN i % 10 = 0 AND n > 2 THEN 'ranks' END, CASE WHEN i % 14 = 0 AND n > 0 THEN 'documents' END) AS violations FROM d)
SELECT * FROM v WHERE violations <> ''"""


def checked_retrieve(spark, sf_dir):
    """The pipeline within the chunks of one document, whose statistics it uses."""
    corpus = _corpus(spark, sf_dir).withColumn("document_id", F.col("source"))
    vectors = _vectors(spark, sf_dir).join(corpus.select("chunk_id", "document_id"), "chunk_id")
    found = r.retrieve(corpus, vectors, _queries(spark, sf_dir), document_id="src0")
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "cross_score", "rrf_score")


_WITHIN = "WITH docs AS (SELECT * FROM documents WHERE source = 'src0'), vecs AS (SELECT e.* FROM embeddings AS e JOIN docs ON vec_id = doc_id),"
CHECKED_RETRIEVE = f"""{_WITHIN}{_LEGS.removeprefix('WITH').replace('FROM documents', 'FROM docs').replace('CROSS JOIN embeddings', 'CROSS JOIN vecs')}, fu AS ({_rrf('1.0', '1.0', 'WHERE rrf_rank <= 15')})
SELECT query_id, rank, chunk_id, cross_score, rrf_score FROM (
  SELECT query_id, chunk_id, CAST(length(text) AS DOUBLE) AS cross_score, rrf_score, row_number() OVER (PARTITION BY query_id ORDER BY length(text) DESC, rrf_rank) AS rank FROM fu JOIN docs ON doc_id = chunk_id) WHERE rank <= 5"""


def review_texts(spark, sf_dir):
    """What a revision is told, and the manifest of claims that people review, with all their columns."""
    rows = read_table(spark, sf_dir, "labels").join(read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id").select(
        "doc_id",
        F.when(F.col("quality") == 0, "rejected").when(F.col("toxic") == 1, "requires_revision").otherwise("approved").alias("verdict"),
        F.expr("if(doc_id % 2 = 0, array(concat('observed in ', lang)), array())").alias("observations"),
        F.array(F.concat(F.lit("rewrite "), "source")).alias("recommendations"),
        F.expr("if(toxic = 1, array('claim of ' || source), null)").alias("unsupported"),
        F.when(F.col("quality") == 1, "supported").when(F.col("lang") == "en", "unsupported").otherwise("unclear").alias("human"),
        (F.col("doc_id") % 3 == 0).alias("needs_review"),
    )
    lists = [F.coalesce(c, F.array().cast("array<string>")) for c in ("observations", "recommendations", "unsupported")]
    told = q.revision_feedback(rows).select("doc_id", F.lit("feedback").alias("part"), "verdict", F.array_join(F.concat(*lists), "; ").alias("said"))
    listed = q.review_manifest(rows).select("doc_id", F.lit("manifest").alias("part"), "verdict", F.col("human").alias("said"))
    return told.unionByName(listed)


REVIEW_TEXTS = """WITH x AS (SELECT l.doc_id, toxic, lang, source, CASE WHEN quality = 0 THEN 'rejected' WHEN toxic = 1 THEN 'requires_revision' ELSE 'approved' END AS verdict, CASE WHEN quality = 1 THEN 'supported' WHEN lang = 'en' THEN 'unsupported' ELSE 'unclear' END AS human
  FROM labels AS l JOIN documents USING (doc_id))
SELECT doc_id, 'feedback' AS part, verdict, concat_ws('; ', CASE WHEN doc_id % 2 = 0 THEN 'observed in ' || lang END, 'rewrite ' || source, CASE WHEN toxic = 1 THEN 'claim of ' || source END) AS said FROM x WHERE verdict <> 'approved'
UNION ALL SELECT doc_id, 'manifest', verdict, human FROM x WHERE doc_id % 3 = 0 AND human <> 'unclear'"""


def listing_order(spark, sf_dir):
    """All orders from the newest, numbered in ranges."""
    orders = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_orderdate").alias("created_at"))
    return lifecycle.placed_newest_first(orders).select("document_id", "place")


LISTING_ORDER = "SELECT o_orderkey AS document_id, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders"


RUNS = ["vector", "bm25", "rrf", "cross"]


def run_comparison(spark, sf_dir):
    """The first five results of each signal as runs; a result is right if its label is that of the query's vector."""
    labels = _vectors(spark, sf_dir).select("chunk_id", "label")
    found = signals(spark, sf_dir).join(labels, "chunk_id", "left").join(labels.withColumnsRenamed({"chunk_id": "query_id", "label": "wanted"}), "query_id")
    right = F.coalesce((F.col("label") == F.col("wanted")).cast("int"), F.lit(0))
    return m.compare_runs(found.groupBy(F.col("query_id").alias("case_id"), F.col("signal").alias("run")).agg((F.sum(right) / 5).alias("value")), RUNS)


RUN_COMPARISON = f"""WITH s AS ({SIGNALS}),
v AS (SELECT query_id, signal, count(*) FILTER (e.label = w.label) / 5 AS value FROM s LEFT JOIN embeddings AS e ON e.vec_id = chunk_id JOIN embeddings AS w ON w.vec_id = query_id GROUP BY ALL),
f AS (SELECT v.*, b.value AS base FROM v LEFT JOIN v AS b ON b.query_id = v.query_id AND b.signal = 'vector'),
r AS (SELECT signal AS run, avg(value) AS mean, count(*) AS cases, count(*) FILTER (value = 0) AS zero_cases, count(*) FILTER (value > base) AS better, count(*) FILTER (value < base) AS worse, list_position(['vector', 'bm25', 'rrf', 'cross'], signal) AS place FROM f GROUP BY signal)
SELECT run, round(mean, 6) AS mean, cases, zero_cases, better, worse, round(mean - first_value(mean) OVER (ORDER BY place), 6) AS delta_first, round(mean - coalesce(lag(mean) OVER (ORDER BY place), mean), 6) AS delta_previous FROM r"""


def atom_versions(spark, sf_dir):
    """H4: three versions of predictions, of which the later miss fewer cases."""
    truth, predicted = _atoms(spark, sf_dir)
    versions = [predicted.where(f"case_id % {n} <> 0").withColumn("version", F.lit(name)) for name, n in (("v1", 3), ("v2", 7), ("v3", 101))]
    return atoms.version_scores(truth, versions[0].unionByName(versions[1]).unionByName(versions[2]), ["v1", "v2", "v3"]).select("version", "cases", "detection_coverage", "class_accuracy", "count_accuracy", "exact_structure_accuracy")


_VERSION = "SELECT '{0}' AS version, count(*) AS cases, round(count(ps) FILTER (case_id % {1} <> 0) / count(*), 6) AS detection_coverage, round(count(*) FILTER (status = 'valid' AND cl = pc AND case_id % {1} <> 0) / count(*) FILTER (status = 'valid'), 6) AS class_accuracy, round(count(*) FILTER (status = 'valid' AND n = pn AND case_id % {1} <> 0) / count(*) FILTER (status = 'valid'), 6) AS count_accuracy, round(count(*) FILTER (status = 'valid' AND n = pn AND cl = pc AND types = pt AND case_id % {1} <> 0) / count(*) FILTER (status = 'valid'), 6) AS exact_structure_accuracy FROM k"
ATOM_VERSIONS = f"{_ATOMS} " + " UNION ALL ".join(_VERSION.format(*v) for v in (("v1", 3), ("v2", 7), ("v3", 101)))


def case_rows(spark, sf_dir):
    """The first five of the BM25 leg for each item; its evidence are its words of more than six letters, its text is expected."""
    items = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("case_id"), F.col("text").alias("expected"))
    cases = items.withColumn("keywords", F.array_distinct(F.filter(t.plain_words(F.col("expected")), lambda w: F.length(w) > 6)))
    corpus = _corpus(spark, sf_dir).select("chunk_id", "text")
    hits = r.bm25_topk(corpus, items.select(F.col("case_id").alias("query_id"), F.col("expected").alias("text")), r.TOP_K)
    results = r.with_texts(hits.select(F.col("query_id").alias("case_id"), F.col("bm25_rank").alias("rank"), "chunk_id", "score"), corpus)
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    found = m.case_rows(cases, results)
    return found.select("case_id", "coverage", "hit", "token_recall", joined("chunk_ids").alias("chunk_ids"), F.size("scores").alias("n_scores"), F.round(F.aggregate("scores", F.lit(0.0), lambda s, x: s + x), 4).alias("score_sum"))


_PLAIN = r"regexp_extract_all(strip_accents(lower({})), '[\p{{L}}\p{{N}}_]+')"
_FLAT = r"regexp_replace(strip_accents(lower({})), '\s+', ' ', 'g')"
CASE_ROWS = rf"""WITH {_bm25('0')}, h AS (SELECT query_id, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY bm25_rank) AS ids, count(*) AS n, round(sum(round(score, 4)), 4) AS total, string_agg(text, chr(10) ORDER BY bm25_rank) AS got FROM bm JOIN documents ON doc_id = chunk_id WHERE bm25_rank <= 5 GROUP BY query_id),
c AS (SELECT item_id AS case_id, list_distinct(list_filter({_PLAIN.format('text')}, lambda x: length(x) > 6)) AS k, list_distinct({_PLAIN.format('text')}) AS a, coalesce(got, '') AS got, ids, n, total FROM benchmark LEFT JOIN h ON query_id = item_id),
e AS (SELECT *, {_FLAT.format('got')} AS flat, {_PLAIN.format('got')} AS b FROM c),
f AS (SELECT *, CASE WHEN len(k) > 0 THEN len(list_filter(k, lambda x: contains(flat, x))) / len(k) ELSE 0 END AS cov FROM e)
SELECT case_id, round(cov, 6) AS coverage, cov >= 0.5 AS hit, CASE WHEN len(a) > 0 THEN round(len(list_intersect(a, b)) / len(a), 6) ELSE 0 END AS token_recall, coalesce(ids, '') AS chunk_ids, CAST(coalesce(n, 0) AS INT) AS n_scores, coalesce(total, 0) AS score_sum FROM f"""


QUERIES = {
    "case_rows": (case_rows, CASE_ROWS),
    "run_comparison": (run_comparison, RUN_COMPARISON),
    "atom_versions": (atom_versions, ATOM_VERSIONS),
    "retrieval_contracts": (retrieval_contracts, RETRIEVAL_CONTRACTS),
    "format_evidence": (format_evidence, FORMAT_EVIDENCE),
    "checked_retrieve": (checked_retrieve, CHECKED_RETRIEVE),
    "review_texts": (review_texts, REVIEW_TEXTS),
    "listing_order": (listing_order, LISTING_ORDER),
}
