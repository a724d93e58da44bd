"""Queries of dataset construction (I) and lifecycle (J) with their DuckDB equivalents.

Events stand for a log of format attempts: a user is a document, the kind of event the state of an attempt.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as t
from corpusloom.operators import datasets as d
from corpusloom.operators import lifecycle as l
from corpusloom.sources.tables import read_table

SEED = "s1"
_RANK = "sha256('s1|' || CAST(doc_id AS VARCHAR))"


def _docs(spark, sf_dir, *columns):
    return read_table(spark, sf_dir, "documents").select(*columns)


_KEY = r"trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '\s+', ' ', 'g'), '[^\p{L}\p{N}_\s]', '', 'g'))"


def exact_dedupe(spark, sf_dir):
    rows = _docs(spark, sf_dir, "doc_id", "text", "source")
    return d.first_of_each(rows, t.dedup_key(F.col("text")), ["doc_id"]).select("doc_id", "source", "copies")


EXACT_DEDUPE = f"SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, count(*) AS copies FROM (SELECT *, {_KEY} AS k FROM documents) WHERE k <> '' GROUP BY k"


def dup_groups(spark, sf_dir):
    """The documents that share their normalised text."""
    found = d.repeated_texts(_docs(spark, sf_dir, "doc_id", "text"), t.overlap_key(F.col("text")), "doc_id")
    return found.select(F.sha2("norm", 256).alias("norm_sha256"), "n", F.col("id").alias("doc_id"))


DUP_GROUPS = r"""SELECT sha256(k) AS norm_sha256, count(*) OVER (PARTITION BY k) AS n, doc_id FROM (
  SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(text), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), '\s+([,.;:!?])', '\1', 'g') AS k FROM documents) QUALIFY n > 1"""


def _sentences(spark, sf_dir, name, key):
    rows = read_table(spark, sf_dir, name).select(key, F.explode(t.split_claims(F.col("text"))).alias("s"))
    return rows.select(key, t.overlap_key(F.col("s")).alias("norm"))


_SENT = r"""SELECT {key}, regexp_replace(trim(lower(s)), '\s+([,.;:!?])', '\1', 'g') AS norm FROM (SELECT {key}, unnest(list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')) AS s FROM {table})"""


def overlap_audit(spark, sf_dir):
    return d.overlap_audit(_sentences(spark, sf_dir, "documents", "doc_id"), _sentences(spark, sf_dir, "benchmark", "item_id"), "norm")


OVERLAP_AUDIT = f"""WITH a AS (SELECT norm, count(*) AS n FROM ({_SENT.format(key='doc_id', table='documents')}) GROUP BY norm), b AS (SELECT DISTINCT norm FROM ({_SENT.format(key='item_id', table='benchmark')}))
SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_keys, CAST(sum(n - 1) AS BIGINT) AS repeated, count(b.norm) AS overlapping, CASE WHEN sum(n - 1) = 0 AND count(b.norm) = 0 THEN 'pass' ELSE 'review' END AS status FROM a LEFT JOIN b ON a.norm = b.norm"""


def overlap_split(spark, sf_dir):
    """Documents with a sentence of the benchmark, and those without."""
    used = d.union_keys([_sentences(spark, sf_dir, "benchmark", "item_id"), _sentences(spark, sf_dir, "benchmark", "item_id")], "norm")
    clean, dirty = d.without_overlap(_sentences(spark, sf_dir, "documents", "doc_id"), used, "norm")
    hit = dirty.select("doc_id").distinct().withColumn("overlap", F.lit(True))
    return hit.unionByName(clean.select("doc_id").distinct().join(hit, "doc_id", "left_anti").withColumn("overlap", F.lit(False)))


OVERLAP_SPLIT = f"SELECT doc_id, bool_or(norm IN (SELECT norm FROM ({_SENT.format(key='item_id', table='benchmark')}))) AS overlap FROM ({_SENT.format(key='doc_id', table='documents')}) GROUP BY doc_id"


def stratified_sample(spark, sf_dir):
    return d.stratified_sample(_docs(spark, sf_dir, "doc_id", "lang"), "lang", "doc_id", 20, SEED).withColumn("pick", F.col("pick").cast("long"))


STRATIFIED_SAMPLE = f"SELECT * FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_RANK}, doc_id) AS pick FROM documents) WHERE pick <= 20"


def round_robin_sample(spark, sf_dir):
    found = d.round_robin_sample(_docs(spark, sf_dir, "doc_id", "lang", "source"), "lang", "source", "doc_id", 37, SEED)
    return found.select("doc_id", "lang", "source", F.col("pick").cast("long").alias("pick"))


ROUND_ROBIN_SAMPLE = f"""SELECT doc_id, lang, source, pick FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY turn, source) AS pick FROM (
  SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY {_RANK}, doc_id) AS turn FROM documents)) WHERE pick <= 37"""


def balanced_deficit(spark, sf_dir):
    """What each source lacks to a target, and the replacements that are drawn for it."""
    labels = read_table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    docs = _docs(spark, sf_dir, "doc_id", "source")
    counts = docs.join(labels, "doc_id", "left_semi").groupBy("source").agg(F.count("*").alias("n"))
    need = d.target_balance(counts, 20)
    unused = docs.join(read_table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").join(need.select("source", "deficit"), "source")
    drawn = d.stratified_sample(unused, "source", "doc_id", F.col("deficit"), SEED).groupBy("source").agg(F.count("*").alias("drawn"), F.sum("doc_id").alias("drawn_sum"))
    return need.join(drawn, "source", "left").na.fill(0, ["drawn", "drawn_sum"]).select("source", "n", F.col("deficit").cast("long").alias("deficit"), F.col("surplus").cast("long").alias("surplus"), "drawn", "drawn_sum")


BALANCED_DEFICIT = f"""WITH c AS (SELECT source, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY source), b AS (SELECT *, greatest(0, 20 - n) AS deficit, greatest(0, n - 20) AS surplus FROM c),
u AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY {_RANK}, doc_id) AS pick FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)), r AS (SELECT source, count(*) AS drawn, CAST(sum(doc_id) AS BIGINT) AS drawn_sum FROM u JOIN b USING (source) WHERE pick <= deficit GROUP BY source)
SELECT b.source, n, deficit, surplus, coalesce(drawn, 0) AS drawn, coalesce(drawn_sum, 0) AS drawn_sum FROM b LEFT JOIN r USING (source)"""


def partition_integrity(spark, sf_dir):
    """I16, H18 on parts that overlap and miss rows by rule."""
    docs = _docs(spark, sf_dir, "doc_id")
    parts = {"dev": docs.where("doc_id % 3 = 0"), "test": docs.where("doc_id % 3 = 1 or doc_id % 50 = 0"), "extra": docs.where("doc_id % 97 = 0").select((-F.col("doc_id") - 1).alias("doc_id"))}
    return d.partition_integrity(docs, parts, "doc_id")


PARTITION_INTEGRITY = """SELECT doc_id, 'dev,test' AS part, 'in several parts' AS finding FROM documents WHERE doc_id % 3 = 0 AND doc_id % 50 = 0
UNION ALL SELECT doc_id, '', 'in no part' FROM documents WHERE NOT (doc_id % 3 = 0 OR doc_id % 3 = 1 OR doc_id % 50 = 0) UNION ALL SELECT -doc_id - 1, 'extra', 'not in the source' FROM documents WHERE doc_id % 97 = 0"""


def batch_export(spark, sf_dir):
    return d.batches(_docs(spark, sf_dir, "doc_id", "lang"), "lang", "doc_id", 20)


BATCH_EXPORT = "SELECT lang, batch, min(doc_id) AS first_id, max(doc_id) AS last_id, count(*) AS rows FROM (SELECT lang, doc_id, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 20 + 1 AS batch FROM documents) GROUP BY ALL"


def numbered_ids(spark, sf_dir):
    return d.numbered(_docs(spark, sf_dir, "doc_id", "source"), ["source", "doc_id"], "CAND-%06d").select("doc_id", "candidate_id")


NUMBERED_IDS = "SELECT doc_id, format('CAND-{:06d}', row_number() OVER (ORDER BY source, doc_id)) AS candidate_id FROM documents"


def build_manifest(spark, sf_dir):
    """Counts of the documents before and after their texts are made unique, and the parameters of the run."""
    raw = _docs(spark, sf_dir, "doc_id", "text", "lang", "source")
    final = d.first_of_each(raw, t.overlap_key(F.col("text")), ["doc_id"])
    return d.build_manifest(raw, final, ["lang", "source"], {"min_length": 8, "max_length": 600, "version": "v1"})


BUILD_MANIFEST = r"""WITH n AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(text), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), '\s+([,.;:!?])', '\1', 'g') AS k FROM documents),
f AS (SELECT * FROM n WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id) = 1),
v AS (SELECT 'lang' AS d, lang AS v, count(*) AS c FROM f GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM f GROUP BY source),
j AS (SELECT d, string_agg('"' || v || '":' || c, ',' ORDER BY v) AS o FROM v GROUP BY d)
SELECT (SELECT count(*) FROM documents) AS raw_count, (SELECT count(*) FROM f) AS final_count, (SELECT count(*) FROM documents) - (SELECT count(*) FROM f) AS duplicate_count,
  (SELECT '{' || string_agg('"' || d || '":{' || o || '}', ',' ORDER BY d) || '}' FROM j) AS counts, '{"max_length":600,"min_length":8,"version":"v1"}' AS run_config"""


def manifest_counts(spark, sf_dir):
    """Counts by dimension, and whether a quota is met."""
    return d.counts_by(_docs(spark, sf_dir, "lang", "source"), ["lang", "source"]).withColumn("quota_met", F.col("rows") == 50)


MANIFEST_COUNTS = "SELECT *, rows = 50 AS quota_met FROM (SELECT 'lang' AS dimension, lang AS value, count(*) AS rows FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source)"


def reference_check(spark, sf_dir):
    """Benchmark items that point to documents that do not exist."""
    truth = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("case_id"), F.array(F.col("item_id"), F.col("item_id") * 37, F.col("item_id") * 1000).alias("relevant"))
    return d.reference_check(truth, _docs(spark, sf_dir, F.col("doc_id").alias("chunk_id")))


REFERENCE_CHECK = "SELECT * FROM (SELECT item_id AS case_id, unnest([item_id, item_id * 37, item_id * 1000]) AS chunk_id FROM benchmark) WHERE chunk_id NOT IN (SELECT doc_id FROM documents)"

_STATES = {"signup": "processing", "error": "failed", "click": "success", "view": "success", "purchase": "processing"}


def _formats(spark, sf_dir):
    c = F.col
    return read_table(spark, sf_dir, "events").select(
        c("event_id").alias("format_id"), c("user_id").alias("document_id"), F.expr("element_at(array('quiz', 'flashcards', 'tldr', 'video_script'), cast(event_id % 4 as int) + 1)").alias("format_type"),
        F.expr("CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'success' WHEN 'view' THEN 'success' ELSE CASE WHEN user_id % 3 = 0 THEN 'processing' ELSE 'success' END END").alias("status"), c("ts").alias("created_at"),
        (c("ts") + F.expr("make_dt_interval(0, 0, cast(event_id % 90 as int), 0)")).alias("updated_at"), F.when((c("event_id") % 10 == 9) & (c("event_id") > 0), c("event_id") - 4).alias("revision_of"), F.lit(None).cast("string").alias("error_message"),
    )


_FORMATS = """WITH f AS (SELECT event_id AS format_id, user_id AS document_id, ['quiz', 'flashcards', 'tldr', 'video_script'][event_id % 4 + 1] AS format_type,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'success' WHEN 'view' THEN 'success' ELSE CASE WHEN user_id % 3 = 0 THEN 'processing' ELSE 'success' END END AS status, ts AS created_at, ts + to_minutes(CAST(event_id % 90 AS INT)) AS updated_at,
  CASE WHEN event_id % 10 = 9 AND event_id > 0 THEN event_id - 4 END AS revision_of FROM events),
cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, format_type ORDER BY CASE status WHEN 'processing' THEN 2 WHEN 'success' THEN 1 ELSE 0 END DESC, created_at DESC, updated_at DESC, format_id DESC) AS rn FROM f) WHERE rn = 1)"""


def current_version(spark, sf_dir):
    return l.current_formats(_formats(spark, sf_dir)).select("document_id", "format_type", "format_id", "status")


CURRENT_VERSION = f"{_FORMATS} SELECT document_id, format_type, format_id, status FROM cur"


def stable_version(spark, sf_dir):
    return l.stable_formats(_formats(spark, sf_dir)).select("document_id", "format_type", "format_id", "status")


STABLE_VERSION = f"{_FORMATS} SELECT document_id, format_type, format_id, status FROM (SELECT *, row_number() OVER (PARTITION BY document_id, format_type ORDER BY CASE status WHEN 'success' THEN 1 ELSE 0 END DESC, created_at DESC, updated_at DESC, format_id DESC) AS rn FROM f WHERE status <> 'processing') WHERE rn = 1"


def aggregate_status(spark, sf_dir):
    customers = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), F.when(F.col("c_acctbal") < 0, "failed").otherwise("stored").alias("status"))
    return l.aggregate_status(l.current_formats(_formats(spark, sf_dir)), customers)


AGGREGATE_STATUS = f"""{_FORMATS}, s AS (SELECT document_id, CASE WHEN bool_or(status = 'processing') THEN 'processing' WHEN NOT bool_or(status = 'success') THEN 'error' WHEN count(DISTINCT format_type) FILTER (status = 'success' AND format_type IN ('quiz', 'flashcards')) < 2 THEN 'partial'
  WHEN count(DISTINCT format_type) FILTER (status = 'success') <> count(DISTINCT format_type) THEN 'partial' ELSE 'ready' END AS state FROM cur GROUP BY document_id)
SELECT c_custkey AS document_id, coalesce(state, CASE WHEN c_acctbal < 0 THEN 'error' ELSE 'pending' END) AS state FROM customer LEFT JOIN s ON document_id = c_custkey"""


def revision_cycles(spark, sf_dir):
    evaluations = _formats(spark, sf_dir).where("format_id % 2 = 1").select((F.col("format_id") - F.col("format_id") % 5).alias("format_id"), F.col("format_id").alias("evaluation_id"), "created_at", F.col("status").alias("verdict"))
    return l.revision_cycles(_formats(spark, sf_dir), evaluations)


REVISION_CYCLES = f"""{_FORMATS}, e AS (SELECT format_id - format_id % 5 AS format_id, arg_max(status, (created_at, format_id)) AS verdict, count(*) AS n FROM f WHERE format_id % 2 = 1 GROUP BY 1),
r AS (SELECT revision_of, min(format_id) AS revision_id, count(*) AS revisions FROM f WHERE revision_of IS NOT NULL GROUP BY 1)
SELECT f.document_id, f.format_type, f.format_id, revision_id, coalesce(revisions, 0) AS revisions, coalesce(e2.verdict, e1.verdict) AS verdict, coalesce(e1.n, 0) + coalesce(e2.n, 0) AS evaluations
FROM f LEFT JOIN r ON r.revision_of = f.format_id LEFT JOIN e e1 ON e1.format_id = f.format_id LEFT JOIN e e2 ON e2.format_id = revision_id WHERE f.revision_of IS NULL"""


def revision_violations(spark, sf_dir):
    return l.revision_violations(_formats(spark, sf_dir))


REVISION_VIOLATIONS = f"""{_FORMATS}, v AS (SELECT f.format_id, CASE WHEN r.format_id IS NULL THEN 'orphan' WHEN r.document_id <> f.document_id OR r.format_type <> f.format_type THEN 'other document or type' WHEN r.status <> 'success' THEN 'root failed' END AS finding
  FROM f LEFT JOIN f r ON r.format_id = f.revision_of AND r.revision_of IS NULL WHERE f.revision_of IS NOT NULL)
SELECT * FROM v WHERE finding IS NOT NULL UNION ALL SELECT revision_of, 'several revisions' FROM f WHERE revision_of IS NOT NULL GROUP BY revision_of HAVING count(*) > 1"""

_CUTOFF = "timestamp '2024-01-15 00:00:00'"


def stale_rows(spark, sf_dir):
    """Stale revisions and the closed log."""
    formats, cutoff = _formats(spark, sf_dir), F.expr(_CUTOFF)
    stale = l.stale(formats, cutoff).select("format_id", F.lit(True).alias("stale"))
    closed = l.fail_stale(formats, cutoff, F.expr("timestamp '2024-02-01 00:00:00'"), "timed out")
    return closed.join(stale, "format_id", "left").groupBy("status", F.coalesce("stale", F.lit(False)).alias("stale"), "error_message").agg(F.count("*").alias("rows"), F.max("updated_at").cast("string").alias("newest"))


STALE_ROWS = f"""{_FORMATS}, c AS (SELECT *, coalesce(status = 'processing' AND revision_of IS NOT NULL AND updated_at <= {_CUTOFF}, false) AS stale FROM f)
SELECT CASE WHEN stale THEN 'failed' ELSE status END AS status, stale, CASE WHEN stale THEN 'timed out' END AS error_message, count(*) AS rows, CAST(max(CASE WHEN stale THEN timestamp '2024-02-01 00:00:00' ELSE updated_at END) AS VARCHAR) AS newest FROM c GROUP BY ALL"""


def state_machine_violations(spark, sf_dir):
    rows = read_table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.col("event_type").alias("state"))
    allowed = {"signup": ("view", "click"), "view": ("click", "purchase", "view"), "click": ("view", "purchase"), "error": ("signup", "view"), "purchase": ("view",)}
    return l.transition_violations(rows, "user_id", ["ts", "event_id"], allowed).select("event_id", "user_id", "previous", "state")


STATE_MACHINE_VIOLATIONS = """SELECT event_id, user_id, previous, state FROM (SELECT event_id, user_id, event_type AS state, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events)
WHERE previous IS NOT NULL AND NOT ((previous = 'signup' AND state IN ('view', 'click')) OR (previous = 'view' AND state IN ('click', 'purchase', 'view')) OR (previous = 'click' AND state IN ('view', 'purchase')) OR (previous = 'error' AND state IN ('signup', 'view')) OR (previous = 'purchase' AND state = 'view'))"""


def register(spark, sf_dir):
    """Documents by content, and first values that are not empty."""
    docs = _docs(spark, sf_dir, F.sha2("text", 256).alias("sha256"), F.col("doc_id").alias("document_id"), F.col("doc_id").alias("created_at"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("").alias("lang"), "source")
    first = l.first_values(docs, "sha256", ["created_at"], ["lang", "source"])
    return l.register(docs).join(first, "sha256")


REGISTER = """SELECT sha256(text) AS sha256, min(doc_id) AS document_id, min(doc_id) AS created_at, count(*) AS registrations, arg_min(CASE WHEN doc_id % 2 = 0 THEN lang END, doc_id) AS lang, arg_min(source, doc_id) AS source FROM documents GROUP BY text"""


def accept_updates(spark, sf_dir):
    """Late answers to revisions that are closed are rejected."""
    formats = _formats(spark, sf_dir)
    return l.accept_updates(formats, formats.select("format_id", F.lit("success").alias("new_status"))).select("format_id", "new_status")


ACCEPT_UPDATES = f"{_FORMATS} SELECT format_id, 'success' AS new_status FROM f WHERE revision_of IS NULL OR status = 'processing'"


def library_search(spark, sf_dir):
    rows = _docs(spark, sf_dir, "doc_id", "text", "lang", "source")
    return l.library_search(rows, "The And", ["text", "source", "lang"], F.col("lang").isin("en", "fr")).select("doc_id")


LIBRARY_SEARCH = "SELECT doc_id FROM documents WHERE lang IN ('en', 'fr') AND (contains(lower(text), 'the and') OR contains(lower(source), 'the and'))"


def timeline(spark, sf_dir):
    """Versions of each document's formats, in the requested order of types."""
    rows = l.timeline(_formats(spark, sf_dir), "document_id", ["created_at", "format_id"]).withColumnRenamed("format_type", "format")
    return l.in_requested_order(rows, F.array(F.lit("tldr"), F.lit("quiz"))).select("format_id", F.col("version").cast("long").alias("version"), F.col("place").cast("long").alias("place"))


TIMELINE = f"{_FORMATS} SELECT format_id, row_number() OVER (PARTITION BY document_id ORDER BY created_at, format_id) AS version, CASE format_type WHEN 'tldr' THEN 1 WHEN 'quiz' THEN 2 ELSE 2147483647 END AS place FROM f"


def package_json(spark, sf_dir):
    """One nested package a document of its stable formats."""
    from corpusloom.sources.sinks import packages

    return packages(l.stable_formats(_formats(spark, sf_dir))).select("document_id", "n_formats", F.md5("package").alias("package_md5"))


PACKAGE_JSON = f"""{_FORMATS}, s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, format_type ORDER BY CASE status WHEN 'success' THEN 1 ELSE 0 END DESC, created_at DESC, updated_at DESC, format_id DESC) AS rn FROM f WHERE status <> 'processing') WHERE rn = 1)
SELECT document_id, CAST(count(*) AS INT) AS n_formats, md5('{{"document_id":' || document_id || ',"formats":[' || string_agg('{{"format_type":"' || format_type || '","format_id":' || format_id || ',"status":"' || status || '"}}', ',' ORDER BY format_type) || ']}}') AS package_md5 FROM s GROUP BY document_id"""


def relational_smoke(spark, sf_dir):
    """Joins of every kind, grouping and top-k on the relational tables."""
    line = read_table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp '1999-12-31'")
    orders, customer, nation, region = (read_table(spark, sf_dir, n) for n in ("orders", "customer", "nation", "region"))
    revenue = line.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    rows = orders.join(revenue, orders.o_orderkey == revenue.l_orderkey, "left").join(customer, orders.o_custkey == customer.c_custkey).join(nation, customer.c_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey)
    return rows.groupBy("r_name", "n_name").agg(F.count("*").alias("orders"), F.round(F.coalesce(F.sum("revenue"), F.lit(0.0)), 2).alias("revenue"))


RELATIONAL_SMOKE = """WITH v AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem WHERE l_shipdate <= timestamp '1999-12-31' GROUP BY 1)
SELECT r_name, n_name, count(*) AS orders, round(coalesce(sum(revenue), 0), 2) AS revenue FROM orders LEFT JOIN v ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL"""


QUERIES = {
    "build_manifest": (build_manifest, BUILD_MANIFEST),
    "exact_dedupe": (exact_dedupe, EXACT_DEDUPE), "dup_groups": (dup_groups, DUP_GROUPS), "overlap_audit": (overlap_audit, OVERLAP_AUDIT), "overlap_split": (overlap_split, OVERLAP_SPLIT), "stratified_hash_sample": (stratified_sample, STRATIFIED_SAMPLE),
    "round_robin_sample": (round_robin_sample, ROUND_ROBIN_SAMPLE), "balanced_deficit": (balanced_deficit, BALANCED_DEFICIT), "partition_integrity": (partition_integrity, PARTITION_INTEGRITY), "batch_export": (batch_export, BATCH_EXPORT), "numbered_ids": (numbered_ids, NUMBERED_IDS),
    "manifest_counts": (manifest_counts, MANIFEST_COUNTS), "reference_check": (reference_check, REFERENCE_CHECK), "current_version": (current_version, CURRENT_VERSION), "stable_version": (stable_version, STABLE_VERSION), "aggregate_status": (aggregate_status, AGGREGATE_STATUS),
    "revision_cycles": (revision_cycles, REVISION_CYCLES), "revision_violations": (revision_violations, REVISION_VIOLATIONS), "stale_rows": (stale_rows, STALE_ROWS), "state_machine_violations": (state_machine_violations, STATE_MACHINE_VIOLATIONS), "register_documents": (register, REGISTER),
    "accept_updates": (accept_updates, ACCEPT_UPDATES), "library_search": (library_search, LIBRARY_SEARCH), "timeline": (timeline, TIMELINE), "package_json": (package_json, PACKAGE_JSON), "relational_smoke": (relational_smoke, RELATIONAL_SMOKE),
}
