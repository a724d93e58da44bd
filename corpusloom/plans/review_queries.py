"""Queries of error causes, batch outcomes, contracts of generated contents, support variants and reviews, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as t
from corpusloom.operators import atoms, chunking, datasets, failures, lifecycle
from corpusloom.operators import metrics as m
from corpusloom.operators import quality as q
from corpusloom.operators import retrieval as r
from corpusloom.plans.evaluation_queries import _SCORED, _SIG, _STATUS, _pairs, _stems
from corpusloom.plans.retrieval_queries import _DIAG
from corpusloom.sources.tables import read_table

_STATES = ("OK", "RESOURCE_EXHAUSTED", "unavailable", "DEADLINE_EXCEEDED", "INTERNAL", "OTHER")
_CODES = (429, 503, 504, 500, 502, 401, 403, 404, 400, 200)


def _failures(spark, sf_dir):
    """Each event as a failed call: its kind, upstream code and status by its id."""
    pick = lambda values, by: F.get(F.array(*map(F.lit, values)), F.pmod(by, F.lit(len(values))).cast("int"))
    i = F.col("event_id")
    return read_table(spark, sf_dir, "events").select(
        "event_id", "user_id", pick(("api", "api", "api", "output", "other"), i).alias("kind"), pick(("ReadTimeout", "ConnectError", "DeadlineExceeded", "KeyError"), i).alias("name"),
        pick((*_CODES, None), i).cast("int").alias("upstream"), pick(_STATES, F.floor(i / 50)).alias("state"), F.concat(F.lit("API key "), F.when(i % 3 == 0, "not valid").otherwise("ok")).alias("message"), "event_type",
    )


_FAILED = f"""WITH e AS (SELECT event_id, user_id, event_type, ['api', 'api', 'api', 'output', 'other'][event_id % 5 + 1] AS kind, ['readtimeout', 'connecterror', 'deadlineexceeded', 'keyerror'][event_id % 4 + 1] AS name,
  [{', '.join(map(str, _CODES))}, NULL][event_id % {len(_CODES) + 1} + 1] AS upstream, upper([{', '.join(f"'{s}'" for s in _STATES)}][(event_id // 50) % {len(_STATES)} + 1]) AS state, event_id % 3 = 0 AS bad FROM events),
c AS (SELECT *, CASE WHEN kind = 'output' THEN 'INVALID_MODEL_OUTPUT' WHEN kind = 'api' THEN CASE
    WHEN coalesce(upstream = 429, false) OR state = 'RESOURCE_EXHAUSTED' THEN 'RESOURCE_EXHAUSTED' WHEN coalesce(upstream = 503, false) OR state = 'UNAVAILABLE' THEN 'PROVIDER_UNAVAILABLE'
    WHEN coalesce(upstream = 504, false) OR state = 'DEADLINE_EXCEEDED' THEN 'PROVIDER_TIMEOUT' WHEN coalesce(upstream IN (500, 502), false) OR state = 'INTERNAL' THEN 'PROVIDER_ERROR'
    WHEN coalesce(upstream IN (401, 403), false) OR bad THEN 'PROVIDER_AUTH_ERROR' WHEN upstream = 404 THEN 'MODEL_NOT_FOUND' ELSE 'PROVIDER_REJECTED_REQUEST' END
  WHEN contains(name, 'timeout') OR name = 'deadlineexceeded' THEN 'PROVIDER_TIMEOUT' WHEN contains(name, 'connect') THEN 'PROVIDER_UNAVAILABLE' ELSE 'INTERNAL_ERROR' END AS code FROM e),
k AS (SELECT unnest([{', '.join(f"'{c[0]}'" for c in failures.CATALOGUE)}]) AS code, unnest([{', '.join(str(c[1]) for c in failures.CATALOGUE)}]) AS http, unnest([{', '.join(str(c[2]).lower() for c in failures.CATALOGUE)}]) AS retryable, unnest(range({len(failures.CATALOGUE)})) AS place)"""


def error_codes(spark, sf_dir):
    """F24."""
    rows = _failures(spark, sf_dir)
    code = failures.error_code(*map(F.col, ("kind", "name", "upstream", "state", "message")))
    return t.bind(rows, code=code).withColumn("e", failures.described(F.col("code"), F.col("message"), F.col("upstream"))).select("event_id", "e.code", "e.retryable", "e.http_status", "e.upstream_status")


ERROR_CODES = f"{_FAILED} SELECT event_id, code, retryable, http AS http_status, upstream AS upstream_status FROM c JOIN k USING (code)"


def batch_outcomes(spark, sf_dir):
    """Events of a user as a batch; purchases have succeeded."""
    code = failures.error_code(*map(F.col, ("kind", "name", "upstream", "state", "message")))
    units = _failures(spark, sf_dir).select("user_id", F.when((F.col("user_id") % 3 == 0) & (F.col("event_type") == "view") | (F.col("user_id") % 7 == 0), None).otherwise(code).alias("code"))
    return failures.batch_outcomes(units, "user_id")


BATCH_OUTCOMES = f"""{_FAILED}, u AS (SELECT user_id, CASE WHEN user_id % 3 = 0 AND event_type = 'view' OR user_id % 7 = 0 THEN NULL ELSE code END AS code FROM c),
g AS (SELECT user_id, count(*) AS total, count(*) - count(code) AS succeeded, count(code) AS failed, min(place) AS place FROM u LEFT JOIN k USING (code) GROUP BY user_id),
o AS (SELECT *, CASE WHEN failed = 0 THEN 'success' WHEN succeeded > 0 THEN 'partial' ELSE 'failed' END AS overall FROM g)
SELECT user_id, overall, total, succeeded, failed, CASE WHEN overall = 'failed' THEN http END AS http FROM o LEFT JOIN k USING (place)"""


def content_violations(spark, sf_dir):
    """V5-V7, V9, V11, V16, I9 on contents made from the columns of documents."""
    d, c = read_table(spark, sf_dir, "documents"), F.col
    item = lambda v: F.struct(v.alias("id"))
    rows = d.select(
        "doc_id", F.array(item(c("source")), item(F.when(c("lang") == "en", c("source")).otherwise(c("lang")))).alias("items"), F.concat(F.lit(" "), c("lang")).alias("front"),
        F.when(c("source") == "src1", c("lang")).otherwise(c("source")).alias("back"), (c("n_chars") % 5 + 1).cast("int").alias("relevance"), F.lit(5).alias("coherence"), F.lit(4).alias("adaptation"), F.lit(5).alias("support"),
        (c("lang") == "de").alias("unsupported"), F.when(c("n_chars") % 2 == 0, "rechazado").otherwise("aprobado").alias("verdict"), (c("lang") == "fr").alias("has_heuristic"), F.when(c("lang") == "es", "success").alias("semantic_status"),
        F.array(c("lang"), F.when(c("source") == "src2", "  ").otherwise("x")).alias("goals"), c("source").alias("claim_id"), F.col("text").alias("claim_text"), c("lang").alias("bucket"), F.lit("quiz").alias("format"),
        F.when(c("source") == "src3", "done").otherwise("candidate").alias("selection_status"),
    )
    rules = q.set_rules() | q.card_rules() | q.status_rules() | q.signal_rules() | q.text_list_rules("goals") | q.candidate_rules(["en", "de", "fr"], ["quiz", "flashcards"])
    return q.violations(rows, "doc_id", rules).select("doc_id", F.array_join("violations", ",").alias("violations"))


CONTENT_VIOLATIONS = r"""WITH d AS (SELECT *, n_chars % 5 + 1 AS rel, CASE WHEN n_chars % 2 = 0 THEN 'rechazado' ELSE 'aprobado' END AS verdict, trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '\s+', ' ', 'g'), '[^\p{L}\p{N}_\s]', '', 'g')) AS norm FROM documents),
v AS (SELECT doc_id, concat_ws(',', CASE WHEN lang = 'en' THEN 'ids' END, CASE WHEN source = 'src1' THEN 'sides' END,
  CASE WHEN verdict <> CASE WHEN lang = 'de' OR rel <= 2 THEN 'rechazado' WHEN rel = 3 THEN 'requiere_revision' ELSE 'aprobado' END THEN 'verdict' END,
  CASE WHEN lang <> 'fr' AND lang <> 'es' THEN 'signal' END, CASE WHEN source = 'src2' THEN 'goals' END, CASE WHEN trim(regexp_replace(text, '\s', '', 'g')) = '' THEN 'claim_text' END, CASE WHEN lang NOT IN ('en', 'de', 'fr') THEN 'bucket' END,
  CASE WHEN source = 'src3' THEN 'selection_status' END, CASE WHEN norm = '' THEN 'normalized' END) AS violations FROM d)
SELECT * FROM v WHERE violations <> ''"""
PRESENTATION = ["generic", "niche", "words"]


def support_variants(spark, sf_dir):
    """both support shares of each document and the verdict of two scores."""
    rows = q.variant_ratios(q.term_reasons(_pairs(spark, sf_dir), "doc_id", PRESENTATION), "doc_id")
    return rows.withColumn("verdict", q.two_score_verdict(F.lit(4), q.support_score(F.col("improved")), q.unsupported(F.col("improved"))))


def term_classes(spark, sf_dir):
    """occurrences and distinct terms by reason and language."""
    pairs = _pairs(spark, sf_dir)
    found = q.term_reasons(pairs, "doc_id", PRESENTATION).groupBy("doc_id", "reason").agg(F.sum("n").alias("n"), F.count("*").alias("terms"))
    found = found.join(read_table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return found.groupBy("lang", "reason").agg(F.sum("n").alias("occurrences"), F.sum("terms").alias("terms"))


_REASONS = f"""{_SCORED}, o AS (SELECT doc_id, lang, unnest(terms) AS term FROM x), n AS (SELECT doc_id, lang, term, count(*) AS n FROM o GROUP BY ALL),
so AS (SELECT DISTINCT doc_id, unnest(st) AS term, true AS in_source FROM x), co AS (SELECT DISTINCT doc_id, unnest(ct) AS term, true AS in_context FROM x),
tr AS (SELECT n.*, CASE WHEN in_source THEN 'source' WHEN in_context THEN 'context' WHEN term IN ('generic', 'niche', 'words') THEN 'presentation' ELSE 'unsupported' END AS reason FROM n LEFT JOIN so USING (doc_id, term) LEFT JOIN co USING (doc_id, term))"""
SUPPORT_VARIANTS = f"""{_REASONS}, vr AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS terms, round(sum(n) FILTER (reason <> 'source') / sum(n), 6) AS b, round(sum(n) FILTER (reason = 'unsupported') / sum(n), 6) AS i FROM tr GROUP BY doc_id),
vz AS (SELECT doc_id, terms, coalesce(b, 0) AS baseline, coalesce(i, 0) AS improved FROM vr)
SELECT *, CASE WHEN improved >= 0.4 THEN 'rechazado' WHEN improved > 0.3 THEN 'requiere_revision' ELSE 'aprobado' END AS verdict FROM vz"""
TERM_CLASSES = f"{_REASONS} SELECT lang, reason, CAST(sum(n) AS BIGINT) AS occurrences, count(*) AS terms FROM tr GROUP BY ALL"


def revision_reviews(spark, sf_dir):
    """F21, G18, G20 on labels: which rows ask for a revision, are disagreed on, or go to the review manifest."""
    rows = read_table(spark, sf_dir, "labels").select(
        "doc_id", F.when(F.col("quality") == 0, "rejected").when(F.col("toxic") == 1, "requires_revision").otherwise("approved").alias("verdict"), F.expr("if(doc_id % 2 = 0, array('x'), array())").alias("observations"),
        F.array().cast("array<string>").alias("recommendations"), F.expr("if(toxic = 1, array('y'), null)").alias("unsupported"), F.when(F.col("quality") == 1, "supported").otherwise("unsupported").alias("human"),
        F.when(F.col("toxic") == 0, "supported").alias("semantic"), F.when(F.col("doc_id") % 5 == 0, "failed").otherwise("success").alias("status"), (F.col("doc_id") % 3 == 0).alias("needs_review"),
    )
    parts = {"feedback": q.revision_feedback(rows), "disagreement": q.disagreements(rows), "manifest": q.review_manifest(rows)}
    out = [df.select("doc_id", F.lit(name).alias("review")) for name, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


REVISION_REVIEWS = """SELECT doc_id, 'feedback' AS review FROM labels WHERE (quality = 0 OR toxic = 1) AND (doc_id % 2 = 0 OR toxic = 1)
UNION ALL SELECT doc_id, 'disagreement' FROM labels WHERE doc_id % 5 <> 0 AND (toxic <> 0 OR quality <> 1) UNION ALL SELECT doc_id, 'manifest' FROM labels WHERE doc_id % 3 = 0"""


def diagnostic_signals(spark, sf_dir):
    """A document's last line as the query, its first line as the expected text, its lines as results of two documents."""
    d = read_table(spark, sf_dir, "documents").withColumn("lines", F.split("text", "\n"))
    results = F.transform("lines", lambda x, i: F.struct(F.when(i % 2 == 0, F.col("source")).otherwise("other").alias("document_id"), x.alias("text")))
    cases = d.select(
        F.col("doc_id").alias("case_id"), F.element_at("lines", -1).alias("query"), F.when(F.col("lang") == "fr", "none").otherwise(F.col("source")).alias("document_id"), F.get("lines", F.lit(0)).alias("expected_text"),
        F.array(F.when(F.col("lang") == "de", "a.b").otherwise("word")).alias("keywords"), results.alias("results"),
    )
    return m.diagnostic_signals(cases)


_OVER = "CASE WHEN len(q) > 0 THEN round(len(list_intersect(q, {0})) / len(q), 6) ELSE 0 END"
DIAGNOSTIC_SIGNALS = f"""WITH d AS (SELECT doc_id, lang, string_split(text, chr(10)) AS lines FROM documents),
a AS (SELECT doc_id, lang, lines, {_DIAG.format('lines[-1]')} AS q, {_DIAG.format('lines[1]')} AS first FROM d),
l AS (SELECT doc_id, max(o) AS best FROM (SELECT doc_id, {_OVER.format('t')} AS o FROM (SELECT doc_id, q, {_DIAG.format('line')} AS t FROM (SELECT doc_id, q, unnest(lines) AS line FROM a))) GROUP BY doc_id),
s AS (SELECT a.doc_id AS case_id, lang, CASE WHEN lang = 'fr' THEN 0 ELSE (len(lines) + 1) // 2 END AS same_document, {_OVER.format('first')} AS expected_overlap, best AS best_overlap, len(q) AS query_tokens FROM a JOIN l USING (doc_id))
SELECT case_id, CAST(same_document AS INT) AS same_document, expected_overlap, best_overlap, CAST(query_tokens AS INT) AS query_tokens,
  CASE WHEN same_document = 0 THEN 'document_filter' WHEN same_document >= 3 AND best_overlap >= expected_overlap THEN 'competing_chunks' WHEN lang = 'de' THEN 'exact_entity' WHEN query_tokens <= 5 THEN 'short_query' ELSE 'manual_review' END AS suggestion FROM s"""


def batch_findings(spark, sf_dir):
    """Labels as a batch against documents, and which of the findings are on cases in focus."""
    docs = read_table(spark, sf_dir, "documents")
    batch = read_table(spark, sf_dir, "labels").join(docs.select("doc_id", "text", "lang"), "doc_id").select(
        (F.col("doc_id") * F.when(F.col("toxic") == 1, -1).otherwise(1)).alias("case_id"), F.lit("2.0").alias("contract_version"), (F.col("quality") + 4).alias("top_k"), F.lit("cross_encoder").alias("score_type"),
        F.lit("success").alias("status"), F.concat(F.lit(" "), F.when(F.col("lang") == "fr", "x").otherwise(F.col("text"))).alias("query"), F.when(F.col("lang") == "de", "none").otherwise("categoria").alias("filter_mode"),
    )
    found = m.batch_findings(batch, docs.select(F.col("doc_id").alias("case_id"), F.col("text").alias("query")), "categoria", 50)
    focus = m.focus(found, list(range(100, 200))).withColumn("finding", F.concat(F.lit("focus:"), "finding"))
    return found.unionByName(focus)


BATCH_FINDINGS = r"""WITH b AS (SELECT doc_id * CASE WHEN toxic = 1 THEN -1 ELSE 1 END AS case_id, quality, lang, text FROM labels JOIN documents USING (doc_id)),
j AS (SELECT b.*, d.doc_id IS NOT NULL AS known, d.text AS own FROM b LEFT JOIN documents d ON d.doc_id = b.case_id),
f AS (SELECT case_id, 'unknown' AS finding FROM j WHERE NOT known UNION SELECT case_id, 'top_k' FROM j WHERE quality <> 1 UNION SELECT case_id, 'filter_mode' FROM j WHERE lang = 'de'
  UNION SELECT case_id, 'query' FROM j WHERE known AND regexp_replace(CASE WHEN lang = 'fr' THEN 'x' ELSE text END, '^\s+|\s+$', '', 'g') <> regexp_replace(own, '^\s+|\s+$', '', 'g')
  UNION SELECT doc_id, 'missing' FROM documents WHERE doc_id NOT IN (SELECT case_id FROM b) UNION SELECT case_id, 'duplicated' FROM b GROUP BY case_id HAVING count(*) > 1
  UNION SELECT NULL, 'size' FROM (SELECT count(*) AS n FROM b) WHERE n <> 50)
SELECT * FROM f UNION ALL SELECT case_id, 'focus:' || finding FROM f WHERE case_id BETWEEN 100 AND 199"""


def active_listing(spark, sf_dir):
    """Orders as documents: the stored and active ones with their place from the newest, and formats that are busy."""
    orders = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("document_id"), F.col("l_shipdate").alias("created_at"), F.when(F.col("l_linestatus") == "F", "stored").otherwise("pending").alias("status"), (F.col("l_returnflag") != "R").alias("is_active"),
        F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("format_type"), F.when(F.col("l_linestatus") == "O", "processing").otherwise("success").alias("attempt"),
    )
    latest = lifecycle.newest_first(lifecycle.active_documents(orders)).groupBy("document_id").agg(F.max("created_at").cast("string").alias("newest"), F.count("*").alias("n"))
    history = orders.select("document_id", "format_type", F.col("attempt").alias("status"))
    busy = lifecycle.busy_formats(history, orders.where("format_type in ('f1', 'f2')"))
    return latest.join(busy, "document_id", "full")


ACTIVE_LISTING = """WITH a AS (SELECT l_orderkey AS document_id, strftime(max(l_shipdate), '%Y-%m-%d %H:%M:%S') AS newest, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag <> 'R' GROUP BY 1),
b AS (SELECT l_orderkey AS document_id, string_agg(DISTINCT 'f' || l_linenumber, ', ' ORDER BY 'f' || l_linenumber) AS formats FROM lineitem WHERE l_linestatus = 'O' AND l_linenumber IN (1, 2) GROUP BY 1)
SELECT document_id, newest, n, formats FROM a FULL JOIN b USING (document_id)"""


def string_ids(spark, sf_dir):
    """D4, E4 on chunk ids that are texts, as in the evaluated system."""
    name = F.concat(F.lit("d_CH_"), F.lpad(F.col("vec_id").cast("string"), 6, "0"))
    vectors = read_table(spark, sf_dir, "embeddings").select(name.alias("chunk_id"), "embedding", "label", "vec_id")
    queries = vectors.where("vec_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    found = r.vector_topk(vectors, queries, 6).where("vector_rank > 1").select(F.col("query_id").alias("case_id"), (F.col("vector_rank") - 1).alias("rank"), "chunk_id")
    status = F.when(F.substring("case_id", -3, 3) == "050", "error").otherwise("success")
    cases = vectors.where("vec_id % 50 = 0").select(F.col("chunk_id").alias("case_id"), F.lit("all").alias("category"), "label").withColumn("status", status)
    return m.evaluate_by_label(cases, found, vectors.select("chunk_id", "label"))


STRING_IDS = """WITH v AS (SELECT 'd_CH_' || lpad(CAST(vec_id AS VARCHAR), 6, '0') AS id, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT a.id AS case_id, b.id AS chunk_id, b.label = a.label AS ok, row_number() OVER (PARTITION BY a.id ORDER BY round(1 - list_cosine_similarity(a.e, b.e), 6), b.id) AS rank FROM v a CROSS JOIN v b WHERE a.vec_id % 50 = 0),
h AS (SELECT case_id, count(*) FILTER (ok AND rank BETWEEN 2 AND 4) AS h3, count(*) FILTER (ok AND rank BETWEEN 2 AND 6) AS h5, count(*) FILTER (ok) AS n FROM s GROUP BY case_id),
z AS (SELECT *, right(case_id, 3) <> '050' AS eligible FROM h)
SELECT case_id, 'all' AS category, CASE WHEN eligible THEN 'success' ELSE 'error' END AS status, eligible, CASE WHEN eligible THEN round(h3 / n, 6) END AS recall_at_3, CASE WHEN eligible THEN round(h5 / n, 6) END AS recall_at_5,
  CASE WHEN eligible THEN round(h3 / 3.0, 6) END AS precision_at_3, CASE WHEN eligible THEN round(h5 / 5.0, 6) END AS precision_at_5 FROM z"""


#: Characters of other blocks put to each text: compatible, marked, composed and not.
_OTHERS = "Ａﬁ½ ệ Ἀθῆναι ё ά é ㎏"


def unicode_keys(spark, sf_dir):
    """B1, B13-B16, B20 on texts with characters beyond the Latin blocks."""
    text = F.concat(F.lit(_OTHERS + " "), F.coalesce("text", F.lit("")))
    rows = read_table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    keys = {"clean": t.clean_text, "dedup": t.dedup_key, "overlap": t.overlap_key, "retrieval": t.retrieval_key, "diagnosis": t.diagnosis_key}
    return rows.select("doc_id", *[F.md5(f(F.col("text"))).alias(f"{name}_md5") for name, f in keys.items()])


UNICODE_KEYS = r"""WITH k AS (SELECT doc_id, regexp_replace(regexp_replace(lower('Afi1⁄2 e αθηναι е α e kg ' || strip_accents(coalesce(text, ''))), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS plain, 'Afi1⁄2 ệ Ἀθῆναι ё ά é kg ' || coalesce(text, '') AS composed FROM documents)
SELECT doc_id, md5(regexp_replace(composed, '\r\n?', chr(10), 'g')) AS clean_md5, md5(trim(regexp_replace(plain, '[^\p{L}\p{N}_\s]', '', 'g'))) AS dedup_md5,
  md5(regexp_replace(regexp_replace(regexp_replace(lower(composed), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), '\s+([,.;:!?])', '\1', 'g')) AS overlap_md5, md5(plain) AS retrieval_md5,
  md5(trim(regexp_replace(plain, '[^a-z0-9_./@+-]+', ' ', 'g'))) AS diagnosis_md5 FROM k"""


def evaluation_responses(spark, sf_dir):
    """the nested response of each document as JSON; every ninth has no heuristic, documents without a label no semantic signal."""
    rows = q.rubric(q.heuristic_scores(_pairs(spark, sf_dir)))
    labels = read_table(spark, sf_dir, "labels").select("doc_id", q.semantic_verdict([2.0 + 3.0 * F.col("quality"), 4.5 - 0.6 * F.col("toxic")]).alias("semantic"))
    rows = rows.join(labels, "doc_id", "left").select(F.col("doc_id").alias("document_id"), F.lit("tldr").alias("format"), *q.SCORES, F.when(F.col("doc_id") % 9 != 0, q.english_verdict(F.col("verdict"))).alias("heuristic"), "semantic")
    return q.evaluation_response(rows, "2.0", "1.0").select("document_id", F.to_json("response", {"ignoreNullFields": "false"}).alias("response"))


_V2 = "CASE verdict WHEN 'aprobado' THEN 'approved' WHEN 'rechazado' THEN 'rejected' ELSE 'requires_revision' END"
EVALUATION_RESPONSES = f"""{_SCORED}, h AS (SELECT *, CASE WHEN doc_id % 9 <> 0 THEN {_V2} END AS heuristic FROM r),
m AS (SELECT doc_id, CASE WHEN least(2.0 + 3.0 * quality, 4.5 - 0.6 * toxic) <= 2 THEN 'rejected' WHEN least(2.0 + 3.0 * quality, 4.5 - 0.6 * toxic) < 4 THEN 'requires_revision' ELSE 'approved' END AS semantic FROM labels)
SELECT doc_id AS document_id, CAST(to_json(struct_pack(document_id := doc_id, format := 'tldr', verdict := CASE WHEN semantic IS NULL THEN heuristic WHEN heuristic IS NULL OR heuristic = semantic THEN semantic ELSE 'requires_revision' END,
  heuristic_scores := CASE WHEN heuristic IS NOT NULL THEN struct_pack(relevance := relevance, coherence := coherence, adaptation := adaptation, support := support) END,
  semantic_evaluation := struct_pack(status := CASE WHEN semantic IS NULL THEN 'unavailable' ELSE 'success' END, verdict := semantic), evaluator_version := '2.0', rubric_version := '1.0')) AS VARCHAR) AS response FROM h LEFT JOIN m USING (doc_id)"""


def routed_cases(spark, sf_dir):
    """The lines of each document as claims, every fifth a prompt, against its source text."""
    pairs = _pairs(spark, sf_dir).select(F.col("doc_id").alias("case_id"), "content_text", "source_text")
    claims = pairs.select("case_id", F.posexplode(F.split("content_text", "\n")).alias("claim_id", "text")).withColumn("role", F.when(F.col("claim_id") % 5 == 0, "prompt").otherwise("factual"))
    return q.route_cases(q.route_claims(claims, pairs.select("case_id", "source_text")))


ROUTED_CASES = f"""{_SCORED}, cl AS (SELECT doc_id, st, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM w),
ct AS (SELECT doc_id, i, st, {_SIG.format('line')} AS terms FROM cl), cn AS (SELECT doc_id, i, terms, st, {_stems('terms')} AS a, {_stems('st')} AS b FROM ct),
cr AS (SELECT doc_id, i, CASE WHEN len(terms) > 0 THEN len(list_filter(terms, lambda x: NOT list_contains(st, x))) / len(terms) END AS legacy, CASE WHEN len(a) > 0 THEN (len(a) - len(list_intersect(a, b))) / len(a) END AS normalized FROM cn),
cs AS (SELECT doc_id, i % 5 <> 0 AS f, {_STATUS.format('legacy')} IN ('lexically_suspicious', 'critical_lexical') AND i % 5 <> 0 AS lr, {_STATUS.format('normalized')} IN ('lexically_suspicious', 'critical_lexical') AND i % 5 <> 0 AS nr FROM cr)
SELECT doc_id AS case_id, count(*) AS total_claims, count(*) FILTER (f) AS factual_claims, count(*) FILTER (lr) AS legacy_review_claims, count(*) FILTER (nr) AS normalized_review_claims, bool_or(lr) AS legacy_case_review, bool_or(nr) AS normalized_case_review FROM cs GROUP BY doc_id"""


def truth_audit(spark, sf_dir):
    """Documents as cases: totals, findings against the frozen ones (ids not divisible by 11), and before a merge."""
    c = F.col
    cases = read_table(spark, sf_dir, "documents").select(
        c("doc_id").alias("case_id"), F.element_at(F.create_map(*[F.lit(x) for x in ("en", "atomic", "de", "compound", "fr", "relational", "es", "non_propositional")]), c("lang")).alias("bucket"), F.when(c("doc_id") % 13 == 0, "pending").otherwise("reviewed").alias("review_status"),
        F.when(c("doc_id") % 17 == 0, "many").otherwise((c("doc_id") % 3).cast("string")).alias("expected_atoms"), "text", F.when(c("source") == "src1", "cause").otherwise(" ").alias("relation_subtype"),
    )
    frozen = cases.where("case_id % 11 <> 0").withColumn("bucket", F.when(c("case_id") % 7 == 0, "atomic").otherwise(c("bucket"))).unionByName(cases.where("case_id % 50 = 1").withColumn("case_id", -c("case_id")))
    again = cases.unionByName(cases.where("case_id % 19 = 0"))
    totals = atoms.truth_totals(again.withColumn("expected_atoms", c("expected_atoms").try_cast("int")), cases, ["atomic", "compound", "non_propositional"], {"cases": 100, "distinct": 100, "valid": 75, "non_propositional": 25, "case_atoms": 90, "atom_rows": 90})
    found = [
        totals.select(F.lit("totals").alias("part"), F.lit(None).cast("long").alias("case_id"), F.concat_ws(":", "check", c("found").cast("string"), c("expected").cast("string")).alias("finding")),
        atoms.case_findings(again, frozen, ["text", "bucket"], {"atomic": 50, "compound": 30}).select(F.lit("cases").alias("part"), "case_id", "finding"),
        datasets.consolidation_findings(again.withColumnRenamed("case_id", "claim_id"), ["atomic", "compound", "relational"], 100).select(F.lit("merge").alias("part"), c("claim_id").alias("case_id"), "finding"),
    ]
    return found[0].unionByName(found[1]).unionByName(found[2])


TRUTH_AUDIT = """WITH d AS (SELECT doc_id AS id, CASE lang WHEN 'en' THEN 'atomic' WHEN 'de' THEN 'compound' WHEN 'fr' THEN 'relational' WHEN 'es' THEN 'non_propositional' END AS b, doc_id % 13 <> 0 AS ok, CASE WHEN doc_id % 17 <> 0 THEN doc_id % 3 END AS n, text, source = 'src1' AS sub FROM documents),
a AS (SELECT * FROM d UNION ALL SELECT * FROM d WHERE id % 19 = 0),
s AS (SELECT count(*) AS cases, count(DISTINCT id) AS dis, count(*) FILTER (b IS NULL OR b NOT IN ('atomic', 'compound', 'non_propositional')) AS fb, count(*) FILTER (NOT ok) AS ur, count(*) FILTER (b IS DISTINCT FROM 'non_propositional') AS va, count(*) FILTER (b = 'non_propositional') AS np, coalesce(sum(n), 0) AS ca, (SELECT count(*) FROM d) AS ar FROM a),
t AS (SELECT unnest(['foreign_buckets', 'unreviewed', 'cases', 'distinct', 'valid', 'non_propositional', 'case_atoms', 'atom_rows']) AS k, unnest([fb, ur, cases, dis, va, np, ca, ar]) AS v, unnest([0, 0, 100, 100, 75, 25, 90, 90]) AS e FROM s)
SELECT 'totals' AS part, NULL::BIGINT AS case_id, k || ':' || CAST(CAST(v AS BIGINT) AS VARCHAR) || ':' || e AS finding FROM t WHERE v <> e
UNION ALL SELECT 'cases', id, 'unreviewed' FROM d WHERE NOT ok UNION ALL SELECT 'cases', id, 'atom_count' FROM d WHERE n IS NULL UNION ALL SELECT 'cases', id, 'unexpected' FROM d WHERE id % 11 = 0
UNION ALL SELECT 'cases', -id, 'missing' FROM d WHERE id % 50 = 1 UNION ALL SELECT 'cases', id, 'changed:bucket' FROM d WHERE id % 11 <> 0 AND id % 7 = 0 AND b IS DISTINCT FROM 'atomic'
UNION ALL SELECT 'cases', id, 'atoms:' || b FROM d WHERE (b IN ('atomic', 'relational') AND n <> 1) OR (b = 'compound' AND n < 2) OR (b = 'non_propositional' AND n <> 0)
UNION ALL SELECT p, id, 'duplicated' FROM d, (SELECT unnest(['cases', 'merge']) AS p) WHERE id % 19 = 0
UNION ALL SELECT 'cases', NULL, 'count:' || k FROM (SELECT unnest(['atomic', 'compound']) AS k, unnest([50, 30]) AS e) WHERE (SELECT count(*) FROM a WHERE b = k) <> e
UNION ALL SELECT 'merge', id, 'unreviewed' FROM d WHERE NOT ok UNION ALL SELECT 'merge', id, 'bucket' FROM d WHERE b IS NULL OR b = 'non_propositional' UNION ALL SELECT 'merge', id, 'subtype_missing' FROM d WHERE b = 'relational' AND NOT sub
UNION ALL SELECT 'merge', id, 'subtype_foreign' FROM d WHERE b IS DISTINCT FROM 'relational' AND sub UNION ALL SELECT 'merge', id, 'text' FROM d WHERE trim(coalesce(text, '')) = ''
UNION ALL SELECT 'merge', NULL, 'size' FROM (SELECT count(*) AS n FROM a) WHERE n <> 100"""


def manifest_build(spark, sf_dir):
    """Documents as files, those of even ids named by a manifest, and what the manifest misses."""
    d = read_table(spark, sf_dir, "documents")
    files = d.select(F.concat(F.lit("md/"), F.col("doc_id").cast("string")).alias("path"), F.lit(1).alias("page"), "text")
    manifest = d.where("doc_id % 2 = 0").select(F.col("doc_id").cast("string").alias("document_id"), F.col("source").alias("category"), F.concat(F.lit("md/"), F.when(F.col("doc_id") % 20 == 0, F.lit("none")).otherwise(F.lit("")), F.col("doc_id").cast("string")).alias("md_file"))
    chunks = chunking.manifest_chunks(files, manifest, "md").select("document_id", "chunk_id", "category", F.md5("text").alias("chunk_md5"))
    gaps = chunking.manifest_gaps(files, manifest, "md").select("document_id", F.lit(None).cast("string").alias("chunk_id"), F.lit("no file").alias("category"), F.lit(None).cast("string").alias("chunk_md5"))
    return chunks.unionByName(gaps)


QUERIES = {
    "error_codes": (error_codes, ERROR_CODES), "batch_outcomes": (batch_outcomes, BATCH_OUTCOMES), "content_violations": (content_violations, CONTENT_VIOLATIONS), "support_variants": (support_variants, SUPPORT_VARIANTS),
    "term_classes": (term_classes, TERM_CLASSES), "revision_reviews": (revision_reviews, REVISION_REVIEWS), "diagnostic_signals": (diagnostic_signals, DIAGNOSTIC_SIGNALS), "batch_findings": (batch_findings, BATCH_FINDINGS),
    "active_listing": (active_listing, ACTIVE_LISTING), "string_ids": (string_ids, STRING_IDS), "unicode_keys": (unicode_keys, UNICODE_KEYS),
    "evaluation_responses": (evaluation_responses, EVALUATION_RESPONSES), "routed_cases": (routed_cases, ROUTED_CASES), "truth_audit": (truth_audit, TRUTH_AUDIT), "manifest_build": (manifest_build, None),
}
