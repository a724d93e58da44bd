"""Queries of evaluation (F, G, H), contracts (V) and the generation graph (W) with their DuckDB equivalents.

Generated contents are documents, their sources the next document of the same source; labels are human judgements.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import text as t
from corpusloom.operators import atoms as a
from corpusloom.operators import graph as g
from corpusloom.operators import metrics as m
from corpusloom.operators import quality as q
from corpusloom.operators.chunking import structural_units
from corpusloom.sources.tables import read_table


#: Ids of a run: documents of one source and language are put in order run by run, so that no task has all of them.
_RUN = 1 << 13


def _with_next(docs):
    """The documents with ``__after``, the text of the next one of the same source and language, by id."""
    docs = docs.withColumn("__run", F.struct("source", "lang", F.floor(F.col("doc_id") / _RUN).alias("n")))
    within = Window.partitionBy("__run").orderBy("doc_id")
    rows = docs.withColumn("__next", F.lead(F.struct("text")).over(within))
    # the last of a run is followed by the first of the next one
    firsts = docs.select("__run", "text", F.row_number().over(within).alias("__at")).where("__at = 1")
    runs = Window.partitionBy("__run.source", "__run.lang").orderBy("__run.n")
    firsts = firsts.select("__run", F.lead(F.struct("text")).over(runs).alias("__other"))
    after = F.when(F.col("__next").isNotNull(), F.col("__next.text")).otherwise(F.col("__other.text"))
    return rows.join(firsts, "__run", "left").withColumn("__after", after).drop("__run", "__next", "__other")


def _pairs(spark, sf_dir):
    docs = _with_next(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    nxt = F.col("__after")
    return docs.select(
        "doc_id", "source", "lang", F.col("text").alias("content_text"), F.col("text").alias("factual_text"), F.concat(F.col("text").substr(F.lit(1), (F.length("text") * 3 / 4).cast("int")), F.lit(" "), F.coalesce(nxt, F.lit(""))).alias("source_text"),
        F.when(F.col("lang") == "en", F.coalesce(nxt, F.lit(""))).otherwise("generic niche words").alias("context"), F.when(F.col("doc_id") % 2 == 0, "Principiante").otherwise("experto").alias("profile"), F.when(F.col("doc_id") % 3 == 0, "high").alias("detail_level"),
    )


_SIG = r"list_filter(regexp_extract_all(strip_accents(lower({})), '[\p{{L}}\p{{N}}_]+'), lambda x: length(x) > 3 AND x NOT IN (" + ", ".join(f"'{x}'" for x in t.STOPWORDS) + "))"
_SCORED = f"""WITH d AS (SELECT doc_id, source, lang, text, left(text, CAST(floor(length(text) * 3 / 4) AS INT)) || ' ' || coalesce(lead(text) OVER (PARTITION BY source, lang ORDER BY doc_id), '') AS src,
  CASE WHEN lang = 'en' THEN coalesce(lead(text) OVER (PARTITION BY source, lang ORDER BY doc_id), '') ELSE 'generic niche words' END AS context, CASE WHEN doc_id % 2 = 0 THEN 'principiante' ELSE 'experto' END AS profile, CASE WHEN doc_id % 3 = 0 THEN 'high' ELSE '' END AS detail FROM documents),
w AS (SELECT *, {_SIG.format('text')} AS terms, list_distinct({_SIG.format('src')}) AS st, list_distinct({_SIG.format('context')}) AS ct FROM d),
x AS (SELECT *, CASE WHEN len(terms) > 0 THEN len(list_filter(terms, lambda x: NOT list_contains(st, x))) / len(terms) END AS ratio, CASE WHEN len(ct) > 0 THEN len(list_filter(ct, lambda x: list_contains(terms, x))) / len(ct) END AS rel FROM w),
s AS (SELECT doc_id, source, lang, ratio, CASE WHEN rel IS NULL OR rel >= 0.5 THEN 5 WHEN rel >= 0.25 THEN 4 ELSE 3 END AS relevance, CASE WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 50 THEN 5 ELSE 2 END AS coherence,
  CASE WHEN profile = 'principiante' AND length(text) > 3000 THEN 3 WHEN detail = 'high' AND length(text) < 200 THEN 2 ELSE 5 END AS adaptation,
  CASE WHEN ratio IS NULL THEN 5 WHEN ratio >= 0.4 THEN 1 WHEN ratio <= 0.15 THEN 5 WHEN ratio <= 0.3 THEN 4 ELSE 3 END AS support, coalesce(ratio >= 0.4, false) AS unsupported,
  CASE WHEN ratio IS NULL THEN 'supported' WHEN ratio >= 0.4 THEN 'critical_lexical' WHEN ratio <= 0.15 THEN 'supported' WHEN ratio <= 0.3 THEN 'mostly_supported' ELSE 'lexically_suspicious' END AS lex FROM x),
r AS (SELECT *, CASE WHEN unsupported OR least(relevance, coherence, adaptation, support) <= 2 THEN 'rechazado' WHEN least(relevance, coherence, adaptation, support) = 3 THEN 'requiere_revision' ELSE 'aprobado' END AS verdict FROM s)"""


def rubric_verdict(spark, sf_dir):
    """F3-F7."""
    rows = q.rubric(q.heuristic_scores(_pairs(spark, sf_dir)))
    return rows.select("doc_id", *q.SCORES, "unsupported", "verdict", q.english_verdict(F.col("verdict")).alias("verdict_v2"), F.md5("observation").alias("observation_md5"))


RUBRIC_VERDICT = f"""{_SCORED} SELECT doc_id, relevance, coherence, adaptation, support, unsupported, verdict, CASE verdict WHEN 'aprobado' THEN 'approved' WHEN 'rechazado' THEN 'rejected' ELSE 'requires_revision' END AS verdict_v2,
  md5(CASE WHEN unsupported THEN '{q.OBSERVATIONS['unsupported']}' WHEN verdict = 'rechazado' THEN '{q.OBSERVATIONS['low']}' WHEN verdict = 'aprobado' THEN '{q.OBSERVATIONS['high']}' ELSE '{q.OBSERVATIONS['regular']}' END) AS observation_md5 FROM r"""


def decision_layer(spark, sf_dir):
    """F8, F9 with labels as the semantic signal; documents without a label have none."""
    rows = q.rubric(q.heuristic_scores(_pairs(spark, sf_dir))).select("doc_id", q.english_verdict(F.col("verdict")).alias("heuristic"))
    labels = read_table(spark, sf_dir, "labels").select("doc_id", q.semantic_verdict([2.0 + 3.0 * F.col("quality"), 4.5 - 0.6 * F.col("toxic")]).alias("semantic"))
    return rows.join(labels, "doc_id", "left").withColumn("verdict", q.decide(F.when(F.col("doc_id") % 9 != 0, F.col("heuristic")), F.col("semantic")))


DECISION_LAYER = f"""{_SCORED}, h AS (SELECT doc_id, CASE verdict WHEN 'aprobado' THEN 'approved' WHEN 'rechazado' THEN 'rejected' ELSE 'requires_revision' END AS heuristic FROM r),
l AS (SELECT doc_id, CASE WHEN least(2.0 + 3.0 * quality, 4.5 - 0.6 * toxic) <= 2 THEN 'rejected' WHEN least(2.0 + 3.0 * quality, 4.5 - 0.6 * toxic) < 4 THEN 'requires_revision' ELSE 'approved' END AS semantic FROM labels),
j AS (SELECT h.*, semantic, CASE WHEN doc_id % 9 <> 0 THEN heuristic END AS hh FROM h LEFT JOIN l USING (doc_id))
SELECT doc_id, heuristic, semantic, CASE WHEN semantic IS NULL THEN hh WHEN hh IS NULL THEN semantic WHEN hh = semantic THEN hh ELSE 'requires_revision' END AS verdict FROM j"""


def lexical_support(spark, sf_dir):
    """Raw and stemmed support of each document by its source."""
    words = {"__own": t.significant_words(F.col("factual_text")), "__source": F.array_distinct(t.significant_words(F.col("source_text")))}
    rows = t.bind(_pairs(spark, sf_dir).select("doc_id", "factual_text", "source_text"), **words)
    rows = rows.select("doc_id", q.support_ratio(F.col("__own"), F.col("__source")).alias("legacy"), q.support_ratio(t.normalize_terms(F.col("__own")), t.normalize_terms(F.col("__source"))).alias("normalized"))
    return rows.select("doc_id", F.round("legacy", 6).alias("legacy"), F.round("normalized", 6).alias("normalized"), q.lexical_status(F.col("legacy")).alias("legacy_status"), q.lexical_status(F.col("normalized")).alias("normalized_status"))


def _stems(column: str) -> str:
    from corpusloom.plans.text_queries import _STEM

    return f"list_distinct(list_transform(list_filter({column}, lambda x: x NOT IN ('ademas', 'mediante')), lambda x: {_STEM}))"


_STATUS = "CASE WHEN {0} IS NULL THEN 'supported' WHEN {0} >= 0.4 THEN 'critical_lexical' WHEN {0} <= 0.15 THEN 'supported' WHEN {0} <= 0.3 THEN 'mostly_supported' ELSE 'lexically_suspicious' END"
LEXICAL_SUPPORT = f"""{_SCORED}, n AS (SELECT doc_id, ratio AS legacy, {_stems('terms')} AS a, {_stems('st')} AS b FROM x), k AS (SELECT doc_id, legacy, CASE WHEN len(a) > 0 THEN (len(a) - len(list_intersect(a, b))) / len(a) END AS normalized FROM n)
SELECT doc_id, round(legacy, 6) AS legacy, round(normalized, 6) AS normalized, {_STATUS.format('legacy')} AS legacy_status, {_STATUS.format('normalized')} AS normalized_status FROM k"""


def routing_by_case(spark, sf_dir):
    """Sources as cases, documents as claims, German ones as prompts."""
    rows = q.heuristic_scores(_pairs(spark, sf_dir)).select(F.col("source").alias("case_id"), F.when(F.col("lang") == "de", "prompt").otherwise("factual").alias("role"), "ratio", q.lexical_status(F.col("ratio")).alias("status"))
    return q.summarize_case(rows)


ROUTING_BY_CASE = f"""{_SCORED}, c AS (SELECT source AS case_id, lang <> 'de' AS f, ratio, lang <> 'de' AND lex IN ('lexically_suspicious', 'critical_lexical') AS rv FROM s)
SELECT case_id, count(*) AS claims, count(*) FILTER (f) AS factual, count(*) FILTER (rv) AS to_review, round(coalesce(count(*) FILTER (rv) / nullif(count(*) FILTER (f), 0), 0), 6) AS review_rate,
  round(avg(ratio) FILTER (f), 6) AS mean_ratio, round(max(ratio) FILTER (f), 6) AS max_ratio, bool_or(rv) AS any_review FROM c GROUP BY case_id"""


def confusion_metrics(spark, sf_dir):
    """Two routers against the labels, unpivoted."""
    rows = q.heuristic_scores(_pairs(spark, sf_dir)).join(read_table(spark, sf_dir, "labels"), "doc_id")
    routers = F.array(F.struct(F.lit("lexical").alias("router"), (F.col("ratio") > 0.3).alias("p")), F.struct(F.lit("short").alias("router"), (F.length("content_text") < 900).alias("p")))
    each = rows.select((F.col("quality") == 0).alias("e"), F.explode(routers).alias("x")).select("x.router", m.confusion(F.col("e"), F.coalesce(F.col("x.p"), F.lit(False))).alias("confusion"))
    return m.confusion_metrics(each, ["router"])


_RATES = ", ".join(f"round(coalesce({n} / nullif({d}, 0), 0), 6) AS {k}" for k, n, d in (("precision", "tp", "tp + fp"), ("recall", "tp", "tp + fn"), ("specificity", "tn", "tn + fp"), ("accuracy", "(tp + tn)", "tp + fp + fn + tn"), ("review_rate", "(tp + fp)", "tp + fp + fn + tn")))
CONFUSION_METRICS = f"""{_SCORED}, e AS (SELECT quality = 0 AS e, coalesce(ratio > 0.3, false) AS l, length(text) < 900 AS sh FROM x JOIN labels USING (doc_id)),
u AS (SELECT 'lexical' AS router, e, l AS p FROM e UNION ALL SELECT 'short', e, sh FROM e), c AS (SELECT router, count(*) FILTER (e AND p) AS tp, count(*) FILTER (NOT e AND p) AS fp, count(*) FILTER (e AND NOT p) AS fn, count(*) FILTER (NOT e AND NOT p) AS tn FROM u GROUP BY router)
SELECT *, {_RATES} FROM c"""


def expected_issues(spark, sf_dir):
    """Expected labels with fallbacks, corrected, and their review priority."""
    rows = read_table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("case_id"), F.when(F.col("doc_id") % 4 == 0, " ").when(F.col("doc_id") % 4 == 1, " Yes").alias("given"), F.when(F.col("toxic") == 1, "Unsupported_claim ").otherwise("clean").alias("variant"),
        F.lit("content_support").alias("dimension"), F.when(F.col("quality") == 0, "rejected").otherwise("approved").alias("verdict"),
    )
    rows = rows.select("case_id", q.expected_issue([F.col("given")], F.col("variant"), F.col("dimension"), F.col("verdict")).alias("any_review"))
    fixed = q.overlay(rows, rows.where("case_id % 10 = 3").select("case_id", (~F.col("any_review")).alias("any_review")), ["case_id"], "any_review")
    return q.review_priority(fixed, ["7", "8"])


EXPECTED_ISSUES = """WITH l AS (SELECT doc_id AS case_id, CASE WHEN doc_id % 4 = 1 THEN true ELSE toxic = 1 OR quality = 0 END AS v FROM labels), f AS (SELECT case_id, CASE WHEN case_id % 10 = 3 THEN NOT v ELSE v END AS any_review FROM l)
SELECT case_id, any_review, CASE WHEN case_id IN (7, 8) THEN 'high' WHEN any_review THEN 'medium' ELSE 'low' END AS priority, CAST(CASE WHEN case_id IN (7, 8) THEN 0 WHEN any_review THEN 1 ELSE 2 END AS INT) AS priority_order FROM f"""


def structural(spark, sf_dir):
    """Units of contents in all four formats, made of all lines of the documents."""
    lines = F.split("text", "\n")
    kind = F.expr("CASE doc_id % 4 WHEN 0 THEN 'quiz' WHEN 1 THEN 'flashcards' WHEN 2 THEN 'tldr' ELSE 'video_script' END")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", lines.alias("l"), kind.alias("format"))
    line = lambda i: F.coalesce(F.get("l", i), F.lit(""))
    each = lambda size: F.transform(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / size).cast("int")), lambda k: k * size)
    question = lambda i: F.struct(line(i).alias("question"), F.array(line(i + 2), line(i + 3)).alias("options"), line(i + 1).alias("correct_answer"), line(i + 2).alias("explanation"))
    is_ = lambda name, value: F.when(F.col("format") == name, value).alias(name)
    rows = docs.select(
        F.col("doc_id").alias("content_id"),
        "format",
        is_("quiz", F.struct(F.transform(each(4), question).alias("questions"))),
        is_("flashcards", F.struct(F.transform(each(2), lambda i: F.struct(line(i).alias("front"), line(i + 1).alias("back"))).alias("cards"))),
        is_("tldr", F.struct(F.lit("title").alias("title"), line(F.lit(0)).alias("summary"), F.slice("l", 2, F.size("l")).alias("key_points"), F.element_at("l", -1).alias("conclusion"))),
        is_("video_script", F.struct(F.transform(each(2), lambda i: F.struct(line(i + 1).alias("visual_description"), line(i).alias("narration"))).alias("scenes"))),
    )
    return structural_units(rows).select("content_id", "unit_type", "role", "position", F.md5("text").alias("text_md5"))


STRUCTURAL = """WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
u AS (SELECT doc_id, CASE doc_id % 4
  WHEN 0 THEN flatten(list_transform(range(0, len(l), 4), lambda k: [['question', 'prompt', l[k + 1]], ['correct_answer', 'factual', coalesce(l[k + 2], '')], ['explanation', 'factual', coalesce(l[k + 3], '')]]))
  WHEN 1 THEN flatten(list_transform(range(0, len(l), 2), lambda k: [['front', 'prompt', l[k + 1]], ['back', 'factual', coalesce(l[k + 2], '')]]))
  WHEN 2 THEN list_concat(list_concat([['summary', 'factual', l[1]]], list_transform(l[2:], lambda x: ['key_point', 'factual', x])), [['conclusion', 'factual', l[-1]]])
  ELSE list_transform(range(0, len(l), 2), lambda k: ['narration', 'factual', l[k + 1]]) END AS us FROM d)
SELECT doc_id AS content_id, x[1] AS unit_type, x[2] AS role, CAST(i - 1 AS INT) AS position, md5(x[3]) AS text_md5 FROM (SELECT doc_id, unnest(us) AS x, generate_subscripts(us, 1) AS i FROM u)"""


def _atoms(spark, sf_dir):
    """Turns as atoms: a conversation is a case, roles are types; the prediction misses some turns."""
    turns = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("case_id"), (F.col("turn") + 1).alias("atom_index"), F.col("role").alias("atom_type"))
    kind = lambda n: F.when(n == 0, None).when(n == 1, "atomic").when(n <= 3, "compound").otherwise("relational")
    status = F.when(F.col("case_id") % 11 == 0, "non_propositional").otherwise("valid")
    shape = lambda df: a.structure(df).withColumn("class", kind(F.col("n_atoms"))).withColumn("status", status)
    predicted = shape(turns.where("not (case_id % 5 = 0 and atom_index = 2)")).where("case_id % 13 <> 0").withColumn("status", F.when(F.col("case_id") % 22 == 0, "valid").otherwise(F.col("status")))
    return shape(turns), predicted


_ATOMS = """WITH t AS (SELECT conv_id AS case_id, turn + 1 AS i, role FROM conversations),
tr AS (SELECT case_id, count(*) AS n, string_agg(role, '>' ORDER BY i) AS types, CASE WHEN case_id % 11 = 0 THEN 'non_propositional' ELSE 'valid' END AS status FROM t GROUP BY case_id),
pr AS (SELECT case_id, count(*) AS n, string_agg(role, '>' ORDER BY i) AS types, CASE WHEN case_id % 11 = 0 AND case_id % 22 <> 0 THEN 'non_propositional' ELSE 'valid' END AS status FROM t WHERE NOT (case_id % 5 = 0 AND i = 2) AND case_id % 13 <> 0 GROUP BY case_id),
k AS (SELECT tr.case_id, tr.status, tr.n, tr.types, CASE WHEN tr.n = 1 THEN 'atomic' WHEN tr.n <= 3 THEN 'compound' ELSE 'relational' END AS cl, pr.status AS ps, coalesce(pr.n, 0) AS pn, pr.types AS pt, CASE WHEN pr.n IS NULL THEN NULL WHEN pr.n = 1 THEN 'atomic' WHEN pr.n <= 3 THEN 'compound' ELSE 'relational' END AS pc FROM tr LEFT JOIN pr USING (case_id))"""


def atom_scores(spark, sf_dir):
    truth, predicted = _atoms(spark, sf_dir)
    return a.decision(a.structure_scores(truth, predicted))


_SAFE = "round(coalesce(count(*) FILTER ({}) / nullif(count(*) FILTER ({}), 0), 0), 6)"
ATOM_SCORES = f"""{_ATOMS}, s AS (SELECT count(*) AS cases, {_SAFE.format('ps IS NOT NULL', 'true')} AS detection_coverage, {_SAFE.format("status <> 'valid' AND ps <> 'valid'", "ps <> 'valid'")} AS non_propositional_precision, {_SAFE.format("status <> 'valid' AND ps <> 'valid'", "status <> 'valid'")} AS non_propositional_recall,
  {_SAFE.format("status = 'valid' AND cl = pc", "status = 'valid'")} AS class_accuracy, {_SAFE.format("status = 'valid' AND n = pn", "status = 'valid'")} AS count_accuracy, {_SAFE.format("status = 'valid' AND types = pt", "status = 'valid'")} AS type_sequence_accuracy,
  {_SAFE.format("status = 'valid' AND types = pt AND n = pn AND cl = pc", "status = 'valid'")} AS exact_structure_accuracy, count(*) FILTER (status = 'valid' AND pn > n) AS over, count(*) FILTER (status = 'valid' AND pn < n) AS under,
  round(sum(CASE WHEN status = 'valid' THEN pn - n END) / sum(CASE WHEN status = 'valid' THEN n END), 6) AS inflation FROM k),
m AS (SELECT *, CAST((exact_structure_accuracy >= 0.9)::INT + (count_accuracy >= 0.95)::INT + (non_propositional_recall >= 0.85)::INT + (non_propositional_precision >= 0.9)::INT + (detection_coverage >= 0.95)::INT AS INT) AS met FROM s)
SELECT *, CASE WHEN met = 5 THEN 'CONTINUE' ELSE 'INVESTIGATE' END AS decision FROM m"""


def atom_confusion(spark, sf_dir):
    return a.confusion_pairs(*_atoms(spark, sf_dir), "types")


ATOM_CONFUSION = f"{_ATOMS} SELECT types AS expected, pt AS found, count(*) AS n FROM k WHERE types IS DISTINCT FROM pt GROUP BY ALL"


def stability(spark, sf_dir):
    """Turns as runs of a case; user turns fail, the structure is the number of lines."""
    runs = read_table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("case_id"), F.col("turn").alias("attempt"), (F.col("role") != "user").alias("ok"), F.length("text").alias("latency_ms"),
        a.signature(F.lit("valid"), F.col("role"), F.size(F.split("text", "\n")), F.lit("x")).alias("signature"),
    )
    return a.stability(runs)


STABILITY = """WITH r AS (SELECT conv_id AS case_id, role <> 'user' AS ok, length(text) AS ms, role || '|' || len(string_split(text, chr(10))) AS sig FROM conversations),
g AS (SELECT case_id, count(*) AS attempts, count(*) FILTER (ok) AS successes, count(DISTINCT CASE WHEN ok THEN sig END) AS structures, round(avg(ms) FILTER (ok), 6) AS mean_latency, CAST(min(ms) FILTER (ok) AS INT) AS min_latency, CAST(max(ms) FILTER (ok) AS INT) AS max_latency FROM r GROUP BY case_id)
SELECT *, successes = attempts AND structures = 1 AS fully_stable FROM g"""


def next_attempts(spark, sf_dir):
    runs = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("case_id"), F.col("turn").alias("attempt"), (F.col("role") != "user").alias("ok"))
    return a.next_attempt(runs)


NEXT_ATTEMPTS = "SELECT conv_id AS case_id, max(turn) + 1 AS attempt FROM conversations GROUP BY conv_id HAVING arg_max(role, turn) = 'user'"


def contract_violations(spark, sf_dir):
    """V1, V4, V10, V12, V13, H1 on rows made from the tables, some of them broken."""
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.col("source"), F.when(F.col("doc_id") % 5 == 0, ".exe").otherwise(".md")).alias("filename"), F.when(F.col("doc_id") % 7 == 0, 0).otherwise(F.col("n_chars")).alias("size_bytes"),
        F.array(F.col("lang"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise(F.col("source"))).alias("options"), F.when(F.col("doc_id") % 4 == 0, "xx").otherwise(F.col("lang")).alias("correct_answer"),
        F.when(F.col("doc_id") % 2 == 0, "success").otherwise("failed").alias("status"), F.when(F.col("doc_id") % 6 != 0, 1.0).alias("scores"), F.when(F.col("doc_id") % 10 == 1, "timeout").alias("error_code"),
    )
    rules = q.document_rules() | {f"quiz_{k}": v for k, v in q.question_rules().items()} | {f"semantic_{k}": v for k, v in q.semantic_rules().items()}
    return q.violations(docs, "doc_id", rules).select("doc_id", F.array_join("violations", ",").alias("violations"))


CONTRACT_VIOLATIONS = """SELECT doc_id, v AS violations FROM (SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 5 = 0 THEN 'extension' END, CASE WHEN doc_id % 7 = 0 THEN 'size' END, CASE WHEN doc_id % 3 = 0 THEN 'quiz_repeated_option' END, CASE WHEN doc_id % 4 = 0 THEN 'quiz_answer' END,
  CASE WHEN doc_id % 2 = 0 AND (doc_id % 6 = 0 OR doc_id % 10 = 1) THEN 'semantic_success' END, CASE WHEN doc_id % 2 = 1 AND NOT (doc_id % 6 = 0 AND doc_id % 10 = 1) THEN 'semantic_failed' END) AS v FROM documents) WHERE v <> ''"""


def generation_graph(spark, sf_dir):
    """Retrieved context, fan-out over requested formats, outcomes with their reducer."""
    requests = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("request_id"), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("quiz"), F.lit("tldr"), F.lit("poem"))).otherwise(F.array(F.lit("flashcards"))).alias("formats_requested"))
    found = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("request_id"), F.posexplode(F.split("text", "\n")).alias("i", "text")).where("request_id % 5 <> 0").select("request_id", (F.col("i") + 1).alias("rank"), "text")
    return g.outcomes(g.fan_out(requests, g.contexts(found))).select("request_id", "n_outcomes", "succeeded", "failed", "outcome", "trace")


GENERATION_GRAPH = """WITH f AS (SELECT doc_id AS request_id, unnest(CASE WHEN doc_id % 2 = 0 THEN ['quiz', 'tldr', 'poem'] ELSE ['flashcards'] END) AS format, doc_id % 5 = 0 AS none FROM documents),
o AS (SELECT request_id, format, CASE WHEN none THEN 'NO_CONTEXT' WHEN format = 'poem' THEN 'UNSUPPORTED_FORMAT' END AS err FROM f)
SELECT request_id, count(*) AS n_outcomes, count(*) FILTER (err IS NULL) AS succeeded, count(*) FILTER (err IS NOT NULL) AS failed, CASE WHEN count(err) = 0 THEN 'success' WHEN count(*) > count(err) THEN 'partial' ELSE 'failed' END AS outcome,
  string_agg(format || ':' || coalesce(err, 'success'), ',' ORDER BY format) AS trace FROM o GROUP BY request_id"""


QUERIES = {
    "rubric_verdict": (rubric_verdict, RUBRIC_VERDICT), "decision_layer": (decision_layer, DECISION_LAYER), "lexical_support": (lexical_support, LEXICAL_SUPPORT), "routing_by_case": (routing_by_case, ROUTING_BY_CASE), "confusion_metrics": (confusion_metrics, CONFUSION_METRICS),
    "expected_issues": (expected_issues, EXPECTED_ISSUES), "structural_units": (structural, STRUCTURAL), "atom_structure_scores": (atom_scores, ATOM_SCORES), "atom_confusion": (atom_confusion, ATOM_CONFUSION), "stability_signatures": (stability, STABILITY),
    "next_attempts": (next_attempts, NEXT_ATTEMPTS), "contract_violations": (contract_violations, CONTRACT_VIOLATIONS), "generation_graph": (generation_graph, GENERATION_GRAPH),
}
