"""Retrieval metrics, evidence metrics, audits and reports (E), and confusion metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as t

EVIDENCE_HIT = 0.5
#: Fixed value: the depth to which a diagnosis follows a ranking.
DIAGNOSTIC_K = 25
METRICS = ("recall_at_3", "recall_at_5", "precision_at_3", "precision_at_5")


def hits_at(relevant: Column, retrieved: Column, k: int) -> Column:
    if k < 1:
        raise ValueError("k must be positive")
    return F.size(F.array_intersect(F.array_distinct(relevant), F.slice(retrieved, 1, k)))


def recall_at(relevant: Column, retrieved: Column, k: int) -> Column:
    """Share of the distinct relevant ids that are among the first k; 0 without relevant ids."""
    n = F.size(F.array_distinct(relevant))
    return F.when(n > 0, hits_at(relevant, retrieved, k) / n).otherwise(0.0)


def precision_at(relevant: Column, retrieved: Column, k: int) -> Column:
    """The denominator is k, not the number retrieved."""
    return hits_at(relevant, retrieved, k) / F.lit(k)


def retrieved_ids(results: DataFrame, case: str = "case_id") -> DataFrame:
    """(case, retrieved): the ids of each case in the order of their ranks."""
    pairs = F.array_sort(F.collect_list(F.struct("rank", "chunk_id")))
    return results.groupBy(case).agg(F.transform(pairs, lambda x: x.chunk_id).alias("retrieved"))


def evaluate_cases(payloads: DataFrame, truth: DataFrame) -> DataFrame:
    """Payloads (case_id, status, retrieved) against truth (case_id, category, relevant).

    A technical error makes the metrics null and the case ineligible; no results count as 0. A case that the truth has
    not exactly once is marked.
    """
    known = truth.withColumn("copies", F.count("*").over(Window.partitionBy("case_id"))).dropDuplicates(["case_id"])
    rows = payloads.join(known, "case_id", "left")
    found = F.when(F.col("status") == "success", F.col("retrieved")).otherwise(F.array().cast(payloads.schema["retrieved"].dataType))
    eligible = (F.col("status") != "error") & F.coalesce(F.col("copies") == 1, F.lit(False))
    metric = lambda f, k: F.when(eligible, F.round(f(F.col("relevant"), found, k), 6))
    return rows.select(
        "case_id", "category", "status", eligible.alias("eligible"),
        metric(recall_at, 3).alias("recall_at_3"), metric(recall_at, 5).alias("recall_at_5"), metric(precision_at, 3).alias("precision_at_3"), metric(precision_at, 5).alias("precision_at_5"),
    )


def evaluate_by_label(cases: DataFrame, results: DataFrame, labels: DataFrame, among: bool = False) -> DataFrame:
    """E1-E4 where the chunks (chunk_id, label) of a case's label are relevant: no list of them is made.

    cases: (case_id, category, status, label), each once; results: (case_id, rank from 1, chunk_id). Hits are found by joining
    the first results to their labels, and relevant chunks are counted; the metrics are those of ``evaluate_cases``.
    With ``among`` each case is a chunk too, which is not relevant to itself.
    """
    known = labels.where("chunk_id IS NOT NULL AND label IS NOT NULL").select("chunk_id", F.col("label").alias("__label")).dropDuplicates(["chunk_id"])
    sizes = known.groupBy(F.col("__label").alias("label")).agg(F.count("*").alias("__n"))
    found = results.where("rank <= 5").join(known, "chunk_id").join(cases.where("status = 'success'").select("case_id", "label"), "case_id").where("label = __label")
    hits = found.groupBy("case_id").agg(F.count_if(F.col("rank") <= 3).alias("__h3"), F.count("*").alias("__h5"))
    rows = cases.join(sizes, "label", "left").join(hits, "case_id", "left")
    rows = rows.withColumn("__n", F.col("__n") - int(among))
    eligible = F.col("status") != "error"
    metric = lambda h, of, name: F.when(eligible, F.round(F.coalesce(F.try_divide(F.coalesce(h, F.lit(0)), of), F.lit(0.0)), 6)).alias(name)
    return rows.select(
        "case_id", "category", "status", eligible.alias("eligible"), metric(F.col("__h3"), F.col("__n"), "recall_at_3"), metric(F.col("__h5"), F.col("__n"), "recall_at_5"),
        metric(F.col("__h3"), F.lit(3), "precision_at_3"), metric(F.col("__h5"), F.lit(5), "precision_at_5"),
    )


def batch_audit(payloads: DataFrame, truth: DataFrame) -> DataFrame:
    """E5: (case_id, finding) of missing, extra and repeated cases."""
    cases = payloads.select("case_id")
    missing = truth.select("case_id").distinct().join(cases, "case_id", "left_anti").withColumn("finding", F.lit("missing"))
    extra = cases.distinct().join(truth, "case_id", "left_anti").withColumn("finding", F.lit("extra"))
    repeated = cases.groupBy("case_id").count().where("count > 1").select("case_id", F.lit("duplicated").alias("finding"))
    return missing.unionByName(extra).unionByName(repeated)


def metric_summary(results: DataFrame) -> DataFrame:
    """(metric, mean) over the eligible cases."""
    means = results.where("eligible").agg(*[F.round(F.avg(m), 6).alias(m) for m in METRICS])
    return means.unpivot([], list(METRICS), "metric", "mean")


def status_summary(results: DataFrame) -> DataFrame:
    """(status, cases, percent), nulls included; the total is taken from the counted statuses."""
    counts = results.groupBy("status").agg(F.count("*").alias("cases"))
    total = counts.agg(F.sum("cases").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("status", "cases", F.round(100 * F.col("cases") / F.col("total"), 6).alias("percent"))


def category_summary(results: DataFrame, category: str = "category") -> DataFrame:
    """E8, E34."""
    return results.where("eligible").groupBy(category).agg(F.count("*").alias("cases"), *[F.round(F.avg(m), 6).alias(m) for m in METRICS])


def case_result(results: DataFrame, case_id: object) -> dict:
    """The one row of a case; KeyError if there is none or more than one."""
    rows = results.where(F.col("case_id") == F.lit(case_id)).take(2)
    if len(rows) != 1:
        raise KeyError(f"{case_id}: {'no' if not rows else 'more than one'} result")
    return rows[0].asDict()


def failure_class(recall: Column) -> Column:
    """E10."""
    return F.when(recall == 0, "total_failure").when(recall < 1, "partial_retrieval").otherwise("complete_retrieval")


def evidence_matches(keywords: Column, text: Column) -> Column:
    """The keywords that the normalised text holds."""
    return t.let(t.retrieval_key(text), lambda body: F.filter(keywords, lambda k: F.contains(body, t.retrieval_key(k))))


_WORD = r"[\p{L}\p{N}_]+"


def _no_two_equal(keys: Column) -> Column:
    return (F.size(F.array_distinct(keys)) == F.size(keys)) & F.forall(keys, lambda k: k.isNotNull())


def _held(keys: Column, body: Column) -> Column:
    """How many of the keys, normalised, the normalised body holds.

    Keys that are words of the body are told by hashing; a word that is none of them can only be within a longer word, so
    the others are looked for in those alone, and keys that are no words in the body.
    """
    def count(z: Column) -> Column:
        longer = lambda r: t.let(F.array_min(F.transform(r, F.length)), lambda n: F.filter(z.words, lambda w: F.length(w) > n))
        seek = lambda r: F.size(F.filter(r.rest, lambda k: F.contains(F.when(k.rlike(f"^{_WORD}$"), r.longer).otherwise(z.body), k)))
        rest = t.let(F.array_except(z["keys"], z.words), lambda r: t.let(F.struct(r.alias("rest"), F.array_join(longer(r), " ").alias("longer")), seek))
        hashed = F.size(F.array_intersect(z["keys"], z.words)) + rest
        return F.when(_no_two_equal(z["keys"]), hashed).otherwise(F.size(F.filter(z["keys"], lambda k: F.contains(z.body, k))))

    both = t.let(body, lambda x: F.struct(keys.alias("keys"), x.alias("body"), F.array_distinct(F.regexp_extract_all(x, F.lit(_WORD), F.lit(0))).alias("words")))
    return t.let(both, lambda z: F.when(z.body.isNull(), 0).otherwise(count(z)))


def evidence_coverage(keywords: Column, text: Column) -> Column:
    return t.let(keywords, lambda k: F.when(F.size(k) > 0, _held(t.retrieval_keys(k), t.retrieval_key(text)) / F.size(k)).otherwise(0.0))


def token_recall(reference: Column, retrieved: Column) -> Column:
    """Share of the reference's distinct tokens that the retrieved text has."""
    return t.let(F.array_distinct(t.plain_words(reference)), lambda a: F.when(F.size(a) > 0, F.size(F.array_intersect(a, t.plain_words(retrieved))) / F.size(a)).otherwise(0.0))


def lexical_overlap(query: Column, text: Column) -> Column:
    """E30."""
    return t.let(t.diagnosis_tokens(query), lambda q: F.when(F.size(q) > 0, F.size(F.array_intersect(q, t.diagnosis_tokens(text))) / F.size(q)).otherwise(0.0))


def list_coverage(cases: DataFrame) -> DataFrame:
    """E22, E23, E24, E29 of cases (case_id, keywords, texts, ...), the texts in the order of their ranks.

    Adds ``covered``, an array of (coverage, running) of each text, and ``any_at`` and ``enough_at``, the first places from 1
    with any and with enough. The texts are joined before they are searched, so a keyword that spans two of them counts:
    each keyword is looked up once in all the texts, and is held by those places at which its first occurrence has
    ended. A case is one row, as one document is, and has its keywords once.
    """
    key = lambda c: F.coalesce(t.retrieval_key(c), F.lit(""))
    rows = t.bind(cases, __k=t.retrieval_keys(F.col("keywords")), __t=F.transform("texts", key))
    rows = t.bind(rows, __w=F.transform("__t", lambda x: F.array_distinct(F.regexp_extract_all(x, F.lit(_WORD), F.lit(0)))))
    # a keyword that is a word, and not within a longer word of the case, is told by hashing; the others are loose
    plain = F.when(_no_two_equal(F.col("__k")), F.filter("__k", lambda k: k.rlike(f"^{_WORD}$"))).otherwise(F.filter("__k", lambda k: F.lit(False)))
    rows = t.bind(rows, __v=F.array_distinct(F.flatten("__w")), __plain=plain)
    rows = t.bind(rows, __least=F.array_min(F.transform("__plain", F.length)))
    rows = t.bind(rows, __longer=F.filter("__v", lambda w: F.length(w) > F.col("__least")))
    inside = F.concat_ws(" ", F.transform("__longer", lambda w: F.substring(w, F.lit(2), F.length(w))), F.transform("__longer", lambda w: F.substring(w, F.lit(1), F.length(w) - 1)))
    rows = t.bind(rows.drop("__v", "__least"), __inside=inside)
    rows = t.bind(rows, __tight=F.filter("__plain", lambda k: ~F.contains("__inside", k)))
    rows = t.bind(rows, __loose=F.when(F.size("__tight") == 0, F.col("__k")).otherwise(F.array_except("__k", "__tight")))
    last = lambda e: F.coalesce(F.try_element_at(e, F.lit(-1)), F.lit(0))
    step = lambda e, x: F.array_append(e, last(e) + F.length(x) + ((last(e) > 0) & (x != "")).cast("int"))
    whole = F.array_join(F.filter("__t", lambda x: x != ""), " ")
    left = lambda s, w: t.let(F.array_except(s.rest, w), lambda r: F.struct(r.alias("rest"), F.array_append(s.left, F.size(r)).alias("left")))
    start = F.struct(F.col("__tight").alias("rest"), F.array().cast("array<int>").alias("left"))
    rows = t.bind(rows, __to=F.aggregate("__t", F.array().cast("array<int>"), step), __whole=whole, __left=F.aggregate("__w", start, left, lambda s: s.left))
    found = F.transform("__loose", lambda k: F.struct(F.instr("__whole", k).alias("at"), F.length(k).alias("n")))
    rows = t.bind(rows, __ends=F.transform(F.filter(found, lambda x: x.at > 0), lambda x: x.at + x.n - 1))
    share = lambda n: F.when(F.size("__k") > 0, n / F.size("__k")).otherwise(0.0)
    here = lambda x, i: F.size(F.array_intersect(F.get("__w", i), F.col("__tight"))) + F.size(F.filter("__loose", lambda k: F.contains(x, k)))
    upto = lambda i: F.size("__tight") - F.get("__left", i) + F.size(F.filter("__ends", lambda e: e <= F.get("__to", i)))
    rows = t.bind(rows, covered=F.transform("__t", lambda x, i: F.struct(share(here(x, i)).alias("coverage"), share(upto(i)).alias("running"))))
    first = lambda held: F.nullif(F.array_position(F.transform("covered", held), F.lit(True)), F.lit(0)).cast("int")
    rows = t.bind(rows, any_at=first(lambda x: x.coverage > 0), enough_at=first(lambda x: x.running >= EVIDENCE_HIT))
    return rows.select(*cases.columns, "covered", "any_at", "enough_at")


def running_coverage(rankings: DataFrame) -> DataFrame:
    """Coverage of the joined texts up to each rank, and the first ranks with any and with enough.

    rankings: (case_id, rank, text, keywords), the keywords those of the case. A case's ranking is one row meanwhile; see
    ``list_coverage``, which takes cases that are such rows already.
    """
    others = [c for c in rankings.columns if c not in ("case_id", "rank", "keywords")]
    rows = rankings.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("rank", *others))).alias("__r"), F.first("keywords").alias("keywords"))
    rows = list_coverage(rows.withColumn("texts", F.transform("__r", lambda r: r.text)))
    scored = F.transform("__r", lambda r, i: F.struct(*[r[c].alias(c) for c in ("rank", *others)], F.get("covered", i).coverage.alias("coverage"), F.get("covered", i).running.alias("running")))
    at = lambda place: F.get("__r", F.col(place) - 1).rank
    return rows.select("case_id", "keywords", at("any_at").alias("first_any"), at("enough_at").alias("first_enough"), F.explode(scored).alias("__x")).select(
        "case_id", "__x.*", "keywords", "first_any", "first_enough"
    )


def keyword_presence(keywords: DataFrame, chunks: DataFrame, by: list[str]) -> DataFrame:
    """(by, keyword, chunk_ids): the chunks of the same group that hold a keyword, sorted."""
    # normalised before they meet: a text and a keyword are in many pairs
    asked = t.bind(keywords.select(*by, "keyword"), __keyword=t.retrieval_key(F.col("keyword")))
    held = t.bind(chunks.select(*by, "chunk_id", "text"), __body=t.retrieval_key(F.col("text"))).drop("text")
    pairs = asked.join(held, by).where(F.contains("__body", "__keyword"))
    return pairs.groupBy(*by, "keyword").agg(F.array_sort(F.collect_list("chunk_id")).alias("chunk_ids"))


def format_pivot(rows: DataFrame, formats: list[str]) -> DataFrame:
    """(case_id, hit and coverage of each format, disagreement, kind) of (case_id, format, hit, coverage)."""
    wide = rows.groupBy("case_id").pivot("format", formats).agg(F.first("hit").alias("hit"), F.first("coverage").alias("coverage"))
    hits, coverages = F.array(*[f"{f}_hit" for f in formats]), F.array(*[f"{f}_coverage" for f in formats])
    differ = lambda xs: F.size(F.array_distinct(xs)) > 1
    kind = F.when(differ(hits), "format_sensitive_hit_disagreement").when(~F.exists(hits, lambda x: x), "format_independent_failure").when(differ(coverages), "format_sensitive_coverage_only")
    return wide.withColumn("disagreement", differ(hits)).withColumn("kind", kind)


def _word_set(c: Column) -> Column:
    return F.array_distinct(t.plain_words(c))


def _similarity(a: Column, b: Column) -> Column:
    return F.round(t.jaccard(_word_set(a), _word_set(b)), 6)


def line_similarities(docs: DataFrame) -> DataFrame:
    """(doc_id, i, similarity) of every line i and the next one, of (doc_id, text)."""
    lines = docs.where("text is not null").select("doc_id", F.transform(F.split("text", "\n"), _word_set).alias("l"))
    pairs = F.transform(F.slice("l", 2, F.size("l")), lambda y, i: F.round(t.jaccard(F.get("l", i), y), 6))
    return lines.select("doc_id", F.posexplode(pairs).alias("i", "similarity"))


def format_similarity(texts: DataFrame, formats: list[str]) -> DataFrame:
    """Similarity of every pair of formats of a case, length of each and whether it has text, of (case_id, text in each format)."""
    texts = texts.select("case_id", *[F.trim(F.regexp_replace(f, r"\s+", " ")).alias(f) for f in formats])
    texts = t.bind(texts, **{f"__{f}": _word_set(F.col(f)) for f in formats})
    pairs = [F.round(t.jaccard(F.col(f"__{a}"), F.col(f"__{b}")), 6).alias(f"{a}_{b}_jaccard") for i, a in enumerate(formats) for b in formats[i + 1 :]]
    return texts.select("case_id", *pairs, *[F.length(f).alias(f"{f}_chars") for f in formats], *[(F.length(f) > 0).alias(f"{f}_nonempty") for f in formats])


def chunk_structure(chunks: DataFrame, formats: list[str]) -> DataFrame:
    """The chunks of a case (case_id, format, chunk_order, text) aligned by order up to the longest format.

    A similarity is null where one of the two formats has no chunk or an empty one.
    """
    wide = chunks.groupBy("case_id", "chunk_order").pivot("format", formats).agg(F.first("text")).fillna("", formats)
    wide = t.bind(wide, **{f"__{f}": _word_set(F.col(f)) for f in formats})
    pairs = [F.when((F.col(a) != "") & (F.col(b) != ""), F.round(t.jaccard(F.col(f"__{a}"), F.col(f"__{b}")), 6)).alias(f"{a}_{b}_jaccard") for i, a in enumerate(formats) for b in formats[i + 1 :]]
    return wide.select("case_id", "chunk_order", *[(F.col(f) != "").alias(f"{f}_chunk_exists") for f in formats], *pairs, *[F.length(f).alias(f"{f}_chars") for f in formats])


def format_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Hits, hit rate and mean coverage."""
    return rows.groupBy(*by).agg(F.count("*").alias("cases"), F.sum(F.col("hit").cast("long")).alias("hits"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("hit_rate"), F.round(F.avg("coverage"), 6).alias("mean_coverage"))


def run_changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Change of hit or coverage of each case between two runs (keys, hit, coverage)."""
    old = before.select(*keys, F.col("hit").alias("hit_before"), F.col("coverage").alias("coverage_before"))
    rows = after.join(old, keys)
    delta = F.round(F.col("coverage") - F.col("coverage_before"), 6)
    change = F.when(F.col("hit") & ~F.col("hit_before"), "improved_hit").when(~F.col("hit") & F.col("hit_before"), "regressed_hit").when(delta > 0, "improved_coverage").when(delta < 0, "regressed_coverage").otherwise("unchanged")
    return rows.select(*keys, "hit_before", "hit", "coverage_before", "coverage", delta.alias("delta"), change.alias("change"))


def category_deltas(before: DataFrame, after: DataFrame, category: str = "category") -> DataFrame:
    """Means of two runs side by side, their differences, and whether any got worse."""
    old = before.select(category, *[F.col(m).alias(f"{m}_before") for m in METRICS])
    rows = after.select(category, *METRICS).join(old, category, "left")
    deltas = [F.round(F.col(m) - F.col(f"{m}_before"), 6).alias(f"{m}_delta") for m in METRICS]
    rows = rows.select("*", *deltas)
    return rows.withColumn("regression", F.coalesce(F.least(*[f"{m}_delta" for m in METRICS]) < 0, F.lit(False)))


def condition_pivot(rows: DataFrame, conditions: list[str], metric: str) -> DataFrame:
    """(case_id, one column a condition)."""
    return rows.groupBy("case_id").pivot("condition", conditions).agg(F.first(metric))


#: Cases whose first characters are the same are joined first, so that a cause is put together of pieces.
CASE_PREFIX = 6


def cause_summary(rows: DataFrame, cause: str, case: str, group: str) -> DataFrame:
    """Cases of each cause, joined in order, and its distinct groups, sorted."""
    prefix = F.substring(F.col(case).cast("string"), 1, CASE_PREFIX)
    ids = F.array_join(F.array_sort(F.collect_list(case)), ";")
    pieces = rows.groupBy(cause, prefix.alias("__prefix")).agg(F.count("*").alias("__n"), F.when(F.count(case) > 0, F.struct(F.col("__prefix").alias("p"), ids.alias("ids"))).alias("__piece"), F.collect_set(group).alias("__groups"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("__piece")), lambda x: x.ids), ";")
    return pieces.groupBy(cause).agg(F.sum("__n").alias("cases"), joined.alias("case_ids"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("__groups")))), ";").alias("groups"))


def crosstab(rows: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts with zeros filled in."""
    return rows.groupBy(row).pivot(column, values).count().na.fill(0)


def root_cause(absent: Column, coverage: Column, first_enough: Column, k: int, reproduced: Column, original: Column, hit: Column) -> Column:
    """Why a case was lost, in this order of tests."""
    return (
        F.when(absent, "evidence_absent_after_extraction_cleaning_chunking")
        .when(coverage < EVIDENCE_HIT, "insufficient_evidence_present_in_document_chunks")
        .when(first_enough.isNull(), "evidence_present_but_not_retrieved_within_diagnostic_top_k")
        .when(first_enough > k, "ranking_issue_evidence_below_top5")
        .when(F.abs(reproduced - original) > 1e-9, "reproduction_mismatch_check_pipeline_state")
        .when(hit, "top5_contains_sufficient_evidence")
        .otherwise("top5_contains_partial_evidence_below_threshold")
    )


def stage_diagnosis(vector: Column, bm25: Column, rrf: Column, cross: Column, k: int = 5) -> Column:
    """The stage that lost the evidence, from the first sufficient rank of each stage (null: none)."""
    return (
        F.when(cross <= k, "retrieved_in_final_top5")
        .when(vector.isNull() & bm25.isNull(), "candidate_generation_failure")
        .when(rrf.isNull(), "rrf_candidate_cutoff")
        .when(cross.isNull(), "cross_encoder_drops_evidence_outside_candidate_pool")
        .when((rrf <= k) & (cross > k), "cross_encoder_reranking_failure")
        .when((rrf > k) & (cross > k), "hybrid_ranking_not_sufficient")
        .otherwise("ranking_issue")
    )


def wrong_document_results(documents: Column, expected: Column) -> Column:
    """E36."""
    return F.size(F.filter(documents, lambda d: d != expected))


def confusion(expected: Column, predicted: Column) -> Column:
    """G12."""
    return F.when(expected & predicted, "TP").when(predicted, "FP").when(expected, "FN").otherwise("TN")


def _ratio(a: Column, b: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)


def confusion_metrics(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts and rates of (confusion); a rate without cases is 0."""
    count = lambda k: F.count_if(F.col("confusion") == k).alias(k.lower())
    c = rows.groupBy(*(by or [])).agg(*map(count, ("TP", "FP", "FN", "TN")))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    return c.select(
        "*", _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(tn, tn + fp).alias("specificity"), _ratio(tp + tn, n).alias("accuracy"), _ratio(tp + fp, n).alias("review_rate")
    )


def diagnostic_signals(cases: DataFrame) -> DataFrame:
    """Cases (case_id, query, document_id, expected_text, keywords, results: array of struct document_id, text) with signals and a cause."""
    overlap = lambda text: lexical_overlap(F.col("query"), text)
    rows = t.bind(
        cases, same_document=F.size(F.filter("results", lambda r: r.document_id == F.col("document_id"))), expected_overlap=F.round(overlap(F.col("expected_text")), 6),
        best_overlap=F.round(F.coalesce(F.array_max(F.transform("results", lambda r: overlap(r.text))), F.lit(0.0)), 6), query_tokens=F.size(t.diagnosis_tokens(F.col("query"))),
    )
    technical = F.exists("keywords", lambda k: F.lower(t.strip(k)).rlike(r"[./@_]|\.py\b"))
    cause = (
        F.when(F.col("same_document") == 0, "document_filter").when((F.col("same_document") >= 3) & (F.col("best_overlap") >= F.col("expected_overlap")), "competing_chunks")
        .when(technical, "exact_entity").when(F.col("query_tokens") <= 5, "short_query").otherwise("manual_review")
    )
    return rows.select("case_id", "same_document", "expected_overlap", "best_overlap", "query_tokens", cause.alias("suggestion"))


def batch_findings(batch: DataFrame, truth: DataFrame, filter_mode: str, size: int | None = None) -> DataFrame:
    """(case_id, finding) of all that a batch (case_id, contract_version, top_k, score_type, status, query, filter_mode) must not have.

    truth: (case_id, query). A finding on the whole batch has a null case_id.
    """
    known = batch.join(truth.select("case_id", F.col("query").alias("__query"), F.lit(True).alias("__known")), "case_id", "left")
    rules = {
        "unknown": F.col("__known").isNotNull(), "contract_version": F.col("contract_version") == "2.0", "top_k": F.col("top_k") == 5, "score_type": F.col("score_type") == "cross_encoder",
        "status": F.col("status") == "success", "query": F.col("__known").isNull() | (t.strip(F.col("query")) == t.strip(F.col("__query"))), "filter_mode": F.col("filter_mode") == filter_mode,
    }
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    found = known.select("case_id", F.explode(broken).alias("finding")).distinct()
    found = found.unionByName(batch_audit(batch, truth).where("finding <> 'extra'"))
    if size is not None:
        wrong = batch.agg(F.count("*").alias("n")).where(F.col("n") != size).select(F.lit(None).cast(batch.schema["case_id"].dataType).alias("case_id"), F.lit("size").alias("finding"))
        found = found.unionByName(wrong)
    return found


def focus(rows: DataFrame, ids: list, key: str = "case_id") -> DataFrame:
    """The rows of a fixed list of ids."""
    return rows.where(F.col(key).isin(*ids))


def compare_runs(scores: DataFrame, runs: list[str]) -> DataFrame:
    """A row a run of (case_id, run, value): cases, mean, zero_cases, delta_first, delta_previous, better and worse (cases, against the first run).

    All runs are compared in one pass over the cases; a case that a run lacks counts in none of its numbers.
    """
    wide = scores.groupBy("case_id").pivot("run", runs).agg(F.first("value"))
    of = lambda run: F.col(f"`{run}`")
    sums = wide.agg(
        *[F.struct(F.count(of(x)).alias("cases"), F.avg(of(x)).alias("mean"), F.count_if(of(x) == 0).alias("zero_cases"), F.count_if(of(x) > of(runs[0])).alias("better"), F.count_if(of(x) < of(runs[0])).alias("worse")).alias(x) for x in runs]
    )
    rows = []
    for place, run in enumerate(runs):
        delta = lambda other: F.round(of(run)["mean"] - of(other)["mean"], 6)  # noqa: B023, E731
        told = [of(run)[c].alias(c) for c in ("cases", "zero_cases", "better", "worse")]
        rows.append(F.struct(F.lit(run).alias("run"), F.round(of(run)["mean"], 6).alias("mean"), *told, delta(runs[0]).alias("delta_first"), delta(runs[max(0, place - 1)]).alias("delta_previous")))
    return sums.select(F.inline(F.array(*rows)))


def case_rows(cases: DataFrame, results: DataFrame) -> DataFrame:
    """Cases (case_id, keywords, expected) with coverage, hit, token_recall, chunk_ids and scores of their results.

    results: (case_id, rank, chunk_id, score, text), the few best of a case by contract. A case without results has
    coverage 0 and empty lists.
    """
    item = F.struct("rank", "chunk_id", F.round("score", 4).alias("score"), "text")
    listed = results.groupBy("case_id").agg(F.array_sort(F.collect_list(item)).alias("r"))
    rows = cases.join(listed, "case_id", "left")
    of = lambda name, kind: F.coalesce(F.transform("r", lambda x: x[name]), F.array().cast(f"array<{kind}>"))
    kind = results.schema["chunk_id"].dataType.simpleString()
    rows = rows.select("case_id", "keywords", "expected", F.array_join(of("text", "string"), "\n").alias("__got"), of("chunk_id", kind).alias("chunk_ids"), of("score", "double").alias("scores"))
    coverage = evidence_coverage(F.col("keywords"), F.col("__got"))
    return rows.select("case_id", F.round(coverage, 6).alias("coverage"), (coverage >= EVIDENCE_HIT).alias("hit"), F.round(token_recall(F.col("expected"), F.col("__got")), 6).alias("token_recall"), "chunk_ids", "scores")
