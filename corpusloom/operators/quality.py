"""Heuristic evaluation, rubric and decision layer (F), claim support routing (G) and row contracts (V)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import text as t

# Thresholds of the scores. Reject is tested before excellent, excellent before good.
REJECT, EXCELLENT, GOOD = 0.40, 0.15, 0.30
RELEVANCE_HIGH, RELEVANCE_MEDIUM = 0.50, 0.25
COHERENT_CHARS, BEGINNER_CHARS, DETAIL_CHARS = 50, 3000, 200
VERDICTS = {"aprobado": "approved", "requiere_revision": "requires_revision", "rechazado": "rejected"}
OBSERVATIONS = {
    "unsupported": "Rechazado: Se detectó información no respaldada en los chunks originales.",
    "low": "Rechazado: Uno o más criterios no superan el puntaje mínimo aceptable (<=2).",
    "regular": "Requiere revisión: Existen criterios con puntaje regular (3) que deben mejorarse.",
    "high": "Aprobado: El contenido cumple con altos estándares de calidad.",
}
SCORES = ("relevance", "coherence", "adaptation", "support")


def evaluable_text(units: Column) -> Column:
    """the texts of units (struct with text) joined by spaces."""
    return F.array_join(F.transform(units, lambda u: u.text), " ")


#: Missing terms that are looked up one by one.
FEW_TERMS = 32


def support_ratio(terms: Column, source_terms: Column) -> Column:
    """Share of the occurrences of terms that the source lacks; null without terms."""
    def share(z: Column) -> Column:
        few = F.size(F.filter(z.terms, lambda x: F.array_contains(z.missing, x)))
        # of many, each is followed by its occurrences in one sorted list
        marked = F.array_sort(F.concat(F.transform(z.missing, lambda x: F.struct(x.alias("t"), F.lit(0).alias("own"))), F.transform(z.terms, lambda x: F.struct(x.alias("t"), F.lit(1).alias("own")))))
        step = lambda s, x: F.when(x.own == 0, F.struct(x.t.alias("t"), s.n.alias("n"))).otherwise(F.struct(s.t.alias("t"), (s.n + F.coalesce((s.t == x.t).cast("int"), F.lit(0))).alias("n")))
        many = F.aggregate(marked, F.struct(F.lit(None).cast("string").alias("t"), F.lit(0).alias("n")), step, lambda s: s.n)
        return F.when(F.size(z.terms) > 0, F.when(F.size(z.missing) <= FEW_TERMS, few).otherwise(many) / F.size(z.terms))

    # array_except hashes
    both = t.let(terms, lambda x: F.struct(x.alias("terms"), F.array_except(x, source_terms).alias("missing")))
    return t.let(both, share)


def support_score(ratio: Column) -> Column:
    """F16: 1 to 5 from the unsupported ratio; 5 without terms."""
    return F.when(ratio.isNull(), 5).when(ratio >= REJECT, 1).when(ratio <= EXCELLENT, 5).when(ratio <= GOOD, 4).otherwise(3)


def unsupported(ratio: Column) -> Column:
    return F.coalesce(ratio >= REJECT, F.lit(False))


def lexical_status(ratio: Column) -> Column:
    """G2."""
    return F.when(ratio.isNull(), "supported").when(ratio >= REJECT, "critical_lexical").when(ratio <= EXCELLENT, "supported").when(ratio <= GOOD, "mostly_supported").otherwise("lexically_suspicious")


def relevance_score(ratio: Column) -> Column:
    """F17; null (no context) counts as relevant."""
    return F.when(ratio.isNull() | (ratio >= RELEVANCE_HIGH), 5).when(ratio >= RELEVANCE_MEDIUM, 4).otherwise(3)


def heuristic_scores(contents: DataFrame) -> DataFrame:
    """adds the four scores and the flag to (content_text, factual_text, source_text, context, profile, detail_level)."""
    words = lambda c: t.significant_words(F.coalesce(F.col(c), F.lit("")))
    rows = t.bind(contents, __context=F.array_distinct(words("context")), __content=words("content_text"), __factual=words("factual_text"), __source=F.array_distinct(words("source_text")))
    context = F.col("__context")
    overlap = F.when(F.size(context) > 0, F.size(F.array_intersect(context, F.col("__content"))) / F.size(context))
    n = F.length("content_text")
    profile, detail = F.lower(F.coalesce("profile", F.lit(""))), F.lower(F.coalesce("detail_level", F.lit("")))
    adaptation = F.when(profile.isin("principiante", "beginner") & (n > BEGINNER_CHARS), 3).when(detail.isin("alto", "high") & (n < DETAIL_CHARS), 2).otherwise(5)
    rows = t.bind(rows, ratio=support_ratio(F.col("__factual"), F.col("__source")), __relevance=relevance_score(overlap))
    return rows.select(
        *contents.columns, "ratio", F.col("__relevance").alias("relevance"), F.when(F.length(t.strip(F.col("content_text"))) > COHERENT_CHARS, 5).otherwise(2).alias("coherence"),
        adaptation.alias("adaptation"), support_score(F.col("ratio")).alias("support"), unsupported(F.col("ratio")).alias("unsupported"),
    )


def _rule() -> Column:
    low = F.least(*SCORES)
    return F.when(F.col("unsupported"), "unsupported").when(low <= 2, "low").when(low == 3, "regular").otherwise("high")


def rubric(scored: DataFrame) -> DataFrame:
    """verdict and observation of the four scores and the flag."""
    verdicts = {"unsupported": "rechazado", "low": "rechazado", "regular": "requiere_revision", "high": "aprobado"}
    rows = scored.withColumn("__rule", _rule())
    pick = lambda values: reduce(lambda c, kv: c.when(F.col("__rule") == kv[0], kv[1]), values.items(), F)
    return rows.withColumn("verdict", pick(verdicts)).withColumn("observation", pick(OBSERVATIONS)).drop("__rule")


def english_verdict(verdict: Column) -> Column:
    """null for an unknown verdict."""
    return reduce(lambda c, kv: c.when(verdict == kv[0], kv[1]), VERDICTS.items(), F)


def semantic_verdict(scores: list[Column]) -> Column:
    """F8: on the scale of fractions anything below 4 is to be revised."""
    low = F.least(*scores)
    return F.when(low <= 2.0, "rejected").when(low < 4.0, "requires_revision").otherwise("approved")


def decide(heuristic: Column, semantic: Column) -> Column:
    """the signal there is; if both agree, it; else revision."""
    return F.when(semantic.isNull(), heuristic).when(heuristic.isNull(), semantic).when(heuristic == semantic, heuristic).otherwise("requires_revision")


def evaluate_contents(contents: DataFrame, key: str, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """heuristic scores, a judge's scores and the verdict of both, a row a content.

    contents: as for ``heuristic_scores``, with a key that is unique. ``judge`` adds status, answer (JSON of the four scores) and
    error_code to rows (key, text), as ``providers.call_provider`` does. An answer that has not all four scores is a
    failure, ``INVALID_MODEL_OUTPUT``; whatever the judge did, the heuristic stands.
    """
    rows = rubric(heuristic_scores(contents)).select(key, *SCORES, "unsupported", english_verdict(F.col("verdict")).alias("heuristic"))
    told = judge(contents.select(key, F.col("content_text").alias("text"))).select(key, "status", "error_code", parse_scores(F.col("answer")).alias("__s"))
    scores = [F.col(f"__s.{c}") for c in ("relevance", "coherence", "adaptation", "support")]
    whole = reduce(Column.__and__, [c.isNotNull() for c in scores])
    ok, useless = (F.col("status") == "success") & whole, (F.col("status") == "success") & ~F.coalesce(whole, F.lit(False))
    told = told.select(
        key,
        F.when(useless, "failed").otherwise(F.col("status")).alias("semantic_status"),
        F.when(useless, "INVALID_MODEL_OUTPUT").otherwise(F.col("error_code")).alias("error_code"),
        F.when(ok, semantic_verdict(scores)).alias("semantic"),
    )
    return rows.join(told, key, "left").withColumn("verdict", decide(F.col("heuristic"), F.col("semantic")))


def reviewer_feedback(issues: Column) -> Column:
    """issues (struct severity, text) sorted by severity, equals in their order."""
    order = lambda x: F.when(x.severity == "high", 0).when(x.severity == "medium", 1).otherwise(2)
    placed = F.transform(issues, lambda x, i: F.struct(order(x).alias("o"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(placed), lambda p: p.x)


def overall_outcome(succeeded: Column, failed: Column) -> Column:
    """success, partial or failed from the numbers of outcomes."""
    return F.when(failed == 0, "success").when(succeeded > 0, "partial").otherwise("failed")


def parse_scores(payload: Column) -> Column:
    """A judge's JSON to typed scores and lists; null where the payload is no such object."""
    return F.from_json(payload, "relevance double, coherence double, adaptation double, support double, observations array<string>, unsupported array<string>")


def routing_action(role: Column, status: Column) -> Column:
    """G3."""
    return F.when(role == "prompt", "excluded").when(status.isin("lexically_suspicious", "critical_lexical"), "needs_semantic_review").otherwise("provisionally_supported")


def requires_review(role: Column, status: Column) -> Column:
    """G7."""
    return (role == "factual") & status.isin("lexically_suspicious", "critical_lexical")


def expected_issue(explicit: list[Column], variant: Column, dimension: Column, verdict: Column) -> Column:
    """The first explicit value that is not blank, else derived from the variant, dimension and verdict."""
    tidy = lambda c: F.lower(t.strip(F.coalesce(c, F.lit(""))))
    given = F.coalesce(*[F.nullif(t.strip(c), F.lit("")) for c in explicit])
    derived = (tidy(variant) == "unsupported_claim") | ((tidy(dimension) == "content_support") & tidy(verdict).isin("requires_revision", "rejected"))
    return F.when(given.isNotNull(), t.as_bool(given)).otherwise(derived)


def summarize_case(claims: DataFrame, by: str = "case_id") -> DataFrame:
    """Counts, review rate and ratios of the factual claims of each case."""
    factual, review = F.col("role") == "factual", requires_review(F.col("role"), F.col("status"))
    n = F.count_if(factual)
    return claims.groupBy(by).agg(
        F.count("*").alias("claims"), n.alias("factual"), F.count_if(review).alias("to_review"), F.round(F.coalesce(F.try_divide(F.count_if(review), n), F.lit(0.0)), 6).alias("review_rate"),
        F.round(F.avg(F.when(factual, F.col("ratio"))), 6).alias("mean_ratio"), F.round(F.max(F.when(factual, F.col("ratio"))), 6).alias("max_ratio"), F.coalesce(F.bool_or(review), F.lit(False)).alias("any_review"),
    )


def review_priority(case_labels: DataFrame, high: list[str]) -> DataFrame:
    """Adds the priority of (case_id, any_review) and sorts by it."""
    priority = F.when(F.col("case_id").isin(*high), "high").when(F.col("any_review"), "medium").otherwise("low")
    order = lambda c: F.when(c == "high", 0).when(c == "medium", 1).otherwise(2)
    return case_labels.withColumn("priority", priority).withColumn("priority_order", order(F.col("priority")))


def overlay(rows: DataFrame, corrections: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Values of ``corrections`` take the place of those of the same key."""
    new = corrections.select(*keys, F.col(column).alias("__new"), F.lit(True).alias("__hit"))
    return rows.join(new, keys, "left").withColumn(column, F.when(F.col("__hit"), F.col("__new")).otherwise(F.col(column))).drop("__new", "__hit")


def overlay_misses(rows: DataFrame, corrections: DataFrame, keys: list[str]) -> DataFrame:
    """Corrections that do not hit exactly one row; must be empty before an overlay is written."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return corrections.join(counts, keys, "left").where("coalesce(n, 0) <> 1").select(*keys, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, violations) of the rows that break a rule; a rule that is null is broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return rows.select(key, broken.alias("violations")).where(F.size("violations") > 0)


def all_distinct(items: Column) -> Column:
    return F.size(items) == F.size(F.array_distinct(items))


def document_rules() -> dict[str, Column]:
    """V1: rows (filename, size_bytes)."""
    name = t.strip(F.coalesce(F.col("filename"), F.lit("")))
    return {"filename": name != "", "extension": F.lower(name).rlike(r"\.(pdf|md|txt)$"), "size": F.coalesce(F.col("size_bytes") > 0, F.lit(True))}


def question_rules() -> dict[str, Column]:
    """V4-V5: rows (options, correct_answer)."""
    tidy = F.transform("options", t.strip)
    return {"blank_option": F.forall(tidy, lambda x: x != ""), "repeated_option": all_distinct(tidy), "answer": F.array_contains(tidy, t.strip(F.col("correct_answer")))}


def retrieval_rules(top_k: int = 5) -> dict[str, Column]:
    """V2, V3: contract rows (contract_version, top_k, score_type, status, results, error)."""
    status, size = F.col("status"), F.size("results")
    return {
        "version": F.col("contract_version") == "2.0", "top_k": F.col("top_k") == top_k, "score_type": F.col("score_type") == "cross_encoder", "status": status.isin("success", "no_results", "error"),
        "results": F.when(status == "success", size > 0).otherwise(size == 0), "error": (status == "error") == F.col("error").isNotNull(),
        "rank": F.forall(F.transform("results", lambda x, i: x.rank == i + 1), lambda ok: ok),
    }


def semantic_rules() -> dict[str, Column]:
    """Rows (status, scores, error_code)."""
    status, scores, code = F.col("status"), F.col("scores"), F.col("error_code")
    return {
        "success": (status != "success") | (scores.isNotNull() & code.isNull()),
        "failed": (status != "failed") | (scores.isNull() & F.coalesce(code != "not_configured", F.lit(False))),
        "unavailable": (status != "unavailable") | (scores.isNull() & F.coalesce(code == "not_configured", F.lit(False))),
    }


def format_rules() -> dict[str, Column]:
    """Generated formats (status, content, chunks, error_message)."""
    status = F.col("status")
    ready = F.col("content").isNotNull() & (F.coalesce(F.size("chunks"), F.lit(0)) > 0)
    return {
        "processing": (status != "processing") | (F.col("content").isNull() & (F.coalesce(F.size("chunks"), F.lit(0)) <= 0) & F.col("error_message").isNull()),
        "success": (status != "success") | ready,
    }


def evidence_rules() -> dict[str, Column]:
    """Rows (document_id, chunks: array of struct chunk_id, document_id, rank)."""
    ids, ranks = F.transform("chunks", lambda c: c.chunk_id), F.transform("chunks", lambda c: c.rank)
    return {"chunk_ids": all_distinct(ids), "ranks": all_distinct(ranks), "documents": F.forall("chunks", lambda c: c.document_id == F.col("document_id"))}


def set_rules() -> dict[str, Column]:
    """V5, V7: sets of questions or cards (items: array of struct id, ...)."""
    return {"ids": all_distinct(F.transform("items", lambda x: x.id))}


def card_rules() -> dict[str, Column]:
    """V6: cards (front, back)."""
    return {"sides": t.strip(F.col("front")) != t.strip(F.col("back"))}


def status_rules() -> dict[str, Column]:
    """V9: evaluations (the four scores, unsupported, verdict): the verdict must be the one that follows from them."""
    derived = F.when(_rule().isin("unsupported", "low"), "rechazado").when(_rule() == "regular", "requiere_revision").otherwise("aprobado")
    return {"verdict": F.col("verdict") == derived}


def signal_rules() -> dict[str, Column]:
    """(has_heuristic, semantic_status, verdict): no verdict without a signal."""
    return {"signal": F.col("verdict").isNull() | F.col("has_heuristic") | (F.coalesce(F.col("semantic_status"), F.lit("")) == "success")}


def text_list_rules(*columns: str) -> dict[str, Column]:
    """Arrays of texts that are not blank."""
    return {c: F.forall(c, lambda x: t.strip(F.coalesce(x, F.lit(""))) != "") for c in columns}


def candidate_rules(buckets: list[str], formats: list[str]) -> dict[str, Column]:
    """Candidates (claim_id, claim_text, bucket, format, selection_status)."""
    filled = lambda c: F.coalesce(t.strip(F.col(c)) != "", F.lit(False))
    return {
        "claim_id": filled("claim_id"), "claim_text": filled("claim_text"), "bucket": F.col("bucket").isin(*buckets), "format": F.col("format").isin(*formats),
        "selection_status": F.col("selection_status") == "candidate", "normalized": t.dedup_key(F.col("claim_text")) != "",
    }


def two_score_verdict(relevance: Column, support: Column, unsupported: Column) -> Column:
    """the verdict where coherence and adaptation are taken as full."""
    low = F.least(relevance, support)
    return F.when(unsupported | (low <= 2), "rechazado").when(low == 3, "requiere_revision").otherwise("aprobado")


def term_reasons(contents: DataFrame, key: str, presentation: list[str]) -> DataFrame:
    """(key, term, n, reason) of the distinct terms of contents (factual_text, source_text, context).

    reason: ``source`` for a term of the source, else ``context``, ``presentation`` (words of the form), or ``unsupported``.
    """
    words = lambda c: t.significant_words(F.coalesce(F.col(c), F.lit("")))
    form = F.array(*map(F.lit, presentation)).cast("array<string>")
    terms = t.bind(contents.select(key, "factual_text", "source_text", "context"), __own=words("factual_text"), __source=F.array_distinct(words("source_text")), __context=F.array_distinct(words("context")))
    # sets are told by hashed differences; each term is then looked up among the few that are left
    sets = t.bind(terms.select(key, "__own", "__source", "__context"), __missing=F.array_except("__own", "__source"))
    sets = t.bind(sets, __alone=F.array_except("__missing", "__context"))
    reason = lambda x: F.when(~F.array_contains("__missing", x), "source").when(~F.array_contains("__alone", x), "context").when(F.array_contains(form, x), "presentation").otherwise("unsupported")
    # the reason goes with the term, so that no row of a term has the lists of its content
    each = sets.select(key, F.explode(F.transform("__own", lambda x: F.struct(x.alias("term"), reason(x).alias("reason")))).alias("x"))
    return each.groupBy(key, "x.term", "x.reason").agg(F.count("*").alias("n")).select(key, "term", "n", "reason")


def variant_ratios(reasons: DataFrame, key: str) -> DataFrame:
    """(key, terms, baseline, improved): unsupported shares of the occurrences, context and form allowed in the second."""
    count = lambda *of: F.sum(F.when(F.col("reason").isin(*of), F.col("n")).otherwise(0))
    n = F.sum("n")
    return reasons.groupBy(key).agg(n.alias("terms"), F.round(count("context", "presentation", "unsupported") / n, 6).alias("baseline"), F.round(count("unsupported") / n, 6).alias("improved"))


def revision_feedback(evaluations: DataFrame) -> DataFrame:
    """evaluations (verdict, observations, recommendations, unsupported: arrays) that ask for a revision and say why."""
    said = [F.coalesce(F.size(c), F.lit(0)) > 0 for c in ("observations", "recommendations", "unsupported")]
    return evaluations.where(F.col("verdict").isin("requires_revision", "rejected") & reduce(Column.__or__, said))


def disagreements(rows: DataFrame) -> DataFrame:
    """(human, semantic, status): judged rows in which the two differ."""
    return rows.where((F.col("status") == "success") & ~F.col("human").eqNullSafe(F.col("semantic")))


def review_manifest(rows: DataFrame, labels: tuple[str, ...] = ("supported", "partially_supported", "unsupported")) -> DataFrame:
    """Claims flagged for review (needs_review) that people gave a definite label."""
    return rows.where(F.col("needs_review") & F.col("human").isin(*labels))


def evaluation_response(rows: DataFrame, evaluator_version: str, rubric_version: str) -> DataFrame:
    """(document_id, response) of (document_id, format, the four scores, heuristic, semantic), a verdict each or null.

    The response is nested: heuristic_scores is null where no heuristic verdict is; both signals stay apart, and
    the verdict is that of ``decide``.
    """
    scores = F.when(F.col("heuristic").isNotNull(), F.struct(*SCORES))
    signal = F.struct(F.when(F.col("semantic").isNull(), "unavailable").otherwise("success").alias("status"), F.col("semantic").alias("verdict"))
    response = F.struct(
        "document_id", "format", decide(F.col("heuristic"), F.col("semantic")).alias("verdict"), scores.alias("heuristic_scores"), signal.alias("semantic_evaluation"),
        F.lit(evaluator_version).alias("evaluator_version"), F.lit(rubric_version).alias("rubric_version"),
    )
    return rows.select("document_id", response.alias("response"))


def _routed(kept: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The claims of a stream sorted by case, sources first, with the shares of their terms that the source lacks."""
    known: dict = {}
    for batch in batches:
        cases, own = batch.column("case_id").to_pylist(), batch.column("__own").to_pylist()
        shares = []
        for router in ("legacy", "normalized"):
            found = []
            for i, terms in enumerate(batch.column(f"__{router}").to_pylist()):
                if known.get(router, (None, None))[0] != cases[i]:
                    known[router] = (cases[i], set())
                if own[i] == 0:
                    known[router][1].update(terms)
                else:
                    found.append(sum(x not in known[router][1] for x in terms) / len(terms) if terms and cases[i] is not None else None)
            shares.append(pa.array(found, pa.float64()))
        claims = batch.filter(pa.array([x == 1 for x in own], pa.bool_()))
        yield pa.RecordBatch.from_arrays([*(claims.column(c) for c in kept), *shares], names=[*kept, "legacy_ratio", "normalized_ratio"])


def route_claims(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Claims (case_id, claim_id, role, text) with the ratio, status and review flag of two routers: legacy and normalized.

    sources: (case_id, source_text), any number a case. The texts of a case come as one stream, its sources first, of which
    only the terms are held, so a case can have any number of claims and no term is a row; legacy counts the
    occurrences of a term, normalized its distinct stems. A claim without terms, without a case, or of null text has no ratio and
    is supported; in a case without a source nothing is supported.
    """
    stream = claims.withColumn("__own", F.lit(1)).unionByName(sources.select("case_id", F.col("source_text").alias("__text"), F.lit(0).alias("__own")), allowMissingColumns=True)
    stream = stream.repartition("case_id").sortWithinPartitions("case_id", "__own")
    text = F.coalesce(F.when(F.col("__own") == 1, F.col("text")).otherwise(F.col("__text")), F.lit(""))
    words = t.bind(stream, __legacy=t.let(t.significant_words(text), lambda x: F.when(F.col("__own") == 1, x).otherwise(F.array_distinct(x))))
    words = words.select(*claims.columns, "__own", "__legacy", t.normalize_terms(F.col("__legacy")).alias("__normalized"))
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in claims.schema), *(T.StructField(f"{r}_ratio", T.DoubleType()) for r in ("legacy", "normalized"))])
    rows = words.mapInArrow(partial(_routed, claims.columns), schema)
    for router in ("legacy", "normalized"):
        status = lexical_status(F.col(f"{router}_ratio"))
        rows = rows.withColumn(f"{router}_status", status).withColumn(f"{router}_review", F.coalesce(requires_review(F.col("role"), F.col(f"{router}_status")), F.lit(False)))
    return rows


def route_cases(routed: DataFrame) -> DataFrame:
    """The claims of each case counted, and whether a router wants any of them reviewed."""
    flags = [F.count_if(f"{r}_review").alias(f"{r}_review_claims") for r in ("legacy", "normalized")] + [F.bool_or(f"{r}_review").alias(f"{r}_case_review") for r in ("legacy", "normalized")]
    return routed.groupBy("case_id").agg(F.count("*").alias("total_claims"), F.count_if(F.col("role") == "factual").alias("factual_claims"), *flags)
