"""Queries of attempt logs and of the evaluation with failed calls, with their DuckDB equivalents.

Conversations stand for cases and their turns for atoms or attempts; rules on the ids make some calls fail and some
predictions wrong.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import atoms, attempts
from corpusloom.sources.tables import read_table

_PAYLOAD = ["latency_ms", "domain"]


def _log(spark, sf_dir):
    """Turns as attempts: answers of the assistant succeed, but for every 13th conversation."""
    return read_table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("case_id"),
        (F.col("turn") + 1).alias("attempt"),
        ((F.col("role") != "user") & (F.col("conv_id") % 13 != 0)).alias("ok"),
        F.length("text").alias("latency_ms"),
        F.concat(F.lit("d"), F.col("conv_id") % 5).alias("domain"),
    )


_LOG = """WITH l AS (
  SELECT conv_id AS case_id, turn + 1 AS attempt, role <> 'user' AND conv_id % 13 <> 0 AS ok, length(text) AS latency_ms, 'd' || conv_id % 5 AS domain FROM conversations
), s AS (
  SELECT case_id, domain, bool_or(ok) AS succeeded, count(*) AS attempts, count(*) FILTER (NOT ok) AS failed_attempts, max(attempt) AS last_attempt, min(attempt) FILTER (ok) AS won FROM l GROUP BY ALL
), state AS (
  SELECT s.case_id, succeeded, l.attempt, attempts, failed_attempts, last_attempt, latency_ms, s.domain FROM s JOIN l ON l.case_id = s.case_id AND l.attempt = coalesce(won, last_attempt)
)"""


def attempt_states(spark, sf_dir):
    """The log up to the second attempt folded to states, which the rest of it, read twice, carries on."""
    log = _log(spark, sf_dir)
    early = attempts.fold(log.where("attempt <= 2"), _PAYLOAD)
    return attempts.advance(early, log.unionByName(log.where("attempt > 2")), _PAYLOAD)


ATTEMPT_STATES = f"{_LOG} SELECT * FROM state"


def retry_statistics(spark, sf_dir):
    """H6: by domain."""
    log = _log(spark, sf_dir)
    return attempts.retry_statistics(log, attempts.fold(log, _PAYLOAD), ["domain"])


RETRY_STATISTICS = f"""{_LOG}, c AS (
  SELECT domain, count(*) FILTER (attempt = 1 AND ok) AS first_success, count(*) FILTER (attempt = 1 AND NOT ok) AS first_failed, count(*) FILTER (attempt > 1 AND ok) AS retry_success, count(*) FILTER (attempt > 1 AND NOT ok) AS retry_failed FROM l GROUP BY domain
), t AS (
  SELECT domain, count(*) AS cases, count(*) FILTER (succeeded AND attempt > 1) AS recovered, count(*) FILTER (NOT succeeded) AS unresolved, CAST(sum(attempts) AS BIGINT) AS attempts FROM state GROUP BY domain
) SELECT *, round(first_success / cases, 6) AS first_completion, round((cases - unresolved) / cases, 6) AS completion FROM c JOIN t USING (domain)"""


def retries_due(spark, sf_dir):
    """Cases to be tried again, some of which the log does not know."""
    log = _log(spark, sf_dir)
    return attempts.due(log.select("case_id"), attempts.fold(log.where("case_id % 7 <> 0"), _PAYLOAD))


RETRIES_DUE = f"{_LOG} SELECT case_id, CASE WHEN case_id % 7 = 0 THEN 1 ELSE last_attempt END + 1 AS attempt FROM s WHERE case_id % 7 = 0 OR NOT succeeded"


def _predictions(spark, sf_dir):
    """A row an atom; of every 5th case the second is missing, of every 7th the first comes twice; every 13th call failed."""
    turns = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("case_id"), (F.col("turn") + 1).alias("atom_index"), F.col("role").alias("atom_type"))
    twice = turns.where("case_id % 7 = 0 AND atom_index = 1").withColumn("atom_index", F.lit(0).cast("long"))
    rows = turns.where("NOT (case_id % 5 = 0 AND atom_index = 2)").unionByName(twice)
    failed = F.col("case_id") % 13 == 0
    review = F.when((F.col("case_id") % 17 == 0) | (F.col("case_id") % 33 == 0), "non_propositional").otherwise("valid_claim")
    return rows.withColumn("status", F.when(failed, "failed").otherwise("success")).withColumn("review_status", F.when(~failed, review))


_PREDICTIONS = """WITH t AS (SELECT conv_id AS case_id, turn + 1 AS i, role FROM conversations), a AS (
  SELECT * FROM t WHERE NOT (case_id % 5 = 0 AND i = 2) UNION ALL SELECT case_id, 0, role FROM t WHERE case_id % 7 = 0 AND i = 1
), p AS (
  SELECT *, CASE WHEN case_id % 13 = 0 THEN 'failed' ELSE 'success' END AS status, CASE WHEN case_id % 13 = 0 THEN NULL WHEN case_id % 17 = 0 OR case_id % 33 = 0 THEN 'non_propositional' ELSE 'valid_claim' END AS review_status FROM a
)"""


def group_statuses(spark, sf_dir):
    """H8: some cases with rows that contradict each other."""
    rows = _predictions(spark, sf_dir).withColumn("status", F.when((F.col("case_id") % 26 == 0) & (F.col("atom_index") == 1), "success").otherwise(F.col("status")))
    return attempts.group_status(rows.withColumn("review_status", F.when((F.col("case_id") % 9 == 0) & (F.col("atom_index") == 1), "unsure").otherwise(F.col("review_status"))))


GROUP_STATUSES = f"""{_PREDICTIONS}, r AS (
  SELECT case_id, CASE WHEN case_id % 26 = 0 AND i = 1 THEN 'success' ELSE status END AS status, CASE WHEN case_id % 9 = 0 AND i = 1 THEN 'unsure' ELSE review_status END AS v FROM p
), g AS (
  SELECT case_id, count(*) AS n, count(*) FILTER (status = 'failed') AS f, min(v) AS low, max(v) AS high, count(v) AS told FROM r GROUP BY case_id
), k AS (
  SELECT *, CASE WHEN f > 0 AND f < n THEN 'mixed' WHEN f = n THEN NULL WHEN low <> high OR told > 0 AND told < n THEN 'answers' WHEN NOT coalesce(low IN ('valid_claim', 'non_propositional'), false) THEN 'unexpected' END AS finding FROM g
) SELECT case_id, CASE WHEN finding IS NULL THEN CASE WHEN f = n THEN 'provider_failed' ELSE low END END AS p_status, finding FROM k"""


def _cases(spark, sf_dir):
    turns = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("case_id"), (F.col("turn") + 1).alias("atom_index"), F.col("role").alias("atom_type"))
    kind = lambda n: F.when(F.col(n) == 1, "atomic").when(F.col(n) <= 3, "compound").otherwise("relational")
    none = F.col("case_id") % 11 == 0
    truth = atoms.structure(turns).withColumn("class", kind("n_atoms")).withColumn("status", F.when(none, "non_propositional").otherwise("valid_claim"))
    truth = truth.withColumns({"bucket": F.when(none, "non_propositional").otherwise(F.col("class")), "domain": F.concat(F.lit("d"), F.col("case_id") % 5)})
    truth = truth.withColumn("subtype", F.when(F.col("bucket") == "relational", F.when(F.col("case_id") % 3 == 0, "causal").when(F.col("case_id") % 3 == 1, "temporal").otherwise("")))
    rows = _predictions(spark, sf_dir)
    shape = atoms.structure(rows).withColumn("p_class", kind("n_atoms")).withColumnsRenamed({"n_atoms": "p_n", "types": "p_types"})
    predicted = attempts.group_status(rows).select("case_id", "p_status").join(shape, "case_id")
    told = F.col("p_status") == "valid_claim"
    return attempts.evaluated_cases(truth, predicted.select("case_id", "p_status", *[F.when(told, F.col(c)).alias(c) for c in ("p_class", "p_n", "p_types")]))


_KIND = "CASE WHEN n = 1 THEN 'atomic' WHEN n <= 3 THEN 'compound' ELSE 'relational' END"
_CASES = f"""{_PREDICTIONS}, tr AS (
  SELECT *, {_KIND} AS cl, case_id % 11 <> 0 AS valid FROM (SELECT case_id, count(*) AS n, string_agg(role, '>' ORDER BY i) AS types FROM t GROUP BY case_id)
), pr AS (
  SELECT case_id, st, CASE WHEN st = 'valid_claim' THEN n END AS pn, CASE WHEN st = 'valid_claim' THEN types END AS pt, CASE WHEN st = 'valid_claim' THEN {_KIND} END AS pc
  FROM (SELECT case_id, coalesce(any_value(review_status), 'provider_failed') AS st, count(*) AS n, string_agg(role, '>' ORDER BY i, role) AS types FROM p GROUP BY case_id)
), m AS (
  SELECT *, CASE WHEN valid THEN cl ELSE 'non_propositional' END AS bucket, 'd' || case_id % 5 AS domain, valid AND st = 'valid_claim' AS ev,
    CASE WHEN st = 'provider_failed' THEN st WHEN valid THEN CASE WHEN st = 'valid_claim' THEN 'TN' ELSE 'FP' END WHEN st = 'valid_claim' THEN 'FN' ELSE 'TP' END AS detection FROM tr LEFT JOIN pr USING (case_id)
), k AS (
  SELECT *, CASE WHEN bucket = 'relational' THEN ['causal', 'temporal', 'unspecified'][case_id % 3 + 1] END AS subtype, ev AND cl = pc AS c1, ev AND n = pn AS c2, ev AND types = pt AS c3, ev AND cl = pc AND n = pn AND types = pt AS c4,
    CASE WHEN ev THEN pn - n WHEN detection = 'FP' THEN -n END AS delta FROM m
), d AS (
  SELECT *, CASE WHEN valid AND NOT c4 THEN CASE WHEN delta IS NULL THEN 'not_evaluable' WHEN delta > 0 THEN 'over_atomized' WHEN delta < 0 THEN 'under_atomized' ELSE 'count_equal_structure_wrong' END END AS direction FROM k
)"""


def external_evaluation(spark, sf_dir):
    """H7: of each bucket's domain."""
    return attempts.external_scores(_cases(spark, sf_dir), ["domain"])


_RATE = "round(coalesce({} / nullif({}, 0), 0), 6)"
EXTERNAL_EVALUATION = f"""{_CASES}, s AS (
  SELECT domain, count(*) AS cases, count(*) FILTER (detection = 'TP') AS tp, count(*) FILTER (detection = 'FP') AS fp, count(*) FILTER (detection = 'FN') AS fn, count(*) FILTER (detection = 'TN') AS tn,
    count(*) FILTER (detection = 'provider_failed') AS provider_failed, count(*) FILTER (valid) AS valid, count(*) FILTER (ev) AS evaluable, count(*) FILTER (c1) AS r1, count(*) FILTER (c2) AS r2, count(*) FILTER (c3) AS r3, count(*) FILTER (c4) AS r4,
    count(*) FILTER (delta > 0) AS over, count(*) FILTER (delta < 0) AS under, CAST(coalesce(sum(n) FILTER (valid), 0) AS BIGINT) AS expected_atoms, CAST(coalesce(sum(pn) FILTER (ev), 0) AS BIGINT) AS predicted_atoms FROM d GROUP BY domain
), x AS (
  SELECT * EXCLUDE (r1, r2, r3, r4), {_RATE.format('tp', 'tp + fp')} AS non_propositional_precision, {_RATE.format('tp', 'tp + fn')} AS non_propositional_recall, {_RATE.format('tn', 'tn + fp')} AS specificity, {_RATE.format('(tp + tn)', 'tp + fp + fn + tn')} AS detection_accuracy,
    {_RATE.format('(tp + fp + fn + tn)', 'cases')} AS detection_coverage, {_RATE.format('evaluable', 'valid')} AS structural_coverage, {_RATE.format('(predicted_atoms - expected_atoms)', 'expected_atoms')} AS inflation,
    {_RATE.format('r1', 'valid')} AS class_accuracy, {_RATE.format('r1', 'evaluable')} AS evaluable_class_accuracy, {_RATE.format('r2', 'valid')} AS count_accuracy, {_RATE.format('r2', 'evaluable')} AS evaluable_count_accuracy,
    {_RATE.format('r3', 'valid')} AS type_sequence_accuracy, {_RATE.format('r3', 'evaluable')} AS evaluable_type_sequence_accuracy, {_RATE.format('r4', 'valid')} AS exact_structure_accuracy, {_RATE.format('r4', 'evaluable')} AS evaluable_exact_structure_accuracy FROM s
), y AS (
  SELECT *, concat_ws(',', CASE WHEN exact_structure_accuracy < 0.9 THEN 'exact_structure_accuracy' END, CASE WHEN count_accuracy < 0.95 THEN 'count_accuracy' END, CASE WHEN non_propositional_recall < 0.85 THEN 'non_propositional_recall' END,
    CASE WHEN non_propositional_precision < 0.9 THEN 'non_propositional_precision' END, CASE WHEN detection_coverage < 0.95 THEN 'detection_coverage' END) AS missed FROM x
) SELECT *, CASE WHEN missed = '' THEN 'CONTINUE' ELSE 'INVESTIGATE' END AS decision FROM y"""


def failure_analysis(spark, sf_dir):
    """H10."""
    return attempts.failure_analysis(_cases(spark, sf_dir))


FAILURE_ANALYSIS = f"""{_CASES}, g AS (
  SELECT CASE grouping_id(detection, direction, bucket, domain, subtype, cl, pcl, types, ptypes) WHEN 255 THEN 'detection' WHEN 383 THEN 'direction' WHEN 447 THEN 'bucket' WHEN 479 THEN 'domain' WHEN 495 THEN 'subtype' WHEN 499 THEN 'class' WHEN 508 THEN 'types' ELSE 'pattern' END AS dimension,
    detection, direction, bucket, domain, subtype, cl, pcl, types, ptypes, count(*) AS n, count(*) FILTER (valid) AS v, count(direction) AS f, count(*) FILTER (direction IS NOT NULL AND types IS DISTINCT FROM pt) AS tf
  FROM (SELECT *, coalesce(pc, 'non_propositional') AS pcl, coalesce(pt, 'none') AS ptypes FROM d)
  GROUP BY GROUPING SETS ((detection), (direction), (bucket), (domain), (subtype), (cl, pcl), (types, ptypes), (bucket, direction))
), r AS (
  SELECT dimension, CASE dimension WHEN 'detection' THEN detection WHEN 'direction' THEN direction WHEN 'domain' THEN domain WHEN 'subtype' THEN subtype WHEN 'class' THEN cl WHEN 'types' THEN types ELSE bucket END AS value,
    CASE dimension WHEN 'class' THEN pcl WHEN 'types' THEN ptypes WHEN 'pattern' THEN direction ELSE '' END AS other, CASE WHEN dimension = 'detection' THEN n ELSE v END AS cases,
    CASE dimension WHEN 'detection' THEN CASE WHEN detection IN ('FP', 'FN', 'provider_failed') THEN n ELSE 0 END WHEN 'types' THEN tf ELSE f END AS failures FROM g
), w AS (
  SELECT r.dimension, r.value, r.other, CASE WHEN r.dimension = 'pattern' THEN b.cases ELSE r.cases END AS cases, r.failures FROM r LEFT JOIN r AS b ON b.dimension = 'bucket' AND b.value = r.value
  WHERE r.value IS NOT NULL AND r.other IS NOT NULL AND (r.failures > 0 OR r.dimension IN ('detection', 'bucket'))
) SELECT *, round(coalesce(failures / nullif(cases, 0), 0), 6) AS rate, CAST(row_number() OVER (PARTITION BY dimension ORDER BY failures DESC, value, other) AS INT) AS place FROM w"""


def replaced_predictions(spark, sf_dir):
    """Failed predictions replaced by the rows of their first retry that succeeded; every third has none."""
    rows = _predictions(spark, sf_dir)
    again = rows.where("status = 'failed'").select("case_id", "atom_index", "atom_type", F.explode(F.array(F.lit(2), F.lit(3), F.lit(4))).alias("attempt"))
    again = again.withColumn("status", F.when((F.col("case_id") % 3 == 0) | (F.col("attempt") == 2), "failed").otherwise("success")).withColumn("review_status", F.concat(F.lit("retry"), "attempt"))
    return attempts.replaced(rows, again)


REPLACED_PREDICTIONS = f"{_PREDICTIONS} SELECT case_id, i AS atom_index, role AS atom_type, CASE WHEN status = 'failed' AND case_id % 3 <> 0 THEN 'success' ELSE status END AS status, CASE WHEN status = 'failed' AND case_id % 3 <> 0 THEN 'retry3' ELSE review_status END AS review_status FROM p"


QUERIES = {
    "attempt_states": (attempt_states, ATTEMPT_STATES),
    "retry_statistics": (retry_statistics, RETRY_STATISTICS),
    "retries_due": (retries_due, RETRIES_DUE),
    "group_statuses": (group_statuses, GROUP_STATUSES),
    "external_evaluation": (external_evaluation, EXTERNAL_EVALUATION),
    "failure_analysis": (failure_analysis, FAILURE_ANALYSIS),
    "replaced_predictions": (replaced_predictions, REPLACED_PREDICTIONS),
}
