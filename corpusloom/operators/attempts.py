"""Repeated provider calls: the log of attempts folded to states (H6, H15), and evaluation with failed calls.

A log is append-only: rows (case_id, attempt, ok, payload columns). The first success of a case wins, of failures the
newest stands for it. A state holds what a log says up to its newest attempt, so a log can be compacted as it grows:
``advance`` takes a state and the rows that came since and gives the state of the whole log. A row whose attempt the
state has already passed came late or twice and changes nothing; ``late_attempts`` lists those that were never counted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.atoms import THRESHOLDS

#: Columns of a state besides the case and the payload.
STATE = ("succeeded", "attempt", "attempts", "failed_attempts", "last_attempt")
# Answers of a provider that answered.
ANSWERS = ("valid_claim", "non_propositional")


def fold(log: DataFrame, payload: list[str]) -> DataFrame:
    """State of each case: succeeded, attempt (that stands for it), attempts, failed_attempts, last_attempt, payload.

    Rows of one case and attempt count once; the one with a success, if any, is taken. Null attempts are not counted.
    """
    best = F.struct(F.col("ok").cast("int").alias("ok"), *payload)
    once = log.where("attempt IS NOT NULL AND ok IS NOT NULL").groupBy("case_id", "attempt").agg(F.max(best).alias("r")).select("case_id", "attempt", (F.col("r.ok") == 1).alias("ok"), *[F.col(f"r.{c}").alias(c) for c in payload])
    # the least stands for the case: successes first, the earliest; then failures, the newest
    rank = F.struct((~F.col("ok")).cast("int"), F.when(F.col("ok"), F.col("attempt")).otherwise(-F.col("attempt")))
    kept = F.min_by(F.struct("ok", "attempt", *payload), rank).alias("r")
    counts = [F.count("*").alias("attempts"), F.count_if(~F.col("ok")).alias("failed_attempts"), F.max("attempt").alias("last_attempt")]
    states = once.groupBy("case_id").agg(kept, *counts)
    return states.select("case_id", F.col("r.ok").alias("succeeded"), "r.attempt", "attempts", "failed_attempts", "last_attempt", *[F.col(f"r.{c}").alias(c) for c in payload])


def advance(state: DataFrame, log: DataFrame, payload: list[str]) -> DataFrame:
    """The state after the rows of a log that came since: equal to the fold of the whole log."""
    newer = _against(state, log).where("__passed IS NULL OR attempt > __passed").drop("__passed")
    came = fold(newer, payload)
    both = state.select("case_id", F.struct(*STATE, *payload).alias("a")).join(came.select("case_id", F.struct(*STATE, *payload).alias("b")), "case_id", "full")
    # an old success stands, else whatever came
    stands = F.when(F.col("b").isNull() | F.coalesce(F.col("a.succeeded"), F.lit(False)), F.col("a")).otherwise(F.col("b"))
    summed = lambda c: (F.coalesce(F.col(f"a.{c}"), F.lit(0)) + F.coalesce(F.col(f"b.{c}"), F.lit(0))).alias(c)
    rows = both.withColumn("r", stands)
    return rows.select(
        "case_id", F.col("r.succeeded").alias("succeeded"), F.col("r.attempt").alias("attempt"), summed("attempts"), summed("failed_attempts"), F.greatest("a.last_attempt", "b.last_attempt").alias("last_attempt"), *[F.col(f"r.{c}").alias(c) for c in payload]
    )


def _against(state: DataFrame, log: DataFrame) -> DataFrame:
    return log.join(state.select("case_id", F.col("last_attempt").alias("__passed")), "case_id", "left")


def late_attempts(state: DataFrame, earlier: DataFrame, log: DataFrame) -> DataFrame:
    """(case_id, attempt) of the rows of a log that a state has passed and that the earlier log does not have."""
    passed = _against(state, log).where("attempt <= __passed").select("case_id", "attempt")
    return passed.join(earlier.select("case_id", "attempt"), ["case_id", "attempt"], "left_anti").distinct()


def due(cases: DataFrame, state: DataFrame) -> DataFrame:
    """(case_id, attempt) of the cases to be tried again: those without a success; the first retry is attempt 2."""
    known = state.select("case_id", "succeeded", "last_attempt")
    rows = cases.select("case_id").distinct().join(known, "case_id", "left").where("NOT coalesce(succeeded, false)")
    return rows.select("case_id", (F.coalesce("last_attempt", F.lit(1)) + 1).alias("attempt"))


def replaced(predictions: DataFrame, retries: DataFrame) -> DataFrame:
    """Predictions, several rows a case, with those of failed cases replaced by the rows of the first retry that succeeded.

    Both have (case_id, status, ...), retries also attempt. Rows of successes, and of failures that no retry mended, stay.
    """
    failed = predictions.where("status = 'failed'").select("case_id").distinct()
    won = retries.where("status = 'success'").groupBy("case_id").agg(F.min("attempt").alias("attempt")).join(failed, "case_id", "left_semi")
    new = retries.where("status = 'success'").join(won, ["case_id", "attempt"], "left_semi").select(predictions.columns)
    return predictions.join(won, "case_id", "left_anti").unionByName(new)


def retry_statistics(log: DataFrame, state: DataFrame, by: list[str] | None = None) -> DataFrame:
    """H6: first_success, first_failed, first_completion, retry_success, retry_failed, recovered, unresolved, completion; by payload columns of both."""
    by = by or []
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    first, ok = F.col("attempt") == 1, F.col("ok")
    calls = log.select("case_id", "attempt", "ok", *by).groupBy("case_id", "attempt", *by).agg(F.max("ok").alias("ok")).groupBy(*by).agg(
        F.count_if(first & ok).alias("first_success"), F.count_if(first & ~ok).alias("first_failed"), F.count_if(~first & ok).alias("retry_success"), F.count_if(~first & ~ok).alias("retry_failed")
    )
    cases = state.groupBy(*by).agg(
        F.count("*").alias("cases"), F.count_if(F.col("succeeded") & (F.col("attempt") > 1)).alias("recovered"), F.count_if(~F.col("succeeded")).alias("unresolved"), F.sum("attempts").alias("attempts")
    )
    rows = calls.join(cases, by) if by else calls.crossJoin(cases)  # one row each
    return rows.withColumn("first_completion", rate(F.col("first_success"), F.col("cases"))).withColumn("completion", rate(F.col("cases") - F.col("unresolved"), F.col("cases")))


def group_status(predictions: DataFrame) -> DataFrame:
    """H8: (case_id, p_status, finding) of prediction rows (case_id, status, review_status).

    A case whose rows all failed is ``provider_failed``; else its one answer. finding is ``mixed`` if only some rows
    failed, ``answers`` if they disagree, ``unexpected`` for an answer that there is not; such a case has no status.
    """
    rows = predictions.groupBy("case_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("status").eqNullSafe("failed")).alias("failed"), F.min("review_status").alias("low"), F.max("review_status").alias("high"), F.count("review_status").alias("told")
    )
    some, all_ = F.col("failed") > 0, F.col("failed") == F.col("n")
    finding = (
        F.when(some & ~all_, "mixed").when(all_, F.lit(None)).when((F.col("low") != F.col("high")) | (F.col("told") > 0) & (F.col("told") < F.col("n")), "answers")
        .when(~F.coalesce(F.col("low").isin(*ANSWERS), F.lit(False)), "unexpected")
    )
    found = rows.withColumn("finding", finding)
    return found.select("case_id", F.when(F.col("finding").isNull(), F.when(all_, "provider_failed").otherwise(F.col("low"))).alias("p_status"), "finding")


def evaluated_cases(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """The table of cases that H7 and H10 sum up.

    truth: (case_id, bucket, domain, subtype, status, class, n_atoms, types), predicted: (case_id, p_status, p_class, p_n,
    p_types) with p_status as by ``group_status``; a case without prediction has failed at the provider. Matches and
    delta are null where they cannot be told; a claim wrongly found to be none has lost all its atoms.
    """
    rows = truth.join(predicted, "case_id", "left").withColumn("p_status", F.coalesce("p_status", F.lit("provider_failed")))
    valid, told = F.col("status") == "valid_claim", F.col("p_status") == "valid_claim"
    positive, found, failed = F.col("status") == "non_propositional", F.col("p_status") == "non_propositional", F.col("p_status") == "provider_failed"
    rows = rows.withColumn("detection", F.when(failed, "provider_failed").when(positive & found, "TP").when(valid & found, "FP").when(positive & told, "FN").when(valid & told, "TN"))
    evaluable = valid & told
    match = {
        "class_match": F.col("class").eqNullSafe(F.col("p_class")), "count_match": F.col("n_atoms").eqNullSafe(F.col("p_n")), "types_match": F.col("types").eqNullSafe(F.col("p_types")),
    }
    rows = rows.withColumns({name: F.when(evaluable, hit) for name, hit in match.items()})
    rows = rows.withColumn("exact_match", F.when(evaluable, F.col("class_match") & F.col("count_match") & F.col("types_match")))
    rows = rows.withColumn("evaluable", evaluable).withColumn("delta", F.when(evaluable, F.col("p_n") - F.col("n_atoms")).when(valid & found, -F.col("n_atoms")))
    direction = F.when(F.col("delta").isNull(), "not_evaluable").when(F.col("delta") > 0, "over_atomized").when(F.col("delta") < 0, "under_atomized").otherwise("count_equal_structure_wrong")
    return rows.withColumn("direction", F.when(valid & ~F.coalesce("exact_match", F.lit(False)), direction))


def external_scores(cases: DataFrame, by: list[str] | None = None) -> DataFrame:
    """H7: detection, structure and thresholds of evaluated cases.

    Structure has two denominators: all valid claims, and (``evaluable_``) those that the provider answered as claims.
    Thresholds are held against exact rates; the shown ones have six digits.
    """
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    at = lambda name: count(F.col("detection") == name)
    valid, evaluable = F.col("status") == "valid_claim", F.col("evaluable")
    sums = cases.groupBy(*(by or [])).agg(
        F.count("*").alias("cases"), at("TP").alias("tp"), at("FP").alias("fp"), at("FN").alias("fn"), at("TN").alias("tn"), at("provider_failed").alias("provider_failed"), count(valid).alias("valid"), count(evaluable).alias("evaluable"),
        *[count(F.col(f"{m}_match")).alias(f"{m}_right") for m in ("class", "count", "types", "exact")], count(F.col("delta") > 0).alias("over"), count(F.col("delta") < 0).alias("under"),
        F.coalesce(F.sum(F.when(valid, F.col("n_atoms"))), F.lit(0)).alias("expected_atoms"), F.coalesce(F.sum(F.when(evaluable, F.col("p_n"))), F.lit(0)).alias("predicted_atoms"),
    )
    rate = lambda a, b: f"coalesce(try_divide({a}, {b}), 0D)"
    rates = {
        "non_propositional_precision": rate("tp", "tp + fp"), "non_propositional_recall": rate("tp", "tp + fn"), "specificity": rate("tn", "tn + fp"), "detection_accuracy": rate("tp + tn", "tp + fp + fn + tn"),
        "detection_coverage": rate("tp + fp + fn + tn", "cases"), "structural_coverage": rate("evaluable", "valid"), "inflation": rate("predicted_atoms - expected_atoms", "expected_atoms"),
    }
    for name, right in (("class_accuracy", "class_right"), ("count_accuracy", "count_right"), ("type_sequence_accuracy", "types_right"), ("exact_structure_accuracy", "exact_right")):
        rates |= {name: rate(right, "valid"), f"evaluable_{name}": rate(right, "evaluable")}
    told = sums.withColumns({name: F.expr(e) for name, e in rates.items()})
    missed = F.array_compact(F.array(*[F.when(F.col(name) < least, F.lit(name)) for name, least in THRESHOLDS.items()]))
    told = told.withColumn("missed", F.array_join(missed, ",")).withColumn("decision", F.when(F.col("missed") == "", "CONTINUE").otherwise("INVESTIGATE"))
    return told.withColumns({name: F.round(name, 6) for name in rates}).drop("class_right", "count_right", "types_right", "exact_right")


#: Dimensions of the failure analysis: name, columns.
DIMENSIONS = (
    ("detection", ("detection",)), ("direction", ("direction",)), ("bucket", ("bucket",)), ("domain", ("domain",)), ("subtype", ("subtype",)), ("class", ("class", "p_class")),
    ("types", ("types", "p_types")), ("pattern", ("bucket", "direction")),
)


def failure_analysis(cases: DataFrame) -> DataFrame:
    """(dimension, value, other, cases, failures, rate, place) of evaluated cases, all dimensions in one pass.

    ``detection`` counts all cases; the other dimensions count structural failures: valid claims without an exact match.
    ``subtype`` is of relational failures only, ``types`` of those whose types differ; an answer that the provider did not
    give is ``none`` among types and ``non_propositional`` among classes. rate is the share of failures among the valid
    claims of that value (of a pattern: of its bucket); place 1 is the dominant value of a dimension.
    """
    failed = F.col("direction").isNotNull()
    rows = cases.select(
        "detection", "direction", "bucket", "domain", F.when(F.col("bucket") == "relational", F.coalesce(F.nullif("subtype", F.lit("")), F.lit("unspecified"))).alias("subtype"),
        F.coalesce("class", F.lit("")).alias("class"), F.coalesce("p_class", F.lit("non_propositional")).alias("p_class"), F.coalesce("types", F.lit("")).alias("types"), F.coalesce("p_types", F.lit("none")).alias("p_types"),
        (F.col("status") == "valid_claim").cast("long").alias("valid"), failed.cast("long").alias("failed"), F.when(failed, ~F.col("types").eqNullSafe(F.col("p_types"))).cast("long").alias("types_differ"),
    )
    columns = list(dict.fromkeys(c for _, of in DIMENSIONS for c in of))
    grouped = rows.groupingSets([list(of) for _, of in DIMENSIONS], *columns).agg(
        F.grouping_id(*columns).alias("set"), F.count("*").alias("all"), F.sum("valid").alias("valid"), F.sum("failed").alias("failed"), F.sum("types_differ").alias("types_differ")
    )
    bit = {c: 1 << (len(columns) - 1 - i) for i, c in enumerate(columns)}
    of_set = {name: reduce(lambda m, c: m & ~bit[c], of, (1 << len(columns)) - 1) for name, of in DIMENSIONS}
    pick = lambda choose: reduce(lambda e, x: F.when(F.col("set") == of_set[x[0]], choose(x)).otherwise(e), DIMENSIONS, F.lit(None))
    named = grouped.select(
        pick(lambda x: F.lit(x[0])).alias("dimension"), pick(lambda x: F.col(x[1][0])).alias("value"), pick(lambda x: F.col(x[1][1]) if len(x[1]) > 1 else F.lit("")).alias("other"), "all", "valid", "failed", "types_differ"
    )
    cases_of = F.when(F.col("dimension") == "detection", F.col("all")).otherwise(F.col("valid"))
    failures = F.when(F.col("dimension") == "detection", F.when(F.col("value").isin("FP", "FN", "provider_failed"), F.col("all")).otherwise(0)).when(F.col("dimension") == "types", F.col("types_differ")).otherwise(F.col("failed"))
    counted = named.select("dimension", "value", "other", cases_of.alias("cases"), F.coalesce(failures, F.lit(0)).alias("failures"))
    return _placed(counted)


def _placed(counted: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    kept = counted.where("value IS NOT NULL AND other IS NOT NULL AND (failures > 0 OR dimension IN ('detection', 'bucket'))")
    # a pattern's rate is of all valid claims of its bucket; the values of a dimension are few, or cut to those that failed
    whole = F.sum(F.when(F.col("dimension") == "bucket", F.col("cases"))).over(Window.partitionBy(F.when(F.col("dimension").isin("bucket", "pattern"), F.col("value")).otherwise(F.concat_ws("|", "dimension", "value", "other"))))
    rated = kept.withColumn("cases", F.when(F.col("dimension") == "pattern", whole).otherwise(F.col("cases")))
    rated = rated.withColumn("rate", F.round(F.coalesce(F.try_divide("failures", "cases"), F.lit(0.0)), 6))
    return rated.withColumn("place", F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("failures"), "value", "other")))
