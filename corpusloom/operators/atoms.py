"""Structural scoring of claim atomisation (H) and its stability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What an evaluation must reach.
THRESHOLDS = {"exact_structure_accuracy": 0.90, "count_accuracy": 0.95, "non_propositional_recall": 0.85, "non_propositional_precision": 0.90, "detection_coverage": 0.95}


def structure(atoms: DataFrame, case: str = "case_id") -> DataFrame:
    """(case, n_atoms, types): the atom types of each case in their order. A case has few atoms by contract."""
    listed = F.array_sort(F.collect_list(F.struct("atom_index", "atom_type")))
    return atoms.groupBy(case).agg(F.count("*").alias("n_atoms"), F.array_join(F.transform(listed, lambda a: a.atom_type), ">").alias("types"))


def atom_rules() -> dict[str, Column]:
    """H1: rows (review_status, atomization_class, n_atoms)."""
    status, kind, n = F.col("review_status"), F.col("atomization_class"), F.col("n_atoms")
    return {
        "non_propositional": (status != "non_propositional") | (kind.isNull() & (n == 0)),
        "valid": (status != "valid") | (kind.isNotNull() & (n >= 1)),
        "atomic": F.coalesce(kind != "atomic", F.lit(True)) | (n == 1),
        "compound": F.coalesce(kind != "compound", F.lit(True)) | (n >= 2),
    }


def index_violations(atoms: DataFrame, case: str = "case_id") -> DataFrame:
    """Cases whose atom numbers are not 1 to n, each once."""
    g = atoms.groupBy(case).agg(F.min("atom_index").alias("low"), F.max("atom_index").alias("high"), F.count("*").alias("n"), F.countDistinct("atom_index").alias("distinct"))
    return g.where("low <> 1 or high <> n or n <> distinct")


def structure_scores(truth: DataFrame, predicted: DataFrame, by: list[str] | None = None) -> DataFrame:
    """H3-H8: truth and predictions (case_id, status, class, n_atoms, types); a case without prediction counts as empty.

    Detection is of cases that are not propositional; structure is scored on all cases that are.
    """
    p = predicted.select("case_id", F.col("status").alias("p_status"), F.col("class").alias("p_class"), F.col("n_atoms").alias("p_n"), F.col("types").alias("p_types"))
    rows = truth.join(p, "case_id", "left").withColumn("p_n", F.coalesce("p_n", F.lit(0)))
    valid, seen = F.col("status") == "valid", F.col("p_status").isNotNull()
    pos, ppos = F.col("status") == "non_propositional", F.coalesce(F.col("p_status") == "non_propositional", F.lit(False))
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    n = count(valid)
    same_class, same_n, same_types = F.col("class").eqNullSafe(F.col("p_class")), F.col("n_atoms") == F.col("p_n"), F.col("types").eqNullSafe(F.col("p_types"))
    return rows.groupBy(*(by or [])).agg(
        F.count("*").alias("cases"), rate(count(seen), F.count("*")).alias("detection_coverage"), rate(count(pos & ppos), count(ppos)).alias("non_propositional_precision"), rate(count(pos & ppos), count(pos)).alias("non_propositional_recall"),
        rate(count(valid & same_class), n).alias("class_accuracy"), rate(count(valid & same_n), n).alias("count_accuracy"), rate(count(valid & same_types), n).alias("type_sequence_accuracy"),
        rate(count(valid & same_class & same_n & same_types), n).alias("exact_structure_accuracy"), count(valid & (F.col("p_n") > F.col("n_atoms"))).alias("over"), count(valid & (F.col("p_n") < F.col("n_atoms"))).alias("under"),
        rate(F.sum(F.when(valid, F.col("p_n") - F.col("n_atoms"))), F.sum(F.when(valid, F.col("n_atoms")))).alias("inflation"),
    )


def version_scores(truth: DataFrame, predicted: DataFrame, versions: list[str]) -> DataFrame:
    """H4: the scores of each version of the predictions (version, case_id, ...) against one truth."""
    out = None
    for version in versions:
        one = structure_scores(truth, predicted.where(F.col("version") == version)).withColumn("version", F.lit(version))
        out = one if out is None else out.unionByName(one)
    return out


def decision(scores: DataFrame) -> DataFrame:
    """H7: thresholds met, and CONTINUE if all are, else INVESTIGATE."""
    met = None
    for name, least in THRESHOLDS.items():
        one = (F.col(name) >= least).cast("int")
        met = one if met is None else met + one
    return scores.withColumn("met", met).withColumn("decision", F.when(F.col("met") == len(THRESHOLDS), "CONTINUE").otherwise("INVESTIGATE"))


def signature(status: Column, kind: Column, n: Column, types: Column) -> Column:
    """Hash of a canonical JSON of the structure, keys sorted."""
    return F.sha2(F.to_json(F.struct(n.alias("atom_count"), types.alias("atom_types"), kind.alias("class"), status.alias("review_status"))), 256)


def stability(runs: DataFrame) -> DataFrame:
    """(case_id) over runs (attempt, ok, signature, latency_ms): successes, distinct structures, latency of successes."""
    ok = F.col("ok")
    g = runs.groupBy("case_id").agg(
        F.count("*").alias("attempts"), F.count_if(ok).alias("successes"), F.countDistinct(F.when(ok, F.col("signature"))).alias("structures"),
        F.round(F.avg(F.when(ok, F.col("latency_ms"))), 6).alias("mean_latency"), F.min(F.when(ok, F.col("latency_ms"))).alias("min_latency"), F.max(F.when(ok, F.col("latency_ms"))).alias("max_latency"),
    )
    return g.withColumn("fully_stable", (F.col("successes") == F.col("attempts")) & (F.col("structures") == 1))


def next_attempt(runs: DataFrame) -> DataFrame:
    """Cases whose newest attempt failed, with the number of the next one."""
    last = runs.groupBy("case_id").agg(F.max("attempt").alias("last"), F.max_by("ok", "attempt").alias("ok"))
    return last.where("not ok").select("case_id", (F.col("last") + 1).alias("attempt"))


def confusion_pairs(truth: DataFrame, predicted: DataFrame, column: str) -> DataFrame:
    """(expected, found, n) of the cases that differ, most frequent first by rank."""
    rows = truth.select("case_id", F.col(column).alias("expected")).join(predicted.select("case_id", F.col(column).alias("found")), "case_id", "left")
    return rows.where("not (expected <=> found)").groupBy("expected", "found").agg(F.count("*").alias("n"))


def truth_totals(cases: DataFrame, atoms: DataFrame, buckets: list[str], expected: dict[str, int]) -> DataFrame:
    """H9: (check, found, expected) of the totals of a ground truth that are not as expected.

    cases: (case_id, bucket, review_status, expected_atoms), atoms: one row an atom. Checks: cases, distinct, valid,
    non_propositional, case_atoms, atom_rows as named in ``expected``; foreign_buckets and unreviewed must be 0.
    """
    bucket, none = F.col("bucket"), F.lit(False)
    totals = cases.agg(
        F.count("*").alias("cases"), F.countDistinct("case_id").alias("distinct"), F.count_if(~F.coalesce(bucket.isin(*buckets), none)).alias("foreign_buckets"), F.count_if(~F.coalesce(F.col("review_status") == "reviewed", none)).alias("unreviewed"),
        F.count_if(~bucket.eqNullSafe("non_propositional")).alias("valid"), F.count_if(bucket == "non_propositional").alias("non_propositional"), F.coalesce(F.sum("expected_atoms"), F.lit(0)).cast("long").alias("case_atoms"),
    )
    totals = totals.crossJoin(atoms.agg(F.count("*").alias("atom_rows")))  # one row each
    wanted = {"foreign_buckets": 0, "unreviewed": 0} | expected
    each = F.array(*[F.struct(F.lit(name).alias("check"), F.col(name).alias("found"), F.lit(n).cast("long").alias("expected")) for name, n in wanted.items()])
    return totals.select(F.inline(each)).where("found <> expected")


def case_findings(cases: DataFrame, frozen: DataFrame, fixed: list[str], bucket_counts: dict[str, int]) -> DataFrame:
    """(case_id, finding) of the cases (case_id, bucket, review_status, expected_atoms as text, fixed columns) that may not be merged.

    Findings: duplicated, unreviewed, atom_count (no number), missing or unexpected against the frozen cases,
    changed:column of those both have, and atoms:bucket where the number of atoms does not suit the bucket. A bucket
    whose size is not as expected is a finding count:bucket without a case.
    """
    n, bucket = F.col("expected_atoms").try_cast("int"), F.col("bucket")
    suits = F.when(bucket.isin("atomic", "relational"), n == 1).when(bucket == "compound", n >= 2).when(bucket == "non_propositional", n == 0).otherwise(True)
    old = frozen.select("case_id", F.lit(True).alias("__frozen"), *[F.col(c).alias(f"__{c}") for c in fixed]).dropDuplicates(["case_id"])
    rows = cases.withColumn("__case", F.lit(True)).join(old, "case_id", "full")
    here, both = F.col("__case").isNotNull(), F.col("__case").isNotNull() & F.col("__frozen").isNotNull()
    rules = {
        "unreviewed": here & ~F.coalesce(F.col("review_status") == "reviewed", F.lit(False)), "atom_count": here & n.isNull(), "missing": F.col("__case").isNull(), "unexpected": F.col("__frozen").isNull(),
    } | {f"changed:{c}": both & ~F.col(c).eqNullSafe(F.col(f"__{c}")) for c in fixed}
    found = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()], F.when(here & ~suits, F.concat(F.lit("atoms:"), bucket))))
    found = rows.select("case_id", F.explode(found).alias("finding")).distinct()
    twice = cases.groupBy("case_id").count().where("count > 1").select("case_id", F.lit("duplicated").alias("finding"))
    sizes = cases.agg(*[F.count_if(bucket == b).alias(b) for b in bucket_counts])
    wrong = F.array_compact(F.array(*[F.when(F.col(b) != k, F.lit(f"count:{b}")) for b, k in bucket_counts.items()]))
    return found.unionByName(twice).unionByName(sizes.select(F.lit(None).cast(cases.schema["case_id"].dataType).alias("case_id"), F.explode(wrong).alias("finding")))
