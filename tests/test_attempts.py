"""Attempt logs, and evaluation with failed calls, on small cases."""

import random

from corpusloom.operators import attempts, datasets

LOG = "case_id string, attempt int, ok boolean, answer string"


def plain(rows):
    """State by case of rows (case, attempt, ok, answer)."""
    cases = {}
    for case, attempt, ok, answer in rows:
        if attempt is not None and ok is not None:
            best = cases.setdefault(case, {}).get(attempt)
            cases[case][attempt] = max(filter(None, [best, (ok, answer)]))
    out = {}
    for case, by in cases.items():
        won = [a for a, (ok, _) in by.items() if ok]
        stands = min(won) if won else max(by)
        out[case] = (bool(won), stands, len(by), sum(not ok for ok, _ in by.values()), max(by), by[stands][1])
    return out


def shown(state):
    return {r.case_id: (r.succeeded, r.attempt, r.attempts, r.failed_attempts, r.last_attempt, r.answer) for r in state.collect()}


def test_any_prefix_carried_on_gives_the_state_of_the_whole_log(spark):
    rng = random.Random(1)
    rows = [(f"c{c}", a, rng.random() < 0.4, f"{c}-{a}") for c in range(12) for a in range(1, rng.randrange(2, 6))]
    rows += [("c0", None, True, "no number"), (None, 1, False, "no case")]
    log = spark.createDataFrame(sorted(rows, key=lambda r: (r[1] or 0)), LOG)
    want = plain(rows)
    assert shown(attempts.fold(log, ["answer"])) == want
    for cut in (0, 1, 3):
        state = attempts.fold(log.where(f"attempt <= {cut}"), ["answer"])
        # the later delivery repeats all that the state has seen
        assert shown(attempts.advance(state, log, ["answer"])) == want


def test_late_and_repeated_rows(spark):
    state = attempts.fold(spark.createDataFrame([("a", 1, False, "x"), ("a", 3, False, "z"), ("b", 1, True, "y")], LOG), ["answer"])
    later = spark.createDataFrame([("a", 2, True, "late"), ("a", 3, False, "z"), ("b", 2, True, "second"), ("c", 1, False, None)], LOG)
    assert shown(attempts.advance(state, later, ["answer"])) == {"a": (False, 3, 2, 2, 3, "z"), "b": (True, 1, 2, 0, 2, "y"), "c": (False, 1, 1, 1, 1, None)}
    earlier = spark.createDataFrame([("a", 1, False, "x"), ("a", 3, False, "z"), ("b", 1, True, "y")], LOG)
    assert [tuple(r) for r in attempts.late_attempts(state, earlier, later).collect()] == [("a", 2)]
    assert shown(attempts.fold(later.limit(0), ["answer"])) == {}


def test_due_and_statistics(spark):
    log = spark.createDataFrame([("a", 1, True, ""), ("b", 1, False, ""), ("b", 2, True, ""), ("c", 1, False, ""), ("c", 2, False, "")], LOG)
    state = attempts.fold(log, ["answer"])
    cases = spark.createDataFrame([(c,) for c in "abcd"], "case_id string")
    assert sorted(map(tuple, attempts.due(cases, state).collect())) == [("c", 3), ("d", 2)]
    r = attempts.retry_statistics(log, state).first()
    assert (r.first_success, r.first_failed, r.retry_success, r.retry_failed, r.cases, r.recovered, r.unresolved, r.first_completion, r.completion) == (1, 2, 1, 1, 3, 1, 1, 0.333333, 0.666667)


def test_replacement_keeps_successes_and_unmended_failures(spark):
    rows = spark.createDataFrame([("a", "success", "1"), ("a", "success", "2"), ("b", "failed", ""), ("c", "failed", "")], "case_id string, status string, atom string")
    again = spark.createDataFrame([("a", 2, "success", "ignored"), ("b", 2, "failed", ""), ("b", 3, "success", "x"), ("b", 3, "success", "y"), ("b", 4, "success", "later"), ("c", 2, "failed", "")], "case_id string, attempt int, status string, atom string")
    assert sorted(map(tuple, attempts.replaced(rows, again).collect())) == [("a", "success", "1"), ("a", "success", "2"), ("b", "success", "x"), ("b", "success", "y"), ("c", "failed", "")]


def test_external_scores_have_two_denominators(spark):
    truth = spark.createDataFrame(
        [("a", "atomic", "d", "", "valid_claim", "atomic", 1, "x"), ("b", "compound", "d", "", "valid_claim", "compound", 2, "x>y"), ("c", "relational", "e", "", "valid_claim", "relational", 1, "x"), ("n", "non_propositional", "e", "", "non_propositional", None, 0, None)],
        "case_id string, bucket string, domain string, subtype string, status string, class string, n_atoms int, types string",
    )
    predicted = spark.createDataFrame(
        [("a", "valid_claim", "atomic", 1, "x"), ("b", "non_propositional", None, None, None), ("n", "non_propositional", None, None, None)], "case_id string, p_status string, p_class string, p_n int, p_types string"
    )
    cases = attempts.evaluated_cases(truth, predicted)
    assert {r.case_id: (r.detection, r.delta, r.direction) for r in cases.collect()} == {"a": ("TN", 0, None), "b": ("FP", -2, "under_atomized"), "c": ("provider_failed", None, "not_evaluable"), "n": ("TP", None, None)}
    r = attempts.external_scores(cases).first()
    assert (r.cases, r.tp, r.fp, r.fn, r.tn, r.provider_failed, r.valid, r.evaluable, r.under, r.over) == (4, 1, 1, 0, 1, 1, 3, 1, 1, 0)
    assert (r.class_accuracy, r.evaluable_class_accuracy, r.detection_coverage, r.inflation, r.decision) == (0.333333, 1.0, 0.75, -0.75, "INVESTIGATE")
    found = {(r.dimension, r.value, r.other): (r.cases, r.failures, r.rate, r.place) for r in attempts.failure_analysis(cases).collect()}
    assert found["pattern", "compound", "under_atomized"] == (1, 1, 1.0, 1) and found["bucket", "atomic", ""][:3] == (1, 0, 0.0)
    assert found["subtype", "unspecified", ""] == (1, 1, 1.0, 1) and found["class", "relational", "non_propositional"][1] == 1
    assert found["detection", "provider_failed", ""][:2] == (1, 1) and found["detection", "TN", ""][:2] == (1, 0)


def test_numbers_of_many_rows_are_dense_and_in_order(spark):
    """More rows and ranges than the sampler of range bounds takes, with columns beside the order."""
    rows = spark.range(1_500_000, numPartitions=24).selectExpr("xxhash64(id) AS k", "id", "repeat('payload', 3) AS payload")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        got = datasets.numbered(rows, ["k"], "C-%08d").selectExpr("k", "cast(substr(candidate_id, 3) as long) AS n")
        low, high, n, distinct = got.selectExpr("min(n)", "max(n)", "count(*)", "count(distinct n)").first()
        assert (low, high, n, distinct) == (1, 1_500_000, 1_500_000, 1_500_000)
        agree = got.join(rows.selectExpr("k").orderBy("k").limit(1000).selectExpr("k", "row_number() over (order by k) AS want"), "k").where("n <> want")
        assert agree.isEmpty()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_batches_of_null_groups_and_hot_strata(spark):
    rows = spark.createDataFrame([(i, "g") for i in range(5)] + [(i, None) for i in range(10, 13)], "id int, g string")
    assert sorted(map(tuple, datasets.batches(rows, "g", "id", 2).collect()), key=str) == sorted([("g", 1, 0, 1, 2), ("g", 2, 2, 3, 2), ("g", 3, 4, 4, 1), (None, 1, 10, 11, 2), (None, 2, 12, 12, 1)], key=str)
    many = spark.range(5000).selectExpr("id", "if(id % 10 < 9, 'hot', 'cold') AS s", "if(id % 10 < 9, 7, 3) AS n")
    picked = datasets.stratified_sample(many, "s", "id", many["n"], "seed")
    order = {s: sorted((r.h, r.id) for r in many.where(f"s = '{s}'").withColumn("h", datasets.stable_rank(many["id"], seed="seed")).collect()) for s in ("hot", "cold")}
    assert {(r.s, r.id, r.pick) for r in picked.collect()} == {(s, i, p + 1) for s, n in (("hot", 7), ("cold", 3)) for p, (_, i) in enumerate(order[s][:n])}
