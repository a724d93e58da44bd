"""Revision cycles: tasks of bounded size, whatever the tables hold."""

from datetime import datetime, timedelta

from corpusloom.operators import lifecycle

DAY = datetime(2024, 1, 1)
FORMATS = "format_id long, document_id long, format_type string, revision_of long"
EVALUATIONS = "format_id long, evaluation_id long, created_at timestamp, verdict string"


def _tables(spark, n):
    formats = [(i, i // 4, "quiz", i - 4 if i % 10 == 9 else None) for i in range(n)]
    # one format has a third of the evaluations; equal times are told apart by the id
    evaluations = [(5 if i % 3 == 0 else i % n, i, DAY + timedelta(days=i // 7 % 11), f"v{i * 37 % 101}") for i in range(2 * n)]
    return formats, evaluations, spark.createDataFrame(formats, FORMATS), spark.createDataFrame(evaluations, EVALUATIONS)


def test_rows_of_cycles(spark):
    formats, evaluations, *tables = _tables(spark, 400)
    newest, number = {}, {}
    for f, i, at, verdict in evaluations:
        newest[f] = max(newest.get(f, ((DAY, -1), "")), ((at, i), verdict))
        number[f] = number.get(f, 0) + 1
    wanted = set()
    for f, document, kind, of in formats:
        if of is None:
            mine = [x[0] for x in formats if x[3] == f]
            revision = min(mine, default=None)
            verdict = newest.get(revision, newest.get(f, (None, None)))[1]
            wanted.add((document, kind, f, revision, len(mine), verdict, number.get(f, 0) + number.get(revision, 0)))
    rows = [tuple(r) for r in lifecycle.revision_cycles(*tables).collect()]
    assert len(rows) == len(wanted) and set(rows) == wanted


def test_more_rows_make_more_tasks_not_larger_ones(spark, monkeypatch):
    monkeypatch.setattr(lifecycle, "TASK_ROWS", 100, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        *_, formats, evaluations = _tables(spark, 3000)
        sizes = lifecycle.revision_cycles(formats, evaluations).rdd.glom().map(len).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(sizes) == 90 and max(sizes) < 5 * 2700 / 90
