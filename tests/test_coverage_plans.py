"""Coverage of the lines of a case: its keywords are held once, and causes are put together of pieces."""

from pyspark.sql import functions as F

from corpusloom.operators import metrics


def test_keywords_are_not_in_every_line(spark):
    keywords = [f"keyword{i}" for i in range(300)]
    lines = [f"Keyword{i} x" for i in range(200)]
    cases = spark.createDataFrame([(1, keywords, lines)], "case_id long, keywords array<string>, texts array<string>")
    found = metrics.list_coverage(cases)
    assert "keywords" not in found.select("covered").schema.simpleString()
    row = found.select(F.size("covered").alias("n"), "any_at", "enough_at", F.get("covered", F.lit(199)).running.alias("last")).first()
    assert tuple(row) == (200, 1, 150, 200 / 300)
    ranked = cases.select("case_id", "keywords", F.posexplode("texts").alias("i", "text")).withColumn("rank", F.col("i") + 1)
    plan = metrics.running_coverage(ranked).select("case_id", "rank", "running")
    # no element of a list holds the keywords of its case
    assert not [x for x in plan._jdf.queryExecution().optimizedPlan().toString().split("collect_list(")[1:] if "keywords" in x.split("AS")[0]]
    assert {r.rank: r.running for r in plan.collect()}[200] == 200 / 300


def test_causes_of_cases_with_and_without_ids(spark):
    rows = spark.createDataFrame([("a", f"{i:09d}", "g2" if i % 2 else "g1") for i in range(3000)][::-1] + [("a", None, "g3"), ("b", None, None), ("b", "x", None)], "cause string, case_id string, source string")
    got = {r.cause: tuple(r)[1:] for r in metrics.cause_summary(rows, "cause", "case_id", "source").collect()}
    assert got == {"a": (3001, ";".join(f"{i:09d}" for i in range(3000)), "g1;g2;g3"), "b": (2, "x", "")}


def test_coverage_equals_search_of_each_keyword(spark):
    keywords = [["planet", "planets", "PLANÉTS x", "a.b", "zz", "", "moon", "x planets"], ["moon", "moon", None], ["one\x1ftwo", "One"], [" Moon ", "no"], [], ["x"]]
    texts = [["Planetst here", "the planéts", " X planets", "a.b moonlight"], ["Moon", "moon"], ["one", None], ["a moon", ""], ["x"], [None]]
    plain = lambda c: " ".join((c or "").lower().replace("é", "e").split())
    rows = spark.createDataFrame([(i, k, x) for i, (k, x) in enumerate(zip(keywords, texts))], "case_id int, keywords array<string>, texts array<string>")
    whole = F.array_join("texts", " ")
    found = metrics.list_coverage(rows.withColumn("whole", whole)).select("case_id", "covered", metrics.evidence_coverage(F.col("keywords"), F.col("whole")).alias("c"), metrics.evidence_coverage(F.col("keywords"), F.lit(None).cast("string")).alias("none"))
    for r in found.collect():
        keys, lines = [None if k is None else plain(k) for k in keywords[r.case_id]], [plain(x) for x in texts[r.case_id]]
        share = lambda body: sum(k is not None and k in body for k in keys) / len(keys) if keys else 0  # noqa: B023, E731
        assert [x.coverage for x in r.covered] == [share(x) for x in lines]
        assert [x.running for x in r.covered] == [share(" ".join(x for x in lines[: i + 1] if x)) for i in range(len(lines))]
        assert r.c == share(plain(" ".join(x for x in texts[r.case_id] if x is not None))) and r.none == 0
