import json
import math

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as t
from corpusloom.operators import chunking, datasets, graph, lifecycle, metrics, providers, quality, retrieval
from corpusloom.sources import html, readers, sinks
from corpusloom.streaming import lifecycle_stream


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


def test_text_edges(spark):
    assert one(spark, t.clean_whitespace(F.col("x")), x="a \t b\r\n\n\n\nc ") == "a b\n\nc"
    assert one(spark, t.normalize_newlines(F.lit(None).cast("string")), x=1) == ""
    assert one(spark, t.split_sentences(F.col("x")), x="Uno. Dos? ¿Tres! cuatro. 5.") == ["Uno.", "Dos?", "¿Tres! cuatro.", "5."]
    assert one(spark, t.dedup_key(F.col("x")), x=" Página,  ÚNICA! ") == "pagina unica"
    assert one(spark, t.overlap_key(F.col("x")), x="A ,b  ;") == "a,b;"
    assert one(spark, t.markdown_to_plain_text(F.col("x")), x="# T\n> q **b** *i* _u_ `c` [l](u) ![a](u)\n---\n") == "T\nq b i u c l a\n"
    assert one(spark, t.clean_markdown_line(F.col("x")), x="## > - [x] y") == "y"
    assert [one(spark, t.stem(F.col("x")), x=w) for w in ("aparezcan", "visitamos", "importada", "importa", "ver", "actuen")] == ["aparezc", "visit", "import", "import", "ver", "actu"]
    assert one(spark, t.sanitize_filename(F.col("x")), x="/a/..ñ b.md") == "b.md"
    assert one(spark, t.sanitize_filename(F.lit(None).cast("string")), x=1) == "archivo"
    assert one(spark, t.distinct_ignoring_case(F.array(F.lit(" A  b"), F.lit("a B"), F.lit(""))), x=1) == ["A b"]
    assert one(spark, t.shorten(F.col("x")), x="y" * 301) == "y" * 297 + "..."
    assert one(spark, t.id_list_or_literal(F.col("x")), x="['a', \"b\"]") == ["a", "b"]
    assert one(spark, t.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")), x=1) == 1.0


def test_recursive_chunks(spark):
    parts = chunking.split_recursively("aa bb cc dd", 5, 2)
    assert parts == ["aa bb", "cc", "dd"]
    assert chunking.split_recursively("aa bb\n\ncc dd ee", 8, 0) == ["aa bb", "cc dd", "ee"]
    assert "".join(chunking.split_recursively("x" * 25, 10, 0)) == "x" * 25
    with pytest.raises(ValueError):
        chunking.recursive_chunks(None, 10, 10)


def test_block_chunks_carry_whole_blocks(spark):
    text = "\n\n".join(["a" * 500, "b" * 100, "c" * 400])
    got = spark.createDataFrame([("d", text)], "document_id string, text string")
    rows = [r["chunk_text"] for r in chunking.build_chunks(got).orderBy("chunk_index").collect()]
    assert rows == ["a" * 500 + "\n\n" + "b" * 100, "b" * 100 + "\n\n" + "c" * 400]


def test_bm25_against_plain_formula(spark):
    texts = {1: "uno dos tres", 2: "dos dos cuatro", 3: "cinco seis", 4: "siete uno"}
    corpus = spark.createDataFrame(list(texts.items()), "chunk_id long, text string")
    queries = spark.createDataFrame([(1, "dos uno uno zzz")], "query_id long, text string")
    got = {r["chunk_id"]: r["score"] for r in retrieval.bm25_topk(corpus, queries, 10).collect()}
    words = {k: v.split() for k, v in texts.items()}
    df = {w: sum(w in x for x in words.values()) for x in words.values() for w in x}
    idf = {w: math.log(4 - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else floor for w, v in idf.items()}
    avg = sum(map(len, words.values())) / 4
    want = {k: sum(idf.get(q, 0) * x.count(q) * 2.5 / (x.count(q) + 1.5 * (0.25 + 0.75 * len(x) / avg)) for q in "dos uno uno zzz".split()) for k, x in words.items()}
    assert got == {k: round(v, 6) for k, v in want.items() if round(v, 6) > 0}


def test_fusion_ties_and_minmax(spark):
    vector = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, chunk_id int, vector_rank int")
    bm25 = spark.createDataFrame([(1, 11, 1), (1, 10, 2), (1, 12, 3)], "query_id int, chunk_id int, bm25_rank int")
    assert [r["chunk_id"] for r in retrieval.rrf(vector, bm25).orderBy("rrf_rank").collect()] == [10, 11, 12]
    same = spark.createDataFrame([(1, 2.0), (1, 2.0)], "query_id int, v double").select(retrieval.minmax("v", ["query_id"]).alias("x"))
    assert [r["x"] for r in same.collect()] == [1.0, 1.0]


def test_metrics_edges(spark):
    arr = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<int>")
    assert one(spark, metrics.recall_at(arr(1, 1, 2), arr(1, 3), 3), x=1) == 0.5
    assert one(spark, metrics.recall_at(arr(), arr(1), 3), x=1) == 0.0
    assert one(spark, metrics.precision_at(arr(1), arr(1), 5), x=1) == 0.2
    with pytest.raises(ValueError):
        metrics.recall_at(arr(1), arr(1), 0)
    rows = spark.createDataFrame([("TP",), ("TN",)], "confusion string")
    got = metrics.confusion_metrics(rows).first()
    assert (got["precision"], got["recall"], got["accuracy"]) == (1.0, 1.0, 1.0)
    results = spark.createDataFrame([(1,), (1,)], "case_id int")
    with pytest.raises(KeyError):
        metrics.case_result(results, 1)


@pytest.mark.parametrize("ratio,score,status", [(0.15, 5, "supported"), (0.30, 4, "mostly_supported"), (0.31, 3, "lexically_suspicious"), (0.40, 1, "critical_lexical"), (None, 5, "supported")])
def test_support_thresholds(spark, ratio, score, status):
    r = F.lit(ratio).cast("double")
    assert spark.range(1).select(quality.support_score(r), quality.lexical_status(r)).first()[:] == (score, status)


def test_decisions(spark):
    lit = lambda x: F.lit(x).cast("string")
    pick = lambda h, s: one(spark, quality.decide(lit(h), lit(s)), x=1)
    assert [pick("approved", None), pick(None, "rejected"), pick("approved", "approved"), pick("approved", "rejected")] == ["approved", "rejected", "approved", "requires_revision"]
    assert one(spark, quality.semantic_verdict([F.lit(3.9), F.lit(5.0)]), x=1) == "requires_revision"


def test_sampling_and_partition(spark):
    rows = spark.createDataFrame([(i, "b", "ab"[i % 2]) for i in range(9)], "id int, bucket string, domain string")
    picked = datasets.round_robin_sample(rows, "bucket", "domain", "id", 4).collect()
    assert sorted(r["domain"] for r in picked) == ["a", "a", "b", "b"]
    assert datasets.partition_integrity(rows, {"x": rows.where("id < 4"), "y": rows.where("id >= 4")}, "id").isEmpty()


def test_lifecycle_cutoff_is_closed(spark):
    rows = spark.createDataFrame([(1, "processing", 9, "2024-01-01 00:00:00"), (2, "processing", 9, "2024-01-01 00:00:01"), (3, "processing", None, "2023-01-01 00:00:00")], "format_id int, status string, revision_of int, updated_at string").withColumn("updated_at", F.to_timestamp("updated_at"))
    assert [r["format_id"] for r in lifecycle.stale(rows, F.expr("timestamp '2024-01-01 00:00:00'")).collect()] == [1]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "docs" / "dom").mkdir(parents=True)
    (tmp_path / "docs" / "dom" / "a.MD").write_text("# á\n")
    (tmp_path / "docs" / "b.exe").write_text("x")
    good, bad = readers.read_documents(spark, str(tmp_path / "docs"))
    assert [(r["document_id"], r["file_type"], r["text"]) for r in good.collect()] == [("a", "markdown", "# á\n")]
    assert [r["reason"] for r in bad.collect()] == ["unsupported suffix"]
    (tmp_path / "c.csv").write_text('﻿chunk_id,document_id,chunk_text\n1,d,"two\nlines ""q"""\n', encoding="utf-8")
    assert readers.read_chunks_csv(spark, str(tmp_path / "c.csv")).first()["chunk_text"] == 'two\nlines "q"'
    (tmp_path / "p.json").write_text(json.dumps([{"case_id": "c", "status": "success", "results": [{"rank": 1, "chunk_id": "x", "score": 0.5}]}]))
    assert readers.read_payloads(spark, str(tmp_path / "p.json")).select("case_id", F.col("results")[0]["chunk_id"]).first()[:] == ("c", "x")
    (tmp_path / "q.json").write_text("{}")
    with pytest.raises(ValueError):
        readers.read_payloads(spark, str(tmp_path / "q.json"))
    sinks.write_csv(spark.range(3), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 3
    assert readers.text_columns(["Back", "text", "x"]) == ["text", "Back"]
    assert [bytes(r.content) for r in sinks.stored_objects(spark, str(tmp_path / "q.json")).collect()] == [b"{}"]
    assert sinks.delete_object(spark, str(tmp_path / "q.json")) and not sinks.delete_object(spark, str(tmp_path / "q.json"))


def test_html_markdown():
    page = "<body><nav><p>no</p></nav><main><h2>T</h2><p>a <b>b</b></p><ul><li>c</li></ul><pre>x\n y</pre><script>no</script></main><p>out</p></body>"
    assert html.markdown(page) == "## T\n\na b\n\n- c\n\n```text\nx\n y\n```"
    assert html.markdown(None) == ""


def test_providers_and_graph(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, None)], "id int, text string")
    got = {r["id"]: r["embedding"] for r in providers.embed(rows, lambda xs: [[3.0, 4.0 * bool(x)] for x in xs]).collect()}
    assert [round(x, 3) for x in got[1]] == [0.6, 0.8] and got[2] == [1.0, 0.0]
    assert providers.unavailable_judge(rows).first()["status"] == "unavailable"
    assert one(spark, graph.parse_json(F.col("x"), "a int"), x='```json\n{"a": 3}\n```')["a"] == 3


def test_stream(spark, tmp_path):
    schema = spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema
    (tmp_path / "in").mkdir()
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(str(tmp_path / "in" / "x"))
    stream = lifecycle_stream.activity(lifecycle_stream.read_events(spark, str(tmp_path / "in" / "x"), schema))
    query = stream.writeStream.format("memory").queryName("activity").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("activity").count() > 0


def test_all_lines_are_compared(spark):
    docs = spark.createDataFrame([(1, "\n".join(["a b"] * 6 + ["b c", "", ""])), (2, "one"), (3, None)], "doc_id long, text string")
    found = [(r["doc_id"], r["i"], r["similarity"]) for r in metrics.line_similarities(docs).orderBy("i").collect()]
    assert found == [(1, i, x) for i, x in enumerate([1.0] * 5 + [0.333333, 0.0, 1.0])]


def test_chunks_are_aligned_up_to_the_longest_format(spark):
    chunks = [(1, "md", 0, "a b"), (1, "md", 1, "c"), (1, "txt", 0, "B c"), (1, "txt", 1, ""), (1, "txt", 6, "last")]
    found = metrics.chunk_structure(spark.createDataFrame(chunks, "case_id long, format string, chunk_order int, text string"), ["md", "txt"]).orderBy("chunk_order").collect()
    assert [tuple(r) for r in found] == [(1, 0, True, True, 0.333333, 3, 3), (1, 1, True, False, None, 1, 0), (1, 6, False, True, None, 0, 4)]


def test_all_pairs_of_formats_are_compared(spark):
    texts = spark.createDataFrame([(1, "a  b\n", "b c", ""), (2, "", " ", "")], "case_id long, md string, txt string, pdf string")
    found = [tuple(r) for r in metrics.format_similarity(texts, ["md", "txt", "pdf"]).orderBy("case_id").collect()]
    assert found == [(1, 0.333333, 0.0, 0.0, 3, 3, 0, True, True, False), (2, 1.0, 1.0, 1.0, 0, 0, 0, False, False, False)]


def test_manifest_build(spark):
    files = spark.createDataFrame([("a.md", 1, " Aa\r\nbb \n\n" + "word " * 400), ("b.md", 1, "short"), ("c.md", 1, None), ("other.md", 1, "not named")], "path string, page int, text string")
    manifest = spark.createDataFrame([("d1", "x", "a.md"), ("d2", "y", "b.md"), ("d3", "y", "c.md"), ("d4", "z", "gone.md")], "document_id string, category string, md_file string")
    got = chunking.manifest_chunks(files, manifest, "md").collect()
    clean = files.join(manifest, files["path"] == manifest["md_file"]).select("document_id", "category", t.clean_text(F.col("text")).alias("text")).collect()
    want = {(r.document_id, r.category, i, part) for r in clean for i, part in enumerate(chunking.split_recursively(r.text or "", chunking.CHUNK_SIZE, chunking.CHUNK_OVERLAP))}
    assert {(r.document_id, r.category, r.chunk_index, r.text) for r in got} == want and len(got) == len(want) > 2
    assert {r.controlled_format for r in got} == {"md"}
    assert [tuple(r) for r in chunking.manifest_gaps(files, manifest, "md").collect()] == [("d4", "gone.md")]


def test_running_coverage_of_ties_and_gaps(spark):
    rows = spark.createDataFrame(
        [("a", 1, "", ["red", "blue sky"]), ("a", 2, "The blue", ["red", "blue sky"]), ("a", 3, " Sky  RED", ["red", "blue sky"]), ("b", 1, None, ["x"]), ("c", 1, "x", [])], "case_id string, rank int, text string, keywords array<string>"
    )
    got = {(r.case_id, r.rank): (r.coverage, r.running, r.first_any, r.first_enough) for r in metrics.running_coverage(rows).collect()}
    assert got == {("a", 1): (0, 0, 3, 3), ("a", 2): (0, 0, 3, 3), ("a", 3): (0.5, 1, 3, 3), ("b", 1): (0, 0, None, None), ("c", 1): (0, 0, None, None)}


def test_routers_of_claims_without_terms_or_source(spark):
    claims = spark.createDataFrame([("a", 1, "factual", "planets circle stars"), ("a", 2, "factual", ""), ("a", 3, "prompt", "unknown matter"), ("b", 1, "factual", "planets"), ("b", 2, "factual", None)], "case_id string, claim_id int, role string, text string")
    sources = spark.createDataFrame([("a", "planets and stars circle"), ("c", "unused")], "case_id string, source_text string")
    routed = quality.route_claims(claims, sources)
    got = {(r.case_id, r.claim_id): (r.legacy_ratio, r.legacy_review) for r in routed.collect()}
    assert got == {("a", 1): (0.0, False), ("a", 2): (None, False), ("a", 3): (1.0, False), ("b", 1): (1.0, True), ("b", 2): (None, False)}
    assert {r.case_id: (r.total_claims, r.factual_claims, r.legacy_review_claims, r.normalized_case_review) for r in quality.route_cases(routed).collect()} == {"a": (3, 2, 0, False), "b": (2, 2, 1, True)}
