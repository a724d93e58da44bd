"""Edge cases and brute-force checks of the training-data operators."""

import base64
import hashlib
import math
import os
import random
import re
import sys
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import corpus_pipeline
from compare import assert_same

from corpusloom.llm import bpe, components, crf_language, jaccard_join, order_minhash, ordinal, positional_index, pu_quality, queries, quote_links, site_style_tree, vectext, warc
from corpusloom.llm.storage import cut, table

SF = "/root/testdata/sf0.001"
LONG = "long text " * 40_000
DOCS = [(1, None), (2, ""), (3, "..."), (4, "one two three"), (4, "one two three"), (None, "uno dos tres"), (5, "The quick brown fox jumps over the lazy dog " * 3), (6, LONG), (7, "naïve café ﬁ 日本語  x")]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names clash with the operators' own."""
    rows = spark.createDataFrame(DOCS, "doc_id long, text string")
    return rows.withColumns({"ids": F.lit("x"), "n": F.lit(0), "node": F.lit("y"), "key": F.lit("k"), "lang": F.lit("en"), "score": F.lit(1), "source": F.lit(None).cast("string")})


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), queries.ORACLES[name], SF)


# shared primitives


def test_words_do_not_cross_documents():
    raw, offsets = vectext.utf8(pa.array(["ab", "cd", "", " e"], pa.large_string()))
    starts, ends, at = vectext.words(raw, offsets, vectext.ALNUM)
    assert [bytes(raw[a:b]) for a, b in zip(starts, ends)] == [b"ab", b"cd", b"e"] and at.tolist() == [0, 1, 2, 2, 3]


def test_slices_keep_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 100, "c"])], names=["t"])
    parts = list(vectext.slices([batch, batch.slice(0, 0)], "t", 12))
    assert [x for p in parts for x in p.column("t").to_pylist()] == ["a" * 10, "", "b" * 100, "c"]


@pytest.mark.parametrize("in_one_task", [200_000, 0])
def test_components(spark, monkeypatch, in_one_task):
    monkeypatch.setattr(components, "TASK_LINKS", in_one_task)
    rng = random.Random(1)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100, 101), (101, 102), (102, 103), (5, 5), (None, 1)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).isEmpty()


# 1


def brute_hits(text, items, window=13):
    split = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").translate({c: c + 32 for c in range(65, 91)}))
    words, hit, found, windows = split(text), set(), set(), {}
    for item, body in items:
        w = split(body)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(n, {}).setdefault(tuple(w[i : i + n]), set()).add(item)
    for n, of in windows.items():
        for j in range(len(words) - n + 1):
            if owners := of.get(tuple(words[j : j + n])):
                hit.update(range(j, j + n))
                found |= owners
    return len(words), len(hit), sorted(found)


def test_decontamination_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    vocabulary = "a b c É".split()
    items = [(str(i), " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate((0, 1, 3, 13, 20))] + [("9", None), ("1", "zz yy")]
    rows = [(i, ", ".join(rng.choices([*vocabulary, "zz", "yy"], k=rng.randrange(60))).upper()) for i in range(40)] + [(98, None), (99, "")]
    monkeypatch.setattr(positional_index, "WINDOW", 13)
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    want = {i: brute_hits(text, items) for i, text in rows}
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in positional_index.contamination(d, b).collect()}
    assert got == want
    monkeypatch.setattr(positional_index, "BLOCK_BYTES", 20)  # several blocks of items
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in positional_index.contamination(d, b).collect()} == want


def test_proximity(spark):
    index = positional_index.build_index(spark.createDataFrame([(1, "a x b y c"), (2, "a b"), (3, "c")], "doc_id long, text string"))
    phrases = spark.createDataFrame([("p", "a b c")], "item_id string, text string")
    got = {r["key"]: r["spans"] for r in positional_index.find_phrases(index, phrases, window=0, slop=2).collect()}
    assert [tuple(s) for s in got[1]] == [(0, 5)] and got[2] == [] and got[3] == []
    assert all(not r["spans"] for r in positional_index.find_phrases(index, phrases, window=0, slop=1).collect())


def test_decontamination_edges(spark, docs):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert positional_index.contamination(docs, empty).where("n_hit > 0").isEmpty()
    assert positional_index.contamination(docs.limit(0), empty).isEmpty()
    assert positional_index.contamination(docs, empty).count() == len(DOCS)


# 2, 4, 8


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op2_quality"](spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").toPandas()
    assert (rows.predicted == rows.quality).mean() > 0.9 and rows.score.between(0, 1).all()


def test_quality_edges(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = pu_quality.train(docs, labels)
    assert {r["score"] for r in pu_quality.score(docs, model, ["doc_id"]).collect()} == {0.0}
    labels = spark.createDataFrame([(1, 1), (4, 1), (5, 0), (6, None), (7, 1)], "doc_id long, quality int")
    found = pu_quality.score(docs, pu_quality.train(docs, labels), ["doc_id", "node"]).collect()
    assert len(found) == len(DOCS) and all(0 <= r["score"] <= 1 for r in found)


def test_nonnegative_risk_separates():
    good, bad = pu_quality.measures(["Some plain words in a row."] * 40), pu_quality.measures(["$$$ %%% ###"] * 20)
    model = pu_quality.fit_pu(good[:20], np.concatenate((good[20:], bad)), 0.5)
    assert model.score(good).min() > 0.5 > model.score(bad).max()


@pytest.mark.parametrize("shift", [3.0, -3.0])
def test_nonnegative_risk_against_numeric_gradients(shift):
    rng = np.random.default_rng(0)
    g, n, prior = rng.normal(size=12) + np.where(np.arange(12) < 5, 2, shift), 5, 0.7
    plain = lambda g: (prior * np.mean([math.log1p(math.exp(-v)) for v in g[:n]]), np.mean([math.log1p(math.exp(v)) for v in g[n:]]) - prior * np.mean([math.log1p(math.exp(v)) for v in g[:n]]))
    first, rest, d = pu_quality.pu_risk(g, n, prior)
    assert (first, rest) == pytest.approx(plain(g)) and (rest < 0) == (shift < 0)
    aim = lambda g: sum(plain(g)) if rest >= 0 else -plain(g)[1]
    for i in range(12):
        step = np.eye(12)[i] * 1e-5
        assert d[i] == pytest.approx((aim(g + step) - aim(g - step)) / 2e-5, abs=1e-6)


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.85])
def test_prior_of_mixtures(prior):
    rng = np.random.default_rng(5)
    good, bad = (lambda n: rng.normal(size=(n, 3))), (lambda n: rng.normal(size=(n, 3)) + [4, 0, 0])
    n = 3000
    mixed = np.concatenate((good(int(n * prior)), bad(n - int(n * prior))))
    assert abs(pu_quality.estimate_prior(good(n), rng.permutation(mixed)) - prior) < 0.06


def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op4_language"](spark, sf).join(table(spark, sf, "documents"), "doc_id").where("held_out").toPandas()
    assert (rows.lang_pred == rows.lang).mean() > 0.95
    assert all(zlib.crc32(str(i).encode()) % 3 == 1 for i in rows.doc_id)


def test_code_switching(spark):
    texts, langs = ["der hund und die katze"] * 30 + ["the dog and the cat"] * 30, ["de"] * 30 + ["en"] * 30
    model = crf_language.fit_crf(texts, langs)
    rows = spark.createDataFrame([(1, "der hund und die katze the dog and the cat"), (2, None), (3, "123 ---")], "id int, text string")
    runs = {r["id"]: [(x["first"], x["end"], x["lang"]) for x in r["runs"]] for r in crf_language.label_words(rows, model, ["id"]).collect()}
    assert runs[1] == [(0, 5, "de"), (5, 10, "en")] and runs[2] == []
    assert {r["id"]: r["lang_pred"] for r in crf_language.predict(rows, model).collect()} | {1: 0} == {1: 0, 2: "und", 3: "und"}


def test_forward_backward_against_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    model = crf_language.Crf(["a", "b"], np.zeros((1, 2)), rng.normal(size=(2, 2)))
    emissions = rng.normal(size=(5, 2))
    p, _ = model.marginals(emissions, np.array([0, 0, 5]))
    total, want = 0, np.zeros((5, 2))
    for path in itertools.product(range(2), repeat=5):
        w = np.exp(sum(emissions[i, y] for i, y in enumerate(path)) + sum(model.transitions[a, b] for a, b in zip(path, path[1:])))
        total += w
        for i, y in enumerate(path):
            want[i, y] += w
    assert np.allclose(p, want / total)
    long = rng.normal(size=(100, 2))
    p, _ = model.marginals(long, np.array([0, 100]))
    alpha = [np.exp(long[0])]
    for e in long[1:]:
        alpha.append((alpha[-1] @ np.exp(model.transitions)) * np.exp(e))
    assert np.allclose(p[-1], alpha[-1] / alpha[-1].sum())


def test_language_edges(spark, docs):
    none = crf_language.fit_crf(*crf_language.training_rows(docs.limit(0)))
    assert {r["lang_pred"] for r in crf_language.predict(docs, none).collect()} == {"und"}
    model = crf_language.fit_crf(*crf_language.training_rows(docs))
    assert {r["lang_pred"] for r in crf_language.predict(docs.where("text is null or text in ('', '...')"), model).collect()} == {"und"}
    assert crf_language.predict(docs, model).count() == len(DOCS)


def test_toxicity_finds_labelled_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op8_toxicity"](spark, sf).join(table(spark, sf, "labels").withColumnRenamed("toxic", "label"), "doc_id").toPandas()
    assert rows.toxic[rows.label == 1].mean() > 0.6 and rows.toxic[rows.label == 0].mean() < 0.02
    assert rows.severity.between(0, 3).all()


def test_toxicity_grades_are_ordered():
    texts = ["plain words here"] * 60 + ["you vile thing"] * 20 + ["vile vile awful thing"] * 20 + ["vile awful vile awful vile rotten"] * 20
    batch = pa.RecordBatch.from_arrays([pa.array([texts[0], texts[60], texts[80], texts[-1]], pa.large_string())], names=["t"])
    graded = np.repeat([0, 1, 2, 3], [60, 20, 20, 20])
    for low, high in ((np.minimum(graded, 1), np.where(graded > 0, 3, 0)), (graded, graded)):
        model = ordinal.fit_ordinal(texts, low, high)
        assert list(model.thresholds) == sorted(model.thresholds) and model.weights.min() > 0
        severity = model.above(model.values(*ordinal.word_features(batch, "t"), 4)).sum(axis=1)
        assert severity[0] < severity[1:].min()
    assert list(severity) == sorted(severity)
    assert np.abs(severity - [0, 1, 2, 3]).max() < 0.7  # grades that are told are met


def test_ordinal_likelihood_and_its_gradients():
    rng = np.random.default_rng(1)
    z, t = rng.normal(size=30), np.array([-0.5, 0.4, 1.5])
    low = rng.integers(0, 4, 30)
    high = np.maximum(low, rng.integers(0, 4, 30))
    value, dz, dt = ordinal.likelihood(z, t, low, high)
    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    grade = lambda k, v, t: (sigmoid(v - t[k - 1]) if k else 1) - (sigmoid(v - t[k]) if k < 3 else 0)
    plain = lambda z, t: sum(math.log(sum(grade(k, v, t) for k in range(a, b + 1))) for v, a, b in zip(z, low, high))
    assert value == pytest.approx(plain(z, t))
    for i in range(30):
        step = np.eye(30)[i] * 1e-5
        assert dz[i] == pytest.approx((plain(z + step, t) - plain(z - step, t)) / 2e-5, abs=1e-5)
    for k in range(3):
        step = np.eye(3)[k] * 1e-5
        assert dt[k] == pytest.approx((plain(z, t + step) - plain(z, t - step)) / 2e-5, abs=1e-4)


def test_unknown_thresholds_share_out_the_toxic_rows():
    rng = np.random.default_rng(2)
    z, low = rng.normal(size=300) * 3, (np.arange(300) < 90) * 1
    t = ordinal._shared_out(z, np.array([0.0, 1.0, 2.0]), low, np.where(low > 0, 3, 0))
    above = 1 / (1 + np.exp(t - z[low > 0][:, None]))
    assert np.allclose(above.sum(axis=0) / above[:, 0].sum(), [1, 2 / 3, 1 / 3], atol=1e-6)


def test_toxicity_edges(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = ordinal.fit_ordinal(*ordinal.training_rows(docs, labels))
    found = ordinal.score(docs, model).collect()
    assert len(found) == len(DOCS) and not any(r["toxic"] for r in found)
    assert ordinal.score(docs.limit(0), model).isEmpty()


# 3


def test_quotes(spark):
    rows = [(1, 0, "user", "Hello there\nsecond line\n\nThird"), (1, 1, "bot", "On Monday X wrote:\n> Hello there\n> second line\n\nMy answer"), (1, 2, "user", "> > hello THERE\n> > second   line\n> My answer\nThanks"), (1, 3, None, "> unknown\nx"), (1, 4, "user", None), (None, 1, "user", "> Hello there"), (1, 3, None, "> unknown\nx")]
    got = quote_links.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("hash", F.lit(1)))
    found = {(r["conv_id"], r["turn"]): (r["text"], r["reply_to"], r["thread"], r["depth"], r["n_quotes"]) for r in got.collect()}
    assert got.count() == len(rows)
    assert found[1, 1] == ("My answer", 0, 0, 1, 1) and found[1, 2] == ("Thanks", 1, 0, 2, 2) and found[1, 3] == ("x", None, 3, 0, 1) and found[1, 4][0] == "" and found[None, 1][1] is None
    assert quote_links.reply_order(got.select("conv_id", "turn", "role", "text").limit(0)).isEmpty()


def test_positions_of_a_conversation_in_many_ranges(spark):
    rows = [(1, i // 3, "user", f"text {i % 3}") for i in range(300)] + [(2, 0, None, "a"), (None, 5, "bot", "b"), (None, None, None, None)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    found = quote_links.numbered(d.withColumn("thread", F.col("turn")), "conv_id", ["thread", "turn", "role", "text"]).collect()
    assert sorted(r["position"] for r in found if r["conv_id"] == 1) == list(range(1, 301))
    assert all(r["position"] == 3 * r["turn"] + int(r["text"][-1]) + 1 for r in found if r["conv_id"] == 1)
    assert sorted((r["position"], r["turn"]) for r in found if r["conv_id"] is None) == [(1, None), (2, 5)] and len(found) == len(rows)


def test_long_announcing_lines_go(spark):
    rows = [(1, 0, "a", "hello there"), (1, 1, "b", "x" * 400 + " wrote:\n> hello there\nyes")]
    found = quote_links.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("turn = 1").first()
    assert found["text"] == "yes" and found["reply_to"] == 0


def test_quotes_use_no_python(spark):
    plan = queries.QUERIES["op3_quote_links"](spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 5


MARKED = ["/html/body/header !", "/html/body/div.top-menu !", "/html/body/div !", "/html/body/article/aside !", "/html/body/footer !"]


def test_main_text():
    page = """<html><head><title>t</title></head><body><header>no</header><div class="top-menu">no</div><div id="cookie-notice">no</div><article><h1>A &amp; B</h1><p>one <b>two
    three<br>four<p>five &copy six<aside>no</aside><ul><li>x<li>y</ul><div class=comments>no</div><form>no</form><script>var a="</p>";</script></article><p>outside</p><footer>no</footer>"""
    assert site_style_tree.main_text(page, frozenset([*MARKED, "/html/body/p"])) == "A & B\none two three four\nfive © six\nx\ny"
    assert site_style_tree.main_text(page).count("no") == 5  # without a tree nothing that is text goes
    assert site_style_tree.main_text("<div>a<!-- b --><p>c") == "a\nc" and site_style_tree.main_text("") == ""
    assert site_style_tree.main_text("a <b>b</b <p title='class=\"ad\"'>c</p><p class='x") == "a bc"
    assert site_style_tree.main_text("<p>a < b <a href=\"x>y</p>z") == "a < b y\nz"


@pytest.mark.parametrize("piece", ["<a ", "<div>", "<!", "<a href=\"x>", "<script>", "</script", "<li>", "<", "<div class=\"", "<x></y>", "<p><td><foo><h1></h1>"])
def test_long_broken_pages_are_read_once(piece):
    start = time.process_time()
    site_style_tree.parse(piece * (1_000_000 // len(piece)))
    assert time.process_time() - start < 10


def plain_style_trees(pages):
    """{(host, path): importance after the imagined pages} from the blocks of all pages, kept in dictionaries."""
    sites = {}
    for host, html in pages:
        blocks, elements = site_style_tree.parse(html)
        sites.setdefault(host, {})[html] = (blocks, elements)
    out = {}
    for host, of in sites.items():
        m = len(of)
        texts, looks = {}, {}
        for page, (blocks, elements) in enumerate(of.values()):
            for b in blocks:
                texts.setdefault(b.path, {}).setdefault(b.text, set()).add(page)
            for path, children in elements:
                looks.setdefault(path, {}).setdefault(children, set()).add(page)
        for node in {path[:i] for path in texts for i in range(1, len(path) + 1) if path[i : i + 1] in ("", "/")}:
            under = [t for path, t in texts.items() if f"{path}/".startswith(node + "/")]
            log = lambda n: math.log(n) / math.log(m)
            content = 1 - sum(log(len(p)) for t in under for p in t.values()) / sum(map(len, under)) if m > 1 else 1
            seen = [len(p) for p in looks.get(node, {}).values()]
            look = -sum(n / sum(seen) * log(n / sum(seen)) for n in seen) if m > 1 and seen else 0
            share = site_style_tree.DECAY ** len(under)
            importance = share * content + (1 - share) * min(1, look) if m > 1 else 1
            prior = 0 if " !" in node else 0.5
            out[host, node] = (importance * m + prior * site_style_tree.PRIOR_PAGES) / (m + site_style_tree.PRIOR_PAGES)
    return out


def test_pages_without_landmarks_against_a_plain_style_tree(spark):
    rng = random.Random(4)
    pages = []
    for i in range(60):
        host = f"h{rng.choice([0, 0, 0, 1, 1, 2])}" if i else "alone"
        nav = "".join(f"<li>item {rng.randrange(3)}</li>" for _ in range(rng.randrange(1, 5)))
        parts = [f"<div class='menu'><ul>{nav}</ul></div>", f"<div class='t{host}'><h2>Head {rng.randrange(40)}</h2><p>words {rng.random()}</p>{'<p>always the same</p>' * rng.randrange(2)}</div>", "<div class='box'><span>same</span> box</div>", f"<div class='side'><p>teaser {rng.randrange(2)}</p></div>", f"<section class='widget'>{'<p>' * rng.randrange(9)}<b>{rng.random()}</b></section>"]
        pages.append((host, "<body>" + "".join(x for x in parts if rng.random() < 0.9)))
    tree = plain_style_trees(pages)
    want = {}
    for i, (host, html) in enumerate(pages):
        kept = []
        for b in site_style_tree.parse(html)[0]:
            head = b.path.split("/")
            marks = [k for k, style in enumerate(head) if style.endswith(" !")]
            if marks:
                gone = tree[host, "/".join(head[: marks[0] + 1])] < site_style_tree.HIGH
            else:
                gone = max(t for (h, path), t in tree.items() if h == host and " !" not in path and f"{path}/".startswith(b.path + "/")) < site_style_tree.LOW
            kept += [] if gone else [b.text]
        want[i] = "\n".join(kept)
    rows = spark.createDataFrame([(i, f"http://{host}/{i}", html) for i, (host, html) in enumerate(pages)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in site_style_tree.extract(rows).collect()} == want
    assert len({len(x.split("\n")) for x in want.values()}) > 2 and not any("same box" in x for i, x in want.items() if pages[i][0] == "h0")


def test_the_tree_decides_on_the_data(spark):
    pages = table(spark, SF, "pages")
    found = {r["page_id"]: r["text"] for r in site_style_tree.extract(pages).collect()}
    without = {r["page_id"]: site_style_tree.main_text(r["html"]) for r in pages.collect()}
    assert all(len(found[i]) < len(without[i]) for i in found)


def test_style_tree_removes_repeated_branches(spark, monkeypatch):
    rows = [(i, "http://H.x/a", f'<div class="body"><p>unique words {i}</p></div><div class="box">same everywhere</div>') for i in range(8)]
    rows += [(90, None, None), (91, "http://h.x/b", ""), (92, "http://other/", "<nav>menu</nav><div>alone</div>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    want = {**{i: f"unique words {i}" for i in range(8)}, 90: "", 91: "", 92: "alone"}
    assert {r["page_id"]: r["text"] for r in site_style_tree.extract(pages).collect()} == want
    monkeypatch.setattr(site_style_tree, "BROADCAST_BYTES", 0)
    assert {r["page_id"]: r["text"] for r in site_style_tree.extract(pages).collect()} == want
    assert site_style_tree.extract(pages.limit(0)).isEmpty()


def test_importance_decides_inside_and_outside_articles(spark):
    article = "<article><h1>Title {0}</h1><p>unique words {0}</p><div class=\"box\">same everywhere</div></article>"
    rows = [(i, "http://h/a", f'{article.format(i)}<div class="more">more words {i}</div><div class="line">same line</div>') for i in range(8)]
    rows += [(10 + i, "http://copies/", f"<article><h1>Title</h1><p>one text</p></article><p>{i}</p>") for i in range(8)]
    rows += [(20, "http://other/", article.format(20) + "<p>outside</p>")]
    found = {r["page_id"]: r["text"] for r in site_style_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [found[i] for i in range(8)] == [f"Title {i}\nunique words {i}\nmore words {i}" for i in range(8)]
    assert [found[10 + i] for i in range(8)] == [f"Title\none text\n{i}" for i in range(8)]
    assert found[20] == "Title 20\nunique words 20\nsame everywhere\noutside"  # one page: the tree knows too little


def test_low_articles_are_kept_whole():
    page = "<body><article><p>a</p><div>b</div></article><p>c</p></body>"
    assert site_style_tree.main_text(page, frozenset(["/body/article", "/body/article/p"])) == "a\nb\nc"
    assert site_style_tree.main_text(page, frozenset(["/body/article/p", "/body/p"])) == "b"
    assert site_style_tree.main_text(page, frozenset(["/body/article/p", "/body/article/div", "/body/p"])) == "a\nb"


# 6


def test_fingerprints(spark, docs):
    d = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    found = {r["doc_id"]: r for r in order_minhash.edits(d, partitions=3).collect()}
    texts = {i: t or "" for i, t in DOCS if i is not None}
    ids = sorted(texts)
    for i, j in zip(ids, ids[1:] + ids[:1]):
        n = len(texts[i])
        edited = texts[i][: n - n // 2] + texts[j][: n // 2]
        assert found[i]["n_chars"] == n and found[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    assert found[1]["near_next"] == 1.0 and found[2]["near_edited"] == 1.0  # empty texts
    assert order_minhash.edits(docs).count() == len(DOCS) and order_minhash.edits(docs.limit(0)).isEmpty()


def test_order_minhash_minds_order():
    words = [f"w{i}" for i in range(300)]
    small = words[:150] + ["new"] + words[151:]
    turned = words[150:] + words[:150]
    a, b, c, same = order_minhash.sketches(pa.array([" ".join(words), " ".join(small), " ".join(turned), " ".join(words)]))
    assert order_minhash.likeness(a, same) == 1.0 > order_minhash.likeness(a, b) > order_minhash.likeness(a, c)


def plain_sketch(text):
    """Order MinHash by its definition, over the numbered k-mers of a text."""
    raw, offsets = vectext.utf8(pa.array([text], pa.large_string()))
    starts, ends, words = vectext.words(raw, offsets, vectext.NON_SPACE)
    kmers = vectext.shingles(vectext.Hasher(raw).spans(starts, ends), words, order_minhash.KMER_WORDS)[0].tolist()
    mask, seen, numbered = 2**64 - 1, {}, []
    for k in kmers:
        seen[k] = seen.get(k, -1) + 1
        numbered.append(int(vectext.mix(np.array([(k + seen[k] * 0x9E3779B97F4A7C15) & mask], np.uint64))[0]))
    places = []
    for factor, shift in zip(order_minhash._FACTORS[:, 0].tolist(), order_minhash._SHIFTS[:, 0].tolist()):
        least = sorted(range(len(numbered)), key=lambda i: (numbered[i] * factor + shift) & mask)[: order_minhash.PICKED]
        out, chosen = shift, [*[0] * (order_minhash.PICKED - len(least)), *(numbered[i] for i in sorted(least))]
        for k in chosen:
            out = int(vectext.mix(np.array([(out + k) & mask], np.uint64))[0])
        places.append(max(1, out >> 48))
    return places if kmers else [0] * order_minhash.PLACES


def test_sketches_against_plain_order_minhash(monkeypatch):
    rng = random.Random(6)
    texts = ["", "a", "a b", "a b c", "x x x x x x x", " ".join(rng.choices("abcdefgh", k=300)), "ä " * 40, " ".join(f"w{rng.randrange(90)}" for _ in range(500))]
    want = [plain_sketch(t) for t in texts]
    for block in (1 << 14, 37, 1):
        monkeypatch.setattr(order_minhash, "BLOCK", block)
        assert order_minhash.sketches(pa.array(texts)).tolist() == want


def test_fingerprints_of_documents_with_other_ids(spark):
    rows = [(f"doc_{i:04d}", f"text number {i} " * (i % 7)) for i in range(80)] + [(None, "none")]
    want = [r for r in sorted(rows, key=lambda r: r[0] or "")]
    for partitions in (1, 5):
        found = {r["doc_id"]: r for r in order_minhash.edits(spark.createDataFrame(rows, "doc_id string, text string"), partitions=partitions).collect()}
        for (i, a), (_, b) in zip(want, want[1:] + want[:1]):
            assert found[i]["edited_sha256"] == hashlib.sha256((a[: len(a) - len(a) // 2] + b[: len(a) // 2]).encode()).hexdigest()


# 7


def brute_components(rows):
    def sets(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    s = [(i, sets(t)) for i, t in rows]
    parent = list(range(len(s)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(s)):
        for b in range(a):
            x, y = s[a][1], s[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(s):
        least[root(k)] = min(i, least.get(root(k), i))
    return sorted((i, len(x), least[root(k)]) for k, (i, x) in enumerate(s))


def loose_copies(n, words, edits, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("small", [64, 3])
def test_jaccard_join_against_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "TEST_AT_ONCE", 10)
    texts = loose_copies(90, 120, 9, 1) + loose_copies(12, 6, 3, 2) + ["a b", "A  b", "", "the same five words here", "x " * 50]
    rows = list(enumerate(texts))
    random.Random(5).shuffle(rows)
    found = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["n"], r["component"]) for r in found.collect()) == brute_components(rows)


def test_jaccard_join_of_large_last_regions(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL", 8)
    monkeypatch.setattr(jaccard_join, "LEVELS", 0)
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 0)
    rows = list(enumerate(loose_copies(80, 120, 14, 9) + loose_copies(30, 60, 8, 3) + ["same text"] * 9 + [None, ""]))
    found = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["n"], r["component"]) for r in found.collect()) == brute_components(rows)


def test_jaccard_join_without_ids_of_least_points(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL", 3)
    texts = loose_copies(60, 120, 14, 1)
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], names=["text"])
    nodes = [jaccard_join.point_of(s)[0] for s in jaccard_join.shingle_sets(batch, "text", 1)]
    least = set(sorted(nodes)[:20])
    rows = [(None if node in least else i, text) for i, (node, text) in enumerate(zip(nodes, texts))]
    found = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["n"], r["component"]) for r in found.where("doc_id is not null").collect()) == brute_components([r for r in rows if r[0] is not None])
    assert {r["component"] for r in found.where("doc_id is null").collect()} == {None}


def test_held_points_grow_after_all_are_dropped():
    held = jaccard_join._Held()
    for n in [10] * 16 + [100] * 20 + [1000] * 40 + [10**4]:
        held.drop_below(0.8 * n)
        held.add(n, n, 0.0, n, b"\0" * 8)
    assert [g["size"] for g in held.groups.values()] == [1]
    assert [x[0].tolist() for x in held.near(9000, 0.1, 1, b"\0" * 8, 2.0)] == [[10**4]]


def test_jaccard_join_edges(spark, docs):
    found = [tuple(r) for r in jaccard_join.near_duplicates(docs).collect()]
    assert len(found) == len(DOCS) and (4, 1, 4) in found and (1, 0, 1) in found and (None, 1, None) in found
    assert jaccard_join.near_duplicates(docs.limit(0)).isEmpty()


# 9


def test_chunked_framing():
    body = bytes(range(256)) * 50
    assert warc.unchunked(warc.chunked(body)) == body and warc.unchunked(warc.chunked(b"")) == b""
    with pytest.raises(ValueError):
        warc.unchunked(warc.chunked(body)[:-600])


def test_warc_segments_and_errors(spark):
    rows = [(1, "http://a\r\n", "x" * 5000), (2, None, "x" * 5000), (3, "u", None), (4, "u", ""), (5, "u", "y"), (5, "u", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit(1))
    archives = warc.write_archives(pages, segment=700, archive=1500)
    assert archives.count() > 1
    records = {(r["key"], r["record_type"]): r for r in warc.read_archives(archives).collect()}
    assert records["2", "response"]["payload"] == b"x" * 5000 and records["1", "revisit"]["refers_to"] == "2" and records["4", "response"]["payload"] == b""
    parts = warc.read_records(archives).where("segment is not null")
    assert {r["error"] for r in warc.reassemble(parts.where("segment <> 3")).collect()} == {"segments are missing or repeated"}
    last = parts.groupBy("record_id").agg(F.max("segment").alias("segment"))
    assert {r["error"] for r in warc.reassemble(parts.join(last, ["record_id", "segment"], "left_anti")).collect()} == {"the total length differs"}
    found = {(r["page_id"], r["record_type"]): r for r in warc.round_trip(pages).collect()}
    assert found[1, "revisit"]["payload_bytes"] == 5000 and found[1, "revisit"]["payload_digest"] == base64.b32encode(hashlib.sha1(b"x" * 5000).digest()).decode()
    assert warc.round_trip(pages).count() == len(rows) and warc.round_trip(pages.limit(0)).isEmpty()


def test_damaged_archives_give_errors(spark):
    pages = spark.createDataFrame([(i, f"http://a/{i}", f"<p>{i}</p>" * 900) for i in range(6)], "page_id long, url string, html string")
    data = warc.write_archives(pages.coalesce(1)).first()["data"]
    whole = list(warc.records(data))
    assert len(whole) == 6
    other = bytearray(data)
    other[len(other) // 2] ^= 255
    for part in (data[: len(data) // 2], data[:-3], bytes(other)):
        found = warc.read_archives(spark.createDataFrame([("x", bytearray(part))], "archive string, data binary")).collect()
        assert sum(r["record_type"] == "damaged" and r["error"] is not None for r in found) == 1
        assert {r["key"] for r in found if r["payload"] is not None} < {h["X-Page-ID"] for h, _ in whole}
    headers = {"WARC-Type": "response", "WARC-Record-ID": "<x>", "WARC-Payload-Digest": "sha1:" + warc.digest(b"a")}
    wrong = warc.record(headers, warc.http_block(b"b"))
    found = warc.read_archives(spark.createDataFrame([("x", bytearray(wrong)), ("y", bytearray()), ("z", None)], "archive string, data binary")).collect()
    assert [(r["payload"], r["error"]) for r in found] == [(None, "the digest differs")]


def test_long_payloads_are_joined_at_once(spark):
    pages = spark.createDataFrame([(1, "u", "x" * 8_000_000)], "page_id long, url string, html string")
    assert [r["payload_bytes"] for r in warc.round_trip(pages).collect()] == [8_000_000]


# 10


def test_bpe_equals_the_library(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.tokenizer_path())
    rng = random.Random(2)
    texts = [t or "" for _, t in DOCS] + ["<|endoftext|> a<|endoftext|>", "  \n\n\t x", "\x00\x7f", "don't we'll 12345 ½ \U0001f600‍"] + ["".join(rng.choices("abcdeAÉ ñ12!'\n一", k=80)) for _ in range(300)]
    own = bpe.encoder(bpe.tokenizer_path())
    ids = own.encode_batch(texts)
    assert ids == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [own.decode(x) for x in ids] == [library.decode(x, skip_special_tokens=False) for x in ids]
    assert own.decode([10**6, -1]) == "" and own.encode_batch([]) == []
    assert bpe.encode(docs, bpe.tokenizer_path()).count() == len(DOCS) and bpe.encode(docs.limit(0), bpe.tokenizer_path()).isEmpty()


def test_bpe_query(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.tokenizer_path())
    texts = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    for r in queries.QUERIES["op10_bpe"](spark, SF).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())


# the pipeline


def test_pipeline_against_brute_force(spark):
    rows = {r["doc_id"]: r for r in table(spark, SF, "documents").collect()}
    docs, kept = table(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = [r["doc_id"] for r in docs.collect()]
        docs = cut(stage(spark, docs, SF), "stage")
        kept[name] = (before, [r["doc_id"] for r in docs.collect()])
    before, after = kept["near duplicates"]
    least = {i: c for i, _, c in brute_components([(i, rows[i]["text"]) for i in before])}
    assert sorted(after) == sorted({least[i] for i in before})
    before, after = kept["decontamination"]
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    hits = {i: brute_hits(rows[i]["text"], items) for i in before}
    assert sorted(after) == sorted(i for i, (n, hit, _) in hits.items() if not (hit and 20 * hit >= n))
    assert kept["tokens"][0] == kept["decontamination"][1] and len(kept["tokens"][1]) == len(kept["tokens"][0])
    # the learned stages against their operators' decisions on each row
    docs = table(spark, SF, "documents")
    found = crf_language.predict(docs, crf_language.fit_crf(*crf_language.training_rows(docs))).collect()
    assert sorted(kept["language ID"][1]) == sorted(r["doc_id"] for r in found if r["lang_pred"] != "und" and r["lang_score"] >= 0.3)
    docs = docs.where(F.col("doc_id").isin(kept["language ID"][1]))
    found = ordinal.score(docs, ordinal.fit_ordinal(*ordinal.training_rows(docs, table(spark, SF, "labels")))).collect()
    assert sorted(kept["toxicity"][1]) == sorted(r["doc_id"] for r in found if not r["toxic"])


def test_pipeline_decides_on_each_row(spark):
    item = table(spark, SF, "benchmark").orderBy(F.desc(F.length("text"))).first()["text"]
    clean = " ".join(f"some clean words of number {i} and more" for i in range(30))
    rows = [(None, item), (1, item), (2, clean), (2, item), (None, clean + " end"), (3, clean + " end"), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("k")).withColumn("lang_pred", F.lit("MINE"))
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    found = corpus_pipeline.decontamination_stage(spark, docs, SF)
    assert sorted([tuple(r)[:2] for r in found.collect()], key=key) == sorted([r for r in rows if r[1] != item], key=key)
    found = corpus_pipeline.near_duplicate_stage(spark, docs, SF)
    assert sorted([tuple(r)[:2] for r in found.collect()], key=key) == sorted([(1, item), (2, clean), (4, None), (5, "")], key=key)
    twice = docs.unionByName(docs)
    assert corpus_pipeline.near_duplicate_stage(spark, twice, SF).count() == 4


def test_pipeline_edges(spark, docs):
    cols = ["doc_id", "text", "lang", "source", "node", "lang_pred", "Key"]
    docs = docs.drop("key").withColumn("lang_pred", F.lit("MINE")).withColumn("Key", F.lit(None).cast("string"))
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs.select(cols), SF)
        assert stage(spark, docs.select(cols).limit(0), SF).isEmpty()
        if name != "tokens":
            assert found.columns == cols and {r["lang_pred"] for r in found.collect()} == {"MINE"}
        found.count()
