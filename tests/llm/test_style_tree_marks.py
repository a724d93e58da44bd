"""Marks of a style tree: names of containers, articles in marked wrappers, headers of articles."""

import random

import pytest

from corpusloom.llm import site_style_tree


@pytest.mark.parametrize(
    "name, marked",
    [("menu", True), ("top-menu", True), ("footer-links", True), ("ad", True), ("ad-slot", True), ("cookie-notice", True), ("has-sidebar", False), ("no-menu", False), ("with-header", False), ("menu-open", False), ("sidebar-left", False), ("adaptive", False), ("reading", False), ("x", False), ("", False)],
)
def test_names(name, marked):
    assert site_style_tree._style("div", f' class="layout {name}"', False)[0].endswith(" !") is marked
    assert site_style_tree._style("div", f' id="{name}"', False)[0].endswith(" !") is marked


def test_articles_in_marked_wrappers_are_kept(spark):
    """On hosts of one page and of many."""
    rng = random.Random(7)
    rows, want = [], {}
    for wrapper in ("layout has-sidebar", "sidebar", "header"):
        for pages in (1, 2, 12, 17, 18, 40):
            for i in range(pages):
                words = " ".join(str(rng.random()) for _ in range(30))
                article = f'<article><div class="article-header"><h1>Title {i}</h1></div><p>{words}</p><div class="ad">buy {i}</div></article>'
                want[len(rows)] = f"Title {i}\n{words}"
                rows.append((len(rows), f"http://{wrapper[-7:]}{pages}/x", f'<body><div class="{wrapper}"><div class="menu">go {i}</div>{article}</div><footer>foot {i}</footer>'))
    got = {r.page_id: r.text for r in site_style_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_the_tree_goes_beyond_the_marks(spark):
    """Repeated branches of neutral names go, and a branch that only has a marked name and differs on each page stays."""
    rng = random.Random(8)
    words = lambda n: " ".join(str(rng.random()) for _ in range(n))
    rows = [(i, "http://h/x", f'<body><article><p>{words(20)}</p></article><div class="share-note">same for all</div><div class="widget">{"".join(f"<p>{words(3)}</p>" + "<h2>x</h2>" * rng.randrange(2) for _ in range(rng.randrange(3, 30)))}</div>') for i in range(60)]
    marks_only = lambda html: "\n".join(b.text for b in site_style_tree.parse(html)[0] if not site_style_tree._marked(b.path))
    got = {r.page_id: r.text for r in site_style_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, _, html in rows:
        assert "same for all" in html and "same for all" not in got[i] and got[i] != marks_only(html)
        assert len(got[i].split("\n")) > 3
