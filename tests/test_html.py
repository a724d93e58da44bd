"""HTML to Markdown against a plain version that builds nodes and walks them recursively."""

import re
from html import unescape
from html.parser import HTMLParser

import pytest

from corpusloom.plans import text_queries
from corpusloom.sources import html

VOID = "area base br col embed hr img input keygen link menuitem meta param source track wbr".split()
DROP = "script style nav footer aside noscript form button svg".split()


class Node:
    def __init__(self, tag, attrs=(), up=None):
        self.tag, self.attrs, self.up, self.kids = tag, dict(attrs), up, []

    def nodes(self):
        for kid in self.kids:
            if isinstance(kid, Node):
                yield kid
                yield from kid.nodes()

    def strings(self):
        for kid in self.kids:
            if isinstance(kid, Node):
                yield from kid.strings()
            else:
                yield kid

    def inside(self, tag):
        return self.up is not None and (self.up.tag == tag or self.up.inside(tag))


class Soup(HTMLParser):
    def __init__(self, text):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("[root]")
        self.feed(text)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = Node(tag, attrs, self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.kids.append(Node(tag, attrs, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node and node.tag != tag:
            node = node.up
        if node and node.up:
            self.at = node.up

    def handle_data(self, data):
        if self.at.kids and isinstance(self.at.kids[-1], str) and not self.split:
            self.at.kids[-1] += data
        else:
            self.at.kids.append(data)
        self.split = False

    split = False

    def handle_comment(self, data):
        self.split = True


def pruned(node):
    node.kids = [pruned(k) if isinstance(k, Node) else k for k in node.kids if not (isinstance(k, Node) and k.tag in DROP)]
    return node


def plain(text):
    root = pruned(Soup(text or "").root)
    tests = [lambda n: n.tag == "main", lambda n: n.tag == "article", lambda n: n.attrs.get("role") == "main"]
    tests += [lambda n, c=c: c in (n.attrs.get("class") or "").split() for c in ("content", "main-content", "article", "article-content", "document", "docs-content")]
    main = next((n for test in [*tests, lambda n: n.tag == "body"] for n in root.nodes() if test(n)), root)
    lines = []
    for n in main.nodes():
        if n.tag == "pre":
            code = [re.sub("\\s+$", "", "".join(Soup(line).root.strings())) for line in unescape("".join(n.strings())).splitlines()]
            while code and not code[0].strip():
                del code[0]
            while code and not code[-1].strip():
                del code[-1]
            lines += ["```text\n" + "\n".join(code) + "\n```"] if code else []
        elif n.tag in "h1 h2 h3 h4 p li code".split() and not n.inside("pre"):
            words = " ".join(s.strip() for s in n.strings() if s.strip())
            words = re.sub(r"\n{3,}", "\n\n", re.sub("[ \t]+", " ", words.replace("\r\n", "\n").replace("\r", "\n"))).strip().replace("¶", "").strip()
            if words:
                lines.append({"h1": "# ", "h2": "## ", "h3": "### ", "h4": "#### ", "li": "- "}.get(n.tag, "") + (f"`{words}`" if n.tag == "code" else words))
    out = []
    for line in re.sub(r"\n{3,}", "\n\n", "\n\n".join(lines)).splitlines():
        noisy = any(x.lower() in line.lower() for x in ("Versión en inglés", "Copiar al portapapeles", "Editar esta página", "o sonar poco natural"))
        if line.strip().startswith(("```", "#")) or not noisy:
            out.append(line if line.strip() else "")
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()


PAGES = [
    None, "", "only text", "<p>a<!-- c -->b</p>", "<body><p>x</p></body><p>after</p>",
    "<main><h1>T ¶</h1><p>a <code>x y</code> b</p></main><article><p>no</p></article>",
    "<article><p>yes</p></article><div class='content'><p>no</p></div>",
    "<div role='main'><p>yes</p></div><div class=article><p>no</p></div>", "<div role='Main'><p>no</p></div><div class='x docs-content'><p>yes</p></div>",
    "<nav><main><p>dropped</p></main></nav><body><p>body</p></body>", "<p>no body <b>at all</b>",
    "<div class='content'><p>1</p></div><div class='main-content'><p>2</p></div>", "<div class='document'><p>2</p></div>", "<div class='article-content'><p>2</p></div>",
    "<body><ul><li>a<p>b</p></li><li>c <ul><li>d</li></ul></ul><h4>h</h4><h5>not a line</h5></body>",
    "<pre>\n\n  def f():  \n    <b>return</b> &lt;b&gt;x&lt;/b&gt; &amp;amp; \n\n</pre>", "<pre><code>in pre</code><p>also</p><pre>inner</pre></pre>", "<pre>   \n </pre>",
    "<p>Copiar al portapapeles</p><h2>Editar esta página</h2><p>versión en INGLÉS aquí</p><p>kept</p>", "<pre>Versión en inglés\nkept</pre>",
    "<p>one<br>two<br/>three<img src=x>four</p><p/>x<div/>y", "<p>unclosed<p>next<div>third</p>fourth", "</p></div>stray<p>&eacute;&#233; &nbsp;x</p>",
    "<script>var x='<p>no</p>'</script><style>p{}</style><p>a<script>b</script>c</p><form><p>no", "<p>" + "x " * 100_000 + "</p>", "<div>" * 3000 + "<p>deep</p>",
]


@pytest.mark.parametrize("i", range(len(PAGES)))
def test_markdown_equals_the_plain_version(i):
    if PAGES[i] and PAGES[i].startswith("<div><div>"):
        assert html.markdown(PAGES[i]) == "deep"
    else:
        assert html.markdown(PAGES[i]) == plain(PAGES[i])


def test_all_pages_equal_the_plain_version(spark):
    rows = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    got = {r.page_id: r.markdown for r in text_queries.html_markdown(spark, "/root/testdata/sf0.001").collect()}
    assert got == {i: plain(page) for i, page in rows.items()} and len(got) > 10


def test_columns_are_kept(spark):
    rows = spark.createDataFrame([(1, "<p>a", "old", None)], "page_id int, html string, markdown string, url string")
    assert html.html_to_markdown(rows).collect() == [(1, None, "a")]
    assert html.html_to_markdown(rows.limit(0)).columns == ["page_id", "url", "markdown"]
