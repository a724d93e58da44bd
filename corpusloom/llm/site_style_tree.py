"""Main text of web pages by site style trees.

The pages of a host are merged into one tree of styles: an element's style is its tag, its classes and whether it is
marked, its place the path of styles from the root. A node of the tree is important if pages differ in it. For its
content that is one less the mean entropy of its text blocks over the host's m pages (a block on c pages has the
entropy log_m c); for its presentation, the entropy of the sequences of child styles that the pages have there. The
composite importance of a branch weighs both. A host's pages are joined by ``PRIOR_PAGES`` imagined ones, on which a
branch has the importance that its marks let expect, so a host of one page is judged like any other:

- a branch that is marked by tag, role, class or id as a menu, header, footer, sidebar, notice or advert has 0 there. It
  is judged as a whole and must reach ``HIGH``: one element of text never does, a branch does whose content and
  presentation differ on almost all pages, as of a container of the text that only has such a name. A name is a mark if
  its first or last part is one of the words, unless a part of it tells a state (``has-sidebar``, ``menu-open``). A mark
  above an article or main element says nothing about what is in it, and a header in one belongs to it;
- a branch in an article or main element has 1 there, any other a half. It goes if it and all branches in it stay below
  ``LOW``.

What the tree does not remove stays. Only what is no text of the page (scripts, styles, the head, forms and their
controls) and reader comments, which differ from page to page as the article does, so that no entropy can tell the two
apart, go by tag, class or id alone.

An article that several pages of a host repeat is still their article: pages of equal article text count as one page,
and an article all of whose blocks, or that as a whole, would go is kept.

Defined results: null and empty html give an empty text, as does a page without article of which all branches are low; a
null url is a host of its own; unclosed and misnested tags are closed as browsers do for p and li; a tag that never ends
goes, a page cut off is read to its end; elements nested deeper than ``NESTING`` belong to the innermost open one; ``br``
is white space; repeated rows get equal results and count as one page. Only key, url and html are read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.storage import cut, table

#: Importance that a branch must reach, and that a marked one must.
LOW, HIGH = 0.25, 0.9
#: Imagined pages of a host, of the importance that marks let expect.
PRIOR_PAGES = 2
#: Share that each child style takes from the weight of a node's presentation.
DECAY = 0.9
#: Open elements at a time, as in browsers; levels of the style tree, deeper elements have the path of the last one.
NESTING, LEVELS = 512, 64
#: Bytes of the table of low branches that are broadcast; a larger one is joined by a shuffle over salted hosts.
BROADCAST_BYTES = 8 << 20
SALTS = 64

_COMMENT = re.compile(r"<!--(.*?)(?:-->|\Z)", re.S)
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>""")
_TAG_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
_RAW = frozenset("script style textarea title noscript iframe template xmp".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_HOLDS_P = frozenset("ul ol div article section td body main".split())
_NO_TEXT = frozenset("form button select dialog svg object head".split())
_READERS = frozenset("comment comments reply replies respond disqus".split())
_MARKED_TAGS = frozenset("nav footer aside menu".split())
_MARKED_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
_MARKED_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent notice notices notification alert
    popup modal overlay newsletter subscribe subscription share sharing social sidebar menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager
    related footer header masthead toolbar widget widgets login signup""".split()
)
#: Parts of names that tell how something else looks.
_STATES = frozenset("has no with without is not on off hide hidden show shown open opened closed close fixed sticky visible enabled disabled active collapsed expanded left right full wide js layout page".split())
_HEADS = frozenset("header masthead".split())
_LANDMARKS = frozenset(("article", "main"))
#: End of a marked style; a class has no blank.
_MARK = " !"


class Block:
    __slots__ = ("path", "text")

    def __init__(self, path: str, text: str):
        self.path, self.text = path, text


def _words(name: str) -> set[str]:
    """The first and last part of a class or id, if none tells a state."""
    parts = [p for p in re.split(r"[^a-z]+", name) if p]
    return set() if not parts or len(parts) > 1 and _STATES.intersection(parts) else {parts[0], parts[-1]}


def _style(tag: str, attributes: str, inside_landmark: bool) -> tuple[str, bool]:
    """Style of an element, and whether its text is none of the page's."""
    marked, none = tag in _MARKED_TAGS or tag == "header" and not inside_landmark, tag in _NO_TEXT
    classes: list[str] = []
    if "=" in attributes:
        words, roles = set(), set()
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), next((v for v in values if v), "").lower()
            if name == "role":
                roles.add(value)
            elif name in ("class", "id"):
                for one in value.split():
                    words |= _words(one)
                if name == "class":
                    classes += value.replace("/", "|").split()
        if tag not in _LANDMARKS and tag not in ("body", "html"):
            marked |= bool(words & (_MARKED_WORDS - _HEADS if inside_landmark else _MARKED_WORDS))
            none |= bool(words & _READERS)
        marked |= bool(roles & _MARKED_ROLES)
    return tag + "".join("." + c for c in sorted(classes)) + (_MARK if marked else ""), none


def _token(html: str, at: int, last: int) -> tuple[str, bool, str, str, int]:
    """Text, or of a tag whether it ends an element, its name and attributes; and the place after it.

    last: place of the last ``>``. Whatever a search passes over belongs to the token, so a page is read about once.
    """
    if html[at] != "<":
        stop = html.find("<", at)
        stop = len(html) if stop < 0 else stop
        return html[at:stop], False, "", "", stop
    if found := _COMMENT.match(html, at):
        return "", False, "", "", found.end()
    if found := _TAG_NAME.match(html, at):
        if at > last:
            return "", False, "", "", len(html)  # it never ends
        # if a quote in it is not closed the tag ends at the first >
        tag = _TAG.match(html, at)
        stop = tag.end() if tag else html.index(">", at) + 1
        return "", bool(found.group(1)), found.group(2).lower(), html[found.end() : stop - 1], stop
    if html[at + 1 : at + 2] in ("!", "?", "/"):
        return "", False, "", "", html.index(">", at) + 1 if at < last else len(html)
    return "<", False, "", "", at + 1


def _raw_end(html: str, tag: str, at: int) -> int:
    """Where the end tag of an element without markup ends."""
    found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
    return html.find(">", found.end()) + 1 or len(html) if found else len(html)


def parse(html: str) -> tuple[list[Block], list[tuple[str, str]]]:
    """The text blocks of a page in order, and its elements as (path, child styles)."""
    blocks: list[Block] = []
    elements: list[tuple[str, str]] = []
    # an open element: tag, path, its level, in a landmark, without text of the page, child styles
    stack: list[tuple[str, str, int, bool, bool, list[str]]] = [("", "", 0, False, False, [])]
    count: Counter[str] = Counter()
    text: list[str] = []

    def flush() -> None:
        if text:
            if not stack[-1][4] and (joined := " ".join(unescape("".join(text)).split())):
                blocks.append(Block(stack[-1][1], joined))
            text.clear()

    def close(depth: int) -> None:
        flush()
        while len(stack) > depth:
            tag, path, _, _, none, children = stack.pop()
            count[tag] -= 1
            if not none:
                elements.append((path, ",".join(children)))

    def close_last(tag: str, within: frozenset[str] = frozenset()) -> None:
        """Close the innermost open element of a tag, unless one of the given tags is open inside it."""
        if count[tag]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == tag:
                    return close(depth)
                if stack[depth][0] in within:
                    return None

    at, end, last = 0, len(html), html.rfind(">")
    while at < end:
        said, ends, tag, attributes, at = _token(html, at, last)
        if not tag or tag == "br":
            text.append(" " if tag else said)
        elif tag in _INLINE:
            continue
        elif ends:
            close_last(tag)
        else:
            if tag == "li" or tag in _CLOSES_P:
                close_last("li" if tag == "li" else "p", _HOLDS_P)
            flush()
            _, path, level, landmark, none, children = stack[-1]
            if tag in _RAW:
                at = _raw_end(html, tag, at)
            elif len(stack) < NESTING:
                style, hidden = _style(tag, attributes, landmark)
                children.append(style)
                if tag not in _VOID and not (attributes.endswith("/") and tag in ("path", "circle", "rect")):
                    shown = level < LEVELS
                    stack.append((tag, f"{path}/{style}" if shown else path, level + shown, landmark or tag in _LANDMARKS, none or hidden, []))
                    count[tag] += 1
    close(1)
    flush()
    return blocks, elements


def _landmark(path: str) -> str | None:
    """The path of the outermost article or main element on a path."""
    styles = path.split("/")
    at = next((i for i, style in enumerate(styles) if style.partition(".")[0].removesuffix(_MARK) in _LANDMARKS), None)
    return None if at is None else "/".join(styles[: at + 1])


def _marked(path: str) -> str | None:
    """The path of the outermost marked element on a path, in its article or main element if it has one."""
    begin = len(_landmark(path) or "")
    begin -= len(_MARK) if path[:begin].endswith(_MARK) else 0
    at = f"{path}/".find(_MARK + "/", begin)
    return None if at < 0 else path[: at + len(_MARK)]


def _host():
    return F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def style_trees(pages: DataFrame) -> DataFrame:
    """(host, path, importance, pages): the merged trees of all hosts, without the imagined pages. pages: (url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64)
                hosts, ids, features = [], [], []
                for host, html in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
                    blocks, elements = parse(html or "")
                    article = "\n".join(b.text for b in blocks if _landmark(b.path) and not _marked(b.path))
                    found = {(b.path, 0, hash64(b.text)) for b in blocks} | {(path, 1, hash64(children)) for path, children in elements} | {("", 2, 0)}
                    hosts.append(host)
                    ids.append(hash64(article or html or ""))
                    features.append([dict(zip(("path", "kind", "feature"), x)) for x in sorted(found)])
                kind = pa.list_(pa.struct([("path", pa.string()), ("kind", pa.int32()), ("feature", pa.int64())]))
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(ids, pa.int64()), pa.array(features, kind)], names=["host", "page", "features"])

    found = pages.select(_host().alias("host"), "html").mapInArrow(run, "host string, page long, features array<struct<path:string,kind:int,feature:long>>")
    # of pages of equal article text the one of greatest features
    seen = found.groupBy("host", "page").agg(F.max("features").alias("features")).select("host", F.inline("features"))
    counts = seen.groupBy("host", "path", "kind", "feature").agg(F.count("*").alias("c"))
    log = lambda c: F.expr(f"{c} * ln({c})")
    nodes = cut(
        counts.groupBy("host", "path", "kind").agg(F.sum("c").alias("n"), F.sum(F.expr("ln(c)")).alias("logs"), F.sum(log("c")).alias("nlog"), F.count("*").alias("features")), "style-nodes"
    )
    sizes = nodes.where("kind = 2").select("host", F.col("n").alias("pages"))
    content = nodes.where("kind = 0 and path <> ''").select("host", F.explode(F.expr(_PREFIXES)).alias("path"), "features", "logs")
    content = content.groupBy("host", "path").agg(F.sum("features").alias("n"), F.sum("logs").alias("logs"), F.count("*").alias("leaves"))
    look = nodes.where("kind = 1").select("host", "path", F.expr("ln(n) - nlog / n").alias("entropy"))
    tree = content.join(look, ["host", "path"], "left").join(sizes, "host")
    weight = f"pow({DECAY}, leaves)"
    importance = f"if(pages = 1, 1, {weight} * (1 - logs / n / ln(pages)) + (1 - {weight}) * least(1, coalesce(entropy, 0) / ln(pages)))"
    return tree.select("host", "path", F.expr(importance).alias("importance"), "pages")


#: The paths of a node and all above it.
_PREFIXES = "transform(sequence(2, size(split(path, '/'))), i -> array_join(slice(split(path, '/'), 1, i), '/'))"


def low_branches(tree: DataFrame) -> DataFrame:
    """(host, low): the paths that decide what goes: marked branches below HIGH, and others that are below LOW with all branches in them."""
    # a mark counts from the outermost article or main element on
    landmark = "|".join(sorted(_LANDMARKS))
    begin = F.expr(f"regexp_instr(path, '/({landmark})([./ ]|$)')")
    own = F.when(begin > 0, F.expr(f"substring(path, regexp_instr(path, '/({landmark})([./ ]|$)'))")).otherwise(F.col("path"))
    found = tree.withColumn("own", own).withColumn("marked", F.expr(f"locate('{_MARK}/', concat(own, '/'))"))
    prior = F.when(F.col("marked") > 0, 0.0).when(begin > 0, 1.0).otherwise(0.5)
    found = found.withColumn("t", (F.col("importance") * F.col("pages") + prior * PRIOR_PAGES) / (F.col("pages") + PRIOR_PAGES))
    whole = found.where((F.col("marked") == F.length("own") - len(_MARK) + 1) & (F.col("t") < HIGH)).select("host", "path")
    plain = found.where("marked = 0")
    most = plain.select("host", F.explode(F.expr(_PREFIXES)).alias("path"), "t").groupBy("host", "path").agg(F.max("t").alias("t"))
    return whole.union(most.where(F.col("t") < LOW).select("host", "path")).groupBy("host").agg(F.collect_set("path").alias("low"))


def hash64(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def main_text(html: str, low: frozenset[str] = frozenset()) -> str:
    """The main text of one page, given the paths of low branches of its host."""
    blocks, _ = parse(html)
    landmarks = {path: _landmark(path) for path in {b.path for b in blocks}}
    deciding = {path: _marked(path) or path for path in landmarks}
    inner = [b for b in blocks if landmarks[b.path] and deciding[b.path] == b.path]
    whole = not any(b.path not in low for b in inner) or any(landmarks[b.path] in low for b in inner)
    kept = {id(b) for b in blocks if deciding[b.path] not in low} | {id(b) for b in inner if whole}
    return "\n".join(b.text for b in blocks if id(b) in kept)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every page."""
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html")).withColumn("host", _host())
    low = cut(low_branches(style_trees(rows)), "low-branches")
    size = low.agg(F.sum(F.expr("octet_length(host) + aggregate(low, 0, (a, p) -> a + octet_length(p))"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(low), "host", "left")
    else:  # pages of one host go to many tasks
        salted = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("key", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h or "", frozenset(p or ())) for h, p in zip(batch.column("html").to_pylist(), batch.column("low").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["key", "url", "text", "n_chars"])

    kind = pages.schema[key].dataType.simpleString()
    return joined.select("key", "url", "html", "low").mapInArrow(run, f"key {kind}, url string, text string, n_chars long").withColumnsRenamed({"key": key, "url": url})


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


OP5_SQL = r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1) AS t FROM pages
), b AS (
  SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(t, '</?(?:p|h1)>', chr(1), 'g'), '<br>', ' ', 'g'), '<[^>]*>', '', 'g') AS t FROM a
), c AS (
  SELECT page_id, url, regexp_replace(regexp_replace(t, '&quot;?', '"', 'g'), '&amp;?', '&', 'g') AS t FROM b
), d AS (
  SELECT page_id, url, array_to_string(list_filter(list_transform(string_split(t, chr(1)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM c
)
SELECT page_id, url, text, length(text) AS n_chars FROM d
"""
