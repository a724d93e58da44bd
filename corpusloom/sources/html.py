"""HTML to Markdown (A13, A14, B4) over a flat element tree.

The standard library's parser gives the events. Elements are kept in document order with the range of elements and of
strings that lie in them, so that the text of any element and the elements of any other are slices, and a page of any
depth is read without recursion. As the parser knows no implied ends, an unclosed paragraph holds what follows it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.functions.text import NOISE_PHRASES

# Elements that are removed, those that become lines and what they begin with, and elements without content.
DROPPED = ("script", "style", "nav", "footer", "aside", "noscript", "form", "button", "svg")
PREFIXES = {"h1": "# ", "h2": "## ", "h3": "### ", "h4": "#### ", "p": "", "li": "- ", "pre": "", "code": ""}
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link", "menuitem", "meta", "param", "source", "track", "wbr")
# Places of the main content in the order in which they are tried.
SELECTORS = ("main", "article", "[role='main']", ".content", ".main-content", ".article", ".article-content", ".document", ".docs-content")
_NOISE = tuple(phrase.lower() for phrase in NOISE_PHRASES)


class Element:
    __slots__ = ("tag", "role", "classes", "parent", "last", "first_string", "end_string", "in_pre")

    def __init__(self, tag: str, role: str | None, classes: list[str], parent: int, first_string: int, in_pre: bool):
        self.tag, self.role, self.classes, self.parent, self.first_string, self.in_pre = tag, role, classes, parent, first_string, in_pre
        self.last = self.end_string = -1


class Tree(HTMLParser):
    """Elements and strings of a page, without what lies in dropped elements."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.elements: list[Element] = []
        self.strings: list[str] = []
        #: Open elements, by their number; -1 for one that is not kept.
        self.open: list[tuple[str, int]] = []
        self.count: Counter[str] = Counter()
        self.dropped = 0
        self.pending: list[str] = []
        self.feed(html)
        self.close()
        while self.open:
            self._pop()
        self._cut()

    def _cut(self) -> None:
        if self.pending:
            if not self.dropped:
                self.strings.append("".join(self.pending))
            self.pending.clear()

    def _pop(self) -> None:
        self._cut()
        tag, number = self.open.pop()
        self.count[tag] -= 1
        self.dropped -= tag in DROPPED
        if number >= 0:
            element = self.elements[number]
            element.last, element.end_string = len(self.elements), len(self.strings)

    def handle_starttag(self, tag, attrs):
        self._cut()
        self.dropped += tag in DROPPED
        number = -1
        if not self.dropped:
            number = len(self.elements)
            values = dict(attrs)
            parent = self.open[-1][1] if self.open else -1
            in_pre = parent >= 0 and (self.elements[parent].in_pre or self.elements[parent].tag == "pre")
            self.elements.append(Element(tag, values.get("role"), (values.get("class") or "").split(), parent, len(self.strings), in_pre))
        self.open.append((tag, number))
        self.count[tag] += 1
        if tag in VOID:
            self._pop()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._pop()

    def handle_endtag(self, tag):
        self._cut()
        if self.count[tag]:
            while self.open[-1][0] != tag:
                self._pop()
            self._pop()

    def handle_data(self, data):
        self.pending.append(data)

    def handle_comment(self, data):
        self._cut()

    handle_decl = handle_pi = unknown_decl = handle_comment

    def text_of(self, element: Element) -> list[str]:
        return self.strings[element.first_string : element.end_string]


def _matches(element: Element, selector: str) -> bool:
    """Whether a selector of one tag, one class or one role picks the element."""
    if selector.startswith("."):
        return selector[1:] in element.classes
    if selector.startswith("["):
        return element.role == selector.partition("'")[2].rstrip("]'")
    return element.tag == selector


def main_element(tree: Tree, selectors: tuple[str, ...] = SELECTORS) -> Element | None:
    """The first element of the first selector that picks any, else the body, else none for the whole page."""
    first: dict[str, Element] = {}
    for element in tree.elements:
        for selector in (*selectors, "body"):
            if selector not in first and _matches(element, selector):
                first[selector] = element
    return next((first[s] for s in (*selectors, "body") if s in first), None)


def code_text(strings: list[str]) -> str:
    """The text of a code block; markup written as text goes, lines keep their indent, blank edges go."""
    lines = ["".join(Tree(line).strings).rstrip() if "<" in line or "&" in line else line.rstrip() for line in unescape("".join(strings)).splitlines()]
    full = [i for i, line in enumerate(lines) if line.strip()]
    return "\n".join(lines[full[0] : full[-1] + 1]) if full else ""


def inline_text(strings: list[str]) -> str:
    """Text of an element on one line, without permalink marks."""
    joined = " ".join(s for s in map(str.strip, strings) if s)
    joined = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", re.sub(r"\r\n?", "\n", joined)))
    return joined.strip().replace("¶", "").strip()


def without_noise(markdown: str) -> str:
    """Lines with a known phrase go, unless they begin a fence or a heading."""
    kept = []
    for line in markdown.splitlines():
        bare = line.strip()
        if not bare or bare.startswith(("```", "#")) or not any(phrase in bare.lower() for phrase in _NOISE):
            kept.append(line if bare else "")
    return re.sub(r"\n{3,}", "\n\n", "\n".join(kept)).strip()


def markdown(html: str | None) -> str:
    """Headings, paragraphs, list items, code blocks and inline code of the main element, in their order.

    Code within a code block, and any other element in one, is part of it; an element in another one (a paragraph in a list
    item, code in a paragraph) has a line of its own besides. Null is empty.
    """
    tree = Tree(html or "")
    main = main_element(tree)
    begin, end = (0, len(tree.elements)) if main is None else (tree.elements.index(main) + 1, main.last)
    lines = []
    for element in tree.elements[begin:end]:
        if element.tag not in PREFIXES or element.in_pre and element.tag != "pre":
            continue
        if element.tag == "pre":
            if text := code_text(tree.text_of(element)):
                lines.append(f"```text\n{text}\n```")
        elif text := inline_text(tree.text_of(element)):
            lines.append(f"`{text}`" if element.tag == "code" else PREFIXES[element.tag] + text)
    return without_noise(re.sub(r"\n{3,}", "\n\n", "\n\n".join(lines)))


def html_to_markdown(pages: DataFrame, html: str = "html") -> DataFrame:
    """The columns of ``pages`` but the html, and ``markdown``; Arrow batches, no row-wise UDF."""
    kept = [c for c in pages.columns if c not in (html, "markdown")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([markdown(h) for h in batch.column(html).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), made], names=[*kept, "markdown"])

    return pages.select(*kept, html).mapInArrow(run, pages.select(*kept).schema.add("markdown", "string"))
