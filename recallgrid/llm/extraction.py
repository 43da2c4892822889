"""Main text of web pages as the maximum-scoring subsequence of their tokens.

A page is read as a sequence of words and tags. Words score by what is known of their
block, positive in prose; tags score negative, the more so the rarer they are inside
articles. A linear scan finds the contiguous region with the greatest sum. All weights
are learned from labelled pages (``layouts.labelled_pages`` or the caller's): those of
blocks by logistic regression over their tag, length, share of linked words, the names
and classes around them and whether they lie outside the page's article element; those of
tags and of marks (element names, roles and classes) as smoothed log odds.

Elements whose marks speak against them (menus, headers, footers, sidebars, notices,
adverts, forms, comments) are taken out before the scan, unless the page's heading or most
of its text is in them; each leaves one negative token, so a sidebar within an article
does not cut it in two. Scripts, styles and other elements without prose are never read. A
region inside an article element, or one whose classes say so, is completed to all of it,
which keeps very short first and last blocks.

Rules of the text: character references are decoded; white space inside a block, line
breaks included, becomes one space; blocks that are empty then go; blocks are joined in
page order by one line end. List items, table cells and captions are blocks of their own.

Edge cases: a null, empty or text-free page gives the empty text; a null id or url is
kept; repeated rows are treated each; other columns of the input are ignored; an empty
table gives none. Unclosed elements, stray end tags, bare ampersands and less-than signs, and
pages cut in the middle of a tag are read as far as they go. A page of any length is one
piece of work of one task.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_batches
from .layouts import MARK, labelled_pages

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?>(?:[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|[="'])*))>"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|hidden|aria-hidden|style)(?=[\s=/]|$)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is raw text up to their end tag.
RAW = frozenset("script style textarea title xmp noembed noframes iframe noscript".split())
#: Elements that hold no prose.
SILENT = frozenset("head script style textarea title template svg math canvas object audio video select button noscript iframe option datalist map".split())
#: Opening one of these ends an open one of the same group, up to the element that holds the group.
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
#: Beginnings of class words, ids and roles that tell something; the first that fits counts.
STEMS = (
    "advert", "sponsor", "promo", "nav", "menu", "breadcrumb", "pagina", "pager", "head", "masthead", "topbar", "banner", "foot", "copyright", "colophon", "contentinfo",
    "side", "widget", "rail", "related", "recommend", "trending", "popular", "complementary", "notice", "cookie", "consent", "gdpr", "alert", "popup", "modal", "dialog", "overlay", "paywall",
    "newsletter", "subscri", "signup", "login", "search", "form", "comment", "discussion", "repl", "response", "disqus", "share", "social", "follow", "tags", "content", "article", "post", "entry", "story", "main", "body", "text",
)
WHOLE = frozenset(("ad", "ads"))
#: Words about the layout that say which parts a page has, not what an element is.
NEUTRAL = re.compile(r"\b(?:has|with|no|without|is)[-_]\w+|\b(?:wp|elementor)-[\w-]+", re.IGNORECASE)
#: Words that begin like a stem and mean something else.
PLAIN = ("responsive", "headline", "heading", "footnote", "replace", "format", "sidenote")
NAMED = frozenset("nav header footer aside form dialog menu article main".split())


def _stems(value: str) -> set[str]:
    out = set()
    for word in _NAME.findall(NEUTRAL.sub(" ", value)):
        word = word.lower()
        if word in WHOLE:
            out.add("ad")
        elif not word.startswith(PLAIN) and (stem := next((s for s in STEMS if word.startswith(s)), None)) is not None:
            out.add(stem)
    return out


class Element:
    """An open or closed element: its place in the tree, and what its name, role and classes say."""

    __slots__ = ("name", "parent", "marks", "silent", "words", "heading", "inner", "main", "dropped")

    def __init__(self, name: str, parent: Element | None, attributes: str):
        self.name, self.parent = name, parent
        self.silent = name in SILENT or (parent is not None and parent.silent)
        self.inner = parent is not None and (parent.inner or parent.name == "article")
        self.main = name in ("main", "article")
        self.words, self.heading, self.dropped = 0, False, False
        marks = set()
        if name in NAMED:
            marks.add("inner-header" if name == "header" and self.inner else f"<{name}>")
        if attributes:
            for found in _ATTRIBUTE.finditer(attributes):
                key, value = found[1].lower(), found[2] or found[3] or found[4] or ""
                if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
                    self.silent = True
                elif key == "itemprop" and value == "articleBody" or key == "role" and value in ("main", "article"):
                    self.main = True
                elif key in ("class", "id", "role"):
                    marks |= _stems(value)
        self.marks = marks if name not in ("html", "body") else set()


class Block:
    """Text between two block boundaries."""

    __slots__ = ("element", "text", "words", "linked")

    def __init__(self, element: Element, text: str, words: int, linked: int):
        self.element, self.text, self.words, self.linked = element, text, words, linked


def read_page(page: str) -> tuple[list, list[Element]]:
    """(tokens, elements): tokens are blocks and, for tags, the elements they open or close, in page order."""
    root = Element("html", None, "")
    stack, elements, tokens = [root], [root], []
    parts: list[str] = []
    linked, at, link = 0, 0, False

    def flush() -> None:
        nonlocal linked
        if parts:
            said = "".join(parts).split()
            parts.clear()
            if said:
                tokens.append(Block(stack[-1], " ".join(said), len(said), min(linked, len(said))))
            linked = 0

    def pop_to(k: int) -> None:
        for gone in reversed(stack[k:]):
            if gone.name in BLOCKS:
                tokens.append(gone)
        del stack[k:]

    def said(begin: int, end: int) -> None:
        nonlocal linked
        if end > begin and not stack[-1].silent:
            text = page[begin:end]
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if link:
                linked += len(text.split())

    while (found := _TAG.search(page, at)) is not None:
        said(at, found.start())
        at = found.end()
        name = found[2] or found[5]
        if name is None:
            continue
        name, closing = name.lower(), found[1] or found[4]
        if closing:
            k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name), 0)
            if name in BLOCKS:
                flush()
            if name == "a":
                link = False
            if k and (name in BLOCKS or not any(e.name in BLOCKS for e in stack[k + 1 :])):
                pop_to(k)
            continue
        if name == "br" or name == "wbr":
            parts.append(" " if name == "br" else "")
            continue
        if name in BLOCKS:
            flush()
            link = False
            k = len(stack) - 1
            while k > 0 and (stack[k].name not in BLOCKS or stack[k].name == "p"):
                if stack[k].name == "p":
                    pop_to(k)
                    break
                k -= 1
        if name in CLOSES:
            same, within = CLOSES[name]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in within:
                    break
                if stack[k].name in same:
                    pop_to(k)
                    break
        if name in VOID:
            continue
        element = Element(name, stack[-1], found[3] or found[6] or "")
        elements.append(element)
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(page, at)
            at = end.start() if end else len(page)
        elif name == "a":
            link = True
        stack.append(element)
        if name in BLOCKS:
            tokens.append(element)
    said(at, len(page))
    flush()
    return tokens, elements


def _up(element: Element) -> Iterator[Element]:
    while element is not None:
        yield element
        element = element.parent


def _tally(tokens: list, elements: list[Element]) -> int:
    """Adds up words and headings of all elements; gives the words of the page that no link holds."""
    for t in tokens:
        if type(t) is Block:
            t.element.words += t.words - t.linked
            if t.element.name == "h1" or t.element.parent is not None and t.element.parent.name == "h1":
                t.element.heading = True
    for e in reversed(elements):
        if e.parent is not None:
            e.parent.words += e.words
            e.parent.heading |= e.heading or e.main and e.name != "article"
    return elements[0].words


#: Share of the words of a page without heading from which an element is taken for the page itself, whatever its marks.
WHOLE_PAGE = 0.7
#: Marks of readers' comments, which may be most of a page.
TALK = frozenset(("comment", "discussion", "repl", "response", "disqus"))


class Model:
    """Weights of marks, tags and blocks, learned from labelled pages."""

    #: Log odds below and above which marks speak against an element and for it; what an element that was taken out costs; bounds of a word's score.
    AGAINST, FOR, CUT, MOST = -1.0, 0.5, -2.0, 3.0

    def __init__(self, pages: Iterable[str], mark: str = MARK):
        read = []
        inside, outside, part_in, part_out = (defaultdict(float) for _ in range(4))
        tags_in, tags_out = defaultdict(float), defaultdict(float)
        for page in pages:
            tokens, elements = read_page(page)
            _tally(tokens, elements)
            read.append((tokens, elements))
            for t in tokens:
                if type(t) is Block:
                    for m in {m for e in _up(t.element) for m in e.marks}:
                        (inside if mark in t.text else outside)[m] += t.words
                    for m in {m for e in _up(t.element) if not e.heading for m in e.marks}:
                        (part_in if mark in t.text else part_out)[m] += t.words
        odds = lambda yes, no: math.log((yes + 1) / (no + 1))
        self.marks = {m: odds(inside[m], outside[m]) for m in {*inside, *outside}}
        #: The same without elements that hold the heading, which are most of the page whatever they are called.
        self.against = {m: min(0.0, odds(part_in[m], part_out[m])) for m in self.marks}
        for tokens, elements in read:
            self._take_out(elements, elements[0].words)
            places = [k for k, t in enumerate(tokens) if type(t) is Block and mark in t.text]
            for k, t in enumerate(tokens):
                if type(t) is not Block and places and not t.dropped:
                    (tags_in if places[0] < k < places[-1] else tags_out)[t.name] += 1
        self.tags = {m: -max(0.05, min(2.0, odds(tags_out[m], tags_in[m]))) for m in {*tags_in, *tags_out}}
        rows, labels, weights = [], [], []
        for tokens, elements in read:
            for block, names in self._unmarked(tokens, elements):
                rows.append(names)
                labels.append(mark in block.text)
                weights.append(math.sqrt(block.words))
        self.weights = self._fit(rows, np.array(labels, float), np.array(weights))

    @staticmethod
    def _fit(rows: list[list[str]], labels: np.ndarray, weights: np.ndarray, ridge: float = 2.0, steps: int = 25) -> dict[str, float]:
        """Logistic regression by Newton's method with a ridge."""
        names = {n: k for k, n in enumerate(sorted({n for r in rows for n in r}))}
        x = np.zeros((len(rows), len(names)))
        for i, r in enumerate(rows):
            x[i, [names[n] for n in r]] = 1
        w = np.zeros(len(names))
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (weights * (labels - p)) - ridge * w
            bend = (x * (weights * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
            w += np.linalg.solve(bend, slope)
        return {n: float(w[k]) for n, k in names.items()}

    def _take_out(self, elements: list[Element], total: int) -> None:
        for e in elements:
            if e.parent is not None and e.parent.dropped:
                e.dropped = True
            elif e.marks and not e.heading and sum(self.against.get(m, 0.0) for m in e.marks) < self.AGAINST:
                e.dropped = elements[0].heading or e.words < WHOLE_PAGE * total or bool(e.marks & TALK)

    def _unmarked(self, tokens: list, elements: list[Element]) -> Iterator[tuple[Block, list[str]]]:
        """Blocks that no mark takes out, with their features."""
        self._take_out(elements, elements[0].words)
        has_main = any(e.main and not e.dropped and e.words for e in elements)
        for t in tokens:
            if type(t) is Block and not t.element.dropped:
                around = list(_up(t.element))
                tag = next((e.name for e in around if e.name in BLOCKS), "html")
                out = {f"tag:{tag}", f"links:{4 * t.linked // t.words}", f"words:{min(6, t.words.bit_length())}", "all"}
                if t.text[-1] in ".!?…。":
                    out.add("stop")
                if has_main:
                    out.add("inside" if any(e.main for e in around) else "outside")
                out |= {f"is:{m}" for e in around for m in e.marks}
                yield t, list(out)

    def extract(self, page: str | None) -> str:
        """The main text of a page."""
        if not page:
            return ""
        tokens, elements = read_page(page)
        _tally(tokens, elements)
        scores = {id(b): self.MOST * math.tanh(sum(self.weights.get(n, 0.0) for n in names) / self.MOST) * b.words for b, names in self._unmarked(tokens, elements)}
        best, run, begin, first, last = 0.0, 0.0, 0, 0, -1
        for k, t in enumerate(tokens):
            if type(t) is Block:
                score = scores.get(id(t), 0.0)
            elif t.dropped:
                score = 0.0 if t.parent.dropped else self.CUT / 2  # its start and its end
            else:
                score = self.tags.get(t.name, -0.5)
            if run <= 0:
                run, begin = 0.0, k
            run += score
            if run > best:
                best, first, last = run, begin, k
        held = [t for t in tokens[first : last + 1] if id(t) in scores]
        whole = self._holder(held)
        if whole is not None:
            held = [t for t in tokens if id(t) in scores and any(e is whole for e in _up(t.element))]
        return "\n".join(t.text for t in held)

    def _holder(self, held: list[Block]) -> Element | None:
        """The innermost element that holds the whole region and is the page's article by its name or marks."""
        if not held:
            return None
        common = list(_up(held[0].element))
        for t in (held[-1], *held):
            own = {id(e) for e in _up(t.element)}
            common = [e for e in common if id(e) in own]
        return next((e for e in common if e.main or sum(self.marks.get(m, 0.0) for m in e.marks) > self.FOR), None)


_MODELS: list[Model] = []


def default_model() -> Model:
    """The model of the labelled layouts, learned once a process."""
    if not _MODELS:
        _MODELS.append(Model(labelled_pages()))
    return _MODELS[0]


def main_text(pages: DataFrame, model: Model | None = None, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """(keep..., text) of every row; map-only. Without ``model`` that of the labelled layouts is used."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract = (model or default_model()).extract
        for batch in text_batches(batches, len(keep)):
            texts = [extract(p) for p in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string())], names=[*keep, "text"])

    rows = pages.select(*keep, F.coalesce(html_col, F.lit("")).alias("_html"))
    return rows.mapInArrow(run, rows.select(*keep).schema.add("text", "string"))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
