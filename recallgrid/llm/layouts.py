"""Labelled web pages, from which the weights of HTML extraction are learned.

A layout is a page with places for text: ``m`` for words of the article, ``x`` for words
of anything else, ``l`` for links in list items, ``k`` for plain links, each followed by
the number of words or links; ``@name`` stands for a class of that family. Words of the
article carry ``MARK``, which tells the labels; words have no other meaning.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

#: Starts each word of the article in a labelled page; a character for private use.
MARK = "\ue000"

#: Names that sites give to parts of a page, by kind.
FAMILIES = {
    "ad": ("ad", "ads", "advert", "advertisement", "ad-slot", "sponsored", "promo", "banner-ad"),
    "nav": ("nav", "menu", "navbar", "main-navigation", "topmenu", "breadcrumbs", "pagination"),
    "head": ("header", "masthead", "site-header", "topbar", "banner"),
    "foot": ("footer", "site-footer", "copyright", "colophon", "footer-links"),
    "side": ("sidebar", "side-bar", "widget", "rail", "related", "recommended", "trending"),
    "note": ("notice", "cookie-notice", "cookie-consent", "alert", "gdpr", "popup", "modal", "paywall"),
    "form": ("newsletter", "subscribe", "signup", "search-box", "login"),
    "talk": ("comments", "comment-list", "discussion", "replies", "disqus-thread", "responses"),
    "share": ("share", "social", "share-buttons", "tags", "follow-us"),
    "main": ("content", "article-body", "post-content", "entry-content", "story", "main", "post", "article-text"),
    "wrap": ("wrap", "container", "row", "col", "page", "inner", "box", "block"),
}

LAYOUTS = (
    "<nav><ul>l6</ul></nav><div class='@ad'>x12</div><article><h1>m8</h1><p><b>m30<br><p>m60</p><p>m4</p></article><footer>x14</footer>",
    "<nav><ul>l5</ul></nav><div class='@ad'>x40</div><article><h1>m3</h1><p>m3</p></article><footer>x20</footer>",
    "<header class='@head'><a href='/'>x2</a><nav><ul>l8</ul></nav></header><main><h1>m7</h1><p>m50</p><aside class='@side'><h3>x3</h3><ul>l5</ul></aside><p>m70</p><h2>m4</h2><p>m25</p></main><footer class='@foot'><p>x25</p></footer>",
    "<div class='@note'><p>x25</p><button>x1</button></div><div class='@head'>x3</div><div class='@wrap'><div class='@main'><h1>m6</h1><p>m45</p><div class='@ad'><p>x15</p></div><p>m55</p><blockquote><p>m20</p></blockquote><p>m12</p></div><div class='@side'><h3>x2</h3><p>x30</p><ul>l6</ul></div></div><div class='@foot'>x18 k4</div>",
    "<div class='@nav'>k7</div><div class='@wrap'><h1>m6</h1><p>m40</p><p>m35</p><ul><li>m9</li><li>m11</li><li>m3</li></ul><p>m50</p></div><div class='@talk'><h3>x2</h3><div class='@wrap'><p>x30</p></div><div class='@wrap'><p>x45</p></div></div><div class='@foot'>x16</div>",
    "<div class='@wrap'>k6</div><div class='@wrap'><h2>m6</h2><p>m40</p><p>m35</p><p>m2</p><p>m50</p></div><div class='@wrap'>k5</div><div class='@wrap'>x9</div>",
    "<header><p>x4</p><form class='@form'><label>x2</label><input><button>x1</button></form></header><article class='@main'><header><h1>m9</h1><p>m5</p></header><figure><img src='a.jpg'><figcaption>m8</figcaption></figure><p>m60</p><table><tr><td>m2</td><td>m3</td></tr></table><p>m30</p><footer class='@share'>x3 k3</footer></article><section class='@talk'><article><p>x40</p></article><article><p>x60</p></article></section>",
    "<table><tr><td class='@nav'>k8</td><td><h1>m5</h1><p>m60</p><p>m40</p></td><td class='@side'>k6 x20</td></tr></table><p class='@foot'>x12</p>",
    "<div id='@nav'><ul>l7</ul></div><div id='@main'><h1>m4</h1><div>m45</div><div>m30</div><div class='@form'><form><p>x14</p><input><button>x1</button></form></div><div>m25</div></div><div id='@talk'><ol><li><p>x22</p></li><li><p>x50</p></li><li><p>x8</p></li></ol><form><textarea></textarea></form></div><div id='@foot'><ul>l4</ul><p>x10</p></div>",
    "<ul>l9</ul><h1>m7</h1><p>m80</p><p>m15</p><p>m40</p><ul>l6</ul><p>x8</p>",
    "<div class='@note'>x16</div><nav class='@nav'>k5</nav><main><section class='@main'><h1>m5</h1><p>m33 <a href='/a'>m3</a> m20</p><pre>m15</pre><dl><dt>m2</dt><dd>m10</dd></dl><p>m44</p></section><section class='@side'><h2>x2</h2><article><h3><a href='/b'>x6</a></h3><p>x18</p></article><article><h3><a href='/c'>x5</a></h3><p>x16</p></article></section></main><footer>k6 <p>x12</p></footer>",
    "<body class='has-sidebar'><form id='aspnetForm'><div class='@head'>x4</div><div class='@wrap'><div class='@wrap'><h1>m6</h1><p>m52</p><div class='@share'>k4</div><p>m61</p><h3>m3</h3><p>m18</p></div><div class='@side'>x22</div></div></form><div class='@foot'>x30</div>",
)


def labelled_pages(each: int = 30, seed: int = 12) -> Iterator[str]:
    """``each`` pages of every layout, with sizes and names drawn at random; the same for the same seed."""
    draw = random.Random(seed)

    def words(n: int, mark: str) -> str:
        n = max(1, round(n * draw.uniform(0.3, 1.7)))
        said = [mark + "w" * draw.randint(1, 9) for _ in range(n)]
        return " ".join(said) + ("." if n > 8 and draw.random() < 0.9 or draw.random() < 0.2 else "")

    def fill(place: re.Match) -> str:
        kind, n = place[1], place[2]
        if kind == "@":
            return draw.choice(FAMILIES[n])
        n = int(n)
        if kind in "mx":
            return words(n, MARK if kind == "m" else "")
        link = lambda: f"<a href='/'>{words(2, '')}</a>"
        return "".join(f"<li>{link()}</li>" if kind == "l" else link() + " " for _ in range(n))

    for layout in LAYOUTS:
        for _ in range(each):
            yield re.sub(r"(?<![\w'=/-])([mxlk])(\d+)(?!\w)|(@)(\w+)", lambda p: fill(re.match(r"([mxlk@])(\w+)", p[0])), layout)
