"""Periodic runs, tokenizer alignment and HTML extraction against brute force and labelled pages."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import Row

from recallgrid.llm import alignment, extraction, layouts, repetitions
from recallgrid.llm.common import tokenizer_path

SF = "/root/testdata/sf0.001"
A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def slow_runs(words):
    """Every maximal stretch for every period, the smallest period of each interval."""
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def planted(doc_id, text):
    words, h = (text or "").encode().split(), zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]


def test_runs_equal_brute_force():
    draw = random.Random(5)
    for _ in range(150):
        texts = []
        for _ in range(draw.randint(1, 5)):
            n, k = draw.choice([0, 1, 5, 6, 7, 9, 40, 150]), draw.choice([1, 2, 3, 40])
            words = [str(draw.randrange(k)) for _ in range(n)]
            if n and draw.random() < 0.6:
                a = draw.randrange(n)
                p = 1 + (n - a) // draw.randint(3, 9)
                words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
            texts.append(" ".join(words))
        assert repetitions.runs_of_texts(texts)[1] == [slow_runs(t.split()) for t in texts]


def test_long_runs_take_little_time():
    (n,), ((run,),), _ = repetitions.runs_of_texts(["a " * 200_000])
    assert n == 200_000 and run == (0, 200_000, 1)
    assert repetitions.runs_of_texts(["a b " * 50_000 + "c " * 50_000])[1] == [[(0, 100_000, 2), (100_000, 50_000, 1)]]


def test_op11_equals_brute_force_over_documents(spark):
    found = {r.doc_id: r for r in repetitions.op11_periodic_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(found) == len(docs)
    for d in docs:
        words, r = planted(d.doc_id, d.text), found[d.doc_id]
        runs = slow_runs(words)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        assert r.n_runs == len(runs)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        assert (r.start, r.length, r.period) == (best or (None, None, None))
        assert r.exponent_milli == (None if best is None else 1000 * best[1] // best[2])


def test_runs_of_odd_rows(spark):
    rows = [Row(doc_id=1, text=None, words=1), Row(doc_id=2, text="", words=1), Row(doc_id=2, text="x " * 9, words=1), Row(doc_id=None, text="a b a b a b a b", words=1), Row(doc_id=3, text="  x", words=1)]
    found = repetitions.periodic_runs(spark.createDataFrame(rows)).orderBy("doc_id", "n_words").collect()
    assert [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found] == [
        (None, 8, [(0, 8, 2)], "a b"), (1, 0, [], ""), (2, 0, [], ""), (2, 9, [(0, 9, 1)], "x"), (3, 2, [], "  x"),
    ]
    assert repetitions.periodic_runs(spark.createDataFrame(rows).limit(0)).count() == 0


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(tokenizer_path(A), tokenizer_path(B))


def slow_alignment(aligner, text):
    """(n_a, n_b, groups, links) from the owner of every byte, with the whole text tokenized at once."""
    if not text:
        return 0, 0, "", []
    aligner.a.encode_special_tokens = True
    a, b = aligner.a.encode(" " + text, add_special_tokens=False).ids, aligner.b.encode(text)
    parts = [aligner.bytes_a[i] for i in a], [aligner.bytes_b[i] for i in b]
    if any(b"".join(p) != (" " + text).encode() for p in parts):
        return 0, 0, "", []
    owner = [[k for k, p in enumerate(side) for _ in p] for side in parts]
    cuts = [k + 1 for k in range(len(owner[0])) if all(k + 1 == len(o) or o[k] != o[k + 1] for o in owner)]
    groups = ["|".join(",".join(str(ids[k]) for k in dict.fromkeys(o[low:high])) for ids, o in zip((a, b), owner, strict=True)) for low, high in zip([0, *cuts], cuts, strict=False)]
    return len(a), len(b), ";".join(groups), [(a[i], b[j]) for i, j in sorted(set(zip(*owner, strict=True)))]


def test_alignment_equals_brute_force_on_odd_texts(aligner):
    draw = random.Random(8)
    some = ["the", " ", "  ", "\n", "\t", "'s", "n't", "é", "日本", "😀", "▁", "<|endoftext|>", "<s>", "12", "..", "\r\n", "\x00", "　", "\xa0", "\x1c", " a", "\n\n", "é", "<0x0A>"]
    texts = ["".join(draw.choice(some) for _ in range(draw.randint(0, 12))) for _ in range(2000)]
    for text, (n_a, n_b, n_groups, groups, links) in zip(texts, aligner.align(texts), strict=True):
        said = n_a, n_b, groups, [(int(x) >> alignment.SHIFT, int(x) & ((1 << alignment.SHIFT) - 1)) for x in links]
        assert said == slow_alignment(aligner, text), text
        assert n_groups == len(groups.split(";")) * (groups != "")


def test_op13_equals_brute_force_over_documents(spark, aligner):
    docs = [(d.doc_id, slow_alignment(aligner, d.text)) for d in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    counts = Counter(x for _, d in docs for x in d[3])
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    expected = {(i, d[0], d[1], d[2].count(";") + 1 if d[2] else 0, len(d[3]), sum(counts[x] == most[x[1]] for x in d[3]), sum(counts[x] for x in d[3]), hashlib.sha256(d[2].encode()).hexdigest() if d[2] else "") for i, d in docs}
    assert {tuple(r) for r in alignment.op13_align_tokens(spark, SF).collect()} == expected


def test_alignment_of_odd_rows_and_of_many_blocks(spark, aligner, monkeypatch):
    rows = [Row(doc_id=i % 7 or None, text=t, block=1) for i, t in enumerate([None, "", "the cat", "the cat", "a▁b", "x" * 3000, "of the"] * 3)]
    docs = spark.createDataFrame(rows)
    found = alignment.align(docs, tokenizer_path(A), tokenizer_path(B))
    counts = {(r.a, r.b): (r.links, r.a_most, r.b_most) for r in alignment.pair_counts(found).collect()}
    links = Counter(x for r in rows for x in slow_alignment(aligner, r.text)[3])
    assert {k: v[0] for k, v in counts.items()} == links
    assert all(v[1] == max(n for (a, _), n in links.items() if a == k[0]) and v[2] == max(n for (_, b), n in links.items() if b == k[1]) for k, v in counts.items())
    told = alignment.doc_links(found, alignment.pair_counts(found), keep=["n_links"])
    assert sorted((r.n_links, r.count_sum) for r in told.collect()) == sorted((len(x), sum(links[y] for y in x)) for x in (slow_alignment(aligner, r.text)[3] for r in rows))
    assert alignment.doc_links(found.limit(0), alignment.pair_counts(found.limit(0))).count() == 0


def labelled_text(page):
    tokens, _ = extraction.read_page(page)
    return "\n".join(t.text for t in tokens if isinstance(t, extraction.Block) and layouts.MARK in t.text)


def test_extraction_of_new_pages_and_of_layouts_never_seen():
    pages = list(layouts.labelled_pages(8, seed=77))
    model = extraction.default_model()
    assert all(model.extract(p) == labelled_text(p) for p in pages)
    right = 0
    for k in range(len(layouts.LAYOUTS)):
        other = extraction.Model(p for i, p in enumerate(layouts.labelled_pages()) if i // 30 != k)
        right += sum(other.extract(p) == labelled_text(p) for p in pages[8 * k : 8 * k + 8])
    assert right >= 0.9 * len(pages)


PAGE = """<html><body class="has-sidebar"><div id=top-menu><a href=/>Home</a> <a href=/a>News</a></div><div class=wrap>
<h1>A&nbsp;title &amp; more</h1><div class="entry-content responsive"><p>First  paragraph,
with <b>bold</b> and <i>italic</i> text &lt;here&gt;, 3 < 4 and a&b.<br>Next line.<p>Unclosed second paragraph about the same thing, with <a href="/x">a link</a> in it.
<script>var x = "<p>not text</p>";</script><div class="ad-slot"><p>Buy this now, only today and only here for you.</p></div>
<ul><li>One item of the list<li>Another item</ul><!-- <p>no</p> --><table><tr><td>Cell one<td>Cell two</table><p>Ok.</p></div></div>
<div class="comments"><h3>2 comments</h3><p>I do not agree with this at all, because it is wrong in every way.</p></div><div class=footer>Copyright us, all rights reserved</div><p cla"""


def test_extraction_of_a_loosely_written_page():
    assert extraction.default_model().extract(PAGE).split("\n") == [
        "A title & more", "First paragraph, with bold and italic text <here>, 3 < 4 and a&b. Next line.", "Unclosed second paragraph about the same thing, with a link in it.",
        "One item of the list", "Another item", "Cell one", "Cell two", "Ok.",
    ]


def test_extraction_of_odd_rows(spark):
    rows = [Row(page_id=1, url=None, html=None, text="x"), Row(page_id=2, url="u", html="", text="x"), Row(page_id=2, url="u", html="<nav><a href=/>Home</a></nav>", text="x"), Row(page_id=None, url="u", html="<article><p>Hi</p></article>" * 1, text="x"), Row(page_id=4, url="u", html="<article><p>" + "long text " * 50_000 + "</p></article>", text="x")]
    found = extraction.main_text(spark.createDataFrame(rows)).collect()
    assert sorted((r.page_id or 0, len(r.text)) for r in found) == [(0, 2), (1, 0), (2, 0), (2, 0), (4, 499_999)]
    assert extraction.main_text(spark.createDataFrame(rows).limit(0)).count() == 0


def test_op12_gives_the_article_of_every_page(spark):
    import html
    import re

    found = {r.page_id: r for r in extraction.op12_main_text(spark, SF).collect()}
    for p in spark.read.parquet(f"{SF}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", p.html, re.DOTALL)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert found[p.page_id].text == "\n".join(b for b in blocks if b)
        assert found[p.page_id].n_chars == len(found[p.page_id].text)
