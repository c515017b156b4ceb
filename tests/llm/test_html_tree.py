import html
import re
import time

import pytest
from llm_frames import clashing, empty

from readpaths.llm import html_tree as H

PAGES = "page_id long, url string, html string"
P = "The committee met on Tuesday, and it said that the bridge will open soon, before the rain comes back to the valley."
C = "I think this is wrong, the bridge was never safe and they all know it, just look at the photos."


@pytest.fixture(scope="module")
def model():
    return H.Model(H.labelled_counts())


CASES = [
    (f'<body><div id="top-nav"><a href=x>A</a></div><div class="main-content"><h2>T</h2><p>{P}<p>{P}</div><div class="reader-comments"><p>{C}</p><p>{C}</p></div><div class="sidebar"><p>{C}</p></div></body>', ["T", P, P]),
    (f'<article><h1>T</h1><p>{P}</p><aside><p>{C}</p></aside><p>{P}</p><div id="comments"><h3>Comments</h3><p>{C}</p><p>{C}</p></div></article>', ["T", P, P]),
    (f"<div><p>{P}</p><p>{P}</p><p>{P}</p></div><div><a>x</a> <a>y</a></div>", [P, P, P]),
    (f'<header><p>Welcome, friends.</p></header><div role="alert">We use cookies, please agree.</div><article><p>Short.</p><form><p>Enter your mail, please.</p><input></form><ul><li>One<li>Two</ul>'
     f"<table><tr><td>1<td>2</table></article><footer><p>{C}</p></footer>", ["Short.", "One", "Two", "1", "2"]),
    ("plain text &amp; more", ["plain text & more"]),
    ("<p>only a paragraph, that is all there is.</p>", ["only a paragraph, that is all there is."]),
    ("<article><p>a &lt; b&nbsp;c<script>if(a<b){'</p>'}</script> d</p><!-- x <p>no</p> --><p>e<br>f</p><p cl", ["a < b c d", "e f"]),
    (f'<article><p>{P}</p><section class="notice"><p>{C}</p></section><div class="newsletter-form"><p>{C}</p></div><p>{P}</p></article><section class="comments"><article class="comment"><p>{C}</p></article></section>', [P, P]),
    (f'<html><body><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="ad">{C}</div><article><h1>Head</h1><p><b>Lead.<br><p>{P}</p></article><footer>&copy; x</footer>', ["Head", "Lead.", P]),
    (f"<article><p>{P} Energy is <math><mi>E</mi><mo>=</mo><mn>5</mn></math> in all, and <object data=x>the <b>fallback</b> text</object> stays.</p><p>{P}</p></article>",
     [f"{P} Energy is E=5 in all, and the fallback text stays.", P]),
    (f'<main><h1>x</h1><p>{P}</p><div class="ad-slot"><p>{C}</p></div><blockquote>{P}</blockquote></main><aside>{C}</aside>', ["x", P, P]),
]


@pytest.mark.parametrize(("page", "want"), CASES)
def test_layouts(model, page, want):
    assert model.texts([page])[0].split("\n") == want


def test_batches_do_not_change_results(model):
    pages = [c[0] for c in CASES] * 3
    assert model.texts(pages) == [model.texts([p])[0] for p in pages]


def test_marginals_are_exact(model):
    """Sum-product against the sum over all assignments of a small tree."""
    import itertools

    import numpy as np

    page = H.Page(f'<div class="post"><p>{P}</p><div class="share"><a href="/">x</a></div></div><footer>z</footer>')
    values = page.features()
    total = np.zeros(len(values))
    norm = 0.0
    for states in itertools.product(H.STATES, repeat=len(values)):
        logp = 0.0
        for v, (tag, cue, *rest) in enumerate(values):
            above = states[page.parent[v]] if v else -1
            logp += model.potential(tag, tuple(rest))[states[v]] + model.join(tag, cue)[above][states[v]]
        norm += np.exp(logp)
        total += np.exp(logp) * (np.array(states) == H.CONTENT)
    assert model.marginals([page])[0] == pytest.approx(total / norm, abs=1e-9)


def test_held_out_accuracy_on_labelled_pages():
    furniture = [w for cue, words in H.CUES.items() if cue not in ("content", "frame") for w in words.split()]
    pages = [H.Page(p) for p in H.labelled_pages(furniture, H.CUES["content"].split())]
    learned = H.Model(H.count_labels((p, p.labels()) for i, p in enumerate(pages) if i % 4))
    held = [p for i, p in enumerate(pages) if i % 4 == 0]
    right = total = 0
    for page, marginal in zip(held, learned.marginals(held), strict=True):
        for want, got in zip(page.labels(), marginal, strict=True):
            total += 1
            right += (want == H.CONTENT) == (got >= 0.5)
    assert right / total > 0.9


def plain(page):
    """The test tables' pages: blocks of the article by their tags."""
    m = re.search(r"<article>(.*?)(</article>|\Z)", page or "", re.S)
    blocks = re.split(r"</?(?:p|h1|br)>", m[1]) if m else []
    return "\n".join(b for b in (" ".join(html.unescape(b.replace("<b>", "")).split()) for b in blocks) if b)


def test_whole_test_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in H.extract(pages).collect()}
    assert got == {r["page_id"]: (r["url"], plain(r["html"]), len(plain(r["html"]))) for r in pages.collect()}


@pytest.mark.parametrize("junk", ["<b>" * 80_000 + "</i>" * 80_000, "<i>" + "<b>" * 60_000 + "<hr>" * 60_000, "<select>" * 60_000, "<svg><button>" * 40_000,
                                  "<td>" + "<x>" * 50_000 + "<li></li><td></td>" * 20_000, "<table><tr>" + "<b>" * 50_000 + "<td></td>" * 30_000])
def test_reading_takes_time_in_proportion_to_the_page(junk):
    """Unclosed and stray tags: each of these pages took minutes when an end tag walked the open elements."""
    began = time.process_time()
    H.Page(junk + P)
    assert time.process_time() - began < 10


def test_awkward_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", " \n "), (3, "u", " \n "), (None, "u", f"<p>{P}"), (4, "u", "<" * 2000), (5, "u", "<div>" * 3000 + P), (6, "u", f"<article><p>{P * 3000}</p></article>"),
            (7, "u", "<p title='x>" + P), (8, "u", "</p></div>&#0;&bogus;&#x1F600;"), (9, "u", "<script>never closed " + P), (10, "u", "<!-- open " + P)]
    out = H.extract(clashing(spark.createDataFrame(rows, PAGES).repartition(3), "text", "n_chars", "id"))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = {r["page_id"]: r["text"] for r in out.collect()}
    assert out.count() == 12 and got[1] == got[2] == got[3] == got[9] == got[10] == "" and got[None] == P and got[6] == P * 3000
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect())


def test_empty_table(spark):
    assert H.extract(empty(spark, PAGES)).count() == 0
