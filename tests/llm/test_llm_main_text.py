"""Extraction from the sample pages, from layouts that were not trained on, and marginals against enumeration."""

import html
import itertools
import math
import random
import re

import cases
import pytest

from orderlens.llm import main_text as m
from orderlens.llm.page_training import LABELLED_PAGES
from orderlens.llm.queries import op12_main_text


def article_of(page):
    """The article of a sample page, cut out by its own tags."""
    inside = page[page.index("<article>") + 9 : page.index("</article>")]
    blocks = re.split("<p>|</p>|<h1>|</h1>", inside)
    texts = [re.sub(r"[ \t-\r]+", " ", html.unescape(re.sub("<[^>]*>", " ", b.replace("<b>", "")))).strip(" ") for b in blocks]
    return "\n\n".join(t for t in texts if t)


@pytest.mark.parametrize("directory", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_returns_the_article_of_every_sample_page(spark, directory):
    df = op12_main_text(spark, directory)
    assert df.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{directory}/pages.parquet").collect()}
    rows = df.collect()
    assert len(rows) == len(pages)
    assert [r.page_id for r in rows if r.text != article_of(pages[r.page_id])] == []
    assert all(r.n_chars == len(r.text) for r in rows)


def test_marginals_match_enumeration_of_all_states():
    model = m.trained()
    rng = random.Random(1)
    for _ in range(30):
        page = "".join(rng.choice(["<div>", "<div class=ad>", "<section id=comments>", "</div>", "<p>word word", "<ul><li><a>link</a>", "</ul>", "<nav>", "</nav>"]) for _ in range(9))
        nodes = m.parsed(page)[:11]
        place = {id(n): i for i, n in enumerate(nodes)}
        evidence = [model.evidence(n) for n in nodes]
        total, yes = 0.0, [0.0] * len(nodes)
        for states in itertools.product((0, 1), repeat=len(nodes)):
            log = sum(e[s] for e, s in zip(evidence, states))
            log += sum(model.step(n)[states[place[id(n.parent.variable)]]][s] for n, s in list(zip(nodes, states))[1:])
            weight = math.exp(log)
            total += weight
            for i, s in enumerate(states):
                yes[i] += s * weight
        for found, expected in zip(model.marginals(nodes), yes):
            assert found == pytest.approx(expected / total, abs=1e-9)


def test_labelled_pages_are_learnt():
    model = m.trained()
    wrong = total = 0
    for page in LABELLED_PAGES:
        nodes = m.parsed(page)
        for node, p in zip(nodes, model.marginals(nodes)):
            if node.words:
                total += 1
                wrong += (p >= 0.5) != node.label
    assert wrong <= 0.02 * total


GOOD = ["Heading of it", *[f"Sentence number {i} tells what happened in the valley, and why it took so long to be known." for i in range(4)]]
# Texts that say "junk" must go.
HELD_OUT = [
    """<body><div class="masthead"><a href="/">junk</a></div><div class="nav-bar"><a>junk a</a><a>junk b</a></div><div class="post-content"><h1>{0}</h1><p>{1}</p>
       <p>{2}</p><p>{3}</p><p>{4}</p></div><div class="comments-area"><h2>junk replies</h2><div class="comment-body"><p>junk said one who read it</p></div></div>
       <div class="footer-wrap"><p>junk rights</p></div></body>""",
    """<html><head><title>junk</title><body><div id="cookie-banner">junk cookies <button>ok</button></div><main><h1>{0}</h1><section><p>{1}<p>{2}</section>
       <p>{3}<ul><li>{4}</ul></main><aside><h3>junk news</h3><ul><li><a>junk</a></ul></aside><form>junk <input></form><footer>junk</footer>""",
    """<div role="navigation"><ul><li><a>junk</a><li><a>junk</a></ul></div><article><h2>{0}</h2><div><p>{1}</p><div class="advertisement"><p>junk to buy</p></div>
       <p>{2}</p><p>{3}</p></div><blockquote>{4}</blockquote></article><div id="sidebar"><p>junk at the side of the page</p></div><div id="comments"><p>junk</p></div>""",
]


@pytest.mark.parametrize("layout", HELD_OUT)
def test_layouts_that_were_not_trained_on(layout):
    assert m.main_text(layout.format(*GOOD)) == "\n\n".join(GOOD)


def test_white_space_references_and_unclosed_elements():
    page = "<article><h1>A&nbsp;b &amp;\n\t c</h1><p>one<br>two <b>th<i>r</i>ee<p>four &eacute;&#x41;<!-- no --> end of it</article>"
    assert m.main_text(page) == "A b & c\n\none two three\n\nfour éA end of it"


@pytest.mark.parametrize("page", [None, "", "<", "<p", "&", "</div></p>", "<script>x", "<!--", "<![CDATA[x", "<head><title>t"])
def test_broken_pages_do_not_fail(page):
    assert isinstance(m.main_text(page), str)


def test_deep_and_long_pages():
    assert m.main_text("<div>" * 20_000 + "<p>x") is not None
    words = " ".join(["word"] * 300_000)
    assert m.main_text(f"<nav><a>x</a></nav><article><h1>t</h1><p>{words}</p></article>") == f"t\n\n{words}"


def test_edge_rows(spark):
    page = f"<nav><a>junk</a></nav><article><p>{cases.PROSE}</p></article>"
    rows = [(1, "u", page), (1, "u", page), (None, None, page), (2, "u", None), (3, "u", ""), (4, "u", " \n ")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "9 AS n_chars", "'y' AS label")
    out = m.extracted(df)
    assert out.columns == ["page_id", "url", "label", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in out.collect()) == sorted(
        (r[0] or 0, cases.PROSE if r[2] == page else "", len(cases.PROSE) if r[2] == page else 0) for r in rows
    )
    assert m.extracted(df.limit(0)).collect() == []
