from __future__ import annotations

import html
import re
import time

import numpy as np
import pytest

from caseflow.llm import html_extract as extract
from caseflow.llm import queries
from tests.llm.frames import SF


@pytest.fixture(scope="module")
def chain():
    return extract.default_field()


def test_accuracy_on_unseen_layouts(chain):
    pages = extract.training_pages(150, 901)
    pairs = [(a, b) for features, labels in pages for a, b in zip(chain.decode(features), labels)]
    assert np.mean([a == b for a, b in pairs]) > 0.98


def test_viterbi_by_brute_force():
    chain = extract.ChainField({"x": 0.7, "y": -0.4}, np.array([[0.3, -0.2], [-0.6, 0.5]]))
    for pattern in ("x", "yx", "xyyx", "yyxxyxy"):
        features = [[c] for c in pattern]
        gains = [chain.weights[c] for c in pattern]

        def total(labels):
            return sum(g for g, k in zip(gains, labels) if k) + sum(chain.moves[a, b] for a, b in zip(labels, labels[1:]))

        every = [[(n >> i) & 1 for i in range(len(pattern))] for n in range(2 ** len(pattern))]
        assert np.isclose(total(chain.decode(features)), max(map(total, every)))


def test_training_raises_the_likelihood_of_a_chain():
    pages = [([["a"], ["b"], ["b"]], [0, 1, 1]), ([["b"], ["b"], ["a"]], [1, 1, 0]), ([], [])] * 5
    chain = extract.train(pages)
    assert chain.decode([["a"], ["b"], ["b"], ["a"]]) == [0, 1, 1, 0]


def wanted(page):
    article = re.search(r"<article>(.*?)</article>", page, re.DOTALL)[1]
    parts = re.split(r"</?(?:p|h1)>", article)
    parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", p))).strip() for p in parts]
    return "\n".join(p for p in parts if p)


def test_whole_table(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    found = queries.op6_html_extraction(spark, SF).collect()
    assert len(found) == len(pages)
    for r in found:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, wanted(pages[r.page_id].html), len(r.text))


PAGE = """<!doctype html><head><title>T</title><script>if (a<b) x("</p>")</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>
<div id="cookie-notice"><p>We use cookies.</p><button>Yes</button></div>
<article><h1>The  title &amp; more</h1><p>First &lt;b&gt; para<br>graph&nbsp;one, with <b>bold
 <i>text</b> and some words.<p>Second one follows the first one here.<style>p{}</style></p>
<div class="comments"><div class="comment"><b>Ann</b><p>I like it a lot, thanks.</p></div></div></article>
<aside class="sidebar"><h3>Related</h3><ul><li><a href=/x>Other</a></li></ul></aside>
<form><label>Mail</label><input><button>Go</button></form><footer>&copy; 2020 Someone. All rights reserved.</footer>"""


def test_a_page_with_everything(chain):
    assert extract.main_text(PAGE, chain) == (
        "The title & more\nFirst <b> para graph one, with bold text and some words.\nSecond one follows the first one here."
    )


def test_odd_pages(spark, chain):
    rows = [(1, None), (2, ""), (3, "<" * 50), (4, "</p></div>"), (5, PAGE), (5, PAGE), (6, "<div>" * 3000 + "deep"), (7, "<!-- only"), (8, "&am &#0; &#x110000;")]
    df = spark.createDataFrame(rows, "page_id long, html string").selectExpr("*", "'u' as url", "1 as blocks", "2 as label")
    result = extract.extract(df)
    assert result.columns == [*df.columns, "text"] and result.count() == len(rows)
    found = {r.page_id: r.text for r in result.collect()}
    assert found[1] == found[2] == "" and found[5] == extract.main_text(PAGE, chain)
    assert extract.extract(df.limit(0)).count() == 0


def test_long_page(chain):
    page = "<article>" + "<p>Some words that make a sentence.</p>" * 20_000 + "</article>"
    assert extract.main_text(page, chain).count("\n") == 19_999


def test_marked_sections_and_unclosed_heads(spark, chain):
    story = "A first sentence of some length stands here. And another one follows it."
    whole = f"<article><p>{story}</p></article>"
    pages = [
        f"<![foo[x]]>{whole}", f"<![if !IE]><p>{whole}<![endif]>", f"{whole}<![", f"{whole}<!foo bar>", f"<![CDATA[x]]>{whole}",
        f"<html><head><title>t</title>{whole}", f"<head><meta charset=x><link rel=y><title>t</title>\n{whole}",
    ]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    assert [r.text for r in extract.extract(df).orderBy("page_id").collect()] == [story] * len(pages)
    assert [b.text for b in extract.blocks_of("<head><title>t</title> <p>x")] == ["x"]
    assert [b.text for b in extract.blocks_of("<head><title>t</title> Plain words.")] == ["Plain words."]


@pytest.mark.parametrize("unit", ["<font>", "<font class=x{}>", "<b><p>x", "<li>x<ul>", "<div id=c{}>x", "<ul><li><i>", "<i></b>"])
def test_time_grows_with_unclosed_tags(chain, unit):
    page = "".join(unit.format("abcdefgh"[i % 8] * (i % 40)) for i in range(50_000))
    started = time.perf_counter()
    extract.main_text(f"<article><p>Words.{page}", chain)
    assert time.perf_counter() - started < 5


def test_telling_words_anywhere():
    features = extract.features_of(extract.blocks_of("<p>" + "word " * 60 + "cookies and more"))
    assert "says cookies" in features[0]


def test_columns_of_the_caller_stay(spark, chain):
    df = spark.createDataFrame([(1, PAGE, "own", "older")], "page_id long, html string, text string, text_given string")
    result = extract.extract(df)
    assert result.columns == ["page_id", "html", "text_given_given", "text_given", "text"]
    row = result.first()
    assert (row.text_given_given, row.text_given, row.text) == ("own", "older", extract.main_text(PAGE, chain))
