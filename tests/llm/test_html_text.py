"""Page texts against hand-made pages, the cut against all labellings."""

from __future__ import annotations

import html
import itertools
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from __spark_entry__ import queries
from tagshift.llm.html_text import extract, main_text, minimum_cut, read


def energy(costs, joined, labels):
    cut = sum(-c if on else 0 for c, on in zip(costs, labels) if c < 0) + sum(0 if on else c for c, on in zip(costs, labels) if c > 0)
    return cut + sum(c for a, b, c in joined if labels[a] != labels[b])


@given(st.data())
@settings(max_examples=150, deadline=None)
def test_cut_is_the_cheapest_labelling(data):
    n = data.draw(st.integers(1, 8))
    costs = data.draw(st.lists(st.integers(-9, 9), min_size=n, max_size=n))
    pairs = list(itertools.combinations(range(n), 2))
    joined = [(a, b, data.draw(st.integers(0, 6))) for a, b in pairs if data.draw(st.booleans())]
    labels = minimum_cut(costs, joined)
    best = min(energy(costs, joined, x) for x in itertools.product([False, True], repeat=n))
    assert energy(costs, joined, labels) == best
    # of the cheapest labellings the one with most content
    assert sum(labels) == max(sum(x) for x in itertools.product([False, True], repeat=n) if energy(costs, joined, x) == best)


PROSE = "A first sentence of plain prose that goes on for a while. And a second one follows it."
LINES = {
    "article with everything around": (
        f"<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{{}}</style><script>var a='<p>no</p>';</script></head><body class='with-sidebar menu-open'>"
        f"<header><h1>Site</h1><p>{PROSE}</p></header><nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav>"
        f"<div class='cookie-notice'><p>{PROSE} We use cookies.</p></div><div class=\"ad\">{PROSE}</div>"
        f"<main><article><h1>Head &lt;x&gt;</h1><p>One <b>bo</b>ld  word.<br>Next\n line<p>Sh.<div class='newsletter'><p>{PROSE}</p></div><blockquote>{PROSE}</blockquote>"
        f"<ul><li>first point<li>second point</ul><form action=/s><p>{PROSE}</p><input name=q><button>Go</button></form></article>"
        f"<section id=comments><article class=comment><p>{PROSE} I disagree.</p></article></section></main>"
        f"<aside><p>{PROSE}</p></aside><div id='sidebarLeft'><p>{PROSE}</p></div><footer><p>&copy; 2024 {PROSE}</p></footer></body></html>",
        f"Head <x> One bold word. Next line Sh. {PROSE} first point second point",
    ),
    "no signs": (f"<p>{PROSE}</p><div>Short.</div>plain &eacute;", f"{PROSE} Short. plain é"),
    "links without nav": (f"<div><a href=a>Alpha</a> <a href=b>Beta</a> <a href=c>Gamma</a></div><div><p>{PROSE}<p>{PROSE}</div>", f"{PROSE} {PROSE}"),
    "form around the page": (f"<form id=aspnet><main><p>{PROSE}</main></form>", PROSE),
    "sidebar is the layout": (f"<div class='has-sidebar'><p>{PROSE}</div>", PROSE),
    "heading in the article's header": (f"<article><header><h2>Title</h2><p>By someone</p></header><p>{PROSE}</p></article>", f"Title {PROSE}"),
    "hidden": (f"<article><p>{PROSE}</p><p hidden>{PROSE}</p><div style='display: none'>{PROSE}</div></article>", PROSE),
    "inline advert": (f"<article><p>{PROSE} <span class='ad'>Buy now.</span>Go on.</p></article>", f"{PROSE} Go on."),
    "broken": (f"<article><p title='a > b'>a < b &amp c &am <p>{PROSE}</b></article></section><foot", f"a < b & c &am {PROSE}"),
    "comments and doctype": ("<!-- > <p>x</p> --><!--><p>seen.</p><!---><p>too.</p><?php <b> ?><p>last.</p><!-- open <p>gone</p>", "seen. too. ?> last."),
    "script unclosed": ("<p>before it.</p><script>if (a</b) '<p>x</p>'", "before it."),
    "table": ("<table><tr><td>one.<td>two.<tr><td>three.</table>", "one. two. three."),
    "no markup": ("just a line of text", "just a line of text"),
    "nothing": ("<html><body><nav><p>x</p></nav></body></html>", ""),
    "empty": ("", ""), "null": (None, ""), "spaces": (" \n\t&nbsp; ", ""),
}


@pytest.mark.parametrize("name", sorted(LINES))
def test_pages(name):
    page, text = LINES[name]
    assert main_text(page) == text


def test_smoothness_decides_where_a_block_says_little():
    link = "<p><a href=x>a line that is all link</a></p>"
    assert main_text(f"<article><p>{PROSE}</p>{link}<p>{PROSE}</p></article>").count("all link") == 1
    assert main_text(f"<p>{PROSE}</p><div>" + link * 6 + "</div>") == PROSE


def test_long_and_deep_pages():
    deep = "<div>" * 20_000 + f"<p>{PROSE}</p>" + "</span>" * 20_000
    assert main_text(deep) == PROSE
    many = "".join(f"<p>{PROSE} {i}.</p>" if i % 3 else f"<nav>{PROSE}</nav>" for i in range(6_000))
    assert main_text(many).count("second one") == 4_000
    quotes = "<p class=\"a" * 3_000 + PROSE
    assert main_text(quotes) == ""


@given(st.text(alphabet="<>/!-\"'= apbdivnsc&;\n", max_size=80))
@settings(max_examples=300, deadline=None)
def test_any_string_is_read(text):
    page = read(text)
    assert len(page.texts) == len(page.costs) == len(page.holders)
    assert "\n" not in main_text(text)


def test_given_pages(spark, sf_dir):
    got = {r.page_id: r for r in queries()["op12_html_text"](spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        inside = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        text = " ".join(html.unescape(re.sub(r"</?(?:p|h1|br)\b[^>]*>", " ", inside).replace("<b>", "").replace("</b>", "")).split())
        assert (got[r.page_id].url, got[r.page_id].text, got[r.page_id].n_chars) == (r.url, text, len(text))


def test_edges(spark):
    rows = [(1, None, "u", "old"), (2, "", None, "old"), (None, f"<p>{PROSE}</p>", "u", "old"), (3, f"<p>{PROSE}</p>", "u", "old"), (3, f"<p>{PROSE}</p>", "u", "old")]
    schema = "page_id long, html string, url string, text string"
    got = extract(spark.createDataFrame(rows, schema))
    assert got.columns == ["page_id", "html", "url", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got.collect()) == [(0, PROSE, len(PROSE)), (1, "", 0), (2, "", 0), (3, PROSE, len(PROSE)), (3, PROSE, len(PROSE))]
    assert extract(spark.createDataFrame([], schema)).count() == 0
