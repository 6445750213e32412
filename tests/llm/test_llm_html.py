"""Extraction of main texts: inference against all assignments, parsing by hand, pages against their articles."""

import html
import itertools
import math
import random
import re

import pytest
from conftest_llm import rows

from profilum.llm import html_extract, labelled_pages
from profilum.llm.queries import QUERIES


@pytest.fixture(scope="module")
def model():
    return html_extract.trained()


def test_marginals_equal_enumeration(model):
    page = '<body><nav><a href="/">a</a></nav><div class="post"><p>Some text.</p>tail<aside>x</aside></div></body>'
    nodes = html_extract.tree(page)
    prepared = html_extract.prepared(nodes)
    odds = [sum(model.weights.get(name, 0.0) * value for name, value in row) for row in prepared.rows]
    chance, total = [0.0] * len(nodes), 0.0
    for states in itertools.product((0, 1), repeat=len(nodes)):
        weight = sum(value for value, state in zip(odds, states) if state)
        weight += sum(model.edges[kind, states[parent], state] for parent, kind, state in zip(prepared.parents, prepared.kinds, states) if parent >= 0)
        weight = math.exp(weight)
        total += weight
        for place, state in enumerate(states):
            chance[place] += weight * state
    assert model.marginals(nodes) == pytest.approx([value / total for value in chance])


def test_labelled_pages_are_learned(model):
    for page in labelled_pages.pages():
        nodes = html_extract.tree(page)
        assert [label for node, label in zip(nodes, html_extract.labels(nodes)) if node.text] == [int(chance > 0.5) for _, chance in html_extract.blocks(page, model)]


def article(page):
    begin = page.find("<article>")
    end = page.find("</article>", begin)
    inside = re.sub(r"<[^>]*$", "", page[begin : end if end >= 0 else len(page)])
    parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", part.replace("<br>", " "))).split()) for part in re.split(r"</?(?:p|h1|article)\b[^>]*>", inside)]
    return "\n".join(part for part in parts if part)


def test_pages(spark):
    pages = {key: (url, page) for key, url, page in rows("sf0.01", "pages", "page_id, url, html")}
    found = QUERIES["op6_html_extract"](spark, "/root/testdata/sf0.01").collect()
    assert len(found) == len(pages)
    for row in found:
        url, page = pages[row.page_id]
        assert (row.url, row.text, row.n_chars) == (url, article(page), len(article(page)))


def test_other_layouts(model):
    """A layout that no labelled page has."""
    page = """<!doctype html><html><head><title>t</title><style>a{}</style><script>if (a<b) document.write("<p>no</p>")</script></head><body>
    <header class="site-header"><div class="logo"><a href="/">Site</a></div><nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav></header>
    <div class="cookie-banner"><p>We use cookies, as everybody does.</p><button>OK</button></div>
    <main><article class="post"><h1>Heading  here</h1><p>First paragraph of the article, with <a href="/l">a link</a> &amp; more&nbsp;words.
    </p><div class="ad">Buy this, it is cheap and good.</div><p>Second paragraph, that says more than the first one does.<ul><li>point one<li>point two</ul>
    <form><label>Mail</label><input><p>Get our letter every week.</p></form></article></main>
    <aside class="sidebar"><p>Popular texts of this week, chosen by readers.</p></aside>
    <section id="comments"><h3>Comments</h3><div class="comment"><p>I liked this very much, thank you for writing.</p></div></section>
    <footer><p>Copyright by the site, all rights.</p></footer></body></html>"""
    expected = ["Heading here", "First paragraph of the article, with a link & more words.", "Second paragraph, that says more than the first one does.", "point one", "point two"]
    assert html_extract.main_text(page, model).split("\n") == expected


def test_parser_stands_anything():
    random.seed(7)
    for _ in range(500):
        page = "".join(random.choice(["<p>", "</p>", "<div class='a", '"', ">", "<", "&amp", "&", "text", "</", "<!--", "-->", "<li>", "<script>", "</script", "<a href=x>", "</a>", "</div>", "\n", "<td>", "<br/>"]) for _ in range(30))
        nodes = html_extract.tree(page)
        assert all(node.parent < place for place, node in enumerate(nodes))
    deep = html_extract.tree("<div>" * 50_000 + "x" + "</div>" * 50_000 + "</p>" * 50_000)
    assert deep[-1].text == "x"
    assert [node.text for node in html_extract.tree("<p>a&am") if node.text] == ["a&am"]
    assert [node.text for node in html_extract.tree("<p>a <di") if node.text] == ["a"]


def test_awkward_rows(make, model):
    long = "<article>" + "<p>Some words, again and again.</p>" * 20_000 + "</article>"
    schema = "page_id long, url string, html string"
    pages = [(1, "u", None), (2, None, ""), (None, "v", "<article><p>Some text, that is it.</p></article>"), (3, "w", "plain text"), (3, "w", "plain text"), (4, "x", long)]
    found = html_extract.extract(make(pages, schema)).collect()
    assert sorted([(row.id, row.url, row.text, row.n_chars) for row in found], key=repr) == sorted([(key, url, html_extract.main_text(page, model), len(html_extract.main_text(page, model))) for key, url, page in pages], key=repr)
    assert {row.id: row.text.count("\n") for row in found}[4] == 19_999
    assert html_extract.extract(make(pages, schema).where("page_id = 9")).count() == 0


def test_nothing_else_is_dropped(model):
    """Formulas stay, and an unclosed drawing or player does not take the rest of its page."""
    rest = "".join(f"<p>Paragraph {place} of the article goes on with a few more words, and ends.</p>" for place in range(6))
    start = "<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article class='post'><h1>A title</h1><p>Energy is <math><mi>E</mi>=<mi>m</mi></math> as known, for a long time.</p>"
    whole = html_extract.main_text(start + rest + "</article></body></html>", model)
    assert whole.startswith("A title\nEnergy is E=m as known") and whole.count("\n") == 7
    for element in ("<svg width=3>", "<video src=x>", "<object>", "<canvas>" * 1000):
        assert html_extract.main_text(start + element + rest + "</article></body></html>", model) == whole
    assert html_extract.main_text(start + "<svg><text>drawn</text></svg>" + rest + "</article></body></html>", model) == whole
