"""Lists, tables, headings and captions of an article, and broken pages of any size."""

import time

import pytest

from airops.llm import html

PAGES = "/root/testdata/sf0.01/pages.parquet"
ELEMENTS = {
    "ul": "<ul><li>{}</li><li>{}</li></ul>", "ol": "<ol><li>{}</li><li>{}</li></ol>",
    "short ul": "<ul><li>Iron</li><li>Two cups</li></ul>", "short ol": "<ol><li>Mix it</li><li>Bake</li></ol>",
    "table": "<table><tr><td>{}</td><td>{}</td></tr></table>",
    "short table": "<table><tr><th>Name</th></tr><tr><td>42</td></tr></table>",
    "dl": "<dl><dt>Term</dt><dd>{}</dd></dl>", "pre": "<pre>{}\n{}</pre>", "h2": "<h2>Further findings</h2>",
    "figcaption": "<figure><figcaption>{}</figcaption></figure>", "blockquote": "<blockquote>{}</blockquote>"}
FIRST = "The committee met on Tuesday to hear the report of the survey, and it agreed to publish the whole of it."
LAST = "Rivers in the north had risen by two metres during the week, which nobody had expected so early in spring."
INSIDE = ("The first gauge stood near the old bridge.", "Another one was placed below the mill")
PAGE = ('<!DOCTYPE html><html><head><title>Floods</title></head><body><nav><ul><li><a href="/">Home</a></li>'
        '<li><a href="/n">News</a></li></ul></nav>{}<div class="ad">Buy two boats and get one free.</div>'
        '<footer><p>Copyright by the paper</p></footer></body></html>')


@pytest.fixture(scope="module")
def net(spark):
    return html.train(spark.read.parquet(PAGES))


@pytest.mark.parametrize("box", ["<article>{}</article>", '<div class="post-content">{}</div>'])
def test_every_element_of_an_article_stays(net, box):
    bodies = {name: box.format(f"<h1>Floods in the north</h1><p>{FIRST}</p>{e.format(*INSIDE)}<p>{LAST}</p>")
              for name, e in ELEMENTS.items()}
    found = [html.blocks(PAGE.format(b)) for b in bodies.values()]
    for (name, body), blocks, p in zip(bodies.items(), found, html.label_pages(net, found, html.Vectors())):
        got = " ".join(b.text for b, v in zip(blocks, p) if v >= 0.5)
        assert got == " ".join(b.text for b in html.blocks(body)), name


def test_scripts_do_not_close_themselves():
    assert [b.text for b in html.blocks("<script src=//c.d/e/>var a=1;</script><p>x")] == ["x"]
    assert [b.text for b in html.blocks("<p>a <svg viewBox='0'/>b")] == ["a b"]


@pytest.mark.parametrize("page,n", [("<div>x" * 40_000, 40_000), ("<svg>" * 40_000, 0), ("<b><p>x" * 20_000, 20_000),
                                    ("<div>" * 20_000 + "</p>x" * 20_000, 20_000)])
def test_broken_pages_take_linear_time(page, n):
    start = time.process_time()
    found = html.blocks(page)
    assert len(found) == n and len(html.Vectors().of(found)) == n
    assert time.process_time() - start < 10


def test_paths_are_those_of_the_open_elements():
    inner = html.blocks('<html><body><div class="post-body"><ul><li>one')[0]
    assert inner.path == ("html", "body", "div post body", "ul", "li") and inner.at.depth == 5
    assert html.path_label(inner) == 1 and html.blocks("x")[0].path == ()
