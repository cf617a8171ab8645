"""Main text of pages: articles put into many templates come back whole."""

import os
import random
import time

import pytest

from priorwise.llm import html_text, queries

WORDS = "and of the thing other were from it stand letter for answer quite through again nothing river".split()


def prose(r, n):
    return [" ".join(r.choice(WORDS) for _ in range(r.randrange(12, 60))).capitalize() + "." for _ in range(n)]


def escaped(text):
    return text.replace("&", "&amp;").replace("<", "&lt;")


MENU = '<ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">Contact</a></li></ul>'
COMMENT = "<p>MARK I have read this twice and I still think that nothing in it stands.</p>"
TEMPLATES = {
    "elements": lambda t, ps: f"<!DOCTYPE html><html><head><title>MARK</title><style>p{{MARK}}</style></head><body><nav>{MENU}</nav><div class='ad'>MARK</div><article><h1>{t}</h1>{ps}</article><aside><p>MARK</p></aside><footer>&copy; MARK</footer><script>var MARK = '</p>';</script></body></html>",
    "names": lambda t, ps: f"<body><div id=pageHeader>MARK {MENU}</div><div class='layout has-sidebar'><div class=content><h1>{t}</h1>{ps}</div><div id=sidebar-left><h4>MARK</h4><p>MARK MARK</p></div></div><div class='cookie-banner'><p>MARK this site keeps cookies.</p></div><div class=footer>MARK</div>",
    "plain": lambda t, ps: f"<div>{MENU}</div><div><h1>{t}</h1>{ps}</div><div>MARK all rights reserved. <a href=/x>Terms</a></div>",
    "comments": lambda t, ps: f"<main><h1>{t}</h1>{ps}<form><label>MARK<input name=q></label><button>MARK</button></form></main><section id=comments><h2>Comments</h2>{COMMENT * 12}</section>",
    "headed comments": lambda t, ps: f"<div class=a><h2>{t}</h2>{ps}</div><div class=b><h3>3 Comments</h3>{COMMENT * 9}</div>",
    "inside": lambda t, ps: f"<article><header><h1>{t}</h1><span>MARK</span></header><!-- MARK --><div class='share-buttons'>MARK</div>{ps}<div class=promo>MARK</div><ul><li><a>MARK one</a><li><a>MARK two</a><li><a>MARK three</a></ul></article>",
    "hidden": lambda t, ps: f"<div hidden>MARK</div><div style='display: none'>MARK</div><div role=dialog>MARK</div><div class=text><h1>{t}</h1>{ps}</div><noscript>MARK</noscript><svg><text>MARK</text></svg>",
    "table": lambda t, ps: f"<table><tr><td>{MENU}<td><h1>{t}</h1>{ps}<td><a href=1>MARK</a></table>",
}


@pytest.mark.parametrize("closed", [True, False])
@pytest.mark.parametrize("name", TEMPLATES)
def test_templates(name, closed):
    r = random.Random(name)
    for n in (3, 8, 25):
        title, texts = "A title & more", prose(r, n) + ["Short."] + prose(r, 1)
        ps = "".join(f"<p>{escaped(t)}</p>" if closed else f"<p><b>{escaped(t)}<br>\n " for t in texts)
        assert html_text.main_text(TEMPLATES[name](escaped(title), ps)) == "\n".join([title, *texts])


def test_blocks():
    page = "<article>one <b>two</b>three<br>four<p>five &lt;6&gt; &#8364;&nbsp;&amp;\n\t x</p>tail<ul><li>a<li>b</ul><table><tr><td>1<td>2</table><pre>p  q\nr</pre><blockquote>said</blockquote></article>"
    assert html_text.main_text(page) == "one twothree four\nfive <6> € & x\ntail\na\nb\n1\n2\np q r\nsaid"


def test_broken_markup():
    for page in ("<", "<a", "</", "<!--", "<p", "<![CDATA[x", "<script>x", "&", "<p title='", "</p></div>", "<b><i></b></i>", "<!>", "<?xml", "\x00", "<title>t"):
        assert isinstance(html_text.main_text(page), str)
    assert html_text.main_text("<p title='a > b' class=x>in <a href=\"?a=1&b=2\">a link</a>, 1 < 2 & so on") == "in a link, 1 < 2 & so on"


def test_time_follows_length():
    """Deep, unclosed and very long pages take time in proportion to their length."""
    deep = "<div>" * 100_000 + "deep" + "</div>" * 100_000
    start = time.time()
    assert html_text.main_text(deep) == "deep"
    assert html_text.main_text("text " * 2_000_000) == ("text " * 2_000_000).strip()
    assert len(html_text.main_text("<p>word " * 100_000).split()) == 100_000
    for odd in ('<a "' * 100_000, "<!--" * 100_000, '<div class="' * 100_000, "<ul>" + "<div>" * 20_000 + "<li></li>" * 20_000, "<h2>Comments</h2>" * 30_000, "<b>" * 50_000 + "<p>x</b>" * 20_000):
        html_text.main_text(odd)
    assert time.time() - start < 60


def test_query(spark, tmp_path):
    pages = [(1, "u", TEMPLATES["elements"]("T", "<p>Text of it.</p>"), 5, "x"), (2, None, None, 5, "x"), (3, "v", "", None, "x"), (None, "w", "<p>no id", 5, "x"), (1, "u", "<p>again", 5, "x"), (1, "u", "<p>again", 5, "x")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string, n_chars int, text string")
    table.write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.QUERIES["op12_html_text"](spark, str(tmp_path))
    assert got.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "u", "T\nText of it.", 13), (2, None, "", 0), (3, "v", "", 0), (None, "w", "no id", 5), (1, "u", "again", 5), (1, "u", "again", 5)], key=repr)
    assert html_text.extract_text(table.limit(0)).count() == 0
    assert html_text.extract_text(table).columns == ["page_id", "url", "html", "text", "n_chars"]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_given_pages(spark):
    """The given pages have one template, whose article is easily cut out by hand."""
    import html
    import re

    rows = queries.table(spark, "/root/testdata/sf0.001", "pages").collect()
    got = {r.page_id: r.text for r in queries.QUERIES["op12_html_text"](spark, "/root/testdata/sf0.001").collect()}
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[r.page_id] == "\n".join(b for b in blocks if b)
