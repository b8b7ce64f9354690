import json

from gleanmill.operators import pages as P


def pages(spark, *rows):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id int, url string, html string")


def test_triage_and_fallbacks(spark):
    words = "word " * 200
    df = pages(spark, ("http://a/x.pdf", "<html>"), ("http://a", " "), ("http://a", None), ("http://a", words), ("http://a", "short  text"), ("http://a", "<p>x"))
    got = P.triage_pages(df).orderBy("page_id").collect()
    assert [r.status for r in got] == ["pdf", "empty", "empty", "not_html", "not_html", "html"]
    assert got[1].title == "Empty Content" and got[4].content.endswith("Raw content: short  text</p>")
    shown = got[3].content.split("Raw content: ")[1]
    assert len(shown) <= 504 and shown.endswith("word...</p>")


HTML = """<html><head><title> The
 Title </title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body><nav>menu <a href="/m">m</a></nav>
<div class="ad">buy</div><article><h2>Head &amp; more</h2><p>One <b>bold</b> <a href="/x">link</a><p>Two<br>lines <i>it</i>
<ul><li>first<li>second<ul><li>deep</ul></ul><img src="p.png" alt="pic"><pre>  code
 here</pre><blockquote>said</blockquote></article><footer>foot</footer></body></html>"""


def test_article_content_and_markdown():
    title, html, markdown = P.article_of(HTML)
    assert title == "The Title"
    assert "<nav>" not in html and "foot" not in html and "buy" not in html and "var a" not in html
    assert markdown.startswith("## Head & more\n\nOne **bold** [link](/x)\n\nTwo  \nlines *it*")
    assert "* first\n* second\n  * deep" in markdown and "![pic](p.png)" in markdown
    assert "```\n  code\n here\n```" in markdown and "> said" in markdown


def test_main_content_without_article_tags():
    html = "<body><div><p>" + "text " * 50 + "</p></div><div><a href='/1'>x</a></div></body>"
    assert P.article_of(html)[2].strip() == ("text " * 50).strip()
    assert P.article_of("<body><nav>x</nav></body>")[1] == P.NO_ARTICLE


def test_extract_all_statuses(spark):
    df = pages(spark, ("http://a", HTML), ("http://a", "plain"), ("http://a/p.pdf", ""), ("http://a", ""))
    got = {r.page_id: r for r in P.extract_articles(df).collect()}
    assert [got[i].status for i in range(4)] == ["html", "not_html", "pdf", "empty"]
    texts = {r.page_id: r.markdown for r in P.articles_to_markdown(P.extract_articles(df)).collect()}
    assert texts[0].startswith("# The Title\n\n## Head") and texts[3] == "# Empty Content\n\nNo content could be extracted from this page"
    assert sorted(texts) == [0, 1, 3]


def test_blocks(spark, table):
    df = spark.createDataFrame(
        [(1, "http://a/d/p?q=1", "x ![i](../i.png) ![j]( //b/j.png )\n![k](http://c/k)"), (2, "http://a", " "), (3, "http://a", "![](#f)")],
        "page_id int, url string, markdown string",
    )
    assert table(P.split_blocks(df)) == [
        (1, 0, "text", "x"), (1, 1, "image_url", "http://a/i.png"), (1, 3, "image_url", "http://b/j.png"), (1, 5, "image_url", "http://c/k"),
        (2, 0, "text", "No content available"), (3, 1, "image_url", "http://a#f"),
    ]


def test_clips(spark):
    df = spark.createDataFrame([(1, "u", "html", "é" * 1500), (2, "p", "pdf", None)], "page_id int, url string, status string, markdown string")
    got = {r.page_id: json.loads(r.payload) for r in P.clip_articles(df).collect()}
    assert got[1] == {"url": "u", "crawled_content": "é" * 1000}
    assert got[2]["is_pdf"] is True and got[2]["crawled_content"] is None and got[2]["error"].startswith("PDF files")
