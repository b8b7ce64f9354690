import json

import pytest
from pyspark.sql import functions as F

from gleanmill.operators import citations as C


def messages(spark, *items):
    return spark.createDataFrame(
        [(1, i, name, content if isinstance(content, (str, type(None))) else json.dumps(content)) for i, (name, content) in enumerate(items)],
        "thread_id bigint, seq bigint, name string, content string",
    )


def test_harvest_by_tool_and_by_shape(spark):
    page = {"url": "http://a", "title": "A", "content": "x" * 600, "score": 0.5}
    df = messages(
        spark,
        ("web_search", [page, {"type": "image_url", "url": "http://i"}, {"url": ""}, {"url": "http://b"}]),
        ("Brave_Search", {"results": [{"url": "http://c", "title": "C"}]}),
        ("web_search", {"error": "x", "results": [{"url": "http://no"}]}),
        ("jina_crawl", {"url": "http://d", "crawled_content": "# Title D\ntext"}),
        ("other", [{"url": "http://e"}]), ("other", [{"link": "x"}, {"url": "http://no"}]),
        ("other", {"url": "http://f", "content": "c"}), ("other", {"url": "http://no"}),
        ("web_search", "not json"), ("web_search", None), ("web_search", [{"url": "http://a", "title": "later"}]),
        ("crawl", [{"url": "http://no"}]),
    )
    got = {r.url: r for r in C.harvest_citations(df).collect()}
    assert sorted(got) == ["http://a", "http://b", "http://c", "http://d", "http://e", "http://f"]
    assert (got["http://a"].title, len(got["http://a"].content_snippet), got["http://a"].domain) == ("A", 500, "a")
    assert (got["http://b"].title, got["http://b"].description) == ("Untitled", "")
    assert (got["http://d"].title, got["http://d"].source_type) == ("Title D", "crawl")
    assert (got["http://f"].title, got["http://f"].raw_content) == ("Untitled", "")


SOURCE = """thread_id bigint, seq bigint, type string, url string, title string, description string, content_snippet string,
 raw_content string, relevance_score double"""


def sources(spark, *rows):
    return spark.createDataFrame([(1, i, "page", u, t, None, None, None, s) for i, (u, t, s) in enumerate(rows)], SOURCE)


def test_collect_replaces_only_on_a_strictly_higher_score(spark, table):
    df = sources(spark, ("b", "b1", 0.5), ("a", "a1", 0.2), ("b", "b2", 0.5), ("a", "a2", 0.9), ("", "x", 1.0))
    numbered = C.number_citations(C.collect_sources(df))
    assert table(numbered, "number", "url", "title") == [(1, "b", "b1"), (2, "a", "a2")]
    used = spark.createDataFrame([(1, "a"), (1, "zzz"), (1, "a")], "thread_id bigint, url string")
    assert table(C.used_citations(C.collect_sources(df), used), "number", "url") == [(1, "a")]


def test_many_sources_are_numbered_without_gaps(spark):
    df = sources(spark, *[(f"http://s/{i % 1000}", "t", 0.1) for i in range(3000)]).repartition(7)
    numbers = [r.number for r in C.number_citations(C.collect_sources(df)).orderBy("number").collect()]
    assert numbers == list(range(1, 1001))


def test_enrich_from_crawl(spark):
    known = C.collect_sources(sources(spark, ("a", "old", 0.5), ("b", "keep", 0.5)))
    crawls = spark.createDataFrame(
        [(1, 10, "a", "Untitled", "first"), (1, 11, "a", "New", ""), (1, 12, "b", "", None), (1, 13, "c", None, "z" * 600)],
        "thread_id bigint, seq bigint, url string, title string, content string",
    )
    got = {r.url: r for r in C.enrich_from_crawl(known, crawls).collect()}
    assert (got["a"].title, got["a"].raw_content, got["a"].content_snippet) == ("New", "first", "first")
    assert (got["b"].title, got["b"].raw_content) == ("keep", None)
    assert (got["c"].title, len(got["c"].content_snippet), got["c"].first_seen) == ("Untitled", 500, 13)


def fold(rows):
    """The merge rule on a list."""
    out = {}
    for url, title, snippet, score in rows:
        if url not in out:
            out[url] = [title, snippet, score]
        elif score > out[url][2]:
            out[url] = [title or out[url][0], snippet or out[url][1], score]
    return out


def test_merge_by_score_is_a_fold(spark):
    import random

    rng = random.Random(3)
    rows = [(rng.choice("abc"), rng.choice(["", None, f"t{i}"]), rng.choice([None, f"s{i}"]), rng.randint(0, 50) / 10) for i in range(300)]
    df = spark.createDataFrame(
        [(1, i, u, t, None, s, score) for i, (u, t, s, score) in enumerate(rows)],
        "thread_id bigint, seq bigint, url string, title string, description string, snippet string, relevance_score double",
    ).repartition(5)
    got = {r.url: [r.title, r.snippet, r.relevance_score] for r in C.merge_by_score(df).collect()}
    assert got == fold(rows)


def test_merge_collections(spark, table):
    left = spark.createDataFrame([(1, "a", "L", 0.1, 3, False)], "thread_id bigint, url string, title string, relevance_score double, first_seen bigint, used boolean")
    right = spark.createDataFrame([(1, "a", "R", 0.9, 0, True), (1, "b", "R", 0.2, 1, False)], left.schema)
    merged = C.merge_collections(left, right)
    assert table(merged, "url", "title", "used", "first_seen") == [("a", "L", True, 3), ("b", "R", False, 5)]
    assert table(C.collection_stats(merged)) == [(1, 2, 1)]


def test_extract_urls(outcomes):
    text = "[a](http://x/1) [b](ftp://n) http://x/1 http://x/2, [c](http://x/1) <http://x/3> http://x/2,"
    assert outcomes(C.url_list, [text]) == [["http://x/1", "http://x/1", "http://x/2,", "http://x/3"]]


def test_reference_section_rules(outcomes, spark, table):
    body = "intro [x](http://no)\n## References\n- [A](http://a)\n## swallowed\n[1] B - http://b\n\n## End\n[y](http://no2)\n## Sources\n\n<a href='http://c' id=1>C</a>\n[^2]: D  -  http://d\n[2] again - http://c"
    df = spark.createDataFrame([(1, body)], "report_id int, body string")
    assert table(C.parse_references(df), "number", "title", "url", "form") == [
        (1, "A", "http://a", "markdown"), (2, "B", "http://b", "numbered"), (3, "again", "http://c", "numbered"),
        (4, "D", "http://d", "footnote"),
    ]
    long = "## Sources\n" + "line\n" * 20000 + "[A](http://a)"
    assert len(outcomes(C.reference_sections, [long])[0][0]) > 100_000


@pytest.mark.parametrize("style, mark", [("numbered", "[12]"), ("footnote", "[^12]"), ("superscript", "¹²"), ("odd", "[12]")])
def test_annotate_links(spark, style, mark):
    body = "[a](u1) text [b](u2)![c](u1)\nend"
    reports = spark.createDataFrame([(1, body), (2, "")], "report_id int, body string")
    numbers = spark.createDataFrame([(1, "u1", 12)], "report_id int, url string, number int")
    got = {r.report_id: r.body for r in C.annotate_links(reports, numbers, style).collect()}
    assert got == {1: f"[a](u1){mark} text [b](u2)![c](u1){mark}\nend", 2: ""}


def test_render_references(spark):
    rows = [(1, i + 1, f"http://u{i}", f"T{i}", "d" * 210 if i == 0 else None, "u.org" if i < 2 else "", "Au" if i == 0 else None, "2024" if i == 0 else None,
             "2024-07-08T01" if i == 1 else None, 0.5 if i == 0 else 0.0, None) for i in range(3)]
    df = spark.createDataFrame(rows, """thread_id int, number int, url string, title string, description string, domain string, author string,
        published_date string, accessed_at string, relevance_score double, content_snippet string""")
    text = {s: C.render_references(df, s).first().section for s in ("simple", "rich", "markdown", "footnote", "full", "reporter")}
    assert text["simple"] == "## Key Citations\n\n- [T0](http://u0)\n\n- [T1](http://u1)\n\n- [T2](http://u2)\n"
    assert "- [T0](http://u0)\n  <!-- domain: u.org, relevance: 0.50 -->" in text["rich"]
    assert "  <!-- domain: u.org, accessed: 2024-07-08 -->\n\n- [T2](http://u2)\n" in text["rich"]
    assert "<!-- domain: u.org, score: 0.50 -->" in text["markdown"]
    assert text["footnote"] == "\n---\n\n[^1]: T0 - http://u0\n[^2]: T1 - http://u1\n[^3]: T2 - http://u2"
    assert "[1] **T0**\n   *Au*\n   Source: u.org\n   Published: 2024\n   URL: http://u0\n   > " + "d" * 200 + "..." in text["full"]
    assert "1. **T0**\n   - URL: http://u0\n   - Domain: u.org\n   - Summary: " + "d" * 150 + "...\n\n2. **T1**" in text["reporter"]
    split = C.render_references(df, "simple", part_rows=2).orderBy("part").collect()
    assert "\n".join(r.section for r in split) == text["simple"]
    citation = C.citations_json(df).orderBy("number").first()
    assert (citation["count"], json.loads(citation.citation)["title"]) == (3, "T0")


def test_collections_are_kept_and_read(spark, table):
    known = C.collect_sources(sources(spark, ("http://a", "a", 0.1), ("http://b", "é\n\"b", None), ("http://c", "c", 0.3)))
    numbers = C.number_citations(known).withColumn("domain", F.lit("d"))
    used = spark.createDataFrame([(1, "http://c"), (1, "http://a"), (1, "http://a"), (1, "http://x")], "thread_id bigint, url string")
    loaded = C.load_collection(C.store_collection(numbers, used))
    assert table(loaded, "first_seen", "url", "title", "used") == [(1, "http://a", "a", True), (2, "http://b", 'é\n"b', False), (3, "http://c", "c", True)]
    assert table(C.number_citations(loaded.where("used")), "number", "url") == [(1, "http://a"), (2, "http://c")]


def test_references_under_custom_headers(spark, table):
    body = "# R\n\n## Quellen\n\n- [A](http://a)\n\n## References\n\n- [B](http://b)\n- [A](http://a)\n\n## See also\n[1] C - http://c\n"
    df = spark.createDataFrame([(1, body)], "report_id int, body string")
    assert table(C.parse_references(df), "number", "url") == [(1, "http://b"), (2, "http://a")]
    assert table(C.parse_references(df, [r"##\s*See also", r"##\s*Quellen"]), "number", "url") == [(1, "http://c"), (2, "http://a")]


def test_harvest_of_very_large_seq(spark):
    """Times in microseconds as seq; results keep their order inside a message and across messages."""
    answer = '[{"url": "http://b", "title": "B"}, {"url": "http://a", "title": "A"}]'
    df = spark.createDataFrame([(1, (1 << 62) + 1, "web_search", answer.replace("a", "c")), (1, 1 << 62, "web_search", answer)], "thread_id bigint, seq bigint, name string, content string")
    got = C.number_citations(C.harvest_citations(df)).orderBy("number").collect()
    assert [r.url for r in got][:2] == ["http://b", "http://a"] and [r.number for r in got] == list(range(1, len(got) + 1))


def test_resolve_and_credibility(spark, table):
    links = spark.createDataFrame([(1, 0, "[1]", "http://a/%20x"), (1, 1, "Title", "http://b"), (1, 2, " ^3^ ", "http://none")],
                                  "report_id int, pos int, text string, url string")
    cites = spark.createDataFrame([(1, "http://a/ x", 1), (1, "http://b", 2), (1, "http://b ", 3)], "report_id int, url string, number int")
    assert table(C.resolve_links(links, cites), "pos", "number", "inline") == [(0, 1, True), (1, 2, False), (2, None, True)]
    found = spark.createDataFrame([(1, "http://b"), (1, "http://c/é (x)")], "thread_id int, url string")
    hrefs = spark.createDataFrame([(1, "http://b"), (1, "http://c/%C3%A9%20(x)"), (1, "http://d")], "thread_id int, url string")
    assert table(C.link_credibility(hrefs, found), "url", "credible") == [("http://b", True), ("http://c/%C3%A9%20(x)", True), ("http://d", False)]


def test_citation_usage(spark, table):
    known = C.collect_sources(sources(spark, ("http://a", "a", 0.1), ("http://b", "b", 0.1), ("http://c", "c", 0.1)))
    reports = spark.createDataFrame([(1, "[x](http://c) http://a http://new")], "thread_id bigint, body string")
    assert table(C.citation_usage(known, reports), "url", "status", "used_number") == [
        ("http://a", "used", 1), ("http://b", "unused", None), ("http://c", "used", 2), ("http://new", "uncollected", None),
    ]
