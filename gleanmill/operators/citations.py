"""Citations: collecting sources per thread, numbering them, and reading or writing reference lists.

Tables: ``sources(thread_id, seq, url, title, description, content_snippet, raw_content, relevance_score)``
with ``seq`` unique inside its thread, and reports ``(report_id, body)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanmill.functions import constants as K
from gleanmill.functions import json_text as jt
from gleanmill.functions import text as tx
from gleanmill.operators.ordering import joined_text, numbered, prior_max

KEY = ["thread_id", "url"]
FIELDS = ["title", "description", "content_snippet", "raw_content"]
ITEM = "array<struct<type: string, url: string, title: string, content: string, score: double>>"
# Positions inside one message; an array's index is below this, so messages keep their order.
WIDTH = 1 << 31


def _place(seq: Column, position: Column) -> Column:
    """A message's seq and a position inside it as one number; decimal, as seq may be as large as a time in microseconds."""
    return (seq.cast("decimal(20,0)") * F.lit(WIDTH) + position).cast("decimal(38,0)")


def _http(url: Column) -> Column:
    return url.startswith("http://") | url.startswith("https://")


def harvest_citations(messages: DataFrame) -> DataFrame:
    """Sources named in tool messages ``(thread_id, seq, name, content)``, first per thread and URL.

    Search tools give lists of results, crawl tools single pages; other tools are judged by the shape of
    their answer.
    """
    tool, content = F.lower(F.coalesce("name", F.lit(""))), tx.strip(F.col("content"))
    value, kind = F.col("_value"), F.substring("content", 1, 1)
    shaped = (
        messages.select("thread_id", "seq", tool.alias("tool"), content.alias("content"))
        .filter(jt.looks_structured(F.col("content")))
        .withColumn("_value", F.when(jt.is_json(F.col("content")), F.try_parse_json("content")))
    )
    tool = F.col("tool")
    has = {n: F.try_variant_get(value, f"$.{n}", "variant").isNotNull() for n in ("url", "content", "crawled_content", "error")}
    listed = F.try_variant_get(value, "$[0].url", "variant").isNotNull()
    searching = tool.isin(K.SEARCH_TOOLS)
    crawling = tool.isin(K.CRAWL_TOOLS)
    as_list = searching | (~crawling & (kind == "[") & listed)
    as_page = (kind == "{") & (crawling | (~searching & has["url"] & (has["content"] | has["crawled_content"])))

    array_text = F.when((kind == "[") & value.isNotNull(), F.col("content")).when(
        ~has["error"], F.to_json(F.try_variant_get(value, "$.results", "variant"))
    )
    items = shaped.filter(as_list).select(
        "thread_id", "seq", F.posexplode(F.from_json(array_text, ITEM)).alias("pos", "x")
    )
    found = items.filter(F.coalesce(F.col("x.type"), F.lit("")) != "image_url").select(
        "thread_id",
        _place(F.col("seq"), F.col("pos")).alias("seq"),
        F.col("x.url").alias("url"),
        F.coalesce("x.title", F.lit("Untitled")).alias("title"),
        F.coalesce("x.content", F.lit("")).alias("description"),
        F.substring(F.coalesce("x.content", F.lit("")), 1, 500).alias("content_snippet"),
        F.lit(None).cast("string").alias("raw_content"),
        F.coalesce("x.score", F.lit(0.0)).alias("relevance_score"),
        F.lit("web_search").alias("source_type"),
    )
    pages = shaped.filter(as_page).select(
        "thread_id",
        _place(F.col("seq"), F.lit(0)).alias("seq"),
        F.try_variant_get(value, "$.url", "string").alias("url"),
        F.coalesce(F.try_variant_get(value, "$.crawled_content", "string"), F.lit("")).alias("text"),
    )
    crawled = pages.select(
        "thread_id", "seq", "url",
        tx.smart_title(F.col("text")).alias("title"),
        F.substring("text", 1, 300).alias("description"),
        F.substring("text", 1, 500).alias("content_snippet"),
        F.col("text").alias("raw_content"),
        F.lit(None).cast("double").alias("relevance_score"),
        F.lit("crawl").alias("source_type"),
    )
    named = found.unionByName(crawled).filter(F.coalesce("url", F.lit("")) != "")
    rest = [c for c in named.columns if c not in (*KEY, "seq")]
    firsts = named.groupBy(*KEY).agg(F.min("seq").alias("first_seen"), *[F.min_by(c, "seq").alias(c) for c in rest])
    return firsts.withColumn("domain", tx.url_domain(F.col("url")))


def collect_sources(results: DataFrame) -> DataFrame:
    """One row per thread and URL: position of the first sighting, data of the best-scored one.

    Only a strictly higher score replaces what is there, so the earliest of equals wins.
    """
    score = F.coalesce("relevance_score", F.lit(0.0))
    usable = results.filter((F.coalesce("type", F.lit("")) != "image_url") & (F.coalesce("url", F.lit("")) != ""))
    best = F.struct(score, -F.col("seq"))
    return usable.groupBy(*KEY).agg(
        F.min("seq").alias("first_seen"),
        *[F.max_by(c, best).alias(c) for c in FIELDS],
        F.max(score).alias("relevance_score"),
    )


def as_sources(results: DataFrame) -> DataFrame:
    """Search-result rows to source rows."""
    return results.select(
        F.col("query_id").alias("thread_id"), "seq", "type", "url",
        F.coalesce("title", F.lit("Untitled")).alias("title"),
        F.coalesce("content", F.lit("")).alias("description"),
        F.substring(tx.filled(F.col("content")), 1, 500).alias("content_snippet"),
        "raw_content",
        F.coalesce("score", F.lit(0.0)).alias("relevance_score"),
    )


def enrich_from_crawl(sources: DataFrame, crawls: DataFrame) -> DataFrame:
    """Update collected sources from crawled pages ``(thread_id, seq, url, title, content)``, in seq order.

    The last real title and the last content win; a snippet is only filled where there is none, from the
    first content. Unknown URLs become new sources, seen at their first crawl.
    """
    named = (F.coalesce("title", F.lit("")) != "") & (F.col("title") != "Untitled")
    filled = F.coalesce("content", F.lit("")) != ""
    pages = crawls.groupBy(*KEY).agg(
        F.min("seq").alias("_seen"),
        F.max_by("title", F.when(named, F.col("seq"))).alias("_title"),
        F.max_by("content", F.when(filled, F.col("seq"))).alias("_content"),
        F.min_by("content", F.when(filled, F.col("seq"))).alias("_earliest"),
    )
    return sources.join(pages, KEY, "full_outer").select(
        *KEY,
        F.coalesce("first_seen", "_seen").alias("first_seen"),
        F.coalesce("_title", "title", F.lit("Untitled")).alias("title"),
        "description",
        F.coalesce(tx.filled(F.col("content_snippet")), F.substring("_earliest", 1, 500)).alias("content_snippet"),
        F.coalesce("_content", "raw_content").alias("raw_content"),
        F.coalesce("relevance_score", F.lit(0.0)).alias("relevance_score"),
    )


def number_citations(sources: DataFrame) -> DataFrame:
    """Add ``number``: 1, 2, … per thread in order of first sighting."""
    return numbered(sources, ["thread_id"], "first_seen", "number")


def used_citations(sources: DataFrame, used: DataFrame) -> DataFrame:
    """Only the sources whose URL is marked used, numbered anew; unknown URLs count for nothing."""
    return number_citations(sources.join(used.select(*KEY).distinct(), KEY, "left_semi"))


def merge_collections(left: DataFrame, right: DataFrame) -> DataFrame:
    """Union of two collections: left data wins, right-only URLs follow, used flags are OR-ed."""
    offset = left.groupBy("thread_id").agg((F.max("first_seen") + 1).alias("_offset"))
    flags = right.select(*KEY, F.col("used").alias("_used"))
    kept = left.join(flags, KEY, "left").withColumn("used", F.col("used") | F.coalesce("_used", F.lit(False))).drop("_used")
    added = (
        right.join(left.select(*KEY), KEY, "left_anti")
        .join(offset, "thread_id", "left")
        .withColumn("first_seen", F.col("first_seen") + F.coalesce("_offset", F.lit(0)))
        .drop("_offset")
    )
    return kept.unionByName(added)


def merge_by_score(citations: DataFrame) -> DataFrame:
    """Fold citations ``(thread_id, seq, url, title, description, snippet, relevance_score, …)`` in order.

    The first row of a URL is the base; each row with a strictly higher score than all before it sets the
    score, and sets title, description and snippet where it has them. Everything else stays the base's.
    """
    score = F.coalesce("relevance_score", F.lit(0.0))
    usable = citations.filter(F.coalesce("url", F.lit("")) != "")
    records = prior_max(usable, KEY, "seq", score, "_best").filter(F.col("_best").isNull() | (score > F.col("_best")))
    updated = ["title", "description", "snippet"]
    rest = [c for c in citations.columns if c not in (*KEY, "seq", "relevance_score", *updated)]
    base = F.col("_best").isNull()

    def latest(name: str) -> Column:
        return F.max_by(name, F.when(base | (F.coalesce(name, F.lit("")) != ""), F.col("seq"))).alias(name)

    return records.groupBy(*KEY).agg(
        F.min("seq").alias("first_seen"),
        F.max(score).alias("relevance_score"),
        *[latest(c) for c in updated],
        *[F.min_by(c, "seq").alias(c) for c in rest],
    )


def url_list(text: Column) -> Column:
    """http(s) targets of markdown links, with repeats, then bare URLs not seen before."""
    links = F.filter(F.regexp_extract_all(text, F.lit(K.MARKDOWN_LINK), F.lit(2)), _http)
    bare = F.regexp_extract_all(text, F.lit(K.BARE_URL), F.lit(1))
    return tx.once(links, lambda found: F.concat(found, F.array_except(bare, found)))


def extract_urls(reports: DataFrame) -> DataFrame:
    """``report_id, pos, url`` of every URL in each report."""
    return reports.select("report_id", F.posexplode(url_list(F.col("body"))).alias("pos", "url"))


def reference_sections(body: Column, headers: Sequence[str] = (K.REFERENCE_HEADERS,)) -> Column:
    """Texts of the reference sections; a section ends at an empty line followed by ``##``.

    ``headers`` are patterns without groups; the sections of the first one come first.
    """
    found = [F.regexp_extract_all(body, F.lit(f"(?is)(?:{h})" + r"\s*\n(.*?)(?=\n\n##|\z)"), F.lit(1)) for h in headers]
    return F.concat(*found)


def _pairs(section: Column, pattern: str, title: int, url: int, form: str) -> Column:
    """Array of (title, url, form) for all matches of one reference format."""

    def parts(found: Column) -> Column:
        text = tx.strip(F.regexp_extract(found, pattern, title))
        return F.struct(text.alias("title"), F.regexp_extract(found, pattern, url).alias("url"), F.lit(form).alias("form"))

    # The text is searched once; the parts are taken out of the matches, which match on their own as they did in the text.
    return F.transform(F.regexp_extract_all(section, F.lit(pattern), F.lit(0)), parts)


def _first_per_url(found: Column) -> Column:
    """The first entry of each URL, in order. Sorting by (url, place) puts repeats side by side."""
    placed = F.transform(
        found,
        lambda r, i: F.struct(tx.strip(r["url"]).alias("url"), i.alias("place"), r["title"].alias("title"), r["form"].alias("form")),
    )
    by_url = F.array_sort(F.filter(placed, lambda r: r["url"] != ""))
    before = F.concat(F.array(F.lit("")), F.transform(by_url, lambda r: r["url"]))
    firsts = F.filter(F.zip_with(by_url, before, lambda r, b: F.when(r["url"] != b, r)), lambda r: r.isNotNull())
    return F.array_sort(
        F.transform(firsts, lambda r: F.struct(r["place"].alias("place"), r["title"].alias("title"), r["url"].alias("url"), r["form"].alias("form")))
    )


def parse_references(reports: DataFrame, headers: Sequence[str] = (K.REFERENCE_HEADERS,)) -> DataFrame:
    """References of each report, first per URL in the order of the formats, numbered from 1.

    They stand in sections under one of the ``headers`` (patterns without groups).

    All of a report's references come from its one text, so they are deduplicated and numbered inside the
    row; nothing is shuffled.
    """

    def on_web(pairs: Column) -> Column:
        return F.filter(pairs, lambda p: _http(p["url"]))

    def listed(text: Column) -> Column:
        return F.concat(
            on_web(_pairs(text, K.MARKDOWN_LINK, 1, 2, "markdown")),
            _pairs(text, K.NUMBERED_REFERENCE, 1, 2, "numbered"),
            _pairs(text, K.FOOTNOTE_REFERENCE, 2, 3, "footnote"),
            on_web(_pairs(text, "(?i)" + K.HTML_REFERENCE, 3, 2, "html")),
        )

    # A filter on the number of sections would search the bodies a second time; a report without any gives no rows below.
    sections = reports.select("report_id", reference_sections(F.col("body"), headers).alias("_sections"))
    found = sections.select("report_id", F.flatten(F.transform("_sections", listed)).alias("_found"))
    firsts = found.select("report_id", F.posexplode(_first_per_url(F.col("_found"))).alias("pos", "r"))
    return firsts.select("report_id", (F.col("pos") + 1).alias("number"), "r.title", "r.url", "r.form")


SUPERSCRIPTS = ("0123456789", "⁰¹²³⁴⁵⁶⁷⁸⁹")


def inline_marker(number: Column, style: str = "numbered") -> Column:
    """``[n]``, ``[^n]`` or superscript digits; an unknown style is numbered."""
    digits = number.cast("string")
    if style == "superscript":
        return F.translate(digits, *SUPERSCRIPTS)
    return F.concat(F.lit("[^" if style == "footnote" else "["), digits, F.lit("]"))


def annotate_links(reports: DataFrame, numbers: DataFrame, style: str = "numbered") -> DataFrame:
    """Put the citation marker behind each markdown link whose URL has a number.

    ``numbers(report_id, url, number)``. Only the distinct link targets are joined with the numbers; what
    comes back to a report is a map no larger than its own links, and the text moves once.
    """
    body = F.col("body")
    targets = reports.select("report_id", F.explode(F.array_distinct(F.regexp_extract_all(body, F.lit(K.MARKDOWN_LINK), F.lit(2)))).alias("url"))
    # A URL with several numbers in a report is marked with the lowest.
    lowest = numbers.groupBy("report_id", "url").agg(F.min("number").alias("number"))
    known = targets.join(lowest, ["report_id", "url"])
    markers = known.groupBy("report_id").agg(
        F.map_from_entries(F.collect_list(F.struct("url", inline_marker(F.col("number"), style)))).alias("_markers")
    )
    pieces = F.split(F.regexp_replace(body, K.MARKDOWN_LINK, "$0\u0000"), "\u0000")

    def marked(piece: Column) -> Column:
        marker = F.try_element_at(F.col("_markers"), F.regexp_extract(piece, K.MARKDOWN_LINK + r"\z", 2))
        return F.concat(piece, F.coalesce(marker, F.lit("")))

    text = F.when(F.col("_markers").isNull(), body).otherwise(F.array_join(F.transform(pieces, marked), ""))
    return reports.join(markers, "report_id", "left").withColumn("body", text).drop("_markers")


def reference_line(style: str) -> Column:
    """One entry of a reference list, from the columns of a numbered citation.

    Styles: simple, numbered, footnote, full, rich, markdown (rich with a score) and reporter.
    """
    title, url, number = F.col("title"), F.col("url"), F.col("number")
    domain = tx.filled(F.col("domain"))
    link = F.concat(F.lit("- ["), title, F.lit("]("), url, F.lit(")"))

    def labelled(label: str, value: Column, end: str = "") -> Column:
        return F.concat(F.lit(label), value, F.lit(end))

    def noted(notes: list[Column]) -> Column:
        joined = tx.filled(F.concat_ws(", ", *notes))
        return F.concat(link, F.coalesce(labelled("\n  <!-- ", joined, " -->"), F.lit("")))

    score = F.when(F.col("relevance_score") > 0, F.format_string("%.2f", "relevance_score"))
    about = tx.filled(F.col("description"))
    if style == "numbered":
        return F.concat(inline_marker(number), F.lit(" "), title, F.lit(" - "), url)
    if style == "footnote":
        return F.concat(F.lit("[^"), number, F.lit("]: "), title, F.lit(" - "), url)
    if style == "full":
        return F.concat_ws(
            "\n",
            F.concat(inline_marker(number), F.lit(" **"), title, F.lit("**")),
            labelled("   *", tx.filled(F.col("author")), "*"),
            labelled("   Source: ", domain),
            labelled("   Published: ", tx.filled(F.col("published_date"))),
            labelled("   URL: ", url),
            labelled("   > ", tx.clip(about, 200, "...")),
        )
    if style == "rich":
        day = tx.filled(F.substring(F.col("accessed_at").cast("string"), 1, 10))
        return noted([labelled("domain: ", domain), labelled("relevance: ", score), labelled("accessed: ", day)])
    if style == "markdown":
        return noted([labelled("domain: ", domain), labelled("score: ", score)])
    if style == "reporter":
        summary = F.coalesce(labelled("   - Summary: ", F.substring(about, 1, 150), "...\n"), F.lit(""))
        return F.concat(
            number, F.lit(". **"), title, F.lit("**\n   - URL: "), url, F.lit("\n   - Domain: "),
            F.coalesce("domain", F.lit("")), F.lit("\n"), summary,
        )
    return link


SECTION_HEAD = {
    "footnote": "\n---\n",
    "reporter": "\n\n## Available Source References (use these in References section):\n",
}
SECTION_TAIL = {"footnote": "", "reporter": "\n"}
BETWEEN = {"footnote": "\n", "reporter": "\n"}


def render_references(citations: DataFrame, style: str = "rich", part_rows: int = 10_000) -> DataFrame:
    """The reference section of each thread as text.

    The section comes in parts of consecutive numbers; part 0 opens it. Parts joined by the separator of the
    style (a line break) are the whole text, so that no value has to hold a section of unbounded size.
    """
    parted = citations.withColumn("part", F.floor((F.col("number") - 1) / F.lit(part_rows)))
    between = BETWEEN.get(style, "\n\n")
    texts = joined_text(parted, ["thread_id", "part"], "number", {"section": reference_line(style)}, between)
    head = F.when(F.col("part") == 0, F.lit(SECTION_HEAD.get(style, "## Key Citations\n") + "\n")).otherwise(F.lit(""))
    return texts.withColumn("section", F.concat(head, "section", F.lit(SECTION_TAIL.get(style, "\n"))))


def citations_json(citations: DataFrame) -> DataFrame:
    """Each numbered citation as a JSON object text, with the thread's count beside it."""
    counts = citations.groupBy("thread_id").agg(F.count(F.lit(1)).alias("count"))
    fields = ["url", "title", "description", "content_snippet", "domain", "relevance_score"]
    body = F.struct(tx.citation_id(F.col("url")).alias("id"), *fields)
    objects = citations.select("thread_id", "number", F.to_json(body, {"ignoreNullFields": "false"}).alias("citation"))
    return objects.join(counts, "thread_id")


STORED = "struct<id: string, url: string, title: string, description: string, content_snippet: string, domain: string, relevance_score: double>"


def store_collection(citations: DataFrame, used: DataFrame) -> DataFrame:
    """Numbered citations as rows to keep: ``thread_id, number, citation, used``; the citation is a JSON object."""
    marks = used.select(*KEY).distinct().withColumn("used", F.lit(True))
    objects = citations_json(citations).withColumn("url", F.get_json_object("citation", "$.url"))
    return objects.join(marks, KEY, "left").select("thread_id", "number", "citation", F.coalesce("used", F.lit(False)).alias("used"))


def load_collection(rows: DataFrame) -> DataFrame:
    """Sources out of kept rows, in their order: ``first_seen`` is the number they had. Rows without a URL are dropped."""
    read = rows.select("thread_id", F.col("number").alias("first_seen"), F.from_json("citation", STORED).alias("c"), "used")
    return read.select("thread_id", "first_seen", "c.url", "c.title", "c.description", "c.content_snippet", "c.domain", "c.relevance_score", "used").filter(
        F.coalesce("url", F.lit("")) != "")


def is_inline_marker(text: Column) -> Column:
    return text.rlike(K.INLINE_MARKER)


# What a browser leaves as it is when it encodes a whole URL, by the code url_encode gives it.
KEPT_IN_URLS = {
    "%3B": ";", "%2F": "/", "%3F": "?", "%3A": ":", "%40": "@", "%26": "&", "%3D": "=", "%2B": "+", "%24": "$",
    "%2C": ",", "%23": "#", "%21": "!", "%7E": "~", "%27": "'", "%28": "(", "%29": ")",
}


def encoded_url(url: Column) -> Column:
    """URL with everything percent-encoded but the characters that have a meaning in URLs."""
    coded = F.replace(F.url_encode(url), F.lit("+"), F.lit("%20"))
    for code, char in KEPT_IN_URLS.items():
        coded = F.replace(coded, F.lit(code), F.lit(char))
    return coded


def resolve_links(links: DataFrame, citations: DataFrame) -> DataFrame:
    """Citation of each link: by exact URL, else by the decoded, trimmed URL; lowest number first.

    ``links(report_id, pos, text, url)``, ``citations(report_id, url, number)``. Adds ``number`` (null if the
    link is no citation) and ``inline`` (a marker such as ``[1]`` rather than a reference entry).
    """
    # The lowest of the lowest: the citations, which may be costly to make, are read once. Both sides keep the same rows, as
    # no key is null and the looser join asks for no more, so that they share the shuffle named here.
    kept = citations.filter("report_id is not null and url is not null")
    exact = kept.groupBy("report_id", "url").agg(F.min("number").alias("_exact")).repartition("report_id", "url")
    loose = (
        exact.withColumn("_found", tx.url_match_key(F.col("url")))
        .groupBy(F.col("report_id").alias("_report"), "_found")
        .agg(F.min("_exact").alias("_loose"))
    )
    keyed = links.withColumn("_key", tx.url_match_key(F.col("url"))).join(exact, ["report_id", "url"], "left")
    return (
        keyed.join(loose, (F.col("report_id") == F.col("_report")) & F.col("_key").eqNullSafe(F.col("_found")), "left")
        .withColumn("number", F.coalesce("_exact", "_loose"))
        .withColumn("inline", is_inline_marker(F.col("text")))
        .drop("_key", "_exact", "_loose", "_report", "_found")
    )


def markdown_links(reports: DataFrame) -> DataFrame:
    """``report_id, pos, text, url`` of the markdown links of each report."""

    def parts(link: Column) -> Column:
        return F.struct(*[F.regexp_extract(link, K.MARKDOWN_LINK, i).alias(n) for i, n in ((1, "text"), (2, "url"))])

    links = F.regexp_extract_all("body", F.lit(K.MARKDOWN_LINK), F.lit(0))
    return reports.select("report_id", F.posexplode(F.transform(links, parts)).alias("pos", "l")).select("report_id", "pos", "l.*")


def link_credibility(links: DataFrame, results: DataFrame) -> DataFrame:
    """Add ``credible``: the link's URL, raw or encoded, is among the thread's search results.

    ``links(thread_id, …, url)``, ``results(thread_id, url)``.
    """
    known = results.filter(F.col("url").isNotNull()).select("thread_id", "url")
    known = known.union(known.select("thread_id", encoded_url(F.col("url")))).distinct()
    return (
        links.join(known.withColumn("_known", F.lit(True)), KEY, "left")
        .withColumn("credible", F.coalesce("_known", F.lit(False)))
        .drop("_known")
    )


def citation_usage(sources: DataFrame, reports: DataFrame) -> DataFrame:
    """Per thread and URL: ``used`` in the report, ``unused``, or in the report but ``uncollected``.

    Used sources keep their number among the used ones as ``used_number``. The reports are read once: whether a thread is
    hot is asked of the sources, and rows that get no number are ranked each on its own.
    """
    cited = (
        reports.select("thread_id", F.explode(url_list(F.col("body"))).alias("url")).distinct().withColumn("_cited", F.lit(1))
    )
    joined = sources.select(*KEY, "first_seen").join(cited, KEY, "full_outer")
    status = F.when(F.col("_cited").isNull(), "unused").when(F.col("first_seen").isNull(), "uncollected").otherwise("used")
    used = F.col("status") == "used"
    labelled = joined.select(*KEY, "first_seen", status.alias("status")).withColumn("_apart", F.when(used, "").otherwise(F.concat(F.lit(":"), "url")))
    collected = sources.select("thread_id", "first_seen", F.lit("").alias("_apart"))
    ranked = numbered(labelled, ["thread_id", "_apart"], "first_seen", "used_number", among=collected)
    return ranked.withColumn("used_number", F.when(used, F.col("used_number").cast("bigint"))).drop("_apart")


def collection_stats(sources: DataFrame) -> DataFrame:
    """Sources and used sources per thread, from rows with a ``used`` flag."""
    return sources.groupBy("thread_id").agg(
        F.count(F.lit(1)).alias("sources"), F.count_if(F.col("used")).alias("used_sources")
    )
