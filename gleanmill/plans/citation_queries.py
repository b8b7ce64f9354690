"""Citation queries and their SQL twins. A search query's results double as one thread's sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanmill.functions import constants as K
from gleanmill.operators import citations as C
from gleanmill.plans.registry import Query
from gleanmill.plans.views import SQL_PAGE_COUNT, ctes, page_count, view
from gleanmill.session import scratch_folder

LINK = r"\[([^\]]+)\]\(([^)]+)\)"


def _results(spark, sf):
    return C.as_sources(view(spark, sf, "v_search_results"))


def _sources(spark, sf):
    return C.collect_sources(_results(spark, sf))


BASE = ctes("v_search_results") + """,
sources as (select query_id as thread_id, seq, type, url, coalesce(title, 'Untitled') as title, coalesce(content, '') as description,
    substring(nullif(content, ''), 1, 500) as content_snippet, raw_content, coalesce(score, 0) as relevance_score
  from v_search_results),
usable as (select * from sources where type <> 'image_url' and coalesce(url, '') <> ''),
collected as (select thread_id, url, title, description, content_snippet, raw_content, relevance_score,
    min(seq) over (partition by thread_id, url) as first_seen from usable
  qualify row_number() over (partition by thread_id, url order by relevance_score desc, seq) = 1),
numbered as (select *, row_number() over (partition by thread_id order by first_seen) as number from collected)
"""

# C1: tool messages made of the pages.
MESSAGES = """select cast(floor(page_id / 10) as bigint) as thread_id, page_id as seq,
  case page_id % 6 when 0 then 'web_search' when 1 then 'Tavily_Search' when 2 then 'crawl_tool' when 3 then 'lookup'
    when 4 then 'fetch' else 'web_search' end as name,
  case page_id % 6
    when 0 then to_json(array(named_struct('type', 'page', 'url', url, 'title', title, 'content', plain, 'score', 0.5D),
      named_struct('type', 'image_url', 'url', url || '/i', 'title', 'i', 'content', '', 'score', 0.0D),
      named_struct('type', 'page', 'url', url, 'title', 'again', 'content', '', 'score', 0.9D)))
    when 1 then to_json(named_struct('results', array(named_struct('url', url, 'content', plain))))
    when 2 then to_json(named_struct('url', url, 'crawled_content', '# ' || title || chr(10) || plain))
    when 3 then to_json(array(named_struct('url', url, 'title', title, 'content', plain, 'score', 0.25D)))
    when 4 then to_json(named_struct('url', url, 'content', plain))
    else to_json(named_struct('error', 'no luck', 'results', array(named_struct('url', url)))) end as content
from {v_pages}"""


def _harvest(spark, sf):
    messages = spark.sql(MESSAGES, v_pages=view(spark, sf, "v_pages"))
    return C.harvest_citations(messages).select(
        "thread_id", "url", "title", "description", "content_snippet", "raw_content", "relevance_score", "source_type", "domain"
    )


# C3: crawls of half of the sources' pages, and of some pages nobody found.
CRAWLS = """select cast(floor(page_id / 10) as bigint) as thread_id, 1000000 + page_id as seq,
  case when page_id % 4 = 3 then url || '/new' else url end as url,
  case page_id % 3 when 0 then 'Untitled' when 1 then '' else 'Crawled ' || title end as title,
  case when page_id % 5 = 0 then '' else plain end as content from {v_pages}
union all select cast(floor(page_id / 10) as bigint), 2000000 + page_id, url,
  'Later ' || title, 'later text' from {v_pages} where page_id % 2 = 0"""


def _enriched(spark, sf):
    crawls = spark.sql(CRAWLS, v_pages=view(spark, sf, "v_pages"))
    return C.enrich_from_crawl(_sources(spark, sf), crawls)


USED = "select query_id as thread_id, case when seq % 2 = 0 then url else url || '/unknown' end as url from {v_search_results} where url is not null"


def _used(spark, sf):
    used = spark.sql(USED, v_search_results=view(spark, sf, "v_search_results"))
    return C.used_citations(_sources(spark, sf), used).select("thread_id", "url", "number")


def _two_collections(spark, sf):
    results = _results(spark, sf)
    copy = F.col("title").endswith("(copy)")
    left = C.collect_sources(results.filter(~copy)).withColumn("used", F.length("url") % 2 == 0)
    shifted = results.filter(copy).withColumn(
        "url", F.when(F.col("seq") % 2 == 0, F.concat("url", F.lit("/r"))).otherwise(F.col("url"))
    )
    right = C.collect_sources(shifted).withColumn("used", F.length("url") % 3 == 0)
    return C.merge_collections(left, right)


MERGED_SQL = BASE + """,
left_side as (select thread_id, url, title, relevance_score, seq as first_seen, length(url) % 2 = 0 as used from usable
              where not ends_with(title, '(copy)')),
right_side as (select thread_id, case when seq % 2 = 0 then url || '/r' else url end as url, title, relevance_score,
                 seq as first_seen from usable where ends_with(title, '(copy)')),
tail as (select thread_id, max(first_seen) + 1 as o from left_side group by 1),
merged as (select l.thread_id, l.url, l.title, l.relevance_score, l.first_seen,
             l.used or coalesce(length(r.url) % 3 = 0, false) as used
           from left_side l left join right_side r using (thread_id, url)
           union all
           select r.thread_id, r.url, r.title, r.relevance_score, r.first_seen + coalesce(t.o, 0), length(r.url) % 3 = 0
           from right_side r left join tail t using (thread_id)
           where not exists (select 1 from left_side l where l.thread_id = r.thread_id and l.url = r.url))
"""


def _scored(spark, sf):
    rows = view(spark, sf, "v_search_results").filter("type = 'page'").select(
        F.col("query_id").alias("thread_id"), "seq", "url",
        F.when(F.col("seq") % 5 == 0, F.lit("")).otherwise(F.col("title")).alias("title"),
        F.when(F.col("seq") % 7 == 0, None).otherwise(F.col("content")).alias("description"),
        F.when(F.col("seq") % 3 == 0, F.col("title")).alias("snippet"),
        "raw_content", F.col("score").alias("relevance_score"),
    )
    return C.merge_by_score(rows).select(
        "thread_id", "url", "title", "description", "snippet", F.length("raw_content").cast("bigint").alias("raw_size"),
        "relevance_score", "first_seen",
    )


MERGE_SCORE_SQL = ctes("v_search_results") + """,
rows as (select query_id as thread_id, seq, url, case when seq % 5 = 0 then '' else title end as title,
    case when seq % 7 = 0 then null else content end as description, case when seq % 3 = 0 then title end as snippet,
    raw_content, coalesce(score, 0) as s from v_search_results where type = 'page'),
best as (select *, max(s) over (partition by thread_id, url order by seq rows between unbounded preceding and 1 preceding) as b
         from rows),
records as (select * from best where b is null or s > b)
select thread_id, url, arg_max(title, seq) filter (where b is null or coalesce(title, '') <> '') as title,
  arg_max_null(description, seq) filter (where b is null or coalesce(description, '') <> '') as description,
  arg_max_null(snippet, seq) filter (where b is null or coalesce(snippet, '') <> '') as snippet,
  length(arg_min_null(raw_content, seq)) as raw_size, max(s) as relevance_score, min(seq) as first_seen
from records group by 1, 2"""

URLS_SQL = ctes("v_reports") + f""",
links as (select report_id, list_filter(regexp_extract_all(body, '{LINK}', 2),
    lambda u: starts_with(u, 'http://') or starts_with(u, 'https://')) as l,
    regexp_extract_all(body, '(?:^|[^(\\[])(https?://[^\\s)>\\]]+)', 1) as b from v_reports),
bare as (select report_id, len(l) as n, l, unnest(b) as url, generate_subscripts(b, 1) as i from links),
firsts as (select report_id, any_value(n) as n, url, min(i) as i from bare where not list_contains(l, url) group by report_id, url),
urls as (select report_id, generate_subscripts(l, 1) - 1 as pos, unnest(l) as url from links union all
  select report_id, n + row_number() over (partition by report_id order by i) - 1, url from firsts)
"""

REFERENCES_SQL = f""",
sections as (select report_id, split_part(split_part(body, '## Key Citations' || chr(10), 2), chr(10) || chr(10) || '##', 1) as s
             from v_reports),
refs as (
  select report_id, 1 as f, generate_subscripts(a, 1) as i, unnest(a) as title, unnest(b) as url, 'markdown' as form from
    (select report_id, regexp_extract_all(s, '{LINK}', 1) as a, regexp_extract_all(s, '{LINK}', 2) as b from sections)
  union all select report_id, 2, generate_subscripts(a, 1), unnest(a), unnest(b), 'numbered' from
    (select report_id, regexp_extract_all(s, '\\[\\d+\\]\\s+([^-\\n]+?)\\s*-\\s*(https?://[^\\s\\n]+)', 1) as a,
       regexp_extract_all(s, '\\[\\d+\\]\\s+([^-\\n]+?)\\s*-\\s*(https?://[^\\s\\n]+)', 2) as b from sections)
  union all select report_id, 3, generate_subscripts(a, 1), unnest(a), unnest(b), 'footnote' from
    (select report_id, regexp_extract_all(s, '\\[\\^\\d+\\]:\\s+([^-\\n]+?)\\s*-\\s*(https?://[^\\s\\n]+)', 1) as a,
       regexp_extract_all(s, '\\[\\^\\d+\\]:\\s+([^-\\n]+?)\\s*-\\s*(https?://[^\\s\\n]+)', 2) as b from sections)
  union all select report_id, 4, generate_subscripts(a, 1), unnest(a), unnest(b), 'html' from
    (select report_id, regexp_extract_all(s, '<a\\s[^>]*href="([^"]+)"[^>]*>([^<]+)</a>', 2) as a,
       regexp_extract_all(s, '<a\\s[^>]*href="([^"]+)"[^>]*>([^<]+)</a>', 1) as b from sections)),
firsts as (select * from refs where starts_with(url, 'http')
  qualify row_number() over (partition by report_id, url order by f, i) = 1),
referenced as (select report_id, row_number() over (partition by report_id order by f, i) as number, trim(title) as title, url, form
  from firsts)
"""


def _references(spark, sf):
    parsed = C.parse_references(view(spark, sf, "v_reports"))
    return parsed.withColumn("number", F.col("number").cast("bigint"))


def _annotated(spark, sf):
    reports = view(spark, sf, "v_reports")
    return C.annotate_links(reports, C.parse_references(reports), "footnote").select("report_id", "body")


def _citations(spark, sf):
    """Numbered citations with all the fields a reference list can show."""
    n = F.col("number")
    return C.number_citations(_sources(spark, sf)).select(
        "thread_id", n, "url", "title", "description", "content_snippet",
        F.regexp_extract("url", "//([^/?#]*)", 1).alias("domain"),
        F.when(n % 2 == 0, F.concat(F.lit("Author "), n)).alias("author"),
        F.when(n % 3 == 0, F.lit("2024-05-06")).alias("published_date"),
        F.when(n % 2 == 1, F.lit("2024-07-08T09:10:11")).alias("accessed_at"),
        "relevance_score",
    )


CITED = """,
cited as (select thread_id, number, cast(floor((number - 1) / 4) as bigint) as part, url, title, description, content_snippet,
    regexp_extract(url, '//([^/?#]*)', 1) as domain,
    case when number % 2 = 0 then 'Author ' || number end as author, case when number % 3 = 0 then '2024-05-06' end as published,
    case when number % 2 = 1 then '2024-07-08' end as accessed, relevance_score from numbered)
"""
SIMPLE = "'- [' || title || '](' || url || ')'"
SCORE = "case when relevance_score > 0 then '{}: ' || printf('%.2f', relevance_score) end"
LINES = {
    "simple": SIMPLE,
    "numbered": "'[' || number || '] ' || title || ' - ' || url",
    "footnote": "'[^' || number || ']: ' || title || ' - ' || url",
    "full": """concat_ws(chr(10), '[' || number || '] **' || title || '**', '   *' || author || '*', '   Source: ' || domain,
      '   Published: ' || published, '   URL: ' || url, case when description <> '' then '   > ' || case when length(description) > 200
      then substring(description, 1, 200) || '...' else description end end)""",
    "rich": SIMPLE + " || chr(10) || '  <!-- ' || concat_ws(', ', 'domain: ' || domain, " + SCORE.format("relevance")
    + ", 'accessed: ' || accessed) || ' -->'",
    "markdown": SIMPLE + " || chr(10) || '  <!-- ' || concat_ws(', ', 'domain: ' || domain, " + SCORE.format("score") + ") || ' -->'",
    "reporter": """number || '. **' || title || '**' || chr(10) || '   - URL: ' || url || chr(10) || '   - Domain: ' || domain || chr(10)
      || case when description <> '' then '   - Summary: ' || substring(description, 1, 150) || '...' || chr(10) else '' end""",
}


def _render_sql(style: str) -> str:
    between = "chr(10)" if style in ("footnote", "reporter") else "chr(10) || chr(10)"
    head = {
        "footnote": "chr(10) || '---' || chr(10) || chr(10)",
        "reporter": "chr(10) || chr(10) || '## Available Source References (use these in References section):' || chr(10) || chr(10)",
    }.get(style, "'## Key Citations' || chr(10) || chr(10)")
    tail = "''" if style == "footnote" else "chr(10)"
    return BASE + CITED + (
        f"select thread_id, part, case when part = 0 then {head} else '' end || string_agg({LINES[style]}, {between} order by number)"
        f" || {tail} as section from cited group by 1, 2"
    )


def _render(style):
    return Query(lambda spark, sf: C.render_references(_citations(spark, sf), style, part_rows=4), _render_sql(style))


def _json(spark, sf):
    return C.citations_json(_citations(spark, sf)).select(
        "thread_id", "number", "count",
        *[F.get_json_object("citation", f"$.{n}").alias(n) for n in ("id", "url", "title", "content_snippet", "domain")],
    )


def _collection(spark, sf):
    """Kept, read again, and numbered anew without the unused ones."""
    citations = _citations(spark, sf)
    kept = C.store_collection(citations, citations.where("number % 3 <> 1"))
    path = scratch_folder(spark, "collection")
    kept.write.parquet(path)
    loaded = C.load_collection(spark.read.parquet(path))
    return C.number_citations(loaded.where("used")).select(
        "thread_id", F.col("number").cast("bigint").alias("number"), F.col("first_seen").cast("bigint").alias("first_seen"), "url", "title", "domain", "relevance_score")


HEADERS = [r"##\s*Notes", r"##\s*Key Citations"]


def _custom_references(spark, sf):
    return C.parse_references(view(spark, sf, "v_reports"), HEADERS).select("report_id", F.col("number").cast("bigint").alias("number"), "title", "url", "form")


NOTES_SQL = REFERENCES_SQL.replace("refs as (", f"""notes as (select report_id, split_part(split_part(body, '## Notes' || chr(10), 2), chr(10) || chr(10) || '##', 1) as s from v_reports),
refs as (select report_id, 0 as f, generate_subscripts(a, 1) as i, unnest(a) as title, unnest(b) as url, 'markdown' as form from
    (select report_id, regexp_extract_all(s, '{LINK}', 1) as a, regexp_extract_all(s, '{LINK}', 2) as b from notes) union all""", 1)

LOOSE = """case number % 3 when 1 then replace(url, 'example', 'ex%61mple') when 2 then url || ' ' else url end"""


def _resolved(spark, sf):
    reports = view(spark, sf, "v_reports")
    cited = C.parse_references(reports).select("report_id", F.expr(LOOSE).alias("url"), "number")
    numbers = reports.select("report_id", F.lit(900).alias("pos"), F.lit("[3]").alias("text"), F.lit("http://none.org").alias("url"))
    links = C.markdown_links(reports).unionByName(numbers)
    return C.resolve_links(links, cited).select(
        "report_id", F.col("pos").cast("bigint").alias("pos"), "text", "url", F.col("number").cast("bigint").alias("number"), "inline"
    )


THREAD_OF = "cast(floor((report_id % {page_count}) / 10) as bigint) as thread_id"
REPORT_THREADS = "select report_id, " + THREAD_OF + ", body from {v_reports}"


def _report_threads(spark, sf):
    text = REPORT_THREADS.replace("{page_count}", page_count(spark, sf))
    return spark.sql(text, v_reports=view(spark, sf, "v_reports"))


def _credibility(spark, sf):
    threads = _report_threads(spark, sf)
    links = C.markdown_links(threads).join(threads.select("report_id", "thread_id"), "report_id")
    results = view(spark, sf, "v_search_results").select(F.col("query_id").alias("thread_id"), "url")
    return C.link_credibility(links, results).select(
        "report_id", F.col("pos").cast("bigint").alias("pos"), "url", "credible"
    )


def _usage(spark, sf):
    return C.citation_usage(_sources(spark, sf), _report_threads(spark, sf)).select("thread_id", "url", "status", "used_number")


REPORTS_AND_RESULTS = ctes("v_search_results", "v_reports") + BASE[len(ctes("v_search_results")):]

QUERIES = {
    "harvest_citations": Query(
        _harvest,
        ctes("v_pages") + """ select cast(floor(page_id / 10) as bigint) as thread_id, url,
  case page_id % 6 when 1 then 'Untitled' when 2 then trim(title) when 4 then 'Untitled' else title end as title,
  case page_id % 6 when 2 then substring('# ' || title || chr(10) || plain, 1, 300) when 4 then '' else plain end as description,
  case page_id % 6 when 2 then substring('# ' || title || chr(10) || plain, 1, 500) when 4 then '' else substring(plain, 1, 500) end
    as content_snippet,
  case page_id % 6 when 2 then '# ' || title || chr(10) || plain when 4 then '' end as raw_content,
  cast(case page_id % 6 when 0 then 0.5 when 1 then 0 when 3 then 0.25 end as double) as relevance_score,
  case when page_id % 6 in (2, 4) then 'crawl' else 'web_search' end as source_type,
  regexp_extract(url, '//([^/?#]*)', 1) as domain from v_pages where page_id % 6 <> 5""",
    ),
    "collect_sources": Query(
        lambda spark, sf: _sources(spark, sf),
        BASE + "select thread_id, url, first_seen, title, description, content_snippet, raw_content, relevance_score from collected",
    ),
    "enrich_from_crawl": Query(
        _enriched,
        BASE + f""",
crawls as ({CRAWLS.format(v_pages='v_pages')}),
pages_seen as (select thread_id, url, min(seq) as seen,
    arg_max(title, seq) filter (where coalesce(title, '') <> '' and title <> 'Untitled') as t,
    arg_max(content, seq) filter (where coalesce(content, '') <> '') as c,
    arg_min(content, seq) filter (where coalesce(content, '') <> '') as e from crawls group by 1, 2)
select coalesce(s.thread_id, p.thread_id) as thread_id, coalesce(s.url, p.url) as url, coalesce(first_seen, seen) as first_seen,
  coalesce(t, title, 'Untitled') as title, description, coalesce(nullif(content_snippet, ''), substring(e, 1, 500)) as content_snippet,
  coalesce(c, raw_content) as raw_content, coalesce(relevance_score, 0) as relevance_score
from collected s full outer join pages_seen p on p.thread_id = s.thread_id and p.url = s.url""",
    ),
    "number_citations": Query(
        lambda spark, sf: C.number_citations(_sources(spark, sf)).select("thread_id", "url", "number"),
        BASE + "select thread_id, url, number from numbered",
    ),
    "used_citations": Query(
        _used,
        BASE + f""",
used as ({USED.format(v_search_results='v_search_results')})
select thread_id, url, row_number() over (partition by thread_id order by first_seen) as number from collected c
where exists (select 1 from used u where u.thread_id = c.thread_id and u.url = c.url)""",
    ),
    "merge_collections": Query(
        lambda spark, sf: _two_collections(spark, sf).select("thread_id", "url", "title", "relevance_score", "first_seen", "used"),
        MERGED_SQL + "select * from merged",
    ),
    "merge_by_score": Query(_scored, MERGE_SCORE_SQL),
    "extract_urls": Query(
        lambda spark, sf: C.extract_urls(view(spark, sf, "v_reports")).select(
            "report_id", F.col("pos").cast("bigint").alias("pos"), "url"
        ),
        URLS_SQL + "select report_id, pos, url from urls",
    ),
    "parse_references": Query(_references, ctes("v_reports") + REFERENCES_SQL + "select report_id, number, title, url, form from referenced"),
    "annotate_links": Query(
        _annotated,
        ctes("v_reports") + REFERENCES_SQL + f""",
cut as (select report_id, string_split(regexp_replace(body, '{LINK}', '\\0' || chr(1), 'g'), chr(1)) as p from v_reports),
pieces as (select report_id, unnest(p) as piece, generate_subscripts(p, 1) as i from cut),
linked as (select *, regexp_extract(piece, '{LINK}$', 2) as url from pieces)
select l.report_id, string_agg(piece || coalesce('[^' || number || ']', ''), '' order by i) as body
from linked l left join referenced r on r.report_id = l.report_id and r.url = l.url group by 1""",
    ),
    **{f"render_references_{style}": _render(style) for style in LINES},
    "citations_json": Query(
        _json,
        BASE + CITED + """select thread_id, number, count(*) over (partition by thread_id) as count,
  substring(sha256(url), 1, 12) as id, url, title, content_snippet, domain from cited""",
    ),
    "parse_custom_references": Query(_custom_references, ctes("v_reports") + NOTES_SQL + "select report_id, number, title, url, form from referenced"),
    "stored_collection": Query(
        _collection,
        BASE + CITED + """select thread_id, row_number() over (partition by thread_id order by number) as number, number as first_seen, url, title, domain,
  relevance_score from cited where number % 3 <> 1""",
    ),
    "resolve_links": Query(
        _resolved,
        ctes("v_reports") + REFERENCES_SQL + f""",
linked as (select report_id, regexp_extract_all(body, '{LINK}', 1) as a, regexp_extract_all(body, '{LINK}', 2) as b from v_reports),
links as (select report_id, generate_subscripts(a, 1) - 1 as pos, unnest(a) as text, unnest(b) as url from linked
          union all select report_id, 900, '[3]', 'http://none.org' from v_reports),
cits as (select report_id, {LOOSE} as url, number from referenced),
exact as (select report_id, url, min(number) as n from cits group by 1, 2),
loose as (select report_id, trim(url_decode(url)) as k, min(number) as n from cits group by 1, 2)
select l.report_id, l.pos, l.text, l.url, coalesce(e.n, o.n) as number,
  regexp_matches(l.text, '{K.INLINE_MARKER}') as "inline"
from links l left join exact e on e.report_id = l.report_id and e.url = l.url
left join loose o on o.report_id = l.report_id and o.k = trim(url_decode(l.url))""",
    ),
    "link_credibility": Query(
        _credibility,
        REPORTS_AND_RESULTS + f""",
threads as ({REPORT_THREADS.format(page_count=SQL_PAGE_COUNT, v_reports='v_reports')}),
linked as (select report_id, thread_id, regexp_extract_all(body, '{LINK}', 2) as b from threads),
links as (select report_id, thread_id, generate_subscripts(b, 1) - 1 as pos, unnest(b) as url from linked)
select report_id, pos, url, exists (select 1 from v_search_results r where r.query_id = l.thread_id and r.url = l.url) as credible
from links l""",
    ),
    "citation_usage": Query(
        _usage,
        REPORTS_AND_RESULTS + URLS_SQL[len(ctes("v_reports")):] + f""",
threads as ({REPORT_THREADS.format(page_count=SQL_PAGE_COUNT, v_reports='v_reports')}),
mentioned as (select distinct thread_id, url from urls join threads using (report_id)),
usage as (select coalesce(c.thread_id, m.thread_id) as thread_id, coalesce(c.url, m.url) as url, first_seen,
    case when m.url is null then 'unused' when c.url is null then 'uncollected' else 'used' end as status
  from collected c full outer join mentioned m on m.thread_id = c.thread_id and m.url = c.url)
select thread_id, url, status, case when status = 'used'
  then row_number() over (partition by thread_id, status order by first_seen) end as used_number from usage""",
    ),
    "collection_stats": Query(
        lambda spark, sf: C.collection_stats(_two_collections(spark, sf)),
        MERGED_SQL + """select thread_id, count(*) as sources, count(*) filter (where used) as used_sources
from merged group by 1""",
    ),
}
