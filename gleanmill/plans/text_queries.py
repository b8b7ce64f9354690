"""Queries that run the column functions over whole tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanmill.functions import constants as K
from gleanmill.functions import json_text as jt
from gleanmill.functions import text as tx
from gleanmill.plans.registry import Query
from gleanmill.plans.views import ctes, view

WS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || ' '"


def over(name, key, **columns):
    """A select over one view: the key column and named expressions."""

    def build(spark, sf):
        return view(spark, sf, name).select(key, *[c().alias(n) for n, c in columns.items()])

    return build


URL_FORMS = """case page_id % 4 when 1 then regexp_replace(url, '^https?://', '')
  when 2 then regexp_replace(url, '^http(s?)://', 'http://user:pw@') when 3 then '//' || url else url end"""
SQL_FORMS = URL_FORMS
SPARK_FORMS = URL_FORMS

PDF_FORMS = """case page_id % 4 when 1 then url || '.PDF' when 2 then regexp_replace(url, '[?#].*$', '') || '.pdf;v=1?x=1.html'
  when 3 then regexp_replace(url, '[?#].*$', '') || '.pdf#p' else url end"""

FILE_FORMS = """case page_id % 4 when 0 then '/up/' || title || '.pdf' when 1 then plain || '.docx' when 2 then '../..'
  else 'dir/' || title end"""

KEY_FORMS = """case page_id % 3 when 0 then url || '?q=a%20b+c' when 1 then ' ' || url || '%zz' else url || '/%C3%A9 ' end"""

TOOL_TEXT = """case when event_id % 2 = 0 then props || ' trailing tokens' else ' ' || event_type || chr(7) || chr(10) || 'x' end"""

NOISY = "replace(text, ' ', case doc_id % 3 when 0 then chr(9) when 1 then chr(92) else chr(27) end)"

MARKDOWN = "'Intro' || chr(10) || '```markdown' || chr(10) || body || chr(10) || '```' || chr(10) || 'see [x](http://e.org/a'"


def _titles(spark, sf):
    parts = [
        view(spark, sf, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("t")),
        view(spark, sf, "v_reports").select(F.lit("report"), "report_id", "body"),
        view(spark, sf, "documents").select(F.lit("document"), "doc_id", "text"),
    ]
    return parts[0].union(parts[1]).union(parts[2]).select("kind", "id", tx.smart_title(F.col("t")).alias("title"))


TITLE_SQL = (
    ctes("v_reports")
    + f""",
inputs as (select 'page' as kind, page_id as id, html as t from pages union all
           select 'report', report_id, body from v_reports union all select 'document', doc_id, text from documents),
fields as (select *, trim(regexp_extract(t, '(?i)"?title"?\\s*:\\s*["'']?([^"''\\n]+)["'']?', 1), {WS}) as f from inputs)
select kind, id, substring(coalesce(
  nullif(trim(regexp_extract(t, '(?i)<title[^>]*>([^<]+)</title>', 1), {WS}), ''),
  nullif(trim(regexp_extract(t, '(?m)^#\\s+(.+?)$', 1), {WS}), ''),
  nullif(trim(regexp_extract(t, '(?m)^#{{2,6}}\\s+(.+?)$', 1), {WS}), ''),
  case when length(f) > 3 then f end,
  list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, {WS})),
    lambda x: length(x) > 10 and not regexp_matches(x, '^(```|---|\\*\\*\\*|- |\\* |\\+ |#)'))[1],
  'Untitled'), 1, 200) as title from fields"""
)

HTML_SQL = f"""with inputs as (select 'page' as kind, page_id as id, html as t from pages union all
           select 'document', doc_id, text from documents),
trimmed as (select kind, id, trim(t, {WS}) as t from inputs)
select kind, id, (starts_with(t, '<!--') and contains(t, '-->')) or (starts_with(t, '<?xml') and contains(t, '<html'))
  or regexp_matches(t, '(?i)^({"|".join(K.HTML_STARTS)})')
  or (regexp_matches(t, '<[^>]+>') and regexp_matches(t, '(?i)({"|".join(K.HTML_HINTS)})')) as is_html from trimmed"""

TOKENS = """(length(regexp_replace({0}, '[^\\x00-\\x7F]', '', 'g')) // 4
  + length({0}) - length(regexp_replace({0}, '[^\\x00-\\x7F]', '', 'g')))"""


def _is_html(spark, sf):
    pages = view(spark, sf, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("t"))
    docs = view(spark, sf, "documents").select(F.lit("document"), "doc_id", "text")
    return pages.union(docs).select("kind", "id", tx.is_html(F.col("t")).alias("is_html"))


def _message_tokens(spark, sf):
    kind = F.when(F.col("role") == "assistant", "ai").when(F.col("role") == "user", "human").otherwise(F.col("role"))
    return view(spark, sf, "v_messages").select(
        "message_id", tx.message_tokens(kind, F.col("content")).alias("tokens")
    )


QUERIES = {
    "url_domain": Query(
        over("pages", "page_id", domain=lambda: tx.url_domain(F.expr(SPARK_FORMS))),
        f"""with forms as (select page_id, {SQL_FORMS} as u from pages)
select page_id, coalesce(nullif(regexp_extract(u, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1), ''),
  nullif(regexp_extract(u, '{K.BARE_HOST}', 1), ''), '') as domain from forms""",
    ),
    "citation_id": Query(
        over("pages", "page_id", citation_id=lambda: tx.citation_id(F.col("url"))),
        "select page_id, substring(sha256(url), 1, 12) as citation_id from pages",
    ),
    "domain_set": Query(
        over("v_reports", "report_id", domains=lambda: F.array_join(F.array_sort(tx.domain_set(F.col("body"))), ",")),
        ctes("v_reports")
        + r""" select report_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(
  regexp_extract_all(body, 'https?://([^\s\)\]]+)', 1),
  lambda u: replace(lower(regexp_extract(u, '^([^/?#]*)', 1)), 'www.', '')), lambda h: h <> ''))), ',') as domains
from v_reports""",
    ),
    "url_match_key": Query(
        over("pages", "page_id", match_key=lambda: tx.url_match_key(F.expr(KEY_FORMS))),
        f"""with forms as (select page_id, {KEY_FORMS} as u from pages)
select page_id, trim(case when contains(u, '%zz') then u else url_decode(u) end) as match_key from forms""",
    ),
    "clip": Query(
        over(
            "documents", "doc_id",
            snippet=lambda: tx.clip(F.col("text"), 500), summary=lambda: tx.clip(F.col("text"), 200, "..."),
        ),
        """select doc_id, substring(text, 1, 500) as snippet,
  case when length(text) > 200 then substring(text, 1, 200) || '...' else text end as summary from documents""",
    ),
    "smart_title": Query(_titles, TITLE_SQL),
    "clean_tool_text": Query(
        over("events", "event_id", cleaned=lambda: jt.clean_tool_text(F.expr(TOOL_TEXT))),
        """select event_id, case when event_id % 2 = 0 then props else event_type || chr(10) || 'x' end as cleaned
from events""",
    ),
    "log_safe": Query(
        over("documents", "doc_id", safe=lambda: tx.log_safe(F.expr(NOISY))),
        f"""with noisy as (select doc_id, replace(replace(replace(replace({NOISY}, chr(92), chr(92) || chr(92)),
    chr(10), chr(92) || 'n'), chr(9), chr(92) || 't'), chr(27), chr(92) || 'x1b') as t from documents)
select doc_id, case when length(t) > 500 then substring(t, 1, 497) || '...' else t end as safe from noisy""",
    ),
    "escape_brackets": Query(
        over(
            "events", "event_id", escaped=lambda: tx.escape_brackets(F.col("props")),
            restored=lambda: tx.unescape_brackets(tx.escape_brackets(F.col("props"))),
        ),
        """select event_id, replace(replace(replace(replace(props, '[', '&#91;'), ']', '&#93;'), '{', '&#123;'), '}',
  '&#125;') as escaped, props as restored from events""",
    ),
    "safe_filename": Query(
        over("v_pages", "page_id", file=lambda: tx.safe_filename(F.expr(FILE_FORMS)),
             upload=lambda: tx.upload_name(F.expr(FILE_FORMS))),
        ctes("v_pages") + f""",
names as (select page_id, {FILE_FORMS} as n from v_pages),
based as (select *, regexp_extract(n, '([^/]*)/*$', 1) as b from names),
cleaned as (select *, coalesce(nullif(trim(regexp_replace(regexp_replace(b, '[^\\p{{L}}\\p{{N}}_.\\-]', '_', 'g'), '_+', '_', 'g'),
   '_.'), ''), 'unnamed_file') as c from based)
select page_id, case when length(c) <= 200 then c when regexp_matches(c, '\\.[^.]{{1,10}}$')
  then substring(regexp_replace(c, '\\.[^.]*$', ''), 1, 200 - length(regexp_extract(c, '(\\.[^.]*)$', 1)))
       || regexp_extract(c, '(\\.[^.]*)$', 1) else substring(c, 1, 200) end as file,
  case when trim(b) in ('', '.', '..') then 'unnamed_file' else trim(regexp_extract(n, '([^/]*)$', 1)) end as upload from cleaned""",
    ),
    "strip_data_uri": Query(
        over("v_search_results", "seq", text=lambda: tx.strip_data_uri(F.coalesce("content", "image_url"))),
        ctes("v_search_results")
        + f" select seq, regexp_replace(coalesce(content, image_url), '{K.BASE64_IMAGE}', ' ', 'g') as text"
        " from v_search_results",
    ),
    "is_html": Query(_is_html, HTML_SQL),
    "is_pdf_url": Query(
        over("pages", "page_id", is_pdf=lambda: tx.is_pdf_url(F.expr(PDF_FORMS))),
        f"""with forms as (select page_id, {PDF_FORMS} as u from pages)
select page_id, ends_with(lower(regexp_replace(regexp_replace(regexp_replace(u, '^[a-z]+://[^/?#]*', ''), '[?#].*$', ''),
  ';[^/]*$', '')), '.pdf') as is_pdf from forms""",
    ),
    "estimate_tokens": Query(
        over("documents", "doc_id", tokens=lambda: tx.estimate_tokens(F.col("text"))),
        f"select doc_id, {TOKENS.format('text')} as tokens from documents",
    ),
    "message_tokens": Query(
        _message_tokens,
        ctes("v_messages") + f""",
typed as (select *, case role when 'assistant' then 'ai' when 'user' then 'human' else role end as kind from v_messages)
select message_id, cast(greatest(floor(({TOKENS.format('content')} + length(kind) // 4)
  * case kind when 'ai' then 1.2e0 when 'system' then 1.1e0 else 1.0e0 end), 1) as bigint) as tokens from typed""",
    ),
    "markdown_clean": Query(
        over("v_reports", "report_id", markdown=lambda: tx.markdown_clean(F.expr(MARKDOWN))),
        ctes("v_reports") + " select report_id, 'Intro' || chr(10) || body || chr(10) || 'see [x](http://e.org/a)' as markdown from v_reports",
    ),
}
