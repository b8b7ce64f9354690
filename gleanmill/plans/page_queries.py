"""Page queries and their SQL twins. Pages, documents (not HTML), and some PDFs and blanks."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanmill.functions import constants as K
from gleanmill.operators import pages as P
from gleanmill.plans.registry import Query
from gleanmill.plans.views import ctes, view

MIXED = """select page_id, case when page_id % 10 = 3 then url || '.pdf' else url end as url,
  case when page_id % 10 = 4 then '  ' else html end as html from {pages}
union all select 1000000000 + doc_id, 'https://docs.example.org/' || doc_id, text from {documents}"""


def _mixed(spark, sf):
    return spark.sql(MIXED, pages=view(spark, sf, "pages"), documents=view(spark, sf, "documents"))


MIXED_SQL = "with mixed as (" + MIXED.format(pages="pages", documents="documents") + """),
triaged as (select *, case when regexp_matches(url, '(?i)^[a-z]+://[^/?#]*[^?#]*[.]pdf$') then 'pdf' when trim(html) = '' then 'empty'
  when page_id < 1000000000 then 'html' else 'not_html' end as status from mixed),
shown as (select *, trim(regexp_replace(html, '\\s+', ' ', 'g')) as flat from triaged)
"""

ARTICLES = """select page_id, url, title, 'Intro ' || title || chr(10) || '![a](/img/' || page_id || '.png)' || chr(10) || plain || chr(10)
  || '![b](' || url || '/b.png)![](c d.png)' || chr(10) as markdown from {v_pages}"""


def _articles(spark, sf):
    return spark.sql(ARTICLES, v_pages=view(spark, sf, "v_pages"))


def _blocks(spark, sf):
    return P.split_blocks(_articles(spark, sf)).select(
        "page_id", F.col("block_no").cast("bigint").alias("block_no"), "type", "value"
    )


def _clips(spark, sf):
    articles = _articles(spark, sf).withColumn("status", F.when(F.col("page_id") % 10 == 3, "pdf").otherwise("html"))
    return P.clip_articles(articles).select(
        "page_id", *[F.get_json_object("payload", f"$.{n}").alias(n) for n in ("url", "crawled_content", "error", "is_pdf")]
    )


ROOT = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"
DIR = "regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '')"

QUERIES = {
    "triage_pages": Query(
        lambda spark, sf: P.triage_pages(_mixed(spark, sf)).select("page_id", "url", "status", "title", "content"),
        MIXED_SQL + f"""select page_id, url, status, case status when 'empty' then '{K.EMPTY_PAGE[0]}' when 'not_html' then '{K.NON_HTML_PAGE[0]}' end
  as title, case status when 'empty' then '{K.EMPTY_PAGE[1]}' when 'not_html' then '{K.NON_HTML_PAGE[1]}'
  || case when length(html) <= 500 then html when length(flat) <= 500 then flat
          else regexp_extract(flat, '^(.{{0,496}}[^ ])(?: |$)', 1) || '...' end || '</p>' end as content from shown""",
    ),
    "extract_articles": Query(lambda spark, sf: P.extract_articles(_mixed(spark, sf))),
    "articles_to_markdown": Query(
        lambda spark, sf: P.articles_to_markdown(P.extract_articles(_mixed(spark, sf))).select("page_id", "markdown")
    ),
    "split_blocks": Query(
        _blocks,
        ctes("v_pages") + f""" select page_id, 0 as block_no, 'text' as type, trim('Intro ' || title) as value from v_pages
union all select page_id, 1, 'image_url', {ROOT} || '/img/' || page_id || '.png' from v_pages
union all select page_id, 2, 'text', plain from v_pages
union all select page_id, 3, 'image_url', url || '/b.png' from v_pages
union all select page_id, 5, 'image_url', {DIR} || 'c d.png' from v_pages""",
    ),
    "clip_articles": Query(
        _clips,
        "with v as (" + ctes("v_pages") + " " + ARTICLES.format(v_pages="v_pages") + f""")
select page_id, url, case when page_id % 10 <> 3 then substring(markdown, 1, 1000) end as crawled_content,
  case when page_id % 10 = 3 then '{K.PDF_ERROR}' end as error, case when page_id % 10 = 3 then 'true' end as is_pdf from v""",
    ),
}
