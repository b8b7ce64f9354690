"""Derived tables: what the jobs read, made from the given tables.

Each view is one SQL text for both engines, apart from a few spellings. ``view`` runs it in Spark;
``ctes`` gives the same views as a WITH prelude for the SQL check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanmill.sources.tables import read_table

TABLES = "documents pages conversations events embeddings benchmark labels".split()

VIEWS = {
    # Title, whole text without tags.
    "v_pages": """
select page_id, url, html, regexp_extract(html, '<title>([^<]*)</title>', 1) as title,
       trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ ]+', ' ', 'g')) as plain
from {pages}""",
    # Ten pages per query; every page twice with different scores, and once as an image.
    "v_search_results": """
select cast(floor(page_id / 10) as bigint) as query_id, page_id * 3 + 1 as seq, 'page' as type, title, url,
       case when page_id % 5 = 0 then plain || ' data:image/png;base64,iVBORw0KGgo= end' else plain end as content,
       html as raw_content, cast(nullif((page_id * 37) % 100, 0) as double) / 100 as score,
       cast(null as string) as image_url, cast(null as string) as image_description
from {v_pages}
union all
select cast(floor(page_id / 10) as bigint), page_id * 3 + (page_id % 2) * 2, 'page', title || ' (copy)', url, plain,
       cast(null as string), cast((page_id * 53 + 11) % 100 as double) / 100, cast(null as string),
       cast(null as string)
from {v_pages}
union all
select cast(floor(page_id / 10) as bigint), page_id * 3 + 2 - (page_id % 2) * 2,
       case when page_id % 3 = 0 then 'image' else 'image_url' end, cast(null as string), cast(null as string),
       cast(null as string), cast(null as string), cast(null as double),
       case page_id % 4 when 1 then 'data:image/png;base64,QUJD' when 2 then url || '?i=data:image/png;base64,QUJD'
            else url || '/img.png' end, plain
from {v_pages}""",
    # One markdown report per document, in six styles, with links, images and four kinds of references.
    "v_reports": """
select d.doc_id as report_id,
       case d.doc_id % 6 when 0 then 'default' when 1 then 'academic' when 2 then 'news'
            when 3 then 'popular_science' when 4 then 'social_media' else 'strategic_investment' end as style,
       '# Report ' || cast(d.doc_id as string) || chr(10) || chr(10)
       || '## Key Points' || chr(10) || '- ' || p1.title || chr(10) || chr(10)
       || case when d.doc_id % 3 <> 0 then '## Overview' || chr(10) else '' end || d.text || chr(10) || chr(10)
       || 'See [' || p1.title || '](' || p1.url || ') and ' || p3.url || ' too.' || chr(10) || chr(10)
       || case when d.doc_id % 2 = 0 then '![Figure](' || p1.url || ')' || chr(10) || chr(10) else '' end
       || '## Key Citations' || chr(10) || chr(10)
       || '- [' || p1.title || '](' || p1.url || ')' || chr(10)
       || '- [' || p2.title || '](' || p2.url || ')' || chr(10)
       || '[1] Numbered - ' || p3.url || chr(10)
       || '[^2]: Footnote - ' || p2.url || '/note' || chr(10)
       || '<a class="r" href="' || p4.url || '">Anchor</a>' || chr(10) || chr(10)
       || '## Notes' || chr(10) || '[Not a source](' || p4.url || '/notes)' || chr(10) as body
from {documents} d
join {v_pages} p1 on p1.page_id = d.doc_id % {page_count}
join {v_pages} p2 on p2.page_id = (d.doc_id * 7 + 1) % {page_count}
join {v_pages} p3 on p3.page_id = (d.doc_id * 3 + 2) % {page_count}
join {v_pages} p4 on p4.page_id = (d.doc_id * 5 + 3) % {page_count}""",
    # Judge answers for the labelled documents: plain, fenced, fenced without a language, or broken JSON.
    "v_verdicts": """
select doc_id as report_id,
       case doc_id % 5 when 1 then 'Here:' || chr(10) || '```json' || chr(10) || answer || chr(10) || '```'
            when 2 then '```' || answer || '```' when 3 then substring(answer, 1, 60) else answer end as raw
from (select doc_id, chr(123) || '"scores": ' || chr(123)
             || '"factual_accuracy": ' || cast((doc_id * 3 + quality) % 10 + 1 as string)
             || ', "completeness": ' || cast((doc_id * 5 + toxic) % 10 + 1 as string)
             || ', "coherence": ' || cast(doc_id * 7 % 10 + 1 as string)
             || case when doc_id % 4 = 0 then '' else ', "relevance": ' || cast(doc_id * 11 % 10 + 1 as string) end
             || ', "citation_quality": ' || cast(doc_id * 13 % 10 + 1 as string)
             || ', "writing_quality": ' || cast(doc_id * 17 % 10 + 1 as string)
             || chr(125) || ', "overall_score": ' || cast(doc_id % 11 as string)
             || ', "strengths": ["s1", "s2", "s3", "s4"], "weaknesses": ["w' || cast(doc_id as string) || '"]'
             || ', "suggestions": []' || chr(125) as answer
      from {labels})""",
    # Conversation turns as agent messages.
    "v_messages": """
select conv_id as thread_id, turn as seq, cast(conv_id as string) || '-' || cast(turn as string) as message_id,
       role, case when role <> 'assistant' then cast(null as string)
                  when turn % 4 = 1 then 'planner' when turn % 4 = 2 then 'researcher' else 'reporter' end as agent,
       text as content,
       case when role = 'assistant' then case when conv_id % 5 = 0 then 'interrupt' else 'stop' end end as finish_reason
from {conversations}""",
    # The whole content of each message, streamed in pieces of 50 characters.
    "v_stream_chunks": """
select thread_id, message_id, seq * 1000000 + piece as seq, piece, role, agent,
       substring(content, cast(piece * 50 + 1 as int), 50) as content,
       case when (piece + 1) * 50 >= length(content) then finish_reason end as finish_reason
from (select m.*, {pieces} as piece from {v_messages} m)""",
    # The pieces of assistant messages read as fragments of three interleaved tool calls.
    "v_tool_chunks": """
select thread_id, message_id, seq, piece, piece % 3 as idx,
       case when piece < 3 then message_id || ':' || cast(piece as string) end as call_id,
       case when piece = 0 then 'web_search' when piece = 1 then 'crawl_tool' when piece = 2 then 'local_search_tool' end
         as name,
       content as args
from {v_stream_chunks} where role = 'assistant'""",
    # One plan per user, one step per event; about half of the steps are done.
    "v_plan_steps": """
select user_id as plan_id, event_id as step_no, event_type in ('click', 'view') as need_search,
       case event_type when 'click' then 'research' when 'view' then 'research' when 'purchase' then 'processing'
            when 'signup' then 'analysis' end as step_type,
       event_type as title, case when event_id % 7 < 3 or value < 20 then props end as execution_res
from {events}""",
}

NEEDS = {
    "v_pages": ["pages"],
    "v_search_results": ["v_pages"],
    "v_reports": ["documents", "v_pages"],
    "v_verdicts": ["labels"],
    "v_messages": ["conversations"],
    "v_stream_chunks": ["v_messages"],
    "v_tool_chunks": ["v_stream_chunks"],
    "v_plan_steps": ["events"],
}

# In Spark the four pages of each report are looked up by its id alone, once per id, and the text joins them last: so it is
# shuffled once and not once per page. The rows are those of the text above, for repeated and null keys too.
REPORT_HEAD, REPORT_JOINS = VIEWS["v_reports"].split("from {documents} d")
REPORT_PAGES = """select d.doc_id, struct(p1.title, p1.url) as p1, struct(p2.title, p2.url) as p2, struct(p3.url) as p3, struct(p4.url) as p4
from (select distinct doc_id from {documents}) d""" + REPORT_JOINS
SPARK_VIEWS = VIEWS | {"v_report_pages": REPORT_PAGES, "v_reports": REPORT_HEAD + "from {documents} d join {v_report_pages} p on p.doc_id = d.doc_id"}
SPARK_NEEDS = NEEDS | {"v_report_pages": ["documents", "v_pages"], "v_reports": ["documents", "v_report_pages"]}

# The spellings that differ between the engines. In Spark the number of pages is read beforehand, from the
# file footers, and put in as a number.
SQL_PAGE_COUNT = "(select count(*) from pages)"
SPARK_PIECES = "explode(sequence(0L, cast(greatest(ceil(length(m.content) / 50.0), 1) as bigint) - 1))"
SQL_PIECES = "unnest(range(0, cast(greatest(ceil(length(m.content) / 50.0), 1) as bigint)))"


KEYS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id", "events": "event_id"}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{table}.parquet", KEYS.get(table))


def page_count(spark: SparkSession, sf_dir: str) -> str:
    return str(spark.read.parquet(f"{sf_dir}/pages.parquet").count())


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given or derived table in Spark. Inputs are passed as frames; the catalog stays untouched."""
    if name in TABLES:
        return read(spark, sf_dir, name)
    text = SPARK_VIEWS[name].replace(", 'g')", ")").replace("{pieces}", SPARK_PIECES)
    if "{page_count}" in text:
        text = text.replace("{page_count}", page_count(spark, sf_dir))
    return spark.sql(text, **{n: view(spark, sf_dir, n) for n in SPARK_NEEDS[name]})


def ctes(*names: str) -> str:
    """WITH prelude that defines the named views and all they need, for the SQL check."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in TABLES or name in ordered:
            return
        for needed in NEEDS[name]:
            add(needed)
        ordered.append(name)

    for name in names:
        add(name)
    texts = []
    for name in ordered:
        text = VIEWS[name].replace("{pieces}", SQL_PIECES).replace("{page_count}", SQL_PAGE_COUNT)
        for needed in NEEDS[name]:
            text = text.replace("{" + needed + "}", needed)
        texts.append(f"{name} as ({text})")
    return "with " + ",\n".join(texts)
