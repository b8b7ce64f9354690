"""Source and sink queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanmill.plans.registry import Query
from gleanmill.plans.views import ctes, view
from gleanmill.session import scratch_folder
from gleanmill.sources import event_log as L
from gleanmill.sources import parse_batches as B
from gleanmill.sources import provider_results as P
from gleanmill.sources import tables as D

O, C = "chr(123)", "chr(125)"


def _chunk_events(spark, sf):
    return view(spark, sf, "v_stream_chunks").select(
        F.lit("message_chunk").alias("event"), "thread_id", "seq", F.col("message_id").alias("id"), "role", "content",
        "finish_reason",
    )


def _read_log(spark, sf):
    """Every chunk written to log files and read back: fields come from the parsed data."""
    path = scratch_folder(spark, "log")
    L.write_event_log(_chunk_events(spark, sf), path)
    parsed = L.read_event_log(spark, path)
    value = F.from_json(
        "data", "thread_id bigint, seq bigint, id string, role string, content string, finish_reason string"
    )
    return parsed.select("event", value.alias("d")).select("event", "d.*")


def _user_log(spark, sf):
    users = view(spark, sf, "v_messages").filter("role = 'user'")
    path = scratch_folder(spark, "user-log")
    L.write_event_log(L.user_frames(users), path)
    return L.read_event_log(spark, path).select(
        "event",
        F.get_json_object("data", "$.id").alias("id"),
        F.get_json_object("data", "$.role").alias("role"),
        F.get_json_object("data", "$.content").alias("content"),
    )


PAGE_RESPONSE = """to_json(named_struct('results', array(named_struct('title', title, 'url', url, 'content', plain, 'score',
  cast(page_id % 100 as double) / 100, 'raw_content', case when page_id % 2 = 0 then html else '' end),
  named_struct('title', 'again', 'url', url, 'content', 'c', 'score', 0.9D, 'raw_content', cast(null as string))),
  'images', array(named_struct('url', url || '/a.png', 'description', title))))"""
SECTION_RESPONSE = """to_json(array(named_struct('content', named_struct('results', named_struct(
  'organic', array(named_struct('title', title, 'url', url, 'desc', plain), named_struct('title', 'again', 'url', url, 'desc', '')),
  'top_stories', named_struct('items', array(named_struct('time_frame', '1d', 'title', title, 'url', url || '/news', 'source', 's'))),
  'images', named_struct('items', array(named_struct('url', url || '/a.png', 'alt', title), named_struct('url', '', 'alt', 'x')))))),
  named_struct('content', named_struct('results', named_struct(
  'organic', array(named_struct('title', 'late', 'url', url || '/news', 'desc', 'd')),
  'top_stories', cast(null as struct<items: array<struct<time_frame: string, title: string, url: string, source: string>>>),
  'images', cast(null as struct<items: array<struct<url: string, alt: string>>>))))))"""


def _responses(spark, sf, response):
    return view(spark, sf, "v_pages").select(F.col("page_id").alias("query_id"), F.expr(response).alias("response"))


def _page_results(spark, sf):
    return P.load_page_results(_responses(spark, sf, PAGE_RESPONSE), 0.2, 300).select(
        "query_id", "type", "title", "url", "content", "raw_content", "score", "image_url", "image_description",
        F.col("position").cast("bigint").alias("position"),
    )


def _sectioned(spark, sf):
    return P.load_sectioned_results(_responses(spark, sf, SECTION_RESPONSE)).drop("seq")


PAYLOAD = f"""case page_id % 4 when 0 then {O} || '"reader_result": "r' || page_id || '", "content": "c"' || {C}
  when 1 then {O} || '"content": "c' || page_id || '"' || {C} when 2 then html else '  ' end"""
STATUS = "cast(case when page_id % 8 = 0 then 500 else 200 end as int)"


def _payloads(spark, sf):
    text, failed = P.unwrap_fetch_payload(F.col("body"), F.col("status"))
    bodies = view(spark, sf, "pages").select("page_id", F.expr(PAYLOAD).alias("body"), F.expr(STATUS).alias("status"))
    return bodies.select("page_id", text.alias("text"), failed.alias("failed"))


# Every event is one parse result; a batch holds the results of one user.
RESULT = """select user_id as batch_id, event_id as pos,
  case when event_type = 'error' then 'lost.pdf' else 'f' || event_id || '.pdf' end as file_name,
  case event_type when 'click' then 'done' when 'view' then 'done' when 'purchase' then 'failed' when 'signup' then 'running'
    else 'done' end as state,
  case when event_id % 2 = 0 then 'broken file' else '' end as err_msg,
  case when event_id % 9 = 0 then '' else 'https://z.example.org/' || event_id end as full_zip_url from {events}"""
FILES = """select user_id as batch_id, event_id as pos, 'f' || event_id || '.pdf' as name from {events}
  where event_type <> 'error'"""


def _results(spark, sf):
    return spark.sql(RESULT, events=view(spark, sf, "events"))


UPLOADS = """select doc_id % 40 as request_id, doc_id as seq,
  source || case doc_id % 5 when 0 then '.pdf' when 1 then '.DOCX' when 2 then '.txt' when 3 then '' else '.pptx' end as name,
  case when doc_id % 11 = 0 then cast(0 as bigint) when doc_id % 13 = 0 then n_chars * 300000000 else n_chars end as size
  from {documents}"""


def _uploads(spark, sf):
    return spark.sql(UPLOADS, documents=view(spark, sf, "documents"))


def _append(spark, sf):
    turns = view(spark, sf, "conversations")
    stamp = F.timestamp_seconds(F.col("conv_id") * 60 + F.col("turn"))
    users = turns.filter("role = 'user'").select(
        F.col("conv_id").alias("thread_id"), F.col("turn").alias("message_no"), F.col("text").alias("message"),
        stamp.alias("ts"),
    )
    others = turns.filter("role <> 'user'").select(
        F.col("conv_id").alias("thread_id"), F.col("turn").alias("seq"), F.col("text").alias("message"), stamp.alias("ts")
    )
    return D.append_conversations(users, others).select(
        "thread_id", "message_no", "message", F.unix_seconds("ts").alias("ts")
    )



QUERIES = {
    "read_event_log": Query(
        _read_log,
        ctes("v_stream_chunks")
        + """ select 'message_chunk' as event, thread_id, seq, message_id as id, role, nullif(content, '') as content,
  finish_reason from v_stream_chunks""",
    ),
    "write_event_log": Query(
        _user_log,
        ctes("v_messages") + """ select 'message_chunk' as event, 'run--' || message_id as id, 'user' as role, content
from v_messages where role = 'user'""",
    ),
    "load_page_results": Query(
        _page_results,
        ctes("v_pages") + """,
scored as (select *, cast(page_id % 100 as double) / 100 as score from v_pages),
rows as (select page_id, 'page' as type, title, url,
    case when length(plain) > 300 then substring(plain, 1, 300) || '...' else plain end as content,
    case when page_id % 2 = 0 then case when length(html) > 600 then substring(html, 1, 600) || '...' else html end end
      as raw_content, score, cast(null as string) as image_url, cast(null as string) as image_description
  from scored where score >= 0.2
  union all select page_id, 'image_url', null, null, null, null, null, url || '/a.png', title from scored)
select page_id as query_id, type, title, url, content, raw_content, score, image_url, image_description,
  row_number() over (partition by page_id order by coalesce(score, 0) desc) as position from rows""",
    ),
    "load_sectioned_results": Query(
        _sectioned,
        ctes("v_pages") + """ select page_id as query_id, 'page' as type, title, url, plain as content, null as source,
  null as time_frame, null as image_url, null as image_description from v_pages
union all select page_id, 'news', title, url || '/news', null, 's', '1d', null, null from v_pages
union all select page_id, 'image_url', null, null, null, null, null, url || '/a.png', title from v_pages""",
    ),
    "unwrap_fetch_payload": Query(
        _payloads,
        """select page_id, case when page_id % 8 = 0 then 'Error: status 500' else case page_id % 4 when 0 then 'r' || page_id
  when 1 then 'c' || page_id when 2 then html else 'Error: empty response' end end as text,
  page_id % 8 = 0 or page_id % 4 = 3 as failed from pages""",
    ),
    "parse_outcome_triage": Query(
        lambda spark, sf: B.parse_outcome_triage(
            _results(spark, sf), spark.sql(FILES, events=view(spark, sf, "events"))
        ),
        f"""with results as ({RESULT.format(events='events')}), files as ({FILES.format(events='events')})
select r.batch_id, r.pos, coalesce(f.name, r.file_name) as path_name, r.full_zip_url,
  case when f.name is null then 'file_name not in batch' when state = 'failed' then coalesce(nullif(err_msg, ''), 'state=failed')
    when state <> 'done' then 'state=' || state when full_zip_url = '' then 'no full_zip_url' end as reason
from results r left join files f on f.batch_id = r.batch_id and f.pos = r.pos""",
    ),
    "batch_progress": Query(
        lambda spark, sf: B.batch_progress(
            _results(spark, sf),
            spark.sql(FILES, events=view(spark, sf, "events")).groupBy("batch_id").agg(F.count(F.lit(1)).alias("expected")),
        ),
        f"""with results as ({RESULT.format(events='events')}), files as ({FILES.format(events='events')}),
expected as (select batch_id, count(*) as expected from files group by 1),
counted as (select batch_id, count(*) filter (where state = 'done') as done, count(*) filter (where state = 'failed') as failed,
  count(*) as total, bool_and(state = 'done') as all_done from results group by 1)
select c.*, e.expected, c.done + c.failed >= e.expected as complete from counted c left join expected e using (batch_id)""",
    ),
    "validate_uploads": Query(
        lambda spark, sf: B.validate_uploads(_uploads(spark, sf)).select("request_id", "seq", "name", "size", "reason"),
        f"""with files as ({UPLOADS.format(documents='documents')}),
counted as (select *, count(*) over (partition by request_id) as n, lower(regexp_extract(name, '(\\.[^./]*)$', 1)) as ext from files)
select request_id, seq, name, size, case when n > 200 then 'too many files (max=200)'
  when ext not in ('.doc', '.docx', '.pdf', '.ppt', '.pptx') then 'unsupported type ' || ext
  when size = 0 then 'empty file' when size > 209715200 then 'file too large' end as reason from counted""",
    ),
    "unique_file_ids": Query(
        lambda spark, sf: B.unique_file_ids(_uploads(spark, sf)),
        f"""with files as ({UPLOADS.format(documents='documents')}),
counted as (select *, row_number() over (partition by request_id, name order by seq) as n, regexp_extract(name, '(\\.[^./]*)$', 1) as ext from files)
select request_id, seq, name, case when n = 1 then name
  else substring(name, 1, length(name) - length(ext)) || '_' || n || ext end as file_id from counted""",
    ),
    "append_conversations": Query(
        _append,
        """with old as (select conv_id, turn as message_no, text, conv_id * 60 + turn as ts from conversations where role = 'user'),
last as (select conv_id, max(message_no) as m from old group by 1),
new as (select conv_id, row_number() over (partition by conv_id order by turn) as n, text, conv_id * 60 + turn as ts
        from conversations where role <> 'user')
select conv_id as thread_id, message_no, text as message, ts from old
union all select n.conv_id, n.n + coalesce(l.m, 0), n.text, n.ts from new n left join last l using (conv_id)""",
    ),
}
