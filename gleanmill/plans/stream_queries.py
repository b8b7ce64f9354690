"""Streaming jobs run to the end of their input, next to the SQL that gives the same rows from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanmill.plans.registry import Query
from gleanmill.plans.views import ctes, view
from gleanmill.plans.trace_queries import ALIVE_SQL, CALLS_OF_MESSAGES, EVENTS
from gleanmill.session import scratch_folder
from gleanmill.sources import event_log as L
from gleanmill.sources.tables import read_arrivals
from gleanmill.streaming import conversations as S


FILES_PER_BATCH = 4


def _streamed(spark, rows):
    """The rows as a file stream of several micro-batches; a thread is in one file."""
    path = scratch_folder(spark, "input")
    rows.repartition("thread_id").write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(path)


def _drained(spark, stream):
    """Run a stream over all its input and read what it wrote."""
    out = scratch_folder(spark, "output")
    S.write_stream(stream, out, scratch_folder(spark, "checkpoint")).awaitTermination()
    return read_arrivals(spark, out).drop("batch_id")


def _chunks(spark, sf):
    return view(spark, sf, "v_stream_chunks").withColumn("thread_id", F.col("thread_id").cast("string"))


def _flushed(spark, sf):
    chunks = _chunks(spark, sf).select("thread_id", "seq", F.col("content").alias("message"), "finish_reason")
    return _drained(spark, S.buffer_and_flush(_streamed(spark, chunks)))


def _messages(spark, sf):
    """Texts, tool calls and errors of all threads, one row per message with its calls as text."""
    events = spark.sql(EVENTS, v_stream_chunks=view(spark, sf, "v_stream_chunks")).withColumn("thread_id", F.col("thread_id").cast("string"))
    calls = F.transform("calls", lambda c: F.concat_ws(" ", c["call_id"], c["name"], c["args"]))
    return _drained(spark, S.stream_assemble(_streamed(spark, events))).select(
        "thread_id", "message_id", "role", "agent", "content", "reasoning", "finish_reason", "streaming",
        F.array_join(calls, "\n").alias("calls"))


O, E = "chr(123)", "chr(125)"
UPDATES = f"""select cast(query_id as string) as thread_id, seq, {O} || '"reporter": ' || {O} || '"citations": [' || {O}
    || '"url": "' || url || '", "title": "' || case when seq % 4 = 0 then '' else 'title ' || seq end
    || '", "description": "d' || seq || '", "relevance_score": ' || cast(coalesce(score, 0) as string) || {E} || ']' || {E} || {E} as data,
  false as ended from {{v_search_results}} where type = 'page'
union all select cast(query_id as string), max(seq) + 1, {O} || {E}, true from {{v_search_results}} group by query_id"""


def _citations(spark, sf):
    updates = spark.sql(UPDATES, v_search_results=view(spark, sf, "v_search_results"))
    return _drained(spark, S.stream_citations(_streamed(spark, updates)))


def _log(spark, sf):
    path = scratch_folder(spark, "log")
    L.write_event_log(
        _chunks(spark, sf).select(
            F.lit("message_chunk").alias("event"), "thread_id", "seq", F.col("message_id").alias("id"), "role", "content"
        ),
        path,
    )
    fields = "thread_id string, seq bigint, id string, role string, content string"
    events = L.read_event_log(spark, path, streaming=True, files_per_batch=FILES_PER_BATCH).select("event", F.from_json("data", fields).alias("d"))
    return _drained(spark, events.select("event", "d.*"))


QUERIES = {
    "buffer_and_flush": Query(
        _flushed,
        ctes("v_stream_chunks") + """,
chunks as (select cast(thread_id as string) as thread_id, seq, content as message, finish_reason in ('stop', 'interrupt') as ends
           from v_stream_chunks where content <> ''),
counted as (select *, coalesce(sum(case when ends then 1 else 0 end) over (partition by thread_id order by seq
    rows between unbounded preceding and 1 preceding), 0) as flush_no,
  coalesce(max(case when ends then seq end) over (partition by thread_id), -1) as last_end from chunks)
select thread_id, cast(flush_no as bigint) as flush_no, seq, message from counted where seq <= last_end""",
    ),
    "stream_assemble": Query(
        _messages,
        ALIVE_SQL + """, texts as (select thread_id, message_id, any_value(role) as role, any_value(agent) as agent,
    string_agg(content, '' order by seq) as content, max(finish_reason) as finish_reason from alive group by 1, 2)""" + CALLS_OF_MESSAGES + """,
listed as (select thread_id, message_id, string_agg(call_id || ' ' || name || ' ' || args, chr(10) order by pos) as calls from calls group by 1, 2)
select cast(t.thread_id as string) as thread_id, t.message_id, role, agent, content, case when role = 'assistant' then 'because ' end as reasoning,
  finish_reason, finish_reason is null as streaming, coalesce(calls, '') as calls
from texts t left join listed l on t.thread_id = l.thread_id and t.message_id = l.message_id
where finish_reason is not null or t.thread_id in (select thread_id from v_stream_chunks where thread_id % 7 = 0 and seq = 0)""",
    ),
    "stream_citations": Query(
        _citations,
        ctes("v_search_results") + """,
rows as (select query_id, seq, url, case when seq % 4 = 0 then '' else 'title ' || seq end as title, 'd' || seq as description,
    coalesce(score, 0) as s from v_search_results where type = 'page'),
best as (select *, max(s) over (partition by query_id, url order by seq rows between unbounded preceding and 1 preceding) as b from rows),
merged as (select query_id, url, min(seq) as f, arg_max(title, seq) filter (where b is null or title <> '') as title,
    arg_max(description, seq) as description, max(s) as score from best where b is null or s > b group by 1, 2)
select cast(query_id as string) as thread_id, row_number() over (partition by query_id order by f) as position, url, title, description,
  cast(null as string) as snippet, score as relevance_score from merged""",
    ),
    "event_log_stream": Query(
        _log,
        ctes("v_stream_chunks") + """ select 'message_chunk' as event, cast(thread_id as string) as thread_id, seq, message_id as id, role,
  nullif(content, '') as content from v_stream_chunks""",
    ),
}
