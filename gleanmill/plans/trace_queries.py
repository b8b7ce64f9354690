"""Agent-trace queries and their SQL twins. Conversations double as threads, users as plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanmill.functions import constants as K
from gleanmill.operators import messages as M
from gleanmill.operators import research as R
from gleanmill.operators import tool_calls as C
from gleanmill.plans.registry import Query
from gleanmill.plans.text_queries import TOKENS
from gleanmill.plans.views import ctes, view

O, E = "chr(123)", "chr(125)"


def _messages(spark, sf):
    return view(spark, sf, "v_messages")


def _steps(spark, sf):
    return view(spark, sf, "v_plan_steps")


def _long(*names):
    return [F.col(n).cast("bigint").alias(n) for n in names]


BASE = ctes("v_messages")
SPEAKERS = """select message_id, case seq % 5 when 0 then upper(role) when 1 then '' when 2 then null when 3 then 'human' else role end as role,
  case when seq % 2 = 0 then upper(agent) else agent end as name from {v_messages}"""
NAMES = ", ".join(f"'{n}'" for n in K.ASSISTANT_NAMES)


def _speakers(spark, sf):
    rows = spark.sql(SPEAKERS, v_messages=_messages(spark, sf))
    typed = M.is_user_typed(F.when(F.col("role") == "human", "human"), F.col("name"), F.col("role"), F.lit(None).cast("string"))
    return rows.select("message_id", M.is_user(F.col("role"), F.col("name")).alias("is_user"), typed.alias("is_user_typed"))


USERS = """, users as (select *, lag(content) over (partition by thread_id order by seq) as before from v_messages
  where role = 'user' and content <> ''),
history as (select thread_id, row_number() over (partition by thread_id order by seq) as item_no, content from users
            where before is null or before <> content)
"""


def _history(spark, sf):
    """Repeated user texts come from reading each conversation twice; silent threads have only a topic."""
    threads = view(spark, sf, "documents").select(
        (F.col("doc_id") + 1000000).alias("thread_id"),
        F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(""), F.col("source"), F.col("lang"))).alias("fallback"),
        F.concat(F.lit(" "), "lang", F.lit(" ")).alias("topic"),
    )
    return M.clarification_history(_messages(spark, sf), threads).select("thread_id", *_long("item_no"), "content")


def _needs(spark, sf):
    rows = view(spark, sf, "events")
    n = F.col("event_id")
    return rows.select(
        "event_id",
        M.needs_clarification(n % 2 == 0, F.when(n % 7 != 0, n % 5), n % 3 == 0, F.when(n % 11 != 0, F.lit(2))).alias("needed"),
    )


CHUNKS = """select message_id, seq, case when piece % 7 = 6 then null else idx end as idx,
  case when piece = 1 then '' else call_id end as call_id, case when piece = 4 then 'late_name' else name end as name,
  case when piece = 0 then 'function' end as type, case when piece % 2 = 0 then '[' || args || ']' else args end as args from {v_tool_chunks}"""


def _assembled(spark, sf):
    return C.assemble_tool_calls(spark.sql(CHUNKS, v_tool_chunks=view(spark, sf, "v_tool_chunks"))).select(
        "message_id", *_long("part", "place", "idx"), "call_id", "name", "type", "args"
    )


ESCAPED = "replace(replace(replace(replace({}, '[', '&#91;'), ']', '&#93;'), '{{', '&#123;'), '}}', '&#125;')"

# Calls: the named fragments; each id is held by two messages, so that the latest must be found.
CALLS = """select thread_id, seq, message_id, 'call-' || cast(cast(floor(seq / 2000000) as bigint) as string) || '-' || idx as call_id, name, idx as pos
  from {v_tool_chunks} where call_id is not null"""
RESULTS = """select thread_id, seq + 5 as seq, 'call-' || cast(cast(floor(seq / 2000000) as bigint) as string) || '-' || (piece % 4) as call_id,
  case when piece % 5 = 3 then 'Error: no' else content end as content from {v_stream_chunks} where role = 'assistant'"""


def _matched(spark, sf):
    calls = spark.sql(CALLS, v_tool_chunks=view(spark, sf, "v_tool_chunks"))
    results = spark.sql(RESULTS, v_stream_chunks=view(spark, sf, "v_stream_chunks"))
    return C.match_tool_results(calls, results).select("thread_id", "seq", "message_id", "call_id", "name", *_long("pos"), "result")


CALLS_SQL = ctes("v_stream_chunks", "v_tool_chunks") + f""",
calls as ({CALLS.format(v_tool_chunks='v_tool_chunks')}), results as ({RESULTS.format(v_stream_chunks='v_stream_chunks')}),
held as (select *, max(seq) over (partition by thread_id, call_id) as holder from calls),
last as (select thread_id, call_id, arg_max(content, seq) as result from results group by 1, 2),
matched as (select h.thread_id, h.seq, h.message_id, h.call_id, h.name, h.pos, case when h.seq = h.holder then l.result end as result
            from held h left join last l using (thread_id, call_id))
"""

# Events: every piece of text, and three tool calls per assistant message whose arguments come in pieces.
CALL_LIST = """array(named_struct('id', message_id || ':0', 'name', 'web_search', 'args', ''), named_struct('id', message_id || ':1', 'name',
  'crawl_tool', 'args', 'as given'), named_struct('id', message_id || ':2', 'name', 'local_search_tool', 'args', ''))"""
CALL_TYPE = "array<struct<id: string, name: string, args: string>>"
CHUNK_TYPE = "array<struct<id: string, index: bigint, args: string>>"
EVENTS = f"""select thread_id, seq * 4 as seq, 'message_chunk' as event, message_id, role, agent, content,
    case when role = 'assistant' and piece = 0 then 'because ' end as reasoning_content, finish_reason,
    cast(null as {CALL_TYPE}) as tool_calls, cast(null as {CHUNK_TYPE}) as tool_call_chunks from {{v_stream_chunks}}
union all select thread_id, seq * 4 - 1, 'tool_calls', message_id, role, agent, null, null, null, {CALL_LIST}, cast(null as {CHUNK_TYPE})
  from {{v_stream_chunks}} where role = 'assistant' and piece = 0
union all select thread_id, seq * 4 - 1, 'tool_call_chunks', message_id, role, agent, null, null, null, cast(null as {CALL_TYPE}),
  array(named_struct('id', case when piece in (1, 2) then message_id || ':' || (piece - 1) end, 'index', cast(0 as bigint),
    'args', case when piece in (1, 2) then '&#91;' || piece else ', ' || piece end))
  from {{v_stream_chunks}} where role = 'assistant' and piece > 0
union all select thread_id, 3 * 4000000 + 10, 'error', 'none', null, null, null, null, null, cast(null as {CALL_TYPE}),
  cast(null as {CHUNK_TYPE}) from {{v_stream_chunks}} where thread_id % 7 = 0 and seq = 0"""


def _events(spark, sf):
    return spark.sql(EVENTS, v_stream_chunks=view(spark, sf, "v_stream_chunks"))


def _assembled_messages(spark, sf):
    return C.assemble_messages(_events(spark, sf)).select(
        "thread_id", "message_id", "role", "agent", "content", "reasoning", "finish_reason", "streaming"
    )


ALIVE_SQL = ctes("v_stream_chunks") + """,
alive as (select * from v_stream_chunks where thread_id % 7 <> 0 or seq * 4 < 12000010),
called as (select * from v_stream_chunks where thread_id % 7 <> 0 or seq * 4 - 1 < 12000010)
"""

CALLS_OF_MESSAGES = f""", firsts as (select thread_id, message_id, max(piece) as p, max(finish_reason) is not null as done from called
            where role = 'assistant' group by 1, 2),
ended as (select thread_id, message_id from alive where finish_reason is not null),
numbers as (select thread_id, message_id, string_agg(piece, ', ' order by piece) filter (where piece = 1 or piece > 2) as own
  from called where role = 'assistant' group by 1, 2),
calls as (select f.thread_id, f.message_id, c.pos, f.message_id || ':' || c.pos as call_id, c.name,
  case when e.message_id is not null and c.pos = 0 and p >= 1 then {O} || '"_parsed": [' || own || ']' || {E}
       when e.message_id is not null and c.pos = 1 and p >= 2 then {O} || '"_parsed": [2]' || {E} else c.args end as args
from firsts f join numbers n using (thread_id, message_id) left join ended e using (thread_id, message_id)
cross join (values (0, 'web_search', ''), (1, 'crawl_tool', 'as given'), (2, 'local_search_tool', '')) as c(pos, name, args))"""

SESSIONS = """, ranked as (select *, coalesce(sum(case when agent = 'reporter' and finish_reason is not null then 1 else 0 end) over (
    partition by thread_id order by seq rows between unbounded preceding and 1 preceding), 0) + 1 as session_no
  from v_messages where agent in ('coder', 'reporter', 'researcher', 'analyst')),
sessions as (select thread_id, session_no, arg_min(message_id, seq) as session_id, min(seq) as first_seq,
    arg_max(message_id, seq) filter (where agent = 'reporter') as report_id, count(*) as activities from ranked group by 1, 2),
started as (select s.*, (select arg_max(m.message_id, m.seq) from v_messages m where m.thread_id = s.thread_id and m.seq < s.first_seq
      and m.agent = 'planner') as plan_id,
    coalesce((select arg_max(m.content, m.seq) from v_messages m where m.thread_id = s.thread_id and m.seq < s.first_seq
      and m.role = 'user' and m.content <> ''), '') as query from sessions s)
"""

# Context: conversation turns, the system ones read as tool answers with long raw content.
CONTEXT = f"""select thread_id, seq, case role when 'user' then 'human' when 'assistant' then 'ai' else 'tool' end as type,
  case when role = 'system' then 'web_search' end as name,
  case when role = 'system' then '[' || {O} || '"title": "t", "raw_content": "' || repeat(replace(replace(content, chr(34), ''), chr(10), ' '), 40)
    || '"' || {E} || ']' else content end as content from {{v_messages}}"""
SHORT = f"""'[' || {O} || '"title": "t", "raw_content": "' || substring(repeat(replace(replace(content, chr(34), ''), chr(10), ' '), 40), 1, 1024)
    || '"' || {E} || ']'"""
LIMIT, PREFIX = 500, 1


def _context(mode):
    def build(spark, sf):
        rows = spark.sql(CONTEXT, v_messages=_messages(spark, sf))
        return M.compress_context(rows, LIMIT, PREFIX, mode).select("thread_id", "position", "seq", "type", "content", "tokens")

    return build


def _tokens(content: str) -> str:
    factor = "case type when 'ai' then 1.2e0 when 'tool' then 1.3e0 else 1.0e0 end"
    return f"cast(greatest(floor(({TOKENS.format(content)} + length(type) // 4) * {factor}), 1) as bigint)"


CONTEXT_SQL = BASE + f""",
given as ({CONTEXT.format(v_messages='v_messages')}),
counted as (select g.*, {_tokens('g.content')} as t, case when type = 'tool' and length(g.content) >= 2048
    and length(repeat(replace(replace(v.content, chr(34), ''), chr(10), ' '), 40)) > 1024 then {SHORT.replace('content,', 'v.content,', 2)} else g.content end as short
  from given g join v_messages v using (thread_id, seq)),
marked as (select *, sum(t) over (partition by thread_id) > {LIMIT} as over from counted),
shrunk as (select thread_id, seq, type, case when over then short else content end as content from marked),
sized as (select *, {_tokens('content')} as tokens, row_number() over (partition by thread_id order by seq) as n,
    count(*) over (partition by thread_id) as cnt from shrunk),
stats as (select *, sum(tokens) over (partition by thread_id) as total, sum(case when n <= {PREFIX} then tokens else 0 end)
    over (partition by thread_id) as kept, max(case when n = cnt then tokens end) over (partition by thread_id) as newest,
    sum(case when n > {PREFIX} then tokens else 0 end) over (partition by thread_id order by seq desc
      rows between unbounded preceding and current row) as tail from sized)
"""

VALUE = f"""case event_id % 5 when 0 then null when 1 then '"' || event_type || '"' when 2 then props when 3 then 'null' else cast(event_id as string) end"""
FEEDBACK = """case event_id % 5 when 0 then ' [edit_plan] ' || props when 1 then '[ACCEPTED] go' when 2 then '' when 3 then 'Ok, ' || event_type else event_type end"""


def _feedback(spark, sf):
    text = F.expr(FEEDBACK)
    return view(spark, sf, "events").select("event_id", M.classify_feedback(text).alias("answer"), M.is_approval(text).alias("approved"))


def _typing(spark, sf):
    n = F.col("event_id")
    kind = F.when(n % 5 == 0, "tool").when(n % 5 == 4, "human").otherwise("ai")
    return view(spark, sf, "events").select(
        "event_id",
        M.event_kind(kind, F.when(n % 5 == 1, 2), F.when(n % 5 < 3, 1)).alias("event"),
        M.agent_name(F.expr("case when event_id % 3 = 0 then event_type || ':' || user_id when event_id % 3 = 1 then event_type end"),
                     F.expr("case when event_id % 2 = 0 then 'node' end")).alias("agent"),
    )


def _plans(spark, sf):
    """All users, and as many ids again that have no steps."""
    users = view(spark, sf, "events").select(F.col("user_id").alias("plan_id")).distinct()
    return users.union(users.select(F.col("plan_id") + 1000000))


def _quiet_steps(spark, sf):
    """Plans of which every other one never searches."""
    return _steps(spark, sf).withColumn("need_search", F.col("need_search") & (F.col("plan_id") % 2 == 0)).withColumn(
        "step_type", F.when((F.col("plan_id") % 4 == 1) & (F.col("step_type") == "research"), None).otherwise(F.col("step_type"))
    )


def _repaired(spark, sf):
    return R.repair_plans(_quiet_steps(spark, sf), _plans(spark, sf), enforce_search=True).select(
        "plan_id", "step_no", "need_search", "step_type", "title"
    )


STEPS = ctes("v_plan_steps")

QUERIES = {
    "classify_speaker": Query(
        _speakers,
        BASE + f""", speakers as ({SPEAKERS.format(v_messages='v_messages')}),
low as (select message_id, lower(coalesce(role, '')) as r, lower(coalesce(name, '')) as n from speakers)
select message_id, r in ('user', 'human') or (r = '' and n not in ({NAMES})) as is_user,
  case when r = 'human' then n not in ({NAMES}) else r = 'user' end as is_user_typed from low""",
    ),
    "latest_user_message": Query(
        lambda spark, sf: M.latest_user_message(_messages(spark, sf)),
        BASE + " select thread_id, arg_max(message_id, seq) as message_id, arg_max(content, seq) as content from v_messages"
        " where role = 'user' and content <> '' group by 1",
    ),
    "clarification_history": Query(
        _history,
        BASE + USERS + """select * from history union all
select doc_id + 1000000, unnest(range(1, 3)), unnest([source, lang]) from documents where doc_id % 2 = 0 union all
select doc_id + 1000000, 1, lang from documents where doc_id % 2 = 1""",
    ),
    "clarified_topic": Query(
        lambda spark, sf: M.clarified_topic(M.clarification_history(_messages(spark, sf))),
        BASE + USERS + """select thread_id, cast(0 as bigint) as part, arg_min(content, item_no) || coalesce(' - ' || string_agg(content, ', ' order by item_no)
  filter (where item_no > 1), '') as topic from history group by 1""",
    ),
    "needs_clarification": Query(
        _needs,
        """select event_id, event_id % 2 = 0 and event_id % 3 <> 0 and coalesce(case when event_id % 7 <> 0 then event_id % 5 end, 0) between 1
  and case when event_id % 11 <> 0 then 2 else 3 end as needed from events""",
    ),
    "assemble_tool_calls": Query(
        _assembled,
        ctes("v_tool_chunks") + f""", chunks as ({CHUNKS.format(v_tool_chunks='v_tool_chunks')}),
grouped as (select message_id, idx, coalesce(arg_min(call_id, seq) filter (where call_id <> ''), '') as call_id,
    coalesce(arg_min(name, seq) filter (where name <> ''), '') as name, arg_min(coalesce(type, ''), seq) as type,
    string_agg(args, '' order by seq) as args from chunks where idx is not null group by 1, 2)
select message_id, 1 as part, idx as place, idx, call_id, name, type, {ESCAPED.format('args')} as args from grouped
union all select message_id, 0, seq, 0, coalesce(call_id, ''), coalesce(name, ''), coalesce(type, ''), {ESCAPED.format('args')}
from chunks where idx is null""",
    ),
    "match_tool_results": Query(_matched, CALLS_SQL + "select thread_id, seq, message_id, call_id, name, pos, result from matched"),
    "tool_call_ledger": Query(
        lambda spark, sf: C.tool_call_ledger(_matched(spark, sf)).select("thread_id", "message_id", "call_id", "kind", "result"),
        CALLS_SQL + """select thread_id, message_id, call_id, case when name in ('web_search', 'crawl_tool', 'python_repl_tool', 'local_search_tool')
  then name else 'other' end as kind, result from matched where not coalesce(starts_with(result, 'Error'), false)""",
    ),
    "search_usage": Query(
        lambda spark, sf: C.search_usage(
            _messages(spark, sf).select(F.col("thread_id").alias("run_id"), F.col("agent").alias("name")),
            view(spark, sf, "v_tool_chunks").filter("name is not null").select(
                F.col("thread_id").alias("run_id"),
                F.when(F.col("thread_id") % 3 == 0, "other").otherwise(F.col("name")).alias("name"),
            ),
        ),
        ctes("v_tool_chunks") + """, named as (select thread_id, agent as name from v_messages union all
  select thread_id, case when thread_id % 3 = 0 then 'other' else name end from v_tool_chunks where name is not null)
select thread_id as run_id, bool_or(coalesce(name, '') = 'web_search') as searched from named group by 1""",
    ),
    "assemble_messages": Query(
        _assembled_messages,
        ALIVE_SQL + """, texts as (select thread_id, message_id, any_value(role) as role, any_value(agent) as agent,
    string_agg(content, '' order by seq) as content, max(finish_reason) as finish_reason from alive group by 1, 2)
select thread_id, message_id, role, agent, content, case when role = 'assistant' then 'because ' end as reasoning, finish_reason,
  finish_reason is null as streaming from texts""",
    ),
    "assemble_calls": Query(
        lambda spark, sf: C.assemble_calls(_events(spark, sf)).select(
            "thread_id", "message_id", *_long("pos"), "call_id", "name", "args"
        ),
        ALIVE_SQL + CALLS_OF_MESSAGES + " select thread_id, message_id, pos, call_id, name, args from calls",
    ),
    "research_sessions": Query(
        lambda spark, sf: R.research_sessions(_messages(spark, sf)).select(
            "thread_id", *_long("session_no"), "session_id", "first_seq", "report_id", "activities"
        ),
        BASE + SESSIONS + "select thread_id, cast(session_no as bigint) as session_no, session_id, first_seq, report_id, activities from sessions",
    ),
    "session_activities": Query(
        lambda spark, sf: R.session_activities(_messages(spark, sf)).select("thread_id", *_long("session_no", "activity_no"), "message_id"),
        BASE + SESSIONS + """select thread_id, cast(session_no as bigint) as session_no, row_number() over (partition by thread_id, session_no
  order by seq) as activity_no, message_id from ranked union all
select thread_id, cast(session_no as bigint), 0, plan_id from started where plan_id is not null""",
    ),
    "plan_and_query": Query(
        lambda spark, sf: R.plan_and_query(_messages(spark, sf)).select("thread_id", *_long("session_no"), "session_id", "plan_id", "query"),
        BASE + SESSIONS + "select thread_id, cast(session_no as bigint) as session_no, session_id, plan_id, query from started",
    ),
    "awaiting_feedback": Query(
        lambda spark, sf: M.awaiting_feedback(_messages(spark, sf)),
        BASE + """, placed as (select *, row_number() over (partition by thread_id order by seq desc) as n,
    lead(message_id) over (partition by thread_id order by seq desc) as before from v_messages)
select thread_id, message_id as interrupt_id, before as feedback_id from placed where n = 1 and before is not null
  and finish_reason = 'interrupt'""",
    ),
    "next_step": Query(
        lambda spark, sf: R.next_step(_steps(spark, sf), _plans(spark, sf)),
        STEPS + """, open as (select plan_id, step_no, step_type from v_plan_steps where coalesce(execution_res, '') = ''
  qualify row_number() over (partition by plan_id order by step_no) = 1),
plans as (select distinct user_id as plan_id from events union all select distinct user_id + 1000000 from events)
select p.plan_id, step_no, case step_type when 'research' then 'researcher' when 'analysis' then 'analyst' when 'processing' then 'coder'
  else 'planner' end as agent from plans p left join open using (plan_id)""",
    ),
    "repair_plans": Query(
        _repaired,
        STEPS + """, quiet as (select plan_id, step_no, title, need_search and plan_id % 2 = 0 as need_search,
    case when plan_id % 4 = 1 and step_type = 'research' then null else step_type end as step_type from v_plan_steps),
typed as (select plan_id, step_no, title, need_search, coalesce(nullif(step_type, ''), case when need_search then 'research' else 'analysis' end)
  as step_type from quiet),
facts as (select plan_id, bool_or(need_search) as has, coalesce(min(step_no) filter (where step_type = 'research'), min(step_no)) as pick
  from typed group by 1)
select plan_id, step_no, need_search or (not has and step_no = pick) as need_search,
  case when not has and step_no = pick then 'research' else step_type end as step_type, title from typed join facts using (plan_id)
union all select distinct user_id + 1000000, 0, true, 'research', 'Initial Research' from events""",
    ),
    "findings_digest": Query(
        lambda spark, sf: R.findings_digest(_steps(spark, sf), 300).select("plan_id", *_long("part"), "digest"),
        STEPS + """, cur as (select plan_id, min(step_no) filter (where coalesce(execution_res, '') = '') as c from v_plan_steps group by 1),
done as (select s.*, row_number() over (partition by plan_id order by step_no) as i from v_plan_steps s join cur using (plan_id)
         where step_no < c),
whole as (select plan_id, '# Completed Research Steps' || chr(10) || chr(10) || string_agg('## Completed Step ' || i || ': ' || title || chr(10) || chr(10)
    || '<finding>' || chr(10) || execution_res || chr(10) || '</finding>' || chr(10) || chr(10), '' order by i) as t from done group by 1)
select plan_id, part, substring(t, part * 300 + 1, 300) as digest from (select *, unnest(range(cast(ceil(length(t) / 300.0) as bigint))) as part from whole)""",
    ),
    "compress_context": Query(
        _context("reference"),
        CONTEXT_SQL + f"""select thread_id, cast(case when total <= {LIMIT} or n <= {PREFIX} then n when kept + newest <= {LIMIT} then {PREFIX + 1}
  else {PREFIX} + cnt - n + 1 end as bigint) as position, seq, type, content, tokens from stats
where total <= {LIMIT} or n <= {PREFIX} or kept + newest > {LIMIT} or n = cnt""",
    ),
    "compress_context_budget": Query(
        _context("budget"),
        CONTEXT_SQL + f"""select thread_id, row_number() over (partition by thread_id order by seq) as position, seq, type, content, tokens
from stats where total <= {LIMIT} or n <= {PREFIX} or kept + tail <= {LIMIT}""",
    ),
    "validate_messages": Query(
        lambda spark, sf: view(spark, sf, "events").select("event_id", M.valid_content(F.expr(VALUE)).alias("content")),
        """select event_id, case event_id % 5 when 1 then event_type when 2 then props when 4 then cast(event_id as string) else '' end
  as content from events""",
    ),
    "classify_feedback": Query(
        _feedback,
        f"""with answers as (select event_id, {FEEDBACK} as t from events)
select event_id, case when starts_with(upper(trim(t)), '[EDIT_PLAN]') then 'edit' when starts_with(upper(trim(t)), '[ACCEPTED]') then 'accepted'
  else 'replan' end as answer, {' or '.join(f"contains(lower(t), '{w}')" for w in K.APPROVAL_WORDS)} as approved from answers""",
    ),
    "event_typing": Query(
        _typing,
        """select event_id, case event_id % 5 when 0 then 'tool_call_result' when 1 then 'tool_calls' when 2 then 'tool_call_chunks'
  when 3 then 'message_chunk' end as event, case when event_id % 3 < 2 then event_type when event_id % 2 = 0 then 'node' else 'unknown' end
  as agent from events""",
    ),
}
