import json

import pytest
from pyspark.sql import functions as F

from gleanmill.operators import messages as M
from gleanmill.operators import research as R
from gleanmill.operators import tool_calls as C

MESSAGE = "thread_id int, seq bigint, message_id string, role string, agent string, content string, finish_reason string"


def thread(spark, *rows):
    return spark.createDataFrame([(1, i, f"m{i}", *r) for i, r in enumerate(rows)], MESSAGE)


def test_speakers(spark):
    cases = [("USER", "x", True), ("human", None, True), ("assistant", None, False), ("", "Planner", False), (None, None, True), ("", "analyst", True), ("tool", None, False)]
    df = spark.createDataFrame([(i, r, n) for i, (r, n, _) in enumerate(cases)], "i int, role string, name string").orderBy("i")
    assert [r[0] for r in df.select(M.is_user(F.col("role"), F.col("name"))).collect()] == [w for *_, w in cases]


def test_history_and_topic(spark, table):
    df = thread(spark, ("user", None, "a", None), ("assistant", "planner", "x", None), ("user", None, "a", None), ("user", None, "", None), ("user", None, "b", None), ("user", None, "a", None))
    threads = spark.createDataFrame([(1, ["no"], "no"), (2, ["", "f"], "t"), (3, None, " t "), (4, [], " ")], "thread_id int, fallback array<string>, topic string")
    history = M.clarification_history(df, threads)
    assert table(history) == [(1, 1, "a"), (1, 2, "b"), (1, 3, "a"), (2, 1, "f"), (3, 1, "t")]
    assert table(M.clarified_topic(history)) == [(1, 0, "a - b, a"), (2, 0, "f"), (3, 0, "t")]
    parts = [t for _, _, t in table(M.clarified_topic(history, 2).filter("thread_id = 1"))]
    assert ", ".join(parts) == "a - b, a"
    assert table(M.latest_user_message(df), "message_id") == [("m5",)]


def test_feedback(outcomes):
    assert outcomes(M.classify_feedback, [" [edit_plan] x", "[Accepted]", "ok", None]) == ["edit", "accepted", "replan", "replan"]
    assert outcomes(M.is_approval, ["Looks OKAY", "no", None, "book"]) == [True, False, False, True]
    assert outcomes(M.valid_content, [None, '"a"', "[1, 2]", "null", "12", "free"]) == ["", "a", "[1, 2]", "", "12", "free"]
    assert outcomes(lambda c: M.valid_content(c, 3), ['"ab  cd"']) == ["ab..."]


def test_awaiting_feedback(spark, table):
    df = thread(spark, ("user", None, "a", None), ("assistant", "planner", "x", "interrupt"))
    assert table(M.awaiting_feedback(df)) == [(1, "m1", "m0")]
    assert table(M.awaiting_feedback(df.filter("seq = 1"))) == []


CONTEXT = "thread_id int, seq bigint, type string, name string, content string"


@pytest.mark.parametrize("mode, limit, want", [("reference", 1000, [0, 1, 2, 3]), ("reference", 35, [0, 3]), ("reference", 15, [0, 3, 2, 1]), ("budget", 35, [0, 2, 3]), ("budget", 15, [0])])
def test_compress_context(spark, mode, limit, want):
    df = spark.createDataFrame([(1, i, "human", None, "x" * 36) for i in range(4)], CONTEXT)
    got = [r.seq for r in M.compress_context(df, limit, 1, mode).orderBy("position").collect()]
    assert got == want


def test_long_search_answers_are_cut_first(spark):
    content = json.dumps([{"url": "é", "raw_content": "r" * 3000}, {"raw_content": 5}], ensure_ascii=False)
    rows = [(1, 0, "tool", "web_search", content), (1, 1, "tool", "other", content), (2, 0, "tool", "web_search", content[:100])]
    got = {(r.thread_id, r.seq): r.content for r in M.compress_context(spark.createDataFrame(rows, CONTEXT), 1500, 0, "budget").collect()}
    assert json.loads(got[1, 0])[0] == {"url": "é", "raw_content": "r" * 1024}
    assert got[1, 1] == content and got[2, 0] == content[:100]


CHUNK = "message_id string, seq bigint, idx int, call_id string, name string, type string, args string"


def test_assemble_tool_calls(spark, table):
    df = spark.createDataFrame(
        [("m", 1, 0, "", "", "f", "{"), ("m", 2, 1, "c1", "n1", None, "x"), ("m", 3, 0, "c0", "n0", "g", '"a"'), ("m", 4, None, "s", "single", None, "[]"), ("m", 5, 0, "c9", "other", None, "}")],
        CHUNK,
    )
    assert table(C.assemble_tool_calls(df), "part", "place", "call_id", "name", "type", "args") == [
        (0, 4, "s", "single", "", "&#91;&#93;"), (1, 0, "c0", "n0", "f", '&#123;"a"&#125;'), (1, 1, "c1", "n1", "", "x"),
    ]


def test_match_results(spark, table):
    calls = spark.createDataFrame([(1, 1, "m1", "c", "web_search"), (1, 2, "m2", "c", "web_search"), (1, 3, "m3", "p", "x")], "thread_id int, seq bigint, message_id string, call_id string, name string")
    results = spark.createDataFrame([(1, 5, "c", "old"), (1, 6, "c", "Error: new"), (1, 7, "zz", "lost")], "thread_id int, seq bigint, call_id string, content string")
    matched = C.match_tool_results(calls, results)
    assert table(matched, "message_id", "result") == [("m1", None), ("m2", "Error: new"), ("m3", None)]
    assert table(C.tool_call_ledger(matched), "message_id", "kind") == [("m1", "web_search"), ("m3", "other")]


EVENT = """thread_id int, seq bigint, event string, message_id string, role string, agent string, content string, reasoning_content string,
 finish_reason string, tool_calls array<struct<id: string, name: string, args: string>>,
 tool_call_chunks array<struct<id: string, index: bigint, args: string>>"""


def events(spark, *rows):
    full = []
    for seq, r in enumerate(rows):
        full.append((1, seq, r.get("event", "message_chunk"), r.get("id", "m"), "assistant", "a", r.get("content"), r.get("why"), r.get("finish"),
                     r.get("calls"), r.get("chunks")))
    return spark.createDataFrame(full, EVENT).repartition(4)


CALLS = [("c0", "direct_response", ""), ("c1", "web_search", "base"), ("c2", "other", "kept")]


def stream(spark, finish="stop"):
    return events(
        spark, {"content": "Hel"}, {"content": "lo", "why": "b"}, {"event": "tool_calls", "calls": CALLS, "chunks": [("c1", 1, "old")]},
        {"event": "tool_call_chunks", "chunks": [(None, 1, "lost"), ("c1", 1, "&#123;"), (None, 1, '"q": "x"')]},
        {"event": "tool_call_chunks", "chunks": [("c0", 0, '&#123;"mess'), ("zz", 3, "no"), (None, 0, 'age": "Direct"&#125;')]},
        {"event": "tool_call_chunks", "chunks": [(None, 1, "} ")]}, {"finish": finish}, {"event": "error"}, {"content": "late"},
    )


def test_stream_arguments_go_to_the_first_call_with_arguments(spark, table):
    got = table(C.assemble_calls(stream(spark)), "pos", "name", "args")
    assert got == [(0, "direct_response", '{"message": "Direct"}'), (1, "web_search", '{"q": "x"}'), (2, "other", "kept")]
    by_index = dict((p, a) for p, a in table(C.assemble_calls(stream(spark), by_index=True), "pos", "args"))
    assert by_index[1] == '{"q": "x"}' and by_index[0] == '{"message": "Direct"}'
    assert table(C.assemble_calls(stream(spark, None)), "pos", "args") == [(0, ""), (1, "base"), (2, "kept")]


def test_assembled_message(spark):
    row = C.assemble_messages(stream(spark)).first()
    assert (row.content, row.reasoning, row.finish_reason, row.streaming) == ("Hello", "b", "stop", False)
    direct = C.assemble_messages(stream(spark), C.assemble_calls(stream(spark))).first()
    assert direct.content == "Direct"
    assert C.assemble_messages(stream(spark, None)).first().streaming
    waiting = C.assemble_messages(events(spark, {"content": "a"}, {"event": "interrupt"})).first()
    assert (waiting.content, waiting.streaming) == ("a", False)


def test_an_event_with_very_many_fragments_stays_together(spark, table):
    """1,500 fragments in one event, more in the next; the order is by event, then by place."""
    parts = [(None, 0, f"{i:04d},") for i in range(1510)]
    df = events(
        spark, {"event": "tool_calls", "calls": [("c", "f", "")], "chunks": [("c", 0, '{"q": "')]}, {"event": "tool_call_chunks", "chunks": parts[:1500]},
        {"event": "tool_call_chunks", "chunks": [*parts[1500:], (None, 0, '"}')]}, {"finish": "stop"},
    )
    assert table(C.assemble_calls(df), "call_id", "args") == [("c", '{"q": "' + "".join(p[2] for p in parts) + '"}')]


def test_options_of_an_interrupt(spark):
    df = events(spark, {"content": "a"}, {"event": "interrupt"}).withColumn("options", F.when(F.col("event") == "interrupt", F.lit('[{"text": "ok"}]')))
    row = C.assemble_messages(df).first()
    assert (row.streaming, row.options) == (False, '[{"text": "ok"}]')


def test_sessions(spark, table):
    df = thread(
        spark, ("user", None, "q1", None), ("assistant", "planner", "p1", None), ("assistant", "researcher", "r", None), ("assistant", "reporter", "r", "stop"),
        ("assistant", "coder", "c", None), ("user", None, "q2", None), ("assistant", "planner", "p2", None), ("assistant", "reporter", "r", None), ("assistant", "analyst", "r", None),
    )
    assert table(R.research_sessions(df), "session_no", "session_id", "report_id", "activities") == [(1, "m2", "m3", 2), (2, "m4", "m7", 3)]
    assert table(R.plan_and_query(df), "session_id", "plan_id", "query") == [("m2", "m1", "q1"), ("m4", "m1", "q1")]
    assert table(R.session_activities(df), "session_no", "activity_no", "message_id") == [
        (1, 0, "m1"), (1, 1, "m2"), (1, 2, "m3"), (2, 0, "m1"), (2, 1, "m4"), (2, 2, "m7"), (2, 3, "m8"),
    ]


STEP = "plan_id int, step_no bigint, need_search boolean, step_type string, title string, execution_res string"


def test_plans(spark, table):
    df = spark.createDataFrame(
        [(1, 0, False, "analysis", "a", "done"), (1, 1, False, "", "b", None), (1, 2, False, "research", "c", "early"), (2, 0, None, "processing", "d", "x"), (3, 5, False, "processing", "e", "")],
        STEP,
    )
    plans = spark.createDataFrame([(1,), (2,), (3,), (4,)], "plan_id int")
    assert table(R.next_step(df, plans), "plan_id", "agent") == [(1, "planner"), (2, "planner"), (3, "coder"), (4, "planner")]
    fixed = R.repair_plans(df, plans, enforce_search=True)
    assert table(R.next_step(fixed.filter("plan_id = 1")), "agent") == [("analyst",)]
    assert table(fixed, "plan_id", "step_no", "need_search", "step_type") == [
        (1, 0, False, "analysis"), (1, 1, False, "analysis"), (1, 2, True, "research"), (2, 0, True, "research"), (3, 5, True, "research"), (4, 0, True, "research"),
    ]
    untouched = R.repair_plans(df, plans, enforce_search=True, search_enabled=False)
    assert untouched.filter("need_search").count() == 0 and untouched.count() == 5
    assert R.findings_digest(df).collect()[0].digest == "# Completed Research Steps\n\n## Completed Step 1: a\n\n<finding>\ndone\n</finding>\n\n"
    assert table(R.findings_digest(df), "plan_id") == [(1,)]
