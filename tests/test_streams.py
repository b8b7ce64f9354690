"""Streams over several files and over a restart give what one batch gives."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from gleanmill.functions import json_text as jt
from gleanmill.operators.citations import merge_by_score
from gleanmill.operators import tool_calls as C
from gleanmill.sources.tables import read_arrivals
from gleanmill.streaming import conversations as S

CHUNK = "thread_id string, seq bigint, message string, finish_reason string"
CHUNKS = [
    [("a", 2, "a2", None), ("a", 1, "a1", None), ("b", 1, "b1", "stop"), ("", 1, "no", "stop"), ("a", 3, "", "stop")],
    [("a", 4, "a4", "partial"), ("b", 2, "b2", None)],
    [("a", 6, "a6", None), ("a", 5, "a5", "interrupt"), ("b", 3, "b3", "stop"), ("c", 1, "never", None)],
]


class Arriving:
    """A directory of files that arrive one after the other, read one file per micro-batch."""

    def __init__(self, spark, root, schema):
        self.spark, self.root, self.schema, self.n = spark, root, schema, 0
        (root / "in").mkdir()

    def add(self, rows):
        import os

        self.n += 1
        part = self.root / f"part{self.n}"
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.json(str(part))
        file = next(part.glob("*.json"))
        target = self.root / "in" / f"{self.n:04d}.json"
        target.write_bytes(file.read_bytes())
        os.utime(target, (1_700_000_000 + self.n, 1_700_000_000 + self.n))

    def run(self, job):
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).json(str(self.root / "in"))
        S.write_stream(job(stream), str(self.root / "out"), str(self.root / "check")).awaitTermination(120)
        return read_arrivals(self.spark, str(self.root / "out")).drop("batch_id")


def test_buffer_and_flush_over_files_and_restart(spark, tmp_path, table):
    log = Arriving(spark, tmp_path, CHUNK)
    log.add(CHUNKS[0])
    log.add(CHUNKS[1])
    assert table(log.run(S.buffer_and_flush)) == [("b", 0, 1, "b1")]
    log.add(CHUNKS[2])
    assert table(log.run(S.buffer_and_flush)) == [
        ("a", 0, 1, "a1"), ("a", 0, 2, "a2"), ("a", 0, 4, "a4"), ("a", 0, 5, "a5"), ("b", 0, 1, "b1"), ("b", 1, 2, "b2"), ("b", 1, 3, "b3"),
    ]


def test_repeated_micro_batch_counts_once(spark, tmp_path):
    batch = spark.createDataFrame([("a",)], "x string")
    for _ in range(2):
        S.write_arrivals(batch, 7, str(tmp_path / "out"))
    assert read_arrivals(spark, str(tmp_path / "out")).count() == 1


def test_a_thread_larger_than_a_page_and_a_batch(spark, tmp_path, table, monkeypatch):
    """Rows of a thread come in several files and in no order inside them; ends lie inside a file."""
    rng, n = random.Random(2), 5_000
    rows = [("hot", i, f"m{i}", "stop" if i in (1_700, 1_702, 4_200) else None) for i in range(n)]
    log = Arriving(spark, tmp_path, CHUNK)
    for start in range(0, n, 2_000):
        part = rows[start : start + 2_000]
        log.add(rng.sample(part, len(part)))
    want = sorted(("hot", 0 if i <= 1_700 else 1 if i <= 1_702 else 2, i, f"m{i}") for i in range(4_201))
    assert table(log.run(S.buffer_and_flush)) == want


def test_idle_threads_are_put_out_not_dropped(spark, tmp_path):
    log = Arriving(spark, tmp_path, CHUNK)
    log.add([("a", 1, "a1", None), ("a", 2, "a2", None), ("b", 1, "b1", "stop")])
    stream = spark.readStream.schema(log.schema).json(str(tmp_path / "in"))
    query = S.write_stream(S.buffer_and_flush(stream, idle_ms=500), str(tmp_path / "out"), str(tmp_path / "check"), once=False)
    want, found, late = {("a", 0, 1, "a1"), ("a", 0, 2, "a2"), ("b", 0, 1, "b1")}, set(), time.time() + 90
    try:
        while found != want and time.time() < late:
            time.sleep(0.5)
            assert query.isActive
            try:
                found = {tuple(r) for r in read_arrivals(spark, str(tmp_path / "out")).drop("batch_id").collect()}
            except Exception:  # nothing, or half a batch, is there yet
                continue
    finally:
        query.stop()
    assert found == want


EVENT = """thread_id string, seq bigint, event string, message_id string, role string, agent string, content string, reasoning_content string,
 finish_reason string, tool_calls array<struct<id: string, name: string, args: string>>,
 tool_call_chunks array<struct<id: string, index: bigint, args: string>>, options string"""


def conversation(rng, thread):
    """Random messages with calls, whose arguments come in pieces; some are interrupted, some threads fail or never end."""
    seq, out = 0, []

    def add(event, message, **values):
        nonlocal seq
        seq += rng.randrange(1, 4)
        row = {"role": None, "agent": None, "content": None, "reasoning_content": None, "finish_reason": None, "tool_calls": None, "tool_call_chunks": None, "options": None}
        out.append((thread, seq, event, message, *{**row, **values}.values()))

    for k in range(rng.randrange(1, 6)):
        message = f"{thread}-{k}"
        for _ in range(rng.randrange(0, 4)):
            add("message_chunk", message, role=rng.choice([None, "assistant"]), agent="x", content=rng.choice([None, "", "text ", "[é]"]), reasoning_content=rng.choice([None, "why "]))
        for _ in range(rng.randrange(0, 3)):
            names = rng.sample(["f", "g", "direct_response", ""], 3)
            calls = [(f"{message}c{i}", name, rng.choice(["", "given", '{"message": "said"}'])) for i, name in enumerate(names)]
            add("tool_calls", message, tool_calls=calls, tool_call_chunks=[(calls[0][0], 0, "&#123;")] if rng.random() < 0.5 else None)
            for _ in range(rng.randrange(0, 4)):
                pieces = [(rng.choice([None, None, "", f"{message}c1", "unknown"]), rng.randrange(3), rng.choice(['"message": ', '"a', 'b"', "&#125;", "{"])) for _ in range(rng.randrange(1, 4))]
                add("tool_call_chunks", message, tool_call_chunks=pieces)
        if rng.random() < 0.3:
            add("citations", message, finish_reason="no")
        if rng.random() < 0.12:
            add("error", None)
        ending = rng.random()
        if ending < 0.6:
            add("message_chunk", message, content="end", finish_reason=rng.choice(["stop", "tool_calls"]))
        elif ending < 0.8:
            add("interrupt", message, finish_reason=rng.choice([None, "interrupt"]), options=rng.choice([None, '["yes"]']))
    return out


def test_assembling_a_stream_equals_assembling_a_table(spark, tmp_path):
    rng = random.Random(11)
    threads = [conversation(rng, f"t{i}") for i in range(40)]
    log = Arriving(spark, tmp_path, EVENT)
    for part in range(3):  # every thread goes on in each file, in order from file to file
        log.add([row for t in threads for row in rng.sample(t[part * len(t) // 3 : (part + 1) * len(t) // 3], len(t) * (part + 1) // 3 - len(t) * part // 3)])
    got = {(r.thread_id, r.message_id): r for r in log.run(S.stream_assemble).collect()}
    events = spark.createDataFrame([r for t in threads for r in t], EVENT)
    calls = C.assemble_calls(events)
    by_message = {}
    for r in calls.collect():
        by_message.setdefault((r.thread_id, r.message_id), []).append((r.pos, r.call_id, r.name, r.args))
    failed = {r[0] for t in threads for r in t if r[2] == "error"}
    seen = set()
    for r in C.assemble_messages(events, calls).collect():
        key = r.thread_id, r.message_id
        if r.streaming and r.thread_id not in failed:
            assert key not in got
            continue
        seen.add(key)
        for name in ("first_seq", "role", "agent", "content", "reasoning", "finish_reason", "streaming", "options"):
            assert got[key][name] == r[name], (key, name)
        assert [tuple(c) for c in got[key].calls] == [c[1:] for c in sorted(by_message.get(key, []))], key
    assert seen == got.keys() and len(seen) > 60 and any(r.streaming for r in got.values()) and any(r.options for r in got.values())


@pytest.mark.parametrize("order", list(itertools.permutations(range(4))))
def test_records_may_come_in_any_order(order):
    rows = [[[1, 0], 0.5, ["a"]], [[2, 0], 0.5, ["b"]], [[3, 0], 0.9, ["c"]], [[4, 0], 0.7, ["d"]]]
    found = []
    for i in order:
        found = S.with_record(found, rows[i])
    assert found == [rows[0], rows[2]]


def test_citations_stream_equals_batch_merge(spark, tmp_path, table):
    updates = [
        [("t", 1, '{"a": {"citations": [{"url": "u", "title": "one", "relevance_score": 0.5}, {"url": "v", "title": "v"}]}}', False)],
        [("t", 2, '{"citations": [{"url": "u", "title": "", "description": "d", "relevance_score": 0.9}]}', False), ("x", 1, '{"citations": [{"url": "open"}]}', False)],
        [("t", 3, '{"citations": [{"url": "u", "title": "low", "relevance_score": 0.7}]}', False), ("t", 4, "{}", True)],
    ]
    log = Arriving(spark, tmp_path, "thread_id string, seq bigint, data string, ended boolean")
    for part in updates:
        log.add(part)
    got = table(log.run(S.stream_citations), "url", "title", "description", "relevance_score")
    rows = spark.createDataFrame([r for p in updates for r in p if r[0] == "t"], log.schema)
    items = rows.select("thread_id", (F.col("seq") * 10).alias("s"), F.posexplode(jt.harvest_nested(F.col("data"))).alias("p", "c"))
    field = {n: F.get_json_object("c", f"$.{n}") for n in ("url", "title", "description", "snippet")}
    flat = items.select("thread_id", (F.col("s") + F.col("p")).alias("seq"), *[c.alias(n) for n, c in field.items()],
                        F.get_json_object("c", "$.relevance_score").cast("double").alias("relevance_score"))
    assert got == table(merge_by_score(flat), "url", "title", "description", "relevance_score")
    assert got == [("u", "one", "d", 0.9), ("v", "v", None, 0.0)]
