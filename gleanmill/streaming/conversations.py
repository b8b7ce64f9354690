"""Conversation streams: buffering, assembling and citation collecting with keyed state.

Each job is a stateful processor per thread in RocksDB that reads its rows one by one and keeps them in state in pages, so
a task holds a page, or one message, and never all rows of a thread. Rows may come in any order inside a micro-batch, also
after the row that ends a conversation; across micro-batches the stream's order counts. The size of a micro-batch is set at
the source (``maxFilesPerTrigger``, ``maxBytesPerTrigger``).

State is cleared when a conversation ends. One that never does is put out after ``idle_ms`` without a row, by a timer on
the clock, with all that waits: nothing expires unseen, and late rows start anew. (A watermark would drop them.) A query
with timers never runs out of batches, so a run over the available input leaves ``idle_ms`` off; WEEK_MS suits a query
that runs for good.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from gleanmill.functions import json_text as jt
from gleanmill.session import ROCKSDB
from gleanmill.sources.tables import write_arrivals

WEEK_MS = 7 * 24 * 3600 * 1000
PAGE = 1_000
ENDS = ("stop", "interrupt")


def _fields(*pairs: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in pairs])


LONG, TEXT = T.LongType(), T.StringType()


def _time_mode(idle_ms: int | None) -> str:
    return "None" if idle_ms is None else "ProcessingTime"


def use_rocksdb(spark: SparkSession) -> None:
    """Stateful processors need the RocksDB provider, set before the query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _Idle(StatefulProcessor):
    """A processor that is told when its thread has been idle for long."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def wait(self, timer_values) -> None:
        """From now on, idle time counts anew."""
        if self.idle_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self.all_that_waits(key)

    def close(self) -> None:
        pass


def _value(state, default):
    return state.get() if state.exists() else default


def _in_pages(rows, append) -> None:
    page = []
    for row in rows:
        page.append(row)
        if len(page) == PAGE:
            append(page)
            page = []
    if page:
        append(page)


FLUSHED = _fields(("thread_id", TEXT), ("flush_no", LONG), ("seq", LONG), ("message", TEXT))


class _Buffer(_Idle):
    """Chunks of a thread wait until its stream ends; then all of them go out and the buffer is empty.

    Two lists take turns: what stays after a flush is written to the other one.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        chunk = _fields(("seq", LONG), ("message", TEXT))
        self.lists = [handle.getListState(f"chunks{i}", chunk) for i in (0, 1)]
        self.place = handle.getValueState("place", _fields(("side", LONG), ("flushes", LONG)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        side, flushes = _value(self.place, (0, 0))
        held, ends = self.lists[side], []

        def chunks():
            for row in rows:
                if row.finish_reason in ENDS:
                    ends.append(row.seq)
                yield row.seq, row.message

        _in_pages(chunks(), held.appendList)
        if ends:
            ends.sort()
            kept = []
            for seq, message in held.get():
                flush = bisect_left(ends, seq)
                if flush < len(ends):
                    yield Row(thread_id=key[0], flush_no=flushes + flush, seq=seq, message=message)
                    continue
                kept.append((seq, message))
                if len(kept) == PAGE:
                    self.lists[1 - side].appendList(kept)
                    kept = []
            if kept:
                self.lists[1 - side].appendList(kept)
            held.clear()
            self.place.update((1 - side, flushes + len(ends)))
        self.wait(timerValues)

    def all_that_waits(self, key) -> Iterator[Row]:
        side, flushes = _value(self.place, (0, 0))
        if self.lists[side].exists():
            for seq, message in self.lists[side].get():
                yield Row(thread_id=key[0], flush_no=flushes, seq=seq, message=message)
        self.lists[side].clear()
        self.place.clear()


def buffer_and_flush(chunks: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Stream of ``(thread_id, seq, message, finish_reason)`` to whole conversations, one row per chunk.

    Chunks without a thread or text are refused. A finish reason of stop or interrupt flushes the thread up to there;
    what comes later starts a new buffer with the next ``flush_no``. Idle threads are flushed as they are, and their
    numbers start again.
    """
    valid = chunks.filter((F.coalesce("thread_id", F.lit("")) != "") & (F.coalesce("message", F.lit("")) != ""))
    return (
        valid.select("thread_id", F.col("seq").cast("bigint"), "message", "finish_reason")
        .groupBy("thread_id")
        .transformWithState(_Buffer(idle_ms), FLUSHED, "Append", _time_mode(idle_ms))
    )


CALL = _fields(("call_id", TEXT), ("name", TEXT), ("args", TEXT))
ASSEMBLED = _fields(
    ("thread_id", TEXT), ("message_id", TEXT), ("first_seq", LONG), ("role", TEXT), ("agent", TEXT), ("content", TEXT),
    ("reasoning", TEXT), ("finish_reason", TEXT), ("streaming", T.BooleanType()), ("options", TEXT), ("calls", T.ArrayType(CALL)),
)
EVENT_TEXTS = ["role", "agent", "content", "reasoning_content", "finish_reason", "options"]
EVENT_LISTS = {
    "tool_calls": "array<struct<id: string, name: string, args: string>>",
    "tool_call_chunks": "array<struct<id: string, index: bigint, args: string>>",
}
BRACKETS = {"&#91;": "[", "&#93;": "]", "&#123;": "{", "&#125;": "}"}


def _unescaped(text: str | None) -> str:
    for code, bracket in BRACKETS.items():
        text = (text or "").replace(code, bracket)
    return text


def fold_calls(events: list[dict]) -> list[Row]:
    """The tool calls of a message out of its events in order.

    The last complete list counts. A chunk with an id starts its call's arguments anew, one without goes on with the first
    call that has arguments by then; once the message is finished they replace the call's own.
    """
    calls: list[list] = []
    texts: dict[int, list[str]] = {}
    for event in events:
        if event["event"] not in EVENT_LISTS:
            continue
        named = event["tool_calls"] if event["event"] == "tool_calls" else None
        if named and named[0]["name"]:
            calls, texts = [[c["id"], c["name"], c["args"]] for c in named], {}
        for chunk in event["tool_call_chunks"] or []:
            if chunk["id"]:
                own = next((i for i, call in enumerate(calls) if call[0] == chunk["id"]), None)
                if own is not None:
                    texts[own] = [_unescaped(chunk["args"])]
            elif texts:
                texts[min(texts)].append(_unescaped(chunk["args"]))
    if any(e["finish_reason"] is not None for e in events):
        for i, parts in texts.items():
            calls[i][2] = jt.args_text("".join(parts))
    return [Row(call_id=c[0], name=c[1], args=c[2]) for c in calls]


def fold_message(thread: str, message: str, events: list[dict]) -> Row | None:
    """The message that its events, in order, make; null without any."""
    calls = fold_calls(events)
    own = [e for e in events if e["event"] != "tool_call_result"]
    if not own:
        return None
    spoken = [e for e in own if e["event"] == "message_chunk"]
    content, reasoning = ("".join(e[n] or "" for e in spoken) for n in ("content", "reasoning_content"))
    first = lambda name: next((e[name] for e in own if e[name] is not None), None)
    finish = next((e["finish_reason"] for e in reversed(own) if e["finish_reason"] is not None), None)
    interrupts = [e for e in own if e["event"] == "interrupt"]
    if finish is not None:
        answers = [jt.field_text(c.args, "message") for c in calls if c.name == "direct_response"]
        content = next((a for a in reversed(answers) if a), content)
    return Row(
        thread_id=thread, message_id=message, first_seq=own[0]["seq"], role=first("role"), agent=first("agent"), content=content,
        reasoning=reasoning or None, finish_reason=finish, streaming=finish is None and not interrupts,
        options=next((e["options"] for e in reversed(interrupts) if e["options"] is not None), None), calls=calls,
    )


class _Assemble(_Idle):
    """Events of a message wait in pages until it finishes, is interrupted, or its thread meets an error.

    After an error nothing of the thread counts: open messages go out with what came before it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.pages = handle.getMapState("pages", _fields(("message_id", TEXT), ("page", LONG)), _fields(("events", TEXT)))
        self.sizes = handle.getMapState("sizes", _fields(("message_id", TEXT)), _fields(("pages", LONG)))
        self.ended = handle.getValueState("ended", _fields(("seq", LONG)))

    def _keep(self, held: dict[str, list[dict]]) -> None:
        for message, events in held.items():
            n = self.sizes.getValue((message,))[0] if self.sizes.containsKey((message,)) else 0
            self.pages.updateValue((message, n), (json.dumps(events),))
            self.sizes.updateValue((message,), (n + 1,))

    def _take(self, thread: str, message: str, end: int | None) -> Iterator[Row]:
        """One message, which is then forgotten."""
        events: list[dict] = []
        for n in range(self.sizes.getValue((message,))[0]):
            events += json.loads(self.pages.getValue((message, n))[0])
            self.pages.removeKey((message, n))
        self.sizes.removeKey((message,))
        events = [e for e in events if end is None or e["seq"] < end]
        events.sort(key=lambda e: e["seq"])
        if (row := fold_message(thread, message, events)) is not None:
            yield row

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = end = _value(self.ended, (None,))[0]
        finished, held, waiting = set(), {}, 0
        for row in rows:
            if end is not None and row.seq >= end:
                continue
            if row.event == "error":
                end = row.seq
                continue
            held.setdefault(row.message_id, []).append(row.asDict(recursive=True))
            if row.event == "interrupt" or (row.finish_reason is not None and row.event != "tool_call_result"):
                finished.add(row.message_id)
            waiting += 1
            if waiting == PAGE:
                self._keep(held)
                held, waiting = {}, 0
        self._keep(held)
        if end != known:
            self.ended.update((end,))
            finished = [k[0] for k in self.sizes.keys()]
        for message in finished:
            yield from self._take(key[0], message, end)
        self.wait(timerValues)

    def all_that_waits(self, key) -> Iterator[Row]:
        end = _value(self.ended, (None,))[0]
        for message in [k[0] for k in self.sizes.keys()]:
            yield from self._take(key[0], message, end)
        self.ended.clear()


def stream_assemble(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Stream of events to messages with their tool calls, put out when finished, interrupted or cut off by an error.

    What a message has by then is what ``assemble_messages`` and ``assemble_calls`` make of the same events; an event that
    comes after its message's end starts a message of the same id anew. Missing event columns count as null.
    """
    wanted = {**dict.fromkeys(EVENT_TEXTS, "string"), **EVENT_LISTS}
    columns = [(F.col(n) if n in events.columns else F.lit(None)).cast(kind).alias(n) for n, kind in wanted.items()]
    kept = events.filter("event <> 'citations' and (event = 'error' or message_id is not null)")
    return (
        kept.select("thread_id", F.col("seq").cast("bigint").alias("seq"), "event", "message_id", *columns)
        .groupBy("thread_id")
        .transformWithState(_Assemble(idle_ms), ASSEMBLED, "Append", _time_mode(idle_ms))
    )


CITATION = ["title", "description", "snippet"]
COLLECTED = _fields(
    ("thread_id", TEXT), ("position", LONG), ("url", TEXT), ("title", TEXT), ("description", TEXT), ("snippet", TEXT),
    ("relevance_score", T.DoubleType()),
)


def with_record(records: list[list], new: list) -> list[list]:
    """Records of a URL, each (place, score, texts) scored above all that come before, with one more row in its place.

    Rows may be added in any order; those that are no record can be forgotten.
    """
    at = bisect_left([r[0] for r in records], new[0])
    if at and records[at - 1][1] >= new[1]:
        return records
    return [*records[:at], new, *(r for r in records[at:] if r[1] > new[1])]


class _Collect(_Idle):
    """Citations of a thread by URL, merged as in merge_by_score, until the thread ends."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.entries = handle.getMapState("entries", _fields(("url", TEXT)), _fields(("records", TEXT)))
        self.waiting = handle.getListState("waiting", _fields(("seq", LONG), ("citations", TEXT)))

    def _merge(self, low: int | None, high: int | None) -> None:
        """Take in what waits between two ends."""
        for seq, citations in self.waiting.get():
            if (low is not None and seq <= low) or (high is not None and seq > high):
                continue
            for at, item in enumerate(map(jt.loads, json.loads(citations))):
                url = item.get("url") if isinstance(item, dict) else None
                if url:
                    old = json.loads(self.entries.getValue((url,))[0]) if self.entries.containsKey((url,)) else []
                    texts = [item.get(n) if isinstance(item.get(n), str) else None for n in CITATION]
                    new = with_record(old, [[seq, at], float(item.get("relevance_score") or 0.0), texts])
                    if new is not old:
                        self.entries.updateValue((url,), (json.dumps(new),))

    def all_that_waits(self, key) -> Iterator[Row]:
        order = sorted((json.loads(records)[0][0], url) for (url,), (records,) in self.entries.iterator())
        for position, (_, url) in enumerate(order, 1):
            records = json.loads(self.entries.getValue((url,))[0])
            texts = records[0][2]
            for _, _, later in records[1:]:
                texts = [new or kept for new, kept in zip(later, texts, strict=True)]
            yield Row(thread_id=key[0], position=position, url=url, **dict(zip(CITATION, texts, strict=True)), relevance_score=records[-1][1])
        self.entries.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        ends = []

        def updates():
            for row in rows:
                if row.ended:
                    ends.append(row.seq)
                if row.citations:
                    yield row.seq, json.dumps(row.citations)

        _in_pages(updates(), self.waiting.appendList)
        low = None
        for high in sorted(ends):
            if self.waiting.exists():
                self._merge(low, high)
            yield from self.all_that_waits(key)
            low = high
        if self.waiting.exists():
            self._merge(low, None)
            self.waiting.clear()
        self.wait(timerValues)


def stream_citations(updates: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Stream of state updates ``(thread_id, seq, data, ended)`` to the citations of each ended (or idle) thread."""
    return (
        updates.select("thread_id", F.col("seq").cast("bigint").alias("seq"), jt.harvest_nested(F.col("data")).alias("citations"), "ended")
        .filter((F.size("citations") > 0) | F.col("ended"))
        .groupBy("thread_id")
        .transformWithState(_Collect(idle_ms), COLLECTED, "Append", _time_mode(idle_ms))
    )


def write_stream(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start the stream into ``path``, one directory per micro-batch; a repeated batch replaces itself."""
    use_rocksdb(stream.sparkSession)
    writer = (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .outputMode("append")
        .foreachBatch(lambda batch, batch_id: write_arrivals(batch, batch_id, path))
    )
    return writer.trigger(availableNow=True).start() if once else writer.start()
