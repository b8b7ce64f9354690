"""Tool calls and streamed messages: putting fragments together again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanmill.functions import json_text as jt
from gleanmill.functions import text as tx
from gleanmill.operators.ordering import joined_text, prior_max

MESSAGE = ["thread_id", "message_id"]


def assemble_tool_calls(chunks: DataFrame) -> DataFrame:
    """Calls of each message out of chunks ``(message_id, seq, idx, call_id, name, type, args)``.

    Chunks of one index are one call: first id, first name and the first chunk's type, arguments in order,
    brackets escaped. Chunks without an index stand for themselves, before the others: order the calls of a
    message by ``(part, place)``.
    """
    indexed = chunks.filter(F.col("idx").isNotNull())
    grouped = joined_text(
        indexed, ["message_id", "idx"], "seq", {"args": F.col("args")},
        firsts={
            "call_id": tx.filled(F.col("call_id")), "name": tx.filled(F.col("name")), "type": F.coalesce("type", F.lit("")),
        },
    )
    blank = F.lit("")
    calls = grouped.select(
        "message_id", F.lit(1).alias("part"), F.col("idx").cast("bigint").alias("place"), F.col("idx").cast("bigint").alias("idx"),
        F.coalesce("call_id", blank).alias("call_id"), F.coalesce("name", blank).alias("name"), "type",
        tx.escape_brackets(F.col("args")).alias("args"),
    )
    single = chunks.filter(F.col("idx").isNull()).select(
        "message_id", F.lit(0).alias("part"), F.col("seq").alias("place"), F.lit(0).cast("bigint").alias("idx"),
        F.coalesce("call_id", blank).alias("call_id"), F.coalesce("name", blank).alias("name"),
        F.coalesce("type", blank).alias("type"), tx.escape_brackets(F.col("args")).alias("args"),
    )
    return calls.unionByName(single)


def match_tool_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Add ``result`` to calls ``(thread_id, seq, message_id, call_id, …)``; a pending call has null.

    A result belongs to the latest message that holds its call; of several results the last counts. Results
    without a call are dropped.
    """
    key = ["thread_id", "call_id"]
    holder = calls.groupBy(*key).agg(F.max("seq").alias("seq"))
    last = results.groupBy(*key).agg(F.max_by("content", "seq").alias("result"))
    return calls.join(holder.join(last, key), [*key, "seq"], "left")


TOOL_KINDS = ["web_search", "crawl_tool", "python_repl_tool", "local_search_tool"]


def tool_call_ledger(calls: DataFrame) -> DataFrame:
    """Every call with its kind; calls whose result is an error are left out."""
    failed = F.coalesce(F.col("result").startswith("Error"), F.lit(False))
    return calls.filter(~failed).withColumn("kind", F.when(F.col("name").isin(TOOL_KINDS), F.col("name")).otherwise("other"))


def search_usage(messages: DataFrame, calls: DataFrame) -> DataFrame:
    """Per run: was ``web_search`` named by any message or called by any tool call?

    ``messages(run_id, name)``, ``calls(run_id, name)``.
    """
    both = messages.select("run_id", "name").unionByName(calls.select("run_id", "name"))
    return both.groupBy("run_id").agg(F.bool_or(F.coalesce("name", F.lit("")) == "web_search").alias("searched"))


def before_errors(events: DataFrame) -> DataFrame:
    """Events of each thread up to its first ``error`` event."""
    errors = events.filter("event = 'error'").groupBy("thread_id").agg(F.min("seq").alias("_end"))
    return events.join(errors, "thread_id", "left").filter(F.col("_end").isNull() | (F.col("seq") < F.col("_end"))).drop("_end")


def _call_args(calls: DataFrame, chunks: DataFrame, by_index: bool) -> DataFrame:
    """Streamed argument text per call: ``thread_id, message_id, pos, streamed``.

    ``calls(…, pos, call_id, _since)``, ``chunks(…, ord, seq, chunk_id, idx, args)``. A chunk with an id
    starts its call's arguments anew; one without goes on with the first call, by position, that has
    arguments by then (or, by index, with the call its index names).
    """
    places = calls.groupBy(*MESSAGE, F.col("call_id").alias("chunk_id")).agg(
        F.min("pos").alias("pos"), F.min("_since").alias("_after")
    )
    since = calls.groupBy(*MESSAGE).agg(F.max("_since").alias("_since"))
    live = chunks.join(since, MESSAGE).filter(F.col("seq") >= F.col("_since"))
    placed = live.join(places, [*MESSAGE, "chunk_id"], "left")
    known = placed.filter(F.col("chunk_id").isNull() | F.col("pos").isNotNull())
    if by_index:
        owned = known.withColumn("owner", F.coalesce("pos", "idx"))
    else:
        owned = prior_max(known, MESSAGE, "ord", -F.col("pos"), "_first").withColumn(
            "owner", F.coalesce("pos", -F.col("_first"))
        )
    owned = owned.filter(F.col("owner").isNotNull())
    restarts = owned.filter("chunk_id is not null").groupBy(*MESSAGE, "owner").agg(F.max("ord").alias("_start"))
    fresh = owned.join(restarts, [*MESSAGE, "owner"], "left").filter(
        F.col("_start").isNull() | (F.col("ord") >= F.col("_start"))
    )
    texts = joined_text(fresh, [*MESSAGE, "owner"], "ord", {"streamed": tx.unescape_brackets(F.col("args"))})
    return texts.withColumnRenamed("owner", "pos")


def assemble_calls(events: DataFrame, by_index: bool = False) -> DataFrame:
    """Tool calls of each message out of its events: ``thread_id, message_id, pos, call_id, name, args``.

    Events carry ``tool_calls`` and ``tool_call_chunks`` arrays. The last complete list of calls counts;
    arguments streamed since then replace its own once the message is finished.
    """
    alive = before_errors(events)
    lists = alive.filter(
        (F.col("event") == "tool_calls") & (F.coalesce(F.try_element_at("tool_calls", F.lit(1))["name"], F.lit("")) != "")
    )
    final = lists.groupBy(*MESSAGE).agg(F.max_by("tool_calls", "seq").alias("calls"), F.max("seq").alias("_since"))
    calls = final.select(*MESSAGE, "_since", F.posexplode("calls").alias("pos", "c")).select(
        *MESSAGE, "_since", "pos", F.col("c.id").alias("call_id"), "c.name", "c.args"
    )
    chunks = alive.filter(F.col("event").isin("tool_calls", "tool_call_chunks")).select(
        *MESSAGE, "seq", F.posexplode("tool_call_chunks").alias("at", "k")
    ).select(
        *MESSAGE, "seq", F.struct("seq", "at").alias("ord"), tx.filled(F.col("k.id")).alias("chunk_id"),
        F.col("k.index").alias("idx"), F.col("k.args").alias("args"),
    )
    finished = alive.filter(
        F.col("finish_reason").isNotNull() & ~F.col("event").isin("citations", "error")
    ).select(*MESSAGE).distinct().withColumn("_done", F.lit(True))
    streamed = _call_args(calls, chunks, by_index)
    joined = calls.join(streamed, [*MESSAGE, "pos"], "left").join(finished, MESSAGE, "left")
    replaced = F.col("_done") & F.col("streamed").isNotNull()
    parsed = joined.withColumn("_text", F.when(replaced, F.col("streamed")))
    args = F.when(F.col("_text").isNotNull(), jt.parse_streamed_args(F.col("_text"))).otherwise(F.col("args"))
    return parsed.select(*MESSAGE, "pos", "call_id", "name", args.alias("args"))


def assemble_messages(events: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """One row per message out of its stream of events: content, reasoning, finish reason, still streaming.

    Texts are concatenated in order, per block of events first. What follows an ``error`` event of the
    thread is ignored. Events with a column ``options`` give the options of the message's last interrupt. With ``calls`` (assemble_calls), the message of a ``direct_response`` call replaces
    the content.
    """
    alive = before_errors(events).filter(~F.col("event").isin("citations", "error", "tool_call_result"))
    spoken = F.col("event") == "message_chunk"

    def said(name: str) -> Column:
        return F.when(spoken, F.coalesce(name, F.lit("")))

    joined = joined_text(
        alive, MESSAGE, "seq", {"content": said("content"), "reasoning": said("reasoning_content")},
        firsts={"first_seq": F.col("seq"), "role": F.col("role"), "agent": F.col("agent")},
        lasts={
            "finish_reason": F.col("finish_reason"),
            "_interrupted": F.when(F.col("event") == "interrupt", F.lit(True)),
            **({"options": F.when(F.col("event") == "interrupt", F.col("options"))} if "options" in events.columns else {}),
        },
    )
    messages = joined.select(
        *MESSAGE, "first_seq", "role", "agent", F.coalesce("content", F.lit("")).alias("content"),
        tx.filled(F.col("reasoning")).alias("reasoning"), "finish_reason",
        (F.col("finish_reason").isNull() & F.col("_interrupted").isNull()).alias("streaming"),
        *(["options"] if "options" in events.columns else []),
    )
    if calls is None:
        return messages
    direct = (
        calls.filter("name = 'direct_response'")
        .select(*MESSAGE, "pos", tx.filled(F.get_json_object("args", "$.message")).alias("_message"))
        .groupBy(*MESSAGE)
        .agg(F.max_by("_message", F.when(F.col("_message").isNotNull(), F.col("pos"))).alias("_message"))
    )
    answered = messages.join(direct, MESSAGE, "left")
    replaced = F.when(F.col("finish_reason").isNotNull(), F.col("_message"))
    return answered.withColumn("content", F.coalesce(replaced, "content")).drop("_message")
