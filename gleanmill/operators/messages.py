"""Agent conversations: who speaks, what was asked, what fits into a context window.

``messages(thread_id, seq, message_id, role, agent, content, …)`` with ``seq`` unique inside its thread.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanmill.functions import constants as K
from gleanmill.functions import json_text as jt
from gleanmill.functions import text as tx
from gleanmill.operators.ordering import joined_text, last_known, numbered, running_sum

THREAD = ["thread_id"]


def is_user(role: Column, name: Column) -> Column:
    """Speaker rule for plain messages: by role, and without one by the name."""
    said, called = F.lower(F.coalesce(role, F.lit(""))), F.lower(F.coalesce(name, F.lit("")))
    return said.isin("user", "human") | ((said == "") & ~called.isin(K.ASSISTANT_NAMES))


def is_user_typed(kind: Column, name: Column, role: Column, extra_role: Column) -> Column:
    """Speaker rule for typed messages: human by type unless an assistant's name, else by a role given."""
    called = F.lower(F.coalesce(name, F.lit("")))
    user_role = F.lower(F.coalesce(role, F.lit(""))).isin("user", "human") | F.lower(
        F.coalesce(extra_role, F.lit(""))
    ).isin("user", "human")
    return F.when(F.lower(F.coalesce(kind, F.lit(""))) == "human", ~called.isin(K.ASSISTANT_NAMES)).otherwise(user_role)


def _user_rows(messages: DataFrame) -> DataFrame:
    asked = is_user(F.col("role"), F.col("agent")) & (F.coalesce("content", F.lit("")) != "")
    return messages.filter(asked)


def latest_user_message(messages: DataFrame) -> DataFrame:
    """Last non-empty user message per thread."""
    return _user_rows(messages).groupBy(*THREAD).agg(
        F.max_by("message_id", "seq").alias("message_id"), F.max_by("content", "seq").alias("content")
    )


def clarification_history(messages: DataFrame, threads: DataFrame | None = None) -> DataFrame:
    """``thread_id, item_no, content``: what the user said, repeats in a row collapsed.

    Threads without any user text take their ``fallback`` items from ``threads(thread_id, fallback, topic)``,
    else the trimmed topic.
    """
    users = _user_rows(messages).select(*THREAD, "seq", "content")
    new = last_known(users, THREAD, "seq", {"before": F.col("content")}).filter(
        F.col("before").isNull() | (F.col("before") != F.col("content"))
    )
    history = numbered(new.drop("before"), THREAD, "seq", "item_no").select(*THREAD, "item_no", "content")
    if threads is None:
        return history
    silent = threads.join(users.select(*THREAD).distinct(), THREAD, "left_anti")
    given = F.filter(F.coalesce("fallback", F.array().cast("array<string>")), lambda t: F.coalesce(t, F.lit("")) != "")
    topic = tx.strip(F.coalesce("topic", F.lit("")))
    items = F.when(F.size(given) > 0, given).when(topic != "", F.array(topic))
    rest = silent.select(*THREAD, F.posexplode(items).alias("pos", "content"))
    return history.unionByName(rest.select(*THREAD, (F.col("pos") + 1).alias("item_no"), "content"))


def clarified_topic(history: DataFrame, part_rows: int = 10_000) -> DataFrame:
    """The topic of each thread in one line: ``first - second, third``.

    A line comes in parts of consecutive items; the parts in order, joined by a comma and a blank, are the
    line.
    """
    parted = history.withColumn("part", F.floor((F.col("item_no") - 1) / F.lit(part_rows)))
    head = F.when(F.col("item_no") == 1, F.col("content"))
    tail = F.when(F.col("item_no") > 1, F.col("content"))
    joined = joined_text(parted, [*THREAD, "part"], "item_no", {"tail": tail}, ", ", firsts={"head": head})
    return joined.select(*THREAD, "part", F.concat_ws(" - ", "head", tx.filled(F.col("tail"))).alias("topic"))


def needs_clarification(enabled: Column, rounds: Column, complete: Column, max_rounds: Column) -> Column:
    rounds, most = F.coalesce(rounds, F.lit(0)), F.coalesce(max_rounds, F.lit(3))
    return (
        F.coalesce(enabled, F.lit(False)) & (rounds > 0) & ~F.coalesce(complete, F.lit(False)) & (rounds <= most)
    )


def awaiting_feedback(messages: DataFrame) -> DataFrame:
    """Threads of two or more messages whose last one ended in an interrupt, with the message before it."""
    latest = Window.partitionBy(*THREAD).orderBy(F.desc("seq"))
    two = messages.withColumn("_n", F.row_number().over(latest)).filter(F.col("_n") <= 2)

    def of(n: int, column: str) -> Column:
        return F.max_by(column, F.when(F.col("_n") == n, F.lit(1)))

    pairs = two.groupBy(*THREAD).agg(
        of(1, "message_id").alias("interrupt_id"),
        of(1, "finish_reason").alias("_reason"),
        of(2, "message_id").alias("feedback_id"),
        F.count(F.lit(1)).alias("_count"),
    )
    return pairs.filter((F.col("_count") == 2) & (F.col("_reason") == "interrupt")).select(
        *THREAD, "interrupt_id", "feedback_id"
    )


def valid_content(raw: Column, size: int | None = None) -> Column:
    """Text of a content value given as JSON text: null is empty, lists and objects stay JSON; whole unless ``size`` bounds it."""
    value = F.try_parse_json(raw)
    kind = jt.variant_kind(value)
    text = (
        F.when(raw.isNull() | (value.isNotNull() & (kind == "null")), F.lit(""))
        .when(kind == "string", F.try_variant_get(value, "$", "string"))
        .otherwise(raw)
    )
    if size is None:
        return text
    cut = F.concat(tx.rstrip(F.substring(text, 1, size)), F.lit("..."))
    return F.when(F.length(text) > size, cut).otherwise(text)


def classify_feedback(text: Column) -> Column:
    """Answer to a plan: edit, accepted, or replan for anything else."""
    said = F.upper(tx.strip(F.coalesce(text, F.lit(""))))
    return (
        F.when(said.startswith("[EDIT_PLAN]"), "edit").when(said.startswith("[ACCEPTED]"), "accepted").otherwise("replan")
    )


def is_approval(text: Column) -> Column:
    """Answer to a tool request: approved if it contains any word of approval."""
    said = F.lower(tx.strip(F.coalesce(text, F.lit(""))))
    hit = F.lit(False)
    for word in K.APPROVAL_WORDS:
        hit = hit | said.contains(word)
    return hit


def event_kind(kind: Column, calls: Column, chunks: Column) -> Column:
    """Event of a traced message: tool result, complete calls, call chunks or text; other types give none."""
    return (
        F.when(kind == "tool", "tool_call_result")
        .when((kind == "ai") & (F.coalesce(calls, F.lit(0)) > 0), "tool_calls")
        .when((kind == "ai") & (F.coalesce(chunks, F.lit(0)) > 0), "tool_call_chunks")
        .when(kind == "ai", "message_chunk")
    )


def agent_name(namespace: Column, node: Column) -> Column:
    """Agent of a traced message: its namespace up to the colon, else the node, else unknown."""
    return F.coalesce(tx.filled(F.split_part(namespace, F.lit(":"), F.lit(1))), node, F.lit("unknown"))


RAW_SIZE, CHECK_SIZE = 1024, 2048


@F.pandas_udf(T.StringType())
def _short_raw_content(texts: pd.Series) -> pd.Series:
    """Cut the raw content of each search result; a text without a long one stays as it is."""

    def cut(text):
        try:
            items = jt.loads(text)
        except ValueError:
            return text
        long = [
            i for i in items if isinstance(i, dict) and isinstance(i.get("raw_content"), str)
            and len(i["raw_content"]) > RAW_SIZE
        ] if isinstance(items, list) else []
        for item in long:
            item["raw_content"] = item["raw_content"][:RAW_SIZE]
        return jt.dumps(items) if long else text

    return texts.map(cut, na_action="ignore")


def _kept(sized: DataFrame, limit: int, prefix: int, mode: str) -> DataFrame:
    """Which messages stay, and where: ``thread_id, seq, position, tokens`` from ``thread_id, seq, tokens``."""
    placed = numbered(sized, THREAD, "seq", "_n")
    first = F.col("_n") <= prefix
    stats = placed.groupBy(*THREAD).agg(
        F.sum("tokens").alias("_total"),
        F.sum(F.when(first, F.col("tokens")).otherwise(0)).alias("_kept"),
        F.count(F.lit(1)).alias("_count"),
        F.max_by("tokens", "seq").alias("_newest"),
    )
    over = F.col("_total") > limit
    if mode == "reference":
        fits = F.col("_kept") + F.col("_newest") <= limit
        behind = F.when(fits, F.lit(prefix + 1)).otherwise(F.lit(prefix) + F.col("_count") - F.col("_n") + 1)
        position = F.when(~over | first, F.col("_n")).otherwise(behind)
        kept = placed.join(stats, THREAD).filter(~over | first | ~fits | (F.col("_n") == F.col("_count")))
        return kept.select(*THREAD, "seq", position.cast("bigint").alias("position"), "tokens")
    tail = F.when(first, F.lit(0).cast("bigint")).otherwise(F.col("tokens"))
    summed = running_sum(placed, THREAD, "seq", tail, "_sum", newest_first=True).join(stats, THREAD)
    kept = summed.filter(~over | first | (F.col("_kept") + F.col("_sum") <= limit)).select(*THREAD, "seq", "tokens")
    return numbered(kept, THREAD, "seq", "position").withColumn("position", F.col("position").cast("bigint"))


def compress_context(messages: DataFrame, limit: int, prefix: int = 0, mode: str = "reference") -> DataFrame:
    """Shrink the threads above ``limit`` tokens: ``thread_id, position, seq, type, content, tokens``.

    First the raw content in long ``web_search`` answers is cut. Threads still above the limit keep their
    first ``prefix`` messages and, in mode ``budget``, the longest run of newest messages that fits, in order.
    Mode ``reference`` gives the established behaviour: the newest message alone if that fits, otherwise all
    messages, newest first behind the prefix.

    All placing works on token counts. The contents are read again only for the long answers, and to put out what
    stays; nothing is written in between.
    """
    if mode not in ("reference", "budget"):
        raise ValueError(f"unknown mode {mode!r}")
    tokens = tx.message_tokens(F.col("type"), F.col("content"))
    counted = messages.select(*THREAD, "seq", tokens.alias("_tokens"))
    over = counted.groupBy(*THREAD).agg(F.sum("_tokens").alias("_sum")).filter(F.col("_sum") > limit).select(*THREAD)
    long = messages.filter(
        (F.col("type") == "tool") & (F.col("name") == "web_search") & (F.length("content") >= CHECK_SIZE)
    ).join(over, THREAD, "left_semi")
    cut = long.select(*THREAD, "seq", "type", _short_raw_content(F.col("content")).alias("_short")).select(
        *THREAD, "seq", "_short", tx.message_tokens(F.col("type"), F.col("_short")).alias("_fewer")
    )
    sized = counted.join(cut.drop("_short"), [*THREAD, "seq"], "left").select(
        *THREAD, "seq", F.coalesce("_fewer", "_tokens").alias("tokens")
    )
    kept = _kept(sized, limit, prefix, mode)
    return (
        messages.join(kept, [*THREAD, "seq"])
        .join(cut.drop("_fewer"), [*THREAD, "seq"], "left")
        .select(*THREAD, "position", "seq", "type", F.coalesce("_short", "content").alias("content"), "tokens")
    )
