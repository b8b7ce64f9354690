"""Research runs: sessions inside a conversation, and the plans they follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanmill.functions import constants as K
from gleanmill.operators.ordering import joined_parts, last_known, numbered, running_sum
from gleanmill.operators.search import PART_CHARS

THREAD = ["thread_id"]
PLAN = ["plan_id"]


def research_rows(messages: DataFrame) -> DataFrame:
    """Messages of research agents with ``session_no``: a session ends with a finished report."""
    rows = messages.filter(F.col("agent").isin(K.RESEARCH_AGENTS))
    ends = F.when((F.col("agent") == "reporter") & F.col("finish_reason").isNotNull(), F.lit(1)).otherwise(F.lit(0))
    counted = running_sum(rows, THREAD, "seq", ends, "session_no", inclusive=False)
    return counted.withColumn("session_no", F.col("session_no") + 1)


def research_sessions(messages: DataFrame) -> DataFrame:
    """One row per session: id (its first message), report message, number of activities."""
    return (
        research_rows(messages)
        .groupBy(*THREAD, "session_no")
        .agg(
            F.min_by("message_id", "seq").alias("session_id"),
            F.min("seq").alias("first_seq"),
            F.max_by("message_id", F.when(F.col("agent") == "reporter", F.col("seq"))).alias("report_id"),
            F.count(F.lit(1)).alias("activities"),
        )
    )


def session_activities(messages: DataFrame) -> DataFrame:
    """Activities of each session in order: ``thread_id, session_no, activity_no, message_id``.

    Number 0 is the plan the session works on, where there is one.
    """
    rows = research_rows(messages)
    listed = numbered(rows.select(*THREAD, "session_no", "seq", "message_id"), [*THREAD, "session_no"], "seq", "activity_no")
    plans = plan_and_query(messages).filter("plan_id is not null")
    opening = plans.select(*THREAD, "session_no", F.lit(0).cast("bigint").alias("activity_no"), F.col("plan_id").alias("message_id"))
    return listed.drop("seq").withColumn("activity_no", F.col("activity_no").cast("bigint")).unionByName(opening)


def plan_and_query(messages: DataFrame) -> DataFrame:
    """For each session, the latest planner message and the latest user text before it began."""
    asked = F.when((F.col("role") == "user") & (F.coalesce("content", F.lit("")) != ""), F.col("content"))
    known = last_known(
        messages, THREAD, "seq", {"plan_id": F.when(F.col("agent") == "planner", F.col("message_id")), "query": asked}
    )
    starts = research_sessions(messages).select(*THREAD, "session_no", "session_id", F.col("first_seq").alias("seq"))
    return starts.join(known.select(*THREAD, "seq", "plan_id", "query"), [*THREAD, "seq"]).withColumn(
        "query", F.coalesce("query", F.lit(""))
    ).drop("seq")


def _pending(name: str = "execution_res") -> Column:
    return F.coalesce(name, F.lit("")) == ""


ROUTES = {"research": "researcher", "analysis": "analyst", "processing": "coder"}


def next_step(steps: DataFrame, plans: DataFrame | None = None) -> DataFrame:
    """Who works next on each plan: by the type of its first open step; the planner if there is none."""
    first = steps.groupBy(*PLAN).agg(
        F.min_by("step_type", F.when(_pending(), F.col("step_no"))).alias("_type"),
        F.min(F.when(_pending(), F.col("step_no"))).alias("step_no"),
    )
    rows = first if plans is None else plans.select(*PLAN).join(first, PLAN, "left")
    route = F.lit("planner")
    for kind, agent in ROUTES.items():
        route = F.when(F.col("_type") == kind, agent).otherwise(route)
    return rows.select(*PLAN, "step_no", route.alias("agent"))


DEFAULT_STEP = {
    "need_search": True,
    "title": "Initial Research",
    "description": "Gather information about the topic",
    "step_type": "research",
}


def repair_plans(
    steps: DataFrame, plans: DataFrame | None = None, enforce_search: bool = False, search_enabled: bool = True
) -> DataFrame:
    """Fill missing step types and, if enforced, make sure that some step of each plan searches.

    Where none does, the first research step will; without one the first step becomes a research step. A
    plan of ``plans(plan_id)`` without steps gets a default one.
    """
    searching = F.coalesce("need_search", F.lit(False))
    kind = F.when(F.coalesce("step_type", F.lit("")) != "", F.col("step_type")).when(searching, "research").otherwise("analysis")
    typed = steps.withColumn("step_type", kind).withColumn("need_search", searching)
    if not (enforce_search and search_enabled):
        return typed
    facts = typed.groupBy(*PLAN).agg(
        F.bool_or("need_search").alias("_any"),
        F.min(F.when(F.col("step_type") == "research", F.col("step_no"))).alias("_research"),
        F.min("step_no").alias("_first"),
    )
    joined = typed.join(facts, PLAN)
    chosen = ~F.col("_any") & (F.col("step_no") == F.coalesce("_research", "_first"))
    fixed = (
        joined.withColumn("need_search", F.col("need_search") | chosen)
        .withColumn("step_type", F.when(chosen, "research").otherwise(F.col("step_type")))
        .select(*typed.columns)
    )
    if plans is None:
        return fixed
    empty = plans.select(*PLAN).join(facts.select(*PLAN), PLAN, "left_anti").withColumn("step_no", F.lit(0).cast("bigint"))
    for name, value in DEFAULT_STEP.items():
        empty = empty.withColumn(name, F.lit(value))
    return fixed.unionByName(empty, allowMissingColumns=True)


def findings_digest(steps: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """Findings of the steps done before each plan's current one, as markdown in parts of so many characters.

    Plans without an open step have no current one and give nothing. Parts in order are the whole text.
    """
    current = steps.groupBy(*PLAN).agg(F.min(F.when(_pending(), F.col("step_no"))).alias("_current"))
    done = steps.join(current, PLAN).filter(F.col("step_no") < F.col("_current"))
    listed = numbered(done.select(*PLAN, "step_no", "title", "execution_res"), PLAN, "step_no", "_i")
    block = F.concat(
        F.lit("## Completed Step "), F.col("_i"), F.lit(": "), F.col("title"), F.lit("\n\n<finding>\n"),
        F.col("execution_res"), F.lit("\n</finding>\n\n"),
    )
    head = F.when(F.col("_i") == 1, F.lit("# Completed Research Steps\n\n")).otherwise(F.lit(""))
    return joined_parts(listed, PLAN, "_i", F.concat(head, block), "", part_chars, "digest")
