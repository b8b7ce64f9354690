"""JSON queries and their SQL twins; texts are made from the rows, whole and damaged."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanmill.functions import json_text as jt
from gleanmill.plans.registry import Query
from gleanmill.plans.views import view

O, C = "chr(123)", "chr(125)"

FRAMED = "case event_id % 3 when 0 then props || ' and more' when 1 then ' ' || props || '] done' else 'x' end"
QUOTE = "chr(39)"
DAMAGED = f"""case event_id % 4 when 0 then '```json' || chr(10) || replace(props, '"', {QUOTE}) || chr(10) || '```'
  when 1 then replace(props, {C}, ',' || {C}) when 2 then replace(props, {C}, '') else props || ' tail' end"""
ARGS = f"""case event_id % 4 when 0 then props when 1 then replace(props, {C}, '') when 2 then '[1, 2' else 'nonsense' end"""
STEPS = f"""'[' || {O} || '"need_search": true, "title": "' || event_type || '", "description": "look", "step_type": "research"' || {C}
  || ', ' || {O} || '"need_search": false, "title": "sum up", "description": "d", "step_type": "analysis"' || {C} || ']'"""
PLAN = f"""{O} || '"locale": "en-US", "has_enough_context": false, "thought": "", "title": "Plan ' || event_id || '", "steps": '
  || {STEPS} || {C}"""
PLAN_TEXT = f"""case event_id % 4 when 0 then {PLAN} when 1 then '```json' || chr(10) || {PLAN} || chr(10) || '```'
  when 2 then {O} || '"content": ' || {PLAN} || {C} else 'no plan at all' end"""
CONTENT = f"""case event_id % 6 when 0 then props when 1 then '"' || event_type || '"'
  when 2 then {O} || '"content": "' || event_type || '"' || {C}
  when 3 then {O} || '"content": [' || {O} || '"type": "text", "text": "' || event_type || '"' || {C} || ', "x"]' || {C}
  when 4 then {O} || '"content": ' || replace(props, ' ', '') || {C} else {O} || '"content": [1]' || {C} end"""
TOPIC = f"""case event_id % 3 when 0 then '[' || {O} || '"text": "' || event_type || '"' || {C} || ', ' || {O}
  || '"content": "two"' || {C} || ', "three", ' || {O} || '"text": ""' || {C} || ']'
  when 1 then '"' || event_type || '"' else event_type end"""
NESTED = f"""{O} || '"step": ' || {O} || '"citations": [' || {O} || '"url": "' || url || '/deep"' || {C} || '], "n": [' || {O}
  || '"citations": [' || {O} || '"url": "' || url || '/list"' || {C} || ']' || {C} || ', 3]' || {C} || ', "citations": [' || {O} || '"url": "'
  || url || '"' || {C} || ']' || {C}"""


def _events(**columns):
    def build(spark, sf):
        return view(spark, sf, "events").select("event_id", *[c().alias(n) for n, c in columns.items()])

    return build


def _plans(spark, sf):
    raw = view(spark, sf, "events").select(F.col("event_id").alias("plan_id"), F.expr(PLAN_TEXT).alias("raw"))
    return jt.parse_plans(raw).select(
        "plan_id", "reason", "locale", "has_enough_context", "plan_title", F.col("step_no").cast("bigint").alias("step_no"),
        "need_search", "title", "description", "step_type",
    )


def _nested(spark, sf):
    raw = view(spark, sf, "pages").select("page_id", jt.harvest_nested(F.expr(NESTED)).alias("found"))
    return raw.select("page_id", F.posexplode("found").alias("pos", "c")).select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), F.get_json_object("c", "$.url").alias("url")
    )


METADATA = "map('props', props, 'none', 'null', 'name', '\"' || event_type || '\"', 'value', cast(event_id as string))"


def _metadata(spark, sf):
    flat = jt.flatten_metadata(F.expr(METADATA))
    return view(spark, sf, "events").select(
        "event_id", *[F.element_at(flat, F.lit(n)).alias(n) for n in ("props", "none", "name", "value")]
    )


QUERIES = {
    "json_frame": Query(
        _events(framed=lambda: jt.json_frame(F.expr(FRAMED))),
        f"select event_id, case when event_id % 3 = 2 then 'x' else props end as framed from events",
    ),
    "json_repair": Query(
        lambda spark, sf: jt.json_repair(
            _events(raw=lambda: F.expr(DAMAGED))(spark, sf), "raw", "repaired"
        ).drop("raw"),
        "select event_id, props as repaired from events",
    ),
    "parse_streamed_args": Query(
        _events(args=lambda: jt.parse_streamed_args(F.expr(ARGS))),
        f"""select event_id, case when event_id % 4 < 2 then props when event_id % 4 = 2
  then {O} || '"_parsed": [1, 2]' || {C} else {O} || {C} end as args from events""",
    ),
    "parse_plans": Query(
        _plans,
        """with steps as (select event_id, 1 as step_no, true as need_search, event_type as title, 'look' as description,
    'research' as step_type from events union all
  select event_id, 2, false, 'sum up', 'd', 'analysis' from events)
select event_id as plan_id, case when event_id % 4 = 3 then 'not JSON' end as reason,
  case when event_id % 4 < 3 then 'en-US' end as locale, case when event_id % 4 < 3 then false end as has_enough_context,
  case when event_id % 4 < 3 then 'Plan ' || event_id end as plan_title,
  cast(case when event_id % 4 < 3 then step_no end as bigint) as step_no,
  case when event_id % 4 < 3 then need_search end as need_search, case when event_id % 4 < 3 then title end as title,
  case when event_id % 4 < 3 then description end as description,
  case when event_id % 4 < 3 then step_type end as step_type
from steps where event_id % 4 < 3 or step_no = 1""",
    ),
    "content_text": Query(
        lambda spark, sf: jt.content_text(_events(raw=lambda: F.expr(CONTENT))(spark, sf), "raw", "text").drop("raw"),
        """select event_id, case event_id % 6 when 0 then props when 4 then replace(props, ' ', '') when 5 then null
  else event_type end as text from events""",
    ),
    "blocks_text": Query(
        _events(text=lambda: jt.blocks_text(F.expr(TOPIC))),
        """select event_id, case event_id % 3 when 0 then event_type || ' two three' else event_type end as text
from events""",
    ),
    "harvest_nested": Query(
        _nested,
        """select page_id, cast(0 as bigint) as pos, url from pages union all
select page_id, 1, url || '/deep' from pages union all select page_id, 2, url || '/list' from pages""",
    ),
    "flatten_metadata": Query(
        _metadata,
        """select event_id, props, '' as none, event_type as name, cast(event_id as string) as value from events""",
    ),
}
