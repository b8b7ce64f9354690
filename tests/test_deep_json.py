"""Damaged JSON nested thousands of levels deep is repaired whole."""

import json

import pytest
from pyspark.sql import functions as F

from gleanmill.functions import json_text as jt

DEEP = 5000


def test_deep_json_is_repaired_whole(spark):
    damaged = '{"a": [' * DEEP + "'last" + "]}" * (DEEP - 7)
    value = jt.lenient_loads(damaged)
    for _ in range(DEEP):
        value = value["a"][0]
    assert value.startswith("last")
    trailing = '{"a": [' * DEEP + "'last', " + "]}" * DEEP
    want = '{"a": [' * DEEP + '"last"' + "]}" * DEEP
    df = spark.createDataFrame([(trailing,)], "t string")
    assert jt.json_repair(df, "t", "r").first().r == want
    assert df.select(jt.parse_streamed_args(F.col("t"))).first()[0] == want


@pytest.mark.parametrize("value", [{}, [], [[], {}], {"a": [1, {"b": None}], "ü\n": "x\"y"}, 1.5, "é", [True, float("inf")]])
def test_dumped_is_json_dumps(value):
    assert jt.dumped(value) == json.dumps(value, ensure_ascii=False)


def test_valid_json_of_any_depth_is_walked(spark):
    deep = '{"a": [' * 50_000 + '{"citations": [{"url": "u"}]}' + "]}" * 50_000
    df = spark.createDataFrame([(deep,), ('{"citations": [1]}',), ("no",)], "t string")
    assert [r[0] for r in df.select(jt.harvest_nested(F.col("t"))).collect()] == [['{"url": "u"}'], ["1"], []]


def test_context_keeps_deep_answers(spark):
    from gleanmill.operators import messages as M

    deep = '[{"raw_content": "' + "r" * 3000 + '", "x": ' + "[" * 50_000 + "]" * 50_000 + "}]"
    rows = [(1, 0, "tool", "web_search", deep), (1, 1, "human", None, "hello")]
    df = spark.createDataFrame(rows, "thread_id int, seq bigint, type string, name string, content string")
    got = {r.seq: r.content for r in M.compress_context(df, 10, 2, "budget").collect()}
    assert got[0] == deep.replace("r" * 3000, "r" * 1024) and got[1] == "hello"
