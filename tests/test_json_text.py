import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleanmill.functions import json_text as jt

VALUES = st.recursive(
    st.none() | st.booleans() | st.integers(-99, 99) | st.text(max_size=6),
    lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.text(max_size=4), inner, max_size=3),
    max_leaves=8,
)


def test_is_json_is_strict(outcomes):
    texts = ['{"a":1}', "[1, 2]", '{"a":1} x', '{"a":1},{"b":2}', '{"a":1}] {x}', "", "{'a':1}", "12"]
    assert outcomes(jt.is_json, texts) == [True, True, False, False, False, False, False, True]


def test_frame_cuts_after_the_last_balanced_point(outcomes):
    texts = ['{"a": "}"} tail', '[1] {"b": 2} x', "no json", ' {"a": [1, 2]} ', "} {", '{"a": 1']
    assert outcomes(jt.json_frame, texts) == ['{"a": "}"}', '[1] {"b": 2}', "no json", '{"a": [1, 2]}', "} {", '{"a": 1']


@settings(max_examples=200, deadline=None)
@given(VALUES.filter(lambda v: isinstance(v, (dict, list))))
def test_lenient_reader_agrees_on_valid_json(value):
    assert jt.lenient_loads(json.dumps(value)) == value


@pytest.mark.parametrize(
    "text, value",
    [
        ("{'a': 'b',}", {"a": "b"}), ('{"a": [1, 2', {"a": [1, 2]}), ('{a: true, b: None}', {"a": True, "b": None}),
        ('[1 2]', ["1 2"]), ('{"a": "un', {"a": "un"}), ('{"a": 1 "b": 2}', {"a": '1 "b": 2'}), ('{"a": {"b": "c"', {"a": {"b": "c"}}),
    ],
)
def test_lenient_reader_on_damage(text, value):
    assert jt.lenient_loads(text) == value


def test_repair_keeps_plain_text_and_unwraps_fences(spark):
    df = spark.createDataFrame([(0, "```json\n{'a': 1}\n```"), (1, "plain"), (2, '```ts\n\n["x",]\n```'), (3, '{"a": 1}')], "i int, t string")
    got = [r.r for r in jt.json_repair(df, "t", "r").orderBy("i").collect()]
    assert got == ['{"a": 1}', "plain", '["x"]', '{"a": 1}']


def test_streamed_args(outcomes):
    assert outcomes(jt.parse_streamed_args, ['{"q": "ru', '{"q": 1}', "[1", "oops", None]) == [
        '{"q": "ru"}', '{"q": 1}', '{"_parsed": [1]}', "{}", "{}",
    ]


def test_nested_citations_at_every_depth(outcomes):
    def nest(depth):
        node = {"citations": [depth]}
        for _ in range(depth):
            node = {"k": node}
        return json.dumps(node)

    assert outcomes(jt.harvest_nested, [nest(5), nest(60), '{"x": [{"citations": [1]}, [{"citations": [2]}]], "citations": [0]}', "bad"]) == [
        ["5"], ["60"], ["0", "1"], [],
    ]


def test_metadata_becomes_scalar(outcomes):
    got = outcomes(jt.flatten_metadata, [{"a": None, "b": "[1, 2]", "c": '"x"', "d": "1.5", "e": "free text"}], "map<string,string>")
    assert got == [{"a": "", "b": "[1, 2]", "c": "x", "d": "1.5", "e": "free text"}]
