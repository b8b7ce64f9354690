"""JSON and half-JSON text: framing, repair, plan texts, nested citations, metadata.

Spark's own JSON functions do the work wherever the text is valid. Only damaged rows are sent to
Python, in Arrow batches.
"""

from __future__ import annotations

import json
import re
from itertools import accumulate
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanmill.functions import text as tx

SCALARS = {"true": True, "false": False, "null": None, "True": True, "False": False, "None": None}


# What matters for nesting: escapes and strings are skipped, the rest are openers and closers.
_MARKS = re.compile(r'\\.|"(?:\\.|[^"\\])*"?|[{}\[\]]', re.S)


def balanced_end(text: str) -> int:
    """Index of the last character at which all braces, or all brackets, opened so far are closed."""
    marks = [m for m in _MARKS.finditer(text) if m[0] in "{}[]"]
    end = -1
    for opener, closer in ("{}", "[]"):
        own = [m for m in marks if m[0] in (opener, closer)]
        levels = accumulate(1 if m[0] == opener else -1 for m in own)
        opened = accumulate((m[0] == opener for m in own), or_)
        end = max([end, *(m.start() for m, level, seen in zip(own, levels, opened, strict=True) if m[0] == closer and level == 0 and seen)])
    return end


def framed(text: str) -> str:
    end = balanced_end(text)
    return text[: end + 1] if end > 0 else text


class _Lenient:
    """Reader for damaged JSON: single quotes, missing commas or closers, bare words, comments cut off."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def peek(self) -> str:
        while self.at < len(self.text) and self.text[self.at] in " \t\r\n﻿":
            self.at += 1
        return self.text[self.at] if self.at < len(self.text) else ""

    def value(self):
        """One value. Containers that are not closed yet wait on a stack, each with the key it reads a value for."""
        opened: list[list] = []
        while True:
            char = self.peek()
            if char in ("{", "["):
                self.at += 1
                opened.append([{} if char == "{" else [], None])
            else:
                done = self.string(char) if char in ('"', "'") else self.word()
                if not opened:
                    return done
                self.put(opened[-1], done)
            while not self.goes_on(opened[-1]):
                done = opened.pop()[0]
                if not opened:
                    return done
                self.put(opened[-1], done)

    @staticmethod
    def put(container: list, value) -> None:
        held, key = container
        if isinstance(held, dict):
            held[key] = value
        else:
            held.append(value)

    def goes_on(self, container: list) -> bool:
        """Move to the next value of a container; false, and behind its end, if there is none."""
        held = container[0]
        closer, skipped = ("}", ",:;]") if isinstance(held, dict) else ("]", ",:;}")
        while (char := self.peek()) not in ("", closer):
            if char in skipped:
                self.at += 1
                continue
            if closer == "]":
                return True
            key = str(self.string(char) if char in ('"', "'") else self.bare(":,}{["))
            if self.peek() == ":":
                self.at += 1
            if self.peek() not in ("", ",", "}"):
                container[1] = key
                return True
            held[key] = ""
        self.at += 1
        return False

    def string(self, quote: str) -> str:
        self.at += 1
        start = self.at
        while self.at < len(self.text) and self.text[self.at] != quote:
            self.at += 2 if self.text[self.at] == "\\" else 1
        raw = self.text[start : min(self.at, len(self.text))]
        self.at += 1
        try:
            return json.loads('"' + (raw if quote == '"' else raw.replace("\\'", "'").replace('"', '\\"')) + '"', strict=False)
        except ValueError:
            return raw

    def bare(self, stops: str) -> str:
        start = self.at
        while self.at < len(self.text) and self.text[self.at] not in stops + "\n":
            self.at += 1
        if self.at == start:
            self.at += 1
        return self.text[start : self.at].strip()

    def word(self):
        token = self.bare(",}]")
        if token in SCALARS:
            return SCALARS[token]
        for number in (int, float):
            try:
                return number(token)
            except ValueError:
                pass
        return token


def lenient_loads(text: str):
    """Best reading of a damaged JSON text; raises ValueError if it holds no object or array."""
    starts = [i for i in (text.find("{"), text.find("[")) if i >= 0]
    if not starts:
        raise ValueError("no object or array")
    reader = _Lenient(text)
    reader.at = min(starts)
    return reader.value()


def dumped(value) -> str:
    """JSON text as ``json.dumps`` writes it, of values nested to any depth."""
    out, todo = [], [(value, None)]
    while todo:
        value, text = todo.pop()
        if text is not None:
            out.append(text)
        elif value and isinstance(value, dict | list):
            fields = isinstance(value, dict)
            parts = [(None, "{" if fields else "[")]
            for k, item in enumerate(value.items() if fields else value):
                lead = ", " if k else ""
                if fields:
                    key, item = item
                    lead += json.dumps(key, ensure_ascii=False) + ": "
                parts += [(None, lead), (item, None)]
            todo += reversed([*parts, (None, "}" if fields else "]")])
        else:
            out.append(json.dumps(value, ensure_ascii=False))
    return "".join(out)


def loads(text: str):
    """``json.loads`` for JSON nested to any depth; raises ValueError if it is none."""
    try:
        return json.loads(text)
    except RecursionError:
        return lenient_loads(text)


def dumps(value) -> str:
    """``json.dumps`` of values nested to any depth."""
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        return dumped(value)


def args_text(text: str) -> str:
    """JSON text of streamed arguments, as :func:`parse_streamed_args` gives it."""
    body = text.strip()
    try:
        loads(body)
    except ValueError:
        return _args_of(body)
    return body


def field_text(text: str | None, name: str) -> str | None:
    """A field of a JSON object as text, null where there is none."""
    try:
        value = loads(text or "")
    except ValueError:
        return None
    found = value.get(name) if isinstance(value, dict) else None
    return found if found is None or isinstance(found, str) else dumped(found)


def _args_of(text: str) -> str:
    try:
        value = lenient_loads(text)
    except ValueError:
        return "{}"
    return dumped(value if isinstance(value, dict) else {"_parsed": value})


@F.pandas_udf(T.StringType())
def _frame(texts: pd.Series) -> pd.Series:
    return texts.map(framed, na_action="ignore")


@F.pandas_udf(T.StringType())
def _repair(texts: pd.Series) -> pd.Series:
    def fix(text):
        text = framed(text)
        try:
            return dumped(lenient_loads(text))
        except ValueError:
            return text

    return texts.map(fix, na_action="ignore")


@F.pandas_udf(T.StringType())
def _read_args(texts: pd.Series) -> pd.Series:
    return texts.map(_args_of, na_action="ignore")


def is_json(text: Column) -> Column:
    """True for exactly one JSON value. The parser ignores what follows a value, but no remainder can be
    legal both before a closing bracket and before a closing brace."""
    in_array = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.coalesce(in_array.isNotNull() & in_object.isNotNull(), F.lit(False))


def looks_structured(text: Column) -> Column:
    return F.substring(text, 1, 1).isin("{", "[")


def json_frame(text: Column) -> Column:
    """Trimmed text, cut after the last point where its JSON is complete."""
    body = tx.strip(text)
    damaged = ~(looks_structured(body) & is_json(body)) & body.rlike(r"[}\]]")
    return F.when(damaged, _frame(F.when(damaged, body))).otherwise(body)


def clean_tool_text(text: Column, size: int | None = None) -> Column:
    """Tool response without trailing tokens or control characters; whole unless ``size`` bounds it."""
    body = tx.strip(text)
    damaged = looks_structured(body) & ~is_json(body)
    body = F.when(damaged, _frame(F.when(damaged, body))).otherwise(body)
    if size is None:
        return tx.drop_controls(body)
    cut = F.concat(tx.rstrip(F.substring(body, 1, size)), F.lit("..."))
    return tx.drop_controls(F.when(F.length(body) > size, cut).otherwise(body))


def _unfenced(text: Column) -> Column:
    """Trimmed text without markdown code fences."""
    opened = F.regexp_replace(text, r"(?im)^[ \t]*```(?:json|ts)?[ \t]*\n+", "")
    closed = F.regexp_replace(opened, r"(?m)\n*```[ \t]*$", "")
    return tx.strip(F.when(text.contains("```"), closed).otherwise(text))


def json_repair(df: DataFrame, source: str, out: str) -> DataFrame:
    """Add ``out``: valid JSON text made of model output; text without an object or array stays, unfenced.

    The steps are columns of their own, so each is worked out once per row.
    """
    body, damaged = F.col("_body"), F.col("_damaged")
    return (
        df.withColumn("_body", _unfenced(tx.strip(F.col(source))))
        .withColumn("_damaged", ~(looks_structured(body) & is_json(body)) & body.rlike(r"[{\[]"))
        .withColumn("_fixed", _repair(F.when(damaged, body)))
        .withColumn(out, F.when(damaged, F.col("_fixed")).otherwise(body))
        .drop("_body", "_damaged", "_fixed")
    )


def parse_streamed_args(text: Column) -> Column:
    """JSON text of an object read from possibly incomplete arguments; ``{}`` if hopeless."""
    body = tx.strip(F.coalesce(text, F.lit("")))
    valid = is_json(body)
    return F.when(valid, body).otherwise(_read_args(F.when(~valid, body)))


def variant_kind(value: Column) -> Column:
    """object, array, string, number, boolean or null."""
    name = F.schema_of_variant(value)
    return (
        F.when(name.startswith("OBJECT"), "object")
        .when(name.startswith("ARRAY"), "array")
        .when(name == "STRING", "string")
        .when(name == "BOOLEAN", "boolean")
        .when((name == "VOID") | name.isNull(), "null")
        .otherwise("number")
    )


def _text_of(value: Column) -> Column:
    """Strings as they are, everything else as JSON text."""
    return F.when(variant_kind(value) == "string", F.try_variant_get(value, "$", "string")).otherwise(F.to_json(value))


def _item_text(item: Column) -> Column:
    """Text of one list item: a non-blank string, a text block, or an object's string content."""
    text = F.try_variant_get(item, "$", "string")
    own = F.try_variant_get(item, "$.text", "string")
    inner = F.try_variant_get(item, "$.content", "variant")
    typed = F.try_variant_get(item, "$.type", "string") == "text"
    return (
        F.when(variant_kind(item) == "string", F.when(tx.strip(text) != "", text))
        .when(typed & own.isNotNull(), own)
        .when(variant_kind(inner) == "string", F.try_variant_get(inner, "$", "string"))
    )


def content_text(df: DataFrame, raw: str, out: str) -> DataFrame:
    """Add ``out``: the text of a polymorphic content value given as JSON text.

    A string stays; an object gives its ``content`` (string, object as JSON text, or the first text in a
    list), or itself as JSON text. Null marks a list without any text.
    """
    value, content, kind = F.col("_value"), F.col("_content"), F.col("_kind")
    texts = F.array_compact(F.transform(F.try_variant_get(content, "$", "array<variant>"), _item_text))
    text = (
        F.when(value.isNull(), F.col(raw))
        .when(kind == "string", F.try_variant_get(value, "$", "string"))
        .when((kind != "object") | content.isNull(), F.col(raw))
        .when(F.col("_inner") == "array", F.try_element_at(texts, F.lit(1)))
        .otherwise(_text_of(content))
    )
    return (
        df.withColumn("_value", F.try_parse_json(raw))
        .withColumn("_kind", variant_kind(value))
        .withColumn("_content", F.try_variant_get(value, "$.content", "variant"))
        .withColumn("_inner", variant_kind(content))
        .withColumn(out, text)
        .drop("_value", "_kind", "_content", "_inner")
    )


def blocks_text(raw: Column) -> Column:
    """Text of a topic given as JSON text: list items joined by a blank, empty ones left out."""
    value = F.try_parse_json(raw)
    items = F.try_variant_get(value, "$", "array<variant>")

    def item_text(item: Column) -> Column:
        parts = [tx.filled(F.try_variant_get(item, f"$.{n}", "string")) for n in ("text", "content")]
        return F.when(variant_kind(item) == "object", F.coalesce(*parts)).otherwise(_text_of(item))

    joined = F.array_join(F.filter(F.transform(items, item_text), lambda t: t != ""), " ")
    return F.when(variant_kind(value) == "array", joined).otherwise(
        F.when(variant_kind(value) == "string", F.try_variant_get(value, "$", "string")).otherwise(F.coalesce(raw, F.lit("")))
    )


STEP = T.StructType(
    [
        T.StructField("need_search", T.BooleanType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("step_type", T.StringType()),
        T.StructField("execution_res", T.StringType()),
    ]
)
PLAN = T.StructType(
    [
        T.StructField("locale", T.StringType()),
        T.StructField("has_enough_context", T.BooleanType()),
        T.StructField("thought", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("steps", T.ArrayType(STEP)),
    ]
)


def parse_plans(df: DataFrame, raw: str = "raw", key: str = "plan_id") -> DataFrame:
    """One row per plan step; a text that is no plan gives one row with its reason.

    Columns: key, reason, locale, has_enough_context, plan_title, step_no (1-based), and the step's own.
    """
    outer = json_repair(df.select(key, raw), raw, "_outer").withColumn(
        "reason", F.when(~looks_structured(F.col("_outer")), F.lit("not JSON"))
    )
    inner = json_repair(content_text(outer, "_outer", "_text"), "_text", "_plan")
    reason = (
        F.when(F.col("reason").isNotNull(), F.col("reason"))
        .when(F.col("_plan").isNull(), "no text content")
        .when(~F.col("_plan").startswith("{"), "not a plan")
    )
    typed = inner.withColumn("reason", reason).select(
        key, "reason", F.when(F.col("reason").isNull(), F.from_json("_plan", PLAN)).alias("p")
    )
    return typed.select(
        key,
        "reason",
        F.col("p.locale").alias("locale"),
        F.col("p.has_enough_context").alias("has_enough_context"),
        F.col("p.title").alias("plan_title"),
        F.posexplode_outer("p.steps").alias("_pos", "s"),
    ).select(key, "reason", "locale", "has_enough_context", "plan_title", (F.col("_pos") + 1).alias("step_no"), "s.*")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nested_citations(texts: pd.Series) -> pd.Series:
    """JSON text of every entry of every ``citations`` list, level by level."""

    def walk(text):
        try:
            level = [loads(text)]
        except ValueError:
            return []
        found = []
        while level := [node for node in level if isinstance(node, dict)]:
            for node in level:
                if isinstance(node.get("citations"), list):
                    found += map(dumps, node["citations"])
            level = [c for node in level for v in node.values() for c in (v if isinstance(v, list) else [v])]
        return found

    return texts.map(walk, na_action="ignore")


def harvest_nested(raw: Column) -> Column:
    """Entries of all ``citations`` lists in nested objects of a JSON text, breadth first.

    Objects, and objects in lists, are visited at every depth. Texts without the word never reach Python.
    """
    mentioned = raw.contains('"citations"')
    found = _nested_citations(F.when(mentioned, raw))
    return F.coalesce(F.when(mentioned, found), F.array().cast("array<string>"))


def flatten_metadata(metadata: Column) -> Column:
    """Map of JSON texts to map of scalar texts: null becomes empty, lists and objects stay JSON text."""

    def flat(_, raw):
        value = F.try_parse_json(raw)
        return (
            F.when(raw.isNull() | (variant_kind(value) == "null") & value.isNotNull(), F.lit(""))
            .when(value.isNull(), raw)
            .when(variant_kind(value) == "string", F.try_variant_get(value, "$", "string"))
            .otherwise(raw)
        )

    return F.transform_values(metadata, flat)

