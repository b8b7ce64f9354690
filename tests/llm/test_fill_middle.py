"""Fill-in-the-middle against a regular expression, and its boundary set against a plain list."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanmill.llm import fill_middle as fm

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    text = text or ""
    units = UNITS.findall(text)
    d = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


TEXTS = ["", None, " ", "a", " a b\n", "\x85a b c ", "x <P> y z", "é\U0001f600 \t\x0b\x0c\r\n ü", "\n\n", "one two three four five six seven", "a " * 70000, "w" * 200000]


def test_texts_match_the_plain_version(spark):
    rows = [(i, TEXTS[i % len(TEXTS)], "x", 0) for i in range(20 * len(TEXTS))] + [(None, "some words here", "x", 0)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, output string, n int")
    made = fm.fill_in_middle(df).withColumn("back", fm.restored(F.col("output"), F.col("form")))
    got = sorted(map(repr, made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()))
    names = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
    from pyspark.sql import Row

    assert got == sorted(repr(Row(*names)(d, *plain(d, t))) for d, t, *_ in rows)
    texts = {d: t or "" for d, t, *_ in rows}
    assert all(r.back == texts[r.doc_id] for r in made.select("doc_id", "back").collect())
    assert {r.form for r in made.select("form").collect()} == {"plain", "spm", "psm"}


def test_empty_table(spark):
    assert fm.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("positions", [
    np.array([], int), np.array([0]), np.array([65535, 65536]), np.arange(200000), np.arange(0, 400000, 3), np.arange(0, 300000, 2),
    np.unique(np.random.default_rng(1).integers(0, 1 << 20, 90000)), np.array([5, 1 << 30]),
    np.concatenate([np.arange(10, 9000), np.arange(20000, 60000), [70000, 70002, 131072]]),
])
def test_select_of_every_position(positions):
    found = fm.BoundarySet(positions)
    step = max(1, len(positions) // 5000)
    assert [found.select(k) for k in range(0, len(positions), step)] == positions[::step].tolist()
    for outside in (-1, len(positions)):
        with pytest.raises(IndexError):
            found.select(outside)


def test_all_kinds_of_containers_are_used():
    kinds = lambda positions: [type(c) for c in fm.BoundarySet(positions).containers]
    assert kinds(np.arange(65536)) == [fm.RunContainer]
    assert kinds(np.arange(0, 65536, 2)) == [fm.BitmapContainer]
    assert kinds(np.array([1, 5, 65536 + 9])) == [fm.ArrayContainer, fm.ArrayContainer]
