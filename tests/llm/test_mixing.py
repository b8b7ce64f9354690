"""Mixing against a plain version of the targets and of the draw."""

import math

import pytest
from pyspark.sql import functions as F

from gleanmill.llm import mixing as M


def plain_targets(sizes):
    """Shares by weight, excess over 3 times the size shared again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    target, capped, left = {}, set(), float(sum(sizes.values()))
    while True:
        free = [s for s in names if s not in capped]
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 3 * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        for s in over:
            target[s] = 3.0 * sizes[s]
            capped.add(s)
        left = sum(sizes.values()) - sum(target[s] for s in capped)


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 10_000, "b": 1, "c": 1, None: 5}, {"a": 5}, {"a": 0, "b": 0}, {"a": 0, "b": 7, None: 0},
    {"Z": 50, "a": 10, "é": 20, "": 3, "😀": 900, "￿": 1}, {f"s{i}": 7 ** (i % 9) for i in range(40)},
])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in M.targets(df).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys()
    assert all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-9) for s in want)
    assert math.isclose(sum(got.values()), sum(sizes.values()), abs_tol=1e-6)


def rows_of(n=400):
    rows = [(i, " ".join(["w"] * (1 + i * i % 97)), ["hot", "b", None, "c"][0 if i % 3 else i % 4], i) for i in range(n)]
    return rows + [(1000, None, "b", 0), (1001, "", "hot", 0), (None, "no id here", "b", 0), (5, "equal ids", "b", 0), (5, "equal ids", "b", 1)]


def test_every_document_once_and_sources_near_their_targets(spark):
    docs = spark.createDataFrame(rows_of(), "doc_id long, text string, source string, size int")
    got = M.mix(docs.repartition(5)).collect()
    assert len(got) == docs.count()
    assert sorted(map(str, got)) == sorted(map(str, M.mix(docs.repartition(2)).collect()))
    totals = {}
    for r in got:
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 3
        share = r.target / r.source_size
        assert math.floor(share) <= r.copies <= math.ceil(share)
        totals.setdefault(r.source, [r.target, 0, 0])
        totals[r.source][1] += r.taken
        totals[r.source][2] = max(totals[r.source][2], r.size)
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = plain_targets(sizes)
    for source, (target, taken, largest) in totals.items():
        assert math.isclose(target, want[source], rel_tol=1e-9)
        assert abs(taken - target) <= 2 * largest, source


def test_copies_are_the_boundaries_crossed(spark):
    """Positions rebuilt from the order that the docstring gives, over the whole source at once."""
    docs = spark.createDataFrame(rows_of(200), "doc_id long, text string, source string, size int")
    sized = M.sized(docs).cache()
    got = M.copies(sized).withColumns({
        "klass": F.floor(4 * F.log2(F.col("size") + 1)), "cell": F.pmod(F.xxhash64("doc_id", "key", F.lit(M.SEED)), F.lit(M.CELLS)),
        "tie": F.xxhash64("doc_id", "key", F.lit(M.SEED + 1)), "u": M._offset(F.col("source"), M.SEED)}).collect()
    by_source = {}
    for r in got:
        by_source.setdefault(r.source, []).append(r)
    for members in by_source.values():
        members.sort(key=lambda r: (-r.klass, r.cell, -r.size, r.tie))
        share = members[0].target / members[0].source_size
        want = [math.floor(share * (k + 1) + r.u) - math.floor(share * k + r.u) for k, r in enumerate(members)]
        assert sorted(zip([(r.klass, r.cell, r.size, r.tie) for r in members], [r.copies for r in members], strict=True)) == sorted(
            zip([(r.klass, r.cell, r.size, r.tie) for r in members], want, strict=True))


def test_emitted_rows(spark):
    docs = spark.createDataFrame(rows_of(), "doc_id long, text string, source string, _n int").withColumn("row", F.lit("x"))
    got = M.emitted(docs)
    assert got.columns == docs.columns
    counts = {(r.doc_id, r.text): r["count"] for r in got.groupBy("doc_id", "text").count().collect()}
    want = {}
    for r in M.copies(M.sized(docs).cache()).collect():
        want[r.doc_id, r.size] = want.get((r.doc_id, r.size), 0) + r.copies
    size = lambda t: len((t or "").split())
    assert {(d, size(t)): n for (d, t), n in counts.items()} == {k: n for k, n in want.items() if n}
    assert M.emitted(docs.limit(0)).count() == 0 and M.mix(docs.limit(0)).count() == 0


def test_no_python(spark):
    docs = spark.createDataFrame(rows_of(50), "doc_id long, text string, source string, x int")
    for df in (M.mix(docs), M.emitted(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
