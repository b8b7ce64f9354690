"""The block-wise helpers against plain Python, with blocks far smaller than the groups."""

import random

import pytest
from pyspark.sql import functions as F

from gleanmill.operators import ordering as O

BLOCK = 7


@pytest.fixture(scope="module")
def data(spark):
    """One group holds most rows; seq values are sparse and shuffled."""
    rng = random.Random(5)
    rows = []
    for group, size in (("hot", 150), ("b", 20), ("c", 1)):
        for seq in rng.sample(range(-50, 400), size):
            rows.append((group, seq, rng.choice([None, 0.0, 0.25, 0.5, 0.5, rng.random()]), rng.choice("abc")))
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "g string, seq bigint, v double, t string").repartition(5)


def by_group(rows, key):
    out = {}
    for row in sorted(rows, key=key):
        out.setdefault(row[0], []).append(row)
    return out


def test_numbered(data):
    rows, df = data
    want = {(g, r[1]): i + 1 for g, rs in by_group(rows, lambda r: r[1]).items() for i, r in enumerate(rs)}
    got = {(r.g, r.seq): r.n for r in O.numbered(df, ["g"], "seq", "n", BLOCK).collect()}
    assert got == want


def test_ranked_by_score(data):
    rows, df = data
    want = {
        (g, r[1]): i + 1 for g, rs in by_group(rows, lambda r: (-(r[2] or 0.0), r[1])).items() for i, r in enumerate(rs)
    }
    ranked = O.ranked_by_score(df, ["g"], F.coalesce("v", F.lit(0.0)), "seq", "n", BLOCK)
    assert {(r.g, r.seq): r.n for r in ranked.collect()} == want


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("newest_first", [True, False])
def test_running_sum(data, inclusive, newest_first):
    rows, df = data
    want = {}
    for g, rs in by_group(rows, lambda r: -r[1] if newest_first else r[1]).items():
        total = 0
        for r in rs:
            before, total = total, total + r[1]
            want[g, r[1]] = total if inclusive else before
    out = O.running_sum(df, ["g"], "seq", F.col("seq"), "s", inclusive, newest_first, BLOCK)
    assert {(r.g, r.seq): r.s for r in out.collect()} == want


def test_prior_max(data):
    rows, df = data
    want = {}
    for g, rs in by_group(rows, lambda r: r[1]).items():
        best = None
        for r in rs:
            want[g, r[1]] = best
            best = r[2] if best is None else max(best, r[2]) if r[2] is not None else best
    assert {(r.g, r.seq): r.m for r in O.prior_max(df, ["g"], "seq", F.col("v"), "m", BLOCK).collect()} == want


@pytest.mark.parametrize("inclusive", [True, False])
def test_last_known(data, inclusive):
    rows, df = data
    want = {}
    for g, rs in by_group(rows, lambda r: r[1]).items():
        last = None
        for r in rs:
            now = r[2] if r[2] is not None else last
            want[g, r[1]] = now if inclusive else last
            last = now
    out = O.last_known(df, ["g"], "seq", {"k": F.col("v")}, inclusive, BLOCK)
    assert {(r.g, r.seq): r.k for r in out.collect()} == want


def test_joined_text(data):
    rows, df = data
    grouped = by_group(rows, lambda r: r[1])
    out = O.joined_text(
        df, ["g"], "seq", {"t": F.col("t")}, ", '\\\n", firsts={"first": F.col("v")}, lasts={"last": F.col("v")}
    )
    for row in out.collect():
        mine = grouped[row.g]
        known = [r[2] for r in mine if r[2] is not None] or [None]
        assert row.t == ", '\\\n".join(r[3] for r in mine)
        assert (row["first"], row["last"]) == (known[0], known[-1])


@pytest.mark.parametrize("spread", ["dense", "sparse", "packed"])
def test_blocks_of_a_hot_group_are_bounded_however_its_values_lie(spark, spread):
    """Most rows in one group, values next to each other, scattered over all numbers, or in clusters."""
    rng = random.Random(9)
    n, block = 20_000, 100
    values = {"dense": range(n), "sparse": list({rng.randrange(-(1 << 62), 1 << 62) for _ in range(n)}), "packed": [i // 50 * 10**9 + i % 50 for i in range(n)]}[spread]
    rows = [("hot", v) for v in values] + [(f"g{i}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, seq bigint").repartition(6)
    sizes = {(r.g, r[O.BLOCK]): r["count"] for r in O.with_block(df, ["g"], "seq", O.find_cuts(df, ["g"], "seq", block)).groupBy("g", O.BLOCK).count().collect()}
    assert max(sizes.values()) <= 4 * block and len(sizes) <= 300 + 2 * n / block
    got = {r.seq: r.n for r in O.numbered(df, ["g"], "seq", "n", block).where("g = 'hot'").collect()}
    assert got == {v: i + 1 for i, v in enumerate(sorted(values))}


def test_close_scores_and_ties_are_split(spark):
    n, block = 5_000, 50
    rows = [("hot", i, 0.5 + (i % 100) * 1e-9 if i % 2 else 0.5) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, seq bigint, score double").repartition(4)
    order = df.withColumn("o", F.struct(-F.col("score"), "seq"))
    assert max(r["count"] for r in O.with_block(order, ["g"], "o", O.find_cuts(order, ["g"], "o", block)).groupBy("g", O.BLOCK).count().collect()) <= 4 * block
    want = {r[1]: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (-r[2], r[1])))}
    assert {r.seq: r.n for r in O.ranked_by_score(df, ["g"], F.col("score"), "seq", "n", block).collect()} == want


def test_blocks_grow_with_the_table(spark, monkeypatch):
    """Cuts stay few enough to be broadcast, whatever the number of hot groups."""
    monkeypatch.setattr(O, "MAX_BLOCKS", 16)
    df = spark.range(6000).select((F.col("id") % 3).alias("g"), F.col("id").alias("seq"))
    cuts = O.find_cuts(df, ["g"], "seq", 10).select(F.size("_cuts")).collect()
    assert len(cuts) == 3 and sum(r[0] for r in cuts) <= 32


def test_without_hot_groups_the_plan_is_one_window(spark):
    df = spark.range(100).select((F.col("id") % 7).alias("g"), F.col("id").alias("seq"))
    stacked = O.running_sum(O.numbered(df, ["g"], "seq", "n"), ["g"], "seq", F.col("n"), "s")
    text = stacked._jdf.queryExecution().executedPlan().toString()
    assert O.find_cuts(df, ["g"], "seq") is None and text.count("Exchange") == 1 and "Join" not in text


def test_null_groups_and_empty_tables(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), ("a", 2)], "g string, seq bigint")
    assert {(r.g, r.seq): r.n for r in O.numbered(df, ["g"], "seq", "n", 1).collect()} == {(None, 1): 1, (None, 3): 2, ("a", 2): 1}
    assert O.numbered(df.limit(0), ["g"], "seq", "n").collect() == []


def test_joined_parts_are_bounded_and_whole(spark):
    rng = random.Random(8)
    rows = [(g, i * 3, "é" * rng.choice([0, 1, 5, 40, 500])) for g in ("a", "b", None) for i in range(30)] + [("e", 1, ""), ("n", 1, None)]
    df = spark.createDataFrame(rows, "g string, seq bigint, t string").repartition(4)
    for size in (1, 7, 64, 10_000):
        parts = {}
        for r in O.joined_parts(df, ["g"], "seq", F.col("t"), ", ", size, "x", BLOCK).collect():
            parts.setdefault(r.g, []).append((r.part, r.x))
        want = {g: ", ".join(t for k, _, t in rows if k == g) for g in ("a", "b", None, "e")}
        assert {g: "".join(x for _, x in sorted(p)) for g, p in parts.items()} == want
        assert all(len(x) == size for p in parts.values() for _, x in sorted(p)[:-1]) and all(len(x) <= size for p in parts.values() for _, x in p)
