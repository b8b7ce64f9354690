"""The manifest against a plain one that sorts and hashes in Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from gleanmill.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, grp string, rank int"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(r):
    return h("".join(field(v) for v in (r[0], r[3], r[2], r[4], r[1])))


def tree(nodes):
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [h("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
        levels.append(nodes)
    return levels


def siblings(levels, i):
    for level in levels[:-1]:
        if i ^ 1 < len(level):
            yield i & 1, level[i ^ 1]
        else:
            yield 0, ""
        i >>= 1


def plain(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in langs}
    trees = {g: tree([leaf(r) for r in rs]) for g, rs in groups.items()}
    top = tree([trees[g][-1][0] for g in langs])
    out = []
    for g, rs in groups.items():
        for i, r in enumerate(rs):
            steps = [*siblings(trees[g], i), *siblings(top, langs.index(g))]
            changed = r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            now = leaf((*r[:4], r[4] + 1)) if changed else leaf(r)
            for odd, s in steps:
                now = h(s + now) if odd else h(now + s)
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], h("".join(s for _, s in steps)), now, now == top[-1][0]))
    return sorted(out, key=repr)


def check(spark, rows, partitions=5):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(partitions)
    altered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    got = sorted((tuple(r) for r in merkle.verified(df, altered).collect()), key=repr)
    assert got == plain(rows)
    return got


def test_two_levels_of_tiles_sparse_and_dense_ids(spark):
    rng = random.Random(3)
    dense = [(i, f"text {i}", "en", "s", i) for i in range(2300)]
    sparse = [(rng.randrange(-(1 << 62), 1 << 62), "ü" * (i % 5), "de", None, None) for i in range(40)]
    edges = [(v, "e", None, "s", 2) for v in (-1, 0, 63, 64, 4095, 4096, (1 << 63) - 1, -(1 << 63), 127)]
    got = check(spark, dense + sparse + edges)
    assert 0 < sum(not r[-1] for r in got) < len(got)


def test_nulls_repeated_ids_and_equal_rows(spark):
    rows = [(None, "a", "en", "s", 1), (None, None, "en", None, None), (7, "x", "en", "s", 1), (7, "x", "en", "s", 1), (7, "y", "en", "s", 2),
            (8, "", "en", "", 0), (3, "x", "", "s", 1), (3, "x", None, "s", 1), (3, "x", "-", "s", 1), (9, "z", "en", "s", 1), (8, "q", "en", "s", 1)]
    check(spark, rows)


def test_one_row_and_no_row(spark):
    check(spark, [(5, "only", "fr", "s", 4)], 1)
    assert merkle.verified(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_long_path_is_refused():
    leaves = [bytes([i]) * 32 for i in range(2)]
    assert merkle.folded(leaves[0], leaves[1], [(0, 2)]) == merkle.node(*leaves)
    with pytest.raises(ValueError):
        merkle.folded(leaves[0], b"".join(leaves), [(0, 2)])
