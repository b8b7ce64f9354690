"""SimHash near-duplicates against all pairs, and the parts of the method."""

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from gleanmill.llm import simhash as S
from gleanmill.llm.components import components

WORDS = [f"w{i}" for i in range(400)]


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(
        str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """component_id of each (doc_id, fingerprint), over all pairs."""
    values = sorted({f for _, f in prints})
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    least = {}
    for doc, f in prints:
        if doc is not None:
            least[find(f)] = min(least.get(find(f), doc), doc)
    return [(doc, f"{f:016x}", least.get(find(f))) for doc, f in prints]


def near_copies():
    rng = np.random.default_rng(3)
    base = rng.choice(WORDS, 900).tolist()
    rows = [(100 + i, " ".join(base[: 300 + 2 * i] + base[301 + 2 * i :])) for i in range(60)]
    rows += [(i, " ".join(rng.choice(WORDS, 80))) for i in range(40)]
    rows += [(500, None), (501, ""), (502, " \n "), (503, "One"), (504, "one"), (505, "ÀB c"), (506, "Àb C"), (77, "again a row"), (77, "another row"),
             (None, "again a row"), (None, "nobody else has this"), (600, "long " * 50_000)]
    return rows


@pytest.mark.parametrize("heavy", [1024, 3])
def test_components_match_all_pairs(spark, heavy, monkeypatch):
    monkeypatch.setattr(S.links, "__defaults__", (3, heavy))
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(map(tuple, S.near_duplicates(docs).collect()), key=str)
    want = sorted(plain_components([(d, plain_fingerprint(t)) for d, t in rows]), key=str)
    assert got == want
    assert len({c for _, _, c in want}) < len(want) - 60


def test_random_close_fingerprints(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = [np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for k in (1, 2, 3, 4, 5) for _ in range(8)]
    values = sorted({int(b) ^ int(f) for b in base[:20] for f in flips} | {int(b) for b in base})
    fps = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    for heavy in (1024, 4):
        found = {(r.node, r.component) for r in components(S.links(fps, heavy=heavy)).collect()}
        groups = {}
        for node, component in found:
            groups.setdefault(component, set()).add(node & (1 << 64) - 1)
        want = {}
        for (d, _, c) in plain_components([(v, v) for v in values]):
            want.setdefault(c, set()).add(d)
        assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_keys_stay_whole_when_the_join_before_turns_into_a_broadcast(spark):
    # As at size: a join planned as a sort-merge join, whose small side is known only at run time, in more than one partition.
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m",
        "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    pairs = [(255, key, key + 256 * x) for x in (0, 1) for key in range(100)]
    rows = spark.createDataFrame(pairs, "mask long, key long, fp long").repartition(4).localCheckpoint()
    heavy = spark.createDataFrame([(255, key) for key in range(80, 160)], "mask long, key long")
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        keyed = rows.join(heavy, ["mask", "key"], "left_anti")
        found = S.verified(keyed, 3, int(spark.conf.get("spark.sql.shuffle.partitions"))).collect()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert sorted(tuple(sorted(r)) for r in found) == [(key, key + 256) for key in range(80)]


def test_radii_obey_the_pigeonhole_sum():
    rng = np.random.default_rng(0)
    for n in (10, 10**6, 10**10, 10**13):
        bits = rng.random((500, 64)) < rng.random(64)
        both = (bits.T.astype(int) @ bits.astype(int)) * n // 500
        plan = S.plan(S.Statistics(n, both))
        assert sorted(b for p in plan.parts for b in p) == list(range(64))
        assert sum(r + 1 for r in plan.radii) == S.DISTANCE + 1 and min(plan.radii) >= -1
    assert len(S.plan(S.Statistics(10**13, both)).parts) < 4


def test_correlated_bits_share_a_part():
    rng = np.random.default_rng(1)
    half = rng.integers(0, 2, (2000, 32))
    bits = np.hstack([half, half])  # bit b goes with bit b + 32
    parts = S.grouped_bits(S.Statistics(2000, bits.T @ bits), 4)
    assert all((b + 32 in p) for p in parts for b in p if b < 32)


def test_keep_one_of_each_group(spark):
    rows = [(d, t, f"s{d}", 1) for d, t in near_copies() if t != "another row"] + [(77, "again a row", "s77", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, _key int")
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    classes = {}
    for (d, t, _, _), (_, _, c) in zip(rows, plain_components([(d, plain_fingerprint(t)) for d, t, _, _ in rows]), strict=True):
        classes.setdefault(c if c is not None else t, []).append((d is None, d, t))
    assert len(got) == len(classes)
    assert sorted(str(d) for d, _ in got) == sorted(str(min(m, key=lambda x: (x[0], x[1] or 0))[1]) for m in classes.values())


def test_rows_with_equal_ids_and_other_texts_are_told_apart(spark):
    docs = spark.createDataFrame([(77, "again a row"), (77, "another row"), (7, "again a row")], "doc_id long, text string")
    assert sorted(r.text for r in S.keep_one(docs).collect()) == ["again a row", "another row"]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(docs).count() == 0 and S.keep_one(docs).count() == 0


def test_components_of_paths_stars_and_loops(spark):
    path = [(i, i + 1) for i in range(300)]
    edges = path + [(1000, 1000 + i) for i in range(1, 50)] + [(5000, 5000), (6000, 6001), (6001, 6000), (6000, 6001)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(301)} == {0} and {got[1000 + i] for i in range(50)} == {1000}
    assert got[6001] == 6000 and 5000 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
