"""Near-duplicates by SimHash fingerprints and the generalised pigeonhole principle.

The 64 bits are grouped into parts of correlated bits, and part i is given a radius r_i of its own (-1: not looked at).
Two fingerprints that differ in at most ``distance`` bits differ in at most r_i bits of some part i as long as the sum of
all (r_i + 1) is distance + 1: if every part differed by more, the differences would add up to more than the distance. Dynamic programming over the parts picks the
radii with the smallest estimated cost: rows that the probes make, and candidate pairs, from the statistics of all
fingerprints. Larger corpora get fewer, longer parts by the same sum.

A fingerprint is put under the key of each part (its bits there, and each pattern of up to r_i flipped bits); rows under
one key are candidates and are verified by counting differing bits. Keys are counted first. A key with more than
``HEAVY`` rows is cut finer before anything is grouped: its rows agree on the key, so the differences are in the other bits, which are cut
into distance + 1 parts again. This goes on until a key leaves at most ``LAST_BITS`` bits free, which bounds its number of
distinct fingerprints. Only distinct fingerprints take part, so copies make no rows. Instead of all pairs, a key emits
a spanning forest of its links; classes are its connected components.

Null and blank texts have fingerprint zero, linked like any other. Rows with equal ids each get their own fingerprint. A
group's component_id is its smallest non-null id. An empty table gives an empty result.

A text of any length is hashed whole, in blocks, in one task. Null, blank and empty texts have fingerprint zero and are linked
like others. Other columns than doc_id and text travel inside a struct, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from gleanmill.llm.common import checkpointed, packed, slices, unpacked
from gleanmill.llm.components import components

BITS = 64
SHINGLE = 3
SEED = 42
DISTANCE = 3
HEAVY = 1024
LAST_BITS = 16
# Cost of comparing a candidate pair, in rows made by a probe.
PAIR_COST = 0.003
_UNPACK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of a text as an unsigned number."""
    words = (text or b"").lower().split()  # on bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]  # noqa: B905
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), "<u8", n)
    ones = np.zeros(BITS, np.int64)
    for start in range(0, n, _UNPACK):
        block = hashes[start : start + _UNPACK].view(np.uint8)
        ones += np.unpackbits(block, bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, distinguish: bool = False) -> DataFrame:
    """doc_id, fp (signed 64 bits) of every row; ``distinguish`` adds key, a hash of the text."""
    extra = ["key"] if distinguish else []
    schema = "doc_id long, " + "key long, " * distinguish + "fp long"

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            fp = np.array(list(map(fingerprint, part.column("text").to_pylist())), np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ["doc_id", *extra]], pa.array(fp)], ["doc_id", *extra, "fp"])

    text = F.col("text").cast("string")
    columns = [F.col("doc_id").cast("long").alias("doc_id"), *([F.xxhash64(text).alias("key")] if distinguish else [])]
    return docs.select(*columns, text.cast("binary").alias("text")).mapInArrow(compute, schema)


@dataclass(frozen=True)
class Statistics:
    """Over all distinct fingerprints: their number, and on how many bits i and j are both set."""

    n: int
    both: np.ndarray


def statistics(distinct: DataFrame) -> Statistics:
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS), np.int64), 0
        for part in slices(batches, 1 << 14):
            fp = part.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            bits = np.unpackbits(fp.view(np.uint8), bitorder="little").reshape(-1, BITS).astype(np.float32)
            both += (bits.T @ bits).astype(np.int64)
            n += len(fp)
        place = np.append(np.arange(BITS * BITS), -1)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(np.append(both.ravel(), n))], ["place", "n"])

    sums = distinct.select("fp").mapInArrow(tally, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    flat, place = np.zeros(BITS * BITS + 1, np.int64), sums.column("place").to_numpy()
    flat[place] = sums.column("n").to_numpy()
    return Statistics(int(flat[-1]), flat[:-1].reshape(BITS, BITS))


def grouped_bits(stats: Statistics, parts: int) -> list[list[int]]:
    """The bits in ``parts`` parts of nearly equal size, correlated ones together: each part grows by the bit that goes best with it."""
    p = np.diag(stats.both) / max(1, stats.n)
    cov = stats.both / max(1, stats.n) - np.outer(p, p)
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    near = np.abs(cov / np.outer(scale, scale))
    np.fill_diagonal(near, 0)
    left, out = list(range(BITS)), []
    for k in range(parts, 0, -1):
        own = [max(left, key=lambda b: (near[b, left].sum(), -b))]
        left.remove(own[0])
        while len(own) < round((len(left) + len(own)) / k):
            own.append(max(left, key=lambda b: (near[b, own].sum(), -b)))  # noqa: B023
            left.remove(own[-1])
        out.append(own)
    return out


def within(stats: Statistics, bits: list[int], most: int) -> list[float]:
    """Estimated share of pairs that differ in at most 0, 1, ..., ``most`` of the bits.

    Whether a pair differs on a bit is taken to depend on the bit before it, as their joint frequencies say.
    """
    n = max(1, stats.n)
    one = np.diag(stats.both) / n
    count = np.zeros((2, most + 2))  # by: differs on the last bit; differences so far (the last entry: more)
    for k, b in enumerate(bits):
        differs = 2 * one[b] * (1 - one[b])
        if k == 0:
            count[0, 0], count[1, 1] = 1 - differs, differs
            continue
        a = bits[k - 1]
        p11 = stats.both[a, b] / n
        p10, p01 = one[a] - p11, one[b] - p11
        p00 = 1 - p11 - p10 - p01
        # Joint over pairs of fingerprints: (differ on a, differ on b).
        joint = np.array([[p00**2 + p01**2 + p10**2 + p11**2, 2 * (p00 * p01 + p10 * p11)], [2 * (p00 * p10 + p01 * p11), 2 * (p00 * p11 + p01 * p10)]])
        go = joint / np.maximum(joint.sum(1, keepdims=True), 1e-12)
        same, other = go[:, 0] @ count, go[:, 1] @ count
        moved = np.zeros(most + 2)
        moved[1:] = other[:-1]
        moved[-1] += other[-1]
        count = np.stack([same, moved])
    return np.cumsum(count.sum(0))[: most + 1].tolist()


@dataclass(frozen=True)
class Plan:
    parts: list[list[int]]
    radii: list[int]


def plan(stats: Statistics, distance: int = DISTANCE) -> Plan:
    """Parts and radii of the smallest estimated cost."""
    best: tuple[float, Plan] | None = None
    for parts in range(2, distance + 2):
        groups = grouped_bits(stats, parts)
        # cost[s]: of the parts so far, if their (radius + 1) sum up to s.
        cost: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for bits in groups:
            share = within(stats, bits, distance)
            price = [0.0] + [
                stats.n * sum(comb(len(bits), f) for f in range(r + 1)) + PAIR_COST * stats.n**2 / 2 * share[r] for r in range(distance + 1)]
            cost = {
                total: min((before + price[total - s], [*radii, total - s - 1]) for s, (before, radii) in cost.items() if 0 <= total - s <= distance + 1)
                for total in range(distance + 2)
            }
        found = (cost[distance + 1][0], Plan(groups, cost[distance + 1][1]))
        if best is None or found[0] < best[0]:
            best = found
    return best[1]


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _finer(mask: int, distance: int) -> list[int]:
    """The bits outside of a mask in distance + 1 parts."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    return [_mask(free[k :: distance + 1]) for k in range(distance + 1)]


def _forest(fp: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect the members of one key, at most one less than members."""
    todo = np.arange(len(fp))
    while len(todo) > 1:
        queue, todo = [todo[0]], todo[1:]
        while queue and len(todo):
            at = queue.pop()
            near = np.bitwise_count(fp[todo] ^ fp[at]) <= distance
            found = todo[near]
            if len(found):
                yield np.full(len(found), fp[at]), fp[found]
                queue.extend(found)
                todo = todo[~near]


def _links(mask: np.ndarray, key: np.ndarray, fp: np.ndarray, distance: int, few: int = 32) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of whole keys that lie next to each other."""
    start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (mask[1:] != mask[:-1])])
    size = np.diff(np.r_[start, len(key)])
    for s, n in zip(start[size > few], size[size > few], strict=True):
        yield from _forest(fp[s : s + n], distance)
    small = np.repeat(size <= few, size)
    group = np.repeat(np.arange(len(start)), size)[small]
    rest = fp[small]
    for step in range(1, few):
        pair = np.flatnonzero(group[step:] == group[:-step])
        if not len(pair):
            break
        a, b = rest[pair], rest[pair + step]
        close = np.bitwise_count(a ^ b) <= distance
        yield a[close], b[close]


def verified(keyed: DataFrame, distance: int, partitions: int) -> DataFrame:
    """a, b: links among the rows (mask, key, fp) of each key, none of which is heavy."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.empty((3, 0), np.int64)
        for part in slices(batches, 1 << 16):
            rows = np.hstack([kept, np.stack([part.column(k).to_numpy() for k in range(3)])])
            change = np.flatnonzero((rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1]))
            cut = change[-1] + 1 if len(change) else 0  # the last key may go on
            kept = rows[:, cut:]
            yield from emit(rows[:, :cut])
        yield from emit(kept)

    def emit(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if rows.shape[1]:
            # Unsigned: numpy counts the bits of the absolute value of signed numbers.
            for a, b in _links(rows[0], rows[1], np.ascontiguousarray(rows[2]).view(np.uint64), distance):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    # Dealt by a hash of the key: Spark leaves out a repartition by columns that a join before it has already dealt by, and once it
    # makes that join a broadcast at run time, it reads the join's shuffle where it lies and spreads a key over many tasks.
    dealt = keyed.select("mask", "key", "fp").repartition(partitions, F.xxhash64("mask", "key")).sortWithinPartitions("mask", "key", "fp")
    return dealt.mapInArrow(link, "a long, b long")


def links(distinct: DataFrame, distance: int = DISTANCE, heavy: int = HEAVY) -> DataFrame:
    """a, b: enough links between fingerprints (column fp, distinct, stored) to connect all that are linked."""
    spark = distinct.sparkSession
    chosen = plan(statistics(distinct), distance)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    masks, probes = [], []
    for bits, radius in zip(chosen.parts, chosen.radii, strict=True):
        if radius >= 0:
            masks.append(_mask(bits))
            probes += [(_mask(bits), _mask(list(flip))) for size in range(radius + 1) for flip in combinations(bits, size)]
    both = F.array(*[F.struct(F.lit(_signed(m)).cast("long").alias("mask"), F.lit(_signed(f)).cast("long").alias("flip")) for m, f in probes])
    rows = distinct.select("fp", F.explode(both).alias("p")).select(
        F.col("p.mask").alias("mask"), F.col("fp").bitwiseXOR(F.col("p.flip")).bitwiseAND(F.col("p.mask")).alias("key"), "fp")
    out = None
    while True:
        last = all(BITS - m.bit_count() <= LAST_BITS for m in masks)
        crowded = None if last else checkpointed(rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > heavy).select("mask", "key"))
        done = last or crowded.isEmpty()
        found = verified(rows if done else rows.join(crowded, ["mask", "key"], "left_anti"), distance, partitions)
        out = found if out is None else out.unionByName(found)
        if done:
            return out
        cut = [(m, s) for m in masks for s in _finer(m, distance)]
        finer = F.create_map(*[x for m in masks for x in (
            F.lit(_signed(m)).cast("long"), F.array(*[F.lit(_signed(s)).cast("long") for s in _finer(m, distance)]))])
        rows = checkpointed(
            rows.join(crowded, ["mask", "key"], "left_semi").withColumn("sub", F.explode(F.element_at(finer, F.col("mask")))).select(
                F.col("mask").bitwiseOR(F.col("sub")).alias("mask"), F.col("key").bitwiseOR(F.col("fp").bitwiseAND(F.col("sub"))).alias("key"), "fp"))
        masks = sorted({m | s for m, s in cut})


def _grouped(prints: DataFrame, distance: int) -> DataFrame:
    """fp, component (the smallest fingerprint of its class) for stored ``prints``; classes of one are left out."""
    return components(links(checkpointed(prints.select("fp").distinct()), distance))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (hex), component_id of every row."""
    prints = checkpointed(fingerprints(docs))
    members = _grouped(prints, distance)
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    joined = first.join(members.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    by_print = joined.join(smallest, "component").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The document with the smallest id of each class (null ids last), whole and with all columns; one row of repeated ones."""
    prints = checkpointed(fingerprints(docs, distinguish=True))
    return keep_first(docs, prints, _grouped(prints, distance))


def keep_first(docs: DataFrame, prints: DataFrame, members: DataFrame) -> DataFrame:
    """The document that comes first in each class, from ``prints`` (doc_id, key, fp of every row) and ``members`` (node, component)."""
    rank = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id"), F.col("key"))
    first = prints.groupBy("fp").agg(F.min(rank).alias("first"))
    joined = first.join(members.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    kept = joined.groupBy("component").agg(F.min("first").alias("kept")).select(F.col("kept.doc_id").alias("_doc"), F.col("kept.key").alias("_key"))
    copies = prints.groupBy(F.col("doc_id").alias("_doc2"), F.col("key").alias("_key2")).agg(F.count(F.lit(1)).alias("_rows"))
    kept = kept.join(copies, F.col("_doc").eqNullSafe(F.col("_doc2")) & (F.col("_key") == F.col("_key2"))).select("_doc", "_key", "_rows")
    found = packed(docs, "doc_id", "text").join(
        kept, F.col("doc_id").cast("long").eqNullSafe(F.col("_doc")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_key"))
    ).select("row", "_doc", "_key", "_rows")
    rank_in = F.row_number().over(Window.partitionBy("_doc", "_key").orderBy(F.lit(1)))
    several = found.where("_rows > 1").withColumn("n", rank_in).where("n = 1").drop("n")
    return unpacked(found.where("_rows = 1").unionByName(several), docs.columns)
