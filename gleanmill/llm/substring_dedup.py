"""Exact substring deduplication with fixed-block anchors.

A repeat of ``WINDOW`` words or more contains, wherever it lies in the earlier document, one whole block of ``BLOCK``
words whose place is a multiple of BLOCK. So only those blocks of each document are indexed, and the blocks at all
places of each document (rolling windows) probe the index. A hit says that a block is shared by two documents; all
13-word windows around hits are compared across documents, and runs of windows that an earlier document has too are the
maximal exact repeats. Their words go.

Documents are dealt once to groups of some megabytes by a hash, and their text is shuffled just that once. Groups send
out hashes, not rows of words:
  1. Per group and hash bucket, the low 32 bits of probe and index hashes, each value once. A bucket finds the values
     that two documents share, one of them as a block, and sends each group those it has. With the bucket that makes
     some 32 + log2(buckets) bits; a chance hit costs work, not correctness.
  2. Per group and bucket, 64-bit hashes of the windows around hits, each with the smallest id in the group. A bucket
     finds the smallest id of all groups and sends back the windows that a smaller document of another group has.
  3. A group adds what repeats inside of it and removes the words covered.
Group and bucket numbers grow with the input, so both stay at a few megabytes. A value that many documents share is sent
once by each group, so hot passages and copies make no large bucket.

Null and blank texts have no words. Null ids rank after all others; rows with equal ids never remove each other's words.
Equal windows inside one document stay. An empty table gives an empty result.

A text of any length is cut whole, in one task. :func:`without_repeats` carries other columns inside a struct, so their names
cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

WINDOW = 13
BLOCK = (WINDOW + 1) // 2
GROUP_BYTES = 8 << 20
_NO_ID = (1 << 63) - 1
_MULTIPLIER = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1

BLOBS = "bucket int, g int, probes binary, blocks binary"
HITS = "g int, bucket int, low binary"
WINDOWS = "bucket int, g int, hashes binary, docs binary"
FOREIGN = "g int, hashes binary"


def _rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of ``width`` consecutive word hashes at every place, by doubling steps; shorter at the end of the array."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out *= np.uint64(_MULTIPLIER)
        out += h[k : k + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


class Group:
    """The documents of one group in order of id, with the hashes of their words one after the other."""

    def __init__(self, rows: pa.Table) -> None:
        ids = np.array([_NO_ID if x is None else x for x in rows.column("doc_id").to_pylist()], np.int64)
        self.order = np.argsort(ids, kind="stable")
        self.ids = ids[self.order]
        text = rows.column("text").to_pylist()
        hashes, sizes = [], []
        for k in self.order.tolist():
            words = (text[k] or b"").split()
            sizes.append(len(words))
            hashes.append(np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words)))
        self.text = text
        self.size = np.array(sizes, np.int64)
        self.hash = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        self.begin = np.cumsum(self.size) - self.size
        self.doc = np.repeat(np.arange(len(sizes)), self.size)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Place and hash of every window that lies in one document."""
        h = _rolling(self.hash, width)
        place = np.flatnonzero(self.doc[: len(h)] == self.doc[width - 1 :])
        return place, h[place]


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The runs of equal buckets in a sorted array."""
    if len(bucket):
        start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        for s, e in zip(start.tolist(), [*start[1:].tolist(), len(bucket)], strict=True):
            yield int(bucket[s]), slice(s, e)


def _anchor_key(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in the high half, what is compared in the low half."""
    return ((h >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))


def _low(keys: np.ndarray) -> bytes:
    return keys.astype("<u4").tobytes()


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.Table.from_arrays([pa.array(list(c), types[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _send_anchors(buckets: int, block: int):
    def send(rows: pa.Table) -> pa.Table:
        g, group = rows.column("g")[0].as_py(), Group(rows)
        place, h = group.windows(block)
        key, doc = _anchor_key(h, buckets), group.ids[group.doc[place]]
        order = np.argsort(key, kind="stable")  # ids ascend within a key
        first = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0]) if len(key) else np.empty(0, np.int64)
        last = np.r_[first[1:], len(key)][: len(first)] - 1
        unique, shared = key[order][first], doc[order][first] != doc[order][last]
        # A value that two documents of the group share is sent twice: it is shared already.
        probes = np.repeat(unique, 1 + shared)
        blocks = np.unique(key[(place - group.begin[group.doc[place]]) % block == 0])
        at = {b: s for b, s in _by_bucket(blocks >> np.uint64(32))}
        return _table(BLOBS, [
            (b, g, _low(probes[s]), _low(blocks[at[b]]) if b in at else b"") for b, s in _by_bucket(probes >> np.uint64(32))])

    return send


def _match_anchors(rows: pa.Table) -> pa.Table:
    bucket = rows.column("bucket")[0].as_py()
    probes = [np.frombuffer(x, "<u4") for x in rows.column("probes").to_pylist()]
    every = np.sort(np.concatenate(probes))
    shared = np.unique(every[1:][every[1:] == every[:-1]])
    blocks = np.unique(np.concatenate([np.frombuffer(x, "<u4") for x in rows.column("blocks").to_pylist()]))
    shared = shared[np.isin(shared, blocks, assume_unique=True)]
    out = []
    for g, own in zip(rows.column("g").to_pylist(), probes, strict=True):
        own = own[np.r_[True, own[1:] != own[:-1]]]
        found = own[np.isin(own, shared, assume_unique=True)]
        if len(found):
            out.append((g, bucket, found.tobytes()))
    return _table(HITS, out)


def _send_windows(buckets: int, block: int, window: int):
    def send(rows: pa.Table, hits: pa.Table) -> pa.Table:
        if not rows.num_rows or not hits.num_rows:
            return _table(WINDOWS, [])
        g, group = rows.column("g")[0].as_py(), Group(rows)
        keys = np.sort(np.concatenate([
            np.uint64(b << 32) | np.frombuffer(x, "<u4").astype(np.uint64)
            for b, x in zip(hits.column("bucket").to_pylist(), hits.column("low").to_pylist(), strict=True)]))
        place, h = group.windows(block)
        hit = np.zeros(len(group.hash) + 1, np.int64)
        hit[place] = _member(keys, _anchor_key(h, buckets))
        before = np.r_[0, np.cumsum(hit)]
        place, h = group.windows(window)
        near = before[place + window - block + 1] > before[place]  # some block inside of the window is a hit
        place, h = place[near], h[near]
        _, first = np.unique(h, return_index=True)  # the first place has the smallest id
        place, h = place[first], h[first]
        bucket = (h % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((place, bucket))
        h, docs, bucket = h[order], group.ids[group.doc[place[order]]], bucket[order]
        return _table(WINDOWS, [(b, g, h[s].astype("<u8").tobytes(), docs[s].astype("<i8").tobytes()) for b, s in _by_bucket(bucket)])

    return send


def _member(ordered: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _match_windows(rows: pa.Table) -> pa.Table:
    hashes = [np.frombuffer(x, "<u8") for x in rows.column("hashes").to_pylist()]
    docs = [np.frombuffer(x, "<i8") for x in rows.column("docs").to_pylist()]
    every, ids = np.concatenate(hashes), np.concatenate(docs)
    order = np.argsort(every, kind="stable")
    start = np.flatnonzero(np.r_[True, np.diff(every[order]) != 0])
    least = np.minimum.reduceat(ids[order], start)
    smallest = np.empty_like(ids)
    smallest[order] = np.repeat(least, np.diff(np.r_[start, len(every)]))
    out, at = [], 0
    for g, own, doc in zip(rows.column("g").to_pylist(), hashes, docs, strict=True):
        earlier = smallest[at : at + len(own)] < doc
        at += len(own)
        if earlier.any():
            out.append((g, own[earlier].tobytes()))
    return _table(FOREIGN, out)


def _covered(group: Group, foreign: np.ndarray, window: int) -> np.ndarray:
    """Which words lie in a window that a document with a smaller id has too."""
    place, h = group.windows(window)
    bad = _member(foreign, h)
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    doc = group.ids[group.doc[place]]
    bad |= doc[first][inverse] < doc
    edge = np.zeros(len(group.hash) + 1, np.int64)
    np.add.at(edge, place[bad], 1)
    np.add.at(edge, place[bad] + window, -1)
    return np.cumsum(edge[:-1]) > 0


def _spans(covered: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.r_[0, covered.astype(np.int8), 0]))
    return [{"begin": b, "end": e} for b, e in edge.reshape(-1, 2).tolist()]


def _cut(window: int, with_text: bool):
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def cut(rows: pa.Table, foreign: pa.Table) -> pa.Table:
        group = Group(rows)
        hashes = [np.frombuffer(x, "<u8") for x in foreign.column("hashes").to_pylist()]
        covered = _covered(group, np.sort(np.concatenate(hashes)) if hashes else np.empty(0, np.uint64), window)
        gone, digest, kept, spans = [], [], [], []
        for k, b, n in zip(group.order.tolist(), group.begin.tolist(), group.size.tolist(), strict=True):
            own = covered[b : b + n]
            words = (group.text[k] or b"").split()
            left = b" ".join([words[i] for i in np.flatnonzero(~own).tolist()] if own.any() else words)
            gone.append(int(own.sum()))
            digest.append(hashlib.sha256(left).hexdigest())
            spans.append(_spans(own))
            if with_text:
                kept.append(left)
        out = pa.table({
            "doc_id": rows.column("doc_id").take(pa.array(group.order)), "n_words": pa.array(group.size), "n_removed": pa.array(gone, pa.int64()),
            "kept_sha256": pa.array(digest, pa.string()), "repeats": pa.array(spans, span)})
        if with_text:
            out = out.append_column("kept", pa.array(kept, pa.binary())).append_column("row", rows.column("row").take(pa.array(group.order)))
        return out

    return cut


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_rows: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and repeats (spans of removed words) of every row.

    ``with_rows`` adds kept (the words left, joined by blanks, as bytes) and row, the struct column of that name in ``docs``.
    """
    block = (window + 1) // 2
    text = F.col("text").cast("string")
    size = docs.select(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    groups = max(1, -(-size // GROUP_BYTES))
    extra = ["row"] if with_rows else []
    dealt = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("text"), *extra,
        F.pmod(F.xxhash64("doc_id", text), F.lit(groups)).cast("int").alias("g"),
    ).repartition(groups, "g")
    by_group = dealt.groupBy("g")
    hits = by_group.applyInArrow(_send_anchors(groups, block), BLOBS).groupBy("bucket").applyInArrow(_match_anchors, HITS)
    windows = by_group.cogroup(hits.groupBy("g")).applyInArrow(_send_windows(groups, block, window), WINDOWS)
    foreign = windows.groupBy("bucket").applyInArrow(_match_windows, FOREIGN)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, repeats array<struct<begin: bigint, end: bigint>>"
    if with_rows:
        schema += f", kept binary, row {dealt.schema['row'].dataType.simpleString()}"
    return by_group.cogroup(foreign.groupBy("g")).applyInArrow(_cut(window, with_rows), schema)


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the repeated words taken out of ``text``.

    A text that loses nothing stays as it is, null included; of others the words left are joined by single blanks. Every
    row stays, with an empty text if nothing is left of it.
    """
    columns = docs.columns
    row = F.struct(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(columns)])
    found = remove_repeats(docs.select(docs["doc_id"], docs["text"], row.alias("row")), window, with_rows=True)
    kept = F.when(F.col("n_removed") > 0, F.col("kept").cast("string"))
    return found.select(*[
        (F.coalesce(kept, F.col(f"row.c{i}")) if c == "text" else F.col(f"row.c{i}")).alias(c) for i, c in enumerate(columns)])
