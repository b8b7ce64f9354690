"""Harmonic packing of token sequences.

Lengths are cut into reciprocal-capacity classes: class k holds pieces of exactly capacity / k tokens, and k of them fill
a bin. With a capacity of 2048 the classes k = 1, 2, 4, ... divide it, so a document is cut into full sequences and the
powers of two that its rest is made of, and every bin is full. Workers fill bins independently: pieces are dealt to
groups by a hash, and in a group the n-th piece of a class goes to bin n div k. What does not fill a bin is packed in
descending order of length within the group; its last sequence is cut at powers of two, which need no padding either.

Null and empty texts are one end token. Rows with equal ids are packed one by one; where also place and
checksum are equal, the pieces are interchangeable. An empty table has no pieces.

A text of any length is encoded whole, in one task. Only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanmill.llm.common import slices
from gleanmill.llm.tokenizing import worker_encoder

CAPACITY = 2048
END_ID = 1


def cuts(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of n tokens: full sequences, then the powers of two of the rest, largest first."""
    full, rest = divmod(n, capacity)
    return [capacity] * full + [1 << b for b in range(capacity.bit_length() - 2, -1, -1) if rest >> b & 1]


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids, little-endian 32-bit) of every piece of every row."""
    if capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    end = np.array([end_id], "<u4").tobytes()
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # what earlier jobs left in this worker, beside what the encoder will remember
        encoder = worker_encoder(tokenizer_path, blank_kept=False)
        for part in slices(batches, 512):
            rows: list[tuple] = []
            for doc, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(part.column("text")), strict=True):
                ids += end
                n, start = len(ids) // 4, 0
                view = memoryview(ids)
                for length in cuts(n, capacity):
                    own = view[4 * start : 4 * (start + length)]
                    rows.append((doc, start, length, zlib.crc32(own), n, *([bytes(own)] if with_ids else [])))
                    start += length
            columns = list(zip(*rows, strict=True))
            types = [pa.int64()] * 5 + [pa.binary()] * with_ids
            names = [c.split()[0] for c in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, schema)


def pack(found: DataFrame, capacity: int = CAPACITY, groups: int | None = None) -> DataFrame:
    """``found`` (doc_id, start, length, ...) with sequence_id and offset.

    ``groups`` workers fill bins on their own; the session's number of shuffle partitions by default. Results depend on it.
    """
    spark = found.sparkSession
    groups = groups or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id"), F.col("start"), F.col("ids_crc32")]
    df = found.withColumn("_group", F.pmod(F.xxhash64("doc_id", "start", "length"), F.lit(groups))).repartition(groups, "_group")
    cell = Window.partitionBy("_group", "length")
    fit = F.lit(capacity) / F.col("length")
    df = df.withColumns({"_rank": F.row_number().over(cell.orderBy(*order)) - 1, "_n": F.count(F.lit(1)).over(cell)})
    df = df.withColumn("_bin", F.floor(F.col("_rank") / fit).cast("long"))
    df = df.withColumn("_full", (F.col("_bin") + 1) * fit <= F.col("_n"))
    # The rest of a group: fewer than k pieces of each class. Lengths are powers of two and descend, so no piece crosses a bin.
    rest = Window.partitionBy("_group", "_full").orderBy(F.desc("length"), *order)
    before = F.coalesce(F.sum("length").over(rest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("length").over(Window.partitionBy("_group", "_full"))
    df = df.withColumns({"_before": before, "_total": total})
    at = F.col("_before") % capacity
    last = F.col("_total") - F.col("_before") + at  # tokens of this piece's bin, if it is the last
    # In the last bin, the sequence begins at the highest multiple of a power of two below: one sequence for each binary digit.
    begin, width = F.lit(0), F.lit(0)
    for power in reversed(range(capacity.bit_length() - 1)):
        inside = (last.bitwiseAND(F.lit(1 << power)) != 0) & (at >= (last.bitwiseAND(F.lit(-(2 << power)))))
        begin = F.when(inside, last.bitwiseAND(F.lit(-(2 << power)))).otherwise(begin)
        width = F.when(inside, F.lit(1 << power)).otherwise(width)
    split = last < capacity
    # Identifiers: group, then class of a full bin (length) or the kind of rest (0 full, or minus the width), then bin.
    slot = F.when(F.col("_full"), F.log2("length").cast("int")).when(~split, F.lit(15)).otherwise(16 + F.log2(width).cast("int"))
    number = F.when(F.col("_full"), F.col("_bin")).otherwise(F.floor(F.col("_before") / capacity).cast("long"))
    offset = F.when(F.col("_full"), (F.col("_rank") % fit) * F.col("length")).when(~split, at).otherwise(at - begin)
    return df.withColumns({
        "sequence_id": ((number * 32 + slot) * groups + F.col("_group")).cast("long"),
        "offset": offset.cast("long"),
    }).drop("_group", "_rank", "_n", "_bin", "_full", "_before", "_total")


def sequences(packed_pieces: DataFrame) -> DataFrame:
    """sequence_id, n_tokens and ids (little-endian 32-bit) of every sequence, from packed pieces with their ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = packed_pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts"))
    return joined.select("sequence_id", "n_tokens", F.concat_ws("", F.transform("parts", lambda p: F.hex(p["ids"]))).alias("hex")).select(
        "sequence_id", "n_tokens", F.unhex("hex").alias("ids"))
