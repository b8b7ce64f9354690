"""Token ids in binary files, coded by a static range asymmetric numeral system (rANS).

Documents are dealt out by ranges of doc_id, sorted and encoded in that order. A frame holds whole documents of some
millions of tokens. Its header carries one table of symbol frequencies that sum up to 2 ** SCALE; all blocks of the frame
share it. A block codes up to BLOCK tokens on its own: token i belongs to lane i mod LANES, each lane is a 64-bit coder
state, and all lanes write 32-bit words to one stream. The block index is a list of checkpoints: where the block's words
begin, its number of tokens, its crc32, and (in the block) the final state of each lane, from which decoding starts.
Blocks can thus be decoded in any order and in parallel, and damage is found.

Frames are the rows of a Parquet table (part, frame, doc_ids, lengths, payload), written and committed by Spark. The
position of a document in the whole stream is the sum of the tokens of earlier parts, earlier frames of its part and
earlier documents of its frame; payloads are not read for that.

Null and empty texts are one end token. Equal ids stay next to each other in some order that the file fixes; null ids come
first. An empty table gives no frames.

A text of any length is encoded whole, in one task, and never split over frames. Only doc_id and text are read, so other columns
cannot clash.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanmill.llm.common import slices, stored
from gleanmill.llm.tokenizing import worker_encoder

END_ID = 2
SCALE = 20
LANES = 4096
BLOCK = LANES * 64
FRAME_TOKENS = 2_000_000
MAGIC = b"GMRANS1\n"
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)
_BITS = np.uint64(SCALE)


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts (all above 0) scaled to sum up to 2 ** SCALE, none below 1; the most frequent symbols take the rounding."""
    scale = 1 << SCALE
    if len(counts) > scale:
        raise ValueError(f"more than {scale} different symbols")
    scaled = np.maximum(1, counts * (scale - len(counts)) // max(1, int(counts.sum()))).astype(np.int64)
    scaled[np.argmax(counts)] += scale - scaled.sum() if len(counts) else 0
    return scaled


class Table:
    """Symbols with their share of the number range."""

    def __init__(self, symbols: np.ndarray, freq: np.ndarray) -> None:
        self.symbols = symbols
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.slots = np.repeat(np.arange(len(freq), dtype=np.int32), freq)

    def encode(self, ranks: np.ndarray) -> bytes:
        """One block: the number of words, the words in reading order, the final states."""
        lanes = min(LANES, len(ranks))
        state = np.full(lanes, _LOW, np.uint64)
        words: list[np.ndarray] = []
        for begin in range((len(ranks) - 1) // lanes * lanes, -1, -lanes):
            rank = ranks[begin : begin + lanes]
            freq, x = self.freq[rank], state[: len(rank)]
            full = x >= (freq << np.uint64(63 - SCALE))
            words.append(x[full].astype("<u4"))
            x = np.where(full, x >> _WORD, x)
            quotient = x // freq
            state[: len(rank)] = (quotient << _BITS) + (x - quotient * freq) + self.start[rank]
        stream = np.concatenate(words[::-1])
        return struct.pack("<I", len(stream)) + stream.tobytes() + state.astype("<u8").tobytes()

    def decode(self, data: memoryview, n: int) -> np.ndarray:
        lanes = min(LANES, n)
        (count,) = struct.unpack_from("<I", data)
        words = np.frombuffer(data, "<u4", count, 4).astype(np.uint64)
        state = np.frombuffer(data, "<u8", lanes, 4 + 4 * count).astype(np.uint64)
        out, at, mask = np.empty(n, np.int32), 0, np.uint64((1 << SCALE) - 1)
        for begin in range(0, n, lanes):
            x = state[: min(lanes, n - begin)]
            slot = x & mask
            rank = self.slots[slot]
            out[begin : begin + len(x)] = rank
            x = self.freq[rank] * (x >> _BITS) + slot - self.start[rank]
            low = np.flatnonzero(x < _LOW)
            x[low] = (x[low] << _WORD) | words[at : at + len(low)]
            at += len(low)
            state[: len(x)] = x
        if at != count or np.any(state != _LOW):
            raise ValueError("damaged block: the coder did not end where it began")
        return out


def _counted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different ids in order, the rank of each id among them, and how often each occurs."""
    if len(ids) and int(ids.max()) >= 1 << 24:  # a table by id would be larger than a sort
        return np.unique(ids, return_inverse=True, return_counts=True)
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    rank = np.zeros(len(counts), np.int32)
    rank[symbols] = np.arange(len(symbols))
    return symbols, rank[ids], counts[symbols]


def encode_frame(ids: np.ndarray) -> bytes:
    """Magic, table, checkpoints, blocks."""
    symbols, ranks, counts = _counted(ids)
    freq = frequencies(counts)
    table = Table(symbols, freq)
    blocks = [table.encode(ranks[b : b + BLOCK]) for b in range(0, len(ids), BLOCK)]
    head = [MAGIC, struct.pack("<QII", len(ids), len(symbols), len(blocks)), symbols.astype("<u4").tobytes(), freq.astype("<u4").tobytes()]
    at = 0
    for b, block in enumerate(blocks):
        own = ids[b * BLOCK : (b + 1) * BLOCK]
        head.append(struct.pack("<QII", at, len(own), zlib.crc32(own.astype("<u4").tobytes())))
        at += len(block)
    return b"".join(head + blocks)


def decode_frame(payload: bytes, only: range | None = None) -> np.ndarray:
    """The ids of a frame, or of some of its blocks."""
    if payload[: len(MAGIC)] != MAGIC:
        raise ValueError("not a frame of token ids")
    _, n_symbols, n_blocks = struct.unpack_from("<QII", payload, len(MAGIC))
    at = len(MAGIC) + 16
    symbols = np.frombuffer(payload, "<u4", n_symbols, at)
    freq = np.frombuffer(payload, "<u4", n_symbols, at + 4 * n_symbols).astype(np.int64)
    index = at + 8 * n_symbols
    body = memoryview(payload)[index + 16 * n_blocks :]
    table, parts = Table(symbols, freq), []
    for b in only if only is not None else range(n_blocks):
        place, n, checksum = struct.unpack_from("<QII", payload, index + 16 * b)
        ids = symbols[table.decode(body[place:], n)]
        if zlib.crc32(ids.tobytes()) != checksum:
            raise ValueError(f"damaged block {b}: wrong checksum")
        parts.append(ids)
    return np.concatenate(parts) if parts else np.empty(0, "<u4")


FRAME_SCHEMA = "part int, frame int, doc_ids array<bigint>, lengths array<bigint>, payload binary"


def frames(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, parts: int | None = None) -> DataFrame:
    """The frames of all documents in ascending order of doc_id."""
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = worker_encoder(tokenizer_path, blank_kept=True), TaskContext.get().partitionId()
        docs_, sizes, texts, total, frame = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            payload = encode_frame(np.frombuffer(b"".join(texts), "<u4"))
            row = {"part": part, "frame": frame, "doc_ids": docs_, "lengths": sizes, "payload": payload}
            schema = pa.schema([("part", pa.int32()), ("frame", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
                                ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])
            return pa.RecordBatch.from_pylist([row], schema)

        for piece in slices(batches, 512):
            for doc, ids in zip(piece.column("doc_id").to_pylist(), encoder.encode(piece.column("text")), strict=True):
                docs_.append(doc)
                sizes.append(len(ids) // 4 + 1)
                texts += ids, end
                total += sizes[-1]
                if total >= FRAME_TOKENS:
                    yield flush()
                    docs_, sizes, texts, total, frame = [], [], [], 0, frame + 1
        if docs_:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange(parts, "doc_id")
    return ordered.sortWithinPartitions("doc_id").mapInArrow(write, FRAME_SCHEMA)


def write_files(docs: DataFrame, tokenizer_path: str, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the frames (to ``path``, else a table of the session) and return the written table."""
    made = frames(docs, tokenizer_path, end_id)
    if path is None:
        return stored(made, "token-files")
    made.write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.schema(FRAME_SCHEMA).parquet(path)


def read_documents(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document, decoded from the files."""
    schema = "part int, frame int, doc_id long, before long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in slices(batches, 1):
            part, frame, docs, sizes, payload = (row.column(c)[0] for c in ("part", "frame", "doc_ids", "lengths", "payload"))
            data = memoryview(decode_frame(payload.as_py()).tobytes())
            sizes = np.array(sizes.as_py(), np.int64)
            before = np.cumsum(sizes) - sizes
            own = [data[4 * b : 4 * (b + n)] for b, n in zip(before.tolist(), sizes.tolist(), strict=True)]
            columns = [
                pa.array([part.as_py()] * len(sizes), pa.int32()), pa.array([frame.as_py()] * len(sizes), pa.int32()), docs.values,
                pa.array(before), pa.array(sizes), pa.array(map(zlib.crc32, own), pa.int64()), *([pa.array(map(bytes, own), pa.binary())] if with_ids else [])]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    tokens = F.aggregate("lengths", F.lit(0).cast("long"), lambda total, n: total + n)
    sizes = files.select(F.col("part").alias("_part"), F.col("frame").alias("_frame"), tokens.alias("n"))
    by_part = sizes.groupBy("_part").agg(F.sum("n").alias("n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = by_part.select(F.col("_part").alias("_p"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("_part").orderBy("_frame").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("frame_start", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(parts, F.col("_part") == F.col("_p"))
    starts = starts.select("_part", "_frame", (F.col("part_start") + F.col("frame_start")).alias("_start"))
    found = files.mapInArrow(decode, schema).join(starts, (F.col("part") == F.col("_part")) & (F.col("frame") == F.col("_frame")))
    return found.select(
        "doc_id", (F.col("_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
