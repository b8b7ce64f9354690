"""Fill-in-the-middle: texts rearranged so that a model learns to fill a gap from both sides.

A text is cut into units, white space with the word after it (what is left at the end is a unit of its own). The ends
of its units form a *boundary set*: positions are split into a high and a low 16-bit half, every high half owns one
container of low halves, and a container is an array, a bitmap or a list of runs, whichever is smallest. Cumulative
cardinalities say which container holds the k-th boundary; a select inside that container gives its offset. The two cut
offsets of a text are two such selects, so nothing is kept per unit beyond the set itself.

The cuts and the form of a document come from the digest of seed and doc_id, so reruns agree and do not depend on
partitioning. Prefix ends after the smaller of two drawn unit numbers, middle after the larger; both may be empty.

Null texts count as empty, empty texts stay plain; texts that hold one of the markers stay plain, as they could not be
restored. A null doc_id is drawn from the seed alone. Repeated rows each give a row, equal ones the same result. A
text of any length is processed whole, in one task, at about 10 bytes a character. An empty table gives no rows. Other
columns than doc_id and text are not read, so their names cannot clash.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanmill.llm.common import slices

SEED = 42
FIM_PERCENT = 50  # share of texts that are rearranged
SPM_PERCENT = 80  # share of those that start with the suffix
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

SPAN = 1 << 16
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class ArrayContainer:
    """Low halves in order."""

    def __init__(self, low: np.ndarray) -> None:
        self.low = low.astype(np.uint16)

    @staticmethod
    def size(low: np.ndarray) -> int:
        return 2 * len(low)

    def select(self, k: int) -> int:
        return int(self.low[k])


class BitmapContainer:
    """One bit per low half, with the number of bits before each 64-bit word."""

    def __init__(self, low: np.ndarray) -> None:
        bits = np.zeros(SPAN, np.uint8)
        bits[low] = 1
        self.bytes = np.packbits(bits, bitorder="little").reshape(-1, 8)
        per_word = bits.reshape(-1, 64).sum(axis=1, dtype=np.int64)
        self.before = np.cumsum(per_word) - per_word

    @staticmethod
    def size(low: np.ndarray) -> int:
        return SPAN // 8

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, side="right")) - 1
        inside = np.flatnonzero(np.unpackbits(self.bytes[word], bitorder="little"))
        return 64 * word + int(inside[k - self.before[word]])


class RunContainer:
    """Stretches of consecutive low halves, with the number of positions before each."""

    def __init__(self, low: np.ndarray) -> None:
        first = np.append(0, np.flatnonzero(np.diff(low) != 1) + 1)
        self.starts, self.before = low[first], first

    @staticmethod
    def size(low: np.ndarray) -> int:
        return 4 * (1 + int(np.count_nonzero(np.diff(low) != 1)))

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.starts[run]) + k - int(self.before[run])


class BoundarySet:
    """A set of positions, given in ascending order, that answers which is the k-th."""

    def __init__(self, positions: np.ndarray) -> None:
        self.cardinality = len(positions)
        self.high: list[int] = []
        self.before: list[int] = []
        self.containers: list[ArrayContainer | BitmapContainer | RunContainer] = []
        if not len(positions):
            return
        high = positions >> 16
        starts = [0] if high[0] == high[-1] else [0, *(np.flatnonzero(np.diff(high)) + 1).tolist()]
        for start, stop in zip(starts, [*starts[1:], len(positions)], strict=True):
            low = positions[start:stop] & (SPAN - 1)
            kind = min((ArrayContainer, RunContainer, BitmapContainer), key=lambda k: k.size(low))
            self.high.append(int(high[start]))
            self.before.append(start)
            self.containers.append(kind(low))

    def select(self, k: int) -> int:
        """The position that ``k`` others precede."""
        if not 0 <= k < self.cardinality:
            raise IndexError(k)
        c = bisect_right(self.before, k) - 1
        return (self.high[c] << 16) + self.containers[c].select(k - self.before[c])


def boundaries(text: str) -> BoundarySet:
    """The ends of the units of ``text``, in code points."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    if not len(points):
        return BoundarySet(np.empty(0, np.int64))
    blank = (points == 0x20) | ((points >= 0x09) & (points <= 0x0D))
    ends = np.append(blank[1:], True)
    ends[:-1] &= ~blank[:-1]
    return BoundarySet(np.flatnonzero(ends) + 1)


def rearranged(doc_id: int | None, text: str, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT):
    """n, form, prefix_chars, middle_chars, output of one text."""
    ends = boundaries(text)
    n = ends.cardinality
    digest = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or h3 % 100 >= fim_percent or any(marker in text for marker in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    first, last = (ends.select(units - 1) if units else 0 for units in (first, last))
    prefix, middle, suffix = text[:first], text[first:last], text[last:]
    if h4 % 100 < spm_percent:
        return n, "spm", first, last - first, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", first, last - first, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(
    docs: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT
) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output of every row."""

    def rearrange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for piece in slices(batches):
            ids = piece.column(0).to_pylist()
            texts = piece.column(1).to_pylist()
            made = [(d, *rearranged(d, t or "", seed, fim_percent, spm_percent)) for d, t in zip(ids, texts, strict=True)]
            columns = [pa.array(values, kind) for values, kind in zip(zip(*made, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(rearrange, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of, from it and its form alone."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return (
        F.when(form == "psm", F.concat(F.get(parts, 1), F.get(parts, 3), F.get(parts, 2)))
        .when(form == "spm", F.concat(F.get(parts, 2), F.get(parts, 3), F.get(parts, 1)))
        .otherwise(output)
    )
