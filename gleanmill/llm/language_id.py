"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, everything but letters becomes one space, and all 1-, 2- and 3-grams of code points are hashed to
``N_BUCKETS`` buckets. Training counts buckets per language over all training documents: every task adds up its own
counts, one shuffle adds up the tasks. The model is a matrix of log-probabilities (buckets by languages), at most
``MAX_MATRIX_BYTES`` large, broadcast to the tasks that score; a document is scored from its non-zero buckets only.

Null text and text without a letter give ``und`` with score 0. Equal scores go to the language first in code point order.
Without any training document everything is ``und``. Rows are scored one by one, so repeated ids and extra columns do
no harm; null languages and null ids are never learned from.

A text of any length is read whole, in one task. Repeated rows are learned from and judged one by one. An empty table has an
empty result. Only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanmill.llm.common import slices

N_BUCKETS = 1 << 15
SMOOTHING = 0.5
MAX_MATRIX_BYTES = 256 << 20
UNKNOWN = "und"
_NO_LETTERS = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class Model:
    languages: list[str]
    log_prior: np.ndarray  # by language
    log_prob: np.ndarray  # buckets by languages


def bucket_counts(text: str) -> np.ndarray:
    """How often each bucket occurs among the 1-, 2- and 3-grams of a text."""
    letters = " " + _NO_LETTERS.sub(" ", text.lower()).strip() + " "
    code = np.frombuffer(letters.encode("utf-32-le", "surrogatepass"), np.uint32)
    one = code + np.uint32(0x9E37)
    two = (one[:-1] * np.uint32(0x01000193)) ^ one[1:]
    three = (two[:-1] * np.uint32(0x01000193)) ^ one[2:]
    shift = np.uint32(32 - N_BUCKETS.bit_length() + 1)
    parts = [(g * np.uint32(k) >> shift) for g, k in ((one, 0x9E3779B1), (two, 0x85EBCA6B), (three, 0xC2B2AE35))]
    return np.bincount(np.concatenate(parts), minlength=N_BUCKETS)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for part in slices(batches):
        for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            if has_letter(text):
                if lang not in sums:
                    sums[lang], docs[lang] = np.zeros(N_BUCKETS, np.int64), 0
                sums[lang] += bucket_counts(text)
                docs[lang] += 1
    for lang, counts in sums.items():
        used = np.flatnonzero(counts)
        # Bucket -1 counts the documents.
        buckets, values = np.append(used, -1).astype(np.int32), np.append(counts[used], docs[lang])
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(buckets)), pa.array(buckets), pa.array(values)], ["lang", "bucket", "n"])


def train(docs: DataFrame) -> Model:
    """Fit on all rows of ``docs`` (text, lang) whose lang is not null."""
    rows = (
        docs.where("lang is not null and text is not null").select(F.col("text").cast("string"), F.col("lang").cast("string"))
        .mapInArrow(_count, "lang string, bucket int, n long")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    )
    found = rows.toArrow()
    languages = sorted(set(found.column("lang").to_pylist()))
    if len(languages) * N_BUCKETS * 4 > MAX_MATRIX_BYTES:
        raise ValueError(f"{len(languages)} languages need more than {MAX_MATRIX_BYTES} bytes; lower N_BUCKETS")
    place = {lang: k for k, lang in enumerate(languages)}
    counts, priors = np.zeros((N_BUCKETS, len(languages))), np.zeros(len(languages))
    column = np.array([place[x] for x in found.column("lang").to_pylist()], np.int64)
    bucket, n = found.column("bucket").to_numpy(), found.column("n").to_numpy()
    grams = bucket >= 0
    counts[bucket[grams], column[grams]] = n[grams]
    priors[column[~grams]] = n[~grams]
    smooth = counts + SMOOTHING
    return Model(languages, np.log((priors + 1) / (priors.sum() + len(languages))), np.log(smooth / smooth.sum(0)).astype(np.float32))


def classify(model: Model, text: str | None) -> tuple[str, float]:
    if not model.languages or not has_letter(text):
        return UNKNOWN, 0.0
    counts = bucket_counts(text)
    used = np.flatnonzero(counts)
    total = model.log_prior + counts[used].astype(np.float64) @ model.log_prob[used].astype(np.float64)
    best = int(np.argmax(total))
    return model.languages[best], float(1 / np.exp(total - total[best]).sum())


def predict(docs: DataFrame, model: Model, keep: str = "doc_id long, held_out boolean") -> DataFrame:
    """lang_pred and score for every row; ``keep`` declares the columns that are passed on."""
    names = [c.split()[0] for c in keep.split(", ")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in slices(batches):
            found = [classify(m, text) for text in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c) for c in names], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                [*names, "lang_pred", "score"])

    return docs.select(*names, F.col("text").cast("string")).mapInArrow(score, f"{keep}, lang_pred string, score double")
