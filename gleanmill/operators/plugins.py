"""What users plug in: embedders and judges. Each runs in the tasks, one instance per Python worker."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanmill.functions import constants as K

VECTOR = T.ArrayType(T.FloatType())


WORD = re.compile(r"[^\x20\x09-\x0D]+")
KNOWN_WORDS = 200_000


class HashingEmbedder:
    """Deterministic embedder without a model: lower-case words hashed to signed dimensions, unit length.

    The code of a word is the first 32 bits of its md5: dimension by remainder, plus or minus by bit 16.
    """

    def __init__(self, dimension: int = 64):
        self.dimension = dimension
        self.known: dict[str, int] = {}

    def _codes(self, words: list[str]) -> np.ndarray:
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        for word in words:
            if word not in self.known:
                self.known[word] = int.from_bytes(hashlib.md5(word.encode()).digest()[:4])
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def embed_query(self, text: str) -> list[float]:
        return self.embed_documents([text])[0]

    def embed_documents(self, texts: list[str]) -> list[list[float]]:
        split = [WORD.findall(t.lower()) for t in texts]
        codes = self._codes([w for words in split for w in words])
        rows = np.repeat(np.arange(len(texts)), [len(words) for words in split])
        signs = np.where(codes & 0x10000, 1.0, -1.0)
        cells = np.bincount(rows * self.dimension + codes % self.dimension, signs, len(texts) * self.dimension)
        matrix = cells.reshape(len(texts), self.dimension)
        norms = np.sqrt((matrix**2).sum(axis=1, keepdims=True))
        return (matrix / np.where(norms == 0, 1, norms)).astype("float32").tolist()


EMBEDDERS: dict[str, Callable[..., object]] = {"hashing": HashingEmbedder}


def register_embedder(name: str, factory: Callable[..., object]) -> None:
    """Make an embedder available; the factory is called in the workers and must be picklable."""
    EMBEDDERS[name] = factory


def embed(text: Column, provider: str = "hashing", batch_size: int = 512, **config) -> Column:
    """Vector of a text. The embedder is made once per worker and fed batches of ``batch_size`` texts."""
    factory = EMBEDDERS[provider]

    @F.pandas_udf(VECTOR)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embedder = factory(**config)
        for texts in batches:
            filled = texts.fillna("").tolist()
            vectors = []
            for start in range(0, len(filled), batch_size):
                vectors += embedder.embed_documents(filled[start : start + batch_size])
            yield pd.Series(vectors)

    return run(text)


def judge_reports(reports: DataFrame, judge: Callable[[str], str], size: int | None = None) -> DataFrame:
    """Raw judge answers ``(report_id, raw, error)``; ``judge`` gets the whole report, or its first ``size`` characters.

    A failing call gives a null answer and its message; such a report scores zero, see failed_verdict.
    """
    schema = T.StructType(
        [reports.schema["report_id"], T.StructField("raw", T.StringType()), T.StructField("error", T.StringType())]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for report_id, body in zip(batch["report_id"], batch["body"]):
                try:
                    rows.append((report_id, judge(body), None))
                except Exception as error:  # one failed call must not fail the corpus
                    rows.append((report_id, None, str(error)))
            yield pd.DataFrame(rows, columns=schema.names)

    body = F.col("body") if size is None else F.substring("body", 1, size)
    clipped = reports.select("report_id", body.alias("body"))
    return clipped.mapInPandas(run, schema)


def failed_verdict(error: Column) -> Column:
    """Verdict of a judge call that failed: zeros, and the message as a weakness."""
    return F.struct(
        F.create_map(*[x for c in K.CRITERIA for x in (F.lit(c), F.lit(0.0))]).alias("scores"),
        F.lit(0.0).alias("overall_score"),
        F.array().cast("array<string>").alias("strengths"),
        F.array(F.concat(F.lit("Evaluation failed: "), error)).alias("weaknesses"),
        F.array(F.lit("Please retry evaluation")).alias("suggestions"),
    )
