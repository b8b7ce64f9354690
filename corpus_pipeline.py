"""From documents to packed training sequences, stage by stage.

Each stage reads what the one before it wrote as Parquet. All but the last keep the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleanmill.llm import mixing, packing, quality, simhash, substring_dedup
from gleanmill.llm.common import narrow_batches, table
from gleanmill.llm.queries import WORD_TOKENIZER
from gleanmill.session import shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail the line-first rules go, then documents that lose too much; the other columns stay as they are."""
    return quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays whose SimHash fingerprints are linked, by shingle length and bit distance of op2."""
    narrow_batches(spark)
    return simhash.keep_one(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words or more that an earlier document has are taken out of the texts."""
    narrow_batches(spark)
    return substring_dedup.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.emitted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 2048 tokens."""
    narrow_batches(spark)
    return packing.pack(packing.pieces(docs, WORD_TOKENIZER))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("near-dedup", near_duplicates),
    ("substring dedup", substrings),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack),
]

# Fingerprints, tokenizers and the drawn copies have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    place = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{place}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(place)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return docs
