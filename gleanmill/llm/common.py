"""What the training-data operators share: reading tables, words, Arrow slices, cutting lineage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanmill.session import scratch_folder, shared_folder

# ASCII white space ends a word; every other character belongs to one.
NOT_SPACE = r"[^\x20\x09-\x0D]"
SPACES = r"[\x20\x09-\x0D]+"

# Rows that cross to Python at once. Documents are large, so Spark's default of 10,000 would need gigabytes.
ARROW_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    narrow_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrow_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of document rows; a smaller setting of the session is kept."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, ARROW_ROWS)


def words(text: Column) -> Column:
    """The words of a text in order; null or blank text has none."""
    body = F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, SPACES))


def fold(id_column: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null for a null id."""
    return F.crc32(id_column.cast("string").cast("binary")) % modulus


def slices(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """The batches in small slices, so that Python objects exist for few rows at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def packed(docs: DataFrame, *names: str) -> DataFrame:
    """The whole row as a struct column ``row`` beside copies of ``names``, so that no helper column meets one of the caller's."""
    row = F.struct(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(docs.columns)])
    return docs.select(row.alias("row"), *[docs[name] for name in names])


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows that :func:`packed` took, under their names."""
    return df.select(*[F.col(f"row.c{i}").alias(name) for i, name in enumerate(columns)])


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared checkpoint folder."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():  # every setting makes a folder
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back; the files go when the session's JVM ends."""
    spark = df.sparkSession
    place = scratch_folder(spark, label)
    df.write.parquet(place)
    return spark.read.schema(df.schema).parquet(place)
