"""Tables the jobs write: vector-store rows and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanmill.operators.ordering import numbered

FILE_ROWS = 100_000
# Compressed bytes of text worth a task of their own.
SPREAD_BYTES = 256 * 1024
# What a file scan puts into one split, unless set otherwise.
SPLIT_BYTES = 128 * 1024 * 1024


def read_table(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """Read a Parquet table; one that comes in fewer splits than the cluster has cores is spread by ``key``.

    Only small tables can be so short of splits: as soon as the files give every core its share, nothing is
    moved. Spreading by a key, not round robin, keeps a repeated task's rows the same.
    """
    table = spark.read.parquet(path)
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    wanted = min(spark.sparkContext.defaultParallelism, -(-size // SPREAD_BYTES))
    splits = -(-size // SPLIT_BYTES)
    if key is None or splits >= wanted or len(table.inputFiles()) >= wanted:
        return table
    return table.repartition(wanted, key)


def store_chunks(rows: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """Append shaped rows to the store, by collection, in files bounded in rows.

    Columnar files keep the wide vectors apart from the scalars, so listings read only what they select.
    """
    rows.write.mode("append").option("maxRecordsPerFile", file_rows).partitionBy("collection").parquet(path)


def append_conversations(existing: DataFrame, arrived: DataFrame) -> DataFrame:
    """Upsert by thread: new messages follow the stored ones, and new threads are added.

    A conversation is a long table ``thread_id, message_no, message, ts``. Nothing stored is rewritten: the
    arrivals ``thread_id, seq, message, ts`` are numbered on from the thread's last message.
    """
    last = existing.groupBy("thread_id").agg(F.max("message_no").alias("_last"))
    placed = numbered(arrived, ["thread_id"], "seq", "message_no").join(last, "thread_id", "left")
    added = placed.withColumn("message_no", F.col("message_no") + F.coalesce("_last", F.lit(0)))
    return existing.unionByName(added.select(*existing.columns))


def conversation_stats(stored: DataFrame) -> DataFrame:
    """Messages and time of the last append per thread."""
    return stored.groupBy("thread_id").agg(F.count(F.lit(1)).alias("messages"), F.max("ts").alias("ts"))


def write_arrivals(batch: DataFrame, batch_id: int, path: str) -> None:
    """Sink of a stream's micro-batch: its own directory, replaced on a retry, so each batch counts once."""
    batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_arrivals(spark: SparkSession, path: str) -> DataFrame:
    """All micro-batches written so far, with their ``batch_id``."""
    return spark.read.parquet(path)
