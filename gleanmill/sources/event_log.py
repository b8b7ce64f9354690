"""The event log: frames of ``event:`` and ``data:`` lines separated by a blank line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME_LIMIT = 1 << 20
FRAME_END = "\n\n"


def parse_frames(frames: DataFrame, text: str = "value", limit: int | None = FRAME_LIMIT) -> DataFrame:
    """Frame texts to ``event, data``; other columns stay. Frames without data and event are dropped.

    In each frame the last line of a name wins. A frame above ``limit`` bytes becomes an ``error`` event that names its
    size, and is not split; all other frames come through. Without a limit frames of any size are read.
    """
    value, size = F.col(text), F.octet_length(F.col(text))
    if limit is not None:
        refused = F.concat(F.lit('event: error\ndata: {"error": "frame too large", "bytes": '), size.cast("string"), F.lit("}"))
        value = F.when(size > limit, refused).otherwise(value)
    lines = F.transform(
        F.split(value, "\n"),
        lambda line: F.struct(
            F.split_part(line, F.lit(": "), F.lit(1)).alias("name"),
            F.when(F.instr(line, ": ") > 0, F.substring(line, F.instr(line, ": ") + 2, F.length(line))).alias("rest"),
        ),
    )

    def last_of(name: str) -> Column:
        found = F.filter(F.col("_lines"), lambda line: (line["name"] == name) & line["rest"].isNotNull())
        return F.try_element_at(found, F.lit(-1))["rest"]

    kept = [c for c in frames.columns if c != text]
    parsed = frames.withColumn("_lines", lines).select(
        *kept, F.coalesce(last_of("event"), F.lit("message")).alias("event"), last_of("data").alias("data")
    )
    return parsed.filter(F.col("data").isNotNull() | (F.col("event") != "message"))


def read_event_log(
    spark: SparkSession, path: str, streaming: bool = False, limit: int | None = FRAME_LIMIT, files_per_batch: int | None = None
) -> DataFrame:
    """``event, data`` rows of all log files below ``path``, as a batch or as a file stream."""
    reader = (spark.readStream if streaming else spark.read).option("lineSep", FRAME_END)
    if streaming and files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return parse_frames(reader.text(path), limit=limit)


def make_frames(events: DataFrame, event: str = "event") -> DataFrame:
    """Rows to frame texts (without the closing blank line); an empty ``content`` is left out.

    All columns but ``event`` become fields of the JSON data, nulls left out.
    """
    fields = [
        F.nullif(F.col(c), F.lit("")).alias(c) if c == "content" else F.col(c) for c in events.columns if c != event
    ]
    body = F.to_json(F.struct(*fields), {"ignoreNullFields": "true"})
    failed = F.lit('event: error\ndata: {"error": "Serialization failed"}')
    frame = F.concat(F.lit("event: "), F.col(event), F.lit("\ndata: "), body)
    return events.select(F.coalesce(frame, failed).alias("value"))


def user_frames(messages: DataFrame) -> DataFrame:
    """The opening user messages of threads as message events with ids ``run--<id>``."""
    return messages.select(
        F.lit("message_chunk").alias("event"),
        "thread_id",
        F.concat(F.lit("run--"), F.col("message_id")).alias("id"),
        F.lit("user").alias("role"),
        "content",
    )


def write_event_log(events: DataFrame, path: str) -> None:
    make_frames(events).write.mode("append").option("lineSep", FRAME_END).text(path)
