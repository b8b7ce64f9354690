"""Uploads and the results of document-parsing batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanmill.functions import constants as K
from gleanmill.functions import text as tx
from gleanmill.operators.ordering import numbered


def parse_outcome_triage(results: DataFrame, files: DataFrame) -> DataFrame:
    """Match parse results to the submitted files, by position first and by file name second.

    ``results(batch_id, pos, file_name, state, err_msg, full_zip_url)``, ``files(batch_id, pos, name)``.
    Gives one row per result with the matched ``path_name`` and ``reason``, null for a parsed document.
    """
    placed = files.select("batch_id", "pos", F.col("name").alias("_placed"))
    named = files.groupBy("batch_id", F.col("name").alias("file_name")).agg(F.lit(True).alias("_named"))
    matched = results.join(placed, ["batch_id", "pos"], "left").join(named, ["batch_id", "file_name"], "left")
    path = F.coalesce("_placed", F.when(F.col("_named"), F.col("file_name")))
    state = F.coalesce("state", F.lit(""))
    reason = (
        F.when(path.isNull(), "file_name not in batch")
        .when(state == "failed", F.coalesce(tx.filled(F.col("err_msg")), F.lit("state=failed")))
        .when(state != "done", F.concat(F.lit("state="), state))
        .when(F.coalesce("full_zip_url", F.lit("")) == "", "no full_zip_url")
    )
    return matched.select(
        "batch_id", "pos", F.coalesce(path, "file_name").alias("path_name"), "full_zip_url", reason.alias("reason")
    )


def batch_progress(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Done and failed results per batch, and whether the batch is finished."""
    counted = results.groupBy("batch_id").agg(
        F.count_if(F.col("state") == "done").alias("done"),
        F.count_if(F.col("state") == "failed").alias("failed"),
        F.count(F.lit(1)).alias("total"),
        F.bool_and(F.coalesce("state", F.lit("")) == "done").alias("all_done"),
    )
    return counted.join(expected, "batch_id", "left").withColumn(
        "complete", F.col("done") + F.col("failed") >= F.col("expected")
    )


def upload_reason(name: Column, size: Column, files_in_request: Column) -> Column:
    """Why an uploaded file is refused; null if it is accepted."""
    ext = F.lower(F.regexp_extract(name, r"(\.[^./]*)$", 1))
    return (
        F.when(files_in_request > K.UPLOAD_MAX_FILES, F.lit(f"too many files (max={K.UPLOAD_MAX_FILES})"))
        .when(~ext.isin(K.UPLOAD_EXTENSIONS), F.concat(F.lit("unsupported type "), ext))
        .when(size == 0, "empty file")
        .when(size > K.UPLOAD_MAX_BYTES, "file too large")
    )


def validate_uploads(files: DataFrame) -> DataFrame:
    """Add ``reason`` to ``(request_id, name, size)``; the count per request is aggregated, then joined."""
    counts = files.groupBy("request_id").agg(F.count(F.lit(1)).alias("_files"))
    joined = files.join(counts, "request_id")
    return joined.withColumn("reason", upload_reason(F.col("name"), F.col("size"), F.col("_files"))).drop("_files")


def read_uploads(spark: SparkSession, manifest: DataFrame, path: str) -> DataFrame:
    """Add ``size`` to the uploaded files ``(request_id, name)`` stored below ``path``, contents unread.

    The file source leaves empty files out, so a file of the manifest that it does not list has size 0.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    sizes = files.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.col("length").alias("size"))
    found = sizes.groupBy("name").agg(F.max("size").alias("size"))
    return manifest.join(found, "name", "left").withColumn("size", F.coalesce("size", F.lit(0).cast("bigint")))


# A name that repeats of another may be given: its stem, a number from 2 without leading zeros.
NUMBERED = r"(?s)^(.*)_([2-9]|[1-9][0-9]{1,17})$"
SERIES = ["request_id", "_base", "_ext"]


def _series_state(blocks: DataFrame, repeats: DataFrame) -> DataFrame:
    """Per series of numbers ``_skipped``, those that repeats pass over, and ``_bumped``, names a repeat took first.

    ``blocks(series, name, _k, _first)`` are given names that look like numbers of the series, ``repeats(series, seq)`` the
    rows that need one. Repeats take numbers upwards. One meets the j-th block with c of the earlier blocks passed over
    when it is repeat k - 1 - c, so those few repeats are looked up, and the blocks are folded in order: a block
    seen before the repeat is passed over, one not seen yet loses its name.
    """
    ranked = numbered(repeats, SERIES, "seq", "_i").select(*SERIES, "_i", F.col("seq").alias("_met"))
    listed = blocks.groupBy(*SERIES).agg(F.array_sort(F.collect_list(F.struct("_k", "_first", "name"))).alias("_b"))
    asked = listed.select(*SERIES, F.posexplode("_b").alias("_j", "b")).select(
        *SERIES, "_j", "b.*", F.explode(F.sequence(F.lit(0), "_j")).alias("_c")).withColumn("_i", F.col("_k") - 1 - F.col("_c"))
    met = asked.join(ranked, [*SERIES, "_i"], "left").groupBy(*SERIES, "_k", "_first", "name").agg(
        F.array_sort(F.collect_list(F.struct("_c", "_met"))).alias("m"))
    folded = met.groupBy(*SERIES).agg(F.array_sort(F.collect_list(F.struct("_k", "_first", "name", "m"))).alias("_b"))
    start = F.expr("named_struct('skipped', cast(array() as array<bigint>), 'bumped', cast(array() as array<string>))")

    def step(state: Column, b: Column) -> Column:
        at = F.get(b["m"], F.size(state["skipped"]))["_met"]
        return F.when(at.isNull(), state).when(
            b["_first"] < at, F.struct(F.array_append(state["skipped"], b["_k"]).alias("skipped"), state["bumped"].alias("bumped"))
        ).otherwise(F.struct(state["skipped"].alias("skipped"), F.array_append(state["bumped"], b["name"]).alias("bumped")))

    return folded.select(*SERIES, F.aggregate("_b", start, step).alias("_s")).select(
        *SERIES, F.col("_s.skipped").alias("_skipped"), F.col("_s.bumped").alias("_bumped"))


def unique_file_ids(files: DataFrame) -> DataFrame:
    """Add ``file_id`` to ``(request_id, seq, name)``: repeated names get the next free number, from 2.

    Repeats are ranked per name, whatever their number. Which numbers are free depends on the given names that look like
    one of them; only such names are folded, the shortest first, as a name that lost its own to a repeat is a repeat
    itself. Refusing large requests is up to ``validate_uploads``.
    """
    stem = F.regexp_replace("name", r"(?s)^(\.*[^.].*)(\.[^./]*)$", "$1")
    named = files.select("request_id", "seq", "name").withColumn("_stem", stem).withColumns({
        "_base": F.coalesce(F.nullif("_stem", F.lit("")), F.lit("file")), "_ext": F.expr("substring(name, length(_stem) + 1)")})
    placed = numbered(named, ["request_id", "name"], "seq", "_n")
    firsts = named.groupBy("request_id", "name", "_stem", "_ext").agg(F.min("seq").alias("_first")).where(F.col("_stem").rlike(NUMBERED))
    series = named.select(*SERIES).distinct()
    depth = F.length(F.regexp_extract("_stem", r"((?:_[1-9][0-9]*)+)$", 1))
    blocks = firsts.select(
        "request_id", F.regexp_extract("_stem", NUMBERED, 1).alias("_base"), "_ext", "name", "_first",
        F.regexp_extract("_stem", NUMBERED, 2).cast("bigint").alias("_k"), depth.alias("_depth"),
    ).join(series, SERIES, "left_semi")
    skipped = blocks.select(*SERIES, F.array(F.col("_k")).alias("_skipped")).limit(0)
    bumped = blocks.select("request_id", "name").limit(0)
    is_repeat = F.col("_n") > 1
    # A name is longer than the one whose number it bears, so lengths of the numbers put each after what decides on it.
    for depth in sorted(r[0] for r in blocks.select("_depth").distinct().collect()):
        here = blocks.where(F.col("_depth") == depth)
        lost = bumped.withColumn("_lost", F.lit(True))
        mine = placed.join(here.select(*SERIES).distinct(), SERIES, "left_semi").join(lost, ["request_id", "name"], "left")
        state = _series_state(here, mine.where(is_repeat | F.col("_lost").isNotNull()).select(*SERIES, "seq"))
        skipped = skipped.unionByName(state.where("size(_skipped) > 0").select(*SERIES, "_skipped"))
        bumped = bumped.unionByName(state.select("request_id", F.explode("_bumped").alias("name")))
    marked = placed.join(bumped.withColumn("_lost", F.lit(True)), ["request_id", "name"], "left")
    repeat = is_repeat | F.col("_lost").isNotNull()
    own = marked.where(~repeat).select("request_id", "seq", "name", F.col("name").alias("file_id"))
    merged = skipped.groupBy(*SERIES).agg(F.array_sort(F.flatten(F.collect_list("_skipped"))).alias("_skipped"))
    ranked = numbered(marked.where(repeat).select(*SERIES, "seq", "name"), SERIES, "seq", "_i").join(merged, SERIES, "left")
    number = F.aggregate(
        F.coalesce("_skipped", F.array().cast("array<bigint>")), (F.col("_i") + 1).cast("bigint"), lambda n, k: F.when(k <= n, n + 1).otherwise(n))
    given = ranked.select("request_id", "seq", "name", F.concat("_base", F.lit("_"), number.cast("string"), "_ext").alias("file_id"))
    return own.unionByName(given)
