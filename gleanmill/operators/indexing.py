"""Indexing: documents to files, chunks, vectors, store rows, and a report per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanmill.functions import constants as K
from gleanmill.functions import text as tx
from gleanmill.operators.chunking import chunk_rows, chunker
from gleanmill.operators.plugins import embed


def group_by_file(docs: DataFrame, paths: DataFrame) -> DataFrame:
    """Add ``file_id`` to ``(id, content, path, filename, …)``: by path, else the file name."""
    return docs.join(paths.select("path", F.col("file_id").alias("_mapped")), "path", "left").withColumn(
        "file_id", F.coalesce("_mapped", "filename")
    ).drop("_mapped")


def file_chunks(docs: DataFrame, spans: Column) -> DataFrame:
    """Per file: documents, chunks, and whether any document has content. Texts stay where they are."""
    counted = docs.select(
        "file_id",
        F.size(spans).alias("_n"),
        (tx.strip(F.coalesce("content", F.lit(""))) != "").alias("_filled"),
    )
    return counted.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("_n").alias("chunks"), F.bool_or("_filled").alias("filled")
    )


def guard_files(counts: DataFrame, max_chunks: int | None = None) -> DataFrame:
    """Add ``stage`` and ``reason`` of the files that cannot be indexed; both null for the others.

    A limit on the chunks of a file is the caller's choice; without one, files of any size pass.
    """
    empty, none, many = ~F.col("filled"), F.col("chunks") == 0, F.lit(False) if max_chunks is None else F.col("chunks") > max_chunks
    stage = F.when(empty, "parse").when(none | many, "chunk")
    reason = (
        F.when(empty, "no content").when(none, "no chunks produced")
        .when(many, f"chunk count exceeds limit (max={max_chunks})")
    )
    return counts.withColumn("stage", stage).withColumn("reason", reason)


def embedding_dimension(model: Column, explicit: Column | None = None) -> Column:
    """Vector length of a model: an explicit positive one, else the known one, else 1536."""
    name = F.trim(F.coalesce(model, F.lit("")))
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in K.EMBED_DIMENSIONS.items() for x in kv]), name)
    default = F.coalesce(known, F.lit(K.DEFAULT_EMBED_DIMENSION))
    return default if explicit is None else F.when(explicit > 0, explicit).otherwise(default)


def embed_batch(model: Column, provider: Column) -> Column:
    """Batch size of an embedding model: exact name, then prefix, then by provider."""
    name = F.trim(F.coalesce(model, F.lit("")))
    exact = F.try_element_at(F.create_map(*[F.lit(x) for kv in K.EMBED_BATCH.items() for x in kv]), name)
    prefixed = F.coalesce(*[F.when(name.startswith(p), F.lit(K.EMBED_BATCH[p])) for p in K.EMBED_BATCH_PREFIXES])
    provided = F.when(F.lower(F.trim(F.coalesce(provider, F.lit("")))) == "openai", F.lit(512)).otherwise(F.lit(10))
    return F.coalesce(exact, prefixed, provided)


def token_limit(model: Column) -> Column:
    """Token limit of a model name: that of the first known part it contains."""
    name = F.lower(F.coalesce(model, F.lit("")))
    hits = [F.when(name.contains(part), F.lit(limit)) for part, limit in K.TOKEN_LIMITS]
    return F.coalesce(*hits, F.lit(K.DEFAULT_TOKEN_LIMIT))


def check_vectors(chunks: DataFrame, vectors: DataFrame, dimension: int) -> DataFrame:
    """Per file: chunks, vectors and the embed failure, if counts differ or a length is wrong.

    Both sides are counted before they meet.
    """
    wanted = chunks.groupBy("file_id").agg(F.count(F.lit(1)).alias("chunks"))
    got = vectors.groupBy("file_id").agg(
        F.count("vector").alias("vectors"), F.count_if(F.size("vector") != dimension).alias("_odd")
    )
    joined = wanted.join(got, "file_id", "left").withColumn("vectors", F.coalesce("vectors", F.lit(0)))
    reason = F.when(F.col("vectors") != F.col("chunks"), "embed count mismatch").when(
        F.col("_odd") > 0, f"vector dimension is not {dimension}"
    )
    return joined.select("file_id", "chunks", "vectors", F.when(reason.isNotNull(), "embed").alias("stage"), reason.alias("reason"))


def stored_title(given: Column, file: Column) -> Column:
    """The given title, else the file name as words; every run of letters starts with a capital."""
    words = F.replace(F.replace(file, F.lit(".md"), F.lit("")), F.lit("_"), F.lit(" "))
    runs = F.regexp_extract_all(words, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.coalesce(tx.filled(given), F.array_join(F.transform(runs, F.initcap), ""))


def store_rows(chunks: DataFrame, collection: str, scheme: str = "milvus", timestamp: Column | None = None) -> DataFrame:
    """Shape ``(file_id, id, chunk_index, total, title, content, vector, metadata)`` for the store.

    ``id`` may be null; then it is made of the file, its hash and the chunk's place. ``total`` is the number
    of chunks of the file. The source is always ``uploaded``; the file and time are set where missing.
    """
    file = tx.safe_filename(F.col("file_id"))
    stamp = F.unix_millis(F.current_timestamp()) if timestamp is None else timestamp
    named = chunks.withColumn("_file", file)
    stem = F.when(F.col("_file").contains("."), F.regexp_replace("_file", r"\.[^.]*$", "")).otherwise(F.col("_file"))
    digest = F.substring(F.md5(F.concat_ws("_", "_file", F.col("total").cast("string"), stamp.cast("string"))), 1, 8)
    prefix = F.concat(F.lit("uploaded_"), stem, F.lit("_"), digest)
    own = F.when(F.col("total") > 1, F.concat(prefix, F.lit("_chunk_"), F.col("chunk_index"))).otherwise(prefix)
    metadata = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    kept = F.map_filter(metadata, lambda k, v: k != "source")
    fixed = F.create_map(F.lit("source"), F.lit("uploaded"))
    for name, value in (("file", F.col("_file")), ("timestamp", stamp.cast("string"))):
        extra = F.when(~F.map_contains_key(metadata, F.lit(name)), F.create_map(F.lit(name), value))
        fixed = F.map_concat(fixed, F.coalesce(extra, F.create_map().cast("map<string,string>")))
    return named.select(
        F.lit(collection).alias("collection"),
        F.coalesce("id", own).alias("id"),
        "vector",
        "content",
        stored_title(F.col("title"), F.col("_file")).alias("title"),
        F.concat(F.lit(f"{scheme}://{collection}/"), F.col("_file")).alias("url"),
        F.lit("uploaded").alias("source"),
        F.map_concat(kept, fixed).alias("metadata"),
    )


def index_documents(
    docs: DataFrame, collection: str, kind: str = "token", size: int = 2048, max_chunks: int | None = None,
    dimension: int = 64, timestamp: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Index ``(file_id, id, content)``: the rows to store, and one report row per file.

    The files' fate is decided on counts; only chunks of accepted files are embedded. One bad file never
    stops the others.
    """
    spans = chunker(kind)(F.col("content"), size)
    guarded = guard_files(file_chunks(docs, spans), max_chunks)
    good = guarded.filter("reason is null").select("file_id", F.col("chunks").alias("total"))
    chunks = chunk_rows(docs.join(good, "file_id").select("file_id", "total", "id", "content"), spans, kind)
    vectors = chunks.withColumn("vector", embed(F.col("content"), dimension=dimension)).withColumn(
        "title", F.lit(None).cast("string")
    )
    return store_rows(vectors, collection, timestamp=timestamp), index_report(guarded, collection)


def index_report(files: DataFrame, collection: str, scheme: str = "milvus") -> DataFrame:
    """One row per file: success with its resource, or the first stage that failed and why.

    ``files(file_id, stage, reason)`` may hold several failures of a file, one per stage.
    """
    order = F.array_position(F.array(*[F.lit(s) for s in ("parse", "chunk", "embed", "store")]), F.col("stage"))
    first = files.groupBy("file_id").agg(
        F.min_by("stage", order).alias("stage"), F.min_by("reason", order).alias("reason")
    )
    file = tx.safe_filename(F.col("file_id"))
    ok = F.col("reason").isNull()
    return first.select(
        "file_id",
        F.when(ok, "success").otherwise("failed").alias("status"),
        "stage",
        "reason",
        F.when(ok, F.concat(F.lit(f"{scheme}://{collection}/"), file)).alias("uri"),
        F.when(ok, stored_title(F.lit(None).cast("string"), file)).alias("title"),
    )


def retrieval_intent(text: Column, extra: list[str] | None = None) -> Column:
    """The first phrase by which a text asks for the private knowledge base; null if it does not."""
    body = tx.strip(F.coalesce(text, F.lit("")))
    lowered = F.lower(body)
    extra = [e.strip() for e in extra or [] if e and e.strip()]
    hits = [F.when(lowered.contains(p.lower()), F.lit(p)) for p in [*K.RETRIEVAL_PHRASES_EN, *extra]]
    hits += [F.when(body.contains(p), F.lit(p)) for p in [*K.RETRIEVAL_PHRASES_ZH, *[e for e in extra if not e.isascii()]]]
    hits += [F.when(lowered.contains(u), F.lit(u)) for u in K.RETRIEVAL_URIS]
    return F.coalesce(*hits)


def list_resources(store: DataFrame, limit: int | None = None, scheme: str = "milvus", distinct: bool = True,
                   uploaded_only: bool = True) -> DataFrame:
    """Uploaded resources as ``uri, title``, one per URI, ordered by it: all of them, or the first ``limit``.

    Only the id, title and URL columns are read from the store.
    """
    rows = store.filter("source = 'uploaded'") if uploaded_only else store
    named = rows.select(
        "id",
        F.coalesce(tx.filled(F.col("url")), F.concat(F.lit(f"{scheme}://"), F.col("id"))).alias("uri"),
        F.coalesce(tx.filled(F.col("title")), tx.filled(F.col("id")), F.lit("Unnamed")).alias("title"),
    )
    if distinct:
        named = named.groupBy("uri").agg(F.min("id").alias("id"), F.min_by("title", "id").alias("title"))
    ordered = named.orderBy("uri", "id").limit(limit) if limit else named
    return ordered.select("uri", "title")
