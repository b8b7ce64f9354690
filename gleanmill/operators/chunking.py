"""Splitting documents into chunks. Every chunker is a column: text to array of (start, end).

The chunk texts are cut out natively after the explode, so chunks of one document spread over rows
before anything heavy happens to them. With overlap 0 the chunks of a text concatenate to the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_SIZE = 2048
SENTENCE_MIN = 12
PIECE_MIN = 24
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def fixed_spans(text: Column, size: int = CHUNK_SIZE, overlap: int = 0) -> Column:
    """Windows of ``size`` characters, each ``size - overlap`` after the last, up to the end of the text."""
    length = F.length(text)
    last = F.greatest(F.ceil((length - F.lit(overlap)) / F.lit(size - overlap)) - 1, F.lit(0).cast("bigint"))
    starts = F.transform(F.sequence(F.lit(0).cast("bigint"), last), lambda i: i * (size - overlap))
    spans = F.transform(
        starts, lambda s: F.struct(s.alias("start"), F.least(s + size, length.cast("bigint")).alias("end"))
    )
    return F.when(length > 0, spans).otherwise(F.array().cast(SPANS))


def packed_spans(lengths: Column, shortest: int, size: int, overlap: int = 0) -> Column:
    """Pack parts, given by their lengths in order, greedily into spans of at most ``size``, at least one piece each.

    Parts join until they are ``shortest`` long and make a piece; what is left at the end is one too. With an overlap, a
    span begins with the pieces at the end of the one before that fit into it. One fold, which keeps the spans so
    far and, for the overlap, the cuts inside the last of them.
    """
    start = F.expr(
        "named_struct('at', 0L, 'cut', 0L, 'first', 0L, 'last', 0L, 'recent', cast(array() as array<bigint>),"
        " 'spans', cast(array() as array<struct<start: bigint, end: bigint>>))")

    def span(first: Column, last: Column) -> Column:
        return F.struct(first.alias("start"), last.alias("end"))

    def cut(s: Column, end: Column) -> Column:
        """The state after one more piece, which ends at ``end``."""
        first, last, recent, spans = s["first"], s["last"], s["recent"], s["spans"]
        fits = (end - first <= size) | (last == first)
        closed, begins = F.array_append(spans, span(first, last)), last
        if overlap:
            inside = F.filter(recent, lambda c: (c > first) & (c < last) & (last - c <= overlap))
            # Where the next piece is too long for the overlap, the span ends where the one before did.
            closed = F.concat(closed, F.transform(F.filter(inside, lambda c: end - c > size), lambda c: span(c, last)))
            begins = F.coalesce(F.try_element_at(F.filter(inside, lambda c: end - c <= size), F.lit(1)), last)
            kept = F.when(fits, recent).otherwise(F.filter(recent, lambda c: c > first))
            recent = F.array_append(kept, end)
        return F.struct(
            end.alias("at"), end.alias("cut"), F.when(fits, first).otherwise(begins).alias("first"), end.alias("last"),
            recent.alias("recent"), F.when(fits, spans).otherwise(closed).alias("spans"))

    def step(s: Column, length: Column) -> Column:
        end = s["at"] + length
        waits = F.struct(end.alias("at"), s["cut"].alias("cut"), s["first"].alias("first"), s["last"].alias("last"),
                         s["recent"].alias("recent"), s["spans"].alias("spans"))
        return F.when(end - s["cut"] >= shortest, cut(s, end)).otherwise(waits)

    def finish(s: Column) -> Column:
        whole = F.when(s["at"] > s["cut"], cut(s, s["at"])).otherwise(s)
        return F.when(whole["last"] > whole["first"], F.array_append(whole["spans"], span(whole["first"], whole["last"]))).otherwise(whole["spans"])

    return F.aggregate(lengths, start, step, finish)


SENTENCE_END = r"\. |! |\? |\n"


def _lengths(text: Column, end: str) -> Column:
    """Lengths of the parts of a text, each up to and with its end."""
    parts = F.regexp_extract_all(text, F.lit(f"(?s).*?(?:{end})|.+"), F.lit(0))
    return F.transform(parts, lambda x: F.length(x).cast("bigint"))


def sentence_spans(text: Column, size: int = CHUNK_SIZE, overlap: int = 0) -> Column:
    """Sentences (of 12 characters or more) packed into chunks; a longer sentence is a chunk of its own."""
    return packed_spans(_lengths(F.coalesce(text, F.lit("")), SENTENCE_END), SENTENCE_MIN, size, overlap)


# Finer and finer places to split at: paragraphs, sentences, clauses, words.
SPLITS = [r"\n\n|\r\n|\n|\r", r"[.!?] ", r"[{}\"\[\]<>()|:;,~`'-]|\.\.\.", r"[ \t\n\f\r]"]


def recursive_spans(text: Column, size: int = CHUNK_SIZE) -> Column:
    """Split at ever finer places until all pieces fit, then merge neighbours; pieces below 24 go along.

    A pass over the spans for each kind of place; spans that fit stay as they are. What still does not fit is cut evenly.
    """
    body = F.coalesce(text, F.lit(""))
    whole = F.struct(F.lit(0).cast("bigint").alias("start"), F.length(body).cast("bigint").alias("end"))
    spans = F.when(F.length(body) > 0, F.array(whole)).otherwise(F.array().cast(SPANS))

    def finer(within: Callable[[Column], Column]) -> Callable[[Column], Column]:
        def split(s: Column) -> Column:
            own = F.substring(body, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
            moved = F.transform(within(own), lambda x: F.struct((s["start"] + x["start"]).alias("start"), (s["start"] + x["end"]).alias("end")))
            return F.when(s["end"] - s["start"] <= size, F.array(s)).otherwise(moved)

        return split

    for end in SPLITS:
        spans = F.flatten(F.transform(spans, finer(lambda own, end=end: packed_spans(_lengths(own, end), PIECE_MIN, size))))
    return F.flatten(F.transform(spans, finer(lambda own: fixed_spans(own, size))))


def chunk_rows(
    docs: DataFrame, spans: Column, kind: str, keep_metadata: bool = True, content: str = "content"
) -> DataFrame:
    """One row per chunk of ``(id, content, metadata)``: id, place in the document, text and metadata.

    ``metadata`` (map of text, optional) gets the chunk's own entries. Order chunks by ``chunk_index``; the
    ids sort as text only up to 10000.
    """
    passed = [c for c in docs.columns if c not in ("id", content, "metadata")]
    spanned = docs.withColumn("_spans", spans).withColumn("_total", F.size("_spans"))
    rows = spanned.select(
        *passed, F.col("id").alias("original_document_id"), F.col(content).alias("_text"),
        *(["metadata"] if "metadata" in docs.columns else []), "_total", F.posexplode("_spans").alias("chunk_index", "_s"),
    )
    size = F.col("_s.end") - F.col("_s.start")
    own = F.create_map(
        F.lit("chunk_index"), F.col("chunk_index").cast("string"),
        F.lit("chunk_start"), F.col("_s.start").cast("string"),
        F.lit("chunk_end"), F.col("_s.end").cast("string"),
        F.lit("chunk_token_count"), size.cast("string"),
        F.lit("original_document_id"), F.col("original_document_id").cast("string"),
        F.lit("chunker_type"), F.lit(kind),
        F.lit("total_chunks"), F.col("_total").cast("string"),
    )
    if keep_metadata and "metadata" in docs.columns:
        base = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(own, k))
        own = F.map_concat(base, own)
    return rows.select(
        *passed,
        F.format_string("%s_chunk_%04d", F.col("original_document_id").cast("string"), "chunk_index").alias("id"),
        "original_document_id",
        F.col("chunk_index").cast("bigint").alias("chunk_index"),
        F.col("_s.start").alias("chunk_start"),
        F.col("_s.end").alias("chunk_end"),
        size.alias("token_count"),
        F.col("_total").cast("bigint").alias("total_chunks"),
        F.substring("_text", (F.col("_s.start") + 1).cast("int"), size.cast("int")).alias("content"),
        own.alias("metadata"),
    )


CHUNKERS: dict[str, Callable[..., Column]] = {
    "token": fixed_spans,
    "sentence": sentence_spans,
    "recursive": recursive_spans,
}


def chunker(kind: str) -> Callable[..., Column]:
    """The chunker registered under a name; an unknown name is an error."""
    if kind not in CHUNKERS:
        raise ValueError(f"unknown chunker {kind!r}, known are {sorted(CHUNKERS)}")
    return CHUNKERS[kind]


def register_chunker(kind: str, spans: Callable[..., Column]) -> None:
    CHUNKERS[kind] = spans
