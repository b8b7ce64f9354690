"""Responses of search providers and page fetchers, turned into result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanmill.functions import json_text as jt
from gleanmill.functions import text as tx
from gleanmill.operators.search import curate, first_copies

RESPONSE = """struct<results: array<struct<title: string, url: string, content: string, score: double,
 raw_content: string>>, images: array<struct<url: string, description: string>>>"""
SECTIONS = """array<struct<content: struct<results: struct<
 organic: array<struct<title: string, url: string, desc: string>>,
 top_stories: struct<items: array<struct<time_frame: string, title: string, url: string, source: string>>>,
 images: struct<items: array<struct<url: string, alt: string>>>>>>>"""

# Positions inside one part of a response, an array's index; parts follow each other in seq.
PART = 1 << 31


def load_page_results(responses: DataFrame, threshold: float = 0.0, size: int = 0) -> DataFrame:
    """``query_id, response`` with JSON of results and images to curated result rows."""
    parsed = responses.select("query_id", F.from_json("response", RESPONSE).alias("r"))
    pages = parsed.select("query_id", F.posexplode("r.results").alias("pos", "p")).select(
        "query_id",
        F.col("pos").cast("bigint").alias("seq"),
        F.lit("page").alias("type"),
        "p.title",
        "p.url",
        "p.content",
        tx.filled(F.col("p.raw_content")).alias("raw_content"),
        "p.score",
        F.lit(None).cast("string").alias("image_url"),
        F.lit(None).cast("string").alias("image_description"),
    )
    null = F.lit(None).cast("string")
    images = parsed.select("query_id", F.posexplode("r.images").alias("pos", "i")).select(
        "query_id",
        (F.col("pos").cast("bigint") + F.lit(PART)).alias("seq"),
        F.lit("image_url").alias("type"),
        null.alias("title"),
        null.alias("url"),
        null.alias("content"),
        null.alias("raw_content"),
        F.lit(None).cast("double").alias("score"),
        F.col("i.url").alias("image_url"),
        F.col("i.description").alias("image_description"),
    )
    return curate(pages.unionByName(images), threshold, size)


def load_sectioned_results(responses: DataFrame) -> DataFrame:
    """``query_id, response`` with JSON content blocks to pages, news and images, first URL wins."""
    blocks = responses.select(
        "query_id", F.posexplode(F.from_json("response", SECTIONS)).alias("block", "b")
    ).select("query_id", "block", "b.content.results.*")

    def part(items: str, number: int, kind: str, columns: dict[str, str]) -> DataFrame:
        names = ["title", "url", "content", "source", "time_frame", "image_url", "image_description"]
        rows = blocks.select("query_id", "block", F.posexplode(items).alias("pos", "x"))
        seq = (F.col("block") * 3 + number).cast("bigint") * F.lit(PART) + F.col("pos")
        return rows.select(
            "query_id", seq.alias("seq"), F.lit(kind).alias("type"),
            *[(F.col(f"x.{columns[n]}") if n in columns else F.lit(None).cast("string")).alias(n) for n in names],
        )

    parts = [
        part("organic", 0, "page", {"title": "title", "url": "url", "content": "desc"}),
        part("top_stories.items", 1, "news",
             {"title": "title", "url": "url", "source": "source", "time_frame": "time_frame"}),
        part("images.items", 2, "image_url", {"image_url": "url", "image_description": "alt"}),
    ]
    rows = reduce(DataFrame.unionByName, parts)
    link = tx.filled(F.coalesce("url", "image_url"))
    return first_copies(rows.filter(link.isNotNull()), ["query_id"], link)


def unwrap_fetch_payload(body: Column, status: Column) -> tuple[Column, Column]:
    """Text of a fetched body, and whether the fetch failed.

    JSON bodies give ``reader_result``, else ``content``; others are taken as they are.
    """
    value = F.when(jt.is_json(body), F.try_parse_json(body))
    fields = [F.try_variant_get(value, f"$.{n}", "string") for n in ("reader_result", "content")]
    failed = F.coalesce(status != 200, F.lit(True)) | (tx.strip(F.coalesce(body, F.lit(""))) == "")
    reason = F.when(F.coalesce(status, F.lit(0)) != 200, F.concat(F.lit("status "), F.coalesce(status, F.lit(0)))).otherwise(
        "empty response"
    )
    text = F.when(failed, F.concat(F.lit("Error: "), reason)).otherwise(F.coalesce(*fields, body))
    return text, failed
