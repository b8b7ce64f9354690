"""Curation of web-search results.

Input rows: ``query_id, seq, type, title, url, content, raw_content, score, image_url,
image_description``; ``seq`` is unique inside its query. Copies are combined before the shuffle and
ranks are worked out per block of seq values, so a query or URL that holds a large part of all rows is
no hot spot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanmill.functions import text as tx
from gleanmill.operators.ordering import joined_parts, ranked_by_score

QUERY = ["query_id"]
# Characters of one value of a text that is put together from many rows.
PART_CHARS = 1 << 20


def result_key(url: Column, image_url: Column) -> Column:
    """What makes two results the same: the URL, else the image URL (plain or ``{"url": …}``)."""
    inner = F.when(image_url.startswith("{"), F.coalesce(F.get_json_object(image_url, "$.url"), F.lit("")))
    return F.coalesce(tx.filled(url), tx.filled(F.coalesce(inner, image_url)))


def first_copies(df: DataFrame, group: list[str], key: Column, seq: str = "seq") -> DataFrame:
    """Keep the first row by ``seq`` of each non-null key in its group, and all rows without a key.

    One aggregation, combined before the shuffle, so copies of a hot key never travel; one min_by per
    column, so that columns nobody reads are pruned.
    """
    rest = [c for c in df.columns if c not in (*group, seq)]
    keyed = df.withColumn("_key", F.coalesce(F.concat(F.lit("k"), key), F.concat(F.lit("r"), F.col(seq))))
    firsts = keyed.groupBy(*group, "_key").agg(
        F.min(seq).alias(seq), *[F.min_by(c, seq).alias(c) for c in rest]
    )
    return firsts.select(*df.columns)


def dedupe_results(df: DataFrame) -> DataFrame:
    return first_copies(df, QUERY, result_key(F.col("url"), F.col("image_url")))


def score_filter(df: DataFrame, threshold: float) -> DataFrame:
    """Drop pages scored below the threshold; a missing score counts as 0."""
    if not threshold or threshold <= 0:
        return df
    weak = (F.col("type") == "page") & (F.coalesce("score", F.lit(0.0)) < F.lit(threshold))
    return df.filter(~F.coalesce(weak, F.lit(False)))


def clip_results(df: DataFrame, size: int) -> DataFrame:
    if not size or size <= 0:
        return df
    return df.withColumns(
        {
            "content": tx.clip(F.col("content"), size, "..."),
            "raw_content": tx.clip(F.col("raw_content"), 2 * size, "..."),
        }
    )


def clean_images(df: DataFrame, size: int = 0) -> DataFrame:
    """Strip data URIs from pages and from rows of type ``image``; drop images left without a link.

    Rows of type ``image_url`` pass untouched.
    """
    page, image = F.col("type") == "page", F.col("type") == "image"
    link = F.col("image_url")
    stripped = F.when(image & link.contains("data:image"), tx.strip_data_uri(link)).otherwise(link)
    about = F.col("image_description")
    described = F.when(image, tx.clip(about, size, "...")).otherwise(about) if size and size > 0 else about
    dead = image & link.contains("data:image") & ~stripped.startswith("http")
    return df.filter(~F.coalesce(dead, F.lit(False))).withColumns(
        {
            "content": F.when(page, tx.strip_data_uri(F.col("content"))).otherwise(F.col("content")),
            "raw_content": F.when(page, tx.strip_data_uri(F.col("raw_content"))).otherwise(F.col("raw_content")),
            "image_url": stripped,
            "image_description": described,
        }
    )


def rank_results(df: DataFrame) -> DataFrame:
    """Add ``position``: score descending, missing scores as 0, ties in input order."""
    return ranked_by_score(df, QUERY, F.coalesce("score", F.lit(0.0)), "seq", "position")


def curate(df: DataFrame, threshold: float = 0.0, size: int = 0) -> DataFrame:
    """Dedupe, then filter, clean, clip and rank; a weak first copy does hide a better later one."""
    kept = clean_images(score_filter(dedupe_results(df), threshold), size)
    return rank_results(clip_results(kept, size))


def on_domains(url: Column, domains: list[str]) -> Column:
    """True if the URL's host is one of the domains or below one."""
    host = F.lower(F.regexp_replace(tx.url_domain(url), r"^.*@|:\d+$", ""))
    hits = [(host == d.lower()) | host.endswith("." + d.lower()) for d in domains]
    out = F.lit(False)
    for hit in hits:
        out = out | hit
    return out


def restrict_results(
    df: DataFrame,
    include: list[str] | None = None,
    exclude: list[str] | None = None,
    site: str | None = None,
    published: str | None = None,
    days: int | None = None,
    today: Column | None = None,
    max_results: int | None = None,
) -> DataFrame:
    """The limits a caller can set on a search: domains, one site, the last days, results per query."""
    if include:
        df = df.filter(on_domains(F.col("url"), include))
    if exclude:
        df = df.filter(~on_domains(F.col("url"), exclude))
    if site:
        df = df.filter(on_domains(F.col("url"), [site]))
    if days and published:
        df = df.filter(F.col(published) >= F.date_sub(today if today is not None else F.current_date(), days))
    if max_results:
        first = Window.partitionBy(*QUERY).orderBy("seq")
        df = df.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= max_results).drop("_n")
    return df


def digest(df: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """Text of the results per query, as ``## title`` and content in seq order.

    A query's text comes in parts of so many characters, so that no value holds a whole hot query or result; the text is
    the parts one after the other.
    """
    entry = F.concat(
        F.lit("## "), F.coalesce("title", F.lit("Untitled")), F.lit("\n\n"),
        F.coalesce("content", F.lit("No content")),
    )
    return joined_parts(df.filter("url is not null"), QUERY, "seq", entry, "\n\n", part_chars, "digest")


def title_lookup(results: DataFrame, crawled: DataFrame) -> DataFrame:
    """Title of each crawled URL: the last one seen among page results, else the URL itself."""
    titles = (
        results.filter((F.col("type") == "page") & F.col("url").isNotNull())
        .groupBy("url")
        .agg(F.max_by("title", "seen").alias("title"))
    )
    return crawled.join(titles, "url", "left").withColumn("title", F.coalesce("title", "url"))


def split_cap(df: DataFrame, pages: int = 20, images: int = 10) -> DataFrame:
    """First pages and first images of each call, as shown to a reader."""
    kind = F.when(F.col("type") == "page", "page").when(F.col("type") == "image_url", "image")
    split = df.withColumn("kind", kind).filter(F.col("kind").isNotNull())
    order = Window.partitionBy(*QUERY, "kind").orderBy("seq")
    capped = split.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= max(pages, images))
    return capped.filter(F.col("position") <= F.when(F.col("kind") == "page", pages).otherwise(images))


