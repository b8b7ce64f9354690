"""Search curation queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanmill.functions import constants as K
from gleanmill.operators import search as S
from gleanmill.plans.registry import Query
from gleanmill.plans.views import ctes, view

THRESHOLD, SIZE = 0.3, 400


def _results(spark, sf):
    return view(spark, sf, "v_search_results")


def _on(operator, *columns):
    def build(spark, sf):
        out = operator(_results(spark, sf))
        return out.select("query_id", "seq", *[F.col(c).cast("bigint") if c == "position" else c for c in columns])

    return build


BASE = ctes("v_search_results")
DEDUPED = """,
keyed as (select *, coalesce(nullif(url, ''), nullif(image_url, ''), 'row ' || seq) as k from v_search_results),
deduped as (select * exclude (k) from keyed
            qualify row_number() over (partition by query_id, k order by seq) = 1)"""


def _filter(source):
    return f"(select * from {source} where not (type = 'page' and coalesce(score, 0) < {THRESHOLD}))"


def _images(source):
    return f"""(select * exclude (content, raw_content, image_url, image_description),
    case when type = 'page' then regexp_replace(content, '{K.BASE64_IMAGE}', ' ', 'g') else content end as content,
    case when type = 'page' then regexp_replace(raw_content, '{K.BASE64_IMAGE}', ' ', 'g') else raw_content end as raw_content,
    case when type = 'image' then regexp_replace(image_url, '{K.BASE64_IMAGE}', ' ', 'g') else image_url end as image_url,
    case when type = 'image' and length(image_description) > {SIZE} then substring(image_description, 1, {SIZE}) || '...'
         else image_description end as image_description
    from {source} where not coalesce(type = 'image' and contains(image_url, 'data:image')
      and not starts_with(regexp_replace(image_url, '{K.BASE64_IMAGE}', ' ', 'g'), 'http'), false))"""


def _clip(source):
    return f"""(select * exclude (content, raw_content),
    case when length(content) > {SIZE} then substring(content, 1, {SIZE}) || '...' else content end as content,
    case when length(raw_content) > {2 * SIZE} then substring(raw_content, 1, {2 * SIZE}) || '...' else raw_content end
      as raw_content from {source})"""


RANK = "row_number() over (partition by query_id order by coalesce(score, 0) desc, seq) as position"
ALL = "query_id, seq, type, title, url, content, raw_content, score, image_url, image_description"
HOSTS = ["example.com", "example.org"]


def _title_lookup(spark, sf):
    results = _results(spark, sf).withColumn("seen", F.col("query_id") * 1000 + F.col("seq"))
    crawled = view(spark, sf, "pages").select(
        "page_id", F.when(F.col("page_id") % 5 == 0, F.concat("url", F.lit("/unseen"))).otherwise(F.col("url")).alias("url")
    )
    return S.title_lookup(results, crawled).select("page_id", "url", "title")


QUERIES = {
    "dedupe_results": Query(_on(S.dedupe_results, "type", "url", "image_url"),
                            BASE + DEDUPED + " select query_id, seq, type, url, image_url from deduped"),
    "score_filter": Query(_on(lambda df: S.score_filter(df, THRESHOLD), "type", "score"),
                          BASE + f" select query_id, seq, type, score from {_filter('v_search_results')}"),
    "clip_results": Query(_on(lambda df: S.clip_results(df, SIZE), "content", "raw_content"),
                          BASE + f" select query_id, seq, content, raw_content from {_clip('v_search_results')}"),
    "clean_images": Query(
        _on(lambda df: S.clean_images(df, SIZE), "content", "raw_content", "image_url", "image_description"),
        BASE + f" select query_id, seq, content, raw_content, image_url, image_description"
        f" from {_images('v_search_results')}",
    ),
    "rank_results": Query(_on(S.rank_results, "score", "position"),
                          BASE + f" select query_id, seq, score, {RANK} from v_search_results"),
    "curate": Query(
        _on(lambda df: S.curate(df, THRESHOLD, SIZE), *ALL.split(", ")[2:], "position"),
        BASE + DEDUPED + f" select {ALL}, {RANK} from {_clip(_images(_filter('deduped')))}",
    ),
    "restrict_results": Query(
        _on(lambda df: S.restrict_results(df, include=HOSTS, exclude=["spam-farm.example.org"], max_results=5), "url"),
        BASE + """,
hosted as (select *, lower(regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '(^.*@|:[0-9]+$)', '', 'g')) as h
           from v_search_results where url is not null)
select query_id, seq, url from hosted
where (h in ('example.com', 'example.org') or ends_with(h, '.example.com') or ends_with(h, '.example.org'))
  and not (h = 'spam-farm.example.org' or ends_with(h, '.spam-farm.example.org'))
qualify row_number() over (partition by query_id order by seq) <= 5""",
    ),
    "digest": Query(
        lambda spark, sf: S.digest(_results(spark, sf), 5000).select("query_id", "part", "digest"),
        BASE + """, whole as (select query_id, string_agg('## ' || coalesce(title, 'Untitled') || chr(10) || chr(10) || coalesce(content, 'No content'),
             chr(10) || chr(10) order by seq) as t from v_search_results where url is not null group by 1)
select query_id, part, substring(t, part * 5000 + 1, 5000) as digest
from (select *, unnest(range(cast(ceil(length(t) / 5000.0) as bigint))) as part from whole)""",
    ),
    "title_lookup": Query(
        _title_lookup,
        BASE + """,
titles as (select url, arg_max(title, query_id * 1000 + seq) as title from v_search_results
           where type = 'page' group by url),
crawled as (select page_id, case when page_id % 5 = 0 then url || '/unseen' else url end as url from pages)
select c.page_id, c.url, coalesce(t.title, c.url) as title from crawled c left join titles t on t.url = c.url""",
    ),
    "split_cap": Query(
        _on(lambda df: S.split_cap(df, 8, 4), "kind", "position"),
        BASE + """,
kinds as (select *, case type when 'page' then 'page' when 'image_url' then 'image' end as kind from v_search_results),
ranked as (select query_id, seq, kind, row_number() over (partition by query_id, kind order by seq) as position
           from kinds where kind is not null)
select * from ranked where position <= case kind when 'page' then 8 else 4 end""",
    ),
}
