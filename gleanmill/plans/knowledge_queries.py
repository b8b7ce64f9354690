"""Indexing and retrieval queries and their SQL twins.

A document's source doubles as its file. Retrieval queries are the mean directions of the embedding labels.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanmill.functions import constants as K
from gleanmill.operators import chunking as H
from gleanmill.operators import indexing as I
from gleanmill.operators import plugins as U
from gleanmill.operators import retrieval as V
from gleanmill.plans.registry import Query
from gleanmill.plans.views import view
from gleanmill.session import scratch_folder
from gleanmill.sources.tables import store_chunks

SIZE, OVERLAP = 512, 64

DOCS = """select doc_id as id, text as content, source, lang, '/data/' || source as path, source || '_v1.md' as filename from {documents}"""
PATHS = """select distinct '/data/' || source as path, 'file-' || source as file_id from {documents} where lang = 'en' and source < 'src5'"""


def _docs(spark, sf):
    return spark.sql(DOCS, documents=view(spark, sf, "documents"))


def _filed(spark, sf):
    return _docs(spark, sf).withColumn("file_id", F.col("source"))


def _guard_docs(spark, sf):
    """Two files have nothing to index: one is blank, one empty."""
    content = F.when(F.col("source") == "src3", "  \n").when(F.col("source") == "src4", "").otherwise(F.col("content"))
    return _filed(spark, sf).withColumn("content", content)


def _chunks(spark, sf, size=SIZE, overlap=OVERLAP):
    docs = _docs(spark, sf).select("id", "content", F.create_map(F.lit("lang"), "lang", F.lit("chunk_index"), F.lit("x")).alias("metadata"))
    return H.chunk_rows(docs, H.fixed_spans(F.col("content"), size, overlap), "token")


def _spans_sql(size: int, overlap: int, source: str = "documents") -> str:
    step = size - overlap
    return f"""spans as (select doc_id, source, text, length(text) as n, greatest(cast(ceil((length(text) - {overlap}) / {step}.0) as bigint), 1) as total
  from {source} where length(text) > 0),
chunks as (select *, i * {step} as s, least(i * {step} + {size}, n) as e from (select *, unnest(range(total)) as i from spans))
"""


def _span_chunks(kind):
    def build(spark, sf):
        docs = _docs(spark, sf).select("id", "content")
        return H.chunk_rows(docs, H.chunker(kind)(F.col("content"), SIZE), kind).select(
            "original_document_id", "chunk_index", "chunk_start", "chunk_end", "content"
        )

    return build


def _chunk_rows(spark, sf):
    m = F.col("metadata")
    return _chunks(spark, sf).select(
        "id", "original_document_id", "chunk_index", "chunk_start", "chunk_end", "token_count", "total_chunks", "content",
        *[F.element_at(m, F.lit(n)).alias(f"m_{n}") for n in ("lang", "chunk_index", "chunker_type", "total_chunks")],
    )


GUARD_SQL = """docs as (select doc_id, source, case source when 'src3' then '  ' || chr(10) when 'src4' then '' else text end as text
  from documents),
counted as (select source as file_id, count(*) as docs, sum(case when length(text) = 0 then 0
    else greatest(cast(ceil((length(text) - 64) / 448.0) as bigint), 1) end) as chunks,
  bool_or(trim(text, ' ' || chr(10)) <> '') as filled from docs group by 1),
guarded as (select *, case when not filled then 'parse' when chunks = 0 then 'chunk' end as stage,
  case when not filled then 'no content' when chunks = 0 then 'no chunks produced' end as reason from counted)
"""


def _guarded(spark, sf):
    docs = _guard_docs(spark, sf)
    return I.guard_files(I.file_chunks(docs, H.fixed_spans(F.col("content"), SIZE, OVERLAP)))


def _report(spark, sf):
    files = _guarded(spark, sf).select("file_id", "stage", "reason")
    vectors = _checked(spark, sf).select("file_id", "stage", "reason")
    return I.index_report(files.union(vectors), "kb")


def _checked(spark, sf):
    """Embeddings by label as files: some vectors are missing, one file's are of the wrong length."""
    rows = view(spark, sf, "embeddings").select(F.concat(F.lit("label_"), "label", F.lit(".md")).alias("file_id"), "vec_id", "embedding", "label")
    vectors = rows.filter((F.col("label") != 3) | (F.col("vec_id") % 2 == 0)).select(
        "file_id", F.when(F.col("label") == 5, F.slice("embedding", 1, 8)).otherwise(F.col("embedding")).alias("vector")
    )
    return I.check_vectors(rows, vectors, 64)


CHECKED_SQL = """rows as (select 'label_' || label || '.md' as file_id, vec_id, label, embedding from embeddings),
checked as (select file_id, count(*) as chunks, count(*) filter (where label <> 3 or vec_id % 2 = 0) as vectors, label
            from rows group by file_id, label),
vectors_checked as (select file_id, chunks, vectors, case when vectors <> chunks or label = 5 then 'embed' end as stage,
  case when vectors <> chunks then 'embed count mismatch' when label = 5 then 'vector dimension is not 64' end as reason from checked)
"""

STAMP = 1700000000000


def _store(spark, sf):
    totals = F.count(F.lit(1)).alias("total")
    rows = view(spark, sf, "embeddings").withColumn("file_id", F.concat(F.lit("my_file-"), "label", F.lit(".md")))
    counted = rows.join(rows.groupBy("file_id").agg(totals), "file_id")
    chunks = counted.select(
        "file_id", F.when(F.col("vec_id") % 2 == 0, F.concat(F.lit("c"), "vec_id")).alias("id"),
        F.col("vec_id").alias("chunk_index"), "total", F.when(F.col("label") == 2, "Given").alias("title"),
        F.concat(F.lit("text "), "vec_id").alias("content"), F.col("embedding").alias("vector"),
        F.create_map(F.lit("source"), F.lit("x"), F.lit("label"), F.col("label").cast("string")).alias("metadata"),
    )
    return I.store_rows(chunks, "kb", timestamp=F.lit(STAMP))


def _stored(rows):
    m = F.col("metadata")
    return rows.select(
        "collection", "id", F.size("vector").cast("bigint").alias("dimension"), "content", "title", "url", "source",
        *[F.element_at(m, F.lit(n)).alias(f"m_{n}") for n in ("source", "file", "timestamp", "label")],
    )


def _store_round_trip(spark, sf):
    path = scratch_folder(spark, "store")
    store_chunks(_store(spark, sf), path)
    return _stored(spark.read.parquet(path))


STORE_SQL = f"""with rows as (select *, 'my_file-' || label || '.md' as f, count(*) over (partition by label) as total from embeddings)
select 'kb' as collection, case when vec_id % 2 = 0 then 'c' || vec_id else 'uploaded_my_file-' || label || '_'
    || substring(md5(f || '_' || total || '_{STAMP}'), 1, 8) || case when total > 1 then '_chunk_' || vec_id else '' end end as id,
  cast(64 as bigint) as dimension, 'text ' || vec_id as content, case when label = 2 then 'Given' else 'My File-' || label end as title,
  'milvus://kb/' || f as url, 'uploaded' as source, 'uploaded' as m_source, f as m_file, '{STAMP}' as m_timestamp,
  cast(label as string) as m_label from rows"""


def _index(spark, sf):
    stored, _ = I.index_documents(_guard_docs(spark, sf), "kb", "token", SIZE, timestamp=F.lit(STAMP))
    return stored.select("id", _components("vector").alias("vector"), "content", "title", "url")


def _components(vector):
    """All components of a vector, in ten thousandths, as text."""
    return F.array_join(F.transform(vector, lambda x: F.round(x.cast("double") * 10000).cast("bigint")), " ")


def _embedded(spark, sf):
    docs = _docs(spark, sf)
    return docs.select("id", _components(U.embed(F.col("content"), dimension=16)).alias("vector"))


def _vectors_sql(source: str, dimension: int) -> str:
    """The vectors of ``source`` (id, content), in the form of ``_components``."""
    return f"""texts as (select id, unnest(regexp_extract_all(lower(content), '[^\\x20\\x09-\\x0D]+')) as w from {source}),
codes as (select id, cast('0x' || md5(w)[1:8] as bigint) as c from texts),
cells as (select id, c % {dimension} as i, sum(case when (c >> 16) & 1 = 1 then 1 else -1 end) as s from codes group by 1, 2),
norms as (select id, sqrt(sum(s * s)) as norm from cells group by 1),
vectors as (select a.id, string_agg(coalesce(cast(round(cast(cast(s / norm as float) as double) * 10000) as bigint), 0), ' ' order by a.i) as vector
  from (select id, unnest(range({dimension})) as i from {source}) a left join cells c on a.id = c.id and a.i = c.i
  left join (select id, case when norm = 0 then 1 else norm end as norm from norms) n on a.id = n.id group by 1)"""


def _packing_sql(name: str, source: str, end: str, shortest: int, size: int) -> str:
    """Table ``name`` (id, s, e): the parts of longer rows of ``source`` (id, text, s, e), up to ``end`` each, packed; others as they are.

    One row per part and piece: a part makes a piece when it is long enough or the last, a piece that does not fit closes the span.
    """
    return f"""
{name}_parts as (select id, text, s, e, regexp_extract_all(substring(text, s + 1, e - s), '(?s).*?(?:{end})|.+') as parts from {source} where e - s > {size}),
{name}_fold as (
  select id, s as base, parts, 0 as k, s as pos, s as cut, s as first, s as last, cast(null as bigint) as close_s, cast(null as bigint) as close_e from {name}_parts
  union all
  select id, base, parts, k + 1, now, case when piece then now else cut end, case when piece and not fits then last else first end,
    case when piece then now else last end, case when piece and not fits then first end, case when piece and not fits then last end
  from (select *, now - cut >= {shortest} or (k + 1 = len(parts) and now > cut) as piece, now - first <= {size} or last = first as fits
        from (select *, pos + length(parts[k + 1]) as now from {name}_fold where k < len(parts)))),
{name} as (select f.id, d.text, s, e from (
    select id, close_s as s, close_e as e from {name}_fold where close_s is not null
    union all select id, first, last from {name}_fold where k = len(parts)
    union all select id, s, e from {source} where e - s <= {size}) f join (select doc_id, text from documents) d on d.doc_id = f.id)"""


WHOLE_SQL = "with recursive whole as (select doc_id as id, text, cast(0 as bigint) as s, cast(length(text) as bigint) as e from documents where length(text) > 0),"
SPANS_OF_SQL = """ select id as original_document_id, row_number() over (partition by id order by s) - 1 as chunk_index, s as chunk_start, e as chunk_end,
  substring(text, s + 1, e - s) as content from """


def _sentences_sql() -> str:
    """Texts that fit into one chunk are one; the others are packed by sentences."""
    return WHOLE_SQL + _packing_sql("spans", "whole", H.SENTENCE_END, H.SENTENCE_MIN, SIZE) + SPANS_OF_SQL + "spans"


def _recursive_sql() -> str:
    levels, source = [], "whole"
    for level, end in enumerate(H.SPLITS):
        levels.append(_packing_sql(f"level{level}", source, end.replace("'", "''"), H.PIECE_MIN, SIZE))
        source = f"level{level}"
    even = f"""even as (select id, text, least(s + i * {SIZE}, e) as s, least(s + (i + 1) * {SIZE}, e) as e
  from (select *, unnest(range(cast(ceil((e - s) / {SIZE}.0) as bigint))) as i from {source}))"""
    return WHOLE_SQL + ",".join(levels) + "," + even + SPANS_OF_SQL + "even"


def _corpus(spark, sf):
    return view(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _label_queries(corpus):
    """The summed vector per label, in millionths, so that the sum is exact in any order."""
    parts = corpus.select(F.col("label").cast("bigint").alias("query_id"), F.posexplode("vector").alias("i", "x"))
    sums = parts.groupBy("query_id", "i").agg(F.sum(F.round(F.col("x").cast("double") * 1e6).cast("bigint")).alias("s"))
    value = F.col("s") / F.lit(1e6)
    return sums.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", value.alias("v")))), lambda p: p["v"]).alias("vector")
    )


LABELS_SQL = """parts as (select cast(label as bigint) as query_id, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings),
sums as (select query_id, i, sum(cast(round(cast(x as double) * 1000000) as bigint)) / 1000000.0e0 as v from parts group by 1, 2),
queries as (select query_id, list(v order by i) as q from sums group by 1),
corpus as (select vec_id as id, cast(embedding as double[]) as v from embeddings)
"""


def _ranked_sql(k: int, cosine: bool) -> str:
    score = "list_cosine_similarity(q, v)" if cosine else "list_inner_product(q, v)"
    return LABELS_SQL + f""", scored as (select query_id, id, round({score}, 6) as similarity from queries, corpus),
hits as (select *, row_number() over (partition by query_id order by similarity desc, id) as rank from scored
         qualify rank <= {k})
"""


def _hits(k, cosine):
    def build(spark, sf):
        corpus = _corpus(spark, sf)
        return V.topk(corpus, _label_queries(corpus), k, cosine).select(
            "query_id", "id", "similarity", F.col("rank").cast("bigint").alias("rank")
        )

    return build


def _ivf(probes):
    """Search with so many of the lists, or with all of them, which must equal the exact search."""

    def build(spark, sf):
        corpus = _corpus(spark, sf).select("id", "vector")
        path = scratch_folder(spark, "ivf")
        rows = corpus.count()
        centers = V.build_ivf(corpus, path, nlist=max(2, min(1024, int(rows**0.5))))
        hits = V.topk_ivf(spark.read.parquet(path), centers, _label_queries(_corpus(spark, sf)), 10, probes or len(centers))
        return hits.select("query_id", "id", "similarity", F.col("rank").cast("bigint").alias("rank"))

    return build


def _documents_of(hits):
    """Hits with made-up documents: chunks of one label and parity belong together."""
    doc = F.concat(F.lit("doc"), F.pmod("id", F.lit(3)).cast("string"))
    return hits.select(
        "query_id", "rank", doc.alias("doc_id"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("kb://a/"), doc)).otherwise("").alias("url"),
        F.when(F.col("id") % 3 == 1, F.concat(F.lit("T "), doc)).otherwise("").alias("title"),
        F.concat(F.lit("text "), "id").alias("content"), "similarity",
    )


RESOURCES = """select distinct cast(label as bigint) as query_id, case label % 4 when 1 then 'kb://a/doc1' when 2 then 'x/doc2/y' else 'kb://none' end
  as uri from {embeddings} where label % 4 <> 0"""
HITS_SQL = _ranked_sql(10, False) + """, docs as (select query_id, rank, 'doc' || (id % 3) as doc_id,
    case when id % 2 = 0 then 'kb://a/doc' || (id % 3) else '' end as url,
    case when id % 3 = 1 then 'T doc' || (id % 3) else '' end as title, 'text ' || id as content, similarity from hits)
"""


def _scoped(spark, sf):
    hits = _documents_of(_hits(10, False)(spark, sf))
    return V.scope_filter(hits, spark.sql(RESOURCES, embeddings=view(spark, sf, "embeddings")))


def _searched_resources(spark, sf):
    hits = _documents_of(_hits(10, False)(spark, sf)).withColumnRenamed("doc_id", "id")
    return V.search_resources(hits).withColumn("position", F.col("position").cast("bigint"))


def _grouped(spark, sf):
    grouped = V.group_hits(_documents_of(_hits(10, False)(spark, sf)))
    return grouped.select(
        "query_id", F.col("position").cast("bigint").alias("position"), "doc_id", "url", "title", "text",
        F.size("chunks").cast("bigint").alias("chunks"),
    )


RESOURCE_ROWS = """select cast(doc_id as string) as id, case when doc_id % 3 = 0 then '' else 'kb://docs/' || source end as url,
  case doc_id % 4 when 0 then '' else source end as title, case when lang = 'en' then 'uploaded' else 'seed' end as source from {documents}"""


def _resources(limit):
    def build(spark, sf):
        return I.list_resources(spark.sql(RESOURCE_ROWS, documents=view(spark, sf, "documents")), limit)

    return build


def _resources_sql(limit):
    tail = f" order by uri, id limit {limit}" if limit else ""
    return f"""with store as ({RESOURCE_ROWS.format(documents='documents')}),
named as (select id, coalesce(nullif(url, ''), 'milvus://' || id) as uri, coalesce(nullif(title, ''), nullif(id, ''), 'Unnamed') as title
          from store where source = 'uploaded'),
one as (select uri, min(id) as id, arg_min(title, id) as title from named group by 1)
select uri, title from (select * from one{tail})"""


TOPICS = """select conv_id, turn, case (conv_id + turn) % 7 when 0 then text || ' Please use My Files.' when 1 then 'STORAGE ' || text
  when 2 then text || ' 请看我的论文' when 3 then 'see RAG://x ' || text when 4 then 'ask MILVUS://y' when 5 then text || ' handbook' else text end as text
  from {conversations}"""


def _intent(spark, sf):
    topics = spark.sql(TOPICS, conversations=view(spark, sf, "conversations"))
    return topics.select("conv_id", "turn", I.retrieval_intent(F.col("text"), ["Handbook"]).alias("phrase"))


INTENT_SQL = f"""with topics as ({TOPICS.format(conversations='conversations')})
select conv_id, turn, coalesce({', '.join(
    [f"case when contains(lower(text), '{p}') then '{p}' end" for p in K.RETRIEVAL_PHRASES_EN]
    + ["case when contains(lower(text), 'handbook') then 'Handbook' end"]
    + [f"case when contains(text, '{p}') then '{p}' end" for p in K.RETRIEVAL_PHRASES_ZH]
    + [f"case when contains(lower(text), '{u}') then '{u}' end" for u in K.RETRIEVAL_URIS]
)}) as phrase from topics"""

MODELS = """select event_id, case event_id % 8 when 0 then 'GPT-4o-mini' when 1 then 'gpt-4-32k' when 2 then 'Qwen2.5-' || event_type
  when 3 then 'text-embedding-v4' when 4 then 'text-embedding-v2-beta' when 5 then 'text-embedding-3-large' when 6 then event_type else '' end as model,
  case when event_id % 3 = 0 then 'OpenAI' else 'other' end as provider from {events}"""


def _models(spark, sf):
    models = spark.sql(MODELS, events=view(spark, sf, "events"))
    m, p = F.col("model"), F.col("provider")
    return models.select(
        "event_id", I.token_limit(m).alias("token_limit"), I.embed_batch(m, p).alias("batch"), I.embedding_dimension(m).alias("dimension")
    )


QUERIES = {
    "group_by_file": Query(
        lambda spark, sf: I.group_by_file(
            _docs(spark, sf), spark.sql(PATHS, documents=view(spark, sf, "documents"))
        ).groupBy("file_id").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.length("content")).alias("chars")),
        f"""with docs as ({DOCS.format(documents='documents')}), paths as ({PATHS.format(documents='documents')})
select coalesce(p.file_id, d.filename) as file_id, count(*) as docs, cast(sum(length(content)) as bigint) as chars
from docs d left join paths p using (path) group by 1""",
    ),
    "chunk_fixed": Query(
        lambda spark, sf: _chunks(spark, sf, 2048, 0).select("original_document_id", "chunk_start", "chunk_end", "content"),
        "with " + _spans_sql(2048, 0)
        + "select doc_id as original_document_id, s as chunk_start, e as chunk_end, substring(text, s + 1, e - s) as content from chunks",
    ),
    "chunk_sentences": Query(_span_chunks("sentence"), _sentences_sql()),
    "chunk_recursive": Query(_span_chunks("recursive"), _recursive_sql()),
    "chunk_rows": Query(
        _chunk_rows,
        "with " + _spans_sql(SIZE, OVERLAP) + """select doc_id || '_chunk_' || printf('%04d', i) as id, doc_id as original_document_id, i as chunk_index,
  s as chunk_start, e as chunk_end, e - s as token_count, total as total_chunks, substring(text, s + 1, e - s) as content,
  lang as m_lang, cast(i as string) as m_chunk_index, 'token' as m_chunker_type, cast(total as string) as m_total_chunks
from chunks join (select doc_id, lang from documents) using (doc_id)""",
    ),
    "guard_files": Query(_guarded, "with " + GUARD_SQL + "select * replace (cast(chunks as bigint) as chunks) from guarded"),
    "embed_chunks": Query(
        _embedded, "with filled as (select doc_id as id, coalesce(text, '') as content from documents), " + _vectors_sql("filled", 16)
        + " select id, vector from vectors",
    ),
    "check_vectors": Query(_checked, "with " + CHECKED_SQL + "select * from vectors_checked"),
    "store_rows": Query(lambda spark, sf: _stored(_store(spark, sf)), STORE_SQL),
    "store_chunks": Query(_store_round_trip, STORE_SQL),
    "index_documents": Query(
        _index,
        "with " + GUARD_SQL.replace("64) / 448.0", "0) / 512.0") + f""", good as (select file_id, chunks from guarded where reason is null),
spans as (select d.doc_id, d.text, g.file_id, cast(ceil(length(d.text) / 512.0) as bigint) as total from docs d join good g on g.file_id = d.source
          where length(d.text) > 0),
cut as (select *, unnest(range(total)) as i from spans),
chunks as (select doc_id || '_chunk_' || printf('%04d', i) as id, file_id, substring(text, i * 512 + 1, 512) as content from cut),
""" + _vectors_sql("chunks", 64) + """ select id, vector, content, 'Src' || substring(file_id, 4) as title, 'milvus://kb/' || file_id as url
from chunks join vectors using (id)""",
    ),
    "index_report": Query(
        _report,
        "with " + GUARD_SQL + ", " + CHECKED_SQL + """, files as (select file_id, stage, reason from guarded union all
  select file_id, stage, reason from vectors_checked)
select file_id, case when reason is null then 'success' else 'failed' end as status, stage, reason,
  case when reason is null then 'milvus://kb/' || file_id end as uri,
  case when reason is null then case when starts_with(file_id, 'label') then 'Label ' || substring(file_id, 7, length(file_id) - 9)
    else 'Src' || substring(file_id, 4) end end as title from files""",
    ),
    "topk_inner_product": Query(_hits(10, False), "with " + _ranked_sql(10, False) + "select query_id, id, similarity, rank from hits"),
    "topk_cosine": Query(_hits(10, True), "with " + _ranked_sql(10, True) + "select query_id, id, similarity, rank from hits"),
    "topk_ivf": Query(_ivf(10)),
    "topk_ivf_all_lists": Query(_ivf(None), "with " + _ranked_sql(10, False) + "select query_id, id, similarity, rank from hits"),
    "search_resources": Query(
        _searched_resources,
        "with " + HITS_SQL + """, named as (select query_id, rank, coalesce(nullif(url, ''), 'milvus://' || doc_id) as uri,
  coalesce(nullif(title, ''), doc_id) as title from docs),
firsts as (select query_id, uri, min(rank) as best, arg_min(title, rank) as title from named group by 1, 2)
select query_id, row_number() over (partition by query_id order by best) as position, uri, title from firsts""",
    ),
    "scope_filter": Query(
        _scoped,
        "with " + HITS_SQL + f""", resources as ({RESOURCES.format(embeddings='embeddings')})
select d.* from docs d where not exists (select 1 from resources r where r.query_id = d.query_id) or exists (select 1 from resources r
  where r.query_id = d.query_id and ((d.url <> '' and contains(r.uri, d.url)) or contains(r.uri, d.doc_id)))""",
    ),
    "group_hits": Query(
        _grouped,
        "with " + HITS_SQL + """select query_id, row_number() over (partition by query_id order by min(rank)) as position, doc_id,
  nullif(arg_min(url, rank), '') as url, nullif(arg_min(title, rank), '') as title,
  string_agg(content, chr(10) || chr(10) order by rank) as text, count(*) as chunks from docs group by query_id, doc_id""",
    ),
    "list_resources": Query(_resources(None), _resources_sql(None)),
    "list_resources_limited": Query(_resources(100), _resources_sql(100)),
    "retrieval_intent": Query(_intent, INTENT_SQL),
    "model_limits": Query(
        _models,
        f"""with models as ({MODELS.format(events='events')})
select event_id, cast(coalesce({', '.join(f"case when contains(lower(model), '{p}') then {n} end" for p, n in K.TOKEN_LIMITS)},
    100000) as int) as token_limit,
  cast(case model {' '.join(f"when '{m}' then {n}" for m, n in K.EMBED_BATCH.items())} else case
    {' '.join(f"when starts_with(model, '{p}') then {K.EMBED_BATCH[p]}" for p in K.EMBED_BATCH_PREFIXES)}
    when lower(provider) = 'openai' then 512 else 10 end end as int) as batch,
  cast(case model {' '.join(f"when '{m}' then {n}" for m, n in K.EMBED_DIMENSIONS.items())} else 1536 end as int) as dimension
from models""",
    ),
}
