import re
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanmill.operators import chunking as H
from gleanmill.operators import indexing as I
from gleanmill.operators import plugins as U
from gleanmill.operators import retrieval as V

RNG = random.Random(11)
TEXTS = ["", "x", "no end", "A b. C d! E f? G\nH", "word " * 300, "a" * 700, "é。中" * 90, "Hi. " * 40 + "\n\n" + "long sentence here, with commas; " * 30]
TEXTS += ["".join(RNG.choice("ab .!?\n,é") for _ in range(RNG.randint(1, 900))) for _ in range(60)]


@pytest.mark.parametrize("kind", ["token", "sentence", "recursive"])
@pytest.mark.parametrize("size", [16, 100])
def test_chunks_concatenate_to_the_text(spark, kind, size):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id int, content string")
    parts: dict[int, list] = {}
    for r in H.chunk_rows(docs, H.chunker(kind)(F.col("content"), size), kind).orderBy("original_document_id", "chunk_index").collect():
        parts.setdefault(r.original_document_id, []).append(r)
    for i, text in enumerate(TEXTS):
        mine = parts.get(i, [])
        assert "".join(r.content for r in mine) == text
        assert all(r.total_chunks == len(mine) and r.content == text[r.chunk_start:r.chunk_end] for r in mine)
        if kind != "sentence":
            assert all(len(r.content) <= size for r in mine)


def plain_packed(cuts, size, overlap=0):
    spans, first = [], 0
    while first < len(cuts) - 1:
        last = first + 1
        while last + 1 < len(cuts) and cuts[last + 1] - cuts[first] <= size:
            last += 1
        spans.append((cuts[first], cuts[last]))
        if last == len(cuts) - 1:
            break
        following = last
        while overlap and following - 1 > first and cuts[last] - cuts[following - 1] <= overlap:
            following -= 1
        first = following
    return spans


def plain_cuts(text, start, end, pattern, shortest):
    cuts = [start]
    for m in re.compile(pattern).finditer(text, start, end):
        if m.end() - cuts[-1] >= shortest:
            cuts.append(m.end())
    return cuts if cuts[-1] == end else [*cuts, end]


def plain_recursive(text, size, start, end, level=0):
    if end - start <= size:
        return [(start, end)]
    if level == len(H.SPLITS):
        return [(s, min(s + size, end)) for s in range(start, end, size)]
    spans = plain_packed(plain_cuts(text, start, end, H.SPLITS[level], H.PIECE_MIN), size)
    return [x for s, e in spans for x in plain_recursive(text, size, s, e, level + 1)]


@pytest.mark.parametrize("overlap", [0, 13, 40])
def test_sentence_spans_match_the_plain_version(spark, overlap):
    docs = spark.createDataFrame([*enumerate(TEXTS), (999, None)], "id int, content string")
    got = {r.id: [tuple(x) for x in r.s] for r in docs.select("id", H.sentence_spans(F.col("content"), 60, overlap).alias("s")).collect()}
    want = {i: plain_packed(plain_cuts(t, 0, len(t), H.SENTENCE_END, H.SENTENCE_MIN), 60, overlap) for i, t in enumerate(TEXTS) if t}
    assert {i: s for i, s in got.items() if s} == want


@pytest.mark.parametrize("size", [30, 100])
def test_recursive_spans_match_the_plain_version(spark, size):
    docs = spark.createDataFrame([*enumerate(TEXTS), (999, None)], "id int, content string")
    chosen = docs.select("id", H.recursive_spans(F.col("content"), size).alias("s"))
    assert "Python" not in chosen._jdf.queryExecution().executedPlan().toString()
    got = {r.id: [tuple(x) for x in r.s] for r in chosen.collect()}
    assert {i: s for i, s in got.items() if s} == {i: plain_recursive(t, size, 0, len(t)) for i, t in enumerate(TEXTS) if t}


def test_overlap_windows(spark):
    docs = spark.createDataFrame([(1, "0123456789")], "id int, content string")
    got = [r.content for r in H.chunk_rows(docs, H.fixed_spans(F.col("content"), 4, 2), "token").orderBy("chunk_index").collect()]
    assert got == ["0123", "2345", "4567", "6789"]
    text = "Sentence number one. Sentence number two. Sentence number three. "
    docs = spark.createDataFrame([(1, text)], "id int, content string")
    spans = [r.content for r in H.chunk_rows(docs, H.sentence_spans(F.col("content"), 45, 25), "sentence").orderBy("chunk_index").collect()]
    assert spans == [text[:42], text[21:]]


def test_chunk_metadata_and_registry(spark):
    docs = spark.createDataFrame([("d", "abcdef", {"lang": "en", "chunk_index": "x"})], "id string, content string, metadata map<string,string>")
    row = H.chunk_rows(docs, H.fixed_spans(F.col("content"), 4), "token").orderBy(F.desc("chunk_index")).first()
    assert row.id == "d_chunk_0001" and row.metadata["lang"] == "en" and row.metadata["chunk_index"] == "1"
    bare = H.chunk_rows(docs, H.fixed_spans(F.col("content"), 4), "token", keep_metadata=False).first()
    assert "lang" not in bare.metadata
    with pytest.raises(ValueError):
        H.chunker("nope")
    H.register_chunker("whole", lambda text, size=0: H.fixed_spans(text, 1 << 30))
    assert H.chunker("whole")


def test_index_documents_reports_every_file(spark, table):
    docs = spark.createDataFrame(
        [("a.md", 1, "x" * 25), ("a.md", 2, "y" * 5), ("b.md", 3, " "), ("c.md", 4, ""), ("big.md", 5, "z" * 500)],
        "file_id string, id int, content string",
    )
    stored, report = I.index_documents(docs, "kb", "token", 10, 20)
    assert table(report, "file_id", "status", "stage", "reason") == [
        ("a.md", "success", None, None), ("b.md", "failed", "parse", "no content"), ("big.md", "failed", "chunk", "chunk count exceeds limit (max=20)"),
        ("c.md", "failed", "parse", "no content"),
    ]
    assert table(stored, "id", "url") == [(i, "milvus://kb/a.md") for i in ("1_chunk_0000", "1_chunk_0001", "1_chunk_0002", "2_chunk_0000")]
    assert {len(r.vector) for r in stored.collect()} == {64}


def test_embedder_is_deterministic_and_pluggable(spark):
    one = U.HashingEmbedder(16)
    assert one.embed_query("a b a") == one.embed_query("A B a") and abs(np.linalg.norm(one.embed_query("some words")) - 1) < 1e-6

    class Lengths:
        def embed_documents(self, texts):
            return [[float(len(t)), float(len(texts))] for t in texts]

    U.register_embedder("lengths", Lengths)
    df = spark.createDataFrame([("ab",), (None,), ("abc",)], "t string").coalesce(1)
    assert [r[0] for r in df.select(U.embed(F.col("t"), "lengths", batch_size=2)).collect()] == [[2.0, 2.0], [0.0, 2.0], [3.0, 1.0]]


def vectors(spark, n, name, seed, dim=6):
    rng = np.random.default_rng(seed)
    data = rng.integers(-2, 3, size=(n, dim)).astype("float64")
    return data, spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], f"{name} bigint, vector array<float>")


@pytest.mark.parametrize("cosine", [False, True])
@pytest.mark.parametrize("held", [4, 10_000])
def test_topk_is_exact_with_ties(spark, cosine, held):
    """Small integer vectors make many ties; whatever a task holds, the hits agree with brute force."""
    corpus, left = vectors(spark, 300, "id", 1)
    queries, right = vectors(spark, 9, "query_id", 2)

    def unit(m):
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) if cosine else m

    scores = np.round(unit(queries) @ unit(corpus).T, 6)
    want = {(q, int(i), r + 1) for q in range(9) for r, i in enumerate(np.lexsort((np.arange(300), -scores[q]))[:7])}
    got = V.topk(left.repartition(6), right, 7, cosine, block_rows=40, query_rows=4, held_queries=held)
    assert {(r.query_id, r.id, r["rank"]) for r in got.collect()} == want
    assert V.topk(left.limit(0), right, 7).collect() == [] == V.topk(left, right.limit(0), 7).collect()


def test_topk_of_very_many_queries(spark):
    """20,000 queries, text ids, and a corpus smaller than k."""
    data, corpus = vectors(spark, 500, "id", 1)
    asked, queries = vectors(spark, 20_000, "query_id", 2)
    named = corpus.withColumn("id", F.format_string("n%04d", "id"))
    got = V.topk_inner_product(named, queries, 3).groupBy("rank").agg(F.sum("similarity").alias("s"), F.count("*").alias("n"), F.max("id").alias("m")).collect()
    best = -np.sort(-(asked @ data.T), axis=1)[:, :3]
    assert {r["rank"]: (round(r.s), r.n) for r in got} == {i + 1: (round(best[:, i].sum()), 20_000) for i in range(3)}
    assert all(r.m.startswith("n") for r in got)
    assert V.topk_inner_product(named.limit(2), queries.limit(3), 5).count() == 6


def test_ivf_recall(spark, tmp_path):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(20, 8)) * 3
    data = centers[rng.integers(0, 20, 2000)] + rng.normal(size=(2000, 8)) * 0.3
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id bigint, vector array<float>")
    queries = corpus.filter("id < 40").select(F.col("id").alias("query_id"), "vector")
    lists = V.build_ivf(corpus, str(tmp_path / "ivf"), nlist=32)
    index = spark.read.parquet(str(tmp_path / "ivf"))
    assert index.count() == 2000
    exact = {(r.query_id, r.id) for r in V.topk_inner_product(corpus, queries).collect()}
    found = {(r.query_id, r.id) for r in V.topk_ivf(index, lists, queries, 10, 16).collect()}
    assert len(exact & found) / len(exact) >= 0.9


def test_scope_and_grouping(spark, table):
    hits = spark.createDataFrame(
        [(1, 1, "d1", "kb://a", "T", "c1", 0.9), (1, 2, "d2", "", "", "c2", 0.8), (1, 3, "d1", "kb://a", "T", "c3", 0.7), (1, 4, "", "", "", "c4", 0.6), (2, 1, "d9", "", "", "c5", 0.5)],
        "query_id int, rank int, doc_id string, url string, title string, content string, similarity double",
    )
    scope = spark.createDataFrame([(1, "kb://a/file")], "query_id int, uri string")
    assert table(V.scope_filter(hits, scope), "query_id", "rank") == [(1, 1), (1, 3), (1, 4), (2, 1)]
    got = table(V.group_hits(hits), "query_id", "position", "doc_id", "url", "text")
    assert got[0] == (1, 1, "d1", "kb://a", "c1\n\nc3") and got[1] == (1, 2, "d2", None, "c2") and got[3] == (2, 1, "d9", None, "c5")


def test_intent(outcomes):
    cases = {"Search MY FILES now": "my files", "storage": "rag", "看我的文档": "我的文档", "Rag://x": "rag", "see MILVUS://x": "milvus://",
             "my": None, " ": None, None: None, "the manual says": "manual"}
    assert outcomes(lambda c: I.retrieval_intent(c, ["manual", " "]), list(cases)) == list(cases.values())


def test_models(outcomes):
    assert outcomes(I.token_limit, ["GPT-4o-x", "my-gpt-4", "", None, "gemini-1.5-pro"]) == [120000, 8000, 100000, 100000, 180000]
    assert outcomes(lambda c: I.embed_batch(c, F.lit("dashscope")), ["text-embedding-v2-x", "odd", "text-embedding-3-small"]) == [25, 10, 512]
    assert outcomes(lambda c: I.embedding_dimension(c, F.lit(0)), ["text-embedding-v4", "odd"]) == [2048, 1536]


def test_stored_title_and_missing_ids(spark):
    df = spark.createDataFrame(
        [("dir/my_file v2.md", None, 0, 2, None, "c", [1.0], None), ("x.md", None, 0, 1, "Given", "c", [1.0], {"file": "kept", "source": "s"})],
        "file_id string, id string, chunk_index int, total int, title string, content string, vector array<float>, metadata map<string,string>",
    )
    a, b = I.store_rows(df, "kb", timestamp=F.lit(5)).orderBy("url").collect()
    assert (a.title, a.url, a.metadata["timestamp"], a.metadata["source"]) == ("My File V2", "milvus://kb/my_file_v2.md", "5", "uploaded")
    assert a.id.startswith("uploaded_my_file_v2_") and a.id.endswith("_chunk_0") and b.id.startswith("uploaded_x_") and "chunk" not in b.id
    assert (b.title, b.metadata["file"], b.metadata["source"]) == ("Given", "kept", "uploaded")


def test_vector_counts(spark, table):
    chunks = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "file_id string")
    found = spark.createDataFrame([("a", [1.0, 2.0]), ("a", None), ("b", [1.0])], "file_id string, vector array<double>")
    assert table(I.check_vectors(chunks, found, 2), "file_id", "reason") == [
        ("a", "embed count mismatch"), ("b", "vector dimension is not 2"), ("c", "embed count mismatch"),
    ]
