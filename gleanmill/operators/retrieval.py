"""Vector retrieval: exact and approximate top-k, scoping, and grouping of hits into documents.

``corpus(id, vector)``, ``queries(query_id, vector)``. Exact search computes every product, but never as rows. Both sides
are packed into rows of bounded size, blocks of the corpus and slices of the queries, and every block meets every slice in
one matrix product; a task keeps its k best per query, so what is shuffled is k rows per query and task. The final merge
runs in rounds. Catalyst sends the slices to the tasks that hold the blocks where they are small, and pairs partitions
where they are not; the result is the same. Rows without a vector take no part. Similarities are rounded to six decimals;
ties go to the lower id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Vectors packed into one row, and queries of which a task keeps hits before it hands them on.
BLOCK_VECTORS = 2_048
SLICE_QUERIES = 512
HELD_QUERIES = 100_000
QUERY_SLICE = 256
GRID_ROWS = 50_000
GRID_QUERIES = 2_000
DIGITS = 6


def _matrix(vectors: pd.Series, unit: bool) -> np.ndarray:
    matrix = np.stack(vectors.to_numpy()).astype("float64") if len(vectors) else np.empty((0, 0))
    if unit and len(matrix):
        norms = np.linalg.norm(matrix, axis=1, keepdims=True)
        matrix = matrix / np.where(norms == 0, 1, norms)
    return matrix


class _Best:
    """The k best (score, id) per query seen so far, ties by id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores = [np.empty(0)] * queries
        self.ids = [np.empty(0, dtype=object)] * queries

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores[query], scores]), np.concatenate([self.ids[query], ids])
        if len(scores) > self.k:
            edge = np.partition(scores, -self.k)[-self.k]
            kept = scores >= edge
            scores, ids = scores[kept], ids[kept]
            order = np.lexsort((ids, -scores))[: self.k]
            scores, ids = scores[order], ids[order]
        self.scores[query], self.ids[query] = scores, ids

    def add_block(self, wanted: np.ndarray, matrix: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> None:
        """Products of some queries with a batch of rows, a slice of queries at a time."""
        for start in range(0, len(wanted), QUERY_SLICE):
            part = wanted[start : start + QUERY_SLICE]
            for query, scores in zip(part, np.round(matrix[part] @ rows.T, DIGITS)):
                self.add(query, scores, ids)

    def frame(self, query_ids: np.ndarray) -> pd.DataFrame:
        sizes = [len(s) for s in self.scores]
        return pd.DataFrame(
            {
                "query_id": np.repeat(query_ids, sizes),
                "id": np.concatenate(self.ids) if sizes else [],
                "similarity": np.concatenate(self.scores) if sizes else [],
            }
        )


def _hit_schema(corpus: DataFrame, queries: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("id", corpus.schema["id"].dataType),
            T.StructField("similarity", T.DoubleType()),
        ]
    )


def _final(hits: DataFrame, k: int) -> DataFrame:
    """Best k per query out of the tasks' candidates, in two rounds so that no query meets all of them at once."""
    order = [F.desc("similarity"), F.asc("id")]
    salted = hits.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    first = Window.partitionBy("query_id", "_salt").orderBy(*order)
    second = Window.partitionBy("query_id").orderBy(*order)
    few = salted.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= k).drop("_n", "_salt")
    return few.withColumn("rank", F.row_number().over(second)).filter(F.col("rank") <= k)


def _packed(table: DataFrame, key: str, unit: bool, count: int, prefix: str) -> DataFrame:
    """Rows of up to ``count`` vectors: their keys as an array, their components as bytes, and a number of its own."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 33, 0
        held: list[pa.RecordBatch] = []
        waiting = 0

        def row(rows: pa.Table) -> pa.RecordBatch:
            matrix = _matrix(rows.column("vector").to_pandas(), unit)
            keys = rows.column("key").combine_chunks()
            values = [pa.array([first + made]), pa.ListArray.from_arrays([0, len(keys)], keys), pa.array([matrix.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(values, [f"{prefix}no", f"{prefix}keys", f"{prefix}vectors"])

        for batch in batches:
            held.append(batch)
            waiting += batch.num_rows
            while waiting >= count:
                rows = pa.Table.from_batches(held)
                yield row(rows[:count])
                made += 1
                held, waiting = rows[count:].to_batches(), waiting - count
        if waiting:
            yield row(pa.Table.from_batches(held))

    kind = table.schema[key].dataType.simpleString()
    rows = table.where("vector is not null").select(F.col(key).alias("key"), F.col("vector").cast("array<double>").alias("vector"))
    return rows.mapInArrow(pack, f"{prefix}no long, {prefix}keys array<{kind}>, {prefix}vectors binary")


def _unpacked(row: dict, prefix: str) -> tuple[np.ndarray, np.ndarray]:
    keys = np.asarray(row[f"{prefix}keys"])
    return keys, np.frombuffer(row[f"{prefix}vectors"], "float64").reshape(len(keys), -1)


def _best_of_block(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, row) of the scores that may be among each query's k best: all that reach its k-th."""
    if scores.shape[1] > k:
        edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        return np.nonzero(scores >= edge[:, None])
    return np.nonzero(np.ones(scores.shape, bool))


class _Hits:
    """Hits of one slice of queries, cut to the k best of each whenever they have doubled."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size, self.limit = 0, 4 * k * len(queries)

    def add(self, places: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        self.parts.append((places, scores, ids))
        self.size += len(places)
        if self.size > self.limit:
            self.cut()

    def cut(self) -> None:
        places, scores, ids = (np.concatenate(column) for column in zip(*self.parts, strict=True))
        order = np.lexsort((ids, -scores, places))
        places = places[order]
        starts = np.flatnonzero(np.append(True, places[1:] != places[:-1]))
        nth = np.arange(len(places)) - np.repeat(starts, np.diff(np.append(starts, len(places))))
        kept = order[nth < self.k]
        self.parts = [(places[nth < self.k], scores[kept], ids[kept])]
        self.size = len(kept)

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        self.cut()
        places, scores, ids = self.parts[0]
        columns = [self.queries[places].tolist(), ids.tolist(), scores]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def topk(
    corpus: DataFrame, queries: DataFrame, k: int = 10, cosine: bool = False, block_rows: int = BLOCK_VECTORS,
    query_rows: int = SLICE_QUERIES, held_queries: int = HELD_QUERIES,
) -> DataFrame:
    """Exact k best per query by inner product or cosine: ``query_id, id, similarity, rank``."""
    kinds = _hit_schema(corpus, queries)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(kinds)
        slices: dict[int, _Hits] = {}
        for batch in batches:
            for pair in (row for i in range(batch.num_rows) for row in batch.slice(i, 1).to_pylist()):
                ids, rows = _unpacked(pair, "c_")
                asked, matrix = _unpacked(pair, "q_")
                if pair["q_no"] not in slices and sum(len(s.queries) for s in slices.values()) + len(asked) > held_queries:
                    yield from (s.batch(schema) for s in slices.values())
                    slices = {}
                scores = np.round(matrix @ rows.T, DIGITS)
                places, found = _best_of_block(scores, k)
                slices.setdefault(pair["q_no"], _Hits(asked, k)).add(places, scores[places, found], ids[found])
        yield from (s.batch(schema) for s in slices.values())

    # The stated queries against all rows, block by slice.
    pairs = _packed(corpus, "id", cosine, block_rows, "c_").crossJoin(_packed(queries, "query_id", cosine, query_rows, "q_"))
    return _final(pairs.mapInArrow(search, kinds), k)


def topk_inner_product(corpus: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    return topk(corpus, queries, k)


def topk_cosine(corpus: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    return topk(corpus, queries, k, cosine=True)


def train_lists(corpus: DataFrame, nlist: int, seed: int = 7) -> np.ndarray:
    """Centroids of ``nlist`` clusters, trained on all rows. Only the centroids come back."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    features = corpus.select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    features = features.persist(StorageLevel.MEMORY_AND_DISK)  # read once per iteration
    try:
        model = KMeans(k=nlist, seed=seed, maxIter=10).fit(features)
        return np.asarray(model.clusterCenters())
    finally:
        features.unpersist()


def _nearest(vectors: np.ndarray, centers: np.ndarray, n: int) -> np.ndarray:
    distances = (centers**2).sum(axis=1) - 2 * vectors @ centers.T
    return np.argsort(distances, axis=1)[:, :n]


def assign_lists(table: DataFrame, centers: np.ndarray, n: int = 1, out: str = "lists") -> DataFrame:
    """Add the ``n`` nearest clusters of each vector. The centroids are few by construction."""
    shared = table.sparkSession.sparkContext.broadcast(centers)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def nearest(vectors: pd.Series) -> pd.Series:
        if vectors.empty:
            return pd.Series([], dtype=object)
        return pd.Series(_nearest(_matrix(vectors, False), shared.value, n).tolist())

    return table.withColumn(out, nearest(F.col("vector")))


def build_ivf(corpus: DataFrame, path: str, nlist: int = 1024, seed: int = 7) -> np.ndarray:
    """Write the corpus partitioned by cluster; a search reads only the clusters it probes."""
    centers = train_lists(corpus, nlist, seed)
    listed = assign_lists(corpus, centers).select("*", F.col("lists")[0].alias("list")).drop("lists")
    listed.write.mode("overwrite").partitionBy("list").parquet(path)
    return centers


def topk_ivf(index: DataFrame, centers: np.ndarray, queries: DataFrame, k: int = 10, nprobe: int = 10) -> DataFrame:
    """Approximate k best: each query looks at its ``nprobe`` nearest clusters of a built index.

    A cluster's rows and the queries that probe it are cut into pieces of bounded size by a hash, and every
    pair of pieces is one group. The tables of pieces have one row per cluster, at most as many as there are
    centroids, so they are broadcast; they also prune the index's partitions.
    """
    probes = assign_lists(queries, centers, min(nprobe, len(centers))).select(
        "query_id", "vector", F.explode("lists").alias("list")
    )

    def pieces(table: DataFrame, rows: int, name: str) -> DataFrame:
        return table.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / F.lit(rows)).alias(name))

    plan = pieces(index, GRID_ROWS, "_rows").join(F.broadcast(pieces(probes, GRID_QUERIES, "_queries")), "list")
    every = {n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)) for n in ("_rows", "_queries")}
    rows = (
        index.join(F.broadcast(plan), "list")
        .withColumn("_c", F.pmod(F.xxhash64("id"), F.col("_rows")))
        .withColumn("_q", every["_queries"])
    )
    asked = (
        probes.join(F.broadcast(plan), "list")
        .withColumn("_q", F.pmod(F.xxhash64("query_id"), F.col("_queries")))
        .withColumn("_c", every["_rows"])
    )

    def search(part: pd.DataFrame, queries_here: pd.DataFrame) -> pd.DataFrame:
        best = _Best(len(queries_here), k)
        if len(part) and len(queries_here):
            best.add_block(
                np.arange(len(queries_here)), _matrix(queries_here["vector"], False), _matrix(part["vector"], False),
                part["id"].to_numpy(),
            )
        return best.frame(queries_here["query_id"].to_numpy())

    left = rows.select("list", "_c", "_q", "id", "vector").groupBy("list", "_c", "_q")
    right = asked.select("list", "_c", "_q", "query_id", "vector").groupBy("list", "_c", "_q")
    return _final(left.cogroup(right).applyInPandas(search, _hit_schema(index, queries)), k)


def scope_filter(hits: DataFrame, resources: DataFrame) -> DataFrame:
    """Keep the hits in the scope of their query's resources ``(query_id, uri)``; no resources, no limit.

    In scope: the non-empty URL, or the document id (even an empty one), is part of a resource's URI. To be
    applied to finished top-k hits.
    """
    scoped = resources.select("query_id").distinct().withColumn("_scoped", F.lit(True))
    marked = hits.join(scoped, "query_id", "left")
    free = marked.filter(F.col("_scoped").isNull()).drop("_scoped")
    bound = marked.filter(F.col("_scoped").isNotNull()).drop("_scoped").alias("h")
    uris = resources.select("query_id", "uri").alias("r")
    within = (F.col("h.query_id") == F.col("r.query_id")) & (
        ((F.coalesce("h.url", F.lit("")) != "") & F.col("r.uri").contains(F.col("h.url")))
        | F.col("r.uri").contains(F.coalesce("h.doc_id", F.lit("")))
    )
    return free.unionByName(bound.join(uris, within, "left_semi").select(*hits.columns))


def group_hits(hits: DataFrame, by: str = "doc_id") -> DataFrame:
    """Hits ``(query_id, rank, doc_id, url, title, content, similarity)`` to documents in best-hit order.

    A query has at most k hits, so the arrays are small. ``text`` joins the chunks by an empty line; empty
    URLs and titles become null.
    """
    chunk = F.struct("rank", "content", "similarity")
    grouped = hits.groupBy("query_id", F.col(by).alias("doc_id")).agg(
        F.min("rank").alias("best"),
        F.min_by("url", "rank").alias("url"),
        F.min_by("title", "rank").alias("title"),
        F.array_sort(F.collect_list(chunk)).alias("chunks"),
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("best"))
    return grouped.select(
        "query_id",
        place.alias("position"),
        "doc_id",
        F.nullif("url", F.lit("")).alias("url"),
        F.nullif("title", F.lit("")).alias("title"),
        "chunks",
        F.array_join(F.transform("chunks", lambda c: c["content"]), "\n\n").alias("text"),
    )


def search_resources(hits: DataFrame, scheme: str = "milvus") -> DataFrame:
    """Distinct resources ``query_id, uri, title`` of finished top-k hits ``(query_id, rank, id, url, title)``, best hit first.

    How many hits are looked at is the k of the search that made them.
    """
    named = hits.select(
        "query_id", "rank",
        F.coalesce(F.nullif("url", F.lit("")), F.concat(F.lit(f"{scheme}://"), F.col("id").cast("string"))).alias("uri"),
        F.coalesce(F.nullif("title", F.lit("")), F.nullif(F.col("id").cast("string"), F.lit("")), F.lit("Unnamed")).alias("title"),
    )
    first = named.groupBy("query_id", "uri").agg(F.min("rank").alias("best"), F.min_by("title", "rank").alias("title"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("best"))
    return first.select("query_id", place.alias("position"), "uri", "title")
