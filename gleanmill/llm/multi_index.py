"""Nearest neighbours by an inverted multi-index.

Vectors are cut into two halves and each half is quantised by a codebook of its own, so that pairs of centroids make a
fine grid of cells. A query walks the cells in descending order of its summed inner products with both centroids, kept in
a heap, until the cells walked hold the wanted share of all rows; the rows of those cells are reranked by the exact inner
product.

The codebooks are fitted to at most ``SAMPLE`` rows, those with the smallest hash of their id; every row is indexed. The
share to walk is measured: for ``PROBES`` rows of the sample the exact neighbours are found among all rows, and the
share is taken at which ``RECALL`` of them are reached, so nearly random vectors are searched widely and clustered ones narrowly.
What is sent to tasks is bounded: codebooks, one count per cell, and the probes.

Rows lie in blocks of one first centroid and a hash of the id, ``BLOCK_ROWS`` rows each on average over the table, so a
vector with very many copies is spread. A query goes once to each block of the first centroids it walks, with the second
centroids wanted, and takes its best k of the block in one matrix product; the best of all blocks are merged.

Null and zero vectors, other lengths than the most common one, and vectors with null or non-finite components take no
part. Ties go to the smaller id. With fewer candidates than k, all are returned.

Rows with one vec_id divisible by 20 answer as one query, and each is a candidate of its own. An empty table has an empty
result. Only vec_id and embedding are read, so other columns cannot clash.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanmill.llm.common import checkpointed, slices

K = 20
CENTROIDS = 32
SAMPLE = 16_384
PROBES = 64
RECALL = 0.96
BLOCK_ROWS = 8_192


def usable(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, vector (array<double>) of the rows that take part; the dimension is that of most rows."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), v.alias("vector")).where(fine)
    size = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("vector") == (size["d"] if size else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def fit(points: np.ndarray, centroids: int, rounds: int = 15) -> np.ndarray:
    """Lloyd's algorithm from evenly spaced rows; an empty centroid stays where it was."""
    centre = points[np.linspace(0, len(points) - 1, min(centroids, len(points))).astype(int)].copy()
    for _ in range(rounds):
        own = nearest(points, centre)
        sums = np.zeros_like(centre)
        np.add.at(sums, own, points)
        n = np.bincount(own, minlength=len(centre))
        centre[n > 0] = sums[n > 0] / n[n > 0, None]
    return centre


def nearest(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.argmin((centre**2).sum(1) - 2 * points @ centre.T, 1)


@dataclass(frozen=True)
class Index:
    first: np.ndarray
    second: np.ndarray
    counts: np.ndarray  # rows by first and second centroid
    share: float = 1.0

    @property
    def half(self) -> int:
        return self.first.shape[1]

    def cells(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return nearest(vectors[:, : self.half], self.first), nearest(vectors[:, self.half :], self.second)

    def walk(self, query: np.ndarray) -> Iterator[tuple[int, int]]:
        """All pairs of centroids by descending sum of inner products."""
        a, b = self.first @ query[: self.half], self.second @ query[self.half :]
        by_a, by_b = np.argsort(-a, kind="stable").tolist(), np.argsort(-b, kind="stable").tolist()
        heap, reached = [(-(a[by_a[0]] + b[by_b[0]]), 0, 0)], {(0, 0)}
        while heap:
            _, i, j = heapq.heappop(heap)
            yield by_a[i], by_b[j]
            for x, y in ((i + 1, j), (i, j + 1)):
                if x < len(by_a) and y < len(by_b) and (x, y) not in reached:
                    reached.add((x, y))
                    heapq.heappush(heap, (-(a[by_a[x]] + b[by_b[y]]), x, y))

    def wanted(self, query: np.ndarray, k: int) -> dict[int, list[int]]:
        """Second centroids by first centroid of the cells to rerank: the share of all rows, and more than k rows."""
        total, seen, out = int(self.counts.sum()), 0, {}
        enough = max(self.share * total, k + 1)
        for i, j in self.walk(query):
            if self.counts[i, j]:
                out.setdefault(i, []).append(j)
                seen += self.counts[i, j]
                if seen >= enough:
                    break
        return out


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    """Places that may belong to the k largest of a row, ties and rounding included."""
    finite = np.flatnonzero(scores > -np.inf)
    if len(finite) <= k:
        return finite
    edge = np.partition(scores[finite], len(finite) - k)[len(finite) - k]
    return finite[scores[finite] >= edge - 1e-9 * (1 + abs(edge))]


def _best(query: np.ndarray, vectors: np.ndarray, ids: np.ndarray, places: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of some rows; each product is summed alike wherever the row lies, so equal vectors tie."""
    exact = (vectors[places] * query).sum(1)
    order = np.lexsort((ids[places], -exact))[:k]
    return ids[places[order]], exact[order]


def _exact(rows: DataFrame, queries: list[tuple[int, np.ndarray]], k: int) -> DataFrame:
    """query_id, id, score, vector: the k best rows of each of a few queries, from one pass over all rows."""
    shared = rows.sparkSession.sparkContext.broadcast(queries)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 4096):
            ids, vectors = part.column(0).to_numpy(), _matrix(part.column(1))
            out = []
            for q, query in shared.value:
                places = _top(np.where(ids == q, -np.inf, vectors @ query), k)
                found, score = _best(query, vectors, ids, places, k)
                at = dict(zip(ids.tolist(), range(len(ids)), strict=True))
                out += [(q, i, s, vectors[at[i]]) for i, s in zip(found.tolist(), score.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[c] for x in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64())))],
                ["query_id", "id", "score", "vector"])

    found = rows.mapInArrow(scan, "query_id long, id long, score double, vector array<double>")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def build(rows: DataFrame, k: int = K, centroids: int = CENTROIDS, sample: int = SAMPLE, probes: int = PROBES, recall: float = RECALL) -> Index | None:
    """The index over ``rows`` (id, vector); None without rows."""
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    if not chosen.num_rows:
        return None
    points = _matrix(chosen.column("vector").combine_chunks())
    half = (points.shape[1] + 1) // 2
    first = fit(points[:, :half], centroids)
    second = fit(points[:, half:], centroids) if half < points.shape[1] else np.zeros((1, 0))
    bare = Index(first, second, np.zeros((len(first), len(second)), np.int64))
    shared = rows.sparkSession.sparkContext.broadcast(bare)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros_like(shared.value.counts)
        for part in slices(batches, 4096):
            np.add.at(counts, shared.value.cells(_matrix(part.column(0))), 1)
        cell = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(counts.ravel()[cell])], ["cell", "n"])

    for r in rows.select("vector").mapInArrow(tally, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        bare.counts.ravel()[r["cell"]] = r["n"]
    queries = list(zip(chosen.column("id").to_pylist()[:probes], points[:probes], strict=True))
    truth = _exact(rows, queries, k).select("query_id", "vector").toArrow()
    if not truth.num_rows:
        return bare
    a, b = bare.cells(_matrix(truth.column("vector").combine_chunks()))
    total, need = bare.counts.sum(), []
    reach: dict[int, dict[tuple[int, int], float]] = {}
    for q, query in queries:
        seen, reach[q] = 0, {}
        for cell in bare.walk(query):
            seen += bare.counts[cell]
            reach[q][cell] = seen / total
    need = [reach[q][x, y] for q, x, y in zip(truth.column("query_id").to_pylist(), a.tolist(), b.tolist(), strict=True)]
    return Index(first, second, bare.counts, float(np.quantile(need, recall)))


def search(rows: DataFrame, queries: DataFrame, index: Index, k: int = K, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of each query (id, vector) among ``rows`` (id, vector) without itself."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(index)
    salts = [max(1, -(-int(n) // block_rows)) for n in index.counts.sum(1)]
    sends = spark.sparkContext.broadcast(salts)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 4096):
            a, b = shared.value.cells(_matrix(part.column(1)))
            salt = part.column(2).to_numpy() % np.array(sends.value)[a]
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int32()), pa.array(salt, pa.int32()), pa.array(b, pa.int32()), part.column(0), part.column(1)],
                ["first", "salt", "second", "id", "vector"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 256):
            out = []
            for q, query in zip(part.column(0).to_pylist(), _matrix(part.column(1)), strict=True):
                for first, second in shared.value.wanted(query, k).items():
                    out += [(first, salt, second, q, query) for salt in range(sends.value[first])]
            types = (pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.int64(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in enumerate(types)], ["first", "salt", "seconds", "query_id", "query"])

    def rerank(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out_q, out_id, out_score = [], [], []
        if rows.num_rows and asked.num_rows:
            rows = rows.sort_by("id")
            ids, vectors = rows.column("id").to_numpy(), _matrix(rows.column("vector").combine_chunks())
            second = rows.column("second").to_numpy()
            for part in asked.to_batches(max_chunksize=256):
                query = _matrix(part.column(part.schema.get_field_index("query")))
                lists = part.column(part.schema.get_field_index("seconds")).to_pylist()
                numbers = part.column(part.schema.get_field_index("query_id")).to_pylist()
                scores = query @ vectors.T
                for r, (q, seconds) in enumerate(zip(numbers, lists, strict=True)):
                    open_cells = np.zeros(len(shared.value.second), bool)
                    open_cells[seconds] = True
                    places = _top(np.where(open_cells[second] & (ids != q), scores[r], -np.inf), k)
                    found, score = _best(query[r], vectors, ids, places, k)
                    out_q.append(np.full(len(found), q))
                    out_id.append(found)
                    out_score.append(score)
        flat = [np.concatenate(x) if x else np.empty(0, t) for x, t in ((out_q, np.int64), (out_id, np.int64), (out_score, np.float64))]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, flat), strict=True)))

    salted = rows.select("id", "vector", F.pmod(F.xxhash64("id"), F.lit(1 << 30)).cast("int"))
    indexed = salted.mapInArrow(place, "first int, salt int, second int, id long, vector array<double>")
    asked = queries.select("id", "vector").mapInArrow(ask, "first int, salt int, seconds array<int>, query_id long, query array<double>")
    hits = indexed.groupBy("first", "salt").cogroup(asked.groupBy("first", "salt")).applyInArrow(rerank, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(vectors: DataFrame, every: int = 20, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the rows whose vec_id is divisible by ``every`` searched among all rows."""
    rows = checkpointed(usable(vectors))
    index = build(rows, k)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search(rows, rows.where(F.col("id") % every == 0), index, k)
