"""Language identification, toxicity and approximate search: exact parts, held-out accuracy, recall."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanmill.llm import language_id as L
from gleanmill.llm import multi_index as N
from gleanmill.llm import toxicity as T
from gleanmill.llm.queries import op1_language_id, op6_multi_index_search, op8_toxicity

SF = "/root/testdata/sf0.01"


# --- languages


def test_naive_bayes_equals_a_plain_version(spark):
    rows = [("aaa bbb", "x"), ("aab ab", "x"), ("ccc ddd", "y"), ("dc 12 dd!", "y"), ("zzz", None), (None, "x"), ("123", "y")]
    model = L.train(spark.createDataFrame(rows, "text string, lang string").repartition(3))
    assert model.languages == ["x", "y"]
    counts = {lang: sum(L.bucket_counts(t) for t, g in rows if g == lang and L.has_letter(t)) for lang in "xy"}
    for text in ("ab", "cd dd", "a c", "É"):
        own = L.bucket_counts(text)
        logs = [math.log(3 / 6) + float((own * np.log((counts[g] + 0.5) / (counts[g] + 0.5).sum())).sum()) for g in "xy"]
        best = max(range(2), key=lambda k: logs[k])
        lang, score = L.classify(model, text)
        assert lang == "xy"[best] and math.isclose(score, 1 / sum(math.exp(v - logs[best]) for v in logs), rel_tol=1e-3)


def test_texts_without_letters_and_tables_without_rows(spark):
    docs = spark.createDataFrame(
        [(1, True, None), (2, False, ""), (3, False, "123 !?"), (4, True, "²"), (5, True, "word " * 20_000), (5, True, "word")], "doc_id long, held_out boolean, text string")
    trained = L.train(spark.createDataFrame([("word here", "en"), ("wort hier", "de")], "text string, lang string"))
    got = sorted(map(tuple, L.predict(docs, trained).select("doc_id", "lang_pred").collect()))
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "und"), (5, "en"), (5, "en")]
    nothing = L.train(spark.createDataFrame([], "text string, lang string"))
    assert {tuple(r) for r in L.predict(docs, nothing).select("lang_pred", "score").collect()} == {("und", 0.0)}
    assert L.predict(docs.limit(0), trained).count() == 0


def test_too_many_languages_for_the_bound(spark, monkeypatch):
    monkeypatch.setattr(L, "MAX_MATRIX_BYTES", 100)
    with pytest.raises(ValueError, match="languages"):
        L.train(spark.createDataFrame([("word", "en")], "text string, lang string"))


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = op1_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r.lang_pred == r.lang for r in got if r.held_out]
    assert sum(held) / len(held) > 0.97


# --- toxicity


def test_label_model_finds_good_and_repeated_voters():
    rng = np.random.default_rng(2)
    truth = rng.random(5000) < 0.2
    right = lambda p: np.where(rng.random(5000) < p, truth, ~truth)
    a, b = right(0.95), right(0.7)
    votes = np.stack([a, a, right(0.9), b, right(0.9)], 1) * 2 - 1
    labels = np.where(np.arange(5000) % 4 == 0, np.where(truth, 1, -1), 0)
    patterns, counts = np.unique(np.column_stack([votes, labels]), axis=0, return_counts=True)
    model = T.fit_label_model(patterns[:, :-1], patterns[:, -1], counts)
    assert model.weight[0] < 0.75 and model.weight[3] > 0.8  # the first two are the same voter
    assert model.table[0, 1, 2] > model.table[3, 1, 2]
    posterior = model.posterior(votes, np.zeros(5000))
    assert ((posterior > 0.5) == truth).mean() > 0.93


def test_linear_classifier_separates():
    rows = [[0], [0, 2], [1], [1, 2], [2], []] * 50
    model = T.fit_linear(rows, np.array([1, 1, 0, 0, 0, 0] * 50, float), ["bad", "good", "plain"])
    assert model.score("bad word") > 0.8 and model.score("good plain") < 0.2 and 0 <= model.score(None) < 0.5
    assert T.fit_linear([], np.empty(0), []).score("anything") < 1e-9


def test_toxicity_edge_rows(spark):
    docs = spark.createDataFrame([(i, "you total grumblewort " + "calm words " * i) for i in range(100)]
                                 + [(1000 + i, "calm words only " * (1 + i % 9)) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(100)] + [(1000 + i, 0) for i in range(300)] + [(3, 0), (None, 1), (7777, 1), (1001, None)], "doc_id long, toxic int")
    model = T.train(docs, labels)
    rows = spark.createDataFrame([(1, True, None), (2, True, ""), (3, True, "grumblewort"), (3, True, "calm"), (4, False, "x " * 100_000)], "doc_id long, held_out boolean, text string")
    got = sorted((r.doc_id, r.predicted) for r in T.score(rows, model).collect())
    assert got == [(1, 0), (2, 0), (3, 0), (3, 1), (4, 0)]
    assert T.train(docs, labels.limit(0)) == T.NOTHING
    assert {r.predicted for r in T.score(rows, T.NOTHING).collect()} == {0}
    assert T.score(rows.limit(0), model).count() == 0


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    got = op8_toxicity(spark, sf).join(labels, "doc_id").where("held_out").collect()
    toxic = [r.predicted for r in got if r.toxic]
    clean = [r.predicted for r in got if not r.toxic]
    assert sum(toxic) / len(toxic) > 0.8 and sum(clean) / len(clean) < 0.01


# --- search


def test_walk_is_sorted_and_complete():
    rng = np.random.default_rng(0)
    index = N.Index(rng.normal(size=(5, 3)), rng.normal(size=(7, 2)), np.ones((5, 7), np.int64))
    q = rng.normal(size=5)
    cells = list(index.walk(q))
    sums = [index.first[i] @ q[:3] + index.second[j] @ q[3:] for i, j in cells]
    assert len(set(cells)) == 35 and all(x >= y - 1e-12 for x, y in zip(sums, sums[1:], strict=False))


def exact(rows, k=20):
    ids = np.array([i for i, _ in rows])
    vectors = np.array([v for _, v in rows], float)
    out = {}
    for i, q in zip(ids.tolist(), vectors, strict=True):
        if i % 20 == 0:
            score = (vectors * q).sum(1)
            order = [p for p in np.lexsort((ids, -score)) if ids[p] != i][:k]
            out[i] = [(int(ids[p]), float(score[p])) for p in order]
    return out


def test_search_edge_rows(spark, monkeypatch):
    monkeypatch.setattr(N.search, "__defaults__", (N.K, 50))
    rng = np.random.default_rng(4)
    good = [(i, [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(200)]
    same = [(1000 + i, good[0][1]) for i in range(300)]  # one hot vector
    odd = [(2000, None), (2020, [0.0] * 6), (2040, [1.0, None] + [0.0] * 4), (2060, [float("nan")] + [1.0] * 5), (2080, [1.0] * 5), (None, [1.0] * 6), (2100, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in good + same + odd], "vec_id long, embedding array<float>, vector string").repartition(6)
    got = {}
    for r in N.nearest_neighbours(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = exact(good + same)
    assert got.keys() == want.keys()
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert [(v, s) for _, v, s in found] == sorted(((v, s) for _, v, s in found), key=lambda x: (-x[1], x[0]))
        hits += len({v for _, v, _ in found} & {v for v, _ in want[q]})
    assert hits >= 0.9 * 20 * len(want)
    assert [v for _, v, _ in got[0]] == [v for v, _ in want[0]]
    few = N.nearest_neighbours(df.where("vec_id < 5 and vec_id <> 2")).collect()
    assert sorted((r.query_id, r.vec_id) for r in few) == [(0, 1), (0, 3), (0, 4)]
    assert N.nearest_neighbours(df.limit(0)).count() == 0 and N.nearest_neighbours(df.where("vec_id = 0")).count() == 0


def test_recall_on_real_vectors(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, got = exact(rows), {}
    for r in op6_multi_index_search(spark, SF).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(got[q] & {v for v, _ in w}) for q, w in want.items()) >= 0.9 * 20 * len(want)
