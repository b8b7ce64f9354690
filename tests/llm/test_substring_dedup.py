"""Substring dedup against all windows, on real and made documents."""

import hashlib

import numpy as np
import pytest

from gleanmill.llm import substring_dedup as S


def plain(rows):
    """(doc_id, n_words, n_removed, sha256 of what is left) by the definition."""
    split = [(d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, w in split:
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            rank = (d is None, d or 0)
            first[key] = min(first.get(key, rank), rank)
    out = []
    for d, w in split:
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < (d is None, d or 0):
                gone |= set(range(k, k + 13))
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return sorted(out, key=str)


def made():
    rng = np.random.default_rng(11)
    word = lambda n: rng.choice([f"v{i}" for i in range(5000)], n).tolist()
    passage, exact, hot = word(60), word(13), word(20)
    rows = [(10 + i, " ".join(word(7 * i % 29) + passage + word(30))) for i in range(6)]
    rows += [(40 + i, " ".join(word(i) + exact + word(5))) for i in range(8)]
    rows += [(60 + i, " ".join(word(i) + exact[:12] + word(5))) for i in range(3)]
    rows += [(100 + i, " ".join(hot)) for i in range(300)]
    rows += [(5, " ".join(["same"] * 40)), (6, " ".join(["same"] * 14)), (7, "\t".join(passage) + "\n"), (8, None), (9, ""), (9, " \x0b "),
             (3, " ".join(exact + exact)), (3, " ".join(exact + passage)), (None, " ".join(passage)), (None, " ".join(passage)),
             (900, " ".join(word(40_000) + passage)), (901, "É " * 20), (902, "É " * 20)]
    return rows


@pytest.mark.parametrize("size", [1 << 30, 3000])
def test_matches_all_windows(spark, size, monkeypatch):
    monkeypatch.setattr(S, "GROUP_BYTES", size)
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [tuple(r) for r in S.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got, key=str) == plain(rows)


def test_real_documents(spark, monkeypatch):
    monkeypatch.setattr(S, "GROUP_BYTES", 40_000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = [tuple(r) for r in S.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    want = plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert sorted(got, key=str) == want and sum(x[2] for x in want) > 0


def test_spans_are_maximal_repeats(spark):
    rows = [(1, " ".join(f"a{i}" for i in range(40))), (2, "x y " + " ".join(f"a{i}" for i in range(5, 25)) + " z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: [(s.begin, s.end) for s in r.repeats] for r in S.remove_repeats(docs).collect()}
    assert spans == {1: [], 2: [(2, 22)]}


def test_texts_lose_the_words_and_rows_keep_their_columns(spark):
    text = " ".join(f"a{i}" for i in range(20))
    rows = [(1, text, "k", 1, "r"), (2, "one  two " + text, "k", 2, "r"), (3, text, None, 3, "r"), (4, None, "k", 4, None), (5, "keeps  its\nblanks", "k", 5, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, g int, row string")
    got = S.without_repeats(docs)
    assert got.columns == docs.columns
    want = [(1, text, "k", 1, "r"), (2, "one two", "k", 2, "r"), (3, "", None, 3, "r"), (4, None, "k", 4, None), (5, "keeps  its\nblanks", "k", 5, "r")]
    assert sorted(map(tuple, got.collect())) == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.remove_repeats(docs).count() == 0 and S.without_repeats(docs).count() == 0


def test_the_text_is_shuffled_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    df = S.remove_repeats(docs)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("REPARTITION_BY_NUM") - plan.count("ReusedExchange") == 1
