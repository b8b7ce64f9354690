import posixpath
import random

import pytest
from pyspark.sql import functions as F

from gleanmill.sources import event_log as L
from gleanmill.sources import parse_batches as B
from gleanmill.sources import provider_results as P
from gleanmill.sources import tables as D
from gleanmill.streaming import conversations as S


def test_frames(spark, tmp_path, table):
    log = "event: a\ndata: {\"x\": \"y: z\"}\n\nid: 7\n\ndata: first\ndata: last\n\nevent: ping\n\nevent: end\ndata: 1"
    (tmp_path / "log.txt").write_text(log)
    got = table(L.read_event_log(spark, str(tmp_path)), "event", "data")
    assert got == [("a", '{"x": "y: z"}'), ("end", "1"), ("message", "last"), ("ping", None)]


@pytest.mark.parametrize("streaming", [False, True])
def test_oversized_frame_becomes_an_error_row(spark, tmp_path, table, streaming):
    size = 2 << 20
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "log.txt").write_text("event: a\ndata: 1\n\ndata: " + "x" * size + "\n\nevent: b\ndata: 2\n\n")

    def read(limit):
        rows = L.read_event_log(spark, str(tmp_path / "in"), streaming, limit)
        if streaming:
            out = str(tmp_path / f"out{limit}")
            S.write_stream(rows, out, str(tmp_path / f"check{limit}")).awaitTermination(60)
            rows = spark.read.parquet(out)
        return table(rows, "event", "data")

    refused = '{"error": "frame too large", "bytes": %d}' % (size + 6)
    assert read(L.FRAME_LIMIT) == [("a", "1"), ("b", "2"), ("error", refused)]
    assert read(None) == [("a", "1"), ("b", "2"), ("message", "x" * size)]


def test_log_round_trip(spark, tmp_path, table):
    df = spark.createDataFrame([("e", 1, "é\n\"q\"", None), ("e", 2, "", "x")], "event string, n int, content string, extra string")
    L.write_event_log(df, str(tmp_path / "log"))
    assert table(L.read_event_log(spark, str(tmp_path / "log")), "data") == [('{"n":1,"content":"é\\n\\"q\\""}',), ('{"n":2,"extra":"x"}',)]


def test_triage_by_position_then_name(spark, table):
    files = spark.createDataFrame([(1, 0, "a.pdf"), (1, 1, "b.pdf")], "batch_id int, pos int, name string")
    results = spark.createDataFrame(
        [(1, 0, "other", "done", "", "u"), (1, 1, "x", "failed", "", ""), (1, 2, "a.pdf", "running", "", ""), (1, 3, "zz", "done", "", "u"), (1, 4, "b.pdf", "done", "", "")],
        "batch_id int, pos int, file_name string, state string, err_msg string, full_zip_url string",
    )
    assert table(B.parse_outcome_triage(results, files), "pos", "path_name", "reason") == [
        (0, "a.pdf", None), (1, "b.pdf", "state=failed"), (2, "a.pdf", "state=running"), (3, "zz", "file_name not in batch"), (4, "b.pdf", "no full_zip_url"),
    ]


def test_uploads(spark, tmp_path, table):
    (tmp_path / "in").mkdir()
    for name, size in {"a.pdf": 3, "b.txt": 3, "c.PPTX": 0}.items():
        (tmp_path / "in" / name).write_bytes(b"x" * size)
    manifest = spark.createDataFrame([(1, n) for n in ("a.pdf", "b.txt", "c.PPTX")], "request_id int, name string")
    files = B.read_uploads(spark, manifest, str(tmp_path / "in"))
    assert table(B.validate_uploads(files), "name", "reason") == [("a.pdf", None), ("b.txt", "unsupported type .txt"), ("c.PPTX", "empty file")]
    many = spark.range(201).select(F.lit(1).alias("request_id"), F.lit("a.pdf").alias("name"), F.lit(1).alias("size"))
    assert table(B.validate_uploads(many).select("reason").distinct()) == [("too many files (max=200)",)]


def test_unique_file_ids_skip_taken_names(spark):
    names = ["a.pdf", "a_2.pdf", "a.pdf", "a.pdf", "a_2.pdf", "x", "x", ".hid", ".hid"]
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate(names)], "request_id int, seq int, name string").repartition(3)
    got = [r.file_id for r in B.unique_file_ids(df).orderBy("seq").collect()]
    assert got == ["a.pdf", "a_2.pdf", "a_3.pdf", "a_4.pdf", "a_2_2.pdf", "x", "x_2", ".hid", ".hid_2"]


def plain_file_ids(names):
    taken, out = set(), []
    for name in names:
        given, number = name, 2
        stem, ext = posixpath.splitext(name)
        while given in taken:
            given, number = f"{stem or 'file'}_{number}{ext}", number + 1
        taken.add(given)
        out.append(given)
    return out


def test_unique_file_ids_of_random_requests(spark):
    """Names that collide with numbers of each other, in all orders and depths."""
    rng, requests = random.Random(4), {}
    for request in range(120):
        pool = ["a.x", "a_2.x", "a_3.x", "a_5.x", "a_2_2.x", "a_2_3.x", "a_02.x", "a_2_2_2.x", "b", "b_2", "", "file", "file_2", "..q", ".q_2", "a_1.x", "a_1_2.x"]
        requests[request] = [rng.choice(rng.sample(pool, 5) if request % 2 else pool) for _ in range(rng.randrange(1, 25))]
    rows = [(r, 10 * i + 3, n) for r, names in requests.items() for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "request_id int, seq int, name string").repartition(5)
    got = {}
    for r in B.unique_file_ids(df).orderBy("request_id", "seq").collect():
        got.setdefault(r.request_id, []).append(r.file_id)
    assert got == {r: plain_file_ids(names) for r, names in requests.items()}


def test_one_hot_name_is_no_group(spark):
    df = spark.range(30_000).select(F.lit(1).alias("request_id"), F.col("id").alias("seq"), F.when(F.col("id") == 5, "r_7.pdf").otherwise("r.pdf").alias("name"))
    ids = B.unique_file_ids(df)
    assert "InPandas" not in ids._jdf.queryExecution().executedPlan().toString()
    got = [r.file_id for r in ids.orderBy("seq").collect()]
    assert got == plain_file_ids(["r_7.pdf" if i == 5 else "r.pdf" for i in range(30_000)][:40]) + [f"r_{i + 1}.pdf" for i in range(40, 30_000)]


def test_fetch_payloads(spark):
    df = spark.createDataFrame([(0, '{"reader_result": "r", "content": "c"}', 200), (1, '{"content": "c"}', 200), (2, "<p>", 200), (3, "", 200), (4, "x", 503)], "i int, b string, s int")
    text, failed = P.unwrap_fetch_payload(F.col("b"), F.col("s"))
    got = df.orderBy("i").select(text.alias("t"), failed.alias("f")).collect()
    assert [r.t for r in got] == ["r", "c", "<p>", "Error: empty response", "Error: status 503"]
    assert [r.f for r in got] == [False, False, False, True, True]


def test_sectioned_results_keep_the_first_url(spark, table):
    response = """[{"content": {"results": {"organic": [{"title": "t", "url": "u", "desc": "d"}, {"title": "n", "url": null, "desc": ""}],
      "images": {"items": [{"url": "i", "alt": "a"}]}}}}, {"content": {"results": {"top_stories": {"items": [{"time_frame": "1d", "title": "s", "url": "u", "source": "x"},
      {"time_frame": "2d", "title": "v", "url": "w", "source": "x"}]}}}}]"""
    df = spark.createDataFrame([(1, response)], "query_id bigint, response string")
    assert table(P.load_sectioned_results(df), "type", "url", "image_url", "time_frame") == [
        ("image_url", None, "i", None), ("news", "w", None, "2d"), ("page", "u", None, None),
    ]


def test_conversations_append(spark, table):
    old = spark.createDataFrame([("t", 1, "a"), ("t", 2, "b")], "thread_id string, message_no bigint, message string").withColumn("ts", F.lit(1))
    new = spark.createDataFrame([("t", 9, "c"), ("u", 3, "x"), ("u", 1, "y")], "thread_id string, seq bigint, message string").withColumn("ts", F.lit(2))
    both = D.append_conversations(old, new)
    assert table(both, "thread_id", "message_no", "message") == [("t", 1, "a"), ("t", 2, "b"), ("t", 3, "c"), ("u", 1, "y"), ("u", 2, "x")]
    assert table(D.conversation_stats(both)) == [("t", 3, 2), ("u", 2, 2)]


def test_store_is_partitioned_and_pruned(spark, tmp_path):
    rows = spark.range(10).select(F.concat(F.lit("c"), F.col("id") % 2).alias("collection"), F.col("id").cast("string").alias("id"), F.array(F.lit(1.0)).alias("vector"))
    D.store_chunks(rows, str(tmp_path / "store"), 3)
    D.store_chunks(rows.limit(0), str(tmp_path / "store"))
    read = spark.read.parquet(str(tmp_path / "store"))
    assert read.count() == 10
    plan = read.filter("collection = 'c1'").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:string>" in plan and "PartitionFilters: [isnotnull(collection" in plan
