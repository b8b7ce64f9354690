from pyspark.sql import functions as F

from gleanmill.operators import search as S

SCHEMA = """query_id bigint, seq bigint, type string, title string, url string, content string, raw_content string, score double,
 image_url string, image_description string"""


def frame(spark, rows):
    full = []
    for i, r in enumerate(rows):
        full.append((r.get("q", 1), r.get("seq", i), r.get("type", "page"), r.get("title"), r.get("url"), r.get("content"),
                     r.get("raw"), r.get("score"), r.get("img"), r.get("about")))
    return spark.createDataFrame(full, SCHEMA)


def test_dedupe_keeps_first_and_all_without_key(spark, table):
    df = frame(spark, [{"url": "a"}, {"url": "b"}, {"url": "a"}, {}, {"url": ""}, {"type": "image_url", "img": '{"url": "b"}'},
                       {"type": "image_url", "img": "c"}, {"q": 2, "url": "a"}])
    once = S.dedupe_results(df)
    assert table(once, "query_id", "seq") == [(1, 0), (1, 1), (1, 3), (1, 4), (1, 6), (2, 7)]
    assert table(S.dedupe_results(once)) == table(once)


def test_weak_first_copy_hides_the_better_one(spark, table):
    df = frame(spark, [{"url": "a", "score": 0.1}, {"url": "a", "score": 0.9}, {"url": "b", "score": 0.5}, {"type": "news", "url": "n"}])
    assert table(S.curate(df, 0.3), "seq", "position") == [(2, 1), (3, 2)]


def test_only_type_image_is_cleaned(spark, table):
    bad = "data:image/png;base64,QUJD"
    df = frame(spark, [{"type": "image", "img": bad, "about": "12345"}, {"type": "image_url", "img": bad, "about": "12345"},
                       {"type": "image", "img": "http://x?" + bad, "about": "12345"}, {"type": "image"}, {"content": f"a{bad}!b"}])
    got = table(S.clean_images(df, 4), "seq", "image_url", "image_description", "content")
    assert got == [(1, bad, "12345", None), (2, "http://x? ", "1234...", None), (3, None, None, None), (4, None, None, "a !b")]


def test_clip(spark, table):
    df = frame(spark, [{"content": "abcd", "raw": "123456789"}])
    assert table(S.clip_results(df, 3), "content", "raw_content") == [("abc...", "123456...")]
    assert table(S.clip_results(df, 0), "content") == [("abcd",)]


def test_result_does_not_depend_on_input_order(spark, table):
    df = frame(spark, [{"q": i % 3, "url": f"u{i % 17}", "score": (i * 7 % 10) / 10, "content": str(i)} for i in range(200)])
    want = table(S.curate(df.repartition(1), 0.2, 50))
    assert table(S.curate(df.orderBy(F.rand(3)).repartition(17), 0.2, 50)) == want


def test_restrictions(spark, table):
    df = frame(spark, [{"url": "https://a.org/1"}, {"url": "https://sub.a.org:80/2"}, {"url": "https://ba.org/3"}, {"url": "https://b.net/4"}])
    assert table(S.restrict_results(df, include=["a.org"]), "seq") == [(0,), (1,)]
    assert table(S.restrict_results(df, exclude=["a.org"], max_results=1), "seq") == [(2,)]
    assert table(S.restrict_results(df, site="b.net"), "seq") == [(3,)]
    dated = df.withColumn("day", F.expr("date_add(date'2024-01-01', cast(seq as int))"))
    assert table(S.restrict_results(dated, published="day", days=1, today=F.lit("2024-01-04").cast("date")), "seq") == [(2,), (3,)]


def test_digest_parts_make_the_whole(spark):
    df = frame(spark, [{"url": f"u{i}", "title": f"t{i}", "content": "c" * (i * 7 % 50)} for i in range(25)])
    parts = [r.digest for r in S.digest(df, 40).orderBy("part").collect()]
    assert "".join(parts) == "\n\n".join(f"## t{i}\n\n" + "c" * (i * 7 % 50) for i in range(25))
    assert all(len(p) == 40 for p in parts[:-1])



def test_copies_are_combined_before_the_shuffle(spark):
    plan = S.dedupe_results(frame(spark, [{"url": "a"}]))._jdf.queryExecution().executedPlan().toString()
    before, after = plan.split("Exchange", 1)
    assert "Aggregate" in before and "partial_min" in after and plan.count("Exchange") == 1
