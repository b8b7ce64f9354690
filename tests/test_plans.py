"""Physical plans: what must not be shuffled, what must be pruned, what must be cut before it moves."""

import pytest
from pyspark.sql import functions as F

from gleanmill.operators import citations as C
from gleanmill.operators import indexing as I
from gleanmill.operators import messages as M
from gleanmill.operators import reports as R
from gleanmill.operators import retrieval as V
from gleanmill.operators import search as S
from gleanmill.operators.ordering import numbered, ranked_by_score
from gleanmill.plans import views


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def stored(spark, tmp_path):
    def store(sql):
        path = str(tmp_path / "table")
        spark.sql(sql).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    return store


def test_text_work_is_narrow(stored):
    reports = stored("select id as report_id, 'news' as style, '# T' as body, 'x' as unread from range(10)")
    for job in (R.evaluate_reports(reports), C.parse_references(reports), C.extract_urls(reports)):
        text = plan(job)
        assert "Exchange" not in text and "unread" not in text


def test_evaluate_is_generated_code(stored):
    reports = stored("select id as report_id, 'news' as style, '# T' as body from range(10)")
    assert "Python" not in plan(R.evaluate_reports(reports))


def test_listing_reads_no_vectors(stored):
    store = stored("select 'uploaded' as source, 'i' as id, 'u' as url, 't' as title, array(1.0f) as vector, 'c' as content from range(3)")
    text = plan(I.list_resources(store))
    assert "EqualTo(source,uploaded)" in text
    assert "ReadSchema: struct<source:string,id:string,url:string,title:string>" in text


def test_top_rows_are_cut_before_the_shuffle(stored):
    results = stored("""select id % 2 as query_id, id as seq, 'page' as type, 'u' as url, 0.5d as score from range(50)""")
    for job in (S.split_cap(results), S.restrict_results(results, max_results=3)):
        before = plan(job).split("Exchange hashpartitioning(query_id", 1)[1]
        assert "WindowGroupLimit" in before and "Partial" in before
    messages = stored("select id % 3 as thread_id, id as seq, 'm' as message_id, 'stop' as finish_reason from range(9)")
    assert "WindowGroupLimit" in plan(M.awaiting_feedback(messages))


def test_exact_search_moves_only_hits(stored, spark):
    corpus = stored("select id, array(cast(id as float), 1.0f) as vector from range(20)")
    queries = spark.sql("select id as query_id, array(1.0f, 0.5f) as vector from range(3)")
    text = plan(V.topk(corpus, queries, 2))
    below_python = text.split("MapInArrow", 1)[1]
    assert "Exchange hashpartitioning" not in below_python and "BroadcastExchange" in below_python and "WindowGroupLimit" in text


def test_ranks_are_computed_per_block(stored):
    results = stored("select id % 2 as query_id, id as seq, 0.5d as score from range(50)")
    text = plan(ranked_by_score(results, ["query_id"], F.col("score"), "seq", "position", 10))
    assert "Exchange hashpartitioning(query_id" in text and "_block" in text.split("Exchange hashpartitioning(query_id", 1)[1][:200]
    assert "_block" not in plan(S.rank_results(results))  # no hot group: one plain window


def exchanges(df, column):
    """Exchanges that move a column."""
    todo, found = [df._jdf.queryExecution().executedPlan().initialPlan()], 0
    while todo:
        node = todo.pop()
        found += "Exchange" in node.nodeName() and f"{column}#" in node.output().mkString(",")
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


@pytest.fixture
def inputs(spark, tmp_path):
    """Documents and pages with repeated and null keys."""
    spark.sql("select * from values (1L, 'a'), (1L, 'a'), (4L, 'b'), (28L, 'c'), (28L, null), (null, 'd'), (3L, 'e'), (-1L, 'f') as t(doc_id, text)").write.parquet(f"{tmp_path}/documents.parquet")
    pages = "select p as page_id, concat('http://e.org/', r) as url, concat('<title>T', r, '</title>') as html from values "
    spark.sql(pages + "(null, 20), (2L, 21), (5L, 22), " + ", ".join(f"({i}L, {i})" for i in range(11)) + " as t(p, r)").write.parquet(f"{tmp_path}/pages.parquet")
    return str(tmp_path)


def test_report_texts_are_shuffled_once(spark, inputs, monkeypatch):
    text = views.VIEWS["v_reports"].replace("{page_count}", views.page_count(spark, inputs))
    plain = spark.sql(text, documents=views.view(spark, inputs, "documents"), v_pages=views.view(spark, inputs, "v_pages"))
    reports = views.view(spark, inputs, "v_reports")
    rows = sorted(map(tuple, reports.collect()), key=str)
    assert rows == sorted(map(tuple, plain.collect()), key=str) and len(rows) == 9
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert exchanges(views.view(spark, inputs, "v_reports"), "text") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_usage_reads_no_report_beforehand(spark):
    """Hot threads are asked for among the sources; a report that cannot be read fails the job, not the call."""
    sources = spark.createDataFrame([(1, "http://a", 1)], "thread_id bigint, url string, first_seen bigint")
    reports = spark.range(1).selectExpr("id as thread_id", "raise_error('read') as body").selectExpr("thread_id", "cast(body as string) as body")
    assert C.citation_usage(sources, reports).columns == ["thread_id", "url", "first_seen", "status", "used_number"]


def test_numbers_with_hot_groups_asked_elsewhere(spark):
    rows = spark.createDataFrame([(g, i * i) for g in (1, 2) for i in range(40)], "g int, at int")
    some = rows.where("at % 2 = 0 and not (g = 2 and at > 100)")
    for among in (rows, None):
        got = {(r.g, r["at"]): r.n for r in numbered(some, ["g"], "at", "n", block_rows=5, among=among).collect()}
        assert got == {(g, a): i + 1 for g, top in ((1, 40 * 40), (2, 101)) for i, a in enumerate(x * x for x in range(0, 40, 2) if x * x < top)}


def test_citations_are_read_once_to_resolve_links(stored, spark):
    reports = stored("select id as report_id, concat('[a](http://', id, ') ## References\\n- [b](http://', id, ') [c](http://', id, '%20)') as body from range(20)")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for source in (reports, reports.repartition("report_id")):
            resolved = C.resolve_links(C.markdown_links(source), C.parse_references(source))
            assert {r.number for r in resolved.collect()} == {1, 2}
            final = plan(resolved).split("Initial Plan")[0]
            assert final.count("Key Citations") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_loose_matches_of_null_and_repeated_keys(spark):
    links = spark.createDataFrame([(1, 0, "a", "http://a%20"), (1, 1, "b", None), (None, 2, "c", "http://a"), (1, 0, "a", "http://a%20")], "report_id int, pos int, text string, url string")
    cited = spark.createDataFrame([(1, "http://a ", 5), (1, "http://a ", 3), (1, "http://a", 4), (1, None, 1), (None, "http://a", 2)], "report_id int, url string, number int")
    got = sorted((r.pos, r.number) for r in C.resolve_links(links, cited).collect())
    assert got == [(0, 3), (0, 3), (1, None), (2, None)]
