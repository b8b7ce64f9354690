"""Pages nested thousands of levels deep, or not readable, stay whole."""

import pytest

from gleanmill.operators import pages as P

DEEP = 5000


@pytest.mark.parametrize("tag", ["div", "span", "b", "ul"])
def test_deep_pages_are_read_whole(spark, tag):
    words = " ".join(f"word{i}" for i in range(300))
    html = f"<html><body><article><p>start</p>{f'<{tag}>' * DEEP}{words}{f'</{tag}>' * DEEP}<p>end</p></article></body></html>"
    row = P.extract_articles(spark.createDataFrame([(1, "http://a", html)], "page_id int, url string, html string")).first()
    assert row.status == "html" and row.content.count(f"<{tag}>") == DEEP
    assert row.markdown.startswith("start") and words in row.markdown and row.markdown.endswith("end")


def test_failed_and_other_pages_keep_their_whole_text(spark, monkeypatch):
    words = " ".join(f"word{i}" for i in range(300))
    df = spark.createDataFrame([(1, "http://a", words), (2, "http://a", f"<p>{words}")], "page_id int, url string, html string")

    @P.F.pandas_udf(P.ARTICLE)
    def failing(texts: P.pd.Series) -> P.pd.DataFrame:
        return P.pd.DataFrame([(None, None, None, None if t is None else "no") for t in texts], columns=["title", "content", "markdown", "error"])

    monkeypatch.setattr(P, "_read_articles", failing)
    whole = {r.page_id: r for r in P.extract_articles(df).collect()}
    assert [whole[i].status for i in (1, 2)] == ["not_html", "failed"] and all(words in r.content for r in whole.values())
    assert all(len(r.content) < 700 for r in P.extract_articles(df, size=500).collect())


def test_articles_leave_python_in_small_slices(spark):
    """A batch of any number of pages is read and given back a few pages at a time, in order, nulls included."""
    html = [None if i % 7 == 3 else f"<title>t{i}</title><p>text {i}" for i in range(3 * P.PAGES_AT_ONCE + 5)]
    taken = []

    def batches():
        for begin in (0, 60):
            taken.append(begin)
            yield P.pa.array(html[begin : begin + 60], P.pa.string())

    slices = P._read_articles.func(batches())
    first = next(slices)
    assert len(first) == P.PAGES_AT_ONCE and taken == [0]
    rows = first.to_pylist() + [r for s in slices for r in s.to_pylist()]
    assert [r["title"] for r in rows] == [None if h is None else f"t{i}" for i, h in enumerate(html)]
    df = spark.createDataFrame([(i, "http://a", h) for i, h in enumerate(html)], "page_id int, url string, html string").coalesce(1)
    got = {r.page_id: r.markdown for r in P.extract_articles(df).collect()}
    assert all(got[i] == f"text {i}" for i, h in enumerate(html) if h is not None) and len(got) == len(html)
