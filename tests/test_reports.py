import pytest
from pyspark.sql import functions as F

from gleanmill.functions import constants as K
from gleanmill.operators import plugins as U
from gleanmill.operators import reports as R


def test_word_count(outcomes):
    cases = {"Hello world": 2, "你好 world": 3, "café été x1 a_b it's": 2, "": 0, "naïve A": 1}
    assert outcomes(R.word_count, list(cases)) == list(cases.values())


def test_counts(outcomes):
    text = "[a](http://x.org/1) ![i](http://x.org/2) [b](/local) ![](u) www https://www.y.org"
    assert outcomes(R.citation_count, [text]) == [2]
    assert outcomes(R.image_count, [text]) == [2]
    assert outcomes(R.unique_sources, [text]) == [2]


def test_sections_of_the_style(spark):
    body = "# T\n## Key  Points\n投资建议 technology KEY CITATIONS detailedanalysis"
    df = spark.createDataFrame([(1, "strategic_investment", body), (2, "odd", "#\nnext line"), (3, "social_media", "概述")],
                               "report_id int, style string, body string")
    got = {r.report_id: r for r in R.detect_sections(df).collect()}
    assert got[1].sections_found == [
        "title", "key_points", "detailed_analysis", "executive_summary", "technology_analysis", "investment_recommendations",
        "key_citations",
    ]
    assert got[1].sections_missing == ["overview", "market_analysis"]
    assert got[2].sections_found == ["title"] and len(got[2].sections_missing) == 4
    assert got[3].sections_found == ["overview"] and got[3].sections_missing == ["title", "key_points", "key_citations"]


@pytest.mark.parametrize("words, style, want", [(1000, "default", 10), (500, "default", 4), (10000, "default", 5), (2400, "news", 9), (5, "odd", 0.04)])
def test_length_score(outcomes, words, style, want):
    assert outcomes(lambda c: R.length_score(c, F.lit(style)), [words], "bigint") == [pytest.approx(want)]


def test_grades(outcomes):
    scores = [low for low, _ in K.GRADES]
    assert outcomes(R.grade, [*scores, 3.99], "double") == [*[g for _, g in K.GRADES], "F"]


def test_verdicts(outcomes):
    good = '{"scores": {"coherence": 8, "unknown": 1}, "overall_score": 7, "strengths": ["a"]}'
    got = outcomes(R.parse_verdicts, [good, f"x\n```json\n{good}\n```", f"```{good}```", "broken {", "{}"])
    assert got[0] == got[1] == got[2]
    assert (got[0].scores["coherence"], got[0].overall_score, got[0].strengths, got[0].weaknesses) == (8, 7, ["a"], [])
    assert set(got[3].scores.values()) == {5.0} and got[3].suggestions == ["Please re-run evaluation"]
    assert (got[4].scores, got[4].overall_score) == ({}, 5.0)


def test_weighted_and_final(outcomes):
    weighted = outcomes(R.weighted_verdict, [{"coherence": 8.0, "relevance": 4.0}, {"x": 9.0}, None], "map<string,double>")
    assert weighted == [6.29, 0.0, 0.0]
    final = outcomes(lambda c: R.final_score(F.lit(5.0), c, F.lit(8.0)), [7.0, 0.0, None], "double")
    assert final == [6.8, 5.0, 5.0]


def test_criteria_of_a_judge_beyond_the_known_ones(spark):
    scores = "map('my_own', 3.5D, 'coherence', 7D, 'x', 2D)"
    row = spark.sql(f"select named_struct('scores', {scores}, 'strengths', array('s'), 'weaknesses', array()) as v, 1 as n")
    row = row.select(R.summary_text(F.lit(7.0), F.lit("B"), {
        **{c: F.col("n") for c in ("word_count", "citation_count", "unique_sources", "image_count")}, "coverage": F.lit(0.5), "missing": F.array()}, F.col("v")).alias("s"))
    assert "- Coherence: 7/10\n- My Own: 3.5/10\n- X: 2/10\n" in row.first().s


def test_summary_and_failed_judge(spark):
    df = spark.createDataFrame([(1, "default", "plain words"), (2, "default", "# T\n boom")], "report_id int, style string, body string")

    def judge(body):
        if "boom" in body:
            raise RuntimeError("no answer")
        return '{"scores": {"writing_quality": 9}, "overall_score": 9, "strengths": ["s1", "s2", "s3", "s4"]}'

    raw = U.judge_reports(df, judge)
    verdicts = raw.select(
        "report_id",
        F.when(F.col("error").isNull(), R.parse_verdicts(F.col("raw"))).otherwise(U.failed_verdict(F.col("error"))).alias("verdict"),
    )
    got = {r.report_id: r for r in R.evaluate_reports(df, verdicts).collect()}
    assert got[1].final_score == pytest.approx(0.4 * got[1].metrics_score + 0.6 * 9, abs=0.006)
    assert "- Writing Quality: 9/10" in got[1].summary and "- s3" in got[1].summary and "- s4" not in got[1].summary
    assert got[1].summary.startswith(f"Report Grade: {got[1].grade} (")
    assert got[2].final_score == got[2].metrics_score and "Evaluation failed: no answer" in got[2].summary


def test_judge_reads_the_whole_text_unless_bounded(spark):
    df = spark.createDataFrame([(1, "x" * 20000)], "report_id int, body string")
    assert U.judge_reports(df, lambda body: str(len(body))).first().raw == "20000"
    assert U.judge_reports(df, lambda body: str(len(body)), size=15000).first().raw == "15000"


def test_summary_keeps_fractions_of_scores(spark):
    scores = R._score_text(F.col("s"))
    rows = spark.createDataFrame([(7.0,), (7.5,), (None,)], "s double").select(scores.alias("t")).collect()
    assert [r.t for r in rows] == ["7", "7.5", None]
