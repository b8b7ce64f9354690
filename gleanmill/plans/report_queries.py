"""Report scoring queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanmill.functions import constants as K
from gleanmill.operators import plugins as U
from gleanmill.operators import reports as R
from gleanmill.plans.registry import Query
from gleanmill.plans.views import ctes, view

# SQL fragments -------------------------------------------------------------------------------

WORDS = (
    r"(len(list_filter(regexp_extract_all(body, '[\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[a-zA-Z]+')))"
    r" + len(regexp_extract_all(body, '[\x{4E00}-\x{9FFF}]')))"
)
CITES = r"len(regexp_extract_all(body, '\[[^\]]*\]\(https?://[^\s\)]+\)'))"
IMAGES = r"len(regexp_extract_all(body, '!\[[^\]]*\]\([^)]+\)'))"
SOURCES = (
    r"len(list_distinct(list_filter(list_transform(regexp_extract_all(body, 'https?://([^\s\)\]]+)', 1),"
    r" lambda u: replace(lower(regexp_extract(u, '^([^/?#]*)', 1)), 'www.', '')), lambda h: h <> '')))"
)


def _sections_sql() -> str:
    """One list of required names per style, and one of the names present, as SQL."""
    required = " ".join(
        f"when '{s}' then [{', '.join(repr(n) for n in names)}]" for s, names in K.STYLE_SECTIONS.items()
    )
    default = ", ".join(repr(n) for n in K.STYLE_SECTIONS["default"])
    present = ", ".join(
        [f"case when regexp_matches(body, '(?m){K.TITLE_PATTERN}') then 'title' end"]
        + [
            f"case when regexp_matches(lower(body), '{'|'.join(words)}') then '{name}' end"
            for name, words in K.SECTION_WORDS.items()
        ]
    )
    return (
        f"sections as (select *, case style {required} else [{default}] end as required,"
        f" list_filter([{present}], lambda n: n is not null) as present from measured),\n"
        "detected as (select *, list_filter(required, lambda n: list_contains(present, n)) as found,"
        " list_filter(required, lambda n: not list_contains(present, n)) as missing from sections)"
    )


def _length_sql() -> str:
    cases = " ".join(
        f"when '{s}' then case when words < {lo} then words / {lo}.0e0 * 8 when words <= {hi} then 10"
        f" else greatest(10 - (words / {hi}.0e0 - 1) * 5, 5) end"
        for s, (lo, hi) in K.WORD_TARGETS.items()
    )
    return f"cast(case style {cases} end as double)"


def _round(value: str) -> str:
    return f"cast(round(cast({value} as decimal(18, 8)), 2) as double)"


def _grade(value: str) -> str:
    return "case " + " ".join(f"when {value} >= {low} then '{g}'" for low, g in K.GRADES) + " else 'F' end"


METRICS = (
    ctes("v_reports")
    + f""",
measured as (select report_id, style, body, {WORDS} as words, {CITES} as cites, {SOURCES} as sources, {IMAGES} as images
             from v_reports),
{_sections_sql()},
covered as (select *, len(found) / cast(len(required) as double) as coverage, {_length_sql()} as len_score from detected),
scored as (select *, {_round('''coverage * 10 * 0.3e0 + least(cites / 10.0e0, 1) * 10 * 0.25e0 + len_score * 0.2e0
             + least(sources / 5.0e0, 1) * 10 * 0.15e0 + least(images / 3.0e0, 1) * 10 * 0.1e0''')} as metrics_score
           from covered)
"""
)


def _number(value: str) -> str:
    return f"regexp_replace(printf('%.2f', {value}), '0$', '')"


def _summary(score: str, extra: str = "") -> str:
    return f"""'Report Grade: ' || {_grade(score)} || ' (' || {_number(score)} || '/10)' || chr(10) || chr(10)
 || '**Automated Metrics:**' || chr(10) || '- Word Count: ' || words || chr(10) || '- Citations: ' || cites || chr(10)
 || '- Unique Sources: ' || sources || chr(10) || '- Images: ' || images || chr(10)
 || '- Section Coverage: ' || printf('%.0f', coverage * 100) || '%'
 || case when len(missing) > 0 then chr(10) || '- Missing Sections: ' || array_to_string(missing, ', ') else '' end{extra}"""


SCORE_OF = {
    c: f"try_cast(json_extract_string(answer, '$.scores.{c}') as double)" for c in K.CRITERIA
}
VERDICTS = """,
fenced as (select report_id, trim(case when contains(raw, '```json')
                  then split_part(split_part(raw, '```json', 2), '```', 1)
                  when contains(raw, '```') then split_part(raw, '```', 2) else raw end, chr(10) || ' ') as answer
           from v_verdicts),
answers as (select report_id, json_valid(answer) as ok, case when json_valid(answer) then answer end as answer
            from fenced),
verdicts as (select report_id, ok, """ + ",\n  ".join(
    f"case when ok then {SCORE_OF[c]} else 5 end as {c}" for c in K.CRITERIA
) + """,
  case when ok then coalesce(try_cast(json_extract_string(answer, '$.overall_score') as double), 5) else 5 end
    as overall_score,
  case when ok then from_json(json_extract(answer, '$.strengths'), '["VARCHAR"]')
       else ['Unable to parse evaluation'] end as strengths,
  case when ok then from_json(json_extract(answer, '$.weaknesses'), '["VARCHAR"]')
       else ['Evaluation parsing failed'] end as weaknesses,
  case when ok then from_json(json_extract(answer, '$.suggestions'), '["VARCHAR"]')
       else ['Please re-run evaluation'] end as suggestions
  from answers)"""
WEIGHTED = _round(
    "(" + " + ".join(f"coalesce({c} * {w}e0, 0)" for c, w in K.CRITERIA.items()) + ") / ("
    + " + ".join(f"case when {c} is not null then {w}e0 else 0 end" for c, w in K.CRITERIA.items()) + ")"
)
FINAL = (
    METRICS
    + VERDICTS.replace("from v_verdicts", f"from ({ctes('v_verdicts')} select * from v_verdicts)")
    + f""",
weighed as (select *, {WEIGHTED} as weighted from verdicts),
finals as (select s.*, v.* exclude (report_id, ok), v.report_id is not null as judged,
                  case when coalesce(v.overall_score, 0) > 0
                       then {_round('metrics_score * 0.4e0 + weighted * 0.6e0')} else metrics_score end as final_score
           from scored s left join weighed v on v.report_id = s.report_id)
"""
)
JUDGED = " || case when judged then chr(10) || chr(10) || '**LLM Evaluation:**'" + "".join(
    f" || coalesce(chr(10) || '- {c.replace('_', ' ').title()}: ' || cast({c} as bigint) || '/10', '')"
    for c in K.CRITERIA
) + "".join(
    f" || case when len({col}) > 0 then chr(10) || chr(10) || '**{title}:**' || chr(10)"
    f" || array_to_string(list_transform({col}[1:3], lambda s: '- ' || s), chr(10)) else '' end"
    for title, col in [("Strengths", "strengths"), ("Areas for Improvement", "weaknesses")]
) + " else '' end"

# Spark side ----------------------------------------------------------------------------------


def _reports(spark, sf):
    return view(spark, sf, "v_reports")


def _measure(name, column):
    def build(spark, sf):
        return _reports(spark, sf).select("report_id", column(F.col("body")).alias(name))

    return build


def _verdicts(spark, sf):
    return view(spark, sf, "v_verdicts").select("report_id", R.parse_verdicts(F.col("raw")).alias("verdict"))


def _joined(name):
    return F.array_join(name, ",").alias(name)


def _evaluated(spark, sf, verdicts=None):
    return R.evaluate_reports(_reports(spark, sf), verdicts)


def _flat(df):
    return df.select(
        "report_id", "style", "word_count", "citation_count", "unique_sources", "image_count",
        _joined("sections_found"), _joined("sections_missing"), "coverage", "metrics_score", "final_score", "grade",
        "summary",
    )


FLAT_SQL = f"""report_id, style, words as word_count, cites as citation_count, sources as unique_sources,
 images as image_count, array_to_string(found, ',') as sections_found, array_to_string(missing, ',') as sections_missing,
 coverage, metrics_score"""


def _parsed_verdicts(spark, sf):
    v = F.col("verdict")
    return _verdicts(spark, sf).select(
        "report_id",
        *[F.try_element_at(v["scores"], F.lit(c)).alias(c) for c in K.CRITERIA],
        v["overall_score"].alias("overall_score"),
        *[F.array_join(v[n], "|").alias(n) for n in ("strengths", "weaknesses", "suggestions")],
    )


def _length_judge(body: str) -> str:
    """Stands in for a model: every score follows from the length of the text it was given."""
    score = len(body) % 10 + 1
    scores = ", ".join(f'"{c}": {score}' for c in K.CRITERIA)
    return f'```json\n{{"scores": {{{scores}}}, "overall_score": {score}}}\n```'


def _judged(spark, sf):
    answers = U.judge_reports(_reports(spark, sf), _length_judge)
    verdict = R.parse_verdicts(F.col("raw"))
    return answers.select("report_id", R.weighted_verdict(verdict["scores"]).alias("weighted_score"))


def _strict_judge(body: str) -> str:
    """A model that refuses some texts."""
    if len(body) % 3 == 0:
        raise ValueError(f"refused {len(body)} characters")
    return _length_judge(body)


def _judge_failures(spark, sf):
    answers = U.judge_reports(_reports(spark, sf), _strict_judge)
    verdict = F.when(F.col("error").isNotNull(), U.failed_verdict(F.col("error")))
    return answers.select(
        "report_id", F.col("raw").isNull().alias("failed"), verdict["overall_score"].alias("overall_score"),
        F.get(verdict["weaknesses"], F.lit(0)).alias("weakness"))


QUERIES = {
    "judge_failures": Query(
        _judge_failures,
        ctes("v_reports") + " select report_id, length(body) % 3 = 0 as failed, case when length(body) % 3 = 0 then 0.0e0 end as overall_score,"
        " case when length(body) % 3 = 0 then 'Evaluation failed: refused ' || length(body) || ' characters' end as weakness from v_reports",
    ),
    "judge_reports": Query(
        _judged,
        ctes("v_reports") + f" select report_id, cast(length(body) % 10 + 1 as double) as weighted_score"
        " from v_reports",
    ),
    "evaluate_reports": Query(
        lambda spark, sf: _flat(_evaluated(spark, sf)),
        METRICS + f"select {FLAT_SQL}, metrics_score as final_score, {_grade('metrics_score')} as grade,"
        f" {_summary('metrics_score')} as summary from scored",
    ),
    "evaluate_reports_with_verdicts": Query(
        lambda spark, sf: _flat(_evaluated(spark, sf, _verdicts(spark, sf))),
        FINAL + f"select {FLAT_SQL}, final_score, {_grade('final_score')} as grade,"
        f" {_summary('final_score', JUDGED)} as summary from finals",
    ),
    "word_count": Query(
        _measure("word_count", R.word_count),
        ctes("v_reports") + f" select report_id, {WORDS} as word_count from v_reports",
    ),
    "citation_count": Query(
        _measure("citation_count", R.citation_count),
        ctes("v_reports") + f" select report_id, {CITES} as citation_count from v_reports",
    ),
    "unique_sources": Query(
        _measure("unique_sources", R.unique_sources),
        ctes("v_reports") + f" select report_id, {SOURCES} as unique_sources from v_reports",
    ),
    "image_count": Query(
        _measure("image_count", R.image_count),
        ctes("v_reports") + f" select report_id, {IMAGES} as image_count from v_reports",
    ),
    "detect_sections": Query(
        lambda spark, sf: R.detect_sections(_reports(spark, sf)).select(
            "report_id", _joined("sections_found"), _joined("sections_missing")
        ),
        METRICS + "select report_id, array_to_string(found, ',') as sections_found,"
        " array_to_string(missing, ',') as sections_missing from detected",
    ),
    "section_coverage": Query(
        lambda spark, sf: R.detect_sections(_reports(spark, sf)).select(
            "report_id",
            R.section_coverage(F.col("sections_found"), F.col("sections_missing")).alias("section_coverage"),
        ),
        METRICS + "select report_id, coverage as section_coverage from covered",
    ),
    "length_score": Query(
        lambda spark, sf: _reports(spark, sf).select(
            "report_id", F.round(R.length_score(R.word_count(F.col("body")), F.col("style")), 6).alias("length_score")
        ),
        METRICS + "select report_id, round(len_score, 6) as length_score from covered",
    ),
    "metrics_score": Query(
        lambda spark, sf: _evaluated(spark, sf).select("report_id", "metrics_score"),
        METRICS + "select report_id, metrics_score from scored",
    ),
    "grade": Query(
        lambda spark, sf: _evaluated(spark, sf).select("report_id", "grade"),
        METRICS + f"select report_id, {_grade('metrics_score')} as grade from scored",
    ),
    "parse_verdicts": Query(
        _parsed_verdicts,
        ctes("v_verdicts") + VERDICTS + " select report_id, " + ", ".join(K.CRITERIA) + ", overall_score, "
        + ", ".join(f"array_to_string({n}, '|') as {n}" for n in ("strengths", "weaknesses", "suggestions"))
        + " from verdicts",
    ),
    "weighted_verdict": Query(
        lambda spark, sf: _verdicts(spark, sf).select(
            "report_id", R.weighted_verdict(F.col("verdict")["scores"]).alias("weighted_score")
        ),
        ctes("v_verdicts") + VERDICTS + f" select report_id, {WEIGHTED} as weighted_score from verdicts",
    ),
    "final_score": Query(
        lambda spark, sf: _evaluated(spark, sf, _verdicts(spark, sf)).select("report_id", "final_score"),
        FINAL + "select report_id, final_score from finals",
    ),
    "summary_text": Query(
        lambda spark, sf: _evaluated(spark, sf, _verdicts(spark, sf)).select("report_id", "summary"),
        FINAL + f"select report_id, {_summary('final_score', JUDGED)} as summary from finals",
    ),
}
