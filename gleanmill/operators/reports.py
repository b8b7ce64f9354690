"""Report quality: text metrics, scores, grades, judge verdicts and summaries.

Everything about one report is computed from its own row, so scoring a corpus is a narrow pass over
the text; only judge verdicts are joined in, on ``report_id``.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanmill.functions import constants as K
from gleanmill.functions import text as tx

# ASCII words with Unicode word boundaries, spelled out so that any Java version agrees.
ASCII_WORD = r"(?<![\p{L}\p{N}_])[a-zA-Z]++(?![\p{L}\p{N}_])"
CJK_CHAR = r"[\x{4E00}-\x{9FFF}]"

VERDICT = T.StructType(
    [
        T.StructField("scores", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("overall_score", T.DoubleType()),
        T.StructField("strengths", T.ArrayType(T.StringType())),
        T.StructField("weaknesses", T.ArrayType(T.StringType())),
        T.StructField("suggestions", T.ArrayType(T.StringType())),
    ]
)


def two_decimals(value: Column) -> Column:
    """Half-up rounding of the decimal value; the first rounding removes binary noise."""
    return F.round(F.round(value, 8), 2)


def word_count(text: Column) -> Column:
    return (F.regexp_count(text, F.lit(ASCII_WORD)) + F.regexp_count(text, F.lit(CJK_CHAR))).cast("bigint")


def citation_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(K.LINK_CITATION)).cast("bigint")


def image_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(K.MARKDOWN_IMAGE)).cast("bigint")


def unique_sources(text: Column) -> Column:
    return F.size(tx.domain_set(text)).cast("bigint")


def required_sections(style: Column) -> Column:
    """Array of the section names a report of this style needs; unknown styles use the default."""
    arrays = {s: F.array(*[F.lit(n) for n in names]) for s, names in K.STYLE_SECTIONS.items()}
    picked = reduce(
        lambda acc, s: acc.when(style == s, arrays[s]), [s for s in arrays if s != "default"],
        F.when(style == "default", arrays["default"]),
    )
    return picked.otherwise(arrays["default"])


def _mentions(lowered: Column, words: list[str]) -> Column:
    """Any of the patterns; plain words are searched as bytes, a regex runs only where its first word occurs."""

    def hit(word: str) -> Column:
        literal = re.match(r"[a-z\u4e00-\u9fff]+", word).group(0)
        found = lowered.contains(literal)
        return found if literal == word else found & lowered.rlike("(?d)" + word)

    return reduce(lambda a, b: a | b, [hit(w) for w in words])


def present_sections(text: Column, lowered: Column) -> Column:
    """Array of all section names that occur in the text, whatever the style."""
    hits = {"title": text.rlike("(?dm)" + K.TITLE_PATTERN)}
    hits |= {name: _mentions(lowered, words) for name, words in K.SECTION_WORDS.items()}
    return F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in hits.items()]))


def detect_sections(df: DataFrame, text: str = "body", style: str = "style") -> DataFrame:
    """Add ``sections_found`` and ``sections_missing``, both in the order the style lists them."""
    return (
        df.withColumn("_lowered", F.lower(text))
        .withColumn("_present", present_sections(F.col(text), F.col("_lowered")))
        .withColumn("_required", required_sections(F.col(style)))
        .withColumn("sections_found", F.filter("_required", lambda n: F.array_contains(F.col("_present"), n)))
        .withColumn("sections_missing", F.array_except("_required", "_present"))
        .drop("_lowered", "_present", "_required")
    )


def section_coverage(found: Column, missing: Column) -> Column:
    return F.size(found) / (F.size(found) + F.size(missing)).cast("double")


def length_score(words: Column, style: Column) -> Column:
    """10 inside the style's word range, falling to 0 below it and to 5 above it."""

    def score(low: int, high: int) -> Column:
        above = F.greatest(F.lit(10.0) - (words / F.lit(float(high)) - F.lit(1.0)) * F.lit(5.0), F.lit(5.0))
        return (
            F.when(words < low, words / F.lit(float(low)) * F.lit(8.0)).when(words <= high, F.lit(10.0)).otherwise(above)
        )

    named = [s for s in K.WORD_TARGETS if s != "default"]
    picked = reduce(
        lambda acc, s: acc.when(style == s, score(*K.WORD_TARGETS[s])),
        named[1:],
        F.when(style == named[0], score(*K.WORD_TARGETS[named[0]])),
    )
    return picked.otherwise(score(*K.WORD_TARGETS["default"]))


def metrics_score(coverage: Column, citations: Column, length: Column, sources: Column, images: Column) -> Column:
    """Weighted 0-10 score of the text metrics, rounded half up to two decimals."""

    def share(value: Column, full: int) -> Column:
        return F.least(value / F.lit(float(full)), F.lit(1.0)) * F.lit(10.0)

    total = (
        coverage * F.lit(10.0) * F.lit(0.30)
        + share(citations, 10) * F.lit(0.25)
        + length * F.lit(0.20)
        + share(sources, 5) * F.lit(0.15)
        + share(images, 3) * F.lit(0.10)
    )
    return two_decimals(total)


def grade(score: Column) -> Column:
    first, *rest = K.GRADES
    return reduce(
        lambda acc, g: acc.when(score >= g[0], F.lit(g[1])), rest, F.when(score >= first[0], F.lit(first[1]))
    ).otherwise(F.lit("F"))


def parse_verdicts(raw: Column) -> Column:
    """Judge answer (plain or fenced JSON) to a verdict struct; the neutral verdict if it is no JSON."""
    fenced = (
        F.when(raw.contains("```json"), F.split_part(F.split_part(raw, F.lit("```json"), F.lit(2)), F.lit("```"), F.lit(1)))
        .when(raw.contains("```"), F.split_part(raw, F.lit("```"), F.lit(2)))
        .otherwise(raw)
    )
    body = tx.strip(fenced)
    neutral = F.struct(
        F.create_map(*[x for c in K.CRITERIA for x in (F.lit(c), F.lit(5.0))]).alias("scores"),
        F.lit(5.0).alias("overall_score"),
        *[F.array(F.lit(t)).alias(n) for n, t in K.VERDICT_FALLBACK_TEXTS.items()],
    )
    parsed = F.from_json(body, VERDICT)
    read = F.struct(
        F.coalesce(parsed["scores"], F.create_map().cast("map<string,double>")).alias("scores"),
        F.coalesce(parsed["overall_score"], F.lit(5.0)).alias("overall_score"),
        *[
            F.coalesce(parsed[n], F.array().cast("array<string>")).alias(n)
            for n in ("strengths", "weaknesses", "suggestions")
        ],
    )
    return F.when(F.try_parse_json(body).isNull(), neutral).otherwise(read)


def weighted_verdict(scores: Column) -> Column:
    """Weighted mean of the known criteria present, two decimals; 0 if there is none."""
    zero = F.lit(0.0)
    parts = [(F.try_element_at(scores, F.lit(c)), F.lit(w)) for c, w in K.CRITERIA.items()]
    total = reduce(lambda a, p: a + F.coalesce(p[0] * p[1], zero), parts, zero)
    weight = reduce(lambda a, p: a + F.when(p[0].isNotNull(), p[1]).otherwise(zero), parts, zero)
    return F.coalesce(two_decimals(F.try_divide(total, weight)), zero)


def final_score(metrics: Column, overall: Column, weighted: Column) -> Column:
    """40 % metrics and 60 % verdict where a verdict with a positive overall score exists."""
    mixed = two_decimals(metrics * F.lit(0.4) + weighted * F.lit(0.6))
    return F.when(F.coalesce(overall, F.lit(0.0)) > 0, mixed).otherwise(metrics)


def _number(value: Column) -> Column:
    """A score as text, at least one decimal, as in ``7.0`` or ``7.25``."""
    return F.regexp_replace(F.format_string("%.2f", value), r"0$", "")


def _score_text(score: Column) -> Column:
    """A score as given; whole scores without a fraction."""
    whole = score == F.floor(score)
    return F.when(whole, score.cast("bigint").cast("string")).otherwise(score.cast("string"))


def summary_text(score: Column, letter: Column, row: dict[str, Column], verdict: Column | None = None) -> Column:
    """The fixed-layout markdown summary of one evaluation."""
    lines = [
        F.concat(F.lit("Report Grade: "), letter, F.lit(" ("), _number(score), F.lit("/10)\n")),
        F.lit("**Automated Metrics:**"),
        F.concat(F.lit("- Word Count: "), row["word_count"]),
        F.concat(F.lit("- Citations: "), row["citation_count"]),
        F.concat(F.lit("- Unique Sources: "), row["unique_sources"]),
        F.concat(F.lit("- Images: "), row["image_count"]),
        F.concat(F.lit("- Section Coverage: "), F.format_string("%.0f", row["coverage"] * 100), F.lit("%")),
        F.when(
            F.size(row["missing"]) > 0, F.concat(F.lit("- Missing Sections: "), F.array_join(row["missing"], ", "))
        ),
    ]
    if verdict is not None:
        scores = F.array(
            *[
                F.when(
                    F.try_element_at(verdict["scores"], F.lit(c)).isNotNull(),
                    F.concat(
                        F.lit(f"- {c.replace('_', ' ').title()}: "),
                        _score_text(F.try_element_at(verdict["scores"], F.lit(c))),
                        F.lit("/10"),
                    ),
                )
                for c in K.CRITERIA
            ]
        )
        # A judge may score more than the known criteria; those follow in its order.
        more = F.filter(F.map_entries(verdict["scores"]), lambda e: ~e["key"].isin(*K.CRITERIA) & e["value"].isNotNull())
        named = F.transform(more, lambda e: F.concat(F.lit("- "), F.initcap(F.replace(e["key"], F.lit("_"), F.lit(" "))), F.lit(": "), _score_text(e["value"]), F.lit("/10")))
        scores = F.concat(scores, F.coalesce(named, F.array().cast("array<string>")))

        def bullets(title: str, items: Column) -> Column:
            shown = F.transform(F.slice(items, 1, 3), lambda s: F.concat(F.lit("- "), s))
            return F.when(F.size(items) > 0, F.concat(F.lit(f"\n**{title}:**\n"), F.array_join(shown, "\n")))

        lines += [
            F.when(
                verdict.isNotNull(),
                F.concat_ws("\n", F.lit("\n**LLM Evaluation:**"), F.filter(scores, lambda s: s.isNotNull())),
            ),
            bullets("Strengths", verdict["strengths"]),
            bullets("Areas for Improvement", verdict["weaknesses"]),
        ]
    return F.concat_ws("\n", *lines)


def evaluate_reports(reports: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Score a corpus of ``(report_id, style, body)`` in one pass over the text.

    ``verdicts`` holds at most one ``(report_id, verdict)`` per report, as parse_verdicts gives it.
    """
    body = F.col("body")
    measured = detect_sections(reports).select(
        "report_id",
        "style",
        word_count(body).alias("word_count"),
        citation_count(body).alias("citation_count"),
        unique_sources(body).alias("unique_sources"),
        image_count(body).alias("image_count"),
        "sections_found",
        "sections_missing",
    )
    scored = measured.withColumn(
        "coverage", section_coverage(F.col("sections_found"), F.col("sections_missing"))
    ).withColumn(
        "metrics_score",
        metrics_score(
            F.col("coverage"),
            F.col("citation_count"),
            length_score(F.col("word_count"), F.col("style")),
            F.col("unique_sources"),
            F.col("image_count"),
        ),
    )
    if verdicts is None:
        joined, verdict = scored.withColumn("final_score", F.col("metrics_score")), None
    else:
        verdict = F.col("verdict")
        joined = scored.join(verdicts, "report_id", "left").withColumn(
            "final_score",
            final_score(F.col("metrics_score"), verdict["overall_score"], weighted_verdict(verdict["scores"])),
        )
    row = {
        "word_count": F.col("word_count"),
        "citation_count": F.col("citation_count"),
        "unique_sources": F.col("unique_sources"),
        "image_count": F.col("image_count"),
        "coverage": F.col("coverage"),
        "missing": F.col("sections_missing"),
    }
    graded = joined.withColumn("grade", grade(F.col("final_score")))
    return graded.withColumn("summary", summary_text(F.col("final_score"), F.col("grade"), row, verdict)).drop("verdict")
