"""Column functions on URLs, titles, markdown and other text. All native, except where noted."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanmill.functions import constants as K


def strip(text: Column) -> Column:
    """Remove the same leading and trailing characters as Python's ``str.strip``."""
    return F.trim(text, F.lit(K.WHITESPACE))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(K.WHITESPACE))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, however often it is used; ``use`` holds no Python function."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def filled(text: Column) -> Column:
    """The text, or null if it is empty."""
    return F.nullif(text, F.lit(""))


def url_domain(url: Column) -> Column:
    """Network location of a URL, including user and port; bare host names are accepted too."""
    located = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1)
    bare = F.regexp_extract(url, K.BARE_HOST, 1)
    return F.coalesce(filled(located), filled(bare), F.lit(""))


def citation_id(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 12)


def domain_set(text: Column) -> Column:
    """Distinct hosts of all http(s) URLs in a text, lower-cased, with every ``www.`` removed."""

    def host(url: Column) -> Column:
        located = filled(F.regexp_extract(url, r"^([^/?#]*)", 1))
        return F.replace(F.lower(F.coalesce(located, F.split(url, "/")[0])), F.lit("www."), F.lit(""))

    hosts = F.transform(F.regexp_extract_all(text, F.lit(K.REPORT_URL), F.lit(1)), host)
    return F.array_distinct(F.filter(hosts, lambda h: (h != "") & ~h.contains("[")))


def url_match_key(url: Column) -> Column:
    """Percent-decoded, trimmed URL; a URL with a bad escape is only trimmed."""
    decoded = F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B")))
    broken = decoded.contains("\ufffd") & ~url.contains("\ufffd")
    return strip(F.when(broken, url).otherwise(F.coalesce(decoded, url)))


def clip(text: Column, size: int, suffix: str = "") -> Column:
    """First ``size`` characters; ``suffix`` is added only where something was cut."""
    if not suffix:
        return F.substring(text, 1, size)
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit(suffix))).otherwise(text)


def smart_title(content: Column, size: int = 200) -> Column:
    """Best title of an HTML page, a markdown text, a record or plain text."""

    def found(pattern: str) -> Column:
        return filled(strip(F.regexp_extract(content, pattern, 1)))

    field = found(r"""(?i)"?title"?\s*:\s*["']?([^"'\n]+)["']?""")
    lines = F.transform(F.split(content, "\n"), strip)
    skipped = r"^(?:```|---|\*\*\*|- |\* |\+ |#)"
    line = F.try_element_at(F.filter(lines, lambda x: (F.length(x) > 10) & ~x.rlike(skipped)), F.lit(1))
    title = F.coalesce(
        found(r"(?i)<title[^>]*>([^<]+)</title>"),
        found(r"(?dm)^#\s+(.+?)$"),
        found(r"(?dm)^#{2,6}\s+(.+?)$"),
        F.when(F.length(field) > 3, field),
        line,
        F.lit("Untitled"),
    )
    return F.substring(title, 1, size)


def drop_controls(text: Column) -> Column:
    """Remove C0/C1 control characters other than tab, line feed and carriage return."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B-\x0C\x0E-\x1F\x7F-\x9F]", "")


def log_safe(text: Column, size: int = 500) -> Column:
    """Text that cannot forge log lines: specials escaped, other controls dropped, length bounded."""
    safe = text
    for raw, shown in [
        ("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\x00", "\\0"), ("\x1b", "\\x1b"),
    ]:
        safe = F.replace(safe, F.lit(raw), F.lit(shown))
    safe = F.regexp_replace(safe, r"[\x00-\x08\x0b-\x0c\x0e-\x1f]", "")
    cut = F.concat(F.substring(safe, 1, size - 3), F.lit("..."))
    return F.coalesce(F.when(F.length(safe) > size, cut).otherwise(safe), F.lit("None"))


BRACKET_CODES = [("[", "&#91;"), ("]", "&#93;"), ("{", "&#123;"), ("}", "&#125;")]


def escape_brackets(text: Column) -> Column:
    escaped = F.coalesce(text, F.lit(""))
    for bracket, code in BRACKET_CODES:
        escaped = F.replace(escaped, F.lit(bracket), F.lit(code))
    return escaped


def unescape_brackets(text: Column) -> Column:
    plain = F.coalesce(text, F.lit(""))
    for bracket, code in BRACKET_CODES:
        plain = F.replace(plain, F.lit(code), F.lit(bracket))
    return plain


def safe_filename(name: Column, size: int = 200) -> Column:
    """File name fit for ids and URIs; a short extension survives the cut."""
    base = F.regexp_extract(name, r"([^/]*)/*$", 1)
    clean = F.regexp_replace(F.regexp_replace(base, r"[^\p{L}\p{N}_.\-]", "_"), "_+", "_")
    clean = F.coalesce(filled(F.trim(clean, F.lit("_."))), F.lit("unnamed_file"))
    ext = F.regexp_extract(clean, r"(\.[^.]*)$", 1)
    stem = F.regexp_replace(clean, r"\.[^.]*$", "")
    short = (F.length(ext) > 0) & (F.length(ext) <= 11)
    cut = F.when(short, F.concat(F.left(stem, F.lit(size) - F.length(ext)), ext)).otherwise(F.left(clean, F.lit(size)))
    return F.when(F.length(clean) > size, cut).otherwise(clean)


def upload_name(name: Column) -> Column:
    """Base name of an uploaded file, safe against path traversal."""
    base = strip(F.replace(F.regexp_extract(name, r"([^/]*)$", 1), F.lit("\x00"), F.lit("")))
    return F.when(base.isin("", ".", ".."), F.lit("unnamed_file")).otherwise(base)


def strip_data_uri(text: Column) -> Column:
    return F.regexp_replace(text, K.BASE64_IMAGE, " ")


def is_html(content: Column) -> Column:
    text = strip(F.coalesce(content, F.lit("")))
    starts = "(?i)^(?:" + "|".join(K.HTML_STARTS) + ")"
    hints = "(?i)(?:" + "|".join(K.HTML_HINTS) + ")"
    return (
        (text.startswith("<!--") & text.contains("-->"))
        | (text.startswith("<?xml") & text.contains("<html"))
        | text.rlike(starts)
        | (text.rlike("<[^>]+>") & text.rlike(hints))
    )


def is_pdf_url(url: Column) -> Column:
    """True if the path of the URL, without query, fragment and parameters, ends in .pdf."""
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.coalesce(F.lower(F.regexp_replace(path, r";[^/]*$", "")).endswith(".pdf"), F.lit(False))


def estimate_tokens(text: Column) -> Column:
    """ASCII characters // 4 plus all other characters; 0 for no text."""
    ascii_only = F.length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    tokens = F.floor(ascii_only / F.lit(4)) + F.length(text) - ascii_only
    return F.coalesce(tokens, F.lit(0)).cast("bigint")


def message_tokens(
    kind: Column, content: Column, extra: Column | None = None, has_tool_calls: Column | None = None
) -> Column:
    """Token estimate of a message of type system / human / ai / tool, never below 1."""
    base = estimate_tokens(content) + estimate_tokens(kind)
    factor = (
        F.when(kind == "system", F.lit(1.1)).when(kind == "ai", F.lit(1.2)).when(kind == "tool", F.lit(1.3))
        .otherwise(F.lit(1.0))
    )
    total = F.floor(base * factor).cast("bigint")
    if extra is not None:
        total = total + estimate_tokens(extra)
    if has_tool_calls is not None:
        total = total + F.when(has_tool_calls, F.lit(50)).otherwise(F.lit(0))
    return F.greatest(total, F.lit(1).cast("bigint"))


def close_trailing_link(markdown: Column) -> Column:
    """Close a link or image that was cut off at the end of the text."""
    text = F.regexp_replace(markdown, r"\[([^\]]*)\]\(([^)]*)\z", r"[$1]($2)")
    return F.regexp_replace(text, r"\[([^\]]*)\z", r"[$1]")


def _inside_math(pattern: str, replacement: str):
    """A column function that rewrites what lies inside of math spans and leaves the rest."""
    span, inner = re.compile(K.MATH_SPAN), re.compile(pattern)

    @F.pandas_udf(T.StringType())
    def rewrite(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: span.sub(lambda m: inner.sub(replacement, m[0]), t), na_action="ignore")

    return rewrite


_single_backslashes = _inside_math(r"\\\\", r"\\")
_plain_math = _inside_math(K.MATH_ESCAPED, r"\1")


def _where(needed: Callable[[Column], Column], udf, text: Column) -> Column:
    """Send only the texts that need it to Python."""
    return F.coalesce(udf(once(text, lambda t: F.when(needed(t), t))), text)


def _math(markdown: Column, inline: str) -> Column:
    def delimited(text: Column) -> Column:
        block = F.regexp_replace(text, K.MATH_BLOCK, r"\$\$$2\$\$")
        return F.when(text.contains("\\"), F.regexp_replace(block, K.MATH_INLINE, inline)).otherwise(text)

    return _where(lambda t: t.contains("$") & t.contains("\\\\"), _single_backslashes, once(markdown, delimited))


def math_for_display(markdown: Column) -> Column:
    return _math(markdown, r"\$\$$2\$\$")


def math_for_editor(markdown: Column) -> Column:
    return _math(markdown, r"\$$2\$")


def unescape_math(markdown: Column) -> Column:
    return _where(lambda t: t.contains("$") & t.contains("\\"), _plain_math, markdown)


def drop_markdown_fences(markdown: Column) -> Column:
    """Unwrap fenced blocks of markdown or plain text, nested ones too; an opening fence that nothing closes goes."""

    def unwrap(state: Column, _: Column) -> Column:
        unwrapped = F.regexp_replace(state["text"], rf"(?s){K.OPEN_FENCE}(.*?){K.CLOSE_FENCE}", "$1")
        looked = once(unwrapped, lambda t: F.struct(t.alias("text"), (t == state["text"]).alias("done")))
        return F.when(state["done"], state).otherwise(looked)

    def all_unwrapped(opened: Column) -> Column:
        # Every pass that changes something takes away two fences, so half their number of passes is enough; after a pass that
        # changes nothing the text is not looked at any more.
        passes = F.greatest(F.lit(1), F.regexp_count(opened, F.lit("```")) / 2).cast("int")
        start = F.struct(opened.alias("text"), F.lit(False).alias("done"))
        return F.aggregate(F.sequence(F.lit(1), passes), start, unwrap, lambda state: state["text"])

    def without(text: Column) -> Column:
        opened = F.regexp_replace(text, rf"(?s)\A{K.OPEN_FENCE}(?!.*{K.CLOSE_FENCE}\z)", "")
        return F.when(text.contains("```"), once(opened, all_unwrapped)).otherwise(text)

    return once(markdown, without)


def markdown_clean(markdown: Column) -> Column:
    """Markdown ready for display: math delimiters, stray fences, trailing links."""
    return close_trailing_link(drop_markdown_fences(math_for_display(markdown)))
