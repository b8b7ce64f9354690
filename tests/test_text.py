from pyspark.sql import functions as F

from gleanmill.functions import text as tx


def test_url_domain(outcomes):
    cases = {
        "https://www.a.org/x": "www.a.org", "http://u:p@a.org:8080/x?y": "u:p@a.org:8080", "a.org": "a.org",
        "a.org:90/x": "a.org:90", "a.org?x": "a.org", "-bad-/x": "", "": "", None: "", "ftp://f.net#z": "f.net", "not a host": "",
    }
    assert outcomes(tx.url_domain, list(cases)) == list(cases.values())


def test_domains_lose_every_www(outcomes):
    got = outcomes(tx.domain_set, ["x https://www.A.org/p, (http://awww.b.org) https://a.org, http://c.org?q"])
    assert got == [["a.org", "ab.org", "a.org,", "c.org"]]


def test_url_match_key(outcomes):
    assert outcomes(tx.url_match_key, ["http://a/%C3%A9+b", " http://a/%zz ", "http://a/%ff"]) == [
        "http://a/é+b", "http://a/%zz", "http://a/%ff",
    ]


def test_clip_counts_characters(outcomes):
    assert outcomes(lambda c: tx.clip(c, 3, "..."), ["😀😀😀😀", "abc", None]) == ["😀😀😀...", "abc", None]


def test_smart_title_ladder(outcomes):
    texts = {
        "<TITLE lang='x'> Page </TITLE># H": "Page",
        "intro line here\n# Head one\n": "Head one",
        "x\n### Third level\n": "Third level",
        'short\ntitle: "Quoted name"\n': "Quoted name",
        "title: abc\nthe first long line": "the first long line",
        "```code fence line\n- list item here\n  A plain sentence. \n": "A plain sentence.",
        "short": "Untitled", "": "Untitled", None: "Untitled", "y" * 300: "y" * 200,
    }
    assert outcomes(tx.smart_title, list(texts)) == list(texts.values())


def test_log_safe(outcomes):
    assert outcomes(lambda c: tx.log_safe(c, 12), ["a\\b\nc\td", "\x1b[0m\x07", None, "0123456789abcdef"]) == [
        "a\\\\b\\nc\\td", "\\x1b[0m", "None", "012345678...",
    ]


def test_brackets_round_trip(outcomes):
    assert outcomes(tx.escape_brackets, ["[{}]", None]) == ["&#91;&#123;&#125;&#93;", ""]
    assert outcomes(lambda c: tx.unescape_brackets(tx.escape_brackets(c)), ["a[{}]b"]) == ["a[{}]b"]


def test_safe_filename(outcomes):
    names = {
        "../x/My report (1).pdf": "My_report_1_.pdf", "..": "unnamed_file", "/": "unnamed_file", "a//b/": "b",
        "é中.md": "é中.md", "a" * 300 + ".pdf": "a" * 196 + ".pdf", "b" * 300: "b" * 200,
    }
    assert outcomes(tx.safe_filename, list(names)) == list(names.values())
    assert outcomes(tx.upload_name, ["/a/b.pdf", "a/", ".."]) == ["b.pdf", "unnamed_file", "unnamed_file"]


def test_data_uri_and_controls(outcomes):
    assert outcomes(tx.strip_data_uri, ["a data:image/png;base64,QUJD= b"]) == ["a   b"]
    assert outcomes(tx.drop_controls, ["a\x00b\tc\n\x9f\r"]) == ["ab\tc\n\r"]


def test_is_html(outcomes):
    cases = {
        "<!-- c --> x": True, " <!doctype HTML>": True, "<?xml version='1'?><html>": True, "<P>": True, "<h7>": False,
        "text <b>bold</b>": False, "text <b class = 'x'>": True, "a <br/> b": True, "x < y": False, "": False, None: False,
    }
    assert outcomes(tx.is_html, list(cases)) == list(cases.values())


def test_is_pdf_url(outcomes):
    cases = {
        "http://a/b.PDF?x=1": True, "http://a/b.pdf#p": True, "http://a.pdf": False, "http://a/b?f=x.pdf": False,
        "b.pdf": True, "http://a/b.pdf;v=1": True, None: False,
    }
    assert outcomes(tx.is_pdf_url, list(cases)) == list(cases.values())


def test_tokens(outcomes):
    assert outcomes(tx.estimate_tokens, ["abcdefgh", "abc", "中文ab", "", None]) == [2, 0, 2, 0, 0]
    assert outcomes(lambda c: tx.message_tokens(F.lit("ai"), c), ["x" * 40, ""]) == [12, 1]
    assert outcomes(lambda c: tx.message_tokens(F.lit("tool"), c, F.lit("abcd"), F.lit(True)), ["x" * 40]) == [65]


def test_markdown_helpers(outcomes):
    assert outcomes(tx.close_trailing_link, ["see [a](http://b", "x ![alt", "[done](u) [open"]) == [
        "see [a](http://b)", "x ![alt]", "[done](u) [open]",
    ]
    assert outcomes(tx.math_for_display, [r"a \[x\] \(y\)", r"$p\\q$ $$r\\s$$"]) == ["a $$x$$ $$y$$", r"$p\q$ $$r\s$$"]
    assert outcomes(tx.math_for_editor, [r"\[x\] \(y\)"]) == ["$$x$$ $y$"]
    assert outcomes(tx.unescape_math, [r"\_a $x\_1 \* 2$"]) == [r"\_a $x_1 * 2$"]
    fenced = ["```markdown\nhead", "a\n```text\nb\n```\nc", "```python\nx\n```", "```\na\n```\n```\nb\n```"]
    assert outcomes(tx.drop_markdown_fences, fenced) == ["head", "a\nb\nc", "```python\nx\n```", "a\nb"]


def test_many_fences_take_few_passes(outcomes):
    """A text with thousands of code fences, which stay, is looked through once or twice, not once per fence."""
    import time

    text = "".join(f"```python\nx = {i}\n```\n" for i in range(4000))
    start = time.perf_counter()
    assert outcomes(tx.drop_markdown_fences, [text])[0] is not None
    assert time.perf_counter() - start < 30


def test_a_text_is_cleaned_once_per_row(spark):
    """No pass over a text is planned once for every use of its result."""
    df = spark.createDataFrame([("a",)], "body string")
    for clean, most in ((tx.markdown_clean, 4), (tx.math_for_display, 4), (tx.math_for_editor, 4)):
        plan = df.select(clean(F.col("body")))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("[([^") > 0 and plan.count(r"\\)\[([^") <= most


def test_cleaning_of_odd_texts(outcomes):
    texts = [None, "", "$", "\\", r"$a\\b$ \\(c\\)", "```\n", "x\n```text\n$a\\\\b$\n```", "```markdown\n```text\na\n```\n```", r"\[a\] $\\$"]
    assert outcomes(tx.markdown_clean, texts) == [None, "", "$", "\\", r"$a\b$ $$c$$", "", "x\n$a\\b$", "a", r"$$a$$ $\$"]
