"""Quality rules against a plain version, row by row."""

import re
from collections import Counter

from gleanmill.llm import quality as Q

SPACE = " \t\n\x0b\x0c\r"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_kept_words", "kept"]


def split(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]


def plain(text):
    text = text or ""
    w = split(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen, covered = Counter(windows), set()
    for i, window in enumerate(windows):
        if seen[window] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if split(x)]
    unique = list(dict.fromkeys(lines))
    kept = [x for x in unique if not fails(x, len(lines) == 1)]
    failed = len(w) < Q.MIN_WORDS or 100 * len(covered) > 50 * len(w)
    n_kept = sum(len(split(x)) for x in kept)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(unique), len(covered), failed, n_kept,
            not failed and n_kept >= Q.MIN_KEPT * len(w))


def fails(line, alone):
    w = split(line)
    symbols = sum(c in "#*$%&|<>" for c in line)
    closed = re.search(Q.CLOSED.replace(r"\s", "[ \t\n\x0b\x0c\r]"), line)
    menu = re.search("(?i)" + Q.MENU_LINE.replace(r"[^\p{L}]", r"[\W\d_]"), line)
    return bool(
        (len(w) < 3 and not alone and not closed)
        or (len(w) >= 10 and 3 * len(set(w)) < len(w))
        or (symbols and 10 * symbols >= len(line))
        or re.search(Q.SEPARATED, line)
        or any(p in line.lower() for p in Q.NOTICES)
        or (len(line) <= 200 and menu))


BODY = " ".join(f"word{i} and" for i in range(40)) + "."
# Each with more words than a fragment has.
FAILING = [
    "Alpha › Beta › Gamma › Delta epsilon", "Alpha » Beta » Gamma » Delta epsilon", "eins · zwei · drei · vier fünf", "a > b > c > d e",
    "Startseite | KONTAKT - Über uns", "STARTSEITE ÜBER UNS KONTAKT", "Accueil, À PROPOS, s'inscrire", "Inicio MÁS Menú buscar",
    "© 2020 Alle Rechte vorbehalten, Verlag", "Tous droits réservés par nous", "Todos los derechos reservados aquí", "Lisez les conditions d'utilisation avant",
]
CLEAN = ["Er sagte: »Mehr kann ich nicht tun.« Dann ging er.", "El inicio fue más difícil que el final.", "Elle a dit « non » et puis « oui » enfin.", "If a > b then we go on."]
CASES = [
    None, "", " \n\t ", "one", "a b c", "a b c a b c a b c", "\n".join([BODY] * 3), BODY + "\nHome | About | Contact\n" + BODY.upper(),
    "x\n" + BODY, "Privacy Policy of all\n" + BODY, "### $$$ %%% |||\n" + BODY, " ".join(["same"] * 60), "alone\n", "Home",
    "\n".join(f"line {i}" for i in range(60)), " ".join(f"r{i % 7}" for i in range(200)), "é ü x " * 30, "tab\tsep\x0bvt\x0cff\rcr " * 20,
    " ".join(f"t{i}" for i in range(30_000)), " ".join(f"t{i % 5000}" for i in range(30_000)), "Share\nTweet\n" + BODY,
    *(line + "\n" + BODY for line in FAILING + CLEAN),
]


def test_all_cases_match_a_plain_version(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)] + [(3, "one"), (None, BODY)], "doc_id long, text string")
    got = {(r.doc_id, r.text): tuple(r[c] for c in MEASURES) for r in Q.judged(docs).collect()}
    want = {(r.doc_id, r.text): plain(r.text) for r in docs.collect()}
    assert got == want


def test_lines_of_four_languages(spark):
    assert all(fails(x, False) for x in FAILING) and not any(fails(x, False) for x in CLEAN)
    docs = spark.createDataFrame([(i, BODY + "\n" + x) for i, x in enumerate(FAILING + CLEAN)], "doc_id int, text string")
    got = {r.doc_id: r.text for r in Q.clean(docs).collect()}
    assert got == {i: BODY if x in FAILING else BODY + "\n" + x for i, x in enumerate(FAILING + CLEAN)}


def test_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for r in Q.judged(docs).collect():
        assert tuple(r[c] for c in MEASURES) == plain(r.text), r.doc_id


def test_no_python_and_no_shuffle(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = Q.clean(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Python" not in text and "Arrow" not in text


def test_clean_keeps_rows_whole_with_any_columns(spark):
    docs = spark.createDataFrame([(1, BODY, "x", 7), (2, "short", "y", 8), (1, BODY, "x", 7)], "doc_id long, text string, _words string, kept int")
    got = Q.clean(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == [(1, BODY, "x", 7)] * 2
    assert Q.clean(docs.limit(0)).count() == 0
