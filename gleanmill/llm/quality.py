"""Line-first cleaning with column expressions only.

Every line is judged by itself; failing lines go, and a document that loses too much of its words goes as a whole.
A line fails if it is
  navigation   few words that mostly are menu words, or short entries between separators,
  boilerplate  a legal or browser notice,
  symbols      made of mark-up symbols to a tenth or more,
  repetition   ten words or more of which fewer than a third differ,
  duplicate    equal to an earlier line of the document,
  fragment     no closing punctuation and fewer than three words, inside a document of several lines.

Null text counts as empty. A document without words fails the base rules. Nothing is joined or shuffled, so rows with
equal ids, copies and ties are judged one by one.

A text of any length is judged whole, in one task. An empty table has an empty result. :func:`clean` keeps all columns under any
names; :func:`judged` adds columns and is meant for tables without columns of those names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanmill.llm.common import NOT_SPACE, packed, words

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
# A document that keeps less than this share of its words is rejected.
MIN_KEPT = 0.5

SYMBOLS = r"[#*$%&|<>]"
# Menu words and notices of the languages the corpus is in: English, German, French, Spanish. Any case.
MENU_LINE = (
    r"^[^\p{L}]*(?:(?:home|about|about us|contact|contact us|menu|login|log in|sign in|sign up|register|search|share|"
    r"tweet|next|previous|back|top|subscribe|sitemap|faq|help|print|comments?|read more|more|"
    r"startseite|über uns|kontakt|impressum|menü|anmelden|registrieren|suche|suchen|teilen|weiter|zurück|nach oben|"
    r"hilfe|drucken|kommentare?|weiterlesen|mehr lesen|mehr|"
    r"accueil|à propos|connexion|s'inscrire|recherche|rechercher|partager|suivant|précédent|retour|haut de page|"
    r"aide|imprimer|commentaires?|lire la suite|plan du site|"
    r"inicio|acerca de|sobre nosotros|contacto|menú|iniciar sesión|registrarse|buscar|compartir|siguiente|anterior|"
    r"volver|arriba|ayuda|imprimir|comentarios?|leer más|más|mapa del sitio)[^\p{L}]*)+$"
)
SEPARATED = r"(?:[^|»›·>]{1,25}[|»›·>]){3,}"
NOTICES = (
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "uses cookies",
    "enable javascript", "lorem ipsum", "click here to", "subscribe to our",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "verwendet cookies", "javascript aktivieren", "hier klicken",
    "tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "utilise des cookies", "activer javascript", "cliquez ici",
    "todos los derechos reservados", "política de privacidad", "condiciones de uso", "utiliza cookies", "habilitar javascript", "haga clic aquí",
)
CLOSED = r"[.!?…:;,\"'”’)\]。！？]\s*$"


def _count(text: Column, pattern: str) -> Column:
    return F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))


def _filled(line: Column) -> Column:
    return line.rlike(NOT_SPACE)


def has_separators(body: Column) -> Column:
    return F.contains(body, F.lit("|")) | F.contains(body, F.lit(">")) | F.contains(body, F.lit("»")) | F.contains(body, F.lit("›")) | F.contains(body, F.lit("·"))


def line_fails(line: Column, alone: Column, symbols: Column, separators: Column) -> Column:
    """Judge one line with words, given as (text, lower, words).

    ``alone`` is true if the document has no other line, ``symbols`` if it has any symbol, ``separators`` if any of those.
    """
    text, count = line["text"], F.size(line["words"])
    notice = F.lit(False)
    for phrase in NOTICES:
        notice = notice | F.contains(line["lower"], F.lit(phrase))
    length = F.char_length(text)
    return (
        ((count < 3) & ~alone & ~text.rlike(CLOSED))
        | ((count >= 10) & (3 * F.size(F.array_distinct(line["words"])) < count))
        | (symbols & (10 * _count(text, SYMBOLS) >= length))
        | (separators & has_separators(text) & text.rlike(SEPARATED))
        | notice
        | ((length <= 200) & text.rlike("(?iu)" + MENU_LINE))
    )


# Up to so many different windows that repeat, each window is looked up among them; beyond, all are sorted with their places.
FEW_REPEATS = 16


def _repeats(df: DataFrame) -> DataFrame:
    """Add ``_repeats``: the places of all three-word windows that occur twice or more in ``_words``, in order."""
    # 64-bit hashes stand for the three words of a window; they only meet hashes of the same text.
    size = F.greatest(F.size("_words") - 2, F.lit(0))
    windows = F.transform("_words", lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)))
    df = df.withColumn("_hash", F.slice(windows, F.lit(1), size)).withColumn("_sorted", F.sort_array("_hash"))
    df = df.withColumn("_twice", F.array_distinct(F.filter("_sorted", lambda h, k: h == F.get("_sorted", k + 1))))
    many = F.size("_twice") > FEW_REPEATS
    placed = F.sort_array(F.when(many, F.transform("_hash", lambda h, p: F.struct(h.alias("h"), p.alias("p")))))
    df = df.withColumn("_placed", placed)
    same = lambda a, b: F.coalesce(F.get("_placed", a)["h"] == F.get("_placed", b)["h"], F.lit(False))
    by_sort = F.sort_array(F.transform(F.filter("_placed", lambda w, k: same(k, k - 1) | same(k, k + 1)), lambda w: w["p"]))
    places = F.sequence(F.lit(0), F.size("_hash") - 1)
    by_lookup = F.filter(places, lambda p: F.array_contains("_twice", F.get("_hash", p)))
    found = F.when(F.size("_twice") == 0, F.array().cast("array<int>")).when(many, by_sort).otherwise(by_lookup)
    return df.withColumn("_repeats", found).drop("_hash", "_sorted", "_twice", "_placed")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the base measures of each text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    body = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumns({"_words": words(F.col(text)), "_lines": F.filter(F.split(body, "\n", -1), _filled)})
    df = _repeats(df)
    # A repeated window covers its three words; what the next repeated window covers too is counted there.
    covered = F.aggregate(
        F.transform("_repeats", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_repeats", k + 1) - p, F.lit(3)))),
        F.lit(0).cast("long"), lambda total, n: total + n,
    )
    return df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
        "n_symbols": _count(body, SYMBOLS).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": covered,
    }).drop("_words", "_repeats")


def _without_failing(body: Column, alone: Column, symbols: Column, separators: Column) -> Column:
    """``body`` without failing and repeated lines. Blank lines stay where they are.

    No line has a line break, so a number with one marks a blank line and keeps it apart from all others.
    """
    marked = F.transform(F.split(body, "\n", -1), lambda x, i: F.when(_filled(x), x).otherwise(F.concat(i.cast("string"), F.lit("\n"), x)))

    def stays(x: Column) -> Column:
        line = F.struct(x.alias("text"), F.lower(x).alias("lower"), words(x).alias("words"))
        return F.contains(x, F.lit("\n")) | ~line_fails(line, alone, symbols, separators)

    left = F.filter(F.array_distinct(marked), stays)
    return F.array_join(F.transform(left, lambda x: F.regexp_replace(x, r"^\d+\n", "")), "\n")


def judged(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS, min_kept: float = MIN_KEPT) -> DataFrame:
    """``docs`` with the measures, base_failed, n_kept_words, clean_text (the text without the lines that fail) and kept."""
    df = measured(docs, text)
    unique = F.transform(F.array_distinct("_lines"), lambda x: F.struct(x.alias("text"), F.lower(x).alias("lower"), words(x).alias("words")))
    df = df.withColumn("_unique", unique)
    body = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("_separators", has_separators(body))
    facts = (F.size("_lines") == 1, F.col("n_symbols") > 0, F.col("_separators"))
    df = df.withColumn("_kept", F.filter("_unique", lambda line: ~line_fails(line, *facts)))
    df = df.withColumn(
        "n_kept_words", F.aggregate("_kept", F.lit(0).cast("long"), lambda total, line: total + F.size(line["words"])))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    # Always true, but not deterministic for the optimizer: a filter on ``kept`` is then not pushed below the arrays, where
    # it would split the text again for every window.
    barrier = F.spark_partition_id() >= 0
    whole = F.size("_kept") == F.size("_lines")
    return df.withColumns({
        "base_failed": failed,
        "clean_text": F.when(whole, body).otherwise(_without_failing(body, *facts)),
        "kept": ~failed & (F.col("n_kept_words") >= min_kept * F.col("n_words")) & barrier,
    }).drop("_lines", "_unique", "_kept", "_separators")


def clean(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns; ``text`` is without its failing lines."""
    kept = judged(packed(docs, "text")).where("kept")
    return kept.select(*[F.col("clean_text" if name == "text" else f"row.c{i}").alias(name) for i, name in enumerate(docs.columns)])
