"""The registered queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanmill.llm import (
    fill_middle,
    language_id,
    merkle,
    mixing,
    multi_index,
    packing,
    quality,
    simhash,
    substring_dedup,
    token_counts,
    token_files,
    toxicity,
    warc,
)
from gleanmill.llm.common import fold, table
from gleanmill.llm.twins import FILL_MIDDLE_SQL, MERKLE_SQL, WARC_SQL

BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from the documents whose crc32(doc_id) mod 3 is not 1. A null id is never learned from and counts as held out."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(True)).alias("held_out"))
    return language_id.predict(docs, language_id.train(docs.where("not held_out")))


def op2_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), BYTE_TOKENIZER)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_multi_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_files(table(spark, sf_dir, "documents"), BYTE_TOKENIZER)
    return token_files.read_documents(files)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are read only where crc32(doc_id) mod 5 is not 0. A null id counts as held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(fold(F.col("doc_id"), 5) != 0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(True)).alias("held_out"))
    return toxicity.score(rows, model)


def op9_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), WORD_TOKENIZER))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tampered are the rows whose crc32(doc_id) 7 divides; a null id is left alone."""
    docs = table(spark, sf_dir, "documents")
    return merkle.verified(docs, altered=F.coalesce(fold(F.col("doc_id"), 7) == 0, F.lit(False)))


def op12_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id, op2_simhash_near_duplicates, op3_token_counts, op4_mix_sources, op5_quality_rules,
        op6_multi_index_search, op7_token_files, op8_toxicity, op9_harmonic_packing, op10_substring_dedup,
        op11_merkle_manifest, op12_warc_archives, op13_fill_in_middle,
    )
}


# Words of each text, with a row number for what belongs to one row.
_WORDS = r"""rows as (select row_number() over () as r, doc_id, coalesce(text, '') as body from documents),
w as (select *, list_filter(regexp_split_to_array(body, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from rows)"""


def _failing_line() -> str:
    """The line rules over t (text), low, w (words), n (words), alone, symbols."""
    quoted = lambda text: text.replace("'", "''")
    notices = " or ".join(f"contains(low, '{quoted(phrase)}')" for phrase in quality.NOTICES)
    closed = "regexp_matches(t, '" + quality.CLOSED.replace("'", "''") + "')"
    count = f"(length(t) - length(regexp_replace(t, '{quality.SYMBOLS}', '', 'g')))"
    return f"""(n < 3 and not alone and not {closed}) or (n >= 10 and 3 * len(list_distinct(w)) < n)
    or (symbols and 10 * {count} >= length(t))
    or regexp_matches(t, '{quality.SEPARATED}')
    or {notices} or (length(t) <= 200 and regexp_matches(t, '(?i){quoted(quality.MENU_LINE)}'))"""


QUALITY_SQL = f"""with {_WORDS},
measured as (select r, doc_id, body, words, len(words) as n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) as word_chars,
  length(body) - length(regexp_replace(body, '{quality.SYMBOLS}', '', 'g')) as n_symbols from w),
windows as (select r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as t from (select r, words, unnest(range(1, len(words) - 1)) as i from w)),
repeated as (select r, i from windows qualify count(*) over (partition by r, t) > 1),
covered as (select r, count(distinct i + k) as n_repeat_words from repeated, (select unnest(range(0, 3)) as k) group by r),
lines as (select r, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w, lower(t) as low
  from (select r, unnest(string_split(body, chr(10))) as t from rows)),
filled as (select *, len(w) as n, count(*) over (partition by r) = 1 as alone from lines where len(w) > 0),
counted as (select r, count(*) as all_lines, count(distinct t) as different from filled group by r),
uniques as (select distinct r, t, low, w, n, alone, n_symbols > 0 as symbols from filled join measured using (r)),
kept_lines as (select r, sum(n) as kept_words from uniques where not ({_failing_line()}) group by r),
judged as (select m.*, coalesce(all_lines - different, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(kept_words, 0) as kept_words
  from measured m left join counted using (r) left join covered using (r) left join kept_lines using (r))
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
  cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words,
  n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > {quality.MAX_REPEATED_PERCENT} * n_words as base_failed,
  not (n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > {quality.MAX_REPEATED_PERCENT} * n_words) and kept_words >= {quality.MIN_KEPT} * n_words as kept
from judged"""

SUBSTRING_SQL = f"""with {_WORDS},
windows as (select r, doc_id, i, array_to_string(words[i : i + 12], ' ') as t from (select r, doc_id, words, unnest(range(1, len(words) - 11)) as i from w)),
firsts as (select t, min(doc_id) as first from windows group by t),
gone as (select distinct r, i + k as p from windows join firsts using (t), (select unnest(range(0, 13)) as k) where first < doc_id),
lost as (select r, list(p) as places, count(*) as n_removed from gone group by r)
select doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(n_removed, 0) as bigint) as n_removed,
  sha256(array_to_string(case when n_removed is null then words else list_filter(words, lambda x, p: not list_contains(places, p)) end, ' ')) as kept_sha256
from w left join lost using (r)"""

ORACLE_SQL: dict[str, str] = {
    "op5_quality_rules": QUALITY_SQL, "op10_substring_dedup": SUBSTRING_SQL, "op11_merkle_manifest": MERKLE_SQL,
    "op12_warc_archives": WARC_SQL, "op13_fill_in_middle": FILL_MIDDLE_SQL,
}
