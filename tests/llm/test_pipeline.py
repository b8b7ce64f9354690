"""The pipeline stage by stage against plain versions, and the entry with and without the operators."""

import subprocess
import sys
from collections import Counter
from pathlib import Path

import corpus_pipeline
from test_line_removal import cleaned
from test_quality import plain as plain_quality
from test_simhash import plain_components, plain_fingerprint
from test_substring_dedup import plain as plain_substrings

ROOT = Path(__file__).resolve().parents[2]
SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_match_plain_versions(spark, tmp_path):
    docs, results = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        results.append([tuple(r) for r in docs.collect()])
        if k < 4:
            assert docs.columns == COLUMNS
    start = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    kept = sorted((r[0], cleaned(r[1]), *r[2:]) for r in start if plain_quality(r[1])[-1])
    assert sorted(results[0]) == kept and 0 < len(kept) < len(start)
    single = {d for d, _, c in plain_components([(r[0], plain_fingerprint(r[1])) for r in kept]) if d == c}
    assert sorted(results[1]) == [r for r in kept if r[0] in single]
    lost = {d: n for d, _, n, _ in plain_substrings([r[:2] for r in results[1]])}
    assert sum(lost.values()) > 0 and len(results[2]) == len(results[1])
    before = {r[0]: r for r in results[1]}
    for r in results[2]:
        assert len(r[1].split()) == len(before[r[0]][1].split()) - lost[r[0]] and r[2:] == before[r[0]][2:]
        assert lost[r[0]] or r == before[r[0]]
    copies = Counter(results[3])
    assert set(copies) <= set(results[2]) and max(copies.values()) <= 3
    words = lambda rows: sum(len(r[1].split()) for r in rows)
    assert abs(words(results[3]) - words(results[2])) < 0.2 * words(results[2])
    packed = Counter((r[0], r[1]) for r in results[4])
    assert sum(n for (d, s), n in packed.items() if s == 0) == len(results[3])


def test_run_returns_the_last_stage(spark):
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(corpus_pipeline.run(spark, SF).columns)


def test_entry_without_the_operators():
    code = """
import sys
sys.path.insert(0, %r)
sys.modules["gleanmill.llm"] = None
import __spark_entry__ as e
names = e.queries()
assert "evaluate_reports" in names and "pipeline" not in names and not any(n.startswith("op1_") for n in names)
assert set(e.oracle_sql()) <= set(names)
""" % str(ROOT)
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)


def test_entry_with_the_operators():
    import __spark_entry__ as entry

    assert {"pipeline", *(f"op{n}" for n in range(1, 14))} <= {n.split("_")[0] for n in entry.queries()}


def test_an_empty_table_goes_through(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.schema(docs.schema if k < 4 else "doc_id long").parquet(str(tmp_path / str(k)))
        assert docs.count() == 0
