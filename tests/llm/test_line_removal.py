"""The quality stage takes failing lines out of the documents it keeps."""

import corpus_pipeline
from test_quality import BODY, fails, plain, split

SF = "/root/testdata/sf0.001"


def cleaned(text):
    """``text`` without failing and repeated lines, blank ones left in place."""
    lines, seen, out = text.split("\n"), set(), []
    alone = sum(bool(split(x)) for x in lines) == 1
    for x in lines:
        if not split(x):
            out.append(x)
        elif x not in seen and not fails(x, alone):
            out.append(x)
        seen.add(x)
    return "\n".join(out)


def test_failing_lines_go_and_clean_lines_stay(spark):
    other = "Another sentence that nobody minds and that closes well."
    rows = [
        (1, "Home | About | Contact\n" + BODY + "\n\n" + other + "\n" + other + "\nAll rights reserved by us.\n \n3\n", "x"),
        (2, BODY + "\n\n\n" + other + "\n", "y"),
        (3, BODY, "z"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in corpus_pipeline.quality_rules(spark, docs, SF).collect()}
    assert got[1].text == BODY + "\n\n" + other + "\n \n" and got[1].source == "x"
    assert tuple(got[2]) == rows[1] and tuple(got[3]) == rows[2]


def test_real_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted((r.doc_id, cleaned(r.text), r.n_chars) for r in docs.collect() if plain(r.text)[-1])
    got = corpus_pipeline.quality_rules(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text, r.n_chars) for r in got.collect()) == want
    before = {r.doc_id: r.text for r in docs.collect()}
    assert 0 < sum(before[d] != t for d, t, _ in want) < len(want)
