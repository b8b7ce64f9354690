"""Archives: read by gzip alone, through the index, and against a plain version."""

import gzip
import hashlib
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gleanmill.llm import warc

SCHEMA = "page_id long, url string, html string, key string, digest int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)


def plain(rows):
    first = {}
    for p, u, t in rows:
        t = t or ""
        if len(t.encode()) >= 1000:
            first[t] = max(first.get(t, (False, -1, False, "")), (p is not None, p or 0, u is not None, u or ""))
    out = []
    for p, u, t in rows:
        t = t or ""
        big = first.get(t)
        revisit = big is not None and big != (p is not None, p or 0, u is not None, u or "")
        out.append((p, len(t.encode()), hashlib.sha1(t.encode()).hexdigest(), "revisit" if revisit else "response", (big[1] if big[0] else None) if revisit else None))
    return sorted(out, key=repr)


def got(df):
    found = df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    return sorted((tuple(r) for r in found), key=repr)


BIG = "<p>é</p>" * 200
ROWS = [
    (1, "http://www.Example.com/a?b=1#top", BIG), (2, "https://x.org/", BIG), (3, "https://x.org/", BIG), (4, None, "small"), (5, "http://x.org/", "small"),
    (6, "no scheme\r\nWARC-Type: revisit", ""), (7, "", None), (8, "https://ü.example.net/ä b", "\r\n\r\nWARC/1.1\r\n\r\n"), (None, "http://q.org", BIG),
    (9, "http://q.org", "z" * 999), (10, "http://q.org", "z" * 999), (11, "http://q.org", "z" * 1000), (11, "http://q.org", "z" * 1000), (12, "http://q.org", "z" * 1000 ),
    (None, "http://n.org", "n" * 1200), (None, None, "n" * 1200), (13, "http://" + "h" * 5000 + ".org/", "l"), (14, "http://long.org/" + "p" * 700 + "1", "l"), (15, "http://long.org/" + "p" * 700 + "2", "l"),
]


def test_every_page_comes_back(spark):
    assert got(warc.archived(pages(spark, ROWS))) == plain(ROWS)


def test_payloads_and_plain_gzip(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    found = {(r.page_id, r.url): r.payload for r in warc.archived(pages(spark, ROWS), folder, with_payload=True).where("record_type = 'response'").collect()}
    assert found[3, "https://x.org/"] == BIG.encode() and found[7, ""] == b"" and found[8, "https://ü.example.net/ä%20b"] == b"\r\n\r\nWARC/1.1\r\n\r\n"
    text = b"".join(gzip.decompress(p.read_bytes()) for p in sorted(Path(tmp_path, "w/archives").glob("part-*")))
    assert text.count(b"WARC-Type: response\r\n") + text.count(b"WARC-Type: revisit\r\n") == len(ROWS)
    assert text.count(b"\r\nWARC-Refers-To: ") == sum(r[3] == "revisit" for r in plain(ROWS))
    lines = b"".join(gzip.decompress(p.read_bytes()) for p in sorted(Path(tmp_path, "w/index").glob("part-*"))).decode().splitlines()
    keys = [line.split(" ")[0] for line in lines]
    assert len(lines) == len(ROWS) and keys == sorted(keys) and "com,example,www)/a?b=1" in keys


def test_hot_keys_many_blocks_and_unknown_keys(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, "http://hot.org/x" if i % 3 else f"http://h{rng.randrange(40)}.org/{i}", "t" * (i % 7)) for i in range(900)]
    folder = f"file://{tmp_path}/w"
    warc.write_archives(pages(spark, rows), f"{folder}/a")
    warc.write_index(spark, f"{folder}/a", f"{folder}/i", min_lines=16, max_blocks=30)
    index = warc.directory(spark, f"{folder}/i")
    assert 20 <= len(index.keys) <= 30 + 8 and index.keys == sorted(index.keys) and len(index.blocks("org,hot)/x")) > 5
    all_keys = spark.createDataFrame(rows, "p long, url string, t string").select(warc.reversed_host_key(F.col("url")).alias("key"))
    assert got(warc.lookup(all_keys, index)) == plain(rows)
    asked = spark.createDataFrame([("org,hot)/x",), ("nobody",), ("zz",), (None,), ("org,hot)/x",)], "key string")
    assert got(warc.lookup(asked, index)) == plain([r for r in rows if r[1] == "http://hot.org/x"])


def test_records_of_16_mb_and_damage(tmp_path):
    for size in (0, 10, (1 << 24) + 5):
        row = {"page_id": 1, "url": "u", "key": "u", "digest": hashlib.sha1(b"a" * size).hexdigest(), "bytes": size, "payload": "a" * size}
        packed = warc.member(warc.page_record(row)) + b"\0"
        path = tmp_path / f"{size}"
        path.write_bytes(packed * 2)
        found = [data for _, _, data in warc.members(f"file://{path}") if data]
        assert len(found) == 2 and warc._capture(found[1], True)[-1] == b"a" * size
        path.write_bytes(packed[:-9])
        with pytest.raises(ValueError):
            list(warc.members(f"file://{path}"))
    with pytest.raises(ValueError):
        warc.parsed(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n")


def test_empty_table(spark):
    assert warc.archived(pages(spark, ROWS).where("false")).collect() == []


def test_keys(outcomes):
    urls = ["http://me:pw@A.b.C:80/x/?q=/#f", "https://a.org", "ftp://a.org?x", "mailto:x", None, "", "http:///p", "//a.b/c", "http://a/b\tc"]
    assert outcomes(warc.reversed_host_key, urls) == ["c,b,a:80)/x/?q=/", "org,a)", "org,a)?x", "mailto:x", "", "", ")/p", "//a.b/c", "a)/b%20c"]
