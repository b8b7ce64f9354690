"""WARC archives of pages, with a two-level capture index to read them back.

Writing. Pages are sorted by *reversed-host key* (``com,example,www)/path``) in ranges, one archive file per range. Every
record is a gzip member of its own, so a record can be read knowing its place only. The files are written and committed by
Spark's text sink, one row per record: the sink ends a row with a separator, and the last byte of a gzip member is 0 for
records under 16 MB (it is the top byte of the length), so a zero byte is the separator and the member is handed over
without it. Larger records are followed by an empty member, which ends so too. Of records with equal payloads of at least
``MIN_REVISIT`` bytes one is a response and the others are revisits of it, without payload.

Index. The archives are read once, member by member, for key, place and digest of each record. Lines sorted by key go into
compressed blocks, again gzip members of text files. A sparse directory has the first key of each block. Blocks grow with
the number of captures, so that the directory never has more than ``MAX_BLOCKS`` entries beside one per file, with keys
cut to 256 characters; this bound is what allows to hand it to every task.

Reading. A key is looked up by binary search in the directory, then in the block, then by a range read in the archive;
places next to each other are read at once. Requests are grouped by block, so a block is read once whatever the number
of its keys, and a key with very many captures is spread over its blocks. Archives and blocks are opened with pyarrow's
file systems (local or mounted folders, HDFS, S3, Google Cloud Storage).

Defined results: null html is an empty payload; a null url has the empty key and no target URI. White space and control
characters are escaped in URIs; in keys each becomes ``%20``, so urls that differ in these only share a key. Among equal
payloads the response is the row with the largest (page_id, url), null ids being smallest; rows equal in all three are
all responses. Payloads of any length are handled whole, in one task. An empty table gives archives without captures. Only
page_id, url and html are read, so other columns cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanmill.llm.common import slices, stored
from gleanmill.session import scratch_folder

MIN_REVISIT = 1000
DATE = "2024-01-01T00:00:00Z"
MIN_LINES = 1024  # captures to a block, at least
MAX_BLOCKS = 1 << 16
KEY_CHARS = 256  # of a key in the directory
READ_AT_ONCE = 8 << 20
CHUNK = 1 << 18

REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
_EMPTY_MEMBER = zlib.compress(b"", wbits=31)


def reversed_host_key(url: Column) -> Column:
    """``http://user@Www.Example.com:80/a?b#c`` as ``com,example,www:80)/a?b``; what has no scheme stays as it is."""
    shape = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)((?::[0-9]*)?)([^#]*)(?:#.*)?$"
    part = lambda k: F.regexp_extract(url, "(?s)" + shape, k)
    host = F.array_join(F.reverse(F.split(F.lower(part(1)), r"\.")), ",")
    key = F.when(url.rlike("(?s)" + shape), F.concat(host, part(2), F.lit(")"), part(3))).otherwise(url)
    return F.regexp_replace(F.coalesce(key, F.lit("")), r"[\x00-\x20\x7F]", "%20")


IDENTITY = ["key", "page_id", "url", "digest", "bytes"]


def captures(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """key, page_id, url, digest (hex SHA-1), bytes, payload of every page; and, with a null payload and first_id and
    first_url, a note for every page that revisits another.

    Notes are found from the narrow columns alone. They sort right before their page, so pages meet them in the one
    shuffle that orders the archives.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"),
    )
    rows = rows.select(
        reversed_host_key(F.col("url")).alias("key"), "page_id", "url", F.sha1("payload").alias("digest"),
        F.octet_length("payload").alias("bytes"), "payload")
    me = F.struct("page_id", "url")
    narrow = rows.select(*IDENTITY).where(F.col("bytes") >= min_revisit)
    firsts = narrow.groupBy("digest", "bytes").agg(F.max(me).alias("first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    notes = narrow.join(firsts, ["digest", "bytes"]).where(~me.eqNullSafe(F.col("first"))).select(
        *IDENTITY, F.lit(None).cast("string").alias("payload"), F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    return rows.unionByName(notes, allowMissingColumns=True)


def member(data: bytes) -> bytes:
    """One record compressed, without the zero byte that it ends with."""
    packed = zlib.compress(data, 6, wbits=31)
    packed += b"" if packed[-1] == 0 else _EMPTY_MEMBER
    return packed[:-1]


def _uri(url: str) -> str:
    return _UNSAFE.sub(lambda found: f"%{ord(found[0]):02X}", url)


def _record_id(page_id: int | None, url: str | None) -> str:
    made = hashlib.md5(json.dumps([page_id, url]).encode()).hexdigest()
    return f"<urn:uuid:{made[:8]}-{made[8:12]}-{made[12:16]}-{made[16:20]}-{made[20:]}>"


def record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = "".join(f"{name}: {value}\r\n" for name, value in fields if value is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def page_record(row: dict[str, Any], note: dict[str, Any] | None = None, date: str = DATE) -> bytes:
    """The response record of a row of :func:`captures`, or with its note the revisit record."""
    revisit = note is not None
    number = lambda value: None if value is None else str(value)
    digest = "sha1:" + base64.b32encode(bytes.fromhex(row["digest"])).decode()
    payload = b"" if revisit else row["payload"].encode()
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_id(row["page_id"], row["url"])),
        ("WARC-Date", date),
        ("WARC-Target-URI", None if row["url"] is None else _uri(row["url"])),
        ("WARC-Payload-Digest", digest),
        ("Content-Type", "application/http; msgtype=response"),
        ("Index-Key", row["key"]),
        ("Page-ID", number(row["page_id"])),
        ("Payload-Length", str(row["bytes"])),
    ]
    if revisit:
        fields += [
            ("WARC-Profile", REVISIT),
            ("WARC-Refers-To", _record_id(note["first_id"], note["first_url"])),
            ("WARC-Refers-To-Target-URI", None if note["first_url"] is None else _uri(note["first_url"])),
            ("Refers-To-Page-ID", number(note["first_id"])),
        ]
    return record(fields, HTTP_HEAD % row["bytes"] + payload)


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines)
    length = int(headers.get("Content-Length", -1))
    if not version.startswith("WARC/1.") or rest[length:] != b"\r\n\r\n":
        raise ValueError("damaged WARC record")
    return headers, rest[:length]


def opened(path: str):
    """A file of the shared folder, open for range reads."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def members(path: str) -> Iterator[tuple[int, int, bytes]]:
    """Place, length and content of every gzip member of a file, read in pieces."""
    with opened(path) as file:
        place, used, pending, reader, parts = 0, 0, b"", zlib.decompressobj(31), []
        while data := pending or file.read(CHUNK):
            parts.append(reader.decompress(data))
            pending = reader.unused_data
            used += len(data) - len(pending)
            if reader.eof:
                yield place, used, b"".join(parts)
                place, used, reader, parts = place + used, 0, zlib.decompressobj(31), []
        if used:
            raise ValueError(f"{path} ends inside a record")


def _write(rows: DataFrame, path: str) -> None:
    """The column ``member`` as files of gzip members."""
    rows.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """path and length of the files in a folder; their content is not read."""
    return spark.read.format("binaryFile").load(folder).select("path", "length").where("length > 0")


def _parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def write_archives(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT) -> None:
    """One archive file per range of keys, a warcinfo record first."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(None, "info")), ("WARC-Date", DATE),
                       ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
        opening, note = [member(info)], None
        for piece in (piece for batch in batches for piece in slices([batch])):
            made, opening = opening, []
            for row in piece.to_pylist():
                if row["payload"] is None:
                    note = row
                else:
                    mine = note is not None and all(note[c] == row[c] for c in IDENTITY)
                    made.append(member(page_record(row, note if mine else None)))
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["member"])

    spark = pages.sparkSession
    rows = captures(pages, min_revisit).repartitionByRange(_parts(spark), *IDENTITY)
    ordered = rows.sortWithinPartitions(*IDENTITY, F.col("payload").isNotNull())
    _write(ordered.mapInArrow(records, "member binary"), folder)


LINE_SCHEMA = "key string, path string, place long, line string"


def index_lines(spark: SparkSession, folder: str) -> DataFrame:
    """key, path, place, line of every capture in the archives of a folder; a line is key, date and a JSON object."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in LINE_SCHEMA.split(", ")]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[tuple] = []
                for place, length, data in members(path):
                    headers = parsed(data)[0] if data else {}
                    if headers.get("WARC-Type") in ("response", "revisit"):
                        entry = {"url": headers.get("WARC-Target-URI"), "mime": headers["WARC-Type"], "digest": headers["WARC-Payload-Digest"],
                                 "length": length, "offset": place, "filename": path}
                        rows.append((headers["Index-Key"], path, place, f"{headers['Index-Key']} {re.sub('[^0-9]', '', headers['WARC-Date'])} {json.dumps(entry)}"))
                    if len(rows) == MIN_LINES:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)

    return _files(spark, folder).mapInArrow(scan, LINE_SCHEMA)


def write_index(spark: SparkSession, archives: str, folder: str, min_lines: int = MIN_LINES, max_blocks: int = MAX_BLOCKS) -> None:
    """Sorted lines in compressed blocks."""
    lines = stored(index_lines(spark, archives), "warc-lines")
    ranged = lines.repartitionByRange(_parts(spark), "key", "path", "place").sortWithinPartitions("key", "path", "place")
    size = max(min_lines, -(-lines.count() // max_blocks))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([member("".join(f"{r}\n" for r in rows).encode())], pa.binary())], ["member"])
        for batch in batches:
            held += batch.column(0).to_pylist()
            while len(held) >= size:
                yield pack(held[:size])
                held = held[size:]
        if held:
            yield pack(held)

    _write(ranged.select("line").mapInArrow(blocks, "member binary"), folder)


class Directory(NamedTuple):
    """The first key of each block, cut, in order, and where the block lies."""

    keys: list[str]
    places: list[tuple[str, int, int]]

    def blocks(self, key: str) -> range:
        """The blocks that may hold ``key``."""
        cut = key[:KEY_CHARS]
        return range(max(0, bisect_left(self.keys, cut) - 1), bisect_right(self.keys, cut))


def directory(spark: SparkSession, folder: str) -> Directory:
    """The sparse directory of an index; its size is bounded, see the module's text."""

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for place, length, data in members(path):
                    if data:
                        key, last = (line.partition(b" ")[0].decode()[:KEY_CHARS] for line in (data, data[data.rfind(b"\n", 0, -1) + 1 :]))
                        yield pa.RecordBatch.from_pylist([{"key": key, "last": last, "path": path, "place": place, "length": length}])

    found = _files(spark, folder).mapInArrow(firsts, "key string, last string, path string, place long, length long").collect()
    # Blocks that share a cut key keep the order of their files, which are ranges.
    found.sort(key=lambda r: (r.key, r.last, r.path, r.place))
    return Directory([r.key for r in found], [(r.path, r.place, r.length) for r in found])


CAPTURE_SCHEMA = "key string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def _capture(data: bytes, with_payload: bool) -> tuple:
    headers, block = parsed(data)
    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    payload, size = None, int(headers["Payload-Length"])
    number = lambda name: int(headers[name]) if name in headers else None
    if headers["WARC-Type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        size = len(payload)
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"damaged payload of {headers['WARC-Record-ID']}")
    found = (headers["Index-Key"], number("Page-ID"), headers.get("WARC-Target-URI"), headers["WARC-Type"], size, digest, number("Refers-To-Page-ID"))
    return (*found, payload) if with_payload else found


def _stretches(entries: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, list[tuple[int, int]]]]:
    """Entries (path, place, length) in order, those next to each other together: path, where to begin, the places in it."""
    held: list[tuple[int, int]] = []
    for path, place, length in entries:
        if held and (path != current or place != held[-1][0] + held[-1][1] or place + length - held[0][0] > READ_AT_ONCE):
            yield current, held[0][0], [(p - held[0][0], n) for p, n in held]
            held = []
        current = path
        held.append((place, length))
    if held:
        yield current, held[0][0], [(p - held[0][0], n) for p, n in held]


def lookup(keys: DataFrame, index: Directory, with_payload: bool = False) -> DataFrame:
    """The captures of every key in ``keys`` (column key), read from the archives: key, page_id, url, record_type,
    payload_bytes, payload_digest, refers_to (and payload, null for revisits)."""
    spark = keys.sparkSession
    shared = spark.sparkContext.broadcast(index)
    schema = CAPTURE_SCHEMA + ", payload binary" * with_payload
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()][: len(names)]

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = [(block, key) for key in batch.column(0).to_pylist() for block in shared.value.blocks(key)]
            columns = zip(*wanted, strict=True) if wanted else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.string()), strict=True)], ["block", "key"])

    def entries(block: int, wanted: set[str]) -> list[tuple[str, int, int]]:
        path, place, length = shared.value.places[block]
        with opened(path) as file:
            text = zlib.decompress(file.read_at(length, place), wbits=31).decode()
        found = []
        for line in text.split("\n")[:-1]:
            key, _, entry = line.split(" ", 2)
            if key in wanted:
                values = json.loads(entry)
                found.append((values["filename"], values["offset"], values["length"]))
        return sorted(found)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, wanted in _by_block(batches):
            for path, begin, places in _stretches(entries(block, wanted)):
                with opened(path) as file:
                    data = file.read_at(sum(places[-1]), begin)
                rows = [_capture(zlib.decompress(data[p : p + n], wbits=31), with_payload) for p, n in places]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    located = keys.select(F.col("key").cast("string").alias("key")).where("key is not null").distinct().mapInArrow(locate, "block int, key string")
    return located.repartition("block").sortWithinPartitions("block", "key").mapInArrow(read, schema)


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, set[str]]]:
    """The keys of each block from rows (block, key) in order of block."""
    current, keys = None, set()
    for batch in batches:
        for block, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if block != current and keys:
                yield current, keys
                keys = set()
            current = block
            keys.add(key)
    if keys:
        yield current, keys


def archived(pages: DataFrame, folder: str | None = None, with_payload: bool = False) -> DataFrame:
    """Write archives and index of ``pages`` (to ``folder``, else to a scratch place) and look every page up in them."""
    spark = pages.sparkSession
    folder = folder or scratch_folder(spark, "warc")
    write_archives(pages, f"{folder}/archives")
    write_index(spark, f"{folder}/archives", f"{folder}/index")
    keys = pages.select(reversed_host_key(F.col("url").cast("string")).alias("key"))
    return lookup(keys, directory(spark, f"{folder}/index"), with_payload)
