"""Token counts, tokenizing, packing and token files."""

import random
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from gleanmill.llm import packing as P
from gleanmill.llm import token_counts as C
from gleanmill.llm import token_files as F
from gleanmill.llm.queries import BYTE_TOKENIZER, WORD_TOKENIZER
from gleanmill.llm.tokenizing import CACHE_PIECES, Encoder

TEXTS = [
    None, "", " ", "word", "It's John's, don't! we'LL 'S", "two  blanks   three    four", "tab\tand\n\nlines \n mixed \n\n x", " lead and trail ",
    "é É ﬁ é ß ŉ İ ΑΣ, Σ.   nbsp 　 wide", "12 3½ ² 1,000.50", "汉字 テスト 🙂🙂 👩‍👩‍👧", "<|endoftext|> inside <|endoftext|>", "a" * 3000,
    "many words " * 4000, "end. end, end; end: end! end?", "\x1c \x85 \x00", "x ,y . z",
]


@pytest.mark.parametrize(("path", "blank_kept"), [(BYTE_TOKENIZER, True), (WORD_TOKENIZER, False)])
def test_pieces_encode_like_whole_texts(path, blank_kept, monkeypatch):
    monkeypatch.setattr("gleanmill.llm.tokenizing.CACHE_PIECES", 3)
    encoder, whole = Encoder(path, blank_kept), Tokenizer.from_file(path)
    for text in TEXTS * 2:
        want = np.array(whole.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()
        assert encoder.encode([text]) == [want], text


@pytest.mark.parametrize(("path", "blank_kept"), [(BYTE_TOKENIZER, True), (WORD_TOKENIZER, False)])
def test_random_texts_encode_like_the_library(path, blank_kept):
    """Letters that change under lower-casing, marks, combining characters, blanks of all kinds and special tokens."""
    rng, encoder, whole = random.Random(1), Encoder(path, blank_kept), Tokenizer.from_file(path)
    parts = ["İ", "İ.", "ſİ?", "é", "e\u0301", "\u0301", "ß", "Σς", "12", ".", ",", "!?", "'s", "<|endoftext|>", "<", "\x00", " ", " ", " ", "  ", "\n", "\n\n", "\t", "\u00a0", "The", "word", "中文", "\U0001f600"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(6000)]
    for start in range(0, len(texts), 300):
        part = texts[start : start + 300]
        want = [np.array(e.ids, "<u4").tobytes() for e in whole.encode_batch(part, add_special_tokens=False)]
        assert encoder.encode(part) == want


@pytest.mark.parametrize(("path", "blank_kept"), [(BYTE_TOKENIZER, True), (WORD_TOKENIZER, False)])
def test_line_ends_and_runs_of_marks_encode_like_the_library(path, blank_kept):
    rng, encoder, whole = random.Random(2), Encoder(path, blank_kept), Tokenizer.from_file(path)
    texts = ["\n", "a\nb", "\na\n", "a.\nB!!\nc$$$", "a\n\nb", "a \nb\nc", "a\n b", "a\r\nb", "a\x1c\nb", "a\n's", "a'll!!\n9%.", "İ!!\nİ.", "\n\ud7ff\n"]
    parts = ["\n", "\n", " ", "word", "Word", "é", "9", "!!", "$$$", "%.", "'s", "'", "\u0301", "\t", "İ", "<|endoftext|>"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(4000)]
    want = [np.array(e.ids, "<u4").tobytes() for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode(texts) == want


def test_words_on_both_sides_of_a_line_end_are_remembered_alone():
    encoder = Encoder(WORD_TOKENIZER, False)
    encoder.encode(["one two.\nthree\none"])
    assert set(encoder.known) == {"one", "two", ".", "two.", "three"}


class Counting:
    """A tokenizer that counts the texts it gets; its merge model is not to be asked word by word."""

    def __init__(self, tokenizer):
        self.inner, self.texts = tokenizer, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.inner.encode_batch_fast(texts, **options)


def test_new_words_go_to_the_library_many_at_a_time_and_without_their_marks():
    rng, encoder, whole = random.Random(4), Encoder(BYTE_TOKENIZER, True), Tokenizer.from_file(BYTE_TOKENIZER)
    words = ["".join(rng.choices("aeinorst\u00e9", k=12)) for _ in range(2000)]
    texts = [" ".join(w + rng.choice([".", ",", "?!", ""]) for w in rng.choices(words, k=200)) for _ in range(100)]
    encoder.tokenizer = counting = Counting(encoder.tokenizer)
    encoder.model = None
    assert encoder.encode(texts) == [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert counting.texts < 60
    assert len(encoder.known) < 2000 + len(texts) + 10  # some words also begin a text
    counting.texts = 0
    encoder.encode(texts)
    assert counting.texts == 0


@pytest.mark.parametrize(("path", "blank_kept"), [(BYTE_TOKENIZER, True), (WORD_TOKENIZER, False)])
def test_texts_in_small_portions_encode_like_the_library(path, blank_kept, monkeypatch):
    """Marks inside of words, white space of all kinds, noncharacters; columns of either width, with nulls."""
    for name, size in (("PORTION", 40), ("BLOCK_PIECES", 3), ("RUN", 4)):
        monkeypatch.setattr(f"gleanmill.llm.tokenizing.{name}", size, raising=False)
    rng, encoder, whole = random.Random(5), Encoder(path, blank_kept), Tokenizer.from_file(path)
    parts = [" ", " ", " ", "\n", "\n", "  ", "\t", "\r", "\x1c", "\x85", "\u2028", "\u3000", "\uffff", "\u0120", "a.b,c", "Word.", "3.5%", "\u0130.", "\u0130", "\u00e9!", "\u03c3,", "\u4e2d.", "'s", "(x),", "\u0301", "\u00d7.", "<|endoftext|>"]
    texts = [None, "", " ", "\n", "\uffff", "\uffff a", *("".join(rng.choices(parts, k=rng.randrange(1, 14))) for _ in range(3000))]
    want = [np.array(e.ids, "<u4").tobytes() for e in whole.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert encoder.encode(texts) == want
    assert encoder.encode(pa.array(texts, pa.string()).slice(1)) == want[1:]
    assert encoder.encode(pa.array(texts, pa.large_string())) == want
    assert encoder.encode([]) == encoder.encode(pa.array([], pa.string())) == []


def test_what_a_worker_remembers_stays_below_a_quarter_of_a_gigabyte():
    rng, encoder = random.Random(3), Encoder(WORD_TOKENIZER, False)
    texts = [" ".join("".join(rng.choices("aeinorst", k=10)) for _ in range(500)) for _ in range(40)]
    encoder.encode(["some words first"])
    tracemalloc.start()
    encoder.encode(texts)
    taken, known = tracemalloc.get_traced_memory()[0], len(encoder.known)
    tracemalloc.stop()
    assert taken / known * CACHE_PIECES < 256e6


def ids_of(path, text, end):
    return [*Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture
def docs(spark):
    rows = [(5 * i % 17 + 3, t, i) for i, t in enumerate(TEXTS)] + [(3, "again", 0), (None, "no id", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(4)


# --- counting


def test_very_long_words_are_cut_and_synchronised():
    rng = random.Random(6)
    vocabulary = {bytes([b]) for b in range(256)} | {b"ab", b"abab", b"ababab", b"ba", b"aab", b"bbbb", b"abba" * 5, b"a" * 300}
    automaton = C.Automaton(vocabulary)

    def greedy(word):
        count = at = 0
        longest = max(map(len, vocabulary))
        while at < len(word):
            at += next(n for n in range(min(longest, len(word) - at), 0, -1) if word[at : at + n] in vocabulary)
            count += 1
        return count

    words = [bytes(rng.choice(b"ab") for _ in range(n)) for n in (1, C.LONG - 1, C.LONG, C.LONG + 1, 9_001, 20_000)]
    words += [b"a" * 12_345, b"ab" * 7_000, b"abba" * 4_001, (b"a" * 299 + b"b") * 40]
    assert automaton.counts(words).tolist() == [greedy(w) for w in words]


def test_a_word_of_a_megabyte_takes_about_a_second():
    rng = random.Random(7)
    automaton = C.Automaton(C.read_vocabulary(BYTE_TOKENIZER))
    word = bytes(rng.choice(b"abcdefghijklmnopqrstuvwxyz0123456789+/=") for _ in range(1 << 20))
    start = time.process_time()
    assert 1 << 18 < automaton.counts([word])[0] < 1 << 20
    assert time.process_time() - start < 10


def greedy(vocabulary, longest, word):
    n = at = 0
    while at < len(word):
        at += next(k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in vocabulary)
        n += 1
    return n


def test_counts_equal_greedy_longest_match(docs):
    vocabulary = set(C.read_vocabulary(BYTE_TOKENIZER))
    longest = max(map(len, vocabulary))
    want = sorted(str((r.doc_id, len(w), sum(greedy(vocabulary, longest, b" " + x) for x in w)))
                  for r in docs.collect() for w in [(r.text or "").encode().split()])
    assert sorted(str(tuple(r)) for r in C.count_tokens(docs, BYTE_TOKENIZER).collect()) == want
    assert C.count_tokens(docs.limit(0), BYTE_TOKENIZER).count() == 0


def test_automaton_on_a_vocabulary_that_backs_up():
    letters = [bytes([b]) for b in range(256)]
    vocabulary = [*letters, b"abcde", b"bcd", b"ab", b"cdx", b"dxxxx", b"xx"]
    automaton, known = C.Automaton(vocabulary), set(vocabulary)
    rng = np.random.default_rng(0)
    words = [bytes(rng.choice(list(b"abcdex"), n).tolist()) for n in rng.integers(1, 40, 500)]
    assert automaton.counts(words).tolist() == [greedy(known, 5, w) for w in words]
    assert automaton.counts([]).tolist() == []
    with pytest.raises(ValueError, match="single byte"):
        C.Automaton([b"a"])


# --- packing


def check_packing(rows, docs):
    """Every id once, sequences without gaps and of at most 2048, lengths with no padding."""
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for members in sequences.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and at & (at - 1) == 0
    wanted = {}
    for r in docs:
        wanted.setdefault(r.doc_id, []).append(ids_of(WORD_TOKENIZER, r.text, 1))
    assert set(pieces) == set(wanted)
    for doc, texts in wanted.items():
        got = Counter((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in pieces[doc])
        want = Counter()
        for ids in texts:
            start = 0
            for n in P.cuts(len(ids)):
                want[start, n, crc(ids[start : start + n]), len(ids)] += 1
                start += n
            assert start == len(ids)
        assert got == want
    return sequences


@pytest.mark.parametrize("groups", [1, 5])
def test_packing(docs, groups):
    rows = P.pack(P.pieces(docs, WORD_TOKENIZER), groups=groups).collect()
    check_packing(rows, docs.collect())


def test_packing_of_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    first = P.pack(P.pieces(docs, WORD_TOKENIZER)).collect()
    sequences = check_packing(first, docs.collect())
    assert sum(sum(r.length for r in m) == 2048 for m in sequences.values()) > 0.5 * len(sequences)
    assert sorted(first) == sorted(P.pack(P.pieces(docs.repartition(7), WORD_TOKENIZER)).collect())


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(1, "many words " * 900), (2, "few")], "doc_id long, text string")
    packed = P.pack(P.pieces(docs, WORD_TOKENIZER, with_ids=True), groups=1)
    got = b"".join(r.ids for r in P.sequences(packed).orderBy("sequence_id").collect())
    want = ids_of(WORD_TOKENIZER, "many words " * 900, 1) + ids_of(WORD_TOKENIZER, "few", 1)
    assert Counter(np.frombuffer(got, "<u4").tolist()) == Counter(want)
    assert all(r.n_tokens * 4 == len(r.ids) for r in P.sequences(packed).collect())
    assert P.pack(P.pieces(docs.limit(0), WORD_TOKENIZER)).count() == 0


def test_capacity_must_be_a_power_of_two(docs):
    with pytest.raises(ValueError, match="power of two"):
        P.pieces(docs, WORD_TOKENIZER, capacity=1000)


# --- files


@pytest.mark.parametrize("n", [1, 2, 4095, 4096, 4097, F.BLOCK - 1, F.BLOCK, F.BLOCK + 1, 3 * F.BLOCK + 77])
def test_frame_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.2, n) % 50_000).astype("<u4")
    payload = F.encode_frame(ids)
    assert np.array_equal(F.decode_frame(payload), ids)
    if n > F.BLOCK:
        assert np.array_equal(F.decode_frame(payload, range(1, 2)), ids[F.BLOCK : 2 * F.BLOCK])


def test_one_symbol_and_many_symbols():
    for ids in (np.zeros(5000, "<u4"), np.arange(200_000, dtype="<u4"), np.array([2**32 - 1, 0], "<u4")):
        assert np.array_equal(F.decode_frame(F.encode_frame(ids)), ids)


def test_coding_is_near_the_entropy():
    ids = np.random.default_rng(1).choice(16, 500_000, p=np.r_[0.7, np.full(15, 0.02)]).astype("<u4")
    share = np.bincount(ids) / len(ids)
    bits = -(share * np.log2(share)).sum()
    assert len(F.encode_frame(ids)) * 8 < 1.04 * bits * len(ids) + 2 * 64 * F.LANES


def test_damage_is_found():
    payload = bytearray(F.encode_frame(np.arange(50_000, dtype="<u4") % 300))
    payload[-40_000] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        F.decode_frame(bytes(payload))
    with pytest.raises(ValueError, match="not a frame"):
        F.decode_frame(b"something else")


def test_files_give_back_all_documents(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(F, "FRAME_TOKENS", 500)
    files = F.write_files(docs, BYTE_TOKENIZER, str(tmp_path / "tokens"))
    got = sorted(map(tuple, F.read_documents(files, with_ids=True).collect()), key=lambda r: r[1])
    rows = docs.collect()
    assert [r[0] for r in got] == sorted((r.doc_id for r in rows), key=lambda d: (d is not None, d or 0))
    at, want = 0, Counter((r.doc_id, tuple(ids_of(BYTE_TOKENIZER, r.text, 2))) for r in rows)
    for doc, start, n, checksum, ids in got:
        assert start == at and n * 4 == len(ids) and zlib.crc32(ids) == checksum
        want[doc, tuple(np.frombuffer(ids, "<u4").tolist())] -= 1
        at += n
    assert not +want and not -want


def test_files_of_an_empty_table(spark, docs, tmp_path):
    files = F.write_files(docs.limit(0), BYTE_TOKENIZER, str(tmp_path / "none"))
    assert F.read_documents(files).count() == 0


def test_tokenizer_files_are_outside_of_the_repository():
    assert public_tokenizers.path("x").startswith("/") and "/repo/" not in BYTE_TOKENIZER
