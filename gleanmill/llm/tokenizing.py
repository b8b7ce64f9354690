"""Token ids of whole texts through a tokenizer file, with the words of a task remembered.

Byte-pair merges never cross the boundary before a single blank, so a text is split there and every piece is encoded by
the tokenizers library once and looked up afterwards. The same holds at the end of a line that no other white space touches.
Arrow splits the texts of a batch and numbers their different pieces, so that each of them is looked up once per batch; numpy
puts the ids together.
Punctuation marks after a letter or digit begin a token. If blanks are kept, marks after Latin letters and digits are pieces of
their own; other pieces that end in marks are learned in two halves.
If blanks are kept, new pieces go to the library many in a text, and its tokens tell where each begins; else words of plain
Latin letters go to its merge model directly, as its pattern would pass them on whole. Texts with runs of white space that could
span such a boundary are split by the pattern instead, or encoded whole. What a Python worker has learned serves all its tasks.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gleanmill.llm.token_counts import byte_alphabet

# Distinct pieces a worker remembers, some 220 MB. The half in use longest ago is let go.
CACHE_PIECES = 1_000_000
# Bytes of text that are split at once, unless a single text has more, and pieces whose ids are put together at once.
PORTION = 4 << 20
BLOCK_PIECES = 1 << 18
# New pieces that the library gets in one text.
RUN = 100
_BLANK_RUN = re.compile(r"\s \s")
# Marks a piece without a blank before it, where the blank belongs to the word. Texts that hold this noncharacter are encoded whole.
_BARE = "\uffff"
_BEFORE_WORD = re.compile(r"(?= \S)")
# What \s stands for in Python, for Arrow's patterns.
_SPACE = "[" + "".join(c for c in map(chr, range(sys.maxunicode)) if c.isspace()) + "]"
_MARKS = ".,;:!?#$%&*"
_LATIN_BEFORE_MARKS = "([0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f])([.,;:!?#$%&*]+)"
LAST_LATIN = "\u024f"
DOTTED_I = "\u0130"  # its lower case ends in a combining dot, which would join a mark that follows


def ids_bytes(ids) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    found = array("I", ids)
    if sys.byteorder == "big":
        found.byteswap()
    return found.tobytes()


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    ``blank_kept`` says whether the tokenizer makes a blank part of the word after it (byte-level vocabularies do) or
    drops white space.
    """

    def __init__(self, path: str, blank_kept: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.blank_kept = blank_kept
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.letters = {byte: char for char, byte in byte_alphabet().items()}
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.after_blank = np.array([name.startswith(self.letters[ord(" ")]) for name in names])
        self.line_end = np.array([name == self.letters[ord("\n")] for name in names])
        self.bare = _BARE * blank_kept
        # Texts that are not simply split at blanks and line ends.
        odd = [*map(re.escape, self.special)]
        if blank_kept:
            odd += _BARE, f"{_SPACE} {_SPACE}", f"\n{_SPACE}", f"{_SPACE}\n"
        self.odd = "|".join(odd)

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text with runs of white space, as keys of what is known: a blank before a piece goes without saying."""
        return [p[1:] if p[0] == " " and p[1:] else _BARE + p for p in _BEFORE_WORD.split(text) if p]

    def _text(self, key: str) -> str:
        """The text that a key stands for."""
        if not self.blank_kept:
            return key
        return key[1:] if key[:1] == _BARE else " " + key

    def _word(self, word: str) -> bytes | None:
        """Ids of a word of Latin letters, for which neither normalising nor splitting does more than what is done here."""
        if not word.isalpha() or max(word) > LAST_LATIN or DOTTED_I in word:
            return None
        return ids_bytes(token.id for token in self.model.tokenize(word.lower().encode().decode("latin-1").translate(self.letters)))

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [ids_bytes(found.ids) for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _runs(self, keys: list[str], apart: str, begins: np.ndarray) -> dict[str, bytes]:
        """Ids of keys encoded many in a text, ``apart`` before each; ``begins`` tells the ids that only a piece's first token has."""
        found = {}
        plain = [p.removeprefix(_BARE) for p in keys]
        if " ".join(plain).split() != plain:  # white space in a piece, or nothing
            hard = [p for p, body in zip(keys, plain, strict=True) if body.split() != [body]]
            found.update(zip(hard, self._whole(list(map(self._text, hard))), strict=True))
            keys = [p for p in keys if p not in found]
        parts = [keys[k : k + RUN] for k in range(0, len(keys), RUN)]
        texts = [apart + apart.join(part).replace(_BARE, "") for part in parts]
        for part, got in zip(parts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(got.ids, "<u4")
            at = (4 * np.flatnonzero(begins[ids])).tolist()
            data, skipped = ids.tobytes(), 4 * (apart != " ")  # a blank belongs to the piece
            found.update(zip(part, [data[a + skipped : b] for a, b in zip(at, [*at[1:], len(data)], strict=True)], strict=True))
        return found

    def _learn(self, new: list[str]) -> None:
        halves = {}
        for p in new:
            if p[-1:] in _MARKS:
                body = p.rstrip(_MARKS)
                if body[-1:].isalnum() and DOTTED_I not in p:
                    halves[p] = body, self.bare + p[len(body) :]
        if halves:
            whole = {p for p in new if p not in halves}
            whole.update(h for pair in halves.values() for h in pair)
            new = [p for p in whole if p not in self.known]
        if self.blank_kept:
            self.known.update(self._runs([p for p in new if p[:1] != _BARE], " ", self.after_blank))
            self.known.update(self._runs([p for p in new if p[:1] == _BARE], "\n", self.line_end))
        else:
            self.known.update((p, ids) for p in new if (ids := self._word(p)) is not None)
            rest = [p for p in new if p not in self.known]
            self.known.update(zip(rest, self._whole(rest), strict=True))
        for piece, (body, mark) in halves.items():
            self.known[piece] = self.known[body] + self.known[mark]

    def _ids(self, keys: list[str]) -> list[bytes]:
        """The ids of different keys."""
        if 2 * len(self.known) > CACHE_PIECES:
            self.before, self.known = self.known, {}
        found = list(map(self.known.get, keys))
        missing = [i for i, ids in enumerate(found) if ids is None]
        new = []
        for i in missing:
            ids = self.before.get(keys[i])
            if ids is None:
                new.append(keys[i])
            else:
                self.known[keys[i]] = ids
        if new:
            self._learn(new)
        for i in missing:
            found[i] = self.known[keys[i]]
        return found

    def _split(self, texts: pa.Array) -> list[bytes]:
        """Ids of texts whose pieces stand between single blanks."""
        split = pc.split_pattern(texts, " ")
        pieces = split.flatten().dictionary_encode()
        at = pieces.indices.to_numpy()
        found = self._ids(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())  # some ten times as fast as to_pylist
        pool = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts = np.cumsum(sizes) - sizes
        ends = np.concatenate([[0], np.cumsum(sizes[at])])
        out = []
        for b in range(0, len(at), BLOCK_PIECES):
            own = at[b : b + BLOCK_PIECES]
            before = ends[b : b + len(own)]
            places = np.repeat(starts[own] - before, sizes[own])
            places += np.arange(before[0], before[0] + len(places))
            out.append(pool[places].tobytes())
        data = b"".join(out)
        counts = pc.list_value_length(split).to_numpy()
        bounds = (4 * ends[np.concatenate([[0], np.cumsum(counts)])]).tolist()
        return [data[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def _portion(self, texts: pa.Array) -> list[bytes]:
        odd = pc.match_substring_regex(texts, self.odd) if self.odd else pa.repeat(pa.scalar(False), len(texts))
        whole, runs = [], []  # apart from these, odd texts keep their line ends
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            text = texts[i].as_py()
            if any(s in text for s in self.special) or (self.blank_kept and _BARE in text):
                whole.append((i, text))
            elif _BLANK_RUN.search(text):
                runs.append((i, self.pieces(text)))
        plain = pc.if_else(odd, texts, pc.replace_substring(texts, "\n", f" {_BARE}\n {_BARE}" if self.blank_kept else " "))
        if whole or runs:
            apart = np.zeros(len(texts), bool)
            apart[[i for i, _ in chain(whole, runs)]] = True
            plain = pc.if_else(pa.array(apart), "", plain)
        if self.blank_kept:
            plain = pc.replace_substring_regex(plain, _LATIN_BEFORE_MARKS, f"\\1 {_BARE}\\2")
            plain = pc.binary_join_element_wise(pa.scalar(_BARE, plain.type), plain, pa.scalar("", plain.type))
        out = self._split(plain)
        if runs:
            keys = list(dict.fromkeys(chain.from_iterable(p for _, p in runs)))
            ids = dict(zip(keys, self._ids(keys), strict=True))
            for i, found in runs:
                out[i] = b"".join(map(ids.__getitem__, found))
        for (i, _), ids in zip(whole, self._whole([text for _, text in whole]), strict=True):
            out[i] = ids
        return out

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text; null is an empty text."""
        column = pc.fill_null(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()), "")
        until = np.cumsum(pc.binary_length(column).to_numpy())
        out, begin = [], 0
        while begin < len(column):
            taken = until[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(until, taken + PORTION, "right")))
            out += self._portion(column.slice(begin, end - begin))
            begin = end
        return out


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def worker_encoder(path: str, blank_kept: bool) -> Encoder:
    """The encoder of this Python worker."""
    if (path, blank_kept) not in _ENCODERS:
        _ENCODERS[path, blank_kept] = Encoder(path, blank_kept)
    return _ENCODERS[path, blank_kept]
