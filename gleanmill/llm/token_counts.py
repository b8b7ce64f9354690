"""Token counts by a linear longest-match automaton.

Greedy longest match cuts each word from left to right into the longest vocabulary entries. The automaton is a trie of
the vocabulary whose nodes carry a failure link and the number of pieces that following it completes. A word is read
once, byte by byte: where the trie has no edge, the pieces of the failure link are added and reading goes on at its
target. Only counts are kept, pieces are never built. Words of a batch advance in lockstep, one array step per byte; a
long word (text without blanks) is cut into stretches that advance in lockstep too and are joined where their states meet.

The vocabulary is that of a byte-level tokenizer file: an entry that begins with a blank can begin a word, and all single
bytes are entries, so every word has a cut. Null and blank texts have 0 words and 0 pieces. Rows are counted one by one;
repeated ids and extra columns do no harm. A text of any length is counted whole, in one task. An empty table gives no rows.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanmill.llm.common import slices

# Bytes from which on a word advances in stretches of its own.
LONG = 2_048
# Distinct words whose counts a task remembers before it starts afresh.
CACHE_WORDS = 300_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that a byte-level vocabulary writes for each byte: itself if it is visible, else the next from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


def read_vocabulary(path: str) -> list[bytes]:
    """The entries of a byte-level tokenizer file as bytes, without its special tokens."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    special = {t["content"] for t in spec["added_tokens"]}
    to_byte = byte_alphabet()
    return [bytes(map(to_byte.__getitem__, piece)) for piece in spec["model"]["vocab"] if piece not in special]


class Automaton:
    """Trie edges in a sorted array; failure links and the pieces they complete by node. Node 0 is the root."""

    def __init__(self, vocabulary: list[bytes]) -> None:
        children: list[dict[int, int]] = [{}]
        ends = [False]
        for piece in sorted(vocabulary):
            node = 0
            for byte in piece:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                    ends.append(False)
                node = children[node][byte]
            ends[node] = node > 0
        if len(children[0]) < 256 or not all(ends[n] for n in children[0].values()):
            raise ValueError("every single byte must be in the vocabulary")
        fail, pops = [0] * len(children), [0] * len(children)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for byte, node in children[parent].items():
                queue.append(node)
                if ends[node]:
                    fail[node], pops[node] = 0, 1
                    continue
                at, count = fail[parent], pops[parent]
                while byte not in children[at]:
                    at, count = fail[at], count + pops[at]
                fail[node], pops[node] = children[at][byte], count
        edges = sorted((n << 8 | b, child) for n, own in enumerate(children) for b, child in own.items())
        self.keys = np.array([k for k, _ in edges], np.int64)
        self.targets = np.array([t for _, t in edges], np.int32)
        self.fail, self.pops = np.array(fail, np.int32), np.array(pops, np.int32)

    def _lockstep(self, words: list[bytes], history: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """State and number of pieces after each word (not empty), from the root, all words advancing together.

        ``history`` collects both after every byte, of words in order of length, longest first.
        """
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-lengths, kind="stable")
        data = np.frombuffer(b"".join(words), np.uint8)
        starts = (np.cumsum(lengths) - lengths)[order]
        lengths = lengths[order]
        state, total = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for step in range(int(lengths[0]) if len(words) else 0):
            live = int(np.searchsorted(-lengths, -step, "left"))  # the words longer than step come first
            byte = data[starts[:live] + step]
            pending = np.arange(live)
            while len(pending):
                key = state[pending] << 8 | byte[pending]
                place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[place] == key
                state[pending[hit]] = self.targets[place[hit]]
                pending = pending[~hit]
                total[pending] += self.pops[state[pending]]
                state[pending] = self.fail[state[pending]]
            if history is not None:
                history.append((state.copy(), total.copy()))
        states, totals = np.empty_like(state), np.empty_like(total)
        states[order], totals[order] = state, total
        return states, totals

    def _next(self, state: int, byte: int) -> tuple[int, int]:
        """One step of one word: the next state, and the pieces popped on the way."""
        popped = 0
        while True:
            key = state << 8 | byte
            place = int(np.searchsorted(self.keys, key))
            if place < len(self.keys) and self.keys[place] == key:
                return int(self.targets[place]), popped
            popped += int(self.pops[state])
            state = int(self.fail[state])

    def _after_long(self, word: bytes) -> tuple[int, int]:
        """State and pieces after a long word. Its stretches advance together, each as if it began at the root; then each
        is walked from where the one before really ended, until it meets what was found for it, which is soon."""
        size = max(256, int(len(word) ** 0.5))
        stretches = [word[i : i + size] for i in range(0, len(word), size)]
        history: list[tuple[np.ndarray, np.ndarray]] = []
        states, totals = self._lockstep(stretches, history)
        state, total = int(states[0]), int(totals[0])
        for j, stretch in enumerate(stretches[1:], 1):
            for step, byte in enumerate(stretch):
                state, popped = self._next(state, byte)
                total += popped
                if state == history[step][0][j]:
                    total += int(totals[j] - history[step][1][j])
                    state = int(states[j])
                    break
        return state, total

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Pieces of each word (not empty)."""
        long = [i for i, word in enumerate(words) if len(word) > LONG]
        state, total = self._lockstep([b"" if len(word) > LONG else word for word in words])
        for i in long:
            state[i], total[i] = self._after_long(words[i])
        while (rest := np.flatnonzero(state)).size:  # what is left in the trie is cut to the end
            total[rest] += self.pops[state[rest]]
            state[rest] = self.fail[state[rest]]
        return total


def count_tokens(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_words, n_pieces of every row. The path must name a file that every executor has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(read_vocabulary(vocabulary_path))
        known: dict[bytes, int] = {}
        for part in slices(batches):
            split = [(text or b"").split() for text in part.column("text").to_pylist()]
            if len(known) > CACHE_WORDS:
                known.clear()
            new = [w for w in set().union(*split) if w not in known]
            known.update(zip(new, automaton.counts([b" " + w for w in new]).tolist(), strict=True))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(map(len, split), pa.int64()),
                 pa.array((sum(map(known.__getitem__, w)) for w in split), pa.int64())],
                ["doc_id", "n_words", "n_pieces"])

    # As bytes, str.split's rule for ASCII white space is that of all word counts here.
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(
        count, "doc_id long, n_words long, n_pieces long")
