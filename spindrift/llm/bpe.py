"""Byte-level BPE encoding and decoding with a contiguous rank array.

A text is split at special tokens, then by the pre-tokenizer's pattern, and each word is merged on its own. For a
short word two arrays are held: the part boundaries and the rank of each adjacent pair. The smallest rank is found by
scanning the array, its boundary is deleted and the two neighbouring ranks are refreshed, until no pair has a rank.
The arrays are a few cache lines long, so the scan beats a heap; words of over ``SHORT`` bytes, on which repeated
scans would be quadratic, take a heap with the same order (rank, then place) and so give the same ids. The short words
of a batch that are not known yet are merged side by side, one row of a matrix each.

Words repeat, so each worker keeps the ids of words that it has met, about
``CACHE_WORDS`` of them; the cache is emptied when it is full. Documents are encoded where they lie: there is no shuffle.

Defined cases: null text is empty; an empty text has no ids; repeated rows are each encoded; an empty table gives an
empty result; other columns are ignored. The vocabulary's path is a parameter. It must be readable on every worker
(it is part of the environment, as a library is).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from spindrift.llm.common import back_id, map_batches, texts

#: Bytes of a word up to which the rank array is scanned.
SHORT = 64
#: Words whose ids a worker remembers.
CACHE_WORDS = 500_000
#: The pattern of byte-level pre-tokenizers (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same without classes of Unicode, for texts in which \\w, \\d and \\s agree with them.
_FAST = re.compile(r"""'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""")
_ODD = frozenset(c for c in map(chr, range(0x110000)) if unicodedata.category(c) in ("No", "Nl", "Cn") or "\x1c" <= c <= "\x1f")
_NONE = 1 << 62


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file: printable ones for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Ids of tokens, ranks of merges and special tokens, read from a tokenizer's JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        symbols = byte_symbols()
        as_bytes = lambda token: bytes(symbols[c] for c in token)
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        ids = {as_bytes(t): i for t, i in data["model"]["vocab"].items() if t not in self.special}
        self.tokens = {i: t for t, i in ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.byte_ids = np.array([ids[bytes([b])] for b in range(256)], np.int64)
        merges = [tuple(as_bytes(x) for x in (m.split(" ") if isinstance(m, str) else m)) for m in data["model"]["merges"]]
        #: (left id << 32 | right id) -> (rank, id of the merged part)
        self.pairs = {ids[a] << 32 | ids[b]: (rank, ids[a + b]) for rank, (a, b) in enumerate(merges)}
        keys = sorted(self.pairs)
        self.keys = np.array(keys or [-1], np.int64)
        self.rank = np.array([self.pairs[k][0] for k in keys] or [_NONE], np.int64)
        self.merged = np.array([self.pairs[k][1] for k in keys] or [0], np.int64)
        self.split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.words = regex.compile(PATTERN)
        self.cache: dict[str, bytes] = {}
        every = [self.tokens.get(i, b"") for i in range(max(self.tokens) + 1)]
        self.token_bytes = np.frombuffer(b"".join(every), np.uint8)
        self.token_lengths = np.fromiter(map(len, every), np.int64, len(every))
        self.token_starts = np.cumsum(self.token_lengths) - self.token_lengths

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and merged ids of pairs of part ids; a negative id stands for no part."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(known, self.rank[at], _NONE), self.merged[at]

    def merge_short(self, words: list[bytes]) -> list[bytes]:
        """The packed ids of short words, all of them at once: a row for each word, its parts and ranks side by side.

        Each round finds the least rank in every row, deletes the boundary between that pair and refreshes the ranks
        to its left and right; rows without a rank are finished.
        """
        width = max(map(len, words))
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
        column = np.arange(width + 1)
        parts = np.full((len(words), width + 1), -1, np.int64)
        parts[:, :width] = np.where(column[:width] < lengths[:, None], self.byte_ids[raw], -1)
        ranks, merged = self._ranks(parts[:, :-1].ravel(), parts[:, 1:].ravel())
        ranks, merged = ranks.reshape(len(words), width), merged.reshape(len(words), width)
        done: list[bytes | None] = [None] * len(words)
        rows = np.arange(len(words))
        while len(rows):
            at = ranks.argmin(1)
            own = np.arange(len(rows))
            live = ranks[own, at] < _NONE
            if not live.all():
                ended = parts[~live]
                packed, ends = ended[ended >= 0].astype("<i4").tobytes(), (4 * np.cumsum((ended >= 0).sum(1))).tolist()
                for row, a, b in zip(rows[~live].tolist(), [0, *ends], ends, strict=False):
                    done[row] = packed[a:b]
                rows, parts, ranks, merged, at = rows[live], parts[live], ranks[live], merged[live], at[live]
                own = np.arange(len(rows))
                if not len(rows):
                    break
            parts[own, at] = merged[own, at]
            # Delete the boundary after part `at`: what is right of it moves one place to the left.
            right = column[:-1] > at[:, None]
            parts[:, :-1] = np.where(right, parts[:, 1:], parts[:, :-1])
            ranks[:, :-1] = np.where(right[:, :-1], ranks[:, 1:], ranks[:, :-1])
            merged[:, :-1] = np.where(right[:, :-1], merged[:, 1:], merged[:, :-1])
            parts[:, -1], ranks[:, -1] = -1, _NONE
            ranks[own, at], merged[own, at] = self._ranks(parts[own, at], parts[own, at + 1])
            left = np.flatnonzero(at)
            if len(left):
                i = at[left] - 1
                ranks[left, i], merged[left, i] = self._ranks(parts[left, i], parts[left, i + 1])
        return done  # type: ignore[return-value]

    def merge_long(self, word: bytes) -> bytes:
        """The packed ids of a long word: a heap of pairs, least rank first, leftmost first among equals."""
        n, none = len(word), (_NONE, 0)
        part = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := self.pairs.get(part[i] << 32 | part[i + 1], none)[0]) < _NONE]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            if part[i] < 0 or (j := after[i]) >= n:
                continue
            found, new = self.pairs.get(part[i] << 32 | part[j], none)
            if found != rank:
                continue
            part[i], part[j], after[i] = new, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := self.pairs.get(new << 32 | part[after[i]], none)[0]) < _NONE:
                    heapq.heappush(heap, (r, i))
            if (k := before[i]) >= 0 and (r := self.pairs.get(part[k] << 32 | new, none)[0]) < _NONE:
                heapq.heappush(heap, (r, k))
        return np.array([p for p in part if p >= 0], "<i4").tobytes()

    def learn(self, words: set[str]) -> None:
        """Put the ids of words into the cache; they are merged together, by class of length."""
        classes: dict[int, list[tuple[str, bytes]]] = {}
        for word in words:
            raw = word.encode()
            classes.setdefault((len(raw) + 3) // 4 if len(raw) <= SHORT else 0, []).append((word, raw))
        for size, pairs in classes.items():
            for some in (pairs[i : i + 4096] for i in range(0, len(pairs), 4096)):
                ids = [self.merge_long(raw) for _, raw in some] if size == 0 else self.merge_short([raw for _, raw in some])
                self.cache.update(zip((w for w, _ in some), ids, strict=True))

    def pre_tokens(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        return (_FAST if _ODD.isdisjoint(set(text)) else self.words).findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of texts, packed as little-endian 32-bit integers; special tokens in a text are taken as such."""
        found: list[list[str] | list[list[str] | bytes]] = []
        missing: set[str] = set()
        for text in texts:
            if self.split is not None and any(t in text for t in self.special):
                parts = [np.array([self.special[x]], "<i4").tobytes() if i % 2 else self.pre_tokens(x) for i, x in enumerate(self.split.split(text))]
                missing.update(*(x for x in parts if isinstance(x, list)))
            else:
                parts = self.pre_tokens(text)
                missing.update(parts)
            found.append(parts)
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        self.learn(missing.difference(self.cache))
        ids, join = self.cache.__getitem__, b"".join
        return [join(x if isinstance(x, bytes) else join(map(ids, x)) for x in parts) if parts and not isinstance(parts[0], str) else join(map(ids, parts)) for parts in found]

    def decode(self, ids: bytes) -> bytes:
        """The text of packed ids as UTF-8; what is no UTF-8 becomes replacement characters."""
        ids = np.frombuffer(ids, "<i4")
        lengths = self.token_lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ends) or not ends[-1]:
            return b""
        at = np.arange(ends[-1]) + np.repeat(self.token_starts[ids] - (ends - lengths), lengths)
        raw = self.token_bytes[at].tobytes()
        try:
            raw.decode()
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()
        return raw


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary for each worker process and path."""
    return Vocabulary(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids: the token ids of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for batch in batches:
            ids = [np.frombuffer(x, "<i4") for x in known.encode(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return map_batches(texts(docs), run, "doc_id long, ids array<int>").select(back_id(), "ids")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text: the texts of encode()'s rows; null ids decode to an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for batch in batches:
            found = [known.decode(np.array(x or [], "<i4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()).cast(pa.string())], ["doc_id", "text"])

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded, and its ids decoded again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        digest = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            ids = known.encode(batch.column(1).to_pylist())
            columns = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(digest, ids), pa.string()), pa.array([digest(known.decode(x)) for x in ids], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = map_batches(texts(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.select(back_id(), "n_tokens", "ids_sha256", "decoded_sha256")
