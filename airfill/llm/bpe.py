"""Byte-level BPE encoding and decoding (operator 5): a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary, probed for a whole batch of
pre-tokens at a time, resolves every pre-token that is itself in the vocabulary. Tier two:
each remaining distinct pre-token is merged by rank with a heap over its linked bytes.

Texts are independent, so the job is one map over partitions: no shuffle, and memory is
bounded by the batch, the vocabulary and a bounded store of merged pre-tokens.

Defined results: null and empty texts give no ids and decode to no bytes; every row in
gives one row out, repeated rows and ids too; other columns are left behind.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airfill.llm import pretokens
from airfill.llm.runtime import batch_of, keyed, map_arrow, slices

#: Distinct merged pre-tokens a worker remembers (two generations of this size).
REMEMBERED = 200_000
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _words(buffer: bytes, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first, second and last eight bytes of each span (zero beyond its end)."""
    padded = buffer + b"\0" * 24
    view = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    last = start + np.maximum(size - 8, 0)
    return (view[start] & _MASK[np.minimum(size, 8)],
            np.where(size > 8, view[start + 8] & _MASK[np.clip(size - 8, 0, 8)], np.uint64(0)),
            np.where(size > 16, view[last], np.uint64(0)))


def _hash(words: tuple[np.ndarray, ...], size: np.ndarray) -> np.ndarray:
    h = size.astype(np.uint64) * _M1
    for w in words:
        h = (h ^ w) * _M2
        h ^= h >> np.uint64(29)
    return h


class PerfectHash:
    """A minimal perfect hash: levels of bit arrays; a key lives in the first level where no
    other key shares its place, and its slot is its bit's rank."""

    def __init__(self, hashes: np.ndarray, room: float = 2.0):
        self.levels: list[np.ndarray] = []
        left, n = hashes, 0
        while len(left):
            size = max(64, int(len(left) * room))
            at = self._place(left, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            slots = np.where(alone, n + np.cumsum(alone) - 1, -1).astype(np.int32)
            self.levels.append(slots)
            n += int(alone.sum())
            left = left[~alone[at]]
            if len(self.levels) > 64:
                raise ValueError("two keys have the same hash")
        self.size = n

    @staticmethod
    def _place(h: np.ndarray, level: int, size: int) -> np.ndarray:
        x = (h + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * _M3
        return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """Each hash's slot; -1 or any slot at all for one that isn't a key's."""
        out = np.full(len(hashes), -1, np.int32)
        todo = np.arange(len(hashes))
        for level, table in enumerate(self.levels):
            got = table[self._place(hashes[todo], level, len(table))]
            found = got >= 0
            out[todo[found]] = got[found]
            todo = todo[~found]
            if not len(todo):
                break
        return out


class Encoder:
    """A vocabulary of byte strings by rank, with both tiers of the lookup."""

    def __init__(self, ranks: dict[bytes, int], remembered: int = REMEMBERED):
        self.ranks, self.remembered = ranks, remembered
        tokens = sorted(ranks, key=ranks.__getitem__)
        self.vocabulary: dict[int, bytes] = {ranks[t]: t for t in tokens}
        self.decimal: dict[int, str] = {i: str(i) for i in self.vocabulary}
        joined, size = b"".join(tokens), np.array([len(t) for t in tokens], np.int64)
        start = np.cumsum(size) - size
        words = _words(joined, start, size)
        h = _hash(words, size)
        self.perfect = PerfectHash(h)
        slot = self.perfect.slots(h)
        self.key_ids = np.empty(self.perfect.size, np.int64)
        self.key_size = np.empty(self.perfect.size, np.int64)
        self.key_words = tuple(np.empty(self.perfect.size, np.uint64) for _ in words)
        self.key_ids[slot] = [ranks[t] for t in tokens]
        self.key_size[slot] = size
        for mine, w in zip(self.key_words, words, strict=True):
            mine[slot] = w
        self.recent: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def merge(self, token: bytes) -> tuple[int, ...]:
        """Ranked merges of one pre-token: the lowest-ranked adjacent pair first, the leftmost
        of equals, by a heap whose entries point into a linked list of pieces."""
        rank, n = self.ranks.get, len(token)
        shift = n.bit_length()
        low = (1 << shift) - 1
        after, before = list(range(1, n + 2)), list(range(-1, n))
        best = [-1] * n  # the live entry of the pair that starts here
        heap = []
        for i in range(n - 1):
            r = rank(token[i:i + 2])
            if r is not None:
                best[i] = r = r << shift | i
                heap.append(r)
        heapify(heap)
        while heap:
            top = heappop(heap)
            i = top & low
            if best[i] != top:
                continue
            j = after[i]
            after[i] = k = after[j]
            best[i] = best[j] = -1
            if k < n:
                before[k] = i
                r = rank(token[i:after[k]])
                if r is not None:
                    best[i] = r = r << shift | i
                    heappush(heap, r)
            if i:
                p = before[i]
                r = rank(token[p:k])
                if r is None:
                    best[p] = -1
                else:
                    best[p] = r = r << shift | p
                    heappush(heap, r)
        ranks = self.ranks
        out, i = [], 0
        while i < n:
            out.append(ranks[token[i:after[i]]])
            i = after[i]
        return tuple(out)

    def forget(self) -> None:
        self.recent, self.older = {}, {}

    def merge_all(self, tokens: list[bytes]) -> list[tuple[int, ...]]:
        return list(map(self.merge, tokens))

    def merged(self, tokens: list[bytes]) -> list[bytes]:
        """The ids of each pre-token as little-endian 32-bit numbers, remembered or merged now."""
        if len(self.recent) >= self.remembered:
            self.older, self.recent = self.recent, {}
        recent, older = self.recent, self.older
        new = []
        for t in tokens:
            if t not in recent:
                got = older.get(t)
                if got is None:
                    new.append(t)
                else:
                    recent[t] = got
        fresh = {}
        for t, ids in zip(new, self.merge_all(new), strict=True):
            packed = array("I", ids).tobytes()
            (recent if len(t) <= 64 else fresh)[t] = packed
        return [recent.get(t) or fresh[t] for t in tokens]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts`` in order, and how many each text has."""
        buffer, start, end, per_text = pretokens.split(texts)
        size = end - start
        words = _words(buffer, start, size)
        hashes = _hash(words, size)
        slot = self.perfect.slots(hashes)
        hit = (slot >= 0) & (self.key_size[slot] == size)
        for mine, w in zip(self.key_words, words, strict=True):
            hit &= mine[slot] == w
        ranks = self.ranks
        for i in np.flatnonzero(hit & (size > 24)):  # the words show 24 bytes; compare the rest
            hit[i] = ranks.get(buffer[start[i]:end[i]], -1) == self.key_ids[slot[i]]
        # the misses, each distinct one once; equal hashes are told apart by what they hash
        miss = np.flatnonzero(~hit)
        own = hashes[miss]
        spans = {k: buffer[start[miss[k]]:end[miss[k]]] for k in np.flatnonzero(size[miss] > 24).tolist()}
        for k, t in spans.items():
            own[k] = np.uint64(hash(t) & (1 << 64) - 1)
        _, first, number = np.unique(own, return_index=True, return_inverse=True)
        at = miss[first]
        if (any((w[miss] != w[at][number]).any() for w in (*words, size))
                or any(t != buffer[start[at[number[k]]]:end[at[number[k]]]] for k, t in spans.items())):
            index: dict[bytes, int] = {}
            number = np.array([index.setdefault(buffer[x:y], len(index)) for x, y in
                               zip(start[miss].tolist(), end[miss].tolist(), strict=True)], np.int64)
            tokens = list(index)
        else:
            tokens = [buffer[x:y] for x, y in zip(start[at].tolist(), end[at].tolist(), strict=True)]
        packed = self.merged(tokens)
        flat = np.frombuffer(b"".join(packed), "<u4").astype(np.int64)
        many = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        begin = np.cumsum(many) - many
        n = many[number]
        count = np.ones(len(start), np.int64)
        count[miss] = n
        place = np.cumsum(count) - count
        ids = np.empty(int(count.sum()), np.int64)
        ids[place[hit]] = self.key_ids[slot[hit]]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        ids[np.repeat(place[miss], n) + step] = flat[np.repeat(begin[number], n) + step]
        text = np.repeat(np.arange(len(texts)), per_text)
        return ids, np.bincount(text, weights=count, minlength=len(texts)).astype(np.int64)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """The encoder of a rank file: lines of base64 token and rank."""
    with open(path, "rb") as f:
        return Encoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def vocabulary_path(name: str) -> str:
    """A public vocabulary's place on the machine that asks (installed with the library)."""
    import public_tokenizers
    return public_tokenizers.path(name)


def encode(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary_path(vocabulary))
        for batch, texts in slices(batches):
            ids, n = e.encode(texts)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()),
                                             pa.array(ids, pa.int32()))
            yield batch_of(doc_id=batch.column("doc_id"), ids=lists)

    return map_arrow(keyed(docs, id_col, text_col), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, bytes binary) of (doc_id, ids); null ids decode to no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary_path(vocabulary))
        for batch in batches:
            yield batch_of(doc_id=batch.column("doc_id"),
                           bytes=pa.array([e.decode(x or ()) for x in batch.column("ids").to_pylist()], pa.binary()))

    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Encode every whole text, decode its ids, and return both as digests: (doc_id,
    n_tokens, ids_sha256 over the decimal ids joined by one space, decoded_sha256). One pass:
    the ids never leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary_path(vocabulary))
        for batch, texts in slices(batches):
            ids, n = e.encode(texts)
            flat, ends = ids.tolist(), np.cumsum(n).tolist()
            shown, back = [], []
            for a, b in zip([0, *ends], ends, strict=False):
                own = flat[a:b]
                shown.append(hashlib.sha256(" ".join(map(e.decimal.__getitem__, own)).encode()).hexdigest())
                back.append(hashlib.sha256(e.decode(own)).hexdigest())
            yield batch_of(doc_id=batch.column("doc_id"), n_tokens=pa.array(n, pa.int64()),
                           ids_sha256=shown, decoded_sha256=back)

    return map_arrow(keyed(docs, id_col, text_col), run,
                     "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, n_tokens) without the ids."""
    return encode(docs, vocabulary).select("doc_id", F.size("ids").cast("long").alias("n_tokens"))
