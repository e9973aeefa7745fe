"""Packing token sequences into fixed windows (operator 1): non-negative least squares over
the histogram of lengths.

1. Tokenise once and write the ids to the shared folder. Every full window of a document is
   a sequence of its own; what remains (fewer tokens than a window) is to be combined.
2. The histogram of remainder lengths, fewer than ``window`` numbers, is all that reaches the
   driver. Shallow combinations (one, two or three lengths filling the window exactly) are
   the columns of a non-negative least-squares problem; its solution says how often each
   combination repeats. Repeats are rounded down.
3. What rounding leaves is packed greedily, longest first with the longest that still fits,
   whole patterns at a time; a window that nothing fills exactly gets its last piece cut from
   a longer remainder. A single last remainder is cut at powers of two.
4. Every remainder has a rank among those of its length, so a plan of rank intervals tells
   each document where its pieces go: a lookup inside one map, no further matching.

Ranks come from running counts within each task and sums over tasks per length, so no
length, however common, meets in one task.

Defined results: null and empty texts are the end token alone; repeated rows and ids are
packed as the separate rows they are; an empty table gives no rows.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airfill.llm import pretokens
from airfill.llm.bpe import Encoder, _hash, _words, vocabulary_path
from airfill.llm.merges import Merges
from airfill.llm.runtime import batch_of, keyed, map_arrow, slices
from airfill.session import written

WINDOW = 1024
#: Bytes of the longest pre-token that is merged on arrays.
MERGED = 64
#: Bytes of the counts per task and length that are broadcast at most; beyond, joined by shuffle.
BROADCAST_BYTES = 64 << 20


@lru_cache(1)
def byte_letters() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary file stands for: printable Latin-1
    characters for themselves, the other bytes, in order, for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizer(Encoder):
    """A ``tokenizers`` vocabulary file: pre-tokens that the library gives one id are looked up
    in the perfect hash; the other distinct ones of a slice are merged together on arrays, by the
    library's own merges. Nothing is remembered from slice to slice."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Library
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Library.from_file(path)
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        letters, known = byte_letters(), {}
        for token, i in self.library.get_vocab(with_added_tokens=False).items():
            try:
                raw = bytes(letters[c] for c in token)
                raw.decode("utf-8")
                known[raw] = i
            except (KeyError, UnicodeDecodeError):  # not a whole text by itself
                continue
        tokens = list(known)
        super().__init__({t: known[t] for t, ids in zip(tokens, self.merge_all(tokens), strict=True) if ids == [known[t]]})
        self.merges = Merges.of_library(self.library, letters)

    def merge_all(self, tokens: list[bytes]) -> list[list[int]]:
        out = []
        for i in range(0, len(tokens), 4096):
            some = [t.decode() for t in tokens[i:i + 4096]]
            out += [e.ids for e in self.library.encode_batch_fast(some, add_special_tokens=False)]
        return out

    def missed(self, buffer: bytes, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens of the buffer, one after the other, and how many each has. Long
        ones, whose merges would take as many rounds, go to the library."""
        short = np.flatnonzero(size <= MERGED)
        begin, own = start[short], size[short]
        step = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
        ids, n = self.merges.merge(np.frombuffer(buffer, np.uint8)[np.repeat(begin, own) + step], own)
        if len(short) == len(size):
            return ids, n
        long = np.flatnonzero(size > MERGED)
        parts = self.merge_all([buffer[x:x + k] for x, k in zip(start[long].tolist(), size[long].tolist(), strict=True)])
        count = np.zeros(len(size), np.int64)
        count[short], count[long] = n, [len(p) for p in parts]
        out, of_long = np.empty(int(count.sum()), np.int32), np.repeat(size > MERGED, count)
        out[~of_long], out[of_long] = ids, np.concatenate([np.array(p, np.int32) for p in parts])
        return out, count

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
        for i in np.flatnonzero(hit & (size > 24)):  # the words show 24 bytes; compare the rest
            hit[i] = self.ranks.get(buffer[start[i]:end[i]], -1) == self.key_ids[slot[i]]
        # the misses, each distinct one once, as far as their hashes tell
        miss = np.flatnonzero(~hit)
        own = hashes[miss]
        long = np.flatnonzero(size[miss] > 24)
        own[long] = [hash(buffer[start[miss[k]]:end[miss[k]]]) & (1 << 64) - 1 for k in long]
        _, first, number = np.unique(own, return_index=True, return_inverse=True)
        at = miss[first]
        if (any((w[miss] != w[at][number]).any() for w in (*words, size))
                or any(buffer[start[miss[k]]:end[miss[k]]] != buffer[start[at[number[k]]]:end[at[number[k]]]] for k in long)):
            at, number = miss, np.arange(len(miss))  # two have one hash
        flat, many = self.missed(buffer, start[at], size[at])
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

    def each(self, texts: list[bytes]) -> list[np.ndarray]:
        ids, n = self.encode(texts)
        own = np.split(ids, np.cumsum(n)[:-1])
        for i, t in enumerate(texts):  # special tokens cut across pre-tokens
            if any(s in t for s in self.special):
                own[i] = np.array(self.merge_all([t])[0], np.int64)
        return own


@lru_cache(2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def tokenised(docs: DataFrame, vocabulary: str, end_id: int, window: int) -> DataFrame:
    """One row per document: its ids (little-endian unsigned 32-bit, end token included), the
    task that made it, and how many full windows and remainders of its length that task had
    made before. Written to the shared folder, so a retried task's numbers are the same rows'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, part = tokenizer(vocabulary_path(vocabulary)), TaskContext.get().partitionId()
        full, rest = 0, defaultdict(int)
        for batch, texts in slices(batches):
            cols: dict[str, list] = {k: [] for k in ("n_tokens", "ids", "full_before", "rest", "rest_before")}
            for ids in t.each(texts):
                n = len(ids) + 1
                cols["n_tokens"].append(n)
                cols["ids"].append(np.append(ids, end_id).astype("<u4").tobytes())
                cols["full_before"].append(full)
                cols["rest"].append(n % window)
                cols["rest_before"].append(rest[n % window])
                full += n // window
                rest[n % window] += 1
            yield batch_of(doc_id=batch.column("doc_id"), part=pa.array([part] * batch.num_rows, pa.int32()),
                           **{k: pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in cols.items()})

    return written(map_arrow(docs, run, "doc_id long, part int, n_tokens long, ids binary, full_before long, "
                                        "rest long, rest_before long"), "packing-tokens")


def combinations(lengths: list[int], window: int, depth: int = 3) -> list[tuple[int, ...]]:
    """Multisets of at most ``depth`` present lengths that fill the window exactly."""
    have, out = set(lengths), []
    for a in lengths:
        if depth >= 2 and window - a >= a and window - a in have:
            out.append((a, window - a))
    for a in lengths if depth >= 3 else []:
        for b in lengths:
            c = window - a - b
            if b >= a and c >= b and c in have:
                out.append((a, b, c))
    return out


def repeats(histogram: dict[int, int], window: int, depth: int = 3, rounds: int = 30,
            block: int = 48) -> list[tuple[tuple[int, ...], int]]:
    """Repeat counts of combinations: min |A x - h| with x >= 0 by an active set (columns of
    largest gradient enter in blocks, negative ones leave), rounded down."""
    lengths = sorted(histogram)
    columns = combinations(lengths, window, depth)
    if not columns:
        return []
    row = {m: i for i, m in enumerate(lengths)}
    at = np.array([[row[m] for m in c] + [len(lengths)] * (depth - len(c)) for c in columns])
    h = np.array([histogram[m] for m in lengths], float)

    def dense(some: np.ndarray) -> np.ndarray:
        a = np.zeros((len(lengths) + 1, len(some)))
        for k in range(at.shape[1]):
            np.add.at(a, (at[some, k], np.arange(len(some))), 1.0)
        return a[:-1]

    active = np.flatnonzero([len(c) == 2 for c in columns])
    x = np.zeros(len(columns))
    residual = h.copy()
    for _ in range(rounds):
        while len(active):
            a = dense(active)
            z = np.linalg.solve(a.T @ a + 1e-9 * np.eye(len(active)), a.T @ h)
            if (z > 0).all():
                break
            bad = z <= 0
            now = x[active]
            step = np.min(np.where(bad, now / np.maximum(now - z, 1e-12), 1.0))
            x[active] = now + step * (z - now)
            gone = bad & (x[active] <= 1e-9)
            if not gone.any():
                gone = bad
            x[active[gone]] = 0
            active = active[~gone]
        if len(active):
            x[active] = z
            residual = h - a @ z
        gradient = np.append(residual, 0)[at].sum(1)
        gradient[active] = 0
        enter, used = [], set()
        for k in np.argsort(-gradient, kind="stable")[:block * 16]:
            if gradient[k] <= 1e-6 * max(1.0, h.max()):
                break
            if used.isdisjoint(columns[k]):
                enter.append(k)
                used.update(columns[k])
            if len(enter) == block:
                break
        if not enter:
            break
        active = np.sort(np.concatenate([active, enter]))
    left, out = dict(histogram), []
    for k in sorted(active, key=lambda k: (len(columns[k]), columns[k])):
        c = columns[k]
        n = min(int(x[k] + 1e-6), *(left[m] // c.count(m) for m in c))
        if n > 0:
            out.append((c, n))
            for m in c:
                left[m] -= n
    return out


class Plan:
    """Where every remainder goes, as intervals of its rank among remainders of its length."""

    def __init__(self, histogram: dict[int, int], window: int = WINDOW, depth: int = 3):
        self.window, self.sequences = window, 0
        #: per length still to place: runs of (original length, start in it, first rank, end rank)
        self.left: dict[int, list[tuple[int, int, int, int]]] = {m: [(m, 0, 0, n)] for m, n in histogram.items() if n}
        self.count = {m: n for m, n in histogram.items() if n}
        self.rows: list[tuple[int, int, int, int, int, int, int]] = []
        for pattern, n in repeats(self.count, window, depth):
            offset = 0
            for m in pattern:
                self.place(self.take(m, n), m, offset)
                offset += m
            self.sequences += n
        while self.count:
            self.greedy()
        self.lookup = self.indexed()

    def take(self, m: int, n: int) -> list[tuple[int, int, int, int]]:
        out = []
        self.count[m] -= n
        runs = self.left[m]
        while n:
            length, start, lo, hi = runs.pop()
            k = min(n, hi - lo)
            out.append((length, start, lo, lo + k))
            if lo + k < hi:
                runs.append((length, start, lo + k, hi))
            n -= k
        if not self.count[m]:
            del self.count[m], self.left[m]
        return out

    def give(self, m: int, runs: list[tuple[int, int, int, int]]) -> None:
        self.left.setdefault(m, []).extend(runs)
        self.count[m] = self.count.get(m, 0) + sum(hi - lo for _, _, lo, hi in runs)

    def place(self, runs: list[tuple[int, int, int, int]], size: int, offset: int) -> None:
        at = self.sequences
        for length, start, lo, hi in runs:
            self.rows.append((length, lo, hi, start, size, at, offset))
            at += hi - lo

    def greedy(self) -> None:
        """One pattern, as often as its lengths allow: the longest remainder, then ever the
        longest that fits; if none fits, a piece cut from the longest other one."""
        free, pattern, cut = dict(self.count), [], 0
        room = self.window
        while room:
            fits = [m for m in free if m <= room]
            if not fits:
                break
            m = max(fits)
            pattern.append(m)
            room -= m
            free[m] -= 1
            if not free[m]:
                del free[m]
        if room and free:
            cut = max(free)
        need = {m: pattern.count(m) + (m == cut) for m in {*pattern, *([cut] if cut else [])}}
        n = min(self.count[m] // k for m, k in need.items())
        if room and not cut:  # the last remainders of all: one sequence, cut at powers of two
            bits = [1 << b for b in range(room.bit_length() + self.window.bit_length(), -1, -1)]
            for m in pattern:
                (length, start, lo, hi), = self.take(m, 1)
                for b in bits:
                    if m & b:
                        self.place([(length, start, lo, hi)], b, 0)
                        self.sequences += 1
                        start += b
            return
        offset = 0
        for m in pattern:
            self.place(self.take(m, n), m, offset)
            offset += m
        if room:
            runs = self.take(cut, n)
            self.place(runs, room, offset)
            self.give(cut - room, [(length, start + room, lo, hi) for length, start, lo, hi in runs])
        self.sequences += n

    def indexed(self) -> dict[int, tuple[list[int], list[list[tuple[int, int, int, int]]]]]:
        """Per length: sorted first ranks, and for each the pieces (start, size, sequence of
        rank 0, offset) of the ranks from there on."""
        by = defaultdict(list)
        for length, lo, hi, start, size, at, offset in self.rows:
            by[length].append((lo, hi, start, size, at - lo, offset))
        out = {}
        for length, rows in by.items():
            firsts = sorted({x for lo, hi, *_ in rows for x in (lo, hi)})
            pieces: list[list[tuple[int, int, int, int]]] = [[] for _ in firsts]
            index = {x: i for i, x in enumerate(firsts)}
            for lo, hi, *rest in sorted(rows, key=lambda r: r[2]):
                for i in range(index[lo], index[hi]):
                    pieces[i].append(tuple(rest))
            out[length] = (firsts, pieces)
        return out

    def pieces(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start, size, sequence, offset) of the remainder of this length and rank."""
        if not length:
            return []
        firsts, pieces = self.lookup[length]
        return [(start, size, at + rank, offset) for start, size, at, offset in pieces[bisect_right(firsts, rank) - 1]]


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", window: int = WINDOW, end_id: int = 0,
         depth: int = 3, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    and with ``with_ids`` the piece's ids (little-endian unsigned 32-bit)."""
    spark = docs.sparkSession
    tokens = tokenised(keyed(docs, id_col, text_col), vocabulary, end_id, window)
    made = written(tokens.where(F.col("rest") > 0).groupBy("part", "rest").agg(F.count(F.lit(1)).alias("n")),
                   "packing-counts")
    histogram = {r["rest"]: r["n"] for r in made.groupBy("rest").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(Plan(histogram, window, depth))
    earlier = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = made.select("part", "rest", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    # one row per task, with fewer lengths than the window
    own = base.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("rest", "base"))).alias("bases"))
    if made.count() * 16 <= BROADCAST_BYTES:
        own = F.broadcast(own)
    ranked = (tokens.join(own, "part", "left")
                    .select("doc_id", "part", "n_tokens", "ids", "full_before", "rest",
                            (F.coalesce(F.element_at("bases", F.col("rest")), F.lit(0)) + F.col("rest_before")).alias("rank")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                out: list[tuple] = []
                for r in whole.slice(at, 1000).to_pylist():
                    ids, n, full = r["ids"], r["n_tokens"], r["n_tokens"] // window
                    first = p.sequences + (r["part"] << 40) + r["full_before"]
                    own = [(k * window, window, first + k, 0) for k in range(full)]
                    own += [(full * window + start, size, sequence, offset)
                            for start, size, sequence, offset in p.pieces(r["rest"], r["rank"])]
                    for start, size, sequence, offset in own:
                        piece = ids[4 * start:4 * (start + size)]
                        out.append((r["doc_id"], start, size, zlib.crc32(piece), n, sequence, offset, piece))
                if out:
                    cols = list(zip(*out, strict=True))
                    yield batch_of(**{k: pa.array(c, pa.binary() if k == "ids" else pa.int64())
                                      for k, c in zip(names, cols, strict=False)})

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    return map_arrow(ranked, run, ", ".join(f"{k} {'binary' if k == 'ids' else 'long'}" for k in names))
