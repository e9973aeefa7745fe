"""Token ids as files (operator 12): canonical length-limited Huffman codes in independent blocks.

1. Tokenise once and write the ids; each task adds its counts of ids, and their sums - at most one
   number per id of the vocabulary - reach the driver.
2. Package-merge gives code lengths of at most ``limit`` bits; codes are canonical (by length, then
   id), so the lengths are all that the files hold of the code.
3. Documents are sorted by id in ranges. Each task writes blocks: whole documents, ``BLOCK`` ids or
   more, their codes in one bit string, and the bit offset of every ``STEP``-th id. A block is
   read without any other block.
4. Reading starts at all checkpoints of many blocks at once: a step looks the next ``limit`` bits of
   every one up in a table of (id, length). A document's place in the whole is its place in its
   task's file plus the sizes of the files before, one row per file.

The format, under a folder: ``codes`` (id, length) and ``blocks`` (part, first, doc_ids, sizes,
checkpoints, bits), both Parquet; ``first``: ids of the part before the block; ``sizes``: ids of each
document; ``checkpoints``: little-endian 64-bit numbers; ``bits``: codes from the highest bit on.

Defined results: null and empty texts are the end id alone; a null doc_id sorts first; rows with
equal ids stay separate documents, in the order in which their tasks met them; an empty table gives an
empty file and no rows; columns beyond id and text are left behind.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airfill.llm.bpe import vocabulary_path
from airfill.llm.packing import tokenizer
from airfill.llm.runtime import batch_of, keyed, map_arrow, slices
from airfill.session import scratch_path, written

END_ID = 2
#: Bits of the longest code; more where the vocabulary needs them.
LIMIT = 18
#: Ids of a block, at least, and from checkpoint to checkpoint; ids that a reader decodes at a time, about.
BLOCK, STEP, DECODED = 1 << 16, 256, 1 << 20
BLOCKS = ("part int, first long, doc_ids array<long>, sizes array<long>, checkpoints binary, bits binary")


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Code lengths of at most ``limit`` bits with the least total of ``counts`` times length, by
    package-merge; 0 for what doesn't occur."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    limit = max(limit, int(len(used) - 1).bit_length())
    used = used[np.argsort(counts[used], kind="stable")]
    weight = counts[used].astype(np.int64)
    level, packed = weight, [np.zeros(len(used), bool)]
    for _ in range(limit - 1):
        pairs = level[:len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weight, pairs])
        order = np.argsort(both, kind="stable")
        level = both[order]
        packed.append(order >= len(weight))
    take = 2 * len(used) - 2
    for is_pair in reversed(packed):
        pairs = int(is_pair[:take].sum())
        lengths[used[:take - pairs]] += 1
        take = 2 * pairs
    return lengths


class Code:
    """The canonical code of ``lengths`` (by id): code words in order of length, then id."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        own = np.flatnonzero(lengths)
        self.order = own[np.argsort(lengths[own], kind="stable")]
        size = self.lengths[self.order]
        self.bits = int(size.max()) if len(size) else 1
        room = np.left_shift(1, self.bits - size)  # of the table, for each code word
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[self.order] = (np.cumsum(room) - room) >> (self.bits - size)
        self._room = room
        self._table: np.ndarray | None = None

    @property
    def table(self) -> np.ndarray:
        """For every ``bits`` bits the id that they start with and its length: id * 64 + length."""
        if self._table is None:
            self._table = np.ones(1 << self.bits, np.int64)  # unused bits: one bit is no id
            entries = np.repeat(self.order * 64 + self.lengths[self.order], self._room)
            self._table[:len(entries)] = entries
        return self._table

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bit string of ``ids``, and the bit offset of each ``STEP``-th."""
        size = self.lengths[ids]
        end = np.cumsum(size)
        at = end - size
        word, shift = at >> 5, at & 31
        value = self.codes[ids] << (64 - shift - size).astype(np.uint64)
        n = int(end[-1] >> 5) + 2 if len(ids) else 0
        # the codes of a word share no bits, so that their sum, below 2**32, is exact
        high = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), n)
        low = np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
        bits = (high + low).astype(">u4").tobytes()[:int(end[-1] + 7) // 8] if len(ids) else b""
        return bits, at[::STEP]

    def decode(self, bits: list[bytes], checkpoints: list[np.ndarray], sizes: list[int]) -> np.ndarray:
        """The ids of blocks, one after the other, given their bit strings, checkpoints and numbers of ids."""
        joined = b"".join(b + b"\0" * 8 for b in bits)
        view = np.ndarray((len(joined) - 7,), ">u8", joined, strides=(1,))
        base = np.cumsum([0, *(len(b) + 8 for b in bits)])[:-1] * 8
        lanes = [len(c) for c in checkpoints]
        at = np.concatenate(checkpoints).astype(np.int64) + np.repeat(base, lanes)
        last = np.repeat(base + np.array([len(b) * 8 for b in bits]), lanes)
        count = np.full(len(at), STEP)
        count[np.cumsum(lanes) - 1] = np.array(sizes) - (np.array(lanes) - 1) * STEP
        out = np.empty((STEP, len(at)), np.int64)
        table, mask, width = self.table, np.uint64((1 << self.bits) - 1), 64 - self.bits
        for k in range(int(count.max())):
            next_bits = view[at >> 3].astype(np.uint64) >> (width - (at & 7)).astype(np.uint64) & mask
            entry = table[next_bits.astype(np.int64)]
            out[k] = entry >> 6
            at = np.minimum(at + (entry & 63), last)
        return out.T[np.arange(STEP) < count[:, None]]


def tokenised(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """(row, doc_id, n_tokens, ids) of every document, ids as little-endian unsigned numbers of 16 bits, or of 32
    where the document needs them, the end id included; and one row per task with ``counts``, how often each id occurs (64-bit
    numbers) and nothing else. ``row`` orders rows of equal doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, row = tokenizer(vocabulary_path(vocabulary)), TaskContext.get().partitionId() << 33
        counts = np.zeros(0, np.int64)
        for batch, texts in slices(batches):
            own = [np.append(ids, end_id) for ids in t.each(texts)]
            more = np.bincount(np.concatenate(own))
            counts, less = (more, counts) if len(more) > len(counts) else (counts, more)
            counts[:len(less)] += less
            yield batch_of(row=pa.array(np.arange(row, row + len(own)), pa.int64()), doc_id=batch.column("doc_id"),
                           n_tokens=pa.array([len(x) for x in own], pa.int64()),
                           ids=pa.array([x.astype("<u2" if x.max() < 1 << 16 else "<u4").tobytes() for x in own], pa.binary()),
                           counts=pa.nulls(len(own), pa.binary()))
            row += len(own)
        if len(counts):
            none = pa.nulls(1, pa.int64())
            yield batch_of(row=none, doc_id=none, n_tokens=none, ids=pa.nulls(1, pa.binary()),
                           counts=pa.array([counts.tobytes()], pa.binary()))

    return written(map_arrow(docs, run, "row long, doc_id long, n_tokens long, ids binary, counts binary"), "huffman-tokens")


def global_counts(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in batch.column("counts").to_pylist():
                c = np.frombuffer(c, np.int64)
                own = np.flatnonzero(c)
                yield batch_of(id=pa.array(own, pa.int64()), n=pa.array(c[own], pa.int64()))

    some = map_arrow(tokens.where(F.col("counts").isNotNull()).select("counts"), run, "id long, n long")
    found = some.groupBy("id").agg(F.sum("n").alias("n")).collect()  # one row per id of the vocabulary
    counts = np.zeros(1 + max((r["id"] for r in found), default=-1), np.int64)
    for r in found:
        counts[r["id"]] = r["n"]
    return counts


def write(docs: DataFrame, path: str, vocabulary: str = "byte_bpe_50k.json", end_id: int = END_ID, limit: int = LIMIT,
          block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> str:
    """The ids of all documents, in ascending order of their id, as files under ``path``."""
    spark = docs.sparkSession
    tokens = tokenised(keyed(docs, id_col, text_col), vocabulary, end_id)
    lengths = code_lengths(global_counts(tokens), limit)
    used = np.flatnonzero(lengths)
    spark.createDataFrame(pa.table({"id": pa.array(used, pa.int64()), "length": pa.array(lengths[used], pa.int32())})) \
         .coalesce(1).write.parquet(f"{path}/codes")
    shared = spark.sparkContext.broadcast(lengths)  # one number per id of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, first = Code(shared.value), TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        sizes: list[int] = []
        held: list[np.ndarray] = []
        total = 0

        def out() -> pa.RecordBatch:
            bits, checkpoints = code.encode(np.concatenate(held, dtype=np.int64))
            return batch_of(part=pa.array([part], pa.int32()), first=pa.array([first], pa.int64()),
                            doc_ids=pa.array([doc_ids], pa.list_(pa.int64())), sizes=pa.array([sizes], pa.list_(pa.int64())),
                            checkpoints=pa.array([checkpoints.astype("<i8").tobytes()], pa.binary()),
                            bits=pa.array([bits], pa.binary()))

        for batch in batches:
            for i, n, ids in zip(batch.column("doc_id").to_pylist(), batch.column("n_tokens").to_pylist(),
                                 batch.column("ids"), strict=True):
                doc_ids.append(i)
                sizes.append(n)
                raw = ids.as_py()
                held.append(np.frombuffer(raw, f"<u{len(raw) // n}"))
                total += n
                if total >= block:
                    yield out()
                    first += total
                    doc_ids, sizes, held, total = [], [], [], 0
        if held:
            yield out()

    ordered = (tokens.where(F.col("ids").isNotNull()).select("row", "doc_id", "n_tokens", "ids")
                     .repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("row"))
                     .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "row"))
    map_arrow(ordered, run, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    return path


class Files(NamedTuple):
    """What a reader needs: the blocks with ``before``, the ids of all parts before theirs, and the code."""

    blocks: DataFrame
    lengths: np.ndarray


def opened(spark: SparkSession, path: str) -> Files:
    found = spark.read.parquet(f"{path}/codes").collect()  # one row per id of the vocabulary
    lengths = np.zeros(1 + max((r["id"] for r in found), default=-1), np.int64)
    for r in found:
        lengths[r["id"]] = r["length"]
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    total = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per part: small enough for the window, and written, so that its size is known to the join
    parts = written(blocks.groupBy("part").agg(F.sum(total).alias("n")).select(
        "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "huffman-parts")
    return Files(blocks.join(parts, "part"), lengths)


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document from the files alone: doc_id, start (ids of all documents before it),
    n_tokens, ids_crc32 (over its ids as little-endian unsigned 32-bit numbers), and with
    ``with_ids`` those bytes."""
    blocks, lengths = opened(spark, path)
    shared = spark.sparkContext.broadcast(lengths)
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(shared.value)
        for batch in batches:
            at = 0
            while at < batch.num_rows:  # blocks with about DECODED ids together
                sizes, stop, total = [], at, 0
                while stop < batch.num_rows and (not total or total < DECODED):
                    own = batch.column("sizes")[stop].values.to_numpy()
                    sizes.append(own)
                    total += int(own.sum())
                    stop += 1
                some = batch.slice(at, stop - at)
                ids = code.decode(some.column("bits").to_pylist(),
                                  [np.frombuffer(c, "<i8") for c in some.column("checkpoints").to_pylist()],
                                  [int(s.sum()) for s in sizes]).astype("<u4")
                n = np.concatenate(sizes)
                end = np.cumsum(n)
                first = np.array(some.column("first").to_pylist()) + np.array(some.column("before").to_pylist())
                per_block = np.array([len(s) for s in sizes])
                inside = (end - n) - np.repeat((end - n)[np.cumsum(per_block) - per_block], per_block)
                raw = memoryview(ids.tobytes())
                pieces = [raw[4 * a:4 * b] for a, b in zip((end - n).tolist(), end.tolist(), strict=True)]
                columns = {"doc_id": some.column("doc_ids").flatten(), "start": pa.array(np.repeat(first, per_block) + inside, pa.int64()),
                           "n_tokens": pa.array(n, pa.int64()), "ids_crc32": pa.array([zlib.crc32(p) for p in pieces], pa.int64())}
                if with_ids:
                    columns["ids"] = pa.array([bytes(p) for p in pieces], pa.binary())
                yield batch_of(**columns)
                at = stop

    return map_arrow(blocks.select("first", "before", "doc_ids", "sizes", "checkpoints", "bits"), run,
                     ", ".join(f"{k} {'binary' if k == 'ids' else 'long'}" for k in names))


def written_and_read(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = END_ID) -> DataFrame:
    """The documents' ids written as files under the shared folder, and read back from them."""
    spark = docs.sparkSession
    return read(spark, write(docs, scratch_path(spark, "huffman"), vocabulary, end_id))
