"""SimHash near-dedup (operator 10) by multi-index hashing.

Each text gets a 64-bit fingerprint: the majority bits of the XXH64 hashes of its word
shingles. Fingerprints within ``distance`` bits differ, in at least one of ``segments``
segments, by at most ``distance // segments`` bits. So every distinct fingerprint is stored
in one table per segment under that segment's value, and looks up the small Hamming ball
around its own value; matches are verified on the whole fingerprint inside the join, and only
where no earlier segment already found them, so that a link is made once and candidates that
fail are never rows.

Copies collapse to one fingerprint first, so a group of copies costs what one text costs.
Groups are the connected components of the links. A group of near copies can hold very many
close pairs, of which connecting it needs few: links to the smallest fingerprint under the
same segment value are taken first, and the search then reports no pair with the same such
neighbour.

Defined results: null and empty texts have fingerprint zero, linked like any other; repeated
rows are separate rows of one group; a component is named by its smallest doc_id (null ids are
ignored unless all are null); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airfill.llm.components import components
from airfill.llm.runtime import attach, batch_of, identity, keyed, map_arrow, slices, told_apart, verdicts
from airfill.session import written

BITS, SEED = 64, 42
#: Shingles counted at a time.
BLOCK = 1 << 16


def fingerprint(words: list[bytes], shingle: int = 4) -> int:
    """Bit b is 1 if it is set in over half of the shingles' hashes."""
    from xxhash import xxh64_intdigest
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    n = max(1, len(words) - shingle + 1)
    spans = list(zip(starts[:n], ends[min(shingle, len(words)) - 1:], strict=True))
    total = np.zeros(BITS, np.int64)
    for i in range(0, n, BLOCK):
        h = np.array([xxh64_intdigest(joined[a:b - 1], SEED) for a, b in spans[i:i + BLOCK]], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key: the row's identity, fp long: the fingerprint's 64 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            yield batch_of(doc_id=batch.column("doc_id"), key=batch.column("key"),
                           fp=pa.array([fingerprint(t.lower().split(), shingle) for t in texts], pa.int64()))

    return map_arrow(keyed(docs, id_col, text_col).withColumn("key", identity()), run, "doc_id long, key binary, fp long")


def layout(segments: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment."""
    ends = [BITS * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def _value(low: int, width: int):
    return F.shiftrightunsigned(F.col("fp"), low).bitwiseAND(F.lit((1 << width) - 1))


def _stored(parts: list[tuple[int, int]]) -> list:
    """A fingerprint's key in each segment's table: the segment's number and value."""
    return [_value(low, width).bitwiseOR(F.lit(s << 40)) for s, (low, width) in enumerate(parts)]


def stars(distinct: DataFrame, distance: int = 4, segments: int = 3) -> DataFrame:
    """Links (a, b) of each fingerprint to the smallest one under the same value of a segment,
    where close enough: as many rows as fingerprints and segments at most. In a dense group
    these already connect most members, whatever its number of close pairs."""
    table = distinct.select("fp", F.explode(F.array(*_stored(layout(segments)))).alias("key"))
    centre = table.groupBy("key").agg(F.min("fp").alias("a"))
    return (table.join(centre, "key").where((F.col("fp") > F.col("a"))
                                            & (F.bit_count(F.col("fp").bitwiseXOR(F.col("a"))) <= distance))
                 .select("a", F.col("fp").alias("b")))


def links(distinct: DataFrame, distance: int = 4, segments: int = 3) -> DataFrame:
    """All pairs (a, b), a < b, of distinct fingerprints (column fp) that differ in at most
    ``distance`` bits, each once. With a column ``root``, only pairs of different roots."""
    radius = distance // segments
    parts, own = layout(segments), _stored(layout(segments))
    probes = [key.bitwiseXOR(F.lit(sum(1 << b for b in some))) for key, (_, width) in zip(own, parts, strict=True)
              for r in range(radius + 1) for some in combinations(range(width), r)]
    rooted = "root" in distinct.columns
    table = distinct.select(F.col("fp").alias("b"), *(["root"] * rooted), F.explode(F.array(*own)).alias("key"))
    asked = distinct.select(F.col("fp").alias("a"), *(["root"] * rooted), F.explode(F.array(*probes)).alias("key"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    met = (F.col("a") < F.col("b")) & (F.bit_count(differ) <= distance)
    if rooted:
        met = met & (F.col("asked.root") != F.col("stored.root"))
    for s, (low, width) in enumerate(parts[:-1]):
        mask = ((1 << width) - 1) << low
        mask -= (1 << 64) if mask >= 1 << 63 else 0
        earlier = F.bit_count(differ.bitwiseAND(F.lit(mask))) <= radius
        met = met & ~(earlier & (F.shiftright("asked.key", 40) > s))
    return asked.alias("asked").join(table.alias("stored"), (F.col("asked.key") == F.col("stored.key")) & met) \
                .select("a", "b")


def connected(distinct: DataFrame, distance: int = 4, segments: int = 3) -> DataFrame:
    """(node, root) of fingerprints with links. Fingerprints linked to the same star centre need
    no link between them, so the full search only reports pairs of different centres."""
    first = written(stars(distinct, distance, segments), "simhash-stars")
    centre = first.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
    marked = written(distinct.join(centre, distinct["fp"] == centre["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root")), "simhash-marked")
    return components(first.unionByName(written(links(marked, distance, segments), "simhash-links")))


def grouped(rows: DataFrame, distance: int = 4, segments: int = 3) -> DataFrame:
    """``rows`` (doc_id, fp and others; a written table) with root, the smallest fingerprint of their
    component, and component_id, its smallest doc_id."""
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("size")),
                       "simhash-distinct")
    linked = connected(distinct.select("fp"), distance, segments)
    named = distinct.join(linked, distinct["fp"] == linked["node"], "left").select(
        "fp", "least", "size", F.coalesce("root", "fp").alias("root"))
    named = written(named, "simhash-roots")
    name = written(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members")),
                   "simhash-names")
    groups = attach(named.drop("least"), name, "root", "members", named.count())
    return attach(rows, written(groups.drop("members"), "simhash-groups"), "fp", "size", rows.count()).drop("size")


def near_groups(docs: DataFrame, shingle: int = 4, distance: int = 4, segments: int = 3,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fp, component_id."""
    rows = written(fingerprints(docs, shingle, id_col, text_col).drop("key"), "simhash-rows")
    return grouped(rows, distance, segments).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, distance: int = 4, segments: int = 3) -> DataFrame:
    """The rows of ``docs`` (read more than once) of which one of each near-duplicate group stays: the
    one with the smallest doc_id (of rows with that id any one)."""
    rows = written(fingerprints(docs, shingle), "simhash-rows")
    stay = (grouped(rows, distance, segments).groupBy("root")
            .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("k")).select("k.key"))
    return told_apart(docs, written(verdicts(rows, stay), "simhash-verdicts"))


def shown(groups: DataFrame) -> DataFrame:
    """The contract's columns: the fingerprint as 16 lowercase hex digits."""
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
