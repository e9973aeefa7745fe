"""Merkle manifest of a dataset (operator 11): a content-addressed tree of digests, proofs for
rows, and the check of presented rows against it.

1. A row's leaf is the digest of its fields, each ``-`` for null, else its length in UTF-8 bytes,
   a colon and its value. Leaves of a group (language) are ranked by id, every ``FAN`` consecutive
   nodes become the digest of their digests, level by level, until one is left: the group's
   subroot. Subroots, ordered by group, form a tree of their own with the dataset's root.
2. Each level is stored as records (digest, children): what a digest stands for is found by the
   digest alone.
3. Requests descend from the root: a request's next child is the next digit, in base ``FAN``, of
   its leaf's rank. Requests that agree in the digits so far go down as one row, so no record
   is asked for twice by one prefix and the root isn't a hot key. On the way they gather the
   children not chosen, left and right of the chosen one; the segments of the path, reversed,
   are the proof.
4. Folding a presented leaf through the reversed path must give the root.

Ranks come from a sort by ranges and counts per range and group, so a group that holds most rows
is split like any other; a run of ``FAN`` nodes is the largest thing collected. The number of
levels is the logarithm of the largest group.

Defined results: null and empty fields differ (``-`` and ``0:``); a null id sorts first and its
fold is that of an empty text; of equal ids the lesser leaf comes first, and repeated rows are
leaves of their own; a null group is a group before all others; an empty table has no root and gives no
rows; other columns, also with the names of results, are left behind.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airfill.llm.runtime import remainder
from airfill.session import written

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "struct<left:string,right:string>"


def digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*values), 256)


def encoded(value: Column) -> Column:
    s = value.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def folded_case(text: Column) -> Column:
    """Only A-Z are lower-cased."""
    return F.translate(text.cast("string"), string.ascii_uppercase, string.ascii_lowercase)


def leaves(docs: DataFrame, group: str = "lang", tampered: Column | None = None, fields: Sequence[str] = FIELDS,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its group as a text that sorts null first, id, leaf, and
    ``presented``, the leaf of the row as someone would show it with the text's case folded
    where ``tampered`` holds (null where that is the same leaf)."""
    own = digest([encoded(F.col(f)) for f in fields])
    shown = digest([encoded(folded_case(F.col(f)) if f == text_col else F.col(f)) for f in fields])
    rows = docs.select(F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0")).alias("g"),
                       F.col(id_col).alias("id"), own.alias("leaf"),
                       F.when(F.lit(False) if tampered is None else tampered, shown).alias("presented"))
    return rows.withColumn("presented", F.when(F.col("presented") != F.col("leaf"), F.col("presented")))


def ranked(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``rows`` with ``rank`` (from 0) in ``order`` among those of the same ``g``, and ``n``, how many
    those are. Ranges of (g, order) are sorted and written with running numbers; a row's rank is
    its distance from the first of its group in its range plus the counts of earlier ranges."""
    keys = ["g", *order]
    # identical rows are told apart by a number, so that ranges can split them
    source = written(rows.withColumn("_row", F.monotonically_increasing_id()), f"{name}-rows")
    held = written(source.repartitionByRange(*keys, "_row").sortWithinPartitions(*keys, "_row").drop("_row")
                         .withColumn("_at", F.monotonically_increasing_id()), f"{name}-sorted")
    held = held.withColumn("_part", F.shiftright("_at", 33))
    sizes = held.groupBy("g", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy("g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = written(sizes.select("g", "_part", "_first", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"),
                                F.sum("_size").over(Window.partitionBy("g")).alias("n")), f"{name}-ranges")
    return (held.join(base, ["g", "_part"])  # one row per range and group
                .withColumn("rank", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_first", "_before"))


class Tree(NamedTuple):
    """The trees of all groups. ``runs``: (g, idx, n, children, payloads), the leaves in runs of ``FAN``;
    ``nodes[h]``: (g, idx, n, digest, children) of height ``h`` + 1, ``n`` being how many nodes the
    group has at that height; ``roots``: (g, digest, height)."""

    runs: DataFrame
    nodes: list[DataFrame]
    roots: DataFrame


def _levels(n: Column) -> Column:
    """How often ``n`` nodes have to be put in runs until one is left."""
    return sum((F.when(n > FAN ** k, 1).otherwise(0) for k in range(20)), F.lit(0))


def grow(rows: DataFrame, name: str) -> Tree:
    """The trees over ``rows``: (g, rank, n, leaf, payload)."""
    up = (F.col("n") + F.lit(FAN - 1)).cast("long")
    members = F.sort_array(F.collect_list(F.struct("rank", "leaf", "payload")))
    runs = written(rows.groupBy("g", "n", F.expr(f"rank div {FAN}").alias("idx")).agg(members.alias("m"))
                       .select("g", "idx", "n", F.col("m.leaf").alias("children"), F.col("m.payload").alias("payloads")),
                   f"{name}-runs")
    roots = runs.where(F.col("n") == 1).select("g", F.get("children", F.lit(0)).alias("digest"), F.lit(0).alias("height"))
    most = runs.agg(F.max(_levels(F.col("n")))).first()[0] or 0
    below, nodes = runs.where(F.col("n") > 1), []
    for h in range(1, most + 1):
        if h > 1:
            below = (nodes[-1].where(F.col("n") > 1).groupBy("g", "n", F.expr(f"idx div {FAN}").alias("up"))
                     .agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("m"))
                     .select("g", F.col("up").alias("idx"), "n", F.col("m.digest").alias("children")))
        nodes.append(written(below.select("g", "idx", F.floor(up / FAN).alias("n"),
                                          F.sha2(F.concat_ws("", "children"), 256).alias("digest"), "children"),
                             f"{name}-nodes"))
        roots = roots.unionByName(nodes[-1].where(F.col("n") == 1).select("g", "digest", F.lit(h).alias("height")))
    return Tree(runs, nodes, roots)


def _step(pos: Column) -> Column:
    """What is left and right of the child at ``pos``: a segment of the path."""
    c = F.col("children")
    return F.struct(F.concat_ws("", F.slice(c, F.lit(1), pos)).alias("left"),
                    F.concat_ws("", F.slice(c, pos + 2, F.size(c))).alias("right"))


def descend(tree: Tree, start: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """From ``start`` (g, digest, height, path, carried), one row per group, down to the leaves that
    ``requests`` (g, rank) name, or to all: (g, rank, digest, path, carried, payload)."""
    start = start.withColumn("idx", F.lit(0).cast("long"))
    front: DataFrame | None = None
    for h in range(len(tree.nodes), 0, -1):
        here = start.where(F.col("height") == h).drop("height")
        front = here if front is None else front.unionByName(here)
        if requests is not None:
            wanted = requests.select("g", F.expr(f"rank div {FAN ** h}").alias("idx")).distinct()
            front = front.join(wanted, ["g", "idx"], "left_semi")
        # content-addressed: equal digests have equal children
        records = tree.nodes[h - 1].select("digest", "children").dropDuplicates(["digest"])
        front = front.join(records, "digest")
        if h > 1:
            front = (front.select("g", "idx", "path", "carried", "children", F.posexplode("children").alias("pos", "digest"))
                          .select("g", (F.col("idx") * FAN + F.col("pos")).alias("idx"), "digest", "carried",
                                  F.concat("path", F.array(_step(F.col("pos")))).alias("path")))
    runs = tree.runs.select("g", "idx", "payloads")
    alone = start.where(F.col("height") == 0).join(runs, ["g", "idx"]).select(
        "g", F.col("idx").alias("rank"), "digest", "path", "carried", F.get("payloads", F.lit(0)).alias("payload"))
    found = alone
    if front is not None:
        found = (front.join(runs, ["g", "idx"])
                 .select("g", "idx", "path", "carried", "children", F.posexplode("payloads").alias("pos", "payload"))
                 .select("g", (F.col("idx") * FAN + F.col("pos")).alias("rank"), F.get("children", F.col("pos")).alias("digest"),
                         F.concat("path", F.array(_step(F.col("pos")))).alias("path"), "carried", "payload")
                 .unionByName(alone))
    return found if requests is None else found.join(requests.select("g", "rank").distinct(), ["g", "rank"], "left_semi")


class Manifest(NamedTuple):
    """``groups``: a tree for each group; ``top``: the tree over their subroots; ``root``: its digest."""

    groups: Tree
    top: Tree
    root: str | None


def build(rows: DataFrame) -> Manifest:
    """The manifest over ``leaves``."""
    own = ranked(rows, ["id", "leaf", "presented"], "merkle-leaves")
    groups = grow(own.select("g", "rank", "n", "leaf", F.struct("id", "presented").alias("payload")), "merkle")
    subroots = groups.roots.select(F.lit("").alias("g"), F.col("g").alias("group"), F.col("digest").alias("leaf"), "height")
    over = ranked(subroots, ["group"], "merkle-groups")
    top = grow(over.select("g", "rank", "n", "leaf", F.struct("group", "height").alias("payload")), "merkle-top")
    root = top.roots.first()
    return Manifest(groups, top, root["digest"] if root else None)


def proofs(m: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """(g, rank, id, leaf, presented, subroot, path) of the leaves that ``requests`` (g, rank) name, or of
    all. ``path`` runs from the leaf to the root; a segment is what is left and right of the node
    among the children of its parent."""
    start = m.top.roots.withColumns({"path": F.array().cast(f"array<{_STEP}>"), "carried": F.lit("")})
    subroots = descend(m.top, start).select(
        F.col("payload.group").alias("g"), "digest", F.col("payload.height").alias("height"), "path",
        F.col("digest").alias("carried"))
    return descend(m.groups, subroots, requests).select(
        "g", "rank", F.col("payload.id").alias("id"), F.col("digest").alias("leaf"),
        F.coalesce("payload.presented", "digest").alias("presented"), F.col("carried").alias("subroot"),
        F.reverse("path").alias("path"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` has under ``path``."""
    return F.aggregate(path, leaf, lambda now, s: F.sha2(F.concat(s["left"], now, s["right"]), 256))


def siblings(path: Column) -> Column:
    """The proof as one text: siblings level by level, left to right."""
    return F.concat_ws("", F.transform(path, lambda s: F.concat(s["left"], s["right"])))


def audit(docs: DataFrame, tampered: Column | None = None, group: str = "lang", fields: Sequence[str] = FIELDS,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The manifest of ``docs`` with the proof of every row, and whether the row as presented folds
    to the root: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. Without
    ``tampered`` every third row by crc32 of its id is presented with its text's case folded."""
    if tampered is None:
        tampered = remainder(id_col, 3) == 0
    m = build(leaves(docs, group, tampered, fields, id_col, text_col))
    return proofs(m).select(
        F.col("id").alias("doc_id"), "leaf", "subroot", F.lit(m.root).cast("string").alias("root"),
        F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"),
        fold(F.col("presented"), F.col("path")).alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
