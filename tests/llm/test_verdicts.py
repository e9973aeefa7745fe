"""Verdicts carried by row digests: identities, repeated rows, and no second copy of the texts."""

import hashlib

import pytest
from pyspark.sql import functions as F

from airfill.llm import runtime, simhash
from airfill.llm.runtime import attach, identity, told_apart, verdicts
from airfill.session import written
from tests.llm.helpers import edge_docs, empty_docs, prose, texts


def brute_identity(i, t):
    return hashlib.md5((("-:" if i is None else f"{len(str(i))}:{i}") + (t or "")).encode()).digest()


def test_identity_of_awkward_rows(spark):
    rows = edge_docs(spark).select("doc_id", "text", identity().alias("key")).collect()
    assert [bytes(r["key"]) for r in rows] == [brute_identity(i, t) for i, t in texts()]
    # an id and a text can't run into each other
    pairs = spark.createDataFrame([(1, "2:x"), (12, ":x"), (None, "1:1x"), (1, "1x")], "doc_id long, text string")
    assert pairs.select(identity().alias("key")).distinct().count() == 4


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_one_row_of_each_staying_identity_is_left(spark, monkeypatch, most):
    monkeypatch.setattr(runtime, "BROADCAST_KEYS", most)  # beyond it: by sort and merge
    rows = [(1, "a"), (1, "a"), (1, "a"), (2, "b"), (3, "c"), (3, "c"), (None, None), (None, ""), (4, None)]
    docs = edge_docs(spark, rows).repartition(3)
    keys = written(docs.select("doc_id", identity().alias("key")), "test-keys")
    stay = keys.where("doc_id is null or doc_id in (1, 2)").select("key").distinct()
    marks = written(verdicts(keys, stay), "test-verdicts")
    assert {bytes(r["key"]): r["stays"] for r in marks.collect()} == {
        brute_identity(1, "a"): True, brute_identity(None, ""): True,
        brute_identity(3, "c"): False, brute_identity(4, ""): False}
    left = told_apart(docs, marks)
    assert left.columns == docs.columns and left.dtypes == docs.dtypes
    assert sorted(repr(r["doc_id"]) for r in left.collect()) == ["1", "2", "None"]
    assert told_apart(empty_docs(spark), marks).count() == 0


def test_texts_are_neither_shuffled_nor_written_twice(spark):
    docs = written(edge_docs(spark, [(i, prose(i, 30)) for i in range(40)]), "test-docs")
    keys = written(docs.select(identity().alias("key")), "test-keys")
    marks = written(verdicts(keys, keys.limit(30)), "test-verdicts")
    left = told_apart(docs, marks)
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert left.count() == 30


def test_components_of_one_smallest_id_stay_apart(spark):
    """Ids may repeat: a component is told by its root, not by its smallest id."""
    rows = [(4, prose(8)), (4, prose(9)), (7, prose(9)), (None, prose(10)), (None, prose(11))]
    kept = simhash.keep_one(edge_docs(spark, rows).repartition(2)).collect()
    assert sorted(repr((r["doc_id"], r["text"])) for r in kept) == sorted(map(repr, [*rows[:2], *rows[3:]]))


def test_attach_of_a_hot_key(spark):
    rows = spark.range(6000).select(F.when(F.col("id") < 3000, 0).otherwise(F.col("id")).alias("k"), "id")
    groups = written(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "test-groups")
    got = attach(rows, groups, "k", "n", 6000)
    assert got.count() == 6000 and got.where("k = 0 and n = 3000").count() == 3000
