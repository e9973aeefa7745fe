import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from airfill.llm import components, exact_dedup, queries, simhash
from airfill.session import scratch_path
from tests.llm.helpers import SF, edge_docs, empty_docs, prose, table, texts


def duck(sql, *names):
    con = duckdb.connect()
    for n in names:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{SF}/{n}.parquet')")
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    return sorted(map(repr, ({c: v for c, v in zip(cols, r, strict=True)}.items() for r in cur.fetchall())))


def test_exact_dedup_equals_sql(spark):
    got = queries.op7_exact_dedup(spark, SF).collect()
    assert sorted(repr(r.asDict().items()) for r in got) == duck(queries.SQL["op7_exact_dedup"], "documents")


def test_exact_dedup_of_awkward_rows(spark):
    docs = edge_docs(spark)
    got = exact_dedup.dedup(docs.repartition(4), exact_dedup.fresh_index(spark)).collect()
    groups = {}
    for i, t in texts():
        key = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        groups.setdefault(hashlib.sha256(key.encode()).hexdigest(), []).append(i)
    assert len(got) == len(texts())
    for r in got:
        ids = groups[r["text_sha256"]]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == max((i for i in ids if i is not None), default=None)
    for key, ids in groups.items():
        kept = [r for r in got if r["text_sha256"] == key and r["kept"]]
        assert len(kept) == 1 and kept[0]["doc_id"] == kept[0]["keep_id"]
    assert exact_dedup.dedup(empty_docs(spark), exact_dedup.fresh_index(spark)).count() == 0


def test_index_persists_and_drops_known_texts(spark):
    path = scratch_path(spark, "index-test")
    first = exact_dedup.DigestIndex(spark, path, 4)
    a, b = edge_docs(spark, [(1, "x"), (2, "y"), (3, "X")]), edge_docs(spark, [(9, "Y"), (10, "z"), (11, "z")])
    assert {r["doc_id"] for r in exact_dedup.dedup(a, first, "a").where("kept").collect()} == {2, 3}
    again = exact_dedup.DigestIndex(spark, path, 4)
    got = {r["doc_id"]: r for r in exact_dedup.dedup(b, again, "b").collect()}
    assert {i for i, r in got.items() if r["kept"]} == {11}
    assert got[9]["keep_id"] == 2 and got[10]["group_size"] == 2
    assert again.table().count() == 3
    plan = again.table().join(spark.table(again.name).alias("o"), "text_sha256")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 0 or "Broadcast" in plan  # bucketed: no shuffle of the index


def test_keep_one_keeps_columns_and_the_largest_id(spark):
    docs = edge_docs(spark)
    kept = exact_dedup.keep_one(docs.repartition(3), exact_dedup.fresh_index(spark))
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 1 not in ids and 2 in ids and ids.count(3) == 1 and len(ids) == len(set(ids))  # 2 has capitals beyond A-Z


def brute_groups(rows, distance=4):
    import xxhash
    fps = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[k:k + 4]), 42) for k in range(max(1, len(w) - 3))] if w else []
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(root(i), []).append(d)
    return sorted((repr(d), f"{fps[i]:016x}", min((x for x in least[root(i)] if x is not None), default=None))
                  for i, (d, _) in enumerate(rows))


def result(df):
    return sorted((repr(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in simhash.shown(df).collect())


def test_simhash_equals_brute_force(spark):
    docs = table(spark, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert result(simhash.near_groups(docs.repartition(4))) == brute_groups(rows)


def test_simhash_of_awkward_rows(spark):
    rows = [(i, t) for i, t in texts() if i != 12] + [(100 + k, prose(50) + " w" * k) for k in range(8)]
    assert result(simhash.near_groups(edge_docs(spark, rows).repartition(3))) == brute_groups(rows)
    assert simhash.near_groups(empty_docs(spark)).count() == 0


@pytest.mark.parametrize("distance,segments", [(4, 3), (3, 4), (6, 3)])
def test_links_find_every_pair(spark, distance, segments):
    rng = np.random.default_rng(distance)
    base = rng.integers(0, 2 ** 63, 40, dtype=np.int64)
    fps = set(base.tolist())
    for x in base.tolist():  # neighbours at every distance up to one too far
        for k in range(1, distance + 2):
            y = x
            for b in rng.choice(64, k, replace=False).tolist():
                y ^= 1 << b
            fps.add(y - (1 << 64) if y >= 1 << 63 else y)
    fps = sorted(fps)
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1:] if ((a ^ b) & (1 << 64) - 1).bit_count() <= distance}
    got = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), distance, segments).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_components_follow_long_chains(spark):
    n = 60
    links = [(i, i + 1) for i in range(n)] + [(1000, 1003), (1003, 1001), (7, 7)]
    got = dict(tuple(r) for r in components.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000, 1003: 1000}


def test_simhash_keep_one(spark):
    rows = [(5, prose(8)), (4, prose(8)), (4, prose(8)), (9, prose(9)), (None, prose(10))]
    docs = edge_docs(spark, rows)
    kept = simhash.keep_one(docs.repartition(2))
    assert kept.columns == docs.columns
    assert sorted(repr(r["doc_id"]) for r in kept.collect()) == ["4", "9", "None"]


def test_dense_groups_report_few_pairs(spark):
    centre = 0x5A5A_1234_0F0F_7777
    fps = {centre} | {centre ^ (1 << i) for i in range(62)} | {centre ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(i)}
    frame = spark.createDataFrame([(x,) for x in sorted(fps)], "fp long")
    every = simhash.links(frame).count()
    near = simhash.stars(frame).groupBy("b").agg(F.min("a").alias("root"))
    marked = frame.join(near, frame["fp"] == near["b"], "left").selectExpr("fp", "coalesce(root, fp) root")
    assert simhash.links(marked).count() < every / 3
    got = simhash.connected(frame).collect()
    assert len(got) == len(fps) and len({r["root"] for r in got}) == 1
