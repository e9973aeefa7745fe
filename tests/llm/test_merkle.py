import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from airfill.llm import merkle
from tests.llm.helpers import edge_docs, empty_docs, texts


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def lower(t):
    return None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


class Brute:
    """The tree of one list of leaves, by lists of whole levels."""

    def __init__(self, leaves):
        self.levels = [leaves]
        while len(self.levels[-1]) > 1:
            now = self.levels[-1]
            self.levels.append([h(*now[i:i + 8]) for i in range(0, len(now), 8)])
        self.root = self.levels[-1][0]

    def path(self, i):
        out = []
        for now in self.levels[:-1]:
            run = now[i // 8 * 8:i // 8 * 8 + 8]
            out.append((run[:i % 8], run[i % 8 + 1:]))
            i //= 8
        return out


def expected(rows):
    """The contract's rows of (doc_id, source, lang, n_chars, text)."""
    def leaf(r, text):
        return h(*map(field, (*r[:4], text)))
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    trees, ordered = {}, sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in ordered:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees[g] = Brute([leaf(r, r[4]) for r in groups[g]])
    top = Brute([trees[g].root for g in ordered])
    out = []
    for k, g in enumerate(ordered):
        for i, r in enumerate(groups[g]):
            path = trees[g].path(i) + top.path(k)
            own = leaf(r, r[4])
            now = leaf(r, lower(r[4])) if zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 3 == 0 else own
            for left, right in path:
                now = h(*left, now, *right)
            out.append((r[0], own, trees[g].root, top.root, h(*[d for p in path for side in p for d in side]), now, now == top.root))
    return out


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")


def many(n_by_lang):
    return [(i, "s", lang, i * 3, f"Text {i}") for lang, n in n_by_lang.items() for i in range(n)]


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8}, {"en": 9, "de": 1}, {"en": 65, None: 17, "": 2, "é": 8, "z": 3},
                                   {f"l{i:02}": 1 + i % 3 for i in range(70)}, {"en": 600}])
def test_trees_of_any_size_equal_brute_force(spark, sizes):
    rows = many(sizes)
    got = sorted(map(tuple, merkle.audit(docs_of(spark, rows).repartition(3)).collect()), key=repr)
    assert got == sorted(expected(rows), key=repr)


def test_awkward_rows_equal_brute_force(spark):
    docs = edge_docs(spark)
    rows = [(i, "s", None if i == 9 else "en", len(t or ""), t) for i, t in texts()]
    rows += [(20, None, "en", None, "Null source")]
    more = docs.limit(0).select("doc_id", "source", "lang", "n_chars", "text").unionByName(docs_of(spark, rows[-1:]))
    got = merkle.audit(docs.unionByName(more, allowMissingColumns=True)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(expected(rows), key=repr)
    assert merkle.audit(empty_docs(spark)).count() == 0


def test_requests_get_their_own_proofs_only(spark):
    rows = many({"en": 100, "de": 9, "x": 1})
    m = merkle.build(merkle.leaves(docs_of(spark, rows)))
    asked = spark.createDataFrame([("1en", 0), ("1en", 77), ("1de", 8), ("1x", 0), ("1x", 5), ("1none", 0)], "g string, rank long")
    got = {(r["g"], r["rank"]): r for r in merkle.proofs(m, asked).collect()}
    every = {(r["g"], r["rank"]): r for r in merkle.proofs(m).collect()}
    assert set(got) == {("1en", 0), ("1en", 77), ("1de", 8), ("1x", 0)} and len(every) == 110
    assert all(got[k] == every[k] for k in got)


def test_any_change_of_a_field_breaks_the_fold(spark):
    rows = many({"en": 20})
    m = merkle.build(merkle.leaves(docs_of(spark, rows)))
    proofs = merkle.proofs(m).select("id", "path")
    changed = docs_of(spark, [(i, s, lang, n + 1, t) for i, s, lang, n, t in rows])
    shown = merkle.leaves(changed).join(proofs, "id")
    assert shown.where(merkle.fold(F.col("leaf"), F.col("path")) == m.root).count() == 0
    same = merkle.leaves(docs_of(spark, rows)).join(proofs, "id")
    assert same.where(merkle.fold(F.col("leaf"), F.col("path")) == m.root).count() == 20


def test_records_are_found_by_digest_alone(spark):
    m = merkle.build(merkle.leaves(docs_of(spark, many({"en": 70}))))
    for nodes in m.groups.nodes:
        for r in nodes.collect():
            assert r["digest"] == h(*r["children"]) and len(r["children"]) <= merkle.FAN


def test_no_python_worker_and_no_nested_loop(spark):
    plan = merkle.audit(docs_of(spark, many({"en": 70})))._jdf.queryExecution().toString()
    assert "InArrow" not in plan and "Python" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
