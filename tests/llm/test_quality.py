import zlib

import numpy as np
import pytest

from airfill.llm import fertility, rule_ensemble, weak_toxicity, wordstats
from tests.llm.helpers import edge_docs, empty_docs, table, texts

SMALL = "/root/testdata/sf0.01"


def brute_base(text):
    """The contract's base counts, word by word."""
    t = text or ""
    white = " \t\n\v\f\r"
    words, own = [], ""
    for c in t + " ":
        if c in white:
            if own:
                words.append(own)
            own = ""
        else:
            own += c
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i:i + 8]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    lines, seen, dup = t.split("\n"), set(), 0
    for x in lines:
        if any(c not in white for c in x):
            key = x
            dup += key in seen
            seen.add(key)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(covered),
            len(words) < 20 or 100 * len(covered) > 30 * len(words))


def check_base(rows, docs):
    want = sorted(repr((i, *brute_base(t))) for i, t in docs)
    got = sorted(repr((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"],
                       r["base_failed"])) for r in rows)
    assert got == want
    assert not any(r["kept"] and r["base_failed"] for r in rows)


def test_base_counts_of_the_table(spark):
    docs = table(spark, "documents", SMALL)
    rows = fertility.rules(docs).collect()
    check_base(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])
    quality = {r["doc_id"]: r["quality"] for r in table(spark, "labels", SMALL).collect()}
    good = [r["kept"] for r in rows if quality.get(r["doc_id"]) == 1 and not r["base_failed"]]
    bad = [r["kept"] for r in rows if quality.get(r["doc_id"]) == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.55


def test_base_counts_of_awkward_rows(spark):
    rows = fertility.rules(edge_docs(spark).repartition(3)).collect()
    check_base(rows, texts())
    assert fertility.rules(empty_docs(spark)).count() == 0
    assert fertility.filtered(empty_docs(spark)).count() == 0


def test_repeated_words_random():
    rng = np.random.default_rng(3)
    cases = [" ".join(map(str, rng.integers(0, 2, rng.integers(0, 60)))) for _ in range(300)]
    _, numbers, per = wordstats.numbered([c.encode() for c in cases])
    assert wordstats.repeated_words(numbers, per).tolist() == [brute_base(c)[4] for c in cases]


def test_entropy_and_bands(spark):
    ids, per = np.array([1, 1, 2, 2, 5, 5, 5, 5]), np.array([4, 0, 4])
    assert np.allclose(fertility.entropies(ids, per), [1.0, 0.0, 0.0])
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abdeginorst"), 5)) for _ in range(400)]
    clean = [(i, " ".join(rng.choice(words, 200))) for i in range(120)]
    odd = [(1000, " ".join(rng.choice(words[:6], 200))), (1001, " ".join("ႠႡႢႣႤ" for _ in range(200)))]
    docs = edge_docs(spark, clean + odd).repartition(3)
    kept = {r["doc_id"] for r in fertility.rules(docs).where("kept").collect()}
    assert len(kept & {i for i, _ in clean}) >= 119 and not kept & {1000, 1001}
    same = fertility.filtered(docs)
    assert same.columns == docs.columns and {r["doc_id"] for r in same.collect()} == kept


def judge(rows, labels, target, held=True):
    x = [(r["score"], labels[r["doc_id"]][target], r["predicted"]) for r in rows
         if r["held_out"] == held and r["doc_id"] in labels]
    s, y, p = (np.array(v) for v in zip(*x, strict=True))
    pairs = (s[y == 1][:, None] > s[y == 0][None, :]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0][None, :]).mean()
    return pairs, (p == y).mean()


@pytest.fixture(scope="module")
def labels(spark):
    return {r["doc_id"]: r for r in table(spark, "labels", SMALL).collect()}


def test_rule_ensemble_on_held_out_rows(spark, labels):
    docs = table(spark, "documents", SMALL)
    rows = rule_ensemble.score(docs, table(spark, "labels", SMALL)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    auc, right = judge(rows, labels, "quality")
    assert auc > 0.95 and right > 0.93


def test_rule_ensemble_of_awkward_rows(spark):
    rows = rule_ensemble.score(edge_docs(spark), spark.createDataFrame(
        [(1, 1, 0), (1, 0, 0), (4, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")).collect()
    assert len(rows) == len(texts()) and {round(r["score"], 3) for r in rows} <= {0.5, 1.0}
    assert rule_ensemble.score(empty_docs(spark), table(spark, "labels")).count() == 0


def test_rules_are_paths(spark):
    rows = [(float(x > 3 and y <= 2), float(x), float(y)) for x in range(8) for y in range(8) for _ in range(8)]
    model = rule_ensemble.fit(spark.createDataFrame(rows, "label double, a double, b double"), ["a", "b"], trees=6, depth=2,
                              penalty=0.001)
    assert model.weights and all(1 <= len(r) <= 4 for r in model.weights)
    df = spark.createDataFrame(rows, "label double, a double, b double").withColumn("p", model.column())
    assert df.where("abs(p - label) > 0.5").count() == 0


def test_weak_supervision_on_held_out_rows(spark, labels):
    docs = table(spark, "documents", "/root/testdata/sf0.1")
    big = table(spark, "labels", "/root/testdata/sf0.1")
    rows = weak_toxicity.score(docs, big).collect()
    auc, right = judge(rows, {r["doc_id"]: r for r in big.collect()}, "toxic")
    assert len(rows) == docs.count() and auc > 0.93 and right > 0.95


def test_weak_supervision_of_awkward_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = weak_toxicity.score(edge_docs(spark), none).collect()
    assert len(rows) == len(texts()) and {(r["score"], r["predicted"]) for r in rows} == {(0.0, 0)}
    assert weak_toxicity.score(empty_docs(spark), table(spark, "labels")).count() == 0


def test_label_model_weighs_voters_by_accuracy():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.3
    good = np.where(rng.random(4000) < 0.9, np.where(y, 1, -1), 0)
    bad = np.where(rng.random(4000) < 0.55, np.where(y, 1, -1), np.where(y, -1, 1))
    copies = [bad] * 4
    votes = np.column_stack([good, *copies]).astype(np.int8)
    p = weak_toxicity.label_model(votes, y.astype(float))
    assert ((p > 0.5) == y)[good != 0].mean() > 0.95
    share = weak_toxicity.evidence(votes, p)
    assert share[0] > 0.8 and share[1:].max() < 0.3
