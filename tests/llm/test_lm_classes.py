import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from airfill.llm import brown_lm
from airfill.llm.runtime import keyed, remainder
from tests.llm.helpers import edge_docs


def alternating(n=400):
    """Texts in which words a.. and b.. take turns, with the same endings and about equal counts."""
    rng = random.Random(4)
    return [(i, " ".join(f"{'ab'[(i + k) % 2]}{rng.randrange(60)}xyz" for k in range(40))) for i in range(n)]


def trained(spark, rows, **parameters):
    docs = keyed(edge_docs(spark, rows).repartition(3)).withColumn("held_out", remainder("doc_id", 7) == 2)
    model, rare = brown_lm.train(docs.where(~F.col("held_out")).select("doc_id", "text"), **parameters)
    label = {w: int(model.label[i]) for w, i in model.items.index.items()} | model.classes
    label |= {bytes(r["word"]): r["label"] for r in rare.collect()}
    count = {w: int(model.known[i]) for w, i in model.items.index.items()} | model.lookup
    return model, label, count | {bytes(r["word"]): r["n"] for r in rare.collect()}


def test_every_training_word_has_a_class_of_its_neighbours(spark):
    _, label, count = trained(spark, alternating(), frequent=20, lookup=30, tails=4, classes=3)
    assert len(label) == len(count) == 120
    a, b = ({c for w, c in label.items() if w.startswith(x)} for x in (b"a", b"b"))
    assert len(a) == len(b) == 1 and a != b


def test_flat_vocabulary_is_clustered(spark):
    rows = [(i, " ".join(f"{'ab'[k % 2]}{k // 2}xyz" for k in range(120))) for i in range(40)]  # all counts equal
    model, label, _ = trained(spark, rows, frequent=20, lookup=30, tails=4, classes=3)
    assert len(model.items.index) == 20 and len(label) == 120


def test_word_probabilities_sum_to_one(spark):
    model, label, count = trained(spark, alternating(60), frequent=20, lookup=30, tails=4, classes=5)
    for before in range(len(model.move)):
        total = math.exp(model.move[before, 0] + model.emit[0])
        total += sum(math.exp(model.move[before, c]) * count[w] / model.mass[c] for w, c in label.items())
        total += sum(math.exp(model.move[before, c]) / model.mass[c] for c in model.unseen)
        assert math.isclose(total, 1, rel_tol=1e-9)


def test_scores_follow_the_classes(spark):
    rows = [*alternating(), (1000, "a1xyz b1xyz a2xyz b2xyz"), (1001, "a1xyz a2xyz b1xyz b2xyz")]
    got = {r["doc_id"]: r["score"] for r in brown_lm.score_corpus(
        edge_docs(spark, rows).repartition(3), frequent=20, lookup=30, tails=4, classes=3).collect()}
    assert got[1000] > got[1001] + 1 and np.isfinite(list(got.values())).all()


@pytest.mark.parametrize("paired", [brown_lm.PAIRED, 10])
def test_neighbour_counts_equal_brute_force(spark, paired, monkeypatch):
    monkeypatch.setattr(brown_lm, "PAIRED", paired)
    rows = [*alternating(50), (900, None), (901, ""), (902, "solo"), (903, "solo solo " + "x" * 200)]
    items = brown_lm.Items(sorted({b"a1xyz", b"b2xyz"}), 4)
    label = np.arange(items.n) % 3
    want = Counter()
    for _, t in rows:
        words = (t or "").lower().encode().split()
        own = [0, *items.of(words), 0]
        for k, w in enumerate(words, 1):
            if own[k] >= items.first_tail:
                want[w, int(label[own[k - 1]])] += 1
                want[w, 3 + int(label[own[k + 1]])] += 1
    docs = keyed(edge_docs(spark, rows)).select("doc_id", "text").repartition(3)
    near = brown_lm._neighbours(docs, spark.sparkContext.broadcast((items, label)), 3)
    batches = near.sort("word").toArrow().to_batches(max_chunksize=3)
    got = {}
    for words, sides in brown_lm._word_runs(iter(batches), 3):
        for w, side in zip(words.to_pylist(), sides, strict=True):
            assert w not in {x for x, _ in got}
            got |= {(w, c): int(n) for c, n in enumerate(side) if n}
    assert got == want


def test_a_frequent_long_word_is_looked_up_by_its_digest(spark):
    line = "=" * 200
    rows = [(i, f"{line} w{i % 7} {'y' * 100}{i}") for i in range(80)]
    model, label, count = trained(spark, rows, frequent=3, lookup=4, tails=4, classes=3)
    assert model.lookup[brown_lm.shown(line.encode())] == count[brown_lm.shown(line.encode())] > 60
    _, rare = brown_lm.train(keyed(edge_docs(spark, rows)).select("doc_id", "text"), frequent=3, lookup=4, tails=4, classes=3)
    assert rare.where(F.col("n") > 1).count() <= 7 and rare.where(F.length("word") == 200).count() == 0
    got = {r["doc_id"]: (r["n_known"], r["n_tokens"]) for r in brown_lm.score_corpus(edge_docs(spark, rows), frequent=3, lookup=4, tails=4, classes=3).collect()}
    assert all(n in (t, t - 1) for n, t in got.values())


def test_rows_are_scored_together_as_each_alone(spark, monkeypatch):
    # op8_brown_lm: sequences were unpacked and scored by a Python loop over rows and lists
    assert not hasattr(brown_lm, "_classed")
    rows = [*alternating(60), (2000, ""), (2001, None), (2002, "newword a1xyz newword other"), (2003, " \t"), (2004, "b1xyz")]
    docs = edge_docs(spark, rows).repartition(3)

    def scores():
        got = brown_lm.score_corpus(docs, frequent=10, lookup=15, tails=4, classes=3).collect()
        return {r["doc_id"]: (r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in got}

    together = scores()
    # workers import the package anew: a run of one row each is asked for by the rows themselves
    model, rare = brown_lm.train(keyed(docs).where(remainder("doc_id", 7) != 2), frequent=10, lookup=15, tails=4, classes=3)
    sequences = brown_lm._sequences(keyed(docs).withColumn("held_out", F.lit(False)), model, rare).toArrow().combine_chunks().to_batches()[0]
    whole = brown_lm._Classed(sequences)
    for i, (start, last) in enumerate(zip(whole.starts, whole.last, strict=True)):
        one = brown_lm._Classed(sequences.slice(i, 1))
        assert (one.classes == whole.classes[start:last + 1]).all() and one.classes[0] == one.classes[-1] == 0
        assert (one.n == whole.n[whole.row == i]).all() and (one.times == whole.times[whole.row == i]).all()
        log_p = model.move[one.classes[:-1], one.classes[1:]].sum() - np.log(model.mass)[one.classes[1:-1]].sum() + model.emit[0]
        log_p += (one.times[one.n > 0] * np.log(one.n[one.n > 0])).sum() + sequences.column("logs")[i].as_py()
        n_tokens, n_known, _, score = together[sequences.column("doc_id")[i].as_py()]
        assert math.isclose(score, log_p / math.log(10), rel_tol=1e-9) and n_tokens == len(one.classes) - 1
        assert n_known == sequences.column("n_known")[i].as_py() + one.times[one.n > 0].sum()
    monkeypatch.setattr(brown_lm, "RUN", 5)
    runs = list(brown_lm._runs([sequences]))
    assert sum(b.num_rows for b, _ in runs) == sequences.num_rows and len(runs) > 10
