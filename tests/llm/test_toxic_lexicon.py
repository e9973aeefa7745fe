import random

import numpy as np

from airfill.llm import weak_toxicity
from airfill.llm.runtime import keyed
from tests.llm.helpers import edge_docs

TERMS = [f"vil{c}" for c in "abcdef"]  # too short for beginnings that they would share


def corpus(toxic=60, clean=540):
    """Toxic texts, each with one of six terms, and clean ones, of the same other words; labels."""
    rng = random.Random(6)
    rows = []
    for i in range(toxic + clean):
        words = [f"{rng.choice('bcdfg')}{rng.randrange(40)}" for _ in range(30)]
        if i < toxic:
            words.insert(rng.randrange(30), TERMS[i % 6])
        rows.append((i, " ".join(words)))
    return rows, [(i, 1, int(i < toxic)) for i, _ in rows]


def scored(spark, rows, labels, **parameters):
    got = weak_toxicity.score(edge_docs(spark, rows).repartition(3),
                              spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), **parameters).collect()
    return {r["doc_id"]: r["score"] for r in got}


def apart(score, toxic):
    """The share of pairs of a toxic and a clean row that the score puts in order."""
    t, c = (np.array([s for i, s in score.items() if toxic[i] == k]) for k in (1, 0))
    return (t[:, None] > c[None, :]).mean()


def test_terms_are_counted_beyond_the_sample(spark):
    rows, labels = corpus()
    assert apart(scored(spark, rows, labels, most=150), {i: t for i, _, t in labels}) > 0.95


def test_copies_of_one_text_do_not_crowd_out_terms(spark):
    rows, labels = corpus()
    crowd = " ".join(f"{k:03}{k:03}spam" for k in range(450))  # words and beginnings that no clean text has
    rows += [(1000 + k, crowd) for k in range(300)]
    labels += [(1000 + k, 1, 1) for k in range(300)]
    score = scored(spark, rows, labels)
    assert apart({i: s for i, s in score.items() if i < 1000}, {i: t for i, _, t in labels}) > 0.95


def test_every_term_that_passes_is_kept_by_lookup_and_by_join(spark):
    rng = random.Random(8)
    rows = [(i, f"{rng.choice('bcd')}{rng.randrange(20)} vile{'abcdefghij'[i % 150 // 15]}{i % 15:02}", 1.0) for i in range(1500)]
    rows += [(2000 + i, f"{rng.choice('bcd')}{rng.randrange(20)} fine", 0.0) for i in range(8000)]
    train = spark.createDataFrame(rows, "doc_id long, text string, label double")
    words = weak_toxicity.lexicon(train, 1500, 8000)
    assert {f"vile{c}{k:02}".encode() for c in "abcdefghij" for k in range(15)} <= set(words) and len(words) > weak_toxicity.TERMS
    assert weak_toxicity.lexicon(train, 1500, 8000, held=10) == words
    voters = weak_toxicity.Voters(words)
    own = {w for t in list(words)[weak_toxicity.TERMS:] for w in [t] if not t.endswith(b"*")}
    assert own and all(voters.n_terms not in voters.signals(w) for w in own)  # "none" is off: the pattern voters see it


def test_few_labels_and_one_separating_term(spark):
    rng = random.Random(3)
    for clean in (40, 400):
        rows, labels = [], []
        for i in range(40 + clean):
            words = [f"{rng.choice('bcdfg')}{rng.randrange(40)}" for _ in range(12)]
            if i < 40:
                words.insert(rng.randrange(12), "vilf")
            rows.append((i, " ".join(words)))
            labels.append((i, 1, int(i < 40)))
        score = scored(spark, rows, labels)
        assert all((score[i] > 0.5) == (i < 40) for i, _ in rows)


def test_counts_are_of_distinct_texts(spark):
    rows = [(1, "vile one"), (1, "vile one"), (2, "VILE one"), (3, "vile one"), (4, "fine two"), (5, "vile two"), (6, None)]
    docs = keyed(edge_docs(spark, rows))
    labels = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 1.0), (4, 0.0), (5, 0.0), (6, 0.0)], "doc_id long, label double")
    chosen = weak_toxicity.distinct_texts(docs, labels)
    for n in (chosen.count(), 10 ** 12):  # digests to the texts, or texts to the digests
        got = {bytes(r["term"]): (r["toxic"], r["clean"]) for r in
               weak_toxicity.term_counts(weak_toxicity.texts_of(docs, chosen, n)).collect()}
        assert got == {b"vile": (2, 1), b"one": (2, 0), b"fine": (0, 1), b"two": (0, 2)}
