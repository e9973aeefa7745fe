"""Toxicity (operator 6) by weak supervision.

1. Voters. Terms - whole words, and beginnings of words, which catch forms not seen before -
   that separate the toxic from the other training labels make up the lexicon, counted once for
   equal texts. Each of the ``TERMS`` that tell most votes toxic on a text that has it. Pattern
   voters look at how strong all of a text's terms are together, these and all others, and how
   thinly they are spread, and vote either way; all others abstain.
2. Label model. A generative model of the votes - a hidden class, and for each voter its
   chances to vote either way in either class - is fitted by expectation-maximisation on a
   bounded sample of training rows, anchored by their labels. Voters that agree beyond what
   the class explains are correlated; each voter's evidence is divided by how many it repeats.
3. A linear classifier over the voters' signals is fitted to the posterior labels, calibrated on the
   sample's labels, and scores every whole text in one map.

The texts scored are whole, and terms and contexts are counted over all labelled training rows;
only the rows that steps 2 and 3 are fitted on are a sample, of ``SAMPLE`` distinct labelled texts at most. Labels, language, source and id are never inputs of a score.

Defined results: null and empty texts have no terms; without a toxic training row there is no
lexicon and every score is 0; repeated rows and ids are scored each; other columns stay behind.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airfill.llm.rule_ensemble import training_labels
from airfill.llm.runtime import batch_of, keyed, map_arrow, remainder, slices
from airfill.session import written

SAMPLE = 20_000
#: Terms with a voter of their own; the lengths of word beginnings; the least toxic texts and contexts of a term.
TERMS, BEGINNINGS, SUPPORT = 96, (4, 5, 6, 7), 5
#: Candidates that tasks hold at most; more meet their contexts by a join.
HELD = 20_000
#: Log odds a term needs, or the share of what it could have among few clean texts; the penalty of the linear classifier.
ODDS, REACHED, RIDGE = 4.5, 0.75, 1e-3
#: Bytes of a row of digests, about, and of digests that are broadcast at most.
ROW_BYTES, BROADCAST_BYTES = 128, 64 << 20
PATTERNS = ("none", "faint", "some", "strong", "thin")
#: Summed log odds of a text's words that are faint, or strong; words a term word is thin among.
FAINT, STRONG, THIN = 6.0, 11.0, 250
_SIGNS = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 32)


def terms(text: bytes) -> list[bytes]:
    """Lower-case words without ASCII signs."""
    return text.decode("utf-8").lower().encode().translate(_SIGNS).split()


def beginnings(words) -> set[bytes]:
    """First characters of longer words, marked with a star."""
    out = set()
    for w in words:
        if len(w) > 4:
            s = w.decode()
            out.update(s[:k].encode() + b"*" for k in BEGINNINGS if len(s) > k)
    return out


def term_counts(train: DataFrame) -> DataFrame:
    """(term, toxic, clean): in how many texts of each label a term is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[float]] = defaultdict(lambda: [0.0, 0.0])

        def out() -> pa.RecordBatch:
            return batch_of(term=pa.array(list(held), pa.binary()), toxic=pa.array([v[1] for v in held.values()], pa.float64()),
                            clean=pa.array([v[0] for v in held.values()], pa.float64()))

        for batch, texts in slices(batches):
            for t, label, weight in zip(texts, *(batch.column(c).to_pylist() for c in ("label", "weight")), strict=True):
                words = set(terms(t))
                for w in words | beginnings(words):
                    held[w][int(label > 0)] += weight
            if len(held) > 300_000:
                yield out()
                held.clear()
        if held:
            yield out()

    if "weight" not in train.columns:
        train = train.withColumn("weight", F.lit(1.0))
    return map_arrow(train, run, "term binary, toxic double, clean double").groupBy("term").agg(
        F.round(F.sum("toxic")).cast("long").alias("toxic"), F.round(F.sum("clean")).cast("long").alias("clean"))


def odds(n_toxic: int, n_clean: int):
    """Log odds of a row of ``term_counts``."""
    return (F.log((F.col("toxic") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (n_clean + 1.0)))


def distinct_texts(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, digest, label, weight) of the labelled ``rows``, each text once for a label; ``weight`` is one over
    how many rows are that text under that id. Only ids and digests are grouped and written."""
    marks = (rows.join(labels, "doc_id").select("doc_id", F.sha2("text", 256).alias("digest"), "label")
                 .groupBy("digest", "label", "doc_id").agg(F.count(F.lit(1)).alias("n")))
    first = F.min(F.struct("doc_id", "n")).alias("first")
    return written(marks.groupBy("digest", "label").agg(first).select(
        F.col("first.doc_id").alias("doc_id"), "digest", "label", (1.0 / F.col("first.n")).alias("weight")), "toxic-digests")


def texts_of(rows: DataFrame, chosen: DataFrame, n: int) -> DataFrame:
    """The texts that ``chosen``, ``n`` rows of ``distinct_texts``, name, read where they lie: as long as the
    digests are small they go to the texts, and only beyond that do texts move."""
    if n * ROW_BYTES <= BROADCAST_BYTES:
        chosen = F.broadcast(chosen)
    return rows.join(chosen, "doc_id").where(F.sha2("text", 256) == F.col("digest")).drop("digest")


def contexts(train: DataFrame, candidates: DataFrame, held: int = HELD) -> DataFrame:
    """(term, odds, n): how many different words stand before each of the ``candidates`` (term, odds)
    in toxic texts. A term of one text's many versions stands in few contexts. Up to ``held``
    candidates are looked for in the task, more by a join."""
    some = candidates.limit(held + 1).select("term").collect()
    known = (train.sparkSession.sparkContext.broadcast(frozenset(bytes(r["term"]) for r in some)) if len(some) <= held else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            met: set[tuple[bytes, bytes]] = set()
            for t, label in zip(texts, batch.column("label").to_pylist(), strict=True):
                if label > 0:
                    words = terms(t)
                    found = {w: {w} | beginnings({w}) for w in set(words)}
                    if known is not None:
                        found = {w: f & known.value for w, f in found.items()}
                    met.update((c, before) for before, w in zip([b"", *words], words, strict=False) for c in found[w])
            yield batch_of(term=pa.array([x for x, _ in met], pa.binary()), before=pa.array([x for _, x in met], pa.binary()))

    n = map_arrow(train, run, "term binary, before binary").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return candidates.join(n, "term")


def lexicon(train: DataFrame, n_toxic: int, n_clean: int, held: int = HELD) -> dict[bytes, float]:
    """Every term with high log odds in many contexts with its log odds, those that tell most of
    the label first. What is high and many follows the numbers of texts: few clean texts bound the odds
    that a term can have, few toxic ones its support."""
    score = odds(n_toxic, n_clean)
    least = min(ODDS, REACHED * math.log(2 * (n_clean + 1)))
    support = max(2, min(SUPPORT, n_toxic // 4))
    told = written(term_counts(train).where((F.col("toxic") >= support) & (score >= least)).select("term", score.alias("odds")),
                   "toxic-terms")
    found = contexts(train, told, held).where(F.col("n") >= support).collect()
    return {bytes(r["term"]): r["odds"] for r in sorted(found, key=lambda r: (-r["n"] * r["odds"], bytes(r["term"])))}


class Voters:
    """Signals and votes of texts: one column for each of the first ``most`` terms, then the patterns,
    which look at all terms."""

    def __init__(self, lexicon: dict[bytes, float], most: int = TERMS):
        self.odds = lexicon
        self.column = {t: i for i, t in enumerate(sorted(list(lexicon)[:most]))}
        self.n_terms, self.n = len(self.column), len(self.column) + len(PATTERNS)

    def signals(self, text: bytes) -> list[int]:
        """The signals that are on: terms, then how strong their words are together, and
        whether they are few for the text's length."""
        words = terms(text)
        on, strength, n = set(), 0.0, 0
        for w in set(words):
            own = [t for t in (w, *beginnings((w,))) if t in self.odds]
            if own:
                on.update(self.column[t] for t in own if t in self.column)
                strength += max(self.odds[t] for t in own)
                n += 1
        level = 0 if not n else 1 if strength < FAINT else 2 if strength < STRONG else 3
        return [*on, self.n_terms + level, *([self.n_terms + 4] if n and n * THIN < len(words) else [])]

    def votes(self, signals: np.ndarray) -> np.ndarray:
        """1 toxic, -1 clean, 0 abstains. "none" and "thin" vote clean, all others toxic."""
        v = signals.astype(np.int8).copy()
        v[:, [self.n_terms, self.n_terms + 4]] *= -1
        return v


def label_model(votes: np.ndarray, gold: np.ndarray, trust: float = 0.5, rounds: int = 40) -> np.ndarray:
    """Posterior chance of class toxic for each row of ``votes``. The voters' accuracies are
    estimated from the posteriors, held in place by the training labels ``gold`` with weight
    ``trust``; the posteriors themselves see votes only."""
    n, m = votes.shape
    balance = min(max(float(gold.mean()), 0.01), 0.99)
    posterior = np.where((votes == 1).any(1), 0.9, 0.02)
    share = np.ones(m)
    for step in range(rounds):
        log_odds = np.full(n, np.log(balance / (1 - balance)))
        belief = (1 - trust) * posterior + trust * gold
        total = belief.sum(), (1 - belief).sum()
        for v in (-1, 0, 1):
            seen = (votes == v).astype(float)
            toxic = (seen.T @ belief + 0.3) / (total[0] + 0.9)
            clean = (seen.T @ (1 - belief) + 0.3) / (total[1] + 0.9)
            if v:  # an abstention tells nothing by itself
                log_odds += seen @ (share * (np.log(toxic) - np.log(clean)))
        new = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
        done = np.abs(new - posterior).max() < 1e-4
        posterior = new
        if step == 3 or done:
            share = evidence(votes, posterior)
        if done and step > 4:
            break
    return posterior


def evidence(votes: np.ndarray, posterior: np.ndarray) -> np.ndarray:
    """Each voter's share of evidence: one over the voters it repeats, by the correlation that
    is left given the class."""
    v = votes.astype(float)
    cov = np.zeros((v.shape[1],) * 2)
    for w in (posterior, 1 - posterior):
        mean = (w @ v) / max(w.sum(), 1e-9)
        d = v - mean
        cov += d.T @ (d * w[:, None])
    sd = np.sqrt(np.maximum(cov.diagonal(), 1e-9))
    r = np.clip(cov / sd[:, None] / sd[None, :], 0, 1)
    np.fill_diagonal(r, 0)
    return 1 / (1 + (r * r).sum(1))


def linear(signals: np.ndarray, posterior: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Logistic weights (last: intercept) for the posterior labels, by Newton steps."""
    x = np.column_stack([signals.astype(float), np.ones(len(signals))])
    w = np.zeros(x.shape[1])
    ridge = RIDGE * len(x) * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (posterior - p) - ridge @ w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), gradient)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


def calibrated(weights: np.ndarray, signals: np.ndarray, gold: np.ndarray, rounds: int = 30) -> np.ndarray:
    """``weights`` rescaled and shifted so that the scores of the training rows ``gold`` are their labels' chances: a
    logistic fit of two numbers, held near one and zero by one row's worth each."""
    z = np.column_stack([signals.astype(float) @ weights[:-1] + weights[-1], np.ones(len(gold))])
    a = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ a, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.eye(2), z.T @ (gold - p) - (a - [1.0, 0.0]))
        a += np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return weights if a[0] <= 0 else np.append(weights[:-1] * a[0], weights[-1] * a[0] + a[1])


def score(docs: DataFrame, labels: DataFrame, target: str = "toxic", threshold: float = 0.5,
          id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text_col)
    chosen = distinct_texts(rows, training_labels(labels, target))
    n, n_toxic = chosen.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    words = lexicon(texts_of(rows, chosen, n), int(n_toxic), int(n - n_toxic)) if n_toxic else {}
    # the distinct texts with the least digests: a sample that copies and repeated ids can't swell
    train = texts_of(rows, chosen.orderBy("digest", "label").limit(most), min(n, most))
    voters = Voters(words)
    weights = None
    if words:
        shared = spark.sparkContext.broadcast(voters)

        def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in slices(batches):
                yield batch_of(on=pa.array([shared.value.signals(t) for t in texts], pa.list_(pa.int32())),
                               label=batch.column("label"))

        got = map_arrow(train, seen, "on array<int>, label double").toArrow()
        on, gold = got.column("on").to_pylist(), got.column("label").to_numpy()
        signals = np.zeros((len(on), voters.n), np.int8)
        for i, own in enumerate(on):
            signals[i, own] = 1
        weights = calibrated(linear(signals, label_model(voters.votes(signals), gold)), signals, gold)
    model = spark.sparkContext.broadcast((voters, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, w = model.value
        for batch, texts in slices(batches):
            z = np.zeros(len(texts)) if w is None else np.array([w[v.signals(t)].sum() + w[-1] for t in texts])
            s = np.zeros(len(texts)) if w is None else 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield batch_of(doc_id=batch.column("doc_id"), score=pa.array(s))

    return map_arrow(rows, run, "doc_id long, score double").select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
