"""Quality classifier (operator 2): a sparse rule ensemble.

Statistics of every whole text are written once. On a bounded sample of labelled rows shallow
trees are grown; every path from a root to a node is a conjunction of conditions on
statistics, and a lasso logistic regression over those rules keeps few of them. What is left
is compiled into one Spark column expression, so scoring is a projection over the statistics.

Defined results: null and empty texts have all statistics 0 and are scored like any other;
labels are one per document (the larger of several), null labels are ignored; without labels
of both kinds every score is the share of good labels (0.5 without any); other columns, also
ones named like a statistic, are left behind; repeated rows and ids are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airfill.llm import textstats
from airfill.llm.runtime import batch_of, keyed, map_arrow, remainder, slices
from airfill.session import written

#: Labelled rows a classifier is fitted on, at most (by hash of the id).
SAMPLE = 20_000
TREES, DEPTH, PENALTY, SEED = 24, 3, 0.002, 7

#: One condition: (statistic, True for "at most" or False for "over", threshold).
Condition = tuple[str, bool, float]
Rule = tuple[Condition, ...]


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, each statistic) of (doc_id, text), written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            x = textstats.statistics(texts)
            yield batch_of(doc_id=batch.column("doc_id"),
                           **{k: pa.array(x[:, i]) for i, k in enumerate(textstats.STATISTICS)})

    return written(map_arrow(docs, run, "doc_id long, " + ", ".join(f"{k} double" for k in textstats.STATISTICS)),
                   "quality-statistics")


def training_labels(labels: DataFrame, target: str, modulus: int = 5, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, label) of the training rows: crc32(id) modulo ``modulus`` isn't 0."""
    return (labels.where(F.col(target).isNotNull() & F.col(id_col).isNotNull() & (remainder(id_col, modulus) != 0))
                  .groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(target).cast("double").alias("label")))


def sampled_labels(labels: DataFrame, target: str, most: int = SAMPLE, modulus: int = 5, id_col: str = "doc_id") -> DataFrame:
    """``training_labels`` thinned by a hash of the id to about ``most`` at the most."""
    rows = training_labels(labels, target, modulus, id_col)
    n = rows.count()
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * most / n))
    return rows


def path_rules(node, names: list[str], above: Rule = ()) -> Iterator[Rule]:
    """The paths to every node below ``node`` (a tree model's node) as rules, one condition per
    statistic and direction."""
    if above:
        yield above
    if node.subtreeDepth() == 0:
        return
    split = node.split()
    name, at = names[split.featureIndex()], float(split.threshold())
    for child, below in ((node.leftChild(), True), (node.rightChild(), False)):
        same = [c for c in above if c[:2] == (name, below)]
        tightest = (min if below else max)([at, *(c[2] for c in same)])
        yield from path_rules(child, names, tuple(sorted({*above} - {*same} | {(name, below, tightest)})))


def condition(rule: Rule) -> Column:
    out = F.lit(True)
    for name, below, at in rule:
        out = out & (F.col(name) <= at if below else F.col(name) > at)
    return out


class RuleEnsemble:
    """Weighted rules; ``column`` is the probability of label 1 as an expression over statistics."""

    def __init__(self, weights: dict[Rule, float], intercept: float):
        self.weights, self.intercept = weights, intercept

    def column(self) -> Column:
        z = F.lit(float(self.intercept))
        for rule, w in sorted(self.weights.items()):
            z = z + F.when(condition(rule), F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def constant(share: float) -> RuleEnsemble:
    import math
    share = min(max(share, 1e-6), 1 - 1e-6)
    return RuleEnsemble({}, math.log(share / (1 - share)))


def fit(train: DataFrame, names: list[str] = textstats.STATISTICS, trees: int = TREES, depth: int = DEPTH,
        penalty: float = PENALTY) -> RuleEnsemble:
    """``train``: (label, statistics), a bounded sample."""
    n, good = train.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not n or not 0 < good < n:
        return constant(good / n if n else 0.5)
    vectors = VectorAssembler(inputCols=list(names), outputCol="vector").transform(train).select("label", "vector")
    forest = RandomForestClassifier(featuresCol="vector", numTrees=trees, maxDepth=depth, seed=SEED, subsamplingRate=0.7,
                                    featureSubsetStrategy="0.4", minInstancesPerNode=5).fit(vectors)
    rules = sorted({r for t in forest._java_obj.trees() for r in path_rules(t.rootNode(), list(names))})
    if not rules:
        return constant(good / n)
    met = train.select("label", *(condition(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)))
    table = written(VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="vector")
                    .transform(met).select("label", "vector"), "quality-rules")
    lasso = LogisticRegression(featuresCol="vector", elasticNetParam=1.0, regParam=penalty, maxIter=60).fit(table)
    weights = {r: float(w) for r, w in zip(rules, lasso.coefficients.toArray(), strict=True) if w}
    return RuleEnsemble(weights, float(lasso.intercept))


def score(docs: DataFrame, labels: DataFrame, target: str = "quality", threshold: float = 0.3,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    stats = statistics(keyed(docs, id_col, text_col))
    train = written(stats.join(sampled_labels(labels, target), "doc_id").repartition(4, "doc_id")
                         .sortWithinPartitions("doc_id", "words").drop("doc_id"), "quality-train")
    p = fit(train).column()
    return (stats.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), p.alias("score"))
                 .withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0)))
