"""Quality classifier: a sparse ensemble of rules over text statistics.

Every text is measured by built-in Spark functions. A random forest on a bounded sample of labelled rows proposes rules:
each path from a root to a node is a conjunction of thresholds. A logistic regression with an L1 penalty weighs them, most
weights become 0, and the rest is compiled into one Column expression, so scoring is a projection of the scan.

Defined cases: null text counts as empty; a text without words has all statistics 0 and is scored like any other; rows
with the same text are scored alike; without labels of both kinds every score is the share of label 1 (0.5 without labels);
texts of any length are measured whole; an empty table gives an empty result; other columns pass through whatever their
names (``scored`` replaces a column named ``score`` or ``predicted``, ``accepted`` replaces none).
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blank_words, boxed, held_out, in_training_part, table, unboxed

#: Labelled rows that a fit reads at most, those with the smallest hash of the id: far more than the rules need.
MAX_LABELLED = 20_000
#: Size of the forest, and the penalty that makes the weights sparse.
TREES, DEPTH, PENALTY = 24, 3, 0.002


def _kept(text: Column, pattern: str) -> Column:
    """Characters that are left when the pattern is taken out."""
    return F.length(F.regexp_replace(text, pattern, "")).cast("double")


def statistics(docs: DataFrame, text: str = "text") -> tuple[DataFrame, list[str]]:
    """The rows with one double column for each statistic, and the names of those columns."""
    body = F.coalesce(F.col(text), F.lit(""))
    split = docs.withColumn("_words", blank_words(F.col(text))).withColumn("_lines", F.split(body, "\n"))
    n, chars, lines = F.size("_words"), F.greatest(F.length(body), F.lit(1)), F.size("_lines")
    per_word = lambda c: F.when(n == 0, F.lit(0.0)).otherwise(c.cast("double") / n)
    pairs = F.zip_with(F.slice("_words", 1, F.greatest(n - 1, F.lit(0))), F.slice("_words", 2, F.greatest(n - 1, F.lit(0))), lambda a, b: a == b)
    found = {
        "s_log_words": F.log1p(n.cast("double")),
        "s_word_length": per_word(chars),
        "s_distinct": per_word(F.size(F.array_distinct("_words"))),
        "s_stutter": per_word(F.size(F.filter(pairs, lambda same: same))),
        "s_upper": _kept(body, r"[^\p{Lu}]+") / chars,
        "s_digit": _kept(body, r"[^0-9]+") / chars,
        "s_symbol": _kept(body, r"[\p{L}\p{N}\s.,;:'()?-]+") / chars,
        "s_letters": _kept(body, r"[^\p{L}]+") / chars,
        "s_bars": per_word(_kept(body, r"[^|]+")),
        "s_bangs": per_word(_kept(body, r"[^!]+")),
        "s_sentences": per_word(F.regexp_count(body, F.lit(r"[.!?](?:\s|$)"))),
        "s_lines": per_word(lines),
        "s_same_lines": 1 - F.size(F.array_distinct("_lines")) / lines.cast("double"),
    }
    return split.withColumns(found).drop("_words", "_lines"), list(found)


@dataclass(frozen=True)
class Rule:
    """A conjunction: for each statistic a lower (exclusive) and an upper (inclusive) bound."""

    bounds: tuple[tuple[str, float, float], ...]

    def holds(self) -> Column:
        out = F.lit(True)
        for name, low, high in self.bounds:
            out = out & (F.col(name) > low if low > -math.inf else F.lit(True)) & (F.col(name) <= high if high < math.inf else F.lit(True))
        return out


@dataclass(frozen=True)
class RuleModel:
    """Rules with weights, an intercept, and the log-odds they add up to."""

    intercept: float
    weighted: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """Probability of label 1 as a Column over the statistics."""
        odds = F.lit(self.intercept)
        for rule, weight in self.weighted:
            odds = odds + F.when(rule.holds(), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-odds))


def paths(description: str, names: list[str]) -> set[Rule]:
    """The conjunction of every node below the root, from a tree's printed form."""
    rules, trail = set(), []
    for depth, feature, sign, bound in re.findall(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) ([^)]+)\)", description, re.M):
        trail = [t for t in trail if t[0] < len(depth)] + [(len(depth), names[int(feature)], sign, float(bound))]
        bounds: dict[str, list[float]] = {}
        for _, name, s, b in trail:
            low, high = bounds.setdefault(name, [-math.inf, math.inf])
            bounds[name] = [max(low, b) if s == ">" else low, min(high, b) if s == "<=" else high]
        rules.add(Rule(tuple(sorted((n, lo, hi) for n, (lo, hi) in bounds.items()))))
    return rules


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = MAX_LABELLED, doc_id: str = "doc_id", text: str = "text") -> RuleModel:
    """Rules for ``label`` from the labelled training part of the documents."""
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & in_training_part(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("double").alias("_y"))
    chosen = F.broadcast(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))  # bounded by the parameter
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")).join(chosen, "doc_id")
    measured, names = statistics(read.select("_text", "_y"), "_text")
    # numbers only; ids may repeat, hence a bound on rows too; by hash, so that one parallel pass finds the same rows each time
    rows = measured.select("_y", *names).orderBy(F.xxhash64("_y", *names)).limit(2 * max_labelled).toPandas()
    positive = float(rows["_y"].mean()) if len(rows) else 0.5
    if not len(rows) or not 0 < positive < 1:
        return RuleModel(math.log((positive + 1e-3) / (1 - positive + 1e-3)), ())
    rows = rows.sort_values(list(rows.columns), kind="stable")  # the same fit, however the rows came
    sample = docs.sparkSession.createDataFrame(rows).coalesce(1).select("_y", array_to_vector(F.array(*names)).alias("features"))
    forest = RandomForestClassifier(labelCol="_y", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="onethird", subsamplingRate=0.6, maxBins=64, seed=17).fit(sample)
    rules = sorted(set().union(*(paths(t.toDebugString, names) for t in forest.trees)), key=lambda r: r.bounds)
    if not rules:
        return RuleModel(math.log(positive / (1 - positive)), ())
    fired = np.column_stack([np.logical_and.reduce([(rows[n] > low) & (rows[n] <= high) for n, low, high in r.bounds]) for r in rules])
    intercept, weights = lasso(fired.astype(np.float64), rows["_y"].to_numpy(np.float64), PENALTY)
    return RuleModel(intercept, tuple((r, float(w)) for r, w in zip(rules, weights) if w))


def lasso(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 2000, tolerance: float = 1e-5) -> tuple[float, np.ndarray]:
    """Intercept and weights of a logistic regression with an L1 penalty on standardised columns, by accelerated proximal steps."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    z = (x - mean) / np.where(scale > 0, scale, 1.0)
    step = 4 / (np.linalg.eigvalsh(z.T @ z / len(z))[-1] + 1)
    w = ahead = np.zeros(z.shape[1])
    b = ahead_b = math.log(y.mean() / (1 - y.mean()))
    t = 1.0
    for _ in range(steps):
        off = 1 / (1 + np.exp(-np.clip(z @ ahead + ahead_b, -30, 30))) - y
        moved = ahead - step * (z.T @ off / len(z))
        new, new_b = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0), ahead_b - step * off.mean()
        if (ahead - new) @ (new - w) + (ahead_b - new_b) * (new_b - b) > 0:  # past the valley: momentum starts anew
            t = 1.0
        following = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_b = new + (t - 1) / following * (new - w), new_b + (t - 1) / following * (new_b - b)
        change = max(np.abs(new - w).max(), abs(new_b - b))
        w, b, t = new, new_b, following
        if change < tolerance:
            break
    weights = np.where(scale > 0, w / np.where(scale > 0, scale, 1.0), 0.0)
    return float(b - weights @ mean), weights


def _scored(docs: DataFrame, model: RuleModel, text: str) -> DataFrame:
    measured, _ = statistics(boxed(docs, F.col(text).alias("_text")), "_text")
    # a generated column: a filter on it is not pushed below, where every rule would measure the text again
    return measured.withColumn("_score", F.explode(F.array(model.score())))


def scored(docs: DataFrame, model: RuleModel, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows with ``score`` and ``predicted``."""
    return unboxed(_scored(docs, model, text), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: RuleModel, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows that score at least the threshold, as they are."""
    return unboxed(_scored(docs, model, text).where(F.col("_score") >= threshold))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op1_quality``: the score of every document."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return scored(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
