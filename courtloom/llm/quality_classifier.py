"""Sparse rule ensemble: paths of shallow trees over text statistics, lasso logistic weights, compiled to columns."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtloom.llm.common import FEATURES, rated_sample, stats_of
from courtloom.session import cut_lineage

Test = tuple[str, str, float]


@dataclass(frozen=True)
class RuleEnsemble:
    """score = logistic(bias + sum of the weights of the rules that hold)."""

    bias: float
    rules: tuple[tuple[tuple[Test, ...], float], ...]

    def score(self, stats: str) -> Column:
        total = F.lit(self.bias)
        for tests, weight in self.rules:
            total = total + F.when(holds(tests, stats), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def holds(tests: tuple[Test, ...], stats: str) -> Column:
    out = F.lit(True)
    for name, side, cut in tests:
        value = F.col(f"{stats}.{name}").cast("double")
        out = out & ((value <= F.lit(cut)) if side == "<=" else (value > F.lit(cut)))
    return out


def _tightest(tests: tuple[Test, ...]) -> tuple[Test, ...]:
    """One bound for each statistic and side, in a fixed order, so that equal paths are one rule."""
    kept: dict[tuple[str, str], float] = {}
    for name, side, cut in tests:
        old = kept.get((name, side), cut)
        kept[name, side] = min(old, cut) if side == "<=" else max(old, cut)
    return tuple(sorted((name, side, cut) for (name, side), cut in kept.items()))


def tree_rules(forest) -> list[tuple[Test, ...]]:
    """The path from the root to each other node of each tree, without repeats, in a fixed order."""
    found: set[tuple[Test, ...]] = set()
    for tree in forest.trees:
        stack: list[tuple] = [(tree._call_java("rootNode"), ())]
        while stack:
            node, path = stack.pop()
            if path:
                found.add(_tightest(path))
            if node.getClass().getSimpleName() == "InternalNode":
                split = node.split()
                name, cut = FEATURES[split.featureIndex()], float(split.threshold())
                stack += [(node.leftChild(), (*path, (name, "<=", cut))), (node.rightChild(), (*path, (name, ">", cut)))]
    return sorted(found)


def fit_quality_ensemble(narrations: DataFrame, ratings: DataFrame, label: str = "quality", bound: int = 20_000, trees: int = 12,
                         depth: int = 3, lasso: float = 0.002) -> RuleEnsemble:
    """Learn from at most about `bound` rated narrations. Without ratings the score is 0.5, with one class its share,
    smoothed by one row of each class."""
    rows = rated_sample(narrations, ratings, label, bound).select("job_id", (F.col("label") > 0).cast("double").alias("label"), stats_of("summary").alias("s"))
    rows = cut_lineage(rows.withColumn("features", array_to_vector(F.array(*[F.col(f"s.{n}").cast("double") for n in FEATURES]))))
    n, good = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if good in (0, n):
        return RuleEnsemble(math.log((good + 1) / (n - good + 1)), ())
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="onethird", seed=7, maxBins=64, minInstancesPerNode=5).fit(rows)
    rules = tree_rules(forest)
    if not rules:
        return RuleEnsemble(math.log((good + 1) / (n - good + 1)), ())
    fired = rows.select("label", array_to_vector(F.array(*[holds(r, "s").cast("double") for r in rules])).alias("features"))
    model = LogisticRegression(regParam=lasso, elasticNetParam=1.0, standardization=False, maxIter=60, tol=1e-5).fit(fired)
    weights = [float(w) for w in model.coefficients.toArray()]
    return RuleEnsemble(float(model.intercept), tuple((r, w) for r, w in zip(rules, weights, strict=True) if w))


def score_quality(narrations: DataFrame, ensemble: RuleEnsemble) -> DataFrame:
    """The columns of `narrations`, `stats` and `quality_score` (0 to 1, higher: better). A null or empty summary is
    scored as a text of zeros; every row, repeated or not, is scored; clashing columns of these names are replaced."""
    return narrations.withColumn("stats", stats_of("summary")).withColumn("quality_score", ensemble.score("stats"))
