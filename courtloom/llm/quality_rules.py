"""Learned decision lists: sequential covering over text statistics, emitted as ordered Spark conditions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtloom.llm.common import FEATURES, rated_sample, stats_of

#: Fixed values of the base rule.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, '<=' or '>', threshold) that ends in `verdict` (True: keep)."""

    tests: tuple[tuple[str, str, float], ...]
    verdict: bool

    def condition(self, stats: str) -> Column:
        out = F.lit(True)
        for name, side, cut in self.tests:
            value = F.col(f"{stats}.{name}").cast("double")
            out = out & ((value <= F.lit(cut)) if side == "<=" else (value > F.lit(cut)))
        return out


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[Rule, ...]
    default: bool

    def verdict(self, stats: str) -> Column:
        """The first rule that holds decides; ordered `CASE WHEN` over the fields of the struct column `stats`."""
        out = None
        for rule in self.rules:
            out = F.when(rule.condition(stats), F.lit(rule.verdict)) if out is None else out.when(rule.condition(stats), F.lit(rule.verdict))
        return F.lit(self.default) if out is None else out.otherwise(F.lit(self.default))


def _holds(x: np.ndarray, tests: list[tuple[int, str, float]]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, side, cut in tests:
        out &= (x[:, j] <= cut) if side == "<=" else (x[:, j] > cut)
    return out


def _best_test(x: np.ndarray, y: np.ndarray) -> tuple[float, tuple[int, str, float] | None]:
    """The threshold with the largest information gain for the true rows of `y`, among distinct values in `x`."""
    n, pos = len(y), int(y.sum())
    best: tuple[float, tuple[int, str, float] | None] = (0.0, None)
    base = np.log2(pos / n)
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v, hits = x[order, j], np.cumsum(y[order])
        edge = np.flatnonzero(v[1:] > v[:-1])
        if not len(edge):
            continue
        left, left_pos = edge + 1.0, hits[edge].astype(float)
        for side, total, good in (("<=", left, left_pos), (">", n - left, pos - left_pos)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(good > 0, good * (np.log2(good / total) - base), 0.0)
            k = int(np.argmax(gain))
            if gain[k] > best[0] + 1e-9:
                best = float(gain[k]), (j, side, float((v[edge[k]] + v[edge[k] + 1]) / 2))
    return best


def learn_list(x: np.ndarray, keep: np.ndarray, names: tuple[str, ...] = FEATURES, min_precision: float = 0.9, min_cover: int = 10,
               max_tests: int = 4, max_rules: int = 16) -> DecisionList:
    """Sequential covering for the rejected rows (`keep` false).

    Two thirds of the rows (by position) grow a conjunction by information gain; the rest prune it: trailing tests go
    while the worth (p - n) / (p + n) does not fall. A rule enters the list if it rejects at least `min_cover` rows
    with `min_precision` on all remaining rows, which it then takes away. Without rows, or with one class, the list is
    empty and keeps all.
    """
    rules: list[Rule] = []
    x, bad = np.asarray(x, float), ~np.asarray(keep, bool)
    grow_side = np.arange(len(bad)) % 3 != 0
    while len(rules) < max_rules and bad.sum() >= min_cover and not bad.all():
        rows, tests = grow_side.copy(), []
        while len(tests) < max_tests and bad[rows].any() and not bad[rows].all():
            gain, test = _best_test(x[rows], bad[rows])
            if test is None:
                break
            tests.append(test)
            rows = grow_side & _holds(x, tests)
        held = ~grow_side

        def worth(some: list) -> float:
            got = held & _holds(x, some)
            p, n = int(bad[got].sum()), int((~bad[got]).sum())
            return (p - n) / (p + n) if p + n else -1.0

        while len(tests) > 1 and worth(tests[:-1]) >= worth(tests):
            tests.pop()
        got = _holds(x, tests)
        if not tests or bad[got].sum() < min_cover or bad[got].mean() < min_precision:
            break
        rules.append(Rule(tuple((names[j], side, cut) for j, side, cut in tests), False))
        x, bad, grow_side = x[~got], bad[~got], grow_side[~got]
    return DecisionList(tuple(rules), True)


def fit_quality_rules(narrations: DataFrame, ratings: DataFrame, label: str = "quality", bound: int = 20_000) -> DecisionList:
    """A decision list from at most about `bound` rated narrations (rating 1: keep); only that sample reaches the driver."""
    rows = rated_sample(narrations, ratings, label, bound).select("job_id", "label", stats_of("summary").alias("s"))
    flat = rows.select("job_id", "label", *[F.col(f"s.{n}").cast("double").alias(n) for n in FEATURES]).toPandas()
    flat = flat.sort_values(["job_id", *FEATURES], kind="stable")
    return learn_list(flat[list(FEATURES)].to_numpy(), flat["label"].to_numpy() == 1)


def judge_quality(narrations: DataFrame, rules: DecisionList) -> DataFrame:
    """Statistics and verdict of every narration: the columns of `narrations`, `stats` (struct), `base_failed`, `kept`.

    A narration fails the base rule with fewer than 50 words or if over half of its words lie in repeated three-word
    windows; else the list decides. A null or empty summary has no word and fails. Clashing columns named like the
    outcome are replaced; repeated rows are judged each.
    """
    out = narrations.withColumn("stats", stats_of("summary")).withColumn("base_failed", base_failed("stats"))
    return out.withColumn("kept", ~F.col("base_failed") & rules.verdict("stats"))


def base_failed(stats: str) -> Column:
    words = F.col(f"{stats}.n_words")
    return (words < MIN_WORDS) | (100 * F.col(f"{stats}.n_repeat_words") > MAX_REPEAT_PERCENT * words)


def kept_narrations(narrations: DataFrame, rules: DecisionList) -> DataFrame:
    """The narrations that `judge_quality` keeps, all columns as they are."""
    mark = "__stats"
    while mark in narrations.columns:
        mark += "_"
    return narrations.withColumn(mark, stats_of("summary")).filter(~base_failed(mark) & rules.verdict(mark)).drop(mark)
