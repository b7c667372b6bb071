"""Quality rules and rule ensemble: base rule, learned parts, edge rows, held-out accuracy on the driver's labels."""

import os
import zlib

import numpy as np
import pytest

from courtloom.llm import quality_classifier, quality_rules
from courtloom.llm.queries import as_narrations, op1_quality_classifier, op10_quality_rules, ratings_of
from tests.llm.test_words import plain_stats

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def test_list_learns_conjunctions_and_keeps_the_rest():
    rng = np.random.default_rng(2)
    x = rng.random((3000, 3))
    bad = (x[:, 0] > 0.7) & (x[:, 1] <= 0.4)
    rules = quality_rules.learn_list(x, ~bad, names=("a", "b", "c"))
    assert rules.rules and rules.default
    found = np.zeros(len(x), bool)
    for r in rules.rules:
        found |= np.all([(x[:, "abc".index(n)] <= c) if s == "<=" else (x[:, "abc".index(n)] > c) for n, s, c in r.tests], axis=0)
    assert (found == bad).mean() > 0.99
    assert quality_rules.learn_list(np.zeros((0, 3)), np.zeros(0, bool)).rules == ()
    assert quality_rules.learn_list(x, np.ones(len(x), bool)).rules == ()


def test_edge_rows_are_judged(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(1, None, 9), (2, "", 9), (3, "word " * 60, 9), (4, good, 9), (4, good, 9), (None, "tip in", 9)]
    narrations = spark.createDataFrame(rows, "job_id long, summary string, kept int")
    ratings = spark.createDataFrame([(4, 1), (4, 1), (None, 0), (3, None)], "job_id long, quality int")
    out = quality_rules.judge_quality(narrations, quality_rules.fit_quality_rules(narrations, ratings)).collect()
    assert sorted((str(r.job_id), r.base_failed, r.kept) for r in out) == sorted([("1", True, False), ("2", True, False), ("3", True, False), ("4", False, True), ("4", False, True), ("None", True, False)])
    empty = narrations.limit(0)
    assert quality_rules.judge_quality(empty, quality_rules.fit_quality_rules(empty, ratings.limit(0))).count() == 0
    scored = quality_classifier.score_quality(narrations, quality_classifier.fit_quality_ensemble(narrations, ratings)).collect()
    assert len(scored) == 6 and all(0 <= r.quality_score <= 1 for r in scored)


@needs_data
def test_base_columns_equal_plain_loops(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op10_quality_rules(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        expect = plain_stats(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expect
        assert r.base_failed == (expect[0] < 50 or 100 * expect[4] > 50 * expect[0]) and not (r.base_failed and r.kept)


@needs_data
def test_verdicts_follow_the_labels(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = [r for r in op10_quality_rules(spark, SF).collect() if r.doc_id in labels and not r.base_failed]
    assert sum(r.kept == (labels[r.doc_id] == 1) for r in got) >= 0.97 * len(got)


@needs_data
def test_ensemble_on_held_out_labels(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = op1_quality_classifier(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.95 * len(held) > 0


@needs_data
def test_ensemble_compiles_to_the_rules(spark):
    narrations = as_narrations(spark.read.parquet(f"{SF}/documents.parquet"))
    model = quality_classifier.fit_quality_ensemble(narrations, ratings_of(spark, SF))
    assert model.rules
    for r in quality_classifier.score_quality(narrations, model).select("stats", "quality_score").limit(100).collect():
        z = model.bias + sum(w for tests, w in model.rules if all((r.stats[n] <= c) if s == "<=" else (r.stats[n] > c) for n, s, c in tests))
        assert abs(r.quality_score - 1 / (1 + np.exp(-z))) < 1e-9
