"""The shot model scores every game by a model that has not seen it; its report against plain figures."""

import random

from courtloom.operators import shot_model as M
from courtloom.plans import catalog  # noqa: F401
from courtloom.plans import q_streaming as Q
from courtloom.plans.registry import QUERIES

RAW = "game long, frame long, x1 double, y1 double, score double, pk long, kit string"


def raw_rows(games=3):
    return [(g, i % 7, 10.0 * i, 400.0 - 9.0 * i + g, 0.5 + i % 4 / 8, i, "BW"[i % 2]) for g in range(games) for i in range(40)]


def test_every_game_is_held_out_once(spark, monkeypatch):
    raw = spark.createDataFrame(raw_rows(), RAW)
    monkeypatch.setattr(Q.A, "raw_detections", lambda *_: raw)
    got = {(r.game, r.kit): r for r in QUERIES["evt24_make_miss_model"](spark, "").collect()}
    assert set(got) == {(g, k) for g in range(3) for k in ("B", "W", None)}
    assert all(got[g, None].n == 40 and got[g, "B"].n == got[g, "W"].n == 20 and got[g, "B"].correct + got[g, "W"].correct == got[g, None].correct for g in range(3))


def plain_auc(rows):
    good, bad = [p for p, y in rows if y], [p for p, y in rows if not y]
    return sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad)) if good and bad else None


def test_report_equals_plain_figures(spark):
    rng = random.Random(3)
    rows = [(g, "BW"[i % 2], rng.randrange(2) if g < 3 else 1, rng.randrange(20) / 20 if g < 2 else rng.random(), [0.3, 0.5, 0.7, 1.5][g]) for g in range(4) for i in range(200)]
    pred = spark.createDataFrame(rows, "game long, kit string, label int, prob double, thr double")
    got = {r.game: r for r in M.model_report(pred).collect()}
    parts = {(r.game, r.kit): (r.n, r.correct) for r in M.accuracy_by_game(pred, "kit").collect()}
    for g in range(4):
        own = [r for r in rows if r[0] == g]
        hit = [(r[3] >= r[4], r[2] == 1) for r in own]
        tp, called, pos = sum(a and b for a, b in hit), sum(a for a, _ in hit), sum(b for _, b in hit)
        auc = plain_auc([(r[3], r[2]) for r in own])
        assert got[g].n == 200 and got[g].accuracy == sum(a == b for a, b in hit) / 200 and got[g].precision == (tp / called if called else 0.0)
        assert got[g].recall == (tp / pos if pos else 0.0) and (got[g].auc is None if auc is None else abs(got[g].auc - auc) < 1e-9)
        for kit in "BW":
            assert parts[g, kit] == (100, sum(a == b for (a, b), r in zip(hit, own, strict=True) if r[1] == kit))


def test_many_games_are_held_out_in_groups(spark):
    rows = [(g, "train" if i % 4 else "val", float(i), float(i * g % 7), int(i > 20)) for g in range(6) for i in range(40)]
    df = spark.createDataFrame(rows, "game long, split string, f1 double, f2 double, label int")
    for most in (6, 3):
        pred = M.held_out_predictions(df, ["f1", "f2"], ["split"], max_models=most, rounds=3).collect()
        assert sorted((r.game, r.split, r.label) for r in pred) == sorted((r[0], r[1], r[4]) for r in rows)
        assert sum((r.prob >= 0.5) == (r.label == 1) for r in pred) > 0.95 * len(pred)
    assert M.held_out_predictions(df.limit(0), ["f1", "f2"], ["split"]).count() == 0
