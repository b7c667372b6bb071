"""Block-cut ordered operators against plain loops, with blocks far smaller than the data."""

import random

import numpy as np
from pyspark.sql import functions as F

from courtloom.operators import joins as J
from courtloom.operators import ordered as O
from courtloom.operators import possession as P
from courtloom.operators import sequence as S


def frames(spark, seed, n=300, p=0.6, values="abc"):
    rng = random.Random(seed)
    rows = [(g, f, rng.choice(values) if rng.random() < 0.8 else None) for g in (0, 1) for f in range(n) if rng.random() < p]
    return rows, spark.createDataFrame(rows, "game long, frame long, v string")


def by_game(rows):
    return {g: sorted(r[1:] for r in rows if r[0] == g) for g in {r[0] for r in rows}}


def test_carry_and_sum(spark):
    rows, df = frames(spark, 1)
    got = {(r.game, r.frame): r for r in O.rank_in_key(O.carry_last(O.carry_last(df, ["game"], "frame", F.col("v"), "inc", 16), ["game"], "frame", F.col("v"), "exc", 16, False),
                                                      ["game"], "frame", "rank", 16).collect()}
    for g, seq in by_game(rows).items():
        last = None
        for i, (f, v) in enumerate(seq):
            assert got[(g, f)].exc == last
            last = v if v is not None else last
            assert got[(g, f)].inc == last and got[(g, f)].rank == i + 1


def test_rle_against_loop(spark):
    rows, df = frames(spark, 2, values="ab")
    got = {(r.game, r.start_frame, r.end_frame, r.v, r.n) for r in S.rle(df, ["game"], "frame", "v", 3, block=16).collect()}
    want = set()
    for g, seq in by_game(rows).items():
        run = None
        for f, v in seq:
            if v is None:
                continue
            if run and run[2] == v and f - run[1] <= 3:
                run[1], run[3] = f, run[3] + 1
            else:
                if run:
                    want.add((g, run[0], run[1], run[2], run[3]))
                run = [f, f, v, 1]
        want.add((g, run[0], run[1], run[2], run[3]))
    assert got == want


def test_hysteresis_against_loop(spark):
    rows, df = frames(spark, 3, values="ab", p=1.0)
    df = df.withColumn("chunk", F.floor(F.col("frame") / 50).cast("long"))
    got = {(r.game, r.chunk, r.frame): r.holder for r in S.hysteresis(df, ["game", "chunk"], "frame", "v", 3).collect()}
    want = {}
    for g, seq in by_game(rows).items():
        for c in {f // 50 for f, _ in seq}:
            cur, streak, last = None, 0, None
            for f, v in (x for x in seq if x[0] // 50 == c):
                if v is not None and v != cur:
                    streak = streak + 1 if v == last else 1
                    last = v
                    if streak >= 3:
                        cur = v
                elif v == cur:
                    streak = 0
                if cur is not None:
                    want[(g, c, f)] = cur
    assert got == want


def test_debounce_and_thin_chain(spark):
    df = spark.createDataFrame([(0, f) for f in (0, 20, 40, 55, 71, 72, 103)], "game long, frame long")
    assert [r.frame for r in S.debounce(df, ["game"], "frame", 30).orderBy("frame").collect()] == [0, 40, 71, 103]
    assert [r.frame for r in S.thin(df, ["game"], "frame", 20).orderBy("frame").collect()] == [0, 20, 40, 71, 103]


def test_nearest_in_time_blocks(spark):
    rng = random.Random(5)
    left = [(g, i, rng.randrange(5000)) for g in (0, 1) for i in range(200)]
    right = sorted({(g, rng.randrange(5000)) for g in (0, 1) for _ in range(60)})
    ldf = spark.createDataFrame(left, "game long, id long, t long")
    rdf = spark.createDataFrame([(g, t, t * 2) for g, t in right], "game long, t long, k long")
    got = {(r.game, r.id): (r.m_t, r.m_k) for r in J.nearest_in_time(ldf, rdf, ["game"], "t", ["k"], 40, block=128).collect()}
    for g, i, t in left:
        near = sorted((abs(u - t), u) for h, u in right if h == g and abs(u - t) <= 40)
        assert got[(g, i)] == ((near[0][1], near[0][1] * 2) if near else (None, None))


def test_merge_segments_and_interval_overlap(spark):
    seg = spark.createDataFrame([(0, 0, 9, "a"), (0, 12, 20, "a"), (0, 30, 40, "a"), (0, 41, 60, "b")], "game long, start_frame long, end_frame long, value string")
    merged = {(r.start_frame, r.end_frame, r.value) for r in P.merge_segments(seg, ["game"], 3, 8).collect()}
    assert merged == {(0, 20, "a"), (30, 40, "a"), (41, 60, "b")}
    win = spark.createDataFrame([(0, 1, 5.0, 45.0)], "game long, wid long, lo double, hi double")
    ov = {r.value: r.overlap for r in J.interval_overlap(win, seg, ["game"], "wid", "lo", "hi", "start_frame", "end_frame", "value", 8).collect()}
    assert ov == {"a": 4.0 + 8.0 + 10.0, "b": 4.0}


def test_top_per_matches_sort(spark):
    rng = np.random.default_rng(0)
    rows = [(int(k), int(v), i) for i, (k, v) in enumerate(zip(rng.integers(0, 3, 500), rng.integers(0, 50, 500)))]
    df = spark.createDataFrame(rows, "k long, v long, i long")
    got = {(r.k, r.i) for r in O.top_per(df, ["k"], [F.col("v"), F.col("i")], 7, ["i"]).collect()}
    want = {(k, i) for k in (0, 1, 2) for _, i in sorted((v, i) for kk, v, i in rows if kk == k)[:7]}
    assert got == want


def test_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 40, 301)
    df = spark.createDataFrame([(0, int(v)) for v in x], "k long, v long")
    r = O.exact_quantiles(df, ["k"], {"": "v"}, {"p50": 0.5, "p90": 0.9}).first()
    assert (r.p50, r.p90) == (np.percentile(x, 50), np.percentile(x, 90))
