"""Identity solvers with appearance, and numeric operators against plain loops."""

import math
import random

import numpy as np
import pandas as pd

from courtloom.operators import sync
from courtloom.operators import tracking as T
from courtloom.operators import votes as V

OBS = "game long, frame long, oid long, cx double, cy double, team string, anchor double, reads long, anchor_team string, reid array<double>"
TRK = "game long, gid long, first long, last long, x0 double, y0 double, x1 double, y1 double, team string, number double, strength double, reid array<double>"
E1, E2 = [1.0, 0.0], [0.0, 1.0]


def solved(spark, rows, **how):
    return {(r.frame, r.oid): (r.identity, r.named) for r in T.two_way_identities(spark.createDataFrame([(0, *r) for r in rows], OBS), ["game"], **how).collect()}


def test_looks_decide_between_near_players(spark):
    rows = [(0, 1, 0.0, 0.0, None, 0.0, 2, None, E1), (0, 2, 200.0, 0.0, None, 1.0, 2, None, E2),
            (1, 5, 100.0, 0.0, None, None, 0, None, E2), (1, 6, 101.0, 0.0, None, None, 0, None, E1)]
    with_look, without = solved(spark, rows), solved(spark, rows, w_reid=0.0)
    assert (with_look[1, 5], with_look[1, 6]) == ((1, 1), (0, 1)) and (without[1, 5], without[1, 6]) == ((0, 1), (1, 1))
    blind = [(*r[:-1], None if r[1] == 6 else r[-1]) for r in rows]        # one unknown look leaves the others in force
    assert solved(spark, blind)[1, 5] == (1, 1)


def test_named_identities_know_their_team(spark):
    """An unseen identity of the other team costs 4 more, so the first free row of its own team is taken."""
    rows = [(0, 1, 0.0, 0.0, "B", None, 0, None, None), (0, 2, 900.0, 0.0, "A", None, 0, None, None), (5, 1, 0.0, 5.0, "B", 1.0, 1, "B", None), (5, 2, 900.0, 5.0, "A", 0.0, 1, "A", None)]
    got = solved(spark, rows)
    assert got[0, 1] == (1, 1) and got[0, 2] == (0, 1)


def test_rows_without_a_name_keep_a_number(spark):
    rows = [(f, o, 500.0 * o, 0.0, None, 0.0 if o == 0 else None, 2, None, None) for f in range(3) for o in range(3)]
    got = solved(spark, rows)
    assert all(got[f, 0] == (0, 1) for f in range(3))
    assert all(got[f, o][1] == 0 and got[f, o][0] == got[0, o][0] for f in range(3) for o in (1, 2)) and got[0, 1][0] != got[0, 2][0]


def test_tracklets_chain_by_look_pair_by_pair(spark):
    rows = [(0, 1, 0, 10, 0.0, 0.0, 100.0, 0.0, None, 7.0, 9.0, E1), (0, 2, 0, 10, 0.0, 0.0, 140.0, 0.0, None, 8.0, 9.0, E2),
            (0, 3, 20, 30, 115.0, 0.0, 150.0, 0.0, None, None, 5.0, E2), (0, 4, 40, 50, 160.0, 0.0, 200.0, 0.0, None, None, 4.0, None)]
    got = {r.gid: (r.identity, r.named) for r in T.chain_tracklets(spark.createDataFrame(rows, TRK), ["game"], min_cos=0.5).collect()}
    assert got[3] == got[2] and got[3][1] == 1          # nearer to 1, but it looks like 2
    assert got[4] == got[3]                             # no look of its own: distance decides
    plain = {r.gid: r.identity for r in T.chain_tracklets(spark.createDataFrame([(*r[:-1], None) for r in rows], TRK), ["game"]).collect()}
    assert plain[3] == plain[1]


def test_smoothing_equals_the_matrix_filter(spark):
    rng = random.Random(1)
    rows = [(0, f, 100 + 9.0 * f + rng.gauss(0, 30), 50 - 4.0 * f + rng.gauss(0, 30), rng.choice([0.2, 1.0])) for f in range(40) if f % 5]
    got = {r.frame: (r.sx, r.sy, r.vx, r.vy) for r in T.smooth_points(spark.createDataFrame(rows, "k long, f long, x double, y double, w double"), ["k"], "f", "x", "y", "w").collect()}
    dt, q, r = 1 / 30, 300.0, 40.0
    a = np.array([[1, 0, dt, 0], [0, 1, 0, dt], [0, 0, 1, 0], [0, 0, 0, 1.0]])
    g = np.array([[dt * dt / 2, 0], [0, dt * dt / 2], [dt, 0], [0, dt]])
    h = np.eye(2, 4)
    m, p, last = np.array([rows[0][2], rows[0][3], 0, 0]), np.diag([r * r, r * r, 200.0**2, 200.0**2]), rows[0][1]
    for _, f, x, y, w in rows:
        if f != last:
            for _ in range(f - last):
                m, p = a @ m, a @ p @ a.T + q * q * g @ g.T
            s = h @ p @ h.T + np.eye(2) * r * r / w
            k = p @ h.T @ np.linalg.inv(s)
            m, p, last = m + k @ (np.array([x, y]) - h @ m), (np.eye(4) - k @ h) @ p, f
        assert np.allclose(got[f], m, atol=1e-6)


def test_read_clusters_equal_a_loop(spark):
    rng = random.Random(6)
    rows = [(0, i, rng.randint(0, 600), rng.choice([200.0, 1500.0]) + rng.gauss(0, 60), 400.0 + rng.gauss(0, 60)) for i in range(200)]
    got = {r.rid: r.cluster for r in T.cluster_reads(spark.createDataFrame(rows, "g long, rid long, frame long, cx double, cy double"), ["g"], min_reads=5, fps=30.0).collect()}
    open_, label = [], {}
    for _, i, f, x, y in sorted(rows, key=lambda r: (r[2], r[1])):
        near = [(math.hypot(x - cx, y - cy), k) for k, (cf, cx, cy) in enumerate(open_) if math.hypot(x - cx, y - cy) <= max(120.0, 900.0 * max(1, f - cf) / 30.0)]
        k = min(near)[1] if near else len(open_)
        if not near:
            open_.append(None)
        open_[k], label[i] = (f, x, y), k
    sizes = pd.Series(label).value_counts()
    assert got == {i: k for i, k in label.items() if sizes[k] >= 5}


def test_static_logo_and_moving_ball(spark):
    rows = [(0, f, 500.0 + (f % 3), 300.0) for f in range(0, 100, 2)] + [(0, f, 900.0 + 12.0 * f, 100.0) for f in range(100)]
    got = V.static_logos(spark.createDataFrame(rows, "g long, f long, x double, y double"), ["g"], "f", "x", "y").collect()
    assert [(r.frames, r.points) for r in got if r.is_static] == [(50, 50)]


def test_offset_is_found_by_signal(spark):
    rng = np.random.default_rng(2)
    rows = []
    for chunk in range(4):
        z = rng.normal(0, 1, 400)
        rows += [(chunk, 0, i, float(z[i])) for i in range(400)] + [(chunk, 1, i, float(z[i - 6]) if i >= 6 else 0.0) for i in range(400)]
    s = spark.createDataFrame(rows, "chunk long, cam long, frame long, z double")
    lags = sync.peak_ratio(sync.lag_correlation(s, ["chunk"], "cam", 0, "frame", "z", 20), ["chunk", "cam"])
    found = sync.offset_mode(lags, ["cam"]).collect()
    assert len(found) == 1 and abs(found[0].offset) == 6 and found[0].windows == 4
    assert sync.offset_mode(lags.filter("chunk < 2"), ["cam"]).first().offset is None


def test_optimal_assignment_equals_all_permutations(spark):
    import itertools

    rng = random.Random(8)
    rows = [(0, f, a, b, round(rng.uniform(0, 50), 3)) for f in range(30) for a in range(4) for b in range(5) if rng.random() < 0.7]
    got = T.assign_per_frame(spark.createDataFrame(rows, "g long, frame long, a long, b long, c double"), ["g"], "frame", "a", "b", "c").collect()
    for f in range(30):
        cost = {(a, b): c for _, g, a, b, c in rows if g == f}
        mine = [r for r in got if r.frame == f]
        best = min((-len([1 for k, b in enumerate(p) if (k, b) in cost]), sum(cost.get((k, b), 0) for k, b in enumerate(p))) for p in itertools.permutations(range(5), 4))
        assert -len(mine) == best[0] and abs(sum(r.cost for r in mine) - best[1]) < 1e-6
