"""Cases of the third review's findings."""

import math
import random

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from courtloom.operators import appearance as P
from courtloom.operators import correction as C
from courtloom.operators import identity as I
from courtloom.operators import joins as J
from courtloom.operators import kernels as K
from courtloom.operators import shot_model as M
from courtloom.operators import shots as H
from courtloom.operators import tracking as T
from courtloom.operators import votes as V
from courtloom.operators import whole as W
from courtloom.plans import catalog  # noqa: F401
from courtloom.plans import q_joins as Q
from courtloom.plans.registry import ORACLES, QUERIES
from courtloom.streaming import stateful as Z

BALL = "game long, chunk long, frame long, cx double, cy double, score double"


def ball_rows():
    return [(0, 0, f, 226.25, 100.75, 0.3) for f in range(12)]


def test_ball_positions_take_halves_up(spark):
    """As the statements round; Python's `round` gives 226.2."""
    rows = spark.createDataFrame(ball_rows(), BALL)
    assert {(r.bx, r.by) for r in T.track_ball(rows).collect()} == {(226.3, 100.8)}
    assert {(r.bx, r.by) for r in W.ball_track(rows.drop("chunk"), length=5).collect()} == {(226.3, 100.8)}


def test_online_ball_positions_take_halves_up(spark, tmp_path):
    rows = spark.createDataFrame(ball_rows(), BALL).withColumn("ts", Z.event_time("frame"))
    Z.write_replay(rows, str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = Z.run_available(Z.track_ball_online(stream), str(tmp_path / "o")).collect()
    assert len(out) == 12 and {(r.bx, r.by) for r in out} == {(226.3, 100.8)}


def test_equally_near_clusters_take_the_first(spark):
    """28 and 47 off is as far as 17 and 52 off, also where a hypotenuse function differs in the last digit."""
    rows = [(0, i, 0, x, y) for i, (x, y) in enumerate([(28.0 + 1000, 47.0), (1000.0 - 17, -52.0)])] + [(0, 9, 1, 1000.0, 0.0)]
    got = {r.rid: r.cluster for r in T.cluster_reads(spark.createDataFrame(rows, "g long, rid long, frame long, cx double, cy double"), ["g"], near=60.0, speed=0.0, min_reads=1).collect()}
    assert got == {0: 0, 1: 1, 9: 0}
    rows = [(0, i, 0, x, y) for i, (x, y) in enumerate([(1000.0 - 17, -52.0), (28.0 + 1000, 47.0)])] + [(0, 9, 1, 1000.0, 0.0)]
    got = {r.rid: r.cluster for r in T.cluster_reads(spark.createDataFrame(rows, "g long, rid long, frame long, cx double, cy double"), ["g"], near=60.0, speed=0.0, min_reads=1).collect()}
    assert got == {0: 0, 1: 1, 9: 0}


def test_a_replay_reads_its_rows_once_however_many_files(spark, tmp_path, monkeypatch):
    """Rows met by the writes of a replay grow with the rows, not with rows times files."""
    met = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda f: met.add(1) or f, "long").asNondeterministic()
    rows = spark.range(0, 1000, 1, 1).withColumn("ts", Z.event_time("id")).select("ts", seen("id").alias("frame"))
    monkeypatch.setattr(Z, "cut_lineage", lambda df: df)          # the count is of rows read, wherever they are kept
    Z.write_replay(rows, str(tmp_path / "in"), rows_per_file=125)
    assert met.value <= 3 * 1000
    ends = [[r.frame for r in spark.read.parquet(str(f)).collect()] for f in sorted((tmp_path / "in").glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)]
    assert len(ends) == 10 and ends[-2:] == [[None], [None]]
    assert [f for part in ends[:-2] for f in sorted(part)] == list(range(1000))


def test_preferred_in_window_forms_no_pairs(spark):
    """Equal to a plain loop, edges of the window included, and no join between the two sides."""
    rng = random.Random(15)
    plays = [(i % 2, i, rng.randint(-200, 200)) for i in range(120)]
    shots = [(i % 2, i, rng.randint(-200, 200), rng.choice([None, 1.0, 2.0, 3.0])) for i in range(160)]
    left = spark.createDataFrame(plays, "game long, play_id long, t long")
    right = spark.createDataFrame(shots, "game long, eid long, t long, rq double")
    prefer = [F.col("rq").isNull().cast("int"), F.coalesce(F.col("rq"), F.lit(9.9))]
    out = J.preferred_in_window(left, right, ["game"], "play_id", "t", 12, prefer, ["eid", "rq"])
    want = {}
    for g, p, t in plays:
        near = [(q is None, q or 0.0, abs(u - t), u, e) for h, e, u, q in shots if h == g and abs(u - t) <= 12]
        if near:
            want[p] = min(near)[3:]
    assert {r.play_id: (r.m_t, r.eid) for r in out.collect()} == want and len(want) > 100
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def appearance_rows(spark, n, people, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        v = [rng.gauss(0, 1) for _ in range(8)]
        norm = sum(x * x for x in v) ** 0.5
        rows.append((i, i % people, [x / norm for x in v]))
    return rows, spark.createDataFrame(rows, "vec_id long, label long, v array<double>")


def nearest(rows, q, want):
    found = [math.floor((1 - sum(a * b for a, b in zip(q[2], r[2], strict=True))) * 1e9 + 0.5) for r in rows if r[0] != q[0] and want(r)]
    return min(found, default=None)


def test_leave_one_out_meets_every_pair_of_tiles(spark):
    """Rows of a label travel once for each of its tiles, and answers are those of all pairs (F1)."""
    rows, df = appearance_rows(spark, 90, 2, 1)
    df = df.union(spark.createDataFrame([(900, 9, rows[0][2])], df.schema))          # alone in its label
    got = {r.q: r.d for r in P.own_distances(df, "vec_id", "label", "v", tile_rows=12).collect()}
    want = {q[0]: nearest(rows, q, lambda r, q=q: r[1] == q[1]) for q in rows}
    assert set(got) == set(want) and all(abs(got[i] - want[i]) <= 1 for i in want)


def test_queries_travel_once_to_a_tile(spark, monkeypatch):
    """Without clusters no block can be skipped, and yet a query is not sent once for each block (F1, F32)."""
    rows, df = appearance_rows(spark, 600, 3, 2)
    sent, arrow = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, *a, **k: sent.append(self.count()) or arrow(self, *a, **k))
    out = P.self_vs_rival(df.filter("vec_id < 300"), df.filter("vec_id >= 300"), "vec_id", "label", "v", slice_rows=8)
    got = {r.vec_id: (r.self_d, r.rival_d) for r in out.collect()}
    for q in rows[:300:10]:
        for at, same in enumerate((True, False)):
            assert abs(got[q[0]][at] - nearest(rows[300:], q, lambda r, q=q, same=same: (r[1] == q[1]) == same) / 1e9) < 3e-9
    assert max(sent) <= 2 * 600
    P.loo_threshold(df, "vec_id", "label", "v").collect()
    assert max(sent) <= 2 * 600


def test_models_read_rows_that_agree_once(spark, monkeypatch):
    """Copies of the rows change neither scores nor thresholds, and what the trees read does not grow (F2, F3)."""
    rows = [(g, "train" if i % 4 else "val", float(i % 40), None if i % 6 == 0 else float(i * g % 7), int(i % 40 > 20)) for g in range(1, 4) for i in range(160)]
    df = spark.createDataFrame(rows, "game long, split string, f1 double, f2 double, label int")
    read, fit, found = [], M.fit, []
    monkeypatch.setattr(M, "fit", lambda train, *a, **k: read.append(train.count()) or fit(train, *a, **k))
    for copies in (1, 5):
        out = M.held_out_predictions(df.crossJoin(spark.range(copies)).drop("id"), ["f1", "f2"], ["split"], rounds=3).collect()
        assert len(out) == copies * len(rows)
        found.append(({(r.game, r.split, r.label, round(r.prob, 9), r.thr) for r in out}, sum(read)))
        read.clear()
    assert found[0] == found[1] and found[0][1] < 3 * 2 * 120


def test_small_groups_travel_in_whole_batches(spark):
    """Groups are cut out of batches, also where one spans several; nulls make a group; results carry their key (F17)."""
    rows = [(i % 7, None if i % 3 == 0 else f"k{i % 3}", i) for i in range(2000)]
    df = spark.createDataFrame(rows, "a long, b string, v long").repartition(5)
    work = lambda pdf: pd.DataFrame({"n": [len(pdf)], "s": [int(pdf["v"].sum())]}) if pdf["a"].iloc[0] != 4 else pd.DataFrame({"n": [], "s": []})      # noqa: E731
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        out = T.per_group(df, ["a", "b"], work, "n long, s long")
        got = sorted(((r.a, r.b or "", r.n, r.s) for r in out.collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    want = {}
    for a, b, v in rows:
        n, s = want.get((a, b or ""), (0, 0))
        want[a, b or ""] = n + 1, s + v
    assert got == sorted((*k, *v) for k, v in want.items() if k[0] != 4)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_plain_filter_equals_the_planar_filter():
    rng = random.Random(4)
    frames = np.cumsum([rng.randint(1, 5) for _ in range(60)])
    xy, weight = np.array([[rng.uniform(0, 2000), rng.uniform(0, 1400)] for _ in range(60)]), np.array([rng.random() for _ in range(60)])
    step = K.PlanarFilter(xy[0])
    for i, row in enumerate(K.filtered(frames, xy, weight)):
        if i:
            for _ in range(int(frames[i] - frames[i - 1])):
                step.advance()
            step.absorb(xy[i], weight[i])
        assert np.allclose(row, step.s.ravel(), rtol=1e-11, atol=1e-9)


def test_equally_near_detections_go_by_slot(spark, monkeypatch):
    """In the statement's window `det_idx` is the slot within the camera, not the number it returns (F10)."""
    world = spark.createDataFrame([(0, 0, 1, 100.0, 100.0)], "game long, frame long, gid long, cx double, cy double")
    det = spark.createDataFrame([(0, 0, 0, 5, 0, 10, 1), (0, 0, 1, 3, 0, 10, 1)], "game long, frame long, cam long, det_idx long, class_id int, pk long, sk long")
    monkeypatch.setattr(Q.A, "world", lambda *_: world)
    monkeypatch.setattr(Q.A, "detections", lambda *_: det)
    got = [r.det_idx for r in QUERIES["jn05_nearest_detection"](spark, "").collect()]
    plain = J.nearest_point(world, det.selectExpr("game", "frame", "cam * 32 + det_idx as det_idx", "70e0 as rx", "131e0 as ry"), ["game", "frame"], "gid", "det_idx", 180.0)
    assert [r.det_idx for r in plain.collect()] == [5]
    c = duckdb.connect()
    c.execute("create table world as select 0 as game, 0 as frame, 1 as gid, 100e0 as cx, 100e0 as cy")
    c.execute("create table det as select 0 as game, 0 as frame, unnest([0, 1]) as cam, unnest([5, 3]) as det_idx, 0 as class_id, 10 as pk, 1 as sk")
    body = ORACLES["jn05_nearest_detection"]
    body = body[body.rindex("select w.game, w.frame, w.gid") : body.rindex(")")]
    assert got == [r[3] for r in c.execute(body).fetchall()] == [35]


def test_small_assignments_equal_wide_ones(monkeypatch):
    """Plain numbers and arrays take the same pairs, also among equal costs (F23)."""
    rng = np.random.default_rng(5)
    for _ in range(300):
        shape = rng.integers(1, 9, 2)
        cost = np.where(rng.random(shape) < 0.3, K.LARGE, rng.integers(0, 6, shape) * 0.1 + rng.integers(0, 2) * rng.random(shape))
        small = K.assign(cost)
        with monkeypatch.context() as m:
            m.setattr(K, "SMALL", 0)
            assert small == K.assign(cost)


def test_edges_in_components_cost_what_the_whole_matrix_costs():
    """As many edges as the assignment of the whole matrix, at its cost, with and without a price for staying alone."""
    rng = random.Random(4)
    for case in range(150):
        n, m = rng.randint(1, 9), rng.randint(1, 9)
        edges = [(a, b, rng.uniform(0, 100)) for a in range(n) for b in range(m) if rng.random() < (0.15, 0.4)[case % 2]]
        whole = np.full((n, m + n), K.LARGE)
        for a, b, c in edges:
            whole[a, b] = c
        for alone in (None, 60.0):
            cost = whole if alone is None else np.where(np.arange(m + n) == m + np.arange(n)[:, None], alone, whole)
            want = [cost[a, b] for a, b in K.assign(cost[:, :m] if alone is None else cost) if b < m and cost[a, b] < K.LARGE]
            got = K.assign_edges(edges, alone)
            assert len({a for a, _, _ in got}) == len({b for _, b, _ in got}) == len(got) and set(got) <= set(edges)
            value = lambda found: sum(found) + (n - len(found)) * (alone or 0.0)      # noqa: E731, B023
            assert math.isclose(value(want), value([c for _, _, c in got]), abs_tol=1e-6) and (alone or len(want) == len(got))


def test_a_frame_without_ties_between_edges_is_solved_edge_by_edge(monkeypatch):
    """The work of a frame grows with its edges and not with the third power of its players."""
    monkeypatch.setattr(K, "_assign_small", None)
    monkeypatch.setattr(K, "assign", None)
    assert K.assign_edges([(i, i, 5.0) for i in range(300)]) == [(i, i, 5.0) for i in range(300)]


def test_micro_tracklets_hand_columns_on(spark):
    rows = [(0, f, oid, 100.0 * oid + f, 50.0, 10 * f + oid) for f in (0, 1, 3, 9) for oid in (1, 2)]
    got = T.micro_tracklets(spark.createDataFrame(rows, "game long, frame long, oid long, cx double, cy double, jersey long"), ["game"], keep=["jersey"]).collect()
    assert {(r.frame, r.oid): r.jersey for r in got} == {(f, o): 10 * f + o for f in (0, 1, 3, 9) for o in (1, 2)}
    assert len({r.tracklet for r in got if r.frame < 9}) == 2 and len({r.tracklet for r in got}) == 4


def test_a_box_meets_the_earlier_boxes_of_its_buffer_in_pieces():
    """The overlaps of a chunk are found over whole columns, whatever the size of the pieces."""
    rng = np.random.default_rng(5)
    frame = np.sort(rng.integers(0, 20, 80))
    low = rng.uniform(0, 60, (80, 2))
    box = np.hstack([low, low + rng.uniform(5, 60, (80, 2))])
    iou = K.pair_iou(box, box)
    for pairs in (1, 50, 10_000):
        got = T._overlaps(box, frame, 4, 0.2, pairs)
        for i in range(80):
            want = {int(j) for j in np.flatnonzero((frame < frame[i]) & (frame >= frame[i] - 4) & (iou[i] >= 0.2))}
            assert {j for j, _ in got[i]} == want and np.allclose([c for _, c in got[i]], [1 - iou[i, j] for j, _ in got[i]])


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


def test_player_groups_do_not_depend_on_batches(spark):
    """Frames that are cut by the batches of a transfer are grouped whole, with and without members."""
    rng = random.Random(6)
    rows = [(0, f, c, t, rng.choice(["A", "B", "REF", None]), rng.choice([None, 4, 7]), rng.uniform(0.5, 1), 0.5, rng.uniform(0, 400), rng.uniform(0, 400))
            for f in range(30) for c in range(4) for t in range(3)]
    obs = spark.createDataFrame(rows, "game long, frame long, cam long, track_id long, team string, jersey long, score double, zone_conf double, cx double, cy double")
    name, found = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(name)
    try:
        for size in ("5", "10000"):
            spark.conf.set(name, size)
            found.append(V.cluster_players(obs, ["game", "frame"], 250.0).orderBy("frame", "group_id").collect())
        plain = V.cluster_players(obs, ["game", "frame"], 250.0, members=False).orderBy("frame", "group_id").collect()
    finally:
        spark.conf.set(name, before)
    assert found[0] == found[1] and [r[:-1] for r in found[0]] == [tuple(r) for r in plain]
    assert sum(len(r.members) for r in found[0]) == len(rows) and all(len({m.cam for m in r.members}) == r.n_cams for r in found[0])


def test_cost_per_frame_is_that_of_the_matching_and_reads_edges_once(spark):
    rng = random.Random(7)
    rows = [(0, f, a, b, rng.uniform(0, 300)) for f in range(12) for a in range(6) for b in range(5) if rng.random() < 0.4]
    edges = spark.createDataFrame(rows, "g long, frame long, l long, r long, c double")
    pairs = T.assign_per_frame(edges, ["g"], "frame", "l", "r", "c", dummy=200.0).collect()
    cost = T.cost_per_frame(edges, ["g"], "frame", "l", "r", "c", 200.0, dummy=200.0)
    assert plan_of(cost).count("Exchange") == 1
    for r in cost.collect():
        mine = [p.cost for p in pairs if p.frame == r.frame]
        alone = len({a for _, f, a, _, _ in rows if f == r.frame}) - len(mine)
        assert math.isclose(r.cost, sum(mine) + 200.0 * alone)


def test_frame_scores_over_block_edges(spark):
    """Weights of all cameras count for the frames around them, whatever the blocks, and only weights travel."""
    rng = random.Random(8)
    rows = [(0, cam, f, f"n{k}", 100.0 + rng.uniform(0, 20), 100.0, 90.0, 100.0, 130.0, 260.0) for f in range(0, 70, 3) for cam in range(2) for k in range(2)]
    boxes = spark.createDataFrame(rows, "game long, cam long, frame long, sid string, ball_x double, ball_y double, x1 double, y1 double, x2 double, y2 double")
    got = {}
    for block in (25, 1000):
        scores = H.frame_scores(boxes, -6, 18, 0.6, block)
        assert plan_of(scores).count("Exchange") == 1
        got[block] = {(r.frame, r.sid): r.score for r in scores.collect()}
    want: dict = {}
    for _, _, f, sid, bx, _, x1, y1, x2, _ in rows:
        for at in range(f - 17, f + 7):
            want[at, sid] = want.get((at, sid), 0.0) + math.exp(-abs(bx - (x1 + x2) / 2) / (x2 - x1))
    for scores in got.values():
        assert scores.keys() == want.keys() and all(math.isclose(scores[k], want[k]) for k in want)


def test_isolated_pairs_in_pieces_and_without_sorted_pairs(spark, monkeypatch):
    """Pairs are met some at a time in a block of frames; none is shuffled or sorted by Spark."""
    rng = random.Random(9)
    rows = [(0, f, c, t, rng.choice(["A", "B", "REF"]), rng.uniform(0, 500), rng.uniform(0, 300)) for f in range(40) for c in range(3) for t in range(5)]
    tracks = spark.createDataFrame(rows, "game long, frame long, cam long, track_id long, team string, cx double, cy double")
    want = set()
    for _, f, c, t, team, x, y in rows:
        for other in range(c + 1, 3):
            d = sorted((math.sqrt((x - q[5]) ** 2 + (y - q[6]) ** 2), q[3], q[4]) for q in rows if q[1] == f and q[2] == other and q[4] != "REF")
            if team != "REF" and d and d[0][0] <= 80 and (len(d) == 1 or d[1][0] >= 180):
                want.add((f, c, t, team, other, *d[0][1:]))
    assert len(want) > 20
    for pairs in (1, 700, 500_000):
        monkeypatch.setattr(I, "PAIRS", pairs)
        found = I.isolated_pairs(tracks, block=16)
        assert "Window" not in plan_of(found) and "Join" not in plan_of(found)
        assert {(r.frame, r.cam1, r.t1, r.team1, r.cam2, r.t2, r.team2) for r in found.collect()} == want


def test_reacquisition_over_block_edges_deals_rows_out_once(spark):
    """Gaps over several blocks, looks at and between truth frames; rows are exchanged for the blocks and for the fill."""
    rng = random.Random(10)
    truth = [(0, s, f, float(f), float(s)) for s in range(6) for f in sorted(rng.sample(range(900), 9))]
    looks = [(0, s, f, rng.uniform(0, 9), rng.uniform(0, 9), rng.uniform(0, 1), 0.6) for s in range(6) for f in range(900) if rng.random() < 0.3 for _ in range(2)]
    a = spark.createDataFrame(truth, "game long, sid long, frame long, cx double, cy double")
    b = spark.createDataFrame(looks, "game long, sid long, frame long, cx double, cy double, own double, other double")
    want = set()
    for s in range(6):
        rows = {f: (x, y, 0) for _, q, f, x, y in truth if q == s}
        for at, to in zip(sorted(rows), sorted(rows)[1:]):
            for f in range(at + 5, to, 5):
                best = min(((own, x, y) for _, q, g, x, y, own, other in looks if q == s and g == f and own < 0.5 and other - own > 0.02), default=None)
                if to - at > 60 and best:
                    rows[f] = (*best[1:], 1)
        order = sorted(rows)
        for f, to in zip(order, order[1:]):
            for i in range(1, to - f if 2 <= to - f <= 30 else 0):
                rows[f + i] = (*[rows[f][k] + (rows[to][k] - rows[f][k]) * (i / (to - f)) for k in (0, 1)], 2)
        want |= {(s, f, round(x, 6), round(y, 6), p) for f, (x, y, p) in rows.items()}
    for block in (40, 4000):
        got = C.reacquire(a, b, 0.5, 60, 5, 0.02, 30, block)
        assert {(r.sid, r.frame, round(r.cx, 6), round(r.cy, 6), r.provisional) for r in got.collect()} == want
        assert sum(line.count("Exchange") for line in plan_of(got).splitlines() if "Reused" not in line) <= 6
