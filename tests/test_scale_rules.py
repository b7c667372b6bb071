"""Whole views, linear ordered joins, streams that lose nothing, and what a cluster needs."""

import os
import random
import subprocess
import sys
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtloom import session
from courtloom.operators import fusion as N
from courtloom.operators import identity as I
from courtloom.operators import joins as J
from courtloom.operators import possession as P
from courtloom.operators import sequence as S
from courtloom.operators import sync
from courtloom.operators import votes as V
from courtloom.plans import adapters as A
from courtloom.plans import catalog
from courtloom.streaming import stateful as Z

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@needs_data
@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_event_views_keep_every_row(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    c = A.candidates(spark, sf)
    assert c.count() == e.count() == c.select("game", "frame").distinct().count()
    assert A.cv_events(spark, sf).count() == e.filter("event_type = 'click'").count()
    o = A.observations(spark, sf)
    assert o.count() == e.count() == o.select("game", "uid", "frame").distinct().count()


def nearest(left, right, tol):
    out = {}
    for i, t in left:
        best = min(((abs(u - t), u, e) for e, u in right if abs(u - t) <= tol), default=None)
        out[i] = best[2] if best else None
    return out


def test_nearest_in_time_equals_brute_force(spark):
    rng = random.Random(3)
    left = [(i, rng.randint(0, 3000)) for i in range(150)]
    right = [(i, rng.choice([5, 700, 701, rng.randint(0, 3000)])) for i in range(120)]
    a, b = spark.createDataFrame([(0, *x) for x in left], "game long, play long, t long"), spark.createDataFrame([(0, *x) for x in right], "game long, e long, t long")
    for tol in (0, 7, 400):
        got = {r.play: r.m_e for r in J.nearest_in_time(a, b, ["game"], "t", ["e"], tol).collect()}
        assert got == nearest(left, right, tol)


def test_nearest_in_time_grows_with_its_rows(spark):
    """One game, one dense block: ten times the rows may not take a hundred times as long."""
    took = []
    for n in (20_000, 200_000):
        a = spark.range(n).selectExpr("0L as game", "id as play", "id * 7 % 5000 as t")
        b = spark.range(n).selectExpr("0L as game", "id as e", "id * 11 % 5000 as t")
        begin = time.perf_counter()
        assert J.nearest_in_time(a, b, ["game"], "t", ["e"], 1800).filter("m_e is not null").count() == n
        took.append(time.perf_counter() - begin)
    assert took[1] < 25 * max(took[0], 1.0)


def test_fast_break_reads_the_first_later_frame(spark):
    rows = [(0, 0, f, "A", x) for f, x in ((0, 0.0), (5, 50.0), (12, 900.0), (30, 1000.0), (31, 2000.0))]
    out = P.fast_breaks(spark.createDataFrame(rows, "game long, chunk long, frame long, team string, cx double"), ["game", "chunk"], 10, 800.0).collect()
    assert [(r.f0, r.f1, r.dx) for r in out] == [(0, 12, 900.0)]


def replayed(spark, df, path, make):
    Z.write_replay(df, f"{path}/in", rows_per_file=max(1, df.count() // 4))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    q = make(stream).writeStream.outputMode("append").option("checkpointLocation", f"{path}/c").trigger(availableNow=True).format("parquet").start(f"{path}/out")
    q.awaitTermination()
    return spark.read.parquet(f"{path}/out"), q


def test_replay_ends_empty_and_loses_nothing(spark, tmp_path):
    rows = [(g, f, "HOLD", "a" if f // 7 % 2 else "b") for g in range(3) for f in range(0, 400 + g)]
    df = spark.createDataFrame(rows, "game long, frame long, state string, top string").withColumn("chunk", F.floor(F.col("frame") / 100)).withColumn("ts", Z.event_time("frame"))
    out, q = replayed(spark, df, str(tmp_path), lambda s: Z.hold_online(s, 3, 2))
    progress = q.recentProgress
    assert len([p for p in progress if p["numInputRows"]]) >= 4
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 0
    assert all(p["stateOperators"][0]["numRowsDroppedByWatermark"] == 0 for p in progress)
    want = []
    for g in range(3):
        for c in range(5):
            current, rival, streak = None, None, 0
            for _, f, _, top in (r for r in rows if r[0] == g and r[1] // 100 == c):
                if top == current:
                    streak = 0
                    continue
                streak, rival = (streak + 1 if top == rival else 1), top
                if streak >= 3:
                    current, streak = top, 0
                    want.append((g, c, f, top))
    assert sorted((r.game, r.chunk, r.frame, r.holder) for r in out.collect()) == sorted(want)


@needs_data
def test_streams_equal_the_batch_jobs(spark):
    q = catalog.queries()
    assert sorted(map(tuple, q["str02_online_ball"](spark, SF).collect())) == sorted(map(tuple, q["trk03_ball_tracker"](spark, SF).collect()))
    one, two = q["str01_online_fusion"](spark, SF).toPandas(), q["trk04_cross_camera_fusion"](spark, SF).toPandas()
    key = ["game", "chunk", "frame", "cx", "cy"]
    assert one[key].sort_values(key).reset_index(drop=True).equals(two[key].sort_values(key).reset_index(drop=True))


def test_aliases_in_a_circle_are_an_error(spark):
    chain = spark.createDataFrame([(k + 1, k) for k in range(70)], "child long, parent long")
    assert {r.parent for r in I.resolve_aliases(chain).collect()} == {0}
    with pytest.raises(ValueError, match="circle"):
        I.resolve_aliases(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "child long, parent long"))


def test_moving_average_is_the_recursion(spark):
    rows = [(k, f, float((f * 37 + k) % 101)) for k in range(2) for f in range(0, 600, 2)]
    got = {(r.k, r.f): r.x_ema for r in S.ema(spark.createDataFrame(rows, "k long, f long, x double"), ["k"], "f", ["x"], 0.01).collect()}
    for k in range(2):
        a = None
        for _, f, x in (r for r in rows if r[0] == k):
            a = x if a is None else a + 0.01 * (x - a)
            assert abs(got[k, f] - a) < 1e-12


def test_teams_are_split_by_camera(spark):
    rng = random.Random(0)
    rows = [(cam, i, base + shift + rng.random(), 100.0 - 50 * (i % 2)) for cam, base in ((0, 10.0), (1, 200.0)) for i, shift in ((i, 60.0 * (i % 2)) for i in range(40))]
    rows.append((2, 0, 5.0, 5.0))
    out = V.two_team_clusters(spark.createDataFrame(rows, "cam long, i long, hue double, v double"), ["cam"], "hue", "v").collect()
    assert len(out) == len(rows) and all(r.team == (None if r.cam == 2 else "AB"[r.i % 2]) for r in out)


def test_peak_without_a_rival_is_infinitely_better(spark):
    curve = spark.createDataFrame([(0, lag, 5.0 if lag == 2 else 0.0) for lag in range(-20, 21)], "w long, lag long, c double")
    assert sync.peak_ratio(curve, ["w"]).first().ratio == float("inf")


def test_grid_equals_single_runs(spark):
    rng = np.random.default_rng(1)
    rows = [(0, f // 50, f, i, c, i, 300.0 + 400 * i + 2 * f + rng.normal(0, 40), 500.0 + rng.normal(0, 40), "AB"[i % 2], None, 0.9, 1.0) for f in range(100) for i in range(4) for c in ("L", "R")]
    groups = spark.createDataFrame(rows, "game long, chunk long, frame long, group_id long, cam string, track_id long, cx double, cy double, team string, jersey long, score double, zone_conf double")
    grid = [{"max_dist": 60.0}, {"max_dist": 400.0, "gate_cost": 3.0}]
    got = N.fusion_grid(groups, ["game", "chunk"], grid).toPandas()
    for k, params in enumerate(grid):
        one = N.fuse_groups(groups, **params).toPandas()
        assert sorted(map(tuple, got[got.config == k][["chunk", "frame", "gid"]].to_numpy())) == sorted(map(tuple, one[["chunk", "frame", "gid"]].to_numpy()))


class Cluster:
    """Just enough of a session outside local mode."""

    class conf:
        @staticmethod
        def get(key, default=None):
            return default

    class sparkContext:
        master = "spark://head:7077"


def test_no_machine_local_folder_on_a_cluster(spark):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch_path(Cluster, "x")
    assert session.scratch_path(spark, "x")


@needs_data
def test_workers_find_the_package_from_any_folder(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""import sys; sys.path.insert(0, {root!r})
from courtloom.session import build_session
from courtloom.plans import catalog
spark = build_session('away', 'local[2]', **{{'spark.ui.enabled': 'false', 'spark.sql.shuffle.partitions': '2'}})
print('rows', catalog.queries()['trk03_ball_tracker'](spark, {SF!r}).count())"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 376" in done.stdout, done.stderr[-2000:]


@needs_data
@pytest.mark.parametrize("name", ["trk15_cross_camera_correction", "trk16_drift_correction"])
def test_corrections_scan_their_tables_three_times(spark, name):
    """Streams, reads and detections once each: the flags are checkpointed before the correction, which scans detections."""
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1


def test_games_are_split_in_order_over_ranges(spark):
    from courtloom.operators import datasets as D

    names = [f"g{k * 7919 % 1000:04d}" for k in range(1000)]
    items = spark.createDataFrame([(g, i) for g in names for i in range(2)], "game string, item int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.game, r.split) for r in D.ordered_split(items, "game").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {(g, "train" if k < 800 else "valid" if k < 920 else "test") for k, g in enumerate(sorted(names))}
