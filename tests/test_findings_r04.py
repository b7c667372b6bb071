"""Cases of the fourth review's findings."""

import glob
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from courtloom.operators import fusion as N
from courtloom.operators import kernels as K
from courtloom.operators import tracking as T
from courtloom.operators import whole as W
from courtloom.plans import catalog  # noqa: F401
from courtloom.plans.registry import QUERIES
from courtloom.streaming import stateful as Z

from tests.test_streaming import Handle, Mark


def work_of(monkeypatch, make):
    """The function that an operator hands to the rows of a key."""
    got = []
    monkeypatch.setattr(T, "per_group", lambda df, keys, work, schema: got.append(work))
    make()
    return got[0]


def test_labels_of_a_stem_are_one_file(spark, tmp_path, monkeypatch):
    """However many tasks hold its rows; each stem's lines are read again with it."""
    rng = random.Random(4)
    rows = [(16 * rng.randrange(400) + g, rng.randrange(200), c, i, float(rng.randrange(1, 50)), rng.randrange(10) / 100, rng.choice("ANR")) for i in range(600) for g in (0, 1) for c in (0, 1)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_returnflag string").write.parquet(f"{tmp_path}/sf/lineitem.parquet")
    monkeypatch.setattr("courtloom.plans.q_io.scratch_path", lambda spark, name: f"{tmp_path}/{name}")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.stem: r.n_labels for r in QUERIES["src05_label_reader"](spark, f"{tmp_path}/sf").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = glob.glob(f"{tmp_path}/labels/stem=*/*.txt")
    labelled = [s for s, n in got.items() if n]
    assert len(files) == len(labelled) > 4 and sum(got.values()) == sum(r[6] in "AN" for r in rows) and got["empty_0"] == 0


def test_a_ball_track_makes_its_candidates_once(spark):
    """Rounds go back to the candidates, but not to what they were made of."""
    met = spark.sparkContext.accumulator(0)
    rng = random.Random(3)
    rows = [(0, f, 400.0 + 9 * (f % 60) + rng.random(), 500.0, 0.3) for f in range(200) if f % 7]

    def seen(batches):
        for b in batches:
            met.add(len(b))
            yield b

    cands = spark.createDataFrame(rows, "game long, frame long, cx double, cy double, score double").coalesce(1)
    got = {(r.frame, r.bx, r.by) for r in W.ball_track(cands.mapInPandas(seen, cands.schema), length=20).collect()}
    want = {(r.frame, r.bx, r.by) for r in T.track_ball(cands.withColumn("chunk", F.lit(0))).collect()}
    assert got == want and met.value == len(rows)


def test_groups_keep_their_parts_behind_a_join(spark):
    """A join by the same keys lends its shuffle to a repartition, which adaptive execution then makes into one part."""
    rows = spark.range(2000).selectExpr("id % 50 as k", "id as v")
    keys = spark.range(50).selectExpr("id as k").repartition(4)
    joined = rows.join(keys.hint("merge"), "k")
    where = T.per_group(joined, ["k"], lambda pdf: pd.DataFrame({"n": [len(pdf)]}), "n long").withColumn("p", F.spark_partition_id()).collect()
    assert len(where) == 50 and {r.n for r in where} == {40} and len({r.p for r in where}) > 4


def tracklets(n, apart, reid=True):
    rng = np.random.default_rng(8)
    return pd.DataFrame({
        "gid": np.arange(n), "first": 10 * np.arange(n), "last": 10 * np.arange(n) + 4, "x0": apart * np.arange(n), "y0": 0.0, "x1": apart * np.arange(n), "y1": 0.0, "team": "A",
        "number": np.where(np.arange(n) % 4 == 0, 7.0, np.nan), "strength": 1.0, "reid": [rng.normal(size=4) if reid else None for _ in range(n)]})


@pytest.mark.parametrize("apart, most", [(1e6, 0), (1.0, 10_000)])
def test_looks_are_compared_within_reach_only(monkeypatch, apart, most):
    work = work_of(monkeypatch, lambda: T.chain_tracklets(None, ["game"], max_gap=20.0, min_cos=-1.0))
    pairs, plain = [], np.einsum
    monkeypatch.setattr(np, "einsum", lambda how, a, b: pairs.append(len(a)) or plain(how, a, b))
    out = work(tracklets(80, apart))
    assert sum(pairs) <= most and (sum(pairs) > 0) == (most > 0)
    assert out["named"].sum() == (20 if apart > 1e3 else 80)


def test_an_identity_is_closed_to_what_overlaps_any_member(monkeypatch):
    work = work_of(monkeypatch, lambda: T.chain_tracklets(None, ["game"], max_gap=20.0, speed=1e9, slack=0))
    t = tracklets(3, 0.0, reid=False)
    t["first"], t["last"], t["number"] = [0, 100, 50], [10, 110, 105], [7.0, 7.0, np.nan]
    assert work(t).set_index("gid")["named"].to_dict() == {0: 1, 1: 1, 2: 0}
    t["last"] = [10, 110, 90]
    assert work(t).set_index("gid")["identity"].nunique() == 1


def test_a_look_becomes_a_unit_once_for_both_ways(monkeypatch):
    work = work_of(monkeypatch, lambda: T.two_way_identities(None, ["game"]))
    rows = [(f, o, 100.0 * o + f, 50.0, "A", float(o) if f % 9 == 0 else None, 2, [1.0, 1.0 + o, f / 90]) for f in range(30) for o in range(4)]
    pdf = pd.DataFrame(rows, columns=["frame", "oid", "cx", "cy", "team", "anchor", "reads", "reid"])
    calls, plain = [], K.unit
    monkeypatch.setattr(K, "unit", lambda v: calls.append(1) or plain(v))
    out = work(pdf)
    assert len(calls) == len(rows) and (out["identity"] == out["oid"]).all() and (out["named"] == 1).all()


def groups(n_frames, gone=()):
    rows = [(f, p, 0, p, 300.0 + 400 * p, 500.0, "A" if p % 2 else "B", None, 1.0, 1.0) for f in range(n_frames) for p in range(4) if p not in gone or f < 5]
    return pd.DataFrame(rows, columns=["frame", "group_id", "cam", "track_id", "cx", "cy", "team", "jersey", "score", "zone_conf"])


def test_a_frame_leads_only_the_votes_that_changed(monkeypatch):
    calls, plain = [], N.Votes.lead
    monkeypatch.setattr(N.Votes, "lead", lambda self, *row: calls.append(1) or plain(self, *row))
    tracks = N.CourtTracks(min_hits=1, lost_buffer=2)
    for f in N.frames(groups(60, gone=(1, 2, 3))):
        calls.clear()
        N.report(tracks, f)
    assert len(tracks.rows(N.LIVE)) == 1 and len(tracks.rows(N.LOST)) == 3 and len(calls) == 2


def test_votes_fade_and_ties_go_to_the_label_held_longest():
    votes = N.Votes()
    votes.new()
    for label, weight in (("B", 1.0), ("A", 1.0), (0, 0.0)):
        votes.add(0, label, weight)
    votes.lead(0)
    assert votes.leader[0] == ("B", 1.0, 2.0)
    votes.fade(0, 0.005)
    votes.lead(0)
    assert votes.leader[0] == (None, 0.0, 0.0)
    votes.add(0, "A", 0.5)
    votes.add(0, "B", 0.5)
    votes.lead(0)
    assert votes.leader[0] == ("A", 0.5, 1.0)


def stepped(order, n, step=None, walk=None):
    handle = Handle()
    steps = Z.FrameSteps(["game"], "ts", "frame", ["frame", "x"], ["at", "x"], list, step, 60_000, 1000, *([walk] if walk else []))
    steps.init(handle)
    rows = pd.DataFrame({"game": 0, "ts": pd.to_datetime([f * 100 for f in order], unit="ms"), "frame": order, "x": [f * 2 for f in order]})
    list(steps.handleInputRows((0,), iter([rows]), Mark(0)))
    (out,) = steps.handleExpiredTimer((0,), Mark(n * 100 + 1), None)
    return list(zip(out["at"].tolist(), out["x"].tolist()))


def test_no_table_is_made_for_a_frame(monkeypatch):
    order = list(range(300))
    random.Random(2).shuffle(order)
    made, plain = [], pd.DataFrame.__init__
    monkeypatch.setattr(pd.DataFrame, "__init__", lambda self, *a, **k: made.append(1) or plain(self, *a, **k))
    got = stepped(order, 300, lambda s, f, rows: [(f, rows[0].x)])
    assert got == [(f, 2 * f) for f in range(300)] and len(made) < 60


def test_a_walk_gets_complete_frames_as_one_table():
    order = list(range(100))[::-1]
    calls = []
    got = stepped(order, 50, walk=lambda s, rows: calls.append(1) or list(zip(rows["frame"], rows["x"])))
    assert got == [(f, 2 * f) for f in range(51)] and len(calls) == 1
