"""Shots: rim arrivals, releases, shooters, zones, feature tables and event assembly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtloom import constants as C
from courtloom.functions import geometry as G
from courtloom.functions import text as T
from courtloom.operators import joins as J
from courtloom.operators import ordered as O
from courtloom.operators import sequence as S

CHUNK = ("game", "cam", "chunk")


def rim_median(boxes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Static rim per camera: the median of each coordinate over its detections."""
    return O.exact_quantiles(boxes, keys, {"rx1": "x1", "ry1": "y1", "rx2": "x2", "ry2": "y2"}, {"": 0.5})


def rim_arrivals(ball: DataFrame, rim: DataFrame, arrive_px: float = 100.0, min_above: float = 60.0,
                 apex_reach: int = 45, quiet: int = 15) -> DataFrame:
    """Frames where the ball comes down into the rim, with the apex frame of its arc.

    `ball`: game, cam, chunk, frame, bx, by (one row per frame, so a chunk bounds the window).
    (a) within reach of the rim, lower than the previous point of the last 6 frames, and clearly above the
    rim before; (b) entering the rim box after `quiet` frames outside it.
    """
    rx, ry = (F.col("rx1") + F.col("rx2")) / 2, (F.col("ry1") + F.col("ry2")) / 2
    rw = F.greatest(F.col("rx2") - F.col("rx1"), F.lit(20.0))
    b = ball.join(rim, ["game", "cam", "chunk"]).withColumn("_rx", rx).withColumn("_ry", ry).withColumn("_rw", rw)
    inside = (F.abs(F.col("ball_x") - F.col("_rx")) < 0.9 * F.col("_rw")) & (F.abs(F.col("ball_y") - F.col("_ry")) < 0.9 * F.col("_rw"))
    b = b.withColumn("_in", inside)
    w = Window.partitionBy(*CHUNK).orderBy("frame")
    before = w.rangeBetween(-apex_reach, -1)
    apex = F.min(F.struct(F.col("ball_y").alias("y"), F.col("frame").alias("f"))).over(before)
    entered = F.max(F.col("_in")).over(w.rangeBetween(-quiet, -1))
    b = b.select("*", F.lag("frame").over(w).alias("_pf"), F.lag("ball_y").over(w).alias("_py"), apex.alias("_apex"), entered.alias("_was"))
    near = G.distance(F.col("ball_x"), F.col("ball_y"), F.col("_rx"), F.col("_ry")) <= arrive_px
    falling = (F.col("_pf") >= F.col("frame") - 6) & (F.col("_py") < F.col("ball_y"))
    arc = near & F.coalesce(falling & (F.col("_ry") - F.col("_apex.y") >= min_above), F.lit(False))
    entry = F.col("_in") & ~F.coalesce(F.col("_was"), F.lit(False))
    hit = b.withColumn("apex_f", F.when(arc, F.col("_apex.f")).when(entry, F.coalesce(F.col("_apex.f"), F.col("frame"))))
    return hit.filter("apex_f is not null").select(*CHUNK, "frame", "apex_f")


def release_frames(shots: DataFrame, ball: DataFrame, reach: int = 26, max_step: int = 8, slack: float = 3.0) -> DataFrame:
    """Walk back from the apex while the ball was lower (within `slack`) and steps stay short.

    A shot meets only the points of its own chunk in the `reach` frames before the apex: at most reach+1
    array elements, folded in the JVM.
    """
    width = reach + 1
    s = shots.select(*CHUNK, "frame", "apex_f").withColumn(
        "_b", F.explode(F.sequence(F.floor((F.col("apex_f") - reach) / width), F.floor(F.col("apex_f") / width))))
    p = ball.select(*CHUNK, F.col("frame").alias("_f"), F.col("ball_y").alias("_y")).withColumn("_b", F.floor(F.col("_f") / width))
    pts = s.join(p, [*CHUNK, "_b"]).filter(F.col("_f").between(F.col("apex_f") - reach, F.col("apex_f")))
    walk = pts.groupBy(*CHUNK, "frame", "apex_f").agg(F.sort_array(F.collect_list(F.struct("_f", "_y")), asc=False).alias("w"))
    start = F.struct(F.get("w", F.lit(0))["_f"].alias("f"), F.get("w", F.lit(0))["_y"].alias("y"), F.lit(True).alias("go"))

    def step(acc: Column, e: Column) -> Column:
        ok = acc["go"] & (acc["f"] - e["_f"] <= max_step) & (e["_y"] >= acc["y"] - slack)
        return F.struct(
            F.when(ok, e["_f"]).otherwise(acc["f"]).alias("f"), F.when(ok, e["_y"]).otherwise(acc["y"]).alias("y"),
            (acc["go"] & ok).alias("go"))

    rest = F.slice("w", 2, reach + 1)
    return walk.withColumn("rel_f", F.aggregate(rest, start, step)["f"]).select(*CHUNK, "frame", "apex_f", "rel_f")


def catch_frames(releases: DataFrame, ball: DataFrame, speed: float, reach: int = 23, max_gap: int = 6) -> DataFrame:
    """Last frame before the release at which the ball was in flight (start of the integration)."""
    w = Window.partitionBy(*CHUNK).orderBy("frame")
    gap = F.col("frame") - F.lag("frame").over(w)
    v = G.distance(F.col("ball_x"), F.col("ball_y"), F.lag("ball_x").over(w), F.lag("ball_y").over(w)) / gap
    flight = ball.withColumn("_v", F.when(gap <= max_gap, v)).filter(F.col("_v") >= speed).select(*CHUNK, F.col("frame").alias("_f"))
    width = reach + 1
    r = releases.withColumn("_b", F.explode(F.sequence(F.floor((F.col("rel_f") - reach) / width), F.floor(F.col("rel_f") / width))))
    f = flight.withColumn("_b", F.floor(F.col("_f") / width))
    best = r.join(f, [*CHUNK, "_b"]).filter(F.col("_f").between(F.col("rel_f") - reach, F.col("rel_f"))).groupBy(
        *CHUNK, "frame").agg(F.max("_f").alias("catch_f"))
    return releases.join(best, [*CHUNK, "frame"], "left")


def in_frames(anchors: DataFrame, keys: Sequence[str], at: str, lo: int, hi: int, out: str = "frame") -> DataFrame:
    """An anchor visits the frames at+lo .. at+hi-1 (a fixed window, so the fan-out is hi-lo)."""
    return anchors.withColumn(out, F.explode(F.sequence(F.col(at) + lo, F.col(at) + hi - 1)))


def shooter_scores(anchors: DataFrame, ball_boxes: DataFrame, lo: int = -23, hi: int = 7, top_share: float | None = None, start: str | None = None) -> DataFrame:
    """Sum of under-ball weights per shot, camera and stream over the frames around the release.

    `anchors`: shot_id, game, cam, at. `ball_boxes`: game, cam, frame, ball, sid, box (frame-bounded join).
    `start` names a column with a later first frame (the catch), replacing `lo`.
    """
    weight = G.under_ball_weight(G.Box.of(), F.col("ball_x"), F.col("ball_y"), top_share)
    weighted = ball_boxes.withColumn("weight", weight).filter("weight is not null").select("game", "cam", "frame", "sid", "weight")
    wide = in_frames(anchors, ["game", "cam"], "at", lo, hi)
    wide = wide.filter(F.col("frame") >= F.col(start)) if start else wide
    pairs = wide.join(weighted, ["game", "cam", "frame"])
    return pairs.groupBy("shot_id", "game", "cam", "sid").agg(F.sum("weight").alias("score"))


def frame_scores(ball_boxes: DataFrame, lo: int, hi: int, top_share: float | None = None, block: int = C.BLOCK_FRAMES) -> DataFrame:
    """(game, _blk, frame, sid, score): the sums of `shooter_scores` over all cameras for every frame, by blocks of frames.

    A weight travels to the blocks it reaches and there meets the frames it counts for; frames do not travel."""
    weight = G.under_ball_weight(G.Box.of(), F.col("ball_x"), F.col("ball_y"), top_share)
    weighted = ball_boxes.withColumn("weight", weight).filter("weight is not null").select("game", "frame", "sid", "weight")
    dealt = O.with_halo(weighted, "frame", -lo, hi - 1, block).drop(O.OWN).repartition("game", O.BLK)
    first = F.col(O.BLK) * block
    reached = F.sequence(F.greatest(F.col("frame") - hi + 1, first), F.least(F.col("frame") - lo, first + block - 1))
    return dealt.withColumn("frame", F.explode(reached)).groupBy("game", O.BLK, "frame", "sid").agg(F.sum("weight").alias("score"))


def pick_shooter(scores: DataFrame, priority: Column) -> DataFrame:
    """First camera (by priority) with any evidence; in it the stream with the largest score."""
    best = scores.withColumn("_p", priority).groupBy("shot_id", "game").agg(
        F.min(F.struct(F.col("_p"), (-F.floor(F.col("score") * 1e6 + 0.5)).alias("s"), F.col("sid"), F.col("cam"), F.col("score"))).alias("b"))
    return best.select("shot_id", "game", "b.sid", "b.cam", "b.score")


def margin_vote(scores: DataFrame, arc_cam: Column) -> DataFrame:
    """Per camera the leader votes with (top - second) / top, twice from the arc camera; argmax of sums."""
    w = Window.partitionBy("shot_id", "game", "cam").orderBy(F.desc("score"), "sid")
    ranked = scores.withColumn("_rn", F.row_number().over(w)).withColumn("_second", F.coalesce(F.lead("score").over(w), F.lit(0.0)))
    lead = ranked.filter("_rn = 1").withColumn(
        "vote", (F.col("score") - F.col("_second")) / F.col("score") * F.when(arc_cam == F.col("cam"), 2.0).otherwise(1.0))
    total = lead.groupBy("shot_id", "game", "sid").agg(F.floor(F.sum("vote") * 1e6 + 0.5).alias("v"))
    best = total.groupBy("shot_id", "game").agg(F.max(F.struct("v", "sid")).alias("b"))
    return best.select("shot_id", "game", "b.sid", (F.col("b.v") / 1e6).alias("vote"))


def release_quality(anchors: DataFrame, ball_boxes: DataFrame, reach: int = 6) -> DataFrame:
    """Smallest horizontal ball offset in box widths while the ball is in the top 60% of a box."""
    b = G.Box.of()
    ok = (F.col("ball_y") <= b.y2) & (F.col("ball_y") <= b.y1 + 0.6 * b.height)
    off = F.abs(F.col("ball_x") - b.cx) / b.width
    near = ball_boxes.filter(ok).withColumn("off", off).groupBy("game", "cam", "frame").agg(F.min("off").alias("off"))
    return in_frames(anchors, ["game", "cam"], "at", -reach, reach + 1).join(near, ["game", "cam", "frame"]).groupBy(
        "shot_id", "game").agg(F.min("off").alias("rq"))


def shooter_position(anchors: DataFrame, feet: DataFrame) -> DataFrame:
    """Median over cameras of the court foot at the nearest of frames 0, -1, +1, -2, +2, for the release and
    6 and 12 frames earlier; the largest basket distance of the three is the release distance.

    `anchors`: one row per shot and camera (shot_id, game, cam, at = the camera's own frame, sid).
    """
    back = anchors.withColumn("back", F.explode(F.array(*[F.lit(v).cast("long") for v in (0, 6, 12)])))
    near = back.withColumn("_d", F.explode(F.sequence(F.lit(-2), F.lit(2)))).withColumn("frame", F.col("at") - F.col("back") + F.col("_d"))
    hit = near.join(feet.select("game", "cam", "sid", "frame", "cx", "cy"), ["game", "cam", "sid", "frame"])
    shot = ["shot_id", "game", "sid"]
    per_cam = hit.groupBy(*shot, "back", "cam").agg(
        F.min(F.struct(F.abs("_d").alias("a"), F.col("_d"), F.struct("cx", "cy").alias("p"))).alias("b"))
    pos = per_cam.groupBy(*shot, "back").agg(          # at most one row per camera
        F.percentile(F.col("b.p.cx"), F.lit(0.5)).alias("cx"), F.percentile(F.col("b.p.cy"), F.lit(0.5)).alias("cy"))
    dist = pos.groupBy(*shot).agg(F.max(G.basket_distance(F.col("cx"), F.col("cy"))).alias("release_dist"))
    return dist.withColumn("zone", G.zone(F.col("release_dist")))


def isolation(shooters: DataFrame, positions: DataFrame, keys: Sequence[str], gid: str) -> DataFrame:
    """Distance from the shooter to the closest other player of the frame."""
    me = shooters.join(positions.select(*keys, gid, "cx", "cy"), [*keys, gid])
    other = positions.select(*keys, F.col(gid).alias("_o"), F.col("cx").alias("rx"), F.col("cy").alias("ry"))
    d = G.distance(F.col("cx"), F.col("cy"), F.col("rx"), F.col("ry"))
    return me.join(other, list(keys)).filter(F.col("_o") != F.col(gid)).groupBy(*keys, gid).agg(F.min(d).alias("iso"))


# --- shot-window feature table ---------------------------------------------------------------------------------
def covered_windows(windows: DataFrame, ranges: DataFrame, keys: Sequence[str], wid: str, n_cams: int, bucket: int) -> DataFrame:
    """Windows that lie inside the union of abutting ranges in every camera.

    The ranges are a small grid of equal chunks; a window is covered when every chunk it touches exists.
    """
    keys = list(keys)
    cell = ranges.select(*keys, "cam", F.floor(F.col("lo") / bucket).cast("long").alias("_c")).distinct()
    span = windows.withColumn("_need", F.floor((F.col("w1") - 1e-9) / bucket).cast("long") - F.floor(F.col("w0") / bucket).cast("long") + 1)
    touch = span.withColumn("_c", F.explode(F.sequence(F.floor(F.col("w0") / bucket).cast("long"), F.floor((F.col("w1") - 1e-9) / bucket).cast("long"))))
    have = touch.join(cell, [*keys, "_c"]).groupBy(*keys, wid, "_need").agg(F.count(F.lit(1)).alias("n"))
    return have.filter(F.col("n") == F.col("_need") * n_cams).select(*keys, wid)


def frame_spine(windows: DataFrame, cams: Sequence) -> DataFrame:
    """One row per (window, camera, frame)."""
    names = F.array(*[F.lit(c).cast("long") if isinstance(c, int) else F.lit(c) for c in cams])
    return windows.withColumn("cam", F.explode(names)).withColumn("frame", F.explode(F.sequence("f0", "f1"))).drop("f0", "f1")


def fold_by_side(df: DataFrame, bases: Sequence[str], left: Column) -> DataFrame:
    """Camera-suffixed feature columns to far/near-side ones, by which half the shot was on."""
    out = []
    for base in bases:
        fl, fr, nl, nr = (F.col(f"{base}_{c}") for c in ("FL", "FR", "NL", "NR"))
        out += [F.when(left, fl).otherwise(fr).alias(f"{base}_FARSIDE"), F.when(left, nl).otherwise(nr).alias(f"{base}_NEARSIDE")]
    return df.select("*", *out)


# --- assembly -----------------------------------------------------------------------------------------------------
def assemble(shots: DataFrame) -> DataFrame:
    """Final shot events: class, tier, confidence; rows with neither player nor verdict are dropped.
    `shots`: t, pred_player, pred_zone, release_dist, rq, verdict."""
    ft = F.coalesce(G.in_free_throw_band(F.col("release_dist"), F.col("pred_zone")), F.lit(False))
    tier = T.confidence_tier(F.col("rq"), F.col("verdict"))
    kept = shots.filter(F.col("pred_player").isNotNull() | F.col("verdict").isNotNull())
    return kept.withColumn("classification", T.shot_class(ft, F.col("pred_zone"), F.col("verdict"))).withColumn("tier", tier).withColumn(
        "confidence", T.tier_confidence(tier)).withColumn("player_a", F.regexp_replace(F.coalesce("pred_player", F.lit("?")), r"\?+$", ""))


def wrist_pick(ball: DataFrame, people: DataFrame, keys: Sequence[str], min_height: float = 100.0, min_score: float = 0.3, accept: float = 0.6) -> DataFrame:
    """Stream whose wrist is closest to the ball in box widths, among tall boxes around the ball.
    `people`: sid, box, wrists array<struct<x, y, s>>."""
    b = G.Box.of()
    w = b.width
    near = F.col("ball_x").between(b.x1 - w, b.x2 + w) & (F.col("ball_y") <= b.y2) & (b.height >= min_height)
    pairs = ball.join(people.select(*keys, "sid", "x1", "y1", "x2", "y2", "wrists"), list(keys)).filter(near)
    seen = F.filter("wrists", lambda k: k["s"] >= min_score)
    d = F.array_min(F.transform(seen, lambda k: G.distance(k["x"], k["y"], F.col("ball_x"), F.col("ball_y")) / w))
    best = pairs.withColumn("d", d).filter("d is not null").groupBy(*keys).agg(F.min(F.struct("d", "sid")).alias("b"))
    return best.select(*keys, F.col("b.sid").alias("sid"), F.col("b.d").alias("d"), (F.col("b.d") < accept).alias("accepted"))


def fuse_signals(rows: DataFrame, grid: Sequence[int], split_t: int) -> DataFrame:
    """appearance > free-throw band: vote > close: wrist > vote. The closeness limit is chosen on the first
    part of the game (largest wins ties) and applied to all of it."""
    limits = F.explode(F.array(*[F.lit(g) for g in grid]))
    near = (F.col("dist") < F.col("d_close")) & F.col("wrist").isNotNull()
    answer = F.when(F.col("appearance").isNotNull(), F.col("appearance")).when(F.col("dist").between(430, 610), F.col("vote")).when(near, F.col("wrist")).otherwise(F.col("vote"))
    x = rows.withColumn("d_close", limits).withColumn("ok", F.coalesce(answer, F.lit(False)))
    first = F.col("t") < split_t
    tally = x.groupBy("d_close").agg(
        F.sum((first & F.col("ok")).cast("long")).alias("fit_ok"), F.count(F.lit(1)).alias("n"), F.sum(F.col("ok").cast("long")).alias("n_ok"),
        F.sum((~first).cast("long")).alias("held_n"), F.sum((~first & F.col("ok")).cast("long")).alias("held_ok"))
    return tally.agg(F.max(F.struct("fit_ok", "d_close", "n", "n_ok", "held_n", "held_ok")).alias("b")).select("b.*")


def play_anchors(plays: DataFrame, players: DataFrame, start: float, duration: float, fps: float = 29.97, pre_s: float = 1.0) -> DataFrame:
    """Plays inside the clip (2 s slack), one per (tick, class), with the ids that wear the player's number.
    `players`: game, jersey, gid, team - a roster, so the candidate list is short."""
    t = F.col("ts") - start
    inside = plays.filter(t.between(-2.0, duration + 2.0)).groupBy("game", "tick", "cls").agg(F.min(F.struct("play_id", "ts", "jersey")).alias("b"))
    kind = T.play_kind(F.col("cls"))
    rows = inside.select("game", "cls", F.col("b.jersey").alias("jersey"), (F.col("b.ts") - start).alias("t_clip"), kind.alias("kind")).filter("kind <> 'ignore'")
    cands = players.groupBy("game", "jersey").agg(F.collect_set(F.struct("gid", "team")).alias("candidates"))
    out = rows.join(cands, ["game", "jersey"], "left")
    return out.withColumn("frame", F.bround(F.col("t_clip") * fps).cast("long")).withColumn(
        "n_candidates", F.coalesce(F.size("candidates"), F.lit(0))).withColumn("n_candidates", F.greatest("n_candidates", F.lit(0))).withColumn(
        "pre_frames", F.when(F.col("kind") == "shot", int(pre_s * fps)).otherwise(0))


def latest_holder(anchors: DataFrame, holders: DataFrame, keys: Sequence[str], lo: int, hi: int) -> DataFrame:
    """Holder at the last frame in [at+lo, at+hi] that has one."""
    wide = in_frames(anchors, keys, "at", lo, hi + 1)
    best = wide.join(holders.select(*keys, "frame", "holder"), [*keys, "frame"]).groupBy(*keys, "shot_id").agg(F.max(F.struct("frame", "holder")).alias("b"))
    return best.select(*keys, "shot_id", F.col("b.holder").alias("holder"), F.col("b.frame").alias("frame"))


def rim_story(ball: DataFrame, streams: DataFrame, rim: tuple[float, float, float], switch_k: int = 6, catch_k: int = 3, flight_v: float = 14.0) -> DataFrame:
    """Ball story with a RIM state (anything but HOLD counts as time since a hold): the holder each time the
    ball reaches the rim."""
    w = Window.partitionBy("game", "cam", "chunk").orderBy("frame")
    b = ball.withColumn("_v", G.distance(F.col("ball_x"), F.col("ball_y"), F.lag("ball_x").over(w), F.lag("ball_y").over(w)))
    key = ["game", "chunk", "frame"]
    at_rim = (F.abs(F.col("ball_x") - rim[0]) < rim[2]) & (F.abs(F.col("ball_y") - rim[1]) < rim[2])
    frames = b.groupBy(*key).agg(F.percentile(F.col("_v"), F.lit(0.5)).alias("speed"), F.max(at_rim).alias("rim"))
    spot = b.select("game", "cam", "chunk", "frame", "ball_x", "ball_y")
    pairs = spot.join(streams.select("game", "cam", "frame", "sid", "x1", "y1", "x2", "y2"), ["game", "cam", "frame"])
    vote = G.hold_vote(G.Box.of(), F.col("ball_x"), F.col("ball_y"), F.lit(0))
    votes = pairs.withColumn("w", vote).filter("w is not null").groupBy(*key, "sid").agg(F.floor(F.sum("w") * 1e6 + 0.5).alias("w"))
    top = votes.groupBy(*key).agg(F.min(F.struct((-F.col("w")).alias("nw"), F.col("sid"))).alias("t"))
    c = Window.partitionBy("game", "chunk").orderBy("frame")
    state = F.when(F.col("rim"), "RIM").when(F.col("t").isNotNull(), "HOLD").when(F.col("speed") > flight_v, "FLIGHT").otherwise("GAP")
    rows = frames.join(top, key, "left").withColumn("state", state)
    rows = rows.withColumn("lf", F.last(F.when(F.col("state") != "HOLD", F.col("frame")), ignorenulls=True).over(S.upto(c)))
    hold = rows.filter("state = 'HOLD'").withColumn("sid", F.col("t.sid")).withColumn("need", F.when(F.col("frame") - F.col("lf") <= 4, catch_k).otherwise(switch_k))
    taken = S.run_position(hold, ["game", "chunk"], "frame", F.col("sid"), "p").select(*key, F.when(F.col("p") >= F.col("need"), F.col("sid")).alias("taken"))
    told = rows.select(*key, "state").join(taken, key, "left").withColumn("holder", F.last("taken", ignorenulls=True).over(S.upto(c))).withColumn("_ps", F.lag("state").over(c))
    return told.filter((F.col("state") == "RIM") & ~F.col("_ps").eqNullSafe(F.lit("RIM"))).select(*key, "holder")
