"""Who holds the ball: votes, the ball story, hysteresis runs and the events derived from them."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtloom import constants as C
from courtloom.functions import geometry as G
from courtloom.operators import joins as J
from courtloom.operators import ordered as O
from courtloom.operators import sequence as S
from courtloom.operators import sync
from courtloom.operators.tracking import per_group
from courtloom.session import cut_lineage

REF = ("game", "chunk", "ref")


# --- votes per frame -----------------------------------------------------------------------------------------
def nearest_votes(ball_boxes: DataFrame, offsets: DataFrame, limit: float = C.VOTE_DIST) -> DataFrame:
    """Per camera the nearest stream within `limit` votes, twice when the ball is inside its box; per
    reference frame the stream with most votes (smaller id on ties)."""
    d = G.expanded_ball_distance(G.Box.of(), F.col("ball_x"), F.col("ball_y"))
    near = ball_boxes.withColumn("d", d).filter(F.col("d") < limit)
    top = near.groupBy("game", "cam", "chunk", "frame").agg(F.min(F.struct("d", "sid")).alias("b"))
    cast = sync.align(top.select("game", "cam", "chunk", "frame", "b.sid", F.when(F.col("b.d") == 0, 2).otherwise(1).alias("v")), offsets)
    votes = cast.groupBy(*REF, "sid").agg(F.sum("v").alias("votes"))
    best = votes.groupBy(*REF).agg(F.min(F.struct((-F.col("votes")).alias("nv"), F.col("sid"))).alias("b"))
    return best.select(*REF, F.col("b.sid").alias("sid"), (-F.col("b.nv")).alias("votes"))


def attribute_ball(ball: DataFrame, boxes: DataFrame, keys: Sequence[str], tid: str, expand: float = C.BOX_EXPAND, near: float = C.NEAR_FRAC) -> DataFrame:
    """Smallest expanded box containing the ball, else the nearest box centre within `near` heights."""
    b = G.Box.of()
    pairs = ball.join(boxes.select(*keys, tid, "x1", "y1", "x2", "y2"), list(keys))
    ex, ey = (b.x2 - b.x1) * expand, b.height * expand
    inside = F.col("ball_x").between(b.x1 - ex, b.x2 + ex) & F.col("ball_y").between(b.y1 - ey, b.y2 + ey)
    d = G.distance(F.col("ball_x"), F.col("ball_y"), b.cx, b.cy)
    pairs = pairs.withColumn("_rank", F.when(inside, 0).when(d <= near * b.height, 1)).withColumn("_m", F.when(inside, F.abs(b.area)).otherwise(d))
    best = pairs.filter("_rank is not null").groupBy(*keys).agg(F.min(F.struct("_rank", "_m", tid)).alias("b"))
    return best.select(*keys, F.col(f"b.{tid}").alias(tid), (F.col("b._rank") == 0).alias("inside"))


# --- the ball story --------------------------------------------------------------------------------------------
def observe(traj: DataFrame, streams: DataFrame, offsets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(votes per ref frame and stream, one row per ref frame with speed, flight vector and state).

    `traj`: game, cam, chunk, frame, ball_x, ball_y, vx, vy, imputed, conf. `streams`: game, cam, frame, sid, box.
    """
    speed = G.hypot(F.col("vx"), F.col("vy"))
    ball = sync.align(traj, offsets).withColumn("speed", speed)
    pairs = ball.join(streams.select("game", "cam", "frame", "sid", "x1", "y1", "x2", "y2"), ["game", "cam", "frame"])
    weight = G.hold_vote(G.Box.of(), F.col("ball_x"), F.col("ball_y"), F.col("imputed"))
    votes = pairs.withColumn("w", weight).filter("w is not null").groupBy(*REF, "sid").agg(F.floor(F.sum("w") * 1e6 + 0.5).alias("w"))
    fast = F.when(F.col("speed") > C.FLIGHT_V, F.struct(F.col("conf"), (-F.col("cam")).alias("nc"), "ball_x", "ball_y", "vx", "vy"))
    # at most one ball per camera and ref frame, so the median sees a handful of values
    frames = ball.groupBy(*REF).agg(F.percentile(F.col("speed"), F.lit(0.5)).alias("speed"), F.max(fast).alias("vec"))
    top = votes.groupBy(*REF).agg(F.min(F.struct((-F.col("w")).alias("nw"), F.col("sid"))).alias("t"))
    rows = frames.join(top, list(REF), "left").withColumn(
        "state", F.when(F.col("t").isNotNull(), "HOLD").when(F.col("speed") > C.FLIGHT_V, "FLIGHT").otherwise("GAP"))
    return votes, rows


def ball_story(traj: DataFrame, streams: DataFrame, offsets: DataFrame, switch_k: int = C.SWITCH_K, catch_k: int = C.CATCH_K,
               since: int = C.SINCE_FLIGHT) -> DataFrame:
    """Takeovers of the ball: (game, chunk, ref, holder, last_ref), one row per change of holder.

    A candidate needs `switch_k` consecutive holds, or `catch_k` just after a flight; the stream whose box
    contains the extrapolated landing point of that flight is preferred. All state is window-computable
    inside a chunk: last flight, run position, last accepted holder.
    """
    votes, rows = observe(traj, streams, offsets)
    w = S.upto(Window.partitionBy("game", "chunk").orderBy("ref"))
    flight = F.col("state") == "FLIGHT"
    rows = rows.withColumn("lf", F.last(F.when(flight, F.col("ref")), ignorenulls=True).over(w)).withColumn(
        "lv", F.last(F.when(flight & F.col("vec").isNotNull(), F.struct("ref", "vec")), ignorenulls=True).over(w))
    hold = rows.filter("state = 'HOLD'").withColumn("fresh", F.coalesce(F.col("ref") - F.col("lf") <= since, F.lit(False)))
    land = hold.filter(F.col("fresh") & F.col("lv").isNotNull()).select(
        *REF, (-F.col("lv.vec.nc")).alias("cam"), (F.col("ref") - F.col("lv.ref")).alias("dt"), F.col("lv.vec").alias("v"))
    point = land.join(F.broadcast(offsets), ["game", "cam"]).select(
        *REF, "cam", (F.col("ref") + F.col("off")).alias("frame"),
        (F.col("v.ball_x") + F.col("v.vx") * F.col("dt")).alias("px"), (F.col("v.ball_y") + F.col("v.vy") * F.col("dt")).alias("py"))
    boxes = streams.select("game", "cam", "frame", "sid", "x1", "y1", "x2", "y2")
    hit = point.join(boxes, ["game", "cam", "frame"]).filter(G.Box.of().contains(F.col("px"), F.col("py"), 10, 0, 20))
    named = hit.join(votes, [*REF, "sid"]).groupBy(*REF).agg(F.min(F.struct((-F.col("w")).alias("nw"), F.col("sid"))).alias("l"))
    tops = hold.join(named.select(*REF, F.col("l.sid").alias("landing")), list(REF), "left").select(
        *REF, F.coalesce("landing", "t.sid").alias("top"), F.when(F.col("fresh"), catch_k).otherwise(switch_k).alias("need"))
    placed = S.run_position(tops, ["game", "chunk"], "ref", F.col("top"), "p")
    held = placed.withColumn("holder", F.when(F.col("p") >= F.col("need"), F.col("top"))).filter("holder is not null")
    prev = F.lag("holder").over(Window.partitionBy("game", "chunk").orderBy("ref"))
    last = rows.groupBy("game", "chunk").agg(F.max("ref").alias("last_ref"))
    changes = held.withColumn("_prev", prev).filter("_prev is null or _prev <> holder")
    return changes.join(last, ["game", "chunk"]).select(*REF, "holder", "last_ref")


def story_segments(takeovers: DataFrame, max_gap: int = 3, block: int = C.BLOCK_FRAMES) -> DataFrame:
    """Holder segments of a whole game: each takeover lasts to the next one (or the end of its chunk); equal
    neighbours across chunk edges are joined."""
    nxt = F.lead("ref").over(Window.partitionBy("game", "chunk").orderBy("ref"))
    seg = takeovers.withColumn("end_frame", F.coalesce(nxt - 1, F.col("last_ref"))).select(
        "game", F.col("ref").alias("start_frame"), "end_frame", F.col("holder").alias("value"))
    return merge_segments(seg, ["game"], max_gap, block)


def merge_segments(seg: DataFrame, keys: Sequence[str], max_gap: int, block: int = C.BLOCK_FRAMES) -> DataFrame:
    """Join neighbouring segments of equal value at most max_gap apart.

    Segments are read several times below, so they are written once (they are the small, run-length form)."""
    keys = list(keys)
    seg = cut_lineage(seg)
    body = F.struct("end_frame", "value")
    prev = O.carry_last(seg, keys, "start_frame", body, "_p", block, inclusive=False)
    fresh = ~F.coalesce((F.col("_p.value") == F.col("value")) & (F.col("start_frame") - F.col("_p.end_frame") <= max_gap), F.lit(False))
    run = O.carry_last(prev.withColumn("_f", fresh).drop("_p"), keys, "start_frame", F.when(F.col("_f"), F.col("start_frame")), "_s", block)
    return run.groupBy(*keys, "_s", "value").agg(F.max("end_frame").alias("end_frame"), F.count(F.lit(1)).alias("parts")).withColumnRenamed("_s", "start_frame")


# --- hysteresis runs (the needed streak depends on the state, so these are folds over a chunk) ---------------------
def _runs(frames, held, min_frames: int) -> list[tuple]:
    out, start, prev = [], None, None
    for i, h in enumerate([*held, None]):
        if start is not None and h != prev:
            if frames[i - 1] - frames[start] + 1 >= min_frames:
                out.append((frames[start], frames[i - 1], prev))
            start = None
        if h is not None and start is None:
            start = i
        prev = h
    return out


def holder_runs(stream: DataFrame, keys: Sequence[str], switch: int = C.SWITCH_K, loose: int = C.LOOSE_CONFIRM, lost_after: int = C.PASS_MAX_GAP,
                min_frames: int = C.MIN_POSS_FRAMES) -> DataFrame:
    """Runs of an image-space holder stream (frame, gid; null = nobody) with hysteresis."""
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("frame")
        frames, gids = p["frame"].tolist(), [None if pd.isna(g) else int(g) for g in p["gid"]]
        holder, rival, streak, shown, held = None, None, 0, None, []
        for f, g in zip(frames, gids):
            if g is None:
                rival, streak = None, 0
                if holder is not None and shown is not None and f - shown > lost_after:
                    holder = None
            elif g == holder:
                rival, streak = None, 0
            else:
                streak, rival = (streak + 1 if g == rival else 1), g
                if streak >= (loose if holder is None else switch):
                    holder, rival, streak = g, None, 0
            got = holder if g is not None and g == holder else None
            shown = f if got is not None else shown
            held.append(got)
        return pd.DataFrame(_runs(frames, held, min_frames), columns=["start_frame", "end_frame", "gid"])

    return per_group(stream, keys, work, "start_frame long, end_frame long, gid long")


def sticky_runs(dist: DataFrame, keys: Sequence[str], radius: float = C.POSS_RADIUS, margin: float = C.STICKY_MARGIN, switch: int = C.SWITCH_K,
                loose: int = C.LOOSE_CONFIRM, min_frames: int = C.MIN_POSS_FRAMES) -> DataFrame:
    """Runs of the sticky nearest player: the holder keeps the ball unless someone is clearly closer for
    long enough. `dist`: frame, gid, dist; a frame without ball has one row with a null dist."""
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        holder, rival, streak, frames, held = None, None, 0, [], []
        for f, g in pdf.sort_values(["frame", "gid"]).groupby("frame", sort=True):
            near = dict(zip(g["gid"], g["dist"]))
            frames.append(int(f))
            closest = min(near, key=near.get) if g["dist"].notna().all() else None
            if closest is None or near[closest] > radius:
                holder, rival, streak = None, None, 0
                held.append(None)
                continue
            mine = near.get(holder, float("inf"))
            if mine <= radius and mine <= near[closest] + margin:
                rival, streak = None, 0
            else:
                streak, rival = (streak + 1 if closest == rival else 1), closest
                if streak >= (loose if holder is None else switch):
                    holder, rival, streak = closest, None, 0
            held.append(None if holder is None else int(holder))
        return pd.DataFrame(_runs(frames, held, min_frames), columns=["start_frame", "end_frame", "gid"])

    return per_group(dist, keys, work, "start_frame long, end_frame long, gid long")


def temporal_gate(points: DataFrame, keys: Sequence[str], px: float = 90.0, k: int = 3) -> DataFrame:
    """Accept points continuous with the last accepted one; a jump must persist `k` consistent points."""
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("frame")
        last, wait, kept = None, [], []

        def reach(a, b) -> bool:
            return ((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) ** 0.5 <= px * max(1, a[0] - b[0])

        for now in zip(p["frame"].tolist(), p["ball_x"].tolist(), p["ball_y"].tolist()):
            if last is not None and reach(now, last):
                kept.append(now[0])
                last, wait = now, []
                continue
            wait = [q for q in wait if now[0] - q[0] <= k + 1 and reach(now, q)] + [now]
            if len(wait) >= k:
                kept += [q[0] for q in wait]
                last, wait = now, []
        return pd.DataFrame({"frame": kept})

    return per_group(points, keys, work, "frame long")


# --- events -------------------------------------------------------------------------------------------------------
def run_events(runs: DataFrame, keys: Sequence[str], teams: DataFrame, max_gap: int = C.PASS_MAX_GAP, block: int = C.BLOCK_FRAMES) -> DataFrame:
    """possession per run; pass / turnover between neighbouring runs of different ids. `teams`: keys, gid, team."""
    keys = list(keys)
    known = cut_lineage(runs.join(teams, [*keys, "gid"], "left"))
    prev = O.carry_last(known, keys, "start_frame", F.struct("end_frame", "gid", "team"), "p", block, inclusive=False)
    poss = prev.select(*keys, F.lit("possession").alias("event"), F.col("start_frame").alias("frame"), "gid", F.lit(None).cast("long").alias("to_gid"), "team")
    handed = (F.col("start_frame") - F.col("p.end_frame") <= max_gap) & (F.col("p.gid") != F.col("gid"))
    kind = F.when(F.col("p.team").eqNullSafe(F.col("team")), "pass").otherwise("turnover")
    change = prev.filter(handed).select(*keys, kind.alias("event"), F.col("p.end_frame").alias("frame"), F.col("p.gid").alias("gid"),
                                        F.col("gid").alias("to_gid"), F.col("p.team").alias("team"))
    return poss.unionByName(change)


def fast_breaks(world: DataFrame, keys: Sequence[str], win: int, cm: float = C.FASTBREAK_CM) -> DataFrame:
    """First frame per team from which the team centroid travels `cm` in about `win` frames.
    Keys are (game, chunk): a centroid row per frame bounds the window."""
    keys = list(keys)
    c = world.filter(F.col("team").isin("A", "B")).groupBy(*keys, "team", "frame").agg(F.avg("cx").alias("x"))
    # in reverse order the frames at least `win` later are a growing prefix, and the nearest of them is its last row
    w = Window.partitionBy(*keys, "team").orderBy(F.desc("frame")).rangeBetween(Window.unboundedPreceding, -win)
    nxt = F.last(F.struct("frame", "x")).over(w)
    moved = c.withColumn("n", nxt).withColumn("dx", F.col("n.x") - F.col("x")).filter(F.abs("dx") >= cm)
    best = moved.groupBy(*keys, "team").agg(F.min(F.struct("frame", F.col("n.frame").alias("f1"), "dx")).alias("b"))
    return best.select(*keys, "team", F.col("b.frame").alias("f0"), "b.f1", F.bround("b.dx").alias("dx"),
                       F.when(F.col("b.dx") > 0, "right").otherwise("left").alias("direction"))


def team_blocks(seg: DataFrame, keys: Sequence[str], merge_gap: float, min_length: float, block: int = C.BLOCK_FRAMES) -> DataFrame:
    """Merge same-team segments, keep long blocks, with first and last player.
    `seg`: start_frame, end_frame, team, player."""
    keys = list(keys)
    prev = O.carry_last(cut_lineage(seg.filter("team is not null")), keys, "start_frame", F.struct("end_frame", "team"), "_p", block, inclusive=False)
    fresh = ~F.coalesce((F.col("_p.team") == F.col("team")) & (F.col("start_frame") - F.col("_p.end_frame") <= merge_gap), F.lit(False))
    run = O.carry_last(prev.withColumn("_f", fresh).drop("_p"), keys, "start_frame", F.when(F.col("_f"), F.col("start_frame")), "f0", block)
    out = run.groupBy(*keys, "f0", "team").agg(
        F.max_by("end_frame", "start_frame").alias("f1"), F.min_by("player", "start_frame").alias("first_player"), F.max_by("player", "start_frame").alias("last_player"))
    return out.filter(F.col("f1") - F.col("f0") + 1 >= min_length)


def turnovers(blocks: DataFrame, shots: DataFrame, keys: Sequence[str], max_gap: float, guard: int, block: int = C.BLOCK_FRAMES) -> DataFrame:
    """Team changes between neighbouring blocks with no shot close by: TURNOVER of the last holder and
    STEAL of the first new one. `shots`: keys, frame (unique)."""
    keys = list(keys)
    prev = O.carry_last(cut_lineage(blocks), keys, "f0", F.struct("f1", "team", "last_player"), "p", block, inclusive=False)
    change = prev.filter((F.col("p.team") != F.col("team")) & (F.col("f0") - F.col("p.f1") <= max_gap))
    near = J.nearest_in_time(change.select(*keys, F.col("f0").alias("frame"), F.col("p.last_player").alias("lost_by"), F.col("first_player").alias("won_by")),
                             shots.select(*keys, "frame", F.lit(1).alias("one")), keys, "frame", ["one"], guard, block)
    live = near.filter("m_one is null")
    pair = F.explode(F.array(F.struct(F.lit("TURNOVER").alias("c"), F.col("lost_by").alias("p")), F.struct(F.lit("STEAL").alias("c"), F.col("won_by").alias("p"))))
    return live.select(*keys, "frame", pair.alias("e")).select(*keys, "frame", F.col("e.c").alias("classification"), F.col("e.p").alias("player_a"))


def rebounds(misses: DataFrame, seg: DataFrame, keys: Sequence[str], before: int = 4, after: int = 134, width: int = 256) -> DataFrame:
    """First new holder after each miss. `misses`: keys, miss_id, frame, team; `seg`: start_frame, end_frame, value, team."""
    keys = list(keys)
    at = J.point_in_segment(misses.select(*keys, "miss_id", "frame"), seg.select(*keys, "start_frame", "end_frame", "value"), keys, "frame", "start_frame", "end_frame", width)
    new = J.first_new_after(at.select(*keys, "miss_id", "frame", "value"), seg, keys, "miss_id", "frame", "start_frame", "value", "value", before, after)
    who = seg.groupBy(*keys, F.col("value").alias("new_value")).agg(F.min("team").alias("new_team"))
    out = new.join(who, [*keys, "new_value"], "left").join(misses.select(*keys, "miss_id", F.col("team").alias("shot_team")), [*keys, "miss_id"])
    kind = F.when(F.col("new_team").isNull() & F.col("shot_team").isNotNull(), "?").when(F.col("shot_team").isNull(), "?").when(
        F.col("new_team") == F.col("shot_team"), "OFF").otherwise("DEF")
    return out.withColumn("off_def", kind)


def longest_hold(misses: DataFrame, seg: DataFrame, keys: Sequence[str], lo: int, hi: int, sustain: int = C.SUSTAIN_F) -> DataFrame:
    """Longest segment beginning in [frame+lo, frame+hi] with at least `sustain` frames inside the window."""
    keys, width = list(keys), hi - lo + 1
    m = misses.withColumn("_lo", F.col("frame") + lo).withColumn("_hi", F.col("frame") + hi).withColumn(
        "_b", F.explode(F.sequence(F.floor(F.col("_lo") / width), F.floor(F.col("_hi") / width))))
    s = seg.select(*keys, "start_frame", "end_frame", "value").withColumn("_b", F.floor(F.col("start_frame") / width))
    c = m.join(s, [*keys, "_b"]).filter(
        F.col("start_frame").between(F.col("_lo"), F.col("_hi")) & (F.least("end_frame", "_hi") - F.col("start_frame") + 1 >= sustain))
    best = c.groupBy(*keys, "miss_id").agg(F.max(F.struct((F.col("end_frame") - F.col("start_frame")).alias("len"), (-F.col("start_frame")).alias("ns"), "value")).alias("b"))
    return best.select(*keys, "miss_id", (-F.col("b.ns")).alias("start_frame"), F.col("b.value").alias("value"), F.col("b.len").alias("length"))


def override_by_evidence(picks: DataFrame, evidence: DataFrame, keys: Sequence[str], factor: float = 1.5) -> DataFrame:
    """Replace a pick when another stream has `factor` times its under-ball evidence.
    `picks`: keys, sid; `evidence`: keys, sid, score."""
    keys = list(keys)
    # a key has one score for each stream in view: they meet the pick in one row
    found = evidence.groupBy(*keys).agg(F.max(F.struct(F.col("score"), F.col("sid"))).alias("b"), F.collect_list(F.struct("sid", "score")).alias("_all"))
    mine = F.get(F.filter("_all", lambda e: e["sid"] == F.col("sid")), F.lit(0))
    own = picks.join(found, keys, "left").withColumn("own", mine["score"])
    beaten = (F.col("b.sid") != F.col("sid")) & (F.col("b.score") >= factor * F.coalesce("own", F.lit(1e-9)))
    return own.select(*keys, F.when(F.coalesce(beaten, F.lit(False)), F.col("b.sid")).otherwise(F.col("sid")).alias("sid"),
                      F.coalesce(beaten, F.lit(False)).alias("overridden"))


def modal_holder(plays: DataFrame, holders: DataFrame, keys: Sequence[str], pid: str, lo: Column, hi: Column) -> DataFrame:
    """Most frequent holder in the frames [lo, hi) around a play and its freshest frame.
    The window is a fixed number of frames; holders are unique per frame."""
    keys = list(keys)
    wide = plays.withColumn("frame", F.explode(F.sequence(lo, hi - 1)))
    votes = wide.join(holders.select(*keys, "frame", "holder"), [*keys, "frame"]).groupBy(*keys, pid, "holder").agg(
        F.count(F.lit(1)).alias("c"), F.min("frame").alias("f"), F.max("frame").alias("fresh"))
    best = votes.groupBy(*keys, pid).agg(F.max(F.struct("c", (-F.col("f")).alias("nf"), "holder", "fresh")).alias("b"))
    return best.select(*keys, pid, F.col("b.holder").alias("holder"), F.col("b.c").alias("votes"), F.col("b.fresh").alias("fresh"))


def with_caveat(events: DataFrame, ball: DataFrame, games: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Games without any ball row carry one caveat row instead of possession events."""
    keys = list(keys)
    seen = ball.select(*keys).distinct()
    kept = events.join(seen, keys, "left_semi").withColumn("caveat", F.lit(None).cast("string"))
    none = games.select(*keys).distinct().join(seen, keys, "left_anti").withColumn("caveat", F.lit("no ball trace: possession events skipped"))
    return kept.unionByName(none, allowMissingColumns=True)
