"""Who is who: team letters, number seeds, claims, tracklet links and identity patches (relational)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtloom import constants as C
from courtloom.functions import geometry as G
from courtloom.operators import ordered as O
from courtloom.operators import tracking as T
from courtloom.operators.joins import FRAME, segment_buckets
from courtloom.session import cut_lineage

PAIRS = 500_000                 # pairs of rows that a task compares at a time


# --- cross-camera team agreement ---------------------------------------------------------------------------
def isolated_pairs(tracks: DataFrame, near: float = 80.0, clear: float = 180.0, block: int = C.BLOCK_FRAMES) -> DataFrame:
    """Pairs of the same spot on court seen by two cameras with no second candidate close by, for every pair of cameras
    (cam1 < cam2).

    One row per track of cam1 and frame that has such a partner; team A/B rows only. Pairs of a block of frames are met in a
    task, `PAIRS` or one frame at a time, and only isolated ones leave it.
    """
    players = tracks.filter(F.col("team").isin("A", "B")).select(
        "game", O.block_of("frame", block).alias("_blk"), "frame", "cam", "track_id", F.col("team").alias("kit"), "cx", "cy")
    kind = {f.name: f.dataType.simpleString() for f in players.schema.fields}

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("frame", kind="stable")
        frame, cam, track, kit = (p[c].to_numpy() for c in ("frame", "cam", "track_id", "kit"))
        x, y = p["cx"].to_numpy(dtype=float), p["cy"].to_numpy(dtype=float)
        start, end = np.searchsorted(frame, frame), np.searchsorted(frame, frame, side="right")
        size, cuts, at, found = np.cumsum(end - start), np.append(start, len(p)), 0, []
        while at < len(p):
            to = max(int(end[at]), int(cuts[np.searchsorted(size, (size[at - 1] if at else 0) + PAIRS, side="right")]))
            n = (end - start)[at:to]
            i = np.repeat(np.arange(at, to), n)
            j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[at:to], n)
            up = cam[i] < cam[j]
            i, j = i[up], j[up]
            dist = np.sqrt((x[i] - x[j]) * (x[i] - x[j]) + (y[i] - y[j]) * (y[i] - y[j]))
            order = np.lexsort((track[j], dist, cam[j], i))
            i, j, dist = i[order], j[order], dist[order]
            new = np.ones(len(i) + 1, dtype=bool)               # the nearest of a track and camera
            new[1:-1] = (i[1:] != i[:-1]) | (cam[j[1:]] != cam[j[:-1]])
            second = np.where(new[1:], np.nan, np.append(dist[1:], np.nan))
            keep = new[:-1] & (dist <= near) & (np.isnan(second) | (second >= clear))
            i, j = i[keep], j[keep]
            found.append(pd.DataFrame({"frame": frame[i], "cam1": cam[i], "t1": track[i], "team1": kit[i], "cam2": cam[j], "t2": track[j],
                                       "team2": kit[j], "dist": dist[keep]}))
            at = to
        return pd.concat(found)

    one, two = (f"cam{k} {kind['cam']}, t{k} {kind['track_id']}, team{k} string" for k in (1, 2))
    return T.per_group(players, ["game", "_blk"], work, f"frame {kind['frame']}, {one}, {two}, dist double").drop("_blk")


def flip_decision(pairs: DataFrame) -> DataFrame:
    """Per game and pair of cameras: does the second camera use the letters the other way round?"""
    same = F.sum((F.col("team1") == F.col("team2")).cast("long"))
    flip = F.sum((F.col("team1") != F.col("team2")).cast("long"))
    return pairs.groupBy("game", "cam1", "cam2").agg(same.alias("same"), flip.alias("flip")).withColumn("flipped", F.col("flip") > F.col("same"))


def team_repair(pairs: DataFrame, min_votes: int = 8, min_share: float = 0.8) -> DataFrame:
    """Tracks whose partners in one other camera consistently wear one letter: (cam1, cam2, side, track) -> team."""
    one = pairs.select("game", "cam1", "cam2", F.lit(1).alias("side"), F.col("t1").alias("track_id"), F.col("team2").alias("team"), "frame")
    two = pairs.select("game", "cam1", "cam2", F.lit(2).alias("side"), F.col("t2").alias("track_id"), F.col("team1").alias("team"), "frame")
    keys = ["game", "cam1", "cam2", "side", "track_id"]
    votes = one.unionByName(two).groupBy(*keys, "team").agg(F.count(F.lit(1)).alias("c"), F.min("frame").alias("f"))
    top = votes.groupBy(*keys).agg(F.sum("c").alias("n"), F.max(F.struct("c", -F.col("f"), "team")).alias("b"))
    keep = (F.col("b.c") >= min_votes) & (F.col("b.c") / F.col("n") >= min_share)
    return top.filter(keep).select(*keys, F.col("b.team").alias("team"), F.col("b.c").alias("votes"))


# --- number reads ---------------------------------------------------------------------------------------------
def seed_reads(reads: DataFrame, person: Sequence[str], cam: str, min_reads: int, min_conf: float, rid: str) -> DataFrame:
    """Earliest confident read per person and camera, for people with enough reads."""
    person = list(person)
    enough = reads.groupBy(*person).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_reads).select(*person)
    seeds = reads.filter(F.col("score") >= min_conf).groupBy(*person, cam).agg(F.min(F.struct("frame", rid)).alias("b"))
    return seeds.join(enough, person, "left_semi").select(*person, cam, F.col("b.frame").alias("seed_frame"), F.col(f"b.{rid}").alias(rid))


def seed_claims(reads: DataFrame, boxes: DataFrame, rid: str, near: int = 15, every: int = 5, iou_attach: float = 0.4, iou_claimed: float = 0.5,
                together: int = 4) -> DataFrame:
    """(game, cam, frame, num, wearer, rid, det_idx): who stands where in each `every`-th frame, by the reads within `near`
    frames. Reads visit those frames and claim their best box, nearest in time first (ties: earlier read, then smaller id).

    A claim is exclusive: a read whose box overlaps a claimed one by more than `iou_claimed` gets none. A number may be worn
    twice, once in either team: a second claim of it must come from a read within `together` frames of the first one's;
    `wearer` numbers the claims of a number in the order of their reads (0, 1). The fold holds the reads of one camera
    around one frame."""
    edges = ("x1", "y1", "x2", "y2")
    samples = boxes.filter(F.col("frame") % every == 0).select("game", "cam", "frame", "det_idx", *[F.col(c).alias(f"b_{c}") for c in edges])
    reach = reads.select("game", "cam", F.col("frame").alias("rf"), rid, "num", *edges, F.explode(F.sequence(F.col("frame") - near, F.col("frame") + near)).alias("frame"))
    pairs = reach.filter(F.col("frame") % every == 0).join(samples, list(FRAME))
    pairs = pairs.withColumn("iou", G.iou(G.Box.of(), G.Box.of("b_"))).filter(F.col("iou") >= iou_attach)
    best = pairs.groupBy(*FRAME, "rf", rid, "num").agg(F.max(F.struct("iou", -F.col("det_idx"), *[F.col(f"b_{c}") for c in edges])).alias("b"))
    claim = F.struct(F.abs(F.col("rf") - F.col("frame")).alias("gap"), "rf", F.col(rid).alias("rid"), "num", (-F.col("b.col2")).alias("det_idx"), *[F.col(f"b.b_{c}").alias(c) for c in edges])
    lists = best.groupBy(*FRAME).agg(F.sort_array(F.collect_list(claim)).alias("_r"))

    def step(taken: Column, r: Column) -> Column:
        same = F.filter(taken, lambda t: t["num"] == r["num"])
        box = lambda t: G.Box(*[t[c] for c in edges])      # noqa: E731
        free = ~F.exists(taken, lambda t: G.iou(box(t), box(r)) > iou_claimed)
        fits = (F.size(same) == 0) | ((F.size(same) == 1) & (F.abs(F.get(same, F.lit(0))["rf"] - r["rf"]) <= together))
        return F.when(free & fits, F.concat(taken, F.array(r))).otherwise(taken)

    kept = lists.select(*FRAME, F.aggregate("_r", F.slice("_r", 1, 0), step).alias("_t"))
    earlier = F.expr("size(filter(_t, (t, k) -> t.num = c.num and (t.rf < c.rf or (t.rf = c.rf and k < at))))")
    flat = kept.select(*FRAME, "_t", F.posexplode("_t").alias("at", "c"))
    return flat.select(*FRAME, "c.num", earlier.alias("wearer"), F.col("c.rid").alias(rid), "c.det_idx")


def best_common_seed(reads: DataFrame, boxes: DataFrame, rid: str, near: int = 15, every: int = 5, iou_attach: float = 0.4, together: int = 4) -> DataFrame:
    """Per camera the frame (every `every`-th) in which most players are confirmed by exclusive claims of reads; the earliest of equal ones."""
    count = seed_claims(reads, boxes, rid, near, every, iou_attach, together=together).groupBy(*FRAME).agg(F.count(F.lit(1)).alias("n"))
    top = count.groupBy("game", "cam").agg(F.max(F.struct("n", -F.col("frame"))).alias("b"))
    return top.select("game", "cam", (-F.col("b.col2")).alias("frame"), F.col("b.n").alias("n_players"))


def name_instances(seeds: DataFrame, instances: DataFrame, person: Sequence[str], inst: str, min_iou: float = 0.5) -> DataFrame:
    """Each (player, camera) takes the mask instance with the best seed overlap."""
    pairs = seeds.join(instances, list(FRAME)).withColumn("iou", G.iou(G.Box.of(), G.Box.of("b_"))).filter(F.col("iou") >= min_iou)
    best = pairs.groupBy(*person).agg(F.max(F.struct(F.col("iou"), (-F.col(inst)).alias("i"))).alias("b"))
    return best.select(*person, (-F.col("b.i")).alias(inst), F.col("b.iou").alias("iou"))


def co_occurrence(segments: DataFrame, keys: Sequence[str], sid: str, start: str, end: str, width: int) -> DataFrame:
    """Number of overlapping segment pairs of different ids per key. Segments visit the time buckets they
    cover and meet there; a pair is counted in the bucket where its overlap begins. Within a bucket and key
    the count is done by inclusion-exclusion over starts and ends, not by forming pairs."""
    keys = list(keys)
    seg = segments.select(*keys, sid, F.col(start).alias("s"), F.col(end).alias("e"))
    # pairs overlapping = for each segment, the segments of other ids with s' <= e and e' >= s, halved.
    # count via an event line: at a start, every other open segment overlaps it.
    marks = seg.select(*keys, sid, F.col("s").alias("t"), F.lit(0).alias("k")).unionByName(
        seg.select(*keys, sid, (F.col("e") + 1).alias("t"), F.lit(-1).alias("k")))
    per_t = marks.groupBy(*keys, sid, "t").agg(
        F.sum((F.col("k") == 0).cast("long")).alias("st"), F.sum((F.col("k") == -1).cast("long")).alias("en"))
    total = per_t.groupBy(*keys, "t").agg(
        F.sum("st").alias("st"), F.sum("en").alias("en"), F.sum(F.col("st") * F.col("st")).alias("own2"))
    # open before t (after closing those ending at t), over all ids and per id
    all_open = O.running_sum(total, keys, "t", F.col("st") - F.col("en"), "open", width * 64)
    own = O.running_sum(per_t, [*keys, sid], "t", F.col("st") - F.col("en"), "open", width * 64)
    cross = all_open.withColumn("before", F.col("open") - F.col("st"))
    everyone = cross.groupBy(*keys).agg(
        F.sum(F.col("st") * F.col("before") + F.col("st") * (F.col("st") - 1) / 2).alias("all_pairs"))
    mine = own.withColumn("before", F.col("open") - F.col("st")).groupBy(*keys).agg(
        F.sum(F.col("st") * F.col("before") + F.col("st") * (F.col("st") - 1) / 2).alias("own_pairs"))
    out = everyone.join(mine, keys).withColumn("n", (F.col("all_pairs") - F.col("own_pairs")).cast("long"))
    return out.filter("n > 0").select(*keys, "n")


def claims(tracks: DataFrame, reads: DataFrame, min_iou: float = 0.35, min_conf: float = 0.8, dual: Sequence[int] = ()) -> DataFrame:
    """A confident read claims the best-overlapping track from that frame on; a later read re-claims.
    One track per number and frame, the higher score winning. A number worn by both teams needs a kit.
    Tracks live inside a chunk, so the ordered part is keyed by (game, cam, chunk, track)."""
    label = F.when(F.col("num").isin(*dual), F.concat("num", "kit")).otherwise(F.col("num").cast("string")) if dual else F.col("num").cast("string")
    usable = reads.filter(F.col("score") >= min_conf).withColumn("label", label).filter("label is not null")
    r = usable.select(*FRAME, "label", F.col("score").alias("conf"), *[F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")])
    pairs = tracks.join(r, list(FRAME)).withColumn("iou", G.iou(G.Box.of(), G.Box.of("b_"))).filter(F.col("iou") >= min_iou)
    best = pairs.groupBy(*FRAME, "label").agg(F.max(F.struct(F.col("iou"), (-F.col("track_id")).alias("t"), F.col("conf"))).alias("b"))
    best = best.select(*FRAME, (-F.col("b.t")).alias("track_id"), F.col("b.conf").alias("conf"), "label")
    hit = best.groupBy(*FRAME, "track_id").agg(F.max(F.struct("conf", "label")).alias("b")).select(*FRAME, "track_id", F.col("b.label").alias("claim"))
    w = Window.partitionBy("game", "cam", "chunk", "track_id").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    held = tracks.join(hit, [*FRAME, "track_id"], "left").withColumn("label", F.last("claim", ignorenulls=True).over(w)).filter("label is not null")
    top = held.groupBy(*FRAME, "label").agg(F.max(F.struct(F.col("score"), (-F.col("track_id")).alias("t"))).alias("b"))
    return top.select(*FRAME, "label", (-F.col("b.t")).alias("track_id"))


# --- aliases and patches ---------------------------------------------------------------------------------------
def resolve_aliases(parents: DataFrame, child: str = "child", parent: str = "parent", keys: Sequence[str] = ()) -> DataFrame:
    """Follow child -> parent to the root by pointer jumping: log2(longest chain) rounds, each a join. A chain has at
    most as many links as there are rows, so rows that still move after that many doublings run in a circle: an error."""
    keys = list(keys)
    current = cut_lineage(parents.select(*keys, child, parent).distinct())
    rounds = max(1, current.count()).bit_length() + 1
    for k in range(rounds + 1):
        if k == rounds:
            raise ValueError(f"aliases run in a circle: {current.take(3)}")
        up = current.select(*keys, F.col(child).alias(parent), F.col(parent).alias("_up"))
        jumped = cut_lineage(
            current.join(up, [*keys, parent], "left").select(
                *keys, child, F.coalesce("_up", parent).alias(parent), F.col("_up").isNotNull().alias("_moved")))
        current = jumped.drop("_moved")
        if jumped.filter("_moved").isEmpty():
            break
    return current


def apply_patches(boxes: DataFrame, patches: DataFrame, keys: Sequence[str], width: int = 256) -> DataFrame:
    """Move boxes of (sid, keys, frame range) to the patch target; a moved box replaces the target's own."""
    keys = list(keys)
    p = segment_buckets(patches, "f0", "f1", width).withColumnRenamed("sid", "sid_from")
    b = boxes.withColumnRenamed("sid", "sid_from").withColumn("_b", F.floor(F.col("frame") / width).cast("long"))
    hit = b.join(p.select(*keys, "sid_from", "f0", "f1", F.col("new").alias("_new"), "_b"), [*keys, "sid_from", "_b"], "left")
    inside = F.col("frame").between(F.col("f0"), F.col("f1"))
    value = [c for c in boxes.columns if c not in (*keys, "sid", "frame")]
    rows = hit.groupBy(*keys, "sid_from", "frame", *value).agg(F.max(F.when(inside, F.col("_new"))).alias("_new"))
    rows = rows.withColumn("sid", F.coalesce("_new", "sid_from")).withColumn("moved", F.col("_new").isNotNull().cast("int"))
    return O.best_per(rows, [*keys, "sid", "frame"], ["moved", "sid_from"], ["sid_from", "moved", *value])


def fold_roster(players: DataFrame, mapping: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Fold alias ids into their canonical id, keeping the first known team and number."""
    keys = list(keys)
    joined = players.join(mapping, [*keys, "gid"], "left").withColumn("gid", F.coalesce("canonical", "gid"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    return joined.groupBy(*keys, "gid").agg(first("team"), first("jersey"), F.count(F.lit(1)).alias("members"))


# --- tracklets ------------------------------------------------------------------------------------------------
def team_compatible(a: Column, b: Column) -> Column:
    ref = (a == "REF") | (b == "REF")
    return F.when(F.coalesce(ref, F.lit(False)), F.coalesce(a == b, F.lit(False))).otherwise(a.isNull() | b.isNull() | (a == b))


def tracklet_candidates(spans: DataFrame, keys: Sequence[str], gid: str, max_gap: int = 75, base: float = 200.0,
                        per_frame: float = 6.0, cap: float = 450.0) -> DataFrame:
    """Pairs (a ends, b starts within max_gap frames) close enough and team-compatible, with their cost.
    Starts and ends meet in time buckets of width max_gap, so only temporal neighbours are paired."""
    keys = list(keys)
    a = spans.select(*keys, F.col(gid).alias("ga"), F.col("last").alias("a_last"), F.col("last_xy").alias("a_xy"), F.col("team").alias("a_team"))
    a = a.withColumn("_b", F.explode(F.array(F.floor(F.col("a_last") / max_gap), F.floor(F.col("a_last") / max_gap) + 1)))
    b = spans.select(*keys, F.col(gid).alias("gb"), F.col("first").alias("b_first"), F.col("first_xy").alias("b_xy"), F.col("team").alias("b_team"))
    b = b.withColumn("_b", F.floor(F.col("b_first") / max_gap))
    pairs = a.join(b, [*keys, "_b"]).withColumn("gap", F.col("b_first") - F.col("a_last"))
    pairs = pairs.filter((F.col("ga") != F.col("gb")) & (F.col("gap") > 0) & (F.col("gap") <= max_gap))
    d = G.distance(F.col("a_xy.x"), F.col("a_xy.y"), F.col("b_xy.x"), F.col("b_xy.y"))
    pairs = pairs.withColumn("dist", d).filter(
        (F.col("dist") <= F.least(F.lit(cap), base + per_frame * F.col("gap"))) & team_compatible(F.col("a_team"), F.col("b_team")))
    return pairs.select(*keys, "ga", "gb", "gap", "dist", (F.col("dist") + 0.5 * F.col("gap")).alias("cost"))


def fragment_ends(rows: DataFrame, keys: Sequence[str], tid: str, tail: int = 8, number: str | None = None) -> DataFrame:
    """First and last point, class and end velocity (over the last `tail` rows) of each fragment; with `number` (a column of
    reads, null without one) also the number most often read in it."""
    from courtloom.operators.linking import committed_numbers

    keys = [*keys, tid]
    w = Window.partitionBy(*keys).orderBy(F.desc("frame"))          # rows of one fragment inside a chunk
    r = rows.withColumn("_rd", F.row_number().over(w))
    late = F.when(F.col("_rd") <= tail, F.col("frame"))
    point = F.struct("px", "py")
    g = r.groupBy(*keys).agg(
        F.min("frame").alias("first"), F.max("frame").alias("last"), F.min_by("class_id", "frame").alias("class_id"), F.min_by(point, F.col("frame")).alias("head"),
        F.max_by(point, F.col("frame")).alias("end"), F.min_by(point, late).alias("_t"), F.greatest(F.least(F.count(F.lit(1)), F.lit(tail)) - 1, F.lit(1)).alias("_n"))
    ends = g.withColumn("vx", (F.col("end.px") - F.col("_t.px")) / F.col("_n")).withColumn("vy", (F.col("end.py") - F.col("_t.py")) / F.col("_n")).drop("_t", "_n")
    if number is None:
        return ends
    return ends.join(committed_numbers(rows, keys, number, "frame").withColumnRenamed(number, "number").drop("votes"), keys, "left")


def fragment_links(ends: DataFrame, keys: Sequence[str], tid: str, max_gap: int = 150, base: float = 60.0, per_frame: float = 6.0, cap: float = 420.0,
                   look: DataFrame | None = None, min_cos: float = 0.55, one_number: bool = True, finish_below: int = 50_000) -> DataFrame:
    """Link fragments of a camera: extrapolated end near the next start, same class, one tail to one head.
    With `look` (keys, ga, gb, cos) appearance gates and ranks the pairs, else distance does.

    Fragments with different committed numbers (column `number` of `ends`, if there is one) are never linked. With
    `one_number` that holds for whole chains: a link that would join two numbers through fragments without one is refused
    as well. Pairs are taken best first in parallel rounds (`linking.chain_links`), so keys may span a whole game.
    """
    from courtloom.operators.linking import chain_links, conflicting

    keys = list(keys)
    known = F.col("number") if "number" in ends.columns else F.lit(None).cast("long")
    a = ends.select(*keys, F.col(tid).alias("ga"), "last", "class_id", "end", "vx", "vy", known.alias("na")).withColumn(
        "_b", F.explode(F.array(F.floor(F.col("last") / max_gap), F.floor(F.col("last") / max_gap) + 1)))
    b = ends.select(*keys, F.col(tid).alias("gb"), "first", "class_id", "head", known.alias("nb")).withColumn("_b", F.floor(F.col("first") / max_gap))
    pairs = a.join(b, [*keys, "class_id", "_b"]).withColumn("gap", F.col("first") - F.col("last")).filter("ga <> gb and gap > 0").filter(F.col("gap") <= max_gap)
    pairs = pairs.filter(~conflicting(F.col("na"), F.col("nb")))
    ahead = F.least("gap", F.lit(30))
    d = G.distance(F.col("end.px") + F.col("vx") * ahead, F.col("end.py") + F.col("vy") * ahead, F.col("head.px"), F.col("head.py"))
    near = pairs.withColumn("dist", d).filter(F.col("dist") <= F.least(base + per_frame * F.col("gap"), F.lit(cap)))
    rank = F.floor(F.col("dist") * 1e6 + 0.5)
    if look is not None:
        near = near.join(look, [*keys, "ga", "gb"]).filter(F.col("cos") >= min_cos)
        rank = F.floor((F.col("dist") / 1000 - F.col("cos")) * 1e9 + 0.5)
    return chain_links(near, keys, "ga", "gb", [rank], ("na", "nb") if one_number else None, finish_below)
