"""Scorecards: detection, identity, possession, events. All are two-level combinable aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtloom.functions import geometry as G
from courtloom.operators import joins as J
from courtloom.operators import ordered as O
from courtloom.operators import sequence as S
from courtloom.session import cut_lineage


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def count_if(cond: Column) -> Column:
    return F.sum(F.coalesce(cond, F.lit(False)).cast("long"))


def prf(df: DataFrame) -> DataFrame:
    """precision / recall / f1 from tp, n_gt, n_cv: empty on both sides counts as perfect."""
    p = F.when(F.col("n_cv") > 0, F.col("tp") / F.col("n_cv")).when(F.col("n_gt") == 0, 1.0).otherwise(0.0)
    r = F.when(F.col("n_gt") > 0, F.col("tp") / F.col("n_gt")).otherwise(1.0)
    return df.withColumn("precision", p).withColumn("recall", r).withColumn(
        "f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def match_moments(gt: DataFrame, derived: DataFrame, keys: Sequence[str], tol: int, order: str = "frame") -> DataFrame:
    """Ground-truth frames in order each take the first unused derived frame within tol; counts per key.
    Both lists are sorted and unique, so the first unused one is found with a single moving pointer; keys
    are (game, chunk) windows and bound both lists."""
    keys = list(keys)
    g = gt.groupBy(*keys).agg(F.sort_array(F.collect_list(order)).alias("g"))
    d = derived.groupBy(*keys).agg(F.sort_array(F.collect_list(order)).alias("d"))
    both = g.join(d, keys, "left").withColumn("d", F.coalesce("d", F.slice("g", 1, 0)))

    def step(acc: Column, x: Column) -> Column:
        hit = F.get(F.filter("d", lambda v: (v > acc["last"]) & (F.abs(v - x) <= tol)), F.lit(0))
        return F.struct(F.coalesce(hit, acc["last"]).alias("last"), (acc["tp"] + hit.isNotNull().cast("long")).alias("tp"))

    start = F.struct(F.lit(-(1 << 60)).cast("long").alias("last"), F.lit(0).cast("long").alias("tp"))
    return both.select(*keys, F.size("g").alias("n_gt"), F.size("d").alias("n_cv"), F.aggregate("g", start, step)["tp"].alias("tp"))


def camera_pair_distance(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median, p75, p90 distance between cameras on identical (player, frame) support."""
    a = points.select(*keys, F.col("cam").alias("cam1"), "cx", "cy")
    b = points.select(*keys, F.col("cam").alias("cam2"), F.col("cx").alias("rx"), F.col("cy").alias("ry"))
    d = a.join(b, list(keys)).filter("cam1 < cam2").withColumn(
        "dist", F.floor(G.distance(F.col("cx"), F.col("cy"), F.col("rx"), F.col("ry"))))
    n = d.groupBy("cam1", "cam2").agg(F.count(F.lit(1)).alias("n"))
    q = O.exact_quantiles(d, ["cam1", "cam2"], {"": "dist"}, {"med": 0.5, "p75": 0.75, "p90": 0.9})
    return n.join(q, ["cam1", "cam2"])


# --- tracks ------------------------------------------------------------------------------------------------
def track_summary(tracks: DataFrame, keys: Sequence[str], tid: str, order: str) -> DataFrame:
    """Frames, ids, observations, min / upper-median / max length, average per frame."""
    keys = list(keys)
    length = tracks.groupBy(*keys, tid).agg(F.count(F.lit(1)).alias("len"))
    # ids per key are counted per length first, so the sorted list has one entry per distinct length
    hist = length.groupBy(*keys, "len").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*keys).orderBy("len")
    cum = hist.withColumn("upto", F.sum("c").over(w)).withColumn("ids", F.sum("c").over(Window.partitionBy(*keys)))
    lens = cum.groupBy(*keys).agg(
        F.max("ids").alias("ids"), F.sum(F.col("c") * F.col("len")).alias("observations"), F.min("len").alias("min_len"), F.max("len").alias("max_len"),
        F.min(F.when(F.col("upto") > F.floor(F.col("ids") / 2), F.col("len"))).alias("median_len"))
    frames = tracks.groupBy(*keys).agg(F.countDistinct(order).alias("frames"))
    return lens.join(frames, keys).withColumn("per_frame", F.col("observations") / F.col("frames"))


def identity_health(world: DataFrame, keys: Sequence[str], gid: str, order: str, coasting: Column, trim: int = 15) -> DataFrame:
    """ids, stable (>= half the frames), ghosts (< 10%), late-born, people per frame, crowding, coasting."""
    keys = list(keys)
    per_frame = world.groupBy(*keys, order).agg(F.countDistinct(gid).alias("ppf"), F.count(F.lit(1)).alias("rows"), count_if(coasting).alias("coast"))
    w = Window.partitionBy(*keys).orderBy(order)
    pos = per_frame.withColumn("_r", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    core = (F.col("_r") > trim) & (F.col("_r") <= F.col("_n") - trim)
    frames = pos.groupBy(*keys).agg(
        F.max("_n").alias("frames"), F.sum("rows").alias("rows"), F.sum("coast").alias("coast"),
        F.percentile(F.when(core, F.col("ppf")), F.lit(0.5)).alias("ppf_median"), F.avg(F.when(core, F.col("ppf"))).alias("ppf_mean"),
        F.avg(F.when(core, (F.col("ppf") > 13).cast("double"))).alias("over13"), F.avg(F.when(core, (F.col("ppf") < 11).cast("double"))).alias("under11"))
    life = world.groupBy(*keys, gid).agg(F.count(F.lit(1)).alias("life"), F.min(order).alias("born"))
    ids = life.join(frames.select(*keys, "frames"), keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("ids"), count_if(F.col("life") >= 0.5 * F.col("frames")).alias("stable"),
        count_if(F.col("life") < 0.1 * F.col("frames")).alias("ghosts"), count_if(F.col("born") > 0.5 * F.col("frames")).alias("late_born"))
    return frames.join(ids, keys).withColumn("coasting_rate", F.col("coast") / F.col("rows"))


def roster_check(reads: DataFrame, official: DataFrame, keys: Sequence[str], num: str) -> DataFrame:
    """Distinct numbers read, how many are official, how many are not."""
    keys = list(keys)
    mine = reads.select(*keys, num).distinct()
    known = official.select(num).distinct().withColumn("_ok", F.lit(1))
    return mine.join(known, num, "left").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("read"), F.count("_ok").alias("on_roster"), count_if(F.col("_ok").isNull()).alias("hallucinated"))


def id_scorecard(matched: DataFrame, keys: Sequence[str], order: str, gid: str, block: int) -> DataFrame:
    """Coverage, purity, dominant id, distinct ids and switches of a matched timeline (null = unmatched)."""
    keys = list(keys)
    n = matched.groupBy(*keys).agg(F.count(F.lit(1)).alias("gt_frames"), F.count(gid).alias("matched"))
    votes = matched.filter(F.col(gid).isNotNull()).groupBy(*keys, gid).agg(F.count(F.lit(1)).alias("c"), F.min(order).alias("f"))
    dom = votes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_ids"), F.max(F.struct(F.col("c"), (-F.col("f")).alias("nf"), F.col(gid).alias("g"))).alias("b"))
    sw = S.value_changes(matched, keys, order, gid, block)
    out = n.join(dom, keys, "left").join(sw, keys, "left")
    return out.select(*keys, "gt_frames", (F.col("matched") / F.col("gt_frames")).alias("coverage"),
                      (F.coalesce("b.c", F.lit(0)) / F.greatest("matched", F.lit(1))).alias("purity"), F.col("b.g").alias("dominant"),
                      F.coalesce("n_ids", F.lit(0)).alias("n_ids"), F.coalesce("n_switches", F.lit(0)).alias("n_switches"))


def camera_fidelity(df: DataFrame, player: Sequence[str], hit: Column, min_visible: int = 20) -> DataFrame:
    """Share of visible ground-truth boxes held, per camera; mean over cameras; fused = any camera holds.
    `df`: one row per (player, cam, frame) with boxes resolved."""
    player = list(player)
    rows = df.withColumn("_h", F.coalesce(hit, F.lit(False)))
    cam = rows.groupBy(*player, "cam").agg(F.count(F.lit(1)).alias("n"), count_if(F.col("_h")).alias("h")).filter(F.col("n") >= min_visible)
    strict = cam.groupBy(*player).agg(F.avg(F.bround(F.col("h") / F.col("n"), 3)).alias("strict"), F.count(F.lit(1)).alias("cams"))
    fused = rows.groupBy(*player, "frame").agg(F.max("_h").alias("any")).groupBy(*player).agg(
        F.count(F.lit(1)).alias("frames"), F.avg(F.col("any").cast("double")).alias("fused"))
    return fused.join(strict, player, "left")


# --- possession ---------------------------------------------------------------------------------------------
def possession_agreement(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Frame agreement of gt and derived letters under the identity and the swapped naming."""
    swapped = F.when(F.col("derived") == "A", "B").when(F.col("derived") == "B", "A").otherwise(F.col("derived"))
    out = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), count_if(F.col("gt") == F.col("derived")).alias("same"), count_if(F.col("gt") == swapped).alias("swap"))
    best = F.greatest("same", "swap")
    return out.withColumn("mapping", F.when(F.col("same") >= F.col("swap"), "identity").otherwise("swapped")).withColumn("accuracy", best / F.col("n"))


def event_scorecard(matched: DataFrame, cls: str) -> DataFrame:
    """n, detected, who / zone / make-miss / all correct, per class and in total (class null)."""
    det = F.col("detected")
    allc = det & F.col("who_ok") & F.col("zone_ok") & F.col("mm_ok")
    return matched.rollup(cls).agg(
        F.count(F.lit(1)).alias("n"), count_if(det).alias("detected"), count_if(det & F.col("who_ok")).alias("who"),
        count_if(det & F.col("zone_ok")).alias("zone"), count_if(det & F.col("mm_ok")).alias("make_miss"), count_if(allc).alias("all_correct"))


def arbiter(rows: DataFrame) -> DataFrame:
    """Accuracy when the story or the baseline answers, under each arbitration rule; union and agreement.
    `rows`: b, v, agree (boolean), rq, dist."""
    def under(rule: Column) -> Column:
        return count_if(F.when(F.coalesce(rule, F.lit(False)), F.col("v")).otherwise(F.col("b")))

    dirty, differ = F.col("rq") > 0.6, ~F.col("agree")
    return rows.agg(
        F.count(F.lit(1)).alias("n"), count_if(F.col("b")).alias("base"), count_if(F.col("v")).alias("story"),
        under(differ & dirty).alias("rule_a"), under(dirty).alias("rule_b"), under(F.coalesce("dist", F.lit(9e9)) < 500).alias("rule_c"),
        under(differ & (F.coalesce("dist", F.lit(9e9)) < 600)).alias("rule_d"), count_if(F.col("b") | F.col("v")).alias("either"),
        count_if(F.col("b") & F.col("v")).alias("b_and_v"), count_if(F.col("agree")).alias("agree"))


def oracle_bound(anchors: DataFrame, evidence: DataFrame, reach: int = 9) -> DataFrame:
    """Share of anchors with supporting evidence within +-reach frames on its own and on any camera."""
    hits = evidence.select("game", "cam", "frame", "sid").distinct()
    near = anchors.withColumn("frame", F.explode(F.sequence(F.col("at") - reach, F.col("at") + reach))).withColumnRenamed("cam", "_arc")
    found = near.join(hits, ["game", "frame", "sid"]).groupBy("shot_id", "game").agg(
        F.max(F.col("cam") == F.col("_arc")).alias("arc"), F.lit(True).alias("any"))
    out = anchors.join(found, ["shot_id", "game"], "left")
    return out.groupBy("game").agg(F.count(F.lit(1)).alias("n"), count_if(F.col("arc")).alias("arc_cam"), count_if(F.col("any")).alias("any_cam"))


# --- tracker agreement ---------------------------------------------------------------------------------------
def tracker_agreement(ours: DataFrame, theirs: DataFrame, pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Agree / only-ours / only-theirs, recalls, count error and id flips from one-to-one `pairs`."""
    keys, frame = list(keys), [*keys, "frame"]
    a = ours.groupBy(*frame).agg(F.count(F.lit(1)).alias("a"))
    b = theirs.groupBy(*frame).agg(F.count(F.lit(1)).alias("b"))
    p = pairs.groupBy(*frame).agg(F.count(F.lit(1)).alias("p"))
    per = a.join(b, frame, "full").join(p, frame, "left").fillna(0, ["a", "b", "p"])
    tot = per.groupBy(*keys).agg(
        F.sum("p").alias("agree"), F.sum(F.col("a") - F.col("p")).alias("only_ours"), F.sum(F.col("b") - F.col("p")).alias("only_theirs"),
        F.avg(F.abs(F.col("a") - F.col("b"))).alias("count_mae"))
    v = pairs.groupBy(*keys, "our_id", "their_id").agg(F.count(F.lit(1)).alias("c"))
    f = v.groupBy(*keys, "our_id").agg(F.sum("c").alias("n"), F.max("c").alias("m")).groupBy(*keys).agg(
        F.sum("n").alias("links"), F.sum(F.col("n") - F.col("m")).alias("flips"))
    return tot.join(f, keys, "left").withColumn("flip_rate", ratio(F.col("flips"), F.col("links"))).withColumn(
        "recall_ours", F.col("agree") / F.greatest(F.lit(1), F.col("agree") + F.col("only_ours"))).withColumn(
        "recall_theirs", F.col("agree") / F.greatest(F.lit(1), F.col("agree") + F.col("only_theirs")))


def worst_frames(ours: DataFrame, theirs: DataFrame, pairs: DataFrame, keys: Sequence[str], k: int = 8) -> DataFrame:
    """Frames with most unmatched boxes of theirs (later frame first on ties): a top-k report."""
    frame = [*keys, "frame"]
    miss = theirs.groupBy(*frame).agg(F.count(F.lit(1)).alias("b")).join(
        pairs.groupBy(*frame).agg(F.count(F.lit(1)).alias("p")), frame, "left").withColumn("miss", F.col("b") - F.coalesce("p", F.lit(0)))
    return miss.filter("miss > 0").orderBy(F.desc("miss"), F.desc("frame"), *keys).limit(k).select(*frame, "miss")


def parity(consensus: DataFrame, world: DataFrame, pairs: DataFrame, links: DataFrame, keys: Sequence[str], min_obs: int = 30, min_links: int = 20) -> DataFrame:
    """Person recall / precision and position error from pairs (dist), id purity of long foreign tracks."""
    keys = list(keys)
    c = consensus.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cons"))
    w = world.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_ours"))
    p = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("hits"), F.sqrt(F.avg(F.floor(F.col("dist") * F.col("dist") + 0.5))).alias("rmse"))
    v = links.groupBy(*keys, "foreign_id", "gid").agg(F.count(F.lit(1)).alias("c"))
    t = v.groupBy(*keys, "foreign_id").agg(F.sum("c").alias("all"), F.sum(F.when(F.col("gid").isNotNull(), F.col("c"))).alias("n"),
                                           F.max(F.when(F.col("gid").isNotNull(), F.col("c"))).alias("m"))
    t = t.filter((F.col("all") >= min_obs) & (F.col("n") >= min_links)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("long_tracks"), count_if(F.col("m") / F.col("n") >= 0.9).alias("pure"), F.sum(F.col("n") - F.col("m")).alias("impure"), F.sum("n").alias("links"))
    return c.join(w, keys).join(p, keys, "left").join(t, keys, "left").withColumn("recall", F.col("hits") / F.col("n_cons")).withColumn(
        "precision", F.col("hits") / F.col("n_ours")).withColumn("impurity", F.col("impure") / F.greatest("links", F.lit(1)))


def heatmap(df: DataFrame, x: str, y: str, rate: Column, cell: float = 150.0, min_n: int = 15) -> DataFrame:
    g = df.groupBy(F.floor(F.col(x) / cell).cast("long").alias("gx"), F.floor(F.col(y) / cell).cast("long").alias("gy"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.avg(rate).alias("rate")).filter(F.col("n") >= min_n)


# --- detection quality ----------------------------------------------------------------------------------------
def band_recall(gt: DataFrame, pred: DataFrame, frame: Sequence[str], angle: str, percentile: float = 0.25, iou: float = 0.5) -> DataFrame:
    """Recall of the smallest boxes (height up to a percentile over all ground truth), per angle and total.
    The threshold is one number: it is computed once and joined as a single row."""
    frame = list(frame)
    height = gt.withColumn("h", F.col("y2") - F.col("y1"))
    thr = O.exact_quantiles(height.withColumn("_k", F.lit(1)), ["_k"], {"thr": "h"}, {"": percentile}).select("thr")
    small = height.join(F.broadcast(thr)).filter(F.col("h") <= F.col("thr")).drop("thr", "h")
    edges = pred.select(*frame, "pred", "score", "x1", "y1", "x2", "y2").join(J.as_right_box(small, "gt", keys=frame), frame)
    edges = edges.withColumn("iou", G.iou(G.Box.of(), G.Box.of("b_"))).filter(F.col("iou") >= iou)
    m = J.greedy_match(edges, frame, "pred", "gt", [-F.col("score"), F.col("pred"), -F.col("iou"), -F.col("gt")])
    hit = m.groupBy(angle).agg(F.count(F.lit(1)).alias("matched"))
    total = small.groupBy(angle).agg(F.count(F.lit(1)).alias("n_gt"))
    both = total.join(hit, angle, "left").fillna(0, ["matched"])
    return both.rollup(angle).agg(F.sum("n_gt").alias("n_gt"), F.sum("matched").alias("matched")).withColumn("recall", ratio(F.col("matched"), F.col("n_gt")))


def average_precision(gt: DataFrame, pred: DataFrame, frame: Sequence[str], thresholds: Sequence[float], block: int = 64) -> DataFrame:
    """COCO average precision per class and IoU threshold: greedy matching by score per image, then the
    101-point interpolated precision.

    The precision curve needs one global order by score per class. Scores are first reduced to one row per
    distinct score (tp, fp counts), so the ordered part works on distinct scores; predictions of equal score
    move together.
    """
    frame = list(frame)
    key = ["class_id", "thr"]
    edges = pred.select(*frame, "class_id", "pred", "score", "x1", "y1", "x2", "y2").join(
        J.as_right_box(gt, "class_id", "gt", keys=frame), [*frame, "class_id"])
    edges = edges.withColumn("iou", G.iou(G.Box.of(), G.Box.of("b_"))).withColumn("thr", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    edges = edges.filter(F.col("iou") >= F.col("thr"))
    m = J.greedy_match(edges, [*frame, *key], "pred", "gt", [-F.col("score"), F.col("pred"), -F.col("iou"), F.col("gt")]).withColumn("tp", F.lit(1))
    p = pred.select(*frame, "class_id", "pred", "score").withColumn("thr", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    s = p.join(m.select(*frame, *key, "pred", "tp"), [*frame, *key, "pred"], "left").groupBy(*key, "score").agg(
        F.count(F.lit(1)).alias("n"), F.count("tp").alias("tp"))
    n_gt = gt.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_gt"))
    # scores are ordered in blocks of 1 / `block`, from high to low for the sums and from low to high for the envelope
    s = cut_lineage(s.withColumn("_down", -F.col("score")))
    run = O.running_sums(s, key, "_down", {"ctp": F.col("tp"), "cn": F.col("n")}, 1 / block).join(n_gt, "class_id")
    run = run.withColumn("prec", F.col("ctp") / F.col("cn")).withColumn("rec", F.col("ctp") / F.col("n_gt"))
    best = O.running_max(run, key, "score", F.col("prec"), "env", 1 / block)
    # points of the recall grid reached between the previous and this recall take this envelope value
    before = F.when(F.col("cn") == F.col("n"), F.lit(0)).otherwise(F.floor((F.col("ctp") - F.col("tp")) / F.col("n_gt") * 100 + 1e-9) + 1)
    pts = best.withColumn("pts", F.floor(F.col("rec") * 100 + 1e-9) + 1 - before)
    ap = pts.groupBy(*key).agg((F.sum(F.col("env") * F.col("pts")) / 101).alias("ap"), F.max("rec").alias("ar"))
    grid = n_gt.withColumn("thr", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    return grid.join(ap, key, "left").select(*key, "n_gt", F.coalesce("ap", F.lit(0.0)).alias("ap"), F.coalesce("ar", F.lit(0.0)).alias("ar"))


# --- appearance ---------------------------------------------------------------------------------------------------
def appearance_separation(vectors: DataFrame, vec: str, team: str, dims: int) -> DataFrame:
    """Mean cosine within and across teams over all track pairs, without forming the pairs: for unit
    vectors the sum of pairwise dot products is (|sum|^2 - n) / 2 within a team and sum_a . sum_b across."""
    unit = vectors.select(team, F.posexplode(vec).alias("i", "v"))
    s = unit.groupBy(team, "i").agg(F.sum("v").alias("s"))
    n = vectors.groupBy(team).agg(F.count(F.lit(1)).alias("n"))
    own = s.groupBy(team).agg(F.sum(F.col("s") * F.col("s")).alias("q")).join(n, team)
    within = own.agg(F.sum((F.col("q") - F.col("n")) / 2).alias("w"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("wn"),
                     F.sum("n").alias("n"), F.sum("q").alias("q"), F.sum(F.col("n") * F.col("n")).alias("n2"))
    total = s.groupBy("i").agg(F.sum("s").alias("t")).agg(F.sum(F.col("t") * F.col("t")).alias("tt"))
    both = within.join(F.broadcast(total))
    return both.select((F.col("w") / F.col("wn")).alias("within"),
                       (((F.col("tt") - F.col("q")) / 2) / ((F.col("n") * F.col("n") - F.col("n2")) / 2)).alias("across"))


def court_side_share(world: DataFrame, keys: Sequence[str], centre: float) -> DataFrame:
    """Frames each team's centroid is left / right of the centre line."""
    c = world.filter(F.col("team").isin("A", "B")).groupBy(*keys, "frame", "team").agg(F.avg("cx").alias("x"))
    return c.groupBy(*keys, "team").agg(count_if(F.col("x") > centre).alias("n_right"), count_if(F.col("x") <= centre).alias("n_left"))
