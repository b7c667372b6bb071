"""Training-table ETL of the observation data: provenance, splits, triage, sampling and audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtloom.functions import geometry as G
from courtloom.functions import text as T
from courtloom.operators import joins as J
from courtloom.operators import ordered as O
from courtloom.operators import sequence as S
from courtloom.session import cut_lineage


# --- provenance -------------------------------------------------------------------------------------------------
def resolve_games(keys: DataFrame, games: DataFrame, aliases: DataFrame, min_prefix: int = 3) -> DataFrame:
    """alias -> exact id -> unique id prefix, else null. `games` is the registry (gid): all prefixes of
    every id are listed once, so the lookup is an equi-join and not a scan of games per key."""
    prefixes = games.select("gid", F.explode(F.transform(F.sequence(F.lit(min_prefix), F.length("gid")), lambda n: F.substring("gid", F.lit(1), n))).alias("key"))
    unique = prefixes.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("gid").alias("game"), F.max(F.col("gid") == F.col("key")).alias("exact"))
    found = unique.withColumn("game", F.when(F.col("exact"), F.col("key")).when(F.col("n") == 1, F.col("game"))).select("key", "game")
    named = keys.join(aliases, "stem_key", "left").withColumn("key", F.coalesce("alias_of", "stem_key"))
    return named.join(found, "key", "left").select(*keys.columns, "game")


def check_aliases(aliases: DataFrame, games: DataFrame) -> DataFrame:
    """Alias rows whose target is not a registered game (must be empty)."""
    return aliases.join(games.select(F.col("gid").alias("alias_of")), "alias_of", "left_anti")


def claim_by_priority(frames: DataFrame, key: Sequence[str], priority: str, source: str, labels: str, keep: Sequence[str]) -> DataFrame:
    """A frame belongs to the source with the lowest priority (then source order); frames without labels
    never claim their key."""
    full = frames.filter(F.col(labels) > 0)
    best = full.groupBy(*key).agg(F.min(F.struct(priority, source, *keep)).alias("b"))
    return best.select(*key, F.col(f"b.{source}").alias(source), *[F.col(f"b.{c}").alias(c) for c in keep])


def check_splits(config: DataFrame, registry: DataFrame) -> DataFrame:
    """Games whose configured split differs from the registry (val and valid are the same)."""
    norm = lambda c: F.when(c == "val", "valid").otherwise(c)
    both = config.select("game", F.col("split").alias("want")).join(registry.select("game", F.col("split").alias("have")), "game", "left")
    return both.filter(F.col("have").isNull() | (norm(F.col("want")) != norm(F.col("have"))))


def require_empty(df: DataFrame, message: str) -> DataFrame:
    """Turn any row of a check into an error when the plan runs."""
    return df.withColumn("_err", F.raise_error(F.lit(message)))


# --- splits --------------------------------------------------------------------------------------------------------
def ordered_split(items: DataFrame, game: str, train: float = 0.80, valid: float = 0.12) -> DataFrame:
    """Whole games in sorted order, 80 / 12 / 8 by index. Games are dealt to ranges and ranked inside them; a game's index is
    that rank after the games of the ranges before, so no task sorts all games."""
    games = cut_lineage(items.select(game).distinct().repartitionByRange(game).withColumn("_p", F.spark_partition_id()))
    sizes = games.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))                  # one row for each range
    ahead = sizes.select("_p", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"),
                         F.sum("_c").over(Window.partitionBy()).alias("n"))
    local = F.row_number().over(Window.partitionBy("_p").orderBy(game)) - 1
    ranked = games.withColumn("_r", local).join(F.broadcast(ahead), "_p").withColumn("i", F.col("_ahead") + F.col("_r"))
    split = F.when(F.col("i") < F.floor(F.col("n") * train), "train").when(F.col("i") < F.floor(F.col("n") * (train + valid)), "valid").otherwise("test")
    return items.join(ranked.select(game, split.alias("split")), game)


def group_hash_split(items: DataFrame, game: str, group: str, seed: int | str, fraction: float, min_games: int = 4) -> DataFrame:
    """Split by game when there are enough games, else by play group."""
    enough = items.agg((F.countDistinct(game) >= min_games).alias("_by_game"))
    unit = F.when(F.col("_by_game"), F.col(game).cast("string")).otherwise(F.col(group).cast("string"))
    return items.join(F.broadcast(enough)).withColumn("split", F.when(T.in_validation(unit, seed, fraction), "valid").otherwise("train")).drop("_by_game")


def assign_validation(items: DataFrame, mode: str, angle: str, order: str, fraction: float = 0.2, block: int = 17982) -> DataFrame:
    """explicit: as configured; held_out_game: test rows serve as valid too; temporal_holdout: the last
    frames of every angle of train become valid."""
    if mode == "explicit":
        return items
    if mode == "held_out_game":
        return items.unionByName(items.filter("split = 'test'").withColumn("split", F.lit("valid")))
    tail = S.tail_holdout(items.filter("split = 'train'").drop("split"), [angle], order, fraction, block)
    return tail.unionByName(items.filter("split <> 'train'").select(*tail.columns))


# --- selection -------------------------------------------------------------------------------------------------------
def mine_misses(teacher: DataFrame, own: DataFrame, min_score: float, iou_miss: float) -> DataFrame:
    """Frames by the number of confident teacher boxes that no own box overlaps."""
    t = teacher.filter(F.col("score") >= min_score).select(*J.FRAME, "det_idx", "x1", "y1", "x2", "y2")
    pairs = t.join(J.as_right_box(own), list(J.FRAME), "left").withColumn("iou", G.iou(G.Box.of(), G.Box.of("b_")))
    best = pairs.groupBy(*J.FRAME, "det_idx").agg(F.max("iou").alias("best"))
    return best.filter(F.coalesce("best", F.lit(0.0)) < iou_miss).groupBy(*J.FRAME).agg(F.count(F.lit(1)).alias("misses"))


def drop_ball_shaped(players: DataFrame, balls: DataFrame, iou_min: float, area_mult: float) -> DataFrame:
    """Player boxes that are really the ball: overlap with a ball box and hardly larger."""
    hit = players.join(J.as_right_box(balls), list(J.FRAME))
    a, b = G.Box.of(), G.Box.of("b_")
    dup = hit.filter((G.iou(a, b) > iou_min) & (a.area < area_mult * b.area)).select(*J.FRAME, "det_idx").distinct()
    return players.join(dup, [*J.FRAME, "det_idx"], "left_anti")


def single_container(balls: DataFrame, people: DataFrame, pid: str, negatives: int = 3) -> DataFrame:
    """Frames with one ball inside exactly one person: holder and the largest other boxes."""
    one = balls.groupBy(*J.FRAME).agg(F.count(F.lit(1)).alias("n"), F.min("ball_x").alias("ball_x"), F.min("ball_y").alias("ball_y")).filter("n = 1").drop("n")
    box = G.Box.of()
    rows = one.join(people, list(J.FRAME)).withColumn("_in", box.contains(F.col("ball_x"), F.col("ball_y"))).withColumn("_a", box.area)
    other = F.when(~F.col("_in"), F.struct(F.col("_a"), F.col(pid)))
    # people of one camera and frame: the list is bounded by the stream slots
    g = rows.groupBy(*J.FRAME).agg(F.sum(F.col("_in").cast("int")).alias("k"), F.max(F.when(F.col("_in"), F.col(pid))).alias(pid),
                                   F.sort_array(F.collect_list(other), asc=False).alias("_o"))
    return g.filter("k = 1").select(*J.FRAME, pid, F.transform(F.slice("_o", 1, negatives), lambda o: o[pid]).alias("negatives"))


def pick_ball_labels(candidates: DataFrame, gold: DataFrame, frame: Sequence[str], min_score: float) -> DataFrame:
    """Exactly one confident ball makes a frame positive, none negative, more is ambiguous and dropped;
    gold labels override."""
    frame = list(frame)
    conf = F.col("score") >= min_score
    n = candidates.groupBy(*frame).agg(F.sum(conf.cast("int")).alias("n"), F.max(F.when(conf, F.struct("score", "det_idx"))).alias("b"))
    auto = n.filter("n <= 1").select(*frame, F.when(F.col("n") == 1, "positive").otherwise("negative").alias("auto"), F.col("b.det_idx").alias("auto_det"))
    both = auto.join(gold.select(*frame, F.col("label").alias("gold"), F.col("det_idx").alias("gold_det")), frame, "full")
    return both.select(*frame, F.coalesce("gold", "auto").alias("label"),
                       F.when(F.col("gold").isNotNull(), F.col("gold_det")).otherwise(F.col("auto_det")).alias("det_idx"),
                       F.when(F.col("gold").isNotNull(), "gold").otherwise("teacher").alias("source"))


def keep_negatives(labels: DataFrame, key: Column, ratio: float, seed: str) -> DataFrame:
    """All positives; negatives kept by hash so that their expected number is ratio x positives."""
    counts = labels.agg(F.sum((F.col("label") == "positive").cast("long")).alias("_p"), F.sum((F.col("label") == "negative").cast("long")).alias("_n"))
    share = F.col("_p") * ratio / F.greatest("_n", F.lit(1)) * 1000
    bucket = T.hash_bucket(key, seed)
    return labels.join(F.broadcast(counts)).filter((F.col("label") == "positive") | (bucket < share)).drop("_p", "_n")


def capped_sample(items: DataFrame, group: Sequence[str], item: Column, cap: int, seed: str) -> DataFrame:
    """At most `cap` rows per group in seeded hash order (this limit is the operator).

    Rows are ranked inside equal slices of the hash range first; only each slice's first `cap` rows reach the
    final ranking, so a hot group is never sorted by one task.
    """
    group = list(group)
    h = S.hash_position(F.concat(F.lit(f"{seed}:"), item.cast("string")))
    rows = items.withColumn("_h", h).withColumn("_slice", F.floor(F.col("_h") / S.HASH_BLOCK))
    local = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*group, "_slice").orderBy("_h"))).filter(F.col("_r") <= cap)
    return local.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy("_h"))).filter(F.col("rank") <= cap).drop("_h", "_slice", "_r")


def sampling_plan(plays: DataFrame, time: str, before: float, after: float, n: int) -> DataFrame:
    """n evenly spaced sample times in [t - before, t + after] of every play."""
    step = (before + after) / (n - 1)
    return plays.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("sample_t", F.col(time) - before + F.col("i") * step)


def triage(labels: DataFrame, status: Column) -> DataFrame:
    """usable / unclear / none counts."""
    return labels.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


# --- reports ---------------------------------------------------------------------------------------------------------------
def audit(items: DataFrame, source: Sequence[str], class_col: str, game: str, angle: str) -> DataFrame:
    """Per source and split: totals and breakdowns by class, game and angle in one pass."""
    cols = [*source, class_col, game, angle]
    sets = [[F.col(c) for c in (*source, *extra)] for extra in ((), (class_col,), (game,), (angle,))]
    return items.groupingSets(sets, *[F.col(c) for c in cols]).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("frame").alias("frames"))


def coco_document(boxes: DataFrame, images: DataFrame, split: str, order: str, block: int) -> DataFrame:
    """COCO annotation rows: 1-based image ids in stem order (`order` is the numeric form of the stem, so
    numbering runs in blocks), pixel boxes and areas."""
    ids = O.rank_in_key(images.select(split, "stem", order, "width", "height").distinct(), [split], order, "image_id", block)
    x, y, bw, bh = G.yolo_to_xywh(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"), F.col("width"), F.col("height"))
    return boxes.join(ids, [split, "stem"]).select(
        split, "image_id", "class_id", x.alias("x"), y.alias("y"), bw.alias("bw"), bh.alias("bh"), (bw * bh).alias("area"))


def build_report(frames: DataFrame, offered: DataFrame, key: Sequence[str]) -> DataFrame:
    """Per split: images, instances, games, cameras and frames offered more than once."""
    rep = frames.groupBy("split").agg(F.count(F.lit(1)).alias("images"), F.sum("labels").alias("instances"), F.countDistinct("game").alias("games"), F.countDistinct("cam").alias("cams"))
    n = offered.filter("labels > 0").groupBy(*key).agg((F.count(F.lit(1)) - 1).alias("dup"))
    dup = n.join(frames.select(*key, "split"), list(key)).groupBy("split").agg(F.sum("dup").alias("duplicates"))
    return rep.join(dup, "split", "left")
