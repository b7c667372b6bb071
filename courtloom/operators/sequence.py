"""Runs, segments, hysteresis, thinning, interpolation and sampling over ordered frames.

Two key shapes occur. Per-chunk logic (`keys` contain the chunk) uses plain windows: a chunk holds at
most CHUNK_FRAMES frames and inputs are unique per frame, so a window partition is bounded. Logic over a
whole game goes through operators/ordered.py and is cut into blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtloom import constants as C
from courtloom.operators import ordered as O


def runs_over(keys: Sequence[str], order: str) -> Window:
    return Window.partitionBy(*keys).orderBy(order)


def upto(window: Window) -> Window:
    return window.rowsBetween(Window.unboundedPreceding, 0)


# --- runs ---------------------------------------------------------------------------------------------
def rle(df: DataFrame, keys: Sequence[str], order: str, value: str, max_gap: int = 3,
        min_length: int = 1, block: int = C.BLOCK_FRAMES) -> DataFrame:
    """Merge equal neighbours at most `max_gap` frames apart: start_frame, end_frame, value, n."""
    keys = list(keys)
    halo = O.with_halo(df.filter(F.col(value).isNotNull()).select(*keys, order, value), order, max_gap, 0, block)
    w = O.halo_window(keys, order)
    joined = (F.lag(value).over(w) == F.col(value)) & (F.col(order) - F.lag(order).over(w) <= max_gap)
    marked = O.own_rows(halo.withColumn("_start", ~F.coalesce(joined, F.lit(False))))
    runs = O.carry_last(marked, keys, order, F.when(F.col("_start"), F.col(order)), "start_frame", block)
    # value is constant inside a run, so it joins the key; max/count combine on the map side
    out = runs.groupBy(*keys, "start_frame", value).agg(
        F.max(order).alias("end_frame"), F.count(F.lit(1)).alias("n"))
    return out.filter(F.col("end_frame") - F.col("start_frame") + 1 >= min_length)


def run_position(df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str) -> DataFrame:
    """1-based position of each row inside its run of equal consecutive values (null is a value)."""
    w = runs_over(keys, order)
    change = ~value.eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)
    tmp = df.withColumn("_run", F.sum(change.cast("long")).over(upto(w)))
    return tmp.withColumn(out, F.row_number().over(Window.partitionBy(*keys, "_run").orderBy(order))).drop("_run")


def hysteresis(df: DataFrame, keys: Sequence[str], order: str, value: str, k: int = C.HYSTERESIS_K) -> DataFrame:
    """Sticky holder: a candidate takes over after `k` repeats. Missing evidence keeps the holder and is
    skipped inside a run once there is a holder; before that it breaks the run. Keys contain the chunk."""
    keys = list(keys)
    w = runs_over(keys, order)
    strict = run_position(df, keys, order, F.col(value), "_p0")
    first = F.min(F.when(F.col(value).isNotNull() & (F.col("_p0") >= k), F.col(order))).over(Window.partitionBy(*keys))
    base = strict.withColumn("_first", first)
    loose = run_position(base.filter(F.col(value).isNotNull()), keys, order, F.col(value), "_p")
    taken = F.when(
        (F.col(order) == F.col("_first")) | ((F.col(order) > F.col("_first")) & (F.col("_p") >= k)), F.col(value))
    rows = loose.select(*keys, order, value, taken.alias("_taken")).unionByName(
        base.filter(F.col(value).isNull()).select(*keys, order, value, F.lit(None).cast("string").alias("_taken")))
    return rows.withColumn("holder", F.last("_taken", ignorenulls=True).over(upto(w))).drop("_taken").filter(
        "holder is not null")


def value_changes(df: DataFrame, keys: Sequence[str], order: str, value: str, block: int = C.BLOCK_FRAMES) -> DataFrame:
    """Number of changes of a non-null value along the ordered rows of a key."""
    prev = O.carry_last(df.filter(F.col(value).isNotNull()), keys, order, F.col(value), "_prev", block, inclusive=False)
    return prev.groupBy(*keys).agg(F.sum((F.col("_prev") != F.col(value)).cast("long")).alias("_c")).select(
        *keys, F.coalesce("_c", F.lit(0)).alias("n_switches"))


# --- gaps ---------------------------------------------------------------------------------------------
def interpolate_gaps(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], max_gap: int,
                     block: int = C.BLOCK_FRAMES) -> DataFrame:
    """Rows strictly between consecutive frames 2..max_gap apart, linear in `values`."""
    keys = list(keys)
    halo = O.with_halo(df.select(*keys, order, *values), order, 0, max_gap, block)
    w = O.halo_window(keys, order)
    nxt = F.lead(F.struct(order, *values)).over(w)
    pairs = O.own_rows(halo.withColumn("_n", nxt)).withColumn("_gap", F.col("_n")[order] - F.col(order))
    pairs = pairs.filter((F.col("_gap") > 1) & (F.col("_gap") <= max_gap))
    steps = pairs.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_gap") - 1)))
    lerp = [
        (F.col(v) + (F.col("_n")[v] - F.col(v)) * (F.col("_i") / F.col("_gap"))).alias(v) for v in values
    ]
    return steps.select(*keys, (F.col(order) + F.col("_i")).alias(order), *lerp)


def teleport_filter(df: DataFrame, keys: Sequence[str], order: str, x: str, y: str, px: float = 125.0) -> DataFrame:
    """Keep points within px * max(1, gap) of the previous or the next point."""
    w = runs_over(keys, order)

    def near(shift) -> Column:
        d = F.sqrt(F.pow(F.col(x) - shift(x), 2) + F.pow(F.col(y) - shift(y), 2))
        gap = F.abs(F.col(order) - shift(order))
        return F.coalesce(d <= px * F.greatest(gap, F.lit(1)), F.lit(False))

    keep = near(lambda c: F.lag(c).over(w)) | near(lambda c: F.lead(c).over(w))
    return df.withColumn("_keep", keep).filter("_keep").drop("_keep")


def bridged_segments(df: DataFrame, keys: Sequence[str], order: str, conf: str, gap: int = 3, bridge: int = 12,
                     bracket: float = 0.30, min_points: int = 5) -> DataFrame:
    """Segment number per row; a gap up to `bridge` is crossed when both ends are confident."""
    keys = list(keys)
    w = runs_over(keys, order)
    step = F.col(order) - F.lag(order).over(w)
    crossed = (step <= bridge) & (F.col(conf) >= bracket) & (F.lag(conf).over(w) >= bracket)
    cut = F.coalesce(~((step <= gap) | crossed), F.lit(False))
    seg = df.withColumn("_cut", cut.cast("long")).withColumn("seg", F.sum("_cut").over(upto(w))).drop("_cut")
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys, "seg"))
    return seg.withColumn("seg_size", size).filter(F.col("seg_size") >= min_points)


def speed_signal(df: DataFrame, keys: Sequence[str], order: str, x: str, y: str, max_gap: int = 3,
                 clip: float = 60.0, min_frames: int = 500) -> DataFrame:
    """Dense z-normalised speed per frame 0..max of a chunk; zero speed where the gap is larger."""
    keys = list(keys)
    w = runs_over(keys, order)
    gap = F.col(order) - F.lag(order).over(w)
    v = F.sqrt(F.pow(F.col(x) - F.lag(x).over(w), 2) + F.pow(F.col(y) - F.lag(y).over(w), 2)) / gap
    moved = df.withColumn("v", F.when(gap <= max_gap, F.least(v, F.lit(clip)))).select(*keys, order, "v")
    total = moved.groupBy(*keys).agg(
        F.max(order).alias("_last"), F.count(F.lit(1)).alias("_n"),
        F.sum("v").alias("_s"), F.sum(F.col("v") * F.col("v")).alias("_q"))
    total = total.filter(F.col("_n") >= min_frames).withColumn("_len", F.col("_last") + 1)
    total = total.withColumn("_mean", F.coalesce("_s", F.lit(0.0)) / F.col("_len")).withColumn(
        "_sd", F.sqrt(F.coalesce("_q", F.lit(0.0)) / F.col("_len") - F.col("_mean") * F.col("_mean")))
    spine = total.filter("_sd > 0").withColumn(order, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))))
    return spine.join(moved, [*keys, order], "left").select(
        *keys, order, ((F.coalesce("v", F.lit(0.0)) - F.col("_mean")) / F.col("_sd")).alias("z"))


# --- thinning folds (few survivors, so the array state stays small) --------------------------------------
def _sorted_list(df: DataFrame, keys: Sequence[str], item: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("_items"))


def thin(df: DataFrame, keys: Sequence[str], order: str, gap: int, keep: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """Greedy minimum spacing: keep a row when it lies `gap` after the last *kept* one (`strict`: more)."""
    item = F.struct(F.col(order).alias("f"), *[F.col(c) for c in keep])
    lists = _sorted_list(df, keys, item)

    def step(acc: Column, e: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)["f"]
        far = (e["f"] - last > gap) if strict else (e["f"] - last >= gap)
        return F.when(F.coalesce(far, F.lit(True)), F.concat(acc, F.array(e))).otherwise(acc)

    kept = F.aggregate(F.col("_items"), F.slice(F.col("_items"), 1, 0), step)
    flat = lists.select(*keys, F.explode(kept).alias("_e"))
    return flat.select(*keys, F.col("_e.f").alias(order), *[F.col(f"_e.{c}").alias(c) for c in keep])


def debounce(df: DataFrame, keys: Sequence[str], order: str, gap: int = 30, keep: Sequence[str] = ()) -> DataFrame:
    return thin(df, keys, order, gap, keep, strict=True)


def top_with_spacing(df: DataFrame, keys: Sequence[str], order: str, weight: str, limit: int = 30, apart: int = 8) -> DataFrame:
    """By weight descending (earlier frame first), up to `limit` frames pairwise `apart` or more."""
    lists = _sorted_list(df, keys, F.struct((-F.col(weight)).alias("w"), F.col(order).alias("f")))

    def step(acc: Column, e: Column) -> Column:
        clash = F.exists(acc, lambda k: F.abs(k["f"] - e["f"]) < apart)
        return F.when((F.size(acc) < limit) & ~clash, F.concat(acc, F.array(e))).otherwise(acc)

    kept = F.aggregate(F.col("_items"), F.slice(F.col("_items"), 1, 0), step)
    flat = lists.select(*keys, F.explode(kept).alias("_e"))
    return flat.select(*keys, F.col("_e.f").alias(order), (-F.col("_e.w")).alias(weight))


# --- smoothing ----------------------------------------------------------------------------------------
def majority_smooth(df: DataFrame, keys: Sequence[str], order: str, value: str, width: int, share: float = 0.6) -> DataFrame:
    """Mode of the values within +-width frames if it holds `share` of them and a third of the window."""
    keys = list(keys)
    known = df.filter(F.col(value).isNotNull())
    reach = F.explode(F.sequence(F.col(order) - width, F.col(order) + width)).alias("_f")
    counts = known.select(*keys, order, value, reach).groupBy(*keys, "_f", value).agg(
        F.count(F.lit(1)).alias("c"), F.min(order).alias("first"))
    best = counts.groupBy(*keys, "_f").agg(
        F.sum("c").alias("n"), F.max(F.struct(F.col("c"), -F.col("first"), F.col(value).alias("v"))).alias("b"))
    span = known.groupBy(*keys).agg(F.min(order).alias("lo"), F.max(order).alias("hi"))
    out = best.join(span, keys).filter(
        F.col("_f").between(F.col("lo"), F.col("hi"))
        & (F.col("n") * 3 >= 2 * width + 1) & (F.col("b.c") >= share * F.col("n")))
    return out.select(*keys, F.col("_f").alias(order), F.col("b.v").alias(value), F.col("b.c").alias("votes"), "n")


def ema(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], alpha: float = 0.35) -> DataFrame:
    """Exponential moving average, the unbounded recursion: one fold over the rows of a key (a track of one chunk, so
    its list is bounded by the chunk's frames), which gives every row its average in one pass."""
    keys, others = list(keys), [c for c in df.columns if c not in keys]
    row = F.struct(F.col(order).alias("_at"), *[F.col(c) for c in others])
    lists = df.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("_rows"))

    def step(acc: Column, r: Column) -> Column:
        now = [F.when(F.size(acc["out"]) == 0, r[v].cast("double")).otherwise(acc["last"][v] + alpha * (r[v].cast("double") - acc["last"][v])).alias(v) for v in values]
        last = F.struct(*now)
        return F.struct(last.alias("last"), F.concat(acc["out"], F.array(last)).alias("out"))

    kind = ", ".join(f"{v}: double" for v in values)
    start = F.struct(F.expr(f"cast(null as struct<{kind}>)").alias("last"), F.expr(f"cast(array() as array<struct<{kind}>>)").alias("out"))
    smooth = F.aggregate(F.col("_rows"), start, step, lambda a: a["out"])
    flat = lists.select(*keys, F.inline(F.arrays_zip(F.col("_rows").alias("r"), smooth.alias("s"))))
    return flat.select(*[F.col(c) if c in keys else F.col(f"r.{c}") for c in df.columns], *[F.col(f"s.{v}").alias(f"{v}_ema") for v in values])


def row_median(col: str, window: Window, half: int) -> Column:
    return F.percentile(F.col(col), F.lit(0.5)).over(window.rowsBetween(-half, half))


# --- sampling -----------------------------------------------------------------------------------------
def even_sample(df: DataFrame, keys: Sequence[str], order: str, k: int, block: int = C.BLOCK_FRAMES) -> DataFrame:
    """k evenly spaced rows per key (truncated linspace over positions); all rows when n <= k."""
    keys = list(keys)
    ranked = O.rank_in_key(df, keys, order, "_rank", block)
    size = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    step = (F.col("_n") - 1) / F.lit(float(k - 1))
    picks = F.concat(
        F.transform(F.sequence(F.lit(0), F.lit(k - 2)), lambda i: F.floor(i * step)), F.array(F.col("_n") - 1))
    keep = (F.col("_n") <= k) | F.array_contains(picks, F.col("_rank") - 1)
    return ranked.join(size, keys).filter(keep).drop("_n", "_rank")


def tail_holdout(df: DataFrame, keys: Sequence[str], order: str, fraction: float, block: int = C.BLOCK_FRAMES) -> DataFrame:
    """Mark the last max(1, int(n * fraction)) rows of a key as `valid`, others `train`."""
    keys = list(keys)
    ranked = O.rank_in_key(df, keys, order, "_rank", block)
    size = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    held = F.greatest(F.floor(F.col("_n") * F.lit(fraction)).cast("long"), F.lit(1))
    split = F.when(F.col("_rank") > F.col("_n") - held, "valid").otherwise("train")
    return ranked.join(size, keys).withColumn("split", split).drop("_rank", "_n")


def hash_position(value: Column) -> Column:
    """First 15 hex digits of md5: a uniform 60-bit order, so equal-width blocks are evenly filled."""
    return F.conv(F.substring(F.md5(value.cast("string")), 1, 15), 16, 10).cast("long")


HASH_BLOCK = 1 << 53            # 128 blocks over the 60-bit range


def round_robin(df: DataFrame, group: str, item: str) -> DataFrame:
    """Items of a group in hash order; round j takes the j-th item of every group. `round` then
    `group_hash` is the output order (sorting is left to the sink)."""
    hashed = df.withColumn("_h", hash_position(F.col(item)))
    ranked = O.rank_in_key(hashed, [group], "_h", "round", HASH_BLOCK)
    return ranked.withColumn("group_hash", F.md5(F.col(group).cast("string"))).drop("_h")


# --- spans, contacts, islands -----------------------------------------------------------------------------
def span_summary(df: DataFrame, keys: Sequence[str], order: str, x: str, y: str, team: str) -> DataFrame:
    """First / last frame and position, modal team (first seen wins ties), rows. Combinable only."""
    keys = list(keys)
    point = F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    spans = df.groupBy(*keys).agg(
        F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"),
        F.min_by(point, F.col(order)).alias("first_xy"), F.max_by(point, F.col(order)).alias("last_xy"))
    votes = df.filter(F.col(team).isNotNull()).groupBy(*keys, team).agg(
        F.count(F.lit(1)).alias("c"), F.min(order).alias("f"))
    modal = votes.groupBy(*keys).agg(F.max(F.struct("c", -F.col("f"), F.col(team).alias("t"))).alias("b"))
    return spans.join(modal.select(*keys, F.col("b.t").alias(team)), keys, "left")


def islands(df: DataFrame, keys: Sequence[str], order: str, max_gap: int, out: str = "island") -> DataFrame:
    """Number groups of rows whose neighbours are at most `max_gap` apart (keys contain the chunk)."""
    w = runs_over(keys, order)
    cut = F.coalesce(F.col(order) - F.lag(order).over(w) > max_gap, F.lit(False)).cast("long")
    return df.withColumn("_cut", cut).withColumn(out, F.sum("_cut").over(upto(w))).drop("_cut")


def identity_carry(df: DataFrame, keys: Sequence[str], order: str, read: str) -> DataFrame:
    """Spread matching reads (+1) along consecutive present frames up to a contradiction (-1)."""
    keys = list(keys)
    usable = islands(df.filter(F.coalesce(F.col(read), F.lit(0)) != -1), keys, order, 1)
    hit = F.max(F.col(read) == 1).over(Window.partitionBy(*keys, "island"))
    return usable.withColumn("_hit", hit).filter("_hit").drop("_hit", "island")


def step_function(spine: DataFrame, breaks: DataFrame, keys: Sequence[str], order: str, value: str,
                  default: str, block: int = C.BLOCK_FRAMES) -> DataFrame:
    """Value of the last breakpoint at or before each spine frame."""
    keys = list(keys)
    marks = breaks.groupBy(*keys, order).agg(F.max(F.struct(F.lit(1).alias("_m"), F.col(value))).alias("_b"))
    both = spine.select(*keys, order).distinct().join(marks, [*keys, order], "full").withColumn(
        "_spine", F.col("_b").isNull())
    filled = O.carry_last(both, keys, order, F.col(f"_b.{value}"), "_v", block)
    out = filled.select(*keys, order, F.coalesce("_v", F.lit(default)).alias(value))
    return out.join(spine.select(*keys, order).distinct(), [*keys, order], "left_semi")


def contact_bursts(tracks: DataFrame, tid: str, min_iou: float, burst: int, block: int = C.BLOCK_FRAMES) -> DataFrame:
    """A track is hot for `burst` frames after its box overlaps another track's box of the frame."""
    from courtloom.functions import geometry as G

    key = ["game", "cam", "frame"]
    other = tracks.select(*key, F.col(tid).alias("_o"), *[F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")])
    met = tracks.join(other, key).filter((F.col(tid) != F.col("_o")) & (G.iou(G.Box.of(), G.Box.of("b_")) >= min_iou))
    touch = met.select(*key, tid).distinct().withColumn("_t", F.lit(1))
    marked = O.with_halo(tracks.join(touch, [*key, tid], "left"), "frame", burst, 0, block)
    w = O.halo_window(["game", "cam", tid], "frame").rangeBetween(-burst, 0)
    return O.own_rows(marked.withColumn("hot", F.coalesce(F.max("_t").over(w), F.lit(0))))


def stride2(dets: DataFrame, min_iou: float = 0.3) -> DataFrame:
    """Even frames kept; an odd frame gets the mean box of the even neighbours' greedily matched boxes of
    one class (detector order first, best overlap next), with the lower score."""
    from courtloom.functions import geometry as G
    from courtloom.operators import joins as J

    key = ["game", "cam", "frame"]
    box = ("x1", "y1", "x2", "y2")
    even = dets.filter(F.col("frame") % 2 == 0)
    nxt = even.select("game", "cam", (F.col("frame") - 2).alias("frame"), "class_id", F.col("det_idx").alias("r"), F.col("score").alias("_s"), *[F.col(c).alias(f"b_{c}") for c in box])
    pairs = even.join(nxt, [*key, "class_id"]).withColumn("iou", G.iou(G.Box.of(), G.Box.of("b_"))).filter(F.col("iou") > min_iou)
    m = J.greedy_match(pairs, key, "det_idx", "r", [F.col("det_idx"), -F.col("iou"), F.col("r")])
    odd = pairs.join(m, [*key, "det_idx", "r"]).select(
        "game", "cam", (F.col("frame") + 1).alias("frame"), "class_id", *[((F.col(c) + F.col(f"b_{c}")) / 2).alias(c) for c in box], F.least("score", "_s").alias("score"))
    return even.select(*key, "class_id", *box, "score").unionByName(odd)
