"""Votes, consensus and clustering. Counts are combinable aggregates; a frame's few boxes fold in the JVM."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtloom import constants as C
from courtloom.functions import geometry as G
from courtloom.operators import ordered as O
from courtloom.session import cut_lineage


def modal(df: DataFrame, keys: Sequence[str], value: str, seen: str, weight: Column | None = None) -> DataFrame:
    """Most frequent (or heaviest) value per key; the first seen wins ties. Adds votes, total."""
    keys = list(keys)
    w = F.count(F.lit(1)) if weight is None else F.sum(weight)
    votes = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(w.alias("c"), F.min(seen).alias("f"))
    top = votes.groupBy(*keys).agg(
        F.sum("c").alias("total"), F.max(F.struct(F.col("c"), (-F.col("f")).alias("nf"), F.col(value).alias("v"))).alias("b"))
    return top.select(*keys, F.col("b.v").alias(value), F.col("b.c").alias("votes"), "total")


def committed_mode(df: DataFrame, keys: Sequence[str], value: str, seen: str, min_votes: int = 2, min_share: float = 0.6) -> DataFrame:
    """Mode only when it has enough votes and share, else null (an abstention is a result)."""
    m = modal(df, keys, value, seen)
    ok = (F.col("votes") >= min_votes) & (F.col("votes") / F.col("total") >= min_share)
    return m.withColumn(value, F.when(ok, F.col(value)))


def confidence_vote(df: DataFrame, keys: Sequence[str], value: str, conf: str, min_conf: float = 0.6, min_reads: int = 2) -> DataFrame:
    """Largest sum of confidence over legible reads; needs `min_reads` of them. Sums are compared in
    thousandths so that summation order cannot decide."""
    keys = list(keys)
    legible = df.filter((F.col(conf) >= min_conf) & F.col(value).isNotNull())
    sums = legible.groupBy(*keys, value).agg(F.sum(F.floor(F.col(conf) * 1000 + 0.5)).alias("s"), F.count(F.lit(1)).alias("n"))
    top = sums.groupBy(*keys).agg(F.sum("n").alias("reads"), F.max(F.struct(F.col("s"), (-F.col(value)).alias("v"))).alias("b"))
    return top.filter(F.col("reads") >= min_reads).select(*keys, (-F.col("b.v")).alias(value), F.col("b.s").alias("weight"), "reads")


def decayed_vote(df: DataFrame, keys: Sequence[str], order: str, value: str, weight: str, decay: float = 0.98, floor: float = 0.01,
                 min_votes: float = 3.0) -> DataFrame:
    """Votes fade by `decay` per update of the key and vanish below `floor`; the fold is exact.

    Keys contain the chunk, one row per (key, frame): the sorted array is bounded by the chunk. Ties take
    the value that entered first, as insertion order does.
    """
    keys = list(keys)
    lists = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("f"), F.col(value).alias("v"), F.col(weight).alias("w")))).alias("u"))

    def step(acc: Column, e: Column) -> Column:
        faded = F.filter(F.transform(acc, lambda a: F.struct(a["v"].alias("v"), (a["w"] * decay).alias("w"))), lambda a: a["w"] >= floor)
        known = F.exists(faded, lambda a: a["v"] == e["v"])
        added = F.transform(faded, lambda a: F.struct(a["v"].alias("v"), F.when(a["v"] == e["v"], a["w"] + e["w"]).otherwise(a["w"]).alias("w")))
        new = F.concat(faded, F.array(F.struct(e["v"].alias("v"), e["w"].alias("w"))))
        return F.when(e["v"].isNull(), faded).when(known, added).otherwise(new)

    empty = F.transform(F.slice("u", 1, 0), lambda e: F.struct(e["v"].alias("v"), e["w"].alias("w")))
    state = F.aggregate("u", empty, step)
    total = F.aggregate(state, F.lit(0.0), lambda a, e: a + e["w"])
    best = F.aggregate(state, F.get(state, F.lit(0)), lambda a, e: F.when(e["w"] > a["w"], e).otherwise(a))
    out = lists.select(*keys, state.alias("s"), total.alias("total"), best.alias("best"))
    return out.select(
        *keys, F.when(F.col("best.w") >= min_votes, F.col("best.v")).alias(value), F.coalesce("best.w", F.lit(0.0)).alias("votes"), "total",
        ((F.col("total") >= 10) & (F.coalesce("best.w", F.lit(0.0)) / F.col("total") >= 0.8)).alias("locked"))


def weighted_centroid(df: DataFrame, keys: Sequence[str], x: str, y: str, weight: Column) -> DataFrame:
    w = F.greatest(weight, F.lit(1e-3))
    return df.withColumn("_w", w).groupBy(*keys).agg(
        (F.sum(F.col(x) * F.col("_w")) / F.sum("_w")).alias("cx"), (F.sum(F.col(y) * F.col("_w")) / F.sum("_w")).alias("cy"),
        F.count(F.lit(1)).alias("n"))


def consensus_point(df: DataFrame, keys: Sequence[str], x: str, y: str, weight: str, keep_cm: float = 150.0) -> DataFrame:
    """Median point, drop points farther than `keep_cm` (none if all are), weighted mean of the rest.
    Keys hold one row per camera, so the window is tiny."""
    w = Window.partitionBy(*keys)
    mx, my = F.percentile(F.col(x), F.lit(0.5)).over(w), F.percentile(F.col(y), F.lit(0.5)).over(w)
    d = df.withColumn("_d", G.distance(F.col(x), F.col(y), mx, my))
    near = d.withColumn("_any", F.max(F.col("_d") <= keep_cm).over(w)).filter((F.col("_d") <= keep_cm) | ~F.col("_any"))
    return near.groupBy(*keys).agg(
        (F.sum(F.col(x) * F.col(weight)) / F.sum(weight)).alias("cx"), (F.sum(F.col(y) * F.col(weight)) / F.sum(weight)).alias("cy"),
        F.count(F.lit(1)).alias("kept"))


# --- greedy clustering of the points of one frame ---------------------------------------------------------------
def fuse_ball_candidates(df: DataFrame, keys: Sequence[str], cluster_cm: float = C.CLUSTER_CM, boost: float = C.AGREEMENT_BOOST) -> DataFrame:
    """Strongest first, join the nearest cluster within reach that lacks the camera, else open one.
    `df`: cam, cx, cy, score per candidate of a frame (detector slots, so the array is bounded)."""
    keys = list(keys)
    item = F.struct((-F.col("score")).alias("o"), F.col("cam").alias("cam"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("score").alias("s"))
    lists = df.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("u"))

    def opened(e: Column) -> Column:
        return F.struct(F.array(e["cam"]).alias("cams"), (e["x"] * e["s"]).alias("wx"), (e["y"] * e["s"]).alias("wy"), e["s"].alias("w"))

    def step(acc: Column, e: Column) -> Column:
        dist = F.transform(acc, lambda c: F.when(
            ~F.array_contains(c["cams"], e["cam"]), G.distance(e["x"], e["y"], c["wx"] / c["w"], c["wy"] / c["w"])))
        best = F.array_min(F.filter(dist, lambda d: d <= cluster_cm))
        # of equally near clusters the later one takes the point
        pos = F.size(acc) - F.array_position(F.reverse(dist), best)
        grown = F.transform(acc, lambda c, i: F.when(i == pos, F.struct(
            F.concat(c["cams"], F.array(e["cam"])).alias("cams"), (c["wx"] + e["x"] * e["s"]).alias("wx"),
            (c["wy"] + e["y"] * e["s"]).alias("wy"), (c["w"] + e["s"]).alias("w"))).otherwise(c))
        return F.when(best.isNull(), F.concat(acc, F.array(opened(e)))).otherwise(grown)

    empty = F.transform(F.slice("u", 1, 0), opened)
    out = lists.select(*keys, F.explode(F.aggregate("u", empty, step)).alias("c"))
    n = F.size("c.cams")
    return out.select(*keys, (F.col("c.wx") / F.col("c.w")).alias("cx"), (F.col("c.wy") / F.col("c.w")).alias("cy"),
                      (F.col("c.w") * (1.0 + boost * (n - 1))).alias("score"), n.alias("n_cams"))


def consensus_people(df: DataFrame, keys: Sequence[str], reach: float = 120.0, min_cams: int = 2) -> DataFrame:
    """First-fit groups in (cam, x, y) order around the running mean; kept when seen by enough cameras."""
    keys = list(keys)
    lists = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("cam", F.col("cx").alias("x"), F.col("cy").alias("y")))).alias("u"))

    def opened(e: Column) -> Column:
        return F.struct(F.array(e["cam"]).alias("cams"), e["x"].alias("sx"), e["y"].alias("sy"), F.lit(1.0).alias("n"))

    def step(acc: Column, e: Column) -> Column:
        fits = F.transform(acc, lambda c: ~F.array_contains(c["cams"], e["cam"]) & (
            G.distance(e["x"], e["y"], c["sx"] / c["n"], c["sy"] / c["n"]) <= reach))
        pos = F.array_position(fits, F.lit(True)) - 1
        grown = F.transform(acc, lambda c, i: F.when(i == pos, F.struct(
            F.concat(c["cams"], F.array(e["cam"])).alias("cams"), (c["sx"] + e["x"]).alias("sx"), (c["sy"] + e["y"]).alias("sy"),
            (c["n"] + 1).alias("n"))).otherwise(c))
        return F.when(pos < 0, F.concat(acc, F.array(opened(e)))).otherwise(grown)

    empty = F.transform(F.slice("u", 1, 0), opened)
    out = lists.select(*keys, F.explode(F.aggregate("u", empty, step)).alias("g")).withColumn("n_cams", F.size(F.array_distinct("g.cams")))
    return out.filter(F.col("n_cams") >= min_cams).select(
        *keys, (F.col("g.sx") / F.col("g.n")).alias("cx"), (F.col("g.sy") / F.col("g.n")).alias("cy"), F.col("g.n").alias("n"), "n_cams")


def cluster_players(df: DataFrame, keys: Sequence[str], cluster_dist: float = 600.0, ref_dist: float = 80.0, members: bool = True) -> DataFrame:
    """Cross-camera grouping of one frame: strongest first into the nearest group that has no observation of
    the camera and no team or number conflict (a referee flip is allowed only close by).
    Input per observation: cam, track_id, cx, cy, team, jersey, score, zone_conf. `members` adds the observations of a group.

    Rows are dealt out and sorted by frame, and a task walks the frames of a batch on plain numbers."""
    keys = list(keys)
    weight = F.greatest(F.col("zone_conf") * F.col("score"), F.lit(1e-3))
    item = {"o": -F.col("score"), "cam": F.col("cam"), "t": F.col("track_id"), "x": F.col("cx").cast("double"), "y": F.col("cy").cast("double"),
            "team": F.coalesce("team", F.lit("")), "j": F.coalesce(F.col("jersey").cast("long"), F.lit(-1)), "w": weight.cast("double")}
    rows = df.select(*keys, *[c.alias(f"_{name}") for name, c in item.items()])
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([f"{k} {kind[k]}" for k in keys] + ["group_id int, cx double, cy double, team string, jersey long, n_cams int"]
                       + [f"members array<struct<cam: {kind['_cam']}, t: {kind['_t']}, team: string, j: bigint>>"] * members)
    names, n = [f.split()[0] for f in schema.split(", members")[0].split(", ")] + ["members"] * members, len(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, frame = None, []
        for batch in batches:
            found: list[tuple] = []
            for row in zip(*[batch[c].tolist() for c in batch.columns]):
                if row[:n] != key:
                    found += [(*key, *g) for g in _player_groups(frame, cluster_dist, ref_dist, members)] if frame else []
                    key, frame = row[:n], []
                frame.append(row[n + 1 :])
            if found:
                yield pd.DataFrame(found, columns=names)
        if frame:
            yield pd.DataFrame([(*key, *g) for g in _player_groups(frame, cluster_dist, ref_dist, members)], columns=names)

    return rows.repartition(*keys).sortWithinPartitions(*rows.columns).mapInPandas(run, schema=schema)


def _player_groups(frame: list[tuple], cluster_dist: float, ref_dist: float, members: bool) -> list[tuple]:
    """Groups of the sorted (cam, track, x, y, team, number, weight) of a frame."""
    groups: list[list] = []         # sums x * w, y * w, w; cameras, teams, numbers, modal team, modal number, members
    for cam, track, x, y, team, number, w in frame:
        best, near = None, cluster_dist
        for g in groups:
            if cam in g[3] or (number != -1 and g[7] is not None and number != g[7]):
                continue
            dx, dy = x - g[0] / g[2], y - g[1] / g[2]
            d = math.sqrt(dx * dx + dy * dy)
            if d <= near:           # the last of equally near groups
                if team and g[6] is not None and team != g[6] and not ((team == "REF" or g[6] == "REF") and d <= ref_dist):
                    continue
                best, near = g, d
        if best is None:
            best = [0.0, 0.0, 0.0, [], [], [], None, None, []]
            groups.append(best)
        best[0], best[1], best[2] = best[0] + x * w, best[1] + y * w, best[2] + w
        best[3].append(cam)
        if team:
            best[4].append(team)
            best[6] = max(best[4], key=best[4].count)           # the first of the most frequent
        if number != -1:
            best[5].append(number)
            best[7] = max(best[5], key=best[5].count)
        if members:
            best[8].append({"cam": cam, "t": track, "team": team, "j": number})
    return [(i, g[0] / g[2], g[1] / g[2], g[6], g[7], len(g[3]), *([g[8]] * members)) for i, g in enumerate(groups)]


def median_fusion(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Median over cameras (one row per camera and key)."""
    return O.exact_quantiles(df, keys, {"cx": x, "cy": y}, {"": 0.5})


# --- static clutter ----------------------------------------------------------------------------------------------
def stationary_cells(df: DataFrame, keys: Sequence[str], order: str, x: str, y: str, cell: float = C.STATIONARY_CELL,
                     max_occupancy: float = C.STATIONARY_OCC) -> DataFrame:
    """Grid cells occupied in more than `max_occupancy` of the frame span."""
    keys = list(keys)
    grid = df.select(*keys, order, F.bround(F.col(x) / cell).cast("long").alias("gx"), F.bround(F.col(y) / cell).cast("long").alias("gy"))
    occ = grid.groupBy(*keys, "gx", "gy").agg(F.countDistinct(order).alias("frames"))
    span = df.groupBy(*keys).agg((F.max(order) - F.min(order) + 1).alias("span"))
    return occ.join(span, keys).filter(F.col("frames") / F.col("span") > max_occupancy)


def reject_stationary(df: DataFrame, keys: Sequence[str], order: str, x: str, y: str, **kw) -> DataFrame:
    keys = list(keys)
    cell = kw.get("cell", C.STATIONARY_CELL)
    banned = stationary_cells(df, keys, order, x, y, **kw).select(*keys, "gx", "gy")
    keyed = df.withColumn("gx", F.bround(F.col(x) / cell).cast("long")).withColumn("gy", F.bround(F.col(y) / cell).cast("long"))
    return keyed.join(banned, [*keys, "gx", "gy"], "left_anti").drop("gx", "gy")


def static_logos(df: DataFrame, keys: Sequence[str], order: str, x: str, y: str, radius: float = 30.0, max_occupancy: float = 0.35,
                 max_step: float = 4.0) -> DataFrame:
    """Clusters (first point's position, first fit) that are occupied often and hardly move.
    The fold runs per clip chunk over its sorted points; its state is the list of cluster seeds."""
    keys = list(keys)
    lists = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("f"), F.col(x).alias("x"), F.col(y).alias("y")))).alias("u"))

    def step(acc: Column, e: Column) -> Column:
        taken = F.exists(acc, lambda c: G.distance(e["x"], e["y"], c["x"], c["y"]) <= radius)
        return F.when(taken, acc).otherwise(F.concat(acc, F.array(e)))

    seeds = lists.select(*keys, F.aggregate("u", F.slice("u", 1, 0), step).alias("seeds"))
    member = df.join(seeds, keys).withColumn(
        "cluster", F.array_position(F.transform("seeds", lambda c: G.distance(F.col(x), F.col(y), c["x"], c["y"]) <= radius), F.lit(True))).drop("seeds")
    w = Window.partitionBy(*keys, "cluster").orderBy(order, x, y)
    moved = member.withColumn("_s", G.distance(F.col(x), F.col(y), F.lag(x).over(w), F.lag(y).over(w)))
    span = df.groupBy(*keys).agg((F.max(order) - F.min(order) + 1).alias("span"))
    stat = moved.groupBy(*keys, "cluster").agg(
        F.countDistinct(order).alias("frames"), F.percentile(F.col("_s"), F.lit(0.5)).alias("step"), F.count(F.lit(1)).alias("points"))
    return stat.join(span, keys).withColumn(
        "is_static", (F.col("frames") / F.col("span") > max_occupancy) & (F.coalesce("step", F.lit(0.0)) < max_step))


# --- number/team rosters -------------------------------------------------------------------------------------------
def number_teams(df: DataFrame, keys: Sequence[str], num: str, team: str, min_total: int = 20, minority: float = 0.25, minority_n: int = 30) -> DataFrame:
    """Team(s) of each number: the majority, or both when the minority is large in share and count."""
    keys = list(keys)
    votes = df.groupBy(*keys, num).agg(
        F.sum((F.col(team) == "A").cast("long")).alias("a"), F.sum((F.col(team) == "B").cast("long")).alias("b"))
    total, small = F.col("a") + F.col("b"), F.least("a", "b")
    both = (small / total >= minority) & (small >= minority_n)
    verdict = F.when(both, "AB").when(F.col("a") >= F.col("b"), "A").otherwise("B")
    return votes.filter(total >= min_total).withColumn("teams", verdict)


def unique_roster(world: DataFrame, keys: Sequence[str], gid: str, order: str) -> DataFrame:
    """Modal team and number per id (referees carry none); a (team, number) stays only with its most-voted id."""
    keys = list(keys)
    team = modal(world, [*keys, gid], "team", order).select(*keys, gid, "team")
    number = modal(world, [*keys, gid], "jersey", order).select(*keys, gid, "jersey", F.col("votes").alias("jersey_votes"))
    pos = world.groupBy(*keys, gid).agg(F.count(F.lit(1)).alias("frames"))
    r = pos.join(team, [*keys, gid], "left").join(number, [*keys, gid], "left").withColumn(
        "jersey", F.when(F.coalesce(F.col("team"), F.lit("")) != "REF", F.col("jersey")))
    owner = r.filter("jersey is not null and team is not null").groupBy(*keys, "team", "jersey").agg(
        F.max(F.struct(F.col("jersey_votes"), (-F.col(gid)).alias("g"))).alias("b")).select(*keys, "team", "jersey", (-F.col("b.g")).alias("_owner"))
    out = r.join(owner, [*keys, "team", "jersey"], "left")
    keep = F.col("team").isNull() | F.col("_owner").isNull() | (F.col("_owner") == F.col(gid))
    return out.withColumn("jersey", F.when(keep, F.col("jersey"))).drop("_owner")


# --- two-way splits ---------------------------------------------------------------------------------------------------
def z_normalise(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """(x - mean) / (population std + 1e-6) per camera: two combinable moments joined back."""
    keys = list(keys)
    m = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return df.join(m, keys).withColumn(out, (F.col(value) - F.col("_m")) / (F.col("_s") + 1e-6)).drop("_m", "_s")


def two_means(df: DataFrame, keys: Sequence[str], value: str, rounds: int = 30, min_reads: int = 60, lo_max: float = -0.3, hi_min: float = 0.2) -> DataFrame:
    """1-D two-means per number, started at min and max; tag above / below the middle when the split is clear.

    Values are reduced to counts per distinct value first; the iteration then runs on that sorted value table with the
    two centres as a fold state, so no driver loop and no repeated scan is needed. Values are taken as they are.
    """
    keys = list(keys)
    grid = df.filter(F.col(value).isNotNull()).withColumn("_v", F.col(value).cast("double"))
    hist = grid.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("c"))
    lists = hist.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("_v", "c"))).alias("h"), F.min("_v").alias("lo0"), F.max("_v").alias("hi0"), F.sum("c").alias("n"))

    def mean(cells: Column, fallback: Column) -> Column:
        n = F.aggregate(cells, F.lit(0).cast("long"), lambda a, e: a + e["c"])
        s = F.aggregate(cells, F.lit(0.0), lambda a, e: a + e["_v"] * e["c"])
        return F.when(n > 0, s / n).otherwise(fallback)

    def step(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        below, above = F.filter("h", lambda e: e["_v"] <= mid), F.filter("h", lambda e: e["_v"] > mid)
        return F.struct(mean(below, acc["lo"]).alias("lo"), mean(above, acc["hi"]).alias("hi"))

    centres = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(F.col("lo0").alias("lo"), F.col("hi0").alias("hi")), step)
    out = lists.filter(F.col("n") >= min_reads).select(*keys, "n", centres.alias("m"))
    return out.select(*keys, "n", F.col("m.lo").alias("lo"), F.col("m.hi").alias("hi"), ((F.col("m.lo") + F.col("m.hi")) / 2).alias("threshold"),
                      ((F.col("m.lo") < lo_max) & (F.col("m.hi") > hi_min)).alias("accepted"))


def two_team_clusters(features: DataFrame, keys: Sequence[str], hue: str, brightness: str, refuse: float = 0.75, hue_gap: float = 8.0, rounds: int = 30) -> DataFrame:
    """Two-means on the colour features of each key (a camera of a game, say), all keys at once.

    Equal features are counted first, so a round is a map over distinct colours and two combinable means. Centres start
    at the lowest and highest hue (brightness breaks ties). A is the cluster with the lower median hue (the darker when
    the hues are within `hue_gap`); a point nearly as close to the other centre, or of a key with fewer than two rows,
    gets null.
    """
    keys = list(keys)
    cells = cut_lineage(features.groupBy(*keys, F.col(hue).cast("double").alias("_h"), F.col(brightness).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n")))
    spot = F.struct("_h", "_v")
    centres = cells.groupBy(*keys).agg(F.min(spot).alias("a"), F.max(spot).alias("b"), F.sum("_n").alias("rows"))

    def far(c: str) -> Column:
        return G.distance(F.col("_h"), F.col("_v"), F.col(f"{c}._h"), F.col(f"{c}._v"))

    def mean(side: Column, old: str) -> Column:
        n = F.sum(F.when(side, F.col("_n")))
        return F.when(n > 0, F.struct((F.sum(F.when(side, F.col("_h") * F.col("_n"))) / n).alias("_h"), (F.sum(F.when(side, F.col("_v") * F.col("_n"))) / n).alias("_v"))).otherwise(F.first(old))

    for _ in range(rounds):
        near_a = far("a") <= far("b")
        new = cut_lineage(cells.join(centres, keys).groupBy(*keys).agg(mean(near_a, "a").alias("na"), mean(~near_a, "b").alias("nb"), F.first("rows").alias("rows"),
                                                                      F.first("a").alias("a"), F.first("b").alias("b")))
        done = new.filter("na <> a or nb <> b").isEmpty()
        centres = new.select(*keys, F.col("na").alias("a"), F.col("nb").alias("b"), "rows")
        if done:
            break
    placed = cells.join(centres, keys).withColumn("_da", far("a")).withColumn("_db", far("b")).withColumn("_low", F.col("_da") <= F.col("_db"))
    middle = placed.groupBy(*keys).agg(*[F.expr(f"percentile({c}, 0.5D, _n) filter (where {side})").alias(name) for c, side, name in (
        ("_h", "_low", "ha"), ("_h", "not _low", "hb"), ("_v", "_low", "va"), ("_v", "not _low", "vb"))])
    dark = F.abs(F.col("ha") - F.col("hb")) < hue_gap
    placed = placed.join(middle.select(*keys, F.coalesce(F.when(dark, F.col("va") <= F.col("vb")).otherwise(F.col("ha") <= F.col("hb")), F.lit(True)).alias("_a_low")), keys)
    near, other = F.least("_da", "_db"), F.greatest("_da", "_db")
    unsure = (near / F.greatest(other, F.lit(1e-9)) > refuse) | (F.col("rows") < 2)
    team = F.when(unsure, F.lit(None)).when(F.col("_low") == F.col("_a_low"), "A").otherwise("B")
    named = placed.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], "_h", "_v", team.alias("_team"))
    on = [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)] + [F.col(hue).cast("double").eqNullSafe(F.col("_h")), F.col(brightness).cast("double").eqNullSafe(F.col("_v"))]
    return features.join(named, on, "left").select(*[c for c in features.columns if c != "team"], F.col("_team").alias("team"))
