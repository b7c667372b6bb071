"""Windows, runs and ordered folds over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtloom.operators import sequence as S
from courtloom.plans import adapters as A
from courtloom.plans.registry import query

col = F.col
B = A.BLOCK

RLE_SQL = """select game, min(frame) as start_frame, max(frame) as end_frame, cand as value, count(*) as n from
  (select *, sum(st) over (partition by game order by frame) as run from
    (select *, case when lag(cand) over w = cand and frame - lag(frame) over w <= {gap} then 0 else 1 end as st
     from {src} where cand is not null window w as (partition by game order by frame)))
  group by game, run, cand"""


@query("win01_rle_segments", "game start_frame end_frame value:s n", "cand", RLE_SQL.format(gap=3, src="cand"))
def _(spark, sf):
    return S.rle(A.candidates(spark, sf), ["game"], "frame", "cand", 3, block=B).withColumnRenamed("cand", "value")


HYST_SQL = """with r0 as (select *, sum(ch) over (partition by game, chunk order by frame) as r from
    (select *, case when cand is not distinct from lag(cand) over (partition by game, chunk order by frame) and row_number() over (partition by game, chunk order by frame) > 1 then 0 else 1 end as ch from cand)),
  p0 as (select *, row_number() over (partition by game, chunk, r order by frame) as p0 from r0),
  f as (select *, min(case when cand is not null and p0 >= {k} then frame end) over (partition by game, chunk) as first from p0),
  r1 as (select game, chunk, frame, cand, first, sum(ch1) over (partition by game, chunk order by frame) as rr from
    (select *, case when cand = lag(cand) over (partition by game, chunk order by frame) then 0 else 1 end as ch1 from f where cand is not null)),
  p as (select *, row_number() over (partition by game, chunk, rr order by frame) as p from r1),
  t as (select game, chunk, frame, cand, case when frame = first or (frame > first and p >= {k}) then cand end as taken from p
        union all select game, chunk, frame, cand, null from f where cand is null)
  select * from (select game, chunk, frame, last_value(taken ignore nulls) over (partition by game, chunk order by frame) as holder from t) where holder is not null"""


@query("win02_hysteresis_holder", "game chunk frame holder:s", "cand", HYST_SQL.format(k=2))
def _(spark, sf):
    return S.hysteresis(A.candidates(spark, sf), ["game", "chunk"], "frame", "cand", 2)


@query("win06_majority_smoothing", "game frame value:s votes n", "cand",
       """with c as (select * from cand where cand is not null),
          v as (select c.game, c.frame + d.d as f, c.cand, count(*) as cnt, min(c.frame) as first from c, (select range - 3 as d from range(7)) d group by all),
          t as (select *, sum(cnt) over (partition by game, f) as n, row_number() over (partition by game, f order by cnt desc, first) as rn from v),
          s as (select game, min(frame) as lo, max(frame) as hi from c group by game)
          select t.game, f as frame, cand as value, cnt as votes, n from t join s on t.game = s.game
          where rn = 1 and f between lo and hi and n * 3 >= 7 and cnt >= 6e-1 * n""")
def _(spark, sf):
    return S.majority_smooth(A.candidates(spark, sf), ["game"], "frame", "cand", 3).withColumnRenamed("cand", "value")


@query("win07_anchor_interpolation", "game uid frame cx:h cy:h", "obs",
       """select game, uid, frame + i as frame, cx + (nx - cx) * (i::double / gap) as cx, cy + (ny - cy) * (i::double / gap) as cy from
          (select *, nf - frame as gap, unnest(range(1, nf - frame)) as i from
            (select *, lead(frame) over w as nf, lead(cx) over w as nx, lead(cy) over w as ny from obs window w as (partition by game, uid order by frame))
           where nf - frame > 1 and nf - frame <= 60)""")
def _(spark, sf):
    return S.interpolate_gaps(A.observations(spark, sf), ["game", "uid"], "frame", ["cx", "cy"], 60, block=4000)


@query("win08_track_gap_fill", "game cam track_id class_id frame x1:h y2:h score:k", "trk",
       """with t as (select game, cam, track_id, class_id, frame, x1, y2, score from trk)
          select game, cam, track_id, class_id, frame, x1, y2, score from t union all
          select game, cam, track_id, class_id, frame + i, x1 + (nx - x1) * (i::double / gap), y2 + (ny - y2) * (i::double / gap), 3e-1 from
          (select *, nf - frame as gap, unnest(range(1, nf - frame)) as i from
            (select *, lead(frame) over w as nf, lead(x1) over w as nx, lead(y2) over w as ny from t window w as (partition by game, cam, track_id, class_id order by frame))
           where nf - frame > 1 and nf - frame <= 20)""")
def _(spark, sf):
    t = A.tracks(spark, sf)
    keys = ["game", "cam", "track_id", "class_id"]
    filled = S.interpolate_gaps(t, keys, "frame", ["x1", "y1", "x2", "y2"], 20, block=B).withColumn("score", F.lit(0.3))
    return t.select(*keys, "frame", "x1", "y1", "x2", "y2", "score").unionByName(filled)


TELEPORT_SQL = """select * from (select *,
   sqrt(pow(ball_x - lag(ball_x) over w, 2) + pow(ball_y - lag(ball_y) over w, 2)) <= 40e0 * greatest(frame - lag(frame) over w, 1) as a,
   sqrt(pow(ball_x - lead(ball_x) over w, 2) + pow(ball_y - lead(ball_y) over w, 2)) <= 40e0 * greatest(lead(frame) over w - frame, 1) as b
   from ball window w as (partition by game, cam, chunk order by frame)) where coalesce(a, false) or coalesce(b, false)"""


@query("win10_teleport_rejection", "game cam frame ball_x:h ball_y:h", "ball", TELEPORT_SQL)
def _(spark, sf):
    return S.teleport_filter(A.ball(spark, sf), ["game", "cam", "chunk"], "frame", "ball_x", "ball_y", 40.0)


SEG_SQL = """select * from (select *, count(*) over (partition by game, cam, chunk, seg) as seg_size from (select *, sum(cut) over (partition by game, cam, chunk order by frame) as seg from
   (select *, case when lag(frame) over w is null or frame - lag(frame) over w <= 1 or (frame - lag(frame) over w <= 3 and score >= 8e-1 and lag(score) over w >= 8e-1) then 0 else 1 end as cut
    from ball window w as (partition by game, cam, chunk order by frame)))) where seg_size >= 5"""


@query("win11_bridged_segments", "game cam chunk frame seg seg_size", "ball", SEG_SQL)
def _(spark, sf):
    return S.bridged_segments(A.ball(spark, sf), ["game", "cam", "chunk"], "frame", "score", 1, 3, 0.8)


SPEED_SQL = """with m as (select game, cam, chunk, frame % 300 as frame, case when frame - lag(frame) over w <= 3 then
    least(sqrt(pow(ball_x - lag(ball_x) over w, 2) + pow(ball_y - lag(ball_y) over w, 2)) / (frame - lag(frame) over w), 60e0) end as v
    from ball window w as (partition by game, cam, chunk order by frame)),
  t as (select game, cam, chunk, max(frame) as last, max(frame) + 1 as len, coalesce(sum(v), 0) / (max(frame) + 1) as mean,
    sqrt(coalesce(sum(v * v), 0) / (max(frame) + 1) - pow(coalesce(sum(v), 0) / (max(frame) + 1), 2)) as sd from m group by all having count(*) >= 50),
  s as (select *, unnest(range(0, last + 1)) as frame from t where sd > 0)
  select s.game, s.cam, s.chunk, s.frame, (coalesce(v, 0) - mean) / sd as z from s left join m using (game, cam, chunk, frame)"""


def speed(spark, sf):
    ball = A.ball(spark, sf).withColumn("frame", col("frame") % A.CHUNK)
    return S.speed_signal(ball, ["game", "cam", "chunk"], "frame", "ball_x", "ball_y", min_frames=50)


@query("win12_speed_signal", "game cam chunk frame z:k", "ball", SPEED_SQL)
def _(spark, sf):
    return speed(spark, sf)


@query("win14_debounce", "game cam chunk frame", "ball",
       """select game, cam, chunk, unnest(list_reduce(list([frame] order by frame), lambda a, e: case when e[1] - a[-1] > 5 then list_concat(a, e) else a end)) as frame
          from ball group by game, cam, chunk""")
def _(spark, sf):
    return S.debounce(A.ball(spark, sf), ["game", "cam", "chunk"], "frame", 5)


@query("win16_identity_switches", "game uid n_switches", "obs",
       """select game, uid, coalesce(sum(case when p <> etype then 1 end), 0) as n_switches from
          (select *, lag(etype) over (partition by game, uid order by frame) as p from obs) group by game, uid""")
def _(spark, sf):
    return S.value_changes(A.observations(spark, sf), ["game", "uid"], "frame", "etype", block=4000)


READ = "case when score >= 9e-1 then 1 when score <= 55e-2 then -1 else 0 end"
CARRY_SQL = f"""with u as (select *, {READ} as read from streams),
   i as (select *, frame - row_number() over (partition by game, cam, sid, chunk order by frame) as isl from u where read <> -1)
   select game, cam, sid, frame from (select *, max(read) over (partition by game, cam, sid, chunk, isl) as hit from i) where hit = 1"""


@query("win17_identity_carry", "game cam sid:s frame", "streams", CARRY_SQL)
def _(spark, sf):
    s = A.streams(spark, sf).withColumn("read", F.expr(READ))
    return S.identity_carry(s, ["game", "cam", "sid", "chunk"], "frame", "read")


@query("win18_min_gap_thinning", "game cam sid:s chunk frame", "streams",
       """select game, cam, sid, chunk, unnest(list_reduce(list([frame] order by frame), lambda a, e: case when e[1] - a[-1] >= 9 then list_concat(a, e) else a end)) as frame
          from streams group by game, cam, sid, chunk""")
def _(spark, sf):
    return S.thin(A.streams(spark, sf), ["game", "cam", "sid", "chunk"], "frame", 9)


@query("win19_top_with_spacing", "game cam chunk frame w", "det",
       """with c as (select game, cam, chunk, frame, count(*) as w from det group by all),
          l as (select game, cam, chunk, list_reduce(list([[frame, w]] order by w desc, frame),
             lambda a, e: case when len(a) < 10 and len(list_filter(a, lambda k: abs(k[1] - e[1][1]) < 8)) = 0 then list_concat(a, e) else a end) as k from c group by all),
          u as (select game, cam, chunk, unnest(k) as k from l)
          select game, cam, chunk, k[1] as frame, k[2] as w from u""")
def _(spark, sf):
    counts = A.detections(spark, sf).groupBy("game", "cam", "chunk", "frame").agg(F.count(F.lit(1)).alias("w"))
    return S.top_with_spacing(counts, ["game", "cam", "chunk"], "frame", "w", 10, 8)


RUNS_SQL = """with m as (select game, uid, day, frame, cam, median(cx) over w as self, median(cy) over w as rival from (select *, cast(floor(frame / 14400) as bigint) as day from obs)
     window w as (partition by game, uid, day order by frame rows between 2 preceding and 2 following)),
   f as (select *, rival < 75e-2 * self as foreign_ from m),
   r as (select *, row_number() over (partition by game, uid, day order by frame) - row_number() over (partition by game, uid, day, foreign_ order by frame) as g from f),
   v as (select game, uid, day, g, cam, count(*) as c, min(frame) as f0, max(frame) as f1 from r where foreign_ group by all)
   select game, uid, min(f0) as f0, max(f1) as f1, sum(c) as n, arg_min(cam, (-c, f0)) as rival from v group by game, uid, day, g having sum(c) >= 3"""


@query("win20_sustained_foreign_runs", "game uid f0 f1 n rival", "obs", RUNS_SQL)
def _(spark, sf):
    o = A.observations(spark, sf).withColumn("day", F.floor(col("frame") / 14400).cast("long"))
    keys = ["game", "uid", "day"]
    w = S.runs_over(keys, "frame")
    m = o.withColumn("self", S.row_median("cx", w, 2)).withColumn("rival", S.row_median("cy", w, 2))
    m = m.withColumn("bad", col("rival") < 0.75 * col("self"))
    change = F.coalesce((col("bad") != F.lag("bad").over(w)).cast("long"), F.lit(1))
    r = m.withColumn("_ch", change).withColumn("g", F.sum("_ch").over(S.upto(w))).filter("bad")
    votes = r.groupBy(*keys, "g", "cam").agg(F.count(F.lit(1)).alias("c"), F.min("frame").alias("f0"), F.max("frame").alias("f1"))
    runs = votes.groupBy(*keys, "g").agg(
        F.min("f0").alias("f0"), F.max("f1").alias("f1"), F.sum("c").alias("n"), F.max(F.struct("c", -col("f0"), "cam")).alias("b"))
    return runs.filter("n >= 3").withColumn("rival", col("b.cam"))


@query("win21_even_sampling", "game uid frame", "obs",
       """with r as (select *, row_number() over (partition by game, uid order by frame) - 1 as rk, count(*) over (partition by game, uid) as n from obs)
          select game, uid, frame from r where n <= 10 or rk = n - 1
            or list_contains([cast(floor(i * ((n - 1) / 9e0)) as bigint) for i in range(9)], rk)""")
def _(spark, sf):
    return S.even_sample(A.observations(spark, sf), ["game", "uid"], "frame", 10, block=4000)


@query("win22_round_robin", "source:s doc_id round group_hash:s", "",
       """select source, doc_id, row_number() over (partition by source order by left(md5(doc_id::varchar), 15)) as round, md5(source) as group_hash from documents""")
def _(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("source", "doc_id")
    return S.round_robin(docs, "source", "doc_id")


@query("win23_ema", "game gid chunk frame x:h y:h", "world",
       """with r as (select *, row_number() over (partition by game, gid, chunk order by frame) - 1 as i from world)
          select game, gid, chunk, frame,
            pow(65e-2, i) * sum(cx * pow(65e-2, -i) * case when i = 0 then 1e0 else 35e-2 end) over (partition by game, gid, chunk order by frame) + 1e-7 as x,
            pow(65e-2, i) * sum(cy * pow(65e-2, -i) * case when i = 0 then 1e0 else 35e-2 end) over (partition by game, gid, chunk order by frame) + 1e-7 as y from r""")
def _(spark, sf):
    out = S.ema(A.world(spark, sf), ["game", "gid", "chunk"], "frame", ["cx", "cy"])
    return out.withColumn("x", col("cx_ema") + 1e-7).withColumn("y", col("cy_ema") + 1e-7)


@query("win27_tail_holdout", "cam game frame split:s", "world",
       """select cam, game, frame, case when row_number() over (partition by cam order by frame * 4 + game) > n - greatest(cast(floor(n * 2e-1) as bigint), 1) then 'valid' else 'train' end as split
          from (select *, count(*) over (partition by cam) as n from (select distinct cam, game, frame from world))""")
def _(spark, sf):
    stems = A.world(spark, sf).select("cam", "game", "frame").distinct().withColumn("ord", col("frame") * 4 + col("game"))
    return S.tail_holdout(stems, ["cam"], "ord", 0.2, block=1000)


XCORR_SQL = f"""with z as ({SPEED_SQL}), n as (select game, cam, chunk, count(*) as n from z group by all),
   c as (select b.game, b.cam, b.chunk, l.k, sum(a.z * b.z) / (least(na.n, nb.n) - abs(l.k)) as c
     from z b cross join (select range - 20 as k from range(41)) l
     join z a on a.game = b.game and a.chunk = b.chunk and a.cam = 0 and a.frame = b.frame - l.k
     join n na on na.game = a.game and na.chunk = a.chunk and na.cam = 0 join n nb on nb.game = b.game and nb.chunk = b.chunk and nb.cam = b.cam
     where b.cam > 0 and a.frame < least(na.n, nb.n) and b.frame < least(na.n, nb.n) group by b.game, b.cam, b.chunk, l.k, na.n, nb.n)
   select game, cam, chunk, lag, peak, n_lags from (select *, row_number() over (partition by game, cam, chunk order by r desc, k) as rn, k as lag, c as peak,
     count(*) over (partition by game, cam, chunk) as n_lags from (select *, floor(c * 1e6 + 5e-1) as r from c)) where rn = 1"""


@query("win28_cross_correlation_lag", "game cam chunk lag peak:k n_lags", "ball", XCORR_SQL)
def _(spark, sf):
    from courtloom.operators import sync
    return sync.lag_peak(speed(spark, sf), ["game", "chunk"], "cam", 0, "frame", "z", 20)


@query("win30_step_function", "game frame holder:s", "cand obs",
       """with b as (select game, frame, max(cand) as cand from cand where cand is not null and frame % 3 = 0 group by all),
          s as (select distinct game, cast(floor(frame / 30) as bigint) as frame from obs)
          select s.game, s.frame, coalesce(b.cand, 'loose') as holder from s asof left join b on s.game = b.game and s.frame >= b.frame""")
def _(spark, sf):
    breaks = A.candidates(spark, sf).filter("cand is not null and frame % 3 = 0")
    spine = A.observations(spark, sf).selectExpr("game", "cast(floor(frame / 30) as bigint) as frame")
    return S.step_function(spine, breaks, ["game"], "frame", "cand", "loose", B).withColumnRenamed("cand", "holder")


TIE_SQL = """with a as (select game, uid, frame, cam, cx from obs where k_amb),
   i as (select *, sum(cut) over (partition by game, uid, day order by frame) as isl from
     (select *, case when frame - lag(frame) over (partition by game, uid, day order by frame) > 400 then 1 else 0 end as cut from
       (select *, cast(floor(frame / 14400) as bigint) as day from obs where eid % 3 > 0))),
   g as (select *, count(*) over (partition by game, uid, day, isl) as n from i),
   c as (select game, uid, day, isl, n, cam, count(*) as cover, avg(cx) as d, min(frame) as f0 from g where n >= 3 group by all)
   select game, uid, day, isl, n, cam, cover, d from c where cover >= greatest(3, 3e-1 * n)
   qualify row_number() over (partition by game, uid, day, isl order by d, cam) = 1"""
TIE_SQL = TIE_SQL[:5] + TIE_SQL[TIE_SQL.index("i as (select"):]


@query("win31_tie_run_vote", "game uid day isl n cam cover d:h", "obs", TIE_SQL)
def _(spark, sf):
    o = A.observations(spark, sf).filter("eid % 3 > 0").withColumn("day", F.floor(col("frame") / 14400).cast("long"))
    keys = ["game", "uid", "day"]
    i = S.islands(o, keys, "frame", 400, "isl")
    n = i.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys, "isl"))).filter("n >= 3")
    c = n.groupBy(*keys, "isl", "n", "cam").agg(F.count(F.lit(1)).alias("cover"), F.avg("cx").alias("d"))
    ok = c.filter(col("cover") >= F.greatest(F.lit(3.0), 0.3 * col("n")))
    best = ok.groupBy(*keys, "isl", "n").agg(F.min(F.struct("d", "cam", "cover")).alias("b"))
    return best.select(*keys, "isl", "n", "b.cam", "b.cover", "b.d")


@query("win33_span_summary", "game gid chunk first last n fx:h lx:h team:s", "world",
       """with s as (select game, gid, chunk, min(frame) as first, max(frame) as last, count(*) as n, arg_min(cx, frame) as fx, arg_max(cx, frame) as lx from world group by all),
          t as (select game, gid, chunk, team, count(*) as c, min(frame) as f from world group by all)
          select s.*, t.team from s join t using (game, gid, chunk) qualify row_number() over (partition by game, gid, chunk order by c desc, f) = 1""")
def _(spark, sf):
    out = S.span_summary(A.world(spark, sf), ["game", "gid", "chunk"], "frame", "cx", "cy", "team")
    return out.withColumn("fx", col("first_xy.x")).withColumn("lx", col("last_xy.x"))


def segments(spark, sf):
    """Holder segments of the candidate stream (game, start_frame, end_frame, value)."""
    return S.rle(A.candidates(spark, sf), ["game"], "frame", "cand", 3, block=B).withColumnRenamed("cand", "value")


A.CTES["seg"] = (("cand",), RLE_SQL.format(gap=3, src="cand"))
