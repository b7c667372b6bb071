"""Joins over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtloom.functions import geometry as G
from courtloom.operators import joins as J
from courtloom.operators import sequence as S
from courtloom.operators import sync
from courtloom.plans import adapters as A
from courtloom.plans.q_columns import IOU_SQL, PAIR_SQL, ball_boxes
from courtloom.plans.q_windows import segments
from courtloom.plans.registry import query

col = F.col


@query("jn01_camera_alignment", "game cam ref track_id pk", "trk offs",
       "select t.game, t.cam, frame - off as ref, track_id, pk from trk t join offs o on t.game = o.game and t.cam = o.cam")
def _(spark, sf):
    return sync.align(A.tracks(spark, sf), A.offsets(spark))


@query("jn02_roster_resolution", "sk name:s team n", "raw roster",
       """with k as (select sk, pk % 70 as num, case when pk % 3 > 0 then kit end as kit, count(*) as n from raw group by all),
          c as (select num, count(*) as c, min(name) as name, min(team) as team from roster group by num),
          t as (select num, team, count(*) as c, min(name) as name from roster group by all)
          select sk, case when c.c = 1 then c.name when t.c = 1 then t.name end as name, case when c.c = 1 then c.team when t.c = 1 then t.team end as team, sum(n) as n
          from k left join c on k.num = c.num left join t on k.num = t.num and t.team = case kit when 'B' then 1 when 'W' then 2 end group by all""")
def _(spark, sf):
    raw = A.raw_detections(spark, sf).drop("num")
    keys = raw.select("sk", (col("pk") % 70).alias("num"), F.when(col("pk") % 3 > 0, col("kit")).alias("kit"))
    keys = keys.groupBy("sk", "num", "kit").agg(F.count(F.lit(1)).alias("n"))
    return J.resolve_roster(keys, A.roster(spark, sf)).groupBy("sk", "name", "team").agg(F.sum("n").alias("n"))


@query("jn03_ball_box_join", "game cam frame sid:s n", "ball streams",
       f"select game, cam, frame, sid, count(*) over (partition by game, cam, frame) as n from ({PAIR_SQL}) where ball_x between x1 and x2 and ball_y between y1 and y2")
def _(spark, sf):
    inside = ball_boxes(spark, sf).filter(G.Box.of().contains(col("ball_x"), col("ball_y")))
    return inside.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("game", "cam", "frame")))


READS_SQL = "select game, cam, frame, det_idx as lid, num, kit, score, x1, y1, x2, y2 from det where class_id = 0 and score >= 7e-1"


def reads(spark, sf):
    """Number reads: confident class-0 boxes."""
    return A.detections(spark, sf).filter("class_id = 0 and score >= 7e-1").withColumnRenamed("det_idx", "lid")


@query("jn04_best_iou_attach", "game cam frame read_id det_idx iou:k", "det",
       f"""select game, cam, frame, lid as read_id, det_idx, iou from (select a.*, b.det_idx, {IOU_SQL} as iou from ({READS_SQL}) a
           join det b on a.game = b.game and a.cam = b.cam and a.frame = b.frame and b.class_id = 1)
           where iou > 3e-1 qualify row_number() over (partition by game, cam, frame, lid order by iou desc, det_idx) = 1""")
def _(spark, sf):
    left = reads(spark, sf).withColumn("lid", F.struct("game", "cam", "frame", "lid"))
    right = J.as_right_box(A.detections(spark, sf).filter("class_id = 1"), "det_idx")
    out = J.best_iou(left.select("game", "cam", "frame", "lid", "x1", "y1", "x2", "y2"), right, "det_idx", 0.3, col("det_idx"))
    return out.select("lid.game", "lid.cam", "lid.frame", col("lid.lid").alias("read_id"), "det_idx", "iou")


@query("jn05_nearest_detection", "game frame gid det_idx dist:h", "world det",
       """select w.game, w.frame, w.gid, d.cam * 32 + d.det_idx as det_idx, sqrt((w.cx - d.pk * 7 % 2144) * (w.cx - d.pk * 7 % 2144) + (w.cy - d.sk * 131 % 1427) * (w.cy - d.sk * 131 % 1427)) as dist
          from world w join det d on w.game = d.game and w.frame = d.frame where d.class_id = 0 and dist < 180
          qualify row_number() over (partition by w.game, w.frame, w.gid order by dist, det_idx) = 1""")
def _(spark, sf):
    det = A.detections(spark, sf).filter("class_id = 0").selectExpr(
        "game", "frame", "det_idx as slot", "cam * 32 + det_idx as det_idx", "cast(pk * 7 % 2144 as double) as rx", "cast(sk * 131 % 1427 as double) as ry")
    return J.nearest_point(A.world(spark, sf), det, ["game", "frame"], "gid", "det_idx", 180.0, tie="slot")


@query("jn06_nearest_event", "game play_id m_eid dt", "plays cv",
       """select p.game, p.play_id, c.eid as m_eid, abs(c.t - p.t) as dt from plays p left join cv c on p.game = c.game and abs(c.t - p.t) <= 1800
          qualify row_number() over (partition by p.game, p.play_id order by abs(c.t - p.t), c.t, c.eid) = 1""")
def _(spark, sf):
    return J.nearest_in_time(A.plays(spark, sf), A.cv_events(spark, sf), ["game"], "t", ["eid"], 1800)


@query("jn06b_nearest_shot_preferring_quality", "game play_id eid m_t", "plays cv",
       """select p.game, p.play_id, c.eid, c.t as m_t from plays p join cv c on p.game = c.game and abs(c.t - p.t) <= 3600
          qualify row_number() over (partition by p.game, p.play_id order by c.rq is null, c.rq, abs(c.t - p.t), c.t, c.eid) = 1""")
def _(spark, sf):
    prefer = [col("rq").isNull().cast("int"), F.coalesce(col("rq"), F.lit(9.9))]
    return J.preferred_in_window(A.plays(spark, sf), A.cv_events(spark, sf), ["game"], "play_id", "t", 3600, prefer, ["eid", "rq"])


@query("jn07_two_tier_as_of", "game play_id m_eid tier", "plays cv",
       """with e as (select p.game, p.play_id, c.eid from plays p join cv c on p.game = c.game and abs(c.t - p.t) <= 600
             qualify row_number() over (partition by p.game, p.play_id order by abs(c.t - p.t), c.t, c.eid) = 1),
          f as (select p.game, p.play_id, c.eid from plays p join cv c on p.game = c.game and c.rq is not null and abs(c.t - p.t) <= 3600
             qualify row_number() over (partition by p.game, p.play_id order by abs(c.t - p.t), c.t, c.eid) = 1)
          select p.game, p.play_id, coalesce(e.eid, f.eid) as m_eid, case when e.eid is not null then 1 when f.eid is not null then 2 else 0 end as tier
          from plays p left join e using (game, play_id) left join f using (game, play_id)""")
def _(spark, sf):
    cv = A.cv_events(spark, sf)
    near = J.nearest_in_time(A.plays(spark, sf), cv, ["game"], "t", ["eid"], 600).drop("dt", "m_t")
    both = J.nearest_in_time(near.withColumnRenamed("m_eid", "e1"), cv.filter("rq is not null"), ["game"], "t", ["eid"], 3600)
    tier = F.when(col("e1").isNotNull(), 1).when(col("m_eid").isNotNull(), 2).otherwise(0)
    return both.withColumn("tier", tier).withColumn("m_eid", F.coalesce("e1", "m_eid"))


TEAM_OF_VALUE = "case when value in ('click', 'view') then 1 when value in ('purchase', 'error') then 2 end"


@query("jn08_attacking_team", "game play_id team", "plays seg",
       f"""with w as (select game, play_id, t / 18e2 - 5 as lo, t / 18e2 - 1 as hi from plays),
          o as (select w.game, w.play_id, {TEAM_OF_VALUE} as team, sum(least(hi, end_frame) - greatest(lo, start_frame)) as ov
             from w join seg s on w.game = s.game and least(hi, end_frame) > greatest(lo, start_frame) group by all),
          p as (select game, play_id, coalesce(sum(case when team = 1 then ov end), 0) as a, coalesce(sum(case when team = 2 then ov end), 0) as b from o group by all)
          select game, play_id, case when floor(a * 1e6 + 5e-1) > floor(b * 1e6 + 5e-1) then 1 when floor(a * 1e6 + 5e-1) < floor(b * 1e6 + 5e-1) then 2 end as team from p""")
def _(spark, sf):
    w = A.plays(spark, sf).select("game", "play_id", (col("t") / 1800 - 5).alias("lo"), (col("t") / 1800 - 1).alias("hi"))
    o = J.interval_overlap(w, segments(spark, sf), ["game"], "play_id", "lo", "hi", "start_frame", "end_frame", "value", 16)
    team = F.expr(TEAM_OF_VALUE)
    p = o.groupBy("game", "play_id").agg(
        F.floor(F.coalesce(F.sum(F.when(team == 1, col("overlap"))), F.lit(0.0)) * 1e6 + 0.5).alias("a"),
        F.floor(F.coalesce(F.sum(F.when(team == 2, col("overlap"))), F.lit(0.0)) * 1e6 + 0.5).alias("b"))
    return p.withColumn("team", F.when(col("a") > col("b"), 1).when(col("a") < col("b"), 2))


@query("jn09_point_in_segment", "game play_id start_frame end_frame value:s", "plays seg",
       """select p.game, p.play_id, s.start_frame, s.end_frame, s.value from plays p
          left join seg s on p.game = s.game and cast(floor(p.t / 1800) as bigint) between s.start_frame and s.end_frame""")
def _(spark, sf):
    pts = A.plays(spark, sf).selectExpr("game", "play_id", "cast(floor(t / 1800) as bigint) as f")
    return J.point_in_segment(pts, segments(spark, sf), ["game"], "f", "start_frame", "end_frame", 16)


@query("jn10_first_new_holder", "game play_id new_start new_value:s", "plays seg",
       """with p as (select p.game, p.play_id, cast(floor(p.t / 1800) as bigint) as f, s.value as cur from plays p
             left join seg s on p.game = s.game and cast(floor(p.t / 1800) as bigint) between s.start_frame and s.end_frame)
          select p.game, p.play_id, s.start_frame as new_start, s.value as new_value from p join seg s on p.game = s.game and s.start_frame between f - 1 and f + 9
          qualify row_number() over (partition by p.game, p.play_id order by s.value is not distinct from cur, s.start_frame) = 1""")
def _(spark, sf):
    seg = segments(spark, sf)
    pts = A.plays(spark, sf).selectExpr("game", "play_id", "cast(floor(t / 1800) as bigint) as f")
    cur = J.point_in_segment(pts, seg, ["game"], "f", "start_frame", "end_frame", 16).select("game", "play_id", "f", "value")
    return J.first_new_after(cur, seg, ["game"], "play_id", "f", "start_frame", "value", "value", 1, 9)


@query("jn11_nearby_frame_lookup", "game cam frame track_id gid", "trk",
       """with l as (select game, cam, track_id, frame from trk where class_id = 0), r as (select game, cam, track_id, frame, pk % 7 as gid from trk where class_id = 1)
          select l.game, l.cam, l.frame, l.track_id, r.gid from l left join r on l.game = r.game and l.cam = r.cam and l.track_id = r.track_id and abs(r.frame - l.frame) <= 5
          qualify row_number() over (partition by l.game, l.cam, l.frame, l.track_id order by abs(r.frame - l.frame), r.frame) = 1""")
def _(spark, sf):
    t = A.tracks(spark, sf)
    left = t.filter("class_id = 0").select("game", "cam", "track_id", "frame")
    right = t.filter("class_id = 1").select("game", "cam", "track_id", "frame", (col("pk") % 7).alias("gid"))
    return J.nearby_frame(left, right, ["game", "cam", "track_id"], "gid", 5)


COURT_TRK = ["game", "cam", "frame", "track_id", "case when pk % 2 = 0 then 'A' else 'B' end as team", "cast(pk * 7 % 900 as double) as cx", "cast(sk * 131 % 600 as double) as cy"]
ISO_SQL = f"""with t as (select {', '.join(COURT_TRK)} from trk), d as (select a.game, a.frame, a.cam as cam1, b.cam as cam2, a.track_id as t1, a.team as team1, b.track_id as t2, b.team as team2,
     sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) as dist
     from t a join t b on a.game = b.game and a.frame = b.frame and a.cam < b.cam),
   r as (select *, row_number() over w as rn, lead(dist) over w as second from d window w as (partition by game, frame, cam1, cam2, t1 order by dist, t2))
   select * from r where rn = 1 and dist <= 80 and (second is null or second >= 180)"""


def isolated_pairs(spark, sf):
    from courtloom.operators import identity
    return identity.isolated_pairs(A.tracks(spark, sf).selectExpr(*COURT_TRK))


@query("jn12_isolated_pairs", "game frame cam1 cam2 t1 t2 dist:h", "trk", ISO_SQL)
def _(spark, sf):
    return isolated_pairs(spark, sf)


@query("jn14_greedy_match", "game cam frame pred gt", "det",
       f"""with recursive e as (select a.game, a.cam, a.frame, a.det_idx as pred, b.det_idx as gt, row_number() over (partition by a.game, a.cam, a.frame order by a.score desc, a.det_idx, {IOU_SQL} desc, b.det_idx desc) as i
             from det a join det b on a.game = b.game and a.cam = b.cam and a.frame = b.frame and a.class_id = 0 and b.class_id = 1 where {IOU_SQL} >= 2e-1),
          g as (select game, cam, frame, 0::bigint as i, []::bigint[] as ls, []::bigint[] as rs, max(i) as n from e group by all union all
             select g.game, g.cam, g.frame, e.i, case when list_contains(ls, pred) or list_contains(rs, gt) then ls else list_append(ls, pred) end,
               case when list_contains(ls, pred) or list_contains(rs, gt) then rs else list_append(rs, gt) end, n
             from g join e on g.game = e.game and g.cam = e.cam and g.frame = e.frame and e.i = g.i + 1)
          select game, cam, frame, unnest(ls) as pred, unnest(rs) as gt from g where i = n""")
def _(spark, sf):
    d = A.detections(spark, sf)
    p = d.filter("class_id = 0").select("game", "cam", "frame", col("det_idx").alias("pred"), "score", "x1", "y1", "x2", "y2")
    g = J.as_right_box(d.filter("class_id = 1"), "det_idx").withColumnRenamed("det_idx", "gt")
    e = p.join(g, ["game", "cam", "frame"]).withColumn("iou", G.iou(G.Box.of(), G.Box.of("b_"))).filter("iou >= 2e-1")
    return J.greedy_match(e, ["game", "cam", "frame"], "pred", "gt", [-col("score"), col("pred"), -col("iou"), -col("gt")])


@query("jn15_moment_matching", "game chunk n_gt n_cv tp", "plays cv",
       """with recursive g as (select game, cast(floor(t / 86400) as bigint) as chunk, list(distinct cast(floor(t / 600) as bigint)) as gs from plays group by all),
          c as (select game, cast(floor(t / 86400) as bigint) as chunk, list_sort(list(distinct cast(floor(t / 600) as bigint))) as ds from cv group by all),
          st as (select game, chunk, list_sort(gs) as gs, coalesce(ds, []) as ds, coalesce(ds, []) as rest, 0 as i, 0 as tp from g left join c using (game, chunk) union all
             select game, chunk, gs, ds, case when len(list_filter(rest, lambda d: abs(d - gs[i + 1]) <= 2)) > 0 then list_filter(rest, lambda d: d <> list_filter(rest, lambda z: abs(z - gs[i + 1]) <= 2)[1]) else rest end,
               i + 1, tp + case when len(list_filter(rest, lambda d: abs(d - gs[i + 1]) <= 2)) > 0 then 1 else 0 end from st where i < len(gs))
          select game, chunk, len(gs) as n_gt, len(ds) as n_cv, tp from st where i = len(gs)""")
def _(spark, sf):
    from courtloom.operators import scoring
    day, tick = "cast(floor(t / 86400) as bigint) as chunk", "cast(floor(t / 600) as bigint) as frame"
    return scoring.match_moments(A.plays(spark, sf).selectExpr("game", day, tick).distinct(),
                                 A.cv_events(spark, sf).selectExpr("game", day, tick).distinct(), ["game", "chunk"], 2)


@query("jn16_co_occurrence", "game num n_overlaps two_people", "streams",
       """with s as (select game, num, cam, sid, chunk, min(frame) as f0, max(frame) as f1 from (select *, cast(floor(frame / 12) as bigint) as w from streams) group by game, num, cam, sid, chunk, w),
          o as (select a.game, a.num, count(*) as n from s a join s b on a.game = b.game and a.num = b.num and a.chunk = b.chunk and a.cam = b.cam and a.sid < b.sid
             and a.f0 <= b.f1 and b.f0 <= a.f1 group by all)
          select game, num, n as n_overlaps, case when n >= 2 then 1 else 0 end as two_people from o""")
def _(spark, sf):
    from courtloom.operators import identity
    s = A.streams(spark, sf).withColumn("w", F.floor(col("frame") / 12).cast("long"))
    seg = s.groupBy("game", "num", "cam", "sid", "chunk", "w").agg(F.min("frame").alias("f0"), F.max("frame").alias("f1"))
    return identity.co_occurrence(seg, ["game", "num", "cam"], "sid", "f0", "f1", 64).groupBy("game", "num").agg(
        F.sum("n").alias("n_overlaps")).withColumn("two_people", (col("n_overlaps") >= 2).cast("long"))


@query("jn17_window_coverage", "game play_id", "plays evt",
       """with r as (select game, cam, cast(floor(sec / 3600) as bigint) as h from (select *, eid % 4 as cam from evt) group by all),
          g as (select game, cam, min(h) * 3600 as lo, max(h) * 3600 + 3600 as hi from (select *, h - row_number() over (partition by game, cam order by h) as isl from r) group by game, cam, isl)
          select p.game, p.play_id from plays p join g on p.game = g.game and p.t - 1800 >= g.lo and p.t + 1800 <= g.hi group by all having count(distinct g.cam) = 4""")
def _(spark, sf):
    from courtloom.operators import shots
    hours = A.events(spark, sf).selectExpr("game", "eid % 4 as cam", "cast(floor(sec / 3600) as bigint) as h").distinct()
    ranges = hours.selectExpr("game", "cam", "h * 3600 as lo", "h * 3600 + 3600 as hi")
    windows = A.plays(spark, sf).selectExpr("game", "play_id", "t - 1800 as w0", "t + 1800 as w1")
    return shots.covered_windows(windows, ranges, ["game"], "play_id", 4, bucket=3600)


@query("jn18_camera_pair_distance", "cam1 cam2 n med:h p75:h p90:h", "trk",
       f"""with t as (select {', '.join(COURT_TRK)} from trk),
          d as (select a.cam as cam1, b.cam as cam2, cast(floor(sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy))) as bigint) as dist
            from t a join t b on a.game = b.game and a.frame = b.frame and a.track_id = b.track_id and a.cam < b.cam)
          select cam1, cam2, count(*) as n, quantile_cont(dist, 5e-1) as med, quantile_cont(dist, 75e-2) as p75, quantile_cont(dist, 9e-1) as p90 from d group by all""")
def _(spark, sf):
    from courtloom.operators import scoring
    return scoring.camera_pair_distance(A.tracks(spark, sf).selectExpr(*COURT_TRK), ["game", "frame", "track_id"])


@query("jn19_dense_frame_spine", "game play_id cam frame ball_id rim_n", "plays evt",
       """with s as (select game, play_id, t, unnest(range(cast(floor(t / 1800) as bigint) - 4, cast(floor(t / 1800) as bigint) + 5)) as frame from plays),
          c as (select s.*, cam.cam from s cross join (select range as cam from range(4)) cam),
          b as (select game, eid % 4 as cam, cast(floor(sec / 1800) as bigint) as frame, max(eid) as ball_id from evt where etype = 'view' group by all),
          r as (select game, eid % 4 as cam, cast(floor(sec / 1800) as bigint) as frame, count(*) as rim_n from evt where etype = 'error' group by all)
          select c.game, c.play_id, c.cam, c.frame, b.ball_id, r.rim_n from c left join b using (game, cam, frame) left join r using (game, cam, frame)""")
def _(spark, sf):
    from courtloom.operators import shots
    e = A.events(spark, sf).selectExpr("game", "eid % 4 as cam", "cast(floor(sec / 1800) as bigint) as frame", "eid", "etype")
    ball = e.filter("etype = 'view'").groupBy("game", "cam", "frame").agg(F.max("eid").alias("ball_id"))
    rim = e.filter("etype = 'error'").groupBy("game", "cam", "frame").agg(F.count(F.lit(1)).alias("rim_n"))
    w = A.plays(spark, sf).selectExpr("game", "play_id", "cast(floor(t / 1800) as bigint) - 4 as f0", "cast(floor(t / 1800) as bigint) + 4 as f1")
    return shots.frame_spine(w, [0, 1, 2, 3]).join(ball, ["game", "cam", "frame"], "left").join(rim, ["game", "cam", "frame"], "left")


SWEEP_SQL = """with r as (select game, cam, cast(regexp_extract(sid, '[0-9]+') as bigint) as num, kit, frame, cast(pk * 7 % 2144 as double) as cx, cast(sk * 131 % 1427 as double) as cy from streams),
  ref as (select * from r where cam = 0), oth as (select * from r where cam > 0),
  p as (select a.game, b.cam, a.num, a.kit, a.frame as f, b.frame - a.frame as s, sqrt(pow(b.cx - a.cx, 2) + pow(b.cy - a.cy, 2)) as dist
    from ref a join oth b on a.game = b.game and a.num = b.num and a.kit = b.kit and abs(b.frame - a.frame) <= 11),
  h as (select *, d.d as d from p cross join (select range - 10 as d from range(21)) d where abs(s - d.d) <= 1 qualify row_number() over (partition by game, cam, num, kit, f, d.d order by s) = 1)
  select game, cam, d, count(*) as n, quantile_cont(floor(dist * 10 + 5e-1) / 10, 5e-1) as median_cm, avg(case when floor(dist * 10 + 5e-1) / 10 <= 120 then 1e0 else 0e0 end) as close_share from h group by all having count(*) >= 20"""


def numbered_streams(spark, sf):
    """Streams on the court by the number in their id, which is unique for a camera, frame and kit."""
    return A.stream_points(spark, sf).withColumn("num", F.regexp_extract("sid", "[0-9]+", 0).cast("long"))


@query("jn20_read_lag_sweep", "game cam d n median_cm:h close_share:k", "streams", SWEEP_SQL)
def _(spark, sf):
    return sync.read_lag_sweep(numbered_streams(spark, sf), 0, sweep=10, tol=1, min_pairs=20)


@query("jn21_priority_dedup", "game cam frame source n", "det",
       """with s as (select game, cam, frame, det_idx % 3 as source, count(*) as n, sum(case when class_id < 2 then 1 else 0 end) as labels from det group by all)
          select game, cam, frame, source, n from s where labels > 0 qualify row_number() over (partition by game, cam, frame order by (source * 2) % 3, source) = 1""")
def _(spark, sf):
    from courtloom.operators import datasets
    s = A.detections(spark, sf).withColumn("source", col("det_idx") % 3).groupBy("game", "cam", "frame", "source").agg(
        F.count(F.lit(1)).alias("n"), F.sum((col("class_id") < 2).cast("long")).alias("labels"))
    s = s.withColumn("priority", (col("source") * 2) % 3)
    return datasets.claim_by_priority(s, ["game", "cam", "frame"], "priority", "source", "labels", ["n"])


@query("jn22_miss_mining", "game cam frame misses", "det",
       f"""with m as (select a.game, a.cam, a.frame, a.det_idx, max({IOU_SQL}) as best from det a left join det b on a.game = b.game and a.cam = b.cam and a.frame = b.frame and b.class_id = 1
             where a.class_id = 0 and a.score >= 6e-1 group by all)
           select game, cam, frame, count(*) as misses from m where coalesce(best, 0) < 3e-1 group by all""")
def _(spark, sf):
    from courtloom.operators import datasets
    d = A.detections(spark, sf)
    return datasets.mine_misses(d.filter("class_id = 0"), d.filter("class_id = 1"), 0.6, 0.3)


@query("jn23_duplicate_box_removal", "game cam frame det_idx", "det",
       f"""select a.* from det a where a.class_id = 0 and not exists (select 1 from det b where b.game = a.game and b.cam = a.cam and b.frame = a.frame and b.class_id = 2
             and {IOU_SQL} > 2e-2 and (a.x2 - a.x1) * (a.y2 - a.y1) < 20 * (b.x2 - b.x1) * (b.y2 - b.y1))""")
def _(spark, sf):
    from courtloom.operators import datasets
    d = A.detections(spark, sf)
    return datasets.drop_ball_shaped(d.filter("class_id = 0"), d.filter("class_id = 2"), 0.02, 20.0)


@query("jn24_game_key_resolution", "stem_key:s game:s", "",
       """with g as (select distinct left(md5(c_mktsegment || c_nationkey), 8) as gid from customer),
          k as (select distinct case when c_custkey % 4 = 0 then 'alias' when c_custkey % 4 = 1 then left(md5(c_mktsegment || c_nationkey), 8) when c_custkey % 4 = 2 then left(md5(c_mktsegment || c_nationkey), 3)
             else left(md5(c_mktsegment || c_nationkey), 2) end as stem_key from customer),
          t as (select stem_key, case when stem_key = 'alias' then (select min(gid) from g) else stem_key end as key from k)
          select stem_key, case when exists (select 1 from g where gid = key) then key when len(key) >= 3 and (select count(*) from g where starts_with(gid, key)) = 1 then (select min(gid) from g where starts_with(gid, key)) end as game from t""")
def _(spark, sf):
    from courtloom.operators import datasets
    gid = "substring(md5(concat(c_mktsegment, c_nationkey)), 1, {})"
    cust = spark.read.parquet(f"{sf}/customer.parquet")
    games = cust.select(F.expr(gid.format(8)).alias("gid")).distinct()
    keys = cust.select(F.expr(f"case c_custkey % 4 when 0 then 'alias' when 1 then {gid.format(8)} when 2 then {gid.format(3)} else {gid.format(2)} end").alias("stem_key")).distinct()
    alias = games.agg(F.min("gid").alias("gid")).select(F.lit("alias").alias("stem_key"), col("gid").alias("alias_of"))
    return datasets.resolve_games(keys, games, alias)


@query("jn25_exactly_one_container", "game cam frame sid:s n_others", "det streams",
       """with b as (select game, cam, frame, min((x1 + x2) / 2) as ball_x, min((y1 + y2) / 2) as ball_y from det where class_id = 2 group by all having count(*) = 1),
          h as (select b.game, b.cam, b.frame, count(*) as n, sum(case when ball_x between x1 and x2 and ball_y between y1 and y2 then 1 else 0 end) as inside,
             max(case when ball_x between x1 and x2 and ball_y between y1 and y2 then sid end) as sid from b join streams s on b.game = s.game and b.cam = s.cam and b.frame = s.frame group by all)
          select game, cam, frame, sid, least(n - 1, 3) as n_others from h where inside = 1""")
def _(spark, sf):
    from courtloom.operators import datasets
    balls = A.detections(spark, sf).filter("class_id = 2").withColumn("ball_x", G.Box.of().cx).withColumn("ball_y", G.Box.of().cy)
    picks = datasets.single_container(balls, A.streams(spark, sf), "sid", 3)
    return picks.withColumn("n_others", F.size("negatives"))


@query("jn26_nearest_track_presence", "game frame gid nearest dist:h", "world",
       """with t as (select * from world where gid < 5), g as (select * from world where gid >= 5)
          select g.game, g.frame, g.gid, t.gid as nearest, sqrt((g.cx - t.cx) * (g.cx - t.cx) + (g.cy - t.cy) * (g.cy - t.cy)) as dist
          from g join t on g.game = t.game and g.frame = t.frame where dist < 150 qualify row_number() over (partition by g.game, g.frame, g.gid order by dist, t.gid) = 1""")
def _(spark, sf):
    w = A.world(spark, sf)
    right = w.filter("gid < 5").selectExpr("game", "frame", "gid as nearest", "cx as rx", "cy as ry")
    return J.nearest_point(w.filter("gid >= 5"), right, ["game", "frame"], "gid", "nearest", 150.0)


@query("jn27_seed_selection", "game num cam seed_frame seed_det", "det",
       f"""with r as ({READS_SQL}), ok as (select game, num from r group by all having count(*) >= 25)
          select r.game, r.num, r.cam, min(frame) as seed_frame, arg_min(lid, frame * 100 + lid) as seed_det from r join ok using (game, num) where score >= 75e-2 group by all""")
def _(spark, sf):
    from courtloom.operators import identity
    return identity.seed_reads(reads(spark, sf), ["game", "num"], "cam", 25, 0.75, "lid").withColumnRenamed("lid", "seed_det")


CLAIMS_SQL = f"""with recursive r as ({READS_SQL}), e as (select b.game, b.cam, b.frame, b.det_idx, b.x1, b.y1, b.x2, b.y2, r.num, abs(r.frame - b.frame) as gap, r.lid, r.frame as rf, {IOU_SQL.replace('a.', 'r.')} as iou
     from det b join r on r.game = b.game and r.cam = b.cam and abs(r.frame - b.frame) <= 2 where b.class_id = 1 and b.frame % 5 = 0),
  best as (select * from e where iou >= 4e-1 qualify row_number() over (partition by game, cam, frame, rf, lid order by iou desc, det_idx) = 1),
  o as (select *, row_number() over (partition by game, cam, frame order by gap, rf, lid) as i from best),
  st as (select game, cam, frame, 0::bigint as i, []::struct(num bigint, rf bigint, lid bigint, det_idx bigint, x1 double, y1 double, x2 double, y2 double)[] as taken, max(i) as n from o group by all union all
    select game, cam, frame, i, case when clear and (len(same) = 0 or (len(same) = 1 and abs(same[1].rf - rf) <= 2))
      then list_append(taken, {{'num': num, 'rf': rf, 'lid': lid, 'det_idx': det_idx, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}) else taken end, n
    from (select b.*, st.taken, st.n, list_filter(st.taken, lambda t: t.num = b.num) as same, len(list_filter(st.taken, lambda t: {IOU_SQL.replace('a.', 't.')} > 5e-1)) = 0 as clear
      from st join o b on st.game = b.game and st.cam = b.cam and st.frame = b.frame and b.i = st.i + 1))"""


@query("jn28_best_common_seed", "game cam frame n_players", "det",
       CLAIMS_SQL + " select game, cam, frame, len(taken) as n_players from st where i = n qualify row_number() over (partition by game, cam order by len(taken) desc, frame) = 1")
def _(spark, sf):
    from courtloom.operators import identity
    d = A.detections(spark, sf)
    return identity.best_common_seed(reads(spark, sf), d.filter("class_id = 1"), "lid", near=2, every=5, iou_attach=0.4, together=2)


@query("jn28b_seed_claims", "game cam frame num wearer lid det_idx", "det",
       CLAIMS_SQL + """, u as (select game, cam, frame, unnest(list_transform(taken, lambda t, k: {'t': t, 'k': k})) as c from st where i = n)
          select game, cam, frame, c.t.num as num, row_number() over (partition by game, cam, frame, c.t.num order by c.t.rf, c.k) - 1 as wearer, c.t.lid as lid, c.t.det_idx as det_idx from u""")
def _(spark, sf):
    from courtloom.operators import identity
    d = A.detections(spark, sf)
    return identity.seed_claims(reads(spark, sf), d.filter("class_id = 1"), "lid", near=2, every=5, iou_attach=0.4, together=2)


@query("jn29_instance_to_name", "game cam num det_idx iou:k", "det",
       f"""select a.game, a.cam, a.num, b.det_idx % 8 as det_idx, max({IOU_SQL}) as iou from det a join det b on a.game = b.game and a.cam = b.cam and a.frame = b.frame and a.class_id = 0 and b.class_id = 1
           where {IOU_SQL} >= 5e-1 group by a.game, a.cam, a.num, b.det_idx % 8 qualify row_number() over (partition by a.game, a.cam, a.num order by max({IOU_SQL}) desc, b.det_idx % 8) = 1""")
def _(spark, sf):
    from courtloom.operators import identity
    d = A.detections(spark, sf)
    inst = J.as_right_box(d.filter("class_id = 1").withColumn("inst", col("det_idx") % 8), "inst")
    return identity.name_instances(d.filter("class_id = 0"), inst, ["game", "cam", "num"], "inst", 0.5).withColumnRenamed("inst", "det_idx")


@query("jn30_isolation_distance", "game frame gid iso:h", "world cball",
       """with s as (select w.game, w.frame, w.gid, w.cx, w.cy from world w join cball b on w.game = b.game and w.frame = b.frame
             qualify row_number() over (partition by w.game, w.frame order by sqrt((w.cx - ball_x) * (w.cx - ball_x) + (w.cy - ball_y) * (w.cy - ball_y)), w.gid) = 1)
          select s.game, s.frame, s.gid, min(sqrt((s.cx - o.cx) * (s.cx - o.cx) + (s.cy - o.cy) * (s.cy - o.cy))) as iso
          from s join world o on s.game = o.game and s.frame = o.frame and s.gid <> o.gid group by all""")
def _(spark, sf):
    from courtloom.operators import shots
    w = A.world(spark, sf)
    b = A.court_ball(spark, sf).selectExpr("game", "frame", "0 as b", "ball_x as cx", "ball_y as cy")
    near = J.nearest_point(b, w.selectExpr("game", "frame", "gid", "cx as rx", "cy as ry"), ["game", "frame"], "b", "gid", 1e9)
    return shots.isolation(near.select("game", "frame", "gid"), w, ["game", "frame"], "gid")
