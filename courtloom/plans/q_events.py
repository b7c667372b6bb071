"""Possession, shots and events over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtloom.functions import geometry as G
from courtloom.operators import joins as J
from courtloom.operators import ordered as O
from courtloom.operators import possession as P
from courtloom.operators import sequence as S
from courtloom.operators import shots as H
from courtloom.plans import adapters as A
from courtloom.plans.q_columns import DIST_SQL, PAIR_SQL, ball_boxes
from courtloom.plans.q_windows import segments
from courtloom.plans.registry import query

col = F.col
B = A.BLOCK

TRAJ = ["game", "cam", "chunk", "frame", "ball_x", "ball_y", "cast(det_idx - 12 as double) as vx", "cast(det_idx * 7 % 25 - 10 as double) as vy",
        "case when det_idx % 3 = 0 then 1 else 0 end as imputed", "score as conf"]


def trajectory(spark, sf):
    return A.ball(spark, sf).selectExpr(*TRAJ)


A.CTES["traj"] = (("ball", "offs"), f"select t.*, frame - off as ref, sqrt(vx * vx + vy * vy) as speed from (select {', '.join(TRAJ)} from ball) t join offs o on t.game = o.game and t.cam = o.cam")
STORY = """with pr as (select t.*, s.sid, abs(ball_x - (x1 + x2) / 2) / greatest(x2 - x1, 1e0) as dx, x1, y1, x2, y2 from traj t join streams s on t.game = s.game and t.cam = s.cam and t.frame = s.frame),
  vo as (select game, chunk, ref, sid, floor(sum((case when imputed = 1 then 5e-1 else 1e0 end) * (1e0 - 5e-1 * dx)) * 1e6 + 5e-1) as w from pr
     where ball_y <= y2 and dx <= 7e-1 and ball_y >= y1 - 1e-1 * (y2 - y1) group by all),
  fr as (select game, chunk, ref, median(speed) as speed, arg_max(struct_pack(cam := cam, x := ball_x, y := ball_y, vx := vx, vy := vy), conf * 1e3 - cam) filter (where speed > 14) as vec from traj group by all),
  tp as (select game, chunk, ref, sid from vo qualify row_number() over (partition by game, chunk, ref order by w desc, sid) = 1),
  ro as (select fr.*, tp.sid, case when tp.sid is not null then 'HOLD' when speed > 14 then 'FLIGHT' else 'GAP' end as state from fr left join tp using (game, chunk, ref)),
  lf as (select *, last_value(case when state = 'FLIGHT' then ref end ignore nulls) over w as lf, last_value(case when state = 'FLIGHT' and vec is not null then struct_pack(ref := ref, vec := vec) end ignore nulls) over w as lv
     from ro window w as (partition by game, chunk order by ref rows between unbounded preceding and current row)),
  ho as (select *, coalesce(ref - lf <= 4, false) as fresh from lf where state = 'HOLD'),
  la as (select h.game, h.chunk, h.ref, s.sid from ho h join offs o on h.game = o.game and o.cam = h.lv.vec.cam join streams s on s.game = h.game and s.cam = o.cam and s.frame = h.ref + o.off
     join vo on vo.game = h.game and vo.chunk = h.chunk and vo.ref = h.ref and vo.sid = s.sid
     where h.fresh and h.lv.vec.x + h.lv.vec.vx * (h.ref - h.lv.ref) between s.x1 - 10 and s.x2 + 10 and h.lv.vec.y + h.lv.vec.vy * (h.ref - h.lv.ref) between s.y1 and s.y2 + 20
     qualify row_number() over (partition by h.game, h.chunk, h.ref order by vo.w desc, s.sid) = 1),
  ca as (select h.game, h.chunk, h.ref, coalesce(la.sid, h.sid) as top, case when fresh then 3 else {k} end as need from ho h left join la using (game, chunk, ref)),
  r0 as (select *, case when top = lag(top) over (partition by game, chunk order by ref) then 0 else 1 end as ch from ca),
  r1 as (select *, sum(ch) over (partition by game, chunk order by ref) as run from r0),
  r2 as (select *, row_number() over (partition by game, chunk, run order by ref) as p from r1),
  he as (select game, chunk, ref, top as holder from r2 where p >= need),
  tk as (select game, chunk, ref, holder, last_ref from (select *, lag(holder) over (partition by game, chunk order by ref) as prev from he) join (select game, chunk, max(ref) as last_ref from fr group by all) using (game, chunk) where prev is null or prev <> holder)"""
def story(spark, sf):
    # random rows rarely repeat six times, so the driver-table query asks for fewer repeats
    return P.ball_story(trajectory(spark, sf), A.streams(spark, sf), A.offsets(spark), switch_k=3, catch_k=2)


SQL_STORY = STORY.replace("then 3 else {k} end", "then 2 else 3 end")


@query("win03_ball_story_takeovers", "game chunk ref holder:s last_ref", "traj streams", SQL_STORY + " select * from tk")
def _(spark, sf):
    return story(spark, sf)


SEG_OF_STORY = """, sg as (select game, ref as start_frame, coalesce(lead(ref) over (partition by game, chunk order by ref) - 1, last_ref) as end_frame, holder as value from tk),
  mg as (select *, sum(st) over (partition by game order by start_frame) as run from (select *, case when lag(value) over w = value and start_frame - lag(end_frame) over w <= 3 then 0 else 1 end as st from sg window w as (partition by game order by start_frame)))
  select game, min(start_frame) as start_frame, max(end_frame) as end_frame, value, count(*) as parts from mg group by game, run, value"""


@query("evt00_ball_story_segments", "game start_frame end_frame value:s parts", "traj streams", SQL_STORY + SEG_OF_STORY)
def _(spark, sf):
    return P.story_segments(story(spark, sf), 3, B)


def holder_stream(spark, sf):
    w = A.world(spark, sf)
    return O.best_per(w, ["game", "chunk", "frame"], [-F.abs(col("cx") - 700), -col("gid")], ["gid"]).withColumn(
        "gid", F.when(col("frame") % 6 > 0, col("gid") % 2))


A.CTES["hstream"] = (("world",), "select game, chunk, frame, case when frame % 6 > 0 then gid % 2 end as gid from world qualify row_number() over (partition by game, chunk, frame order by abs(cx - 700), gid) = 1")
RUN_TAIL = """, e as (select game, chunk, frame, i, h, case when h is not distinct from lag(h) over (partition by game, chunk order by i) then 0 else 1 end as ch from st where i > 0),
  g as (select *, sum(ch) over (partition by game, chunk order by i) as run from e)
  select game, chunk, min(frame) as start_frame, max(frame) as end_frame, h as gid from g where h is not null group by game, chunk, run, h having max(frame) - min(frame) + 1 >= {m}"""
HRUN_SQL = """with recursive s as (select *, row_number() over (partition by game, chunk order by frame) as i from hstream),
  m as (select game, chunk, 0::bigint as i, 0::bigint as frame, null::bigint as holder, null::bigint as rival, 0::bigint as streak, null::bigint as shown, null::bigint as h from s where i = 1 union all
    select game, chunk, i, frame, nh, case when gid is null or gid = holder or nh is distinct from holder then null else gid end, case when gid is null or gid = holder or nh is distinct from holder then 0 else ns end,
      case when gid = nh then frame else shown end, case when gid = nh then nh end
    from (select q.*, case when gid is null then case when holder is not null and shown is not null and frame - shown > 30 then null else holder end when gid = holder then holder
       when ns >= case when holder is null then 2 else 2 end then gid else holder end as nh from
       (select s.game, s.chunk, s.i, s.frame, s.gid, m.holder, m.rival, m.shown, case when s.gid = m.rival then m.streak + 1 else 1 end as ns from m join s on s.game = m.game and s.chunk = m.chunk and s.i = m.i + 1) q)),
  st as (select * from m)"""


@query("win04_holder_runs", "game chunk start_frame end_frame gid", "hstream", HRUN_SQL + RUN_TAIL.format(m=3))
def _(spark, sf):
    return P.holder_runs(holder_stream(spark, sf), ["game", "chunk"], 2, 2, 30, 3)


def ball_distances(spark, sf):
    w = A.world(spark, sf).select("game", "chunk", "frame", "gid", "cx", "cy")
    b = A.court_ball(spark, sf).select("game", "frame", "ball_x", "ball_y")
    return w.join(b, ["game", "frame"], "left").withColumn("dist", G.distance(col("cx"), col("cy"), col("ball_x"), col("ball_y")))


STICKY_SQL = """with recursive d as (select w.game, w.chunk, w.frame, w.gid % 3 as gid, min(sqrt((cx - ball_x) * (cx - ball_x) + (cy - ball_y) * (cy - ball_y))) as dist from world w left join cball b on w.game = b.game and w.frame = b.frame group by all),
  f as (select game, chunk, frame, arg_min(gid, dist * 1e3 + gid) as near, min(dist) as dmin, map_from_entries(list((gid, dist))) as ds from d group by all),
  s as (select *, row_number() over (partition by game, chunk order by frame) as i from f),
  m as (select game, chunk, 0::bigint as i, 0::bigint as frame, null::bigint as holder, null::bigint as rival, 0::bigint as streak, null::bigint as h from s where i = 1 union all
    select game, chunk, i, frame, nh, case when loose or keep or took then null else near end, case when loose or keep or took then 0 else ns end, nh
    from (select *, case when loose then null when keep then holder when took then near else holder end as nh from
      (select *, not loose and not keep and ns >= case when holder is null then 1 else 2 end as took from
        (select s.game, s.chunk, s.i, s.frame, s.near, m.holder, coalesce(s.dmin > 600, true) as loose, coalesce(m.holder is not null and s.ds[m.holder] <= 600 and s.ds[m.holder] <= s.dmin + 70, false) as keep,
           case when s.near = m.rival then m.streak + 1 else 1 end as ns from m join s on s.game = m.game and s.chunk = m.chunk and s.i = m.i + 1)))),
  st as (select * from m)"""


@query("win05_sticky_possession", "game chunk start_frame end_frame gid", "world cball", STICKY_SQL + RUN_TAIL.format(m=3))
def _(spark, sf):
    d = ball_distances(spark, sf).withColumn("gid", col("gid") % 3).groupBy("game", "chunk", "frame", "gid").agg(F.min("dist").alias("dist"))
    return P.sticky_runs(d, ["game", "chunk"], 600.0, 70.0, 2, 1, 3)


GATE_SQL = """with recursive s as (select game, cam, chunk, frame, ball_x as x, ball_y as y, row_number() over (partition by game, cam, chunk order by frame) as i from ball),
  m as (select game, cam, chunk, 0::bigint as i, null::struct(f bigint, x double, y double) as last, []::struct(f bigint, x double, y double)[] as wait, []::bigint[] as kept from s where i = 1 union all
    select game, cam, chunk, i, case when ok or len(w2) >= 3 then now else last end, case when ok or len(w2) >= 3 then [] else w2 end,
      case when ok then list_append(kept, now.f) when len(w2) >= 3 then list_concat(kept, list_transform(w2, lambda q: q.f)) else kept end
    from (select s.game, s.cam, s.chunk, s.i, {'f': s.frame, 'x': s.x, 'y': s.y} as now, m.last, m.kept,
       coalesce(sqrt((s.x - m.last.x) * (s.x - m.last.x) + (s.y - m.last.y) * (s.y - m.last.y)) <= 60 * greatest(1, s.frame - m.last.f), false) as ok,
       list_append(list_filter(m.wait, lambda q: s.frame - q.f <= 4 and sqrt((s.x - q.x) * (s.x - q.x) + (s.y - q.y) * (s.y - q.y)) <= 60 * greatest(1, s.frame - q.f)), {'f': s.frame, 'x': s.x, 'y': s.y}) as w2
       from m join s on s.game = m.game and s.cam = m.cam and s.chunk = m.chunk and s.i = m.i + 1))
  select game, cam, chunk, unnest(arg_max(kept, i)) as frame from m group by game, cam, chunk"""


@query("win26_temporal_gate", "game cam chunk frame", "ball", GATE_SQL)
def _(spark, sf):
    return P.temporal_gate(A.ball(spark, sf), ["game", "cam", "chunk"], 60.0, 3)


RIM_SQL = """with rim as (select game, cam, chunk, median(x1) as rx1, median(y1) as ry1, median(x2) as rx2, median(y2) as ry2 from det where class_id = 1 group by all),
  b as (select b.*, (rx1 + rx2) / 2 as rx, (ry1 + ry2) / 2 as ry, greatest(rx2 - rx1, 20e0) as rw from ball b join rim using (game, cam, chunk)),
  i as (select *, abs(ball_x - rx) < 9e-1 * rw and abs(ball_y - ry) < 9e-1 * rw as ins from b),
  w as (select *, lag(frame) over o as pf, lag(ball_y) over o as py, min(struct_pack(y := ball_y, f := frame)) over (partition by game, cam, chunk order by frame range between 45 preceding and 1 preceding) as apex,
     max(ins) over (partition by game, cam, chunk order by frame range between 15 preceding and 1 preceding) as was from i window o as (partition by game, cam, chunk order by frame)),
  t as (select *, case when sqrt((ball_x - rx) * (ball_x - rx) + (ball_y - ry) * (ball_y - ry)) <= 100 and coalesce(pf >= frame - 6 and py < ball_y and ry - apex.y >= 60, false) then apex.f
     when ins and not coalesce(was, false) then coalesce(apex.f, frame) end as apex_f from w),
  tr as (select game, cam, chunk, frame, apex_f from t where apex_f is not null)"""


def rim(spark, sf):
    return H.rim_median(A.detections(spark, sf).filter("class_id = 1"), ["game", "cam", "chunk"])


def arrivals(spark, sf):
    return H.rim_arrivals(A.ball(spark, sf), rim(spark, sf))


@query("win13_rim_arrivals", "game cam chunk frame apex_f", "ball det", RIM_SQL + " select * from tr")
def _(spark, sf):
    return arrivals(spark, sf)


SHOT_SQL = RIM_SQL + """, dl as (select game, cam, chunk, unnest(list_reduce(list([frame, apex_f] order by frame).list_transform(lambda z: [z]), lambda a, e: case when e[1][1] - a[-1][1] > 30 then list_concat(a, e) else a end)) as k from tr group by game, cam, chunk),
  sh as (select game, cam, chunk, k[1] as frame, k[2] as apex_f from dl),
  wl as (select s.game, s.cam, s.chunk, s.frame, s.apex_f, list(struct_pack(f := p.frame, y := p.ball_y, go := true) order by p.frame desc) as w from sh s join ball p on p.game = s.game and p.cam = s.cam and p.chunk = s.chunk and p.frame between s.apex_f - 26 and s.apex_f group by all),
  rl as (select game, cam, chunk, frame, apex_f, list_reduce(w, lambda a, e: case when a.go and a.f - e.f <= 8 and e.y >= a.y - 3 then e else struct_pack(f := a.f, y := a.y, go := false) end).f as rel_f from wl)"""


def shot_list(spark, sf):
    kept = S.debounce(arrivals(spark, sf), ["game", "cam", "chunk"], "frame", 30, ["apex_f"])
    return H.release_frames(kept, A.ball(spark, sf))


@query("evt05_shot_detection", "game cam chunk frame apex_f rel_f", "ball det", SHOT_SQL + " select * from rl")
def _(spark, sf):
    return shot_list(spark, sf)


@query("win15_release_walk_back", "game cam chunk frame rel_f", "ball det", SHOT_SQL.replace("[1][1] - a[-1][1] > 30", "[1][1] - a[-1][1] > 5") + " select * from rl")
def _(spark, sf):
    kept = S.debounce(arrivals(spark, sf), ["game", "cam", "chunk"], "frame", 5, ["apex_f"])
    return H.release_frames(kept, A.ball(spark, sf))


FLIGHT_SQL = """, fl as (select * from (select *, sqrt((ball_x - lag(ball_x) over o) * (ball_x - lag(ball_x) over o) + (ball_y - lag(ball_y) over o) * (ball_y - lag(ball_y) over o)) / (frame - lag(frame) over o) as v, frame - lag(frame) over o as gap
   from ball window o as (partition by game, cam, chunk order by frame)) where gap <= 6 and v >= 120)"""


@query("win29_catch_frame", "game cam chunk frame rel_f catch_f", "ball det", SHOT_SQL + FLIGHT_SQL + """
  select rl.game, rl.cam, rl.chunk, rl.frame, rl.rel_f, max(fl.frame) as catch_f from rl left join fl on fl.game = rl.game and fl.cam = rl.cam and fl.chunk = rl.chunk and fl.frame between rl.rel_f - 23 and rl.rel_f group by all""")
def _(spark, sf):
    return H.catch_frames(shot_list(spark, sf), A.ball(spark, sf), 120.0)


def anchors(spark, sf):
    """Shots on the reference timeline, visiting every camera at its own frame."""
    s = shot_list(spark, sf).join(F.broadcast(A.offsets(spark)), ["game", "cam"]).select(
        "game", col("cam").alias("arc"), (col("frame") * 4 + col("cam")).alias("shot_id"), (col("rel_f") - col("off")).alias("ref"))
    every = s.join(F.broadcast(A.offsets(spark)), "game")
    return every.select("game", "arc", "shot_id", "cam", (col("ref") + col("off")).alias("at"), "ref")


ANCHOR_SQL = """, an as (select r.game, r.cam as arc, r.frame * 4 + r.cam as shot_id, o2.cam, r.rel_f - o1.off + o2.off as at from rl r join offs o1 on o1.game = r.game and o1.cam = r.cam join offs o2 on o2.game = r.game),
  ub as (select game, cam, frame, sid, exp(-(sqrt((ball_x - (x1 + x2) / 2) * (ball_x - (x1 + x2) / 2) + (ball_y - y1) * (ball_y - y1)) / w)) as weight from (""" + PAIR_SQL + """) where ball_x between x1 - 6e-1 * w and x2 + 6e-1 * w and ball_y <= y2),
  sc as (select an.game, an.arc, an.shot_id, an.cam, ub.sid, sum(ub.weight) as score from an join ub on ub.game = an.game and ub.cam = an.cam and ub.frame between an.at - 23 and an.at + 6 group by all)"""


def scores(spark, sf):
    a = anchors(spark, sf)
    return H.shooter_scores(a, ball_boxes(spark, sf)).join(a.select("shot_id", "game", "arc").distinct(), ["shot_id", "game"])


@query("evt06_release_quality", "game shot_id rq:k", "ball det streams offs", SHOT_SQL + ANCHOR_SQL + """
  , q as (select game, cam, frame, min(abs(ball_x - (x1 + x2) / 2) / w) as off_ from (""" + PAIR_SQL + """) where ball_y <= y2 and ball_y <= y1 + 6e-1 * (y2 - y1) group by all)
  select an.game, an.shot_id, min(off_) as rq from an join q on q.game = an.game and q.cam = an.cam and q.frame between an.at - 6 and an.at + 6 where an.cam = an.arc group by all""")
def _(spark, sf):
    return H.release_quality(anchors(spark, sf).filter("cam = arc"), ball_boxes(spark, sf))


@query("evt07_shooter_attribution", "game shot_id sid:s cam score:k", "ball det streams offs", SHOT_SQL + ANCHOR_SQL + """
  select * from sc qualify row_number() over (partition by game, shot_id order by case when cam = arc then -1 else cam end, floor(score * 1e6 + 5e-1) desc, sid) = 1""")
def _(spark, sf):
    return H.pick_shooter(scores(spark, sf), F.when(col("cam") == col("arc"), -1).otherwise(col("cam")))


FEET = ["game", "cam", "frame", "sid", "cast(pk * 7 % 2144 as double) as cx", "cast(sk * 131 % 1427 as double) as cy"]


@query("evt08_shooter_position_zone", "game shot_id sid:s release_dist:h zone:s", "ball det streams offs", SHOT_SQL + ANCHOR_SQL + f"""
  , pk_ as (select game, shot_id, sid from sc qualify row_number() over (partition by game, shot_id order by case when cam = arc then -1 else cam end, floor(score * 1e6 + 5e-1) desc, sid) = 1),
  ft as (select {', '.join(FEET)} from streams),
  ps as (select p.game, p.shot_id, p.sid, bk.b, an.cam, ft.cx, ft.cy from pk_ p join an using (game, shot_id) cross join (select unnest([0, 6, 12]) as b) bk
     join ft on ft.game = p.game and ft.cam = an.cam and ft.sid = p.sid and ft.frame between an.at - bk.b - 2 and an.at - bk.b + 2
     qualify row_number() over (partition by p.game, p.shot_id, bk.b, an.cam order by abs(ft.frame - an.at + bk.b), ft.frame) = 1),
  md as (select game, shot_id, sid, b, median(cx) as cx, median(cy) as cy from ps group by all),
  dd as (select game, shot_id, sid, max({DIST_SQL}) as release_dist from md group by all)
  select *, case when release_dist < 710 then '2PT' when release_dist < 840 then '3PT' else '4PT' end as zone from dd""")
def _(spark, sf):
    pick = H.pick_shooter(scores(spark, sf), F.when(col("cam") == col("arc"), -1).otherwise(col("cam"))).select("shot_id", "game", "sid")
    a = anchors(spark, sf).join(pick, ["shot_id", "game"])
    feet = A.streams(spark, sf).selectExpr(*FEET)
    return H.shooter_position(a.select("shot_id", "game", "cam", "at", "sid"), feet)


@query("evt09_cross_camera_vote", "game shot_id sid:s vote:k", "ball det streams offs", SHOT_SQL + ANCHOR_SQL + """
  , rk as (select *, row_number() over (partition by game, shot_id, cam order by score desc, sid) as rn, coalesce(lead(score) over (partition by game, shot_id, cam order by score desc, sid), 0) as nx from sc),
  vt as (select game, shot_id, sid, floor(sum((score - nx) / score * case when cam = arc then 2 else 1 end) * 1e6 + 5e-1) as v from rk where rn = 1 group by all)
  select game, shot_id, sid, v / 1e6 as vote from vt qualify row_number() over (partition by game, shot_id order by v desc, sid desc) = 1""")
def _(spark, sf):
    return H.margin_vote(scores(spark, sf), col("arc"))


@query("evt10_catch_anchored_vote", "game shot_id sid:s score:k", "ball det streams offs", SHOT_SQL + FLIGHT_SQL + ANCHOR_SQL + """
  , ct as (select rl.game, rl.cam, rl.frame * 4 + rl.cam as shot_id, rl.rel_f, max(fl.frame) as c from rl left join fl on fl.game = rl.game and fl.cam = rl.cam and fl.chunk = rl.chunk and fl.frame between rl.rel_f - 23 and rl.rel_f group by all),
  s2 as (select ct.game, ct.shot_id, ub.sid, sum(weight) as score from ct join ub on ub.game = ct.game and ub.cam = ct.cam and ub.frame between coalesce(c + 1, rel_f - 23) and rel_f + 6 group by all)
  select * from s2 qualify row_number() over (partition by game, shot_id order by floor(score * 1e6 + 5e-1) desc, sid) = 1""")
def _(spark, sf):
    c = H.catch_frames(shot_list(spark, sf), A.ball(spark, sf), 120.0).withColumn("shot_id", col("frame") * 4 + col("cam"))
    a = c.select("shot_id", "game", "cam", col("rel_f").alias("at"), F.coalesce(col("catch_f") + 1, col("rel_f") - 23).alias("from_f"))
    return H.pick_shooter(H.shooter_scores(a, ball_boxes(spark, sf), start="from_f"), F.lit(0))


@query("evt11_wrist_override", "game cam frame sid:s d:k accepted", "ball streams",
       """select game, cam, frame, sid, d, (d < 6e-1)::int as accepted from (select s.game, s.cam, s.frame, s.sid,
            least(case when s.pk % 5 > 0 then sqrt((wx - ball_x) * (wx - ball_x) + (s.y1 + 60 - ball_y) * (s.y1 + 60 - ball_y)) / w else 1e9 end,
                  case when s.sk % 5 > 0 then sqrt((wx + 10 - ball_x) * (wx + 10 - ball_x) + (s.y1 + 80 - ball_y) * (s.y1 + 80 - ball_y)) / w else 1e9 end) as d
          from (select *, x1 + pk % 17 * (x2 - x1) / 16e0 as wx, greatest(x2 - x1, 1e0) as w from streams) s join ball b on s.game = b.game and s.cam = b.cam and s.frame = b.frame
          where ball_x between s.x1 - w and s.x2 + w and ball_y <= s.y2 and s.y2 - s.y1 >= 100) where d < 1e9 qualify row_number() over (partition by game, cam, frame order by d, sid) = 1""")
def _(spark, sf):
    s = A.streams(spark, sf).withColumn("wx", F.expr("x1 + pk % 17 * (x2 - x1) / 16e0"))
    wrists = F.array(F.struct(col("wx").alias("x"), (col("y1") + 60).alias("y"), F.when(col("pk") % 5 > 0, 1.0).otherwise(0.0).alias("s")),
                     F.struct((col("wx") + 10).alias("x"), (col("y1") + 80).alias("y"), F.when(col("sk") % 5 > 0, 1.0).otherwise(0.0).alias("s")))
    return H.wrist_pick(A.ball(spark, sf).select("game", "cam", "frame", "ball_x", "ball_y"), s.withColumn("wrists", wrists), ["game", "cam", "frame"])


FUSE_ROWS = ["eid", "game", "sec as t", "case when val % 9 = 0 then k % 2 = 0 end as appearance", "k % 3 = 0 as vote", "case when val % 4 > 0 then val % 2 = 0 end as wrist",
             "case when val % 11 > 0 then val % 900 end as dist"]


@query("evt12_signal_fusion", "d_close fit_ok n n_ok held_n held_ok", "evt",
       f"""with r as (select {', '.join(FUSE_ROWS)} from evt), g as (select unnest([550, 650, 750]) as d),
           x as (select r.*, d, case when appearance is not null then appearance when dist between 430 and 610 then vote when dist < d and wrist is not null then wrist else vote end as ok from r cross join g),
           f as (select d, sum(case when t < 1200000 and ok then 1 else 0 end) as fit_ok from x group by d), b as (select d, fit_ok from f order by fit_ok desc, d desc limit 1)
           select x.d as d_close, b.fit_ok, count(*) as n, sum(ok::int) as n_ok, sum((t >= 1200000)::int) as held_n, sum((t >= 1200000 and ok)::int) as held_ok from x join b on x.d = b.d group by all""")
def _(spark, sf):
    return H.fuse_signals(A.events(spark, sf).selectExpr(*FUSE_ROWS), [550, 650, 750], 1200000)


ASM = ["game", "eid", "t", "rq", "case when k % 5 > 0 then concat('P', uid, case when k % 2 = 0 then '?' else '' end) end as pred_player",
       "case k % 4 when 0 then '2PT' when 1 then '3PT' when 2 then '4PT' end as pred_zone", "case when k % 7 > 0 then k * 9e0 end as release_dist",
       "case uid % 3 when 0 then 'MAKE' when 1 then 'MISS' end as verdict"]


@query("evt13_event_assembly", "game eid t classification:s player_a:s tier:s confidence:k", "cv",
       f"""select *, case when coalesce(release_dist between 430 and 610 and pred_zone = '2PT', false) then 'FREE_THROW' when pred_zone = '2PT' then 'FG' else coalesce(pred_zone, 'FG') end || '_' || coalesce(verdict, 'ATTEMPT') as classification,
           rtrim(coalesce(pred_player, '?'), '?') as player_a, case when rq <= 16e-1 and verdict is not null then 'high' else 'low' end as tier,
           case when rq <= 16e-1 and verdict is not null then 8e-1 else 4e-1 end as confidence from (select {', '.join(ASM)} from cv) where pred_player is not null or verdict is not null""")
def _(spark, sf):
    return H.assemble(A.cv_events(spark, sf).selectExpr(*ASM))


MISS = "select game, play_id as miss_id, cast(floor(t / 1800) as bigint) as frame, case when k % 5 > 0 then 1 + k % 2 end as team from plays where k % 3 > 0"
VTEAM = "case when value in ('click', 'view') then 1 when value in ('purchase', 'error') then 2 end"


def misses(spark, sf):
    return A.plays(spark, sf).filter("k % 3 > 0").selectExpr("game", "play_id as miss_id", "cast(floor(t / 1800) as bigint) as frame", "case when k % 5 > 0 then 1 + k % 2 end as team")


@query("evt14_rebounds", "game miss_id new_start new_value:s off_def:s", "plays seg",
       f"""with m as ({MISS}), p as (select m.*, s.value as cur from m left join seg s on m.game = s.game and m.frame between s.start_frame and s.end_frame),
           n as (select p.game, p.miss_id, p.team, s.start_frame as new_start, s.value as new_value, {VTEAM.replace('value', 's.value')} as nt from p join seg s on p.game = s.game and s.start_frame between p.frame - 1 and p.frame + 9
             qualify row_number() over (partition by p.game, p.miss_id order by s.value is not distinct from cur, s.start_frame) = 1)
           select *, case when team is null or nt is null then '?' when nt = team then 'OFF' else 'DEF' end as off_def from n""")
def _(spark, sf):
    return P.rebounds(misses(spark, sf), segments(spark, sf).withColumn("team", F.expr(VTEAM)), ["game"], 1, 9, 16)


@query("evt14b_longest_hold_rebounds", "game miss_id start_frame value:s length", "plays seg",
       f"""with m as ({MISS}) select m.game, m.miss_id, s.start_frame, s.value, s.end_frame - s.start_frame as length from m join seg s on m.game = s.game and s.start_frame between m.frame + 1 and m.frame + 12
           and least(s.end_frame, m.frame + 12) - s.start_frame + 1 >= 2 qualify row_number() over (partition by m.game, m.miss_id order by s.end_frame - s.start_frame desc, s.start_frame) = 1""")
def _(spark, sf):
    return P.longest_hold(misses(spark, sf), segments(spark, sf), ["game"], 1, 12, 2)


@query("evt15_grab_recheck", "game frame sid:s overridden", "ball streams",
       """with ub as (select game, cam, frame, sid, exp(-(sqrt((ball_x - (x1 + x2) / 2) * (ball_x - (x1 + x2) / 2) + (ball_y - y1) * (ball_y - y1)) / w)) as weight from (""" + PAIR_SQL + """)
            where ball_x between x1 - 6e-1 * w and x2 + 6e-1 * w and ball_y <= y2 and ball_y <= y1 + 6e-1 * (y2 - y1)),
          pk_ as (select distinct game, frame, concat('n', frame % 10, 'B') as sid from ball),
          ev as (select p.game, p.frame, ub.sid, sum(weight) as score from pk_ p join ub on ub.game = p.game and ub.frame between p.frame - 6 and p.frame + 17 group by all),
          b as (select * from ev qualify row_number() over (partition by game, frame order by score desc, sid desc) = 1)
          select p.game, p.frame, case when b.sid <> p.sid and b.score >= 15e-1 * coalesce(o.score, 1e-9) then b.sid else p.sid end as sid, coalesce(b.sid <> p.sid and b.score >= 15e-1 * coalesce(o.score, 1e-9), false) as overridden
          from pk_ p left join b using (game, frame) left join ev o on o.game = p.game and o.frame = p.frame and o.sid = p.sid""")
def _(spark, sf):
    picks = A.ball(spark, sf).selectExpr("game", "frame", "concat('n', frame % 10, 'B') as sid").distinct()
    ev = H.frame_scores(ball_boxes(spark, sf), -6, 18, 0.6, A.BLOCK)
    return P.override_by_evidence(picks.withColumn(O.BLK, O.block_of("frame", A.BLOCK)), ev, ["game", O.BLK, "frame"])


BLOCK_SQL = f"""with t as (select *, {VTEAM} as team from seg where {VTEAM} is not null), s as (select *, case when lag(team) over w = team and start_frame - lag(end_frame) over w <= 2 then 0 else 1 end as st from t window w as (partition by game order by start_frame)),
  r as (select *, sum(st) over (partition by game order by start_frame) as run from s),
  b as (select game, team, min(start_frame) as f0, arg_max(end_frame, start_frame) as f1, arg_min(value, start_frame) as first_player, arg_max(value, start_frame) as last_player from r group by game, run, team having arg_max(end_frame, start_frame) - min(start_frame) + 1 >= 2)"""


def blocks(spark, sf):
    seg = segments(spark, sf).withColumn("team", F.expr(VTEAM)).withColumn("player", col("value"))
    return P.team_blocks(seg, ["game"], 2, 2, B)


@query("win25_team_blocks", "game f0 f1 team first_player:s last_player:s", "seg", BLOCK_SQL + " select * from b")
def _(spark, sf):
    return blocks(spark, sf)


@query("evt16_turnovers_steals", "game frame classification:s player_a:s", "seg plays",
       BLOCK_SQL + """, c as (select *, lag(f1) over w as pf1, lag(team) over w as pteam, lag(last_player) over w as pl from b window w as (partition by game order by f0)),
          sh as (select distinct game, cast(floor(t / 1800) as bigint) as frame from plays where k % 4 = 0),
          l as (select * from c where pteam <> team and f0 - pf1 <= 3 and not exists (select 1 from sh where sh.game = c.game and abs(sh.frame - c.f0) <= 1))
          select game, f0 as frame, 'TURNOVER' as classification, pl as player_a from l union all select game, f0, 'STEAL', first_player from l""")
def _(spark, sf):
    shots = A.plays(spark, sf).filter("k % 4 = 0").selectExpr("game", "cast(floor(t / 1800) as bigint) as frame").distinct()
    return P.turnovers(blocks(spark, sf), shots, ["game"], 3, 1, B)


FAST_SQL = """with c as (select game, chunk, team, frame, avg(cx) as x from world where team in ('A', 'B') group by all),
  n as (select a.game, a.chunk, a.team, a.frame, a.x, min(b.frame) as f1 from c a join c b on a.game = b.game and a.chunk = b.chunk and a.team = b.team and b.frame - a.frame >= 12 group by all),
  d as (select n.*, b.x - n.x as dx from n join c b on b.game = n.game and b.chunk = n.chunk and b.team = n.team and b.frame = n.f1 where abs(b.x - n.x) >= 800)
  select game, chunk, team, frame as f0, f1, round_even(dx, 0) as dx, case when dx > 0 then 'right' else 'left' end as direction from d qualify row_number() over (partition by game, chunk, team order by frame) = 1"""


@query("win24_fast_break", "game chunk team:s f0 f1 direction:s", "world", FAST_SQL)
def _(spark, sf):
    return P.fast_breaks(A.world(spark, sf), ["game", "chunk"], 12)


RUNS = RLE_RUNS = "select game, start_frame, end_frame, case value when 'click' then 1 when 'view' then 2 when 'purchase' then 3 when 'error' then 4 else 5 end as gid from seg"
EVT1_SQL = f"""with r as (select *, case when gid < 3 then 'A' when gid < 5 then 'B' end as team from ({RUNS})), p as (select *, lag(end_frame) over w as pe, lag(gid) over w as pg, lag(team) over w as pt from r window w as (partition by game order by start_frame))
  select game, 'possession' as event, start_frame as frame, gid, null as to_gid, team from p union all
  select game, case when pt is not distinct from team then 'pass' else 'turnover' end, pe, pg, gid, pt from p where start_frame - pe <= 4 and pg <> gid"""


def run_events(spark, sf):
    r = segments(spark, sf).withColumn("gid", F.expr("case value when 'click' then 1 when 'view' then 2 when 'purchase' then 3 when 'error' then 4 else 5 end")).drop("value")
    teams = spark.range(1, 6).join(F.broadcast(spark.range(5).withColumnRenamed("id", "game"))).selectExpr("game", "id as gid", "case when id < 3 then 'A' when id < 5 then 'B' end as team")
    return P.run_events(r, ["game"], teams, 4, B)


@query("evt01_possession_pass_turnover", "game event:s frame gid to_gid team:s", "seg", EVT1_SQL)
def _(spark, sf):
    return run_events(spark, sf)


@query("evt02_holder_votes", "game chunk ref sid:s votes", "ball det streams offs",
       """with d as (select b.game, b.cam, b.chunk, b.frame, s.sid, b.ball_x - (s.x1 + s.x2) / 2 as dx, b.ball_y - (s.y1 + s.y2) / 2 as dy, (s.x2 - s.x1) * 135e-2 / 2 as hw, (s.y2 - s.y1) * 135e-2 / 2 as hh
            from ball b join streams s on b.game = s.game and b.cam = s.cam and b.frame = s.frame),
          e as (select *, case when abs(dx) <= hw and abs(dy) <= hh then 0e0 else sqrt((dx / greatest(hw, 1e0)) * (dx / greatest(hw, 1e0)) + (dy / greatest(hh, 1e0)) * (dy / greatest(hh, 1e0))) end as dist from d),
          n as (select * from e where dist < 2 qualify row_number() over (partition by game, cam, chunk, frame order by dist, sid) = 1),
          v as (select n.game, n.chunk, n.frame - off as ref, sid, sum(case when dist = 0 then 2 else 1 end) as votes from n join offs o on n.game = o.game and n.cam = o.cam group by all)
          select * from v qualify row_number() over (partition by game, chunk, ref order by votes desc, sid) = 1""")
def _(spark, sf):
    b = A.ball(spark, sf).select("game", "cam", "frame", "chunk", "ball_x", "ball_y")
    s = A.streams(spark, sf).select("game", "cam", "frame", "sid", "x1", "y1", "x2", "y2")
    return P.nearest_votes(b.join(s, ["game", "cam", "frame"]), A.offsets(spark))


@query("evt03_image_attribution", "game cam frame track_id inside", "ball trk",
       """with d as (select b.game, b.cam, b.frame, t.track_id, ball_x between t.x1 - (t.x2 - t.x1) * 2e-1 and t.x2 + (t.x2 - t.x1) * 2e-1 and ball_y between t.y1 - (t.y2 - t.y1) * 2e-1 and t.y2 + (t.y2 - t.y1) * 2e-1 as ins,
             abs((t.x2 - t.x1) * (t.y2 - t.y1)) as area, sqrt((ball_x - (t.x1 + t.x2) / 2) * (ball_x - (t.x1 + t.x2) / 2) + (ball_y - (t.y1 + t.y2) / 2) * (ball_y - (t.y1 + t.y2) / 2)) as d, 5e-1 * (t.y2 - t.y1) as lim
             from ball b join trk t on b.game = t.game and b.cam = t.cam and b.frame = t.frame)
          select game, cam, frame, track_id, ins as inside from d where ins or d <= lim qualify row_number() over (partition by game, cam, frame order by not ins, case when ins then area else d end, track_id) = 1""")
def _(spark, sf):
    return P.attribute_ball(A.ball(spark, sf).select("game", "cam", "frame", "ball_x", "ball_y"), A.tracks(spark, sf), ["game", "cam", "frame"], "track_id")


@query("evt04_best_ball_holder", "game frame cam track_id gid", "trk",
       """with v as (select game, frame, cam, track_id from trk where class_id = 0 qualify row_number() over (partition by game, frame order by score desc, cam desc, track_id desc) = 1),
          m as (select game, cam, track_id, frame, pk % 7 as gid from trk where class_id = 1)
          select v.game, v.frame, v.cam, v.track_id, m.gid from v join m on v.game = m.game and v.cam = m.cam and v.track_id = m.track_id and abs(m.frame - v.frame) <= 5
          qualify row_number() over (partition by v.game, v.frame order by abs(m.frame - v.frame), m.frame) = 1""")
def _(spark, sf):
    t = A.tracks(spark, sf)
    votes = O.best_per(t.filter("class_id = 0"), ["game", "frame"], ["score", "cam", "track_id"], ["cam", "track_id"])
    members = t.filter("class_id = 1").select("game", "cam", "track_id", "frame", (col("pk") % 7).alias("gid"))
    return J.nearby_frame(votes, members, ["game", "cam", "track_id"], "gid", 5).filter("gid is not null")


@query("evt17_transitions", "game chunk t:k team:s direction:s", "world", f"select game, chunk, (f0 - 0) / 2997e-2 as t, team, direction from ({FAST_SQL})")
def _(spark, sf):
    return P.fast_breaks(A.world(spark, sf), ["game", "chunk"], 12).withColumn("t", col("f0") / F.lit(29.97))


ANCH = "case k % 12 when 0 then 'FG_MAKE' when 1 then 'FG_MISS' when 2 then '3PT_MAKE' when 3 then '3PT_MISS' when 4 then '4PT_MAKE' when 5 then '4PT_MISS' when 6 then 'REBOUND' when 7 then 'STEAL' when 8 then 'TURNOVER' when 9 then 'FREE_THROW_MAKE' else 'FOUL' end"


@query("evt18_play_anchors", "game frame cls:s kind:s jersey n_candidates pre_frames", "plays world",
       f"""with p as (select game, cast(floor(t / 600) as bigint) as tick, {ANCH} as cls, min(play_id) as play_id, arg_min(t, play_id) as t, arg_min(uid, play_id) % 12 as jersey from plays where t / 1e3 - 200 between -2 and 602 group by all),
           w as (select game, jersey, count(*) as n from (select distinct game, jersey, chunk from world where jersey is not null) group by all)
           select p.game, cast(round_even((t / 1e3 - 200) * 2997e-2, 0) as bigint) as frame, cls, case when k6 then 'shot' when cls = 'REBOUND' then 'possession_flip' else 'turnover' end as kind, p.jersey,
             coalesce(w.n, 0) as n_candidates, case when k6 then 29 else 0 end as pre_frames
           from (select *, ends_with(cls, 'MAKE') or ends_with(cls, 'MISS') as k6 from p where cls not in ('FREE_THROW_MAKE', 'FOUL')) p left join w on p.game = w.game and p.jersey = w.jersey""")
def _(spark, sf):
    p = A.plays(spark, sf).withColumn("cls", F.expr(ANCH)).withColumn("ts", col("t") / 1000).withColumn("jersey", col("uid") % 12).withColumn("tick", F.floor(col("t") / 600))
    players = A.world(spark, sf).filter("jersey is not null").select("game", "jersey", "chunk", "team").distinct().withColumnRenamed("chunk", "gid")
    return H.play_anchors(p, players, 200.0, 600.0)


@query("evt19_attribution_at_play_time", "game play_id holder:s votes fresh", "plays cand",
       """with p as (select game, play_id, cast(floor(t / 1800) as bigint) as f from plays), c as (select p.game, p.play_id, cand, count(*) as c, min(frame) as f0, max(frame) as fresh from p join cand on cand.game = p.game and frame between f - 8 and f - 1 where cand is not null group by all)
          select game, play_id, cand as holder, c as votes, fresh from c qualify row_number() over (partition by game, play_id order by c desc, f0) = 1""")
def _(spark, sf):
    p = A.plays(spark, sf).selectExpr("game", "play_id", "cast(floor(t / 1800) as bigint) as f")
    h = A.candidates(spark, sf).filter("cand is not null").withColumnRenamed("cand", "holder")
    return P.modal_holder(p, h, ["game"], "play_id", col("f") - 8, col("f"))


@query("evt20_latest_holder_pick", "game play_id holder:s frame", "plays cand",
       """select p.game, p.play_id, c.cand as holder, c.frame from (select game, play_id, cast(floor(t / 1800) as bigint) as f from plays) p join cand c on c.game = p.game and c.cand is not null and c.frame between f - 10 and f + 3
          qualify row_number() over (partition by p.game, p.play_id order by c.frame desc) = 1""")
def _(spark, sf):
    p = A.plays(spark, sf).selectExpr("game", "play_id as shot_id", "cast(floor(t / 1800) as bigint) as at")
    h = A.candidates(spark, sf).filter("cand is not null").withColumnRenamed("cand", "holder")
    return H.latest_holder(p, h, ["game"], -10, 3).withColumnRenamed("shot_id", "play_id")


RIMSTORY_SQL = """with b as (select *, ball_x - lag(ball_x) over w as ddx, ball_y - lag(ball_y) over w as ddy from ball window w as (partition by game, cam, chunk order by frame)),
  v as (select b.game, b.chunk, b.frame, s.sid, sum(1e0 - 5e-1 * abs(ball_x - (s.x1 + s.x2) / 2) / greatest(s.x2 - s.x1, 1e0)) as w from b join streams s on b.game = s.game and b.cam = s.cam and b.frame = s.frame
    where ball_y <= s.y2 and abs(ball_x - (s.x1 + s.x2) / 2) / greatest(s.x2 - s.x1, 1e0) <= 7e-1 and ball_y >= s.y1 - 1e-1 * (s.y2 - s.y1) group by all),
  t as (select * from v qualify row_number() over (partition by game, chunk, frame order by floor(w * 1e6 + 5e-1) desc, sid) = 1),
  f as (select game, chunk, frame, median(sqrt(ddx * ddx + ddy * ddy)) as speed, max((abs(ball_x - 200) < 30 and abs(ball_y - 100) < 30)::int) as rim from b group by all),
  o as (select f.*, t.sid, case when rim = 1 then 'RIM' when t.sid is not null then 'HOLD' when speed > 14 then 'FLIGHT' else 'GAP' end as state from f left join t using (game, chunk, frame)),
  s as (select *, row_number() over (partition by game, chunk order by frame) as i, last_value(case when state <> 'HOLD' then frame end ignore nulls) over (partition by game, chunk order by frame) as lf from o),
  h as (select *, case when frame - lf <= 4 then 2 else 3 end as need from s where state = 'HOLD'),
  r as (select *, sum(ch) over (partition by game, chunk order by frame) as run from (select *, case when sid = lag(sid) over (partition by game, chunk order by frame) then 0 else 1 end as ch from h)),
  p as (select *, row_number() over (partition by game, chunk, run order by frame) as p from r),
  hh as (select s.game, s.chunk, s.frame, s.state, last_value(case when p.p >= p.need then p.sid end ignore nulls) over (partition by s.game, s.chunk order by s.frame) as holder from s left join p on p.game = s.game and p.chunk = s.chunk and p.frame = s.frame)
  select game, chunk, frame, holder from (select *, lag(state) over (partition by game, chunk order by frame) as ps from hh) where state = 'RIM' and ps is distinct from 'RIM'"""


@query("evt21_story_with_rim", "game chunk frame holder:s", "ball streams", RIMSTORY_SQL)
def _(spark, sf):
    return H.rim_story(A.ball(spark, sf), A.streams(spark, sf), (200.0, 100.0, 30.0), switch_k=3, catch_k=2)


@query("evt22_shot_window_features", "game play_id cam frame ball_id conf:k", "plays evt",
       """with w as (select game, play_id, cast(floor(t / 1800) as bigint) as f from plays), s as (select w.game, w.play_id, c.cam, unnest(range(f - 2, f + 3)) as frame from w cross join (select range as cam from range(4)) c),
          b as (select game, eid % 4 as cam, cast(floor(sec / 1800) as bigint) as frame, arg_max(eid, val * 1e5 + eid) as ball_id, max(val) % 1000 / 1e3 as conf from evt where val % 1000 >= 250 group by all),
          cov as (select w.game, w.play_id from w join (select distinct game, cam, frame from (select game, eid % 4 as cam, cast(floor(sec / 1800) as bigint) as frame from evt)) k on k.game = w.game and k.frame between f - 2 and f + 2 group by all having count(*) >= 14)
          select s.*, b.ball_id, b.conf from s join cov using (game, play_id) left join b using (game, cam, frame)""")
def _(spark, sf):
    w = A.plays(spark, sf).selectExpr("game", "play_id", "cast(floor(t / 1800) as bigint) - 2 as f0", "cast(floor(t / 1800) as bigint) + 2 as f1")
    e = A.events(spark, sf).selectExpr("game", "eid % 4 as cam", "cast(floor(sec / 1800) as bigint) as frame", "eid", "val")
    ball = e.filter("val % 1000 >= 250").groupBy("game", "cam", "frame").agg(
        F.max(F.struct("val", "eid")).alias("b")).select("game", "cam", "frame", col("b.eid").alias("ball_id"), (col("b.val") % 1000 / F.lit(1000.0)).alias("conf"))
    seen = e.select("game", "cam", "frame").distinct()
    spine = H.frame_spine(w, [0, 1, 2, 3])
    covered = spine.join(seen, ["game", "cam", "frame"], "left_semi").groupBy("game", "play_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 14")
    return spine.join(covered.drop("n"), ["game", "play_id"], "left_semi").join(ball, ["game", "cam", "frame"], "left")


@query("evt23_angle_aware_fold", "game frame n_FARSIDE n_NEARSIDE", "det",
       """with p as (select game, frame, sum((cam = 0)::int) as fl, sum((cam = 1)::int) as fr, sum((cam = 2)::int) as nl, sum((cam = 3)::int) as nr, max(det_idx) % 2 = 0 as lf from det group by all)
          select game, frame, case when lf then fl else fr end as n_FARSIDE, case when lf then nl else nr end as n_NEARSIDE from p""")
def _(spark, sf):
    d = A.detections(spark, sf).groupBy("game", "frame").agg(
        *[F.sum((col("cam") == i).cast("long")).alias(f"n_{c}") for i, c in enumerate(("FL", "FR", "NL", "NR"))], (F.max("det_idx") % 2 == 0).alias("lf"))
    return H.fold_by_side(d, ["n"], col("lf"))


@query("evt25_clock_shift", "game shift:h n", "plays cv",
       """with m as (select p.game, c.t - p.t as d from plays p join cv c on p.game = c.game and abs(c.t - p.t) <= 1800 qualify row_number() over (partition by p.game, p.play_id order by abs(c.t - p.t), c.t, c.eid) = 1)
          select game, median(d) as shift, count(*) as n from m group by game""")
def _(spark, sf):
    m = J.nearest_in_time(A.plays(spark, sf), A.cv_events(spark, sf), ["game"], "t", ["eid"], 1800).filter("m_t is not null")
    d = m.withColumn("d", col("m_t") - col("t"))
    return O.exact_quantiles(d, ["game"], {"shift": "d"}, {"": 0.5}).join(d.groupBy("game").agg(F.count(F.lit(1)).alias("n")), "game")


@query("evt26_honest_degradation", "game event:s frame caveat:s", "seg evt",
       f"""with e as ({EVT1_SQL.replace('with r as', 'select * from (with r as')})), b as (select distinct game from evt where game < 4)
           select game, event, frame, null as caveat from e where game in (select game from b) union all select distinct game, null, null::bigint, 'no ball trace: possession events skipped' from evt where game not in (select game from b)""")
def _(spark, sf):
    e = A.events(spark, sf)
    return P.with_caveat(run_events(spark, sf).select("game", "event", "frame"), e.filter("game < 4"), e, ["game"])
