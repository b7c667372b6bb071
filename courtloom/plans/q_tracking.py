"""Trackers, identity solvers and corrections over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtloom.functions import geometry as G
from courtloom.operators import correction as K
from courtloom.operators import fusion as N
from courtloom.operators import identity as I
from courtloom.operators import joins as J
from courtloom.operators import linking as LK
from courtloom.operators import ordered as O
from courtloom.operators import scoring as R
from courtloom.operators import sequence as S
from courtloom.operators import tracking as T
from courtloom.operators import votes as V
from courtloom.operators import whole as WH
from courtloom.plans import adapters as A
from courtloom.plans.q_aggregates import FUSE_BALL_SQL, ball_points, court_observations
from courtloom.plans.q_columns import COURT_SQL, IOU_SQL
from courtloom.plans.registry import query
from courtloom.session import cut_lineage

col = F.col
B = A.BLOCK


def world_edges(spark, sf, gate=600.0):
    w = A.world(spark, sf)
    a = w.filter("gid < 5").select("game", "chunk", "frame", col("gid").alias("left_id"), "cx", "cy")
    b = w.filter("gid >= 5").select("game", "frame", col("gid").alias("right_id"), col("cx").alias("rx"), col("cy").alias("ry"))
    e = a.join(b, ["game", "frame"]).withColumn("cost", G.distance(col("cx"), col("cy"), col("rx"), col("ry")))
    return e.filter(col("cost") <= gate).select("game", "chunk", "frame", "left_id", "right_id", "cost")


@query("jn13_optimal_assignment", "game frame left_id right_id cost:h")
def _(spark, sf):
    return T.assign_per_frame(world_edges(spark, sf), ["game", "chunk"], "frame", "left_id", "right_id", "cost")


# cheapest choice for each frame: left rows one after the other, the set of used right rows as bits, one state for each set
CHOICE_SQL = """l as (select *, dense_rank() over (partition by {keys} order by left_id) as li, dense_rank() over (partition by {keys} order by right_id) - 1 as ri from e),
  n as (select {keys}, max(li) as n from l group by {keys}),
  st as (select {keys}, 0::bigint as i, 0::hugeint as used, 0e0 as cost from n union all
    select {keys}, i, used, min(cost) from (
      select {on}, st.i + 1 as i, st.used, st.cost + {alone} as cost from st join n using ({keys}) where st.i < n.n union all
      select {on}, st.i + 1, st.used + (1::hugeint << l.ri::int), st.cost + l.cost from st join l using ({keys}) where l.li = st.i + 1 and (st.used >> l.ri::int) % 2 = 0) group by {keys}, i, used)
  select {keys}, min(cost) as cost from st join n using ({keys}) where i = n group by {keys}"""


def choice_sql(keys: list[str], alone: str) -> str:
    names = ", ".join(keys)
    return CHOICE_SQL.format(keys=names, on=", ".join(f"st.{k}" for k in keys), alone=alone)


@query("jn13b_assignment_cost", "game frame cost:h", "world",
       """with recursive e as (select a.game, a.frame, a.gid as left_id, b.gid as right_id, sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2)) as cost
    from world a join world b on a.game = b.game and a.frame = b.frame and a.gid < 5 and b.gid >= 5 where sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2)) <= 600), """ + choice_sql(["game", "frame"], "1e6"))
def _(spark, sf):
    return T.cost_per_frame(world_edges(spark, sf), ["game", "chunk"], "frame", "left_id", "right_id", "cost", 1e6)


# one row of state for each frame from the first to the last sight: position, velocity and the covariance both axes share
SMOOTH_SQL = """with recursive o as (select f.game, f.gid, f.chunk, f.frame, row_number() over (partition by f.game, f.gid, f.chunk order by f.frame) as i, w.cx, w.cy
    from (select game, gid, chunk, unnest(range(lo, hi + 1)) as frame from (select game, gid, chunk, min(frame) as lo, max(frame) as hi from world group by all)) f left join world w using (game, gid, chunk, frame)),
  k as (select 1 / 30e0 as dt, 16e2 as r, 9e4 as q),
  s as (select game, gid, chunk, frame, i, cx as x, cy as y, 0e0 as vx, 0e0 as vy, 16e2 as a, 0e0 as b, 4e4 as d, true as seen from o where i = 1 union all
    select game, gid, chunk, frame, i, case when hit then px + g0 * (cx - px) else px end, case when hit then py + g0 * (cy - py) else py end, case when hit then vx + g1 * (cx - px) else vx end, case when hit then vy + g1 * (cy - py) else vy end,
      case when hit then pa - g0 * pa else pa end, case when hit then pb - g0 * pb else pb end, case when hit then pd - g1 * pb else pd end, hit
    from (select *, cx is not null as hit, pa / (pa + r) as g0, pb / (pa + r) as g1
      from (select o.game, o.gid, o.chunk, o.frame, o.i, o.cx, o.cy, k.r, s.vx, s.vy, s.x + k.dt * s.vx as px, s.y + k.dt * s.vy as py,
          s.a + 2 * k.dt * s.b + k.dt * k.dt * s.d + k.q * k.dt * k.dt * k.dt * k.dt / 4 as pa, s.b + k.dt * s.d + k.q * k.dt * k.dt * k.dt / 2 as pb, s.d + k.q * k.dt * k.dt as pd
        from s join o on s.game = o.game and s.gid = o.gid and s.chunk = o.chunk and o.i = s.i + 1 cross join k)))
  select game, gid, chunk, frame, x as sx, y as sy, vx, vy from s where seen"""


@query("trk01_smoothed_points", "game gid chunk frame sx:h sy:h vx:h vy:h", "world", SMOOTH_SQL)
def _(spark, sf):
    return T.smooth_points(A.world(spark, sf).withColumn("w", F.lit(1.0)), ["game", "gid", "chunk"], "frame", "cx", "cy", "w")


@query("trk02_ball_trajectory", "game cam chunk frame cx:h cy:h vx:h vy:h imputed conf:k")
def _(spark, sf):
    return T.ball_trajectory(A.ball(spark, sf), gap=3, bridge=6, bracket=0.8)


# one row of state for each frame: on (a track lives), position, velocity, covariance, frames missed, run of bright far points
BALL_SQL = f"""with recursive fused as ({FUSE_BALL_SQL}),
  l as (select game, cast(floor(frame / {A.CHUNK}) as bigint) as chunk, frame, list({{'x': cx, 'y': cy, 's': score}} order by score desc, cx, cy) as c from fused group by all),
  f as (select game, chunk, unnest(range(lo, hi + 1)) as frame from (select game, chunk, min(frame) as lo, max(frame) as hi from l group by all)),
  o as (select f.game, f.chunk, f.frame, row_number() over (partition by f.game, f.chunk order by f.frame) as i, coalesce(l.c, []) as c from f left join l using (game, chunk, frame)),
  k as (select 1 / 2997e-2 as dt, 16e2 as r, 9e4 as q),
  s as (select game, chunk, frame, i, true as live, c[1].x as x, c[1].y as y, 0e0 as vx, 0e0 as vy, 16e2 as a, 0e0 as b, 4e4 as d, 0 as missed, []::struct(x double, y double, s double)[] as run, true as shown, c[1].x as ox, c[1].y as oy from o where i = 1
    union all
    select game, chunk, frame, i, live2 and not (missed2 > 12 and len(run2) = 0), x2, y2, vx2, vy2, a2, b2, d2, case when missed2 > 12 and len(run2) = 0 then 0 else missed2 end, run2, shown2, case when born or near then x2 else px end, case when born or near then y2 else py end
    from (select *, live or len(c) > 0 as live2, case when born then top.x when near then px + g0 * (z.x - px) else px end as x2, case when born then top.y when near then py + g0 * (z.y - py) else py end as y2,
        case when born then 0e0 when near then vx + g1 * (z.x - px) else vx end as vx2, case when born then 0e0 when near then vy + g1 * (z.y - py) else vy end as vy2,
        case when born then 16e2 when near then pa - g0 * pa else pa end as a2, case when born then 0e0 when near then pb - g0 * pb else pb end as b2, case when born then 4e4 when near then pd - g1 * pb else pd end as d2,
        case when born or near or not live then 0 else missed + 1 end as missed2, case when born or near then [] else grown end as run2, case when not live then len(c) > 0 else born or near or missed + 1 <= 12 end as shown2
      from (select *, (not live and len(c) > 0) or (live and not near and len(grown) >= 3) as born, pa / (pa + r / w) as g0, pb / (pa + r / w) as g1
        from (select *, case when live and not near then case when top.s >= 2e-1 then case when len(run) = 0 or sqrt((run[-1].x - top.x) * (run[-1].x - top.x) + (run[-1].y - top.y) * (run[-1].y - top.y)) <= 25e1 then list_append(run, top) else [top] end else [] end else run end as grown
          from (select *, coalesce(live and dz <= 25e1, false) as near, least(greatest(z.s * 3, 3e-1), 15e-1) as w
            from (select *, sqrt((z.x - px) * (z.x - px) + (z.y - py) * (z.y - py)) as dz
              from (select s.game, s.chunk, o.frame, o.i, s.live, s.missed, s.run, o.c, o.c[1] as top, s.vx, s.vy, k.r, s.x + k.dt * s.vx as px, s.y + k.dt * s.vy as py,
                  s.a + 2 * k.dt * s.b + k.dt * k.dt * s.d + k.q * k.dt * k.dt * k.dt * k.dt / 4 as pa, s.b + k.dt * s.d + k.q * k.dt * k.dt * k.dt / 2 as pb, s.d + k.q * k.dt * k.dt as pd,
                  list_reduce(list_prepend({{'x': 1e9, 'y': 1e9, 's': 0e0}}, o.c), lambda m, e: case when (e.x - s.x - k.dt * s.vx) * (e.x - s.x - k.dt * s.vx) + (e.y - s.y - k.dt * s.vy) * (e.y - s.y - k.dt * s.vy)
                    < (m.x - s.x - k.dt * s.vx) * (m.x - s.x - k.dt * s.vx) + (m.y - s.y - k.dt * s.vy) * (m.y - s.y - k.dt * s.vy) then e else m end) as z
                from s join o on s.game = o.game and s.chunk = o.chunk and o.i = s.i + 1 cross join k)))))))
  select game, chunk, frame, ox as bx, oy as by_ from s where shown"""


@query("trk03_ball_tracker", "game chunk frame bx:h by_:h", "bpts", BALL_SQL)
def _(spark, sf):
    fused = V.fuse_ball_candidates(ball_points(spark, sf), ["game", "chunk", "frame"])
    return T.track_ball(fused).withColumnRenamed("by", "by_")


WHOLE_BALL_SQL = BALL_SQL.replace(f"cast(floor(frame / {A.CHUNK}) as bigint) as chunk", "0 as chunk").replace("select game, chunk, frame, ox as bx", "select game, frame, ox as bx")


@query("trk03b_ball_track_of_a_game", "game frame bx:h by_:h", "bpts", WHOLE_BALL_SQL)
def _(spark, sf):
    fused = V.fuse_ball_candidates(ball_points(spark, sf), ["game", "frame"])
    return WH.ball_track(fused, length=A.CHUNK).withColumnRenamed("by", "by_")


@query("trk02b_ball_paths_of_a_game", "game cam seg frame cx:h cy:h vx:h vy:h imputed conf:k")
def _(spark, sf):
    return WH.ball_paths(A.ball(spark, sf), length=A.CHUNK, edge=100, gap=3, bridge=6, bracket=0.8)


def player_groups(spark, sf):
    g = V.cluster_players(court_observations(spark, sf), ["game", "chunk", "frame"], 250.0)
    m = g.select("game", "chunk", "frame", "group_id", F.explode("members").alias("m"))
    flat = m.select("game", "chunk", "frame", "group_id", "m.cam", col("m.t").alias("track_id"))
    obs = court_observations(spark, sf).select("game", "cam", "frame", "track_id", "cx", "cy", "team", "jersey", "score", "zone_conf")
    return flat.join(obs, ["game", "cam", "frame", "track_id"])


@query("trk04_cross_camera_fusion", "game chunk frame gid cx:h cy:h team:s jersey n_members")
def _(spark, sf):
    return N.fuse_groups(player_groups(spark, sf), max_dist=400.0)


@query("trk04b_fused_tracks_of_a_game", "game frame gid cx:h cy:h team:s jersey n_members")
def _(spark, sf):
    return WH.fused_tracks(player_groups(spark, sf), length=A.CHUNK, before=60, max_dist=400.0)


@query("trk05_alias_resolution", "game child root", "",
       """with recursive p as (select distinct o_custkey % 4 as game, o_custkey as child, cast(floor(o_custkey / 3) as bigint) as parent from orders where o_custkey % 4 = cast(floor(o_custkey / 3) as bigint) % 4 and o_custkey > 0),
          r as (select game, child, parent as root from p union all select r.game, r.child, p.parent from r join p on r.game = p.game and r.root = p.child)
          select game, child, min(root) as root from r group by game, child""")
def _(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_custkey % 4 as game", "o_custkey as child", "cast(floor(o_custkey / 3) as bigint) as parent")
    p = o.filter("game = parent % 4 and child > 0").distinct()
    return I.resolve_aliases(p, keys=["game"]).withColumnRenamed("parent", "root")


def fragments(spark, sf):
    """Tracklets: runs of a global id with gaps up to 1 frame inside a chunk."""
    w = A.world(spark, sf)
    i = S.islands(w, ["game", "gid", "chunk"], "frame", 1)
    return S.span_summary(i.withColumn("tid", col("gid") * 1000 + col("island")), ["game", "chunk", "tid"], "frame", "cx", "cy", "team")


FRAG_SQL = """with i as (select *, sum(cut) over (partition by game, gid, chunk order by frame) as isl from (select *, case when frame - lag(frame) over (partition by game, gid, chunk order by frame) > 1 then 1 else 0 end as cut from world)),
  s as (select game, chunk, gid * 1000 + isl as tid, min(frame) as first, max(frame) as last, count(*) as n, arg_min(cx, frame) as fx, arg_min(cy, frame) as fy, arg_max(cx, frame) as lx, arg_max(cy, frame) as ly, min(team) as team from i group by all),
  c as (select a.game, a.chunk, a.tid as ga, b.tid as gb, b.first - a.last as gap, sqrt((a.lx - b.fx) * (a.lx - b.fx) + (a.ly - b.fy) * (a.ly - b.fy)) as dist
    from s a join s b on a.game = b.game and a.chunk = b.chunk and a.tid <> b.tid and b.first - a.last between 1 and 10
    where case when a.team = 'REF' or b.team = 'REF' then a.team = b.team else a.team = b.team end)"""


@query("trk06a_tracklet_candidates", "game chunk ga gb gap cost:h", "world", FRAG_SQL + " select *, dist + 5e-1 * gap as cost from c where dist <= least(450, 200 + 6 * gap)")
def _(spark, sf):
    return I.tracklet_candidates(fragments(spark, sf), ["game", "chunk"], "tid", max_gap=10)


MERGE_SQL = FRAG_SQL.replace("with i as", "with recursive i as", 1) + """,
  e as (select game, chunk, cast(ga as bigint) as ga, cast(gb as bigint) as gb, row_number() over (partition by game, chunk order by dist + 5e-1 * gap, ga, gb) as i from c where dist <= least(450, 200 + 6 * gap)),
  z as (select game, chunk, list({'r': cast(tid as bigint), 'm': [cast(tid as bigint)], 'f': first, 'l': last, 't': team}) as gs from s
    where exists (select 1 from e where e.game = s.game and e.chunk = s.chunk and (e.ga = s.tid or e.gb = s.tid)) group by game, chunk),
  st as (select game, chunk, 0::bigint as i, gs, n from z join (select game, chunk, max(i) as n from e group by all) using (game, chunk) union all
    select game, chunk, i, case when a.r <> b.r and b.f > a.l and case when 'REF' in (coalesce(a.t, ''), coalesce(b.t, '')) then coalesce(a.t = b.t, false) else a.t is null or b.t is null or a.t = b.t end
      then list_append(list_filter(gs, lambda q: q.r <> a.r and q.r <> b.r), {'r': a.r, 'm': list_concat(a.m, b.m), 'f': a.f, 'l': b.l, 't': coalesce(a.t, b.t)}) else gs end, n
    from (select st.game, st.chunk, e.i, st.gs, st.n, list_filter(st.gs, lambda q: list_contains(q.m, e.ga))[1] as a, list_filter(st.gs, lambda q: list_contains(q.m, e.gb))[1] as b
      from st join e on st.game = e.game and st.chunk = e.chunk and e.i = st.i + 1)),
  u as (select game, chunk, unnest(gs) as q from st where i = n), v as (select game, chunk, q.r as canonical, unnest(q.m) as alias from u)
  select game, chunk, alias, canonical from v where alias <> canonical"""


@query("trk06_tracklet_merge", "game chunk alias canonical", "world", MERGE_SQL)
def _(spark, sf):
    f = fragments(spark, sf)
    return T.merge_tracklets(I.tracklet_candidates(f, ["game", "chunk"], "tid", max_gap=10), f, ["game", "chunk"], "tid")


LINK_SQL = """with recursive i as (select *, track_id * 1000 + sum(cut) over (partition by game, cam, track_id, chunk order by frame) as tid, case when pk % 3 = 0 then cast(floor(pk / 10) as bigint) % 4 end as jersey
     from (select *, case when frame - lag(frame) over (partition by game, cam, track_id, chunk order by frame) > 3 then 1 else 0 end as cut from trk)),
  v as (select game, cam, chunk, tid, jersey from i where jersey is not null group by game, cam, chunk, tid, jersey qualify row_number() over (partition by game, cam, chunk, tid order by count(*) desc, min(frame), jersey) = 1),
  r as (select *, row_number() over (partition by game, cam, chunk, tid order by frame desc) as rd, (x1 + x2) / 2 as px, (y1 + y2) / 2 as py from i),
  t0 as (select game, cam, chunk, tid, min(frame) as first, max(frame) as last, arg_min(class_id, frame) as cls, arg_min(px, frame) as fx, arg_min(py, frame) as fy, arg_max(px, frame) as lx, arg_max(py, frame) as ly,
     (arg_max(px, frame) - arg_min(px, frame) filter (where rd <= 8)) / greatest(1, least(count(*), 8) - 1) as vx, (arg_max(py, frame) - arg_min(py, frame) filter (where rd <= 8)) / greatest(1, least(count(*), 8) - 1) as vy from r group by game, cam, chunk, tid),
  t as (select * from t0 left join v using (game, cam, chunk, tid)),
  c as (select a.game, a.cam, a.chunk, a.tid as ga, b.tid as gb, a.jersey as na, b.jersey as nb, b.first - a.last as gap, sqrt(pow(a.lx + a.vx * least(b.first - a.last, 30) - b.fx, 2) + pow(a.ly + a.vy * least(b.first - a.last, 30) - b.fy, 2)) as dist
     from t a join t b on a.game = b.game and a.cam = b.cam and a.chunk = b.chunk and a.tid <> b.tid and a.cls = b.cls and b.first - a.last between 1 and 12 and not coalesce(a.jersey <> b.jersey, false)),
  e as (select *, row_number() over (partition by game, cam, chunk order by floor(dist * 1e6 + 5e-1), ga, gb) as i from c where dist <= least(60 + 6 * gap, 420)),
  g as (select game, cam, chunk, 0::bigint as i, []::bigint[] as ls, []::bigint[] as rs, []::struct(f bigint, l bigint, n bigint)[] as cs, max(i) as n from e group by all union all
     select game, cam, chunk, i, case when ok then list_append(ls, ga) else ls end, case when ok then list_append(rs, gb) else rs end,
       case when ok then list_append(list_filter(cs, lambda c: c.l <> ga and c.f <> gb), {'f': coalesce(ca.f, ga), 'l': coalesce(cb.l, gb), 'n': coalesce(va, vb)}) else cs end, n
     from (select *, not list_contains(ls, ga) and not list_contains(rs, gb) and not coalesce(va <> vb, false) as ok
       from (select *, coalesce(ca.n, na) as va, coalesce(cb.n, nb) as vb
         from (select g.game, g.cam, g.chunk, g.ls, g.rs, g.cs, g.n, e.i, e.ga, e.gb, e.na, e.nb, list_filter(g.cs, lambda c: c.l = e.ga)[1] as ca, list_filter(g.cs, lambda c: c.f = e.gb)[1] as cb
           from g join e on g.game = e.game and g.cam = e.cam and g.chunk = e.chunk and e.i = g.i + 1)))),
  k as (select game, cam, chunk, unnest(ls) as ga, unnest(rs) as gb from g where i = n)"""


def track_fragments(spark, sf):
    """Runs of a camera's track id inside a chunk, with the ends, velocity and committed number of each."""
    t = A.tracks(spark, sf).withColumn("px", G.Box.of().cx).withColumn("py", G.Box.of().cy)
    t = t.withColumn("jersey", F.expr("case when pk % 3 = 0 then cast(floor(pk / 10) as bigint) % 4 end"))
    i = S.islands(t, ["game", "cam", "track_id", "chunk"], "frame", 3).withColumn("tid", col("track_id") * 1000 + col("island"))
    return I.fragment_ends(i, ["game", "cam", "chunk"], "tid", number="jersey")


@query("trk07_fragment_links", "game cam chunk ga gb", "trk", LINK_SQL + " select * from k")
def _(spark, sf):
    return I.fragment_links(track_fragments(spark, sf), ["game", "cam", "chunk"], "tid", max_gap=12)


@query("trk07b_fragment_chains", "game cam chunk root fragments number", "trk", LINK_SQL + """,
  h as (select game, cam, chunk, tid, tid as root from t where not exists (select 1 from k where k.game = t.game and k.cam = t.cam and k.chunk = t.chunk and k.gb = t.tid) union all
    select k.game, k.cam, k.chunk, k.gb, h.root from h join k on h.game = k.game and h.cam = k.cam and h.chunk = k.chunk and h.tid = k.ga)
  select game, cam, chunk, root, count(*) as fragments, max(jersey) as number from h join t using (game, cam, chunk, tid) group by game, cam, chunk, root""")
def _(spark, sf):
    ends, keys = cut_lineage(track_fragments(spark, sf)), ["game", "cam", "chunk"]
    roots = LK.chain_roots(ends, I.fragment_links(ends, keys, "tid", max_gap=12), keys, "tid")
    return roots.join(ends.select(*keys, "tid", "number"), [*keys, "tid"]).groupBy(*keys, "root").agg(F.count(F.lit(1)).alias("fragments"), F.max("number").alias("number"))


@query("trk08_iou_tracker", "game cam chunk frame det_idx track_id")
def _(spark, sf):
    return T.iou_tracker(A.detections(spark, sf).filter("class_id < 2"), confirm=2)


@query("trk08b_iou_tracks_of_a_game", "game cam frame det_idx track_id")
def _(spark, sf):
    return WH.iou_tracks(A.detections(spark, sf).filter("class_id < 2"), length=A.CHUNK, before=60, confirm=2)


CLAIM_SQL = f"""with p as (select t.game, t.cam, t.frame, t.track_id, r.num as label, r.score as conf, {IOU_SQL.replace('a.', 't.').replace('b.', 'r.')} as iou from trk t join det r on t.game = r.game and t.cam = r.cam and t.frame = r.frame
     where r.class_id = 0 and r.score >= 8e-1),
  b as (select * from p where iou >= 35e-2 qualify row_number() over (partition by game, cam, frame, label order by iou desc, track_id, conf desc) = 1),
  h as (select game, cam, frame, track_id, label from b qualify row_number() over (partition by game, cam, frame, track_id order by conf desc, cast(label as varchar) desc) = 1),
  o as (select t.*, last_value(h.label ignore nulls) over (partition by t.game, t.cam, t.chunk, t.track_id order by t.frame rows between unbounded preceding and current row) as label from trk t left join h using (game, cam, frame, track_id))
  select game, cam, frame, label, track_id from o where label is not null qualify row_number() over (partition by game, cam, frame, label order by score desc, track_id) = 1"""


@query("trk09_identity_claims", "game cam frame label track_id", "trk det", CLAIM_SQL)
def _(spark, sf):
    reads = A.detections(spark, sf).filter("class_id = 0")
    return I.claims(A.tracks(spark, sf), reads)


def looks(spark, sf):
    """Appearance by (game, gid): the mean of all vectors of the embeddings table that fall to one of 40 slots, as the look of
    an identity is the mean over its crops. Parts are summed as whole numbers, so the order of rows does not show."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("vec_id % 4 as game", "cast(floor(vec_id / 4) as bigint) % 10 as gid", "posexplode(embedding) as (at, v)")
    parts = e.filter("gid % 4 > 0").groupBy("game", "gid", "at").agg(F.sum(F.floor(col("v").cast("double") * 1e6)).alias("s"))
    mean = F.sort_array(F.collect_list(F.struct("at", "s")))
    return parts.groupBy("game", "gid").agg(F.transform(mean, lambda p: p["s"] / F.lit(1e6)).alias("reid"))


def tracklet_table(spark, sf):
    f = fragments(spark, sf).withColumn("slot", col("tid") % 10).join(looks(spark, sf).withColumnRenamed("gid", "slot"), ["game", "slot"], "left")
    number = F.when(col("n") >= 4, F.floor(col("tid") / 1000) % 7)
    return f.select("game", "chunk", col("tid").alias("gid"), "first", "last", col("first_xy.x").alias("x0"), col("first_xy.y").alias("y0"), col("last_xy.x").alias("x1"),
                    col("last_xy.y").alias("y1"), "team", number.cast("double").alias("number"), col("n").cast("double").alias("strength"), "reid")


@query("trk10_identity_chaining", "game chunk gid identity named")
def _(spark, sf):
    return T.chain_tracklets(tracklet_table(spark, sf), ["game", "chunk"], max_gap=1.0, speed=900.0)


@query("trk10b_identities_of_a_game", "game gid identity named")
def _(spark, sf):
    t = tracklet_table(spark, sf).withColumn("gid", col("chunk") * 1_000_000 + col("gid"))
    return WH.chained_tracklets(t, length=A.CHUNK, edge=60, max_gap=1.0, speed=900.0)


def anchored_rows(spark, sf):
    w = A.world(spark, sf).withColumn("anchor", F.when(col("cx") % 9 == 0, col("gid")).cast("double")).withColumn("reads", F.when(col("cy") % 2 == 0, 2).otherwise(1))
    w = w.withColumn("anchor_team", F.when(col("gid") % 2 == 0, "A").otherwise("B")).withColumn("slot", col("gid") % 10)
    w = w.join(looks(spark, sf).withColumnRenamed("gid", "slot"), ["game", "slot"], "left").drop("slot")
    return w.withColumn("oid", col("gid"))


@query("trk11_two_way_identities", "game chunk frame oid identity named")
def _(spark, sf):
    return T.two_way_identities(anchored_rows(spark, sf), ["game", "chunk"])


@query("trk11b_two_way_identities_of_a_game", "game frame oid identity named")
def _(spark, sf):
    return WH.two_way_names(anchored_rows(spark, sf), length=A.CHUNK, edge=60)


def numbered_segments(spark, sf):
    """Micro-tracklets of the court rows with span, look and number: two reads or more, 70 % of them alike."""
    w = A.world(spark, sf).withColumn("oid", col("gid"))
    own = ["cx", "cy", "jersey"]
    rows = T.micro_tracklets(w.select("game", "chunk", "frame", "oid", *own), ["game", "chunk"], stitch=250.0, keep=own).withColumnRenamed("tracklet", "gid")
    key = ["game", "chunk", "gid"]
    ends = [f(c, "frame").alias(f"{c[1]}{i}") for i, f in enumerate((F.min_by, F.max_by)) for c in ("cx", "cy")]
    # a segment's rows are dealt out once; counts by number and then the segments come from the same partitions
    by_number = rows.repartition(*key).groupBy(*key, "jersey").agg(
        F.count(F.lit(1)).alias("n"), F.min("frame").alias("first"), F.max("frame").alias("last"), F.min("oid").alias("oid"), *ends)
    read = F.when(col("jersey").isNotNull(), col("n"))
    seen = by_number.groupBy(*key).agg(
        *[F.min_by(c, "first").alias(c) for c in ("x0", "y0")], *[F.max_by(c, "last").alias(c) for c in ("x1", "y1")], (F.min("oid") % 10).alias("oid"),
        F.max_by("jersey", read).alias("jersey"), F.max(read).alias("votes"), F.coalesce(F.sum(read), F.lit(0)).alias("reads"),
        F.min("first").alias("first"), F.max("last").alias("last"))
    alike = (col("votes") >= 2) & (col("votes") / col("reads") >= 0.7)
    seen = seen.join(looks(spark, sf).withColumnRenamed("gid", "oid"), ["game", "oid"], "left")
    return seen.select(*key, "first", "last", "x0", "y0", "x1", "y1", F.lit(None).cast("string").alias("team"),
                       F.when(alike, col("jersey")).cast("double").alias("number"), col("reads").cast("double").alias("strength"), "reid")


@query("trk12_micro_tracklet_identities", "game chunk gid identity named")
def _(spark, sf):
    segments = cut_lineage(numbered_segments(spark, sf))
    worn = T.scaffolded(segments, T.number_wearers(segments, ["game", "chunk"], min_reads=5), ["game", "chunk"])
    return T.chain_tracklets(worn, ["game", "chunk"], max_gap=1.0, speed=900.0, slack=0, rounds=8, w_gap=0.12, w_dist=900.0, w_cos=0.8, floor_cm=120.0, min_cos=0.4)


@query("trk12b_number_wearers", "game chunk number wearers segments reads")
def _(spark, sf):
    segments = cut_lineage(numbered_segments(spark, sf))
    worn = T.number_wearers(segments, ["game", "chunk"], min_reads=5).join(segments.select("game", "chunk", "gid", "strength"), ["game", "chunk", "gid"])
    return worn.groupBy("game", "chunk", "number").agg(F.countDistinct("wearer").alias("wearers"), F.count(F.lit(1)).alias("segments"), F.sum("strength").alias("reads"))


READS_SQL = """with recursive o as (select game, num, chunk, cam * 1000 + det_idx as rid, frame, pk * 7 % 2144 * 1e0 as cx, sk * 131 % 1427 * 1e0 as cy,
    row_number() over (partition by game, num, chunk order by frame, cam * 1000 + det_idx, pk * 7 % 2144, sk * 131 % 1427) as i from streams),
  s as (select game, num, chunk, rid, frame, i, 1::bigint as pos, [{'f': frame, 'x': cx, 'y': cy}] as c from o where i = 1 union all
    select game, num, chunk, rid, frame, i, case when hit = 0 then len(c) + 1 else hit end, case when hit = 0 then list_append(c, {'f': frame, 'x': cx, 'y': cy})
      else list_transform(c, lambda q, k: case when k = hit then {'f': frame, 'x': cx, 'y': cy} else q end) end
    from (select o.*, s.c, coalesce(list_reduce(list_prepend({'d': 1e18, 'k': 0}, list_transform(s.c, lambda q, k: {'d':
        case when sqrt((q.x - o.cx) * (q.x - o.cx) + (q.y - o.cy) * (q.y - o.cy)) <= greatest(12e1, 9e3 * greatest(1, o.frame - q.f) / 2997e-2) then sqrt((q.x - o.cx) * (q.x - o.cx) + (q.y - o.cy) * (q.y - o.cy)) else 1e18 end,
        'k': k})), lambda x, y: case when y.d < x.d then y else x end).k, 0) as hit
      from s join o on s.game = o.game and s.num = o.num and s.chunk = o.chunk and o.i = s.i + 1))
  select game, num, chunk, rid, frame, pos - 1 as cluster from s qualify count(*) over (partition by game, num, chunk, pos) >= 15"""


@query("trk13_read_clusters", "game num chunk rid frame cluster", "streams", READS_SQL)
def _(spark, sf):
    r = A.stream_points(spark, sf).withColumn("rid", col("cam") * 1000 + col("det_idx"))
    return T.cluster_reads(r.select("game", "num", "chunk", "rid", "frame", "cx", "cy"), speed=9000.0, min_reads=15)


def joint_edges(spark, sf):
    w = A.world(spark, sf).select("game", "frame", col("gid").alias("left_id"), col("cx").alias("tx"), col("cy").alias("ty"))
    d = A.detections(spark, sf).filter("class_id < 2").selectExpr("game", "cam", "chunk", "frame", "det_idx as right_id", "num", "cast(pk * 7 % 2144 as double) as cx", "cast(sk * 131 % 1427 as double) as cy")
    e = w.join(d, ["game", "frame"]).withColumn("dist", G.distance(col("cx"), col("cy"), col("tx"), col("ty"))).filter("dist <= 300")
    return e.withColumn("cost", col("dist") - F.when(col("num") == col("left_id"), 150.0).otherwise(0.0))


@query("trk14_joint_assignment", "game cam frame left_id right_id cost:h")
def _(spark, sf):
    return T.assign_per_frame(joint_edges(spark, sf), ["game", "cam", "chunk"], "frame", "left_id", "right_id", "cost", dummy=300.0)


@query("trk14b_joint_assignment_cost", "game cam frame cost:h", "world det",
       """with recursive d as (select game, cam, frame, det_idx as right_id, num, cast(pk * 7 % 2144 as double) as cx, cast(sk * 131 % 1427 as double) as cy from det where class_id < 2),
    e as (select d.game, d.cam, d.frame, w.gid as left_id, d.right_id, sqrt(pow(d.cx - w.cx, 2) + pow(d.cy - w.cy, 2)) - case when d.num = w.gid then 150e0 else 0e0 end as cost
    from world w join d on w.game = d.game and w.frame = d.frame where sqrt(pow(d.cx - w.cx, 2) + pow(d.cy - w.cy, 2)) <= 300), """ + choice_sql(["game", "cam", "frame"], "300e0"))
def _(spark, sf):
    return T.cost_per_frame(joint_edges(spark, sf), ["game", "cam", "chunk"], "frame", "left_id", "right_id", "cost", 300.0, dummy=300.0)


def flagged(spark, sf):
    s = A.stream_points(spark, sf).withColumn("zone", (col("cam") + 1) / F.lit(4.0))
    r = A.detections(spark, sf).filter("class_id = 1").selectExpr(
        "game", "cam", "frame", "pk % 4 + 3 * (pk % 2) as read_num", "case when qty % 5 > 0 then kit end as read_kit", *[f"{c} as b_{c}" for c in ("x1", "y1", "x2", "y2")])
    s = s.withColumn("num", F.expr("num % 7"))
    return K.read_flags(s, r, 0.15)


A.CTES["flagged"] = (("streams", "det"), f"""select s.*, s.num % 7 as num7, cast(s.pk * 7 % 2144 as double) as cx, cast(s.sk * 131 % 1427 as double) as cy, (s.cam + 1) / 4e0 as zone, coalesce(f.flag, 0) as read from streams s left join
  (select * from (select a.game, a.cam, a.frame, a.sid, {IOU_SQL} as iou, case when b.pk % 4 + 3 * (b.pk % 2) = a.num % 7 then case when b.qty % 5 = 0 then 0 when b.kit = a.kit then 1 else -1 end else -1 end as flag
    from streams a join det b on a.game = b.game and a.cam = b.cam and a.frame = b.frame and b.class_id = 1) where iou >= 15e-2 qualify row_number() over (partition by game, cam, frame, sid order by iou desc, flag desc) = 1) f
  on s.game = f.game and s.cam = f.cam and s.frame = f.frame and s.sid = f.sid""")
TRUTH_SQL = """with i as (select *, frame - row_number() over (partition by game, sid, cam, chunk order by frame) as isl from flagged where read <> -1),
  c as (select * from (select *, max(case when read = 1 then 1 else 0 end) over (partition by game, sid, cam, chunk, isl) as hit from i) where hit = 1),
  m as (select *, median(cx) over w as mx, median(cy) over w as my from c window w as (partition by game, sid, frame)),
  d as (select *, sqrt((cx - mx) * (cx - mx) + (cy - my) * (cy - my)) as d from m), k as (select *, max((d <= 150)::int) over (partition by game, sid, frame) as any_ from d),
  t0 as (select game, sid, frame, sum(cx * zone) / sum(zone) as cx, sum(cy * zone) / sum(zone) as cy from k where d <= 150 or any_ = 0 group by all),
  t as (select * from t0 union all select game, sid, frame + i, cx + (nx - cx) * (i::double / gap), cy + (ny - cy) * (i::double / gap) from (select *, nf - frame as gap, unnest(range(1, nf - frame)) as i from
     (select *, lead(frame) over w as nf, lead(cx) over w as nx, lead(cy) over w as ny from t0 window w as (partition by game, sid order by frame)) where nf - frame between 2 and 20))"""
DPTS = "select game, cam, frame, det_idx, cast(pk * 7 % 2144 as double) as cx, cast(sk * 131 % 1427 as double) as cy, case when class_id = 1 then num % 7 end as read_num from det where class_id < 2"


def det_points(spark, sf):
    return A.detections(spark, sf).filter("class_id < 2").selectExpr(
        "game", "cam", "frame", "det_idx", "cast(pk * 7 % 2144 as double) as cx", "cast(sk * 131 % 1427 as double) as cy", "case when class_id = 1 then num % 7 end as read_num")


@query("trk15_cross_camera_correction", "game sid:s cam frame source:s det_idx", "flagged det", TRUTH_SQL + f""",
  n as (select t.game, t.sid, q.cam, t.frame, q.det_idx from t join ({DPTS}) q on q.game = t.game and q.frame = t.frame where sqrt((q.cx - t.cx) * (q.cx - t.cx) + (q.cy - t.cy) * (q.cy - t.cy)) < 180
    qualify row_number() over (partition by t.game, t.sid, q.cam, t.frame order by sqrt((q.cx - t.cx) * (q.cx - t.cx) + (q.cy - t.cy) * (q.cy - t.cy)), q.det_idx) = 1),
  o as (select coalesce(f.game, n.game) as game, coalesce(f.sid, n.sid) as sid, coalesce(f.cam, n.cam) as cam, coalesce(f.frame, n.frame) as frame, case when f.read = 1 then 'anchor' when n.det_idx is not null then 'nearest' else 'stream' end as source, n.det_idx as nd
    from flagged f full join n on f.game = n.game and f.sid = n.sid and f.cam = n.cam and f.frame = n.frame)
  select game, sid, cam, frame, source, case when source = 'nearest' then nd end as det_idx from o""")
def _(spark, sf):
    f = flagged(spark, sf)
    truth = K.truth_positions(f, "zone", 20, B)
    return K.correct_boxes(f, det_points(spark, sf), truth, [0, 1, 2, 3])


@query("trk16_drift_correction", "game sid:s cam frame source:s det_idx", "flagged det", f"""with u as (select *, zone * case when read = 1 then 2 else 1 end as tw from flagged where read <> -1),
  m as (select *, median(cx) over w as mx, median(cy) over w as my from u window w as (partition by game, sid, num7, frame)), d as (select *, sqrt((cx - mx) * (cx - mx) + (cy - my) * (cy - my)) as d from m),
  k as (select *, max((d <= 150)::int) over (partition by game, sid, num7, frame) as any_ from d), t as (select game, sid, num7, frame, sum(cx * tw) / sum(tw) as tx, sum(cy * tw) / sum(tw) as ty from k where d <= 150 or any_ = 0 group by all),
  l as (select t.*, c.cam from t cross join (select range as cam from range(4)) c where not exists (select 1 from u where u.game = t.game and u.sid = t.sid and u.cam = c.cam and u.frame = t.frame)),
  n as (select l.game, l.sid, l.cam, l.frame, q.det_idx, sqrt((q.cx - tx) * (q.cx - tx) + (q.cy - ty) * (q.cy - ty)) - case when q.read_num = l.num7 then 80e0 else 0e0 end as d from l join ({DPTS}) q on q.game = l.game and q.cam = l.cam and q.frame = l.frame)
  select game, sid, cam, frame, 'kept' as source, null::bigint as det_idx from u union all
  select game, sid, cam, frame, 'reacquired', det_idx from (select * from n where d < 180 qualify row_number() over (partition by game, sid, cam, frame order by d, det_idx) = 1)""")
def _(spark, sf):
    return K.drift_correction(flagged(spark, sf), det_points(spark, sf), "zone", [0, 1, 2, 3])


TIE_CANDS = """select w.game, w.frame, w.gid, d.cam * 32 + d.det_idx as det_idx, d.score, sqrt((w.cx - d.pk * 7 % 2144) * (w.cx - d.pk * 7 % 2144) + (w.cy - d.sk * 131 % 1427) * (w.cy - d.sk * 131 % 1427)) as dist
  from world w join det d on w.game = d.game and w.frame = d.frame where d.class_id < 2"""


@query("trk17_appearance_tie_break", "game frame gid det_idx score:k", "world det", f"""with c as (select * from ({TIE_CANDS}) where dist <= 300),
  g as (select game, frame, gid, list(dist order by dist)[1:2] as ds from c group by all having count(*) >= 2)
  select c.game, c.frame, c.gid, c.det_idx, c.score + 3e-1 * dist / 300 as score from c join g using (game, frame, gid) where ds[2] - ds[1] < 150 qualify row_number() over (partition by c.game, c.frame, c.gid order by c.score + 3e-1 * dist / 300, det_idx) = 1""")
def _(spark, sf):
    w = A.world(spark, sf).select("game", "frame", "gid", "cx", "cy")
    d = A.detections(spark, sf).filter("class_id < 2").selectExpr("game", "frame", "cam * 32 + det_idx as det_idx", "score", "cast(pk * 7 % 2144 as double) as rx", "cast(sk * 131 % 1427 as double) as ry")
    c = w.join(d, ["game", "frame"]).withColumn("dist", G.distance(col("cx"), col("cy"), col("rx"), col("ry")))
    return K.appearance_tie_break(c, ["game", "frame", "gid"], "det_idx", "dist", "score", 300.0, 150.0)


@query("trk18_reacquisition_scan", "game sid frame cx:h cy:h provisional", "obs", """with t as (select game, uid as sid, frame, cx, cy from obs where eid % 3 > 0), l as (select game, uid as sid, frame - frame % 5 as frame, cx, cy, cy / 1426 as own, cx / 2142 as other from obs),
  p as (select *, lag(frame) over (partition by game, sid order by frame) as pf from t), s as (select game, sid, unnest(range(pf + 5, frame, 5)) as frame from p where frame - pf > 240),
  h as (select s.game, s.sid, s.frame, arg_min(struct_pack(cx := cx, cy := cy), struct_pack(own := own, cx := cx, cy := cy)) as b from s join l on l.game = s.game and l.sid = s.sid and l.frame = s.frame where own < 5e-1 and other - own > 2e-2 group by all),
  a as (select game, sid, frame, cx, cy, 0 as provisional from t union all select game, sid, frame, b.cx, b.cy, 1 from h)
  select * from a union all select game, sid, frame + i, cx + (nx - cx) * (i::double / gap), cy + (ny - cy) * (i::double / gap), 2 from (select *, nf - frame as gap, unnest(range(1, nf - frame)) as i from
   (select *, lead(frame) over w as nf, lead(cx) over w as nx, lead(cy) over w as ny from a window w as (partition by game, sid order by frame)) where nf - frame between 2 and 30)""")
def _(spark, sf):
    o = A.observations(spark, sf).withColumn("sid", col("uid"))
    # the driver's observations fall on any minute; scanning starts at a truth frame + 5, so looks are placed on fives
    truth = o.filter("eid % 3 > 0").select("game", "sid", "frame", "cx", "cy")
    looks = o.selectExpr("game", "sid", "frame - frame % 5 as frame", "cx", "cy", "cy / 1426 as own", "cx / 2142 as other")
    return K.reacquire(truth, looks, 0.5, 240, 5, 0.02, 30, 4000)


@query("trk19_patch_apply", "game cam sid:s frame sid_from:s moved", "streams", """with p as (select game, cam, sid, min(frame) as f0, max(frame) as f1, concat('n', (num + 1) % 10, kit) as new from streams where num % 3 = 0 group by game, cam, chunk, sid, num, kit),
  r as (select s.game, s.cam, s.frame, coalesce(p.new, s.sid) as sid, s.sid as sid_from, (p.new is not null)::int as moved from streams s left join p on p.game = s.game and p.cam = s.cam and p.sid = s.sid and s.frame between p.f0 and p.f1)
  select * from r qualify row_number() over (partition by game, cam, sid, frame order by moved desc, sid_from desc) = 1""")
def _(spark, sf):
    s = A.streams(spark, sf)
    p = s.filter("num % 3 = 0").groupBy("game", "cam", "chunk", "sid", "num", "kit").agg(F.min("frame").alias("f0"), F.max("frame").alias("f1"))
    p = p.select("game", "cam", "sid", "f0", "f1", F.expr("concat('n', (num + 1) % 10, kit)").alias("new"))
    return I.apply_patches(s.select("game", "cam", "sid", "frame", "det_idx"), p, ["game", "cam"])


@query("trk20_fusion_grid_search", "config ids stable ghosts penalty:k")
def _(spark, sf):
    grid = [{"max_dist": d, "gate_cost": g} for d in (250.0, 400.0) for g in (4.0, 7.0)]
    out = cut_lineage(N.fusion_grid(player_groups(spark, sf), ["game", "chunk"], grid))      # read by several aggregates
    h = R.identity_health(out, ["config", "game", "chunk"], "gid", "frame", F.lit(False))
    s = h.groupBy("config").agg(F.sum("ids").alias("ids"), F.sum("stable").alias("stable"), F.sum("ghosts").alias("ghosts"))
    return s.withColumn("penalty", (col("ghosts") + F.abs(col("stable") - 10)) / col("ids")).orderBy("penalty", "config")


def tracker_pairs(spark, sf):
    d = A.detections(spark, sf)
    ours = d.filter("class_id = 0").select("game", "cam", "chunk", "frame", col("det_idx").alias("our_det"), (col("num")).alias("our_id"), "x1", "y1", "x2", "y2")
    theirs = d.filter("class_id = 1").select("game", "cam", "frame", col("det_idx").alias("their_det"), col("num").alias("their_id"), *[col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")])
    e = ours.join(theirs, ["game", "cam", "frame"]).withColumn("iou", G.iou(G.Box.of(), G.Box.of("b_"))).filter("iou >= 3e-1").withColumn("cost", 1 - col("iou"))
    m = T.assign_per_frame(e, ["game", "cam", "chunk"], "frame", "our_det", "their_det", "cost").select("game", "cam", "frame", col("left_id").alias("our_det"), col("right_id").alias("their_det"))
    ids = e.select("game", "cam", "frame", "our_det", "their_det", "our_id", "their_id")
    return ours, theirs, m.join(ids, ["game", "cam", "frame", "our_det", "their_det"])


@query("agg24_tracker_agreement", "game cam agree only_ours only_theirs count_mae:k flip_rate:k recall_ours:k recall_theirs:k")
def _(spark, sf):
    ours, theirs, pairs = tracker_pairs(spark, sf)
    return R.tracker_agreement(ours, theirs, pairs, ["game", "cam"])


@query("agg24b_agreement_counts", "game cam agree only_ours only_theirs count_mae:k recall_ours:k recall_theirs:k", "det",
       f"""with recursive e as (select a.game, a.cam, a.frame, a.det_idx as left_id, b.det_idx as right_id, 1 - {IOU_SQL} as cost
    from det a join det b on a.game = b.game and a.cam = b.cam and a.frame = b.frame and a.class_id = 0 and b.class_id = 1 where {IOU_SQL} >= 3e-1), """
       + choice_sql(["game", "cam", "frame"], "1e6").replace("select game, cam, frame, min(cost) as cost from st", ", p as (select game, cam, frame, any_value(n.n) - cast(floor(min(cost) / 1e6) as bigint) as p from st", 1)
       .replace("where i = n group by game, cam, frame", "where i = n group by game, cam, frame)") + """,
  c as (select game, cam, frame, sum((class_id = 0)::int) as a, sum((class_id = 1)::int) as b from det where class_id < 2 group by all), t as (select *, coalesce(p, 0) as q from c left join p using (game, cam, frame))
  select game, cam, sum(q) as agree, sum(a - q) as only_ours, sum(b - q) as only_theirs, avg(abs(a - b)) as count_mae, sum(q) / greatest(1, sum(a)) as recall_ours, sum(q) / greatest(1, sum(b)) as recall_theirs from t group by game, cam""")
def _(spark, sf):
    ours, theirs, pairs = tracker_pairs(spark, sf)
    return R.tracker_agreement(ours, theirs, pairs, ["game", "cam"])


@query("agg25_fused_parity", "game n_cons n_ours hits rmse:h long_tracks pure impurity:k recall:k precision:k")
def _(spark, sf):
    w = A.world(spark, sf)
    cons = V.consensus_people(A.tracks(spark, sf).selectExpr("game", "cam", "frame", "cast(pk * 7 % 2144 as double) as cx", "cast(sk * 131 % 1427 as double) as cy"), ["game", "frame"], 300.0)
    c = cons.withColumn("cid", F.row_number().over(S.runs_over(["game", "frame"], "cx"))).withColumn("chunk", F.floor(col("frame") / A.CHUNK).cast("long"))
    e = c.join(w.select("game", "frame", "gid", col("cx").alias("rx"), col("cy").alias("ry")), ["game", "frame"]).withColumn("cost", G.distance(col("cx"), col("cy"), col("rx"), col("ry"))).filter("cost <= 400")
    pairs = T.assign_per_frame(e, ["game", "chunk"], "frame", "cid", "gid", "cost").withColumnRenamed("cost", "dist")
    pts = A.stream_points(spark, sf).selectExpr("game", "frame", "concat(cam, sid) as foreign_id", "cx", "cy")
    near = J.nearest_point(pts, w.selectExpr("game", "frame", "gid", "cx as rx", "cy as ry"), ["game", "frame"], "foreign_id", "gid", 200.0)
    links = pts.select("game", "frame", "foreign_id").join(near.select("game", "frame", "foreign_id", "gid"), ["game", "frame", "foreign_id"], "left")
    return R.parity(cons, w, pairs, links, ["game"], 30, 20)


@query("win32_contact_bursts", "game cam frame track_id hot", "trk", f"""with c as (select distinct game, cam, frame, t from (select a.game, a.cam, a.frame, unnest([a.track_id, b.track_id]) as t from trk a join trk b on a.game = b.game and a.cam = b.cam and a.frame = b.frame and a.track_id < b.track_id where {IOU_SQL} >= 3e-1))
  select t.game, t.cam, t.frame, t.track_id, (count(c.t) > 0)::int as hot from trk t left join c on c.game = t.game and c.cam = t.cam and c.t = t.track_id and c.frame between t.frame - 5 and t.frame group by all""")
def _(spark, sf):
    return S.contact_bursts(A.tracks(spark, sf), "track_id", 0.3, 5, B)


@query("win09_stride2_reconstruction", "game cam frame class_id x1:h y2:h score:k", "det", f"""with recursive e as materialized (select a.game, a.cam, a.frame, a.class_id, (a.x1 + b.x1) / 2 as x1, (a.y2 + b.y2) / 2 as y2, least(a.score, b.score) as score, a.det_idx as l, b.det_idx as r, row_number() over (partition by a.game, a.cam, a.frame order by a.det_idx, {IOU_SQL} desc, b.det_idx) as i
     from det a join det b on a.game = b.game and a.cam = b.cam and b.frame = a.frame + 2 and a.class_id = b.class_id and a.frame % 2 = 0 where {IOU_SQL} > 3e-1),
  g as (select game, cam, frame, 0::bigint as i, []::bigint[] as ls, []::bigint[] as rs, max(i) as n from e group by all union all
     select g.game, g.cam, g.frame, e.i, case when list_contains(ls, l) or list_contains(rs, r) then ls else list_append(ls, l) end, case when list_contains(ls, l) or list_contains(rs, r) then rs else list_append(rs, r) end, n
     from g join e on g.game = e.game and g.cam = e.cam and g.frame = e.frame and e.i = g.i + 1),
  m as (select game, cam, frame, unnest(ls) as l, unnest(rs) as r from g where i = n)
  select game, cam, frame, class_id, x1, y2, score from det where frame % 2 = 0 union all
  select e.game, e.cam, e.frame + 1, class_id, x1, y2, score from e join m using (game, cam, frame, l, r)""")
def _(spark, sf):
    return S.stride2(A.detections(spark, sf), 0.3)


# balls of all cameras on the court and on the reference clock; fused, without cells that are occupied most of a chunk, and tracked
A.CTES["balls_on_court"] = (("det", "calib", "offs"), f"""select p.game, p.cam, p.frame - off as frame, p.score * (p.cam + 1) / 4e0 as score, cx, cy
  from ({COURT_SQL.replace("y2 as v from raw", "(y1 + y2) / 2 as v from det where class_id = 2")}) p join offs o on p.game = o.game and p.cam = o.cam
  where cx between -500 and 26437e-1 and cy between -500 and 19264e-1""")
TRACE_SQL = BALL_SQL.replace("from bpts", "from balls_on_court").replace("with recursive fused as (", "with recursive fz as (", 1).replace(">= 2e-1", ">= 5e-1").replace("""),
  l as (select game,""", f"""),
  gz as (select *, cast(floor(frame / {A.CHUNK}) as bigint) as chunk, cast(round_even(cx / 80e0, 0) as bigint) as gx, cast(round_even(cy / 80e0, 0) as bigint) as gy from fz),
  sz as (select game, chunk, max(frame) - min(frame) + 1 as span from gz group by all),
  bz as (select game, chunk, gx, gy from gz join sz using (game, chunk) group by all having count(distinct frame) / any_value(span) > 35e-2),
  fused as (select game, frame, cx, cy, score, n_cams from gz where not exists (select 1 from bz where bz.game = gz.game and bz.chunk = gz.chunk and bz.gx = gz.gx and bz.gy = gz.gy)),
  l as (select game,""", 1)


@query("evt27_multicamera_ball_trace", "game chunk frame bx:h by_:h", "balls_on_court", TRACE_SQL)
def _(spark, sf):
    from courtloom.operators import sync
    pts = A.detections(spark, sf).filter("class_id = 2").withColumn("u", G.Box.of().cx).withColumn("v", G.Box.of().cy)
    court = pts.join(F.broadcast(A.calibration(spark)), "cam")
    cx, cy = G.pixel_to_court(col("u"), col("v"))
    placed = court.withColumn("cx", cx).withColumn("cy", cy).filter(G.on_court(col("cx"), col("cy"), 500.0))
    ref = sync.align(placed.withColumn("score", col("score") * (col("cam") + 1) / F.lit(4.0)), A.offsets(spark)).withColumn("frame", col("ref"))
    ref = ref.withColumn("chunk", F.floor(col("frame") / A.CHUNK).cast("long"))
    fused = V.fuse_ball_candidates(ref, ["game", "chunk", "frame"])
    kept = V.reject_stationary(fused, ["game", "chunk"], "frame", "cx", "cy")
    return T.track_ball(kept, strong=0.5).withColumnRenamed("by", "by_")
