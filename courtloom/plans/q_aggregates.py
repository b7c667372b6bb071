"""Aggregations, votes and scorecards over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtloom import constants as C
from courtloom.functions import geometry as G
from courtloom.functions import vectors as V
from courtloom.operators import identity as I
from courtloom.operators import joins as J
from courtloom.operators import ordered as O
from courtloom.operators import scoring as R
from courtloom.operators import shots as H
from courtloom.operators import votes as T
from courtloom.plans import adapters as A
from courtloom.plans.q_columns import DIST_SQL, IOU_SQL
from courtloom.plans.q_joins import COURT_TRK, ISO_SQL, isolated_pairs
from courtloom.plans.registry import query

col = F.col
B = A.BLOCK


@query("agg01_best_detection", "game cam frame class_id det_idx score:k", "det",
       "select * from det qualify row_number() over (partition by game, cam, frame, class_id order by score desc, det_idx) = 1")
def _(spark, sf):
    best = O.best_per(A.detections(spark, sf).withColumn("first", -col("det_idx")), ["game", "cam", "frame", "class_id"],
                      ["score", "first"], ["score", "det_idx"])
    return best


@query("agg02_median_rim", "game cam rx1:h ry1:h rx2:h ry2:h", "det",
       "select game, cam, median(x1) as rx1, median(y1) as ry1, median(x2) as rx2, median(y2) as ry2 from det where class_id = 1 group by all")
def _(spark, sf):
    return H.rim_median(A.detections(spark, sf).filter("class_id = 1"), ["game", "cam"])


@query("agg03_majority_class", "game cam track_id class_id votes total", "trk",
       """select game, cam, track_id, class_id, c as votes, total from (select *, sum(c) over (partition by game, cam, track_id) as total from
          (select game, cam, track_id, class_id, count(*) as c, min(frame) as f from trk group by all))
          qualify row_number() over (partition by game, cam, track_id order by c desc, f, class_id desc) = 1""")
def _(spark, sf):
    return T.modal(A.tracks(spark, sf), ["game", "cam", "track_id"], "class_id", "frame")


@query("agg04_committed_number", "game cam track_id chunk num votes total", "trk",
       """select game, cam, track_id, chunk, case when c >= 2 and c / total >= 6e-1 then num end as num, c as votes, total from
          (select *, sum(c) over (partition by game, cam, track_id, chunk) as total from
          (select game, cam, track_id, chunk, qty % 2 as num, count(*) as c, min(frame) as f from trk group by all))
          qualify row_number() over (partition by game, cam, track_id, chunk order by c desc, f, num desc) = 1""")
def _(spark, sf):
    t = A.tracks(spark, sf).drop("num").withColumn("num", col("qty") % 2)
    return T.committed_mode(t, ["game", "cam", "track_id", "chunk"], "num", "frame")


@query("agg05_confidence_vote", "game cam track_id number weight reads", "trk",
       """with s as (select game, cam, track_id, qty % 5 as number, sum(floor(score * 1000 + 5e-1)) as s, count(*) as n from trk where score >= 6e-1 group by all)
          select game, cam, track_id, number, s as weight, reads from (select *, sum(n) over (partition by game, cam, track_id) as reads from s) where reads >= 2
          qualify row_number() over (partition by game, cam, track_id order by s desc, number) = 1""")
def _(spark, sf):
    t = A.tracks(spark, sf).withColumn("number", col("qty") % 5)
    return T.confidence_vote(t, ["game", "cam", "track_id"], "number", "score")


@query("agg06_decayed_vote", "game gid chunk team:s votes:k total:k locked", "world",
       """with recursive r as (select game, gid, chunk, case when frame % 11 = 0 then null when frame % 3 = 0 then 'B' else 'A' end as v, cam / 4e0 + 25e-2 as w,
             row_number() over (partition by game, gid, chunk order by frame) as i, count(*) over (partition by game, gid, chunk) as n from world),
          s as (select game, gid, chunk, 0::bigint as i, n, 0e0::double as a, 0e0::double as b, 0::bigint as fa, 0::bigint as fb from r where i = 1 union all
             select s.game, s.gid, s.chunk, r.i, s.n,
               case when a * 98e-2 >= 1e-2 then a * 98e-2 else 0e0 end + case when v = 'A' then w else 0e0 end,
               case when b * 98e-2 >= 1e-2 then b * 98e-2 else 0e0 end + case when v = 'B' then w else 0e0 end,
               case when a * 98e-2 >= 1e-2 then fa when v = 'A' then r.i else fa end, case when b * 98e-2 >= 1e-2 then fb when v = 'B' then r.i else fb end
             from s join r on s.game = r.game and s.gid = r.gid and s.chunk = r.chunk and r.i = s.i + 1),
          l as (select *, greatest(a, b) as top, a + b as total, case when a > b or (a = b and fa < fb) then 'A' else 'B' end as t from s where i = n)
          select game, gid, chunk, case when top >= 3 then t end as team, top as votes, total, case when total >= 10 and top / total >= 8e-1 then 1 else 0 end as locked from l""")
def _(spark, sf):
    w = A.world(spark, sf).drop("team").withColumn("team", F.expr("case when frame % 11 = 0 then null when frame % 3 = 0 then 'B' else 'A' end")).withColumn("w", col("cam") / 4 + 0.25)
    return T.decayed_vote(w, ["game", "gid", "chunk"], "frame", "team", "w")


TRKXY = f"(select {', '.join(COURT_TRK)}, score from trk)"


@query("agg07_weighted_centroid", "game frame track_id cx:k cy:k n", "trk",
       f"""select game, frame, track_id, sum(cx * w) / sum(w) + 1e-7 as cx, sum(cy * w) / sum(w) + 1e-7 as cy, count(*) as n from (select *, greatest(score * (cam + 1) / 4e0, 1e-3) as w from {TRKXY}) group by all""")
def _(spark, sf):
    t = A.tracks(spark, sf).selectExpr(*COURT_TRK, "score")
    return T.weighted_centroid(t, ["game", "frame", "track_id"], "cx", "cy", col("score") * (col("cam") + 1) / F.lit(4.0)).withColumn("cx", col("cx") + 1e-7).withColumn("cy", col("cy") + 1e-7)


@query("agg08_consensus_point", "game frame track_id cx:k cy:k kept", "trk",
       f"""with m as (select *, median(cx) over w as mx, median(cy) over w as my from {TRKXY} window w as (partition by game, frame, track_id)),
          d as (select *, sqrt((cx - mx) * (cx - mx) + (cy - my) * (cy - my)) as d from m),
          k as (select *, max(case when d <= 150 then 1 else 0 end) over (partition by game, frame, track_id) as any_ from d)
          select game, frame, track_id, sum(cx * score) / sum(score) + 1e-7 as cx, sum(cy * score) / sum(score) + 1e-7 as cy, count(*) as kept from k where d <= 150 or any_ = 0 group by all""")
def _(spark, sf):
    return T.consensus_point(A.tracks(spark, sf).selectExpr(*COURT_TRK, "score"), ["game", "frame", "track_id"], "cx", "cy", "score").withColumn("cx", col("cx") + 1e-7).withColumn("cy", col("cy") + 1e-7)


def court_observations(spark, sf):
    team = "case when class_id = 1 then 'REF' when pk % 3 = 0 then null when pk % 3 = 1 then 'A' else 'B' end as team"
    return A.tracks(spark, sf).selectExpr(
        "game", "cam", "frame", "chunk", "track_id", team, "case when pk % 4 = 0 then track_id end as jersey", "score", "(cam + 1) / 4e0 as zone_conf",
        "cast(pk * 7 % 900 as double) as cx", "cast(sk * 131 % 600 as double) as cy")


def _mode_sql(values: str, empty: str) -> str:
    """Most frequent of the non-empty values, the first of equals."""
    known = f"list_filter({values}, lambda z: z <> {empty})"
    counts = f"list_transform({known}, lambda v: len(list_filter({known}, lambda z: z = v)))"
    return f"{known}[list_position({counts}, list_max({counts}))]"


CLUSTER_SQL = f"""with recursive o as (select *, row_number() over (partition by game, frame order by -score, cam, track_id) as i, count(*) over (partition by game, frame) as n from
    (select game, frame, cam, track_id, score, case when class_id = 1 then 'REF' when pk % 3 = 0 then '' when pk % 3 = 1 then 'A' else 'B' end as team, case when pk % 4 = 0 then track_id else -1 end as j,
      greatest((cam + 1) / 4e0 * score, 1e-3) as w, pk * 7 % 900 * 1e0 as x, sk * 131 % 600 * 1e0 as y from trk)),
  s as (select game, frame, i, n, [{{'cams': [cam], 'teams': [team], 'js': [j], 'wx': x * w, 'wy': y * w, 'w': w}}] as c from o where i = 1 union all
    select game, frame, i, n, case when pos = 0 then list_append(c, {{'cams': [cam], 'teams': [team], 'js': [j], 'wx': x * w, 'wy': y * w, 'w': w}}) else
      list_transform(c, lambda q, k: case when k = pos then {{'cams': list_append(q.cams, cam), 'teams': list_append(q.teams, team), 'js': list_append(q.js, j), 'wx': q.wx + x * w, 'wy': q.wy + y * w, 'w': q.w + w}} else q end) end
    from (select o.*, s.c, coalesce(list_reduce(list_prepend({{'d': 25e1, 'k': 0}}, list_transform(list_transform(s.c, lambda q: {{'q': q, 't': {_mode_sql('q.teams', "''")}, 'j': {_mode_sql('q.js', '-1')},
          'd': sqrt((o.x - q.wx / q.w) * (o.x - q.wx / q.w) + (o.y - q.wy / q.w) * (o.y - q.wy / q.w))}}),
        lambda q, k: {{'d': case when list_contains(q.q.cams, o.cam) or coalesce(o.team <> '' and o.team <> q.t and not ((o.team = 'REF' or q.t = 'REF') and q.d <= 80), false) or coalesce(o.j <> -1 and o.j <> q.j, false) then 1e9 else q.d end, 'k': k}})),
        lambda a, b: case when b.d <= a.d then b else a end).k, 0) as pos
      from s join o on s.game = o.game and s.frame = o.frame and o.i = s.i + 1)),
  u as (select game, frame, unnest(range(0, len(c))) as group_id, unnest(c) as q from s where i = n)
  select game, frame, group_id, q.wx / q.w as cx, q.wy / q.w as cy, {_mode_sql('q.teams', "''")} as team, {_mode_sql('q.js', '-1')} as jersey, len(q.cams) as n_cams from u"""


@query("agg09_player_clusters", "game frame group_id cx:k cy:k team:s jersey n_cams", "trk", CLUSTER_SQL)
def _(spark, sf):
    return T.cluster_players(court_observations(spark, sf), ["game", "frame"], 250.0, members=False)


def ball_points(spark, sf):
    return A.detections(spark, sf).filter("class_id = 2").selectExpr(
        "game", "cam", "frame", "chunk", "score", "det_idx", "cast(pk * 7 % 900 as double) as cx", "cast(sk * 131 % 600 as double) as cy")


A.CTES["bpts"] = (("det",), "select game, cam, frame, chunk, score, det_idx, cast(pk * 7 % 900 as double) as cx, cast(sk * 131 % 600 as double) as cy from det where class_id = 2")
FUSE_BALL_SQL = """with recursive o as (select game, frame, cam, cx, cy, score, row_number() over (partition by game, frame order by score desc, cam, cx, cy) as i, count(*) over (partition by game, frame) as n from bpts),
  s as (select game, frame, 0::bigint as i, n, []::struct(cams bigint[], wx double, wy double, w double)[] as c from o where i = 1 union all
    select game, frame, i, n, case when pos = 0 then list_append(c, {'cams': [cam], 'wx': cx * score, 'wy': cy * score, 'w': score}) else
      list_transform(c, lambda q, k: case when k = pos then {'cams': list_append(q.cams, cam), 'wx': q.wx + cx * score, 'wy': q.wy + cy * score, 'w': q.w + score} else q end) end
    from (select s.game, s.frame, o.i, s.n, s.c, o.cam, o.cx, o.cy, o.score,
      coalesce(list_reduce(list_prepend({'d': 200e0, 'k': 0}, list_transform(s.c, lambda q, k: {'d': case when list_contains(q.cams, o.cam) then 1e9
         else sqrt((o.cx - q.wx / q.w) * (o.cx - q.wx / q.w) + (o.cy - q.wy / q.w) * (o.cy - q.wy / q.w)) end, 'k': k})),
         lambda x, y: case when y.d <= x.d then y else x end).k, 0) as pos
      from s join o on s.game = o.game and s.frame = o.frame and o.i = s.i + 1)),
  u as (select game, frame, unnest(c) as q from s where i = n)
  select game, frame, q.wx / q.w as cx, q.wy / q.w as cy, q.w * (1e0 + 6e-1 * (len(q.cams) - 1)) as score, len(q.cams) as n_cams from u"""


@query("agg10_ball_candidate_fusion", "game frame cx:k cy:k score:k n_cams", "bpts", FUSE_BALL_SQL)
def _(spark, sf):
    return T.fuse_ball_candidates(ball_points(spark, sf), ["game", "frame"])


@query("agg11_consensus_people", "game frame cx:k cy:k n n_cams", "trk",
       f"""with recursive o as (select game, frame, cam, cx, cy, row_number() over (partition by game, frame order by cam, cx, cy) as i, count(*) over (partition by game, frame) as n from {TRKXY}),
          s as (select game, frame, 0::bigint as i, n, []::struct(cams bigint[], sx double, sy double, n double)[] as c from o where i = 1 union all
             select game, frame, i, n, case when pos = 0 then list_append(c, {{'cams': [cam], 'sx': cx, 'sy': cy, 'n': 1e0}}) else
               list_transform(c, lambda q, k: case when k = pos then {{'cams': list_append(q.cams, cam), 'sx': q.sx + cx, 'sy': q.sy + cy, 'n': q.n + 1}} else q end) end
             from (select s.game, s.frame, o.i, s.n, s.c, o.cam, o.cx, o.cy,
               coalesce(list_position(list_transform(s.c, lambda q: not list_contains(q.cams, o.cam) and sqrt((o.cx - q.sx / q.n) * (o.cx - q.sx / q.n) + (o.cy - q.sy / q.n) * (o.cy - q.sy / q.n)) <= 120), true), 0) as pos
               from s join o on s.game = o.game and s.frame = o.frame and o.i = s.i + 1)),
          u as (select game, frame, unnest(c) as q from s where i = n)
          select game, frame, q.sx / q.n as cx, q.sy / q.n as cy, q.n as n, len(list_distinct(q.cams)) as n_cams from u where len(list_distinct(q.cams)) >= 2""")
def _(spark, sf):
    return T.consensus_people(A.tracks(spark, sf).selectExpr(*COURT_TRK), ["game", "frame"])


@query("agg12_median_ball_fusion", "game frame cx:h cy:h", "ball",
       "select game, frame, median(ball_x) as cx, median(ball_y) as cy from ball group by all")
def _(spark, sf):
    return T.median_fusion(A.ball(spark, sf), ["game", "frame"], "ball_x", "ball_y")


STATIC_SQL = """with g as (select *, cast(round_even(cx / 80e0, 0) as bigint) as gx, cast(round_even(cy / 80e0, 0) as bigint) as gy from bpts),
  s as (select game, chunk, max(frame) - min(frame) + 1 as span from bpts group by all),
  b as (select game, chunk, gx, gy, count(distinct frame) as frames, span from g join s using (game, chunk) group by all having count(distinct frame) / span > 4e-2)"""


@query("agg13_stationary_cells", "game chunk gx gy frames span", "bpts", STATIC_SQL + " select * from b")
def _(spark, sf):
    return T.stationary_cells(ball_points(spark, sf), ["game", "chunk"], "frame", "cx", "cy", max_occupancy=0.04)


@query("agg13b_reject_stationary", "game cam frame det_idx", "bpts",
       STATIC_SQL + " select g.* from g where not exists (select 1 from b where b.game = g.game and b.chunk = g.chunk and b.gx = g.gx and b.gy = g.gy)")
def _(spark, sf):
    return T.reject_stationary(ball_points(spark, sf), ["game", "chunk"], "frame", "cx", "cy", max_occupancy=0.04)


LOGO_SQL = """with recursive o as (select game, cam, chunk, frame, cx, cy, row_number() over (partition by game, cam, chunk order by frame, cx, cy) as i, count(*) over (partition by game, cam, chunk) as n from bpts),
  s as (select game, cam, chunk, 1::bigint as i, n, [{'x': cx, 'y': cy}] as c from o where i = 1 union all
    select s.game, s.cam, s.chunk, o.i, s.n, case when list_contains(list_transform(s.c, lambda q: sqrt((o.cx - q.x) * (o.cx - q.x) + (o.cy - q.y) * (o.cy - q.y)) <= 60), true) then s.c
      else list_append(s.c, {'x': o.cx, 'y': o.cy}) end from s join o on s.game = o.game and s.cam = o.cam and s.chunk = o.chunk and o.i = s.i + 1),
  m as (select o.*, list_position(list_transform(s.c, lambda q: sqrt((o.cx - q.x) * (o.cx - q.x) + (o.cy - q.y) * (o.cy - q.y)) <= 60), true) as cluster
    from o join s on s.game = o.game and s.cam = o.cam and s.chunk = o.chunk and s.i = s.n),
  t as (select *, sqrt(pow(cx - lag(cx) over w, 2) + pow(cy - lag(cy) over w, 2)) as step from m window w as (partition by game, cam, chunk, cluster order by frame, cx, cy)),
  p as (select game, cam, chunk, max(frame) - min(frame) + 1 as span from bpts group by all)
  select game, cam, chunk, cluster, count(distinct frame) as frames, count(*) as points, count(distinct frame) / any_value(span) > 6e-2 and coalesce(median(step), 0) < 40 as is_static
  from t join p using (game, cam, chunk) group by game, cam, chunk, cluster"""


@query("agg14_static_logos", "game cam chunk cluster frames points is_static", "bpts", LOGO_SQL)
def _(spark, sf):
    return T.static_logos(ball_points(spark, sf), ["game", "cam", "chunk"], "frame", "cx", "cy", 60.0, 0.06, 40.0)


@query("agg15_track_summary", "game cam ids observations min_len median_len max_len frames per_frame:k", "trk",
       """with l as (select game, cam, track_id * 40 + chunk as t, count(*) as len from trk group by all), f as (select game, cam, count(distinct frame) as frames from trk group by all),
          r as (select *, row_number() over (partition by game, cam order by len) as rn, count(*) over (partition by game, cam) as n from l)
          select game, cam, count(*) as ids, sum(len) as observations, min(len) as min_len, max(case when rn = cast(floor(n / 2) as bigint) + 1 then len end) as median_len, max(len) as max_len,
            any_value(frames) as frames, sum(len) / any_value(frames) as per_frame from r join f using (game, cam) group by all""")
def _(spark, sf):
    t = A.tracks(spark, sf).withColumn("track_id", F.expr("track_id * 40 + chunk"))
    return R.track_summary(t, ["game", "cam"], "track_id", "frame")


@query("agg16_identity_health", "game chunk frames ids stable ghosts late_born ppf_median:k ppf_mean:k over13:k under11:k coasting_rate:k", "world",
       """with f as (select game, chunk, frame, count(distinct gid) as ppf, count(*) as rows_, sum(case when cam = 0 then 1 else 0 end) as coast from world group by all),
          p as (select *, row_number() over (partition by game, chunk order by frame) as r, count(*) over (partition by game, chunk) as n from f),
          a as (select game, chunk, max(n) as frames, sum(rows_) as rows_, sum(coast) as coast, median(case when r > 15 and r <= n - 15 then ppf end) as ppf_median,
             avg(case when r > 15 and r <= n - 15 then ppf end) as ppf_mean, avg(case when r > 15 and r <= n - 15 then (case when ppf > 13 then 1e0 else 0e0 end) end) as over13,
             avg(case when r > 15 and r <= n - 15 then (case when ppf < 11 then 1e0 else 0e0 end) end) as under11 from p group by all),
          l as (select game, chunk, gid, count(*) as life, min(frame) as born from world group by all)
          select a.game, a.chunk, frames, count(*) as ids, sum(case when life >= 5e-1 * frames then 1 else 0 end) as stable, sum(case when life < 1e-1 * frames then 1 else 0 end) as ghosts,
            sum(case when born > 5e-1 * frames then 1 else 0 end) as late_born, ppf_median, ppf_mean, over13, under11, coast / rows_ as coasting_rate from l join a using (game, chunk) group by all""")
def _(spark, sf):
    return R.identity_health(A.world(spark, sf), ["game", "chunk"], "gid", "frame", col("cam") == 0)


@query("agg17_roster_check", "game read on_roster hallucinated", "raw roster",
       """with m as (select distinct game, pk % 90 as num from raw), k as (select distinct num, 1 as ok from roster)
          select game, count(*) as read, count(ok) as on_roster, sum(case when ok is null then 1 else 0 end) as hallucinated from m left join k using (num) group by all""")
def _(spark, sf):
    r = A.raw_detections(spark, sf).drop("num").withColumn("num", col("pk") % 90)
    return R.roster_check(r, A.roster(spark, sf), ["game"], "num")


@query("agg18_precision_recall", "game chunk precision:k recall:k f1:k", "plays cv",
       """with c as (select game, cast(floor(t / 86400) as bigint) as chunk, count(*) as n_gt, sum(case when k % 3 = 0 then 1 else 0 end) as tp from plays group by all),
          d as (select game, cast(floor(t / 86400) as bigint) as chunk, count(*) as n_cv from cv group by all),
          p as (select game, chunk, coalesce(n_gt, 0) as n_gt, coalesce(n_cv, 0) as n_cv, least(coalesce(tp, 0), coalesce(n_cv, 0)) as tp from c full join d using (game, chunk)),
          q as (select *, case when n_cv > 0 then tp / n_cv when n_gt = 0 then 1 else 0 end as precision, case when n_gt > 0 then tp / n_gt else 1 end as recall from p)
          select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1 from q""")
def _(spark, sf):
    day = "cast(floor(t / 86400) as bigint) as chunk"
    c = A.plays(spark, sf).selectExpr("game", day, "k").groupBy("game", "chunk").agg(F.count(F.lit(1)).alias("n_gt"), R.count_if(col("k") % 3 == 0).alias("tp"))
    d = A.cv_events(spark, sf).selectExpr("game", day).groupBy("game", "chunk").agg(F.count(F.lit(1)).alias("n_cv"))
    return R.prf(c.join(d, ["game", "chunk"], "full").na.fill(0).withColumn("tp", F.least("tp", "n_cv")))


@query("agg19_possession_agreement", "game n same swap mapping:s accuracy:k", "cand",
       """with p as (select game, case when cand in ('click', 'view') then 'A' when cand in ('purchase', 'error') then 'B' else 'loose' end as gt,
             case when frame % 4 = 0 then 'loose' when frame % 3 = 0 then 'A' else 'B' end as derived from cand)
          select game, count(*) as n, sum(case when gt = derived then 1 else 0 end) as same, sum(case when gt = case derived when 'A' then 'B' when 'B' then 'A' else derived end then 1 else 0 end) as swap,
            case when same >= swap then 'identity' else 'swapped' end as mapping, greatest(same, swap) / n as accuracy from p group by game""")
def _(spark, sf):
    p = A.candidates(spark, sf).selectExpr(
        "game", "case when cand in ('click', 'view') then 'A' when cand in ('purchase', 'error') then 'B' else 'loose' end as gt",
        "case when frame % 4 = 0 then 'loose' when frame % 3 = 0 then 'A' else 'B' end as derived")
    return R.possession_agreement(p, ["game"])


SCORE_SQL = """with m as (select p.game, p.play_id, p.k, p.uid, c.uid as cu, c.k as ck from plays p left join cv c on p.game = c.game and abs(c.t - p.t) <= 1800
     qualify row_number() over (partition by p.game, p.play_id order by abs(c.t - p.t), c.t, c.eid) = 1),
  x as (select case k % 3 when 0 then 'FG' when 1 then '3PT' else '4PT' end as cls, ck is not null as det, uid % 3 = cu % 3 as w, k % 2 = ck % 2 as z, (k % 5 < 3) = (ck % 5 < 3) as mm from m)
  select cls, count(*) as n, sum(case when det then 1 else 0 end) as detected, sum(case when det and w then 1 else 0 end) as who, sum(case when det and z then 1 else 0 end) as zone,
   sum(case when det and mm then 1 else 0 end) as make_miss, sum(case when det and w and z and mm then 1 else 0 end) as all_correct from x group by rollup (cls)"""


def matched_plays(spark, sf):
    m = J.nearest_in_time(A.plays(spark, sf), A.cv_events(spark, sf), ["game"], "t", ["eid", "uid", "k", "rq"], 1800)
    return m.select("game", "play_id", "k", "uid", "t", "m_k", "m_uid", "m_rq", "dt", F.expr("case k % 3 when 0 then 'FG' when 1 then '3PT' else '4PT' end").alias("cls"),
                    col("m_k").isNotNull().alias("detected"), (col("uid") % 3 == col("m_uid") % 3).alias("who_ok"),
                    (col("k") % 2 == col("m_k") % 2).alias("zone_ok"), ((col("k") % 5 < 3) == (col("m_k") % 5 < 3)).alias("mm_ok"))


@query("agg20_event_scorecard", "cls:s n detected who zone make_miss all_correct", "plays cv", SCORE_SQL)
def _(spark, sf):
    return R.event_scorecard(matched_plays(spark, sf), "cls")


ID_SQL = """with m as (select game, {key}, frame, {order} as o, {gid} as gid from {src}),
  n as (select game, {key}, count(*) as gt_frames, count(gid) as matched from m group by all),
  v as (select game, {key}, gid, count(*) as c, min(o) as f from m where gid is not null group by all),
  d as (select *, count(*) over (partition by game, {key}) as n_ids from v qualify row_number() over (partition by game, {key} order by c desc, f, gid desc) = 1),
  s as (select game, {key}, sum(case when p <> gid then 1 else 0 end) as sw from (select *, lag(gid) over (partition by game, {key} order by o) as p from m where gid is not null) group by all)
  select n.game, {nkey}, gt_frames, matched / gt_frames as coverage, coalesce(c, 0) / greatest(matched, 1) as purity, gid as dominant, coalesce(n_ids, 0) as n_ids, coalesce(sw, 0) as n_switches
  from n left join d using (game, {key}) left join s using (game, {key})"""


@query("agg21_identity_scorecard", "game uid gt_frames coverage:k purity:k dominant n_ids n_switches", "obs",
       ID_SQL.format(key="uid", nkey="uid", order="frame", gid="case when eid % 5 > 0 then k end", src="(select *, cast(cx / 21 as bigint) % 4 as k from obs)"))
def _(spark, sf):
    m = A.observations(spark, sf).withColumn("gid", F.expr("case when eid % 5 > 0 then cast(cx / 21 as bigint) % 4 end"))
    return R.id_scorecard(m, ["game", "uid"], "frame", "gid", 4000)


def fidelity_rows(spark, sf):
    d = A.detections(spark, sf)
    gt = d.filter("class_id = 0").select("game", "cam", "frame", col("num").alias("player"), "x1", "y1", "x2", "y2", "det_idx")
    gt = O.best_per(gt, ["game", "player", "cam", "frame"], [-col("det_idx")], ["x1", "y1", "x2", "y2"])
    got = O.best_per(d.filter("class_id = 1").withColumn("player", col("num")), ["game", "player", "cam", "frame"], [-col("det_idx")], ["x1", "y1", "x2", "y2"])
    got = got.select("game", "player", "cam", "frame", *[col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")])
    return gt.join(got, ["game", "player", "cam", "frame"], "left").withColumn("iou", G.iou(G.Box.of(), G.Box.of("b_")))


A.CTES["fid"] = (("det",), f"""select a.game, a.num as player, a.cam, a.frame, {IOU_SQL} as iou from
  (select * from det where class_id = 0 qualify row_number() over (partition by game, num, cam, frame order by det_idx) = 1) a left join
  (select * from det where class_id = 1 qualify row_number() over (partition by game, num, cam, frame order by det_idx) = 1) b
  on a.game = b.game and a.num = b.num and a.cam = b.cam and a.frame = b.frame""")


@query("agg22_camera_fidelity", "game player frames fused:k strict:k cams", "fid",
       """with c as (select game, player, cam, count(*) as n, sum(case when iou >= 5e-2 then 1 else 0 end) as h from fid group by all having count(*) >= 20),
          s as (select game, player, avg(round_even(h / n, 3)) + 1e-7 as strict, count(*) as cams from c group by all),
          f as (select game, player, frame, max(case when iou >= 5e-2 then 1e0 else 0e0 end) as a from fid group by all),
          g as (select game, player, count(*) as frames, avg(a) as fused from f group by all)
          select * from g left join s using (game, player)""")
def _(spark, sf):
    return R.camera_fidelity(fidelity_rows(spark, sf), ["game", "player"], col("iou") >= 0.05).withColumn("strict", col("strict") + 1e-7)


@query("agg23_raw_id_scorecard", "game num gt_frames coverage:k purity:k dominant n_ids n_switches", "streams",
       ID_SQL.format(key="num, cam", nkey="num", order="frame", gid="case when kit = 'B' then det_idx % 4 end",
                     src="(select * from streams qualify row_number() over (partition by game, cam, num, frame order by kit, det_idx) = 1)"))
def _(spark, sf):
    s = O.best_per(A.streams(spark, sf).withColumn("o", F.when(col("kit") == "B", 1).otherwise(0)), ["game", "cam", "num", "frame"], [col("o"), -col("det_idx")], ["kit", "det_idx"])
    return R.id_scorecard(s.withColumn("gid", F.expr("case when kit = 'B' then det_idx % 4 end")), ["game", "num", "cam"], "frame", "gid", B)


@query("agg26_failure_heatmap", "gx gy n rate:k", "world",
       """select cast(floor(cx / 150) as bigint) as gx, cast(floor(cy / 150) as bigint) as gy, count(*) as n, avg(case when jersey is not null then 1e0 else 0e0 end) as rate
          from world group by all having count(*) >= 15""")
def _(spark, sf):
    return R.heatmap(A.world(spark, sf), "cx", "cy", col("jersey").isNotNull().cast("double"))


BAND_SQL = f"""with recursive gt as (select game, cam, frame, det_idx as gt, x1, y1, x2, y2 from det where class_id = 1 and y2 - y1 <= (select quantile_cont(y2 - y1, 25e-2) from det where class_id = 1)),
  e as (select a.game, a.cam, a.frame, a.det_idx as pred, b.gt, row_number() over (partition by a.game, a.cam, a.frame order by a.score desc, a.det_idx, {IOU_SQL} desc, b.gt desc) as i
     from det a join gt b on a.game = b.game and a.cam = b.cam and a.frame = b.frame where a.class_id = 0 and {IOU_SQL} >= 3e-1),
  g as (select game, cam, frame, 0::bigint as i, []::bigint[] as ls, []::bigint[] as rs, max(i) as n from e group by all union all
     select g.game, g.cam, g.frame, e.i, case when list_contains(ls, pred) or list_contains(rs, gt) then ls else list_append(ls, pred) end,
       case when list_contains(ls, pred) or list_contains(rs, gt) then rs else list_append(rs, gt) end, n
     from g join e on g.game = e.game and g.cam = e.cam and g.frame = e.frame and e.i = g.i + 1),
  h as (select cam, sum(len(ls)) as matched from g where i = n group by cam), t as (select cam, count(*) as n_gt from gt group by cam)
  select cam, sum(n_gt) as n_gt, sum(coalesce(matched, 0)) as matched, sum(coalesce(matched, 0)) / sum(n_gt) as recall from t left join h using (cam) group by rollup (cam)"""


@query("agg27_small_band_recall", "cam n_gt matched recall:k", "det", BAND_SQL)
def _(spark, sf):
    d = A.detections(spark, sf)
    gt = d.filter("class_id = 1").withColumn("gt", col("det_idx")).select("game", "cam", "frame", "gt", "x1", "y1", "x2", "y2")
    pred = d.filter("class_id = 0").withColumn("pred", col("det_idx")).select("game", "cam", "frame", "pred", "score", "x1", "y1", "x2", "y2")
    return R.band_recall(gt, pred, ["game", "cam", "frame"], "cam", iou=0.3)


AP_SQL = f"""with recursive gt as (select game, cam, frame, kit, det_idx as gt, x1, y1, x2, y2 from det where class_id = 1), th as (select unnest([5e-2, 2e-1]) as thr),
  e as (select a.game, a.cam, a.frame, a.kit, thr, a.det_idx as pred, b.gt, row_number() over (partition by a.game, a.cam, a.frame, a.kit, thr order by a.score desc, a.det_idx, {IOU_SQL} desc, b.gt) as i
     from det a join gt b on a.game = b.game and a.cam = b.cam and a.frame = b.frame and a.kit = b.kit cross join th where a.class_id = 0 and {IOU_SQL} >= thr),
  g as (select game, cam, frame, kit, thr, 0::bigint as i, []::bigint[] as ls, []::bigint[] as rs, max(i) as n from e group by all union all
     select g.game, g.cam, g.frame, g.kit, g.thr, e.i, case when list_contains(ls, pred) or list_contains(rs, gt) then ls else list_append(ls, pred) end,
       case when list_contains(ls, pred) or list_contains(rs, gt) then rs else list_append(rs, gt) end, n
     from g join e on g.game = e.game and g.cam = e.cam and g.frame = e.frame and g.kit = e.kit and g.thr = e.thr and e.i = g.i + 1),
  m as (select game, cam, frame, kit, thr, unnest(ls) as pred from g where i = n),
  p as (select d.game, d.cam, d.frame, d.kit, thr, d.det_idx as pred, d.score from det d cross join th where d.class_id = 0),
  s as (select p.kit, p.thr, p.score, count(*) as n, count(m.pred) as tp from p left join m using (game, cam, frame, kit, thr, pred) group by all),
  c as (select *, sum(tp) over w as ctp, sum(n) over w as cn, (select count(*) from gt where gt.kit = s.kit) as n_gt from s window w as (partition by kit, thr order by score desc)),
  grid as (select kit, thr, r.r / 1e2 as r, max(case when ctp / n_gt >= r.r / 1e2 - 1e-11 then ctp / cn end) as pr from c cross join (select range as r from range(101)) r group by all)
  select case kit when 'B' then 0 else 1 end as class_id, thr, max(n_gt) as n_gt, sum(coalesce(pr, 0)) / 101 as ap, max(rec) as ar from grid join (select kit, thr, max(n_gt) as n_gt, max(ctp / n_gt) as rec from c group by all) using (kit, thr) group by kit, thr"""


@query("agg28_average_precision", "class_id thr:k n_gt ap:k ar:k", "det", AP_SQL)
def _(spark, sf):
    d = A.detections(spark, sf).withColumn("cls", F.expr("case kit when 'B' then 0 else 1 end"))
    gt = d.filter("class_id = 1").drop("class_id").select("game", "cam", "frame", col("cls").alias("class_id"), col("det_idx").alias("gt"), "x1", "y1", "x2", "y2")
    pred = d.filter("class_id = 0").drop("class_id").select("game", "cam", "frame", col("cls").alias("class_id"), col("det_idx").alias("pred"), "score", "x1", "y1", "x2", "y2")
    return R.average_precision(gt, pred, ["game", "cam", "frame"], [0.05, 0.2])


@query("agg31_appearance_separation", "within:k across:k", "",
       """with e as (select vec_id, label, embedding::double[] as v from embeddings), u as (select vec_id, label % 2 as team, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-8)) as v from e)
          select avg(case when a.team = b.team then list_dot_product(a.v, b.v) end) as within, avg(case when a.team <> b.team then list_dot_product(a.v, b.v) end) as across from u a join u b on a.vec_id < b.vec_id""")
def _(spark, sf):
    u = spark.read.parquet(f"{sf}/embeddings.parquet").select((col("label") % 2).alias("team"), V.l2_normalise(V.as_double(col("embedding"))).alias("v"))
    return R.appearance_separation(u, "v", "team", 64)


GALLERY = "vec_id % 10 = 0"


@query("agg32_gallery_distance", "vec_id best d3:k dmin:k", "",
       """with e as (select vec_id, label, embedding::double[] as v from embeddings), u as (select vec_id, label, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-8)) as v from e),
          d as (select q.vec_id, g.label, floor((1 - list_dot_product(q.v, g.v)) * 1e9 + 5e-1) as d from u q join u g on q.vec_id <> g.vec_id where g.vec_id % 10 = 0 and q.vec_id % 10 > 0),
          n as (select *, row_number() over (partition by vec_id, label order by d) as rn from d), a as (select vec_id, label, avg(d) / 1e9 as d3, min(d) / 1e9 as dmin from n where rn <= 3 group by all)
          select vec_id, label as best, d3, dmin from a qualify row_number() over (partition by vec_id order by dmin, label) = 1""")
def _(spark, sf):
    from courtloom.operators import appearance
    u = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label", V.l2_normalise(V.as_double(col("embedding"))).alias("v"))
    return appearance.gallery_distance(u.filter("vec_id % 10 > 0"), u.filter(GALLERY), "vec_id", "label", "v")


@query("agg33_self_vs_rival", "vec_id self_d:k rival_d:k rival", "",
       """with e as (select vec_id, label, embedding::double[] as v from embeddings), u as (select vec_id, label, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-8)) as v from e),
          d as (select q.vec_id, q.label as own, g.label, min(floor((1 - list_dot_product(q.v, g.v)) * 1e9 + 5e-1)) as d from u q join u g on q.vec_id <> g.vec_id where g.vec_id % 10 = 0 and q.vec_id % 10 > 0 group by all)
          select vec_id, min(case when own = label then d end) / 1e9 as self_d, min(case when own <> label then d end) / 1e9 as rival_d, arg_min(label, case when own <> label then d * 1e3 + label end) as rival from d group by vec_id""")
def _(spark, sf):
    from courtloom.operators import appearance
    u = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label", V.l2_normalise(V.as_double(col("embedding"))).alias("v"))
    return appearance.self_vs_rival(u.filter("vec_id % 10 > 0"), u.filter(GALLERY), "vec_id", "label", "v")


@query("agg34_zone_radius_fit", "half n radius:h", "obs",
       f"""with d as (select case when cx > 107185e-2 then 1 else 0 end as half, floor({DIST_SQL} * 10 + 5e-1) / 10 as dist from obs)
          select half, count(*) as n, quantile_cont(dist, 5e-1) as radius from d where dist > 400 and dist < 1200 group by all having count(*) > 200""")
def _(spark, sf):
    d = A.observations(spark, sf).select((col("cx") > C.COURT_CENTER_X).cast("long").alias("half"), (F.floor(G.basket_distance(col("cx"), col("cy")) * 10 + 0.5) / 10).alias("dist"))
    d = d.filter("dist > 400 and dist < 1200")
    n = d.groupBy("half").agg(F.count(F.lit(1)).alias("n")).filter("n > 200")
    return n.join(O.exact_quantiles(d, ["half"], {"radius": "dist"}, {"": 0.5}), "half")


@query("agg35_court_side_share", "game chunk team:s n_left n_right", "world",
       """with c as (select game, chunk, frame, team, avg(cx) as x from world where team in ('A', 'B') group by all)
          select game, chunk, team, sum(case when x <= 107185e-2 then 1 else 0 end) as n_left, sum(case when x > 107185e-2 then 1 else 0 end) as n_right from c group by all""")
def _(spark, sf):
    return R.court_side_share(A.world(spark, sf), ["game", "chunk"], C.COURT_CENTER_X)


ARB_SQL = """with m as (select p.k, p.uid, c.uid as cu, c.k as ck, c.rq from plays p join cv c on p.game = c.game and abs(c.t - p.t) <= 1800
     qualify row_number() over (partition by p.game, p.play_id order by abs(c.t - p.t), c.t, c.eid) = 1),
  r as (select uid % 3 = cu % 3 as b, k % 2 = ck % 2 as v, uid % 2 = ck % 2 as agree, rq, ck * 10 as dist from m)
  select count(*) as n, sum(b::int) as base, sum(v::int) as story, sum((case when coalesce(not agree and rq > 6e-1, false) then v else b end)::int) as rule_a,
    sum((case when coalesce(rq > 6e-1, false) then v else b end)::int) as rule_b, sum((case when dist < 500 then v else b end)::int) as rule_c, sum((case when not agree and dist < 600 then v else b end)::int) as rule_d,
    sum((b or v)::int) as either, sum((b and v)::int) as b_and_v, sum(agree::int) as agree from r"""


@query("agg36_arbiter_ceilings", "n base story rule_a rule_b rule_c rule_d either b_and_v agree", "plays cv", ARB_SQL)
def _(spark, sf):
    m = matched_plays(spark, sf).filter("detected")
    return R.arbiter(m.select(col("who_ok").alias("b"), col("zone_ok").alias("v"), (col("uid") % 2 == col("m_k") % 2).alias("agree"), col("m_rq").alias("rq"), (col("m_k") * 10).alias("dist")))


@query("agg36b_oracle_bound", "game n arc_cam any_cam", "ball streams",
       """with ev as (select distinct game, cam, frame, sid from streams where score >= 9e-1), a as (select *, concat('n', det_idx % 10, 'B') as sid from ball),
          h as (select a.game, a.cam, a.frame, max(case when e.cam = a.cam then 1 else 0 end) as arc, count(e.cam) > 0 as hit from a left join ev e on a.game = e.game and a.sid = e.sid and abs(e.frame - a.frame) <= 9 group by all)
          select game, count(*) as n, sum(arc) as arc_cam, sum(hit::int) as any_cam from h group by game""")
def _(spark, sf):
    ev = A.streams(spark, sf).filter("score >= 9e-1")
    a = A.ball(spark, sf).selectExpr("game", "cam", "frame as at", "concat('n', det_idx % 10, 'B') as sid", "frame * 4 + cam as shot_id")
    return R.oracle_bound(a, ev)


SPLIT_SQL = """with recursive v as (select game, num, (qty - 25) / 2e1 as v, count(*) as c from trk group by all),
  l as (select game, num, list({'v': v, 'c': c} order by v) as h, min(v) as lo, max(v) as hi, sum(c) as n from v group by all having sum(c) >= 60),
  r as (select game, num, n, h, lo, hi, 0 as i from l union all
    select game, num, n, h, coalesce(list_sum(list_transform(list_filter(h, lambda e: e.v <= (lo + hi) / 2), lambda e: e.v * e.c)) / nullif(list_sum(list_transform(list_filter(h, lambda e: e.v <= (lo + hi) / 2), lambda e: e.c)), 0), lo),
      coalesce(list_sum(list_transform(list_filter(h, lambda e: e.v > (lo + hi) / 2), lambda e: e.v * e.c)) / nullif(list_sum(list_transform(list_filter(h, lambda e: e.v > (lo + hi) / 2), lambda e: e.c)), 0), hi), i + 1
    from r where i < 30)
  select game, num, n, lo, hi, (lo + hi) / 2 as threshold, lo < -3e-1 and hi > 2e-1 as accepted from r where i = 30"""


@query("agg37_two_means_split", "game num n lo:k hi:k threshold:k accepted", "trk", SPLIT_SQL)
def _(spark, sf):
    t = A.tracks(spark, sf).withColumn("shade", (col("qty") - 25) / 20.0)
    return T.two_means(t, ["game", "num"], "shade")


@query("agg38_camera_z_normalise", "game cam frame track_id z:k", "trk",
       "select game, cam, frame, track_id, (qty - avg(qty) over (partition by cam)) / (stddev_pop(qty) over (partition by cam) + 1e-6) as z from trk")
def _(spark, sf):
    return T.z_normalise(A.tracks(spark, sf), ["cam"], "qty", "z")


@query("agg39_two_team_clusters", "game cam team:s n")
def _(spark, sf):
    f = A.tracks(spark, sf).withColumn("hue", F.expr("cast(case when pk % 2 = 0 then 10 + qty % 13 else 60 + qty % 17 end as double)")).withColumn("value", F.expr("cast(sk % 50 as double)"))
    return T.two_team_clusters(f, ["game", "cam"], "hue", "value").groupBy("game", "cam", "team").agg(F.count(F.lit(1)).alias("n"))


@query("agg40_read_count_roster", "game num n", "det",
       "select game, num, count(*) as n from det where class_id = 0 and score >= 7e-1 group by all having count(*) >= 150")
def _(spark, sf):
    return A.detections(spark, sf).filter("class_id = 0 and score >= 7e-1").groupBy("game", "num").agg(F.count(F.lit(1)).alias("n")).filter("n >= 150")


@query("agg41_distance_percentiles", "cam p50:h p75:h p90:h", "world",
       f"select cam, quantile_cont(d, 5e-1) as p50, quantile_cont(d, 75e-2) as p75, quantile_cont(d, 9e-1) as p90 from (select cam, floor({DIST_SQL}) as d from world) group by cam")
def _(spark, sf):
    d = A.world(spark, sf).withColumn("d", F.floor(G.basket_distance(col("cx"), col("cy"))))
    return O.exact_quantiles(d, ["cam"], {"": "d"}, {"p50": 0.5, "p75": 0.75, "p90": 0.9})


@query("agg42_team_flip_decision", "game cam1 cam2 same flip flipped", "trk",
       f"select game, cam1, cam2, sum((team1 = team2)::int) as same, sum((team1 <> team2)::int) as flip, (flip > same)::int as flipped from ({ISO_SQL}) group by game, cam1, cam2")
def _(spark, sf):
    return I.flip_decision(isolated_pairs(spark, sf))


@query("agg43_track_team_repair", "game cam1 cam2 side track_id team:s votes", "trk",
       f"""with p as ({ISO_SQL}), v as (select game, cam1, cam2, 1 as side, t1 as track_id, team2 as team, frame from p union all select game, cam1, cam2, 2, t2, team1, frame from p),
          c as (select game, cam1, cam2, side, track_id, team, count(*) as c, min(frame) as f from v group by all), t as (select *, sum(c) over (partition by game, cam1, cam2, side, track_id) as n from c
             qualify row_number() over (partition by game, cam1, cam2, side, track_id order by c desc, f, team desc) = 1)
          select game, cam1, cam2, side, track_id, team, c as votes from t where c >= 4 and c / n >= 55e-2""")
def _(spark, sf):
    return I.team_repair(isolated_pairs(spark, sf), 4, 0.55)


@query("agg44_number_teams", "game num a b teams:s", "raw",
       """with v as (select game, num, sum(case when t = 'A' then 1 else 0 end) as a, sum(case when t = 'B' then 1 else 0 end) as b from (select *, case when (pk + sk) % 5 < 1 + num % 4 then 'A' else 'B' end as t from raw) group by all)
          select *, case when least(a, b) / (a + b) >= 25e-2 and least(a, b) >= 30 then 'AB' when a >= b then 'A' else 'B' end as teams from v where a + b >= 20""")
def _(spark, sf):
    return T.number_teams(A.raw_detections(spark, sf).withColumn("t", F.expr("case when (pk + sk) % 5 < 1 + num % 4 then 'A' else 'B' end")), ["game"], "num", "t")


ROSTER_SQL = """with w as (select game, chunk, gid, frame, team, case when pk % 3 = 0 then pk % 4 end as jersey from (select *, cast(cx as bigint) as pk from world)),
  t as (select game, chunk, gid, team from (select game, chunk, gid, team, count(*) as c, min(frame) as f from w group by all) qualify row_number() over (partition by game, chunk, gid order by c desc, f, team desc) = 1),
  j as (select game, chunk, gid, jersey, c from (select game, chunk, gid, jersey, count(*) as c, min(frame) as f from w where jersey is not null group by all) qualify row_number() over (partition by game, chunk, gid order by c desc, f, jersey desc) = 1),
  r as (select t.game, t.chunk, t.gid, t.team, case when t.team <> 'REF' then j.jersey end as jersey, j.c from t left join j using (game, chunk, gid)),
  o as (select game, chunk, team, jersey, gid as owner from r where jersey is not null and team is not null qualify row_number() over (partition by game, chunk, team, jersey order by c desc, gid) = 1)
  select r.game, r.chunk, r.gid, r.team, case when owner is null or owner = r.gid then r.jersey end as jersey from r left join o using (game, chunk, team, jersey)"""


@query("agg45_unique_roster", "game chunk gid team:s jersey", "world", ROSTER_SQL)
def _(spark, sf):
    w = A.world(spark, sf).withColumn("jersey", F.expr("case when cast(cx as bigint) % 3 = 0 then cast(cx as bigint) % 4 end"))
    return T.unique_roster(w, ["game", "chunk"], "gid", "frame")


@query("agg46_roster_fold", "game gid team:s jersey members", "world",
       """with p as (select game, chunk * 1000 + gid as id, gid, case when chunk % 2 = 0 then team end as team, case when chunk > 0 then gid end as jersey from world group by all)
          select game, gid, arg_min(team, id) filter (where team is not null) as team, arg_min(jersey, id) filter (where jersey is not null) as jersey, count(*) as members from p group by game, gid""")
def _(spark, sf):
    p = A.world(spark, sf).selectExpr("game", "chunk * 1000 + gid as gid", "chunk * 1000 + gid as id", "case when chunk % 2 = 0 then team end as team", "case when chunk > 0 then gid end as jersey").distinct()
    mapping = p.select("game", "gid", (col("gid") % 1000).alias("canonical")).distinct()
    return I.fold_roster(p, mapping, ["game"], "id")
