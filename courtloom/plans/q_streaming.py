"""Streams over the driver tables (run to the end of what is there) and the extension points."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from courtloom.functions import geometry as G
from courtloom.functions import providers
from courtloom.functions import vectors as V
from courtloom.operators import sequence as S
from courtloom.operators import shot_model as M
from courtloom.operators import votes as W
from courtloom.plans import adapters as A
from courtloom.plans.q_columns import DIST_SQL, IOU_SQL
from courtloom.plans.q_joins import SWEEP_SQL, numbered_streams
from courtloom.plans.q_tracking import BALL_SQL
from courtloom.plans.q_windows import RLE_SQL, XCORR_SQL
from courtloom.plans.registry import query
from courtloom.session import scratch_path
from courtloom.streaming import stateful as T

col = F.col


def stream_table(spark, df, name):
    """Write a derived table to shared storage in time ranges and read it back as a stream, one file for each micro-batch."""
    path = scratch_path(spark, name)
    T.write_replay(df, f"{path}/in")
    return spark.readStream.schema(spark.read.parquet(f"{path}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in"), path


def raw_stream(spark, sf, table):
    schema = spark.read.parquet(f"{sf}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf)


@query("str01_online_fusion", "game chunk frame gid cx:h cy:h")
def _(spark, sf):
    from courtloom.plans.q_tracking import player_groups
    s, path = stream_table(spark, player_groups(spark, sf).withColumn("ts", T.event_time("frame")), "groups")
    return T.run_available(T.fuse_online(s, "1 seconds", max_dist=400.0), path)


@query("str02_online_ball", "game chunk frame bx:h by_:h", "bpts", BALL_SQL)
def _(spark, sf):
    from courtloom.plans.q_aggregates import ball_points
    fused = W.fuse_ball_candidates(ball_points(spark, sf), ["game", "chunk", "frame"]).withColumn("ts", T.event_time("frame"))
    s, path = stream_table(spark, fused, "ball")
    return T.run_available(T.track_ball_online(s), path).withColumnRenamed("by", "by_")


HOLD_SQL = """with c as (select game, chunk, frame, case when cand is null then 'GAP' when cand = 'error' then 'FLIGHT' else 'HOLD' end as state, cand as top from cand),
  f as (select *, last_value(case when state = 'FLIGHT' then frame end ignore nulls) over (partition by game, chunk order by frame rows between unbounded preceding and current row) as lf from c),
  h as (select *, case when coalesce(frame - lf <= 4, false) then 2 else 3 end as need, case when top = lag(top) over (partition by game, chunk order by frame) then 0 else 1 end as ch from f where state = 'HOLD'),
  r as (select *, sum(ch) over (partition by game, chunk order by frame) as run from h), p as (select *, row_number() over (partition by game, chunk, run order by frame) as p from r),
  t as (select *, lag(top) over (partition by game, chunk order by frame) as prev from p where p >= need)
  select game, chunk, frame, top as holder from t where prev is null or prev <> top"""


@query("str03_online_holder", "game chunk frame holder:s", "cand", HOLD_SQL)
def _(spark, sf):
    c = A.candidates(spark, sf).select("game", "chunk", "frame", F.when(col("cand").isNull(), "GAP").when(col("cand") == "error", "FLIGHT").otherwise("HOLD").alias("state"), col("cand").alias("top"))
    s, path = stream_table(spark, c.withColumn("ts", T.event_time("frame")), "holder")
    return T.run_available(T.hold_online(s, 3, 2), path)


# one row of state for each sight: votes in the order in which numbers came, claim, last read, end of the hot time
READS_STATE_SQL = """with recursive o as (select game, cam, track_id, frame, case when qty % 3 = 0 then null else qty % 4 end as num, score as conf, qty > 45 as contact, row_number() over (partition by game, cam, track_id order by frame) as i from trk),
  s as (select game, cam, track_id, 0::bigint as i, null::bigint as frame, []::struct(n bigint, c bigint)[] as votes, null::bigint as claim, null::bigint as last, -1::bigint as hot, false as rd from (select distinct game, cam, track_id from o) union all
    select game, cam, track_id, i, frame, v2, case when rd and num is not null and ok then top else claim end, case when rd then frame else last end,
      case when rd and num is not null and ok then case when claim <> top then frame + 5 else h end when rd and num is not null and claim is not null and num <> claim and conf >= 8e-1 then frame + 5 else h end, rd
    from (select *, list_filter(v2, lambda v: v.c = list_max(list_transform(v2, lambda x: x.c)))[1].n as top,
        coalesce(list_max(list_transform(v2, lambda x: x.c)) >= 2 and list_max(list_transform(v2, lambda x: x.c)) / list_sum(list_transform(v2, lambda x: x.c)) >= 6e-1, false) as ok
      from (select *, case when not rd or num is null then votes when len(list_filter(votes, lambda v: v.n = num)) = 0 then list_append(votes, {'n': num, 'c': 1::bigint})
          else list_transform(votes, lambda v: {'n': v.n, 'c': case when v.n = num then v.c + 1 else v.c end}) end as v2
        from (select *, claim is null or last is null or frame - last >= 10 or frame <= h as rd
          from (select *, case when contact then greatest(hot, frame + 5) else hot end as h
            from (select s.game, s.cam, s.track_id, o.i, o.frame, o.num, o.conf, o.contact, case when o.frame - s.frame > 18000 then []::struct(n bigint, c bigint)[] else s.votes end as votes,
                case when o.frame - s.frame > 18000 then null else s.claim end as claim, case when o.frame - s.frame > 18000 then null else s.last end as last, case when o.frame - s.frame > 18000 then -1 else s.hot end as hot
              from s join o on s.game = o.game and s.cam = o.cam and s.track_id = o.track_id and o.i = s.i + 1)))))
  ) select game, cam, track_id, frame, claim from s where rd"""


@query("str04_triggered_reads", "game cam track_id frame claim", "trk", READS_STATE_SQL)
def _(spark, sf):
    t = A.tracks(spark, sf).selectExpr("game", "cam", "track_id", "frame", "case when qty % 3 = 0 then null else cast(qty % 4 as double) end as num", "score as conf", "qty > 45 as contact")
    s, path = stream_table(spark, t.withColumn("ts", T.event_time("frame")), "reads")
    return T.run_available(T.triggered_reads(s, 10, 5), path)


@query("str05_track_expiry", "game gid frame event:s", "world", """select game, gid, frame, case when coalesce(frame - p <= 300, false) then 'reentry' else 'enter' end as event from (select *, lag(frame) over (partition by game, gid order by frame) as p from world)
  where p is null or frame - p > 3""")
def _(spark, sf):
    s, path = stream_table(spark, A.world(spark, sf).select("game", "gid", "frame", T.event_time("frame").alias("ts")), "seen")
    return T.run_available(T.expire_tracks(s, 3), path)


@query("str06_camera_alignment", "game ref left_cam right_cam left_id right_id", "trk offs",
       """with r as (select t.game, t.cam, frame - off as ref, frame * 10 + track_id as id from trk t join offs o on t.game = o.game and t.cam = o.cam)
          select a.game, a.ref, a.cam as left_cam, b.cam as right_cam, a.id as left_id, b.id as right_id from r a join r b on a.game = b.game and a.ref = b.ref and a.cam < b.cam""")
def _(spark, sf):
    from courtloom.operators import sync
    r = sync.align(A.tracks(spark, sf), A.offsets(spark)).select("game", "cam", "ref", (col("frame") * 10 + col("track_id")).alias("id")).withColumn("ts", T.event_time("ref"))
    s, path = stream_table(spark, r, "cams")
    return T.run_available(T.align_cameras(s, s), path)


@query("str07_possession_sessions", "game holder:s start_sec n", "evt",
       """with g as (select *, sum(cut) over (partition by game, etype order by sec, eid) as s from (select *, case when sec - lag(sec) over (partition by game, etype order by sec, eid) <= 1800 then 0 else 1 end as cut from evt)),
          w as (select game, etype as holder, min(sec) as start_sec, max(sec) + 1800 as e, count(*) as n from g group by game, etype, s)
          select game, holder, start_sec, n from w""")
def _(spark, sf):
    e = A.events(spark, sf).select("game", col("etype").alias("holder"), F.timestamp_seconds("sec").alias("ts"))
    s, path = stream_table(spark, e, "sessions")
    out = T.run_available(T.possession_sessions(s, "1800 seconds", "3600 seconds"), path)
    return out.withColumn("start_sec", F.unix_seconds("start_ts"))


@query("str08_buffered_flush", "game n", "evt", "select game, count(*) as n from evt group by game")
def _(spark, sf):
    path = scratch_path(spark, "flush")
    e = raw_stream(spark, sf, "events").selectExpr("user_id % 5 as game", "event_id as eid")
    T.run_batches(e, path, lambda batch, i: batch.write.mode("overwrite").parquet(f"{path}/out/batch={i}"))
    return spark.read.parquet(f"{path}/out").groupBy("game").agg(F.count(F.lit(1)).alias("n"))


# --- extension points ----------------------------------------------------------------------------------------------
@query("udf01_column_functions", "game cam frame pk a:k zone:s", "raw", f"""select game, cam, frame, pk, {IOU_SQL.replace('a.', 'r.').replace('b.x1', '100e0').replace('b.y1', '50e0').replace('b.x2', '200e0').replace('b.y2', '250e0')} as a,
   case when d < 710 then '2PT' when d < 840 then '3PT' else '4PT' end as zone from (select *, {DIST_SQL} as d from (select *, x1 * 3 as cx, y1 * 3 as cy from raw)) r""")
def _(spark, sf):
    fixed = G.Box(F.lit(100.0), F.lit(50.0), F.lit(200.0), F.lit(250.0))
    raw = A.raw_detections(spark, sf)
    return raw.withColumn("a", G.iou(G.Box.of(), fixed)).withColumn("zone", G.zone(G.basket_distance(col("x1") * 3, col("y1") * 3)))


@query("udf02_weighted_mode", "game cam num weight:k total:k", "raw", """with s as (select game, cam, num, sum(cast(floor(score * 1000 + 5e-1) as bigint)) / 1e3 as w, min(frame) as f from raw group by all)
  select game, cam, num, w as weight, (select sum(w) from s q where q.game = s.game and q.cam = s.cam) as total from s qualify row_number() over (partition by game, cam order by w desc, f, num desc) = 1""")
def _(spark, sf):
    m = W.modal(A.raw_detections(spark, sf).withColumn("w", F.floor(col("score") * 1000 + 0.5)), ["game", "cam"], "num", "frame", col("w"))
    return m.select("game", "cam", "num", (col("votes") / F.lit(1000.0)).alias("weight"), (col("total") / F.lit(1000.0)).alias("total"))


@query("udf03_sequence_functions", "game n_runs longest", "cand", f"select game, count(*) as n_runs, max(end_frame - start_frame + 1) as longest from ({RLE_SQL.format(gap=1, src='cand')}) group by game")
def _(spark, sf):
    r = S.rle(A.candidates(spark, sf), ["game"], "frame", "cand", 1, block=A.BLOCK)
    return r.groupBy("game").agg(F.count(F.lit(1)).alias("n_runs"), F.max(col("end_frame") - col("start_frame") + 1).alias("longest"))


@query("udf04_match_functions", "game matched", "plays cv", "select game, count(*) as matched from (select p.game, p.play_id from plays p join cv c on p.game = c.game and abs(c.t - p.t) <= 900 group by all) group by game")
def _(spark, sf):
    from courtloom.operators import joins as J
    m = J.nearest_in_time(A.plays(spark, sf), A.cv_events(spark, sf), ["game"], "t", ["eid"], 900)
    return m.filter("m_eid is not null").groupBy("game").agg(F.count(F.lit(1)).alias("matched"))


@query("udf05_explode_tracks", "game sid:s cam frame x1:h", "streams", "select game, sid, cam, frame, x1 from streams where det_idx % 7 > 0")
def _(spark, sf):
    providers.register(spark)
    rec = F.struct(F.array("x1", "y1", "x2", "y2").alias("box"), (col("det_idx") % 7 > 0).alias("present"), "score")
    docs = A.streams(spark, sf).groupBy("game", "sid", "cam", "chunk").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(col("frame").cast("string"), rec)))).alias("doc"))
    return spark.sql("select d.game, d.sid, d.cam, t.frame, t.x1 from {docs} d, lateral explode_tracks(d.doc) t", docs=docs)


@query("udf06_attribute_provider", "game cam frame pk tall", "raw", "select game, cam, frame, pk, (y2 - y1 >= 150)::int as tall from raw")
def _(spark, sf):
    def tall(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[["game", "cam", "frame", "pk"]].assign(tall=(pdf["y2"] - pdf["y1"] >= 150).astype("int64"))

    providers.register_provider("tall", tall, "game long, cam long, frame long, pk long, tall long")
    return providers.apply_provider(A.raw_detections(spark, sf).select("game", "cam", "frame", "pk", "y1", "y2"), "tall")


def shot_predictions(spark, sf):
    d = A.raw_detections(spark, sf).selectExpr(
        "game", "kit", "case when frame % 5 = 0 then 'val' else 'train' end as split", "cast(x1 as double) as f1", "case when pk % 6 > 0 then y1 end as f2", "score as f3",
        "case when x1 + y1 > 320 then 1 else 0 end as label")
    return M.held_out_predictions(d, ["f1", "f2", "f3"], ["kit"])


@query("evt24_make_miss_model", "game kit:s n correct thr:k")
def _(spark, sf):
    return M.accuracy_by_game(shot_predictions(spark, sf), "kit")


@query("evt24b_model_report", "game n accuracy:k precision:k recall:k auc:k thr:k")
def _(spark, sf):
    return M.model_report(shot_predictions(spark, sf))


@query("evt24c_score_auc", "game cam auc:k", "raw", """with p as (select game, cam, floor(score * 1e9 + 5e-1) as s, case when x1 + y1 > 320 then 1 else 0 end as label from raw),
  c as (select game, cam, s, sum(label) as pos, sum(1 - label) as neg from p group by all), r as (select *, sum(neg) over (partition by game, cam order by s) as upto from c)
  select game, cam, sum(pos * (2 * upto - neg)) / (2e0 * sum(pos) * sum(neg)) as auc from r group by game, cam having sum(pos) > 0 and sum(neg) > 0""")
def _(spark, sf):
    d = A.raw_detections(spark, sf).selectExpr("game", "cam", "score as prob", "case when x1 + y1 > 320 then 1 else 0 end as label")
    return M.area_under_curve(d, ["game", "cam"]).filter("auc is not null")


OFFSET_SQL = f"""with cv as ({XCORR_SQL[:XCORR_SQL.rindex('select game, cam, chunk, lag, peak')]} select * from c),
  p as (select *, row_number() over (partition by game, cam, chunk order by c desc, k) as rn from cv), t as (select game, cam, chunk, k as lag, c as peak from p where rn = 1),
  f as (select t.game, t.cam, t.chunk, t.lag, any_value(t.peak) as peak, max(case when abs(cv.k - t.lag) > 5 then cv.c end) as second from t join cv on t.game = cv.game and t.cam = cv.cam and t.chunk = cv.chunk group by t.game, t.cam, t.chunk, t.lag),
  g as (select cam, lag, count(*) as n from f where second = 0 or peak / abs(second) >= 1 group by cam, lag),
  b as (select *, row_number() over (partition by cam order by n desc, lag) as rn, sum(n) over (partition by cam) as windows from g)
  select cam, windows, n as agree, case when windows >= 3 then lag end as off from b where rn = 1"""


@query("jn20b_offset_from_signal", "cam windows agree off", "ball", OFFSET_SQL)
def _(spark, sf):
    from courtloom.operators import sync
    from courtloom.plans.q_windows import speed
    curve = sync.lag_correlation(speed(spark, sf), ["game", "chunk"], "cam", 0, "frame", "z", 20)
    lags = sync.peak_ratio(curve, ["game", "chunk", "cam"])
    return sync.offset_mode(lags, ["cam"], 1.0).withColumnRenamed("offset", "off")


@query("jn20c_best_residual", "game cam d median_cm:h n margin:k", "streams", f"""with curve as ({SWEEP_SQL}), b as (select * from curve qualify row_number() over (partition by game, cam order by median_cm, d) = 1),
  v as (select c.game, c.cam, min(case when abs(c.d - b.d) > 3 then c.median_cm end) as rival from curve c join b on c.game = b.game and c.cam = b.cam group by all)
  select b.game, b.cam, b.d, b.median_cm, b.n, rival / median_cm as margin from b join v using (game, cam)""")
def _(spark, sf):
    from courtloom.operators import sync
    return sync.best_residual(sync.read_lag_sweep(numbered_streams(spark, sf), 0, sweep=10, tol=1, min_pairs=20))


@query("agg32b_leave_one_out_threshold", "threshold:k", "", """with e as (select vec_id, label, embedding::double[] as v from embeddings), u as (select vec_id, label, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-8)) as v from e),
  d as (select q.vec_id, min(floor((1 - list_dot_product(q.v, g.v)) * 1e9 + 5e-1)) / 1e9 as s from u q join u g on q.vec_id <> g.vec_id and q.label = g.label group by q.vec_id)
  select quantile_cont(floor(s * 1e6 + 5e-1), 75e-2) / 1e6 as threshold from d""")
def _(spark, sf):
    from courtloom.operators import appearance
    u = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label", V.l2_normalise(V.as_double(col("embedding"))).alias("v"))
    return appearance.loo_threshold(u, "vec_id", "label", "v")
