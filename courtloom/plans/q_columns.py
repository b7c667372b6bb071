"""Projections, predicates and scalar functions over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtloom import constants as C
from courtloom.functions import geometry as G
from courtloom.functions import text as T
from courtloom.functions import vectors as V
from courtloom.plans import adapters as A
from courtloom.plans.registry import query

col = F.col
HULL_POINTS = [(0.0, 0.0), (700.0, 0.0), (820.0, 500.0), (700.0, 1000.0), (0.0, 1000.0)]
UNDISTORT_SQL = """select r.*, c.*exclude(cam),
  case when lam is null or lam = 0 then u else (u - px) / (1e0 + coalesce(lam, 0e0) * (((u - px) * (u - px) + (v - py) * (v - py)) / (diag * diag))) + px end as ux,
  case when lam is null or lam = 0 then v else (v - py) / (1e0 + coalesce(lam, 0e0) * (((u - px) * (u - px) + (v - py) * (v - py)) / (diag * diag))) + py end as uy
  from (select *, (x1 + x2) / 2 as u, y2 as v from raw) r join calib c on r.cam = c.cam"""
COURT_SQL = f"""select *, (h0 * ux + h1 * uy + h2) / (h6 * ux + h7 * uy + h8) as cx,
  (h3 * ux + h4 * uy + h5) / (h6 * ux + h7 * uy + h8) as cy from ({UNDISTORT_SQL})"""


def foot_points(spark, sf):
    raw = A.raw_detections(spark, sf)
    box = G.Box.of()
    return raw.withColumn("u", box.foot[0]).withColumn("v", box.foot[1]).join(
        F.broadcast(A.calibration(spark)), "cam"
    )


def court_points(spark, sf):
    cx, cy = G.pixel_to_court(col("u"), col("v"))
    return foot_points(spark, sf).withColumn("cx", cx).withColumn("cy", cy)


@query("prj01_box_geometry", "game cam frame pk cx:h cy:h foot_x:h foot_y:h w:h h:h area:h", "raw",
       """select game, cam, frame, pk, (x1 + x2) / 2 as cx, (y1 + y2) / 2 as cy, (x1 + x2) / 2 as foot_x, y2 as foot_y,
          greatest(x2 - x1, 1e0) as w, y2 - y1 as h, (x2 - x1) * (y2 - y1) as area from raw""")
def _(spark, sf):
    b = G.Box.of()
    return A.raw_detections(spark, sf).select(
        "game", "cam", "frame", "pk", b.cx.alias("cx"), b.cy.alias("cy"), b.foot[0].alias("foot_x"),
        b.foot[1].alias("foot_y"), b.width.alias("w"), b.height.alias("h"), b.area.alias("area"))


IOU_SQL = """case when least(a.x2, b.x2) > greatest(a.x1, b.x1) and least(a.y2, b.y2) > greatest(a.y1, b.y1)
  then (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1))
   / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1)
      - (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)))
  else 0e0 end"""


@query("prj02_iou", "game cam frame det_idx sid:s iou:k", "det streams",
       f"""select a.game, a.cam, a.frame, a.det_idx, b.sid, {IOU_SQL} as iou
           from det a join streams b on a.game = b.game and a.cam = b.cam and a.frame = b.frame where a.class_id = 0""")
def _(spark, sf):
    a = A.detections(spark, sf).filter("class_id = 0").select("game", "cam", "frame", "det_idx", "x1", "y1", "x2", "y2")
    b = A.streams(spark, sf).selectExpr("game", "cam", "frame", "sid", "x1 as bx1", "y1 as by1", "x2 as bx2", "y2 as by2")
    return a.join(b, ["game", "cam", "frame"]).withColumn("iou", G.iou(G.Box.of(), G.Box.of("b")))


@query("prj03_undistort", "game cam frame pk ux:k uy:k", "raw calib", f"select * from ({UNDISTORT_SQL})")
def _(spark, sf):
    ux, uy = G.undistort(col("u"), col("v"), col("lam"), col("px"), col("py"), col("diag"))
    return foot_points(spark, sf).withColumn("ux", ux).withColumn("uy", uy)


@query("prj04_homography", "game cam frame pk cx:h cy:h", "raw calib", COURT_SQL)
def _(spark, sf):
    return court_points(spark, sf)


@query("prj05_court_gate", "game cam frame pk cx:h cy:h", "raw calib",
       f"select * from ({COURT_SQL}) where cx between 300e0 and 1843.7e0 and cy between 300e0 and 1126.4e0")
def _(spark, sf):
    return court_points(spark, sf).filter(G.on_court(col("cx"), col("cy"), -300.0))


_EDGES = "(values " + ", ".join(
    f"({a[0]:.1f}::double, {a[1]:.1f}::double, {b[0]:.1f}::double, {b[1]:.1f}::double)"
    for a, b in zip(HULL_POINTS, HULL_POINTS[1:] + HULL_POINTS[:1])
) + ") as e(ax, ay, fx, fy)"


def hull_literal():
    return F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in HULL_POINTS])


@query("prj06_hull_gate", "game uid frame dist:h", "obs",
       f"""with d as (select game, uid, frame, cx, cy, ax, ay, fx, fy,
             least(greatest(((cx - ax) * (fx - ax) + (cy - ay) * (fy - ay)) / ((fx - ax) * (fx - ax) + (fy - ay) * (fy - ay)), 0e0), 1e0) as t
             from obs, {_EDGES}),
           s as (select game, uid, frame,
             min(sqrt((cx - (ax + t * (fx - ax))) * (cx - (ax + t * (fx - ax))) + (cy - (ay + t * (fy - ay))) * (cy - (ay + t * (fy - ay))))) as near,
             sum(case when (ay > cy) <> (fy > cy) and cx < (fx - ax) * (cy - ay) / (case when fy = ay then 1e0 else fy - ay end) + ax then 1 else 0 end) as hits
             from d group by game, uid, frame)
           select game, uid, frame, case when hits % 2 = 1 then near else -near end as dist from s
           where case when hits % 2 = 1 then near else -near end >= -250""")
def _(spark, sf):
    return (A.observations(spark, sf)
            .withColumn("dist", G.hull_distance(col("cx"), col("cy"), hull_literal()))
            .filter(col("dist") >= -C.HULL_PAD))


@query("prj07_in_court_share", "cam n share:k", "raw calib",
       f"""select cam, count(*) as n, avg(case when cx between -300 and 2443.7 and cy between -300 and 1726.4 then 1e0 else 0e0 end) as share
           from ({COURT_SQL}) group by cam""")
def _(spark, sf):
    inside = G.on_court(col("cx"), col("cy")).cast("double")
    return court_points(spark, sf).groupBy("cam").agg(F.count(F.lit(1)).alias("n"), F.avg(inside).alias("share"))


@query("prj08_reprojection_error", "cam n mean_cm:h max_cm:h", "raw calib",
       f"""with p as (select cam, cast(floor(sqrt((cx - u * 2) * (cx - u * 2) + (cy - v * 2) * (cy - v * 2)) * 10 + 5e-1) as bigint) as e from ({COURT_SQL}) where det_idx = 1)
           select cam, count(*) as n, sum(e) / 1e1 / count(*) as mean_cm, max(e) / 1e1 as max_cm from p group by cam""")
def _(spark, sf):
    # each slot-1 detection is a correspondence whose known court point is twice its pixel
    err = G.distance(col("cx"), col("cy"), col("u") * 2, col("v") * 2)
    e = F.floor(err * 10 + 0.5)
    return (court_points(spark, sf).filter("det_idx = 1").groupBy("cam")
            .agg(F.count(F.lit(1)).alias("n"), (F.sum(e) / F.lit(10.0) / F.count(F.lit(1))).alias("mean_cm"),
                 (F.max(e) / F.lit(10.0)).alias("max_cm")))


@query("prj09_region_confidence", "game cam frame pk conf:k team:s jersey", "raw",
       """select game, cam, frame, pk, score * least(greatest((y2 - y1) / 260e0, 35e-2), 13e-1) as conf,
          case when t = 'REF' then case when y2 - y1 >= 100 then t end when cam >= 2 and y2 - y1 >= 120 then t end as team,
          case when cam >= 2 and y2 - y1 >= 120 and t <> 'REF' then num end as jersey
          from (select *, case class_id when 1 then 'REF' when 0 then kit else 'A' end as t from raw)""")
def _(spark, sf):
    raw = A.raw_detections(spark, sf).withColumn(
        "t", F.expr("case class_id when 1 then 'REF' when 0 then kit else 'A' end"))
    h, near = G.Box.of().height, col("cam") >= 2
    return (raw.withColumn("conf", G.zone_confidence(col("score"), h)).withColumn("team", G.gated_team(col("t"), near, h))
            .withColumn("jersey", G.gated_jersey(col("num"), col("t"), near, h)))


PAIR_SQL = """select b.game, b.cam, b.frame, b.ball_x, b.ball_y, b.det_idx, s.sid, s.x1, s.y1, s.x2, s.y2, greatest(s.x2 - s.x1, 1e0) as w
  from ball b join streams s on b.game = s.game and b.cam = s.cam and b.frame = s.frame"""


def ball_boxes(spark, sf):
    """JN3: every stream box at the ball's camera and frame (at most 20 boxes per ball)."""
    b = A.ball(spark, sf).select("game", "cam", "frame", "chunk", "ball_x", "ball_y", "det_idx")
    s = A.streams(spark, sf).select("game", "cam", "frame", "sid", "x1", "y1", "x2", "y2")
    return b.join(s, ["game", "cam", "frame"])


@query("prj10_expanded_ball_distance", "game cam frame sid:s dist:k", "ball streams",
       f"""select *, case when abs(dx) <= hw and abs(dy) <= hh then 0e0
             else sqrt((dx / greatest(hw, 1e0)) * (dx / greatest(hw, 1e0)) + (dy / greatest(hh, 1e0)) * (dy / greatest(hh, 1e0))) end as dist
           from (select *, ball_x - (x1 + x2) / 2 as dx, ball_y - (y1 + y2) / 2 as dy, (x2 - x1) * 135e-2 / 2 as hw, (y2 - y1) * 135e-2 / 2 as hh from ({PAIR_SQL}))""")
def _(spark, sf):
    return ball_boxes(spark, sf).withColumn("dist", G.expanded_ball_distance(G.Box.of(), col("ball_x"), col("ball_y")))


HOLD_SQL = f"""select *, (case when det_idx % 3 = 0 then 5e-1 else 1e0 end) * (1e0 - 5e-1 * dx) as vote from
  (select *, abs(ball_x - (x1 + x2) / 2) / w as dx from ({PAIR_SQL})) where ball_y <= y2 and dx <= 7e-1 and ball_y >= y1 - 1e-1 * (y2 - y1)"""


@query("prj11_hold_vote", "game cam frame sid:s vote:k", "ball streams", HOLD_SQL)
def _(spark, sf):
    imputed = F.when(col("det_idx") % 3 == 0, 1).otherwise(0)
    return ball_boxes(spark, sf).withColumn("vote", G.hold_vote(G.Box.of(), col("ball_x"), col("ball_y"), imputed)).filter("vote is not null")


@query("prj12_under_ball_weight", "game cam frame sid:s weight:k", "ball streams",
       f"""select *, exp(-(sqrt((ball_x - (x1 + x2) / 2) * (ball_x - (x1 + x2) / 2) + (ball_y - y1) * (ball_y - y1)) / w)) as weight from ({PAIR_SQL})
           where ball_x between x1 - 6e-1 * w and x2 + 6e-1 * w and ball_y <= y2 and ball_y <= y1 + 6e-1 * (y2 - y1)""")
def _(spark, sf):
    return ball_boxes(spark, sf).withColumn("weight", G.under_ball_weight(G.Box.of(), col("ball_x"), col("ball_y"), 0.6)).filter("weight is not null")


@query("prj13_ankle_foot", "vec_id fx:k fy:k", "",
       """with k as (select vec_id, embedding[31]::double as ax, embedding[32]::double as ay, embedding[33]::double as b_x, embedding[34]::double as b_y,
            abs(embedding[16]::double) * 5 >= 5e-1 as va, abs(embedding[17]::double) * 5 >= 5e-1 as vb from embeddings)
          select vec_id, case when va and vb then (ax + b_x) / 2 when va then ax when vb then b_x else 5e-1 end as fx,
            case when va and vb then (ay + b_y) / 2 + 7e-2 * 2 when va then ay + 7e-2 * 2 when vb then b_y + 7e-2 * 2 else 2e0 end as fy from k""")
def _(spark, sf):
    # embedding components stand in for a 17-point pose in a 1 x 2 box
    emb = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", V.as_double(col("embedding")).alias("e"))
    pts = F.transform(F.sequence(F.lit(0), F.lit(16)), lambda i: F.struct(
        col("e")[i * 2].alias("x"), col("e")[i * 2 + 1].alias("y")))
    scores = F.transform(F.sequence(F.lit(0), F.lit(16)), lambda i: F.abs(col("e")[i]) * 5)
    box = G.Box(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(2.0))
    fx, fy = G.ankle_foot(box, col("pts"), col("ks"))
    return emb.withColumn("pts", pts).withColumn("ks", scores).select("vec_id", fx.alias("fx"), fy.alias("fy"))


DIST_SQL = """least(sqrt((cx - 1077e-1) * (cx - 1077e-1) + (cy - 7132e-1) * (cy - 7132e-1)),
  sqrt((cx - 2036e0) * (cx - 2036e0) + (cy - 7132e-1) * (cy - 7132e-1)))"""
ZONE_SQL = "case when dist < 710 then '2PT' when dist < 840 then '3PT' else '4PT' end"


@query("prj14_zone", "game uid frame dist:h zone:s zone_geo:s", "obs",
       f"""select *, {ZONE_SQL} as zone, case when dist < 6706e-1 then '2PT' when dist < case when l < r then 9495e-1 else 9398e-1 end then '3PT' else '4PT' end as zone_geo
           from (select *, least(l, r) as dist from (select *, sqrt((cx - 1077e-1) * (cx - 1077e-1) + (cy - 7132e-1) * (cy - 7132e-1)) as l,
           sqrt((cx - 2036e0) * (cx - 2036e0) + (cy - 7132e-1) * (cy - 7132e-1)) as r from obs))""")
def _(spark, sf):
    return (A.observations(spark, sf).withColumn("dist", G.basket_distance(col("cx"), col("cy")))
            .withColumn("zone", G.zone(col("dist"))).withColumn("zone_geo", G.zone_geometric(col("cx"), col("cy"))))


@query("prj15_free_throw_band", "game uid frame dist:h", "obs",
       f"select * from (select *, {DIST_SQL} as dist from obs) where dist between 430 and 610 and dist < 710")
def _(spark, sf):
    d = A.observations(spark, sf).withColumn("dist", G.basket_distance(col("cx"), col("cy")))
    return d.filter(G.in_free_throw_band(col("dist"), G.zone(col("dist"))))


CLS = "case k % 12 when 0 then 'FG_MAKE' when 1 then 'FG_MISS' when 2 then '3PT_MAKE' when 3 then '3PT_MISS' when 4 then '4PT_MAKE' when 5 then '4PT_MISS' when 6 then 'REBOUND' when 7 then 'STEAL' when 8 then 'TURNOVER' when 9 then 'FREE_THROW_MAKE' when 10 then 'FREE_THROW_MISS' else 'FOUL' end"


@query("prj16_play_taxonomy", "eid cls:s kind:s gt_zone:s gt_verdict:s label:s", "evt",
       f"""select *, case when k % 12 < 6 then 'shot' when k % 12 = 6 then 'possession_flip' when k % 12 in (7, 8) then 'turnover' else 'ignore' end as kind,
           case left(cls, 3) when '4PT' then '4PT' when '3PT' then '3PT' else '2PT' end as gt_zone,
           case when contains(cls, 'MAKE') then 'MAKE' else 'MISS' end as gt_verdict,
           (case when val % 4 = 0 then 'FREE_THROW' else case val % 3 when 0 then 'FG' when 1 then '3PT' else 'FG' end end) || '_' || (case when val % 7 < 3 then 'MAKE' when val % 7 < 6 then 'MISS' else 'ATTEMPT' end) as label
           from (select *, {CLS} as cls from evt)""")
def _(spark, sf):
    e = A.events(spark, sf).withColumn("cls", F.expr(CLS))
    zone = F.expr("case val % 3 when 0 then '2PT' when 1 then '3PT' end")
    verdict = F.expr("case when val % 7 < 3 then 'MAKE' when val % 7 < 6 then 'MISS' end")
    return e.select("eid", "cls", T.play_kind(col("cls")).alias("kind"), T.ground_truth_zone(col("cls")).alias("gt_zone"),
                    T.ground_truth_verdict(col("cls")).alias("gt_verdict"),
                    T.shot_class(col("val") % 4 == 0, zone, verdict).alias("label"))


@query("prj17_stream_id", "game cam frame sid:s num kit:s", "raw",
       """select game, cam, frame, sid, pk % 100 as num, case when sk % 3 > 0 then kit end as kit
          from (select *, concat(case when qty % 2 = 0 then '#' else '' end, 'n', pk % 100, case when sk % 3 > 0 then kit else '' end) as sid from raw)""")
def _(spark, sf):
    raw = A.raw_detections(spark, sf).drop("num", "kit").withColumn("sid", F.expr(
        "concat(case when qty % 2 = 0 then '#' else '' end, 'n', pk % 100, case when sk % 3 > 0 then case when floor(sk / 4) % 2 = 0 then 'B' else 'W' end else '' end)"))
    return raw.select("game", "cam", "frame", "sid", T.stream_number(col("sid")).alias("num"), T.stream_kit(col("sid")).alias("kit"))


@query("prj18_last_name", "p_partkey last:s", "",
       """select p_partkey, string_split(p_name, ' ')[-1] as last from part""")
def _(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    marked = F.when(col("p_partkey") % 3 == 0, F.concat("p_name", F.lit("?"))).otherwise(col("p_name"))
    return part.select("p_partkey", T.last_name(marked).alias("last"))


STEM = "concat(case when pk % 9 = 0 then 'frame' else 'g' || game end, case when pk % 5 = 0 then '_x' else '' end, '_', case cam when 0 then 'FL' when 1 then 'FR' when 2 then 'NL' else 'QQ' end, '_f', frame)"


@query("prj19_stem_provenance", "stem:s game_key:s angle:s", "raw",
       f"""select {STEM} as stem, case when pk % 9 = 0 then 'frame' else 'g' || game end as game_key,
           case cam when 0 then 'FL' when 1 then 'FR' when 2 then 'NL' end as angle from raw""")
def _(spark, sf):
    s = A.raw_detections(spark, sf).select(F.expr(STEM).alias("stem"))
    return s.select("stem", T.stem_game(col("stem")).alias("game_key"), T.stem_angle(col("stem")).alias("angle"))


NAME = "concat(source, '_', doc_id, case doc_id % 5 when 0 then '.jpg' when 1 then '.JPEG' when 2 then '.png' when 3 then '.txt' else '.jpg.bak' end)"


@query("prj20_image_name", "doc_id name:s", "", f"select doc_id, {NAME} as name from documents where doc_id % 5 <= 2")
def _(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.expr(NAME).alias("name"))
    return d.filter(T.is_image(col("name")))


@query("prj21_frame_clock", "eid frame t:k clock:s", "evt",
       """select eid, frame, round_even((frame - 100) / 2997e-2, 2) as t,
            lpad(cast(cast(floor(sec / 60) as bigint) as varchar), 2, '0') || ':' || lpad(cast(sec % 60 as varchar), 2, '0') as clock
          from (select eid, sec % 5400 as sec, cast(round_even((sec % 5400) * 2997e-2, 0) as bigint) as frame from evt)""")
def _(spark, sf):
    e = A.events(spark, sf).withColumn("s", col("sec") % 5400).withColumn("frame", T.frame_of(col("s")))
    return e.select("eid", "frame", T.seconds_of(col("frame"), F.lit(100)).alias("t"), T.clock_text(col("s")).alias("clock"))


@query("prj22_box_formats", "game cam frame pk x:h y:h w:h h:h ncx:k nh:k", "raw",
       """select game, cam, frame, pk, (ncx - nw / 2) * 1920e0 as x, (ncy - nh / 2) * 1080e0 as y, nw * 1920e0 as w, nh * 1080e0 as h, ncx, nh from
          (select *, (x1 + x2) / 2 / 1920e0 as ncx, (y1 + y2) / 2 / 1080e0 as ncy, (x2 - x1) / 1920e0 as nw, (y2 - y1) / 1080e0 as nh from raw)""")
def _(spark, sf):
    w, h = F.lit(1920.0), F.lit(1080.0)
    ncx, ncy, nw, nh = G.xyxy_to_yolo(G.Box.of(), w, h)
    raw = A.raw_detections(spark, sf).select("game", "cam", "frame", "pk", ncx.alias("ncx"), ncy.alias("ncy"), nw.alias("nw"), nh.alias("nh"))
    x, y, bw, bh = G.yolo_to_xywh(col("ncx"), col("ncy"), col("nw"), col("nh"), w, h)
    return raw.select("game", "cam", "frame", "pk", x.alias("x"), y.alias("y"), bw.alias("w"), bh.alias("h"), "ncx", "nh")


@query("prj23_class_remap", "game cam frame pk src dst", "raw",
       "select game, cam, frame, pk, qty % 6 as src, case qty % 6 when 0 then 2 when 1 then 0 when 4 then 1 end as dst from raw where qty % 6 in (0, 1, 4)")
def _(spark, sf):
    mapping = F.create_map(*[F.lit(v).cast("long") for v in (0, 2, 1, 0, 4, 1)])
    raw = A.raw_detections(spark, sf).withColumn("src", col("qty") % 6)
    return raw.withColumn("dst", mapping[col("src")]).filter("dst is not null")


@query("prj24_embedding_maths", "vec_id cos:k unit0:k", "",
       """with c as (select embedding::double[] as c from embeddings where vec_id = 0),
          n as (select vec_id, embedding::double[] as e from embeddings)
          select vec_id, list_dot_product(e, c) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(c, c)) + 1e-8) as cos,
            e[1] / (sqrt(list_dot_product(e, e)) + 1e-8) as unit0 from n, c""")
def _(spark, sf):
    emb = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", V.as_double(col("embedding")).alias("e"))
    anchor = emb.filter("vec_id = 0").select(col("e").alias("c"))        # one row
    return emb.join(F.broadcast(anchor)).select(
        "vec_id", V.cosine(col("e"), col("c")).alias("cos"), V.l2_normalise(col("e"))[0].alias("unit0"))


@query("prj25_hash_split", "o_custkey bucket is_val", "",
       """select distinct o_custkey, bucket, case when bucket < 150 then 1 else 0 end as is_val from
          (select o_custkey, ('0x' || left(md5('7:' || o_custkey), 8))::bigint % 1000 as bucket from orders)""")
def _(spark, sf):
    g = spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey").distinct()
    return g.select("o_custkey", T.hash_bucket(col("o_custkey"), 7).alias("bucket"),
                    T.in_validation(col("o_custkey"), 7, 0.15).cast("long").alias("is_val"))


CLASS_NAME = "case when pk % 50 = 7 then 'Basketball Hoop' when pk % 50 = 8 and game = 1 then 'crowd' when pk % 3 = 0 then 'Player' when pk % 3 = 1 then 'referee' else ' ball' end"


@query("prj26_source_role", "sk role:s n_classes", "raw",
       f"""with n as (select distinct sk, lower(trim(case when sk % 5 = 0 then (case when pk % 2 = 0 then 'basketball' else 'basketball hoop' end)
              when sk % 5 = 1 then {CLASS_NAME} else (case when pk % 3 = 0 then 'Player' else 'ball' end) end)) as c from raw)
           select sk, count(*) as n_classes, case when bool_and(c in ('player', 'referee', 'ball')) then 'detection'
             when bool_and(c in ('basketball', 'basketball hoop')) then 'rim' else 'other' end as role from n group by sk""")
def _(spark, sf):
    name = F.expr(f"""case when sk % 5 = 0 then (case when pk % 2 = 0 then 'basketball' else 'basketball hoop' end)
        when sk % 5 = 1 then {CLASS_NAME} else (case when pk % 3 = 0 then 'Player' else 'ball' end) end""")
    names = A.raw_detections(spark, sf).groupBy("sk").agg(F.collect_set(F.lower(F.trim(name))).alias("names"))
    return names.select("sk", T.source_role(col("names")).alias("role"), F.size("names").alias("n_classes"))


@query("prj27_confidence_tier", "eid tier:s conf:k", "cv",
       """select eid, case when rq <= 16e-1 and verdict is not null then 'high' else 'low' end as tier,
            case when rq <= 16e-1 and verdict is not null then 8e-1 else 4e-1 end as conf
          from (select *, case k % 3 when 0 then 'MAKE' when 1 then 'MISS' end as verdict, case when k % 5 > 0 then uid end as player from cv)
          where player is not null or verdict is not null""")
def _(spark, sf):
    cv = A.cv_events(spark, sf).withColumn("verdict", F.expr("case k % 3 when 0 then 'MAKE' when 1 then 'MISS' end")).withColumn(
        "player", F.expr("case when k % 5 > 0 then uid end")).filter("player is not null or verdict is not null")
    tier = T.confidence_tier(col("rq"), col("verdict"))
    return cv.select("eid", tier.alias("tier"), T.tier_confidence(tier).alias("conf"))


@query("prj28_event_label", "game frame gid label:s", "world",
       """select game, frame, gid, (case team when 'A' then 'Blue' when 'B' then 'Green' else coalesce(team, '?') end) ||
            case when jersey is not null then ' #' || jersey else ' id' || gid end as label from world""")
def _(spark, sf):
    return A.world(spark, sf).select("game", "frame", "gid", T.player_label(col("team"), col("jersey"), col("gid")).alias("label"))


@query("prj29_read_eligible", "game cam frame pk", "raw",
       "select * from raw where frame % 3 = 0 and y2 - y1 >= 90 and least(x2, 420e0) - greatest(x1, 30e0) >= 20 and score >= 6e-1")
def _(spark, sf):
    clipped = F.least(col("x2"), F.lit(420.0)) - F.greatest(col("x1"), F.lit(30.0))
    keep = T.read_eligible(col("frame"), 3, G.Box.of().height, clipped, col("score"))
    return A.raw_detections(spark, sf).filter(keep & (col("score") >= 0.6))
