"""Readers and writers: driver tables are written in the documents' layouts and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtloom.functions import geometry as G
from courtloom.operators import datasets as D
from courtloom.plans import adapters as A
from courtloom.plans.q_columns import UNDISTORT_SQL
from courtloom.plans.q_joins import numbered_streams
from courtloom.plans.q_windows import segments
from courtloom.plans.registry import query
from courtloom.session import scratch_path
from courtloom.sources import readers, sinks

col = F.col
STEMS = "concat(game, '_', chunk * 10, '_10__', sid, '__', cam)"


@query("src01_detection_reader", "game cam frame n", "det",
       """with s as (select game, cam, unnest(range(0, max(frame) + 1)) as frame from det group by game, cam), c as (select game, cam, frame, count(*) as n from det group by all)
          select s.game, s.cam, s.frame, coalesce(n, 0) as n from s left join c using (game, cam, frame)""")
def _(spark, sf):
    path = scratch_path(spark, "detections")
    A.detections(spark, sf).write.mode("overwrite").partitionBy("game", "cam").parquet(path)
    d = readers.detections(spark, path).withColumn("game", col("game").cast("long")).withColumn("cam", col("cam").cast("long"))
    frames = d.groupBy("game", "cam").agg((F.max("frame") + 1).alias("n_frames"))
    return readers.frame_counts(d, frames)


@query("src02_stream_dump_reader", "game tag:s sid:s cam frame x1:h y2:h", "streams", "select game, chunk * 10 || '_10' as tag, sid, cam, frame, x1, y2 from streams where det_idx % 7 > 0")
def _(spark, sf):
    path = scratch_path(spark, "dumps")
    rec = F.struct(F.array("x1", "y1", "x2", "y2").alias("box"), (col("det_idx") % 7 > 0).alias("present"), "score")
    docs = A.streams(spark, sf).groupBy(F.expr(STEMS).alias("stem")).agg(F.map_from_entries(F.collect_list(F.struct(col("frame").cast("string"), rec))).alias("frames"))
    docs.write.mode("overwrite").json(path)
    return readers.stream_dumps(spark, path)


@query("src03_play_reader", "game play_id t:k cls:s player_a:s", "plays", "select game, play_id, t / 1e1 as t, case when k % 2 = 0 then 'FG_MAKE' else 'REBOUND' end as cls, 'P' || uid as player_a from plays")
def _(spark, sf):
    path = scratch_path(spark, "plays")
    p = A.plays(spark, sf).select("game", F.floor(col("t") / 86400).alias("day"), F.floor(col("t") / 3600).alias("hour"), "play_id", (col("t") / 10).alias("t"), F.expr("case when k % 2 = 0 then 'FG_MAKE' else 'REBOUND' end").alias("cls"), F.concat(F.lit("P"), "uid").alias("a"))
    # a document holds an hour of a game, in one of the two layouts
    one = p.filter("day % 2 = 0").groupBy("game", "day", "hour").agg(F.collect_list(F.struct("play_id", "t", "cls", "a")).alias("plays"))
    two = p.filter("day % 2 = 1").groupBy("game", "day", "hour").agg(F.collect_list(F.struct("play_id", col("t").alias("ts"), col("cls").alias("classification"), col("a").alias("player_a"))).alias("rows"))
    both = one.unionByName(two, allowMissingColumns=True)
    both.withColumn("game", col("game").cast("string")).write.mode("overwrite").json(path)
    return readers.plays(spark, path)


@query("src04_calibration_reader", "cam n sx:h", "raw calib", f"select cam, count(*) as n, sum(floor(ux * 10 + 5e-1)) / 1e1 as sx from ({UNDISTORT_SQL}) group by cam")
def _(spark, sf):
    path = scratch_path(spark, "calib")
    h = F.array(*[F.array(*[col(f"h{3 * i + j}") for j in range(3)]) for i in range(3)])
    A.calibration(spark).select("cam", h.alias("homography_matrix"), F.array(F.lit(400.0), F.lit(400.0)).alias("image_size"), col("lam").alias("division_lambda")).write.mode("overwrite").json(path)
    c = readers.calibration(spark, path).withColumn("diag", F.lit(282.84))
    raw = A.raw_detections(spark, sf).withColumn("u", G.Box.of().cx).withColumn("v", col("y2"))
    ux, _uy = G.undistort(col("u"), col("v"), col("lam"), col("px"), col("py"), col("diag"))
    return raw.join(F.broadcast(c), "cam").groupBy("cam").agg(F.count(F.lit(1)).alias("n"), (F.sum(F.floor(ux * 10 + 0.5)) / F.lit(10.0)).alias("sx"))


@query("src05_label_reader", "stem:s n_labels", "det",
       """with i as (select distinct concat(game, '_', cam, '_', chunk) as stem from det union select concat('empty_', game) from det), l as (select concat(game, '_', cam, '_', chunk) as stem, count(*) as n from det where class_id < 2 group by all)
          select i.stem, coalesce(n, 0) as n_labels from i left join l using (stem)""")
def _(spark, sf):
    path = scratch_path(spark, "labels")
    d = A.detections(spark, sf).withColumn("stem", F.concat_ws("_", "game", "cam", "chunk"))
    line = F.concat_ws(" ", "class_id", *[c.cast("string") for c in G.xyxy_to_yolo(G.Box.of(), F.lit(1920.0), F.lit(1080.0))])
    # the lines of a stem meet in one task and make one file; else each task would write a file for each stem
    d.filter("class_id < 2").select("stem", line.alias("value")).repartition("stem").write.mode("overwrite").partitionBy("stem").text(path)
    images = d.select("stem").distinct().union(d.select(F.concat(F.lit("empty_"), "game").alias("stem")).distinct())
    return readers.with_negatives(images, readers.label_lines(spark, path), "stem")


@query("src06_number_read_reader", "game frame cam cam_frame num conf:k kit:s", "det offs",
       "select d.game, frame, d.cam, frame + off as cam_frame, num, score as conf, kit from det d join offs o on d.game = o.game and d.cam = o.cam where class_id = 0 and score >= 7e-1")
def _(spark, sf):
    path = scratch_path(spark, "reads")
    offs = A.offsets(spark).groupBy("game").agg(F.map_from_entries(F.collect_list(F.struct(col("cam").cast("string"), "off"))).alias("offsets"))
    a = F.struct("frame", col("cam").cast("string").alias("cam"), F.array("x1", "y1", "x2", "y2").alias("box"), col("num").alias("number"), col("score").alias("conf"), "kit")
    d = A.detections(spark, sf).filter("class_id = 0 and score >= 7e-1").groupBy("game", col("chunk").cast("string").alias("tag")).agg(F.collect_list(a).alias("anchors"))
    d.join(F.broadcast(offs), "game").withColumn("game", col("game").cast("string")).write.mode("overwrite").json(path)
    return readers.number_reads(spark, path)


@query("src07_chunk_stitching", "game cam track_id global_frame", "trk", "select game, cam, track_id, cast(round_even(chunk * 10 * 2997e-2, 0) as bigint) + frame % 300 as global_frame from trk where chunk <> 1")
def _(spark, sf):
    t = A.tracks(spark, sf).withColumn("tag", col("chunk")).withColumn("frame", col("frame") % A.CHUNK)
    chunks = A.tracks(spark, sf).filter("chunk <> 1").select("game", col("chunk").alias("tag"), (col("chunk") * 10).alias("start_s")).distinct()
    return readers.stitch_chunks(t, chunks)


@query("src08_approved_ground_truth", "game player:s frame cam det_idx", "streams",
       """with s as (select * replace (cast(regexp_extract(sid, '[0-9]+') as bigint) as num) from streams where kit = 'B'), f as (select game, num, frame from s where frame % 3 > 0 group by all), e as (select game, num from f group by all having count(*) >= 30)
          select s.game, 'n' || s.num as player, s.frame, s.cam, s.det_idx from s join e using (game, num) where frame % 3 > 0""")
def _(spark, sf):
    path = scratch_path(spark, "gt")
    s = numbered_streams(spark, sf).filter("kit = 'B'")
    f = s.groupBy("game", "num", "frame").agg(F.map_from_entries(F.collect_list(F.struct(col("cam").cast("string"), "det_idx"))).alias("picks"))
    doc = f.withColumn("chunk", F.floor(col("frame") / A.CHUNK)).groupBy(col("game").cast("string").alias("game"), F.concat(F.lit("n"), "num").alias("player"), "chunk").agg(
        F.map_from_entries(F.collect_list(F.struct(col("frame").cast("string"), "picks"))).alias("frames"),
        F.map_from_entries(F.collect_list(F.struct(col("frame").cast("string"), col("frame") % 3 > 0))).alias("approved"))
    doc.drop("chunk").write.mode("overwrite").json(path)
    return readers.approved_players(spark, path)


@query("snk01_segment_sink", "game start_frame end_frame value:s", "seg", "select game, start_frame, end_frame, value from seg")
def _(spark, sf):
    path = scratch_path(spark, "segments")
    sinks.holder_segments(segments(spark, sf), path)
    return spark.read.parquet(path)


@query("snk02_world_state_sink", "game chunk frame gid cx:h", "world", "select game, chunk, frame, gid, cx from world")
def _(spark, sf):
    path = scratch_path(spark, "world")
    sinks.world_state(A.world(spark, sf), path)
    w = spark.read.schema("chunk long, frame long, tracks array<struct<gid: long, court_xy: array<double>, team: string, jersey: long>>, game long").json(path)
    return w.select("game", "chunk", "frame", F.inline("tracks")).withColumn("cx", col("court_xy")[0])


def coco_rows(spark, sf):
    b = A.detections(spark, sf).withColumn("split", F.expr("case when game = 3 then 'valid' else 'train' end")).withColumn("ord", col("frame") * 16 + col("game") * 4 + col("cam")).withColumn("stem", col("ord").cast("string"))
    cx, cy, w, h = G.xyxy_to_yolo(G.Box.of(), F.lit(1920.0), F.lit(1080.0))
    images = b.select("split", "stem", "ord", F.lit(1920.0).alias("width"), F.lit(1080.0).alias("height")).distinct()
    boxes = b.select("split", "stem", "class_id", cx.alias("cx"), cy.alias("cy"), w.alias("w"), h.alias("h"))
    return D.coco_document(boxes, images, "split", "ord", 4000)


@query("snk03_coco_writer", "split:s image_id class_id x:h area:h", "det",
       """select case when game = 3 then 'valid' else 'train' end as split, dense_rank() over (partition by case when game = 3 then 'valid' else 'train' end order by frame * 16 + game * 4 + cam) as image_id, class_id,
          ((x1 + x2) / 2 / 1920e0 - (x2 - x1) / 1920e0 / 2) * 1920e0 as x, ((x2 - x1) / 1920e0 * 1920e0) * ((y2 - y1) / 1080e0 * 1080e0) as area from det""")
def _(spark, sf):
    path = scratch_path(spark, "coco")
    sinks.coco(coco_rows(spark, sf), path)
    d = spark.read.schema("image_id long, annotations array<struct<class_id: long, bbox: array<double>, area: double>>, split string").json(path)
    return d.select("split", "image_id", F.inline("annotations")).withColumn("x", col("bbox")[0])


@query("snk04_event_feed_sink", "game t eid", "cv", "select game, t, eid from cv")
def _(spark, sf):
    path = scratch_path(spark, "feed")
    sinks.event_feed(A.cv_events(spark, sf).select("game", "t", "eid"), path)
    return spark.read.schema("t long, eid long, game long").json(path)


@query("snk05_append_ledger", "game version:s n", "plays cv", "select game, 'v1' as version, count(*) as n from plays group by game union all select game, 'v2', count(*) from cv group by game")
def _(spark, sf):
    path = scratch_path(spark, "ledger")
    for version, rows in (("v1", A.plays(spark, sf)), ("v2", A.cv_events(spark, sf))):
        sinks.append_ledger(rows.groupBy("game").agg(F.count(F.lit(1)).alias("n")).withColumn("version", F.lit(version)), path)
    return spark.read.parquet(path)


@query("snk06_feature_sink", "game frame cam n", "det", "select game, frame, cam, count(*) as n from det group by all")
def _(spark, sf):
    path = scratch_path(spark, "features")
    sinks.feature_table(A.detections(spark, sf).groupBy("game", "frame", "cam").agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.parquet(path)
