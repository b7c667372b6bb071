"""Dataset ETL, sorts, set operations and grouping sets over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtloom.operators import datasets as D
from courtloom.operators import ordered as O
from courtloom.plans import adapters as A
from courtloom.plans.registry import query

col = F.col
B = A.BLOCK
FR = ["game", "cam", "frame"]


def source_frames(spark, sf):
    d = A.detections(spark, sf).withColumn("source", col("det_idx") % 3)
    s = d.groupBy(*FR, "source").agg(F.count(F.lit(1)).alias("n"), F.sum((col("class_id") < 2).cast("long")).alias("labels"))
    return s.withColumn("priority", (col("source") * 2) % 3)


BUILD_SQL = """with s as (select game, cam, frame, det_idx % 3 as source, count(*) as n, sum((class_id < 2)::int) as labels from det group by all),
  c as (select * from s where labels > 0 qualify row_number() over (partition by game, cam, frame order by (source * 2) % 3, source) = 1),
  sp as (select *, case game when 0 then 'train' when 1 then 'valid' else 'test' end as split from c)"""


def consolidated(spark, sf):
    frames = D.claim_by_priority(source_frames(spark, sf), FR, "priority", "source", "labels", ["n", "labels"])
    split = A.offsets(spark).selectExpr("game", "case game when 0 then 'train' when 1 then 'valid' else 'test' end as split").distinct()
    return frames.join(F.broadcast(split), "game")


@query("etl01_consolidation", "game cam frame source n split:s", "det", BUILD_SQL + " select * from sp")
def _(spark, sf):
    return consolidated(spark, sf)


@query("etl02_split_validation", "game want:s have:s", "evt", """with c as (select distinct game, case when game % 2 = 0 then 'val' else 'train' end as want from evt), r as (select distinct game, case when game in (0, 2) then 'valid' when game = 1 then 'train' else 'test' end as have from evt where game < 4)
  select c.game, want, have from c left join r using (game) where have is null or case when want = 'val' then 'valid' else want end <> have""")
def _(spark, sf):
    e = A.events(spark, sf)
    config = e.selectExpr("game", "case when game % 2 = 0 then 'val' else 'train' end as split").distinct()
    reg = e.filter("game < 4").selectExpr("game", "case when game in (0, 2) then 'valid' when game = 1 then 'train' else 'test' end as split").distinct()
    return D.check_splits(config, reg)


@query("etl03_held_out_game_split", "game cam frame split:s", "det", BUILD_SQL + " select game, cam, frame, split from sp union all select game, cam, frame, 'valid' from sp where split = 'test'")
def _(spark, sf):
    return D.assign_validation(consolidated(spark, sf), "held_out_game", "cam", "frame")


@query("etl03b_temporal_holdout_split", "game cam frame split:s", "det", BUILD_SQL + """, t as (select *, row_number() over (partition by cam order by frame) as r, count(*) over (partition by cam) as c from sp where split = 'train')
  select game, cam, frame, case when r > c - greatest(cast(floor(c * 2e-1) as bigint), 1) then 'valid' else 'train' end as split from t union all select game, cam, frame, split from sp where split <> 'train'""")
def _(spark, sf):
    return D.assign_validation(consolidated(spark, sf), "temporal_holdout", "cam", "frame", 0.2, B)


@query("etl04_ordered_game_split", "sk n split:s", "raw", """with g as (select sk, count(*) as n from raw group by sk), r as (select *, row_number() over (order by sk) - 1 as i, count(*) over () as c from g)
  select sk, n, case when i < floor(c * 8e-1) then 'train' when i < floor(c * 92e-2) then 'valid' else 'test' end as split from r""")
def _(spark, sf):
    g = A.raw_detections(spark, sf).groupBy("sk").agg(F.count(F.lit(1)).alias("n"))
    return D.ordered_split(g, "sk", 0.80, 0.12)


@query("etl05_group_hash_split", "split:s n", "", """select case when ('0x' || left(md5('3:' || source), 8))::bigint % 1000 < 200 then 'valid' else 'train' end as split, count(*) as n from documents group by 1""")
def _(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("source", "doc_id")
    return D.group_hash_split(d, "source", "doc_id", 3, 0.2).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("etl06_label_triage", "status:s num n", "", """with l as (select case when toxic = 1 then 'unclear' when quality = 1 then 'usable' else 'none' end as status, doc_id % 10 as num from labels)
  select status, case when status = 'usable' then num end as num, count(*) as n from l group by all""")
def _(spark, sf):
    lab = spark.read.parquet(f"{sf}/labels.parquet")
    status = F.when(col("toxic") == 1, "unclear").when(col("quality") == 1, "usable").otherwise("none")
    return lab.withColumn("status", status).groupBy("status", F.when(col("status") == "usable", col("doc_id") % 10).alias("num")).agg(F.count(F.lit(1)).alias("n"))


TEACH_SQL = """with n as (select game, cam, frame, sum((score >= 7e-1)::int) as n, arg_max(det_idx, score * 1e4 + det_idx) filter (where score >= 7e-1) as b from det where class_id = 2 group by all),
  a as (select game, cam, frame, case when n = 1 then 'positive' else 'negative' end as auto, b from n where n <= 1), g as (select game, cam, frame, min(det_idx) as det_idx, case when min(det_idx) % 2 = 0 then 'positive' else 'negative' end as label from det where class_id = 0 and frame % 10 = 0 group by all),
  l as (select game, cam, frame, coalesce(g.label, a.auto) as label, case when g.label is not null then g.det_idx else a.b end as det_idx, case when g.label is not null then 'gold' else 'teacher' end as source from a full join g using (game, cam, frame))"""


def ball_labels(spark, sf):
    d = A.detections(spark, sf)
    gold = d.filter("class_id = 0 and frame % 10 = 0").groupBy(*FR).agg(F.min("det_idx").alias("det_idx")).withColumn("label", F.expr("case when det_idx % 2 = 0 then 'positive' else 'negative' end"))
    return D.pick_ball_labels(d.filter("class_id = 2"), gold, FR, 0.7)


@query("etl07_teacher_labels", "game cam frame label:s det_idx source:s", "det", TEACH_SQL + " select * from l")
def _(spark, sf):
    return ball_labels(spark, sf)


@query("etl07b_negative_ratio", "game cam frame label:s", "det", TEACH_SQL + """, c as (select sum((label = 'positive')::int) as p, sum((label = 'negative')::int) as q from l)
  select game, cam, frame, label from l, c where label = 'positive' or ('0x' || left(md5('neg:' || game || '_' || cam || '_' || frame), 8))::bigint % 1000 < p * 5e-1 / greatest(q, 1) * 1000""")
def _(spark, sf):
    return D.keep_negatives(ball_labels(spark, sf), F.concat_ws("_", *FR), 0.5, "neg")


@query("etl08_capped_identity_sample", "game num cam frame sid:s rank", "streams", """with h as (select *, ('0x' || left(md5('cap:' || game || '_' || cam || '_' || frame || '_' || sid), 15))::bigint as h from streams)
  select game, num, cam, frame, sid, row_number() over (partition by game, num, cam order by h) as rank from h qualify rank <= 12""")
def _(spark, sf):
    return D.capped_sample(A.streams(spark, sf), ["game", "num", "cam"], F.concat_ws("_", "game", "cam", "frame", "sid"), 12, "cap")


@query("etl09_sampling_plan", "game play_id i sample_t:h cam:s", "plays", """select game, play_id, i, t - 6e1 + i * (9e1 / 4) as sample_t, case when k % 2 = 0 then 'NL' else 'NR' end as cam from plays cross join (select range as i from range(5))""")
def _(spark, sf):
    p = A.plays(spark, sf).withColumn("cam", F.expr("case when k % 2 = 0 then 'NL' else 'NR' end"))
    return D.sampling_plan(p, "t", 60.0, 30.0, 5)


@query("etl10_purged_queue", "source:s n n_next", "", """with d as (select source, doc_id from documents where n_chars > 500), r as (select *, row_number() over (partition by source order by left(md5(doc_id::varchar), 15)) as rn from d),
  q as (select * from r order by rn, md5(source) limit 400) select d.source, count(*) as n, (select count(*) from q where q.source = d.source) as n_next from d group by d.source""")
def _(spark, sf):
    from courtloom.operators import sequence as S
    d = spark.read.parquet(f"{sf}/documents.parquet").filter("n_chars > 500").select("source", "doc_id")
    nxt = S.round_robin(d, "source", "doc_id").orderBy("round", "group_hash").limit(400)
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n")).join(nxt.groupBy("source").agg(F.count(F.lit(1)).alias("n_next")), "source", "left").fillna(0, ["n_next"])


@query("agg29_dataset_audit", "source split:s class_id game cam n frames", "det", """with i as (select det_idx % 3 as source, case when game = 3 then 'test' else 'train' end as split, class_id, game, cam, frame from det)
  select source, split, class_id, game, cam, count(*) as n, count(distinct frame) as frames from i group by grouping sets ((source, split), (source, split, class_id), (source, split, game), (source, split, cam))""")
def _(spark, sf):
    i = A.detections(spark, sf).selectExpr("det_idx % 3 as source", "case when game = 3 then 'test' else 'train' end as split", "class_id", "game", "cam", "frame")
    return D.audit(i, ["source", "split"], "class_id", "game", "cam")


@query("agg30_build_report", "split:s images instances games cams duplicates", "det", BUILD_SQL + """, r as (select case game when 0 then 'train' when 1 then 'valid' else 'test' end as split, count(*) - count(distinct (game, cam, frame)) as duplicates from s where labels > 0 group by all)
  select split, count(*) as images, sum(labels) as instances, count(distinct game) as games, count(distinct cam) as cams, any_value(duplicates) as duplicates from sp join r using (split) group by split""")
def _(spark, sf):
    return D.build_report(consolidated(spark, sf), source_frames(spark, sf), FR)


@query("srt01_event_sort", "game t eid", "cv", "select game, t, eid from cv order by t, eid")
def _(spark, sf):
    return A.cv_events(spark, sf).select("game", "t", "eid").orderBy("t", "eid")


@query("srt02_worst_frames", "game cam frame misses", "det", "select game, cam, frame, count(*) as misses from det group by all order by misses desc, frame desc, game, cam limit 8")
def _(spark, sf):
    return A.detections(spark, sf).groupBy(*FR).agg(F.count(F.lit(1)).alias("misses")).orderBy(F.desc("misses"), F.desc("frame"), "game", "cam").limit(8)


@query("srt03_widest_per_group", "game num w frame cam det_idx", "det", "select game, num, x2 - x1 as w, frame, cam, det_idx from det where class_id = 0 qualify row_number() over (partition by game, num order by x2 - x1 desc, frame, cam, det_idx) <= 8")
def _(spark, sf):
    d = A.detections(spark, sf).filter("class_id = 0").withColumn("w", col("x2") - col("x1"))
    return O.top_per(d, ["game", "num"], [-col("w"), col("frame"), col("cam"), col("det_idx")], 8, ["w", "frame", "cam", "det_idx"])


@query("set01_union_events", "game kind:s t", "plays cv", "select game, 'gt' as kind, t from plays union all select game, 'cv', t from cv")
def _(spark, sf):
    return A.plays(spark, sf).select("game", F.lit("gt").alias("kind"), "t").unionByName(A.cv_events(spark, sf).select("game", F.lit("cv").alias("kind"), "t"))


@query("set02_roster_set_ops", "side:s num", "raw roster", "(select 'both' as side, num from (select pk % 90 as num from raw intersect select num from roster)) union all (select 'read_only', num from (select pk % 90 as num from raw except select num from roster))")
def _(spark, sf):
    mine = A.raw_detections(spark, sf).select((col("pk") % 90).alias("num")).distinct()
    known = A.roster(spark, sf).select("num")
    return mine.intersect(known).select(F.lit("both").alias("side"), "num").unionByName(mine.exceptAll(known.distinct()).select(F.lit("read_only").alias("side"), "num"))


CAMERAS = {"a": 0, "b": 1, "c": 2, "d": 3}
FULL_SQL = " full join ".join(f"(select game, frame, count(*) as {n} from det where cam = {k} group by all)" + (" using (game, frame)" if k else "") for n, k in CAMERAS.items())


@query("set03_frame_key_union", "game frame a b c d", "det", f"select game, frame, a, b, c, d from {FULL_SQL}")
def _(spark, sf):
    counts = [F.nullif(F.count_if(col("cam") == k), F.lit(0)).alias(n) for n, k in CAMERAS.items()]
    return A.detections(spark, sf).groupBy("game", "frame").agg(*counts)      # the union of the cameras' frame keys in one shuffle


@query("grp01_rollup_breakdown", "class_id cam n s:k", "det", "select class_id, cam, count(*) as n, sum(cast(floor(score * 100 + 5e-1) as bigint)) / 1e2 as s from det group by rollup (class_id, cam)")
def _(spark, sf):
    return A.detections(spark, sf).rollup("class_id", "cam").agg(F.count(F.lit(1)).alias("n"), (F.sum(F.round(col("score") * 100).cast("long")) / F.lit(100.0)).alias("s"))


@query("grp02_confusion_pivot", "gt:s A B loose", "cand", """with p as (select case when cand in ('click', 'view') then 'A' when cand in ('purchase', 'error') then 'B' else 'loose' end as gt, case when frame % 4 = 0 then 'loose' when frame % 3 = 0 then 'A' else 'B' end as d from cand)
  select gt, sum((d = 'A')::int) as A, sum((d = 'B')::int) as B, sum((d = 'loose')::int) as loose from p group by gt""")
def _(spark, sf):
    p = A.candidates(spark, sf).selectExpr("case when cand in ('click', 'view') then 'A' when cand in ('purchase', 'error') then 'B' else 'loose' end as gt", "case when frame % 4 = 0 then 'loose' when frame % 3 = 0 then 'A' else 'B' end as d")
    return p.groupBy("gt").pivot("d", ["A", "B", "loose"]).count().fillna(0)
