"""The driver's parquet tables seen through the observation data model.

Every view exists twice from one set of expressions: as a DataFrame and as a DuckDB CTE for the oracle.
All views read whole tables. Detections, tracks, streams and world rows keep every row: rows that fall into one slot of
a frame are told apart by further slot numbers (`_numbered`). Only the two ball views choose: the best ball of a frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtloom.operators.ordered import best_per

CHUNK = 300                     # frames per chunk in the driver-table views
BLOCK = 250                     # ordering block in the driver-table queries

# --- lineitem as detector output -----------------------------------------------------------------
RAW = [
    "l_orderkey % 4 as game",
    "l_suppkey % 4 as cam",
    "cast(floor(l_orderkey / 16) as bigint) as frame",
    "cast(floor(l_orderkey / 4) as bigint) % 4 * 8 + l_linenumber as det_idx",
    "case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as class_id",
    "(100 - cast(round(l_discount * 100) as int) * 5) / 1e2 as score",
    "l_partkey as pk",
    "l_suppkey as sk",
    "cast(l_quantity as bigint) as qty",
]
DET = [
    "game", "cam", "frame", "det_idx", "class_id", "score", "pk", "sk", "qty",
    f"cast(floor(frame / {CHUNK}) as bigint) as chunk",
    "cast(pk * 7 % 400 as double) as x1",
    "cast(sk * 13 % 250 as double) as y1",
    "cast(pk * 7 % 400 + case when class_id = 2 then 24 else 60 + qty end as double) as x2",
    "cast(sk * 13 % 250 + case when class_id = 2 then 24 else 120 + 2 * qty end as double) as y2",
    "pk % 10 as num",
    "case when floor(sk / 4) % 2 = 0 then 'B' else 'W' end as kit",
]
_RANK = ["score", "pk", "sk", "qty", "class_id"]

# --- events as time series --------------------------------------------------------------------------
SPARK_SEC = "timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts)"
DUCK_SEC = "date_diff('second', timestamp '2024-01-01 00:00:00', ts)"
SPARK_K = "cast(get_json_object(props, '$.k') as bigint)"
DUCK_K = "cast(json_extract_string(props, '$.k') as bigint)"


def _evt(sec: str, k: str) -> list[str]:
    return [
        "user_id % 5 as game", "user_id as uid", "event_id as eid", "event_type as etype",
        f"cast({sec} as bigint) as sec", f"{k} as k", "cast(floor(value * 100) as bigint) as val",
    ]


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def raw_detections(spark: SparkSession, sf: str) -> DataFrame:
    """One row per lineitem, no shuffle: for row-level projections."""
    return _table(spark, sf, "lineitem").selectExpr(*RAW).selectExpr(*DET)


def _numbered(df: DataFrame, keys: list[str], slot: str, step: int, rank: list[str]) -> DataFrame:
    """The k-th row of a slot, by `rank`, goes to slot + k * step: every row stays and (keys, slot) is unique. `step` is
    above the plain slot numbers."""
    w = Window.partitionBy(*keys, slot).orderBy(*[F.desc(c) for c in rank])
    return df.withColumn(slot, F.col(slot) + step * (F.row_number().over(w) - 1))


def detections(spark: SparkSession, sf: str) -> DataFrame:
    """32 plain slots per (game, cam, frame)."""
    raw = _table(spark, sf, "lineitem").selectExpr(*RAW)
    return _numbered(raw, ["game", "cam", "frame"], "det_idx", 32, _RANK).selectExpr(*DET)


def tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Per-camera track rows: 10 plain ids per (game, cam, frame), classes 0/1."""
    raw = _table(spark, sf, "lineitem").selectExpr(*RAW).filter("class_id < 2")
    raw = raw.withColumn("track_id", F.expr("pk % 10"))
    return _numbered(raw, ["game", "cam", "frame"], "track_id", 10, _RANK).selectExpr(
        "track_id", "cast(0 as bigint) as det_idx", *[e for e in DET if e != "det_idx"]
    )


def streams(spark: SparkSession, sf: str) -> DataFrame:
    """Identity streams: one box per (game, cam, frame, sid), 20 plain sids (number and kit)."""
    raw = _table(spark, sf, "lineitem").selectExpr(*RAW).filter("class_id < 2").selectExpr("*", *STREAM_SLOT)
    return _numbered(raw, ["game", "cam", "frame", "dress"], "slot", 10, STREAM_RANK).selectExpr(*STREAM_KEY, *DET)


def stream_points(spark: SparkSession, sf: str) -> DataFrame:
    """Streams placed on the court."""
    return streams(spark, sf).selectExpr(
        "*", "cast(pk * 7 % 2144 as double) as cx", "cast(sk * 131 % 1427 as double) as cy")


def ball(spark: SparkSession, sf: str) -> DataFrame:
    """Best ball per (game, cam, frame)."""
    raw = _table(spark, sf, "lineitem").selectExpr(*RAW).filter("class_id = 2")
    top = best_per(raw, ["game", "cam", "frame"], STREAM_RANK, STREAM_RANK)
    return top.selectExpr(*DET).selectExpr("*", "(x1 + x2) / 2 as ball_x", "(y1 + y2) / 2 as ball_y")


STREAM_SLOT = ["pk % 10 as slot", "case when floor(sk / 4) % 2 = 0 then 'B' else 'W' end as dress"]
STREAM_KEY = ["concat('n', slot, dress) as sid"]
STREAM_RANK = ["score", "det_idx", "pk", "sk", "qty", "class_id"]


def world(spark: SparkSession, sf: str) -> DataFrame:
    """Fused court rows: 10 plain global ids per (game, frame)."""
    raw = _table(spark, sf, "lineitem").selectExpr(*RAW).filter("class_id < 2")
    return _numbered(raw.withColumn("gid", F.expr("pk % 10")), ["game", "frame"], "gid", 10, _RANK).selectExpr(*WORLD)


WORLD = [
    "game", "frame", "gid", "cam", f"cast(floor(frame / {CHUNK}) as bigint) as chunk",
    "cast(pk * 7 % 2144 as double) as cx", "cast(sk * 131 % 1427 as double) as cy",
    "case when pk % 10 = 9 then 'REF' when pk % 2 = 0 then 'A' else 'B' end as team",
    "case when pk % 3 = 0 then pk % 10 end as jersey",
]


def court_ball(spark: SparkSession, sf: str) -> DataFrame:
    """One court ball position per (game, frame)."""
    raw = _table(spark, sf, "lineitem").selectExpr(*RAW).filter("class_id = 2")
    return best_per(raw, ["game", "frame"], _RANK, ["pk", "sk"]).selectExpr(*COURT_BALL)


COURT_BALL = [
    "game", "frame", f"cast(floor(frame / {CHUNK}) as bigint) as chunk",
    "cast(pk * 7 % 2144 as double) as ball_x", "cast(sk * 131 % 1427 as double) as ball_y",
]


def events(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "events").selectExpr(*_evt(SPARK_SEC, SPARK_K))


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate holder of every event; its number in time order is the frame, so keys are unique. Null every 7th event."""
    return events(spark, sf).selectExpr(*CAND)


CAND = ["game", "eid as frame", "cast(floor(eid / 360) as bigint) as chunk", "case when eid % 7 = 0 then null else etype end as cand"]


def observations(spark: SparkSession, sf: str) -> DataFrame:
    """Court observations by (game, uid, minute); further events of a player's minute count as further players."""
    per_min = events(spark, sf).selectExpr("*", "cast(floor(sec / 60) as bigint) as frame")
    return _numbered(per_min, ["game", "frame"], "uid", 10_000_000, ["val", "eid"]).selectExpr(*OBS)


OBS = [
    "game", "uid", "frame", "eid", "eid % 4 as cam", "k * 21e0 as cx", "val % 1426 * 1e0 as cy", "etype",
]


def plays(spark: SparkSession, sf: str) -> DataFrame:
    """Ground-truth plays: purchases, one row per event."""
    return events(spark, sf).filter("etype = 'purchase'").selectExpr("game", "eid as play_id", "sec as t", "k", "uid")


def cv_events(spark: SparkSession, sf: str) -> DataFrame:
    """Derived events: every click. Several may share a second; matchings break such ties by eid."""
    return events(spark, sf).filter("etype = 'click'").selectExpr(*CV)


CV = ["game", "eid", "sec as t", "k", "uid", "case when val % 5 = 0 then null else val % 300 / 1e2 end as rq"]


# --- small dimensions made from a rule ---------------------------------------------------------------
OFFSETS_RANGE = ["cast(id % 4 as bigint) as game", "cast(floor(id / 4) as bigint) as cam"]
OFFSET = "(game * 7 + cam * 5) % 11 - 5 as off"
CALIB = [
    "cam", "1.9e0 + 1e-1 * cam as h0", "5e-2 as h1", "1e1 * cam as h2",
    "3e-2 as h3", "2.4e0 - 1e-1 * cam as h4", "2e1 as h5", "1e-4 as h6", "2e-4 as h7", "1e0 as h8",
    "case when cam = 0 then null else -6e-2 end as lam", "2e2 as px", "2e2 as py", "282.84e0 as diag",
]


def offsets(spark: SparkSession) -> DataFrame:
    """16 rows (4 games x 4 cameras)."""
    return spark.range(16).selectExpr(*OFFSETS_RANGE).selectExpr("game", "cam", OFFSET)


def calibration(spark: SparkSession) -> DataFrame:
    """4 rows, one per camera."""
    return spark.range(4).selectExpr("cast(id as bigint) as cam").selectExpr(*CALIB)


def roster(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers with duplicates: one row per supplier."""
    return _table(spark, sf, "supplier").selectExpr(*ROSTER)


ROSTER = ["s_suppkey % 70 as num", "1 + s_suppkey % 2 as team", "s_name as name"]


# --- the same views as CTEs -------------------------------------------------------------------------
def _c(exprs: list[str], source: str, where: str = "") -> str:
    return f"select {', '.join(exprs)} from {source} {where}"


def _best(source: str, keys: str, order: str, where: str = "") -> str:
    return f"select * from {source} {where} qualify row_number() over (partition by {keys} order by {order}) = 1"


def _slots(source: str, keys: str, slot: str, step: int, order: str) -> str:
    return f"(select * replace ({slot} + {step} * (row_number() over (partition by {keys}, {slot} order by {order}) - 1) as {slot}) from {source})"


_SR = "score desc, det_idx desc, pk desc, sk desc, qty desc, class_id desc"
_R = "score desc, pk desc, sk desc, qty desc, class_id desc"
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "raw0": ((), _c(RAW, "lineitem")),
    "raw": (("raw0",), _c(DET, "raw0")),
    "det": (("raw0",), _c(DET, _slots("raw0", "game, cam, frame", "det_idx", 32, _R))),
    "trk": (
        ("raw0",),
        _c(["track_id"] + [e for e in DET if e != "det_idx"],
           _slots("(select *, pk % 10 as track_id from raw0 where class_id < 2)", "game, cam, frame", "track_id", 10, _R)),
    ),
    "streams": (
        ("raw0",),
        _c([*STREAM_KEY, *DET], _slots(f"(select *, {', '.join(STREAM_SLOT)} from raw0 where class_id < 2)", "game, cam, frame, dress", "slot", 10, _SR)),
    ),
    "ball": (
        ("raw0",),
        "select *, (x1 + x2) / 2 as ball_x, (y1 + y2) / 2 as ball_y from (" + _c(DET, "(" + _best("raw0", "game, cam, frame", _SR, "where class_id = 2") + ")") + ")",
    ),
    "world": (
        ("raw0",),
        _c(WORLD, _slots("(select *, pk % 10 as gid from raw0 where class_id < 2)", "game, frame", "gid", 10, _R)),
    ),
    "cball": (("raw0",), _c(COURT_BALL, "(" + _best("raw0", "game, frame", _R, "where class_id = 2") + ")")),
    "evt": ((), _c(_evt(DUCK_SEC, DUCK_K), "events")),
    "cand": (
        ("evt",),
        _c(CAND, "evt"),
    ),
    "obs": (
        ("evt",),
        _c(OBS, _slots("(select *, cast(floor(sec / 60) as bigint) as frame from evt)", "game, frame", "uid", 10_000_000, "val desc, eid desc")),
    ),
    "plays": (("evt",), "select game, eid as play_id, sec as t, k, uid from evt where etype = 'purchase'"),
    "cv": (
        ("evt",),
        _c(CV, "evt", "where etype = 'click'"),
    ),
    "offs": ((), f"select game, cam, {OFFSET} from (select {', '.join(OFFSETS_RANGE)} from (select range as id from range(16)))"),
    "calib": ((), _c(CALIB, "(select range as cam from range(4))")),
    "roster": ((), _c(ROSTER, "supplier")),
}


def with_ctes(names: str, body: str) -> str:
    """Prefix `body` with the named CTEs and what they need, each once, in dependency order."""
    done: list[str] = []

    def visit(name: str) -> None:
        if name not in done:
            for dep in CTES[name][0]:
                visit(dep)
            done.append(name)

    for name in names.split():
        visit(name)
    parts = [f"{n} as ({CTES[n][1]})" for n in done]
    body = body.strip()
    if not parts:
        return body
    if body.lower().startswith("with recursive"):
        return "with recursive " + ", ".join(parts) + ", " + body[len("with recursive"):]
    if body.lower().startswith("with"):
        return "with " + ", ".join(parts) + ", " + body[len("with"):]
    return "with " + ", ".join(parts) + " " + body
