"""Readers: documents and tables of the observation model as typed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtloom import constants as C

BOX = "struct<box: array<double>, present: boolean, score: double>"


def detections(spark: SparkSession, path: str) -> DataFrame:
    """Detection table, partitioned by game and cam on disk (both prune at the scan)."""
    return spark.read.parquet(path)


def frame_counts(dets: DataFrame, frames: DataFrame) -> DataFrame:
    """Detections per frame including empty frames: `frames` has (game, cam, n_frames)."""
    spine = frames.select("game", "cam", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_frames") - 1)).alias("frame"))
    found = dets.groupBy("game", "cam", "frame").agg(F.count(F.lit(1)).alias("n"))
    return spine.join(found, ["game", "cam", "frame"], "left").fillna(0, ["n"])


def stream_dumps(spark: SparkSession, path: str) -> DataFrame:
    """Identity dumps `{frame: {box, present, score}}`, one document per line; game, tag, sid and cam come
    from the document's stem `game_tag__sid__cam` (or the file name when the document has none)."""
    raw = spark.read.schema(f"stem string, frames map<string, {BOX}>").json(path)
    file_stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    parts = F.split(F.coalesce("stem", file_stem), "__")
    head = F.split(parts[0], "_")
    rows = raw.select(
        head[0].alias("game"), F.concat_ws("_", F.slice(head, 2, 8)).alias("tag"), parts[1].alias("sid"), parts[2].alias("cam"), F.explode("frames").alias("frame", "r"))
    box = F.col("r.box")
    return rows.filter("r.present").select(
        "game", "tag", "sid", "cam", F.col("frame").cast("long").alias("frame"), box[0].alias("x1"), box[1].alias("y1"), box[2].alias("x2"), box[3].alias("y2"), "r.score")


PLAY = "array<struct<play_id: bigint, t: double, cls: string, a: string, b: string>>"
ROW = "array<struct<play_id: bigint, ts: double, classification: string, player_a: string, player_b: string>>"


def plays(spark: SparkSession, path: str) -> DataFrame:
    """Play logs in either shape: `plays[]` (t, cls, a, b) or `rows[]` (ts, classification, player_a, player_b)."""
    doc = spark.read.schema(f"game string, plays {PLAY}, rows {ROW}").json(path)
    one = doc.select("game", F.inline("plays")).select("game", "play_id", "t", "cls", F.col("a").alias("player_a"), F.col("b").alias("player_b"))
    two = doc.select("game", F.inline("rows")).select("game", "play_id", F.col("ts").alias("t"), F.col("classification").alias("cls"), "player_a", "player_b")
    return one.unionByName(two)


def roster(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("game string, players array<struct<num: bigint, name: string, team: bigint>>").json(path).select("game", F.inline("players"))


def kit_teams(spark: SparkSession, path: str) -> DataFrame:
    doc = spark.read.schema("game string, kit_team map<string, bigint>").json(path)
    default = F.create_map(*[F.lit(v).cast("long") if isinstance(v, int) else F.lit(v) for kv in C.KIT_TEAM.items() for v in kv])
    return doc.select("game", F.explode(F.coalesce("kit_team", default)).alias("kit", "team"))


def registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("games array<struct<gid8: string, date: string, split: string>>").json(path, multiLine=True).select(F.inline("games"))


def calibration(spark: SparkSession, path: str) -> DataFrame:
    """Camera calibrations as one row per camera with h0..h8, lens and hull columns."""
    schema = ("cam bigint, homography_matrix array<array<double>>, image_size array<double>, division_lambda double, "
              "principal_point array<double>, calib_hull array<array<double>>")
    d = spark.read.schema(schema).json(path)
    flat = F.flatten("homography_matrix")
    px = F.coalesce(F.get("principal_point", F.lit(0)), F.get("image_size", F.lit(0)) / 2)
    py = F.coalesce(F.get("principal_point", F.lit(1)), F.get("image_size", F.lit(1)) / 2)
    hull = F.transform("calib_hull", lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return d.select("cam", *[flat[i].alias(f"h{i}") for i in range(9)], F.col("division_lambda").alias("lam"), px.alias("px"), py.alias("py"),
                    F.sqrt(px * px + py * py).alias("diag"), hull.alias("hull"))


def label_lines(spark: SparkSession, path: str) -> DataFrame:
    """YOLO text labels `cls cx cy w h`; the stem is the file's directory partition or name."""
    raw = spark.read.option("pathGlobFilter", "*.txt").text(path)
    p = F.split(F.trim("value"), r"\s+")
    rows = raw.filter(F.size(p) >= 5)
    keep = [c for c in raw.columns if c != "value"]
    names = ("class_id", "cx", "cy", "w", "h")
    return rows.select(*keep, F.col("_metadata.file_name").alias("file"), *[p[i].cast("long" if i == 0 else "double").alias(n) for i, n in enumerate(names)])


def with_negatives(images: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Every image with its label count; an image without labels is a negative sample."""
    n = labels.groupBy(key).agg(F.count(F.lit(1)).alias("n_labels"))
    return images.join(n, key, "left").fillna(0, ["n_labels"])


def number_reads(spark: SparkSession, path: str) -> DataFrame:
    """Number reads `anchors[]` with the baked camera offsets: cam_frame = frame + offset."""
    schema = ("game string, tag string, offsets map<string, bigint>, anchors array<struct<frame: bigint, cam: string, box: array<double>, number: bigint, conf: double, kit: string>>")
    d = spark.read.schema(schema).json(path).select("game", "tag", "offsets", F.explode("anchors").alias("a"))
    b = F.col("a.box")
    return d.select("game", "tag", "a.frame", "a.cam", (F.col("a.frame") + F.coalesce(F.col("offsets")[F.col("a.cam")], F.lit(0))).alias("cam_frame"),
                    F.col("a.number").alias("num"), "a.conf", "a.kit", b[0].alias("x1"), b[1].alias("y1"), b[2].alias("x2"), b[3].alias("y2"))


def stitch_chunks(df: DataFrame, chunks: DataFrame, fps: float = C.FPS) -> DataFrame:
    """Chunk-local frames to game frames; rows of chunks that are not listed are skipped.
    `chunks`: game, tag, start_s - one row per 600 s of a game; it grows with the games, so the join is left to its size."""
    base = chunks.select("game", "tag", F.bround(F.col("start_s") * fps).cast("long").alias("_base"))
    return df.join(base, ["game", "tag"]).withColumn("global_frame", F.col("_base") + F.col("frame")).drop("_base")


def approved_players(spark: SparkSession, path: str, min_frames: int = 30) -> DataFrame:
    """Clicked ground truth `player: {frames: {f: {cam: det}}, approved: {f: true}}`, approved frames only,
    players with enough of them."""
    d = spark.read.schema("game string, player string, frames map<string, map<string, bigint>>, approved map<string, boolean>").json(path)
    f = d.select("game", "player", "approved", F.explode("frames").alias("f", "picks")).filter(F.col("approved")[F.col("f")])
    enough = f.groupBy("game", "player").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_frames)
    rows = f.join(enough.select("game", "player"), ["game", "player"], "left_semi")
    return rows.select("game", "player", F.col("f").cast("long").alias("frame"), F.explode("picks").alias("cam", "det_idx"))


def legacy_archives(spark: SparkSession, path: str) -> DataFrame:
    """Array archives (boxes, scores, classes, frame_idx) read as binary files, one archive per row of
    Arrow output; meant as a one-off ingest into Parquet."""
    def parse(batches):
        import io

        import numpy as np
        import pandas as pd

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                z = np.load(io.BytesIO(content))
                n = len(z["scores"])
                cls = z["classes"] if "classes" in z else np.zeros(n, dtype="int64")
                yield pd.DataFrame({
                    "stem": [name.rsplit("/", 1)[-1].split(".")[0]] * n, "frame": z["frame_idx"].astype("int64"), "det_idx": np.arange(n), "class_id": cls.astype("int64"),
                    "score": z["scores"].astype("float64"), **{c: z["boxes"][:, i].astype("float64") for i, c in enumerate(("x1", "y1", "x2", "y2"))}})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content")
    return files.mapInPandas(parse, "stem string, frame long, det_idx long, class_id long, score double, x1 double, y1 double, x2 double, y2 double")
