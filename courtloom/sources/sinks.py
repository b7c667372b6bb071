"""Writers. Flat Parquet is canonical; nested JSON documents are written one per bounded key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def holder_segments(seg: DataFrame, path: str, fmt: str = "parquet") -> None:
    """[start, end, sid] segments, one partition per game, in order inside each file."""
    spread = seg.repartition("game", F.floor(F.col("start_frame") / 17982)).sortWithinPartitions("game", "start_frame")
    spread.write.mode("overwrite").partitionBy("game").format(fmt).save(path)


def world_state(world: DataFrame, path: str) -> None:
    """One JSON document per (game, chunk, frame) with its tracks; a frame holds a handful of them."""
    track = F.struct("gid", F.array("cx", "cy").alias("court_xy"), "team", "jersey")
    doc = world.groupBy("game", "chunk", "frame").agg(F.sort_array(F.collect_list(track)).alias("tracks"))
    doc.write.mode("overwrite").partitionBy("game").json(path)


def coco(annotations: DataFrame, path: str) -> None:
    """COCO annotation records, one JSON object per line and image."""
    ann = F.struct("class_id", F.array("x", "y", "bw", "bh").alias("bbox"), "area")
    annotations.groupBy("split", "image_id").agg(F.collect_list(ann).alias("annotations")).write.mode("overwrite").partitionBy("split").json(path)


def event_feed(events: DataFrame, path: str) -> None:
    """Per-game feed sorted by time inside each file."""
    events.repartitionByRange("game", "t").sortWithinPartitions("game", "t").write.mode("overwrite").partitionBy("game").json(path)


def append_ledger(records: DataFrame, path: str) -> None:
    records.write.mode("append").parquet(path)


def feature_table(features: DataFrame, path: str) -> None:
    features.write.mode("overwrite").partitionBy("game").parquet(path)


