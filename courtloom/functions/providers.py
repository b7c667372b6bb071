"""Extension points: dump ingestion as a table function and attribute providers as Arrow batch maps."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

_PROVIDERS: dict[str, tuple[Callable[[pd.DataFrame], pd.DataFrame], str]] = {}


@udtf(returnType="frame: bigint, x1: double, y1: double, x2: double, y2: double, score: double")
class ExplodeTracks:
    """One row per present frame of a `{frame: {box, present, score}}` document."""

    def eval(self, document: str):
        for frame, rec in json.loads(document or "{}").items():
            if rec.get("present"):
                x1, y1, x2, y2 = (float(v) for v in rec["box"])
                yield int(frame), x1, y1, x2, y2, float(rec.get("score") or 0.0)


def register(spark: SparkSession) -> None:
    """Make `explode_tracks(json)` callable from SQL."""
    spark.udtf.register("explode_tracks", ExplodeTracks)


def register_provider(name: str, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> None:
    """A provider maps a batch of rows to the same rows with attributes (a model's output, a lookup)."""
    _PROVIDERS[name] = (fn, schema)


def apply_provider(df: DataFrame, name: str) -> DataFrame:
    fn, schema = _PROVIDERS[name]

    def batches(it):
        for pdf in it:
            yield fn(pdf)

    return df.mapInPandas(batches, schema)
