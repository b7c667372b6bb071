"""Language of narrations: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtloom.llm.common import free_prefix

#: Code points handled at once; bounds the temporary arrays of a task.
PIECE = 1 << 18
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def _points(text: str) -> np.ndarray:
    """Lower-case code points with one space for each sign that is no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    return np.where(_letters()[points], points, np.uint32(32))


def gram_buckets(points: np.ndarray, orders: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket of each gram, whether it counts) for n = 1 .. orders at every position; a gram of spaces alone does not."""
    solid = points != 32
    key, any_letter = np.zeros(len(points), np.uint32), np.zeros(len(points), bool)
    for n in range(1, orders + 1):
        m = len(points) - n + 1
        if m < 1:
            return
        key = key[:m] * np.uint32(0x9E3779B1) + (points[n - 1 :] + np.uint32(n)) * np.uint32(0x85EBCA6B)
        any_letter = any_letter[:m] | solid[n - 1 :]
        mixed = key ^ (key >> np.uint32(15))
        yield (mixed * np.uint32(0xC2B2AE35)) >> np.uint32(32 - bits), any_letter


def _groups(texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(rows, code points, row of each code point) of about PIECE points; a longer text comes in several groups.
    Texts are parted by a run of spaces, so no gram mixes letters of two texts."""
    rows, parts, held = [], [], 0
    gap = np.full(8, 32, np.uint32)

    def close() -> tuple[list[int], np.ndarray, np.ndarray]:
        return rows, np.concatenate(parts), np.repeat(np.arange(len(rows)), [len(p) for p in parts])

    for i, text in enumerate(texts):
        points = _points(text or "")
        for at in range(0, max(len(points), 1), PIECE):
            part = np.concatenate((points[max(at - 7, 0) : at + PIECE] if at else points[:PIECE], gap))
            rows.append(i)
            parts.append(part)
            held += len(part)
            if held >= PIECE:
                yield close()
                rows, parts, held = [], [], 0
    if rows:
        yield close()


class LanguageModel:
    """Log-probability matrix (bucket x language) and priors."""

    def __init__(self, langs: list[str], counts: np.ndarray, rows: np.ndarray, orders: int, bits: int, alpha: float = 0.1):
        self.langs, self.orders, self.bits = langs, orders, bits
        counts = counts + alpha
        self.logp = np.log(counts / counts.sum(axis=0, keepdims=True)).astype(np.float32)
        self.prior = np.log((rows + 1.0) / (rows.sum() + len(langs)))

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(sum of log probabilities by text and language, letters by text): sparse gram rows gathered from the matrix."""
        total, letters = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        for rows, points, row in _groups(texts):
            at = np.array(rows)
            np.add.at(letters, at, np.bincount(row, points != 32, len(rows)).astype(np.int64))
            starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            for bucket, counts in gram_buckets(points, self.orders, self.bits):
                got = self.logp[bucket]
                got[~counts] = 0
                np.add.at(total, at, np.add.reduceat(got, starts[starts < len(got)], axis=0, dtype=np.float64))
        return total, letters

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        if not self.langs:
            return pd.DataFrame({"lang_pred": ["und"] * len(texts), "score": 0.0})
        total, letters = self.scores(texts)
        total += self.prior
        best = total.argmax(axis=1)
        share = 1.0 / np.exp(total - total[np.arange(len(texts)), best][:, None]).sum(axis=1)
        none = letters == 0
        return pd.DataFrame({"lang_pred": np.where(none, "und", np.array(self.langs, object)[best]), "score": np.where(none, 0.0, share)})


def _count(orders: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("summary").to_pylist()
            for lang in set(langs):
                held = counts.setdefault(lang, np.zeros(1 << bits, np.int64))
                for _, points, _ in _groups([t for t, x in zip(texts, langs, strict=True) if x == lang]):
                    for bucket, solid in gram_buckets(points, orders, bits):
                        held += np.bincount(bucket[solid], minlength=1 << bits)
        for lang, held in counts.items():
            at = np.flatnonzero(held)
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(held[at], pa.int64())], ["lang", "bucket", "n"])

    return run


def fit_language_model(narrations: DataFrame, learn: Column, orders: int = 3, bits: int = 15, max_cells: int = 1 << 25) -> LanguageModel:
    """Gram counts by language over every narration for which `learn` holds and lang is not null.

    Each task adds up its counts before the shuffle. The driver gets languages x 2 ** bits counts, whatever the number
    of rows; more than `max_cells` cells is an error, not a cut.
    """
    rows = narrations.filter(learn).filter("lang is not null").select("lang", F.coalesce("summary", F.lit("")).alias("summary"))
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if len(langs) << bits > max_cells:
        raise ValueError(f"{len(langs)} languages exceed the matrix of {max_cells} cells")
    counts = np.zeros((1 << bits, len(langs)))
    if langs:
        place = {x: k for k, x in enumerate(langs)}
        got = rows.mapInArrow(_count(orders, bits), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
        counts[got["bucket"].to_numpy(), got["lang"].map(place).to_numpy(np.int64)] = got["n"].to_numpy()
    return LanguageModel(langs, counts, np.array([sizes[x] for x in langs], float), orders, bits)


def identify_language(narrations: DataFrame, model: LanguageModel) -> DataFrame:
    """The columns of `narrations`, `lang_pred` (a learned language; `und` without a letter or a model) and `score` (its
    posterior; 0 for `und`). Equal posteriors go to the language first in order; clashing columns are replaced."""
    shared = narrations.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return shared.value.predict(list(texts))

    guess = f"{free_prefix(narrations.columns)}guess"
    out = narrations.withColumn(guess, predict("summary"))
    return out.withColumns({"lang_pred": F.col(f"{guess}.lang_pred"), "score": F.col(f"{guess}.score")}).drop(guess)
