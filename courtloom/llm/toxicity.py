"""Toxic narrations: class-conditional Kneser-Ney models of letters, compared by length-normalised log-likelihood."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtloom.llm.common import fold, mix64, rated_sample
from courtloom.session import cut_lineage

#: Runs of letters that touch no digit, so that keys and codes give no words.
_WORD = re.compile(r"\b[^\W\d_]+\b")
#: Letters of a word that are modelled; a longer word is cut into pieces of this length, all of which count.
LONGEST = 40
MARGINS = ("mean", "best_1", "best_4", "best_16")


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters; runs beyond LONGEST letters come in pieces."""
    found = _WORD.findall((text or "").lower())
    if any(len(w) > LONGEST for w in found):
        found = [w[at : at + LONGEST] for w in found for at in range(0, len(w), LONGEST)]
    return found


def gram_keys(points: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the grams of `n` code points that end at `at`, and of their contexts (the grams without the last point)."""
    context = np.full(len(at), n, np.uint64)
    for k in range(n - 1, 0, -1):
        context = context * np.uint64(0x9E3779B97F4A7C15) + points[at - k]
    return mix64(context * np.uint64(0x9E3779B97F4A7C15) + points[at]), mix64(context + np.uint64(1))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)


def framed(word: str, order: int) -> str:
    """A word between `order - 1` starts and one end, so that each of its letters has a full context."""
    return "\x02" * (order - 1) + word + "\x03"


class Slots:
    """Sorted distinct 64-bit keys with columns of values; zero where a key is missing. The top bits of a key point near
    its place, so a lookup is a step or two instead of a binary search."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.values = [np.concatenate((v[order], [0])).astype(np.float32) for v in values]
        self.shift = np.uint64(64 - max(1, len(keys).bit_length()))
        self.first = np.searchsorted(self.keys, np.arange(1 << int(64 - self.shift), dtype=np.uint64) << self.shift)

    def get(self, keys: np.ndarray) -> list[np.ndarray]:
        n = len(self.keys)
        if not n:
            return [np.zeros(len(keys), np.float32) for _ in self.values]
        at = self.first[keys >> self.shift]
        ahead = np.flatnonzero(self.keys[np.minimum(at, n - 1)] < keys)
        while len(ahead):
            at[ahead] += 1
            ahead = ahead[at[ahead] < n]
            ahead = ahead[self.keys[at[ahead]] < keys[ahead]]
        at[at < n] = np.where(self.keys[at[at < n]] == keys[at < n], at[at < n], n)
        return [v[at] for v in self.values]


def _totals(context: np.ndarray, *counts: np.ndarray) -> Slots:
    """For each context and count: its sum and the number of grams seen with it."""
    keys, back = np.unique(context, return_inverse=True)
    out = []
    for c in counts:
        out += [np.bincount(back, c, len(keys)), np.bincount(back, c > 0, len(keys))]
    return Slots(keys, *out)


def _keys_of(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = points.shape[1]
    return gram_keys(np.ascontiguousarray(points).ravel(), np.arange(len(points)) * n + n - 1, n)


def _shared(points: np.ndarray, d: float) -> np.ndarray:
    """Shared probability of the last code point of each row after the others: its continuation count, discounted, and the
    shared probability of the row that is one shorter."""
    keys, context = _keys_of(points)
    _, first, back, types = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    rows, context = points[first], context[first]
    low = _shared(rows[:, 1:], d) if points.shape[1] > 1 else np.full(len(rows), 1.0 / (len(rows) + 1))
    total, kinds = _totals(context, types.astype(float)).get(context)
    return ((np.maximum(types - d, 0) + d * kinds * low) / total)[back]


class ToxicModel:
    """log P(letter | context, toxic) - log P(letter | context, ordinary) for every gram of `order` code points.

    The classes are apart at the highest order only: P = (max(c - d, 0) + d * types * shared) / total. All lower orders
    are shared, where the count of a shorter gram is the number of different grams, of either class, that it continues.
    So the shared part of a gram that was not seen cancels, and what remains of it is the context's back-off weights:
    scoring needs one value for each seen gram and one for each seen context.
    """

    def __init__(self, order: int, grams: list[str], toxic: np.ndarray, ordinary: np.ndarray, discount: float = 0.75):
        self.order = order
        points = _points("".join(grams)).reshape(-1, order)
        gram, context = _keys_of(points)
        sums = _totals(context, toxic, ordinary)
        low = _shared(points[:, 1:], discount) if len(points) else np.zeros(0)
        total = sums.get(context)
        with np.errstate(divide="ignore", invalid="ignore"):
            chance = [np.where(n > 0, (np.maximum(c - discount, 0) + discount * types * low) / n, low)
                      for c, n, types in ((toxic, total[0], total[1]), (ordinary, total[2], total[3]))]
            back = [np.where(n > 0, discount * types / n, 1.0) for n, types in ((sums.values[0][:-1], sums.values[1][:-1]), (sums.values[2][:-1], sums.values[3][:-1]))]
        self.gram = Slots(gram, np.log(chance[0]) - np.log(chance[1]), np.ones(len(gram)))
        self.context = Slots(sums.keys, np.log(back[0]) - np.log(back[1]))
        self.weights, self.bias, self.memo = np.zeros(len(MARGINS)), 0.0, {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}}

    def margins(self, words: list[str]) -> np.ndarray:
        """Log-likelihood ratio of each word, divided by its letters and its end."""
        points = _points("".join(framed(w, self.order) for w in words))
        at = np.flatnonzero(points != 2)
        word = np.repeat(np.arange(len(words)), [len(w) + self.order for w in words])[at]
        gram, context = gram_keys(points, at, self.order)
        ratio, seen = self.gram.get(gram)
        new = np.flatnonzero(seen == 0)
        ratio[new] = self.context.get(context[new])[0]
        return np.bincount(word, ratio, len(words)) / np.bincount(word, minlength=len(words))

    def features(self, text: str | None) -> np.ndarray:
        """Margin by word over the whole text, and the largest mean over 1, 4 and 16 words in a row."""
        words = words_of(text)
        if not words:
            return np.zeros(len(MARGINS))
        new = [w for w in dict.fromkeys(words) if w not in self.memo]
        if new:
            if len(self.memo) > 300_000:
                self.memo, new = {}, list(dict.fromkeys(words))
            for at in range(0, len(new), 8192):
                some = new[at : at + 8192]
                self.memo.update(zip(some, self.margins(some).tolist(), strict=True))
        margin = np.array([self.memo[w] for w in words])
        run = np.concatenate(([0.0], np.cumsum(margin)))
        best = [((run[k:] - run[:-k]).max() / k if len(words) >= k else run[-1] / k) for k in (1, 4, 16)]
        return np.array([run[-1] / len(words), *best])

    def score(self, text: str | None) -> float:
        z = float(np.clip(self.features(text) @ self.weights + self.bias, -30, 30))
        return 1.0 / (1.0 + np.exp(-z))


def _class_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[int]] = {}

    def flush() -> pa.RecordBatch:
        both = np.array(list(held.values()), np.int64).reshape(-1, 2)
        return pa.record_batch([pa.array(list(held), pa.string()), pa.array(both[:, 0]), pa.array(both[:, 1])], ["word", "toxic", "ordinary"])

    for batch in batches:
        for text, label in zip(batch.column("summary").to_pylist(), batch.column("label").to_pylist(), strict=True):
            for w in set(words_of(text)):       # once for each narration, so that a text that repeats itself counts no more
                held.setdefault(w, [0, 0])[0 if label else 1] += 1
            if len(held) > 200_000:
                yield flush()
                held.clear()
    if held:
        yield flush()


def _class_grams(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}

        def flush() -> pa.RecordBatch:
            both = np.array(list(held.values()), np.int64).reshape(-1, 2)
            return pa.record_batch([pa.array(list(held), pa.string()), pa.array(both[:, 0]), pa.array(both[:, 1])], ["gram", "toxic", "ordinary"])

        for batch in batches:
            for word, toxic, ordinary in zip(*(batch.column(c).to_pylist() for c in ("word", "toxic", "ordinary")), strict=True):
                text = framed(word, order)
                for k in range(len(word) + 1):
                    both = held.setdefault(text[k : k + order], [0, 0])
                    both[0] += toxic
                    both[1] += ordinary
            if len(held) > 400_000:
                yield flush()
                held.clear()
        if held:
            yield flush()

    return run


def fit_toxic_model(narrations: DataFrame, ratings: DataFrame, label: str = "toxic", order: int = 6, calibration_part: int = 1,
                    parts: int = 5, learn_part: int = 0, max_grams: int = 4_000_000, bound: int = 20_000) -> ToxicModel:
    """Letter counts of every rated narration but two folds, and a calibration of the margins on one of these folds.

    `crc32(job_id) mod parts` = `learn_part` is held out and never read; = `calibration_part` fits the weights of the
    margins, on about `bound` narrations at most, which the counts have not seen; all others are counted, each class apart at the highest
    order, together below. The join is a merge at every size, so that what moves grows with the rows. Words are added up in the tasks, then in a shuffle, then grams of distinct words. The driver
    gets the distinct letter grams, whose number follows the spelling of the languages rather than the rows; beyond
    `max_grams` it is an error, not a cut.
    """
    rated = ratings.select("job_id", F.col(label).cast("int").alias("label")).dropna().groupBy("job_id").agg(F.max("label").alias("label"))
    part = fold(F.col("job_id"), parts)
    count_them = ~part.isin(learn_part, calibration_part)
    counted = narrations.filter(count_them).select("job_id", "summary").join(rated.filter(count_them).hint("merge"), "job_id").select("summary", "label")
    words = counted.mapInArrow(_class_words, "word string, toxic long, ordinary long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    grams = words.mapInArrow(_class_grams(order), "gram string, toxic long, ordinary long")
    table = cut_lineage(grams.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")))
    if table.count() > max_grams:
        raise ValueError(f"more than {max_grams} distinct letter grams")
    got = table.orderBy("gram").toArrow()
    model = ToxicModel(order, got["gram"].to_pylist(), got["toxic"].to_numpy().astype(float), got["ordinary"].to_numpy().astype(float))
    del got
    shared = narrations.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def margins(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.features(x) for x in texts], dtype=object)

    held = rated_sample(narrations, rated.filter(part == calibration_part), "label", bound)
    held = cut_lineage(held.select(F.col("label").cast("double").alias("label"), array_to_vector(margins("summary")).alias("features")))
    n, bad = held.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if bad in (0, n):
        model.bias, model.weights = -2.0, np.array([1.0] * len(MARGINS))
    else:
        fitted = LogisticRegression(regParam=1e-4, maxIter=100, tol=1e-7).fit(held)
        model.weights, model.bias = np.array(fitted.coefficients.toArray()), float(fitted.intercept)
    return model


def score_toxicity(narrations: DataFrame, model: ToxicModel) -> DataFrame:
    """The columns of `narrations` and `toxicity` (0 to 1). A null summary, or one without a letter, has margins of zero;
    each row is scored by its whole text; a clashing column is replaced."""
    shared = narrations.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxic(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(x) for x in texts], dtype=float)

    return narrations.withColumn("toxicity", toxic("summary"))
