"""Camera synchronisation: lag search by signal correlation and by matching number reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def align(df: DataFrame, offsets: DataFrame, out: str = "ref") -> DataFrame:
    """ref frame = camera frame - offset. `offsets` is one row per (game, camera): a rig dimension."""
    return df.join(F.broadcast(offsets), ["game", "cam"]).withColumn(out, F.col("frame") - F.col("off")).drop("off")


def lag_correlation(signal: DataFrame, keys: Sequence[str], cam: str, ref_cam, index: str, value: str, max_lag: int) -> DataFrame:
    """Mean product of the reference signal and each other camera's signal at every lag.

    Every sample meets 2*max_lag+1 lags by an equi-join on (keys, index); sums combine map-side.
    """
    keys = list(keys)
    size = signal.groupBy(*keys, cam).agg(F.count(F.lit(1)).alias("_n"))
    ref = signal.filter(F.col(cam) == ref_cam).select(*keys, F.col(index).alias("_i"), F.col(value).alias("_a"))
    ref_n = size.filter(F.col(cam) == ref_cam).select(*keys, F.col("_n").alias("_na"))
    sized = signal.filter(F.col(cam) != ref_cam).join(size, [*keys, cam]).join(ref_n, keys)
    common = F.least("_n", "_na")
    lags = F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))).alias("lag")
    other = sized.withColumn("_len", common).filter(F.col(index) < F.col("_len")).select(*keys, cam, index, value, "_len", lags)
    pairs = other.withColumn("_i", F.col(index) - F.col("lag")).filter(F.col("_i") < F.col("_len")).join(ref, [*keys, "_i"])
    return pairs.groupBy(*keys, cam, "lag", "_len").agg(F.sum(F.col("_a") * F.col(value)).alias("_s")).select(
        *keys, cam, "lag", (F.col("_s") / (F.col("_len") - F.abs("lag"))).alias("c"))


def lag_peak(signal: DataFrame, keys: Sequence[str], cam: str, ref_cam, index: str, value: str, max_lag: int) -> DataFrame:
    """Best lag per camera; correlations are compared at 1e-6 so that summation order cannot flip a tie."""
    c = lag_correlation(signal, keys, cam, ref_cam, index, value, max_lag)
    best = c.groupBy(*keys, cam).agg(
        F.max(F.struct(F.floor(F.col("c") * 1e6 + 0.5).alias("r"), (-F.col("lag")).alias("l"), "c")).alias("b"),
        F.count(F.lit(1)).alias("n_lags"))
    return best.select(*keys, cam, (-F.col("b.l")).alias("lag"), F.col("b.c").alias("peak"), "n_lags")


def peak_ratio(curve: DataFrame, keys: Sequence[str], away: int = 5) -> DataFrame:
    """Peak against the best value more than `away` lags from it."""
    keys = list(keys)
    peak = curve.groupBy(*keys).agg(F.max(F.struct(F.col("c"), (-F.col("lag")).alias("l"))).alias("_p"))
    far = curve.join(peak, keys).groupBy(*keys).agg(
        F.first("_p").alias("_p"),
        F.max(F.when(F.abs(F.col("lag") + F.col("_p.l")) > away, F.col("c"))).alias("_second"))
    # a second best of 0 makes the peak infinitely better; without any value far away there is nothing to compare with
    ratio = F.when(F.col("_second") == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.col("_p.c"), F.abs(F.col("_second"))))
    return far.select(*keys, (-F.col("_p.l")).alias("lag"), F.col("_p.c").alias("peak"), ratio.alias("ratio"))


def offset_mode(lags: DataFrame, keys: Sequence[str], min_ratio: float = 1.3, min_windows: int = 3) -> DataFrame:
    """Most frequent confident lag over windows (smallest wins ties), or null with fewer than three."""
    keys = list(keys)
    good = lags.filter(F.col("ratio") >= min_ratio).groupBy(*keys, "lag").agg(F.count(F.lit(1)).alias("c"))
    return good.groupBy(*keys).agg(
        F.sum("c").alias("windows"), F.max(F.struct(F.col("c"), (-F.col("lag")).alias("l"))).alias("_b")
    ).select(*keys, "windows", F.col("_b.c").alias("agree"),
             F.when(F.col("windows") >= min_windows, -F.col("_b.l")).alias("offset"))


def read_lag_sweep(reads: DataFrame, ref_cam, sweep: int = 60, tol: int = 1, min_pairs: int = 200, close_cm: float = 120.0) -> DataFrame:
    """Residual offset per camera from equal (number, kit) reads seen on court at nearly the same time.

    `reads`: game, cam, num, kit, frame, cx, cy, unique per key and frame. Each read meets the
    2*(sweep+tol)+1 reference frames around it by equi-join, never all reads of its key.
    """
    span = sweep + tol
    key = ["game", "num", "kit"]
    ref = reads.filter(F.col("cam") == ref_cam).select(
        *key, F.col("frame").alias("_f"), F.col("cx").alias("rx"), F.col("cy").alias("ry"))
    other = reads.filter(F.col("cam") != ref_cam).select(
        *key, "cam", "cx", "cy", "frame", F.explode(F.sequence(F.lit(-span), F.lit(span))).alias("s"))
    pairs = other.withColumn("_f", F.col("frame") - F.col("s")).join(ref, [*key, "_f"]).withColumn(
        "dist", F.sqrt(F.pow(F.col("cx") - F.col("rx"), 2) + F.pow(F.col("cy") - F.col("ry"), 2)))
    # a pair at shift s serves residuals s-tol..s+tol; per reference read and residual the smallest shift wins
    cand = pairs.withColumn("d", F.explode(F.sequence(F.col("s") - tol, F.col("s") + tol))).filter(F.abs("d") <= sweep)
    hit = cand.groupBy(*key, "cam", "_f", "d").agg(F.min_by("dist", "s").alias("dist"))
    rounded = hit.withColumn("dist", F.floor(F.col("dist") * 10 + 0.5) / 10)
    counted = rounded.groupBy("game", "cam", "d", "dist").agg(F.count(F.lit(1)).alias("c"))
    return counted.groupBy("game", "cam", "d").agg(
        F.sum("c").alias("n"), F.expr("percentile(dist, 0.5D, c)").alias("median_cm"),
        (F.sum(F.when(F.col("dist") <= close_cm, F.col("c")).otherwise(0)) / F.sum("c")).alias("close_share"),
    ).filter(F.col("n") >= min_pairs)


def best_residual(curve: DataFrame, rival_gap: int = 3) -> DataFrame:
    """Residual with the smallest median and the margin of the best rival more than 3 frames away."""
    best = curve.groupBy("game", "cam").agg(F.min(F.struct("median_cm", "d", "n", "close_share")).alias("b"))
    rival = curve.join(best, ["game", "cam"]).groupBy("game", "cam").agg(
        F.first("b").alias("b"),
        F.min(F.when(F.abs(F.col("d") - F.col("b.d")) > rival_gap, F.col("median_cm"))).alias("rival"))
    return rival.select(
        "game", "cam", F.col("b.d").alias("d"), F.col("b.median_cm").alias("median_cm"), F.col("b.n").alias("n"),
        F.col("b.close_share").alias("close_share"), (F.col("rival") / F.col("b.median_cm")).alias("margin"))
