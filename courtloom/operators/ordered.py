"""Ordered computation over one long key, without ever sorting that key in one task.

A game can hold a third of all rows, so `Window.partitionBy("game").orderBy("frame")` would put a third
of the data in one task. Frames are cut into fixed blocks instead, and three exact building blocks cover
what ordered logic needs:

* `with_halo`   rows near an edge are copied to the next block, so any window of bounded reach is exact;
* `carry_last`  "last non-null value so far": local window plus one value carried in per block;
* `running_sum` prefix sums: local prefix plus one offset per block.

The per-block summaries are 1 / BLOCK_FRAMES of the rows. Blocks depend on the data only (never on task
or partition numbers), so a re-run after a lost executor gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtloom.constants import BLOCK_FRAMES

BLK = "_blk"
OWN = "_own"


def block_of(order: str | Column, size: int) -> Column:
    col = F.col(order) if isinstance(order, str) else order
    return F.floor(col / F.lit(size)).cast("long")


def with_halo(
    df: DataFrame, order: str, before: int, after: int = 0, size: int = BLOCK_FRAMES
) -> DataFrame:
    """Add `_blk`/`_own`; each row also visits the blocks whose windows can reach it."""
    first = block_of(F.col(order) - after, size)
    last = block_of(F.col(order) + before, size)
    return df.withColumn(BLK, F.explode(F.sequence(first, last))).withColumn(
        OWN, F.col(BLK) == block_of(order, size)
    )


def halo_window(keys: Sequence[str], order: str) -> Window:
    return Window.partitionBy(*keys, BLK).orderBy(order)


def own_rows(df: DataFrame) -> DataFrame:
    return df.filter(OWN).drop(OWN, BLK)


def carry_last(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: Column,
    out: str,
    size: int = BLOCK_FRAMES,
    inclusive: bool = True,
) -> DataFrame:
    """`last(value, ignorenulls)` up to (or, exclusive, before) each row, per `keys`, over `order`."""
    keys = list(keys)
    base = df.withColumn("_val", value).withColumn(BLK, block_of(order, size))
    base = base.repartition(*[F.col(k) for k in keys], F.col(BLK))
    local = Window.partitionBy(*keys, BLK).orderBy(order)
    local = local.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    rows = base.withColumn("_loc", F.last("_val", ignorenulls=True).over(local))
    # the summary reads every column, so both branches share one exchange and the input is computed once
    whole = F.struct(*[F.col(c) for c in base.columns if c not in (*keys, BLK)])
    tail = base.groupBy(*keys, BLK).agg(
        F.max_by(whole, F.when(F.col("_val").isNotNull(), F.col(order))).alias("_last")
    ).withColumn("_tail", F.col("_last._val"))
    over_blocks = Window.partitionBy(*keys).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    carried = tail.withColumn("_in", F.last("_tail", ignorenulls=True).over(over_blocks)).select(*keys, BLK, "_in", "_last")
    return (
        rows.join(carried, [*keys, BLK], "left")
        .withColumn(out, F.coalesce("_loc", "_in"))
        .drop("_val", "_loc", "_in", "_last", BLK)
    )


def running_sum(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str, size: float = BLOCK_FRAMES
) -> DataFrame:
    """Inclusive prefix sum of `value` per `keys` over `order`."""
    return running_sums(df, keys, order, {out: value}, size)


def running_sums(df: DataFrame, keys: Sequence[str], order: str, values: dict[str, Column], size: float = BLOCK_FRAMES) -> DataFrame:
    """Inclusive prefix sums of several values (by output name) in one pass."""
    return _running(df, keys, order, values, size, F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))


def running_max(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str, size: float = BLOCK_FRAMES
) -> DataFrame:
    """Inclusive prefix maximum of `value` per `keys` over `order`."""
    return _running(df, keys, order, {out: value}, size, F.max, F.greatest)


def _running(df: DataFrame, keys: Sequence[str], order: str, values: dict[str, Column], size: float, fold: Callable, join: Callable) -> DataFrame:
    """A local prefix of each block joined with one value carried in from the blocks before it."""
    keys, n = list(keys), range(len(values))
    base = df.withColumns({f"_val{i}": v for i, v in enumerate(values.values())}).withColumn(BLK, block_of(order, size))
    base = base.repartition(*[F.col(k) for k in keys], F.col(BLK))
    local = Window.partitionBy(*keys, BLK).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = base.withColumns({f"_loc{i}": fold(f"_val{i}").over(local) for i in n})
    total = base.groupBy(*keys, BLK).agg(*[fold(f"_val{i}").alias(f"_total{i}") for i in n])
    over_blocks = Window.partitionBy(*keys).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    offset = total.select(*keys, BLK, *[fold(f"_total{i}").over(over_blocks).alias(f"_in{i}") for i in n])
    joined = rows.join(offset, [*keys, BLK], "left").withColumns({out: join(F.col(f"_loc{i}"), F.col(f"_in{i}")) for i, out in enumerate(values)})
    return joined.drop(*[f"_{c}{i}" for c in ("val", "loc", "in") for i in n], BLK)


def rank_in_key(
    df: DataFrame, keys: Sequence[str], order: str, out: str, size: int = BLOCK_FRAMES
) -> DataFrame:
    """`row_number` per `keys` over a unique `order` column."""
    return running_sum(df, keys, order, F.lit(1).cast("long"), out, size)


def best_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], keep: Sequence[str]) -> DataFrame:
    """One row per `keys`: the maximum of `order` (column names, or expressions that are not kept).

    A combinable aggregate, so a hot key is pre-reduced on the map side instead of being sorted in one task
    (what `row_number() = 1` would do). Each kept column travels once.
    """
    ranking = [F.col(c) if isinstance(c, str) else c.alias(f"_o{i}") for i, c in enumerate(order)]
    named = [c for c in order if isinstance(c, str)]
    top = F.max(F.struct(*ranking, *[F.col(c) for c in keep if c not in named])).alias("_top")
    return df.groupBy(*keys).agg(top).select(*keys, *[F.col("_top")[c].alias(c) for c in keep])


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], values: dict[str, str], probs: dict[str, float]
) -> DataFrame:
    """Exact linear-interpolated quantiles. Values are counted first (combinable), so the quantile
    aggregate holds one entry per distinct value of a key, not one per row.

    `values` maps output prefix -> column; `probs` maps suffix -> probability.
    """
    keys = list(keys)
    pairs = F.explode(
        F.array(*[F.struct(F.lit(p).alias("_n"), F.col(c).cast("double").alias("_v")) for p, c in values.items()])
    )
    counted = (
        df.select(*keys, pairs.alias("_e"))
        .select(*keys, "_e._n", "_e._v")
        .filter(F.col("_v").isNotNull())
        .groupBy(*keys, "_n", "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    aggs = [
        F.expr(f"percentile(_v, {q}D, _c) filter (where _n = '{p}')").alias(f"{p}{s}")
        for p in values
        for s, q in probs.items()
    ]
    return counted.groupBy(*keys).agg(*aggs)


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, keep: Sequence[str], salts: int = 64) -> DataFrame:
    """The k smallest rows per key. Rows are ranked per salted sub-key first, so a hot key is sorted in
    `salts` pieces and only salts * k rows of it meet in the final ranking."""
    ranked = df.select(*keys, *[c.alias(f"_o{i}") for i, c in enumerate(order)], *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)])
    names = [f"_o{i}" for i in range(len(order))]
    salted = ranked.withColumn("_salt", F.pmod(F.xxhash64(*names), F.lit(salts)))
    local = Window.partitionBy(*keys, "_salt").orderBy(*names)
    few = salted.withColumn("_r", F.row_number().over(local)).filter(F.col("_r") <= k)
    final = Window.partitionBy(*keys).orderBy(*names)
    out = few.withColumn("_r", F.row_number().over(final)).filter(F.col("_r") <= k)
    return out.select(*keys, F.col("_r").alias("rank"), *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)])
