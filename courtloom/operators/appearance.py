"""Appearance distances of embedding tables against a gallery, by blocks that bounds can skip.

The gallery (seed crops of the roster) is dealt to the nearest of a few centres, and from there to blocks of bounded
size. A block's rows lie within its centre's radius, so the distance from a query to the centre bounds all inner
products of the block (triangle inequality). A query first meets one block near it; what it finds there limits which
blocks it must meet at all. Neighbouring blocks make tiles, and a query travels once to each tile that holds a block it
must meet; there the bounds skip the other rows again. Met rows are compared in one product for all their queries, and
only the few smallest distances leave the task. The result is exact, whatever is skipped.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtloom.session import cut_lineage

SLICE = 512                      # gallery rows of a block
TILE = 16384                     # rows of a tile
ASKED = 8192                     # queries that meet one copy of a tile
CENTRES = 64                     # centres, chosen farthest first
SAMPLE = 2048                    # gallery rows among which they are chosen
_SLACK = 1e-6                    # rounding of distances between vectors


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0.0))


def _least(q: np.ndarray, centres: np.ndarray, radius: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """The least distance of each query to rows of each centre, infinite where it has none."""
    near = np.maximum(_apart(q, centres) - radius - _SLACK, 0.0)
    most = ((q * q).sum(1)[:, None] + norm**2 - near**2) / 2
    return np.where(radius < 0, np.inf, 1.0 - most - _SLACK)


class Gallery:
    """A gallery (id `g`, label `l`, vector `v`) in blocks `blk`, with the radius, largest norm and size of each centre."""

    def __init__(self, gallery: DataFrame, qid: str, label: str, vec: str, slice_rows: int = SLICE, centres: int = CENTRES):
        self.slice_rows = slice_rows
        rows = gallery.select(F.col(qid).cast("long").alias("g"), F.col(label).cast("long").alias("l"), F.col(vec).alias("v")).dropna()
        chosen = rows.orderBy(F.xxhash64("g")).limit(SAMPLE).select("v").collect()
        points = np.array([r["v"] for r in chosen]) if chosen else np.zeros((1, 1))
        heads = [0]
        d = _apart(points, points[:1])[:, 0]
        while len(heads) < centres and d.max() > 4 * _SLACK:
            heads.append(int(d.argmax()))
            d = np.minimum(d, _apart(points, points[heads[-1] :][:1])[:, 0])
        self.centres = points[heads]
        far = self.far_from_centres("v")
        placed = rows.withColumn("_far", far).withColumn("gap", F.array_min("_far")).withColumn("centre", F.array_position("_far", F.array_min("_far")).cast("int") - 1)
        placed = cut_lineage(placed.drop("_far"))
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
        self.radius, self.norm, self.blocks = np.full(len(heads), -1.0), np.zeros(len(heads)), np.zeros(len(heads), int)
        for r in placed.groupBy("centre").agg(F.max("gap").alias("gap"), F.max(norm).alias("norm"), F.count(F.lit(1)).alias("n")).collect():      # a row for each centre
            self.radius[r["centre"]], self.norm[r["centre"]], self.blocks[r["centre"]] = r["gap"], r["norm"], -(-r["n"] // slice_rows)
        self.rows = placed.withColumn("blk", self._block("centre", F.pmod(F.xxhash64("g"), self._count("centre"))))
        self.labels = self.rows.select("blk", "l").distinct()

    def far_from_centres(self, vec: str) -> Column:
        centres = self.centres

        @F.pandas_udf("array<double>")
        def far(v: pd.Series) -> pd.Series:
            return pd.Series(list(_apart(np.stack(v.to_numpy()), centres)) if len(v) else [], dtype=object)

        return far(vec)

    def _count(self, centre: str) -> Column:
        return F.element_at(F.array(*[F.lit(int(n)).cast("long") for n in self.blocks]), F.col(centre) + 1)

    def _block(self, centre: str, salt: Column) -> Column:
        return F.shiftleft(F.col(centre).cast("long"), 40) + salt

    def bounded(self, queries: DataFrame) -> DataFrame:
        """Queries (q, own, v) with the least distance that rows of each centre can have (`floors`, infinite without rows)."""
        radius, norm, centres = self.radius, self.norm, self.centres
        if (radius < 0).all():
            return queries.withColumn("floors", F.array(F.lit(float("inf"))))

        @F.pandas_udf("array<double>")
        def floors(v: pd.Series) -> pd.Series:
            if not len(v):
                return pd.Series([], dtype=object)
            return pd.Series(list(_least(np.stack(v.to_numpy()), centres, radius, norm)))

        return cut_lineage(queries.withColumn("floors", floors("v")))

    def home(self, queries: DataFrame) -> DataFrame:
        """Each query with one block of the centre whose rows may lie nearest."""
        best = queries.withColumn("centre", (F.array_position("floors", F.array_min("floors")) - 1).cast("int"))
        best = best.filter(F.array_min("floors") < float("inf"))
        return best.withColumn("blk", self._block("centre", F.pmod(F.xxhash64("q"), self._count("centre"))))

    def within(self, queries: DataFrame, limit: Column, label: str | None = None) -> DataFrame:
        """Each query with the blocks that may hold a distance of at most `limit`; with `label`, those that have that label."""
        near = queries.withColumn("_lim", limit).withColumn("_c", F.expr("filter(transform(floors, (f, i) -> if(f <= _lim and f < double('infinity'), i, null)), i -> i is not null)"))
        met = near.withColumn("centre", F.explode("_c")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), self._count("centre") - 1)))
        met = met.withColumn("blk", self._block("centre", F.col("salt"))).drop("_c", "_lim", "salt", "centre")
        return met if label is None else met.join(self.labels.withColumnRenamed("l", label), ["blk", label])

    def compare(self, met: DataFrame, keep: int) -> DataFrame:
        """(q, l, d, other): for each query and block that it meets the nearest row of its own label (other false) and of the
        others (other true), with the `keep` smallest distances to either's label; a row with the query's id does not count."""
        columns = ["blk", "kind", "id", "label", "v"]
        mine = met.select("blk", F.lit(1).alias("kind"), F.col("q").alias("id"), F.col("own").alias("label"), "v")
        theirs = self.rows.select("blk", F.lit(0).alias("kind"), F.col("g").alias("id"), F.col("l").alias("label"), "v")
        dealt = theirs.select(columns).union(mine.select(columns)).repartition("blk").sortWithinPartitions("blk", "kind")
        return dealt.mapInArrow(_compared(keep), "q long, l long, d double, other boolean")

    def meet(self, queries: DataFrame, near: Column | None, own: Column | None = None, keep: int = 1) -> DataFrame:
        """As `compare`, for queries (q, own, v, floors) and all rows that may lie within `near`, and those of the query's own
        label within `own`; of the others only the nearest. A query travels once to each tile, a tile once for each
        `ASKED` queries."""
        none = F.lit(float("-inf"))
        per = max(1, TILE // self.slice_rows)
        upto = np.concatenate([[0], np.cumsum(self.blocks)])
        ends = lambda values: F.array(*[F.lit(int(x)) for x in values])      # noqa: E731
        first, last = ends(upto[:-1] // per), ends(np.maximum(upto[1:] - 1, 0) // per)
        inside = lambda limit: F.array_distinct(F.flatten(F.transform("floors", lambda f, i: F.when(      # noqa: E731
            (f <= limit) & (f < float("inf")), F.sequence(F.element_at(first, i + 1), F.element_at(last, i + 1))).otherwise(F.array().cast("array<int>")))))
        tile = F.floor((F.element_at(ends(upto[:-1]), F.col("centre") + 1) + F.col("blk").bitwiseAND((1 << 40) - 1)) / per).cast("int")
        rows = self.rows.withColumn("tile", tile)
        slices = -(-queries.count() // ASKED) or 1
        asked = queries.withColumns({"near": none if near is None else near, "mine": none if own is None else own}).withColumn("_tiles", inside(F.col("near")))
        if own is not None:
            held = rows.groupBy(F.col("l").alias("own")).agg(F.collect_set("tile").alias("_held"))
            few = F.array_intersect(inside(F.col("mine")), F.coalesce("_held", F.array().cast("array<int>")))
            asked = asked.join(held, "own", "left").withColumn("_tiles", F.array_union("_tiles", few))
        columns = ["tile", "slice", "kind", "id", "label", "v", "centre", "near", "mine"]
        mine = asked.withColumn("tile", F.explode("_tiles")).select(
            "tile", F.pmod(F.xxhash64("q"), F.lit(slices)).cast("int").alias("slice"), F.lit(1).alias("kind"), F.col("q").alias("id"), F.col("own").alias("label"), "v",
            F.lit(-1).alias("centre"), "near", "mine")
        theirs = rows.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).select(
            "tile", "slice", F.lit(0).alias("kind"), F.col("g").alias("id"), F.col("l").alias("label"), "v", "centre", none.alias("near"), none.alias("mine"))
        dealt = theirs.select(columns).union(mine.select(columns)).repartition("tile", "slice").sortWithinPartitions("tile", "slice", "kind", "centre", "label")
        return dealt.mapInArrow(_met(keep, self.centres, self.radius, self.norm), "q long, l long, d double, other boolean")


def _runs(batches: Iterator[pa.RecordBatch], columns: Sequence[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Sorted batches cut where one of `columns` changes: (its values, rows)."""
    for batch in batches:
        keys = [batch.column(c).to_numpy() for c in columns]
        if len(batch):
            cuts = [0, *(np.flatnonzero(reduce(np.logical_or, [np.diff(k) != 0 for k in keys])) + 1).tolist(), len(batch)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield tuple(int(k[a]) for k in keys), batch.slice(a, b - a)


def _vectors(parts: Sequence[pa.RecordBatch]) -> np.ndarray:
    return np.concatenate([b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1) for b in parts])


def _column(parts: Sequence[pa.RecordBatch], name: str) -> np.ndarray:
    return np.concatenate([b.column(name).to_numpy(zero_copy_only=False) for b in parts])


def _same(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of equal ids."""
    order = np.argsort(b, kind="stable")
    low, high = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    row = np.repeat(np.arange(len(a)), high - low)
    return row, order[np.arange(len(row)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)]


def _scaled(product: np.ndarray) -> np.ndarray:
    return np.floor((1.0 - product) * 1e9 + 0.5)


def _met(keep: int, centres: np.ndarray, radius: np.ndarray, norm: np.ndarray):
    def answer(tile: tuple, asked: pa.RecordBatch) -> pa.RecordBatch:
        ids, labels, centre, v = tile
        q, own, near, mine, x = asked.column("id").to_numpy(), _column([asked], "label"), *(asked.column(c).to_numpy() for c in ("near", "mine")), _vectors([asked])
        floors = _least(x, centres, radius, norm)
        best = np.full((len(q), keep), np.inf)
        least, label = np.full(len(q), np.inf), np.full(len(q), np.iinfo(np.int64).max)

        def take(rows: np.ndarray, d: np.ndarray) -> None:
            d = np.concatenate([best[rows], d], axis=1)
            best[rows] = np.sort(np.partition(d, keep - 1, axis=1)[:, :keep], axis=1)

        def product(rows: np.ndarray, a: int, b: int) -> np.ndarray:
            dots = x[rows] @ v[a:b].T
            dots[_same(q[rows], ids[a:b])] = -np.inf
            return dots

        cuts = [0, *(np.flatnonzero(np.diff(centre)) + 1).tolist(), len(centre)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            starts = np.concatenate([[0], np.flatnonzero(np.diff(labels[a:b])) + 1])
            names, stops = labels[a:b][starts], [*starts[1:].tolist(), b - a]
            floor = floors[:, centre[a]]
            rows = np.flatnonzero(floor <= near)
            if len(rows):
                dots = product(rows, a, b)
                d = _scaled(np.maximum.reduceat(dots, starts, axis=1))
                for i, name in enumerate(names):
                    belong = np.flatnonzero(own[rows] == name)
                    if len(belong):
                        take(rows[belong], _scaled(dots[belong, starts[i] : stops[i]]) if keep > 1 else d[belong, i : i + 1])
                        d[belong, i] = np.inf
                at = d.argmin(axis=1)          # of equally near rows the smallest label
                d, name = d[np.arange(len(rows)), at], names[at]
                nearer = (d < least[rows]) | ((d == least[rows]) & (name < label[rows]))
                least[rows[nearer]], label[rows[nearer]] = d[nearer], name[nearer]
            rest = (floor <= mine) & ~(floor <= near)
            for i, name in enumerate(names) if rest.any() else ():
                rows = np.flatnonzero(rest & (own == name))
                if len(rows):
                    take(rows, _scaled(product(rows, a + starts[i], a + stops[i])))
        row, at = np.nonzero(np.isfinite(best))
        some = np.flatnonzero(np.isfinite(least))
        return pa.record_batch([
            pa.array(np.concatenate([q[row], q[some]])), pa.array(np.concatenate([own[row].astype("int64"), label[some]])),
            pa.array(np.concatenate([best[row, at], least[some]])), pa.array(np.arange(len(row) + len(some)) >= len(row))], ["q", "l", "d", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, tile = None, [], None
        for (number, piece, kind), part in _runs(batches, ["tile", "slice", "kind"]):
            if (number, piece) != at:
                at, parts, tile = (number, piece), [], None
            if not kind:
                parts.append(part)
            elif parts or tile:
                tile = tile or (*(_column(parts, c) for c in ("id", "label", "centre")), _vectors(parts))
                parts = []
                for low in range(0, len(part), 512):
                    yield answer(tile, part.slice(low, min(512, len(part) - low)))

    return run


def own_distances(rows: DataFrame, qid: str, label: str, vec: str, tile_rows: int = TILE) -> DataFrame:
    """(q, d): distance of each row to the nearest other row of its label, in billionths; rows without one are left out.

    The rows of a label are dealt to tiles by their id and each pair of tiles is one product, which answers for both: a
    row travels once for each tile of its label."""
    rows = rows.select(F.col(qid).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vec).alias("v")).dropna()
    tiles = rows.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("_n"))
    dealt = rows.join(tiles, "label").withColumn("tile", F.pmod(F.xxhash64("id"), "_n").cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    dealt = dealt.select("label", F.least("tile", "_other").alias("a"), F.greatest("tile", "_other").alias("b"), "tile", "id", "v")
    cells = dealt.repartition("label", "a", "b").sortWithinPartitions("label", "a", "b", "tile")
    found = cells.mapInArrow(_within_label, "q long, d double")
    return found.groupBy("q").agg(F.min("d").alias("d"))


def _within_label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def answer(cell: tuple, parts: dict[int, list[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
        _, a, b = cell
        if a not in parts or b not in parts:
            return
        (p, x), (q, y) = (((_column(parts[t], "id"), _vectors(parts[t]))) for t in (a, b))
        most, back = np.full(len(p), -np.inf), np.full(len(q), -np.inf)
        for low in range(0, len(p), 512):
            dots = x[low : low + 512] @ y.T
            if a == b:
                dots[_same(p[low : low + 512], q)] = -np.inf
            most[low : low + 512] = dots.max(axis=1)
            if a != b:
                np.maximum(back, dots.max(axis=0), out=back)
        for ids, top in ((p, most), (q, back)):
            some = np.isfinite(top)
            yield pa.record_batch([pa.array(ids[some]), pa.array(_scaled(top[some]))], ["q", "d"])

    at, parts = None, {}
    for (name, a, b, tile), part in _runs(batches, ["label", "a", "b", "tile"]):
        if (name, a, b) != at:
            if at:
                yield from answer(at, parts)
            at, parts = (name, a, b), {}
        parts.setdefault(tile, []).append(part)
    if at:
        yield from answer(at, parts)


def _compared(keep: int):
    def answer(block: list[pa.RecordBatch], asked: pa.RecordBatch) -> pa.RecordBatch:
        vectors = lambda b: np.array(b.column("v").to_pylist())      # noqa: E731
        ids = np.concatenate([b.column("id").to_numpy() for b in block])
        labels = np.concatenate([b.column("label").to_numpy() for b in block])
        q, own = asked.column("id").to_numpy(), asked.column("label").to_numpy(zero_copy_only=False)
        d = np.floor((1.0 - vectors(asked) @ np.concatenate([vectors(b) for b in block]).T) * 1e9 + 0.5)
        d[q[:, None] == ids[None, :]] = np.inf
        out = []
        for other in (False, True):
            part = np.where((labels[None, :] != own[:, None]) == other, d, np.inf)
            least = part.min(axis=1)
            # of equally near rows the smallest label
            label = np.where(part == least[:, None], labels[None, :], np.iinfo(np.int64).max).min(axis=1)
            part = np.where(labels[None, :] == label[:, None], d, np.inf)
            few = np.sort(np.partition(part, min(keep, part.shape[1]) - 1, axis=1)[:, :keep], axis=1)
            row, at = np.nonzero(np.isfinite(few) & np.isfinite(least)[:, None])
            out.append((q[row], label[row], few[row, at], np.full(len(row), other)))
        q, label, d, other = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.record_batch([pa.array(q), pa.array(label), pa.array(d), pa.array(other)], ["q", "l", "d", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, []
        for batch in batches:
            blk, kind = (batch.column(c).to_numpy() for c in ("blk", "kind"))
            cuts = [0, *(np.flatnonzero((np.diff(blk) != 0) | (np.diff(kind) != 0)) + 1).tolist(), len(blk)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if blk[a] != at:
                    at, block = blk[a], []
                if not kind[a]:
                    block.append(batch.slice(a, b - a))
                elif block:
                    for low in range(a, b, 1024):
                        yield answer(block, batch.slice(low, min(1024, b - low)))

    return run


def _queries(queries: DataFrame, qid: str, label: str, vec: str) -> DataFrame:
    return queries.select(F.col(qid).cast("long").alias("q"), F.col(label).cast("long").alias("own"), F.col(vec).alias("v")).dropna(subset=["q", "v"])


def gallery_distance(queries: DataFrame, gallery: DataFrame, qid: str, label: str, vec: str, k: int = 3, slice_rows: int = SLICE) -> DataFrame:
    """(qid, best, d3, dmin): the identity of the nearest gallery row (the smallest of equals), the mean of the k smallest
    distances to it and the smallest. Queries and gallery rows without an id or vector take no part, nor does a gallery
    row with the query's id."""
    g = Gallery(gallery, qid, label, vec, slice_rows)
    asked = g.bounded(_queries(queries, qid, label, vec).withColumn("own", F.lit(None).cast("long")))      # no label is a query's own
    nearest = lambda found: found.groupBy("q").agg(F.min(F.struct("d", "l")).alias("b"))      # noqa: E731
    home = nearest(g.compare(g.home(asked), 1)).select("q", F.col("b.d").alias("up"))
    met = g.meet(cut_lineage(asked.join(home, "q", "left")), F.coalesce(F.col("up"), F.lit(float("inf"))) / 1e9 + 1e-9)
    found = cut_lineage(nearest(met))
    best = found.select("q", F.col("b.l").alias("own"), F.col("b.d").alias("dmin"))
    # the k-th distance to that identity in one block bounds the blocks that can hold nearer ones
    known = g.compare(g.home(asked.drop("own").join(best, "q")), k).filter("not other").groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("kth"))
    named = cut_lineage(asked.drop("own").join(best, "q").join(known, "q", "left"))
    limit = F.when(F.col("n") >= k, F.col("kth") / 1e9 + 1e-9).otherwise(F.lit(float("inf")))
    few = g.meet(named, None, limit, k).filter("not other").groupBy("q").agg(F.slice(F.sort_array(F.collect_list("d")), 1, k).alias("s"))
    mean = F.aggregate("s", F.lit(0.0), lambda a, x: a + x) / F.size("s")
    return few.join(best, "q").select(F.col("q").alias(qid), F.col("own").alias("best"), (mean / 1e9).alias("d3"), (F.col("dmin") / 1e9).alias("dmin"))


def self_vs_rival(queries: DataFrame, gallery: DataFrame, qid: str, label: str, vec: str, slice_rows: int = SLICE) -> DataFrame:
    """(qid, self_d, rival_d, rival): distance to the own identity's gallery and to the nearest other one (the smallest of equals)."""
    g = Gallery(gallery, qid, label, vec, slice_rows)
    asked = g.bounded(_queries(queries, qid, label, vec))
    sides = lambda found: found.groupBy("q").agg(F.min(F.when(~F.col("other"), F.col("d"))).alias("s"), F.min(F.when(F.col("other"), F.struct("d", "l"))).alias("r"))      # noqa: E731
    home = cut_lineage(g.compare(g.home(asked), 1))
    up = cut_lineage(asked.join(sides(home), "q", "left"))
    limit = lambda c: F.coalesce(F.col(c), F.lit(float("inf"))) / 1e9 + 1e-9      # noqa: E731
    both = sides(home.union(g.meet(up, limit("r.d"), limit("s"))))
    return both.filter("s is not null or r is not null").select(
        F.col("q").alias(qid), (F.col("s") / 1e9).alias("self_d"), (F.col("r.d") / 1e9).alias("rival_d"), F.col("r.l").alias("rival"))


def loo_threshold(gallery: DataFrame, qid: str, label: str, vec: str, p: float = 0.75) -> DataFrame:
    """p75 of the leave-one-out distance of gallery crops to their own identity."""
    own = own_distances(gallery, qid, label, vec).select(F.floor(F.col("d") / 1e9 * 1e6 + 0.5).alias("d"))
    hist = own.groupBy("d").agg(F.count(F.lit(1)).alias("c"))
    return hist.agg((F.expr(f"percentile(d, {p}D, c)") / 1e6).alias("threshold"))
