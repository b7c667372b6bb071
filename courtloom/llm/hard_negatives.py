"""Hard negatives of appearance vectors: cover trees over norm-augmented vectors, best-first descent, exact leaves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtloom.llm.common import bounded_sample
from courtloom.session import cut_lineage

#: Rounding of distances, as a share of the largest norm; every bound is widened by it.
_SLACK = 1e-6
_NONE = np.int64(np.iinfo(np.int64).max)


class Space:
    """Vectors x lifted to (x, sqrt(M^2 - |x|^2)), so that all have norm M and a query q (lifted by 0) has
    q.x = (|q|^2 + M^2 - d(q, x)^2) / 2: bounds of distances are bounds of inner products."""

    def __init__(self, width: int, largest: float, component: float):
        self.width, self.m2 = width, largest
        self.slack = _SLACK * max(largest, 1.0) ** 0.5
        if component * component * max(width, 1) >= 2**53:      # below, sums of doubles have no rounding
            raise ArithmeticError("inner products of these vectors can exceed 2**53")
        self.store = np.dtype("<i2" if component < 2**15 else "<i4")

    def pack(self, lists: list[list[int]]) -> np.ndarray:
        """One row for each vector; a shorter one ends in zeros."""
        out = np.zeros((len(lists), self.width), np.int64)
        for row, values in zip(out, lists, strict=True):
            row[: len(values)] = values
        return out

    def gaps(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances between lifted rows of `a` and of `b`."""
        a, b = a.astype(np.float64), b.astype(np.float64)
        up_a, up_b = (np.sqrt(np.maximum(self.m2 - (x * x).sum(axis=1), 0.0)) for x in (a, b))
        return np.sqrt(np.maximum(2 * self.m2 - 2 * (a @ b.T + np.outer(up_a, up_b)), 0.0))

    def bounds(self, q: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(largest, smallest) inner product that a row within `radii` of a centre can have with each query."""
        q = q.astype(np.float64)
        total = (q * q).sum(axis=1)[:, None] + self.m2
        d = np.sqrt(np.maximum(total - 2 * (q @ centres.astype(np.float64).T), 0.0))
        near, far = np.maximum(d - radii - self.slack, 0.0), d + radii + self.slack
        return (total - near * near) / 2, (total - far * far) / 2


class CoverTree:
    """Nested nodes with their true covering radii. The centres of a level are taken farthest first until each row lies
    within half the radius of the level above, `fan_out` at most; a node of `leaf_rows` rows or of equal vectors is a leaf."""

    def __init__(self, space: Space, points: np.ndarray, leaf_rows: int, fan_out: int):
        self.children: list[list[int]] = []
        self.rows: list[np.ndarray] = []
        centre, radius = [], []
        work = [(np.arange(len(points)), 0, None)]
        while work:
            rows, at, parent = work.pop()
            d = space.gaps(points[rows], points[at : at + 1])[:, 0]
            node = len(centre)
            if parent is not None:
                self.children[parent].append(node)
            centre.append(at)
            radius.append(d.max())
            self.children.append([])
            self.rows.append(rows)
            if len(rows) <= leaf_rows or radius[-1] <= 4 * space.slack:
                continue
            owner, heads = np.zeros(len(rows), np.int32), [at]
            while len(heads) < fan_out and d.max() > radius[-1] / 2:
                heads.append(int(rows[d.argmax()]))
                other = space.gaps(points[rows], points[heads[-1] : heads[-1] + 1])[:, 0]
                owner[other < d] = len(heads) - 1
                d = np.minimum(d, other)
            self.rows[node] = rows[:0]
            work += [(rows[owner == k], head, node) for k, head in enumerate(heads)]
        self.centres, self.radii = points[centre], np.array(radius)


def best_rows(space: Space, tree: CoverTree, points: np.ndarray, ids: np.ndarray, codes: np.ndarray, q: np.ndarray, q_ids: np.ndarray,
              q_codes: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, ...]:
    """(query, window, score, id) of the first k rows, by score and then smaller id, of each query and window
    [low, high] of scores, among rows of the query's player (`same`) or of other ones.

    Each query opens its nodes best first, all queries at once: one round takes the node with the largest bound of each.
    A node whose bounds miss all windows, narrowed to the k-th score found so far, is not opened; a query whose best
    bound misses them is done. Leaves are compared exactly."""
    n, windows = low.shape
    queue = np.full((n, len(tree.radii)), -np.inf)
    score = np.full((n * windows, k), np.iinfo(np.int64).min, np.int64)
    held = np.full((n * windows, k), _NONE, np.int64)
    floor = low.astype(np.float64)
    leaves, qx, px = tree.rows, q.astype(np.float64), points.astype(np.float64)

    def push(who: np.ndarray, nodes: list[int], cap: np.ndarray | None) -> None:
        most, least = space.bounds(q[who], tree.centres[nodes], tree.radii[nodes])
        if cap is not None:
            most = np.minimum(most, cap[:, None])
        open_ = np.zeros(most.shape, bool)
        for w in range(windows):
            open_ |= (most >= floor[who, w][:, None]) & (least <= high[who, w][:, None]) & (low[who, w] <= high[who, w])[:, None]
        queue[who[:, None], np.array(nodes)[None, :]] = np.where(open_, most, -np.inf)

    def verify(who: np.ndarray, rows: np.ndarray) -> None:
        s = (qx[who] @ px[rows].T).astype(np.int64)
        fits = ((q_codes[who][:, None] == codes[rows][None, :]) == same) & (q_ids[who][:, None] != ids[rows][None, :])
        hit = fits[:, None, :] & (s[:, None, :] >= floor[who][:, :, None]) & (s[:, None, :] <= high[who][:, :, None])
        a, w, m = np.nonzero(hit)
        if not len(a):
            return
        at = who[a] * windows + w
        slots = np.unique(at)
        all_at = np.concatenate((np.repeat(slots, k), at))
        all_s = np.concatenate((score[slots].ravel(), s[a, m]))
        all_id = np.concatenate((held[slots].ravel(), ids[rows][m]))
        order = np.lexsort((all_id, ~all_s, all_at))
        all_at, all_s, all_id = all_at[order], all_s[order], all_id[order]
        first = np.searchsorted(all_at, slots)
        take = first[:, None] + np.arange(k)
        score[slots], held[slots] = all_s[take], all_id[take]
        full = held[slots, k - 1] != _NONE
        floor.reshape(-1)[slots[full]] = np.maximum(floor.reshape(-1)[slots[full]], score[slots[full], k - 1])

    push(np.arange(n), [0], None)
    live = np.arange(n)
    while len(live):
        pick = queue[live].argmax(axis=1)
        top = queue[live, pick]
        go = (top[:, None] >= floor[live]).any(axis=1) & (top > -np.inf)
        live, pick, top = live[go], pick[go], top[go]
        queue[live, pick] = -np.inf
        order = np.argsort(pick, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(pick[order])) + 1):
            if not len(part):
                continue
            node = int(pick[part[0]])
            if tree.children[node]:
                push(live[part], tree.children[node], top[part])
            else:
                verify(live[part], leaves[node])
    at, rank = np.nonzero(held != _NONE)
    return at // windows, at % windows, score[at, rank], held[at, rank]


def _placed(space: Space, pivots: np.ndarray):
    """Rows with their vector packed, their pivot and their distance to it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = space.pack(batch.column("emb").to_pylist())
            d = space.gaps(x, pivots) if len(x) else np.zeros((0, len(pivots)))
            packed = pa.array([row.tobytes() for row in x.astype(space.store)], pa.binary())
            yield pa.record_batch([batch.column("track_id"), batch.column("player"), batch.column("anchor"), packed,
                                   pa.array(d.argmin(axis=1).astype(np.int32)), pa.array(d.min(axis=1, initial=np.inf))],
                                  ["track_id", "player", "anchor", "vec", "pivot", "gap"])

    return run


def _groups(space: Space, pivots: np.ndarray, radii: np.ndarray):
    """Anchors with the pivots whose rows may have a score in one of their windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _unpacked(space, batch.column("vec"))
            most, least = space.bounds(q, pivots, radii)
            low, high = _windows(batch)
            may = (most[:, None, :] >= low[:, :, None]) & (least[:, None, :] <= high[:, :, None]) & (low <= high)[:, :, None]
            groups = [np.flatnonzero(row).tolist() for row in (may.any(axis=1) & (radii >= 0))]
            yield pa.record_batch([*batch.columns, pa.array(groups, pa.list_(pa.int32()))], [*batch.schema.names, "groups"])

    return run


def _unpacked(space: Space, column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), space.store).reshape(len(column), space.width).astype(np.int64)


def _windows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Windows of scores, padded with empty ones to one number."""
    lists = [batch.column(c).to_pylist() for c in ("low", "high")]
    most = max((len(x) for x in lists[0]), default=0) or 1
    out = np.tile(np.array([[1.0], [0.0]]), (1, len(lists[0]) * most)).reshape(2, len(lists[0]), most)
    for side, rows in zip(out, lists, strict=True):
        for row, values in zip(side, rows, strict=True):
            row[: len(values)] = values
    return out[0], out[1]


def _searched(space: Space, same: bool, k: int, leaf_rows: int, fan_out: int, at_once: int = 4096):
    """Rows sorted by block, candidates before anchors: a block becomes a tree, and its anchors are searched in batches."""
    names = ["key", "window", "score", "partner_id"]

    class Block:
        def __init__(self, parts: list[pa.RecordBatch]):
            table = pa.Table.from_batches(parts)
            x, ids = _unpacked(space, table.column("vec").combine_chunks()), np.array(table.column("track_id").to_pylist(), np.int64)
            labels = table.column("player").to_pylist()
            self.known = {label: i for i, label in enumerate(sorted(set(labels)))}
            codes = np.array([self.known[label] for label in labels], np.int64)
            # equal vectors of one player: k + 1 smallest ids are enough for any anchor; a row that repeats counts once
            _, equal = np.unique(x, axis=0, return_inverse=True) if space.width else (None, np.zeros(len(x), np.int64))
            order = np.lexsort((ids, codes, equal))
            group = np.stack((equal[order], codes[order]))
            fresh = np.concatenate(([True], (np.diff(group) != 0).any(axis=0) | (np.diff(ids[order]) != 0)))
            order, group = order[fresh], group[:, fresh]
            start = np.concatenate(([True], (np.diff(group) != 0).any(axis=0)))
            rank = np.arange(len(order)) - np.flatnonzero(start)[np.cumsum(start) - 1]
            keep = order[rank <= k]
            self.points, self.ids, self.codes = x[keep], ids[keep], codes[keep]
            self.tree = CoverTree(space, self.points, leaf_rows, fan_out)

        def search(self, batch: pa.RecordBatch) -> pa.RecordBatch:
            q, ids = _unpacked(space, batch.column("vec")), np.array(batch.column("track_id").to_pylist(), np.int64)
            codes = np.array([self.known.get(label, -1) for label in batch.column("player").to_pylist()], np.int64)
            low, high = _windows(batch)
            a, w, score, partner = best_rows(space, self.tree, self.points, self.ids, self.codes, q, ids, codes, low, high, same, k)
            keys = np.array(batch.column("key").to_pylist(), np.int64)[a]
            return pa.record_batch([pa.array(keys), pa.array(w.astype(np.int32)), pa.array(score), pa.array(partner)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, tree, asked = None, [], None, []

        def answer() -> Iterator[pa.RecordBatch]:
            nonlocal tree, asked
            if asked and parts:
                tree = tree or Block(parts)
                table = pa.Table.from_batches(asked).combine_chunks()
                for piece in table.to_batches(max_chunksize=at_once):
                    yield tree.search(piece)
            asked = []

        for batch in batches:
            blocks, kinds = np.array(batch.column("block").to_pylist(), np.int64), np.array(batch.column("kind").to_pylist(), np.int64)
            cuts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(blocks)], strict=True):
                if a == b:
                    continue
                if blocks[a] != at:
                    yield from answer()
                    at, parts, tree = int(blocks[a]), [], None
                (asked if kinds[a] else parts).append(batch.slice(a, b - a))
                if sum(x.num_rows for x in asked) >= at_once:
                    yield from answer()
        yield from answer()

    return run


def _farthest_first(space: Space, x: np.ndarray, n: int) -> np.ndarray:
    heads = [0]
    d = space.gaps(x, x[:1])[:, 0]
    while len(heads) < n and d.max() > 4 * space.slack:
        heads.append(int(d.argmax()))
        d = np.minimum(d, space.gaps(x, x[heads[-1] :][:1])[:, 0])
    return x[heads]


def mine_hard_negatives(reid: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 5, low: int = 80, high: int = 100,
                        pivots: int = 64, sample: int = 4096, block_rows: int = 4096, leaf_rows: int = 128, fan_out: int = 16) -> DataFrame:
    """(track_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its
    positives the hardest negatives.

    `reid(track_id, player, emb)` holds the appearance vectors of tracks, quantised to whole numbers; `track_id` is
    unique over games and cameras. A score is the exact inner product with the anchor; rows rank by larger score, then by
    smaller id. Positives are the first `n_positives` other rows of the anchor's player; negatives the first `n_negatives`
    rows of other players with low % of the positive's score <= score <= high % of it (all, if there are fewer; none for
    a negative positive score, as such a range is empty).

    Every row is dealt to the nearest of `pivots` centres, chosen farthest first among about `sample` rows (the top
    level of the tree; only the choice of centres rests on the sample), then to blocks of about `block_rows` rows by a
    hash of its id, so a frequent vector or player fills many blocks. A task builds the lower levels for a block and
    answers the anchors sent to it. An anchor first visits its own block; its n-th score there bounds the groups that can
    hold better positives, and the windows bound those that can hold negatives. Anchors (a query set) are sent to blocks;
    candidates are never copied, and at most n rows for an anchor, window and block leave a task.

    Rows with a null id, player or vector or a null component take no part, as candidates or as anchors; vectors of
    different lengths count as ended by zeros. A row repeated whole counts once; other rows with the anchor's own id are
    never its partners, and two rows under one anchor id answer for themselves. Vectors whose products could exceed 2**53
    raise ArithmeticError. Other columns are not read; an empty table gives no rows.
    """
    spark = reid.sparkSession
    source = reid.select(F.col("track_id").cast("long").alias("track_id"), F.col("player").cast("string").alias("player"),
                         F.transform("emb", lambda x: x.cast("long")).alias("emb"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    source = source.filter("track_id is not null and player is not null and emb is not null and forall(emb, x -> x is not null)")
    squares = F.aggregate("emb", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    largest = F.aggregate("emb", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x.cast("double"))))
    size = source.agg(F.max(F.size("emb")).alias("width"), F.max(squares).alias("m2"), F.max(largest).alias("most")).first()
    fields = "key long, window int, score long, partner_id long"
    space = Space(size["width"] or 0, float(size["m2"] or 0.0), float(size["most"] or 0.0))
    chosen = bounded_sample(source, F.col("track_id"), sample).orderBy(F.xxhash64("track_id", "emb")).select("emb").limit(2 * sample).collect()
    tops = _farthest_first(space, space.pack([r["emb"] for r in chosen] or [[]]), pivots)
    rows = cut_lineage(source.mapInArrow(_placed(space, tops), "track_id long, player string, anchor boolean, vec binary, pivot int, gap double"))
    radii, blocks = np.full(len(tops), -1.0), [0] * len(tops)
    for r in rows.groupBy("pivot").agg(F.count("*").alias("n"), F.max("gap").alias("gap")).collect():       # one row for each pivot
        radii[r["pivot"]], blocks[r["pivot"]] = r["gap"], -(-r["n"] // block_rows)
    in_group = F.element_at(F.array(*[F.lit(int(b)).cast("long") for b in blocks]), F.col("pivot") + 1)
    block_of = F.shiftleft(F.col("pivot").cast("long"), 40)
    rows = rows.withColumn("block", block_of + F.pmod(F.xxhash64("track_id"), in_group))
    anchors = rows.filter("anchor").dropDuplicates(["track_id", "player", "vec"]).withColumn("key", F.xxhash64("track_id", "player", "vec"))

    def visit(asked: DataFrame, same: bool, k: int) -> DataFrame:
        empty = F.array().cast("array<double>")
        columns = ["block", "kind", "key", "track_id", "player", "vec", "low", "high"]
        candidates = rows.withColumns({"kind": F.lit(0), "key": F.lit(0).cast("long"), "low": empty, "high": empty}).select(columns)
        asking = asked.withColumn("kind", F.lit(1)).select(columns)
        dealt = candidates.union(asking).repartition("block").sortWithinPartitions("block", "kind")
        return dealt.mapInArrow(_searched(space, same, k, leaf_rows, fan_out), fields)

    def elsewhere(asked: DataFrame) -> DataFrame:
        """The blocks that the bounds of the top level leave to each anchor, its own among them."""
        schema = asked.select("key", "track_id", "player", "vec", "low", "high", F.col("block").alias("home"))
        may = schema.mapInArrow(_groups(space, tops, radii), "key long, track_id long, player string, vec binary, low array<double>, high array<double>, home long, groups array<int>")
        spread = may.withColumn("pivot", F.explode("groups")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), in_group - 1)))
        return spread.withColumn("block", block_of + F.col("salt"))

    def first(found: DataFrame, k: int) -> DataFrame:
        w = Window.partitionBy("key", "window").orderBy(F.desc("score"), "partner_id")      # limited before the shuffle
        return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    every = F.array(F.lit(float("inf")))
    home = cut_lineage(visit(anchors.withColumns({"low": F.transform(every, lambda x: -x), "high": every}), True, n_positives))
    floor = home.groupBy("key").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    known = anchors.join(floor, "key", "left").withColumn(
        "low", F.array(F.when(F.col("n") >= n_positives, F.col("least").cast("double")).otherwise(F.lit(float("-inf"))))).withColumn("high", every)
    more = visit(elsewhere(known).filter("block <> home"), True, n_positives)
    positives = cut_lineage(first(home.union(more), n_positives))
    rising = F.sort_array(F.collect_list(F.struct("rank", "score")))
    bounds = positives.groupBy("key").agg(rising.alias("p"))
    asked = anchors.join(bounds, "key").withColumns({
        "low": F.expr(f"transform(p, x -> double(({low} * x.score) div 100 + if(({low} * x.score) % 100 > 0, 1, 0)))"),
        "high": F.expr(f"transform(p, x -> double(({high} * x.score) div 100 - if(({high} * x.score) % 100 < 0, 1, 0)))")})
    found = first(visit(elsewhere(asked), False, n_negatives), n_negatives)
    named = positives.withColumn("window", F.col("rank") - 1).select("key", "window", F.col("partner_id").alias("positive_id"), F.col("score").alias("positive_score"))
    ids = anchors.select("key", "track_id")
    return found.join(named, ["key", "window"]).join(ids, "key").select(
        "track_id", "positive_id", "rank", F.col("partner_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
