"""Near-duplicate narrations: MinHash bands, Bayesian pruning of pairs, exact Jaccard similarity of word shingles."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtloom.llm.common import components, dealt_anew, free_prefix, hashed_groups, mix64, windows_of
from courtloom.session import cut_lineage

_LOW = np.uint64(0xFFFFFFFF)


def _families(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix64(np.arange(1, 2 * n + 1, dtype=np.uint64))
    return (seeds[:n] & _LOW).astype(np.uint32) | np.uint32(1), (seeds[n:] & _LOW).astype(np.uint32)


def minhash(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One minimum for each hash function; the shingles are taken in pieces so that memory stays bounded."""
    out = np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    low = (shingles >> np.uint64(16)).astype(np.uint32)
    for at in range(0, len(low), 1024):
        np.minimum(out, (low[at : at + 1024, None] * a + b).min(axis=0), out=out)
    return out


def least_matches(n_hashes: int, step: int, threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """(hashes compared, fewest equal values to go on). With a uniform prior the similarity after m of n equal values is
    Beta(m + 1, n - m + 1); P(similarity >= t) is then P(Binomial(n + 1, t) <= m), and a pair goes when that is below
    `tolerance`."""
    out = []
    for n in range(step, n_hashes + 1, step):
        below, m = 0.0, -1
        while below < tolerance:
            m += 1
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def surviving_pairs(signs: np.ndarray, left: np.ndarray, right: np.ndarray, steps: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Compare the pairs piece by piece and keep those that no step drops."""
    same, at = np.zeros(len(left), np.int32), 0
    for n, least in steps:
        same += (signs[left, at:n] == signs[right, at:n]).sum(axis=1, dtype=np.int32)
        go = same >= least
        left, right, same, at = left[go], right[go], same[go], n
        if not len(left):
            break
    return left, right


def similar(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Exact: |A & B| / |A | B| >= threshold. Few pairs are merged one by one; many pairs among few texts share one
    product of their incidence matrix, in column pieces."""
    if not len(left):
        return np.zeros(0, bool)
    members = np.unique(np.concatenate((left, right)))
    sizes = np.array([len(s) for s in sets])
    if len(left) <= 4 * len(members):
        common = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(left, right, strict=True)])
    else:
        row = np.repeat(np.arange(len(members)), sizes[members])
        _, col, count = np.unique(np.concatenate([sets[i] for i in members]), return_inverse=True, return_counts=True)
        shared = np.cumsum(count > 1) - 1
        use = count[col] > 1
        row, col = row[use], shared[col[use]]
        product = np.zeros((len(members), len(members)), np.float32)
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        for low in range(0, int(col[-1]) + 1 if len(col) else 0, 4096):
            a, b = np.searchsorted(col, (low, low + 4096))
            part = np.zeros((len(members), 4096), np.float32)
            part[row[a:b], col[a:b] - low] = 1
            product += part @ part.T
        common = product[np.searchsorted(members, left), np.searchsorted(members, right)].astype(np.int64)
    return common >= threshold * (sizes[left] + sizes[right] - common) - 1e-9


def _signatures(words: int, bands: int, rows: int):
    a, b = _families(bands * rows)
    weights = mix64(np.arange(1, rows + 1, dtype=np.uint64) * np.uint64(77)) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[bytes | None] = [None] * batch.num_rows
            banded = np.zeros((batch.num_rows, bands), np.int64)
            for first, hashes, offs in hashed_groups(batch.column("summary").to_pylist()):
                for k in range(len(offs) - 1):
                    own = np.unique(windows_of(hashes[offs[k] : offs[k + 1]], words))
                    if len(own):
                        keys[first + k] = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                        sign = minhash(own, a, b).astype(np.uint64).reshape(bands, rows)
                        banded[first + k] = mix64((sign * weights).sum(axis=1, dtype=np.uint64)).view(np.int64)
            flat = pa.ListArray.from_arrays(np.arange(0, banded.size + 1, bands, dtype=np.int32), banded.ravel())
            yield pa.record_batch([batch.column("job_id"), batch.column("text_key"), pa.array(keys, pa.binary()), flat], ["job_id", "text_key", "set_key", "bands"])

    return run


def _verify(words: int, n_hashes: int, threshold: float, steps: list[tuple[int, int]]):
    """Rows sorted by cell (component and block pair) become (node, root, links, text_links) of linked nodes."""
    a, b = _families(n_hashes)

    def cell(ids: list[bytes], copies: list[int], sides: list[int], texts: list[str]) -> tuple[list, ...]:
        sets: list[np.ndarray] = []
        for _, hashes, offs in hashed_groups(texts):
            sets += [np.unique(windows_of(hashes[offs[k] : offs[k + 1]], words)) for k in range(len(offs) - 1)]
        signs = np.stack([minhash(s, a, b) for s in sets])
        side = np.array(sides)
        ends, left, right = np.flatnonzero(side != 1), None, None
        if (side == 1).any():
            other = np.flatnonzero(side == 1)
            left, right = (x.ravel() for x in np.meshgrid(ends, other, indexing="ij"))
        else:
            left, right = (ends[x] for x in np.triu_indices(len(ends), 1))
        left, right = surviving_pairs(signs, left, right, steps)
        ok = similar(sets, left, right, threshold)
        left, right = left[ok], right[ok]
        linked = np.unique(np.concatenate((left, right)))
        parent = list(range(len(ids)))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for i, j in zip(left.tolist(), right.tolist(), strict=True):
            i, j = find(i), find(j)
            if i != j:
                low, high = (i, j) if ids[i] < ids[j] else (j, i)
                parent[high] = low
        weight = np.array(copies, np.int64)
        links = np.bincount(left, weight[right], len(ids)) + np.bincount(right, weight[left], len(ids))
        other_texts = np.bincount(left, minlength=len(ids)) + np.bincount(right, minlength=len(ids))
        return ([ids[i] for i in linked], [ids[find(i)] for i in linked], links[linked].astype(np.int64).tolist(), other_texts[linked].tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, ([], [], [], [])

        def done() -> pa.RecordBatch:
            columns = [pa.array(x, kind) for x, kind in zip(cell(*held), (pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)]
            return pa.record_batch(columns, ["node", "root", "links", "text_links"])

        for batch in batches:
            d = batch.to_pydict()
            for key, *row in zip(zip(d["comp"], d["i"], d["j"], strict=True), d["node"], d["copies"], d["side"], d["summary"], strict=True):
                if key != at:
                    if len(held[0]) > 1:
                        yield done()
                    at, held = key, ([], [], [], [])
                for column, value in zip(held, row, strict=True):
                    column.append(value)
        if len(held[0]) > 1:
            yield done()

    return run


def link_narrations(narrations: DataFrame, threshold: float = 0.8, words: int = 5, bands: int = 28, rows: int = 5,
                    tolerance: float = 1e-9, step: int = 20, block: int = 192) -> DataFrame:
    """(job_id, class_id, n_links, n_text_links, text_key, class_key): one row for each row of `narrations`, by Jaccard
    similarity of shingles.

    Shingles are runs of `words` words (a shorter text is one shingle). Narrations with one shingle set are one node;
    nodes that share a MinHash band form candidate components (missed with probability (1 - s ** rows) ** bands: 1.5e-5
    at s = 0.8). Inside a component pairs are compared hash by hash, dropped by the Bayesian rule, and the rest
    verified exactly; a component of more than `block` nodes is dealt out by pairs of blocks, so no task holds it.
    Only counts and local roots leave a task, never pairs.

    `class_id` is the smallest job_id of the connected class, `n_links` the number of other rows with similarity of at
    least `threshold` (copies counted), `n_text_links` that of different shingle sets. `text_key` is a hash of the summary
    and `class_key` names the class itself, as different texts may stand under one id. A narration without words (null or
    empty) or id is alone: class_id = job_id, no links, no class_key. Rows that repeat a text and its id count as copies;
    different texts under one id are linked each for itself. Other columns are not read.
    """
    source = narrations.select(F.col("job_id").cast("long").alias("job_id"), "summary", F.xxhash64("summary").alias("text_key"))
    signed = cut_lineage(source.mapInArrow(_signatures(words, bands, rows), "job_id long, text_key long, set_key binary, bands array<bigint>"))
    usable = signed.filter("set_key is not null and job_id is not null")
    nodes = cut_lineage(usable.groupBy("set_key").agg(F.min(F.struct("job_id", "text_key")).alias("head"), F.count("*").alias("copies")))
    heads = nodes.select(F.col("set_key").alias("node"), "head.*").join(usable.select("job_id", "text_key", "bands"), ["job_id", "text_key"])
    banded = heads.dropDuplicates(["node"]).select("node", F.posexplode("bands").alias("band", "value"))
    shared = banded.groupBy("band", "value").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high")
    edges = banded.join(shared.drop("high"), ["band", "value"]).select(F.col("node").alias("a"), F.col("low").alias("b"))
    comps = cut_lineage(components(edges))
    sizes = comps.groupBy("root").agg(F.count("*").alias("size"))
    places = comps.join(sizes, "root").join(nodes.select(F.col("set_key").alias("node"), "head.*", "copies"), "node").select(
        "node", F.col("root").alias("comp"), "job_id", "text_key", "copies", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    places = places.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = F.expr("transform(sequence(0, blocks - 1), o -> struct(least(own, o) as i, greatest(own, o) as j, int(own > o) as side))")
    texts = source.join(places, ["job_id", "text_key"]).dropDuplicates(["node"])
    cells = texts.select("node", "comp", "copies", "summary", "blocks", F.inline(pairs))
    dealt = cells.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "node").select("comp", "i", "j", "node", "copies", "side", "summary")
    steps = least_matches(bands * rows, step, threshold, tolerance)
    found = cut_lineage(dealt.mapInArrow(_verify(words, bands * rows, threshold, steps), "node binary, root binary, links long, text_links long"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"), F.sum("text_links").alias("text_links"))
    joined = nodes.withColumnRenamed("set_key", "node").join(counts.join(roots, "node"), "node", "left").withColumn("class_key", F.coalesce("root", "node"))
    lows = joined.groupBy("class_key").agg(F.min("head.job_id").alias("class_id"))
    classes = joined.join(dealt_anew(lows, "class_key"), "class_key").select(
        F.col("node").alias("set_key"), "class_key", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
        F.coalesce("text_links", F.lit(0)).alias("text_links"))
    own = signed.select("job_id", "text_key", F.when(F.col("job_id").isNotNull(), F.col("set_key")).alias("set_key"))
    return own.join(dealt_anew(classes, "set_key"), "set_key", "left").select(
        "job_id", F.coalesce("class_id", "job_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"),
        F.coalesce("text_links", F.lit(0)).alias("n_text_links"), "text_key", "class_key")


def one_per_class(narrations: DataFrame, links: DataFrame) -> DataFrame:
    """One narration of each class, that with the smallest id, once; rows without an id stay, and of rows without words one
    for each id and text. Different texts under one id are different narrations. Columns and types are kept."""
    alone = F.struct("job_id", "text_key")
    known = links.filter("job_id is not null").withColumn("alone", F.when(F.col("class_key").isNull(), alone))
    heads = known.groupBy("class_key", "alone").agg(F.min(alone).alias("head")).select(F.col("head.job_id").alias("head_id"), F.col("head.text_key").alias("head_text"))
    same = (narrations["job_id"] == F.col("head_id")) & (F.xxhash64(narrations["summary"]) == F.col("head_text"))
    mark = f"{free_prefix(narrations.columns)}text"
    kept = narrations.join(heads.distinct(), same, "left_semi").withColumn(mark, F.xxhash64("summary")).dropDuplicates(["job_id", mark]).drop(mark)
    return kept.unionByName(narrations.filter("job_id is null"))
