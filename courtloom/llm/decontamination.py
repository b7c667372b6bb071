"""Benchmark decontamination by greedy string tiling between narrations and held-out reference summaries."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from courtloom.llm.common import hashed_groups, windows_of

#: Signs count as spaces and case does not count.
_SIGNS = str.maketrans({c: " " for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"})


def _plain(text: str | None) -> str:
    return (text or "").lower().translate(_SIGNS)


def tiles(doc_at: np.ndarray, ref_at: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling. The arguments are the starts of equal windows of `least` words in both texts; windows that
    follow each other on one diagonal form a maximal match. The longest match whose words are all free becomes a tile
    (ties: earlier in the reference, then in the text); a match that meets marked words is cut into its free runs."""
    order = np.lexsort((ref_at, ref_at - doc_at))
    d, r = doc_at[order], ref_at[order]
    new = np.flatnonzero(np.concatenate(([True], (np.diff(r) != 1) | (np.diff(r - d) != 0))))
    runs = np.diff(np.concatenate((new, [len(r)])))
    heap = [(-(int(n) + least - 1), int(r[k]), int(d[k])) for k, n in zip(new, runs, strict=True)]
    heapq.heapify(heap)
    used_ref, used_doc, found = set(), set(), []
    while heap:
        n, at, to = heapq.heappop(heap)
        n = -n
        busy = [k for k in range(n) if at + k in used_ref or to + k in used_doc]
        if not busy:
            found.append((at, to, n))
            used_ref.update(range(at, at + n))
            used_doc.update(range(to, to + n))
            continue
        low = 0
        for k in [*busy, n]:
            if k - low >= least:
                heapq.heappush(heap, (-(k - low), at + low, to + low))
            low = k + 1
    return found


class ReferenceSet:
    """Window hashes of a block of reference summaries, ready for lookup in every task."""

    def __init__(self, references: list[tuple[int, str]], least: int, coverage: float):
        self.least, self.coverage = least, coverage
        self.ids, self.sizes, keys, owner, at = [], [], [], [], []
        for window_id, summary in references:
            for _, words, offs in hashed_groups([_plain(summary)]):
                if offs[-1] >= least:
                    own = windows_of(words, least)
                    keys.append(own)
                    owner.append(np.full(len(own), len(self.ids)))
                    at.append(np.arange(len(own)))
                    self.ids.append(window_id)
                    self.sizes.append(int(offs[-1]))
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(self.keys, kind="stable")
        self.keys = self.keys[order]
        self.owner = np.concatenate(owner)[order] if keys else np.zeros(0, np.int64)
        self.at = np.concatenate(at)[order] if keys else np.zeros(0, np.int64)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.keys >> np.uint64(44)] = True

    def match(self, windows: np.ndarray) -> list[dict]:
        maybe = np.flatnonzero(self.bits[windows >> np.uint64(44)])
        if not len(maybe):
            return []
        low = np.searchsorted(self.keys, windows[maybe])
        n = np.searchsorted(self.keys, windows[maybe], "right") - low
        seeds = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        doc_at, owner, ref_at = np.repeat(maybe, n), self.owner[seeds], self.at[seeds]
        out = []
        for k in np.unique(owner):
            own = owner == k
            d, r = doc_at[own], ref_at[own]
            starts = np.unique(r)       # every tile is made of these windows, so their union bounds the coverage
            most = np.minimum(np.diff(starts), self.least).sum() + self.least
            if most < self.coverage * self.sizes[k]:
                continue
            made = tiles(d, r, self.least)
            share = sum(t[2] for t in made) / self.sizes[k]
            if share >= self.coverage:
                out.append({"window_id": self.ids[k], "coverage": share, "tiles": len(made), "longest": max(t[2] for t in made)})
        return out

    def find(self, texts: list[str | None]) -> list[list[dict]]:
        found: list[list[dict]] = []
        for _, words, offs in hashed_groups([_plain(x) for x in texts]):
            for k in range(len(offs) - 1):
                own = words[offs[k] : offs[k + 1]]
                found.append(self.match(windows_of(own, self.least)) if len(own) >= self.least and len(self.keys) else [])
        return found


def _blocks(narrations: DataFrame, references: DataFrame, coverage: float, least: int, block_chars: int) -> Iterator[Broadcast]:
    """The references in blocks of about `block_chars` characters, one after the other."""
    known = references.select("window_id", "summary").dropna().distinct()
    chars = known.agg(F.sum(F.length("summary"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / block_chars))
    for k in range(blocks):
        rows = known.filter(F.pmod(F.xxhash64("window_id", "summary"), F.lit(blocks)) == k).orderBy("window_id", "summary").collect()
        yield narrations.sparkSession.sparkContext.broadcast(ReferenceSet([tuple(r) for r in rows], least, coverage))


def _hit_rows(shared: Broadcast, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.find(batch.column("summary").to_pylist())
            take = pa.array([i for i, hits in enumerate(found) for _ in hits], pa.int32())
            hits = [h for own in found for h in own]
            columns = [pa.array([h[n] for h in hits], kind) for n, kind in (("window_id", id_type), ("coverage", pa.float64()), ("tiles", pa.int32()), ("longest", pa.int32()))]
            yield pa.record_batch([batch.column("job_id").take(take), *columns], ["job_id", "window_id", "coverage", "tiles", "longest"])

    return run


def contaminated(narrations: DataFrame, references: DataFrame, coverage: float = 0.6, least: int = 5, block_chars: int = 16_000_000) -> DataFrame:
    """(job_id, window_id, coverage, tiles, longest): one row for each row of `narrations` and each reference (window_id,
    summary) of which tiles of at least `least` words cover `coverage` of the words, in whatever order the tiles stand.

    The references are a stated query set. They are met in blocks of about `block_chars` characters, each block in tasks of
    its own, so what a task holds does not grow with their number; the narrations are neither shuffled nor paired.
    Ids keep their types. A reference of fewer than `least` words never matches; null counts as empty; a repeated
    reference is met once for each text that bears its id. Other columns are not read.
    """
    kind = {name: references.schema["window_id"].dataType if name == "window_id" else narrations.schema["job_id"].dataType for name in ("job_id", "window_id")}
    schema = f"job_id {kind['job_id'].simpleString()}, window_id {kind['window_id'].simpleString()}, coverage double, tiles int, longest int"
    texts = narrations.select("job_id", "summary")
    parts = [texts.mapInArrow(_hit_rows(shared, to_arrow_type(kind["window_id"])), schema) for shared in _blocks(narrations, references, coverage, least, block_chars)]
    return reduce(DataFrame.union, parts)


def without_contaminated(narrations: DataFrame, references: DataFrame, coverage: float = 0.6, least: int = 5, block_chars: int = 16_000_000) -> DataFrame:
    """The narrations that hold no reference, all columns as they are.

    One block of references is looked up where the texts are read. Of several, each in tasks of its own leaves the digests
    of the texts that it finds, and the narrations with such a text go."""
    blocks = list(_blocks(narrations, references, coverage, least, block_chars))

    def held(shared: Broadcast) -> Column:
        @F.pandas_udf("boolean")
        def found(texts: pd.Series) -> pd.Series:
            return pd.Series([len(hits) > 0 for hits in shared.value.find(list(texts))], dtype=bool)

        return found("summary")

    if len(blocks) == 1:
        return narrations.filter(~held(blocks[0]))
    digest = F.md5(F.col("summary").cast("binary"))
    bad = reduce(DataFrame.union, [narrations.select("summary").filter(held(shared)).select(digest.alias("digest")) for shared in blocks]).distinct()
    return narrations.join(bad, F.md5(narrations["summary"].cast("binary")) == bad["digest"], "left_anti")
