"""Near-duplicate narrations by SimHash: popcounts of fingerprint segments as grid points, a range join under Manhattan distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtloom.llm.common import components, dealt_anew
from courtloom.session import cut_lineage

_PAIRS = np.uint64(0x5555555555555555)
#: Shingles hashed and counted at once.
_PIECE = 1 << 15
#: Most hot cells that are broadcast (16 bytes each); beyond it they are joined.
_BROADCAST = 100_000


def fingerprint_of(text: str | None, words: int) -> int:
    """Bit k is set if it is set in over half of the XXH64 values (seed 42) of the shingles; 0 without words."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()      # bytes: lower() and split() are ASCII's
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(words, len(tokens))
    starts, ends = starts[: len(tokens) - size + 1].tolist(), ends[size - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), _PIECE):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at : at + _PIECE], ends[at : at + _PIECE], strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(starts), bitorder="little")
    return int(bits.view("<i8")[0])


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint_of(text.as_py(), words) for text in batch.column("summary")]
            yield pa.record_batch([batch.column("job_id"), pa.array(prints, pa.int64())], ["job_id", "fingerprint"])

    return run


def popcounts(prints: np.ndarray) -> np.ndarray:
    """Counts of set bits of the 32 two-bit segments, packed as two-bit numbers. Two fingerprints differ in as many bits at
    least as the Manhattan distance of their counts."""
    return prints - ((prints >> np.uint64(1)) & _PAIRS)


def grid_cells(prints: np.ndarray, parts: tuple[tuple[int, int], ...]) -> tuple[np.ndarray, np.ndarray]:
    """(cell, row): grid cells in which fingerprints meet whose counts within some part differ by its reach at most.

    `parts` are (bits, reach): points within reach 2 have a common neighbour one step from either, so each visits the
    cells one step up and down; of two points one step apart the lower one is the other's lower neighbour."""
    counts, cells, rows = popcounts(prints), [], []
    at, every = 0, np.arange(len(prints))
    for k, (bits, reach) in enumerate(parts):
        own = (counts >> np.uint64(at)) & np.uint64((1 << bits) - 1)
        tag = np.uint64(k << 58)
        cells.append(own | tag)
        rows.append(every)
        for place in range(0, bits if reach else 0, 2):
            one = np.uint64(1 << place)
            field = (own >> np.uint64(place)) & np.uint64(3)
            for step, may in ((-1, field > 0), (1, field < 2)):
                if step < 0 or reach == 2:
                    cells.append((own[may] - one if step < 0 else own[may] + one) | tag)
                    rows.append(every[may])
        at += bits
    return np.concatenate(cells), np.concatenate(rows)


def _visited(parts: tuple[tuple[int, int], ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column("fingerprint").to_numpy(zero_copy_only=False).view(np.uint64)
            for low in range(0, len(prints), 4096):
                part = prints[low : low + 4096]
                cells, rows = grid_cells(part, parts)
                yield pa.record_batch([pa.array(cells.view(np.int64)), pa.array(part[rows].view(np.int64))], ["cell", "fingerprint"])

    return run


def _roots(a: np.ndarray, b: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Union of the pairs (a, b) into `parent`, whose entries are roots; each root is the smallest node of its set."""
    while True:
        pa_, pb = parent[a], parent[b]
        differ = pa_ != pb
        if not differ.any():
            return parent
        a, b, pa_, pb = a[differ], b[differ], pa_[differ], pb[differ]
        np.minimum.at(parent, np.maximum(pa_, pb), np.minimum(pa_, pb))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def linked(group: np.ndarray, prints: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, root): a spanning forest of the pairs inside a group that differ in `max_bits` bits at most. Rows are
    sorted by group; rows of distance 1, 2, ... are compared until no two of them share a group."""
    values, node = np.unique(prints, return_inverse=True)
    parent = np.arange(len(values))
    at, lag = np.arange(len(prints)), 1
    while len(at):
        at = at[at + lag < len(prints)]
        at = at[group[at] == group[at + lag]]
        near = at[np.bitwise_count(prints[at] ^ prints[at + lag]) <= max_bits]
        parent = _roots(node[near], node[near + lag], parent)
        lag += 1
    child = np.flatnonzero(parent != np.arange(len(values)))
    return values[child], values[parent[child]]


def _verified(max_bits: int, at_once: int = 1 << 17):
    """Rows sorted by (cell, i, j) become the verified links of whole cells."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def done(rows: np.ndarray) -> pa.RecordBatch:
            group = np.concatenate(([0], np.cumsum((np.diff(rows[:, :3], axis=0) != 0).any(axis=1))))
            a, b = linked(group, np.ascontiguousarray(rows[:, 3]).view(np.uint64), max_bits)
            return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("cell", "i", "j", "fingerprint")], axis=1)
            held.append(rows)
            n += len(rows)
            if n >= at_once:
                rows = np.concatenate(held)
                cut = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1))
                to = int(cut[-1]) + 1 if len(cut) else 0
                if to:
                    yield done(rows[:to])
                held, n = [rows[to:]], len(rows) - to
        if n:
            yield done(np.concatenate(held))

    return run


def near_copy_classes(narrations: DataFrame, words: int = 4, max_bits: int = 4, parts: tuple[tuple[int, int], ...] = ((36, 2), (28, 1)),
                      block: int = 2048) -> DataFrame:
    """(job_id, fingerprint, class_id): one row for each row of `narrations(job_id, summary)`.

    A fingerprint has 64 bits over the runs of `words` words of the whole summary, lower-cased in A-Z, repeats counted; a
    shorter text is one run, and one without words (null or empty) has fingerprint 0. Narrations are linked whose
    fingerprints differ in `max_bits` bits at most; `class_id` is the smallest job_id that links reach.

    Equal fingerprints are one node. Two-bit segments map a node to 32 counts of set bits; the Manhattan distance of
    counts is at most the number of differing bits. `parts` split the bits into ranges with a reach each; as the reaches
    plus one sum to more than `max_bits`, near nodes lie within the reach of some part, and meet in a cell of its grid
    (`grid_cells`). Pairs in a cell are verified exactly; only a spanning forest of them leaves a task. A cell of more
    than `block` nodes is dealt out by pairs of blocks, so no task holds it.

    Rows without an id take part; their class is that of their fingerprint (null if no id is in it). Repeated rows and
    ids stay as they are. Other columns are not read; an empty table gives no rows.
    """
    if sum(reach + 1 for _, reach in parts) <= max_bits or sum(bits for bits, _ in parts) != 64 or any(reach not in (0, 1, 2) or bits % 2 for bits, reach in parts):
        raise ValueError("parts must split 64 bits evenly, with reaches of 0, 1 or 2 that cover max_bits")
    source = narrations.select(F.col("job_id").cast("long").alias("job_id"), "summary")
    prints = cut_lineage(source.mapInArrow(_fingerprints(words), "job_id long, fingerprint long"))
    nodes = cut_lineage(prints.groupBy("fingerprint").agg(F.min("job_id").alias("least")))
    cells = nodes.select("fingerprint").mapInArrow(_visited(parts), "cell long, fingerprint long")
    hot = cut_lineage(cells.groupBy("cell").count().filter(F.col("count") > block).select("cell", F.ceil(F.col("count") / block).cast("int").alias("blocks")))
    found = cells.join(F.broadcast(hot) if hot.count() <= _BROADCAST else hot, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j")))
    dealt = found.withColumn("own", own).select("cell", "fingerprint", F.inline(others)).repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    roots = components(cut_lineage(dealt.mapInArrow(_verified(max_bits), "a long, b long")))
    joined = nodes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    lows = joined.groupBy("root").agg(F.min("least").alias("class_id"))
    classes = joined.join(dealt_anew(lows, "root"), "root").select("fingerprint", "class_id")
    return prints.join(dealt_anew(classes, "fingerprint"), "fingerprint").select("job_id", "fingerprint", "class_id")
