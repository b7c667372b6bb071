"""Helpers shared by the text operators: word hashes in numpy, text statistics, bounded samples, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtloom.session import cut_lineage

#: Bytes hashed at once; bounds the temporary arrays of a task (about 60 bytes for each).
PIECE = 1 << 19
_MULT = 0x9E3779B97F4A7C15
_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n + 1:
        size = max(n, PIECE) + 1
        inverse = pow(_MULT, -1, 1 << 64)
        for name, base in (("up", _MULT), ("down", inverse)):
            column = np.full(size, np.uint64(base))
            column[0] = 1
            _POWERS[name] = np.multiply.accumulate(column)
        _POWERS["byte"] = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULT))
    return _POWERS["up"], _POWERS["down"], _POWERS["byte"]


def _hash_piece(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start byte of each word `[^\\x20\\x09-\\x0D]+` of a piece that cuts no word."""
    data = np.frombuffer(raw, np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down, byte = _powers(len(data))
    inside = np.concatenate(([False], ~_WS[data], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte[data] * up[: len(data)], out=total[1:])
    return mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), start


def hashed_groups(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, offsets) for groups of whole rows of about PIECE bytes; a longer text is a group of its own.

    Null counts as empty. Equal words have equal hashes in every task and run.
    """
    group: list[bytes] = []
    first, held = 0, 0

    def close() -> tuple[int, np.ndarray, np.ndarray]:
        words, start = _hash_piece(b" ".join(group))
        ends = np.cumsum([len(raw) + 1 for raw in group])
        return first, words, np.concatenate(([0], np.searchsorted(start, ends)))

    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "replace")
        if group and held + len(raw) > PIECE:
            yield close()
            group, first, held = [], i, 0
        if len(raw) > PIECE:
            parts, at = [], 0
            while at < len(raw):
                to = min(len(raw), at + PIECE)
                while to < len(raw) and not _WS[raw[to]]:
                    to += 1
                parts.append(_hash_piece(raw[at:to])[0])
                at = to
            words = np.concatenate(parts)
            yield i, words, np.array([0, len(words)])
            first = i + 1
            continue
        group.append(raw)
        held += len(raw) + 1
    if group:
        yield close()


def windows_of(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` words; the whole text if it has fewer (none without words)."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    out = words[:n].copy()
    for k in range(1, size):
        out = out * np.uint64(_MULT) + words[k : k + n]
    return mix64(out + np.uint64(size))


# ---------------------------------------------------------------- statistics

STATS = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField(n, T.DoubleType()) for n in ("symbol_share", "upper_share", "shout_share", "digit_share", "mark_share", "pipe_share",
                                                  "mean_word", "distinct_share", "repeat_share", "dup_line_share", "words_per_line")]
)
#: Statistics that models may use.
FEATURES = ("n_words", "symbol_share", "upper_share", "shout_share", "digit_share", "mark_share", "pipe_share", "mean_word", "distinct_share",
            "repeat_share", "dup_line_share", "words_per_line")
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_MARKS = np.frombuffer(b".,;:!?'\"()-", np.uint8)


def repeated_words(ids: np.ndarray) -> int:
    """Words inside three-word windows that occur twice or more in the text, the first occurrence included."""
    n = len(ids) - 2
    if n < 2:
        return 0
    keys = ids.astype(np.int64)
    for k in (1, 2):      # ranks after each step, so that a product stays below 2 ** 63
        head = np.unique(keys[:n], return_inverse=True)[1] if k == 2 else keys[:n]
        keys = head * (int(ids.max()) + 1) + ids[k : k + n]
    _, back, count = np.unique(keys, return_inverse=True, return_counts=True)
    hit = count[back] > 1
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k : k + n] |= hit
    return int(covered.sum())


def text_stats(texts: list[str | None]) -> pd.DataFrame:
    """One row of STATS for each whole text; null counts as empty, and an empty text has zeros."""
    rows = []
    for text in texts:
        raw = (text or "").encode("utf-8", "replace")
        hist = np.zeros(256, np.int64)
        for at in range(0, len(raw), PIECE):
            hist += np.bincount(np.frombuffer(raw[at : at + PIECE], np.uint8), minlength=256)
        points = int(hist.sum() - hist[128:192].sum())
        word_chars = points - int(hist[_WS].sum())
        words = raw.split()
        known: dict[bytes, int] = {}
        ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
        lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
        n, n_lines = len(words), len(lines)
        symbols, dup, again = int(hist[_SYMBOLS].sum()), n_lines - len(set(lines)), repeated_words(ids)
        of_chars, of_words = 1.0 / max(word_chars, 1), 1.0 / max(n, 1)
        rows.append((n, word_chars, symbols, dup, again, symbols * of_chars, int(hist[65:91].sum()) * of_chars, int(hist[33]) * of_chars,
                     int(hist[48:58].sum()) * of_chars, int(hist[_MARKS].sum()) * of_chars, int(hist[124]) * of_chars, word_chars * of_words,
                     len(known) * of_words, again * of_words, dup / max(n_lines, 1), n / max(n_lines, 1)))
    return pd.DataFrame(rows, columns=STATS.fieldNames())


@F.pandas_udf(STATS)
def stats_of(texts: pd.Series) -> pd.DataFrame:
    return text_stats(list(texts))


def free_prefix(columns: list[str]) -> str:
    """A prefix that no name of `columns` begins with, for columns that are added for a while."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


# ---------------------------------------------------------------- samples

def fold(job_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; null for a null id."""
    return F.pmod(F.crc32(job_id.cast("string").cast("binary")), F.lit(parts))


def bounded_sample(rows: DataFrame, key: Column, bound: int) -> DataFrame:
    """About `bound` rows at most (all if there are fewer), chosen by a hash of the key and so alike in every run."""
    n = rows.count()
    if n <= bound:
        return rows
    keep = int(bound / n * (1 << 30))
    return rows.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < keep)


def rated_sample(narrations: DataFrame, ratings: DataFrame, label: str, bound: int) -> DataFrame:
    """(job_id, summary, label) of at most about `bound` rated narrations. The chosen ids (8 bytes each, so their size
    is bounded by `bound`) are broadcast: the texts are filtered where they are read and not shuffled. A narration
    rated more than once takes the largest rating; a null id or rating does not count."""
    rated = ratings.select("job_id", F.col(label).cast("int").alias("label")).dropna().groupBy("job_id").agg(F.max("label").alias("label"))
    chosen = bounded_sample(rated, F.col("job_id"), bound)
    return narrations.select("job_id", "summary").join(F.broadcast(chosen), "job_id")


# ---------------------------------------------------------------- components

def dealt_anew(summed: DataFrame, key: str) -> DataFrame:
    """The rows of an aggregate by `key`, dealt by another hash, so that a join on `key` shuffles either side plainly and
    adaptive execution can split the large keys of the other one. `summed` has one row for each key."""
    return summed.repartition(F.xxhash64(F.lit(1), key))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component of undirected `edges` (a, b), for nodes with an edge.

    Alternates large-star and small-star steps, each a combinable minimum by node and a join back, until the edges no
    longer change; the edges of each round are checkpointed, nothing is collected but two sums.
    """
    def mark(e: DataFrame) -> tuple:
        row = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return row[0], row[1]

    e = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    seen = mark(e)
    while seen[0]:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(dealt_anew(low, "a"), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(dealt_anew(low, "a"), "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut_lineage(small.union(low.select("a", F.col("m").alias("b"))).distinct())
        last, seen = seen, mark(e)
        if last == seen:
            break
    nodes = e.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return nodes.union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
