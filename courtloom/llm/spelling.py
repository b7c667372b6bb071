"""Spelling variants of words in narrations: pivotal bigrams met by gram prefixes, verified by one edit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtloom.operators.identity import resolve_aliases
from courtloom.session import cut_lineage

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_runs(narrations: DataFrame, min_length: int = 7) -> DataFrame:
    """(job_id, word): every maximal run of letters A-Z, a-z and U+00C0 to U+00FF of at least `min_length` code points,
    lower-cased in A-Z only, one row for each time it stands in a summary. Null summaries have none."""
    runs = F.regexp_extract_all(F.translate("summary", _UPPER, _LOWER), F.lit(f"([a-z\\u00C0-\\u00FF]{{{min_length},}})"), 1)
    return narrations.select("job_id", F.explode(runs).alias("word"))


def count_words(words: DataFrame, min_length: int = 7, min_count: int = 2) -> DataFrame:
    """(word, n): words of at least `min_length` code points that stand there `min_count` times or more."""
    return words.filter(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def pivots_of(prefix: list[tuple[int, int]]) -> tuple[int, int]:
    """Places of the two disjoint bigrams of least total frequency among `prefix` (place, frequency), sorted by place.

    best[p] is the cheapest single choice among grams that end before place p; the second gram adds to it."""
    best: tuple[int, int] | None = None       # (frequency, place) of the cheapest gram disjoint from the one at hand
    chosen: tuple[int, int, int] | None = None
    waiting: list[tuple[int, int]] = []
    for place, frequency in prefix:
        while waiting and waiting[0][1] + 2 <= place:
            best = min(waiting.pop(0), best or (1 << 62, 0))
        if best is not None and (chosen is None or best[0] + frequency < chosen[0]):
            chosen = (best[0] + frequency, best[1], place)
        waiting.append((frequency, place))
    return chosen[1], chosen[2]


def _rank(gram: str, order: dict[str, tuple[int, int]]) -> tuple[int, int]:
    """(place in the order of grams, frequency). Grams that are not in `order` come first, by their code points."""
    return order.get(gram) or ((ord(gram[0]) << 21 | ord(gram[1])) - (1 << 62), 0)


def signatures(word: str, order: dict[str, tuple[int, int]]) -> tuple[int, list[str], list[str]]:
    """(last, pivot keys, prefix keys) of a word of four code points or more.

    `order` has the place and frequency of bigrams, rare ones first. The first three bigrams are the word's prefix, with
    all further places of the third. Two of the three are disjoint pivots p < q, and one edit leaves one of them alone:
    an edit in q or later leaves the word's start before q, an edit in p or earlier its end behind p, an edit between
    them the start up to p and the end from q. These are the pivot keys. If `last`, the third gram, is not smaller in the
    other word, the pivot that is left stands in that word's prefix, at the same place from that side; so the other word
    offers its starts behind a prefix gram, its ends in front of one, and the outer parts around two of them."""
    grams = sorted((*_rank(word[p : p + 2], order), p) for p in range(len(word) - 1))
    last = grams[2][0]
    p, q = pivots_of(sorted((at, f) for _, f, at in grams[:3]))
    places = sorted(at for rank, _, at in grams if rank <= last)
    keys = [f"<{word[:k]}" for k in range(places[0] + 2, len(word) + 1)] + [f">{word[k:]}" for k in range(places[-1] + 1)]
    keys += [f"|{word[: x + 2]}|{word[y:]}" for x in places for y in places if y - x >= 2]
    return last, [f"<{word[:q]}", f">{word[p + 2 :]}", f"|{word[: p + 2]}|{word[q:]}"], keys


def parity(word: str) -> int:
    """Bit k is the parity of the number of letters whose code point is k modulo 63: one edit changes two bits at most."""
    out = 0
    for letter in word:
        out ^= 1 << ord(letter) % 63
    return out


def _signed(order: dict[str, tuple[int, int]], of_pivots: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                part = batch.slice(low, 2048)
                lasts, keys, rows, sizes, bits = [], [], [], [], []
                for i, word in enumerate(part.column("word").to_pylist()):
                    last, pivots, prefix = signatures(word, order)
                    own = pivots if of_pivots else prefix
                    keys += own
                    rows += [i] * len(own)
                    lasts.append(last)
                    sizes.append(len(word))
                    bits.append(parity(word))
                take = pa.array(rows, pa.int32())
                columns = [pa.array(lasts, pa.int64()), pa.array(sizes, pa.int32()), pa.array(bits, pa.int64()), part.column("word"), part.column("n")]
                yield pa.record_batch([pa.array(keys, pa.string()), *[c.take(take) for c in columns]], ["key", "last", "size", "bits", "word", "n"])

    return run


def near_words(words: DataFrame, max_grams: int = 20_000) -> DataFrame:
    """(word, n, other, other_n): both directions of each pair of `words(word, n)` with exactly one inserted, deleted or
    replaced code point between them. Words are distinct and have four code points or more.

    Frequencies of the `max_grams` most frequent bigrams are sent to the tasks (words of A-Z and Latin-1 letters have at
    most 90 * 90); others count as rarest. Any order of grams finds all pairs; a good one makes the keys rare. Pairs that
    meet by a key are filtered by length and by letter parity, and verified by their edit distance, inside the join."""
    grams = words.select(F.explode(F.expr("transform(sequence(1, length(word) - 1), p -> substring(word, p, 2))")).alias("gram"))
    counted = grams.groupBy("gram").count().orderBy(F.desc("count"), "gram").limit(max_grams).collect()
    order = {gram: (place, n) for place, (n, gram) in enumerate(sorted((r["count"], r["gram"]) for r in counted))}
    fields = "key string, last long, size int, bits long, word string, n long"
    keyed = [words.mapInArrow(_signed(order, of_pivots), fields).withColumn("key", F.xxhash64("key")) for of_pivots in (True, False)]
    left = keyed[0].withColumnsRenamed({"last": "least", "size": "a_size", "bits": "a_bits", "word": "a", "n": "a_n"})
    right = keyed[1].withColumnsRenamed({"word": "b", "n": "b_n"})
    may = (F.col("last") >= F.col("least")) & (F.abs(F.col("size") - F.col("a_size")) <= 1) & (F.bit_count(F.col("bits").bitwiseXOR(F.col("a_bits"))) <= 2)
    met = left.join(right, "key").filter(may & (F.col("a") != F.col("b")) & (F.levenshtein("a", "b", 1) == 1))
    turn = F.col("a") < F.col("b")
    one, two = F.struct(F.col("a").alias("w"), F.col("a_n").alias("n")), F.struct(F.col("b").alias("w"), F.col("b_n").alias("n"))
    pairs = met.select(F.when(turn, one).otherwise(two).alias("x"), F.when(turn, two).otherwise(one).alias("y")).distinct()
    both = pairs.select(F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("p"))
    return both.select(F.col("p.x.w").alias("word"), F.col("p.x.n").alias("n"), F.col("p.y.w").alias("other"), F.col("p.y.n").alias("other_n"))


def group_spellings(words: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n): one row for each of `words(word, n)`, the words of narrations with their counts.

    Two words are near if one inserted, deleted or replaced code point is between them; `n_near` counts a word's near
    words. `form` is the near word of largest n (ties: the smallest in code-point order), if that is at least `ratio`
    times the word's n, else null; `form_n` is its n. `root` is the last word that forms lead to, the word itself without
    a form. As n grows at each step, chains of forms end after a few steps.

    A null word or n takes no part; rows that repeat a word add up; words of fewer than four code points have no near
    words. Other columns are not read; an empty table gives no rows.
    """
    counted = cut_lineage(words.select("word", F.col("n").cast("long").alias("n")).dropna().groupBy("word").agg(F.sum("n").alias("n")))
    near = near_words(counted.filter(F.length("word") >= 4)).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best"))
    known = counted.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("best.minus") >= ratio * F.col("n"), F.col("best")).alias("best"))
    known = cut_lineage(known.select("word", F.col("best.other").alias("form"), "n", "n_near", (-F.col("best.minus")).alias("form_n")))
    roots = resolve_aliases(known.filter("form is not null").select("word", "form"), "word", "form").withColumnRenamed("form", "root")
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
