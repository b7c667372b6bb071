"""Hard negatives, SimHash classes and spelling variants against brute force."""

import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from courtloom.llm import hard_negatives, simhash, spelling
from courtloom.llm.queries import QUERIES, STATEMENTS

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
REID = "track_id long, player string, emb array<long>, score int, block long, key long, vec string"


# ---------------------------------------------------------------- hard negatives
def plain_negatives(rows, is_anchor, k=5, low=80, high=100):
    rows = [r for r in rows if None not in r and None not in r[2]]
    rows = sorted(set((i, p, tuple(v)) for i, p, v in rows))
    width = max((len(v) for _, _, v in rows), default=0)
    full = [(i, p, np.array([*v, *[0] * (width - len(v))], object)) for i, p, v in rows]
    out = []
    for i, p, v in full:
        if not is_anchor(i):
            continue
        scored = sorted((-int(v @ w), j, q) for j, q, w in full if j != i)
        for minus, j, _ in [s for s in scored if s[2] == p][:k]:
            fit = [s for s in scored if s[2] != p and low * -minus <= 100 * -s[0] <= high * -minus][:k]
            out += [(i, j, rank + 1, n, -minus, -m) for rank, (m, n, _) in enumerate(fit)]
    return sorted(out)


def reid_of(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], REID)


def clustered(n, seed, width=8, spread=20):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-200, 200, (12, width))
    vectors = centres[rng.integers(0, 12, n)] + rng.integers(-spread, spread, (n, width))
    return [(i, f"p{rng.integers(0, 4)}", vectors[i].tolist()) for i in range(n)]


def test_negatives_equal_brute_force(spark):
    rows = clustered(600, 3)
    for blocks, leaf, fan in ((4096, 128, 16), (50, 8, 3)):
        got = hard_negatives.mine_hard_negatives(reid_of(spark, rows), F.col("track_id") % 20 == 0, pivots=5, block_rows=blocks, leaf_rows=leaf, fan_out=fan)
        assert sorted(tuple(r) for r in got.collect()) == plain_negatives(rows, lambda i: i % 20 == 0)


def test_negatives_of_a_frequent_vector(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("ab"), [10, 20, 30] if i % 3 else [rng.randrange(-9, 40) for _ in range(3)]) for i in range(400)]
    got = hard_negatives.mine_hard_negatives(reid_of(spark, rows), F.col("track_id") % 10 == 0, block_rows=40, leaf_rows=8)
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives(rows, lambda i: i % 10 == 0)


def test_odd_rows_of_negatives(spark):
    rows = [(1, "a", [5, 5]), (1, "a", [5, 5]), (2, "a", [4]), (3, "b", [5, 4, 0]), (4, "b", [5, 5]), (4, "b", [5, 5]), (5, None, [1, 1]), (None, "a", [5, 5]),
            (6, "a", None), (7, "b", [None, 5]), (8, "b", []), (9, "c", [-5, -5]), (10, "c", [5, 5]), (3, "a", [3, 3]), (3, "a", [4, 4])]
    every = reid_of(spark, rows)
    got = sorted(tuple(r) for r in hard_negatives.mine_hard_negatives(every, F.lit(True)).collect())
    assert got == plain_negatives(rows, lambda i: True)
    assert hard_negatives.mine_hard_negatives(every.limit(0), F.lit(True)).count() == 0
    assert hard_negatives.mine_hard_negatives(every, F.lit(None).cast("boolean")).count() == 0
    with pytest.raises(ArithmeticError):
        hard_negatives.mine_hard_negatives(reid_of(spark, [(1, "a", [1 << 40])]), F.lit(True))


def test_tree_radii_cover_and_bounds_skip():
    rng = np.random.default_rng(1)
    centres = rng.integers(-2000, 2000, (40, 16))
    points = centres[rng.integers(0, 40, 4000)] + rng.integers(-30, 30, (4000, 16))
    norms = (points.astype(float) ** 2).sum(axis=1)
    space = hard_negatives.Space(16, norms.max(), float(np.abs(points).max()))
    tree = hard_negatives.CoverTree(space, points, 64, 16)

    def below(node):
        return np.concatenate([tree.rows[node], *[below(c) for c in tree.children[node]]])

    assert sorted(below(0)) == list(range(4000))
    for node, (centre, radius) in enumerate(zip(tree.centres, tree.radii, strict=True)):
        rows = points[below(node)]
        assert (space.gaps(rows, centre[None])[:, 0] <= radius + space.slack).all()
        most, least = space.bounds(points[:5], centre[None], np.array([radius]))
        products = points[:5] @ rows.T
        assert (products <= most).all() and (products >= least).all()
    met = []
    points_met = hard_negatives.CoverTree.__new__(hard_negatives.CoverTree)
    points_met.__dict__ = tree.__dict__ | {"rows": Counted(tree.rows, met)}
    ids, codes = np.arange(4000), rng.integers(0, 3, 4000)
    q, low, high = points[:40], np.full((40, 1), -np.inf), np.full((40, 1), np.inf)
    a, _, score, partner = hard_negatives.best_rows(space, points_met, points, ids, codes, q, ids[:40], codes[:40], low, high, True, 5)
    for k in range(40):
        own = points[k] @ points.T
        want = sorted((-own[j], j) for j in range(4000) if j != k and codes[j] == codes[k])[:5]
        assert [(-s, j) for s, j in zip(score[a == k], partner[a == k], strict=True)] == want
    assert len(met) < 0.3 * 40 * sum(len(r) > 0 for r in tree.rows)      # most leaves are skipped for most queries


class Counted(list):
    """Leaf rows that note each time a leaf is read."""

    def __init__(self, rows, met):
        super().__init__(rows)
        self.met = met

    def __getitem__(self, at):
        self.met.append(at)
        return super().__getitem__(at)


@needs_data
def test_negatives_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    got = QUERIES["op11_hard_negatives"](spark, SF)
    want = con.execute(STATEMENTS["op11_hard_negatives"])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(tuple(r) for r in got.select(*names).collect()) == sorted(want.fetchall())


# ---------------------------------------------------------------- SimHash
def plain_print(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    runs = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(prints, bits=4):
    """Least id reached by each row of (id, fingerprint)."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= bits:
                parent[find(i)] = find(j)
    low = {}
    for k, (i, _) in enumerate(prints):
        if i is not None:
            low[find(k)] = min(i, low.get(find(k), i))
    return [low.get(find(k)) for k in range(len(prints))]


def near_texts(seed, n=60):
    rng = random.Random(seed)
    words = [f"W{k}é" for k in range(300)]
    out = []
    for _ in range(n):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 4, 40, 900]))]
        out.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 3])):
            copy = list(base)
            copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" \t".join(copy).upper())
    return out + ["", None, " \n\x0b", "x y", out[0]]


def test_classes_equal_brute_force(spark):
    rows = list(enumerate(near_texts(2), 50))
    random.Random(1).shuffle(rows)
    rows += [(None, rows[3][1]), (None, "alone with no id"), (rows[5][0], rows[7][1]), rows[9]]
    narrations = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "job_id long, summary string, fingerprint int, class_id int, cell int")
    prints = [(i, plain_print(t)) for i, t in rows]
    want = sorted((str(i), p, str(c)) for (i, p), c in zip(prints, plain_classes(prints), strict=True))
    for block in (2048, 2):
        got = simhash.near_copy_classes(narrations, block=block)
        assert sorted((str(r.job_id), r.fingerprint % (1 << 64), str(r.class_id)) for r in got.collect()) == want
    assert simhash.near_copy_classes(narrations.limit(0)).count() == 0
    with pytest.raises(ValueError):
        simhash.near_copy_classes(narrations, max_bits=5)


def test_cells_meet_and_forest_links_every_near_pair():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 300, dtype=np.uint64)
    other = base.copy()
    for k in range(300):
        for bit in rng.choice(64, k % 5, replace=False):
            other[k] ^= np.uint64(1) << np.uint64(bit)
    both = np.concatenate((base, other))
    cells, rows = simhash.grid_cells(both, ((36, 2), (28, 1)))
    seen = {}
    for c, r in zip(cells.tolist(), rows.tolist(), strict=True):
        seen.setdefault(c, set()).add(r)
    meets = {(a, b) for group in seen.values() for a in group for b in group}
    assert all((k, k + 300) in meets for k in range(300))
    group = np.zeros(600, np.int64)
    a, b = simhash.linked(group, both, 4)
    roots = dict(zip(a.tolist(), b.tolist(), strict=True))
    assert all(roots.get(x, x) == roots.get(y, y) for x, y in zip(base.tolist(), other.tolist(), strict=True))


def test_very_long_summary(spark):
    text = " ".join(f"t{k % 5000}" for k in range(80_000))
    got = simhash.near_copy_classes(spark.createDataFrame([(1, text), (2, text + " end")], "job_id long, summary string")).collect()
    assert {r.class_id for r in got} == {1}
    assert {r.job_id: r.fingerprint % (1 << 64) for r in got}[1] == plain_print(text)


# ---------------------------------------------------------------- spelling
def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k + 1 :] == b[k:] if len(a) > len(b) else a[k:] == b[k + 1 :]


def plain_groups(counts, ratio=10):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda v: (-counts[v], v))
            if counts[best] >= ratio * counts[w]:
                form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n, len(near[w]), counts[form[w]] if w in form else None) for w, n in counts.items())


def plain_near(words):
    """Near pairs by the words that one deletion leaves."""
    gone = {}
    for w in words:
        for k in range(len(w)):
            gone.setdefault(w[:k] + w[k + 1 :], set()).add(w)
    return {(a, b) for s, group in gone.items() for a in group | ({s} & set(words)) for b in group | ({s} & set(words)) if one_edit(a, b)}


def test_groups_equal_brute_force(spark):
    rng = random.Random(4)
    counts = Counter()
    for _ in range(120):
        word = "".join(rng.choice("abcéß") for _ in range(rng.randrange(7, 11)))
        counts[word] += rng.choice([1, 2, 40, 900])
        for _ in range(rng.randrange(5)):
            k, c = rng.randrange(len(word) + 1), rng.choice(["", "a", "é"])
            counts[word[:k] + c + word[k + rng.randrange(2) :]] += rng.choice([1, 3])
    counts |= {"aaaaaaa": 500, "aaaaaaaa": 40, "aaaaaab": 3, "aaaaaaaaa": 3, "bananana": 7, "ananana": 70, "abcabca": 7, "abcabcc": 7, "abcabcb": 70}
    counts = {w: n for w, n in counts.items() if len(w) >= 4}
    for grams in (20_000, 3):
        words = spark.createDataFrame([(w, n, "x", "y", 1) for w, n in counts.items()], "word string, n long, form string, root string, a_n int")
        near = spelling.near_words(words, max_grams=grams).select("word", "other").collect()
        assert sorted(tuple(r) for r in near) == sorted((a, b) for a in counts for b in counts if one_edit(a, b))
        assert sorted(tuple(r) for r in spelling.group_spellings(words).collect()) == plain_groups(counts)


def test_odd_words(spark):
    rows = [("pivotal", 2), ("pivotal", 3), (None, 4), ("pivital", None), ("abc", 9), ("abd", 90), ("", 4), ("pivotel", 50)]
    got = {r.word: tuple(r)[1:] for r in spelling.group_spellings(spark.createDataFrame(rows, "word string, n int")).collect()}
    assert got == {"pivotal": ("pivotel", "pivotel", 5, 1, 50), "pivotel": (None, "pivotel", 50, 1, None), "abc": (None, "abc", 9, 0, None),
                   "abd": (None, "abd", 90, 0, None), "": (None, "", 4, 0, None)}
    assert spelling.group_spellings(spark.createDataFrame(rows[:0], "word string, n int")).count() == 0


def test_runs_of_letters(spark):
    rows = [(1, "ZÜRICHS Großväter-überall x1abcdefgĀhijklmno"), (None, "Abcdefgh"), (2, None), (3, "kurz"), (4, "a" * 70_000)]
    narrations = spark.createDataFrame([(*r, "w") for r in rows], "job_id long, summary string, word string")
    got = Counter((r.job_id, r.word) for r in spelling.word_runs(narrations).collect())
    want = [(1, "zÜrichs"), (1, "großväter"), (1, "überall"), (1, "abcdefg"), (1, "hijklmno"), (None, "abcdefgh"), (4, "a" * 70_000)]
    assert got == Counter(want)


def test_pivots_are_the_cheapest_disjoint_pair():
    rng = random.Random(3)
    for _ in range(300):
        prefix = sorted((p, rng.randrange(9)) for p in rng.sample(range(12), rng.randrange(3, 7)))
        a, b = spelling.pivots_of(prefix)
        cost = dict(prefix)
        assert b - a >= 2 and cost[a] + cost[b] == min(cost[p] + cost[q] for p in cost for q in cost if q - p >= 2)


@needs_data
def test_spelling_query_equals_plain_count(spark):
    counts = Counter()
    for doc in spark.read.parquet(f"{SF}/documents.parquet").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", doc.text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc.doc_id}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += len(word) >= 7
    counts = {w: n for w, n in counts.items() if n >= 2}
    near = Counter(a for a, _ in plain_near(list(counts)))
    got = QUERIES["op13_spelling_variants"](spark, SF).collect()
    assert {r.word: (r.n, r.n_near) for r in got} == {w: (n, near[w]) for w, n in counts.items()}
    for r in got:
        assert (r.form is None) == (r.form_n is None) and (r.form is None or (one_edit(r.word, r.form) and r.form_n == counts[r.form] >= 10 * r.n))
