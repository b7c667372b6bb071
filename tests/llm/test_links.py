"""Near copies, decontamination and passages against brute force."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from courtloom.llm import common, decontamination, jaccard_join, passages


def shingles(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def texts_with_copies(n, seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(500)]
    out = []
    for _ in range(n):
        base = [rng.choice(words) for _ in range(rng.choice([1, 3, 30, 60, 200]))]
        out.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 3])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append("  ".join(copy))
    return out + ["", None, " \n", out[0]]


def brute_links(rows):
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in links:
        i, j = sorted((find(i), find(j)), key=lambda k: rows[k][0])
        parent[j] = i
    degree = Counter(x for pair in links for x in pair)
    return [(rows[k][0], rows[find(k)][0], degree[k]) for k in range(len(rows))]


def test_links_equal_brute_force(spark):
    rows = list(enumerate(texts_with_copies(60, 1), 100))
    random.Random(0).shuffle(rows)
    narrations = spark.createDataFrame([(*r, "x", 1) for r in rows], "job_id long, summary string, class_id string, root int")
    for block in (192, 3):      # small blocks deal the same components out by pairs of blocks
        got = jaccard_join.link_narrations(narrations, block=block).collect()
        assert sorted((r.job_id, r.class_id, r.n_links) for r in got) == sorted(brute_links(rows))


def test_different_texts_under_one_id_are_linked_each_for_itself(spark):
    words = [f"w{k}" for k in range(80)]
    a, b = " ".join(words[:40]), " ".join(words[40:])
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, "alone here with some other words"), (4, "and again alone under the same id"), (5, None), (5, "")]
    for order in (rows, rows[::-1]):
        narrations = spark.createDataFrame([(*r, 7, 8) for r in order], "job_id long, summary string, text_key int, __text int").repartition(3)
        links = jaccard_join.link_narrations(narrations)
        got = sorted((r.job_id, r.class_id, r.n_links) for r in links.collect())
        assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 4, 0), (4, 4, 0), (5, 5, 0), (5, 5, 0)]
        kept = jaccard_join.one_per_class(narrations, links)
        assert kept.columns == narrations.columns
        assert sorted((r.job_id, r.summary or "") for r in kept.collect()) == sorted([(1, a), (1, b), (4, rows[4][1]), (4, rows[5][1]), (5, ""), (5, "")])


def test_large_group_of_near_copies(spark):
    rng = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(300):
        copy = list(base)
        copy[rng.randrange(120)] = f"x{i % 200}"
        rows.append((i, " ".join(copy)))
    got = jaccard_join.link_narrations(spark.createDataFrame(rows, "job_id long, summary string"), block=40)
    assert sorted((r.job_id, r.class_id, r.n_links) for r in got.collect()) == sorted(brute_links(rows))


def test_odd_rows_of_links(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (7, "a b c d e f"), (8, None)]
    narrations = spark.createDataFrame(rows, "job_id long, summary string")
    got = sorted((str(r.job_id), r.class_id, r.n_links) for r in jaccard_join.link_narrations(narrations).collect())
    assert got == [("5", 5, 2), ("5", 5, 2), ("7", 5, 2), ("8", 8, 0), ("None", None, 0)]
    kept = jaccard_join.one_per_class(narrations, jaccard_join.link_narrations(narrations)).collect()
    assert sorted(str(r.job_id) for r in kept) == ["5", "8", "None"]
    assert jaccard_join.link_narrations(narrations.limit(0)).count() == 0


def test_pruning_keeps_similar_pairs():
    steps = jaccard_join.least_matches(140, 20, 0.8, 1e-4)
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 32, (400, 140), dtype=np.uint32)
    b = np.where(rng.random(a.shape) < 0.8, a, a + np.uint32(1))
    c = np.where(rng.random(a.shape) < 0.4, a, a + np.uint32(1))
    signs = np.concatenate((a, b, c))
    left = np.arange(400)
    assert len(jaccard_join.surviving_pairs(signs, left, left + 400, steps)[0]) >= 398
    assert len(jaccard_join.surviving_pairs(signs, left, left + 800, steps)[0]) == 0


def greedy_tiles(doc, ref, least):
    """Plain greedy string tiling."""
    used_d, used_r, out = [False] * len(doc), [False] * len(ref), []
    while True:
        best = None
        for r in range(len(ref)):
            for d in range(len(doc)):
                n = 0
                while r + n < len(ref) and d + n < len(doc) and ref[r + n] == doc[d + n] and not used_r[r + n] and not used_d[d + n]:
                    n += 1
                if n >= least and (best is None or n > best[0]):
                    best = n, r, d
        if best is None:
            return out
        n, r, d = best
        out.append(n)
        used_r[r : r + n] = [True] * n
        used_d[d : d + n] = [True] * n


def test_tiles_equal_plain_tiling():
    rng = random.Random(2)
    for _ in range(200):
        doc, ref = ([rng.choice("abc") for _ in range(rng.randint(5, 40))] for _ in range(2))
        at = [(d, r) for d in range(len(doc) - 2) for r in range(len(ref) - 2) if doc[d : d + 3] == ref[r : r + 3]]
        if at:
            d, r = (np.array(x) for x in zip(*at, strict=True))
            assert sorted(t[2] for t in decontamination.tiles(d, r, 3)) == sorted(greedy_tiles(doc, ref, 3))


def test_reordered_passages_are_caught(spark):
    ref = [f"r{k}" for k in range(40)]
    near = " ".join(ref[20:]) + ". Then, " + " ".join(ref[:20]).upper()
    narrations = spark.createDataFrame([(1, "x y " * 30 + near + " z"), (2, " ".join(ref[:15])), (3, None), (4, ""), (1, near), (5, "q " * 50)], "job_id long, summary string")
    references = spark.createDataFrame([(9, " ".join(ref)), (9, " ".join(ref)), (10, None), (11, "too short"), (12, " ".join(ref[:30]))], "window_id long, summary string")
    for chars in (16_000_000, 60):      # one block, several blocks
        got = decontamination.contaminated(narrations, references, block_chars=chars).collect()
        assert sorted((r.job_id, r.window_id, r.tiles) for r in got) == [(1, 9, 2), (1, 9, 2), (1, 12, 2), (1, 12, 2)]
        left = decontamination.without_contaminated(narrations, references, block_chars=chars)
        assert sorted(r.job_id for r in left.collect()) == [2, 3, 4, 5] and left.columns == narrations.columns
    assert decontamination.contaminated(narrations, references.limit(0)).count() == 0
    named = references.withColumn("window_id", F.concat(F.lit("w"), "window_id"))
    assert sorted(r.window_id for r in decontamination.contaminated(narrations, named).collect()) == sorted(f"w{r.window_id}" for r in got)
    assert decontamination.contaminated(narrations.limit(0), references).count() == 0


def test_chains_are_best():
    """The best chain has the value of the quadratic recursion."""
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 25))
        at = np.unique(rng.integers(0, 60, (n, 2)), axis=0)
        a, b, worth, gap = at[:, 0], at[:, 1], 16.0, 0.2
        best = [worth] * len(a)
        for i in range(len(a)):
            for j in range(i):
                if a[j] < a[i] and b[j] < b[i]:
                    best[i] = max(best[i], best[j] + worth - gap * float(a[i] - a[j] + b[i] - b[j])) if worth > gap * float(a[i] - a[j] + b[i] - b[j]) else best[i]
        found = passages.chain(a, b, worth, gap)
        assert sorted(int(x) for c in found for x in c) == list(range(len(a)))
        for c in found:
            assert (np.diff(a[c]) > 0).all() and (np.diff(b[c]) > 0).all()
        value = max(worth * len(c) - gap * float(a[c[-1]] - a[c[0]] + b[c[-1]] - b[c[0]]) for c in found)
        assert value >= 0.75 * max(best)


def test_fuzzy_passages_are_found(spark):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(3000)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    passage = prose(90)
    rows, where = [], {}
    for i in range(40):
        lead = prose(rng.randint(0, 300))
        own = list(passage)
        if i % 3 == 1:
            own[30] = "changed"
        if i % 3 == 2:
            del own[50]
        text = lead + (own if i < 25 else []) + prose(200)
        if i < 25:
            where[i] = (len(lead), len(lead) + len(own))
        rows.append((i, " ".join(text), "t"))
    rows += [(90, None, "t"), (91, "", "t"), (92, "short text", "t"), (0, rows[0][1], "t"), (None, rows[0][1], "t")]
    narrations = spark.createDataFrame(rows, "job_id long, summary string, start string")
    got = passages.repeated_passages(narrations).collect()
    assert {r.job_id for r in got} | {r.other_id for r in got} == set(where)
    for r in got:
        for i, low, high in ((r.job_id, r.start, r.end), (r.other_id, r.other_start, r.other_end)):
            assert abs(low - where[i][0]) <= 2 and abs(high - where[i][1]) <= 2
    assert passages.repeated_passages(narrations.limit(0)).count() == 0


def test_texts_that_repeat_themselves_are_found(spark):
    rows = [(1, "Shti " * 400), (2, "a b c " + "Shti " * 300), (3, " ".join(f"w{i}" for i in range(300)))]
    got = passages.repeated_passages(spark.createDataFrame(rows, "job_id long, summary string")).collect()
    assert {(r.job_id, r.other_id) for r in got} == {(2, 1)} and all(r.n_words >= 50 for r in got)


def test_seeds_cover_shared_runs():
    rng = np.random.default_rng(3)
    for _ in range(50):
        run = rng.integers(0, 1 << 63, 27, dtype=np.uint64)
        a, b = (np.concatenate((rng.integers(0, 1 << 63, rng.integers(0, 50), dtype=np.uint64), run, rng.integers(0, 1 << 63, 9, dtype=np.uint64))) for _ in range(2))
        assert set(passages.seeds_of(a, 8, 20)[0].tolist()) & set(passages.seeds_of(b, 8, 20)[0].tolist())
    assert len(common.windows_of(np.zeros(0, np.uint64), 5)) == 0


def rows_of(texts):
    return [(i, " ".join(t)) for i, t in texts.items()]


def test_passages_made_of_frequent_sentences(spark):
    rng = random.Random(11)
    prose = lambda n: [f"w{rng.randrange(100_000)}" for _ in range(n)]
    a, b, texts, pairs = prose(40), prose(40), {}, []
    texts |= {3: prose(60) + a + prose(60), 7: prose(60) + b + prose(60)}
    for n in range(20):
        x, y = prose(40 + n % 10), prose(40 + n % 10)
        texts |= {100 + n: prose(30) + x + prose(30), 200 + n: prose(30) + y + prose(30)}
        texts |= {500 + n: prose(50) + x + y + prose(50), 900 + n: prose(20) + x + y + prose(20)}
        pairs.append((900 + n, 500 + n))
    texts |= {590: prose(80) + a + b + prose(20), 990: prose(10) + a + b + prose(70)}
    got = passages.repeated_passages(spark.createDataFrame(rows_of(texts), "job_id long, summary string")).collect()
    assert {(r.job_id, r.other_id) for r in got} == {*pairs, (990, 590)}
    for r in got:
        assert abs(r.n_words - 80 - 2 * (r.job_id % 10 if r.job_id < 990 else 0)) <= 4 and r.identity >= 0.9


def test_exact_runs_equal_brute_force(spark):
    """Of the holders of any run of 50 words, each but the first has a row that covers it, against a narration with it."""
    rng = random.Random(12)
    for size in (9, 12, 18, 25, 45):
        lines = [[f"w{rng.randrange(100_000)}" for _ in range(rng.randint(size - 5, size))] for _ in range(18)]
        texts = {i: sum((rng.choice(lines) if rng.random() < 0.85 else [f"x{rng.randrange(100_000)}" for _ in range(9)] for _ in range(200 // size)), []) for i in range(60)}
        texts |= {i: sum(lines[i % 4 :], [])[i % 3 : 70] for i in range(60, 75)}
        holders = {}
        for i, t in texts.items():
            for p in range(len(t) - 49):
                holders.setdefault(tuple(t[p : p + 50]), {}).setdefault(i, []).append(p)
        rows = passages.repeated_passages(spark.createDataFrame(rows_of(texts), "job_id long, summary string")).collect()
        of = {}
        for r in rows:
            of.setdefault(r.job_id, []).append(r)
        checked = 0
        for run, held in holders.items():
            for i in sorted(held)[1:]:
                checked += 1
                assert any(r.start <= p and p + 50 <= r.end and r.other_id in held for p in held[i] for r in of.get(i, ())), (size, i, held)
        assert checked > 50


def test_edited_passages_are_found(spark):
    rng = random.Random(13)
    prose = lambda n: [f"w{rng.randrange(1_000_000)}" for _ in range(n)]
    texts, pairs = {}, set()
    for n, (length, rate) in enumerate([(50, 0.0), (51, 0.0), (60, 0.05), (60, 0.1), (60, 0.15), (100, 0.1), (100, 0.15), (100, 0.2)] * 25):
        passage = prose(length)
        changed = set(rng.sample(range(1, length - 1), int(rate * length)))
        texts[n] = prose(rng.randrange(60)) + passage + prose(rng.randrange(60))
        texts[10_000 + n] = prose(rng.randrange(60)) + [*(f"y{rng.randrange(1_000_000)}" if k in changed else w for k, w in enumerate(passage))] + prose(rng.randrange(60))
        pairs.add((10_000 + n, n))
    got = {(r.job_id, r.other_id): r for r in passages.repeated_passages(spark.createDataFrame(rows_of(texts), "job_id long, summary string")).collect()}
    assert set(got) <= pairs and len(got) >= 198 and all(r.identity >= 0.8 and r.n_words >= 50 for r in got.values())


def test_passages_within_weaker_chains_are_found(spark):
    rng = random.Random(14)
    prose = lambda n: [f"w{rng.randrange(1_000_000)}" for _ in range(n)]
    texts = {}
    for n in range(40):
        passage, lines = prose(60), [prose(20) for _ in range(3)]
        for i in (n, 1000 + n):
            texts[i] = prose(20 + n) + passage + sum(([*prose(18), *line] for line in lines), []) + prose(30)
    got = passages.repeated_passages(spark.createDataFrame(rows_of(texts), "job_id long, summary string")).collect()
    assert {(r.job_id, r.other_id) for r in got} == {(1000 + n, n) for n in range(40)}
    assert all(r.start <= 20 + r.other_id and 80 + r.other_id <= r.end and r.identity >= 0.8 for r in got)


def test_stretches_reach_the_least_length():
    rng = np.random.default_rng(5)
    for _ in range(60):
        a, b = rng.integers(0, 1 << 31, 900, dtype=np.uint32), rng.integers(0, 1 << 31, 900, dtype=np.uint32)
        places = [(int(rng.integers(0, 150)) + 300 * k, int(rng.integers(50, 140))) for k in range(3)]
        for at, n in places:
            b[at : at + n] = np.where((np.arange(n) % 6 == 3) & (n > 55), b[at : at + n], a[at : at + n])
        found = passages.stretches(a, b, 0, 0, 50, 0.8, piece=300)
        for at, n in places:
            assert any(low <= at + 3 and at + n - 3 <= high and share >= 0.8 for low, high, _, _, share in found)
