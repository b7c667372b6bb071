"""Gallery distances against brute force, and the share of blocks that bounds skip."""

import numpy as np

from courtloom.operators import appearance as P

ROWS = "vec_id long, label long, v array<double>"


def crops(n, people, seed, spread=0.05, dims=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(people, dims))
    label = rng.integers(0, people, n)
    v = centres[label] + spread * rng.normal(size=(n, dims))
    v /= np.linalg.norm(v, axis=1)[:, None]
    return [(i, int(label[i]), v[i].tolist()) for i in range(n)]


def brute(queries, gallery):
    out = {}
    for q, own, v in queries:
        out[q] = [(float(np.floor((1 - np.dot(v, w)) * 1e9 + 0.5)), label) for g, label, w in gallery if g != q], own
    return out


def check(spark, queries, gallery, slice_rows):
    q, g = spark.createDataFrame(queries, ROWS), spark.createDataFrame(gallery, ROWS)
    near = {r.vec_id: r for r in P.gallery_distance(q, g, "vec_id", "label", "v", slice_rows=slice_rows).collect()}
    rival = {r.vec_id: r for r in P.self_vs_rival(q, g, "vec_id", "label", "v", slice_rows=slice_rows).collect()}
    for i, (pairs, own) in brute(queries, gallery).items():
        d, best = min(pairs)
        three = sorted(x for x, label in pairs if label == best)[:3]
        assert near[i].best == best and abs(near[i].dmin - d / 1e9) < 3e-9 and abs(near[i].d3 - sum(three) / len(three) / 1e9) < 3e-9
        mine, others = [x for x, label in pairs if label == own], [p for p in pairs if p[1] != own]
        assert (rival[i].self_d is None) == (not mine) and (not mine or abs(rival[i].self_d - min(mine) / 1e9) < 3e-9)
        assert rival[i].rival == min(others)[1] and abs(rival[i].rival_d - min(others)[0] / 1e9) < 3e-9


def test_distances_equal_brute_force(spark):
    rows = crops(500, 9, 1, 0.2)
    check(spark, [r for r in rows if r[0] % 4 == 0], [r for r in rows if r[0] % 4], 32)
    check(spark, rows[:80], rows[:300], 512)            # queries are gallery rows too: their own row does not count
    lone = [(900, 77, rows[0][2]), (901, 78, rows[1][2])]
    check(spark, [*rows[:5], (902, 77, rows[3][2]), (903, 55, rows[3][2])], [*rows[50:200], *lone], 16)


def test_most_blocks_are_skipped(spark):
    rows = crops(3000, 40, 2, 0.02)
    queries, gallery = spark.createDataFrame(rows[:200], ROWS), spark.createDataFrame(rows[200:], ROWS)
    met = {}
    for name in ("first", "double"):
        g = P.Gallery(gallery if name == "first" else gallery.union(gallery.selectExpr("vec_id + 10000", "label", "v")), "vec_id", "label", "v", 32)
        asked = g.bounded(P._queries(queries, "vec_id", "label", "v"))
        home = g.compare(g.home(asked), 1).groupBy("q").agg({"d": "min"}).withColumnRenamed("min(d)", "up")
        from pyspark.sql import functions as F

        met[name] = g.within(asked.join(home, "q"), F.col("up") / 1e9 + 1e-9).count() / (200 * int(g.blocks.sum()))
    assert met["first"] < 0.15 and met["double"] < 0.15


def test_empty_and_null_rows(spark):
    rows = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, None, [0.0, 1.0]), (3, 2, None), (None, 1, [0.0, 1.0])], ROWS)
    assert P.gallery_distance(rows, rows.limit(0), "vec_id", "label", "v").count() == 0
    assert P.self_vs_rival(rows.limit(0), rows, "vec_id", "label", "v").count() == 0
    got = P.gallery_distance(rows, rows.filter("label = 1"), "vec_id", "label", "v").collect()
    assert [(r.vec_id, r.best, r.dmin) for r in got] == [(2, 1, 1.0)]
