"""Agreement and parity reports against plain counts."""

import math
import random
from collections import Counter, defaultdict

from courtloom.operators import scoring as R


def test_parity_equals_plain_counts(spark):
    rng = random.Random(5)
    consensus = [(g, f, c) for g in (0, 1) for f in range(60) for c in range(rng.randrange(1, 4))]
    world = [(g, f, c) for g in (0, 1) for f in range(60) for c in range(rng.randrange(2, 5))]
    pairs = [(g, f, rng.uniform(0, 400)) for g in (0, 1) for f in range(60) for _ in range(rng.randrange(3))]
    links = [(g, f, f"s{s}", rng.choice([s, s, s, s, s + 1, None]) if s < 4 else rng.choice([None, 7])) for g in (0, 1) for s in range(6) for f in range(rng.randrange(20, 60))]
    links += [(0, f, "pure", 9) for f in range(40)]
    table = lambda rows, schema: spark.createDataFrame(rows, schema)      # noqa: E731
    got = {r.game: r for r in R.parity(table(consensus, "game long, frame long, c long"), table(world, "game long, frame long, c long"), table(pairs, "game long, frame long, dist double"),
                                       table(links, "game long, frame long, foreign_id string, gid long"), ["game"], 30, 20).collect()}
    for g in (0, 1):
        own = [d for k, _, d in pairs if k == g]
        n_cons, n_ours = sum(r[0] == g for r in consensus), sum(r[0] == g for r in world)
        met = defaultdict(list)
        for k, _, sid, gid in links:
            if k == g:
                met[sid].append(gid)
        long = [Counter(x for x in ids if x is not None) for ids in met.values() if len(ids) >= 30 and sum(x is not None for x in ids) >= 20]
        total, most = sum(sum(c.values()) for c in long), sum(max(c.values()) for c in long)
        r = got[g]
        assert (r.n_cons, r.n_ours, r.hits) == (n_cons, n_ours, len(own)) and math.isclose(r.recall, len(own) / n_cons) and math.isclose(r.precision, len(own) / n_ours)
        assert math.isclose(r.rmse, math.sqrt(sum(math.floor(d * d + 0.5) for d in own) / len(own)))
        assert r.long_tracks == len(long) and r.pure == sum(max(c.values()) >= 0.9 * sum(c.values()) for c in long) and math.isclose(r.impurity, (total - most) / total)


def test_agreement_equals_plain_counts(spark):
    rng = random.Random(7)
    ours = [(g, f, d) for g in (0, 1) for f in range(50) for d in range(rng.randrange(4)) if f != 13]
    theirs = [(g, f, d) for g in (0, 1) for f in range(50) for d in range(rng.randrange(4)) if f != 17]
    count = lambda rows: Counter((g, f) for g, f, _ in rows)      # noqa: E731
    a, b = count(ours), count(theirs)
    pairs = [(g, f, d, d if rng.random() < 0.8 else d + 1) for g in (0, 1) for f in range(50) for d in range(rng.randrange(1 + min(a[g, f], b[g, f])))]
    table = lambda rows, schema: spark.createDataFrame(rows, schema)      # noqa: E731
    got = {r.game: r for r in R.tracker_agreement(table(ours, "game long, frame long, d long"), table(theirs, "game long, frame long, d long"),
                                                  table(pairs, "game long, frame long, our_id long, their_id long"), ["game"]).collect()}
    for g in (0, 1):
        frames = [k for k in a | b if k[0] == g]
        n_a, n_b, own = sum(a[k] for k in frames), sum(b[k] for k in frames), [p for p in pairs if p[0] == g]
        votes = defaultdict(Counter)
        for _, _, mine, other in own:
            votes[mine][other] += 1
        flips = sum(sum(c.values()) - max(c.values()) for c in votes.values())
        r = got[g]
        assert (r.agree, r.only_ours, r.only_theirs) == (len(own), n_a - len(own), n_b - len(own)) and math.isclose(r.count_mae, sum(abs(a[k] - b[k]) for k in frames) / len(frames))
        assert math.isclose(r.flip_rate, flips / len(own)) and math.isclose(r.recall_ours, len(own) / n_a) and math.isclose(r.recall_theirs, len(own) / n_b)
