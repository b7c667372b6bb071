"""Word hashes, statistics and components against plain loops."""

import random
import re
from collections import Counter

import numpy as np

from courtloom.llm import common

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_equal_words_have_equal_hashes_wherever_they_stand(monkeypatch):
    monkeypatch.setattr(common, "PIECE", 64)
    random.seed(3)
    texts = [None, "", "  ", "a", "b a", "é\x85ü x\xa0y"] + [" ".join(random.choice(["tip", "in", "paß", "x" * 90, "Ω", "a"]) for _ in range(random.randint(1, 60))) for _ in range(40)]
    seen, rows = {}, 0
    for first, words, offs in common.hashed_groups(texts):
        for k in range(len(offs) - 1):
            expect = WORD.findall(texts[first + k] or "")
            got = words[offs[k] : offs[k + 1]].tolist()
            assert len(got) == len(expect)
            for w, h in zip(expect, got, strict=True):
                assert seen.setdefault(w, h) == h
            rows += 1
    assert rows == len(texts) and len(set(seen.values())) == len(seen)


def plain_stats(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(zip(words, words[1:], words[2:]))
    hit = set()
    for i, g in enumerate(zip(words, words[1:], words[2:])):
        if grams[g] > 1:
            hit.update((i, i + 1, i + 2))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_statistics_equal_plain_loops():
    random.seed(5)
    texts = [None, "", "\n\n", "a a a a", "x y z x y z", "é|é & <b>\n\té|é & <b>"]
    texts += [random.choice([" ", "\n", " \n "]).join(random.choice(["pass", "to", "rim", "é#", "a\x85b", "*"]) for _ in range(random.randint(1, 80))) for _ in range(200)]
    got = common.text_stats(texts)
    for t, row in zip(texts, got.itertuples(), strict=True):
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == plain_stats(t), t


def test_long_text_is_seen_whole():
    text = "pass rim " * 200_000 + "end"
    row = common.text_stats([text]).iloc[0]
    assert row.n_words == 400_001 and row.n_repeat_words == 400_000
    assert sum(len(w) for _, w, _ in common.hashed_groups([text])) == 400_001


def test_components(spark):
    random.seed(1)
    edges = [(i, i + 1) for i in range(30)] + [(100, 50), (50, 70), (7, 7)] + [(random.randint(200, 260), random.randint(200, 260)) for _ in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_repeated_words_of_random_ids():
    rng = np.random.default_rng(0)
    for _ in range(300):
        ids = rng.integers(0, 4, rng.integers(0, 30))
        words = [str(x) for x in ids]
        assert common.repeated_words(ids) == plain_stats(" ".join(words))[4]
