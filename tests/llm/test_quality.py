import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from epochal.llm.quality import ABSTAIN, DRAWN, fitted, quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    found = defaultdict(list)
    for i in range(len(words) - 4):
        found[tuple(words[i : i + 5])].append(i)
    covered = {k for at in found.values() if len(at) > 1 for i in at for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " \n\t ", "one two", "a b c d e a b c d e\n" * 4, "x\nx\n\n\nx", "é | <b>   y " * 30, "the cat of it is in. " * 200, "a a a a a a a", "w\n" * 3000]


def test_counts_match_brute_force(spark):
    df = spark.createDataFrame([(i, t, "mine", True) for i, t in enumerate(TEXTS + TEXTS[:3])], "doc_id long, text string, n_words string, kept boolean")
    rows = quality(df).collect()
    assert len(rows) == len(TEXTS) + 3
    for r in rows:
        assert tuple(r[c] for c in DRAWN) == brute(r.text)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert quality(df).count() == 0


def test_clean_texts_are_kept(spark):
    clean = [(i, " ".join(f"word{(i * 37 + k * 11) % 977} of the" for k in range(40)) + ".") for i in range(60)]
    junk = [(1000 + i, " ".join(f"QX{i}Z{k}$$$" for k in range(40))) for i in range(15)]
    got = quality(spark.createDataFrame(clean + junk, "doc_id long, text string"))
    assert got.where("kept and doc_id < 1000").count() >= 58
    assert got.where("kept and doc_id >= 1000").count() == 0


def test_em_finds_how_rules_vote():
    """Votes drawn with known accuracies: the fit comes near them, and never lowers the likelihood."""
    import math
    import random

    rng = random.Random(4)
    right = [0.95, 0.9, 0.8, 0.7]
    votes = []
    for _ in range(6000):
        bad = int(rng.random() < 0.3)
        votes.append(tuple(ABSTAIN if rng.random() < 0.2 else bad if rng.random() < p else 1 - bad for p in right))
    patterns = sorted({v: votes.count(v) for v in set(votes)}.items())

    def likelihood(m):
        p = m["prior"]
        return sum(n * math.log(p * math.prod(g[v] for (g, _), v in zip(m["rules"].values(), vs, strict=True)) + (1 - p) * math.prod(b[v] for (_, b), v in zip(m["rules"].values(), vs, strict=True))) for vs, n in patterns)

    model = fitted(patterns, list("abcd"), rounds=60)
    assert abs(model["prior"] - 0.7) < 0.04
    for p, (good, bad) in zip(right, model["rules"].values(), strict=True):
        assert abs(good[0] - 0.8 * p) < 0.05 and abs(bad[1] - 0.8 * p) < 0.06
    steps = [likelihood(fitted(patterns, list("abcd"), rounds=k, tolerance=0)) for k in (1, 3, 10, 40)]
    assert all(b > a - 1 for a, b in zip(steps, steps[1:], strict=False))  # but for the added counts
