import random
from math import comb

import numpy as np
from pyspark.sql import functions as F

from epochal.llm import common
from epochal.llm.neardup import joined_components, multipliers, near_duplicates, overlaps, signatures


def brute(docs):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    comp = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(comp[a], comp[b])
            if comp[a] != m or comp[b] != m:
                comp[a] = comp[b] = m
                changed = True
    return {i: (len(sets[i]), comp[i], comp[i] == i) for i in ids}


def test_matches_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    docs = [(0, None), (1, ""), (2, "a b"), (3, "A  b"), (4, "a b c")]
    passage = rng.choices(vocab, k=40)
    for g in range(6):
        base = rng.choices(vocab, k=rng.choice([20, 80, 200])) + (passage if g % 2 else [])
        for _ in range(9):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            docs.append((100 - len(docs), " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()}
    assert got == brute(docs)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_large_group_at_the_border_and_a_common_passage(spark):
    rng = random.Random(6)
    vocab = [f"v{i}" for i in range(5000)]
    base, passage = rng.choices(vocab, k=80), rng.choices(vocab, k=30)
    docs = []
    for _ in range(260):
        w = list(base)
        for _ in range(rng.randrange(7)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        docs.append(" ".join(w))
    for _ in range(120):
        docs.append(" ".join([*rng.choices(vocab, k=25), *passage, *rng.choices(vocab, k=rng.randrange(30))]))
    rng.shuffle(docs)
    docs = list(enumerate(docs))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)
    assert 5 < len({c for _, c, _ in got.values()}) < 300


def test_repeated_rows_null_ids_clashing_columns_and_a_long_text(spark):
    long = " ".join(f"w{i % 9973}" for i in range(300_000))
    docs = [(5, "a b c d e f g", 1), (5, "a b c d e f g", 1), (3, "A b c d e f  g", 2), (None, "a b c d e f g", 3), (7, long, 4), (9, long + " end", 5), (9, "other words here", 6), (8, None, 7)]
    df = spark.createDataFrame(docs, "doc_id long, text string, comp int").withColumns({"node": F.lit("x"), "key": F.lit(1), "salt": F.lit(2), "kept": F.lit("no"), "component_id": F.lit(0)})
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert [g for g in got if g[0] in (-1, 3, 5, 8)] == [(-1, 3, None, True), (3, 3, 3, True), (5, 3, 3, False), (5, 3, 3, False), (8, 0, 8, True)]
    assert [(g[0], *g[2:]) for g in got if g[0] in (7, 9)] == [(7, 7, True), (9, 7, False), (9, 7, False)]


def test_recall_of_links_at_the_border():
    """20,000 pairs of exactly 75 percent: all collide in the places asked for."""
    rng = np.random.default_rng(7)
    m = multipliers(96)
    least = 48
    for _ in range(40):
        sets = [rng.integers(0, 2**64, 8 * 10, dtype=np.uint64) for _ in range(500)]
        a, b = [s[:70] for s in sets], [s[10:] for s in sets]  # 60 of 80
        least = min(least, (signatures(a, m, 2) == signatures(b, m, 2)).sum(1).min())
    assert least >= 10
    missed = sum(comb(48, k) * 0.5625**k * 0.4375 ** (48 - k) for k in range(10))
    assert missed < 2e-7


def test_overlaps_of_frequent_and_rare_elements_match_brute_force():
    rng = np.random.default_rng(8)
    for n, m, common_part in ((1, 1, 0), (40, 60, 0), (40, 60, 2500), (300, 200, 30)):
        shared = rng.integers(-(2**62), 2**62, common_part)
        sets = [np.unique(np.concatenate([shared[rng.random(common_part) < 0.9], rng.integers(0, 3000, rng.integers(0, 60)), rng.integers(-(2**62), 2**62, 5)])) for _ in range(n + m)]
        a, b = sets[:n], sets[n:]
        assert overlaps(a, b).tolist() == [[len(np.intersect1d(x, y)) for y in b] for x in a]


def test_joined_components():
    a, b = joined_components(np.array([7, 3, 9, 20, 30]), np.array([3, 9, 1, 21, 20]))
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(3, 1), (7, 1), (9, 1), (21, 20), (30, 20)]
    assert [len(x) for x in joined_components(np.zeros(0, np.int64), np.zeros(0, np.int64))] == [0, 0]


def template_pages(n, rng):
    """Pages of one template, alike below the threshold, and a tenth as many that link with one of them."""
    base = [f"t{i}" for i in range(300)]
    pages = []
    for k in range(n):
        w = list(base)
        for at in rng.sample(range(300), 6):
            w[at] = f"u{k}-{at}"
        pages.append(w)
    for k in range(n // 10):
        w = list(pages[k * 7 % n])
        for at in rng.sample(range(300), 3):
            w[at] = f"x{k}-{at}"
        pages.append(w)
    rng.shuffle(pages)
    return [(i, " ".join(w)) for i, w in enumerate(pages)]


def test_pages_of_one_template_link_right_and_make_no_row_a_pair(spark, monkeypatch):
    kept, made = common.Workspace.write, {}

    def write(self, df, name):
        out = kept(self, df, name)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(common.Workspace, "write", write)
    rng = random.Random(9)
    for n, chunk in ((300, 500_000), (150, 20_000)):
        made.clear()
        docs = template_pages(n, rng)
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), chunk=chunk).collect()}
        assert got == brute(docs)
        assert made["chunks"] > 0 and made["candidates"] <= 4 * len(docs)
        assert chunk == 500_000 or made["cells"] > 50


def test_comparisons_hold_neither_earlier_shuffles_nor_sets_that_none_reads(spark, monkeypatch):
    kept, log = common.Workspace.write, []

    def write(self, df, name):
        out = kept(self, df, name)
        log.append((name, [p.rsplit("/", 1)[1].removeprefix("near-duplicates-").rsplit("-", 1)[0] for p, _ in self.tables]))
        return out

    monkeypatch.setattr(common.Workspace, "write", write)
    monkeypatch.setattr(common.Workspace, "forget_shuffles", lambda self: log.append(("forgotten", [])))
    docs = template_pages(60, random.Random(3))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)
    names = [name for name, _ in log]
    assert all(names[i - 2 : i] == ["candidates", "forgotten"] for i, name in enumerate(names) if name == "links")
    later = log[names.index("prefixes") + 1 :]
    assert any(name == "links" for name, _ in later)
    assert not any({"sets", "shared-postings"} & set(tables) for _, tables in later)
