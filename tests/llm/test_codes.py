import hashlib
import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from epochal.llm import codes
from epochal.llm.codes import nearest, op13_vector_codes, vector_codes
from epochal.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, label int"
SF = "/root/testdata/sf0.001"


def by_hand(rows, parts=16, entries=64, rounds=2):
    """Over all rows, with Python's integers."""
    kept = [(i, [math.floor(256 * v) for v in x], label) for i, x, label in rows if x and len(x) % parts == 0 and all(v is not None and math.isfinite(v) for v in x)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], "<i4").tobytes()))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    if not kept:
        return []
    width = len(kept[0][1]) // parts
    cut = [[tuple(x[p * width : (p + 1) * width]) for p in range(parts)] for _, x, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def closest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        chosen = [[closest(p, c[p])[1] for c in cut] for p in range(parts)]
        for p in range(parts):
            for k in set(chosen[p]):
                mine = [c[p] for c, at in zip(cut, chosen[p], strict=True) if at == k]
                books[p][k] = tuple(sum(v) // len(mine) for v in zip(*mine, strict=True))
    found = [[closest(p, c[p]) for p in range(parts)] for c in cut]
    errors = [sum(e for e, _ in f) for f in found]
    labels = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        labels[label] = labels.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(v) for book in books for e in book for v in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), e, labels[label], digest) for (i, _, label), f, e in zip(kept, found, errors, strict=True)), key=repr)


def answers(found):
    return sorted((tuple(r) for r in found.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def drawn(n, dims, seed=1, kinds=None):
    random = np.random.default_rng(seed)
    x = random.normal(0, 0.2, (n, dims)).astype(np.float32)
    if kinds:
        x = x[random.integers(0, kinds, n)]
    return [(i, v.tolist(), [1, 2, None][i % 3]) for i, v in enumerate(x)]


def test_whole_table(spark):
    rows = [tuple(r) for r in table(spark, SF, "embeddings").select("vec_id", "embedding", "label").collect()]
    assert answers(op13_vector_codes(spark, SF)) == by_hand(rows)


def test_hot_vectors_and_labels(spark, monkeypatch):
    """Half of the rows are one vector; shared parts are broadcast, the others joined by shuffle."""
    monkeypatch.setattr(codes, "SHARE", 20)
    rows = drawn(300, 32) + [(1000 + i, [0.25] * 32, 1) for i in range(300)] + [(2000 + r[0], *r[1:]) for r in drawn(100, 32, 2, 5)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert answers(vector_codes(spark.createDataFrame(rows, SCHEMA).repartition(5))) == by_hand(rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_unusable_vectors_ties_repeats_and_clashing_columns(spark):
    nan, inf = float("nan"), float("inf")
    rows = [*drawn(70, 16, 3, 40), (71, None, 1), (72, [], 1), (73, [nan] + [0.0] * 15, 1), (74, [None] + [0.0] * 15, 1), (75, [inf] * 16, 2), (76, [0.5] * 15, 1), (77, [0.5] * 32, 1), (None, [0.1] * 16, None), (None, [0.1] * 16, None), (5, [-0.001] * 16, 4), (5, [-0.5] * 16, 4), (5, [-0.5] * 16, 4)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", key string, n int")
    assert answers(vector_codes(df)) == by_hand(rows)


def test_fewer_rows_than_entries_and_other_shapes(spark):
    rows = drawn(7, 12)
    assert answers(vector_codes(spark.createDataFrame(rows, SCHEMA), parts=4, rounds=3)) == by_hand(rows, 4, 64, 3)
    assert answers(vector_codes(spark.createDataFrame(rows, SCHEMA), parts=2, entries=2)) == by_hand(rows, 2, 2)


def test_empty_tables(spark):
    for rows in ([], [(1, None, 1)]):
        found = vector_codes(spark.createDataFrame(rows, SCHEMA))
        assert found.count() == 0 and found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_huge_components_are_the_largest_that_fit(spark):
    rows = [(i, [v] * 16, 1) for i, v in enumerate([3e38, -3e38, 1.0, 0.0])]
    found = answers(vector_codes(spark.createDataFrame(rows, SCHEMA), entries=1, rounds=0))
    assert found[0][2] == 0 and found[1][2] == 16 * (2 * math.isqrt(2**60 // 16)) ** 2
    assert found[0][3] <= 2**63 - 1
    assert len(answers(vector_codes(spark.createDataFrame(rows, SCHEMA)))) == 4


@settings(deadline=None, max_examples=100)
@given(st.lists(st.lists(st.integers(-4, 4), min_size=3, max_size=3), min_size=1, max_size=30), st.lists(st.lists(st.integers(-4, 4), min_size=3, max_size=3), min_size=1, max_size=9), st.sampled_from([1, 10**8]))
def test_nearest_is_the_first_of_the_nearest(x, book, by):
    x, book = np.array(x) * by, np.array(book) * by
    best, errors = nearest(np.zeros(len(x), np.int64), x, book[None])
    for row, k, e in zip(x, best, errors, strict=True):
        assert min((sum((int(a) - int(b)) ** 2 for a, b in zip(row, c, strict=True)), j) for j, c in enumerate(book)) == (e, k)
