import math
import random
from collections import Counter

import numpy as np
import pytest

from epochal.llm.common import hashed_words, split_words
from epochal.llm.lmscore import CODES, Bucket, Root, codes_of, discount, is_held, keys_of, leaves_of, log_scores, pack, reseated


def corpus():
    rng = random.Random(8)
    chains = [[f"{k}{i}" for i in range(12)] for k in "abc"]
    docs = [(i, " ".join(rng.choices(chains[i % 3], [1 / (x + 1) for x in range(12)], k=rng.randrange(60))) + (" rare%d" % i if i % 9 == 0 else "")) for i in range(200)]
    return [*docs, (200, None), (201, ""), (202, "A0 \t\n a0"), (7, docs[7][1]), (None, "a0 b1")]


def base(docs):
    toks = [(i, (t or "").lower().split() + [0]) for i, t in docs]
    c = Counter(w for i, ws in toks if not is_held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return n, sorted((-1 if i is None else i, is_held(i), len(ws), sum(c[w] > 0 for w in ws), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in toks)


def test_base_and_gain(spark):
    docs = corpus()
    got = log_scores(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    n, want = base(docs)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {n}
    for held in (True, False):
        assert sum(r.score for r in got if r.held_out == held) > sum(r.base_score for r in got if r.held_out == held)
    assert all(r.score < 0 for r in got)


def test_other_documents_have_finite_scores(spark):
    train = [(i, t) for i, t in corpus() if not is_held(i)]
    vocab = sorted({w for _, t in train for w in (t or "").lower().split()}) + ["unseen"]
    held = [i for i in range(10_000, 11_000) if is_held(i)][: len(vocab) + 1]
    asked = [(i, w) for i, w in zip(held, ["a0 " + w for w in vocab], strict=False)] + [(held[-1], "a0")]
    schema = "doc_id long, text string"
    got = {r.doc_id: r for r in log_scores(spark.createDataFrame(train, schema), spark.createDataFrame(asked + [(10**6 + 1, "")], schema)).collect()}
    both = {i: got[i].score for i, _ in asked}
    assert len(both) == len(vocab) + 1 and all(math.isfinite(x) for x in both.values())


def test_repeats_and_empty(spark):
    schema = "doc_id long, text string"
    assert log_scores(spark.createDataFrame([], schema)).count() == 0
    only_held = log_scores(spark.createDataFrame([(i, "x y") for i in range(30) if is_held(i)], schema)).collect()
    assert only_held and all(r.score == 0 == r.base_score and r.train_tokens == 0 for r in only_held)


def test_score_is_the_same_however_tokens_are_dealt(spark):
    docs = corpus()
    few = {r.doc_id: r for r in log_scores(spark.createDataFrame(docs[:60], "doc_id long, text string"), bucket_bytes=10**9).collect()}
    many = {r.doc_id: r for r in log_scores(spark.createDataFrame(docs[:60], "doc_id long, text string").repartition(7), bucket_bytes=200).collect()}
    assert all(abs(few[i].base_score - many[i].base_score) < 1e-9 and few[i].n_known == many[i].n_known for i in few)
    assert abs(sum(r.score for r in few.values()) / sum(r.score for r in many.values()) - 1) < 0.03


def test_scores_of_documents_do_not_depend_on_the_number_of_buckets(spark):
    """Half of the words are one, whose restaurant goes to many buckets where they are small."""
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice(["the", f"w{int(rng.paretovariate(0.7)) % 40}"]) for _ in range(rng.randrange(80)))) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    few = {r.doc_id: r for r in log_scores(df, bucket_bytes=10**9).collect()}
    many = {r.doc_id: r for r in log_scores(df.repartition(3), bucket_bytes=500).collect()}
    assert few.keys() == many.keys() and len(few) == 120
    assert max(abs(few[i].score - many[i].score) for i in few) < 1e-6


def test_seen_documents_scored_as_others_keep_their_tokens(spark):
    """Pairs that training has not seen count for documents on either side of the split."""
    train = [(i, t) for i, t in corpus() if i is not None]
    i = next(i for i in range(10**4, 10**5) if not is_held(i))
    (row,) = log_scores(spark.createDataFrame(train, "doc_id long, text string"), spark.createDataFrame([(i, "a0 zz qq b0")], "doc_id long, text string")).collect()
    assert (row.n_tokens, row.n_known, row.held_out) == (5, 3, False) and row.score < -3


def conditional(n, p, d, theta, others):
    s = np.full((n + 1, n + 2), -np.inf)
    s[0, 0] = 0
    t = np.arange(1, n + 1)
    with np.errstate(divide="ignore"):
        for m in range(1, n + 1):
            s[m, t] = np.logaddexp(s[m - 1, t - 1], np.log(np.maximum(m - 1 - d * t, 0)) + s[m - 1, t])
    w = s[n, t] + np.cumsum(np.log(p * (theta + d * (others + t - 1))))
    w = np.exp(w - w.max())
    return w / w.sum()


@pytest.mark.parametrize("n,p,others,rows", [(4, 0.05, 3, 20_000), (6, 0.4, 0, 20_000), (200, 0.05, 100, 20_000), (600, 0.05, 100, 2000), (3000, 0.3, 5000, 500), (3000, 1e-4, 10, 2000)])
def test_tables_have_their_conditional_distribution(n, p, others, rows):
    d, theta = 0.6, 1.0
    want = conditional(n, p, d, theta, others)
    t = np.arange(1, n + 1)
    mean = (want * t).sum()
    sd = ((want * t**2).sum() - mean**2) ** 0.5
    got = reseated(np.full(rows, n), np.full(rows, others), np.full(rows, p), np.arange(1, rows + 1, dtype=np.uint64), d, theta)
    assert abs(got.mean() - mean) < 5 * sd / rows**0.5 + (0.05 * sd if n > 256 else 0)
    assert abs(got.std() - sd) < 0.1 * sd + 0.02


def whole_bucket(words, rng):
    """A bucket of two words' restaurants, each with a dish of every word."""
    u, v, w = (x.ravel() for x in np.meshgrid(np.arange(2), np.arange(3), np.arange(words), indexing="ij"))
    order = np.lexsort((v, w, u))
    u, v, w = u[order], v[order], w[order]
    n = rng.integers(0, 4, len(u)) * rng.integers(0, 2, len(u))
    pu, pw = np.repeat(np.arange(2), words), np.tile(np.arange(words), 2)
    return Bucket(pack(np.full(2 * words, 3), pu, pw, u * 3 + v, n))


def test_probabilities_of_each_context_sum_to_one():
    rng = np.random.default_rng(5)
    b = whole_bucket(20, rng)
    b.seat(np.minimum(b.n3, 1))
    for sweep in range(3):
        n1 = np.bincount(b.w, b.t2, 20).astype(int)
        known = n1 > 0
        root = Root(int(n1.sum()), int(known.sum()), int(known.sum()), 99, 0.5, 1.0)
        p1 = root.chances(n1, known.astype(int))
        # words that training lacks share one unknown word
        p1 = np.where(known, p1, root.unknown / max(1, (~known).sum()))
        p1 = p1 / 1 if (~known).any() else p1
        left = 0 if (~known).any() else root.unknown
        p2 = b.pairs(p1, 0.6, 1.0)
        p3 = b.trigrams(p2, 0.7, 1.0)
        assert np.allclose(p1.sum() + left, 1)
        back = np.bincount(b.u, p2)
        assert (back <= 1 + 1e-9).all() and (back > 0.5).all()
        if not left:
            assert np.allclose(back, 1) and np.allclose(np.bincount(b.of_two, p3), 1)
        b.sweep(p1, 0.7, 0.6, 1.0, keys_of(len(b.n3), 0, sweep))


def sequential(docs, d3, d2, d1, theta, sweeps, burn, seed):
    """Customers leave and sit down one by one; mean log10 score of all documents by averaged probabilities."""
    rng = random.Random(seed)
    toks = [["^", "^", *t.split(), "$"] for t in docs]
    triples = [(a, b, c) for t in toks for a, b, c in zip(t, t[1:], t[2:], strict=False)]
    vocab = {c for *_, c in triples}
    rest: dict = {}

    def p(ctx, w):
        if ctx is None:
            return 1 / (len(vocab) + 1)
        d = (d1, d2, d3)[len(ctx)]
        dishes = rest.get(ctx, {})
        n, t = sum(sum(x) for x in dishes.values()), sum(map(len, dishes.values()))
        own = dishes.get(w, [])
        return (sum(own) - d * len(own) + (theta + d * t) * p(ctx[1:] if ctx else None, w)) / (theta + n)

    def add(ctx, w):
        d = (d1, d2, d3)[len(ctx)]
        dishes = rest.setdefault(ctx, {})
        own = dishes.setdefault(w, [])
        t = sum(map(len, dishes.values()))
        weights = [x - d for x in own] + [(theta + d * t) * p(ctx[1:] if ctx else None, w)]
        k = rng.choices(range(len(weights)), weights)[0]
        if k == len(own):
            own.append(1)
            if ctx:
                add(ctx[1:], w)
        else:
            own[k] += 1

    def remove(ctx, w):
        own = rest[ctx][w]
        k = rng.choices(range(len(own)), own)[0]
        own[k] -= 1
        if not own[k]:
            own.pop(k)
            if ctx:
                remove(ctx[1:], w)

    total = Counter()
    for a, b, c in triples:
        add((a, b), c)
    for s in range(sweeps):
        for a, b, c in triples:
            remove((a, b), c)
            add((a, b), c)
        if s >= burn:
            for x in set(triples):
                total[x] += p(x[:2], x[2]) / (sweeps - burn)
    return sum(math.log10(total[x]) for x in triples)


def test_scores_equal_a_sequential_samplers(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choices([f"k{x}" for x in range(15)], [1 / (x + 1) for x in range(15)], k=20))) for i in range(60) if not is_held(i)][:50]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    mine = [sum(r.score for r in log_scores(df, burn_in=6, samples=s).collect()) for s in (4, 8)]
    toks = [["^", "^", *t.split(), "$"] for _, t in docs]
    tri = Counter(x for t in toks for x in zip(t, t[1:], t[2:], strict=False))
    pairs = Counter(x[1:] for x in tri)
    words = Counter(x[1] for x in pairs)
    d3, d2, d1 = (discount(sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())) for c in (tri, pairs, words))
    theirs = [sequential([t for _, t in docs], d3, d2, d1, 1.0, 24, 8, seed) for seed in (1, 2)]
    assert max(abs(m / t - 1) for m in mine for t in theirs) < 0.02


def test_words_hashed_side_by_side_are_those_of_split_words():
    """Words of up to 256 bytes are hashed without a step of Python each."""
    rng = random.Random(1)
    bits = [b"a", b"B", b"the", b" ", b"  ", b"\t\n", b"\x0b", b"\x0e", b"\x08", b"\x00", b"\xc3\xa9", b"x" * 300, b"abcdefgh", b"abcdefghi", b"\r\x0c", b"\xff"]
    texts = [b"", b" ", b"A", b"x" * 256, b"x" * 257, b""] + [b"".join(rng.choices(bits, k=rng.randrange(12))) for _ in range(2000)]
    names, words = {}, {}
    for text, hashes in zip(texts, hashed_words(texts), strict=True):
        for word, h in zip(split_words(text), hashes.tolist(), strict=True):
            assert names.setdefault(word, h) == h and words.setdefault(h, word) == word
    assert list(hashed_words([])) == []


@pytest.mark.parametrize("size", [0, 1, 3000])
def test_codes_are_places_in_the_codebook(size):
    rng = np.random.default_rng(2)
    codebook = np.unique(np.append(rng.integers(0, 2**64, size, np.uint64), np.arange(min(size, 9), dtype=np.uint64)))[:size]
    words = np.concatenate([codebook, rng.integers(0, 2**64, 500, np.uint64), np.array([0, 5, 2**64 - 1], np.uint64)])
    place = {w: k for k, w in enumerate(codebook.tolist())}
    assert codes_of(words, codebook, leaves_of(codebook)).tolist() == [place.get(w, CODES) for w in words.tolist()]
