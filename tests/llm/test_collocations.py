import re
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from epochal.llm import collocations as c
from epochal.llm.common import table

SF = "/root/testdata/sf0.001"


def by_hand(rows, most_words=3, least=10, covered=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        text = "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", text):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, most_words + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        scored, cover = [], Counter()
        for g, a in counts.items():
            if len(g) > 2 and a >= least:
                for k in range(2, len(g)):
                    for i in range(len(g) - k + 1):
                        cover[g[i : i + k]] = max(cover[g[i : i + k]], a)
        for g, a in counts.items():
            if len(g) > 1 and a >= least and not 100 * cover[g] >= covered * a:
                score, _, l, r = min((1000000 * a * a // (counts[g[:k]] * counts[g[k:]]), k, counts[g[:k]], counts[g[k:]]) for k in range(1, len(g)))
                scored.append((-score, -a, " ".join(g).encode(), l, r))
        out += [(lang, i, g.decode(), -a, l, r, n[lang], -s) for i, (s, a, g, l, r) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def answers(found):
    return sorted(tuple(r) for r in found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@settings(deadline=None, max_examples=100)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=200), st.integers(1, 9))
def test_suffixes_are_in_the_order_of_their_first_words(ids, depth):
    ids = np.array(ids)
    order = c.suffix_order(ids, depth)
    heads = [tuple(ids[i : i + depth]) for i in order]
    assert sorted(order.tolist()) == list(range(len(ids)))
    assert all(a <= b for a, b in pairwise(heads))


@settings(deadline=None, max_examples=60)
@given(st.text("ab .", max_size=120), st.integers(1, 4))
def test_intervals_count_phrases(text, depth):
    words = c.words_of(text.encode())
    want = Counter()
    for piece in text.split("."):
        w = piece.split()
        for k in range(1, depth + 1):
            want.update(" ".join(w[i : i + k]).encode() for i in range(len(w) - k + 1))
    found, hashes = Counter(), {}
    for texts, n, h in c.phrases(pa.chunked_array([words], pa.binary()), depth, len(words)):
        found.update(dict(zip(texts.to_pylist(), n.tolist(), strict=True)))
        hashes |= dict(zip(texts.to_pylist(), h.tolist(), strict=True))
    assert found == want
    assert c.phrase_hashes(pa.array(list(hashes), pa.binary())).tolist() == list(hashes.values())


def test_whole_table(spark):
    rows = [(r.lang, r.text) for r in table(spark, SF, "documents").collect()]
    assert answers(c.op12_phrase_collocations(spark, SF)) == by_hand(rows)


@pytest.mark.parametrize("most_words", [2, 4])
def test_small_shards_and_blocks_dealt_again(spark, monkeypatch, most_words):
    """Shards of 50 words, texts in parts of 40 bytes, and blocks dealt three times."""
    rows = [(r.lang, r.text) for r in table(spark, SF, "documents").limit(60).collect()]
    rows.append(("xx", "new york city " * 300 + "x" * 100 + " New York? " * 40))
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    want = by_hand(rows, most_words, 4, 60, 50)
    for name, value in (("SHARD", 50), ("PIECE", 40), ("FAN", 8), ("BLOCK", 500)):
        monkeypatch.setattr(c, name, value)
    assert answers(c.collocations(df, most_words, 4, 60, 50)) == want


def test_nulls_ties_repeats_and_clashing_columns(spark):
    texts = [None, "", " .,\n\t", "A b a B\ta b", "a b", "a b", "é à é à", "x y. x y", "p q\x0br s\x1ct u"]
    rows = [(lang, t, 1, "n") for t in texts for lang in ("en", None, "und") for _ in range(5)]
    df = spark.createDataFrame(rows, "lang string, text string, n int, phrase string")
    assert answers(c.collocations(df)) == by_hand([r[:2] for r in rows])


def test_empty_tables_and_no_candidates(spark):
    assert c.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    for texts in (["a b c", None], ["a. b! c"], ["alone"] * 20):
        assert c.collocations(spark.createDataFrame([("en", t) for t in texts], "lang string, text string")).count() == 0


def test_scores_of_large_counts_are_exact(spark):
    a, l, r = 987_654_321_987, 999_999_999_999, 987_654_321_989
    rows = [("en", 2, "p q", a), ("en", 1, "p", l), ("en", 1, "q", r)]
    found = c.scored(spark.createDataFrame(rows, "lang string, words int, phrase string, n long")).first()
    assert (found.score, found.l, found.r) == (1000000 * a * a // (l * r), l, r)
