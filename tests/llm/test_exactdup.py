import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from epochal.llm import exactdup
from epochal.llm.exactdup import counted, exact_duplicates, filter_of, merged

SCHEMA = "doc_id long, text string"


def by_hand(rows):
    norm = [re.sub(r"[ \t-\r]+", " ", t or "") for _, t in rows]
    out = []
    for (doc_id, _), text in zip(rows, norm, strict=True):
        ids = [d for (d, _), other in zip(rows, norm, strict=True) if other == text]
        keep = min((d for d in ids if d is not None), default=None)
        out.append((doc_id, keep, len(ids), doc_id == keep, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def answers(found):
    return sorted((tuple(r) for r in found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.dictionaries(st.integers(0, 2**20 - 1), st.integers(1, 2**40), max_size=300), min_size=1, max_size=4))
def test_filters_give_back_and_merge_what_they_took(parts):
    filters, total = [], {}
    for part in parts:
        keys = np.array(sorted(part), np.uint64)
        counts = np.array([part[int(k)] for k in keys], np.int64)
        made = filter_of(keys, counts, 20)
        found = counted(made, 20)
        assert found[0].tolist() == keys.tolist() and found[1].tolist() == counts.tolist()
        filters.append(made)
        for k, n in part.items():
            total[k] = total.get(k, 0) + n
    keys, counts = counted(merged(filters, 20), 20)
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == total
    assert keys.tolist() == sorted(total)


def test_filters_of_wide_fingerprints_take_little_room():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**48, 20_000).astype(np.uint64))
    made = filter_of(keys, np.ones(len(keys), np.int64), 48)
    assert counted(made, 48)[0].tolist() == keys.tolist()
    assert sum(map(len, made[2:])) < 10 * len(keys)


def test_duplicates_nulls_ties_and_repeats(spark):
    rows = [(5, "a  b"), (3, "a\tb"), (9, "a b"), (4, None), (2, ""), (8, " "), (7, "  \n"), (None, "a b"), (None, "lone"), (None, "twin"), (None, "twin"), (6, "x"), (6, "x"), (1, "a b"), (10, "long " * 50_000), (11, "long  " * 50_000), (12, "A B"), (13, "a b ")]
    assert answers(exact_duplicates(spark.createDataFrame(rows, SCHEMA))) == by_hand(rows)


def test_empty_table_and_clashing_columns(spark):
    assert exact_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "a b", 5, "x"), (2, "a  b", 6, "y")]
    found = exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string, n long, sha string"))
    assert answers(found) == by_hand([r[:2] for r in rows])


@pytest.mark.parametrize("spare_bits", [0, 16])
def test_hot_groups_and_chance_meetings(spark, monkeypatch, spare_bits):
    """With hardly any bits most fingerprints are shared by chance, and bytes decide."""
    monkeypatch.setattr(exactdup, "SHARE", 50)
    monkeypatch.setattr(exactdup, "HELD", 100)
    rows = [(i, "hot text" if i % 3 == 0 else f"copy {i // 7}" if i % 3 == 1 else f"own {i}") for i in range(900)]
    made = exact_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5), spare_bits)
    assert answers(made) == by_hand(rows)


def test_shuffled_lookup(spark):
    """The way that is taken where the shared fingerprints are too many to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = [(i, f"text {i % 40}" if i % 2 else f"own {i}") for i in range(300)]
        assert answers(exact_duplicates(spark.createDataFrame(rows, SCHEMA))) == by_hand(rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
