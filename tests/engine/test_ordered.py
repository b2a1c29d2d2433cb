import random
import statistics

import pytest
from pyspark.sql import functions as F

from epochal.operators.ordered import between, medians, placed, spread, stepped
from epochal.operators.timing import gaps

SCHEMA = "k string, t double, tag long"


def drawn(n, seed):
    rng = random.Random(seed)
    return [(rng.choice(["hot", "hot", "hot", "b", "c", None]), rng.choice([None, float(rng.randrange(50)), rng.uniform(0, 1000)]), i) for i in range(n)]


@pytest.mark.parametrize("rows", [drawn(2000, 1), [("one", float(i % 3), i) for i in range(500)], [("one", 1.0, 0)], []], ids=["mixed", "ties", "single", "none"])
def test_steps_and_medians_over_many_blocks(spark, rows):
    """Keys go over many blocks here; a null key is a key."""
    spark.conf.set("spark.sql.shuffle.partitions", 13)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, SCHEMA).withColumn("k", F.coalesce("k", F.lit("")))
        by_key = {}
        for k, t, _ in rows:
            if t is not None:
                by_key.setdefault(k or "", []).append(t)
        want = {k: sorted(b - a for a, b in zip(sorted(v), sorted(v)[1:], strict=False)) for k, v in by_key.items()}
        got = {}
        for r in stepped(df, "k", "t").collect():
            got.setdefault(r.k, []).append(r.step)
        assert {k: sorted(x for x in v if x is not None) for k, v in got.items()} == want
        assert all(v.count(None) == 1 for v in got.values())
        assert {r.k: r.median for r in medians(df, "k", "t").collect()} == {k: statistics.median(v) for k, v in by_key.items()}
        places = [(r.k, r.place, r.t, r.tag) for r in placed(df, "k", "t", "tag").collect()]
        order = lambda r: (r[0] or "", r[1] is not None, r[1] or 0.0, r[2])
        by_place = [(k, tag) for k, _, _, tag in sorted(places, key=lambda r: r[:2])]
        assert by_place == [(r[0] or "", r[2]) for r in sorted(rows, key=order)]
        found = sorted(r.step for r in gaps(df, "k", "t").collect())
        assert found == sorted(x for v in want.values() for x in v if x > 1.5 * statistics.median(v))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_slices_hold_both_ends_and_pivots_refuse_two_rows_of_one_time(spark):
    rows = spark.createDataFrame([(1.0, "a", 5.0), (1.0, "b", 6.0), (2.0, "a", None), (3.0, "b", 8.0)], "t double, c string, v double")
    assert between(rows, "t", 1, 2).count() == 3
    assert sorted(map(tuple, spread(rows, "t", "c", "v", ["a", "b"]).collect())) == [(1.0, 5.0, 6.0), (2.0, None, None), (3.0, None, 8.0)]
    with pytest.raises(Exception, match="two rows of one channel at 2.0"):
        spread(rows.union(rows.where("t = 2")), "t", "c", "v", ["a", "b"]).collect()
