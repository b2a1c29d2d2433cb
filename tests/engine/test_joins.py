import bisect
import random

from pyspark.sql import functions as F

from epochal.operators import joins
from epochal.streaming.epochs import streaming_epochs


def test_asof_in_blocks_matches_brute_force(spark):
    rng = random.Random(3)
    left = [(i, rng.randrange(2), float(rng.randrange(400))) for i in range(150)] + [(999, 7, 1.0)]
    right = [(k, t, i) for i, (k, t) in enumerate({(rng.randrange(2), float(rng.randrange(400))) for _ in range(40)})]
    frames = spark.createDataFrame(left, "i long, k long, t double"), spark.createDataFrame(right, "k long, t double, v long")
    times = {k: sorted((t, v) for kk, t, v in right if kk == k) for k in (0, 1, 7)}

    def near(k, t, both):
        at = bisect.bisect_right(times[k], (t, 1 << 60))
        back, ahead = times[k][at - 1] if at else None, times[k][at] if at < len(times[k]) else None
        exact = back and back[0] == t
        if both and not exact and ahead and (not back or ahead[0] - t < t - back[0]):
            return ahead[1]
        return back[1] if back else None

    for direction in ("backward", "nearest"):
        for block in (None, 50.0):
            got = {r.i: r.v for r in joins.asof(*frames, "k", "t", "v", direction=direction, block=block).collect()}
            assert got == {i: near(k, t, direction == "nearest") for i, k, t in left}


def test_covered_points(spark):
    rng = random.Random(4)
    points = [(i, rng.randrange(2), float(rng.randrange(100))) for i in range(80)]
    spans = [(i, rng.randrange(2), float(rng.randrange(100)), rng.choice([None, 0.0, 1.0, 37.0])) for i in range(20)]
    got = joins.covered_by(spark.createDataFrame(points, "p long, k long, t double"), spark.createDataFrame(spans, "s long, k long, a double, n double"), "k", "t", "a", "n", 10.0)
    assert sorted((r.p, r.s) for r in got.collect()) == sorted((p, s) for p, k, t in points for s, kk, a, n in spans if k == kk and n and a <= t < a + n)


def test_streamed_epochs(spark, tmp_path):
    rows = [(0, f"2024-01-01 00:00:{s:02d}", float(s)) for s in range(40)] + [(0, "2024-01-01 01:00:00", 0.0)]
    df = spark.createDataFrame(rows, "signal_index int, at string, value double").select("signal_index", F.to_timestamp("at").alias("ts"), "value")
    df.write.parquet(str(tmp_path / "in"))
    stream = streaming_epochs(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 30)
    query = stream.writeStream.format("memory").queryName("epochs").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = [(r.n, r.mean_value, r.peak) for r in spark.sql("select * from epochs order by epoch").collect()]
    assert got[:2] == [(30, 14.5, 29.0), (10, 34.5, 39.0)]
