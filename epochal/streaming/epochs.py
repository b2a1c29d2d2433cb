"""Epoch statistics of samples that arrive as a stream.

An event-time window closes once the watermark has passed it, so state is one
row a channel and open epoch; later samples are dropped, as the delay says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_epochs(samples: DataFrame, seconds: int, delay: str = "10 seconds", time: str = "ts", key: str = "signal_index", value: str = "value") -> DataFrame:
    late = samples.withWatermark(time, delay)
    stats = late.groupBy(key, F.window(time, f"{seconds} seconds")).agg(F.count(value).alias("n"), F.avg(value).alias("mean_value"), F.max(F.abs(value)).alias("peak"))
    return stats.select(key, F.col("window.start").alias("epoch"), "n", "mean_value", "peak")
