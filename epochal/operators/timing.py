"""When each record starts, and what is wrong with those times.

Rows are (path, record_index, declared_s, record_duration_seconds, continuity,
finest_s). A file's first origin is an aggregate that is joined back, so only
the order checks need a window over a file's records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import medians, stepped


def origins(records: DataFrame, first_records: int = 16) -> DataFrame:
    """(path, origin_s): the first readable start less the records before it, among a
    file's first records, as the source has it; no other where that isn't finite."""
    records = records.where(F.col("record_index") < first_records)
    stated = F.col("declared_s") - F.col("record_index") * F.col("record_duration_seconds")
    first = F.min_by(F.when(F.col("declared_s").isNotNull(), stated), F.when(F.col("declared_s").isNotNull(), F.col("record_index")))
    return records.groupBy("path").agg(first.alias("origin_s")).withColumn("origin_s", F.when(F.abs("origin_s") < float("inf"), F.col("origin_s")))


def record_starts(records: DataFrame) -> DataFrame:
    """``records`` with start_s: from zero without a mark, one origin for files
    marked continuous, and stated starts for discontinuous ones."""
    steps = F.col("record_index") * F.col("record_duration_seconds")
    whole = F.coalesce("origin_s", F.lit(0.0)) + steps
    start = F.when(F.col("continuity").isNull(), steps).when(F.col("continuity").endswith("C"), whole).otherwise(F.coalesce("declared_s", whole))
    return records.join(origins(records), "path", "left").withColumn("start_s", start)


def contradicts() -> Column:
    """A stated start over half the finest interval away from the contiguous one."""
    expected = F.col("origin_s") + F.col("record_index") * F.col("record_duration_seconds")
    return F.coalesce(F.abs(F.col("declared_s") - expected) > F.col("finest_s") / 2, F.lit(False))


def record_order(starts: DataFrame) -> DataFrame:
    """``fault``: backwards, overlapping (never both), or NULL."""
    before = F.lag("start_s").over(Window.partitionBy("path").orderBy("record_index"))
    overlap = F.col("start_s") + F.col("finest_s") / 2 < before + F.col("record_duration_seconds")
    return starts.withColumn("fault", F.when(F.col("start_s") < before, "backwards").when(overlap, "overlapping"))


def spans(starts: DataFrame) -> DataFrame:
    ends = F.col("start_s") + F.col("record_duration_seconds")
    return starts.groupBy("path").agg(F.min("start_s").alias("first_s"), F.max(ends).alias("last_s"), F.max_by("start_s", F.abs("start_s")).alias("furthest_s"), F.count(F.lit(1)).alias("records"))


def run_spans(runs: DataFrame) -> DataFrame:
    """(path, first_s, last_s) from runs of records."""
    last = F.when(F.col("records") == 1, F.col("start_s")).otherwise(F.col("base_s") + (F.col("first_record") + F.col("records") - 1) * F.col("record_duration_seconds"))
    return runs.groupBy("path").agg(F.min("start_s").alias("first_s"), F.max(last + F.col("record_duration_seconds")).alias("last_s"))


def rows_in_run(rate: Column, samples: Column, start: Column, end: Column) -> Column:
    """How many samples of a run of records lie in the window: all of those before the few
    records around a bound, and those of these few by ``rows_in_window``'s rule."""
    eps, c = F.least(F.lit(1e-9), F.lit(0.5) / rate), F.col
    first, after, step = c("first_record"), c("first_record") + c("records"), c("record_duration_seconds")

    def upto(bound: Column) -> Column:
        near = F.floor(F.try_divide(F.greatest(F.least(bound - eps - c("base_s"), F.lit(1e18)), F.lit(-1e18)), step))
        lo = F.least(after, F.greatest(first, F.coalesce(near, first) - 2))
        hi = F.when(step > 0, F.least(after, F.greatest(first, F.coalesce(near, first) + 3))).otherwise(after)
        start = lambda i: F.when(c("records") == 1, c("start_s")).otherwise(c("base_s") + i * step)
        few = F.when(hi > lo, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<bigint>"))
        part = F.aggregate(few, F.lit(0).cast("long"), lambda n, i: n + F.least(samples, F.greatest(F.lit(0), F.ceil((bound - eps - start(i)) * rate))).cast("long"))
        return (lo - first) * samples + part

    return F.greatest(F.lit(0), upto(end) - upto(start)).cast("long")


def overlapping_records(starts: DataFrame, start: float, end: float) -> DataFrame:
    """Records that a window needs: the scan's range, found without a sample."""
    return starts.where((F.col("start_s") + F.col("record_duration_seconds") > start) & (F.col("start_s") < end))


def rows_in_window(start_s: Column, rate: Column, samples: Column, start: float, end: float) -> Column:
    """How many samples of a record lie in the window, in closed form."""
    eps = F.least(F.lit(1e-9), F.lit(0.5) / rate)
    upto = lambda bound: F.least(samples, F.greatest(F.lit(0), F.ceil((F.lit(bound) - eps - start_s) * rate)))
    return F.greatest(F.lit(0), upto(end) - upto(start)).cast("long")


def gaps(events: DataFrame, key: str, time: str, factor: float = 1.5) -> DataFrame:
    """Steps longer than ``factor`` times the key's median step, whatever rows a key has."""
    steps = stepped(events, key, time)
    median = medians(steps, key, "step").withColumnRenamed("median", "median_step")
    return steps.join(median, key).where(F.col("step") > factor * F.col("median_step"))
