"""As-of and interval joins without range-join plans.

As-of: a union and a fill over one sort by key and time, so it costs one
shuffle. ``block`` cuts a hot key's time line into blocks that are sorted
apart: the last right row of each block is carried forward over the (few)
blocks. Interval: both sides meet by key and time bucket, then the exact bounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, key: str, time: str, value: str, tolerance: float | None = None, direction: str = "backward", block: float | None = None) -> DataFrame:
    """``left`` with ``value`` and ``value_time`` of its closest ``right`` row.

    backward: the most recent row at or before; nearest: the closer neighbour,
    the earlier on a tie. Beyond ``tolerance`` (inclusive) both are NULL."""
    width = F.floor(F.col(time) / block).cast("long") if block else F.lit(0).cast("long")
    hit = F.struct(F.col(time).alias("t"), F.col(value).alias("v"))
    rows = left.select(F.struct(*left.columns).alias("row"), key, time, F.lit(None).cast(right.select(hit.alias("h")).schema["h"].dataType).alias("hit"), width.alias("block"))
    both = rows.unionByName(right.select(F.lit(None).cast(rows.schema["row"].dataType).alias("row"), key, time, hit.alias("hit"), width.alias("block")))
    order = Window.partitionBy(key, "block").orderBy(time, F.col("hit").isNull())
    back = F.last("hit", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("hit", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    out = both.withColumn("back", back)
    if direction == "nearest":
        out = out.withColumn("ahead", ahead)
    if block:
        of_block = both.groupBy(key, "block").agg(F.max_by("hit", F.col("hit.t")).alias("most"), F.min_by("hit", F.col("hit.t")).alias("least"))
        line = Window.partitionBy(key).orderBy("block")
        carried = of_block.select(key, "block", F.last("most", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"), F.first("least", ignorenulls=True).over(line.rowsBetween(1, Window.unboundedFollowing)).alias("later"))
        out = out.join(carried, [key, "block"], "left").withColumn("back", F.coalesce("back", "earlier"))
        if direction == "nearest":
            out = out.withColumn("ahead", F.coalesce("ahead", "later"))
    chosen = F.col("back")
    if direction == "nearest":
        chosen = F.when(F.col("ahead.t") - F.col(time) < F.col(time) - F.col("back.t"), F.col("ahead")).otherwise(F.coalesce("back", "ahead"))
    out = out.where("row is not null").withColumn("chosen", chosen)
    if tolerance is not None:
        out = out.withColumn("chosen", F.when(F.abs(F.col(time) - F.col("chosen.t")) <= tolerance, F.col("chosen")))
    return out.select("row.*", F.col("chosen.v").alias(value), F.col("chosen.t").alias(f"{value}_{time}"))


def covered_by(points: DataFrame, intervals: DataFrame, key: str, time: str, start: str, length: str, width: float, classes: int = 16) -> DataFrame:
    """Pairs with start <= time < start + length; a NULL length is empty.

    ``width``: of the smallest bucket, near the usual length. Lengths fall into classes,
    each with buckets four times as wide as the one before, so that an interval touches
    at most five of its class's buckets however long it is; a point lies in one of each
    class. Beyond the last class an interval touches more."""
    end = F.col(start) + F.coalesce(F.col(length), F.lit(0))
    level = F.least(F.lit(classes - 1), F.greatest(F.lit(0), F.ceil(F.log(4.0, F.greatest(F.col(length) / width, F.lit(1.0)))))).cast("int")
    cut = lambda t, k: F.floor(t / (width * F.pow(F.lit(4.0), k))).cast("long")
    spread = intervals.where(F.col(length) > 0).withColumn("level", level).withColumn("bucket", F.explode(F.sequence(cut(F.col(start), F.col("level")), cut(end, F.col("level")))))
    used = spread.select(F.lit(0).alias("one"), "level").groupBy("one").agg(F.collect_set("level").alias("levels")).select("levels").scalar()  # at most ``classes``
    dealt = points.withColumn("level", F.explode(used)).withColumn("bucket", cut(F.col(time), F.col("level")))
    joined = dealt.join(spread, [key, "level", "bucket"])
    return joined.where((F.col(time) >= F.col(start)) & (F.col(time) < end)).drop("bucket", "level")
