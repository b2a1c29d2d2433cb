"""Steps and medians of ordered rows whose keys may hold any number of them.

Rows are dealt by ranges of (key, value) and written with the number of their block, so
a key's rows lie in as many blocks as it needs. A window runs within a key's part of a
block alone; what it needs of the blocks before, a value or a count, is carried over
from a table of a row a key and block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import scratch


def in_blocks(rows: DataFrame, key: str, *values: str) -> DataFrame:
    """``rows`` with ``block``: a key's later blocks hold larger values, equal ones one block."""
    path, ranged = scratch(rows.sparkSession, "blocks"), rows.repartitionByRange(key, *values)
    ranged = ranged.withColumn("block", F.spark_partition_id())
    ranged.write.parquet(path)
    return rows.sparkSession.read.schema(ranged.schema).parquet(path)


def stepped(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``rows`` that have a value, with ``step``, the way from the value before of the key."""
    blocks = in_blocks(rows.where(F.col(value).isNotNull()), key, value)
    ends = blocks.groupBy(key, "block").agg(F.max(value).alias("__end"))
    carried = ends.select(key, "block", F.lag("__end").over(Window.partitionBy(key).orderBy("block")).alias("__carried"))
    before = F.lag(value).over(Window.partitionBy(key, "block").orderBy(value))
    found = blocks.withColumn("__before", before).join(carried.where("__carried IS NOT NULL"), [key, "block"], "left")
    return found.withColumn("step", F.col(value) - F.coalesce("__before", "__carried")).drop("__before", "__carried", "block")


def medians(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, median): of the values that a key has, half way between the middle two of an even number."""
    counts = in_blocks(rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n")), key, value)
    sums = counts.groupBy(key, "block").agg(F.sum("n").alias("__n"))
    w = Window.partitionBy(key).orderBy("block")
    sums = sums.select(key, "block", (F.sum("__n").over(w) - F.col("__n")).alias("__carried"), F.sum("__n").over(Window.partitionBy(key)).alias("__all"))
    # only blocks that a middle rank lies in are looked into
    low, high = F.floor((F.col("__all") - 1) / 2), F.ceil((F.col("__all") - 1) / 2)
    upto = F.lead("__carried", 1).over(w)
    sums = sums.withColumn("__upto", F.coalesce(upto, F.col("__all"))).where((F.col("__carried") <= high) & (low < F.col("__upto")))
    inner = Window.partitionBy(key, "block").orderBy(value)
    found = counts.join(sums, [key, "block"]).withColumn("__until", F.col("__carried") + F.sum("n").over(inner))
    since = F.col("__until") - F.col("n")
    holds = lambda rank: F.max(F.when((since <= rank) & (rank < F.col("__until")), F.col(value)))
    return found.groupBy(key).agg(((holds(low) + holds(high)) / 2).alias("median"))


def placed(rows: DataFrame, key: str, *values: str) -> DataFrame:
    """``rows`` with ``place``, from 1, in the order of ``values`` within the key."""
    blocks = in_blocks(rows, key, *values)
    sizes = blocks.groupBy(key, "block").agg(F.count(F.lit(1)).alias("__n"))
    carried = sizes.select(key, "block", (F.sum("__n").over(Window.partitionBy(key).orderBy("block")) - F.col("__n")).alias("__carried"))
    own = F.row_number().over(Window.partitionBy(key, "block").orderBy(*values))
    return blocks.withColumn("__own", own).join(carried, [key, "block"]).withColumn("place", F.col("__own") + F.col("__carried")).drop("__own", "__carried", "block")


def between(rows: DataFrame, time: str, first: float, last: float) -> DataFrame:
    """Rows from ``first`` to ``last``, both of them inside, unlike a window of a conversion."""
    return rows.where(F.col(time).between(first, last))


def spread(rows: DataFrame, time: str, channel: str, value: str, channels: list) -> DataFrame:
    """A row a time with a column a channel, empty where the channel has no row; two rows of
    one time and channel are an error."""
    twice = F.raise_error(F.concat(F.lit("two rows of one channel at "), F.first(time).cast("string")))
    return rows.groupBy(time).pivot(channel, channels).agg(F.when(F.count(F.lit(1)) > 1, twice).otherwise(F.max(value)))
