"""A recording as DataFrames: packed records, samples, calibration, windows.

Every function is DataFrame to DataFrame. Packed rows hold a record's codes as
one array, so decoding is an explode; no sample is shuffled before it is aggregated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .plans.convert import scaled

#: signal, label, first slot, samples a record, physical and digital range.
CHANNELS = [
    (0, "EEG", 0, 32, -250.0, 250.0, -2048, 2047),
    (1, "ECG", 32, 16, -5.0, 5.0, -2048, 2047),
    (2, "T8", 48, 8, 100.0, -100.0, -2048, 2047),
    (3, "T8", 56, 8, -1.0, 1.0, 0, 0),
]
CHANNEL_SCHEMA = "signal_index int, label string, first_slot int, spr int, pmin double, pmax double, dmin int, dmax int"


def channels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CHANNELS, CHANNEL_SCHEMA)


def samples(packed: DataFrame, record: str = "vec_id", codes: str = "embedding") -> DataFrame:
    """One row per sample: record_index, signal_index, sample_index, time_s, digital, value.

    Each channel's part is cut out of the array before it is exploded, so no sample is
    matched with a channel."""
    names = [x.split(" ") for x in CHANNEL_SCHEMA.split(", ")]
    parts = F.array(*(F.struct(*(F.lit(v).cast(t).alias(n) for v, (n, t) in zip(c, names, strict=True)), F.slice(codes, c[2] + 1, c[3]).alias("codes")) for c in CHANNELS))
    rows = packed.select(F.col(record).alias("record_index"), F.explode(parts).alias("c")).select("record_index", "c.*")
    rows = rows.select("record_index", *(n for n, _ in names), F.posexplode("codes").alias("sample_index", "code"))
    digital = F.floor(F.col("code").cast("double") * 2048).cast("int")
    return (
        rows.withColumn("time_s", F.col("record_index") + F.col("sample_index") / F.col("spr").cast("double"))
        .withColumn("digital", digital)
        .withColumn("value", scaled(F.col("digital"), F.col("pmin"), F.col("pmax"), F.col("dmin"), F.col("dmax")))
    )


def in_window(df: DataFrame, start: float, end: float) -> DataFrame:
    """Half-open window on time_s; both bounds move by the rate's tolerance."""
    eps = F.least(F.lit(1e-9), F.lit(0.5) / F.col("spr").cast("double"))
    return df.where((F.col("time_s") >= F.lit(start) - eps) & (F.col("time_s") < F.lit(end) - eps))


def epochs(df: DataFrame, seconds: int) -> DataFrame:
    """Mean and largest magnitude by channel and epoch."""
    return df.groupBy("signal_index", (F.floor(F.col("time_s") / seconds) * seconds).cast("long").alias("epoch_s")).agg(
        F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), F.round(F.max(F.abs("value")), 6).alias("peak")
    )


def described(df: DataFrame) -> DataFrame:
    """Count, mean, spread, extremes and quartiles of each channel's values.

    Quartiles are exact, from the numbers of samples by value: a channel has at most as
    many values as codes, so what a task holds of it is bounded."""
    by_value = df.where("value is not null").groupBy("signal_index", "value").agg(F.count(F.lit(1)).alias("k"))
    line = Window.partitionBy("signal_index").orderBy("value")
    upto = by_value.withColumn("upto", F.sum("k").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    n = df.groupBy("signal_index").agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), F.round(F.stddev_samp("value"), 6).alias("sd"), F.min("value").alias("least"), F.max("value").alias("most"))
    placed = upto.join(n.select("signal_index", "n"), "signal_index")

    def quarter(q: float):
        at = (F.col("n") - 1) * q
        low = F.min(F.when(F.col("upto") > F.floor(at), F.col("value")))
        high = F.min(F.when(F.col("upto") > F.ceil(at), F.col("value")))
        return F.round(low + (high - low) * F.first(at - F.floor(at)), 6)

    quartiles = placed.groupBy("signal_index").agg(*(quarter(q).alias(f"q{k}") for k, q in enumerate((0.25, 0.5, 0.75), 1)))
    return n.join(quartiles, "signal_index", "left").select("signal_index", "n", "mean_value", "sd", "least", "q1", "q2", "q3", "most")


def zipped(packed: DataFrame, signals: list[int], names: list[str], record: str = "vec_id", codes: str = "embedding") -> DataFrame:
    """A row per sample time of channels of one rate, from a record's arrays side by side."""
    chosen = [c for c in CHANNELS if c[0] in signals]
    spr = chosen[0][3]
    value = lambda c: F.transform(F.slice(codes, c[2] + 1, spr), lambda x: scaled(F.floor(x.cast("double") * 2048).cast("int"), *map(F.lit, c[4:])))
    rows = packed.select(F.col(record).alias("record_index"), F.posexplode(F.arrays_zip(*(value(c).alias(n) for c, n in zip(chosen, names, strict=True)))).alias("sample_index", "v"))
    return rows.select("record_index", "sample_index", (F.col("record_index") + F.col("sample_index") / float(spr)).alias("time_s"), "v.*")
