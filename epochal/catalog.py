"""The engine's queries by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import recording
from .functions import text
from .operators import channels, joins

DIMS = "(VALUES " + ", ".join(f"({i}, '{label}', {first}, {spr}, CAST({pmin} AS DOUBLE), CAST({pmax} AS DOUBLE), {dmin}, {dmax})" for i, label, first, spr, pmin, pmax, dmin, dmax in recording.CHANNELS) + ") AS c(signal_index, label, first_slot, spr, pmin, pmax, dmin, dmax)"
SAMPLES = f"""WITH u AS (SELECT vec_id AS record_index, unnest(embedding) AS code, unnest(range(64)) AS slot FROM embeddings),
s AS (SELECT record_index, signal_index, label, spr, pmin, pmax, dmin, dmax, slot - first_slot AS sample_index,
record_index + (slot - first_slot) / CAST(spr AS DOUBLE) AS time_s, CAST(floor(CAST(code AS DOUBLE) * 2048) AS INTEGER) AS digital
FROM u JOIN {DIMS} ON slot >= first_slot AND slot < first_slot + spr),
samples AS (SELECT *, CASE WHEN dmax <> dmin THEN ((pmax - pmin) / (dmax - dmin)) * (pmax / ((pmax - pmin) / (dmax - dmin)) - dmax + digital) END AS value FROM s) """

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recording.samples(read(spark, sf_dir, "embeddings"))


@query(SAMPLES + "SELECT signal_index, CAST(floor(time_s / 30) * 30 AS BIGINT) AS epoch_s, count(value) AS n, round(avg(value), 6) AS mean_value, round(max(abs(value)), 6) AS peak FROM samples GROUP BY 1, 2")
def epoch_stats(spark, sf_dir):
    return recording.epochs(sampled(spark, sf_dir), 30)


@query(SAMPLES + "SELECT record_index, signal_index, CAST(sample_index AS INTEGER) AS sample_index, time_s, digital, value FROM samples")
def decode_samples(spark, sf_dir):
    return sampled(spark, sf_dir).select("record_index", "signal_index", "sample_index", "time_s", "digital", "value")


@query(SAMPLES + "SELECT record_index, signal_index, CAST(sample_index AS INTEGER) AS sample_index, time_s FROM samples WHERE time_s >= 10.25 - least(1e-9, 0.5 / spr) AND time_s < 20.5 - least(1e-9, 0.5 / spr)")
def window_half_open(spark, sf_dir):
    return recording.in_window(sampled(spark, sf_dir), 10.25, 20.5).select("record_index", "signal_index", "sample_index", "time_s")


@query(SAMPLES + "SELECT signal_index, count(value) AS n, round(avg(value), 6) AS mean_value, round(stddev_samp(value), 6) AS sd, min(value) AS least, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS q2, round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS most FROM samples GROUP BY 1")
def channel_describe(spark, sf_dir):
    return recording.described(sampled(spark, sf_dir))


@query(SAMPLES + "SELECT record_index, sample_index, time_s, max(CASE WHEN signal_index = 2 THEN value END) AS \"T8_ch2\", max(CASE WHEN signal_index = 3 THEN value END) AS \"T8_ch3\" FROM (SELECT record_index, CAST(sample_index AS INTEGER) AS sample_index, time_s, signal_index, value FROM samples WHERE spr = 8) GROUP BY 1, 2, 3")
def wide_by_rate(spark, sf_dir):
    return recording.zipped(read(spark, sf_dir, "embeddings"), [2, 3], ["T8_ch2", "T8_ch3"])


@query(SAMPLES + "SELECT signal_index, count(*) AS n, sum(CASE WHEN round(value / ((pmax - pmin) / (dmax - dmin)) - (pmax / ((pmax - pmin) / (dmax - dmin)) - dmax)) = digital THEN 1 ELSE 0 END) AS recovered FROM samples WHERE dmax <> dmin GROUP BY 1")
def digital_recovery(spark, sf_dir):
    gain = (F.col("pmax") - F.col("pmin")) / (F.col("dmax") - F.col("dmin"))
    back = F.round(F.col("value") / gain - (F.col("pmax") / gain - F.col("dmax")))
    return sampled(spark, sf_dir).where("dmax <> dmin").groupBy("signal_index").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(back == F.col("digital"), 1).otherwise(0)).alias("recovered"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def events_per_description(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap_us FROM events")
def event_gaps(spark, sf_dir):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select("user_id", "event_id", (us - F.lag(us).over(w)).alias("gap_us"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '["\\r\\n,]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS field FROM documents""")
def csv_escape(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.csv_field(F.col("text")).alias("field"))


@query("SELECT p_name AS label, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_labels(spark, sf_dir):
    df = read(spark, sf_dir, "part").select(F.lit("x").alias("path"), F.col("p_name").alias("label"), F.col("p_partkey").alias("signal_index"))
    return channels.duplicate_labels(df).select("label", "n")


@query(SAMPLES + "SELECT f.record_index, CAST(f.sample_index AS INTEGER) AS sample_index, f.value AS ecg, g.value AS t8 FROM (SELECT * FROM samples WHERE signal_index = 1) f ASOF LEFT JOIN (SELECT * FROM samples WHERE signal_index = 2) g ON f.record_index = g.record_index AND f.time_s >= g.time_s")
def asof_backward(spark, sf_dir):
    """The most recent slow sample for each fast one: a union and a fill, with no range join."""
    return joins.asof(*fast_and_slow(spark, sf_dir), "record_index", "time_s", "t8").select("record_index", "sample_index", "ecg", "t8")


def fast_and_slow(spark, sf_dir):
    df = sampled(spark, sf_dir)
    return df.where("signal_index = 1").select("record_index", "sample_index", "time_s", F.col("value").alias("ecg")), df.where("signal_index = 2").select("record_index", "time_s", F.col("value").alias("t8"))


@query(SAMPLES + "SELECT f.record_index, CAST(f.sample_index AS INTEGER) AS sample_index, f.value AS ecg, g.value AS t8 FROM (SELECT * FROM samples WHERE signal_index = 1) f ASOF JOIN (SELECT * FROM samples WHERE signal_index = 2 AND sample_index >= 3) g ON f.record_index = g.record_index AND f.time_s >= g.time_s")
def asof_inner(spark, sf_dir):
    fast, slow = fast_and_slow(spark, sf_dir)
    found = joins.asof(fast, slow.where("time_s - floor(time_s) >= 0.375"), "record_index", "time_s", "t8")
    return found.where("t8_time_s is not null").select("record_index", "sample_index", "ecg", "t8")


PARTS = "(SELECT p_brand AS path, p_partkey AS signal_index, p_name AS label, p_size % 5 AS spr FROM part)"


def parts(spark, sf_dir):
    """Parts as channels: a brand is a recording, a part's size its samples a record."""
    return read(spark, sf_dir, "part").select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("signal_index"), F.col("p_name").alias("label"), (F.col("p_size") % 5).alias("samples_per_record"), "p_size", "p_retailprice")


@query(f"SELECT path, spr, string_agg(CAST(signal_index AS VARCHAR), ',' ORDER BY signal_index) AS members FROM {PARTS} WHERE spr > 0 GROUP BY path, spr")
def rate_groups(spark, sf_dir):
    groups = channels.rate_groups(parts(spark, sf_dir))
    return groups.select("path", F.col("samples_per_record").alias("spr"), F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


@query(f"SELECT path, signal_index, CASE WHEN count(*) OVER (PARTITION BY path, label) > 1 THEN label || '_ch' || signal_index ELSE label END AS column_name FROM {PARTS}")
def column_names(spark, sf_dir):
    return channels.column_names(parts(spark, sf_dir)).select("path", "signal_index", "column_name")


from . import catalog_recordings, catalog_text, catalog_time  # noqa: E402, F401  they add their queries here
