"""Queries on time: records, windows, order, joins in time, samples' statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .catalog import DIMS, SAMPLES, query, read, sampled
from .functions import numbers, text
from .operators import annotations, channels, joins, ordered, timing

MICROS = "CAST(epoch_us(ts) - 1704067200000000 AS BIGINT)"
STATED = """r AS (SELECT CASE WHEN vec_id % 2 = 0 THEN 'even' ELSE 'odd' END AS path, vec_id // 2 AS record_index, CAST(1 AS DOUBLE) AS dur,
CASE WHEN vec_id % 7 = 0 THEN NULL WHEN vec_id % 2 = 0 THEN (vec_id // 2) + CAST(0.5 AS DOUBLE) ELSE (vec_id // 2) + 5.0 * (vec_id // 2 // 100) - (CASE WHEN vec_id % 11 = 0 THEN 1.5 WHEN vec_id % 13 = 0 THEN 0.5 ELSE 0 END) END AS declared_s FROM embeddings),
o AS (SELECT path, arg_min(declared_s - record_index * dur, record_index) FILTER (declared_s IS NOT NULL) AS origin_s FROM r GROUP BY path),
starts AS (SELECT r.*, origin_s, CAST(CASE WHEN path = 'even' THEN coalesce(origin_s, 0) + record_index * dur ELSE coalesce(declared_s, coalesce(origin_s, 0) + record_index * dur) END AS DOUBLE) AS start_s FROM r JOIN o USING (path)) """


def stated(spark, sf_dir):
    """Two made-up recordings of the packed records: one marked continuous, one not."""
    n, index = F.col("vec_id"), F.floor(F.col("vec_id") / 2).cast("long")
    shift = F.when(n % 11 == 0, 1.5).when(n % 13 == 0, 0.5).otherwise(0.0)
    odd = F.col("record_index") + 5.0 * F.floor(F.col("record_index") / 100) - shift
    declared = F.when(n % 7 == 0, None).when(n % 2 == 0, F.col("record_index") + 0.5).otherwise(odd)
    df = read(spark, sf_dir, "embeddings").select("vec_id", F.when(n % 2 == 0, "even").otherwise("odd").alias("path"), index.alias("record_index"))
    df = df.withColumn("declared_s", declared.cast("double")).withColumn("record_duration_seconds", F.lit(1.0)).withColumn("continuity", F.when(F.col("path") == "even", "EDF+C").otherwise("EDF+D"))
    return df.withColumn("finest_s", F.lit(1 / 32)).drop("vec_id")


@query("WITH " + STATED + "SELECT path, record_index, declared_s, start_s FROM starts")
def start_fill(spark, sf_dir):
    return timing.record_starts(stated(spark, sf_dir)).select("path", "record_index", "declared_s", "start_s")


@query("WITH " + STATED + "SELECT path, count(*) AS records, sum(CASE WHEN abs(declared_s - (origin_s + record_index * dur)) > 1.0 / 64 THEN 1 ELSE 0 END) AS contradictions FROM starts GROUP BY path")
def continuity_check(spark, sf_dir):
    starts = timing.record_starts(stated(spark, sf_dir))
    return starts.groupBy("path").agg(F.count(F.lit(1)).alias("records"), F.count_if(timing.contradicts()).alias("contradictions"))


@query("WITH " + STATED + ", l AS (SELECT path, record_index, start_s, lag(start_s) OVER (PARTITION BY path ORDER BY record_index) AS b FROM starts) SELECT path, record_index, CASE WHEN start_s < b THEN 'backwards' ELSE 'overlapping' END AS fault FROM l WHERE start_s < b OR start_s + 1.0 / 64 < b + 1")
def record_order_quality(spark, sf_dir):
    return timing.record_order(timing.record_starts(stated(spark, sf_dir))).where("fault is not null").select("path", "record_index", "fault")


@query("WITH " + STATED + "SELECT path, min(start_s) AS first_s, max(start_s + dur) AS last_s, arg_max(start_s, abs(start_s)) AS furthest_s, count(*) AS records FROM starts GROUP BY path")
def recording_span(spark, sf_dir):
    return timing.spans(timing.record_starts(stated(spark, sf_dir)))


@query("WITH " + STATED + "SELECT path, record_index FROM starts WHERE start_s + dur > 10.25 AND start_s < 20.5")
def record_pruning(spark, sf_dir):
    return timing.overlapping_records(timing.record_starts(stated(spark, sf_dir)), 10.25, 20.5).select("path", "record_index")


@query(SAMPLES + "SELECT spr, count(*) FILTER (time_s >= 10.25 - least(1e-9, 0.5 / spr) AND time_s < 20.5 - least(1e-9, 0.5 / spr)) AS n FROM samples GROUP BY spr")
def window_count_closed_form(spark, sf_dir):
    """Counted from records and rates; the SQL scans the samples."""
    from .recording import CHANNELS

    pairs = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("double").alias("start_s"), F.explode(F.lit([c[3] for c in CHANNELS])).alias("spr"))
    n = timing.rows_in_window(F.col("start_s"), F.col("spr").cast("double"), F.col("spr"), 10.25, 20.5)
    return pairs.groupBy("spr").agg(F.sum(n).alias("n"))


@query(SAMPLES + "SELECT count(*) FILTER (time_s < 12.5 - least(1e-9, 0.5 / spr)) AS left_rows, count(*) FILTER (time_s >= 12.5 - least(1e-9, 0.5 / spr)) AS right_rows, count(*) AS both_rows, CAST(0 AS BIGINT) AS difference FROM samples WHERE time_s >= 5 - least(1e-9, 0.5 / spr) AND time_s < 20 - least(1e-9, 0.5 / spr)")
def window_partition(spark, sf_dir):
    from .recording import in_window

    cols = ["record_index", "signal_index", "sample_index"]
    df = sampled(spark, sf_dir)
    left, right, both = (in_window(df, *b).select(cols) for b in ((5, 12.5), (12.5, 20), (5, 20)))
    tagged = left.withColumn("side", F.lit(0)).union(right.withColumn("side", F.lit(1))).union(both.withColumn("side", F.lit(2)))
    each = tagged.groupBy(cols).agg(*[F.count_if(F.col("side") == k).alias(f"n{k}") for k in range(3)])
    return each.agg(F.sum("n0").alias("left_rows"), F.sum("n1").alias("right_rows"), F.sum("n2").alias("both_rows"), F.sum(F.abs(F.col("n0") + F.col("n1") - F.col("n2"))).alias("difference"))


@query(SAMPLES + "SELECT record_index, signal_index, CAST(sample_index * (32 // spr) AS BIGINT) AS instant_key, row_number() OVER (PARTITION BY record_index ORDER BY sample_index * (32 // spr), signal_index) AS place, value FROM samples")
def long_layout(spark, sf_dir):
    """Rows of one long table in order: whole-number instants, so ties are exact."""
    df = sampled(spark, sf_dir).withColumn("instant_key", (F.col("sample_index") * (F.lit(32) / F.col("spr")).cast("long")).cast("long"))
    place = F.row_number().over(Window.partitionBy("record_index").orderBy("instant_key", "signal_index"))
    return df.select("record_index", "signal_index", "instant_key", place.alias("place"), "value")


@query(SAMPLES + "SELECT time_s, max(CASE WHEN signal_index = 0 THEN value END) AS eeg, max(CASE WHEN signal_index = 1 THEN value END) AS ecg, max(CASE WHEN signal_index = 2 THEN value END) AS t8 FROM samples GROUP BY time_s")
def long_to_wide_pivot(spark, sf_dir):
    wide = ordered.spread(sampled(spark, sf_dir), "time_s", "signal_index", "value", [0, 1, 2])
    return wide.select("time_s", F.col("0").alias("eeg"), F.col("1").alias("ecg"), F.col("2").alias("t8"))


@query(SAMPLES + ", f AS (SELECT CAST(floor(time_s) AS BIGINT) AS second, count(value) AS n, round(avg(value), 6) AS mean_value, round(stddev_samp(value), 6) AS sd FROM samples WHERE signal_index = 0 GROUP BY 1), g AS (SELECT CAST(floor(time_s) AS BIGINT) AS second, round(avg(value), 6) AS slow_mean FROM samples WHERE signal_index = 2 GROUP BY 1) SELECT * FROM f JOIN g USING (second)")
def per_second_stats(spark, sf_dir):
    df = sampled(spark, sf_dir).withColumn("second", F.floor("time_s").cast("long"))
    fast = df.where("signal_index = 0").groupBy("second").agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), F.round(F.stddev_samp("value"), 6).alias("sd"))
    return fast.join(df.where("signal_index = 2").groupBy("second").agg(F.round(F.avg("value"), 6).alias("slow_mean")), "second")


@query(SAMPLES + ", k AS (SELECT *, row_number() OVER (PARTITION BY signal_index ORDER BY abs(value) DESC, record_index, sample_index) AS k FROM samples WHERE value IS NOT NULL) SELECT signal_index, value AS peak, time_s FROM k WHERE k = 1")
def signed_peak(spark, sf_dir):
    first = F.max_by(F.struct("value", "time_s"), F.struct(F.abs("value"), -F.col("record_index"), -F.col("sample_index")))
    df = sampled(spark, sf_dir).where("value is not null").groupBy("signal_index").agg(first.alias("p"))
    return df.select("signal_index", F.col("p.value").alias("peak"), F.col("p.time_s").alias("time_s"))


@query(SAMPLES + "SELECT count(*) AS n, count(value) AS n_defined, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean_value FROM samples")
def global_stats(spark, sf_dir):
    return sampled(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_defined"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.avg("value"), 6).alias("mean_value"))


@query(SAMPLES + "SELECT signal_index, count(*) AS n, sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS undefined FROM samples GROUP BY 1")
def undefined_mapping(spark, sf_dir):
    return sampled(spark, sf_dir).groupBy("signal_index").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").isNull()).alias("undefined"))


def chosen(spark, sf_dir, terms):
    from .recording import channels as dims

    picked = channels.select(dims(spark), terms).select("signal_index")
    return sampled(spark, sf_dir).join(picked, "signal_index", "left_semi").select("record_index", "signal_index", "sample_index", "digital")


@query(SAMPLES + "SELECT record_index, signal_index, CAST(sample_index AS INTEGER) AS sample_index, digital FROM samples WHERE lower(label) = 't8'")
def select_by_label(spark, sf_dir):
    return chosen(spark, sf_dir, ["T8"])


@query(SAMPLES + "SELECT record_index, signal_index, CAST(sample_index AS INTEGER) AS sample_index, digital FROM samples WHERE signal_index = 1")
def select_by_position(spark, sf_dir):
    return chosen(spark, sf_dir, ["#1"])


@query(SAMPLES + "SELECT signal_index, CAST(sample_index AS INTEGER) AS sample_index, record_index, TIMESTAMP '2004-03-02 05:06:07' + to_microseconds(CAST(round(time_s * 1000000) AS BIGINT)) AS instant FROM samples WHERE signal_index < 3")
def wall_clock(spark, sf_dir):
    start = F.lit("2004-03-02 05:06:07").cast("timestamp_ntz")
    instant = text.wall_clock(start, F.col("time_s"))
    return sampled(spark, sf_dir).where("signal_index < 3").select("signal_index", "sample_index", "record_index", instant.alias("instant"))


EVENTS = f"e AS (SELECT event_id, user_id, event_type, {MICROS} AS onset_us, CASE WHEN event_type <> (SELECT min(event_type) FROM events) THEN CAST(60000000 * (1 + event_id % 5) AS BIGINT) END AS length_us FROM events) "


def events(spark, sf_dir):
    """Events as annotations: whole microseconds, and no length for one kind."""
    df = read(spark, sf_dir, "events")
    least = df.agg(F.min("event_type")).scalar()
    onset = F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000
    length = F.when(F.col("event_type") != least, F.lit(60000000) * (F.lit(1) + F.col("event_id") % 5)).cast("long")
    return df.select("event_id", "user_id", "event_type", onset.alias("onset_us"), length.alias("length_us"))


@query("WITH " + EVENTS + "SELECT a.event_id AS event_id, b.event_id AS during_id FROM e a JOIN e b ON a.user_id = b.user_id AND a.onset_us >= b.onset_us AND a.onset_us < b.onset_us + b.length_us WHERE a.event_id <> b.event_id")
def event_interval_join(spark, sf_dir):
    df = events(spark, sf_dir)
    points = df.select("event_id", "user_id", F.col("onset_us").alias("at_us"))
    spans = df.select(F.col("event_id").alias("during_id"), "user_id", F.col("onset_us").alias("from_us"), "length_us")
    return joins.covered_by(points, spans, "user_id", "at_us", "from_us", "length_us", 60e6).where("event_id <> during_id").select("event_id", "during_id")


@query("WITH " + EVENTS + ", f AS (SELECT user_id, greatest(0, min(onset_us) - 900000000) AS lo FROM e WHERE length_us IS NULL GROUP BY 1) SELECT e.user_id, count(*) AS n FROM e JOIN f USING (user_id) WHERE onset_us >= lo AND onset_us < lo + 1800000000 GROUP BY 1")
def event_window(spark, sf_dir):
    """What lies within half an hour about a user's first event of one kind."""
    df = events(spark, sf_dir)
    first = df.where("length_us is null").groupBy("user_id").agg(F.greatest(F.lit(0), F.min("onset_us") - 900000000).alias("lo"))
    return df.join(first, "user_id").where("onset_us >= lo and onset_us < lo + 1800000000").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + EVENTS + ", s AS (SELECT user_id, event_id, onset_us - lag(onset_us) OVER (PARTITION BY user_id ORDER BY onset_us) AS step FROM e), m AS (SELECT user_id, quantile_cont(CAST(step AS DOUBLE), 0.5) AS median_step FROM s GROUP BY 1) SELECT user_id, event_id, step FROM s JOIN m USING (user_id) WHERE step > 1.5 * median_step")
def gap_detect(spark, sf_dir):
    return timing.gaps(events(spark, sf_dir), "user_id", "onset_us").select("user_id", "event_id", "step")


@query("WITH " + EVENTS + "SELECT event_id, onset_us, event_type FROM e WHERE onset_us >= 86400000000 AND onset_us < 259200000000")
def annotation_filter(spark, sf_dir):
    df = events(spark, sf_dir).withColumn("onset_s", F.col("onset_us") / 1e6)
    return annotations.within(df, 86400.0, 259200.0).select("event_id", "onset_us", "event_type")


@query("WITH " + EVENTS + "SELECT 'even' AS recording, event_type, event_id FROM e WHERE user_id % 2 = 0 UNION ALL SELECT 'odd', event_type, event_id FROM e WHERE user_id % 2 = 1")
def events_union(spark, sf_dir):
    df = events(spark, sf_dir)
    parts = [df.where(F.col("user_id") % 2 == k).select(F.lit(name).alias("recording"), "event_type", "event_id") for k, name in enumerate(("even", "odd"))]
    return parts[0].unionByName(parts[1])


SIDES = "WITH " + EVENTS + ", l AS (SELECT event_id, user_id, onset_us FROM e WHERE event_id % 2 = 0), r AS (SELECT user_id, onset_us, event_id AS slow_id FROM e WHERE event_id % 2 = 1) "


def sides(spark, sf_dir):
    df = events(spark, sf_dir)
    return df.where("event_id % 2 = 0").select("event_id", "user_id", "onset_us"), df.where("event_id % 2 = 1").select("user_id", "onset_us", F.col("event_id").alias("slow_id"))


@query(SIDES + "SELECT l.event_id, CASE WHEN l.onset_us - r.onset_us <= 3600000000 THEN slow_id END AS slow_id FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.onset_us >= r.onset_us")
def asof_tolerance(spark, sf_dir):
    return joins.asof(*sides(spark, sf_dir), "user_id", "onset_us", "slow_id", tolerance=3600000000, block=86400e6).select("event_id", "slow_id")


@query(SIDES + ", b AS (SELECT l.*, r.onset_us AS bt, slow_id AS bid FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.onset_us >= r.onset_us), f AS (SELECT b.*, r.onset_us AS ft, slow_id AS fid FROM b ASOF LEFT JOIN r ON b.user_id = r.user_id AND b.onset_us <= r.onset_us) SELECT event_id, CASE WHEN ft - onset_us < onset_us - bt THEN fid ELSE coalesce(bid, fid) END AS slow_id FROM f")
def asof_nearest(spark, sf_dir):
    return joins.asof(*sides(spark, sf_dir), "user_id", "onset_us", "slow_id", direction="nearest", block=86400e6).select("event_id", "slow_id")


@query("SELECT 'signals_' || l_returnflag || '.csv' AS \"table\", printf('%s', format('{:,}', count(*) * 100)) AS rows_text FROM lineitem GROUP BY l_returnflag HAVING count(*) * 100 + 1 > 1048576")
def large_output(spark, sf_dir):
    """Tables over a spreadsheet's rows, told by the diagnostic of a plan."""
    from .operators.diagnostics import SPREADSHEET_ROWS

    n = read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg((F.count(F.lit(1)) * 100).alias("n_rows"))
    large = n.where(F.col("n_rows") + 1 > SPREADSHEET_ROWS)
    return large.select(F.concat(F.lit("signals_"), "l_returnflag", F.lit(".csv")).alias("table"), numbers.thousands(F.col("n_rows")).alias("rows_text"))


@query(SIDES + ", b AS (SELECT l.*, r.onset_us AS bt, slow_id AS bid FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.onset_us >= r.onset_us), f AS (SELECT b.*, r.onset_us AS ft, slow_id AS fid FROM b ASOF LEFT JOIN r ON b.user_id = r.user_id AND b.onset_us <= r.onset_us), c AS (SELECT event_id, onset_us, CASE WHEN ft - onset_us < onset_us - bt THEN fid ELSE coalesce(bid, fid) END AS sid, CASE WHEN ft - onset_us < onset_us - bt THEN ft ELSE coalesce(bt, ft) END AS st FROM f) SELECT event_id, CASE WHEN abs(onset_us - st) <= 1800000000 THEN sid END AS slow_id FROM c")
def asof_nearest_tolerance(spark, sf_dir):
    return joins.asof(*sides(spark, sf_dir), "user_id", "onset_us", "slow_id", tolerance=1800000000, direction="nearest", block=86400e6).select("event_id", "slow_id")


@query(SAMPLES + "SELECT record_index, signal_index, CAST(sample_index AS INTEGER) AS sample_index, time_s FROM samples WHERE time_s BETWEEN 10.25 AND 20.5")
def range_slice(spark, sf_dir):
    """Both ends belong to a slice, unlike those of a window."""
    return ordered.between(sampled(spark, sf_dir), "time_s", 10.25, 20.5).select("record_index", "signal_index", "sample_index", "time_s")


@query("WITH " + EVENTS + "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY onset_us, event_id) AS place FROM e")
def sorted_by_time(spark, sf_dir):
    """Rows in the order of their times, which they need not have been in."""
    return ordered.placed(events(spark, sf_dir), "user_id", "onset_us", "event_id").select("user_id", "event_id", "place")
