"""Queries that read, and convert, binary recordings.

The recordings are written from the packed vectors: 128 records a file, of four
channels and an annotation channel. Files take turns in being plain, continuous and
discontinuous; some lists in their slots are broken.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import DIMS, query, read
from .operators import annotations, diagnostics, timing
from .plans.convert import Recording, convert, open_recordings
from .recording import CHANNELS
from .scratch import kept, scratch
from .sinks.recordings import write_recordings
from .sinks.tables import read_table

RECORDS = 128
SIGNALS = [{"label": label, "unit": "uV", "physical_min": f"{lo:g}", "physical_max": f"{hi:g}", "digital_min": dlo, "digital_max": dhi, "samples_per_record": spr} for _, label, _, spr, lo, hi, dlo, dhi in CHANNELS]
MARKS = {"label": "EDF Annotations", "unit": "", "physical_min": "-1", "physical_max": "1", "digital_min": -32768, "digital_max": 32767, "samples_per_record": 40}
WRITTEN: dict[tuple[str, str, bool], str] = {}


def made(spark, sf_dir: str, wide: bool = False) -> str:
    """The folder of the recordings of a table, written once a session."""
    key = (spark.sparkContext.applicationId, sf_dir, wide)
    if key in WRITTEN:
        return WRITTEN[key]
    folder, n = scratch(spark, "recordings"), F.col("vec_id")
    spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(folder))
    file, record = F.floor(n / RECORDS), n % RECORDS
    text = lambda *parts: F.concat(*(p if isinstance(p, F.Column) else F.lit(p) for p in parts))
    stated = F.when(file % 3 == 1, text(record.cast("string"), ".5")).when(file % 3 == 2, text((record + 100 + 5 * F.floor(record / 50)).cast("string"))).otherwise(record.cast("string"))
    clock = F.when(n % 11 == 3, F.lit("oops")).otherwise(text("+", stated))
    length = F.when(n % 5 == 0, "").when(n % 5 == 1, "\x15-1").when(n % 5 == 2, "\x15abc").otherwise("\x152.5")
    event = text("+", record.cast("string"), ".25", length, "\x14note ", (n % 7).cast("string"), F.when(n % 13 == 5, "\x14é").otherwise(""), "\x14\x00")
    slot = text(clock, "\x14\x14\x00", event, F.when(n % 17 == 4, "bad\x14lost\x14\x00").otherwise(""))
    codes = F.transform("embedding", lambda x: F.floor(x.cast("double") * 2048).cast("int") * (1000 if wide else 1))
    rows = read(spark, sf_dir, "embeddings").select(
        F.concat(F.lit(folder + "/rec"), F.lpad(file.cast("string"), 4, "0"), F.lit(".bdf" if wide else ".edf")).alias("path"),
        record.alias("record_index"),
        codes.alias("codes"),
        F.encode(slot, "ISO-8859-1").alias("slot"),
        F.lit("").alias("reserved") if wide else F.when(file % 3 == 1, "EDF+C").when(file % 3 == 2, "EDF+D").otherwise("").alias("reserved"),
    )
    write_recordings(rows, SIGNALS if wide else [*SIGNALS, MARKS], wide=wide, recording="Startdate 02-MAR-2004 X").write.format("noop").mode("overwrite").save()
    WRITTEN[key] = folder
    return folder


def found(spark, sf_dir: str, wide: bool = False) -> Recording:
    return open_recordings(spark, made(spark, sf_dir, wide))


def file_of(name: str = "path") -> F.Column:
    return F.regexp_extract(name, r"rec(\d+)", 1).cast("long")


FILES = f"""WITH v AS (SELECT vec_id, vec_id // {RECORDS} AS file, vec_id % {RECORDS} AS r, embedding FROM embeddings),
st AS (SELECT vec_id, file, r, CASE WHEN vec_id % 11 = 3 THEN NULL WHEN file % 3 = 1 THEN r + 0.5 WHEN file % 3 = 2 THEN r + 100 + 5 * (r // 50) ELSE r END AS declared FROM v),
og AS (SELECT file, arg_min(declared - r, r) FILTER (declared IS NOT NULL AND r < 16) AS origin FROM st GROUP BY file),
starts AS (SELECT vec_id, st.file AS file, r, CAST(declared AS DOUBLE) AS declared_s, CAST(CASE WHEN st.file % 3 = 0 THEN r WHEN st.file % 3 = 1 THEN origin + r ELSE coalesce(declared, origin + r) END AS DOUBLE) AS start_s FROM st JOIN og ON st.file = og.file),
u AS (SELECT vec_id, file, r, unnest(embedding) AS code, unnest(range(64)) AS slot FROM v),
samples AS (SELECT u.file AS file, u.r AS record_index, signal_index, label, spr, slot - first_slot AS sample_index, start_s + (slot - first_slot) / CAST(spr AS DOUBLE) AS time_s, CAST(floor(CAST(code AS DOUBLE) * 2048) AS INTEGER) AS digital, dmin, dmax, pmin, pmax
FROM u JOIN starts s ON s.vec_id = u.vec_id JOIN {DIMS} ON slot >= first_slot AND slot < first_slot + spr),
valued AS (SELECT *, CASE WHEN dmax <> dmin THEN ((pmax - pmin) / (dmax - dmin)) * (pmax / ((pmax - pmin) / (dmax - dmin)) - dmax + digital) END AS value FROM samples),
ev AS (SELECT file, vec_id, r AS record_index, r + 0.25 AS onset_s, CASE WHEN vec_id % 5 = 1 THEN -1.0 WHEN vec_id % 5 > 2 THEN 2.5 END AS duration_s, vec_id % 5 = 2 AS unreadable, unnest(CASE WHEN vec_id % 13 = 5 THEN ['note ' || (vec_id % 7), 'é'] ELSE ['note ' || (vec_id % 7)] END) AS description FROM v) """
NAMES = {0: "EEG", 1: "ECG", 2: "T8_ch2", 3: "T8_ch3"}


@query(FILES + "SELECT file, count(*) AS data_records, 208 * count(*) + 1536 AS bytes, CASE file % 3 WHEN 0 THEN 'EDF' WHEN 1 THEN 'EDF+ (continuous)' ELSE 'EDF+ (discontinuous)' END AS format, TIMESTAMP '2004-03-02 05:06:07' AS start_datetime, CAST(count(*) AS DOUBLE) AS duration_seconds FROM v GROUP BY file")
def source_recordings(spark, sf_dir):
    c = F.col
    return found(spark, sf_dir).recordings.select(file_of().alias("file"), "data_records", "bytes", "format", c("start_datetime"), "duration_seconds")


@query(FILES + f"SELECT file, signal_index, label, label || CASE WHEN label = 'T8' THEN '_ch' || signal_index ELSE '' END AS column_name, CAST(spr AS DOUBLE) AS rate_hz, pmin AS physical_min, pmax AS physical_max, CAST(dmin AS BIGINT) AS digital_min, CAST(dmax AS BIGINT) AS digital_max FROM (SELECT DISTINCT file FROM v) CROSS JOIN (SELECT * FROM {DIMS})")
def source_channels(spark, sf_dir):
    return found(spark, sf_dir).channels.where("not is_annotations").select(file_of().alias("file"), "signal_index", "label", "column_name", "rate_hz", "physical_min", "physical_max", "digital_min", "digital_max")


@query(FILES + "SELECT file, record_index, signal_index, CAST(sample_index AS INTEGER) AS sample_index, time_s, digital, value FROM valued")
def source_samples(spark, sf_dir):
    return found(spark, sf_dir).samples().select(file_of().alias("file"), "record_index", "signal_index", "sample_index", "time_s", "digital", "value")


@query(FILES.replace("* 2048) AS INTEGER)", "* 2048) AS INTEGER) * 1000") + "SELECT file, record_index, signal_index, CAST(sample_index AS INTEGER) AS sample_index, digital FROM samples")
def source_samples_24(spark, sf_dir):
    """Three bytes a sample, in slices of five samples and of small parts of files."""
    folder = made(spark, sf_dir, wide=True)
    return Recording.samples(open_recordings(spark, folder), sliceSamples=5, sliceBytes=5000).select(file_of().alias("file"), "record_index", "signal_index", "sample_index", "digital")


@query(FILES + "SELECT file, record_index, signal_index, CAST(sample_index AS INTEGER) AS sample_index, time_s, digital FROM samples WHERE signal_index > 0 AND time_s >= 10.25 - 1e-9 AND time_s < 120.5 - 1e-9")
def source_window(spark, sf_dir):
    """Chosen channels and records alone are read."""
    return found(spark, sf_dir).samples(["t8", "#1"], 10.25, 120.5).select(file_of().alias("file"), "record_index", "signal_index", "sample_index", "time_s", "digital")


@query(FILES + "SELECT file, r AS record_index, declared_s, start_s FROM starts")
def source_starts(spark, sf_dir):
    return found(spark, sf_dir).starts.select(file_of().alias("file"), "record_index", "declared_s", "start_s")


@query(FILES + "SELECT file, record_index, CAST(onset_s AS DOUBLE) AS onset_s, CAST(duration_s AS DOUBLE) AS duration_s, description, unreadable AS duration_unreadable FROM ev")
def source_events(spark, sf_dir):
    return found(spark, sf_dir).events().select(file_of().alias("file"), "record_index", "onset_s", "duration_s", "description", "duration_unreadable")


@query(FILES + "SELECT file, row_number() OVER (PARTITION BY file ORDER BY onset_s, record_index, CASE WHEN description = 'é' THEN 1 ELSE 0 END) AS place, record_index, description FROM ev WHERE onset_s >= 3.25 AND onset_s < 60")
def source_event_order(spark, sf_dir):
    """Events of a window in their order; ties stand as they stand in the slot."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("path").orderBy(*annotations.ORDER))
    return found(spark, sf_dir).events(3.25, 60).select(file_of().alias("file"), place.alias("place"), "record_index", "description")


@query(FILES + "SELECT file, count(*) FILTER (vec_id % 17 = 4) AS malformed, count(*) FILTER (vec_id % 11 = 3) AS lost_starts, CAST(sum(CASE WHEN vec_id % 5 = 2 THEN CASE WHEN vec_id % 13 = 5 THEN 2 ELSE 1 END ELSE 0 END) AS BIGINT) AS unreadable_durations, CAST(sum(CASE WHEN vec_id % 5 = 1 THEN CASE WHEN vec_id % 13 = 5 THEN 2 ELSE 1 END ELSE 0 END) AS BIGINT) AS negative_durations FROM v GROUP BY file")
def source_event_faults(spark, sf_dir):
    rows = annotations.decode_faults(found(spark, sf_dir).slots)
    return rows.select(file_of().alias("file"), "malformed", "lost_starts", "unreadable_durations", "negative_durations")


@query(FILES + ", p AS (SELECT file, CASE WHEN count(*) FILTER (vec_id % 17 = 4) > 0 THEN 1 ELSE 0 END AS bad, CASE WHEN count(*) FILTER (vec_id % 11 = 3) > 0 THEN 1 ELSE 0 END AS lost, CASE WHEN count(*) FILTER (vec_id % 11 = 3 AND r >= 50) > 0 THEN 2 ELSE 1 END AS back FROM v GROUP BY file) SELECT * FROM (SELECT file, code, CAST(n AS BIGINT) AS n FROM (SELECT file, 'DEGENERATE_DIGITAL_RANGE' AS code, 1 AS n FROM p UNION ALL SELECT file, 'INVERTED_PHYSICAL_RANGE', 1 FROM p UNION ALL SELECT file, 'DUPLICATE_LABEL', 1 FROM p UNION ALL SELECT file, 'MIXED_SAMPLING_RATES', 1 FROM p UNION ALL SELECT file, 'DISCONTINUOUS', back FROM p WHERE file % 3 = 2 UNION ALL SELECT file, 'ANNOTATION_DECODE_FAILED', bad + lost FROM p) WHERE n > 0)")
def source_diagnostics(spark, sf_dir):
    rows = found(spark, sf_dir).diagnostics()  # those of discontinuous files overlap where a start is lost
    return rows.groupBy(file_of().alias("file"), "code").agg(F.count(F.lit(1)).alias("n"))


@query(FILES + "SELECT file, min(start_s) AS first_s, max(start_s + 1) AS last_s, arg_max(start_s, abs(start_s)) AS furthest_s, count(*) AS records FROM starts GROUP BY file")
def source_spans(spark, sf_dir):
    return timing.spans(found(spark, sf_dir).starts).select(file_of().alias("file"), "first_s", "last_s", "furthest_s", "records")


@query(FILES + "SELECT file, spr AS samples_per_record, count(*) // count(DISTINCT signal_index) AS n_rows FROM (SELECT file, signal_index, spr, time_s FROM samples) WHERE time_s >= 20.5 - 1e-9 AND time_s < 110 - 1e-9 GROUP BY file, spr")
def planned_rows(spark, sf_dir):
    """Rows of each table, counted from headers and record starts; the SQL counts samples."""
    rec = found(spark, sf_dir)
    usable = rec.windows(20.5, 110).where("fault is null")
    return rec.rate_groups(windows=usable).where("n_rows > 0").select(file_of().alias("file"), F.col("samples_per_record").cast("int").alias("samples_per_record"), "n_rows")


@query(FILES + ", s AS (SELECT file, min(start_s) AS a, max(start_s + 1) AS b FROM starts GROUP BY file) SELECT file, CAST(60 AS DOUBLE) AS start_seconds, least(CAST(90 AS DOUBLE), b) AS end_seconds, 60 <= a AND b <= 90 AS whole_recording, CASE WHEN b <= 60 THEN 'starts at or past the end' END AS fault FROM s")
def planned_windows(spark, sf_dir):
    return found(spark, sf_dir).windows(60, duration=30).select(file_of().alias("file"), "start_seconds", "end_seconds", "whole_recording", "fault")


CONVERTED: dict[tuple, tuple] = {}


def converted(spark, sf_dir: str, **options):
    """(folder, what convert returned), once a session and set of options."""
    key = (spark.sparkContext.applicationId, sf_dir, *sorted((k, str(v)) for k, v in options.items()))
    if key not in CONVERTED:
        out = scratch(spark, "converted")
        CONVERTED[key] = (out, convert(spark, made(spark, sf_dir), out, **options))
    return CONVERTED[key]


def texts(spark, folder: str, table: str, schema: str) -> DataFrame:
    """All recordings' tables of a name as text, as they were printed."""
    rows = spark.read.schema(schema).option("header", "true").option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(f"{folder}/*/{table}")
    return rows.withColumn("file", file_of("path") if "path" in rows.columns else file_of_input())


def file_of_input() -> F.Column:
    return F.regexp_extract(F.input_file_name(), r"rec(\d+)_csv", 1).cast("long")


TEXT = "CASE WHEN regexp_matches({0}, '^-0\\.?0*$') THEN {0}[2:] ELSE {0} END"
PRINTED = "printf('%.{0}f', {1})"


@query(FILES + f"SELECT file, {PRINTED.format(3, 'time_s')} AS time_s, max({TEXT.format(PRINTED.format(4, 'value'))}) FILTER (signal_index = 2) AS t8_2, max(CASE WHEN value IS NOT NULL THEN {PRINTED.format(3, 'value')} END) FILTER (signal_index = 3) AS t8_3 FROM valued WHERE spr = 8 GROUP BY file, record_index, sample_index, time_s")
def convert_wide(spark, sf_dir):
    """The printed cells of the table of one rate, read back."""
    out, _ = converted(spark, sf_dir)
    return texts(spark, out, "signals_8hz.csv", "time_s string, t8_2 string, t8_3 string")


@query(FILES + f"SELECT file, channel, count(*) AS n, count(value) AS n_values, min(time_s) AS first, max(time_s) AS last, round(sum(value), 6) AS total FROM (SELECT file, CASE signal_index WHEN 0 THEN 'EEG' WHEN 1 THEN 'ECG' ELSE 'T8_ch' || signal_index END AS channel, {PRINTED.format(5, 'time_s')} AS time_s, round(value, 3) AS value FROM valued WHERE signal_index <> 1 AND time_s >= 5 - 1e-9 AND time_s < 101.5 - 1e-9) GROUP BY file, channel")
def convert_long(spark, sf_dir):
    """A window of three channels as one long table; times share the finest precision."""
    out, _ = converted(spark, sf_dir, layout="long", terms=["EEG", "T8"], start=5.0, end=101.5, decimals=3, gzip=True)
    rows = texts(spark, out, "signals.csv.gz", "time_s string, channel string, value string")
    value = F.col("value").try_cast("double")
    return rows.groupBy("file", "channel").agg(F.count(F.lit(1)).alias("n"), F.count(value).alias("n_values"), F.min("time_s").alias("first"), F.max("time_s").alias("last"), F.round(F.sum(value), 6).alias("total"))


@query(FILES + "SELECT file, regexp_replace(CAST(CAST(onset_s AS DOUBLE) AS VARCHAR), '\\.0$', '') AS onset_s, regexp_replace(CAST(CAST(duration_s AS DOUBLE) AS VARCHAR), '\\.0$', '') AS duration_s, description, CAST(record_index AS VARCHAR) AS record_index FROM ev")
def convert_annotations(spark, sf_dir):
    out, _ = converted(spark, sf_dir)
    return texts(spark, out, "annotations.csv", "onset_s string, duration_s string, description string, record_index string")


@query(FILES + f"SELECT file, label || CASE WHEN label = 'T8' THEN '_ch' || signal_index ELSE '' END AS \"column\", CAST(signal_index AS VARCHAR) AS signal_index, label, 'uV' AS unit, CAST(spr AS VARCHAR) AS sampling_rate_hz, CAST(spr AS VARCHAR) AS samples_per_record, CAST(CAST(pmin AS BIGINT) AS VARCHAR) AS physical_min, CAST(CAST(pmax AS BIGINT) AS VARCHAR) AS physical_max, CAST(dmin AS VARCHAR) AS digital_min, CAST(dmax AS VARCHAR) AS digital_max, CASE WHEN signal_index = 1 THEN NULL ELSE 'signals.csv.gz' END AS output_file, CASE WHEN signal_index = 1 THEN 'no' ELSE 'yes' END AS converted FROM (SELECT DISTINCT file FROM v) CROSS JOIN (SELECT * FROM {DIMS})")
def convert_channels(spark, sf_dir):
    """All channels are described, with the table of those that were chosen."""
    out, _ = converted(spark, sf_dir, layout="long", terms=["EEG", "T8"], start=5.0, end=101.5, decimals=3, gzip=True)
    names = "column signal_index label unit sampling_rate_hz samples_per_record physical_min physical_max digital_min digital_max transducer prefiltering output_file converted".split()
    return texts(spark, out, "channels.csv.gz", ", ".join(f"{n} string" for n in names)).drop("transducer", "prefiltering")


@query(FILES + "SELECT file, t AS \"table\", CAST(n AS BIGINT) AS n_rows FROM (SELECT file, 'annotations.csv' AS t, count(*) AS n FROM ev GROUP BY file UNION ALL SELECT file, 'signals_' || spr || 'hz.csv', count(*) * spr FROM v CROSS JOIN (SELECT unnest([8, 16, 32]) AS spr) GROUP BY file, spr UNION ALL SELECT DISTINCT file, 'channels.csv', 4 FROM v UNION ALL SELECT DISTINCT file, 'metadata.json', NULL FROM v)")
def convert_files(spark, sf_dir):
    _, done = converted(spark, sf_dir)
    return done.files.select(F.regexp_extract("recording", r"rec(\d+)", 1).cast("long").alias("file"), "table", "n_rows")


@query(FILES + ", s AS (SELECT file, min(start_s) AS a, max(start_s + 1) AS b, count(*) AS n FROM starts GROUP BY file), e AS (SELECT file, count(*) AS n_events FROM ev GROUP BY file) SELECT s.file AS file, n AS data_records, CAST(a AS DOUBLE) AS start_seconds, b AS end_seconds, true AS whole_recording, n_events AS annotations_written, CAST(3 AS BIGINT) AS rates, 'EEG' AS fastest FROM s JOIN e ON s.file = e.file")
def convert_metadata(spark, sf_dir):
    out, _ = converted(spark, sf_dir)
    schema = "recording struct<data_records:long>, conversion struct<start_seconds:double,end_seconds:double,whole_recording:boolean,annotations_written:long,rate_groups:array<struct<channels:array<string>>>>"
    rows = spark.read.text(f"{out}/*/metadata.json", wholetext=True).select(file_of_input().alias("file"), F.from_json("value", schema).alias("m"))
    return rows.select("file", "m.recording.data_records", "m.conversion.start_seconds", "m.conversion.end_seconds", "m.conversion.whole_recording", "m.conversion.annotations_written", F.size("m.conversion.rate_groups").cast("long").alias("rates"), F.col("m.conversion.rate_groups")[0]["channels"][0].alias("fastest"))


@query(FILES + "SELECT file, code, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT file, 'MIXED_SAMPLING_RATES' AS code FROM v UNION ALL SELECT file, 'ANNOTATION_DECODE_FAILED' FROM ev WHERE duration_s < 0 GROUP BY file UNION ALL SELECT file, 'ANNOTATION_DECODE_FAILED' FROM ev WHERE unreadable GROUP BY file) GROUP BY file, code")
def plan_diagnostics(spark, sf_dir):
    """What is to note of a conversion of everything. Its notes read channels, windows and
    groups many times, so these are written once, which keeps the plan small."""
    from .plans.convert import with_tables

    rec = found(spark, sf_dir)
    rec = replace(rec, channels=kept(rec.channels, "channels"), runs=kept(rec.runs, "runs"))
    windows = kept(rec.windows(), "windows")
    groups = kept(with_tables(rec.rate_groups(windows=windows), "wide", ".csv"), "groups")
    rows = diagnostics.of_plan(rec.channels, groups, windows, rec.recordings, rec.events())
    return rows.groupBy(file_of().alias("file"), "code").agg(F.count(F.lit(1)).alias("n"))


@query(FILES + "SELECT file, count(*) AS n, round(avg(value), 6) AS mean_value, max(abs(value)) AS peak FROM (SELECT file, round(value, 3) AS value FROM valued WHERE signal_index = 0) GROUP BY file")
def scan_outputs(spark, sf_dir):
    """Written tables read back with their types; only a channel's column is read."""
    out, _ = converted(spark, sf_dir)
    rows = read_table(spark, f"{out}/*/signals_32hz.csv").select(file_of_input().alias("file"), F.round("EEG", 3).alias("value"))
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), F.max(F.abs("value")).alias("peak"))


@query(FILES + "SELECT CAST(count(DISTINCT file) AS BIGINT) AS recordings, CAST(count(*) * 56 AS BIGINT) AS n_rows, '8,16,32' AS rates FROM v")
def folder_totals(spark, sf_dir):
    """Row sums and rates over a folder of summaries."""
    out, _ = converted(spark, sf_dir)
    schema = "conversion struct<rate_groups:array<struct<sampling_rate_hz:double,n_rows:long>>>"
    rows = spark.read.text(f"{out}/*/metadata.json", wholetext=True).select(F.from_json("value", schema).alias("m"))
    groups = F.col("m.conversion.rate_groups")
    each = rows.agg(F.count(F.lit(1)).alias("recordings"), F.sum(F.aggregate(groups["n_rows"], F.lit(0).cast("long"), lambda a, x: a + x)).alias("n_rows"), F.array_distinct(F.flatten(F.collect_set(F.transform(groups["sampling_rate_hz"], lambda x: x.cast("int"))))).alias("rates"))
    return each.withColumn("rates", F.array_join(F.transform(F.array_sort("rates"), lambda x: x.cast("string")), ","))


@query(FILES + "SELECT file, count(*) AS n, round(sum(value), 6) AS total, min(time_s) AS first, max(time_s) AS last FROM valued WHERE time_s >= 20 AND time_s < 110.25 AND signal_index = 2 GROUP BY file")
def sql_window(spark, sf_dir):
    """Plain SQL on a view; its filters choose the records and slots that are read."""
    found(spark, sf_dir).views()
    rows = spark.sql("SELECT path, count(*) AS n, round(sum(value), 6) AS total, min(time_s) AS first, max(time_s) AS last FROM samples WHERE time_s >= 20 AND time_s < 110.25 AND signal_index = 2 GROUP BY path")
    return rows.withColumn("file", file_of()).drop("path")


@query(FILES + "SELECT file, record_index, CAST(onset_s AS DOUBLE) AS onset_s, CAST(duration_s AS DOUBLE) AS duration_s, description, unreadable AS duration_unreadable FROM ev WHERE record_index < 100")
def sql_tal_decode(spark, sf_dir):
    """Lists of the slots by a table function in SQL."""
    found(spark, sf_dir).views()
    rows = spark.sql("SELECT s.path, s.record_index, t.onset_s, t.duration_s, t.description, t.duration_unreadable FROM annotation_slots s, LATERAL tal_decode(s.slot) t WHERE s.record_index < 100")
    return rows.withColumn("file", file_of()).drop("path")


@query(FILES + "SELECT file, signal_index, count(value) AS n_values, round(sum(value), 6) AS total, count(DISTINCT CAST(floor(time_s / 30) AS BIGINT)) AS epochs FROM valued GROUP BY file, signal_index")
def sql_calibration(spark, sf_dir):
    """Physical values and epochs by functions in SQL, over packed rows."""
    rec = found(spark, sf_dir)
    rec.views()
    rec.packed().createOrReplaceTempView("packed")
    rows = spark.sql("SELECT path, signal_index, count(v) AS n_values, round(sum(v), 6) AS total, count(DISTINCT e) AS epochs FROM (SELECT path, signal_index, physical_value(d.code, physical_min, physical_max, digital_min, digital_max) AS v, epoch_of(start_s + d.at / rate_hz, 30) AS e FROM (SELECT *, posexplode(digital) AS (at, code) FROM packed) d) GROUP BY path, signal_index")
    return rows.withColumn("file", file_of()).drop("path")


@query(FILES + "SELECT file, count(*) AS records, min(start_s) AS first_s, max(start_s + 1) AS last_s, CASE WHEN file % 3 = 2 THEN NULL ELSE CAST(1 AS BIGINT) END AS runs FROM starts GROUP BY file")
def source_runs(spark, sf_dir):
    """Runs of records; a recording without gaps is one, told by its header."""
    from .operators.timing import run_spans

    rec = found(spark, sf_dir)
    counts = rec.runs.groupBy("path").agg(F.sum("records").alias("records"), F.max(F.coalesce(F.col("continuity").endswith("D"), F.lit(False))).alias("gaps"), F.count(F.lit(1)).alias("n"))
    return run_spans(rec.runs).join(counts, "path").select(file_of().alias("file"), "records", "first_s", "last_s", F.when(~F.col("gaps"), F.col("n")).alias("runs"))


@query(FILES + "SELECT file, signal_index, count(*) AS n, CAST(sum(digital) AS BIGINT) AS total, count(DISTINCT record_index) AS records FROM samples GROUP BY file, signal_index")
def source_growing(spark, sf_dir):
    """The recordings as a stream of whole records, in batches until there are no more."""
    from .sources.binary import read_growing

    folder, out = made(spark, sf_dir), scratch(spark, "growing")
    stream = read_growing(spark, folder, "values").writeStream.format("parquet").option("checkpointLocation", scratch(spark, "growing-offsets")).trigger(availableNow=True).start(out)
    stream.awaitTermination()
    rows = spark.read.parquet(out)
    return rows.groupBy(file_of().alias("file"), "signal_index").agg(F.count(F.lit(1)).alias("n"), F.sum("digital").alias("total"), F.count_distinct("record_index").alias("records"))


@query(FILES + f"SELECT file, 'night' || half AS folder, \"table\", n_lines, CAST(1 AS BIGINT) AS headers, CAST(1 AS BIGINT) AS files FROM (SELECT file, unnest([1, 2]) AS half, 'signals_' || spr || 'hz.csv' AS \"table\", 1 + count(*) AS n_lines FROM samples WHERE signal_index IN (SELECT min(signal_index) FROM {DIMS} GROUP BY spr) GROUP BY file, spr)")
def convert_folders(spark, sf_dir):
    """Recordings of the same names in two folders; each table is one file with one header."""
    from .sources.files import copied_tree

    key = (spark.sparkContext.applicationId, sf_dir, "folders")
    if key not in CONVERTED:
        study, out = scratch(spark, "study"), scratch(spark, "converted")
        for night in ("night1", "night2"):
            copied_tree(spark, made(spark, sf_dir), f"{study}/{night}")
        CONVERTED[key] = (out, convert(spark, study, out))
    rows = spark.read.text(f"{CONVERTED[key][0]}/*/*/signals_*.csv").select("value", F.input_file_name().alias("name"))
    parts = [F.regexp_extract("name", r"/(night\d)/rec(\d+)_csv/([^/]+)$", k) for k in (1, 2, 3)]
    return rows.groupBy(parts[1].cast("long").alias("file"), parts[0].alias("folder"), parts[2].alias("table")).agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.startswith("value", F.lit("time_s"))).alias("headers"), F.count_distinct("name").alias("files"))


@query(FILES + "SELECT s.file AS file, t AS \"table\", CAST(n AS BIGINT) AS n_rows, true AS bound_holds, true AS bound_is_near FROM (SELECT DISTINCT file FROM v) s JOIN (SELECT file, 'signals_' || spr || 'hz.csv' AS t, count(*) * spr AS n FROM v CROSS JOIN (SELECT unnest([8, 16, 32]) AS spr) GROUP BY file, spr) p ON p.file = s.file")
def convert_sizes(spark, sf_dir):
    """Bytes at most, told before a conversion, against those that tasks wrote."""
    from .plans.convert import with_tables

    _, done = converted(spark, sf_dir)
    rec = found(spark, sf_dir)
    planned = with_tables(rec.rate_groups(), "wide", ".csv").select(file_of().alias("file"), "table", "bytes_at_most")
    wrote = done.files.select(F.regexp_extract("recording", r"rec(\d+)", 1).cast("long").alias("file"), "table", "n_rows", "bytes")
    size = F.col("bytes")
    return planned.join(wrote, ["file", "table"]).select("file", "table", "n_rows", (F.col("bytes_at_most") >= size).alias("bound_holds"), (F.col("bytes_at_most") <= size * 1.75).alias("bound_is_near"))


@query(FILES + "SELECT v.file AS file, data_records, 4 AS channels, n_events, n_descriptions, CAST(56 AS BIGINT) * data_records AS n_rows, CASE v.file % 3 WHEN 0 THEN 'EDF' WHEN 1 THEN 'EDF+ (continuous)' ELSE 'EDF+ (discontinuous)' END AS format FROM (SELECT file, count(*) AS data_records FROM v GROUP BY 1) v JOIN (SELECT file, count(*) AS n_events, count(DISTINCT description) AS n_descriptions FROM ev GROUP BY 1) e ON e.file = v.file")
def survey(spark, sf_dir):
    """What recordings hold and what a conversion would write."""
    from .plans.survey import survey as surveyed

    rows = surveyed(spark, made(spark, sf_dir))
    n_rows = F.aggregate("tables", F.lit(0).cast("long"), lambda n, t: n + t.n_rows)
    return rows.select(file_of().alias("file"), "data_records", F.size("channels").alias("channels"), "n_events", "n_descriptions", n_rows.alias("n_rows"), "format")


HINTED = "CASE code " + " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in diagnostics.HINTS.items()) + " END"


@query(FILES + f", p AS (SELECT file, CASE WHEN count(*) FILTER (vec_id % 17 = 4) > 0 THEN 1 ELSE 0 END AS bad, CASE WHEN count(*) FILTER (vec_id % 11 = 3) > 0 THEN 1 ELSE 0 END AS lost, CASE WHEN count(*) FILTER (vec_id % 11 = 3 AND r >= 50) > 0 THEN 2 ELSE 1 END AS back, CASE WHEN count(*) FILTER (vec_id % 5 = 1) > 0 THEN 1 ELSE 0 END + CASE WHEN count(*) FILTER (vec_id % 5 = 2) > 0 THEN 1 ELSE 0 END AS odd FROM v GROUP BY file), n AS (SELECT file, 0 AS stage, 'DEGENERATE_DIGITAL_RANGE' AS code, 1 AS n FROM p UNION ALL SELECT file, 0, 'INVERTED_PHYSICAL_RANGE', 1 FROM p UNION ALL SELECT file, 0, 'DUPLICATE_LABEL', 1 FROM p UNION ALL SELECT file, 0, 'DISCONTINUOUS', back FROM p WHERE file % 3 = 2 UNION ALL SELECT file, 0, 'ANNOTATION_DECODE_FAILED', bad + lost FROM p UNION ALL SELECT file, 1, 'MIXED_SAMPLING_RATES', 1 FROM p UNION ALL SELECT file, 1, 'ANNOTATION_DECODE_FAILED', odd FROM p) SELECT file, stage, code, CAST(n AS BIGINT) AS n, {HINTED} AS hint FROM n WHERE n > 0")
def convert_notes(spark, sf_dir):
    """What a conversion tells, in its order, with what to do about it."""
    _, done = converted(spark, sf_dir)
    return done.diagnostics.groupBy(file_of().alias("file"), "stage", "code", "hint").agg(F.count(F.lit(1)).alias("n"))
