"""What is wrong with recordings, as rows (path, code, severity, message).

Each code is a filter over headers, channels or record starts; a union of
narrow scans of small tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import can_carry, clamped, quantization_step, thousands
from ..functions.text import date_mismatch, has_control, start_datetime, starts_formula
from . import channels as channel_ops
from .annotations import decode_faults
from .timing import contradicts

#: Rows that spreadsheets open, with the header.
SPREADSHEET_ROWS = 1_048_576
TEXT_FIELDS = ("label", "unit", "transducer", "prefiltering")


def rows(df: DataFrame, code: str, severity: str, where: Column, *message) -> DataFrame:
    parts = [m if isinstance(m, Column) else F.lit(m) for m in message]
    return df.where(where).select("path", F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.concat_ws(" ", *parts).alias("message"))


def notes(df: DataFrame, *found: tuple) -> DataFrame:
    """Rows of several codes, each (code, severity, where, *message), from one scan of ``df``."""
    each = []
    for code, severity, where, *message in found:
        parts = [m if isinstance(m, Column) else F.lit(m) for m in message]
        each.append(F.when(where, F.struct((code if isinstance(code, Column) else F.lit(code)).alias("code"), (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"), F.concat_ws(" ", *parts).alias("message"))))
    return df.select("path", F.explode(F.array_compact(F.array(*each))).alias("n")).select("path", "n.code", "n.severity", "n.message")


#: What to do about a note; those that tell all there is to do have no hint.
HINTS = {
    "ANNOTATION_DECODE_FAILED": "Look at the recording's slots for what these lists hold; all other events were read.",
    "COMMA_DECIMAL": "The commas were read as points; check the channels' ranges.",
    "DEGENERATE_DIGITAL_RANGE": "No value can be told from such codes; the channel's cells stay empty.",
    "DEGENERATE_PHYSICAL_RANGE": "All codes stand for one value, which fills the channel's column.",
    "DISCONTINUOUS": "Rows keep the time that each record states, so steps in time are gaps, not lost rows.",
    "DUPLICATE_LABEL": "Choose such a channel by its position, such as #0.",
    "EMPTY_LABEL": "The column is named by the channel's position.",
    "EMPTY_WINDOW": "Times count from the recording's own origin; ask for a survey to see its span.",
    "FORMULA_LABEL": "A spreadsheet may take such a text for a formula; import the column as text.",
    "HEADER_BYTES_MISMATCH": "The length was taken from the number of signals.",
    "INPUT_CHANGED": "Convert again once the recording is finished.",
    "INVERTED_PHYSICAL_RANGE": "Values were turned as the header says; compare with the device's manual.",
    "LARGE_OUTPUT": "Choose channels or a window, or read the table with something other than a spreadsheet.",
    "MISSING_EDF_PLUS_MARKER": "The recording was timed from zero; its events stand as they are stated.",
    "MIXED_SAMPLING_RATES": "Each rate has a table of its own; the long layout puts all into one.",
    "NONPRINTABLE_LABEL": "The text is written as it is; tools may show it in another way.",
    "NO_ANNOTATIONS": "The recording has no channel of events.",
    "NO_SIGNAL_CHANNELS": "Ask for the events alone.",
    "NO_SAMPLES": "The chosen channels hold no samples.",
    "RECORD_COUNT_MISMATCH": "All whole records in the file were read.",
    "RECORD_COUNT_UNKNOWN": "The recording may still be growing; all whole records were read.",
    "STALE_OUTPUT": "Delete it, or convert into a new folder.",
    "START_DATE_MISMATCH": "The start date field was used.",
    "START_TIME_UNREADABLE": "Times count from the first record in any case.",
    "STDOUT_UNSUPPORTED": "Choose channels of one rate, or the long layout.",
    "TIME_RESOLUTION": "Use the row's place, not its time, to tell such rows apart.",
    "TRAILING_BYTES": "A part of a record at the end was left out.",
    "UNREADABLE": "Check that the file is a whole recording.",
    "UNUSABLE_PHYSICAL_RANGE": "The channel's cells stay empty; its codes are in the samples view.",
    "VALUE_RESOLUTION": "Ask for more decimals, or read codes and calibration instead.",
    "WINDOW": "Times count from the recording's own origin; ask for a survey to see its span.",
}


def in_order(*found: DataFrame) -> DataFrame:
    """The notes of each stage (of headers, of the plan, of what was found later), with ``stage``,
    their place in the list, and ``hint``."""
    hint = F.create_map(*(F.lit(x) for pair in HINTS.items() for x in pair))[F.col("code")]
    staged = [df.select("path", F.lit(k).alias("stage"), "code", "severity", "message", hint.alias("hint")) for k, df in enumerate(found)]
    return reduce(DataFrame.unionByName, staged)


def any_of(test) -> Column:
    return reduce(lambda a, b: a | b, [test(F.col(c)) for c in TEXT_FIELDS])


def calibration_fault() -> Column:
    """The first fault of a channel's calibration; NULL where there is none."""
    physical, digital = F.col("physical_max") - F.col("physical_min"), F.col("digital_max") - F.col("digital_min")
    gain = F.try_divide(physical, digital.cast("double"))
    unusable = ~(F.abs(physical) < float("inf")) | ((physical != 0) & (gain == 0))
    return F.when(unusable, "UNUSABLE_PHYSICAL_RANGE").when(digital == 0, "DEGENERATE_DIGITAL_RANGE").when(physical == 0, "DEGENERATE_PHYSICAL_RANGE").when((physical < 0) != (digital < 0), "INVERTED_PHYSICAL_RANGE")


def of_recordings(recordings: DataFrame) -> list[DataFrame]:
    c = F.col
    start = start_datetime(c("start_date_raw"), c("start_time_raw"), c("recording_id"))
    readable = recordings.where("error is null")
    return [
        rows(recordings, "UNREADABLE", "error", c("error").isNotNull(), c("error")),
        notes(
            readable,
            ("HEADER_BYTES_MISMATCH", "warning", c("declared_header_bytes") != c("header_bytes"), "header states", c("declared_header_bytes"), "bytes and has", c("header_bytes")),
            ("COMMA_DECIMAL", "warning", c("comma_decimal"), "numbers written with a comma"),
            ("RECORD_COUNT_UNKNOWN", "info", c("data_records_declared") == -1, "record count left open; found", c("data_records")),
            ("RECORD_COUNT_MISMATCH", "warning", (c("data_records_declared") != -1) & (c("data_records_declared") != c("data_records")), "stated", c("data_records_declared"), "records, found", c("data_records")),
            ("TRAILING_BYTES", "warning", c("trailing_bytes") > 0, c("trailing_bytes"), "bytes after the last record"),
            ("DISCONTINUOUS", "info", c("continuity").endswith("D"), "records need not follow each other"),
            ("DISCONTINUOUS", "warning", c("continuity").endswith("D") & (c("annotation_channels") == 0), "records need not follow each other, and none states when it starts"),
            ("LEAP_SECOND_START", "warning", F.rlike("start_time_raw", F.lit(r"^\d\d.\d\d.60$")) & start.isNotNull(), "a start in the 60th second is told as the 59th"),
            ("START_DATE_MISMATCH", "warning", date_mismatch(c("start_date_raw"), c("recording_id")), "start date", c("start_date_raw"), "and the recording's own field differ"),
            ("START_TIME_UNREADABLE", "warning", start.isNull(), c("start_date_raw"), c("start_time_raw"), "is no date and time"),
        ),
    ]


def of_channels(channels: DataFrame) -> list[DataFrame]:
    c = F.col
    data = channels.where(~c("is_annotations")).withColumn("fault", calibration_fault())
    named = F.concat(F.lit("channel"), F.lit(" "), c("signal_index").cast("string"))
    per_file = channels.groupBy("path").agg(F.count_if(~c("is_annotations")).alias("data"), F.count_distinct(F.when(~c("is_annotations") & (c("samples_per_record") > 0), c("samples_per_record"))).alias("rates"))
    shared = data.groupBy("path", "label").agg(F.count(F.lit(1)).alias("n"))
    return [
        notes(
            data,
            (c("fault"), F.when(c("fault").startswith("INVERTED"), "info").otherwise("warning"), c("fault").isNotNull(), named),
            ("NONPRINTABLE_LABEL", "warning", any_of(has_control), named),
            ("FORMULA_LABEL", "warning", any_of(starts_formula), named),
            ("EMPTY_LABEL", "warning", c("label") == "", named),
            ("NO_SAMPLES", "warning", c("samples_per_record") == 0, named),
        ),
        rows(shared, "DUPLICATE_LABEL", "info", c("n") > 1, c("label"), "names", c("n"), "channels"),
        notes(per_file, ("NO_SIGNAL_CHANNELS", "info", c("data") == 0, "annotations only"), ("MIXED_SAMPLING_RATES", "info", c("rates") > 1, c("rates"), "rates")),
    ]


def of_starts(starts: DataFrame) -> list[DataFrame]:
    """``starts``: of operators.timing.record_order."""
    told = starts.withColumn("liar", contradicts() & F.col("continuity").endswith("C"))
    first = F.min_by("origin_s", "record_index")
    per_file = told.groupBy("path").agg(
        F.count_if("liar").alias("liars"), F.count_if(F.col("fault") == "backwards").alias("backwards"), F.count_if(F.col("fault") == "overlapping").alias("overlapping"),
        F.bool_or(F.col("continuity").isNull() & (F.col("origin_s") != 0)).alias("unmarked"),
        F.bool_or(F.col("continuity").isNotNull() & F.col("origin_s").isNotNull() & ~can_carry(F.col("origin_s"), F.col("finest_s"))).alias("unusable"), first.alias("origin_s"),
    )
    found_here = [
        ("DISCONTINUOUS", "warning", F.col("liars") > 0, F.col("liars"), "records contradict the continuous mark"),
        ("DISCONTINUOUS", "warning", F.col("backwards") > 0, F.col("backwards"), "records start before the one before"),
        ("DISCONTINUOUS", "warning", F.col("overlapping") > 0, F.col("overlapping"), "records overlap the one before"),
        ("DISCONTINUOUS", "warning", F.coalesce("unusable", F.lit(False)), "starts too far away to tell samples apart; timed from zero"),
        ("MISSING_EDF_PLUS_MARKER", "warning", F.coalesce("unmarked", F.lit(False)), "stated starts in a file without a mark"),
    ]
    return [notes(per_file, *found_here)]


def of_annotations(slots: DataFrame) -> list[DataFrame]:
    """What was lost in reading lists; durations are told of the events that are written."""
    found = decode_faults(slots)
    found_here = [
        ("ANNOTATION_DECODE_FAILED", "warning", F.col("malformed") > 0, F.col("malformed"), "lists could not be read"),
        ("ANNOTATION_DECODE_FAILED", "warning", F.col("lost_starts") > 0, F.col("lost_starts"), "records whose start could not be read,", F.col("lost_starts_with_text"), "of them with events"),
    ]
    return [notes(found, *found_here)]


def of_events(events: DataFrame) -> list[DataFrame]:
    """``events``: those in the window."""
    found = events.groupBy("path").agg(F.count_if(F.col("duration_s") < 0).alias("negative"), F.count_if("duration_unreadable").alias("unreadable"))
    found_here = [
        ("ANNOTATION_DECODE_FAILED", "warning", F.col("negative") > 0, F.col("negative"), "durations are below zero"),
        ("ANNOTATION_DECODE_FAILED", "warning", F.col("unreadable") > 0, F.col("unreadable"), "durations are no numbers"),
    ]
    return [notes(found, *found_here)]


def of_plan(channels: DataFrame, groups: DataFrame, windows: DataFrame, recordings: DataFrame, events: DataFrame, terms: list[str] | None = None, layout: str = "wide", annotations_only: bool = False) -> DataFrame:
    """What is to note of a conversion: ``groups`` and ``windows`` of plans.convert, with tables."""
    c = F.col
    data = channels.where("not is_annotations")
    tables = groups.groupBy("path", "table").agg(F.sum("n_rows").alias("n_rows"))
    files = groups.groupBy("path").agg(F.sum("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("rates"), F.bool_or(c("rate_hz") == float("inf")).alias("untimed"))
    step = F.lit(1.0) / c("rate_hz")
    short = groups.withColumn("short", F.size(F.filter("members", lambda m: m["clamped"])))
    found = [
        rows(channel_ops.renamed(data), "DUPLICATE_LABEL", "warning", F.lit(True), "channel", c("signal_index"), "is named", c("column_name")),
        notes(files, ("MIXED_SAMPLING_RATES", "warning", c("rates") > 1, c("rates"), "rates"), ("EMPTY_WINDOW", "warning", (c("n_rows") == 0) & ~c("untimed"), "no samples lie in the window")),
        notes(
            short,
            ("TIME_RESOLUTION", "warning", c("rate_hz") == float("inf"), "samples of", c("table"), "can't be placed in time"),
            ("TIME_RESOLUTION", "warning", (c("rate_hz") < float("inf")) & (step < F.pow(F.lit(10.0), -c("time_decimals"))), "rows of", c("table"), "share a printed time"),
            ("VALUE_RESOLUTION", "warning", c("short") > 0, c("short"), "channels of", c("table"), "step by less than can be printed"),
        ),
        rows(tables, "LARGE_OUTPUT", "warning", c("n_rows") + 1 > SPREADSHEET_ROWS, c("table"), "has", thousands(c("n_rows")), "rows"),
        rows(windows, "WINDOW", "error", c("fault").isNotNull(), "the window", c("fault")),
        *of_events(events),
    ]
    usable = windows.where("fault is null").select("path")
    if annotations_only:
        found.append(rows(recordings.join(usable, "path", "left_semi"), "NO_ANNOTATIONS", "warning", c("annotation_channels") == 0, "no events to write"))
    else:
        bare = recordings.join(usable, "path", "left_semi").join(groups.select("path").distinct(), "path", "left_anti")
        found.append(rows(bare, "NO_SAMPLES", "warning", F.lit(True), "no signal table is written"))
    if terms is not None:
        labels = [t.strip().lower() for t in terms]
        same = data.where(F.lower("label").isin(labels)).groupBy("path", F.lower("label").alias("term")).agg(F.count(F.lit(1)).alias("n"))
        found.append(rows(same, "DUPLICATE_LABEL", "warning", c("n") > 1, c("term"), "selects", c("n"), "channels"))
    return reduce(DataFrame.unionByName, found)


def of_single_table(groups: DataFrame, recordings: DataFrame) -> DataFrame:
    """Recordings whose signals aren't one table, which is what a single stream can hold."""
    n = recordings.where("error is null").join(groups.groupBy("path").agg(F.count_distinct("table").alias("n")), "path", "left")
    return rows(n, "STDOUT_UNSUPPORTED", "warning", F.coalesce("n", F.lit(0)) != 1, F.coalesce("n", F.lit(0)), "signal tables")


def diagnostics(recordings: DataFrame, channels: DataFrame, starts: DataFrame | None = None, slots: DataFrame | None = None) -> DataFrame:
    found = of_recordings(recordings) + of_channels(channels)
    found += of_starts(starts) if starts is not None else []
    found += of_annotations(slots) if slots is not None else []
    return reduce(DataFrame.unionByName, found)
