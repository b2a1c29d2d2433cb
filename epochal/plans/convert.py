"""From binary recordings to tables: streams of recordings, and their conversion.

Headers are read first; selection and window are options of the scan, so only
chosen channels and records are read from disk. A conversion of any number of
recordings is one scan that renders text as it reads, plus small tables of headers
and events.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import reduce
from itertools import groupby
from uuid import uuid4

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..operators import annotations, channels, diagnostics, timing
from ..scratch import scratch
from ..sinks import committed, tables
from ..sources.binary import read_recording
from ..sources.files import opened
from .render import rendered
from .sql import register


def scaled(digital, pmin, pmax, dmin, dmax):
    """Digital code to physical value; NULL where the mapping is undefined."""
    gain = F.try_divide(pmax - pmin, (dmax - dmin).cast("double"))
    offset = F.try_divide(pmax, gain) - dmax
    value = F.when(pmax == pmin, pmin).when(gain != 0, F.when(F.abs(offset) < float("inf"), gain * (offset + digital)).otherwise((digital - dmin) * gain + pmin))
    return F.when((dmax != dmin) & (F.abs(gain) < float("inf")), value)


CALIBRATION = ("physical_min", "physical_max", "digital_min", "digital_max")


class TimeRangeError(ValueError):
    """A window that no recording can have."""


@dataclass
class Recording:
    """The frames of the recordings at one path; all lazy."""

    recordings: DataFrame
    channels: DataFrame
    starts: DataFrame
    slots: DataFrame
    runs: DataFrame
    spark: SparkSession
    path: str
    root: str

    def folder(self) -> Column:
        return folder_of(F.col("path"), self.root)

    def packed(self, terms: list[str] | None = None, start: float | None = None, end: float | None = None, **options) -> DataFrame:
        """A row per record and chosen channel, of the records that the window needs."""
        return read_recording(self.spark, self.path, "samples", select=",".join(terms) if terms is not None else None, startSeconds=start, endSeconds=end, **options)

    def samples(self, terms: list[str] | None = None, start: float | None = None, end: float | None = None, **options) -> DataFrame:
        """(path, record_index, signal_index, column_name, sample_index, rate_hz, time_s, digital, value)"""
        rows = self.packed(terms, start, end, **options).select("*", F.posexplode("digital").alias("at", "code")).withColumn("sample_index", F.col("sample_from") + F.col("at"))
        rows = in_window(rows.withColumn("time_s", F.col("start_s") + F.col("sample_index") / F.col("rate_hz")), start, end)
        return rows.select("path", "record_index", "signal_index", "column_name", "sample_index", "samples_per_record", "rate_hz", "time_s", F.col("code").alias("digital"), scaled(F.col("code"), *map(F.col, CALIBRATION)).alias("value"))

    def events(self, start: float | None = None, end: float | None = None) -> DataFrame:
        return annotations.within(annotations.events(self.slots), start, end)

    def spans(self) -> DataFrame:
        """(path, first_s, last_s), from runs of records."""
        return timing.run_spans(self.runs)

    def windows(self, start: float | None = None, end: float | None = None, duration: float | None = None) -> DataFrame:
        """(path, start_seconds, end_seconds, whole_recording, fault) of a requested window.

        The end is cut to the recording's; the start is not. ``fault`` tells why a
        recording can't have the window."""
        if duration is not None and end is not None:
            raise TimeRangeError("a window has a duration or an end, not both")
        first, last = F.col("first_s"), F.col("last_s")
        since = first if start is None else F.lit(float(start))
        until = since + duration if duration is not None else last if end is None else F.lit(float(end))
        beyond = (since >= last) | numbers.nearly_equal(since, last)
        fault = F.when(beyond, "starts at or past the end").when(until <= since, "ends before it starts")
        upto = F.least(until, last)
        whole = ((since <= first) | numbers.nearly_equal(since, first)) & ((upto >= last) | numbers.nearly_equal(upto, last))
        return self.spans().select("path", since.alias("start_seconds"), upto.alias("end_seconds"), whole.alias("whole_recording"), fault.alias("fault"), "first_s", "last_s")

    def rate_groups(self, terms: list[str] | None = None, layout: str = "wide", decimals: int | None = None, windows: DataFrame | None = None) -> DataFrame:
        """A row per recording and rate, fastest first: its channels, table, exact rows
        and bytes at most, counted from headers and runs of records."""
        data = self.channels.where("not is_annotations and samples_per_record > 0")
        data = channels.select(data, terms) if terms is not None else data
        c = F.col
        step = numbers.quantization_step(*map(F.col, CALIBRATION))
        places = numbers.value_decimals(step) if decimals is None else F.lit(decimals)
        width = numbers.cell_width(F.greatest(F.abs("physical_min"), F.abs("physical_max")), places, (c("physical_min") < 0) | (c("physical_max") < 0))
        name = F.octet_length(text.csv_field(c("column_name"))).cast("long")
        member = F.struct("signal_index", "column_name", places.alias("decimals"), width.alias("width"), name.alias("name_width"), numbers.clamped(step).alias("clamped"))
        groups = data.groupBy("path", "rate_hz", "samples_per_record").agg(F.array_sort(F.collect_list(member)).alias("members"))
        windows = self.windows() if windows is None else windows
        rows = timing.rows_in_run(c("rate_hz"), c("samples_per_record"), c("start_seconds"), c("end_seconds"))
        timed = groups.join(windows, "path").join(self.runs, "path", "left")
        counted = timed.groupBy("path", "rate_hz").agg(F.sum(F.when(c("rate_hz") < float("inf"), rows).otherwise(0)).alias("times"))
        joined = groups.join(counted, ["path", "rate_hz"]).join(windows.select("path", "start_seconds", "end_seconds"), "path")
        size = F.size("members").cast("long")
        long = layout == "long"
        digits = numbers.time_decimals(c("rate_hz"))
        joined = joined.withColumn("time_decimals", digits)
        if long:
            finest = joined.groupBy("path").agg(F.max("time_decimals").alias("finest"))
            joined = joined.join(finest, "path").withColumn("time_decimals", c("finest")).drop("finest")
        clock = numbers.cell_width(F.greatest(F.abs("start_seconds"), F.abs("end_seconds")), c("time_decimals"), (c("start_seconds") < 0) | (c("end_seconds") < 0))
        add = lambda part: F.aggregate(F.transform("members", lambda m: m[part]), F.lit(0).cast("long"), lambda a, x: a + x)
        cells = clock * size + add("width") + add("name_width") + 3 * size if long else clock + add("width") + size + 1
        head = F.lit(0) if long else F.lit(7) + add("name_width") + size
        return joined.select("path", "rate_hz", "samples_per_record", "members", "time_decimals", (c("times") * (size if long else 1)).alias("n_rows"), (c("times") * cells + head).alias("bytes_at_most"))

    def diagnostics(self) -> DataFrame:
        return diagnostics.diagnostics(self.recordings, self.channels, timing.record_order(self.starts), self.slots)

    def checksums(self) -> DataFrame:
        return read_recording(self.spark, self.path, "checksums")

    def changed(self, before: DataFrame) -> DataFrame:
        """Diagnostics of recordings whose size or time moved since ``before``, checksums
        or headers that were read (and kept) earlier."""
        now = read_recording(self.spark, self.path, "recordings", mode="PERMISSIVE").select("path", F.col("bytes").alias("b"), F.col("modified_ns").alias("m"))
        moved = before.join(now, "path").where("bytes <> b or modified_ns <> m")
        return diagnostics.rows(moved, "INPUT_CHANGED", "warning", F.lit(True), "the file moved from", F.col("bytes"), "to", F.col("b"), "bytes or was written again")

    def views(self) -> None:
        """Temporary views and functions for SQL. Filters on ``samples`` choose what is read."""
        read = lambda stream: read_recording(self.spark, self.path, stream, mode="PERMISSIVE", pushdown="true")
        found = {"recordings": self.recordings, "channels": self.channels, "samples": read("values"), "annotations": self.events(), "annotation_slots": read("annotations"), "record_starts": read("starts"), "record_runs": self.runs, "diagnostics": self.diagnostics()}
        for name, df in found.items():
            df.createOrReplaceTempView(name)
        register(self.spark)


def in_window(rows: DataFrame, start: float | None, end: float | None) -> DataFrame:
    """Half-open on time_s; both bounds move by the rate's tolerance."""
    eps = F.least(F.lit(1e-9), F.lit(0.5) / F.col("rate_hz"))
    rows = rows if start is None else rows.where(F.col("time_s") >= F.lit(float(start)) - eps)
    return rows if end is None else rows.where(F.col("time_s") < F.lit(float(end)) - eps)


def open_recordings(spark: SparkSession, path: str) -> Recording:
    read = lambda stream: read_recording(spark, path, stream, mode="PERMISSIVE")
    c = F.col
    start = text.start_datetime(c("start_date_raw"), c("start_time_raw"), c("recording_id"))
    duration = c("data_records") * c("record_duration_seconds")
    recordings = read("recordings").withColumns({"format": text.format_name(c("is_bdf"), c("continuity")), "start_datetime": start, "duration_seconds": duration})
    return Recording(recordings, read("signals"), read("starts"), read("annotations"), read("runs"), spark, path, root_of(path))


def root_of(path: str) -> str:
    """The folder that was asked for, or that of the file."""
    store, plain = opened(path)
    if store.get_file_info(plain).type != fs.FileType.Directory:
        return path.rpartition("/")[0]
    return plain if isinstance(store, fs.LocalFileSystem) else path.rstrip("/")


def folder_name(path: str, root: str) -> str:
    """A recording's folder below the output: where it is below the root, without its ending."""
    inner = path[len(root) + 1 :] if root and path.startswith(root + "/") else path.rpartition("/")[2]
    above, _, name = inner.rpartition("/")
    return (f"{above}/" if above else "") + (name.rpartition(".")[0] if "." in name else name) + "_csv"


def folder_of(path: Column, root: str) -> Column:
    """``folder_name`` of a column."""
    below = F.substr(path, F.lit(len(root) + 2)) if root else F.lit(None).cast("string")
    inner = F.when(F.startswith(path, F.lit(root + "/")), below).otherwise(F.element_at(F.split(path, "/"), -1))
    return F.concat(F.regexp_replace(inner, r"\.[^./]*$", ""), F.lit("_csv"))


def number(name: str) -> Column:
    return numbers.shortest_text(F.col(name).cast("double"))


def channel_lines(found: Recording, groups: DataFrame, suffix: str) -> DataFrame:
    """The 14 columns of every data channel; ``groups`` with its table."""
    chosen = groups.select("path", "table", F.explode("members.signal_index").alias("signal_index"))
    rows = found.channels.where("not is_annotations").join(chosen, ["path", "signal_index"], "left")
    c = lambda n: F.col(n).cast("string")
    cells = [c("column_name"), c("signal_index"), c("label"), c("unit"), number("rate_hz"), c("samples_per_record"), number("physical_min"), number("physical_max"), c("digital_min"), c("digital_max"), c("transducer"), c("prefiltering"), F.coalesce(c("table"), F.lit("")), F.when(F.col("table").isNull(), "no").otherwise("yes")]
    ranged = rows.repartitionByRange("path", "signal_index").sortWithinPartitions("path", "signal_index")
    return ranged.select(found.folder().alias("recording"), F.lit(f"channels{suffix}").alias("table"), tables.line(*cells).alias("line"))


def event_lines(found: Recording, events: DataFrame, suffix: str) -> DataFrame:
    ranged = events.repartitionByRange("path", *annotations.ORDER).sortWithinPartitions("path", *annotations.ORDER)
    cells = [number("onset_s"), number("duration_s"), F.col("description"), F.col("record_index").cast("string")]
    return ranged.select(found.folder().alias("recording"), F.lit(f"annotations{suffix}").alias("table"), tables.line(*cells).alias("line"))


def slugs_of(rates: pd.Series) -> pd.Series:
    return rates.map(lambda r: numbers.rate_slugs([float(x) for x in r]))


def with_tables(groups: DataFrame, layout: str, suffix: str) -> DataFrame:
    """``groups`` with the table of each rate; a recording has few rates."""
    slugs = F.pandas_udf(slugs_of, "array<string>")
    rates = groups.groupBy("path").agg(F.sort_array(F.collect_list("rate_hz"), asc=False).alias("rates"))
    named = rates.select("path", F.size("rates").alias("n"), F.explode(F.arrays_zip("rates", slugs("rates").alias("slugs"))).alias("r"))
    single = (F.col("n") == 1) | F.lit(layout == "long")
    named = named.select("path", F.col("r.rates").alias("rate_hz"), F.when(single, f"signals{suffix}").otherwise(F.concat(F.lit("signals_"), "r.slugs", F.lit(suffix))).alias("table"))
    return groups.join(named, ["path", "rate_hz"])


@dataclass
class Converted:
    """What a conversion did: rows (recording, table, n_rows, bytes) as tasks wrote them,
    diagnostics with their hints and stages, and the tables by folder."""

    files: DataFrame
    diagnostics: DataFrame
    written: dict[str, list[str]]


WRITTEN = "recording string, table string, n_rows long, bytes long"


def convert(spark: SparkSession, path: str, out: str, terms: list[str] | None = None, start: float | None = None, end: float | None = None, layout: str = "wide", gzip: bool = False, force: bool = False, duration: float | None = None, decimals: int | None = None, bom: bool = False, annotations_only: bool = False, checksum: bool = False) -> Converted:
    """Write signals (a table per rate, or one long table), channels, events and a summary
    of every readable recording to ``out/<folder below the input>/<name>_csv``, a file a table.

    A window is checked against each recording; one that can't have it is not converted
    and is told in the diagnostics. All folders are claimed before anything is written."""
    if layout not in ("wide", "long"):
        raise ValueError(f"layout is wide or long, not {layout!r}")
    if decimals is not None and not 0 <= decimals <= 20:
        raise ValueError("decimals are 0 to 20")
    if start is not None and end is not None and end <= start or duration is not None and duration <= 0:
        raise TimeRangeError("the window ends before it starts")
    out = out.rstrip("/") if "://" in out else opened(out)[1]
    found, work, run = open_recordings(spark, path), scratch(spark, "convert"), uuid4().hex

    def kept(df: DataFrame, name: str) -> DataFrame:
        """Tables of headers and events are read several times, so they are written once."""
        df.write.parquet(f"{work}/{name}")
        return spark.read.schema(df.schema).parquet(f"{work}/{name}")

    found = replace(found, recordings=kept(found.recordings, "recordings"), channels=kept(found.channels, "channels"), runs=kept(found.runs, "runs"))
    readable = found.recordings.where("error is null")
    targets = readable.select("path", F.concat(F.lit(out + "/"), found.folder()).alias("folder"))
    if faults := committed.nested(targets, readable.select("path")).limit(20).collect():
        raise ValueError("; ".join(f"{r.folder} {r.why}" for r in faults))
    try:
        if faults := kept(committed.claim(targets, run, force), "claims").limit(20).collect():
            raise committed.OutputExists("; ".join(f"{r.folder} {r.why}" for r in faults))
        return written(found, kept, out, terms, start, end, layout, gzip, duration, decimals, bom, annotations_only, checksum)
    finally:
        committed.released(targets, run)


def written(found: Recording, kept, out: str, terms, start, end, layout, gzip, duration, decimals, bom, annotations_only, checksum) -> Converted:
    """The conversion itself, into claimed folders."""
    spark, root, suffix = found.spark, found.root, ".csv.gz" if gzip else ".csv"
    windows = kept(found.windows(start, end, duration), "windows")
    usable = windows.where("fault is null")
    folder = found.folder().alias("recording")
    groups = kept(with_tables(found.rate_groups(terms, layout, decimals, usable), layout, suffix), "groups")
    if annotations_only:
        groups = groups.where("false")
    left_out = found.recordings.select("path").join(usable, "path", "left_anti")
    # the window of a recording that has none of its own kind is the whole of it
    until = end if duration is None else (start + duration if start is not None else None)
    mark = tables.MARK if bom else ""
    parts = []
    if not annotations_only:
        options = {"layout": layout, "gzip": gzip, "decimals": decimals, "bom": bom, "window": (start, until)}
        by_start = duration is not None and start is None
        size = found.recordings.agg(F.sum("bytes")).first()[0] or 0
        part = min(64 << 20, max(2 << 20, size // (2 * spark.sparkContext.defaultParallelism) + 1))
        scan = found.packed(terms, start, until, mode="PERMISSIVE", sliceBytes=part)
        bounds = {r.path: (r.start_seconds, r.end_seconds) for r in usable.collect()} if by_start else {}
        name = lambda p: folder_name(p, root)

        def render(batches):
            if not by_start:
                yield from rendered(batches, name, options)
                return
            rows = ((b.column("path")[0].as_py(), b) for x in batches for b in split_by_path(x))
            for p, own in groupby(rows, lambda x: x[0]):
                yield from rendered((b for _, b in own), name, {**options, "window": bounds.get(p, (None, None))})

        if bad := [r.path for r in left_out.collect()]:
            scan = scan.where(~F.col("path").isin(bad))
        parts.append(scan.mapInArrow(render, tables.BLOCKS))
        # tables without a row have their header alone
        line = F.lit("time_s,channel,value") if layout == "long" else F.concat(F.lit("time_s,"), F.array_join(F.transform("members", lambda m: text.csv_field(m["column_name"])), ","))
        empty = groups.where("n_rows = 0").select(folder, "table", F.lit(None).cast("string").alias("value"), F.lit(0).cast("long").alias("n_rows"), F.concat(F.lit(mark), line).alias("header"))
        parts.append(empty.dropDuplicates(["recording", "table"]).join(groups.where("n_rows > 0").select(folder, "table"), ["recording", "table"], "left_anti") if layout == "long" else empty)
    until_event = F.col("first_s") + duration if duration is not None and start is None else F.lit(float("inf") if until is None else float(until))
    events = found.events(start).join(usable.select("path", "first_s"), "path").where(F.col("onset_s") < until_event).drop("first_s")
    events = kept(events, "events")
    header = {k: mark + ",".join(x.split(" ")[0] for x in tables.TYPES[k].split(", ")) for k in ("channels", "annotations")}
    described = replace(found, channels=found.channels.join(usable.select("path"), "path", "left_semi"))
    parts.append(tables.in_blocks(channel_lines(described, groups, suffix), header["channels"]))
    parts.append(tables.in_blocks(event_lines(found, events, suffix), header["annotations"]))
    no_events = found.recordings.where("annotation_channels > 0").join(events.select("path").distinct(), "path", "left_anti").join(usable.select("path"), "path", "left_semi")
    parts.append(no_events.select(folder, F.lit(f"annotations{suffix}").alias("table"), F.lit(None).cast("string").alias("value"), F.lit(0).cast("long").alias("n_rows"), F.lit(header["annotations"]).alias("header")))

    def noted() -> DataFrame:
        told = found.diagnostics().where("code <> 'MIXED_SAMPLING_RATES'")
        return kept(diagnostics.in_order(told, diagnostics.of_plan(found.channels, groups, windows, found.recordings, events, terms, layout, annotations_only)), "notes")

    with ThreadPoolExecutor(1) as beside:  # what is to note is found while the tables are written
        notes = beside.submit(noted)
        done = committed.write_tables(reduce(DataFrame.unionByName, parts), out, gzip)
        notes = notes.result().unionByName(kept(diagnostics.in_order(found.changed(found.recordings)).withColumn("stage", F.lit(2)), "changed"))
    done += committed.write_whole(summary(found, groups, windows, events, notes, layout, checksum), out)
    files = spark.createDataFrame([(r["recording"], r["table"], r["n_rows"] if r["table"] != "metadata.json" else None, r["bytes"]) for r in done], WRITTEN)
    left = tables.stale(files, out).select(F.col("recording").alias("path"), F.lit("STALE_OUTPUT").alias("code"), F.lit("warning").alias("severity"), F.concat("table", F.lit(" is of an earlier conversion")).alias("message"))
    by_folder: dict[str, list[str]] = {}
    for r in done:
        by_folder.setdefault(r["recording"], []).append(r["table"])
    left = kept(diagnostics.in_order(left).withColumn("stage", F.lit(3)), "stale")
    return Converted(files, notes.unionByName(left), {k: sorted(v, key=lambda t: (t == "metadata.json", t)) for k, v in sorted(by_folder.items())})


def split_by_path(batch):
    """A batch's runs of rows of one path."""
    paths = batch.column("path").to_numpy(zero_copy_only=False)
    first = np.flatnonzero(np.append(True, paths[1:] != paths[:-1])) if len(paths) else []
    for s, e in zip(first, [*first[1:], len(paths)], strict=True):
        yield batch.slice(s, e - s)


def summary(found: Recording, groups: DataFrame, windows: DataFrame, events: DataFrame, notes: DataFrame, layout: str, checksum: bool) -> DataFrame:
    """Blocks (recording, metadata.json): what was read, how, and what is to note."""
    c = F.col
    per_path = groups.groupBy("path").agg(F.reverse(F.array_sort(F.collect_list(F.struct(c("rate_hz").alias("sampling_rate_hz"), c("table").alias("file"), c("members.column_name").alias("channels"), c("members.decimals").alias("decimals"), "n_rows")))).alias("rate_groups"))
    told = notes.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("stage", "code", "severity", "message", "hint"))).alias("notes"))
    told = told.withColumn("notes", F.transform("notes", lambda n: n.dropFields("stage")))
    n_events = events.groupBy("path").agg(F.count(F.lit(1)).alias("annotations_written"))
    moved = notes.where("code = 'INPUT_CHANGED'").select("path")  # what was converted is no longer there to sum
    sums = found.checksums().select("path", "sha256").join(moved, "path", "left_anti") if checksum else found.recordings.select("path", F.lit(None).cast("string").alias("sha256"))
    rows = found.recordings.join(windows.where("fault is null"), "path").join(per_path, "path", "left").join(told, "path", "left").join(n_events, "path", "left").join(sums, "path", "left")
    body = F.struct(
        F.struct(F.lit("epochal").alias("name")).alias("tool"),
        F.struct("path", "bytes", F.date_format(F.timestamp_micros((c("modified_ns") / 1000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("modified"), "sha256").alias("source"),
        F.struct("format", "version", "patient_id", "recording_id", text.clock_text(c("start_datetime")).alias("start_datetime_local"), "start_date_raw", "start_time_raw", "data_records", "data_records_declared", "record_duration_seconds", "duration_seconds", "signal_count", "annotation_channels").alias("recording"),
        F.struct(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("converted_at"), "start_seconds", "end_seconds", "whole_recording", F.coalesce("annotations_written", F.lit(0)).alias("annotations_written"), F.lit(layout).alias("layout"), F.coalesce("rate_groups", F.array().cast(per_path.schema["rate_groups"].dataType)).alias("rate_groups")).alias("conversion"),
        F.coalesce("notes", F.array().cast(told.schema["notes"].dataType)).alias("notes"),
    )
    value = F.to_json(body, {"pretty": "true", "ignoreNullFields": "false"})
    return rows.select(found.folder().alias("recording"), F.lit("metadata.json").alias("table"), value.alias("value"))
