"""What recordings hold and what a conversion would write, without converting them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..functions.lists import counted, listed
from ..operators import annotations, diagnostics
from .convert import open_recordings, with_tables


def survey(spark: SparkSession, path: str, terms: list[str] | None = None, start: float | None = None, end: float | None = None, duration: float | None = None, layout: str = "wide", decimals: int | None = None) -> DataFrame:
    """A row per recording: its header, channels, events by description, the tables that a
    conversion would write with their rows and bytes at most, and what is to note."""
    found, c = open_recordings(spark, path), F.col
    windows = found.windows(start, end, duration)
    groups = with_tables(found.rate_groups(terms, layout, decimals, windows.where("fault is null")), layout, ".csv")
    until = end if duration is None else (start + duration if start is not None else None)
    events = annotations.within(found.events(), start, until)
    channels = found.channels.where("not is_annotations").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("signal_index", "column_name", "label", "unit", "rate_hz", "samples_per_record", "physical_min", "physical_max"))).alias("channels"))
    tables = groups.groupBy("path").agg(F.reverse(F.array_sort(F.collect_list(F.struct("rate_hz", "table", "n_rows", "bytes_at_most")))).alias("tables"))
    descriptions = events.groupBy("path", "description").agg(F.count(F.lit(1)).alias("n")).groupBy("path").agg(F.sum("n").alias("n_events"), F.count(F.lit(1)).alias("n_descriptions"))
    notes = diagnostics.in_order(found.diagnostics().where("code <> 'MIXED_SAMPLING_RATES'"), diagnostics.of_plan(found.channels, groups, windows, found.recordings, events, terms, layout).unionByName(diagnostics.of_single_table(groups, found.recordings)))
    told = notes.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("stage", "code", "severity", "message", "hint"))).alias("notes"))
    rows = found.recordings.select("path", "format", text.printable(c("patient_id")).alias("patient_id"), text.printable(c("recording_id")).alias("recording_id"), "start_datetime", "data_records", "record_duration_seconds", "duration_seconds", "bytes", "error")
    for more in (windows.select("path", "start_seconds", "end_seconds", "fault", "first_s", "last_s"), channels, tables, descriptions, told):
        rows = rows.join(more, "path", "left")
    return rows


def printed(row: Row) -> str:
    """A survey's row as a page of text."""
    if row.error:
        return f"{row.path}\n  unreadable: {row.error}"
    out = [row.path, f"  {row.format}, {numbers.bytes_text(row.bytes)}, {numbers.duration_text(row.duration_seconds)}, {counted(row.data_records, 'record')} of {numbers.seconds_text(row.record_duration_seconds)}"]
    out.append(f"  recorded {row.start_datetime or 'at an unreadable time'}; patient {row.patient_id!r}; recording {row.recording_id!r}")
    if row.first_s:
        out.append(f"  timed from {numbers.fixed(row.first_s, 3)}s")
    channels = row.channels or []
    rates = dict(zip([x.rate_hz for x in channels], numbers.rate_texts([x.rate_hz for x in channels]), strict=True))
    out.append(f"  {counted(len(channels), 'channel')}:")
    out += [f"    #{x.signal_index} {x.column_name} [{x.unit}] {rates[x.rate_hz]} Hz, {numbers.number_text(x.physical_min)} to {numbers.number_text(x.physical_max)}" for x in channels]
    for t in row.tables or []:
        out.append(f"  would write {t.table}: {t.n_rows:,} rows, about {numbers.bytes_text(t.bytes_at_most)}")
    if row.n_events:
        out.append(f"  {counted(row.n_events, 'event')} of {counted(row.n_descriptions, 'description')}")
    notes = [f"{n.code} ({n.message})" for n in row.notes or []]
    if notes:
        out.append(f"  to note: {listed(notes)}")
    return "\n".join(out)
