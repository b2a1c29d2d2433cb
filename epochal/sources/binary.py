"""A Spark data source of binary recordings.

``spark.dataSource.register(RecordingSource)``, then
``spark.read.format("recording").option("stream", s).load(path)`` with one of

- ``samples``: a packed row per record and channel (or per ``sliceSamples`` of
  one, so that a huge record is several rows), with the record's start and the
  channel's calibration, so that no join is needed to read physical values;
- ``values``: a row per sample, with its time and its physical value;
- ``starts``: a row per record with its stated start and the one that it has;
- ``runs``: a row per run of records that follow each other without a gap; only those
  of a discontinuous recording need its records' slots;
- ``annotations``: the bytes of each annotation slot; only these are read;
- ``signals``, ``recordings``: headers alone; ``checksums``: SHA-256 of the bytes
  that a file had when the job was planned.

``select`` (labels or #positions, by commas) and ``startRecord``/``endRecord`` or
``startSeconds``/``endSeconds`` prune what is read from disk. So do comparisons of
``path``, ``record_index``, ``signal_index``, ``column_name``, ``start_s`` and ``time_s``
in a query's filters, with option ``pushdown`` and Spark's
``spark.sql.python.filterPushdown.enabled``, as the views for SQL set them. A file is split by
its size alone, so the driver opens no file; tasks find their records from the
header. Runs of whole records are read where most of their bytes are wanted. Any
store that Arrow's file systems know will do. ``mode`` PERMISSIVE reports an
unreadable header in ``recordings.error`` and skips the file elsewhere; FAILFAST,
the default, raises.

A recording without a mark of continuity is timed from zero. One that is marked
continuous has one origin: the first start that its first ``originRecords`` (16)
records state, less the records before. In one that is marked discontinuous each
record has the start it states, or else its place after that origin. Where no
start can carry the finest interval, records are timed from zero.

``spark.readStream.format("recording")`` gives the whole records of growing recordings,
each once; its offsets are the numbers of whole records of the files. A recording that
shrinks or goes fails the stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..functions.numbers import physical
from ..operators.selection import selected
from .files import opened, recordings_at, registered
from .header import Header, HeaderError, parse_header, stated_start

SCHEMAS = {
    "samples": "path string, record_index long, signal_index int, sample_from int, start_s double, rate_hz double, samples_per_record int, column_name string, physical_min double, physical_max double, digital_min long, digital_max long, digital array<int>",
    "values": "path string, record_index long, signal_index int, column_name string, sample_index int, samples_per_record int, rate_hz double, time_s double, digital int, value double",
    "runs": "path string, first_record long, records long, record_duration_seconds double, start_s double, base_s double, continuity string",
    "starts": "path string, record_index long, record_duration_seconds double, continuity string, finest_s double, declared_s double, origin_s double, start_s double",
    "annotations": "path string, record_index long, signal_index int, timekeeping boolean, slot binary",
    "signals": "path string, signal_index int, label string, column_name string, transducer string, unit string, physical_min double, physical_max double, digital_min long, digital_max long, prefiltering string, samples_per_record long, rate_hz double, is_annotations boolean",
    "recordings": "path string, bytes long, modified_ns long, version string, patient_id string, recording_id string, start_date_raw string, start_time_raw string, declared_header_bytes long, header_bytes long, data_records long, data_records_declared long, record_duration_seconds double, signal_count int, annotation_channels int, continuity string, is_bdf boolean, bytes_per_sample int, record_bytes long, trailing_bytes long, comma_decimal boolean, origin_s double, error string",
    "checksums": "path string, bytes long, modified_ns long, sha256 string",
}
ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
RUN = 8 << 20


def decode(data: bytes, width: int) -> np.ndarray:
    """Little-endian signed samples of two or three bytes."""
    if width == 2:
        return np.frombuffer(data, "<i2").astype(np.int32)
    parts = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
    return (parts[:, 0] << 8 | parts[:, 1] << 16 | parts[:, 2] << 24) >> 8


def batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, ARROW[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def row_of(schema: str, values: dict) -> tuple:
    return tuple(values.get(f.split(" ")[0]) for f in schema.split(", "))


class Opened:
    """An open recording: its header, and when its records start."""

    def __init__(self, file, size: int, origin_records: int):
        self.file, self.size, self.bytes_read = file, size, 0
        start = self.at(0, 256)
        digits = start[252:256].decode("latin-1").strip("\0 ")
        self.header: Header = parse_header(start + self.at(256, 256 * int(digits)) if digits.isdigit() else start)
        self.records = self.header.record_count(size)
        self.keeper, self.origin = self.header.timekeeper(), None
        for record in range(min(origin_records, self.records) if self.keeper else 0):
            if (stated := self.stated(record)) is not None:
                origin = stated - record * self.header.duration
                self.origin = origin if abs(origin) < float("inf") else None
                break
        spr = [s["samples_per_record"] for s in self.header.signals if not s["is_annotations"]]
        self.finest = min(self.header.duration, self.header.duration / max(spr, default=0)) if max(spr, default=0) else self.header.duration

    def at(self, start: int, size: int) -> bytes:
        self.file.seek(start)
        self.bytes_read += size
        return self.file.read(size)

    def slot(self, record: int, signal: dict) -> bytes:
        return self.at(self.header.header_bytes + record * self.header.record_bytes + signal["byte_offset"], signal["samples_per_record"] * self.header.sample_bytes)

    def stated(self, record: int) -> float | None:
        return stated_start(self.slot(record, self.keeper)) if self.keeper else None

    @property
    def base(self) -> float:
        """When the recording begins, but for records that state their own start."""
        if not self.header.fixed["continuity"] or not self.keeper:
            return 0.0
        return self.origin if self.origin is not None and self.origin + self.finest > self.origin else 0.0

    @property
    def gaps(self) -> bool:
        """Whether each record states its own start."""
        return bool(self.keeper) and (self.header.fixed["continuity"] or "").endswith("D")

    def start(self, record: int, stated: float | None = None) -> float:
        if self.gaps:
            stated = self.stated(record) if stated is None else stated
            if stated is not None and stated + self.finest > stated:
                return stated
        return self.base + record * self.header.duration

    def runs(self, lo: int, hi: int) -> Iterator[tuple[int, int, float, float]]:
        """(first record, records, its start, base) of runs of records from ``lo`` to ``hi``; in a
        run of several, record i starts at base + i durations, to the bit."""
        if not self.gaps:
            if hi > lo:
                yield lo, hi - lo, self.base + lo * self.header.duration, self.base
            return
        first, start, base = lo, None, 0.0
        for record in range(lo, hi):
            at = self.start(record)
            if start is not None and at == base + record * self.header.duration and start == base + first * self.header.duration:
                continue
            if start is not None:
                yield first, record - first, start, base
            first, start, base = record, at, at - record * self.header.duration
        if start is not None:
            yield first, hi - first, start, base

    def records_in(self, lo: int, hi: int, since: float | None, until: float | None) -> tuple[int, int]:
        """Of the records from ``lo`` to ``hi``, those that a window may need, found without their slots."""
        step = self.header.duration
        if self.gaps or step <= 0:
            return lo, max(lo, hi)
        if since is not None and since > self.base:
            lo = max(lo, int(min((since - self.base) / step, hi)) - 1)
        if until is not None:
            hi = min(hi, int(max(min((until - self.base) / step, hi), -2)) + 2)
        return lo, max(lo, hi)


class Slice(InputPartition):
    def __init__(self, path: str, size: int, modified: int, part: int, parts: int):
        self.path, self.size, self.modified, self.part, self.parts = path, size, modified, part, parts


class RecordingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.stream = options.get("stream", "samples")
        self.path = options["path"]
        self.slice_bytes = int(options.get("sliceBytes", 64 << 20))
        self.slice_samples = int(options.get("sliceSamples", 1 << 20))
        self.terms = options["select"].split(",") if "select" in options else None
        self.first, self.last = int(options.get("startRecord", 0)), int(options.get("endRecord", 1 << 62))
        self.since, self.until = (float(options[k]) if k in options else None for k in ("startSeconds", "endSeconds"))
        self.origin_records = int(options.get("originRecords", 16))
        self.strict = options.get("mode", "FAILFAST").upper() == "FAILFAST"
        self.ranges: dict[str, tuple] = {}  # what filters ask of columns, ends included
        self.sets: dict[str, set] = {}

    def partitions(self) -> list[Slice]:
        whole = self.stream in ("signals", "recordings", "checksums")
        cut = lambda size: 1 if whole else max(1, -(-size // self.slice_bytes))
        return [Slice(path, size, modified, k, cut(size)) for path, size, modified in recordings_at(self.path) if self.wants("path", path) for k in range(cut(size))]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        path, schema, size = partition.path, SCHEMAS[self.stream], partition.size
        store, plain = opened(path)
        with store.open_input_file(plain) as file:
            if self.stream == "checksums":
                digest, left = hashlib.sha256(), size
                while left and (data := file.read(min(left, RUN))):
                    digest.update(data)
                    left -= len(data)
                yield batch([(path, size, partition.modified, digest.hexdigest())], schema)
                return
            try:
                found = Opened(file, size, self.origin_records)
            except HeaderError as e:
                if self.strict:
                    raise
                if self.stream == "recordings":
                    yield batch([row_of(schema, {"path": path, "bytes": size, "modified_ns": partition.modified, "error": str(e)})], schema)
                return
            header, records = found.header, found.records
            if self.stream == "recordings":
                row = {**header.fixed, "path": path, "bytes": size, "modified_ns": partition.modified, "header_bytes": header.header_bytes, "data_records": records, "bytes_per_sample": header.sample_bytes, "record_bytes": header.record_bytes, "trailing_bytes": size - header.header_bytes - records * header.record_bytes, "comma_decimal": header.commas, "annotation_channels": sum(s["is_annotations"] for s in header.signals), "origin_s": found.origin}
                yield batch([row_of(schema, row)], schema)
                return
            if self.stream == "signals":
                yield batch([row_of(schema, {**s, "path": path}) for s in header.signals], schema)
                return
            lo = max(self.first, records * partition.part // partition.parts)
            hi = min(self.last, records * (partition.part + 1) // partition.parts)
            since, until = self.ranges.get("record_index", (None, None))
            lo, hi = lo if since is None else max(lo, since), hi if until is None else min(hi, until + 1)
            if self.stream == "runs":
                if not found.gaps:  # the header tells all of it
                    lo, hi = (self.first, min(self.last, records)) if partition.part == 0 else (0, 0)
                rows = [(path, first, n, header.duration, start, base, header.fixed["continuity"]) for first, n, start, base in found.runs(lo, hi)]
                for k in range(0, len(rows), 50_000):
                    yield batch(rows[k : k + 50_000], schema)
            elif self.stream == "starts":
                rows = []
                for record in range(lo, hi):
                    stated = found.stated(record)
                    rows.append((path, record, header.duration, header.fixed["continuity"], found.finest, stated, found.origin, found.start(record, stated)))
                    if len(rows) >= 50_000:
                        yield batch(rows, schema)
                        rows = []
                if rows:
                    yield batch(rows, schema)
            elif self.stream == "annotations":
                yield from self.slots(path, found, lo, hi)
            else:
                yield from self.chosen(path, found, lo, hi)

    def chosen(self, path: str, found: Opened, lo: int, hi: int) -> Iterator[pa.RecordBatch]:
        """Samples of the records, packed or one a row."""
        for packed in self.samples(path, found, lo, hi):
            yield packed if self.stream == "samples" else values_of(packed)

    def wants(self, name: str, value) -> bool:
        """Whether the pushed filters may let rows with this value pass."""
        lo, hi = self.ranges.get(name, (None, None))
        return value is None or (lo is None or value >= lo) and (hi is None or value <= hi) and (name not in self.sets or value in self.sets[name])

    def slots(self, path: str, found: Opened, lo: int, hi: int) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for record in range(lo, hi):
            for s in found.header.signals:
                if s["is_annotations"] and s["samples_per_record"]:
                    rows.append((path, record, s["signal_index"], s is found.keeper, found.slot(record, s)))
                    held += len(rows[-1][4])
            if held > RUN:
                yield batch(rows, SCHEMAS["annotations"])
                rows, held = [], 0
        if rows:
            yield batch(rows, SCHEMAS["annotations"])

    def samples(self, path: str, found: Opened, lo: int, hi: int) -> Iterator[pa.RecordBatch]:
        header = found.header
        chosen = header.signals if self.terms is None else selected(header.signals, self.terms)
        wanted = [s for s in chosen if not s["is_annotations"] and s["samples_per_record"] and self.wants("signal_index", s["signal_index"]) and self.wants("column_name", s["column_name"])]
        if not wanted:
            return
        time = "time_s" if self.stream == "values" else "start_s"
        since, until = self.ranges.get(time, (None, None))
        bounds = [x for x in (self.since, since) if x is not None], [x for x in (self.until, until) if x is not None]
        lo, hi = found.records_in(lo, hi, max(bounds[0], default=None), min(bounds[1], default=None))
        width, some = header.sample_bytes, sum(s["samples_per_record"] for s in wanted)
        whole = 2 * some * width >= header.record_bytes and header.record_bytes <= RUN
        huge = max(s["samples_per_record"] for s in wanted) > self.slice_samples
        record = lo
        while record < hi:
            starts, first = [], record
            while record < hi and (record - first) * header.record_bytes < RUN:
                start = found.start(record)
                inside = (self.since is None or start + header.duration > self.since) and (self.until is None or start < self.until) and (since is None or start + header.duration >= since) and (until is None or start <= until)
                if inside:
                    starts.append(start)
                    record += 1
                elif starts:
                    break
                else:
                    record = first = record + 1
            if not starts:
                continue
            if huge:
                yield from self.sliced(path, found, wanted, first, starts)
                continue
            n = len(starts)
            if whole:
                data = np.frombuffer(found.at(header.header_bytes + first * header.record_bytes, n * header.record_bytes), np.uint8).reshape(n, -1)
                parts = [data[:, s["byte_offset"] : s["byte_offset"] + s["samples_per_record"] * width] for s in wanted]
                raw = (np.concatenate(parts, axis=1) if len(parts) > 1 else parts[0]).tobytes()
            else:
                raw = b"".join(found.slot(r, s) for r in range(first, first + n) for s in wanted)
            yield self.packed(path, wanted, np.arange(first, first + n), np.array(starts), decode(raw, width))

    def packed(self, path: str, wanted: list[dict], records: np.ndarray, starts: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        """A row per record and wanted channel, from samples in that order."""
        n, k = len(records), len(wanted)
        offsets = np.concatenate([[0], np.cumsum(np.tile([s["samples_per_record"] for s in wanted], n))]).astype(np.int32)
        place = pa.array(np.tile(np.arange(k), n))
        known = {"path": pa.DictionaryArray.from_arrays(np.zeros(n * k, np.int32), [path]).cast(pa.string()), "record_index": pa.array(np.repeat(records, k)), "sample_from": pa.array(np.zeros(n * k, np.int32)), "start_s": pa.array(np.repeat(starts, k)), "digital": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))}
        fields = [f.split(" ") for f in SCHEMAS["samples"].split(", ")]
        return pa.RecordBatch.from_arrays([known[f] if f in known else pa.array([s[f] for s in wanted], ARROW[t]).take(place) for f, t in fields], names=[f for f, _ in fields])

    def sliced(self, path: str, found: Opened, wanted: list[dict], first: int, starts: list[float]) -> Iterator[pa.RecordBatch]:
        """Rows of ``sliceSamples`` samples at most, in order of record, channel and place."""
        header, schema = found.header, SCHEMAS["samples"]
        for record, start in enumerate(starts, first):
            for s in wanted:
                at = header.header_bytes + record * header.record_bytes + s["byte_offset"]
                for k in range(0, s["samples_per_record"], self.slice_samples):
                    n = min(self.slice_samples, s["samples_per_record"] - k)
                    values = decode(found.at(at + k * header.sample_bytes, n * header.sample_bytes), header.sample_bytes)
                    yield batch([row_of(schema, {**s, "path": path, "record_index": record, "sample_from": k, "start_s": start, "digital": values})], schema)


class PushingReader(RecordingReader):
    """Takes comparisons of columns as hints of what to read; Spark still applies them."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            yield f
            if len(getattr(f, "attribute", ())) != 1:
                continue
            name, value = f.attribute[0], getattr(f, "value", None)
            lo, hi = self.ranges.get(name, (None, None))
            if value is None or value != value:
                pass
            elif isinstance(f, (EqualTo, EqualNullSafe)):
                self.sets[name] = self.sets.get(name, {value}) & {value}
                lo, hi = (value if lo is None else max(lo, value)), (value if hi is None else min(hi, value))
            elif isinstance(f, In):
                self.sets[name] = self.sets.get(name, set(f.value)) & set(f.value)
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                lo = value if lo is None else max(lo, value)
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                hi = value if hi is None else min(hi, value)
            if (lo, hi) != (None, None):
                self.ranges[name] = lo, hi


def values_of(packed: pa.RecordBatch) -> pa.RecordBatch:
    """A row per sample of packed rows."""
    lists = packed.column("digital")
    sizes, codes = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten()
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + packed.column("sample_from").to_numpy()[row]
    column = {n: packed.column(n).to_numpy(zero_copy_only=False) for n in ("signal_index", "start_s", "rate_hz", "physical_min", "physical_max", "digital_min", "digital_max")}
    digital, values = codes.to_numpy(zero_copy_only=False), np.empty(len(row))
    for k in np.unique(column["signal_index"]):
        own = column["signal_index"] == k
        first = int(np.flatnonzero(own)[0])
        values[own[row]] = physical(digital[own[row]].astype(np.int64), *(column[n][first].item() for n in ("physical_min", "physical_max", "digital_min", "digital_max")))
    known = {"sample_index": pa.array(place, pa.int32()), "time_s": pa.array(column["start_s"][row] + place / column["rate_hz"][row]), "digital": codes, "value": pa.array(values, mask=np.isnan(values))}
    at, names = pa.array(row), [f.split(" ")[0] for f in SCHEMAS["values"].split(", ")]
    return pa.RecordBatch.from_arrays([known[n] if n in known else packed.column(n).take(at) for n in names], names=names)


class Range(InputPartition):
    """Records of a growing recording."""

    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class GrowingReader(DataSourceStreamReader):
    """The whole records of recordings that grow, each once."""

    def __init__(self, options: dict):
        self.options, self.layouts = options, {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Whole records by path; a file whose header isn't whole yet has none."""
        out = {}
        for path, size, _ in recordings_at(self.options["path"]):
            if path not in self.layouts:
                store, plain = opened(path)
                try:
                    with store.open_input_file(plain) as file:
                        header = Opened(file, size, 0).header
                except HeaderError:
                    continue
                self.layouts[path] = header.header_bytes, header.record_bytes
            begin, each = self.layouts[path]
            out[path] = max(0, size - begin) // each if each else 0
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        for path, n in start.items():
            if end.get(path, 0) < n:
                raise ValueError(f"{path} had {n} records and has {end.get(path, 0)}")
        out = []
        for path, n in end.items():
            _, each = self.layouts.get(path, (0, 1 << 20))
            step = max(1, int(self.options.get("sliceBytes", 64 << 20)) // max(1, each))
            out += [Range(path, k, min(n, k + step)) for k in range(start.get(path, 0), n, step)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        reader = RecordingReader(self.options)
        store, plain = opened(partition.path)
        with store.open_input_file(plain) as file:
            found = Opened(file, file.size(), reader.origin_records)
            if partition.last * found.header.record_bytes + found.header.header_bytes > found.size:
                raise ValueError(f"{partition.path} is shorter than it was")
            yield from reader.chosen(partition.path, found, partition.first, partition.last)


class RecordingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("stream", "samples")]

    def reader(self, schema) -> RecordingReader:
        return (PushingReader if self.options.get("pushdown", "false").lower() == "true" else RecordingReader)(self.options)

    def streamReader(self, schema) -> GrowingReader:
        if self.options.get("stream", "samples") not in ("samples", "values"):
            raise ValueError("a stream of growing recordings has samples or values")
        return GrowingReader(dict(self.options))


def read_recording(spark: SparkSession, path: str, stream: str, **options):
    """One stream of the recordings at ``path`` as a DataFrame; with ``pushdown`` filters reach its scan."""
    registered(spark, RecordingSource)
    if options.get("pushdown"):
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("recording").options(stream=stream, **{k: str(v) for k, v in options.items() if v is not None}).load(path)


def read_growing(spark: SparkSession, path: str, stream: str = "samples", **options):
    """The whole records of the recordings at ``path``, and of those to come, as a stream."""
    registered(spark, RecordingSource)
    return spark.readStream.format("recording").options(stream=stream, **{k: str(v) for k, v in options.items() if v is not None}).load(path)
