import io
import json
import random

import pytest
from pyspark.sql import functions as F

from epochal.functions.numbers import bytes_text, duration_text, fixed
from epochal.cli import main
from epochal.functions.timespec import seconds_of
from epochal.operators import annotations, channels
from epochal.plans.convert import TimeRangeError, convert, open_recordings
from epochal.sinks.committed import OutputExists
from epochal.sources.binary import read_recording
from epochal.sources.files import recordings_at
from epochal.sources.header import HeaderError, column_names
from files import write

EEG, ECG = ("EEG", "uV", -250, 250, -2048, 2047, 4), ("ECG", "mV", "-5,0", 5, -2048, 2047, 2)
FLAT, MARKS = ("EEG", "uV", 1, 2, 7, 7, 4), ("EDF Annotations", "", -1, 1, -32768, 32767, 30)


def test_samples_events_and_starts_of_a_discontinuous_recording(spark, tmp_path):
    tal = [b"+0\x14\x14\0+0.5\x151\x14W\xc3\xa9ke\x14again\x14\0", b"+10\x14\x14\0+10.25\x15x\x14N\xe9\x14\0", b"+11\x14\x14\0oops\x14lost\x14\0"]
    rows = [[[k * 4, 1, -2, -2048], [k, 2047], [7] * 4, tal[k]] for k in range(3)]
    path = write(tmp_path / "a.edf", [EEG, ECG, FLAT, MARKS], rows, reserved="EDF+D", declared=5)
    found = open_recordings(spark, path)
    got = {(r.record_index, r.signal_index, r.sample_index): r for r in found.samples().collect()}
    assert len(got) == 30
    gain = 500 / 4095
    assert got[1, 0, 0].time_s == 10 and got[1, 0, 3].time_s == 10.75
    assert got[2, 0, 0].value == gain * (250 / gain - 2047 + 8) and got[0, 2, 0].value is None
    few = found.samples(["ecg"], 10, 10.5).collect()
    assert [(r.signal_index, r.record_index, r.sample_index) for r in few] == [(1, 1, 0)]
    events = [(r.onset_s, r.duration_s, r.description, r.record_index) for r in found.events().orderBy("onset_s", "text_ordinal").collect()]
    assert events == [(0.5, 1.0, "Wéke", 0), (0.5, 1.0, "again", 0), (10.25, None, "Né", 1)]
    codes = {r.code for r in found.diagnostics().collect()}
    assert {"RECORD_COUNT_MISMATCH", "COMMA_DECIMAL", "DEGENERATE_DIGITAL_RANGE", "DUPLICATE_LABEL", "MIXED_SAMPLING_RATES", "DISCONTINUOUS"} <= codes
    with pytest.raises(Exception, match="close: EEG"):
        found.samples(["EGG"]).collect()
    with pytest.raises(channels.SelectionError, match="EEG"):
        channels.select(found.channels, ["EGG"])
    names = {r.signal_index: r.column_name for r in found.channels.collect()}
    assert names == {0: "EEG_ch0", 1: "ECG", 2: "EEG_ch2", 3: None}
    assert [(r.malformed, r.lost_starts, r.lost_starts_with_text) for r in annotations.decode_faults(found.slots).collect()] == [(1, 0, 0)]
    assert "ANNOTATION_DECODE_FAILED" in codes


def test_slices_and_24_bits(spark, tmp_path):
    values = [random.Random(k).randrange(-(1 << 23), 1 << 23) for k in range(40)]
    path = write(tmp_path / "b.bdf", [("A", "uV", -1, 1, -8388608, 8388607, 8)], [[values[k : k + 8]] for k in range(0, 40, 8)], wide=True)
    rows = read_recording(spark, path, "samples", sliceBytes="50", sliceSamples="3").orderBy("record_index", "sample_from").collect()
    assert [x for r in rows for x in r.digital] == values
    assert read_recording(spark, path, "samples", startRecord="1", endRecord="3").select(F.count_distinct("record_index")).first()[0] == 2


def test_unreadable_headers(spark, tmp_path):
    (tmp_path / "bad.edf").write_bytes(b"0" * 100)
    write(tmp_path / "good.EDF", [EEG], [[[1, 2, 3, 4]]])
    rows = {r.path.rsplit("/", 1)[1]: r for r in read_recording(spark, str(tmp_path), "recordings", mode="PERMISSIVE").collect()}
    assert rows["bad.edf"].error and rows["good.EDF"].data_records == 1
    assert HeaderError.__mro__[1] is ValueError
    with pytest.raises(Exception, match="256 bytes"):
        read_recording(spark, str(tmp_path), "signals").collect()


def lines(path):
    return open(path, encoding="utf-8").read().splitlines()


def test_converted_tables(spark, tmp_path):
    path = write(tmp_path / "c.edf", [("ch1", "uV", -100, 100, -1000, 1000, 2), ("c,2", "mV", -1, 1, -1000, 1000, 2)], [[[0, 1], [0, -1]], [[2, 3], [-2, -3]]])
    out = tmp_path / "out"
    done = convert(spark, path, str(out))
    assert lines(out / "c_csv/signals.csv") == ['time_s,ch1,"c,2"', "0.000,0.000,0.00000", "0.500,0.100,-0.00100", "1.000,0.200,-0.00200", "1.500,0.300,-0.00300"]
    assert lines(out / "c_csv/channels.csv") == ["column,signal_index,label,unit,sampling_rate_hz,samples_per_record,physical_min,physical_max,digital_min,digital_max,transducer,prefiltering,output_file,converted", "ch1,0,ch1,uV,2,2,-100,100,-1000,1000,,,signals.csv,yes", '"c,2",1,"c,2",mV,2,2,-1,1,-1000,1000,,,signals.csv,yes']
    assert done.written == {"c_csv": ["channels.csv", "signals.csv", "metadata.json"]}  # no annotation channel, no table of events
    meta = json.loads("\n".join(lines(out / "c_csv/metadata.json")))
    assert meta["source"]["sha256"] is None and meta["conversion"]["rate_groups"][0]["channels"] == ["ch1", "c,2"]
    assert meta["notes"] == [] and meta["recording"]["start_datetime_local"] == "2004-03-02T05:06:07"
    convert(spark, path, str(tmp_path / "long"), layout="long", bom=True)
    assert lines(tmp_path / "long/c_csv/signals.csv")[:3] == ["\ufefftime_s,channel,value", "0.000,ch1,0.000", '0.000,"c,2",0.00000']
    with pytest.raises(OutputExists):
        convert(spark, path, str(out))
    again = convert(spark, path, str(out), terms=["ch1"], force=True, layout="long", gzip=True, checksum=True)
    assert {(r.code, r.path) for r in again.diagnostics.collect()} == {("STALE_OUTPUT", "c_csv")}


def test_rows_in_file_order_over_many_parts(spark, tmp_path):
    """Slices of a file and several rates: rows stand as in the file, times tie exactly."""
    rows = [[[k * 4 + i for i in range(4)], [k * 3, k * 3 + 1, k * 3 + 2]] for k in range(50)]
    path = write(tmp_path / "m.edf", [("A", "u", -100, 100, -1000, 1000, 4), ("B", "u", -100, 100, -1000, 1000, 3)], rows, duration="0.1")
    convert(spark, path, str(tmp_path / "w"))
    fast = [x for x in lines(tmp_path / "w/m_csv/signals_40hz.csv") if not x.startswith("time")]
    assert [float(x.split(",")[1]) for x in fast] == pytest.approx([k / 10 for k in range(200)])
    assert fast[1].split(",")[0] == "0.025" and sorted(fast, key=lambda x: float(x.split(",")[0])) == fast
    assert "signals_30hz.csv" in convert(spark, path, str(tmp_path / "x"), start=0.05, end=4.0).written["m_csv"]
    part = [x for x in lines(tmp_path / "x/m_csv/signals_40hz.csv") if not x.startswith("time")]
    assert part == fast[2:160]
    convert(spark, path, str(tmp_path / "l"), layout="long")
    long = [x.split(",") for x in lines(tmp_path / "l/m_csv/signals.csv") if not x.startswith("time")]
    want = sorted(((k, i / n, s) for k in range(50) for s, n in ((0, 4), (1, 3)) for i in range(n)))
    assert [x[1] for x in long] == ["AB"[s] for _, _, s in want]


def test_windows_diagnostics_and_totals(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    tal = lambda t: f"+{t}\x14\x14\0".encode()
    write(folder / "a.edf", [EEG, MARKS], [[[1, 2, 3, 4], tal(k)] for k in (0, 1, 10)], reserved="EDF+D", date="31.02.04")
    write(folder / "b.edf", [EEG], [[[1, 2, 3, 4]]] * 3, time="05.06.60")
    found = open_recordings(spark, str(folder))
    by_file = lambda df, *cols: {(r.path[-5:-4], *(r[c] for c in cols)) for r in df.collect()}
    assert by_file(found.windows(3, 9), "start_seconds", "end_seconds", "fault") == {("a", 3.0, 9.0, None), ("b", 3.0, 3.0, "starts at or past the end")}
    done = convert(spark, str(folder), str(tmp_path / "out"), start=3.0, end=9.0)
    assert by_file(done.diagnostics, "code") >= {("a", "EMPTY_WINDOW"), ("b", "WINDOW"), ("a", "START_TIME_UNREADABLE"), ("b", "LEAP_SECOND_START")}
    assert list(done.written) == ["a_csv"] and lines(tmp_path / "out/a_csv/signals.csv") == ["time_s,EEG"]
    assert lines(tmp_path / "out/a_csv/annotations.csv") == ["onset_s,duration_s,description,record_index"]
    only = convert(spark, str(folder), str(tmp_path / "ev"), annotations_only=True)
    assert by_file(only.diagnostics, "code") >= {("b", "NO_ANNOTATIONS")} and only.written["b_csv"] == ["channels.csv", "metadata.json"]
    with pytest.raises(TimeRangeError):
        found.windows(1, 2, 3)
    before = found.checksums().collect()
    kept = spark.createDataFrame(before, found.checksums().schema)
    assert found.changed(kept).count() == 0
    with open(folder / "b.edf", "ab") as f:
        f.write(b"12345678")
    assert by_file(found.changed(kept), "code") == {("b", "INPUT_CHANGED")}
    import hashlib

    assert {r.sha256 for r in before if r.path.endswith("a.edf")} == {hashlib.sha256((folder / "a.edf").read_bytes()).hexdigest()}


def test_folders_links_and_names(spark, tmp_path):
    (tmp_path / "x").mkdir()
    write(tmp_path / "x/a.EDF", [EEG], [[[1, 2, 3, 4]]])
    (tmp_path / "link.edf").symlink_to(tmp_path / "x/a.EDF")
    (tmp_path / "x/loop").symlink_to(tmp_path)
    (tmp_path / "x/notes.txt").write_text("no")
    assert [p for p, _, _ in recordings_at(str(tmp_path))] == [str(tmp_path / "link.edf")]
    assert [p for p, _, _ in recordings_at(f"file://{tmp_path}/x/a.EDF")] == [f"file://{tmp_path}/x/a.EDF"]
    assert read_recording(spark, f"file://{tmp_path}/x/a.EDF", "samples").count() == 1
    names = column_names([{"signal_index": i, "label": s, "is_annotations": False} for i, s in enumerate(["T8", "T8", "T8_ch0", "T8_ch0_ch0", "T8_ch0_ch0_ch0", "time_s", ""])])
    assert len(set(names.values())) == 7 and names[6] == "signal_6" and names[5] == "time_s_ch5"


def test_command_line_and_survey(spark, tmp_path):
    path = write(tmp_path / "c.edf", [EEG, ECG], [[[1, 2, 3, 4], [5, 6]]] * 2)
    out = io.StringIO()
    assert main([path, "--info"], spark, out) == 0
    assert "signals_4hz.csv: 8 rows" in out.getvalue() and "#1 ECG [mV] 2 Hz, -5 to 5" in out.getvalue()
    assert main([path, "--stdout"], spark, out) == 2 and main([path, "--start", "5 min"], spark, out) == 2 and main([path, "--decimals", "0x2"], spark, out) == 2
    out = io.StringIO()
    assert main([path, "--stdout", "--channels", "ECG", "--start", "1s"], spark, out) == 0
    assert out.getvalue().splitlines() == ["time_s,ECG", "1.000,0.01343", "1.500,0.01587"]
    assert main([path, "-o", str(tmp_path / "o"), "--json"], spark, io.StringIO()) == 0 and main([path, "-o", str(tmp_path / "o")], spark, io.StringIO()) == 2
    assert main([path, "-o", str(tmp_path / "s"), "--strict"], spark, io.StringIO()) == 1
    (tmp_path / "bad.edf").write_bytes(b"0" * 300)
    assert main([str(tmp_path / "bad.edf"), "-o", str(tmp_path / "p")], spark, io.StringIO()) == 1


@pytest.mark.parametrize("value, decimals, text", [(1.005, 2, "1.00"), (2.5, 0, "3"), (-0.001, 2, "0.00"), (2.675, 2, "2.67"), (1e21, 1, "1000000000000000000000.0"), (float("nan"), 2, "")])
def test_fixed(value, decimals, text):
    assert fixed(value, decimals) == text


@pytest.mark.parametrize("text, seconds", [("90", 90), ("1:30", 90), ("1:01:30.5", 3690.5), ("-5", -5), ("1m30s", 90), ("2h", 7200), ("1h 30m 15s", 5415), ("250ms", 0.25), ("-1h30m", -5400), ("-00:01:40", -100)])
def test_times(text, seconds):
    assert seconds_of(text) == seconds


@pytest.mark.parametrize("text", ["", "5 min", "1m2m", "1:75", "abc", "120:30", "1:5.", "+5", "-+5", "- 5", "5x", "1h banana", "00:99:00", "-"])
def test_refused_times(text):
    with pytest.raises(ValueError):
        seconds_of(text)


def test_sizes_and_lengths():
    assert [bytes_text(n) for n in (0, 1023, 1536, 1 << 30)] == ["0 B", "1023 B", "1.5 KB", "1.0 GB"]
    assert [duration_text(s) for s in (0.5, 61, 3912.2)] == ["0.5s", "1m 01s", "1h 05m 12s"]
