"""One file a table, claims, folders, runs of records, pushed filters and growing recordings."""

import gzip
import random
import threading

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

from epochal.operators import timing
from epochal.plans.convert import convert, folder_name, folder_of, open_recordings
from epochal.plans.render import rendered
from epochal.sinks import committed
from epochal.sources.binary import Opened, PushingReader, read_growing
from files import write

A, B = ("A", "u", -100, 100, -1000, 1000, 4), ("B,2", "u", -100, 100, -1000, 1000, 3)
MARKS = ("EDF Annotations", "", -1, 1, -32768, 32767, 30)


def tal(t):
    return f"+{t}\x14\x14\0".encode()


def recording(path, n=60, signals=(A, B), **header):
    rng = random.Random(n)
    return write(path, list(signals), [[[rng.randrange(-1000, 1000) for _ in range(s[6])] for s in signals] for _ in range(n)], **header)


@pytest.mark.parametrize("layout, compress, bom", [("wide", False, True), ("long", True, False)])
def test_a_table_is_one_file_as_one_task_renders_it(spark, tmp_path, layout, compress, bom):
    path = recording(tmp_path / "m.edf", 300)
    options = {"layout": layout, "gzip": compress, "decimals": None, "bom": bom, "window": (None, None)}
    blocks = [r for b in rendered(iter(open_recordings(spark, path).packed().toArrow().to_batches()), lambda _: "m_csv", options) for r in b.to_pylist()]
    done = convert(spark, path, str(tmp_path / "out"), layout=layout, gzip=compress, bom=bom)
    files = {r.table: r for r in done.files.collect()}
    for table in {b["table"] for b in blocks}:
        own = [b for b in blocks if b["table"] == table]
        want = "\n".join([own[0]["header"], *(b["value"] for b in own)]) + "\n"
        raw = (tmp_path / "out/m_csv" / table).read_bytes()
        assert (gzip.decompress(raw) if compress else raw).decode() == want
        assert files[table].bytes == len(raw) and files[table].n_rows == sum(b["n_rows"] for b in own)
        assert spark.read.text(str(tmp_path / "out/m_csv" / table)).count() == want.count("\n")  # members of gzip are read in a row
    assert not [p for p in (tmp_path / "out").rglob(".*")]


def test_parts_of_many_tasks_stand_in_their_order(spark, tmp_path):
    out = tmp_path / "o"
    (out / "r").mkdir(parents=True)
    rows = spark.range(0, 1000, 1, 7).select(F.lit("r").alias("recording"), F.concat(F.lit("t"), F.col("id") % 2).alias("table"), F.col("id").cast("string").alias("value"), F.lit(1).cast("long").alias("n_rows"), F.lit("head").alias("header"))
    done = {r.table: r for r in committed.write_tables(rows, str(out))}
    for k in (0, 1):
        assert (out / f"r/t{k}").read_text() == "\n".join(["head", *map(str, range(k, 1000, 2))]) + "\n"
        assert done[f"t{k}"].n_rows == 500
    assert committed.write_tables(rows.where("false"), str(out)) == []


def test_a_failed_task_leaves_no_table(spark, tmp_path):
    (tmp_path / "r").mkdir()

    def fail(batches):
        for k, b in enumerate(batches):
            yield b
            raise RuntimeError("lost")

    rows = spark.range(10).select(F.lit("r").alias("recording"), F.lit("t").alias("table"), F.lit("x").alias("value"), F.lit(1).cast("long").alias("n_rows"), F.lit(None).cast("string").alias("header"))
    with pytest.raises(Exception, match="lost"):
        committed.write_tables(rows.mapInArrow(fail, committed.BLOCKS), str(tmp_path))
    assert list(tmp_path.rglob("*")) == [tmp_path / "r"]


def test_of_two_runs_into_one_folder_one_is_refused(spark, tmp_path):
    path, out = recording(tmp_path / "m.edf", 40), str(tmp_path / "out")
    told = []

    def run():
        try:
            told.append(convert(spark, path, out).written)
        except committed.OutputExists as e:
            told.append(str(e))

    runs = [threading.Thread(target=run) for _ in range(2)]
    for r in runs:
        r.start()
    for r in runs:
        r.join()
    assert sorted(isinstance(t, str) for t in told) == [False, True]
    assert sorted(p.name for p in (tmp_path / "out/m_csv").iterdir()) == ["channels.csv", "metadata.json", "signals_3hz.csv", "signals_4hz.csv"]
    with pytest.raises(committed.OutputExists, match="exists"):
        convert(spark, path, out)


def test_a_claim_that_another_run_holds_stands_even_when_forced(spark, tmp_path):
    path = recording(tmp_path / "m.edf", 4)
    (tmp_path / "out/m_csv").mkdir(parents=True)
    (tmp_path / "out/m_csv/.claimed").write_text("other")
    with pytest.raises(committed.OutputExists, match="another run"):
        convert(spark, path, str(tmp_path / "out"), force=True)
    assert (tmp_path / "out/m_csv/.claimed").read_text() == "other"


def test_folders_come_out_in_folders(spark, tmp_path):
    for folder in ("a", "b/c"):
        (tmp_path / "in" / folder).mkdir(parents=True)
        recording(tmp_path / "in" / folder / "rec.edf", 3)
    done = convert(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert sorted(done.written) == ["a/rec_csv", "b/c/rec_csv"]
    assert (tmp_path / "out/b/c/rec_csv/signals_4hz.csv").read_text() == (tmp_path / "out/a/rec_csv/signals_4hz.csv").read_text()
    paths = ["/x/in/a/r.edf", "/x/in/r.v2.bdf", "/y/r.edf", "/x/in/d.d/r", "r.edf"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string").select("path", folder_of(F.col("path"), "/x/in").alias("folder")).collect()
    assert {r.path: r.folder for r in rows} == {p: folder_name(p, "/x/in") for p in paths}
    assert folder_name(paths[1], "/x/in") == "r.v2_csv" and folder_name(paths[0], "/x/in") == "a/r_csv"


def test_nested_destinations_and_inputs_are_refused(spark, tmp_path):
    (tmp_path / "in/x_csv").mkdir(parents=True)
    recording(tmp_path / "in/x.edf", 2)
    recording(tmp_path / "in/x_csv/y.edf", 2)
    with pytest.raises(ValueError, match="holds the folder of another|overwrite"):
        convert(spark, str(tmp_path / "in"), str(tmp_path / "in"), force=True)
    recording(tmp_path / "in/x.bdf", 2)
    with pytest.raises(ValueError, match="or is it"):
        convert(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()
    (tmp_path / "link").symlink_to(tmp_path / "real")
    targets = spark.createDataFrame([(str(tmp_path / "link/a"),), (str(tmp_path / "real/a/b"),), (str(tmp_path / "real/c"),)], "folder string")
    sources = spark.createDataFrame([(str(tmp_path / "real/c/r.edf"),)], "path string")
    assert {(r.folder.rpartition("/")[2], r.why.split()[0]) for r in committed.nested(targets, sources).collect()} == {("a", "holds"), ("c", "would")}


def test_rows_of_runs_are_those_of_their_records(spark):
    """Counts in closed form against a sum over records, with awkward starts, rates and bounds."""
    rng, rows = random.Random(5), []
    for k in range(400):
        duration = rng.choice([1.0, 0.1, 0.3, 2.5, 1e-3])
        base, first, n = rng.choice([0.0, 0.5, -3.0, 1e6 + 0.1]), rng.randrange(5), rng.randrange(1, 40)
        spr = rng.choice([1, 3, 4, 250])
        since = base + (first + rng.uniform(-2, n + 2)) * duration
        if rng.random() < 0.4:
            since = base + (first + rng.randrange(n + 1)) * duration + rng.randrange(3) * duration / spr
        rows.append((k, first, n, duration, base + first * duration, base, spr / duration, spr, since, since + rng.choice([0.0, 0.7, 3.0, 100.0]) * duration))
    df = spark.createDataFrame(rows, "k long, first_record long, records long, record_duration_seconds double, start_s double, base_s double, rate double, spr long, a double, b double")
    c = F.col
    found = {r.k: r.n for r in df.select("k", timing.rows_in_run(c("rate"), c("spr"), c("a"), c("b")).alias("n")).collect()}
    each = df.select("*", F.explode(F.sequence(c("first_record"), c("first_record") + c("records") - 1)).alias("i"))
    start = c("base_s") + c("i") * c("record_duration_seconds")
    upto = lambda bound: F.least(c("spr"), F.greatest(F.lit(0), F.ceil((bound - F.least(F.lit(1e-9), F.lit(0.5) / c("rate")) - start) * c("rate"))))
    want = {r.k: r.n for r in each.groupBy("k").agg(F.sum(F.greatest(F.lit(0), upto(c("b")) - upto(c("a")))).alias("n")).collect()}
    assert found == want and any(found.values())


def test_runs_of_a_recording_with_gaps(spark, tmp_path):
    starts = [0, 1, 2, 10, 11, 5, 6, 6.5, 7.5]
    path = write(tmp_path / "d.edf", [A, MARKS], [[[1, 2, 3, 4], tal(t)] for t in starts], reserved="EDF+D")
    found = open_recordings(spark, path)
    runs = [(r.first_record, r.records, r.start_s) for r in found.runs.orderBy("first_record").collect()]
    assert runs == [(0, 3, 0.0), (3, 2, 10.0), (5, 2, 5.0), (7, 2, 6.5)]
    assert found.spans().first()[1:] == (0.0, 12.0)
    plain = open_recordings(spark, recording(tmp_path / "p.edf", 50))
    assert [(r.first_record, r.records) for r in plain.runs.collect()] == [(0, 50)]


def bytes_read(path, stream, *filters):
    """The bytes that a scan of a file reads under filters, and its rows."""
    seen, at = [0], Opened.at

    def counting(self, start, size):
        seen[0] += size
        return at(self, start, size)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(Opened, "at", counting)
        reader = PushingReader({"path": path, "stream": stream})
        assert list(reader.pushFilters(list(filters))) == list(filters)  # Spark applies them too
        rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    return seen[0], rows


def test_filters_choose_what_is_read(spark, tmp_path):
    path = recording(tmp_path / "m.edf", 2000, (A, ("C", "u", -1, 1, -1000, 1000, 400)))
    whole, every = bytes_read(path, "values")
    filters = [GreaterThanOrEqual(("time_s",), 10.0), LessThan(("time_s",), 20.0), EqualTo(("signal_index",), 0)]
    some, rows = bytes_read(path, "values", *filters)
    want = [r for r in every if 10 <= r["time_s"] < 20 and r["signal_index"] == 0]
    assert [r for r in rows if 10 <= r["time_s"] < 20] == want and len(rows) <= 4 * 14
    assert some < 768 + 14 * 8 + 1000 < whole / 100
    few, rows = bytes_read(path, "samples", In(("column_name",), ("A",)), EqualTo(("record_index",), 7))
    assert few < 1100 and [r["record_index"] for r in rows] == [7]
    assert bytes_read(path, "values", EqualTo(("path",), "other"))[1] == []
    open_recordings(spark, path).views()
    got = spark.sql("SELECT record_index, sample_index, time_s, value FROM samples WHERE time_s >= 10 AND 20 > time_s AND signal_index = 0").collect()
    assert sorted(map(tuple, got)) == sorted((r["record_index"], r["sample_index"], r["time_s"], r["value"]) for r in want)


def test_growing_recordings_give_each_record_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    path, out = tmp_path / "in/g.edf", str(tmp_path / "out")
    recording(path, 5, declared=-1)
    (tmp_path / "in/new.edf").write_bytes(b"0   ")  # its header isn't whole yet

    def run():
        stream = read_growing(spark, str(tmp_path / "in"), sliceBytes=30).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "offsets")).trigger(availableNow=True).start(out)
        stream.awaitTermination()
        return sorted((r.record_index, r.signal_index, tuple(r.digital)) for r in spark.read.parquet(out).where("path like '%g.edf'").collect())

    assert len(run()) == 10
    with open(path, "ab") as f:
        f.write(bytes(14 * 2 + 5))  # two records and a part of one
    assert len(run()) == 14
    with open(path, "ab") as f:
        f.write(bytes(9))
    recording(tmp_path / "in/new.edf", 3)
    rows = run()
    assert [r[:2] for r in rows] == [(k, s) for k in range(8) for s in (0, 1)]
    whole = open_recordings(spark, str(path)).packed().collect()
    assert rows == sorted((r.record_index, r.signal_index, tuple(r.digital)) for r in whole)
    with open(path, "r+b") as f:
        f.truncate(800)
    with pytest.raises(Exception, match="had 8 records"):
        run()


def test_tables_of_blocks_know_their_columns():
    assert [f.split()[0] for f in committed.BLOCKS.split(", ")] == committed.BLOCK.names and isinstance(committed.PARTS, pa.Schema)
