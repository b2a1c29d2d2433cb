"""Tables of text as one file each, written by many tasks and committed together.

``committed`` is a data source that takes blocks of lines (``BLOCKS``). Each task
writes its blocks of a table to a part of its own, in a draft folder, and its commit
message lists the parts with their sizes and rows; the commit tells from them where each
part goes and how large each table is, an abort deletes the draft. ``assembled`` then lays the parts of a table end
to end behind its one header, in the order of the tasks: on a file system that takes
writes at any place, each part is copied to its place by a task of its own, elsewhere a
task streams a table's parts. Members of gzip may follow each other, so compressed
parts do too. A table gets its name, by a rename in a task, once all of its bytes are
there; readers see the old table or the new one.

A folder is claimed by a file that only one run can make. Claims are checked and made
by tasks, with all that would be overwritten, before anything is written.
"""

from __future__ import annotations

import gzip
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..sources.files import opened, registered

BLOCKS = "recording string, table string, value string, n_rows long, header string"
BLOCK = pa.schema([("recording", pa.string()), ("table", pa.string()), ("value", pa.string()), ("n_rows", pa.int64()), ("header", pa.string())])
PARTS = pa.schema([("recording", pa.string()), ("table", pa.string()), ("task", pa.int64()), ("place", pa.int64()), ("path", pa.string()), ("bytes", pa.int64()), ("n_rows", pa.int64()), ("head", pa.binary())])
WRITTEN = "recording string, table string, bytes long, n_rows long"
CLAIM, CHUNK = ".claimed", 8 << 20


class OutputExists(FileExistsError):
    """The folder of a conversion is there already, or another run is writing it."""


class Parts(WriterCommitMessage):
    """What a task wrote, as columns of ``PARTS``."""

    def __init__(self, parts: dict):
        self.parts = parts


class Part:
    """An open part of a table."""

    def __init__(self, recording: str, table: str, header: str | None, draft: str, compress: bool, task: int, place: int):
        store, plain = opened(draft)
        self.path = f"{draft}/{task:08}-{place:06}-{uuid.uuid4().hex}"
        store.create_dir(plain, recursive=True)
        self.raw = store.open_output_stream(opened(self.path)[1])
        self.out = gzip.GzipFile("", "wb", 6, self.raw, 0) if compress else self.raw
        head = b"" if header is None else (header + "\n").encode()
        self.row = {"recording": recording, "table": table, "task": task, "place": place, "path": self.path, "bytes": 0, "n_rows": 0, "head": gzip.compress(head, 6, mtime=0) if compress and head else head}
        self.empty = True

    def add(self, value: pa.Scalar, n_rows: int) -> None:
        self.row["n_rows"] += n_rows
        if value.is_valid:
            self.out.write(value.as_buffer())
            self.out.write(b"\n")
            self.empty = False

    def closed(self) -> dict:
        if self.out is not self.raw and not self.empty:
            self.out.close()
        self.row["bytes"] = self.raw.tell()
        self.raw.close()
        return self.row


class CommittedWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.draft, self.compress = options["draft"], options.get("gzip", "false") == "true"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Parts:
        task, rows, parts = TaskContext.get().partitionId(), [], {}
        for batch in iterator:
            columns = [batch.column(n).to_pylist() for n in ("recording", "table", "n_rows", "header")]
            values = batch.column("value")
            for k, (recording, table, n_rows, header) in enumerate(zip(*columns, strict=True)):
                if (recording, table) not in parts:
                    if parts and next(iter(parts))[0] != recording:  # a recording's tables stand together
                        rows += [p.closed() for p in parts.values()]
                        parts = {}
                    parts[recording, table] = Part(recording, table, header, self.draft, self.compress, task, len(rows) + len(parts))
                parts[recording, table].add(values[k], n_rows)
        rows += [p.closed() for p in parts.values()]
        return Parts({n: [r[n] for r in rows] for n in PARTS.names})

    def commit(self, messages: list[Parts | None]) -> None:
        """Write down where each part goes in its table, and how large each table is."""
        found = pa.concat_tables([pa.table(m.parts, PARTS) for m in messages if m is not None] or [PARTS.empty_table()])
        found = found.sort_by([(n, "ascending") for n in ("recording", "table", "task", "place")])
        rows, tables, key = {"at": [], "first": []}, [], None
        for recording, table, size, n_rows, head in zip(*(found[n].to_pylist() for n in ("recording", "table", "bytes", "n_rows", "head")), strict=True):
            rows["first"].append(key != (recording, table))
            if key != (recording, table):
                key = recording, table
                tables.append([recording, table, len(head), 0])
            rows["at"].append(tables[-1][2])
            tables[-1][2] += size
            tables[-1][3] += n_rows
        store, plain = opened(self.draft)
        for name in ("parts", "tables"):
            store.create_dir(f"{plain}/{name}", recursive=True)
        pq.write_table(found.append_column("at", pa.array(rows["at"], pa.int64())).append_column("first", pa.array(rows["first"], pa.bool_())), f"{plain}/parts/0.parquet", filesystem=store)
        columns = list(zip(*tables, strict=True)) or [[]] * 4
        pq.write_table(pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["recording", "table", "bytes", "n_rows"]), f"{plain}/tables/0.parquet", filesystem=store)

    def abort(self, messages: list[Parts | None]) -> None:
        store, plain = opened(self.draft)
        if store.get_file_info(plain).type == fs.FileType.Directory:
            store.delete_dir(plain)


class Committed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "committed"

    def writer(self, schema, overwrite: bool) -> CommittedWriter:
        return CommittedWriter(dict(self.options))


def copied(path: str, target: int, at: int, size: int) -> None:
    """Copy a part to its place in an open file."""
    with open(path, "rb") as f:
        done = 0
        while done < size:
            moved = os.copy_file_range(f.fileno(), target, size - done, done, at + done)
            if not moved:
                raise OSError(f"{path} is shorter than it was")
            done += moved


def assembled(spark: SparkSession, draft: str, out: str) -> DataFrame:
    """(recording, table, bytes, n_rows) of the tables of a committed draft, made one file each."""
    parts, run = spark.read.parquet(f"{draft}/parts"), draft.rsplit("-", 1)[-1]
    local = isinstance(opened(out)[0], fs.LocalFileSystem)
    target = lambda recording, table: f"{opened(out)[1]}/{recording}/.{table}.{run}"

    def placed(batches):
        for batch in batches:
            for r in batch.to_pylist():
                path = target(r["recording"], r["table"])
                file = os.open(path, os.O_CREAT | os.O_WRONLY, 0o666)
                try:
                    if r["first"]:
                        os.pwrite(file, r["head"], 0)
                    if r["bytes"]:
                        copied(opened(r["path"])[1], file, r["at"], r["bytes"])
                finally:
                    os.close(file)
            yield batch.select(["path"])

    def named(batches):
        for batch in batches:
            for r in batch.to_pylist():
                path, final = target(r["recording"], r["table"]), f"{opened(out)[1]}/{r['recording']}/{r['table']}"
                size = os.path.getsize(path if os.path.exists(path) else final)  # a lost attempt may have named it
                if size != r["bytes"]:
                    raise OSError(f"{r['recording']}/{r['table']} has {size} bytes and not {r['bytes']}")
                if os.path.exists(path):
                    os.replace(path, final)
            yield batch

    def streamed(found: pa.Table) -> pa.Table:
        rows = sorted(found.to_pylist(), key=lambda r: (r["task"], r["place"]))
        name = f"{out}/{rows[0]['recording']}/{rows[0]['table']}"
        store, plain = opened(name)
        hidden = isinstance(store, fs.HadoopFileSystem)  # elsewhere a file is there once it is whole
        at = opened(f"{out}/{rows[0]['recording']}/.{rows[0]['table']}.{run}")[1] if hidden else plain
        with store.open_output_stream(at) as f:
            f.write(rows[0]["head"])
            for r in rows:
                with store.open_input_stream(opened(r["path"])[1]) as part:
                    while data := part.read(CHUNK):
                        f.write(data)
        if hidden:
            if store.get_file_info(plain).type != fs.FileType.NotFound:
                store.delete_file(plain)
            store.move(at, plain)
        sums = [len(rows[0]["head"]) + sum(r["bytes"] for r in rows), sum(r["n_rows"] for r in rows)]
        return pa.table({"recording": [rows[0]["recording"]], "table": [rows[0]["table"]], "bytes": [sums[0]], "n_rows": [sums[1]]})

    if not local:
        return parts.groupBy("recording", "table").applyInArrow(streamed, WRITTEN)
    tasks = spark.sparkContext.defaultParallelism
    parts.repartition(tasks).mapInArrow(placed, "path string").write.format("noop").mode("overwrite").save()
    # nothing is placed again once tables get their names
    return spark.read.schema(WRITTEN).parquet(f"{draft}/tables").repartition(tasks).mapInArrow(named, WRITTEN)


def write_whole(rows: DataFrame, out: str) -> list:
    """Write rows (recording, table, value), each the whole of a small file. Returns as ``write_tables``."""
    run = uuid.uuid4().hex

    def write(batches):
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                store, plain = opened(f"{out}/{r['recording']}/{r['table']}")
                hidden = f"{plain.rpartition('/')[0]}/.{r['table']}.{run}-{uuid.uuid4().hex}" if isinstance(store, (fs.LocalFileSystem, fs.HadoopFileSystem)) else plain
                data = (r["value"] + "\n").encode()
                with store.open_output_stream(hidden) as f:
                    f.write(data)
                if isinstance(store, fs.LocalFileSystem):
                    os.replace(hidden, plain)
                elif hidden != plain:
                    if store.get_file_info(plain).type != fs.FileType.NotFound:
                        store.delete_file(plain)
                    store.move(hidden, plain)
                done.append((r["recording"], r["table"], len(data), 1))
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["recording", "table", "bytes", "n_rows"])

    return rows.select("recording", "table", "value").mapInArrow(write, WRITTEN).collect()  # a row a file


def write_tables(blocks: DataFrame, out: str, gzip: bool = False) -> list:
    """Write blocks to one file a table, ``out/recording/table``, whose folders are there.

    Returns a row (recording, table, bytes, n_rows) a table."""
    spark, draft = blocks.sparkSession, f"{out}/.draft-{uuid.uuid4().hex}"
    registered(spark, Committed)
    spark._jvm.SparkSession.setActiveSession(spark._jsparkSession)  # where a thread's writers look for their source
    try:
        blocks.select(*BLOCK.names).write.format("committed").options(draft=draft, gzip=str(gzip).lower()).mode("append").save()
        return assembled(spark, draft, out).collect()  # a row a table
    finally:
        store, plain = opened(draft)
        if store.get_file_info(plain).type == fs.FileType.Directory:
            store.delete_dir(plain)


def above(path: Column) -> Column:
    """A path and all folders that it is in."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def real_paths(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` with its paths of this machine's files as they are without links."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(name)
            paths = [os.path.realpath(plain) if isinstance(store, fs.LocalFileSystem) else p for p in batch.column(at).to_pylist() for store, plain in [opened(p)]]
            yield batch.set_column(at, name, pa.array(paths, pa.string()))

    return frame.mapInArrow(run, frame.schema)


def nested(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """(folder, why): folders (``targets``) that are equal to or inside another, or hold one of ``sources``."""
    own = real_paths(targets.select("folder"), "folder").withColumn("asked", F.monotonically_increasing_id())
    inner = own.select(F.col("asked").alias("inner"), F.explode(above(F.col("folder"))).alias("folder"))
    both = own.join(inner, "folder").where("asked <> inner").select("folder", F.lit("holds the folder of another recording, or is it").alias("why"))
    read = real_paths(sources.select(F.col("path").alias("folder")), "folder").select(F.explode(above(F.col("folder"))).alias("folder")).distinct()
    return both.unionByName(own.join(read, "folder", "left_semi").select("folder", F.lit("would overwrite what it is read from").alias("why"))).distinct()


def claim(targets: DataFrame, run: str, force: bool) -> DataFrame:
    """(folder, why): what hinders this run to write each of ``targets`` (folder); the others are claimed."""

    def make(batches):
        for batch in batches:
            told = []
            for folder in batch.column(0).to_pylist():
                store, plain = opened(folder)
                store.create_dir(plain, recursive=True)
                marked = f"{plain}/{CLAIM}"
                if isinstance(store, fs.LocalFileSystem):
                    try:
                        file = os.open(marked, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
                    except FileExistsError:
                        with open(marked, "rb") as f:
                            mine = f.read() == run.encode()  # by an attempt of this task that was lost
                        if not mine:
                            told.append((folder, "is being written by another run"))
                            continue
                    else:
                        os.write(file, run.encode())
                        os.close(file)
                else:
                    if store.get_file_info(marked).type == fs.FileType.NotFound:
                        with store.open_output_stream(marked) as f:
                            f.write(run.encode())
                    with store.open_input_stream(marked) as f:
                        if f.read() != run.encode():
                            told.append((folder, "is being written by another run"))
                            continue
                if not force and any(i.base_name != CLAIM for i in store.get_file_info(fs.FileSelector(plain))):
                    told.append((folder, "exists"))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*told, strict=True)] if told else [pa.array([], pa.string())] * 2, names=["folder", "why"])

    return targets.select("folder").mapInArrow(make, "folder string, why string")


def released(targets: DataFrame, run: str) -> None:
    """Take this run's claims back; folders that hold nothing else go."""

    def drop(batches):
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                store, plain = opened(folder)
                marked = f"{plain}/{CLAIM}"
                if store.get_file_info(marked).type != fs.FileType.NotFound:
                    with store.open_input_stream(marked) as f:
                        mine = f.read() == run.encode()
                    if mine:
                        store.delete_file(marked)
                        if not store.get_file_info(fs.FileSelector(plain)):
                            store.delete_dir(plain)
            yield batch

    targets.select("folder").mapInArrow(drop, "folder string").write.format("noop").mode("overwrite").save()
