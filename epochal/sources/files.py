"""Files of any store that Arrow's file systems know, for tasks that read byte ranges."""

from __future__ import annotations

import os
from threading import Lock
from weakref import WeakKeyDictionary

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource


KNOWN: WeakKeyDictionary[SparkSession, set[str]] = WeakKeyDictionary()
LOCK = Lock()


def registered(spark: SparkSession, source: type[DataSource]) -> None:
    """Make a data source known to a session, once: a source that is made known anew is unknown meanwhile."""
    with LOCK:
        if source.name() not in KNOWN.setdefault(spark, set()):
            spark.dataSource.register(source)
            KNOWN[spark].add(source.name())


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path and the path in it; without a scheme, this machine's."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    if path.startswith("file:"):
        path = path[5:]
    return fs.LocalFileSystem(), os.path.abspath(path)


def full_name(path: str, name: str) -> str:
    """A name that a store gave, as a path of the kind that was asked for."""
    return f"{path.split('://', 1)[0]}://{name.lstrip('/') if not path.startswith(('file://', 'hdfs://')) else name}" if "://" in path else name


def recordings_at(path: str) -> list[tuple[str, int, int]]:
    """(path, bytes, modified in ns) of a file, or of the recordings below a folder in
    name order; a file that links lead to several times is there once, by its first name."""
    store, plain = opened(path)
    top = store.get_file_info(plain)
    if top.type != fs.FileType.Directory:
        return [(path, top.size or 0, top.mtime_ns or 0)]
    if isinstance(store, fs.LocalFileSystem):
        found, seen = {}, set()
        for folder, inner, names in os.walk(plain, followlinks=True):
            seen.add(os.path.realpath(folder))
            inner[:] = sorted(d for d in inner if os.path.realpath(os.path.join(folder, d)) not in seen)
            for name in names:
                if name.lower().endswith((".edf", ".bdf")) and os.path.isfile(full := os.path.join(folder, name)):
                    real = os.path.realpath(full)
                    found[real] = min(found.get(real, full), full)
        return [(p, os.path.getsize(p), os.stat(p).st_mtime_ns) for p in sorted(found.values())]
    infos = store.get_file_info(fs.FileSelector(plain, recursive=True))
    return sorted((full_name(path, i.path), i.size, i.mtime_ns or 0) for i in infos if i.type == fs.FileType.File and i.path.lower().endswith((".edf", ".bdf")))


def copied_tree(spark: SparkSession, folder: str, target: str) -> None:
    """Copy the recordings below a folder by tasks; their places below it stay."""
    rows = spark.createDataFrame([(p,) for p, _, _ in recordings_at(folder)], "path string")
    root = opened(folder)[1] if "://" not in folder else folder.rstrip("/")

    def copy(batches):
        for batch in batches:
            for p in batch.column(0).to_pylist():
                store, to = opened(f"{target}/{p[len(root) + 1 :]}")
                store.create_dir(to.rpartition("/")[0], recursive=True)
                source, plain = opened(p)
                fs.copy_files(plain, to, source_filesystem=source, destination_filesystem=store)
            yield batch

    rows.repartition(spark.sparkContext.defaultParallelism).mapInArrow(copy, "path string").write.format("noop").mode("overwrite").save()
