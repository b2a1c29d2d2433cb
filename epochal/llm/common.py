"""Helpers that the operators share: tables, the shared scratch folder, words."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import scratch

#: Word separators of the contracts as a Java/Python regular expression class.
WORD_SPACE = r"[\x20\x09-\x0D]"
#: A key of more than one row in so many is broadcast; there are fewer than so many.
SHARE = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def removed(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    This cuts the lineage in a way that survives lost executors.
    """
    path = scratch(df.sparkSession, label)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Workspace:
    """Scratch tables of one operator's run, deleted once its result no longer needs them."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label = spark, label
        self.tables: list[tuple[str, DataFrame]] = []
        self.named: dict[str, str] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch(self.spark, f"{self.label}-{name}")
        df.write.parquet(path)
        self.tables.append((path, self.spark.read.schema(df.schema).parquet(path)))
        return self.tables[-1][1]

    def bucketed(self, df: DataFrame, name: str, count: int) -> DataFrame:
        """As ``write``, in ``count`` buckets by ``part`` and folders by ``kind``, so that
        joins by ``part`` move the other side alone."""
        path, called = scratch(self.spark, f"{self.label}-{name}"), f"epochal_{uuid.uuid4().hex}"
        df.write.partitionBy("kind").bucketBy(count, "part").option("path", path).saveAsTable(called)
        self.named[path] = called
        self.tables.append((path, self.spark.table(called)))
        return self.tables[-1][1]

    def forget_shuffles(self) -> None:
        """Let the driver drop shuffle files that no table to come reads."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, df: DataFrame) -> None:
        """Delete a table that nothing reads any more, and let go of shuffles."""
        self.clear(*(t for _, t in self.tables if t is not df))
        self.forget_shuffles()

    def clear(self, *keep: DataFrame) -> None:
        """Delete all tables but those given."""
        for path, df in self.tables:
            if not any(df is k for k in keep):
                if path in self.named:
                    self.spark.sql(f"DROP TABLE IF EXISTS {self.named[path]}")
                removed(self.spark, path)
        self.tables = [t for t in self.tables if any(t[1] is k for k in keep)]


def looked_up(rows: DataFrame, answers: DataFrame, key: str, hot: Column) -> DataFrame:
    """``rows`` with the other columns of ``answers``, which has a row a key, or nulls.

    Few keys are ``hot``; their rows stay where they are or go anywhere."""
    values = [c for c in answers.columns if c != key]
    few = F.broadcast(answers.where(hot).select(F.col(key).alias("__few"), F.struct(*values).alias("__hot")))
    dealt = rows.join(few, F.col(key) == F.col("__few"), "left").drop("__few")
    dealt = dealt.withColumn("__deal", F.when(F.col("__hot").isNull(), F.lit(-1).cast("long")).otherwise(F.monotonically_increasing_id()))
    rest = answers.where(~hot).select(key, F.struct(*values).alias("__rest"), F.lit(-1).cast("long").alias("__deal"))
    found = dealt.join(rest, [key, "__deal"], "left").withColumn("__found", F.coalesce("__hot", "__rest"))
    return found.select(*rows.columns, *(F.col(f"__found.{v}").alias(v) for v in values))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let at most ``rows`` rows cross to Python at once in this session, since texts can be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def binary_column(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column of a batch as bytes; nulls become empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def split_words(text: bytes) -> list[bytes]:
    """Lower-case A-Z and split at space and U+0009 to U+000D.

    ``bytes.lower`` and ``bytes.split`` know ASCII only, which is the contract.
    """
    return text.lower().split()


def hash_words(words: list[bytes], memo: dict[bytes, int]) -> np.ndarray:
    """64-bit hashes of words; ``memo`` saves hashing the frequent ones again."""
    if len(memo) > 200_000:
        memo.clear()
    for w in set(words).difference(memo):
        memo[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that sums of products spread well."""
    x = x ^ (x >> np.uint64(31))
    x = x * _M2
    return x ^ (x >> np.uint64(29))


#: The lowest bytes of a number.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def groups(texts: list, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most ``most`` characters, or of one text."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        if k > first and size + len(t) > most:
            yield first, k
            first, size = k, 0
        size += len(t)
    if texts:
        yield first, len(texts)


def hashes_at(data: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of pieces of ``data``, eight bytes of all at a time; at least eight bytes follow the last."""
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    h, own, k = sizes.astype(np.uint64), np.flatnonzero(sizes <= 256), 0
    while len(own):
        h[own] = mixed(mixed(h[own] * _M1 + (eight[starts[own] + k] & _LOW[np.minimum(sizes[own] - k, 8)])) * _M1)
        k += 8
        own = own[sizes[own] > k]
    for i in np.flatnonzero(sizes > 256):
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : starts[i] + sizes[i]])
    return h


def hashed_words(texts: list[bytes]) -> Iterator[np.ndarray]:
    """64-bit hashes of each text's words, which are those of ``split_words``, made eight bytes
    of all words at a time."""
    for a, b in groups(texts):
        data = b" " + b" ".join(texts[a:b]).lower() + bytes([32] * 9)
        at = np.frombuffer(data, np.uint8)
        space = (at == 32) | (at - np.uint8(9) < 5)
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        starts, sizes = edges[::2], edges[1::2] - edges[::2]
        h = hashes_at(data, starts, sizes)
        ends = np.cumsum([len(t) + 1 for t in texts[a:b]])
        yield from np.split(h, np.searchsorted(starts, ends[:-1] + 1))


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words, or of the whole shorter sequence."""
    if not len(hashes):
        return hashes
    width = min(width, len(hashes))
    n = len(hashes) - width + 1
    out = np.full(n, np.uint64(width))
    for k in range(width):
        out = mixed(out * _M1 + hashes[k : k + n])
    return out
