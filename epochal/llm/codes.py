"""Vector codes by product quantisation on weighted distinct parts.

Vectors become integers and are cut into equal parts. Equal parts of one position are
put together with their number, so every later step takes time by distinct parts:
``rounds`` of weighted Lloyd, whose sums each task adds up before they meet, and the
last assignment. Codes and errors are then joined back to the parts of each vector. A
part that over one row in ten thousand has is broadcast, so that join is even whatever
the parts. Codebooks are all that the driver holds. All arithmetic is on integers.

Rows whose vector is null, empty or holds a null or a component that isn't finite are
dropped; so are vectors that can't be cut into equal parts and those whose length isn't
that of the vector with the smallest id. With fewer rows than entries codebooks are
shorter. Rows that repeat an id are rows of their own; among equal ids the smaller
integers come first, and rows without an id last. Components that don't fit errors of
63 bits (beyond 2^19 for 64 components) count as the largest that do; a label's error
is capped at 2^63 - 1. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SHARE, Workspace, looked_up, table

INTEGERS = "vec_id long, label string, dims int, keys array<binary>"
RESULT = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


def limit_of(dims: int) -> int:
    """Integers up to this keep a vector's error within 62 bits."""
    return math.isqrt((1 << 60) // dims)


def integers(vectors: DataFrame, parts: int, scale: int) -> DataFrame:
    """Kept vectors as keys, one a position: its number in two bytes, then four a component."""

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            for dims in np.unique(lengths[(lengths > 0) & (lengths % parts == 0)]):
                at = np.flatnonzero(lengths == dims)
                x = lists.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)  # nulls become nan
                finite = np.isfinite(x).all(1)
                at, most = at[finite], limit_of(int(dims))
                if not len(at):
                    continue
                with np.errstate(over="ignore"):
                    whole = np.clip(np.floor(x[finite] * scale), -most, most).astype("<i4")
                keys = np.empty((len(at), parts, 2 + 4 * dims // parts), np.uint8)
                keys[:, :, :2] = np.arange(parts, dtype=">u2").view(np.uint8).reshape(-1, 2)
                keys[:, :, 2:] = whole.view(np.uint8).reshape(len(at), parts, -1)
                ends = pa.array(np.arange(len(at) * parts + 1, dtype=np.int32) * keys.shape[2])
                flat = pa.Array.from_buffers(pa.binary(), len(at) * parts, [None, ends.buffers()[1], pa.py_buffer(keys.tobytes())])
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * parts), flat)
                where = pa.array(at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(2).take(where), pa.array(np.full(len(at), dims, np.int32)), rows], names=["vec_id", "label", "dims", "keys"])

    # a text that tells null from any label
    label = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", label.alias("label")).mapInArrow(run, INTEGERS)


def unkeyed(keys: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and integers of keys."""
    raw = np.frombuffer(b"".join(keys.to_pylist()), np.uint8).reshape(len(keys), 2 + 4 * width)
    return raw[:, :2].copy().view(">u2").ravel().astype(np.int64), raw[:, 2:].copy().view("<i4").astype(np.int64)


def nearest(positions: np.ndarray, x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row's codebook, the first of several, and its squared distance.

    Floating point is used where it is exact."""
    best, errors = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    for p in np.unique(positions):
        at, book = np.flatnonzero(positions == p), books[p]
        span = max(int(np.abs(book).max()), int(np.abs(x[at]).max()))
        if x.shape[1] * 4 * span * span < 2**53:
            a, b = x[at].astype(np.float64), book.astype(np.float64)
            distances = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
        else:
            distances = np.zeros((len(at), len(book)), np.int64)
            for j in range(x.shape[1]):
                distances += (x[at, j, None] - book[:, j]) ** 2
        best[at] = distances.argmin(1)
        errors[at] = distances[np.arange(len(at)), best[at]].astype(np.int64)
    return best, errors


def moved(distinct: DataFrame, books: np.ndarray, rows: int) -> np.ndarray:
    """The codebooks after one round: floored means of what is nearest to each entry."""
    parts, entries, width = books.shape
    kind = np.int64 if rows * limit_of(parts * width) < 2**62 else object

    def run(batches):
        sums, counts = np.zeros((parts, entries, width), kind), np.zeros((parts, entries), np.int64)
        for batch in batches:
            if batch.num_rows:
                positions, x = unkeyed(batch.column(0), width)
                n = batch.column(1).to_numpy(zero_copy_only=False)
                best, _ = nearest(positions, x, books)
                np.add.at(sums, (positions, best), (x.astype(kind) * n[:, None]).astype(kind))
                np.add.at(counts, (positions, best), n)
        p, e = np.nonzero(counts)
        columns = [np.repeat(p, width), np.repeat(e, width), np.tile(np.arange(width), len(p))]
        totals = pa.array([Decimal(int(v)) for v in sums[p, e].ravel()], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in columns), totals, pa.array(np.repeat(counts[p, e], width))], names=["part", "entry", "place", "total", "n"])

    found = distinct.mapInArrow(run, "part int, entry int, place int, total decimal(38, 0), n long")
    books = books.copy()
    for r in found.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # at most one a codebook's integer
        books[r.part, r.entry, r.place] = int(r.total) // r.n
    return books


def vector_codes(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """A row per kept vector: vec_id, code, error, label_error, codebooks_sha256."""
    spark = vectors.sparkSession
    work = Workspace(spark, "vector-codes")
    order = [F.asc_nulls_last("vec_id"), F.asc("keys")]
    whole = work.write(integers(vectors, parts, scale).withColumn("row", F.monotonically_increasing_id()), "integers")
    first = whole.orderBy(*order).first()
    if first is None:
        work.clear()
        return spark.createDataFrame([], RESULT)
    whole = whole.where(F.col("dims") == first.dims)
    seeds = whole.orderBy(*order).limit(entries).select("keys").toArrow()["keys"].combine_chunks()
    width, rows = first.dims // parts, whole.count()
    books = unkeyed(seeds.flatten(), width)[1].reshape(len(seeds), parts, width).transpose(1, 0, 2)
    distinct = work.write(whole.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")), "parts")
    work.forget_shuffles()
    for _ in range(rounds):
        books = moved(distinct, books, rows)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()

    def coded(batches):
        for batch in batches:
            best, errors = nearest(*unkeyed(batch.column(0), width), books) if batch.num_rows else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best), pa.array(errors)], names=["key", "n", "best", "error"])

    codes = distinct.mapInArrow(coded, "key binary, n long, best long, error long")
    asked = whole.select("row", F.posexplode("keys").alias("part", "key"))
    told = looked_up(asked, codes, "key", F.col("n") * SHARE > rows)
    digits = F.lower(F.lpad(F.hex("best"), 2, "0"))
    ordered = F.array_sort(F.collect_list(F.struct("part", digits.alias("digits"))))  # one a part
    each = told.groupBy("row").agg(F.array_join(F.transform(ordered, lambda x: x.digits), "").alias("code"), F.sum("error").alias("error"))
    answers = work.write(whole.select("row", "vec_id", "label").join(each, "row"), "answers")
    total = F.least(F.sum(F.col("error").cast("decimal(38, 0)")), F.lit(2**63 - 1).cast("decimal(38, 0)")).cast("long")
    labels = answers.groupBy("label").agg(total.alias("label_error"), F.count(F.lit(1)).alias("n"))
    work.clear(answers)
    found = looked_up(answers, labels, "label", F.col("n") * SHARE > rows)
    return found.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))
