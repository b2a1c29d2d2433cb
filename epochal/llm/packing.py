"""Best-fit decreasing packing of tokenised documents.

Each task packs pools of its own documents: no shuffle, and a pool is closed
after ``pool_tokens`` ids, so memory is bounded whatever the partition. Texts
of over 4096 ids are cut into full windows first; the rest goes, longest
first, to the tightest open window, found in a segment tree by remaining
capacity. A window left with more than ``slack`` free places is cut into
power-of-two sequences, which need no padding.

Null texts are empty: their end id alone is packed. Repeated rows are packed
each; ties go in input order; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import binary_column, small_batches, table
from .tokens import word_ids

FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]


class CapacityTree:
    """Which remaining capacities have open windows; asks for the least that fits."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: dict[int, list[int]] = {}

    def add(self, capacity: int, window: int) -> None:
        self.open.setdefault(capacity, []).append(window)
        at = capacity + self.size
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, needed: int) -> tuple[int, int] | None:
        """The fullest open window with ``needed`` places: (capacity, window)."""
        at = needed + self.size
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at *= 2
                if not self.count[at]:
                    at += 1
        capacity = at - self.size
        while at:
            self.count[at] -= 1
            at >>= 1
        return capacity, self.open[capacity].pop()


def pack(lengths: list[int], width: int, slack: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of all pieces."""
    out, rests, sequence = [], [], 0
    for d, n in enumerate(lengths):
        for start in range(0, n - n % width, width):
            out.append((d, start, width, sequence, 0))
            sequence += 1
        if n % width:
            rests.append((n % width, d))
    tree, windows = CapacityTree(width), []
    for n, d in sorted(rests, key=lambda x: -x[0]):
        capacity, w = tree.take(n) or (width, len(windows))
        if w == len(windows):
            windows.append([])
        windows[w].append((d, lengths[d] - n, n))
        if capacity > n:
            tree.add(capacity - n, w)
    for pieces in windows:
        fill = sum(p[2] for p in pieces)
        room = width if width - fill <= slack else 1 << (fill.bit_length() - 1)
        at = 0
        for d, start, n in pieces:
            while n:
                k = min(n, room - at)
                out.append((d, start, k, sequence, at))
                start, n, at, fill = start + k, n - k, at + k, fill - k
                if at == room and fill:
                    sequence, at, room = sequence + 1, 0, 1 << (fill.bit_length() - 1)
        sequence += 1
    return out


def packed(docs: DataFrame, tokenizer: str, end_id: int = 2, width: int = 4096, slack: int = 64, pool_tokens: int = 8_000_000) -> DataFrame:
    """Pieces of sequences; ``tokenizer`` is a file that every executor has."""

    def run(batches):
        from pyspark import TaskContext

        encoder = word_ids(tokenizer, spaces=False)
        base, pool, held = TaskContext.get().partitionId() << 36, [], 0

        def flush():
            nonlocal base, pool, held
            rows, last = [], 0
            for d, start, n, sequence, offset in pack([len(ids) for _, ids in pool], width, slack):
                doc_id, ids = pool[d]
                rows.append((doc_id, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids), base + sequence, offset))
                last = max(last, sequence + 1)
            base, pool, held = base + last, [], 0
            for k in range(0, len(rows), 20_000):
                cut = list(zip(*rows[k : k + 20_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cut, FIELDS, strict=True)], names=[n for n, _ in FIELDS])

        for batch in batches:
            ids_of, texts = batch.column(0).to_pylist(), [t.decode("utf-8", "replace") for t in binary_column(batch, "text")]
            for k in range(0, len(texts), 64):
                for doc_id, own in zip(ids_of[k : k + 64], encoder.encode(texts[k : k + 64]), strict=True):
                    ids = np.append(own, np.uint32(end_id))
                    pool.append((doc_id, ids))
                    held += len(ids)
                if held >= pool_tokens:
                    yield from flush()
        yield from flush()

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(f"{n} long" for n, _ in FIELDS))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
