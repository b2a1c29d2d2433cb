"""Exact duplicates by counting quotient filters.

A fingerprint of ``bits`` bits is cut into a quotient, the home slot of a table, and
a remainder, which the slot holds. Remainders of one quotient form a run, ascending;
runs that don't fit shift to the right. Three bits a slot say whether a quotient
occurs, where a run ends, and whether a slot holds a digit of the count of the
remainder before it. So a filter gives back its fingerprints in order, with counts,
and filters merge without loss, whatever their sizes, by their sorted remainders.

Each partition of the texts' fingerprints makes a filter for each block of the
fingerprints' range; each block's filters are merged in one task, which sees a
fingerprint once a partition, however often it occurs there. Fingerprints that the
merged filter counts more than once are routed to verification: their texts alone are
grouped byte by byte, after each partition has put its equal texts together. A
fingerprint that two texts share by chance costs a comparison, never a wrong answer.

Texts and fingerprints of over one row in ten thousand are broadcast (so many there are
at most); all others are joined by shuffle.

Null and empty texts are equal texts of no characters. Rows that repeat an id and its
text share their answer. A row without an id stays only where no equal text has an id;
then ``keep_id`` is null for all of them and all are kept, as no id tells them apart.
Texts may have any length. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SHARE, WORD_SPACE, Workspace, looked_up, table

#: Fingerprints that a filter takes before it is handed on, and those of a merged block.
HELD, BLOCK = 1 << 21, 1 << 19
FILTER = "block long, quotient_bits int, slots long, occupied binary, run_ends binary, digits binary, remainders binary"


class Filter(NamedTuple):
    """A counting quotient filter as packed arrays."""

    quotient_bits: int
    slots: int
    occupied: bytes
    run_ends: bytes
    digits: bytes
    remainders: bytes


def bits_of(packed: bytes, size: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8), count=size).view(bool)


def within(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``starts[i]``, ``starts[i] + 1`` and so on, ``lengths[i]`` of each, end to end."""
    before = np.cumsum(lengths) - lengths
    return np.arange(lengths.sum()) + np.repeat(starts - before, lengths)


def firsts(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))[: len(ordered)]


def filter_of(fingerprints: np.ndarray, counts: np.ndarray, bits: int) -> Filter:
    """The filter of distinct ascending fingerprints of ``bits`` < 64 bits with their counts."""
    rest, digits_of = counts.astype(np.uint64) - np.uint64(1), np.zeros(len(counts), np.int64)
    width = max(8, bits - max(1, int(len(counts)).bit_length()))  # leaves the table under full
    quotient_bits = max(0, bits - width)
    width = np.uint64(bits - quotient_bits)
    while rest.any():
        digits_of += rest > 0
        rest = rest >> width
    quotients = (fingerprints >> width).astype(np.int64)
    mask = np.uint64((1 << int(width)) - 1)
    first = np.cumsum(1 + digits_of) - (1 + digits_of)
    slot_quotients, place = np.repeat(quotients, 1 + digits_of), within(np.zeros(len(counts), np.int64), 1 + digits_of)
    content = np.repeat(counts.astype(np.uint64) - np.uint64(1), 1 + digits_of) >> (np.maximum(place - 1, 0).astype(np.uint64) * width) & mask
    content[first] = fingerprints & mask
    order = np.arange(len(content))
    at = np.maximum.accumulate(slot_quotients - order) + order
    size = max(1 << quotient_bits, int(at[-1]) + 1 if len(at) else 0)
    flags = np.zeros((3, size), bool)
    flags[0, quotients] = True
    flags[1, at[np.append(slot_quotients[1:] != slot_quotients[:-1], True)] if len(at) else at] = True
    flags[2, at] = place > 0
    remainders = np.zeros((size, 8), np.uint8)
    remainders[at] = content.astype("<u8").view(np.uint8).reshape(-1, 8)
    packed = [np.packbits(f).tobytes() for f in flags]
    return Filter(quotient_bits, size, *packed, remainders[:, : (int(width) + 7) // 8].tobytes())


def counted(found: Filter, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints of a filter, ascending, and their counts."""
    width = np.uint64(bits - found.quotient_bits)
    quotients = np.flatnonzero(bits_of(found.occupied, found.slots))
    ends = np.flatnonzero(bits_of(found.run_ends, found.slots))
    starts = np.maximum(quotients, np.append(-1, ends[:-1]) + 1) if len(ends) else ends
    at = within(starts, ends - starts + 1)
    wide = np.zeros((found.slots, 8), np.uint8)
    wide[:, : (int(width) + 7) // 8] = np.frombuffer(found.remainders, np.uint8).reshape(found.slots, -1)
    content = wide.view("<u8").ravel()[at].astype(np.uint64)
    first = np.flatnonzero(~bits_of(found.digits, found.slots)[at])
    place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    values = np.where(place == 0, np.uint64(1), content << (np.maximum(place - 1, 0).astype(np.uint64) * width))
    counts = np.add.reduceat(values, first) if len(first) else values
    high = np.repeat(quotients, ends - starts + 1)[first].astype(np.uint64)
    return high << width | content[first], counts.astype(np.int64)


def merged(filters: Iterable[Filter], bits: int) -> Filter:
    """One filter with the summed counts of all."""
    keys, counts = (np.concatenate(x) for x in zip(*(counted(f, bits) for f in filters), strict=True))
    order = np.argsort(keys, kind="stable")  # which merges ascending runs
    keys, counts = keys[order], counts[order]
    first = firsts(keys)
    return filter_of(keys[first], np.add.reduceat(counts, first) if len(first) else counts, bits)


def repeated(fingerprints: DataFrame, rows: int, bits: int) -> DataFrame:
    """(fingerprint, n): those that occur more than once in the first column."""
    high = min(bits - 8, max(5, (rows // BLOCK).bit_length()))
    low = bits - high

    def build(batches):
        def flush(held):
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            blocks = (keys >> np.uint64(low)).astype(np.int64)
            first = firsts(blocks)
            for a, b in zip(first, np.append(first[1:], len(keys)), strict=True):
                yield (int(blocks[a]), *filter_of(keys[a:b] & np.uint64((1 << low) - 1), counts[a:b], low))

        def parts():
            held, size = [], 0
            for batch in batches:
                if batch.num_rows:
                    held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
                    size += batch.num_rows
                if size >= HELD:
                    yield held
                    held, size = [], 0
            if held:
                yield held

        for held in parts():
            pieces = list(flush(held))
            yield pa.RecordBatch.from_pylist([dict(zip(names, p, strict=True)) for p in pieces], pa.schema(list(zip(names, kinds, strict=True))))

    names = [c.split()[0] for c in FILTER.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]

    def merge(found: pa.Table) -> pa.Table:
        block = found["block"][0].as_py()
        keys, counts = counted(merged((Filter(*row) for row in zip(*(found[n].to_pylist() for n in names[1:]), strict=True)), low), low)
        more = counts > 1
        return pa.table({"fingerprint": (keys[more] | np.uint64(block << low)).view(np.int64), "n": counts[more]})

    return fingerprints.mapInArrow(build, FILTER).groupBy("block").applyInArrow(merge, "fingerprint long, n long")


def exact_duplicates(docs: DataFrame, spare_bits: int = 16) -> DataFrame:
    """A row per document: keep_id, group_size, kept and the digest of its text.

    ``spare_bits`` over the logarithm of the rows keep chance meetings of two
    fingerprints to one document in 2^spare_bits."""
    work = Workspace(docs.sparkSession, "exact-duplicates")
    texts = docs.select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), f"{WORD_SPACE}+", " ").alias("norm"))
    rows = work.write(texts.select("doc_id", F.unhex(F.sha2("norm", 256)).alias("sha"), F.xxhash64("norm").alias("hash")), "digests")
    total = rows.count()
    bits = min(63, total.bit_length() + spare_bits)
    fingerprint = F.shiftrightunsigned("hash", 64 - bits).alias("fingerprint")
    shared = work.write(repeated(rows.select(fingerprint), total, bits), "shared")
    hot = F.col("n") * SHARE > total
    suspects = looked_up(texts.withColumn("hash", F.xxhash64("norm")).select("doc_id", "norm", fingerprint), shared, "fingerprint", hot).where("n > 1")
    equal = suspects.groupBy("fingerprint", "norm").agg(F.min("doc_id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = work.write(equal.select(F.unhex(F.sha2("norm", 256)).alias("sha"), "keep", "n"), "groups")
    work.clear(rows, groups)
    found = looked_up(rows.select("doc_id", "sha"), groups, "sha", hot)
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep"))
    return found.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))
