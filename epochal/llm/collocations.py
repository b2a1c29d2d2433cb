"""Phrase collocations by suffix arrays of word ids.

Each task gathers words into shards of one language, gives the shard's distinct words
ids, and sorts the shard's suffixes by prefix doubling until they are ordered by as
many words as a phrase may have. Neighbours' common prefixes (LCP) bound the intervals
whose sizes are the counts of the shard's phrases. Counts are packed by blocks of the
phrases' hashes, compressed, and summed by key, a block in a task; a frequent phrase
is one row a shard there. Where there would be more blocks than a shard can fill,
packed counts are dealt again, each time to ``FAN`` blocks of the block before.

Scores are exact: quotients of decimals of 38 digits, for counts up to 10^15. A
part that many candidates share is looked up once for each of ``SALTS`` deals of them.
The first phrases of a language are the first of the first of its deals.

Words and counts are of whole texts, whatever their length: a shard that ends within a
piece hands its last words on. Null texts are empty, null languages are ``und``.
Repeated rows count each time. Extra columns are ignored; a table without candidates
gives no rows. Equal scores are ordered by count, then by the phrase's bytes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, binary_column, hash_words, mixed, small_batches, table

#: Words of a shard, bytes of text that a block of counts stands for, blocks that one
#: dealing makes, bytes that are cut into words at once, and deals of hot keys.
SHARD, BLOCK, FAN, PIECE, SALTS = 1 << 21, 10 << 20, 1 << 11, 1 << 22, 32
PACKED = "block long, deal long, lang string, counts binary"
NAMES = [c.split()[0] for c in PACKED.split(", ")]
KINDS = (pa.int64(), pa.int64(), pa.string(), pa.binary())
BREAKS = bytes.maketrans(b",;:!?\n\x0b\x0c\r", b"." * 9)
COUNTS = pa.schema([("phrase", pa.binary()), ("n", pa.int64())])
ZSTD = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 1))
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def cut(text: bytes, size: int) -> Iterator[bytes]:
    """``text`` in parts of about ``size`` bytes that end before a space."""
    at = 0
    while len(text) - at > size:
        end = text.find(b" ", at + size)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]


def words_of(part: bytes) -> pa.Array:
    """Lower-case words of a part of a text; a ``.`` stands for each end of a piece."""
    spaced = part.lower().translate(BREAKS).replace(b".", b" . ")
    return pa.array(spaced.split(), pa.binary())


def suffix_order(ids: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of ``ids`` in the order of their first ``depth`` ids at least."""
    n, have = len(ids), 1
    rank, order = ids.astype(np.int64), np.argsort(ids, kind="stable")
    while have < depth:
        behind = np.zeros(n, np.int64)
        behind[: n - have] = rank[have:] + 1
        keys = rank * (rank.max() + 2) + behind
        order = np.argsort(keys)
        keys = keys[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.append(0, keys[1:] != keys[:-1]))
        rank, have = new, 2 * have
        if rank.max() == n - 1:
            break
    return order


def phrases(words: pa.ChunkedArray, depth: int, limit: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """For each length up to ``depth``: phrases that begin before ``limit``, how often, and hashes."""
    coded = pa.concat_arrays(words.chunks).dictionary_encode()
    kinds = coded.dictionary
    dot = kinds.index(pa.scalar(b".", pa.binary())).as_py()
    end = dot if dot >= 0 else len(kinds)
    ids = np.append(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.full(depth, end))
    stop = ids == end
    hashes = np.append(hash_words(kinds.to_pylist(), {}), np.uint64(0))
    order = suffix_order(ids, depth)
    order = order[(order < limit) & ~stop[order]]
    if not len(order):
        return
    lcp = np.zeros(len(order), np.int64)  # with the suffix before, up to depth
    same = np.ones(len(order) - 1, bool)
    for k in range(depth):
        same &= ids[order[1:] + k] == ids[order[:-1] + k]
        lcp[1:] += same
    whole = np.ones(len(order), bool)
    for k in range(depth):
        whole &= ~stop[order + k]
        first = np.flatnonzero(lcp <= k)
        n = np.diff(np.append(first, len(order)))
        keep = whole[first]
        at, n = order[first[keep]], n[keep]
        h, texts = np.full(len(at), np.uint64(k + 1)), []
        for j in range(k + 1):
            h = mixed(h * GOLDEN + hashes[ids[at + j]])
            texts.append(kinds.take(pa.array(ids[at + j])))
        yield (pc.binary_join_element_wise(*texts, b" ") if k else texts[0]), n, h


def pack(counts: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, COUNTS, options=ZSTD) as out:
        out.write_table(counts)
    return sink.getvalue().to_pybytes()


def unpack(packed: Iterable[bytes]) -> pa.Table:
    """The counts of all, summed by phrase."""
    found = pa.concat_tables([pa.ipc.open_stream(p).read_all() for p in packed])
    return found.group_by("phrase", use_threads=False).aggregate([("n", "sum")]).rename_columns(["phrase", "n"])


def dealt(counts: pa.Table, hashes: np.ndarray, bits: int, lang: str, deal: int) -> pa.RecordBatch:
    """``counts`` packed by the first ``bits`` bits of the hashes."""
    blocks = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(blocks, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(blocks[order]) > 0))[: len(order)]
    counts = counts.take(pa.array(order))
    rows = [(int(blocks[order[a]]), deal, lang, pack(counts.slice(a, b - a))) for a, b in zip(first, np.append(first[1:], len(order))[: len(first)], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), KINDS, strict=True)] if rows else [pa.array([], t) for t in KINDS], names=NAMES)


def phrase_hashes(found: pa.Array) -> np.ndarray:
    """The hashes that ``phrases`` gives, from the phrases themselves."""
    memo: dict[bytes, int] = {}
    out = np.empty(len(found), np.uint64)
    sizes = pc.add(pc.count_substring(found, b" "), 1).to_numpy()
    for k in np.unique(sizes):
        at = np.flatnonzero(sizes == k)
        parts = hash_words(b" ".join(found.take(pa.array(at)).to_pylist()).split(b" "), memo).reshape(-1, k)
        h = np.full(len(at), np.uint64(k))
        for j in range(k):
            h = mixed(h * GOLDEN + parts[:, j])
        out[at] = h
    return out


class Shards:
    """Words of each language until they make a shard."""

    def __init__(self, depth: int, bits: int, deals: int):
        self.depth, self.bits, self.deals = depth, bits, deals
        self.words: dict[str, list[pa.Array]] = {}
        self.sizes: dict[str, int] = {}
        self.waiting: dict[str, list[bytes]] = {}
        self.bytes = self.made = 0

    def counted(self, lang: str, ended: bool) -> Iterator[pa.RecordBatch]:
        """The counts of a language's shard; what may go on stays."""
        words = pa.chunked_array(self.words.pop(lang, []), pa.binary())
        self.sizes.pop(lang, None)
        limit = len(words) if ended else max(0, len(words) - self.depth + 1)
        if not ended:
            self.add(lang, words.slice(limit).chunks)
        if limit:
            self.made += 1
            for found, n, h in phrases(words, self.depth, limit):
                yield dealt(pa.table([found, pa.array(n)], schema=COUNTS), h, self.bits, lang, self.made % self.deals)

    def add(self, lang: str, words: list[pa.Array]) -> None:
        self.words.setdefault(lang, []).extend(words)
        self.sizes[lang] = self.sizes.get(lang, 0) + sum(map(len, words))

    def take(self, lang: str, part: bytes) -> Iterator[pa.RecordBatch]:
        self.add(lang, [words_of(part)])
        if sum(self.sizes.values()) >= SHARD:
            yield from self.counted(max(self.sizes, key=self.sizes.get), False)

    def text(self, lang: str, text: bytes) -> Iterator[pa.RecordBatch]:
        """Short texts wait until they make a piece of some size."""
        if len(text) >= PIECE:
            yield from self.settle(lang)
            for part in cut(text, PIECE):
                yield from self.take(lang, part)
            yield from self.take(lang, b".")
            return
        self.waiting.setdefault(lang, []).append(text)
        self.bytes += len(text) + 64
        if self.bytes >= PIECE:
            for each in list(self.waiting):
                yield from self.settle(each)

    def settle(self, lang: str) -> Iterator[pa.RecordBatch]:
        if texts := self.waiting.pop(lang, None):
            self.bytes -= sum(map(len, texts)) + 64 * len(texts)
            yield from self.take(lang, b".".join([*texts, b""]))

    def end(self) -> Iterator[pa.RecordBatch]:
        for lang in list(self.waiting):
            yield from self.settle(lang)
        for lang in list(self.words):
            yield from self.counted(lang, True)


def phrase_counts(docs: DataFrame, depth: int, least: int) -> DataFrame:
    """(lang, words, phrase, n): phrases of up to ``depth`` words with ``n`` of ``least`` or
    more, and rows of no words whose sum for a language is the number of its words."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits, fan = max(5, (size // BLOCK).bit_length()), FAN.bit_length() - 1
    taken = min(bits, fan)

    def shards(batches, taken=taken):
        made = Shards(depth, taken, 1 << (bits - taken))
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), binary_column(batch, "text"), strict=True):
                yield from made.text(lang, text)
        yield from made.end()

    packed = docs.mapInArrow(shards, PACKED)
    while taken < bits:
        taken = min(bits, taken + fan)

        def again(batches, taken=taken):
            held, key, room = [], None, 0

            def flush():
                counts = unpack(held)
                return dealt(counts, phrase_hashes(counts["phrase"].combine_chunks()), taken, key[1], key[2] % (1 << (bits - taken)))

            for batch in batches:
                for block, deal, lang, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if held and (key != (block, lang, deal) or room > SHARD * 8):
                        yield flush()
                        held, room = [], 0
                    key, room = (block, lang, deal), room + len(counts)
                    held.append(counts)
            if held:
                yield flush()

        packed = packed.repartition("block", "deal").sortWithinPartitions("block", "deal", "lang").mapInArrow(again, PACKED)

    def summed(found: pa.Table) -> pa.Table:
        out = []
        langs = found["lang"].to_pylist()
        for lang in sorted(set(langs)):
            counts = unpack(c for c, other in zip(found["counts"].to_pylist(), langs, strict=True) if other == lang)
            words = pc.add(pc.count_substring(counts["phrase"], b" "), 1)
            total = pc.sum(counts.filter(pc.equal(words, 1))["n"]).as_py() or 0
            more = pc.greater_equal(counts["n"], least)
            kept, sizes = counts.filter(more), words.filter(more)
            out.append(pa.table({"lang": pa.array([lang] * (len(kept) + 1)), "words": pa.array([0, *sizes.to_pylist()], pa.int32()), "phrase": pa.array(["", *(p.decode() for p in kept["phrase"].to_pylist())]), "n": pa.array([total, *kept["n"].to_pylist()], pa.int64())}))
        return pa.concat_tables(out)

    return packed.groupBy("block").applyInArrow(summed, "lang string, words int, phrase string, n long")


def part(words: str, first: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, first, size), " ")


def scored(totals: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, score, l, r) of each phrase, by its lowest cut."""
    phrase = totals.where("words >= 2").select("lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = phrase.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    sides = F.array(F.struct(F.lit(0).alias("side"), part("w", F.lit(1), F.col("k")).alias("part")), F.struct(F.lit(1).alias("side"), part("w", F.col("k") + 1, F.col("words") - F.col("k")).alias("part")))
    asked = cuts.select("lang", "phrase", "words", "a", "k", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt"), F.explode(sides).alias("s")).select("*", "s.side", "s.part").drop("s")
    known = asked.select("lang", "part", "salt").distinct().join(totals.where("words > 0").select("lang", F.col("phrase").alias("part"), F.col("n").alias("f")), ["lang", "part"])
    told = asked.join(known, ["lang", "part", "salt"]).groupBy("lang", "phrase", "words", "a", "k").agg(F.max(F.expr("CASE WHEN side = 0 THEN f END")).alias("l"), F.max(F.expr("CASE WHEN side = 1 THEN f END")).alias("r"))
    a, l, r = (f"CAST({c} AS DECIMAL(15, 0))" for c in "alr")
    score = F.expr(f"(CAST(1000000 AS DECIMAL(7, 0)) * {a} * {a}) div ({l} * {r})").alias("score")
    lowest = told.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct(score, "k", "l", "r")).alias("least"))
    return lowest.select("lang", "phrase", "words", "a", "least.score", "least.l", "least.r")


def collocations(docs: DataFrame, most_words: int = 3, least: int = 10, covered: int = 50, top: int = 2000) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    work = Workspace(docs.sparkSession, "collocations")
    totals = work.write(phrase_counts(docs, most_words, least), "counts")
    longer = totals.where("words > 2").select("lang", "n", "words", F.split("phrase", " ").alias("w"))
    inside = longer.select("*", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inside = inside.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("first"))
    cover = inside.groupBy("lang", part("w", F.col("first"), F.col("size")).alias("phrase")).agg(F.max("n").alias("cover"))
    kept = scored(totals).join(cover, ["lang", "phrase"], "left").where(F.col("cover").isNull() | (F.col("cover") * 100 < F.col("a") * covered))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    deal = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    some = kept.select("*", F.row_number().over(Window.partitionBy("lang", deal).orderBy(*order)).alias("place")).where(F.col("place") <= top)
    first = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    n = totals.where("words = 0").groupBy(F.col("lang").alias("of")).agg(F.sum("n").alias("n"))
    found = first.join(n, F.col("lang") == F.col("of"))
    return found.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
