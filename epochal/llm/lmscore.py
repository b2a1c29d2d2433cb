"""Hierarchical Pitman-Yor scores of texts.

Each word is drawn in the restaurant of the two words before it, whose parent is
that of the one word before, whose parent is shared by all and has a uniform base
over the known words and one unknown word. The tables of a restaurant are the
customers of its parent.

Tokens are dealt to buckets by the word before them, so that a bucket holds whole
restaurants of one and two words with all their dishes. (The restaurants of two words
whose last word is more than half a bucket's share of all tokens are dealt to several
buckets. That word's own restaurant stays one: its dishes are dealt with the shared
restaurant's by their word, and hear of their customers from all those buckets.)
Buckets are packed arrays, written once as a table bucketed by their number; a sweep
reads them beside the small seating of the sweep before. Only numbers of tables by
word go to the shared restaurant, and only its customers and tables come back.

Seating is sampled by Gibbs over the numbers of tables of each dish: the table
sizes are integrated out by generalised Stirling numbers, and a dish of any size
draws its number of tables given all else, as if its customers left and sat down
again without end. All restaurants are sampled at once against the seating of the
sweep before; random numbers are hashes of the dish's words and the sweep, so that
a task that is run again draws the same, and so does any number of buckets.
Predictive probabilities are averaged over the sweeps after the first ones.

Discounts are estimated from all counts of ones and twos, a level each. A null text
is empty and still has its end; repeated rows are scored each (and learned from
each); a null id is the text ''; without training rows every probability is 1;
texts may have any length; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, binary_column, hashed_words, mixed, small_batches, table

END = np.uint64(0x5E0D0F7E87E57A1D)
EXPLICIT = 256
CHUNK, CODES = 500_000, 65_535
HALF = np.uint64(0xFFFFFFFF)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
ROW = "part int, kind int, id long, data binary"


def is_held(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


# Packed arrays


def pack(*arrays: np.ndarray, level: int = 3) -> bytes:
    """Arrays as one compressed text; equal bytes of neighbours lie side by side."""
    out = [struct.pack("<H", len(arrays))]
    for a in arrays:
        if a.dtype.kind in "iu" and a.dtype.itemsize > 1 and len(a) and a.min() >= 0:
            a = a.astype(np.min_scalar_type(int(a.max())))
        out.append(struct.pack("<2sQ", a.dtype.str[1:].encode(), len(a)))
        out.append(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=level).compress(b"".join(out))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    out, at = [], 2
    for _ in range(struct.unpack_from("<H", raw)[0]):
        kind, n = struct.unpack_from("<2sQ", raw, at)
        dtype = np.dtype("<" + kind.decode())
        end = at + 10 + n * dtype.itemsize
        out.append(np.frombuffer(raw[at + 10 : end], np.uint8).reshape(dtype.itemsize, n).T.copy().view(dtype).reshape(n))
        at = end
    return out


def runs_of(a: np.ndarray) -> np.ndarray:
    """Where runs of equal neighbours begin."""
    return np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, np.int64)


def emitted(rows, schema: str = ROW):
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


# From texts to buckets


def frequent_words(docs: DataFrame, total: int, sample_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``CODES`` words of a sample of ``sample_bytes``, sorted, and their shares.

    They only tell how words are written down and which words' tokens go to several buckets."""

    def run(batches):
        for batch in batches:
            h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashed_words(binary_column(batch, "text"))]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], names=["w", "n"])

    some = docs.select("text").sample(min(1.0, sample_bytes / max(total, 1)), seed=7)
    rows = some.mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "w").limit(CODES).toArrow()
    h, n = rows["w"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order] / max(1, n.sum())


def leaves_of(codebook: np.ndarray) -> np.ndarray:
    """Where the words that begin with each 17 bits begin in the codebook."""
    return np.searchsorted(codebook, np.arange(1 << 17, dtype=np.uint64) << np.uint64(47))


def codes_of(words: np.ndarray, codebook: np.ndarray, leaves: np.ndarray) -> np.ndarray:
    """Two bytes a word: its place in the codebook, or ``CODES``."""
    upto = np.append(codebook, np.uint64(2**64 - 1))
    at = leaves[words >> np.uint64(47)]
    less = np.flatnonzero(upto[at] < words)
    while len(less):
        at[less] += 1
        less = less[upto[at[less]] < words[less]]
    return np.where((upto[at] == words) & (at < len(codebook)), at, CODES).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two ordered lists without a common word as one; a stable sort merges runs."""
    out = np.concatenate([a, b])
    out.sort(kind="stable")
    return out


def coded(words: np.ndarray, codes: np.ndarray) -> list[np.ndarray]:
    """The codes, and the words that have none."""
    return [codes, words[codes == CODES]]


def decoded(coded_words: list[tuple[np.ndarray, np.ndarray]], codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words of several coded lists in order, and the place of each word among them."""
    codes, rest = (np.concatenate(x) for x in zip(*coded_words, strict=True))
    used = np.flatnonzero(np.bincount(codes, minlength=CODES + 1)[: len(codebook)])
    other, at = np.unique(rest, return_inverse=True)
    words = merged(codebook[used], other)
    places = np.zeros(CODES + 1, np.int32)
    places[used] = np.searchsorted(words, codebook[used])
    out = places[codes]
    out[codes == CODES] = np.searchsorted(words, other)[at]
    return words, out


def places_in(few: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``words`` are among the ordered ``few``, and their places there."""
    if not len(few):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(few, words), len(few) - 1)
    own = np.flatnonzero(few[at] == words)
    return own, at[own]


def listed(words: np.ndarray, codebook: np.ndarray) -> list[np.ndarray]:
    """Distinct words in order, as steps in the codebook and the words that it lacks."""
    own, at = places_in(codebook, words)
    return [np.diff(at, prepend=0), np.delete(words, own)]


def unlisted(steps: np.ndarray, others: np.ndarray, codebook: np.ndarray) -> np.ndarray:
    return merged(codebook[np.cumsum(steps, dtype=np.int64)], others.astype(np.uint64))


def ordered(*keys: np.ndarray) -> np.ndarray:
    """The order by keys from 0 on, the first one first; one sort where they fit into a number."""
    sizes = [int(k.max(initial=0)) + 1 for k in keys]
    if np.prod([float(x) for x in sizes]) >= 2**62:
        return np.lexsort(keys[::-1])
    key = keys[0].astype(np.int64)
    for k, size in zip(keys[1:], sizes[1:], strict=True):
        key = key * size + k
    return np.argsort(key)


def dealt(docs: DataFrame, buckets: int, codebook: np.ndarray, hot: np.ndarray, classes: np.ndarray) -> DataFrame:
    """Chunks of (doc_id, text, train, scored), a row a chunk and bucket (kind 0),
    and a row a chunk of its scored documents (kind 1).

    The tokens after a ``hot`` word are dealt by ``classes`` of the word before it."""
    codes = docs.sparkSession.sparkContext.broadcast(codebook)

    def run(batches):
        from pyspark import TaskContext

        leaves = leaves_of(codes.value)
        part, chunk, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            held.sort(key=lambda x: not x[1])  # training documents first
            n = np.array([len(h) + 1 for *_, h in held])
            words = np.concatenate([x for *_, h in held for x in ([END, END], h, [END])]).astype(np.uint64)
            at = np.arange(n.sum()) + 2 * np.repeat(np.arange(1, len(n) + 1), n)
            v, u, w, doc = words[at - 2], words[at - 1], words[at], np.repeat(np.arange(len(n)), n)
            code = codes_of(words, codes.value, leaves)
            cv, cu, cw = code[at - 2], code[at - 1], code[at]
            to = (u % np.uint64(buckets)).astype(np.int64)
            own, which = places_in(hot, u)
            to[own] = (mixed(u[own] + GOLDEN * (1 + mixed(v[own] & HALF) % classes[which])) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort((to.astype(np.uint64) << np.uint64(40)) | (u >> np.uint64(24))) if buckets < 1 << 24 else np.lexsort((u, to))
            v, u, w, doc, to, cv, cu, cw = (x[order] for x in (v, u, w, doc, to, cv, cu, cw))
            name, trained = (part << 24) + chunk, sum(t for _, t, _, _ in held)
            first = runs_of(to)
            for s, e in zip(first, [*first[1:], len(to)], strict=True):
                begins = runs_of(u[s:e])
                before, rare = coded(v[s:e], cv[s:e])  # half a hash tells apart the words before a word
                heads = u[s:e][begins]
                data = pack(np.array([trained, len(n)]), *coded(heads, cu[s:e][begins]), np.diff(np.append(begins, e - s)), *coded(w[s:e], cw[s:e]), before, rare & HALF, doc[s:e], level=1)
                yield int(to[s]), 0, name, data
            ids = np.array([0 if i is None else i for i, *_ in held])
            yield name % buckets, 1, name, pack(ids.astype(np.int64).view(np.uint64), np.array([i is None for i, *_ in held], np.uint8), n, np.array([x for _, _, x, _ in held], np.uint8))

        for batch in batches:
            ids, train, scored = (batch.column(k).to_pylist() for k in (0, 2, 3))
            for row in zip(ids, train, scored, hashed_words(binary_column(batch, "text")), strict=True):
                held.append(row)
                size += len(row[3]) + 1
                if size >= CHUNK or len(held) >= 1 << 16:
                    yield emitted(list(flush()))
                    chunk, held, size = chunk + 1, [], 0
        if held:
            yield emitted(list(flush()))

    return docs.mapInArrow(run, ROW)


def by_word(w: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Places of the pairs whose restaurants are shared by buckets, in the order of their words."""
    at = np.flatnonzero(shared)
    return at[np.argsort(w[at], kind="stable")]


def bucket_of(rows, codebook: np.ndarray, hot: np.ndarray) -> tuple[bytes, bytes, np.ndarray, list[np.ndarray], list[np.ndarray], bytes]:
    """A bucket from its chunks: its packed restaurants and tokens; its words, how often each is
    counted and is a customer of the shared restaurant; its pairs after ``hot`` words, as places
    of both words, and their customers; and the counts of ones and twos."""
    us, longs, ws, vs, slots, train, names, base = [], [], [], [], [], [], [], [0]
    for _, _, name, data in rows:
        (trained, docs), uc, ur, long, wc, wr, vc, vr, doc = unpack(data)
        us.append((uc, ur.astype(np.uint64)))
        longs.append(long.astype(np.int64))
        ws.append((wc, wr.astype(np.uint64)))
        vs.append((vc, vr.astype(np.uint64)))
        slots.append(doc.astype(np.int32) + np.int32(base[-1]))
        train.append(doc < trained)
        names.append(name)
        base.append(base[-1] + int(docs))
    slot, train = np.concatenate(slots), np.concatenate(train)
    words, w = decoded(ws, codebook)
    befores, v = decoded(vs, codebook & HALF)
    heads, u = decoded(us, codebook)
    u = np.repeat(u, np.concatenate(longs))
    order = ordered(u, w, v)
    u, w, v, slot, train = u[order], w[order], v[order], slot[order], train[order]
    pair = u.astype(np.int64) * len(words) + w
    tri = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (v[1:] != v[:-1])))
    first = runs_of(pair)
    of_pair = np.searchsorted(first, tri, "right") - 1
    by_two = ordered(u[tri], v[tri])
    u2, v2 = u[tri][by_two], v[tri][by_two]
    of_two = np.empty(len(tri), np.int32)
    of_two[by_two] = np.cumsum(np.append(False, (u2[1:] != u2[:-1]) | (v2[1:] != v2[:-1])))
    n = np.add.reduceat(train.astype(np.int64), tri)
    n2 = np.bincount(of_pair, n > 0, len(first)).astype(np.int64)
    c = np.bincount(w[first], np.bincount(of_pair, n, len(first)), len(words)).astype(np.int64)
    own, which = places_in(hot, heads)
    of_hot = np.zeros(len(heads), np.int64)
    of_hot[own] = which + 1
    alone = of_hot[u[first]] == 0
    n1 = np.bincount(w[first], (n2 > 0) & alone, len(words)).astype(np.int64)
    ones = [int((x == k).sum()) for x in (n, n2[alone]) for k in (1, 2)]
    new_two = np.flatnonzero(np.append(True, np.diff(of_pair) > 0))
    body = pack(np.diff(np.append(new_two, len(tri))), u[first], w[first], of_two, n, of_hot, befores[v[tri[n > 1]]] & np.uint64(0xFFFF), *listed(heads, codebook), *listed(words, codebook))
    tokens = pack(np.diff(np.append(tri, len(u))), slot, np.array(names, np.uint64), np.array(base))
    at = by_word(w[first], ~alone)
    return body, tokens, words, [c, n1], [of_hot[u[first][at]] - 1, w[first][at], n2[at]], pack(np.array(ones))


def built(chunks: DataFrame, buckets: int, codebook: np.ndarray, hot: np.ndarray, parts: int) -> DataFrame:
    """A row a bucket (kind 0) of its restaurants and their customers; rows (kind 2) of its
    words, and its pairs after hot words, to each part of the shared ones; a row (kind 3) of
    how many trigrams and pairs have one or two customers; a row (kind 5) of where each token
    is from."""
    codes = chunks.sparkSession.sparkContext.broadcast(codebook)

    def run(batches):
        rows = (tuple(c[k].as_py() for c in b.columns) for b in batches for k in range(b.num_rows))
        for (part, kind), own in groupby(rows, lambda r: r[:2]):
            if kind:
                yield emitted(list(own))
                continue
            body, tokens, words, counts, pairs, ones = bucket_of(own, codes.value, hot)
            out = [(part, 0, 0, body), (part, 3, 0, ones), (part, 5, 0, tokens)]
            to = (words >> np.uint64(40)).astype(np.int64) * parts >> 24
            first = runs_of(to)
            for s, e in zip(first, [*first[1:], len(to)], strict=True):
                p, q = np.searchsorted(pairs[1], [s, e])
                out.append((part, 2, int(to[s]), pack(*listed(words[s:e], codes.value), *(x[s:e] for x in counts), pairs[0][p:q], pairs[1][p:q] - s, pairs[2][p:q])))
            yield emitted(out)

    return chunks.repartition(buckets, "part").sortWithinPartitions("part", "kind", "id").mapInArrow(run, ROW)


# Seating


def stirling_ratios(d: float, most: int = EXPLICIT) -> np.ndarray:
    """[n, t]: probability that a given one of n customers at t tables sits alone."""
    log = np.full((most + 1, most + 2), -np.inf)
    log[0, 0] = 0
    t = np.arange(1, most + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for n in range(1, most + 1):
            log[n, t] = np.logaddexp(log[n - 1, t - 1], np.log(np.maximum(n - 1 - d * t, 0)) + log[n - 1, t])
        out = np.zeros_like(log)
        out[1:, 1:] = np.exp(log[:-1, :-1] - log[1:, 1:])
    return np.nan_to_num(out)


def drawn(key: np.ndarray) -> np.ndarray:
    return (mixed(mixed(key) * GOLDEN) >> np.uint64(11)).astype(float) / 2.0**53


def table_counts(n, others, p, u, d: float, theta: float, log: np.ndarray) -> np.ndarray:
    """How many tables dishes of n customers have, drawn given all else.

    That is as if their customers left and sat down again without end: t tables
    weigh S(n, t) p^t (theta + d others) ... (theta + d (others + t - 1)); ``log``: of S."""
    out, order = np.ones(len(n), np.int64), np.argsort(n, kind="stable")
    near = np.where(n[order] < 16, n[order], 14 + n[order] // 8)
    for same in np.split(order, np.flatnonzero(np.diff(near)) + 1) if len(n) else []:
        most = int(n[same].max())
        for rows in np.array_split(same, len(same) * most // 4_000_000 + 1):
            steps = np.log((theta + d * (others[rows, None] + np.arange(most))) * p[rows, None])
            weight = log[n[rows], 1 : most + 1] + np.cumsum(steps, axis=1)
            sums = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            out[rows] = np.minimum(n[rows], 1 + (sums < u[rows, None] * sums[:, -1:]).sum(axis=1))
    return out


@lru_cache(maxsize=4)
def growth(d: float) -> tuple[np.ndarray, np.ndarray]:
    """log(t / n) and the log of S(n, t + 1) d t / S(n, t), which only depends on it.

    S(n, t) is n! / (t! d^t) times the coefficient of z^n in (1 - (1 - z)^d)^t, and at
    the saddle point 1 - s of that function the ratio is 1 - s^d."""
    x = -np.exp(np.linspace(np.log(300.0), np.log(1e-7), 4000))
    s = np.exp(x)
    tail = np.log(-np.expm1(d * x))
    return -(np.log1p(-s) + np.log(d) + (d - 1) * x - tail), tail


def large_count(n: int, others: float, p: float, u: float, d: float, theta: float, curve) -> int:
    """``table_counts`` of a dish with many customers, by the growth of S(n, t)."""

    def step(t):
        return np.interp(np.log((t + 0.5) / n), *curve) - np.log(d * t) + np.log(p * (theta + d * (others + t)))

    t = np.unique(np.round(np.geomspace(1, n, 200)))
    k = int(np.searchsorted(-step(t), 0.0))  # more tables weigh more before it
    low, high = t[max(0, k - 1)], t[min(k, len(t) - 1)]
    at = (low + high) / 2 if k else 1.0
    for _ in range(24):
        low, high = (at, high) if step(at) > 0 else (low, at)
        at = (low + high) / 2
    spread = 1 / np.sqrt(max(1e-18, (step(at) - step(at * 1.01 + 0.01)) / (at * 0.01 + 0.01)))
    first, last = int(max(1, at - 12 * spread - 20)), int(min(n, at + 12 * spread + 20))
    if last - first > 200_000:
        from statistics import NormalDist

        return int(min(n, max(1, round(at + spread * NormalDist().inv_cdf(min(max(u, 1e-12), 1 - 1e-12))))))
    weight = np.append(0.0, np.cumsum(step(np.arange(first, last, dtype=float))))
    sums = np.cumsum(np.exp(weight - weight.max()))
    return first + min(last - first, int(np.searchsorted(sums, u * sums[-1])))


@lru_cache(maxsize=4)
def stirling_logs(d: float) -> np.ndarray:
    """[n, t]: the log of S(n, t), up to ``EXPLICIT`` customers."""
    ratios = stirling_ratios(d)
    log = np.full(ratios.shape, -np.inf)
    log[1, 1] = 0.0
    with np.errstate(divide="ignore"):
        for m in range(2, len(ratios)):
            log[m, 1] = log[m - 1, 1] + np.log(m - 1 - d)
            log[m, 2 : m + 1] = log[m - 1, 1:m] - np.log(ratios[m, 2 : m + 1])
    return log


def reseated(n: np.ndarray, others: np.ndarray, p: np.ndarray, key: np.ndarray, d: float, theta: float) -> np.ndarray:
    """New numbers of tables of all dishes, given the other dishes' tables."""
    t, u = np.minimum(n, 1), drawn(key)
    small = np.flatnonzero((n > 1) & (n <= EXPLICIT))
    t[small] = table_counts(n[small], others[small], p[small], u[small], d, theta, stirling_logs(d))
    curve = growth(d)
    for i in np.flatnonzero(n > EXPLICIT):
        t[i] = large_count(int(n[i]), float(others[i]), float(p[i]), float(u[i]), d, theta, curve)
    return t


class Bucket:
    """The restaurants of a bucket, read from its packed rows.

    ``shared`` are the pairs, by word, of restaurants that other buckets have customers in."""

    def __init__(self, data: bytes):
        tris, self.u, self.w, self.of_two, self.n3, *more = unpack(data)
        self.u, self.w, self.of_two, self.n3 = (x.astype(np.int64) for x in (self.u, self.w, self.of_two, self.n3))
        self.of_pair = np.repeat(np.arange(len(tris)), tris.astype(np.int64))
        self.c3 = np.bincount(self.of_two, self.n3)
        self.hot = more[0].astype(np.int64) if more else np.zeros(int(self.u.max(initial=0)) + 1, np.int64)
        self.names = more[1:]
        self.shared = by_word(self.w, self.hot[self.u] > 0)

    def seat(self, t3: np.ndarray, t2: np.ndarray | None = None) -> None:
        self.t3 = t3.astype(np.int64)
        self.n2 = np.bincount(self.of_pair, self.t3, len(self.u)).astype(np.int64)
        self.t2 = np.minimum(self.n2, 1) if t2 is None else np.minimum(np.maximum(t2.astype(np.int64), np.minimum(self.n2, 1)), self.n2)
        self.c2, self.tables2 = np.bincount(self.u, self.n2), np.bincount(self.u, self.t2)

    def hear(self, n2: np.ndarray, t2: np.ndarray, c2: np.ndarray, tables2: np.ndarray) -> None:
        """Customers and tables of ``shared`` in all buckets, and the sums of each hot word."""
        self.n2[self.shared], self.t2[self.shared] = n2, t2
        own = np.flatnonzero(self.hot)
        self.c2[own], self.tables2[own] = c2[self.hot[own] - 1], tables2[self.hot[own] - 1]

    def keys(self, sweep: int, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of trigrams and pairs, by their words."""
        v, *names = self.names
        u, w = (unlisted(*names[k : k + 2], codebook) & HALF for k in (0, 2))
        two, three = pair_keys(u[self.u], w[self.w], sweep), np.zeros(len(self.n3), np.uint64)
        several = np.flatnonzero(self.n3 > 1)
        three[several] = mixed(two[self.of_pair[several]] + GOLDEN * (v.astype(np.uint64) + np.uint64(1)))
        return three, two

    def pairs(self, p1: np.ndarray, d2: float, theta: float) -> np.ndarray:
        """Predictive probabilities of every pair, from those of words."""
        return (self.n2 - d2 * self.t2) / (theta + self.c2)[self.u] + ((theta + d2 * self.tables2) / (theta + self.c2))[self.u] * p1[self.w]

    def trigrams(self, p2: np.ndarray, d3: float, theta: float) -> np.ndarray:
        """Predictive probabilities of every trigram, from those of pairs."""
        tables3 = np.bincount(self.of_two, self.t3)
        return (self.n3 - d3 * self.t3) / (theta + self.c3)[self.of_two] + ((theta + d3 * tables3) / (theta + self.c3))[self.of_two] * p2[self.of_pair]

    def sweep(self, p1: np.ndarray, d3: float, d2: float, theta: float, key: np.ndarray, pair_key: np.ndarray | None = None) -> None:
        """Seat all anew; ``shared`` keep their customers from this bucket and no tables."""
        p2, tables3 = self.pairs(p1, d2, theta), np.bincount(self.of_two, self.t3)
        t3 = reseated(self.n3, tables3[self.of_two] - self.t3, p2[self.of_pair], mixed(key[: len(self.n3)]), d3, theta)
        others = self.tables2[self.u] - self.t2
        self.seat(t3, self.t2)
        n2 = self.n2.copy()
        n2[self.shared] = 0
        self.t2 = reseated(n2, others, p1[self.w], key[: len(self.u)] if pair_key is None else pair_key, d2, theta)
        self.tables2 = np.bincount(self.u, self.t2)


class Root:
    """Numbers of the shared restaurant that all tasks need."""

    def __init__(self, customers: int, tables: int, words: int, tokens: int, d: float, theta: float):
        self.customers, self.tables, self.words, self.tokens, self.d, self.theta = customers, tables, words, tokens, d, theta
        self.base = 1 / (words + 1)
        self.unknown = (theta + d * tables) / (theta + customers) * self.base if tokens else 1.0

    def chances(self, n: np.ndarray, t: np.ndarray) -> np.ndarray:
        return (n - self.d * t) / (self.theta + self.customers) + self.unknown


def named_keys(names: np.ndarray, sweep: int) -> np.ndarray:
    return mixed(names + mixed(np.array([sweep + 1], np.uint64)))


def pair_keys(u: np.ndarray, w: np.ndarray, sweep: int) -> np.ndarray:
    """Keys of pairs, from the names of their words."""
    return named_keys(mixed(u.astype(np.uint64) << np.uint64(32) | w.astype(np.uint64)), sweep)


def keys_of(size: int, part: int, sweep: int) -> np.ndarray:
    """Keys of dishes that have a place instead of names."""
    return named_keys(np.arange(size, dtype=np.uint64) + (np.uint64(part) << np.uint64(36)), sweep)


def discount(ones: int, twos: int) -> float:
    """The usual estimate from how many counts are one and two."""
    return min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5


def beside(state: DataFrame, inputs: DataFrame, parts: int) -> DataFrame:
    """(part, data, rows): a bucket and its rows of ``inputs`` (part, kind, id, data) in order."""
    rows = inputs.repartition(parts, "part").groupBy("part").agg(F.sort_array(F.collect_list(F.struct("kind", "id", "data"))).alias("rows"))
    return state.where("kind = 0").select("part", "data").join(rows, "part")


def each(df: DataFrame, run, schema: str = ROW) -> DataFrame:
    """``run(part, data, rows)`` gives rows for each row of ``beside``."""

    def batches_of(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                part, data, rows, *more = (c[k].as_py() for c in batch.columns)
                if out := list(run(part, data, [(r["kind"], r["id"], r["data"]) for r in rows], *more)):
                    yield emitted(out, schema)

    return df.mapInArrow(batches_of, schema)


def told(rows: list, kind: int) -> list[np.ndarray]:
    """The messages of a kind, joined in order."""
    return [np.concatenate(x) for x in zip(*(unpack(d) for k, _, d in rows if k == kind), strict=True)]


def as_given(df: DataFrame, kind: int) -> DataFrame:
    return df.where(F.col("kind") == kind).select("part", "kind", "id", "data")


def turned(df: DataFrame, kind: int) -> DataFrame:
    """Messages by their receiver."""
    return df.where(F.col("kind") == kind).select(F.col("id").cast("int").alias("part"), "kind", F.col("part").cast("long").alias("id"), "data")


def summed(df: DataFrame, kind: int, *sizes: int, tasks: int = 16) -> list[np.ndarray]:
    """The sums, number by number, of the arrays of ``sizes`` that each part tells."""

    def run(batches):
        found = [np.zeros(n, np.int64) for n in sizes]
        for batch in batches:
            for data in batch.column(0).to_pylist():
                found = [x + y.astype(np.int64) for x, y in zip(found, unpack(data), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([pack(*found)], pa.binary())], names=["data"])

    rows = df.where(F.col("kind") == kind).select("data").coalesce(tasks).mapInArrow(run, "data binary").collect()
    return [sum((x.astype(np.int64) for x in own), np.zeros(n, np.int64)) for n, *own in zip(sizes, *(unpack(r.data) for r in rows), strict=True)]


def log_scores(train_docs: DataFrame, docs: DataFrame | None = None, burn_in: int = 2, samples: int = 2, theta: float = 1.0, bucket_bytes: int = 7_000_000, sample_bytes: int = 20_000_000) -> DataFrame:
    """A row per document of ``docs``: its tokens and log10 probabilities."""
    spark = train_docs.sparkSession
    small_batches(spark)
    work = Workspace(spark, "lm-score")
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2
    every = train_docs.select("doc_id", "text", (~held).alias("train"), F.lit(docs is None).alias("scored"))
    if docs is not None:
        every = every.where("train").unionByName(docs.select("doc_id", "text", F.lit(False).alias("train"), F.lit(True).alias("scored")))
    total = every.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(4, -(-total // bucket_bytes))
    parts = min(buckets, 4 * int(buckets**0.5))
    codebook, shares = frequent_words(train_docs, total, sample_bytes)
    often = 2 * shares * buckets > 1
    hot, classes = codebook[often], np.ceil(2 * shares[often] * buckets).astype(np.uint64)
    state = work.bucketed(built(dealt(every, buckets, codebook, hot, classes), buckets, codebook, hot, parts), "buckets", buckets)
    work.forget_shuffles()
    codes = spark.sparkContext.broadcast(codebook)

    # kinds of the shared restaurants: 0 where each bucket's words and pairs are, 1 customers and
    # tables of a bucket's words and pairs, 2 sums, 3 customers and tables, 4 counts of a bucket's words
    def sums(n, t, hot_u, n2, t2):
        return np.array([n.sum(), t.sum()]), *(np.bincount(hot_u, x, len(hot)).astype(np.int64) for x in (n2, t2))

    def gathered(part, rows):
        ids, steps, others, c, n, hot_u, hot_w, n2 = zip(*((i, *unpack(d)) for _, i, d in rows), strict=True)
        words = [unlisted(*x, codes.value) for x in zip(steps, others, strict=True)]
        ends, hot_ends = (np.cumsum([len(x) for x in xs]) for xs in (words, hot_w))
        words, at = np.unique(np.concatenate(words), return_inverse=True)
        c, n = (np.bincount(at, np.concatenate(x), len(words)).astype(np.int64) for x in (c, n))
        hot_w = np.concatenate([a[x] for a, x in zip(np.split(at, ends[:-1]), hot_w, strict=True)])
        pairs, hot_at = np.unique(np.concatenate(hot_u).astype(np.int64) * len(words) + hot_w, return_inverse=True)
        n2 = np.bincount(hot_at, np.concatenate(n2), len(pairs)).astype(np.int64)
        hot_u, hot_w, t2 = pairs // len(words), pairs % len(words), np.minimum(n2, 1)
        n += np.bincount(hot_w, t2, len(words)).astype(np.int64)
        t = np.minimum(n, 1)
        yield part, 0, 0, pack(np.array(ids), ends, at, hot_ends, hot_at, hot_u, hot_w, words & HALF)
        yield part, 3, 0, pack(n, t, n2, t2)
        for i, a, h in zip(ids, np.split(at, ends[:-1]), np.split(hot_at, hot_ends[:-1]), strict=True):
            yield part, 1, i, pack(n[a], t[a], n2[h], t2[h])
            yield part, 4, i, pack(c[a])
        yield part, 2, 0, pack(*sums(n, t, hot_u, n2, t2), np.array([(c > 0).sum(), c.sum(), *((x == k).sum() for x in (n, n2) for k in (1, 2))]))

    words = turned(state, 2).repartition(parts, "part").groupBy("part").agg(F.sort_array(F.collect_list(F.struct("kind", "id", "data"))).alias("rows"))
    places = work.bucketed(each(words.select("part", F.lit(b"").alias("data"), "rows"), lambda part, _, rows: gathered(part, rows)), "places", parts)
    work.forget_shuffles()
    (customers, tables), c2, tables2, (distinct, tokens, one, two, *hot_ones) = summed(places, 2, 2, len(hot), len(hot), 6)
    (ones,) = summed(state, 3, 4)
    d3, d2, d1 = discount(*ones[:2]), discount(*(ones[2:] + hot_ones)), discount(one, two)
    root, shared, seats, kept = Root(customers, tables, distinct, tokens, d1, theta), places, None, []
    for sweep in range(burn_in + samples):

        def seat(part, data, rows, root=root, sweep=sweep, hot_sums=(c2, tables2)):
            b = Bucket(data)
            b.seat(*([unpack(d) for k, _, d in rows if k == 0] or [[np.minimum(b.n3, 1)]])[0])
            n, t, *pairs = told(rows, 1)
            b.hear(*pairs, *hot_sums)
            b.sweep(root.chances(n, t), d3, d2, theta, *b.keys(sweep, codes.value))
            yield part, 0, 0, pack(b.t3, b.t2)
            guests, customers, at, hot_at = np.bincount(b.w, b.t2, len(n)).astype(np.int64), b.n2[b.shared], 0, 0
            for _, i, d in (r for r in rows if r[0] == 1):
                size, _, hot_size, _ = map(len, unpack(d))
                yield part, 1, i, pack(guests[at : at + size], customers[hot_at : hot_at + hot_size])
                at, hot_at = at + size, hot_at + hot_size

        def sit(part, data, rows, root=root, sweep=sweep, hot_tables=tables2):
            ids, ends, at, hot_ends, hot_at, hot_u, hot_w, names = (x.astype(np.int64) for x in unpack(data))
            (n, t, _, t2), (sent, hot_sent) = ([x.astype(np.int64) for x in told(rows, k)] for k in (3, 1))
            n2 = np.bincount(hot_at, hot_sent, len(t2)).astype(np.int64)
            t2 = reseated(n2, hot_tables[hot_u] - t2, root.chances(n, t)[hot_w], pair_keys(hot[hot_u] & HALF, names[hot_w], sweep), d2, theta)
            n = (np.bincount(at, sent, len(t)) + np.bincount(hot_w, t2, len(t))).astype(np.int64)
            t = reseated(n, root.tables - t, np.full(len(n), root.base), named_keys(mixed(names.astype(np.uint64)), sweep + 1_000_003), root.d, theta)
            yield part, 3, 0, pack(n, t, n2, t2)
            for i, a, h in zip(ids, np.split(at, ends[:-1]), np.split(hot_at, hot_ends[:-1]), strict=True):
                yield part, 1, int(i), pack(n[a], t[a], n2[h], t2[h])
            yield part, 2, 0, pack(*sums(n, t, hot_u, n2, t2))

        told_now = turned(shared, 1) if seats is None else turned(shared, 1).unionByName(as_given(seats, 0))
        seats = work.write(each(beside(state, told_now, buckets), seat), f"seats-{sweep}")
        shared = work.write(each(beside(places, as_given(shared, 3).unionByName(turned(seats, 1)), parts), sit), f"shared-{sweep}")
        (customers, tables), c2, tables2 = summed(shared, 2, 2, len(hot), len(hot))
        root = Root(customers, tables, distinct, tokens, d1, theta)
        if sweep >= burn_in:
            kept.append((seats, shared, root, (c2, tables2)))
        work.forget_shuffles()

    roots = [(root, hot_sums) for *_, root, hot_sums in kept]

    def score(part, data, rows, tokens_of):
        """Sums of a bucket's tokens by document, a row a chunk."""
        b = Bucket(data)
        seen, slot, names, base = unpack(tokens_of)
        p3 = 0.0
        for k, (root, hot_sums) in enumerate(roots):
            n, t, *pairs = told(rows, 10 * k + 1)
            b.seat(*[unpack(d) for kind, _, d in rows if kind == 10 * k][0])
            b.hear(*pairs, *hot_sums)
            p3 = p3 + b.trigrams(b.pairs(root.chances(n, t), d2, theta), d3, theta) / len(roots)
        (c,) = told(rows, 4)
        c, of = c.astype(float)[b.w][b.of_pair], np.repeat(np.arange(len(p3)), seen.astype(np.int64))
        slot, base = slot.astype(np.int64), base.astype(np.int64)
        sums = [np.bincount(slot, x[of], int(base[-1])) for x in (np.log10(p3), np.log10((c + 1) / (tokens + distinct + 1)), c > 0)]
        own = np.unique(slot)
        for name, s, some in zip(names, base, np.split(own, np.searchsorted(own, base[1:-1])), strict=False):
            yield part, 2, int(name), pack(some - int(s), sums[0][some], sums[1][some], sums[2][some].astype(np.int64))

    given = turned(places, 4)
    for k, (seats, shared, *_) in enumerate(kept):
        for df in (as_given(seats, 0), turned(shared, 1)):
            given = given.unionByName(df.withColumn("kind", F.col("kind") + 10 * k))
    parted = work.write(each(beside(state, given, buckets).join(state.where("kind = 5").select("part", F.col("data").alias("tokens")), "part"), score).unionByName(as_given(state, 1)), "sums")
    work.clear(parted)
    return documents(parted, buckets, tokens)


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def documents(rows: DataFrame, partitions: int, tokens: int) -> DataFrame:
    """A row a scored document, from the rows of its chunk (kind 1) and of the buckets (kind 2)."""

    def run(batches):
        rows = (tuple(c[k].as_py() for c in b.columns) for b in batches for k in range(b.num_rows))
        for _, own in groupby(rows, lambda r: r[0]):
            ids = None
            for _, kind, _, data in own:
                if kind == 1:
                    ids, null, n, scored = unpack(data)
                    sums = np.zeros((3, len(ids)))
                else:
                    some, *more = unpack(data)
                    for total, x in zip(sums, more, strict=True):
                        total[some] += x
            keep = np.flatnonzero(scored)
            doc_ids = [None if x else int(i) for i, x in zip(ids.astype(np.int64)[keep], null[keep], strict=True)]
            score, base, known = sums[:, keep]
            n = n[keep].astype(np.int64)
            out = (doc_ids, [is_held(i) for i in doc_ids], n, known.astype(np.int64), np.full(len(n), tokens), base, score, 10 ** (-score / n))
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), *[pa.float64()] * 3)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=[x.split()[0] for x in SCORED.split(", ")])

    by_chunk = rows.select("id", "kind", "part", "data").repartition(partitions, "id").sortWithinPartitions("id", "kind", "part")
    return by_chunk.mapInArrow(run, SCORED)


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_scores(table(spark, sf_dir, "documents"))
