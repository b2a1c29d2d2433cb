"""Near-duplicates by a signature-coordinate inverted join.

Equal shingle sets are merged first; a set stands for its documents under the
least of their ids. A coordinate of its signature is the hash of ``fold``
minima. A set posts itself under each coordinate-value pair that another set
has too, and two linked sets collide in ``matches`` or more of ``coordinates``
places. So a set with fewer shared pairs is left out, and the ``matches - 1``
longest lists of each other set, where common passages sit, are dropped: any
such two still meet in a list (prefix merging). Lists whose members are all
connected are skipped.

``rounds`` times, the collisions of each set with one centre of each of its
lists are counted, and it is compared with the three centres that it meets most.
What is still apart then goes on by exact prefixes: a set's rarest shingles are
posted with their places in a common order of all shingles, and two sets meet
only where those places still allow the threshold. Again centres come first. Of
what is left, lists of at most ``short`` members are compared pair by pair. Longer
ones, as of pages of one template that are alike but linked nowhere, are cut into
chunks of about ``chunk`` shingles, and any two chunks meet in one task, which
multiplies them as matrices and returns the components that its links join: a set
moves once a pair of chunks and no row is made for a pair of sets. Pairs of rows
need ``matches`` collisions of whole signatures; all are confirmed on the full sets.

A link of 75 percent agrees in 27 of 48 places on average, and in fewer than 10
with a probability of 1.1e-7; no other step can miss a link.

Null and empty texts have no shingles and are linked with nothing; repeated
rows are copies, and each row is answered; texts whose least ids are the same
count as one, and each row is answered by its own text. A row without an id is linked with nothing,
has no component and is kept. Texts may have any length. Extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, binary_column, hash_words, mixed, shingle_hashes, small_batches, split_words, table

SCHEMA = "doc_id long, n_shingles long, set_id binary, signature array<long>, shingles array<long>"
KINDS = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
#: Words signed at once, parts that a hot key is dealt to, and counters of shingles (4 MB).
WORDS, SALTS, COUNTERS = 100_000, 32, 1 << 20
#: Shingles that a set counts for at least in a chunk, columns multiplied at once, sums made
#: at once, and how many times a sum costs more than a product of a matrix.
LEAST_WEIGHT, STRIP, SUMS, SUM_COST = 256, 1024, 1 << 20, 100
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def signatures(sets: list[np.ndarray], multipliers: np.ndarray, fold: int) -> np.ndarray:
    """A row of coordinates for each set that isn't empty, each with its place hashed in.

    Shingle hashes are well mixed, so a product by an odd number orders them anew."""
    joined, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    minima = np.stack([np.minimum.reduceat(joined * m, starts) for m in multipliers], 1).reshape(len(sets), -1, fold)
    values = np.broadcast_to(np.arange(minima.shape[1], dtype=np.uint64), minima.shape[:2])
    for k in range(fold):
        values = mixed(values * GOLDEN + minima[:, :, k])
    return values.view(np.int64)


def multipliers(count: int) -> np.ndarray:
    return mixed(np.arange(1, count + 1, dtype=np.uint64) * GOLDEN) | np.uint64(1)


def features(docs: DataFrame, width: int, coordinates: int, fold: int, whole: bool) -> DataFrame:
    """Size, digest and signature of each document's set; ``whole``: the sorted set too."""

    def run(batches):
        memo: dict[bytes, int] = {}
        m = multipliers(coordinates * fold)

        def flush(ids, sets):
            signed = iter(signatures([s for s in sets if len(s)], m, fold) if any(map(len, sets)) else ())
            nothing = np.zeros(0, np.int64)
            rows = [(i, len(s), hashlib.sha1(s.tobytes()).digest()[:16], next(signed) if len(s) else nothing, s.view(np.int64) if whole else nothing) for i, s in zip(ids, sets, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), KINDS, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            ids, sets, held = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), binary_column(batch, "text"), strict=True):
                s = np.sort(shingle_hashes(hash_words(split_words(text), memo), width))
                ids.append(doc_id)
                sets.append(s[np.append(True, s[1:] != s[:-1])] if len(s) else s)
                held += len(s)
                if held >= WORDS:
                    yield flush(ids, sets)
                    ids, sets, held = [], [], 0
            if ids:
                yield flush(ids, sets)

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def components(work: Workspace, edges: DataFrame) -> DataFrame:
    """(node, comp): the least node that each node of (a, b) is connected to, by
    least labels with pointer jumps."""
    both = work.write(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("comp"))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("least"))
        step = labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "least").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
        new = work.write(step.join(jump, "comp").select("node", "was", F.least("comp", "root").alias("comp")), "steps")
        labels = new.select("node", "comp")
        if new.where("was <> comp").isEmpty():
            return labels


def salted(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int").alias("salt")


def merged(work: Workspace, labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, comp) with the components that ``links`` (a, b) connect made one."""
    ends = links.join(labels.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a").join(labels.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b")
    edges = work.write(ends.where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "joined")
    if edges.isEmpty():
        return labels
    roots = components(work, edges).select(F.col("node").alias("comp"), F.col("comp").alias("root"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    moved = labels.select("node", "comp", salted("node")).join(roots, ["comp", "salt"], "left")
    return work.write(moved.select("node", F.coalesce("root", "comp").alias("comp")), "labels")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int, matches: int) -> DataFrame:
    """The pairs (a, b) that collide in ``matches`` places and have ``percent`` similarity.

    Many pairs can have the same ``b``, so its set goes to as many tasks as have some."""
    parts = pairs.select("a", "b", salted("a"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"), F.col("signature").alias("gb"))
    b = parts.select("b", "salt").distinct().join(b, "b")
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"), F.col("signature").alias("ga"))
    hits = F.aggregate(F.zip_with("ga", "gb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    joined = parts.join(b, ["b", "salt"]).join(a, "a").where(hits >= matches).withColumn("both", F.size(F.array_intersect("sa", "sb")))
    return joined.where(100 * F.col("both") >= percent * (F.size("sa") + F.size("sb") - F.col("both"))).select("a", "b").distinct()


def rarity(sets: DataFrame) -> np.ndarray:
    """How many shingles of all ``sets`` fall on each of ``COUNTERS`` counters."""

    def run(batches):
        for batch in batches:
            n = np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64) % COUNTERS, minlength=COUNTERS)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["at", "n"])

    found = sets.select("shingles").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    counters = np.zeros(COUNTERS, np.int64)
    rows = found.toArrow()  # at most COUNTERS rows
    counters[rows["at"].to_numpy()] = rows["n"].to_numpy()
    return np.minimum(counters, 2**31 - 1).astype(np.int32)


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(key, node, n, place): the shingles of each set's prefix that others may have.

    All sets order their shingles alike, rarest first; ``place`` counts from 0."""
    counters = sets.sparkSession.sparkContext.broadcast(rarity(sets))

    def run(batches):
        for batch in batches:
            keys, nodes, sizes, places = [], [], [], []
            for node, s in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = s.values.to_numpy(zero_copy_only=False)
                seen = counters.value[s.view(np.uint64) % COUNTERS]
                order = np.lexsort((s, seen))[: len(s) + (-len(s) * percent) // 100 + 1]
                place = np.flatnonzero(seen[order] > 1)
                keys.append(s[order[place]])
                places.append(place)
                nodes.append(np.full(len(place), node))
                sizes.append(np.full(len(place), len(s)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in (keys, nodes, sizes, places)], names=["key", "node", "n_shingles", "place"])

    return sets.select("node", "shingles").mapInArrow(run, "key long, node long, n_shingles long, place long")


def apart(live: DataFrame, middle: Column) -> DataFrame:
    """(key, c): a centre of each list that has members of several components."""
    centre = F.min_by(F.struct("node", "n_shingles", "place", "comp"), middle)
    return live.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), centre.alias("c")).where("lo <> hi").select("key", "c")


def with_centres(live: DataFrame, middle: Column, allowed: Callable[[str, str], Column], most: int = 3) -> DataFrame:
    """Pairs (a, b) of each member with the ``most`` centres that it collides with most."""
    met = live.join(apart(live, middle), "key").where((F.col("comp") != F.col("c.comp")) & allowed("", "c."))
    hits = met.groupBy(F.col("node").alias("a"), F.col("c.node").alias("b")).agg(F.count(F.lit(1)).alias("hits"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("hits"), "b"))
    return hits.select("a", "b", rank.alias("rank")).where(F.col("rank") <= most).select("a", "b")


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of ``a`` has in common with each of ``b``.

    Elements of many sets are columns of matrices; rarer ones are summed pair by pair."""
    sizes = np.array([*map(len, a), *map(len, b)])
    rows = np.concatenate([np.arange(len(a)), np.arange(len(b))]).repeat(sizes)
    codes = np.unique(np.concatenate([*a, *b]), return_inverse=True)[1]
    cut = sizes[: len(a)].sum()
    na, nb = (np.bincount(c, minlength=codes.max() + 1) for c in (codes[:cut], codes[cut:]))
    often = na * nb * SUM_COST > len(a) * len(b)
    out = np.zeros((len(a), len(b)), np.int32)

    def chosen(part: slice, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Columns, renumbered and in order, and rows of the elements that ``which`` takes."""
        c, r = codes[part], rows[part]
        taken = np.flatnonzero(which[c])
        c, r = (np.cumsum(which) - 1)[c[taken]], r[taken]
        order = np.argsort(c, kind="stable")
        return c[order], r[order]

    (ca, ra), (cb, rb) = (chosen(p, often) for p in (slice(cut), slice(cut, None)))
    for start in range(0, int(often.sum()), STRIP):
        strips = []
        for c, r, n in ((ca, ra, len(a)), (cb, rb, len(b))):
            lo, hi = np.searchsorted(c, [start, start + STRIP])
            strips.append(np.zeros((n, STRIP), np.float32))
            strips[-1][r[lo:hi], c[lo:hi] - start] = 1
        out += (strips[0] @ strips[1].T).astype(np.int32)

    seldom = ~often & (na > 0) & (nb > 0)
    (ca, ra), (cb, rb) = (chosen(p, seldom) for p in (slice(cut), slice(cut, None)))
    first, times = np.searchsorted(cb, ca), nb[seldom][ca]
    ends, flat = np.cumsum(times), out.reshape(-1)
    lo = 0
    while lo < len(ca):
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + SUMS, "right")))
        t = times[lo:hi]
        within = np.arange(ends[hi - 1] - done) - np.repeat(ends[lo:hi] - t - done, t)
        np.add.at(flat, np.repeat(ra[lo:hi] * len(b), t) + rb[np.repeat(first[lo:hi], t) + within], 1)
        lo = hi
    return out


def joined_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node of the edges (a, b), but the least ones, to the least it reaches."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    p, q = ends[: len(a)], ends[len(a) :]
    least = np.arange(len(nodes))
    while True:
        was = least.copy()
        np.minimum.at(least, p, was[q])
        np.minimum.at(least, q, was[p])
        least = least[least]
        if (least == was).all():
            moved = least != np.arange(len(nodes))
            return nodes[moved], nodes[least[moved]]


def block_links(work: Workspace, posts: DataFrame, sets: DataFrame, percent: int, chunk: int) -> DataFrame:
    """(a, b): components that links within the lists of ``posts`` (key, node, n_shingles, place, comp) join.

    A set's first list is told; those of a list that have another first list in common are
    apart in chunks of their own, which don't meet here, as they do so there."""
    first = posts.groupBy("node").agg(F.min_by("key", F.struct("place", "key")).alias("first"))
    posts = work.write(posts.join(first, "node"), "first-lists")
    mass = posts.groupBy("key", "first").agg(F.sum(F.col("n_shingles") + LEAST_WEIGHT).alias("mass"))
    mass = work.write(mass.withColumn("many", F.col("mass") >= chunk).withColumn("of", F.when(F.col("many"), F.col("first")).otherwise(0)), "mass")
    parts = mass.groupBy("key", "many", "of").agg(F.ceil(F.sum("mass") / chunk).alias("parts"))
    dealt = posts.join(mass.select("key", "first", "many", "of"), ["key", "first"]).join(parts, ["key", "many", "of"])
    part = F.pmod(F.xxhash64("node"), F.col("parts")).alias("part")
    dealt = work.write(dealt.select("key", "node", "comp", F.struct("many", "of", part).alias("chunk")), "chunks")
    chunks = dealt.groupBy("key", "chunk").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    x, y = (chunks.select("key", F.col("chunk").alias(c), F.col("lo").alias(f"{c}_lo"), F.col("hi").alias(f"{c}_hi")) for c in "xy")
    elsewhere = F.col("x.many") & F.col("y.many") & (F.col("x.of") == F.col("y.of")) & (F.col("x.of") != F.col("key"))
    cells = x.join(y, "key").where((F.col("x") <= F.col("y")) & ~elsewhere & (F.least("x_lo", "y_lo") < F.greatest("x_hi", "y_hi")))
    cells = work.write(cells.select("key", "x", "y"), "cells")
    sides = cells.select("key", F.col("x").alias("chunk"), "x", "y").union(cells.where("x < y").select("key", F.col("y").alias("chunk"), "x", "y"))
    rows = dealt.join(sides, ["key", "chunk"]).select("key", "x", "y", "node", "comp", (F.col("chunk") == F.col("x")).alias("in_x"), (F.col("chunk") == F.col("y")).alias("in_y"))

    def run(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks()
        comp = cell["comp"].to_numpy()
        members = [s.values.to_numpy(zero_copy_only=False) for s in cell["shingles"]]
        sides = [np.flatnonzero(cell[c].to_numpy()) for c in ("in_x", "in_y")]
        (a, la), (b, lb) = (([members[i] for i in side], np.array([len(members[i]) for i in side])) for side in sides)
        linked = (100 + percent) * overlaps(a, b).astype(np.int64) >= percent * (la[:, None] + lb)
        linked &= comp[sides[0]][:, None] != comp[sides[1]]
        i, j = np.nonzero(linked)
        return pa.table(dict(zip("ab", joined_components(comp[sides[0]][i], comp[sides[1]][j]), strict=True)), schema=pa.schema({"a": pa.int64(), "b": pa.int64()}))

    whole = rows.join(sets.select("node", "shingles"), "node").select("key", "x", "y", "comp", "in_x", "in_y", "shingles")
    return whole.groupBy("key", "x", "y").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = 75, width: int = 5, coordinates: int = 48, fold: int = 2, matches: int = 10, rounds: int = 2, short: int = 32, chunk: int = 500_000) -> DataFrame:
    """A row per document: n_shingles, component_id and kept."""
    work = Workspace(docs.sparkSession, "near-duplicates")
    rows = work.write(features(docs, width, coordinates, fold, False).drop("shingles"), "features")
    some = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    groups = some.select("set_id", "doc_id", salted("doc_id")).groupBy("set_id").agg(F.min("doc_id").alias("node"), F.collect_set("salt").alias("salts"))
    groups = work.write(groups, "groups")
    own = some.select(F.col("doc_id").alias("node"), "set_id", "n_shingles", "signature").join(groups.select("node", "set_id"), ["node", "set_id"])

    keyed = own.select("node", "n_shingles", F.explode("signature").alias("key"))
    keyed = work.write(keyed, "postings")
    work.forget_shuffles()
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("length")).where("length > 1")
    lists = keyed.join(shared, "key").groupBy("node", "n_shingles").agg(F.sort_array(F.collect_set(F.struct("length", "key"))).alias("lists"))  # at most a row's coordinates
    prefix = F.slice("lists", 1, F.size("lists") - matches + 1)
    posts = lists.where(F.size("lists") >= matches).select("node", "n_shingles", F.explode(prefix).alias("l")).select("node", "n_shingles", F.col("l.key").alias("key"), F.lit(0).cast("long").alias("place"))
    posts = work.write(posts, "shared-postings")
    del lists, shared
    work.drop(keyed)
    labels = work.write(posts.select("node").distinct().select("node", F.col("node").alias("comp")), "labels")

    members = docs.select("doc_id", "text").join(labels.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    sets = work.write(features(members, width, coordinates, fold, True).select(F.col("doc_id").alias("node"), "set_id", "signature", "shingles").dropDuplicates(["node", "set_id"]), "sets")
    work.forget_shuffles()

    def alike(x: str, y: str) -> Column:
        a, b = F.col(f"{x}n_shingles"), F.col(f"{y}n_shingles")
        return (a * 100 >= b * percent) & (b * 100 >= a * percent)

    def reachable(x: str, y: str) -> Column:
        a, b = F.col(f"{x}n_shingles"), F.col(f"{y}n_shingles")
        left = F.least(a - F.col(f"{x}place"), b - F.col(f"{y}place"))
        return left * (100 + percent) >= (a + b) * percent

    def linked(pairs: DataFrame) -> bool:
        nonlocal labels
        pairs = work.write(pairs, "candidates")
        work.forget_shuffles()
        links = work.write(confirmed(pairs, sets, percent, matches), "links")
        before = labels
        labels = merged(work, labels, links)
        work.forget_shuffles()
        return labels is not before

    for k in range(rounds):
        linked(with_centres(posts.join(labels, "node"), F.xxhash64("node", F.lit(k)), alike))

    live = posts.join(labels, "node")
    still = live.join(apart(live, F.col("node")), "key", "left_semi").select("node").distinct()
    sets = work.write(sets.join(still, "node", "left_semi"), "live-sets")  # none but these is compared again
    posts = work.write(prefixes(sets, percent), "prefixes")
    del live, still
    work.clear(rows, groups, labels, sets, posts)
    work.forget_shuffles()
    for k in range(4):
        least = F.struct("place", F.xxhash64("node", F.lit(k))) if k % 2 == 0 else F.struct(F.xxhash64("node", F.lit(k)))
        if not linked(with_centres(posts.join(labels, "node"), least, reachable)):
            break
    live = posts.join(labels, "node")
    left = work.write(live.join(apart(live, F.col("node")), "key", "left_semi"), "apart")
    many = left.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > short).select("key")
    few = left.join(many, "key", "left_anti")
    other = few.select("key", *(F.col(x).alias(f"other_{x}") for x in ("node", "n_shingles", "place", "comp")))
    pairs = few.join(other, "key").where((F.col("comp") < F.col("other_comp")) & reachable("", "other_"))
    linked(pairs.select(F.col("node").alias("a"), F.col("other_node").alias("b")).distinct())
    live = work.write(left.drop("comp").join(many, "key", "left_semi").join(labels, "node"), "long-lists")
    live = work.write(live.join(apart(live, F.col("node")), "key", "left_semi"), "long-apart")
    if not live.isEmpty():
        labels = merged(work, labels, work.write(block_links(work, live, sets, percent, chunk), "block-links"))

    answers = groups.join(labels, "node", "left").select("set_id", F.coalesce("comp", "node").alias("comp"), F.explode("salts").alias("salt"))
    found = rows.select("doc_id", "n_shingles", "set_id", salted("doc_id")).join(answers, ["set_id", "salt"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("comp")).otherwise(F.col("doc_id")))
    work.clear(rows, groups, labels)
    work.forget_shuffles()
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
