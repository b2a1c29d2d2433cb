"""Benchmark decontamination with a generalised suffix automaton of item words.

Items are cut into blocks of bounded size; each block becomes one automaton in
packed arrays, made once a worker. A document's words stream through all of them,
but for those that no window can hold, since the runs of four words there aren't
the items'. The longest match is tracked word by word. A state that holds a window knows the window's items; from the state of a
match the states of its shorter ends are reached by suffix links.

``hit_spans`` gives the merged spans of words. ``decontaminated`` takes them out
of the texts, from the first byte of the first word to the last of the last:
those of at least ``SPAN_WORDS`` words, and shorter ones, which hold a whole item
of fewer words. What then stands side by side is scanned again, until no such
span is left. A document of which more than ``MOST_COVERAGE`` of the words went is
dropped. With ``SPAN_WORDS`` at the width of a window every span goes.

A benchmark table of any size is dealt to groups of at most about ``GROUP_BYTES``
by hashes of its items; documents pass one group after the other, and the next
one reads what the last has written.

Nulls have no words. An item without an id is named by the empty text. An empty
text isn't contaminated; rows are never merged, so repeated rows give repeated
results. Texts may have any length. Extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, binary_column, shingle_hashes, small_batches, table

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Item words of an automaton; while it is made, a word takes some 500 bytes.
BLOCK_WORDS = 300_000
#: Words of a run that tells where to look, and words whose numbers a block keeps at hand.
RUN_WORDS, KNOWN_WORDS = 4, 10_000
GROUP_BYTES = 64_000_000
SPAN_WORDS = 10
MOST_COVERAGE = 0.5
Items = list[tuple[str, str | None]]


def words_of(text: bytes | None) -> list[bytes]:
    return WORD.findall((text or b"").lower())


def hashed(words: list[bytes]) -> np.ndarray:
    """Hashes of words that hold within a process, which only tell where to look."""
    return np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)


def packed(values, kind: str = "i") -> array:
    return array(kind, np.asarray(values, {"i": np.int32, "q": np.int64}[kind]).tobytes())


def places(counts: np.ndarray) -> array:
    """Where each of the runs of ``counts`` entries starts, and the end."""
    return packed(np.concatenate([[0], np.cumsum(counts)]))


class States:
    """The states of an automaton while items are added, with a table of edges each."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = array("i", [-1]), array("i", [0])

    def extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self.split(last, w, q)
        new = self.state({}, self.length[last] + 1, 0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self.split(p, w, q)
        return new

    def state(self, edges: dict, length: int, link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def split(self, p: int, w: int, q: int) -> int:
        copy = self.state(dict(self.next[q]), self.length[p] + 1, self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy


class Automaton:
    """A state stands for the runs of words that end at the same places of the items.

    All is held in packed arrays: words sorted in one buffer, a state's edges side by
    side in order of their words, windows in order of state and length, each with the
    numbers of its items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], width: int):
        items = [(item, words) for item, words in items if words]
        vocabulary = sorted({w for _, words in items for w in words})
        self.words, self.word_at = b"".join(vocabulary), places(np.fromiter(map(len, vocabulary), np.int64, len(vocabulary)))
        self.known: dict[bytes, int] = {w: i for i, w in enumerate(vocabulary)}
        numbered = [packed([self.known[w] for w in words]) for _, words in items]
        states = States()
        for ids in numbered:
            last = 0
            for w in ids:
                last = states.extend(last, w)
        self.link, self.length = states.link, states.length
        self.lengths = sorted({min(width, len(ids)) for ids in numbered}, reverse=True)
        self.least = self.lengths[-1] if self.lengths else 0
        self.names = [item for item, _ in items]
        keys, owners = array("q"), array("i")
        for k, ids in enumerate(numbered):
            n, state = min(width, len(ids)), 0
            size = self.lengths.index(n)
            for i, w in enumerate(ids):
                state = states.next[state][w]
                if i + 1 >= n:
                    state = self.ending(state, n)
                    keys.append(state * len(self.lengths) + size)
                    owners.append(k)
        both = np.unique(np.stack([np.asarray(keys, np.int64), np.asarray(owners, np.int64)], 1), axis=0) if keys else np.zeros((0, 2), np.int64)
        found, counts = np.unique(both[:, 0], return_counts=True)
        self.windows, self.window_at, self.owners = packed(found, "q"), places(counts), packed(both[:, 1])
        sizes = np.fromiter(map(len, states.next), np.int64, len(states.next))
        self.edge_at, self.edges, self.targets = places(sizes), array("i"), array("i")
        for k, edges in enumerate(states.next):
            if len(edges) == 1:
                self.edges.extend(edges)
                self.targets.extend(edges.values())
            else:
                for w in sorted(edges):
                    self.edges.append(w)
                    self.targets.append(edges[w])
            states.next[k] = None
        self.known = {}

    def ending(self, state: int, n: int) -> int:
        """The state of the last ``n`` words of a longer or equal run of ``state``."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def number(self, word: bytes) -> int:
        """The place of a word among the items' words, or -1; the last words asked for are kept."""
        i = self.known.get(word)
        if i is None:
            at, words = self.word_at, self.words
            i = bisect_left(range(len(at) - 1), word, key=lambda k: words[at[k] : at[k + 1]])
            if i == len(at) - 1 or words[at[i] : at[i + 1]] != word:
                i = -1
            if len(self.known) >= KNOWN_WORDS:
                self.known.clear()
            self.known[word] = i
        return i

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of words inside window occurrences, merged, and their items."""
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        state = length = 0
        links, lengths, edge_at, edges, targets = self.link, self.length, self.edge_at, self.edges, self.targets
        for i, w in enumerate(map(self.number, words)):
            if w < 0:
                state = length = 0
                continue
            while True:
                end = edge_at[state + 1]
                to = bisect_left(edges, w, edge_at[state], end)
                if to < end and edges[to] == w:
                    break
                state = links[state]  # the first state has an edge for each word of the items
                length = lengths[state]
            state, length = targets[to], length + 1
            if length >= self.least:
                end = state
                for k, n in enumerate(self.lengths):
                    if n <= length:
                        end = self.ending(end, n)
                        key = end * len(self.lengths) + k
                        at = bisect_left(self.windows, key)
                        if at < len(self.windows) and self.windows[at] == key:
                            found.update(self.names[x] for x in self.owners[self.window_at[at] : self.window_at[at + 1]])
                            start = i + 1 - n
                            while spans and spans[-1][1] >= start:
                                start = min(start, spans.pop()[0])
                            spans.append((start, i + 1))
        return spans, found


class Automata:
    """The automata of all blocks of a group of items, and what tells where to look.

    ``runs`` are the hashes of all runs of ``n_run`` item words. A window of ``least``
    or more words has such a run at each place, so only words with enough of them side
    by side pass the automata; where hashes meet by chance, more words do."""

    def __init__(self, items: Items, width: int, block_words: int):
        self.blocks: list[Automaton] = []
        lengths = [len(words) for _, words in worded(items) if words]
        self.least = min(width, *lengths) if lengths else 0
        self.n_run = min(RUN_WORDS, self.least)
        self.runs, filled = np.empty(sum(lengths) - len(lengths) * (self.n_run - 1), np.uint64), 0
        for block in blocks(worded(items), block_words):
            for _, words in block:
                if words:
                    own = shingle_hashes(hashed(words), self.n_run)
                    self.runs[filled : filled + len(own)] = own
                    filled += len(own)
            self.blocks.append(Automaton(block, width))
        self.runs.sort()

    def candidates(self, words: list[bytes]) -> list[tuple[int, int]]:
        """The stretches of words that can hold windows."""
        if not self.least or len(words) < self.least:
            return []
        own = shingle_hashes(hashed(words), self.n_run)
        at = np.minimum(np.searchsorted(self.runs, own), len(self.runs) - 1)
        turns = np.flatnonzero(np.diff(np.concatenate([[False], self.runs[at] == own, [False]]).astype(np.int8)))
        starts, ends = turns[::2], turns[1::2]
        long = ends - starts > self.least - self.n_run
        return list(zip(starts[long].tolist(), (ends[long] + self.n_run - 1).tolist(), strict=True))


def worded(items: Items) -> Iterator[tuple[str, list[bytes]]]:
    return ((item, words_of(text.encode() if text else b"")) for item, text in items)


def blocks(items: Iterable[tuple[str, list[bytes]]], most: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    out, size = [], 0
    for x in items:
        if size and size + len(x[1]) > most:
            yield out
            out, size = [], 0
        out.append(x)
        size += len(x[1])
    yield out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def scan_words(automata: Automata, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
    """Spans of words in windows of any block, merged where they meet."""
    spans, found = [], set()
    for start, end in automata.candidates(words):
        for block in automata.blocks:
            more, items_here = block.hits(words[start:end])
            spans += [(start + s, start + e) for s, e in more]
            found |= items_here
    return merged(spans), found


AUTOMATA: dict[str, Automata] = {}


def automata(name: str, items, width: int, block_words: int) -> Automata:
    """The automata of broadcast items, made once in a worker and kept for its later tasks."""
    if name not in AUTOMATA:
        AUTOMATA.clear()
        AUTOMATA[name] = Automata(items.value, width, block_words)
    return AUTOMATA[name]


def groups(bench: DataFrame, most_bytes: int) -> Iterator[Items]:
    """The items of a benchmark table, as many at once as have ``most_bytes`` on average."""
    rows = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    size = rows.selectExpr("coalesce(sum(octet_length(text)), 0) AS n").first()["n"]
    count = max(1, -(-size // most_bytes))
    for k in range(count):
        own = rows if count == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k)
        yield [(r.item_id, r.text) for r in own.collect()]


def hit_spans(docs: DataFrame, bench: DataFrame | Items, width: int = 10, block_words: int = BLOCK_WORDS, most_bytes: int = GROUP_BYTES) -> DataFrame:
    """A row per document: its hit words, the items with windows in it, and the
    merged spans of words as ``start:end``, by commas."""
    small_batches(docs.sparkSession)
    work = Workspace(docs.sparkSession, "hit-spans")
    rows = docs.select("doc_id", "text", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<int>").alias("starts"), F.array().cast("array<int>").alias("ends"), F.array().cast("array<string>").alias("found"))

    def scan(rows: DataFrame, items: Items) -> DataFrame:
        sent, name = rows.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

        def run(batches):
            own = automata(name, sent, width, block_words)
            for batch in batches:
                out = []
                for text, starts, ends, found in zip(binary_column(batch, "text"), *(batch.column(k).to_pylist() for k in (3, 4, 5)), strict=True):
                    words = words_of(text)
                    spans, more = scan_words(own, words)
                    spans = merged([*zip(starts, ends, strict=True), *spans])
                    out.append((len(words), [s for s, _ in spans], [e for _, e in spans], sorted(more.union(found))))
                kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], names=batch.schema.names) if out else batch

        return rows.mapInArrow(run, rows.schema)

    several = isinstance(bench, DataFrame)
    for k, items in enumerate(groups(bench, most_bytes) if several else [bench]):
        rows = scan(work.write(rows, "rows") if k else rows, items)
    lengths = F.zip_with("starts", "ends", lambda s, e: (e - s).cast("long"))
    return rows.select(
        "doc_id",
        "n_words",
        F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_hit"),
        F.size("found").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("found"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("starts") > 0).alias("contaminated"),
        F.array_join(F.zip_with("starts", "ends", lambda s, e: F.concat(s.cast("string"), F.lit(":"), e.cast("string"))), ",").alias("spans"),
    )


def contamination(docs: DataFrame, bench: DataFrame | Items, width: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``hit_spans`` without the spans."""
    return hit_spans(docs, bench, width, block_words).drop("spans")


def cleaned(text: bytes, automata: Automata, width: int, span_words: int) -> tuple[bytes, int, int]:
    """The text without its spans, how many words it had, and how many went."""
    total, gone = None, 0
    while True:
        at = [m.span() for m in WORD.finditer(text.lower())]
        total = len(at) if total is None else total
        spans = [(s, e) for s, e in scan_words(automata, [text[s:e].lower() for s, e in at])[0] if e - s >= span_words or e - s < width]
        if not spans:
            return text, total, gone
        gone += sum(e - s for s, e in spans)
        kept = 0
        out = []
        for s, e in spans:
            out.append(text[kept : at[s][0]])
            kept = at[e - 1][1]
        text = b"".join([*out, text[kept:]])


def decontaminated(docs: DataFrame, bench: DataFrame | Items, width: int = 10, block_words: int = BLOCK_WORDS, span_words: int = SPAN_WORDS, most_coverage: float = MOST_COVERAGE, most_bytes: int = GROUP_BYTES) -> DataFrame:
    """``docs`` with benchmark spans taken out of ``text``, without rows that are mostly such."""
    small_batches(docs.sparkSession)
    work = Workspace(docs.sparkSession, "decontaminated")
    others = F.struct(*(c for c in docs.columns if c != "text")) if len(docs.columns) > 1 else F.lit(0)
    rows, again = docs.select(others.alias("row"), "text", F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("gone")), True

    def scan(rows: DataFrame, items: Items) -> DataFrame:
        sent, name = rows.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

        def run(batches):
            own = automata(name, sent, width, block_words)
            for batch in batches:
                old = batch.column(1)
                new = [cleaned(t, own, width, span_words) for t in binary_column(batch, "text")]
                texts = pa.array([None if null else t.decode() for (t, _, _), null in zip(new, old.is_null().to_pylist(), strict=True)], old.type)
                had, went = batch.column(2).to_pylist(), batch.column(3).to_pylist()
                total = [a or n for a, (_, n, _) in zip(had, new, strict=True)]
                gone = [a + n for a, (_, _, n) in zip(went, new, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), texts, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=batch.schema.names)

        return rows.mapInArrow(run, rows.schema)

    while again:
        count, before = 0, rows
        for items in groups(bench, most_bytes) if isinstance(bench, DataFrame) else [bench]:
            rows = scan(work.write(rows, "rows") if count else rows, items)
            count += 1
        # what one group's spans leave side by side can be another group's
        again = count > 1
        if again:
            rows = work.write(rows, "rows")
            again = rows.agg(F.sum("gone")).first()[0] != before.agg(F.sum("gone")).first()[0]
    kept = rows.where(F.col("gone") <= most_coverage * F.col("total"))
    return kept.select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
