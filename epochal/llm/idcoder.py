"""Token ids in a compressed file format: context mixing and a range coder.

A block holds at most ``BLOCK`` ids and starts from nothing, so that any block is read
alone. Its distinct ids are numbered as they first occur, and the numbers are coded, each
under one mixture of what the orders give it: order 2, the number that followed the same two
the last time; order 1, the one that followed the same number; order 0, all numbers of the
block so far, each as often as it occurred; and that the number is new. The orders' weights
mix what was right under the confidences of the order-2 and order-1 predictions with what
was right at all. How much the first counts grows with how often its context was seen, and
shifts to what would have cost less. A number that several orders give has the sum of
their shares. The ids that new numbers stand for are coded too: the leading bits of each under
how often they led in the block, in a mixture with all equal, the bits after them as equally
likely. Weights change every ``EPOCH`` ids at first and every ``LATER`` ids then, order 0 with
each id. All arithmetic is in integers, so that every machine decodes alike.

The range coder is of the asymmetric kind: one state of 64 bits, coded from the last id
to the first, with at most 32 bits of output an id. The ``t``-th number has 4096 shares of
``t`` slots. A share of order 0 has a slot at each place before, which stands for the number
there, so that a reader finds numbers without a table of their frequencies. New ids are read first.
Blocks are coded side by side as the lanes of arrays. What a writer's predictions are
is known from the whole block, by sorting; a reader goes id by id. Documents stay whole in a row of
the files, which are written by Spark in ascending order of ``doc_id`` (ties: by text);
null texts are empty, and their end id alone is written. An empty table gives no rows;
texts may have any length; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary_column, scratch, small_batches, table
from .tokens import word_ids

BLOCK, LANES, ROW_IDS, EPOCH, LATER = 2048, 2048, 1 << 22, 64, 256
SLOTS = 512
HEAD = struct.Struct("<4sHHIII")  # magic, bits, 0, ids, crc32 of the ids, bytes
COST = np.round(-np.log2(np.maximum(np.arange(4097), 1) / 4096) * 256).astype(np.int32)
#: Lanes whose predictions are found at once, so that their arrays stay in a core's cache.
ABREAST = 64
#: Places between rows of lanes, so that a column isn't in few lines of a cache.
APART = 32


class Model:
    """The weights of orders in ``lanes`` blocks, under 16 pairs of confidences."""

    def __init__(self, lanes: int):
        self.lanes = lanes
        self.all = np.repeat(np.array([2, 2, 6, 6], np.int32), lanes).reshape(4, lanes, 1)
        self.counts = np.zeros((4, lanes, 16), np.int32)
        self.trust = np.full((lanes, 1), 8, np.int32)
        self.settle(np.zeros((0, lanes), np.uint8))

    def settle(self, seen: np.ndarray) -> None:
        """New weights, of 4096, from the orders that were right in this epoch, a column a lane, and before."""
        if seen.size:
            chunks = [seen[:, k : k + ABREAST] + np.arange(0, 64 * min(ABREAST, self.lanes - k), 64) for k in range(0, self.lanes, ABREAST)]
            new = np.concatenate([np.bincount(c.ravel(), minlength=64 * c.shape[1]) for c in chunks])
            new = np.ascontiguousarray(new.reshape(self.lanes, 16, 4).transpose(2, 0, 1), dtype=np.int32)
            lost = total(new * (COST.take(self.narrow) - COST.take(self.wide))).sum(1, keepdims=True)
            self.trust = np.clip(self.trust + np.where(lost < 0, 2, -2), 2, 16).astype(np.int32)
            self.counts += new * 4
            self.all += new.sum(2, keepdims=True, dtype=np.int32)
            self.counts -= (self.counts >> 1) * (total(self.counts) > 512)
            self.all -= (self.all >> 1) * (total(self.all) > 1024)
        n = total(self.counts)
        self.wide = (self.all << 12) // total(self.all)
        self.narrow = (((self.counts << 12) + self.wide * 4).view(np.uint32) // (n + 4).view(np.uint32)).view(np.int32)
        weight = np.minimum(n, 64) * self.trust
        share = self.narrow[:3] * weight
        share += self.wide[:3] * (1024 - weight)
        share >>= 10
        share *= 4064
        share >>= 12
        share += 8
        share[1] += share[0]
        share[2] += share[1]
        #: where the shares of order 1, of order 0 and of new numbers begin; those of order 2 do at 0
        self.starts = share.astype(np.uint16).reshape(3, -1)


ONE, TWO, THREE, SLOT = (np.uint16(k) for k in (1, 2, 3, SLOTS - 1))
WORD, HALF, ENDS, WHOLE = np.uint64(32), np.uint32(16), np.uint32(0xFFFF), np.uint16(4096)
#: Leading bits of ids below 65,536: three of them and how many follow, small ids whole.
FIRST = np.array([*range(8), *((4 + k) << e for e in range(1, 14) for k in range(4))], np.uint32)
AFTER = np.array([0] * 8 + [e for e in range(1, 14) for _ in range(4)], np.uint64)
LEADS = len(FIRST)
LEAD = np.repeat(np.arange(LEADS, dtype=np.uint8), np.diff(FIRST, append=1 << 16))


def total(counts: np.ndarray) -> np.ndarray:
    """Sums over the first axis of four."""
    return counts[0] + counts[1] + counts[2] + counts[3]


def slot2(last: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Where the order-2 table holds what follows these two."""
    return (last * np.uint16(0x9E37) + before * np.uint16(0x58B5)) >> np.uint16(17 - SLOTS.bit_length())


def epochs(steps: int) -> list[tuple[int, int]]:
    edges = [*range(0, LATER, EPOCH), *range(LATER, max(BLOCK, steps), LATER)]
    return [(a, min(b, steps)) for a, b in zip(edges, [*edges[1:], steps], strict=True) if a < steps]


def sorted_places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in their rows of the keys in ascending order, equal ones in order of place, and whether a key equals the one before."""
    lanes, steps = keys.shape
    shift = steps.bit_length()
    kind = np.uint32 if int(keys.max()) < 1 << 32 - shift else np.uint64
    both = keys.astype(kind) << kind(shift) | np.arange(steps, dtype=kind)
    both.sort(axis=1)
    at = (both & kind((1 << shift) - 1)).astype(np.int64)
    both >>= kind(shift)
    again = np.zeros(keys.shape, bool)
    np.equal(both[:, 1:], both[:, :-1], out=again[:, 1:])
    return at, again.ravel()


def over_rows(at: np.ndarray) -> np.ndarray:
    """Places in rows as places in all rows one after the other."""
    return (at + np.arange(0, at.size, at.shape[1])[:, None]).ravel()


def followed(slots: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a table predicts each number, which is the last one put in the same slot, and with what confidence: how often it was right there just before, three at most."""
    at, again = sorted_places(slots)
    at = over_rows(at)
    by_slot = own.ravel().take(at)
    hit, confidence = np.zeros((2, len(at)), np.uint8)
    np.equal(by_slot[1:], by_slot[:-1], out=hit[1:].view(bool))
    hit &= again
    run = again.view(np.uint8)
    for k in (1, 2, 3):
        run[k:] &= hit[:-k]
        run[:k] = 0
        confidence += run
    out = np.empty(len(at), np.uint8)
    out[at] = confidence << np.uint8(1) | hit
    out = out.reshape(slots.shape)
    return (out & np.uint8(1)).view(bool), out >> np.uint8(1)


def numbered(ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """Numbers of ids, a row a block, in order of their first places from 1 on; whether they are new;
    how often each occurred before; the places in order of ids; and where there its id's first place stands."""
    place, again = sorted_places(ids)
    at = over_rows(place)
    leaders = np.flatnonzero(~again)
    sizes = np.diff(leaders, append=len(at))
    begin = at[leaders]
    new = np.zeros(ids.shape, bool)
    new.ravel()[begin] = True
    own, first, times = np.empty((3, *ids.shape), np.uint16)
    own.ravel()[at] = np.repeat(np.cumsum(new, axis=1, dtype=np.uint16).ravel()[begin], sizes)
    stands = np.tile(np.arange(ids.shape[1], dtype=np.uint16), len(ids))
    led = np.repeat(stands[leaders], sizes)
    first.ravel()[at], times.ravel()[at] = led, stands - led
    return own, new, times, place.astype(np.uint16), first


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lower and upper 32 bits of numbers of 64, as views."""
    both = x.view("<u4")
    return both[::2], both[1::2]


def slots(t: int) -> tuple[int, int, int]:
    """Of the ``t``-th number: slots a share, all slots, and how often these fit into 32 bits, by which
    the state before it is bounded."""
    each = max(t, 1)
    return each, each << 12, (1 << 32) // (each << 12)


def encode_lanes(ids: np.ndarray, bits: int) -> list[bytes]:
    """``ids``: a row a lane."""
    lanes, steps = ids.shape
    sizes, heads, bases, firsts = np.empty((4, steps, lanes), np.uint32)
    weights, zeros = np.empty((2, steps, lanes), np.uint16)
    places, raw, counts = [], [], []
    each = np.maximum(np.arange(steps, dtype=np.uint32), 1)[:, None]
    for k in range(0, lanes, ABREAST):
        some, mine = ids[k : k + ABREAST], slice(k, k + ABREAST)
        own, new, times, place, first = numbered(some)
        last, before = np.zeros((2, *own.shape), np.uint16)
        last[:, 1:], before[:, 2:] = own[:, :-1], own[:, :-2]
        right2, sure2 = followed(slot2(last, before), own)
        right1, sure1 = followed(last & SLOT, own)
        kind = np.where(right2, np.uint8(0), np.where(right1, np.uint8(1), np.uint8(2) + new))
        kind |= sure2 << np.uint8(4) | sure1 << np.uint8(2) | right1.view(np.uint8) << np.uint8(6)
        places.append(place)
        raw.append(some[new])
        counts.append(new.sum(1))
        # from here on a column a lane
        kind, times, first = (np.ascontiguousarray(z.T) for z in (kind, times, first))
        right1, kind = kind >> np.uint8(6), kind & np.uint8(63)
        right = kind & np.uint8(3)
        right2, new = right == 0, right == 3
        np.add(first, np.arange(k * steps, (k + len(some)) * steps, steps, dtype=np.uint32), out=firsts[:, mine])
        model, base = Model(len(some)), np.arange(0, len(some) * 16, 16)
        for a, b in epochs(steps):
            if a:
                model.settle(seen)
            seen, fresh, wrong2 = kind[a:b], new[a:b], ~right2[a:b]
            row = base + (seen >> np.uint8(2))
            order1, order0, unseen = (x.take(row, mode="clip") for x in model.starts)
            weight = np.subtract(unseen, order0, out=weights[a:b, mine])
            zeros[a:b, mine] = order0
            head = right2[a:b] * order1 + right1[a:b] * (order0 - order1) + fresh * (WHOLE - unseen)
            head = np.multiply(head, each[a:b], out=heads[a:b, mine])
            np.add(weight * times[a:b].astype(np.uint32), head, out=sizes[a:b, mine])
            np.multiply(fresh * unseen + (wrong2 > fresh) * order1, each[a:b], out=bases[a:b, mine])
    # the coder goes backwards, so that a reader goes forwards; a step gives 32 bits or none
    places = np.concatenate(places)
    x, words, full = np.full(lanes, 1 << 32, np.uint64), *(np.empty((steps, lanes + APART), k)[:, :lanes] for k in ("<u4", bool))
    for t in range(steps - 1, -1, -1):
        n, every, fit = slots(t)
        size, head = sizes[t], heads[t]
        low, high = halves(x)
        words[t] = low
        x = np.where(np.greater_equal(high, size * np.uint32(fit), out=full[t]), x >> WORD, x)
        whole = x // size
        rest = halves(x)[0] - halves(whole)[0] * size
        slot = bases[t] + rest
        some = np.flatnonzero(rest >= head)
        weight, rest = weights[t].take(some, mode="clip").astype(np.uint32), rest.take(some, mode="clip") - head.take(some, mode="clip")
        turn = rest // weight
        place = places.take(firsts[t].take(some, mode="clip") + turn, mode="clip")
        slot[some] = zeros[t].take(some, mode="clip") * np.uint32(n) + rest + (place - turn) * weight
        whole *= np.uint64(every)
        x = whole + slot
    del sizes, heads, bases, firsts, weights, zeros, places
    counts = np.concatenate(counts)
    x, more = encode_new(x, np.concatenate(raw), counts, bits)
    words, full = (np.concatenate([*m, own]) for m, own in zip(zip(*more, strict=True), (words, full), strict=True))
    words, ends = words.T[full.T], np.append(0, np.cumsum(full.sum(0))).tolist()
    return [struct.pack("<QHH", state, b - a, n) + words[a:b].tobytes() for state, n, a, b in zip(x.tolist(), counts.tolist(), ends, ends[1:], strict=False)]


class Leads:
    """How often leading bits are coded in ``lanes`` blocks, as shares of 1024."""

    def __init__(self, lanes: int):
        self.counts, self.base = np.ones((lanes, LEADS), np.uint32), np.arange(0, lanes * LEADS, LEADS)
        self.settle(np.zeros((0, lanes), np.uint8))

    def settle(self, seen: np.ndarray) -> None:
        """New shares from what was seen since, a column a lane; there may be fewer columns than before."""
        lanes = seen.shape[1]
        self.base = self.base[:lanes]
        self.counts = self.counts[:lanes] + 2 * np.bincount((seen + self.base).ravel(), minlength=lanes * LEADS).reshape(lanes, LEADS).astype(np.uint32)
        upto = np.cumsum(self.counts, axis=1, dtype=np.uint32)
        upto *= np.uint32(1024 - LEADS << 16) // upto[:, -1:]
        ends = (upto >> np.uint32(16)) + np.arange(1, LEADS + 1, dtype=np.uint32)
        self.size = np.diff(ends, axis=1, prepend=np.uint32(0)).astype(np.uint64)
        self.start = (ends - self.size).astype(np.uint64).ravel()
        self.ends, self.size = ends, self.size.ravel()

    def at(self) -> np.ndarray:
        """What leads at each of the 1024 slots of a lane, lane by lane."""
        sizes = self.size.reshape(self.ends.shape).copy()
        sizes[:, -1] += np.uint64(1024) - self.ends[:, -1]
        return np.repeat(np.tile(np.arange(LEADS, dtype=np.uint8), len(sizes)), sizes.ravel().astype(np.int64))


def doubling(steps: int) -> list[tuple[int, int]]:
    edges = [0, *(32 << k for k in range(7) if 32 << k < steps), steps]
    return list(zip(edges, edges[1:], strict=False)) if steps else []


def fewer(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lanes in descending order of their counts, and how many have more than each number."""
    lanes = np.argsort(-counts, kind="stable")
    return lanes, np.searchsorted(-counts[lanes], -np.arange(int(counts.max(initial=0))), "left")


def encode_new(x: np.ndarray, raw: np.ndarray, counts: np.ndarray, bits: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The states after the ids that are new in each lane, one lane's after another's, and the words
    they give with where those are. Ids of 32 bits have their lower half as a second step."""
    lanes, active = fewer(counts)
    steps = len(active)
    ids, x, back, out = np.zeros((len(x), steps), np.uint32), x[lanes], np.argsort(lanes), []
    ids[np.arange(steps) < counts[:, None]] = raw
    ids = ids[lanes].T
    if bits > 16:
        words, full = np.zeros((steps, len(x)), "<u4"), np.zeros((steps, len(x)), bool)
        for j, n in reversed([*enumerate(active.tolist())]):
            state = x[:n]
            over = np.greater_equal(state, np.uint64(1 << 48), out=full[j, :n])
            words[j, :n] = state
            state >>= over.view(np.uint8) << np.uint8(5)
            state <<= np.uint64(16)
            state |= ids[j, :n] & np.uint32(0xFFFF)
        out.append((words[:, back], full[:, back]))
        ids >>= np.uint32(16)
    lead = LEAD.take(ids)
    after, parts = AFTER.astype(np.uint8).take(lead), np.zeros((2, steps, len(x)), np.uint16)
    rest, model = (ids - FIRST.take(lead)).astype(np.uint16), None
    for a, b in doubling(steps):
        n = int(active[a])
        if model is None:
            model = Leads(n)
        else:
            model.settle(seen[:, :n])
        seen = lead[a:b, :n]
        parts[0, a:b, :n], parts[1, a:b, :n] = (p.take(model.base + seen) for p in (model.size, model.start))
        if len(seen) and b < steps:
            seen = seen[:, : int(active[b])]
    words, full = np.zeros((steps, len(x)), "<u4"), np.zeros((steps, len(x)), bool)
    for j, n in reversed([*enumerate(active.tolist())]):
        state, size, k = x[:n], parts[0, j, :n].astype(np.uint64), after[j, :n]
        over = np.greater_equal(state >> (np.uint8(54) - k), size, out=full[j, :n])
        words[j, :n] = state
        state >>= over.view(np.uint8) << np.uint8(5)
        state <<= k
        state |= rest[j, :n]
        whole = state // size
        state += whole * (np.uint64(1024) - size) + parts[1, j, :n]
    out.append((words[:, back], full[:, back]))
    return x[back], out[::-1]


def decode_new(x: np.ndarray, words: np.ndarray, at_word: np.ndarray, counts: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The new ids, a row a lane, with the states and places in ``words`` after them."""
    lanes, active = fewer(counts)
    steps, back = len(active), np.argsort(lanes)
    x, at_word = x[lanes], at_word[lanes]
    ids, lead, model = np.zeros((steps, len(x)), np.uint32), np.zeros((steps, len(x)), np.uint8), None

    def refill(state: np.ndarray) -> None:
        short = np.flatnonzero(state >> WORD == 0)
        at = at_word.take(short)
        state[short] = state.take(short) << WORD | words.take(at, mode="clip")
        at_word[short] = at + 1

    for a, b in doubling(steps):
        n = int(active[a])
        if model is None:
            model = Leads(n)
        else:
            model.settle(lead[done:a, :n])
        done, table, base = a, model.at(), np.arange(0, n * 1024, 1024)
        for j, n in enumerate(active[a:b].tolist(), a):
            state = x[:n]
            slot = state & np.uint64(1023)
            found = table.take(base[:n] + slot.astype(np.int64), out=lead[j, :n])
            at, k = model.base[:n] + found, AFTER.take(found)
            state >>= np.uint64(10)
            state *= model.size.take(at)
            state += slot - model.start.take(at)
            ids[j, :n] = FIRST.take(found) + (state & ((np.uint64(1) << k) - np.uint64(1))).astype(np.uint32)
            state >>= k
            refill(state)
    if bits > 16:
        ids <<= np.uint32(16)
        for j, n in enumerate(active.tolist()):
            state = x[:n]
            ids[j, :n] |= (state & np.uint64(0xFFFF)).astype(np.uint32)
            state >>= np.uint64(16)
            refill(state)
    return np.ascontiguousarray(ids[:, back].T), x[back], at_word[back]


def decode_lanes(payloads: list[bytes], steps: int, bits: int) -> np.ndarray:
    """A row a lane."""
    lanes, head = len(payloads), struct.Struct("<QHH")
    x, counts, fields = np.zeros(lanes, np.uint64), np.zeros((2, lanes), np.int64), []
    for i, data in enumerate(payloads):
        if len(data) < head.size:
            raise ValueError(f"block {i} has another size")
        x[i], *counts[:, i] = n, words, new = head.unpack_from(data)
        del n
        if len(data) != head.size + 4 * words or new > BLOCK:
            raise ValueError(f"block {i} has another size")
        fields.append(np.frombuffer(data, "<u4", offset=head.size))
    # what a damaged block reads beyond its end is caught by its checksum
    words = np.append(np.concatenate(fields), np.uint32(0))
    raw, x, at_word = decode_new(x, words, np.cumsum(counts[0]) - counts[0], counts[1], bits)
    model, history = Model(lanes), np.zeros((steps, lanes + APART), np.uint32)
    # both orders' tables stand in one, and each step asks them together
    orders, base = np.zeros(2 * lanes * SLOTS, np.uint16), np.arange(0, 2 * lanes * SLOTS, SLOTS).reshape(2, lanes)
    hits, fresh_here, contexts = np.empty((LATER, 2, lanes), bool), np.empty((LATER, lanes), bool), np.empty((LATER, lanes), np.uint16)
    tally, apart = np.zeros(lanes * (BLOCK + 1), np.uint16), lanes + APART
    base16, based = (np.arange(lanes) * n for n in (16, BLOCK + 1))
    last, before, asked = np.zeros(lanes, np.uint16), np.zeros(lanes, np.uint16), np.empty((2, lanes), np.uint16)
    fresh, done = np.ones(lanes, np.uint16), 0
    for a, b in epochs(steps):
        if a:
            right2, right1 = hits[: a - done].view(np.uint8).transpose(1, 0, 2)
            new = fresh_here[: a - done].view(np.uint8)
            seen = contexts[: a - done].astype(np.uint8) << np.uint8(2) | (np.uint8(2) + new - right1) * (np.uint8(1) - right2)
            model.settle(seen)
        done = a
        for t in range(a, b):
            n, every, _ = slots(t)
            n, every = np.uint32(n), np.uint64(every)
            asked[0], new = slot2(last, before), fresh_here[t - a]
            np.bitwise_and(last, SLOT, out=asked[1])
            at_orders = base + asked
            entries = orders.take(at_orders, mode="clip")
            sure, told = entries & THREE, entries >> TWO
            row = base16 + np.bitwise_or(sure[0] << TWO, sure[1], out=contexts[t - a])
            start1, start0, start = (s.take(row, mode="clip") for s in model.starts)
            weight = start - start0
            whole = x // every
            slot = halves(x)[0] - halves(whole)[0] * np.uint32(every)
            share = (slot // n).astype(np.uint16)
            np.greater_equal(share, start, out=new)
            own = np.where(share >= start1, told[1], told[0])
            # order 0: the number at a place before
            zero = np.flatnonzero((share >= start0) > new)
            own_weight = weight.take(zero, mode="clip").astype(np.uint32)
            rest = slot.take(zero, mode="clip") - start0.take(zero, mode="clip") * n
            place = rest // own_weight
            rest -= place * own_weight
            there = history.take(place * apart + zero, mode="clip")
            own[zero] = there.view("<u2")[::2]
            rest += (there >> HALF) * own_weight
            unseen = np.flatnonzero(new)
            number = fresh.take(unseen, mode="clip")
            own[unseen] = number
            fresh[unseen] = number + ONE
            hit = np.equal(told, own, out=hits[t - a]).astype(np.uint16)
            hit2, hit1 = hit[0], hit[1]
            at = based + own
            times = tally.take(at, mode="clip")
            tally[at] = times + ONE
            now = history[t].view("<u2")
            now[: 2 * lanes : 2], now[1 : 2 * lanes : 2] = own, times
            wide = times.astype(np.uint32)
            head = (hit2 * start1 + hit1 * (start0 - start1)) * n
            wide *= weight
            wide += head
            rank = slot - (start1 * (hit2 ^ ONE)) * n
            rank[zero] = rest + head.take(zero, mode="clip")
            begin = start.take(unseen, mode="clip")
            wide[unseen] = (WHOLE - begin) * n
            rank[unseen] = slot.take(unseen, mode="clip") - begin * n
            x = whole * wide
            x += rank
            short = np.flatnonzero(x < np.uint64(BOUNDS[t + 1]))
            at = at_word.take(short, mode="clip")
            x[short] = x.take(short, mode="clip") << WORD | words.take(at, mode="clip")
            at_word[short] = at + 1
            sure += ONE
            np.minimum(sure, THREE, out=sure)
            sure *= hit
            sure |= own << TWO
            orders[at_orders] = sure
            before, last = last, own
    numbers, ids = history[:, :lanes].T.astype(np.uint16) - ONE, np.empty((lanes, steps), np.uint32)
    raw = np.append(raw, np.zeros((lanes, 1), np.uint32), axis=1)
    for i in range(lanes):
        raw[i].take(numbers[i], mode="clip", out=ids[i])
    return ids


#: The least state before each number.
BOUNDS = [every * fit for _, every, fit in map(slots, range(BLOCK + 1))]


def abreast(blocks: int, most: int = LANES) -> list[tuple[int, int]]:
    """Runs of about ``most`` blocks, none of a few alone, as a step costs as much for those."""
    runs = max(1, round(blocks / most))
    return [(blocks * k // runs, blocks * (k + 1) // runs) for k in range(runs)] if blocks else []


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """Self-contained blocks of a run of ids."""
    out = []
    for a, b in abreast(-(-len(ids) // BLOCK)):
        own = ids[a * BLOCK : b * BLOCK]
        bits = 16 if int(own.max()) < 1 << 16 else 32
        padded = np.zeros((b - a) * BLOCK, np.uint32)
        padded[: len(own)] = own
        steps = min(BLOCK, len(own))
        payloads = encode_lanes(padded.reshape(b - a, BLOCK)[:, :steps], bits)
        for i, payload in enumerate(payloads):
            block = own[i * BLOCK : (i + 1) * BLOCK].astype("<u4")
            out.append(HEAD.pack(b"IDX5", bits, 0, len(block), zlib.crc32(block.tobytes()), len(payload)) + payload)
    return out


def decode_blocks(blocks: list[bytes]) -> np.ndarray:
    """The ids of blocks; a damaged block raises."""
    out = [None] * len(blocks)
    heads = [HEAD.unpack_from(b) for b in blocks]
    for i, (magic, bits, _, n, _, size) in enumerate(heads):
        if magic != b"IDX5" or bits not in (16, 32) or n > BLOCK or len(blocks[i]) != HEAD.size + size:
            raise ValueError("not a block of ids")
    for bits in {h[1] for h in heads}:
        mine = [i for i, h in enumerate(heads) if h[1] == bits]
        for a, b in abreast(len(mine)):
            part = mine[a:b]
            ids = decode_lanes([blocks[i][HEAD.size :] for i in part], max(heads[i][3] for i in part), bits)
            for lane, i in enumerate(part):
                out[i] = ids[lane, : heads[i][3]].astype("<u4")
                if zlib.crc32(out[i].tobytes()) != heads[i][4]:
                    raise ValueError(f"block {i} fails its checksum")
    return np.concatenate(out) if out else np.zeros(0, "<u4")


#: Bytes of text whose words are looked up at once.
AT_ONCE = 6_000_000
FILE = "part int, start long, doc_ids array<long>, lengths array<long>, blocks array<binary>"


def write_ids(docs: DataFrame, tokenizer: str, end_id: int = 0, row_ids: int = ROW_IDS) -> str:
    """Write the files; their folder. A partition's documents follow each other."""

    def run(batches):
        from pyspark import TaskContext

        encoder, part, start = word_ids(tokenizer, spaces=True), TaskContext.get().partitionId(), 0
        names, texts, chars, held, n = [], [], 0, [], 0
        end, ids = np.array([end_id], np.uint32), []
        kinds = (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()))

        def flush():
            nonlocal start, names, held, n
            row = (part, start, names, [len(x) + 1 for x in held[::2]], encode_blocks(np.concatenate(held)))
            start, names, held, n = start + n, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, kinds, strict=True)], names=[x.split()[0] for x in FILE.split(", ")])

        def encoded():
            nonlocal ids, texts, chars, n
            for doc_id, own in zip(ids, encoder.encode(texts), strict=True):
                names.append(doc_id)
                held.extend((own, end))
                n += len(own) + 1
                if n >= row_ids:
                    yield flush()
            ids, texts, chars = [], [], 0

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), binary_column(batch, "text"), strict=True):
                if chars and chars + len(text) > AT_ONCE:
                    yield from encoded()
                ids.append(doc_id)
                texts.append(text.decode("utf-8", "replace"))
                chars += len(text)
        yield from encoded()
        if names:
            yield flush()

    small_batches(docs.sparkSession)
    path = scratch(docs.sparkSession, "token-ids")
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, FILE).write.option("compression", "none").parquet(path)
    return path


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                part, start, names, lengths, blocks = (c[row].as_py() for c in batch.columns)
                ids = decode_blocks(blocks)
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends, lengths, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(names), pa.int32()), pa.array(names, pa.int64()), pa.array(ends - lengths + start, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], names=["part", "doc_id", "at", "n_tokens", "ids_crc32"])

    files = spark.read.schema(FILE).parquet(path)
    totals = files.groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before, offsets = 0, []
    for part, n in sorted(totals.collect()):  # a row a partition of the writing job
        offsets.append((part, before))
        before += n
    shift = spark.createDataFrame(offsets, "part int, before long")
    read = files.mapInArrow(run, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return read.join(F.broadcast(shift), "part").select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_ids(spark, write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
