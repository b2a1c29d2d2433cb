"""Signal tables as text, from packed rows in file order.

A task's rows hold the chosen channels of a record side by side, so a wide line
comes from zipping them and a long table from one fixed order a record; nothing is
shuffled or sorted. A channel's texts are made once a code, and those of times once
a sample place, so no text is made sample by sample.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from math import lcm

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions.numbers import decimals_of, decimals_of_rate, fixed_texts, physical, rate_slugs
from ..sinks.committed import BLOCK
from ..sinks.tables import MARK, field


class Channel:
    """A channel's texts by code."""

    def __init__(self, row: dict, decimals: int | None):
        self.row, self.texts, self.codes = row, pa.array([], pa.string()), np.zeros(0, np.int64)
        self.calibration = [row[k] for k in ("physical_min", "physical_max", "digital_min", "digital_max")]
        self.decimals = decimals_of(*self.calibration) if decimals is None else decimals
        self.name = field(row["column_name"])

    def text_of(self, codes: np.ndarray) -> pa.Array:
        found, at = np.unique(codes, return_inverse=True)
        new = np.setdiff1d(found, self.codes, assume_unique=True)
        if len(new):
            if len(self.codes) > 1 << 20:
                self.codes, self.texts, new = np.zeros(0, np.int64), self.texts[:0], found
            codes_now = np.append(self.codes, new)
            texts = pa.concat_arrays([self.texts, pa.array(fixed_texts(physical(new, *self.calibration).tolist(), self.decimals), pa.string())])
            order = np.argsort(codes_now)
            self.codes, self.texts = codes_now[order], texts.take(pa.array(order))
        return self.texts.take(pa.array(np.searchsorted(self.codes, found)[at]))


class Times:
    """Texts of sample times at one rate."""

    def __init__(self, rate: float, samples: int, decimals: int):
        self.rate, self.decimals = rate, decimals
        parts = [x.split(".") for x in fixed_texts((np.arange(samples) / rate).tolist(), decimals)]
        self.whole, self.rest = np.array([int(p[0]) for p in parts]), pa.array([p[1] for p in parts], pa.string())

    def text_of(self, starts: np.ndarray, places: np.ndarray) -> pa.Array:
        """Of samples at ``places`` of records that begin at ``starts``."""
        if (starts >= 0).all() and (starts == np.floor(starts)).all() and starts.max(initial=0) < 2**53:
            return pc.binary_join_element_wise(pa.array(starts.astype(np.int64) + self.whole[places]).cast(pa.string()), self.rest.take(pa.array(places)), ".")
        if len(own := np.flatnonzero((starts < 0) | (starts != np.floor(starts)) | (starts >= 2**53))) == len(starts):
            return pa.array(fixed_texts((starts + places / self.rate).tolist(), self.decimals), pa.string())
        other = np.setdiff1d(np.arange(len(starts)), own)
        both = pa.concat_arrays([self.text_of(starts[own], places[own]), self.text_of(starts[other], places[other])])
        return both.take(pa.array(np.argsort(np.concatenate([own, other]))))


class Plan:
    """The tables of one recording, from a record's rows: a rate's channels make a table."""

    def __init__(self, rows: list[dict], options: dict):
        self.layout, self.suffix = options["layout"], ".csv.gz" if options["gzip"] else ".csv"
        self.channels = {r["signal_index"]: Channel(r, options["decimals"]) for r in rows}
        by_rate: dict[float, list[int]] = {}
        for r in rows:
            by_rate.setdefault(r["rate_hz"], []).append(r["signal_index"])
        self.groups = sorted(by_rate.items(), reverse=True)
        rates, single = [g[0] for g in self.groups], len(self.groups) == 1 or self.layout == "long"
        self.tables = ["signals" if single else f"signals_{s}" for s in rate_slugs(rates)]
        finest = max(map(decimals_of_rate, rates))
        spr = {r["rate_hz"]: r["samples_per_record"] for r in rows}
        self.times = {r: Times(r, spr[r], finest if self.layout == "long" else decimals_of_rate(r)) for r in rates if 0 < r < np.inf}
        mark = MARK if options["bom"] else ""
        self.headers = [mark + "time_s,channel,value" if self.layout == "long" else mark + ",".join(["time_s", *(self.channels[i].name for i in members)]) for _, members in self.groups]
        self.window, self.spr = options["window"], spr
        steps = lcm(*(spr[r] for r in rates))
        instants = lambda n: np.arange(n) * (steps // n) if steps < 2**62 else np.arange(n) / n
        signal, instant = (np.concatenate(x) for x in zip(*((np.full(spr[r], i), instants(spr[r])) for r, members in self.groups for i in members), strict=True))
        self.line_order = np.lexsort((signal, instant)) if self.layout == "long" else None

    def places(self, rate: float, start: float) -> np.ndarray:
        """The samples of a record that lie in the window."""
        i, (since, until) = np.arange(self.spr[rate]), self.window
        if since is None and until is None:
            return i
        t, eps = start + i / rate, min(1e-9, 0.5 / rate)
        return i[(t >= (-np.inf if since is None else since) - eps) & (t < (np.inf if until is None else until) - eps)]

    def cells(self, rate: float, members: list[int], starts: list[float], codes: list[dict[int, np.ndarray]]) -> tuple[pa.Array, list[pa.Array], list[int]]:
        """Times and the members' texts of some records, one after the other, and how many a record has."""
        at = [self.places(rate, s) for s in starts]
        sizes = [len(x) for x in at]
        times = self.times[rate].text_of(np.repeat(starts, sizes), np.concatenate(at))
        return times, [self.channels[i].text_of(np.concatenate([c[i][x] for c, x in zip(codes, at, strict=True)])) for i in members], sizes

    def lines(self, starts: list[float], codes: list[dict[int, np.ndarray]]) -> Iterator[tuple[int, pa.Array]]:
        """(table, lines) of some records in order."""
        timed = [(k, rate, members) for k, (rate, members) in enumerate(self.groups) if rate in self.times]
        if self.layout == "wide":
            for k, rate, members in timed:
                times, texts, _ = self.cells(rate, members, starts, codes)
                if len(times):
                    yield k, pc.binary_join_element_wise(times, *texts, ",")
            return
        parts, at, base = [], [], 0  # at: of each channel's places by record, where its lines begin
        for _, rate, members in timed:
            times, texts, sizes = self.cells(rate, members, starts, codes)
            inside = [self.places(rate, s) for s in starts]
            for i, text in zip(members, texts, strict=True):
                parts.append(pc.binary_join_element_wise(times, pa.scalar(self.channels[i].name), text, ","))
                at.append((self.spr[rate], inside, base + np.cumsum([0, *sizes[:-1]])))
                base += len(times)
        order = []
        for r in range(len(starts)):
            row = np.concatenate([self.row_of(spr, inside[r], begin[r]) for spr, inside, begin in at]) if at else np.zeros(0, np.int64)
            row = row[self.line_order] if len(row) == len(self.line_order) else row
            order.append(row[row >= 0])
        if base:
            yield 0, pa.concat_arrays(parts).take(pa.array(np.concatenate(order)))

    @staticmethod
    def row_of(spr: int, inside: np.ndarray, begin: int) -> np.ndarray:
        """Where the lines of a channel's samples of a record are, or -1 outside the window."""
        row = np.full(spr, -1)
        row[inside] = begin + np.arange(len(inside))
        return row


def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, float, dict, Callable[[], list[dict]]]]:
    """(path, record, start, codes by signal, what gives a row a signal) of each record, from rows in file order."""

    def parts():
        for batch in batches:
            cols = [batch.column(n).to_pylist() for n in ("path", "record_index", "signal_index", "start_s")]
            lists = batch.column("digital")
            values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for k, (path, record, signal, start) in enumerate(zip(*cols, strict=True)):
                yield path, record, signal, start, values[offsets[k] : offsets[k + 1]], (batch, k)

    for (path, record), own in groupby(parts(), lambda x: x[:2]):
        places, codes, begin = {}, {}, 0.0
        for _, _, signal, begin, values, place in own:
            places.setdefault(signal, place)
            codes.setdefault(signal, []).append(values)
        yield path, record, begin, {i: np.concatenate(v) if len(v) > 1 else v[0] for i, v in codes.items()}, lambda places=places: [{n: batch.column(n)[k].as_py() for n in batch.schema.names if n != "digital"} for batch, k in places.values()]


def rendered(batches: Iterator[pa.RecordBatch], folder: Callable[[str], str], options: dict, block_rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Blocks of lines of packed rows; ``folder`` gives a path's."""
    plan, path_now = None, None
    starts: list[float] = []
    held: list[dict[int, np.ndarray]] = []

    def flush():
        nonlocal starts, held
        for k, out in plan.lines(starts, held) if held else ():
            block = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(out)], pa.int32()), out), "\n")[0].as_py()
            row = (folder(path_now), plan.tables[k] + plan.suffix, block, len(out), plan.headers[k])
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, BLOCK.types, strict=True)], schema=BLOCK)
        starts, held = [], []

    for path, _, start, codes, rows in records(batches):
        if path != path_now:
            if plan:
                yield from flush()
            plan, path_now = Plan(rows(), options), path
        starts.append(start)
        held.append(codes)
        if len(held) * max(plan.spr.values()) >= block_rows:
            yield from flush()
    if plan:
        yield from flush()
