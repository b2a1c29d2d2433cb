"""The ASCII header of a binary recording.

256 bytes describe the recording and 256 more each signal; the signals' fields
are stored field by field. The lengths that a header states of itself (header
bytes, record count) are reported, never trusted: the layout follows from the
signal count and the file's size. What is derived for a whole header, names of
columns and rates, is derived here too, since tasks read headers anyway.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

# Fixed values of the format: field names with widths in bytes, in file order.
FIXED_FIELDS = [("version", 8), ("patient_id", 80), ("recording_id", 80), ("start_date_raw", 8), ("start_time_raw", 8), ("declared_header_bytes", 8), ("reserved", 44), ("data_records_declared", 8), ("record_duration_seconds", 8), ("signal_count", 4)]
SIGNAL_FIELDS = [("label", 16), ("transducer", 80), ("unit", 8), ("physical_min", 8), ("physical_max", 8), ("digital_min", 8), ("digital_max", 8), ("prefiltering", 80), ("samples_per_record", 8), ("signal_reserved", 32)]
ANNOTATION_LABELS = ("EDF Annotations", "BDF Annotations")
NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\Z")
SPACE = " \t\r\n\v\f "
ONSET = re.compile(rb"([+-](?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*(?:[\x14\x15]|\Z)")
PADDING = b" \t\r\n\0"


class HeaderError(ValueError):
    """A header that no samples can be read by."""


@dataclass
class Header:
    fixed: dict
    signals: list[dict]
    header_bytes: int
    record_bytes: int
    sample_bytes: int
    commas: bool = field(default=False)

    @property
    def duration(self) -> float:
        return self.fixed["record_duration_seconds"]

    def record_count(self, file_bytes: int) -> int:
        return max(0, file_bytes - self.header_bytes) // self.record_bytes if self.record_bytes else 0

    def timekeeper(self) -> dict | None:
        """The first annotation channel with bytes, which states when records start."""
        return next((s for s in self.signals if s["is_annotations"] and s["samples_per_record"]), None)


def text_of(raw: bytes) -> str:
    return raw.decode("latin-1").rstrip("\0" + SPACE).lstrip(SPACE)


def number_of(raw: bytes, name: str, whole: bool = False) -> tuple[float | int, bool]:
    """The value, and whether its first comma had to be read as a point."""
    text = text_of(raw)
    comma = "," in text and "." not in text
    text = text.replace(",", ".", 1) if comma else text
    if not NUMBER.match(text):
        raise HeaderError(f"{name} is not a number: {text!r}")
    value = float(text)
    if not whole:
        return value, comma
    if not value.is_integer():
        raise HeaderError(f"{name} is not a whole number: {text!r}")
    return int(value), comma


def column_names(signals: list[dict], reserved: str = "time_s", rounds: int = 8) -> dict[int, str]:
    """Signal to column: its label, with ``_ch<n>`` where that is shared, until no two are
    equal or the rounds are over."""
    data = [s for s in signals if not s["is_annotations"]]
    names = {s["signal_index"]: s["label"] or f"signal_{s['signal_index']}" for s in data}
    shared = Counter(names.values())
    names = {i: f"{n}_ch{i}" if shared[n] > 1 else n for i, n in names.items()}
    for _ in range(rounds):
        taken = Counter([reserved, *names.values()])
        if max(taken.values()) == 1:
            break
        names = {i: f"{n}_ch{i}" if taken[n] > 1 else n for i, n in names.items()}
    return names


def parse_header(data: bytes) -> Header:
    """``data``: at least the header's bytes; more may follow."""
    if len(data) < 256:
        raise HeaderError("shorter than 256 bytes")
    fixed, at, commas = {}, 0, False
    for name, width in FIXED_FIELDS:
        fixed[name], at = data[at : at + width], at + width
    wide = fixed["version"][:1] == b"\xff" and text_of(fixed["version"][1:]) == "BIOSEMI"
    for name, _ in FIXED_FIELDS:
        if name in ("declared_header_bytes", "data_records_declared", "signal_count", "record_duration_seconds"):
            fixed[name], comma = number_of(fixed[name], name, name != "record_duration_seconds")
            commas |= comma
        else:
            fixed[name] = text_of(fixed[name])
    n = fixed["signal_count"]
    if n < 1 or fixed["record_duration_seconds"] < 0:
        raise HeaderError("no signals, or a negative record duration")
    if len(data) < 256 * (n + 1):
        raise HeaderError("the signals' header is cut short")
    signals = [{"signal_index": i} for i in range(n)]
    for name, width in SIGNAL_FIELDS:
        for signal in signals:
            raw, at = data[at : at + width], at + width
            if name.startswith(("physical", "digital", "samples")):
                signal[name], comma = number_of(raw, name, not name.startswith("physical"))
                commas |= comma
            else:
                signal[name] = text_of(raw)
    sample_bytes, offset = 3 if wide else 2, 0
    duration = fixed["record_duration_seconds"]
    for signal in signals:
        spr = signal["samples_per_record"]
        if spr < 0:
            raise HeaderError("a negative number of samples")
        signal["byte_offset"] = offset
        signal["is_annotations"] = signal["label"] in ANNOTATION_LABELS
        signal["rate_hz"] = min(spr / duration, float("inf")) if duration else float("inf") if spr else 0.0
        offset += spr * sample_bytes
    names = column_names(signals)
    for signal in signals:
        signal["column_name"] = names.get(signal["signal_index"])
    mark = re.match(r"(EDF|BDF)\+([CD])", fixed["reserved"])
    fixed["continuity"] = f"EDF+{mark[2]}" if mark else None
    fixed["is_bdf"] = wide
    return Header(fixed, signals, 256 * (n + 1), offset, sample_bytes, commas)


def stated_start(slot: bytes) -> float | None:
    """The onset of a slot's first list, readable or not; padding is no list."""
    for chunk in slot.split(b"\0"):
        if chunk.strip(PADDING):
            found = ONSET.match(chunk)
            value = float(found[1]) if found else None
            return value if value is not None and abs(value) < float("inf") else None
    return None
