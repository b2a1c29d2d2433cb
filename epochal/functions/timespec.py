"""Times as people write them: 90, 1:30, 0:01:30.5, 1m30s, 1h 30m 15s."""

from __future__ import annotations

import re

# Unit spellings and their seconds.
UNITS = {"ms": 0.001, "s": 1, "sec": 1, "secs": 1, "second": 1, "seconds": 1, "m": 60, "min": 60, "mins": 60, "minute": 60, "minutes": 60, "h": 3600, "hr": 3600, "hrs": 3600, "hour": 3600, "hours": 3600}
BARE = re.compile(r"[0-9]+(?:\.[0-9]+)?")
CLOCK = re.compile(r"(?:([0-9]+):)?([0-9]{1,2}):([0-9]{1,2}(?:\.[0-9]+)?)")
PART = re.compile(r"([0-9]+(?:\.[0-9]+)?)([a-z]+)\s*")


class TimeSpecError(ValueError):
    """A text that is no time."""


def seconds_of(text: str, position: bool = True) -> float:
    """Seconds. A position, not a length, may have a minus, which holds for all of it.
    White space may stand between parts, but not between a number and its unit."""
    whole = text.strip().lower()
    sign, body = (-1.0, whole[1:]) if whole.startswith("-") else (1.0, whole)
    if sign < 0 and not position:
        raise TimeSpecError(f"a length has no sign: {text!r}")
    if BARE.fullmatch(body):
        return finite(sign * float(body), text)
    if clock := CLOCK.fullmatch(body):
        if int(clock[2]) >= 60 or float(clock[3]) >= 60:
            raise TimeSpecError(f"minutes and seconds stay under 60: {text!r}")
        return finite(sign * (int(clock[1] or 0) * 3600 + int(clock[2]) * 60 + float(clock[3])), text)
    parts, at, total, seen = 0, 0, 0.0, set()
    while m := PART.match(body, at):
        if m[2] not in UNITS:
            raise TimeSpecError(f"no unit {m[2]!r}: {text!r}")
        if UNITS[m[2]] in seen:
            raise TimeSpecError(f"a unit is there twice: {text!r}")
        seen.add(UNITS[m[2]])
        parts, at, total = parts + 1, m.end(), total + float(m[1]) * UNITS[m[2]]
    if not parts or at < len(body):
        raise TimeSpecError(f"not a time: {text!r}")
    return finite(sign * total, text)


def finite(seconds: float, text: str) -> float:
    if abs(seconds) == float("inf"):
        raise TimeSpecError(f"too far: {text!r}")
    return seconds
