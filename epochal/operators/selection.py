"""Channels of one header by terms: labels in any case, or #positions."""

from __future__ import annotations

import re

from ..functions.lists import listed


class SelectionError(ValueError):
    """A selection that names no channel."""


def distance(a: str, b: str) -> int:
    """Edits of one character that turn ``a`` into ``b``."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
    return row[-1]


def close_labels(term: str, labels: list[str]) -> list[str]:
    """Labels at most two edits or a third of the term away, nearest first, then in file order."""
    found = [(distance(term.lower(), x.lower()), k, x) for k, x in enumerate(dict.fromkeys(labels)) if x]
    return [x for d, _, x in sorted(found) if d <= max(2, len(term) // 3)]


def selected(signals: list[dict], terms: list[str]) -> list[dict]:
    """The data channels that the terms name, each once, in file order.

    A label names every channel that has it; a label that looks like a position wins."""
    data = [s for s in signals if not s["is_annotations"]]
    positions, chosen = listed([f"#{s['signal_index']}" for s in data]), set()
    for term in filter(None, (t.strip() for t in terms)):
        same = [s["signal_index"] for s in data if s["label"].lower() == term.lower()]
        if term.startswith("#") and not same:
            if not re.fullmatch(r"#[0-9]+", term):
                raise SelectionError(f"{term!r} is not a position such as #0; there are {positions}")
            same = [s["signal_index"] for s in data if s["signal_index"] == int(term[1:])]
            if not same:
                raise SelectionError(f"no channel at {term}; there are {positions}")
        if not same:
            owner = next((s for s in data if (s["column_name"] or "").lower() == term.lower()), None)
            if owner:
                raise SelectionError(f"{term!r} is the name of a column; its channel is #{owner['signal_index']}, labelled {owner['label']!r}")
            if any(s["is_annotations"] and s["label"].lower() == term.lower() for s in signals):
                raise SelectionError(f"{term!r} holds events, not samples")
            close = close_labels(term, [s["label"] for s in data])
            raise SelectionError(f"no channel {term!r}" + (f"; close: {listed(close, 3)}" if close else ""))
        chosen.update(same)
    if not chosen:
        raise SelectionError("no channel is selected")
    return [s for s in data if s["signal_index"] in chosen]


def ambiguous(signals: list[dict], terms: list[str]) -> list[tuple[str, list[int]]]:
    """Terms whose label several channels share, with their positions."""
    out = []
    for term in filter(None, (t.strip() for t in terms)):
        same = [s["signal_index"] for s in signals if not s["is_annotations"] and s["label"].lower() == term.lower()]
        if len(same) > 1:
            out.append((term, same))
    return out
