"""Words for lists and counts in messages."""

from __future__ import annotations


def listed(items: list[str], limit: int = 8) -> str:
    """At most ``limit`` items, or one more where only that one would be left out."""
    if len(items) <= limit + 1:
        return ", ".join(items)
    return f"{', '.join(items[:limit])} and {len(items) - limit} more"


def counted(n: int, one: str, many: str | None = None) -> str:
    return f"{n} {one if n == 1 else many or one + 's'}"
