"""Spans (kind, start, end) of texts, and the columns that queries derive from them."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from itertools import accumulate


def ordered(spans: list[tuple[str, int, int]], kinds: tuple[str, ...]) -> list[tuple[str, int, int]]:
    """By start, then by kind as listed."""
    return sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2]))


def joined(spans: list[tuple[str, int, int]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{z}" for k, a, z in ordered(spans, kinds))


def digest(spans: list[tuple[str, int, int]], kinds: tuple[str, ...]) -> str:
    return hashlib.sha256(joined(spans, kinds).encode()).hexdigest()


class Taken:
    """Places that spans cover; asking costs the logarithm of their number."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        by_start = sorted((s, e) for _, s, e in spans)
        self._starts = [s for s, _ in by_start]
        self._reach = list(accumulate((e for _, e in by_start), max))  # the furthest end of the spans so far

    def overlaps(self, a: int, z: int) -> bool:
        """Whether a span shares a character with [a, z)."""
        before = bisect_left(self._starts, z)
        return before > 0 and self._reach[before - 1] > a
