"""Spans of a text: (kind, start, end) in code points, end exclusive, and how they are written down."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Sequence

Span = tuple[str, int, int]


def written(spans: Iterable[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def digest(spans: Iterable[Span]) -> str:
    return hashlib.sha256(written(spans).encode()).hexdigest()


def by_start(spans: Iterable[Span], kinds: Sequence[str]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2]))


def by_kind(spans: Iterable[Span], kinds: Sequence[str]) -> list[Span]:
    return sorted(spans, key=lambda s: (kinds.index(s[0]), s[1], s[2]))


def outside(new: Iterable[Span], base: Iterable[Span]) -> list[Span]:
    """Those of ``new`` that touch no span of ``base`` and none taken before, by start and the longest first."""
    begins: list[int] = []
    ends: list[int] = []
    for a, b in sorted((a, b) for _, a, b in base):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            begins.append(a)
            ends.append(b)
    out: list[Span] = []
    taken = 0
    for kind, a, b in sorted(new, key=lambda s: (s[1], -s[2])):
        k = bisect_left(begins, b) - 1
        if a >= taken and (k < 0 or ends[k] <= a):
            out.append((kind, a, b))
            taken = b
    return out
