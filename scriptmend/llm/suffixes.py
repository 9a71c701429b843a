"""Sorting suffixes block by block with a difference cover, in numpy.

A difference cover of period 16 holds, for any two positions, an offset below 16 that leads both into the
sample. The sample's suffixes are ranked first, by doubling to 64 bytes. Suffixes to be sorted are then dealt
into blocks by splitters taken from the sorted sample and sorted one block at a time: by their first 16 bytes
directly, and where those tie by three-way partition, comparing each suffix with its group's pivot by the
sample ranks at their common offset. Memory is bounded by the ranks and one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PERIOD, COVER = 16, (0, 1, 2, 5, 8)
#: Bytes that the order is exact to, at least; a text must be followed by so many bytes of padding.
DEPTH = 64
_IN = np.isin(np.arange(PERIOD), COVER)
_SHIFT = np.array([[next(d for d in range(PERIOD) if _IN[(a + d) % PERIOD] and _IN[(b + d) % PERIOD]) for b in range(PERIOD)] for a in range(PERIOD)])


def words(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as a big-endian number, as a view."""
    return np.ndarray((len(text) - 7,), ">u8", text.data, 0, (1,))


def dense(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks from 1 of fewer than 2^32 pairs, equal pairs alike, and an order.

    Sorted by ``high`` alone, and where that ties once more by both as one number: numpy sorts one number far faster than two keys.
    """
    order = np.argsort(high)
    h = high[order]
    new = np.ones(len(order), bool)
    new[1:] = h[1:] != h[:-1]
    tied = np.append(~new[1:], False) | ~new if len(order) else new
    live = np.flatnonzero(tied)
    if len(live):
        own = order[live]
        x = low[own]
        by = np.argsort(x)
        x = x[by]
        small = np.empty(len(x), np.uint64)
        small[by] = np.cumsum(np.append(False, x[1:] != x[:-1]))
        key = (np.cumsum(new)[live].astype(np.uint64) << np.uint64(32)) | small
        turn = np.argsort(key)
        order[live], key = own[turn], key[turn]
        new[live] = np.append(True, key[1:] != key[:-1])
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.cumsum(new)
    return ranks, order


class Cover:
    """Ranks of the cover sample of one text (uint8, padded by DEPTH + PERIOD zeros or more)."""

    def __init__(self, text: np.ndarray) -> None:
        self.text, self.words = text, words(text)
        n = len(text) - DEPTH - PERIOD
        self.at = np.flatnonzero(_IN[np.arange(n + PERIOD) % PERIOD])
        w = self.words
        self.rank = np.zeros(len(text) + DEPTH, np.int64)
        ranks, order = dense(w[self.at].astype(np.uint64), w[self.at + 8].astype(np.uint64))
        step = PERIOD
        while step < DEPTH:
            self.rank[self.at] = ranks
            ranks, order = dense(ranks, self.rank[self.at + step])
            step *= 2
        self.rank[self.at] = ranks
        self.order = self.at[order]

    def splitters(self, blocks: int) -> np.ndarray:
        """First 8 bytes of evenly spaced suffixes of the sorted sample."""
        picks = np.linspace(0, len(self.order), blocks + 1).astype(int)[1:-1]
        return np.unique(self.words[self.order[picks]].astype(np.uint64)) if len(self.order) else np.empty(0, np.uint64)

    def sorted_blocks(self, suffixes: np.ndarray, block: int = 1 << 18) -> Iterator[np.ndarray]:
        """The suffixes (positions) in order of DEPTH bytes or more, one block after another; equal first 8 bytes share a block."""
        first = self.words[suffixes].astype(np.uint64)
        cuts = self.splitters(max(1, -(-len(suffixes) // block)))
        which = np.searchsorted(cuts, first, side="right")
        for b in range(len(cuts) + 1):
            own = np.flatnonzero(which == b) if len(cuts) else slice(None)
            yield self._sorted(suffixes[own], first[own])

    def _sorted(self, at: np.ndarray, first: np.ndarray) -> np.ndarray:
        if not len(at):
            return at
        ranks, order = dense(first, self.words[at + 8].astype(np.uint64))
        at, group = at[order], ranks[order]
        live = np.arange(len(at))
        while len(live):
            g = group[live]
            edge = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            size = np.diff(np.append(edge, len(g)))
            keep = np.repeat(size > 1, size)
            live, g = live[keep], g[keep]
            if not len(live):
                break
            edge = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            size = np.diff(np.append(edge, len(g)))
            here = at[live]
            pivot = np.repeat(here[edge + size // 2], size)
            shift = _SHIFT[here % PERIOD, pivot % PERIOD]
            side = np.sign(self.rank[here + shift] - self.rank[pivot + shift])
            number = np.repeat(np.arange(len(edge)), size)
            turn = np.argsort(number * 3 + side + 1, kind="stable")
            at[live], side, number = here[turn], side[turn], number[turn]
            # new groups get numbers of their own; those equal to their pivot are done
            part = number * 3 + side + 1
            group[live] = part
            live = live[side != 0]
        return at


def equal_runs(text_words: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For suffixes in order: number, from 0, of the run of suffixes whose first ``length`` bytes (8 or more) are equal."""
    differ = np.zeros(len(order), bool)
    for k in [*range(0, length - 7, 8), length - 8]:
        w = text_words[order + k]
        differ[1:] |= w[1:] != w[:-1]
    return np.cumsum(differ)
