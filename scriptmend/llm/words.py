"""Words of many texts at once: runs of wanted bytes of their UTF-8, A-Z lower-cased, found with array operations.

A word never crosses texts. Bytes of 0x80 and over belong to words, so that no character is cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

LOT_BYTES = 16 << 20


def _table(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for first, last in ranges:
        table[first : last + 1] = True
    return table


#: Bytes of words: letters, and letters with digits. Of A-Z the small ones.
LETTERS = _table((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
ALPHANUMERIC = LETTERS | _table((0x30, 0x39))
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[0x41:0x5B] += 0x20


class Words(NamedTuple):
    """``words`` in order; ``text``: the number of each one's text; ``start`` and ``end``: byte places in ``data``, where text k begins at ``begins[k]``."""

    words: pa.StringArray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray
    begins: np.ndarray


def lots(texts: pa.StringArray, lot_bytes: int = LOT_BYTES) -> Iterator[tuple[int, pa.StringArray]]:
    """(number of the first, neighbouring texts of about so many bytes together); a longer text is a lot of its own, whole."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + lot_bytes, "right")) - 1)
        yield at, texts.slice(at, to - at)
        at = to


def words_of(texts: pa.StringArray, wanted: np.ndarray) -> Words:
    """The words of texts, which hold no null."""
    begins = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[begins[0] : begins[-1]] if raw is not None else np.empty(0, np.uint8)
    begins = begins - begins[0]
    keep = wanted[data]
    first, last = keep.copy(), keep.copy()
    first[1:] &= ~keep[:-1]
    last[:-1] &= ~keep[1:]
    inner = begins[1:-1][(begins[1:-1] > 0) & (begins[1:-1] < len(data))]
    first[inner] = keep[inner]
    last[inner - 1] = keep[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    ends = np.zeros(len(start) + 1, np.int32)
    np.cumsum(end - start, out=ends[1:])
    made = pa.StringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(_SMALL[data[keep]])))
    return Words(made, np.searchsorted(begins, start, "right") - 1, start, end, data, begins)
