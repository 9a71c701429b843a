"""Spelled-out addresses of any length."""

from __future__ import annotations

import numpy as np
import pytest

from scriptmend.llm import pii


@pytest.fixture(scope="module")
def decoder():
    return pii.Decoder(pii.trained())


@pytest.mark.parametrize("n", [1, 2, 3, 4, 6, 12])
def test_long_addresses(decoder, n):
    address = "john at mail" + "".join(f" dot {w}" for w in (["cs", "uni", "lab", "sub"] * 3)[: n - 1]) + " dot edu"
    text = f"please write to {address} about the plan"
    (_, spans), = pii.all_spans([text], decoder)
    assert [text[a:b] for kind, a, b in spans] == [address]


def test_window_ends_see_their_neighbours(decoder):
    line = ("word " * 30 + "call 555 010 9999 now " + "word " * 30 + "mail ann at uni dot edu " + "word " * 30).split()
    whole = pii.Decoder(decoder.field)
    whole.REACH = 1000
    a, b = decoder.lines([line])[0], whole.lines([line])[0]
    assert np.array_equal(a, b)
