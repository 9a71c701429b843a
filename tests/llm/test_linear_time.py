"""Personal data in texts of long digit runs and long lines: the same result, in linear time."""

from __future__ import annotations

import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptmend.llm import pii

PLAIN_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


@settings(max_examples=500, deadline=None)
@given(st.text("019.@+- a", max_size=40))
def test_ip_is_the_plain_pattern(text):
    want = [m.span() for m in PLAIN_IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    assert [(a, b) for k, a, b in pii.base_spans(text) if k == "ip"] == want


@pytest.mark.parametrize("text", ["1" * 2_000_000, "1." * 700_000, "1.2." + "3" * 1_500_000, "+1(" * 400_000, "9 " * 700_000])
def test_digits_take_linear_time(text):
    began = time.process_time()
    pii.base_spans(text)
    assert time.process_time() - began < 10


WORDS = ["call", "me", "at", "020", "7946", "0958", "jane", "(at)", "x", "dot", "com", "id", "123456789", "12", "on", "Monday,", "415-555-0132", "[dot]", "org."]


@pytest.mark.parametrize("size", [1, 2, 255, 256, 257, 512, 3000])
def test_blocks_change_no_tag(size):
    rng = random.Random(size)
    field = pii.trained()
    lines = [[rng.choice(WORDS) for _ in range(size)] for _ in range(3)]
    whole, cut = pii.Decoder(field), pii.Decoder(field)
    whole.LONG, cut.LONG = 10**9, 0
    want, got = whole.lines(lines), cut.lines(lines)
    assert want.keys() == got.keys() and all((want[k] == got[k]).all() for k in want)


@pytest.mark.parametrize(("block", "at_once"), [(2, 3), (5, 2), (16, 1)])
def test_blocks_of_random_scores(block, at_once):
    rng = np.random.default_rng(block)
    moves = pii.exact(np.where(pii._ALLOWED, rng.normal(size=pii._ALLOWED.shape), -1e4))
    for size in (1, 2, 7, 33, 100):
        scores = pii.exact(rng.normal(size=(size, len(pii.TAGS))) * 2)
        want = pii.viterbi(scores[:, :, None], np.array([size]), moves)[0]
        assert (pii.viterbi_blocks(lambda a, b, scores=scores: scores[a:b], size, moves, block, at_once) == want).all()


def test_a_long_line_takes_linear_time():
    rng = random.Random(1)
    line = " ".join(rng.choice(WORDS) for _ in range(1_000_000))
    decoder = pii.Decoder(pii.trained())
    began = time.process_time()
    (base, spans), = pii.all_spans([line], decoder)
    assert time.process_time() - began < 40 and len(spans) > 1000


def test_a_long_line_is_tagged_as_its_copies(spark):
    rng = random.Random(2)
    line = " ".join(rng.choice(WORDS) for _ in range(5000))
    rows = [(k, t, "x") for k, t in enumerate([line, line + "\n" + line, None, ""])]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {r.doc_id: r.spans for r in pii.find_pii(df).collect()}
    one = [x.split(":") for x in got[0].split(",")]
    twice = sorted(x.split(":") for x in got[1].split(","))
    assert twice == sorted([*one, *([k, str(int(a) + len(line) + 1), str(int(b) + len(line) + 1)] for k, a, b in one)])
    assert got[2] == got[3] == ""
