"""Secrets of long values and under long names."""

from __future__ import annotations

import base64
import hashlib
import time

import pytest

from scriptmend.llm import secrets

KEY = "qZ7rT2vX9kLm4NpB8sWc"


def found(text):
    return [text[a:b] for kind, a, b in secrets.scan_text(text)[1] if kind == "literal"]


def test_long_values():
    value = base64.b64encode(b"".join(hashlib.sha256(bytes([i])).digest() for i in range(200))).decode()
    assert len(value) > 4096
    assert found(f'x = 1\nprivate_key = "{value}"\n') == [value]


@pytest.mark.parametrize("n", [10, 60, 100, 150, 1000])
@pytest.mark.parametrize("form", ['{{"{}": "{}"}}', '{{"a": 1, "{}" : "{}"}}', 'conf["{}"] = "{}"', '{} = "{}"', '{}: str = "{}"'])
def test_long_names(n, form):
    assert found(form.format("a" * n + "_private_key", KEY)) == [KEY]


def test_placeholder_words_inside_keys():
    for value in ("AbC9none1234567890", "aNull9283hfksdhf", "q7trueX2falseY8", "Zx81exampled92Kq"):
        assert found(f'private_key = "{value}"') == [value]
    long = "Ab9null" + KEY * 20
    assert found(f"private_key={long}") == [long]
    for value in ("your_private_key_1", "null-Null-null-1", "<put-Key-9-here>", "xxxxxxxxxxxx", "${PRIVATE_KEY_1}", "Change-me.example.9", "%PRIVATE_KEY_1%"):
        assert found(f'private_key = "{value}"') == [], value
    marked = KEY * 20 + "_example_" + KEY
    assert found(f"private_key={marked}") == found(f'private_key = "{marked}"') == []


def test_time_grows_with_length():
    for text in ('w' * 300_000 + '" = x', "word " * 60_000 + '": x'):
        began = time.process_time()
        secrets.scan_text(text)
        assert time.process_time() - began < 5
