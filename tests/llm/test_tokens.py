"""Encoding, decoding and counts against the tokenizers library."""

from __future__ import annotations

import hashlib
import random

import pytest
from tokenizers import Tokenizer

from scriptmend.llm import bpe, token_counts
from scriptmend.llm.queries import tokenizer_path

from ..conftest import SMALL

ALPHABET = "abcdeé  \n\t'sß$$ıİΣσςÅ<|endoftext|>日本語한국ñ\x1c\x85\xa0٣½ⅧDžafi🙂🏽"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def samples():
    rng = random.Random(4)
    return [None, "", " \n", "x" * 3000, "ab" * 2500, "&" * 700, "it's we'll 'sfoo ''s", "ΑΣ ΑΣΑ", "<|endoftext|>a<|startoftext|>"] + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(400)]


def test_encoder_equals_library(library):
    coder = bpe.Encoder(bpe.engine(tokenizer_path()), cache_words=500)
    for text in samples():
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert coder.encode(text or "") == ids
        assert coder.eng.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_queries_equal_library(spark, library):
    rows = [(i, t, "x", "y") for i, t in enumerate(samples())] + [(0, None, "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded string")
    want = {}
    for i, t, _, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = bpe.digests(df, tokenizer_path()).collect()
    assert len(got) == len(rows) and all(tuple(r)[1:] == want[r.doc_id] for r in got)
    counts = token_counts.count_tokens(df, tokenizer_path(), limit=100, frequent=50).collect()
    assert len(counts) == len(rows)
    assert all((r.n_tokens, r.n_bytes, r.over_limit) == (want[r.doc_id][0], len((rows[r.doc_id][1] or "").encode()), want[r.doc_id][0] > 100) for r in counts)
    empty = df.limit(0)
    assert bpe.digests(empty, tokenizer_path()).count() == token_counts.count_tokens(empty, tokenizer_path()).count() == 0


def test_documents(spark, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in token_counts.count_tokens(docs, tokenizer_path()).collect():
        assert r.n_tokens == len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)


def test_heavy_hitters_stay():
    seen = token_counts.HeavyHitters(10)
    for i in range(500):
        seen.add(["common", f"w{i}", "common", f"v{i}"])
    assert seen.heaviest(1)[0][0] == "common" and len(seen.counts) <= 20
