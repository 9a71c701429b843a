"""Searches of tables with few different vectors."""

from __future__ import annotations

import numpy as np
import pytest

from scriptmend.llm import ann


def brute(ids, x, q, k=10):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    return [int(ids[j]) for j in np.lexsort((ids, d)) if ids[j] != ids[q]][:k]


@pytest.mark.parametrize("n", [2, 8, 11, 12, 15])
def test_no_query_is_short_of_neighbours(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert {q: len(f) for q, f in got.items()} == {q: min(10, n - 1) for q in range(n)}
    if n <= 11:
        assert all([v for _, v in sorted(got[q])] == brute(np.arange(n), x, q) for q in got)


def test_folded_table(spark):
    x = np.random.default_rng(7).normal(size=(15, 8))
    x = np.concatenate([x, np.repeat(x[:1] + 30, 200, 0)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, df.filter("vec_id < 15 or vec_id = 100")).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert all(len(v) == 10 for v in got.values()) and len(got) == 16
