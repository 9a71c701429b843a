"""Span choosers and resamples by cluster against plain loops."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptmend.functions.text import GAP
from scriptmend.operators import choosers, resampling


def unit(seed, key, t):
    return int(hashlib.md5(f"{seed}:{key}:{t}".encode()).hexdigest()[:8], 16) / 4294967296


def length(seed, key, t):
    return min(choosers.LONGEST, 1 + math.floor(math.log(1 - unit(seed + "-len", key, t)) / math.log(1 - choosers.P)))


def plain_whole(key, n, tries=50):
    chosen, goal = [], max(1, round(n * choosers.SHARE))
    for t in range(1, tries + 1):
        if not n or len(chosen) >= goal:
            break
        size = min(length("spans", key, t), n)
        start = math.floor(unit("spans", key, t) * max(1, n - size + 1))
        span = range(start, start + size)
        if not set(span) & set(chosen):
            chosen += span
    return sorted(chosen)


def plain_preserved(key, words, tries=100):
    free = [i for i, w in enumerate(words) if w != GAP]
    chosen, goal = [], max(1, round(len(free) * choosers.SHARE))
    for t in range(1, tries + 1):
        if not free or len(chosen) >= goal:
            break
        start = free[math.floor(unit("preserved", key, t) * len(free))]
        for i in range(start, min(start + length("preserved", key, t), len(words))):
            if words[i] == GAP or len(chosen) >= goal:
                break
            if i not in chosen:
                chosen.append(i)
    return sorted(chosen)


def drawn_rows():
    rng = random.Random(9)
    sizes = [0, 1, 2, 3, 10, 30, 33, 100, 3000]
    rows = [(k, [GAP if rng.random() < 0.2 else f"w{i}" for i in range(n)], "m") for k, n in enumerate(sizes * 3)]
    return [*rows, (500, [GAP] * 20, "m"), (501, None, "m"), (502, ["a"] * 40, "m"), (502, ["a"] * 40, "m"), (503, [GAP, "a"] * 15, "m")]


def test_choosers_are_plain_loops(spark):
    rows = drawn_rows()
    df = spark.createDataFrame(rows, "doc_id long, ws array<string>, masked_at string")
    whole = [(r.doc_id, r.masked_at) for r in choosers.whole_spans(df, "doc_id").collect()]
    assert sorted(whole) == sorted((k, plain_whole(k, len(ws or []))) for k, ws, _ in rows)
    kept = [(r.doc_id, r.masked_at) for r in choosers.preserved_spans(df, "doc_id").collect()]
    assert sorted(kept) == sorted((k, plain_preserved(k, ws or [])) for k, ws, _ in rows)
    of = {k: ws for k, ws, _ in rows}
    for k, at in kept:
        free = sum(w != GAP for w in of[k] or [])
        assert len(at) == len(set(at)) and all(of[k][i] != GAP for i in at)
        # tries suffice on short rows: the budget is met exactly
        assert len(at) == (max(1, round(free * choosers.SHARE)) if free else 0) or free > 1000
    for k, at in whole:
        assert len(at) == len(set(at)) and len(at) < max(1, round(len(of[k] or []) * choosers.SHARE)) + choosers.LONGEST


def test_draws_are_even_and_the_same_in_columns(spark):
    b = np.arange(200)
    drawn = resampling.draws(b, 50)
    counts = np.bincount(drawn.reshape(-1), minlength=50)
    assert drawn.min() == 0 and drawn.max() == 49 and abs(counts - 200).max() < 80
    x = np.array([0, 1, 2, 77, 2**31, 2**32 - 1, 123456789], np.uint64)
    got = [r[0] for r in spark.createDataFrame([(int(v),) for v in x], "x long").select(resampling._mixed_column(F.col("x"))).collect()]
    assert got == resampling.mixed(x).tolist()


def plain_delta(cases, k, rounds, seed):
    names = sorted({c for c, *_ in cases})
    n, d = [0] * len(names), [0] * len(names)
    for cluster, x, y in cases:
        at = names.index(cluster)
        n[at] += 1
        d[at] += (y is not None and y < k) - (x is not None and x < k)
    rates = []
    for b in range(rounds):
        own = resampling.draws(np.array([b]), len(names), seed)[0]
        rates.append((round(100.0 * sum(d[i] for i in own) / sum(n[i] for i in own), 6), b))
    rates.sort()
    return round(100.0 * sum(d) / sum(n), 6), rates[int(0.025 * rounds)][0], rates[int(0.975 * rounds) - 1][0]


@pytest.mark.parametrize("held", [resampling.HELD, 3])
def test_delta_is_a_plain_loop(spark, held):
    rng = random.Random(2)
    cases = [(f"c{min(11, int(rng.expovariate(0.3)))}", *(rng.choice([None, 0, 3, 7, 15]) for _ in "xy")) for _ in range(150)]
    table = lambda name, rows: spark.createDataFrame(rows, f"case_id int, {name}").repartition(3)
    a, b = (table("gold_rank int", [(k, c[s]) for k, c in enumerate(cases) if c[s] is not None or k % 2]) for s in (1, 2))
    clusters = table("cluster string", [(k, c[0]) for k, c in enumerate(cases)])
    got = {r.k: (r.delta, r.low, r.high, r.n, r.n_clusters) for r in resampling.paired_delta(a, b, clusters, (1, 10), 80, 7, held).collect()}
    assert got == {k: (*plain_delta(cases, k, 80, 7), 150, len({c[0] for c in cases})) for k in (1, 10)}


def test_delta_of_nothing(spark):
    none = spark.createDataFrame([], "case_id int, gold_rank int")
    assert resampling.paired_delta(none, none, spark.createDataFrame([], "case_id int, cluster string")).collect() == []


def test_one_cluster_has_no_spread(spark):
    ranks = lambda rs: spark.createDataFrame(list(enumerate(rs)), "case_id int, gold_rank int")
    clusters = spark.createDataFrame([(k, "x") for k in range(4)], "case_id int, cluster string")
    (row,) = resampling.paired_delta(ranks([0, None, 5, 12]), ranks([0, 0, 0, None]), clusters, (1,), 40).collect()
    assert (row.delta, row.low, row.high, row.n_clusters, row.n) == (50.0, 50.0, 50.0, 1, 4)
