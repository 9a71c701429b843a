"""Near-duplicates between splits and within lists against plain loops."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from scriptmend.operators import diversity, leakage


def plain_seen(rows, n=5, percent=80):
    def grams(ws):
        ws = ws or []
        return [tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)] if len(ws) >= n else [tuple(ws)] if ws else []

    order = list(leakage.BITS)
    has = {s: {g for _, split, ws in rows if split == s for g in grams(ws)} for s in order}
    out = []
    for k, split, ws in rows:
        if split not in ("dev", "heldout"):
            continue
        before = set().union(*(has[s] for s in order[: order.index(split)]))
        own = grams(ws)
        shared = set(own) & before
        out.append((k, split, len(own), sum(g in before for g in own), len(set(own)), len(shared), bool(own) and 100 * len(shared) >= percent * len(set(own))))
    return sorted(out)


def drawn(seed):
    rng = random.Random(seed)
    text = lambda n, words: [f"w{rng.randrange(words)}" for _ in range(n)]
    base = [text(60, 500) for _ in range(5)]
    rows = []
    for k in range(150):
        ws = list(rng.choice(base)) if rng.random() < 0.5 else text(rng.randrange(0, 50), 6)
        for _ in range(rng.choice([0, 0, 1, 3])):
            if ws:
                ws[rng.randrange(len(ws))] = "x"
        rows.append((k, rng.choice(["train", "dev", "heldout"]), ws))
    return rows


def test_seen_before_is_a_plain_loop(spark):
    edges = [(900, "dev", None), (901, "heldout", []), (902, "train", ["a", "b"]), (903, "dev", ["a", "b"]), (904, "heldout", ["b", "a"]), (905, None, ["a", "b"]), (906, "other", ["a"] * 9), (907, "heldout", ["z"] * 3000), (908, "dev", ["z"] * 5)]
    for seed in (1, 2):
        rows = drawn(seed) + edges
        df = spark.createDataFrame(rows, "id long, split string, ws array<string>").withColumn("k", F.lit(1)).withColumn("h", F.lit("z"))
        assert sorted(map(tuple, leakage.seen_before(df, "id").collect())) == plain_seen(rows)


def test_nothing_to_hold_against(spark):
    schema = "id long, split string, ws array<string>"
    assert leakage.seen_before(spark.createDataFrame([], schema), "id").collect() == []
    only = spark.createDataFrame([(1, "heldout", ["a"] * 8), (2, "heldout", ["a"] * 8)], schema)
    assert sorted(map(tuple, leakage.seen_before(only, "id").collect())) == [(1, "heldout", 4, 0, 1, 0, False), (2, "heldout", 4, 0, 1, 0, False)]


def plain_pairs(word):
    w = f"^{word}$"
    return {w[i : i + 2] for i in range(len(w) - 1)}


def plain_likeness(a, b):
    a, b = plain_pairs(a), plain_pairs(b)
    return len(a & b) / len(a | b)


def plain_diverse(words, scores, k=5, weight=0.7):
    taken = []
    while len(taken) < min(k, len(words)):
        left = [i for i in range(len(words)) if i not in taken]
        worth = {i: weight * round(math.exp(scores[i]), 6) - round(1 - weight, 10) * max((plain_likeness(words[i], words[j]) for j in taken), default=0.0) for i in left}
        taken.append(max(left, key=lambda i: (worth[i], -i)))
    return [words[i] for i in taken]


def test_diverse_lists_are_plain_loops(spark):
    rng = random.Random(4)
    cases = {}
    for c in range(40):
        words = ["".join(rng.choice("abc") for _ in range(rng.randrange(0, 5))) for _ in range(rng.choice([1, 2, 5, 12, 20]))]
        cases[c] = (words, sorted((round(math.log(rng.choice([0.5, 0.1, 0.1, 0.02])), 6) for _ in words), reverse=True))
    rows = [(c, w, s, r) for c, (ws, ss) in cases.items() for r, (w, s) in enumerate(zip(ws, ss, strict=True))]
    df = spark.createDataFrame([*rows, (99, None, -1.0, 0), (99, "a", None, 1), (0, "far", -9.0, 20)], "case_id long, candidate string, score double, rank int").withColumn("list", F.lit(0)).repartition(3)
    told = diversity.lists(df, ["case_id"])
    got = {r.case_id: [x.candidate for x in r.list] for r in diversity.diverse(told, ["case_id"]).collect()}
    assert got == {c: plain_diverse(*cases[c]) for c in cases}
    for found, lists in ((told, {c: ws[:5] for c, (ws, _) in cases.items()}), (diversity.diverse(told, ["case_id"]), got)):
        likes = [plain_likeness(ws[i], ws[j]) for ws in lists.values() for i in range(len(ws)) for j in range(i)]
        r = diversity.rates(found, []).first()
        assert (r.n_lists, r.n_pairs) == (len(cases), len(likes))
        assert math.isclose(r.near_rate, 100 * sum(x >= 0.5 for x in likes) / len(likes), abs_tol=1e-4)
        assert math.isclose(r.mean_distance, sum(1 - x for x in likes) / len(likes), abs_tol=1e-6)
    alone = diversity.rates(told.filter(F.size("list") == 1), []).first()
    assert alone.n_pairs == 0 and alone.near_rate is None
